"""Language-model scores by context-tree weighting over bytes.

A text is its words, lower-cased, joined by one space and closed by a line
feed: one byte string for each sequence of words and an end. A byte is eight
binary decisions, each with its own tree over the ``DEPTH`` bytes before it.
Every node holds the Krichevsky-Trofimov estimate of its zeros and ones and
mixes it, half and half, with the product of its children's mixtures; so all
depths are weighed by how well they coded the training texts. A new byte is
predicted by the estimates along its context with the weights that the
training texts left. Where a context goes on into a part of the tree that the
training texts never reached, the mixture ends at the last node they did.

*Counting.* Documents are dealt over blocks of bounded bytes. A block counts
its distinct byte strings of ``DEPTH + 1`` (and its distinct words) and sends
them, as sorted arrays, to shards by the three bytes before the last; nothing
moves for each position of a text. Strings of texts outside the training
fold go along with count 0, as the strings whose probability will be asked.
The number of shards grows with the data.

*Merging.* A shard adds up the arrays of at most ``FAN`` blocks at a time, in
as many levels as that takes. At the top it has whole subtrees from depth
``TOP`` on. The levels above have at most 256 ** 2 * 255 nodes, whatever the
data, and in practice as many as pairs of bytes occur; only these sums go to the driver.

*Answering.* Each array goes back the way it came, with a probability for each
string, and each block scores its own documents.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cambium.llm.words import U64, hashed, one_array, steps, words_of
from cambium.scratch import written

DEPTH, TOP = 5, 3
FOLDS = 10
#: Bytes of text in a block and, on average, of all text for each shard; least number of shards; arrays that one merge takes.
BLOCK_BYTES, SHARD_BYTES, SHARDS, FAN = 16 << 20, 8 << 20, 64, 256
GRAMS, WORDS = 0, 1
_END = 0x0A


def held_out(doc_id: Column, folds: int = FOLDS) -> Column:
    """Whether crc32 of the id as text, modulo ``folds``, is 0; a null id is an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == 0


# --- a step of texts ---------------------------------------------------------------------------------------------


class Step:
    """Words and byte strings of some texts."""

    def __init__(self, text: pa.Array):
        self.words = w = words_of(pc.ascii_lower(pc.fill_null(text, "")))
        flat = pa.DictionaryArray.from_arrays(pa.array(w.ids), w.unique).dictionary_decode()
        lists = pa.ListArray.from_arrays(pa.array(w.first, pa.int32()), flat)
        joined = pc.binary_join(lists, " ")
        pad = pa.scalar("\n" * DEPTH)
        whole = pc.binary_join_element_wise(pad, joined, pa.scalar("\n"), pa.scalar(""))
        _, offsets, data = whole.buffers()
        ends = np.frombuffer(offsets, np.int32)[whole.offset : whole.offset + len(whole) + 1].astype(np.int64)
        raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]]
        ends -= ends[0]
        keys = raw.astype(U64)
        wide = keys.copy()
        for j in range(1, DEPTH + 1):
            keys[j:] |= wide[:-j] << U64(8 * (DEPTH + 1 - j))
        real = np.ones(len(raw), bool)
        for j in range(DEPTH):
            real[ends[:-1] + j] = False
        self.keys = keys[real]
        self.n_bytes = np.diff(ends) - DEPTH
        self.first = np.concatenate([[0], np.cumsum(self.n_bytes)])
        self.word_hash = hashed(w.unique)


END_KEY = U64(0x5EED0FE4D0000001)  # stands for the end token among word hashes


def added(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys of several arrays with the sums of their counts."""
    k, c = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k, kind="stable")
    k, c = k[order], c[order]
    if not len(k):
        return k, c
    at = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    return k[at], np.add.reduceat(c, at)


def _planes(x: np.ndarray) -> bytes:
    """The bytes of an array, first bytes first: equal high bytes then compress away."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()


def _unplaned(blob: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(blob, np.uint8).reshape(size, -1).T).view(kind).reshape(-1)


def _pack(keys: np.ndarray) -> bytes:
    """Sorted keys as differences."""
    return _planes(np.diff(keys, prepend=U64(0)))


def _unpack(blob: bytes) -> np.ndarray:
    return np.cumsum(_unplaned(blob, U64), dtype=U64)


def shard_of(keys: np.ndarray, kind: int, shards: int) -> np.ndarray:
    """Shard by the ``TOP`` context bytes next to the predicted one, or by a word's hash."""
    top = keys >> U64(8 * (DEPTH + 1 - TOP)) if kind == GRAMS else keys >> U64(20)
    return ((top * U64(0x9E3779B97F4A7C15)) >> U64(32)) % U64(shards)


def counted(group: pa.Table, shards: int) -> pa.Table:
    """A block's distinct strings and words with their counts in training texts, one row for each shard."""
    parts: dict[int, tuple[list, list]] = {GRAMS: ([], []), WORDS: ([], [])}
    for b in steps(iter(group.combine_chunks().to_batches()), "text"):
        s = Step(one_array(b, "text"))
        learn = ~one_array(b, "held_out").to_numpy(zero_copy_only=False)
        marked = (s.keys << U64(1)) | np.repeat(learn, s.n_bytes).astype(U64)
        k, c = np.unique(marked, return_counts=True)
        parts[GRAMS][0].append(k >> U64(1))
        parts[GRAMS][1].append(np.where(k & U64(1), c, 0))
        per = np.bincount(s.words.ids, weights=np.repeat(learn, s.words.counts), minlength=len(s.words.unique)).astype(np.int64)
        parts[WORDS][0].append(np.append(s.word_hash, END_KEY))
        parts[WORDS][1].append(np.append(per, int(learn.sum())))
    block = group["block"][0].as_py()
    rows: list[tuple] = []
    for kind, (keys, counts) in parts.items():
        if not keys:
            continue
        k, c = added(keys, counts)
        shard = shard_of(k, kind, shards)
        for s in range(shards):
            mine = shard == s
            if mine.any():
                rows.append((kind, s, block, _pack(k[mine]), _planes(c[mine].astype(np.int64))))
    return _rows(rows, BLOBS)


BLOBS = pa.schema([("kind", pa.int32()), ("shard", pa.int32()), ("block", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])
BLOBS_SQL = "kind int, shard int, block long, keys binary, counts binary"


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.table([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def _merged(group: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    return added([_unpack(x) for x in group["keys"].to_pylist()], [_unplaned(x, np.int64) for x in group["counts"].to_pylist()])


# --- the tree ----------------------------------------------------------------------------------------------------


def lgamma(x: np.ndarray) -> np.ndarray:
    """log of the gamma function for x > 0, by Stirling's series after a shift of 8."""
    shift = np.zeros_like(x, dtype=float)
    for k in range(8):
        shift += np.log(x + k)
    z = x + 8
    return (z - 0.5) * np.log(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - shift


def log_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Log probability of a zeros and b ones in any one order, by the Krichevsky-Trofimov estimator."""
    return lgamma(a + 0.5) + lgamma(b + 0.5) - lgamma(a + b + 1.0) - math.log(math.pi)


def bit_nodes(context: np.ndarray, symbol: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nodes (context << 8 | 1 << k | first k bits) with their zeros and ones, sorted."""
    ids, zeros, ones = [], [], []
    for k in range(8):
        node = (context << U64(8)) | U64(1 << k) | (symbol >> U64(8 - k))
        bit = ((symbol >> U64(7 - k)) & U64(1)).astype(np.int64)
        ids.append(node)
        zeros.append(count * (1 - bit))
        ones.append(count * bit)
    node = np.concatenate(ids)
    order = np.argsort(node, kind="stable")
    node = node[order]
    at = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
    return node[at], np.add.reduceat(np.concatenate(zeros)[order], at), np.add.reduceat(np.concatenate(ones)[order], at)


class Level:
    """The nodes of one depth: estimate, and the estimate's share in the mixture."""

    def __init__(self, node: np.ndarray, zeros: np.ndarray, ones: np.ndarray, below: np.ndarray | None):
        """``below``: log of the product of the children's mixtures; None at the greatest depth."""
        self.node, self.n = node, zeros + ones
        pe = log_kt(zeros.astype(float), ones.astype(float))
        self.pw = pe if below is None else np.logaddexp(pe, below) + math.log(0.5)
        self.share = np.ones(len(pe)) if below is None else np.exp(math.log(0.5) + pe - self.pw)
        self.one = (ones + 0.5) / (self.n + 1.0)


def subtree(keys: np.ndarray, counts: np.ndarray, top: int = TOP) -> list[Level]:
    """Levels of depth ``top`` to DEPTH, in this order."""
    symbol, levels, under = keys & U64(255), [], None
    for d in range(DEPTH, top - 1, -1):
        node, zeros, ones = bit_nodes(keys >> U64(8 * (DEPTH - d + 1)), symbol, counts)
        below = None
        if under is not None:
            parent = ((under.node >> U64(16)) << U64(8)) | (under.node & U64(255))
            below = np.bincount(np.searchsorted(node, parent), weights=under.pw, minlength=len(node))
        under = Level(node, zeros, ones, below)
        levels.append(under)
    return levels[::-1]


class Upper:
    """Depths 0 to ``TOP - 1``, from sums over all shards: ``levels[d]`` has the nodes that occur."""

    def __init__(self, node: np.ndarray, zeros: np.ndarray, ones: np.ndarray, below: np.ndarray):
        """Nodes (context << 8 | first bits) of depth ``TOP - 1``, sorted, with the log of their children's mixtures."""
        self.levels = [Level(node, zeros, ones, below)]
        for _ in range(TOP - 1):
            under = self.levels[0]
            parent = ((under.node >> U64(16)) << U64(8)) | (under.node & U64(255))
            up, where = np.unique(parent, return_inverse=True)
            sums = [np.bincount(where, weights=x, minlength=len(up)) for x in (zeros, ones, under.pw)]
            zeros, ones = sums[0], sums[1]
            self.levels.insert(0, Level(up, *sums))


def log_probability(keys: np.ndarray, counts: np.ndarray, upper: Upper) -> np.ndarray:
    """log10 probability of each string's last byte after the others."""
    levels = [*upper.levels, *subtree(keys, counts)]
    symbol, out = keys & U64(255), np.zeros(len(keys))
    # A context's strings stand together: each level is looked up once for all strings with the same context.
    contexts = []
    for d in range(len(levels)):
        context = keys >> U64(8 * (DEPTH - d + 1)) if d else np.zeros(len(keys), U64)
        contexts.append(context << U64(8))
    for k in range(8):
        heap = U64(1 << k) | (symbol >> U64(8 - k))
        bit = (symbol >> U64(7 - k)) & U64(1)
        p = np.full(len(keys), np.nan)  # of the next bit being 1, nan below the last node with training strings
        for context, level in zip(reversed(contexts), reversed(levels), strict=True):
            at = np.minimum(np.searchsorted(level.node, context | heap), max(len(level.node) - 1, 0))
            if not len(level.node):
                continue
            n, share, one = level.n[at], level.share[at], level.one[at]
            seen = (n > 0) & (level.node[at] == (context | heap))
            p = np.where(seen, np.where(np.isnan(p), one, share * one + (1 - share) * p), np.nan)
        p = np.where(np.isnan(p), 0.5, p)
        out += np.log10(np.where(bit == 1, p, 1 - p))
    return out


# --- merging and answering ---------------------------------------------------------------------------------------

SUMS_SQL = "kind int, node long, below double, zeros long, ones long"


def upper_sums(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of some whole subtrees: the nodes above them, log of their children's mixtures, zeros and ones."""
    first = subtree(keys, counts)[0]
    parent = ((first.node >> U64(16)) << U64(8)) | (first.node & U64(255))
    node, where = np.unique(parent, return_inverse=True)
    mine, zeros, ones = bit_nodes(keys >> U64(8 * (DEPTH - TOP + 2)), keys & U64(255), counts)
    assert (mine == node).all()
    return node, np.bincount(where, weights=first.pw, minlength=len(node)), zeros, ones


def summary(group: pa.Table) -> pa.Table:
    """What the top needs of a shard. Words: one row with N in ``zeros`` and V in ``ones``."""
    keys, counts = _merged(group)
    kinds = [pa.int32(), pa.int64(), pa.float64(), pa.int64(), pa.int64()]
    names = ["kind", "node", "below", "zeros", "ones"]
    if group["kind"][0].as_py() == WORDS:
        values = [[WORDS], [0], [0.0], [int(counts.sum())], [int((counts > 0).sum())]]
    else:
        node, below, zeros, ones = upper_sums(keys, counts)
        values = [np.full(len(node), GRAMS), node.astype(np.int64), below, zeros, ones]
    return pa.table([pa.array(v, t) for v, t in zip(values, kinds, strict=True)], names=names)


def _merge_level(group: pa.Table) -> pa.Table:
    keys, counts = _merged(group)
    first = [group[c][0].as_py() for c in ("kind", "shard")]
    return _rows([(*first, group["parent"][0].as_py(), _pack(keys), _planes(counts))], BLOBS)


ANSWERS_SQL = "kind int, shard int, block long, keys binary, answers binary"
ANSWERS = pa.schema([(n, BLOBS.field(n).type if n in BLOBS.names else pa.binary()) for n in ("kind", "shard", "block", "keys", "answers")])


def _answer_top(upper: Upper):
    """Answers for the arrays that a shard merged last: probabilities of strings, counts of words."""

    def run(group: pa.Table) -> pa.Table:
        keys, counts = _merged(group)
        values = log_probability(keys, counts, upper) if group["kind"][0].as_py() == GRAMS else counts.astype(float)
        return _asked(group, keys, values)

    return run


def _asked(group: pa.Table, keys: np.ndarray, values: np.ndarray) -> pa.Table:
    rows = []
    for kind, shard, block, blob in zip(*(group[c].to_pylist() for c in ("kind", "shard", "block", "keys")), strict=True):
        own = values[np.searchsorted(keys, _unpack(blob))]
        rows.append((kind, shard, block, blob, _planes(own.astype(np.float32 if kind == GRAMS else np.float64))))
    return _rows(rows, ANSWERS)


def _answer_down(children: pa.Table, parents: pa.Table) -> pa.Table:
    """Answers of merged arrays, given to the arrays they were merged from."""
    if not children.num_rows:
        return _rows([], ANSWERS)
    kind = children["kind"][0].as_py()
    keys = np.concatenate([_unpack(x) for x in parents["keys"].to_pylist()])
    values = np.concatenate([_unplaned(x, np.float32 if kind == GRAMS else np.float64) for x in parents["answers"].to_pylist()])
    return _asked(children, keys, values)


def answered(blobs: DataFrame, blocks: int, fan: int = FAN) -> tuple[DataFrame, int, int]:
    """Answers to all arrays, the number of training tokens and that of distinct ones."""
    if blocks > fan:
        keyed = blobs.withColumn("parent", F.floor(F.col("block") / fan))
        merged = written(keyed.groupBy("kind", "shard", "parent").applyInArrow(_merge_level, BLOBS_SQL), "merged")
        got, tokens, distinct = answered(merged, -(-blocks // fan), fan)
        answers = keyed.groupBy("kind", "shard", "parent").cogroup(got.withColumnRenamed("block", "parent").groupBy("kind", "shard", "parent")).applyInArrow(_answer_down, ANSWERS_SQL)
        return answers, tokens, distinct
    sums = blobs.groupBy("kind", "shard").applyInArrow(summary, SUMS_SQL)
    got = sums.groupBy("kind", "node").agg(F.sum("below").alias("below"), F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones")).toArrow().sort_by("node")  # one row for each pair of bytes and first bits, and one for words
    words = got.filter(pc.equal(got["kind"], WORDS)).to_pylist()
    grams = got.filter(pc.equal(got["kind"], GRAMS))
    node, below, zeros, ones = (np.asarray(grams[c]) for c in ("node", "below", "zeros", "ones"))
    upper = Upper(node.astype(U64), zeros, ones, below)
    tokens, distinct = (words[0]["zeros"], words[0]["ones"]) if words else (0, 0)
    return blobs.groupBy("kind", "shard").applyInArrow(_answer_top(upper), ANSWERS_SQL), tokens, distinct


def _scores(tokens: int, distinct: int):
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        out: list[pa.RecordBatch] = []
        known: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for kind, dtype in ((GRAMS, np.float32), (WORDS, np.float64)):
            mine = answers.filter(pc.equal(answers["kind"], kind))
            keys = np.concatenate([np.zeros(0, U64), *(_unpack(x) for x in mine["keys"].to_pylist())])
            values = np.concatenate([np.zeros(0, dtype), *(_unplaned(x, dtype) for x in mine["answers"].to_pylist())])
            order = np.argsort(keys)
            known[kind] = keys[order], values[order].astype(np.float64)
        for b in steps(iter(docs.combine_chunks().to_batches()), "text"):
            s = Step(one_array(b, "text"))
            keys, values = known[GRAMS]
            each = values[np.searchsorted(keys, s.keys)]
            score = np.add.reduceat(each, s.first[:-1])  # no text is empty: each has its end
            keys, values = known[WORDS]
            c = values[np.searchsorted(keys, s.word_hash)]
            end = values[np.searchsorted(keys, END_KEY)]
            unit = lambda n: np.log10((n + 0.1) / (tokens + 0.1 * (distinct + 1)))
            doc, n_words = s.words.doc_of(), s.words.counts
            base = np.bincount(doc, weights=unit(c)[s.words.ids], minlength=b.num_rows) + unit(end)
            n_known = np.bincount(doc, weights=(c > 0)[s.words.ids], minlength=b.num_rows).astype(np.int64) + int(end > 0)
            bits = -score / math.log10(2) / s.n_bytes
            out.append(pa.RecordBatch.from_arrays([one_array(b, "doc_id"), one_array(b, "held_out"), pa.array(n_words + 1), pa.array(n_known), pa.array(np.full(b.num_rows, tokens, np.int64)), pa.array(base), pa.array(score), pa.array(s.n_bytes.astype(np.int64)), pa.array(bits)], names=OUT))
        schema = pa.schema([("doc_id", docs.schema.field("doc_id").type), ("held_out", pa.bool_()), *((n, pa.int64()) for n in OUT[2:5]), *((n, pa.float64()) for n in OUT[5:7]), ("n_bytes", pa.int64()), ("bits_per_byte", pa.float64())])
        return pa.Table.from_batches(out, schema=schema)

    return run


OUT = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_bytes", "bits_per_byte"]


def scored(docs: DataFrame, block_bytes: int = BLOCK_BYTES, shards: int | None = None, fan: int = FAN) -> DataFrame:
    """Scores of every document by the model that the training fold teaches.

    Null and blank texts have one token, the end. Without training texts every
    bit has probability 1/2 and N and V are 0. ``score`` and ``base_score``
    are log10 probabilities of the whole text, ``bits_per_byte`` the code
    length. Rows that are alike in every column score alike.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // block_bytes))
    shards = shards or max(SHARDS, -(-size // SHARD_BYTES))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)))
    blobs = written(rows.groupBy("block").applyInArrow(lambda g: counted(g, shards), BLOBS_SQL), "grams")
    answers, tokens, distinct = answered(blobs, blocks, fan)
    kind = docs.schema["doc_id"].dataType.simpleString()
    out = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_bytes long, bits_per_byte double"
    return rows.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_scores(tokens, distinct), out)
