"""Phrase collocations of each language from vertical positional inverted lists.

*Postings.* A task gathers whole texts up to ``BLOCK_BYTES`` into a block and
writes one row for it: its distinct words, each with the ascending positions
where it stands. Positions leave a gap between pieces and between texts, so
words at p and p + 1 are neighbours in one piece.

*Extension.* The list of a phrase of k + 1 words is the merge join, by
position, of its first k words' list with the list of its last k words one
place further on (for two words, the postings of adjacent words). The lists'
lengths, added up over the blocks, are exact frequencies. Level by level,
the frequent phrases enter a bitmap of at most 8 MB that goes to all tasks;
only lists that it lets pass are extended. A bitmap lets every frequent phrase
pass, so it spares work and decides nothing: were it full, the lists would be
longer and the results the same. With its frequency a phrase gets the least block that has it. In the
last pass this block sends the keys of the phrase's two parents, found by a
second bitmap over phrase and block, so that a phrase is sent about once and not
by every block.

*Scores.* Phrases get their words, and the frequencies of all their first and
last parts, from their parents, a level at a time, by joins on keys.

A key is a 64-bit hash: of a word and its language, or of two parents' keys.
Keys stand for phrases in joins and counts. A block is counted before the
shuffle, so a word or phrase that a third of all texts repeat sends one row a
block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cambium.llm.filters import bit_array, holds
from cambium.llm.words import U64, in_small_batches, mix, one_array, steps, tidy, words_of
from cambium.scratch import temporary, written

#: Bytes of text in a block, a longer single text excepted.
BLOCK_BYTES = 8 << 20
#: Each block is a row group of its own, so that neither its writer nor a reader holds the other blocks of a file.
ONE_BLOCK = {"parquet.block.row.count.limit": "1", "parquet.block.size": "1", "parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "1"}
#: Parts by which a language's best phrases are chosen first.
SALTS = 64

#: Bytes that end a piece; in the text they and the tab become spaces, and A-Z lower case.
_ENDS = np.isin(np.arange(256), [*b".,;:!?\n\v\f\r"])
_PLAIN = np.array([32 if _ENDS[b] or b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)

_BLOCK = "block long, langs array<string>, lang array<int>, words array<string>, keys array<long>, lengths array<int>, gaps array<int>"


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Of all words in order: position, index into the distinct words; and these. Null counts as empty."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.zeros(0, np.uint8)
    ends = ends - ends[0]
    plain = _PLAIN[raw]
    w = words_of(pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(ends), pa.py_buffer(plain)).cast(pa.string()))
    # A word starts where no space is, after a space or at a text's start; what ends a piece is counted before it.
    letter = plain != 32
    start = letter.copy()
    start[1:] &= ~letter[:-1]
    first = ends[:-1][ends[:-1] < len(plain)]
    start[first] = letter[first]
    at = np.flatnonzero(start)
    piece = np.cumsum(_ENDS[raw], dtype=np.int32)[at]
    doc = w.doc_of()
    fresh = np.ones(len(at), bool)
    fresh[1:] = (piece[1:] != piece[:-1]) | (doc[1:] != doc[:-1])
    return np.arange(len(at)) + np.cumsum(fresh), w.ids, w.unique


class _Block:
    """Words of some texts: for each language and word its key and positions."""

    def __init__(self) -> None:
        self.size, self.end = 0, 0
        self.langs: dict[str, int] = {}
        self.index: dict[tuple[int, str], int] = {}
        self.at: list[np.ndarray] = []
        self.word: list[np.ndarray] = []

    def add(self, lang: str, texts: pa.Array) -> None:
        position, ids, unique = tokens(texts)
        number = self.langs.setdefault(lang, len(self.langs))
        index = self.index
        mine = np.fromiter((index.setdefault((number, w), len(index)) for w in unique.to_pylist()), np.int32, len(unique))
        self.at.append((position + self.end).astype(np.int32))
        self.word.append(mine[ids])
        self.size += texts.nbytes
        if len(position):
            self.end += int(position[-1]) + 2

    def row(self) -> pa.RecordBatch:
        word, at = np.concatenate(self.word), np.concatenate(self.at)
        order = np.argsort(word, kind="stable")  # positions ascend within a word
        names = list(self.langs)
        seeds = [xxhash.xxh3_64_intdigest(x.encode()) for x in names]
        langs, words = [k for k, _ in self.index], [w for _, w in self.index]
        keys = np.fromiter((xxhash.xxh3_64_intdigest(w.encode(), seeds[k]) for k, w in self.index), U64, len(words))
        columns = [pa.array(names, pa.string()), pa.array(langs, pa.int32()), pa.array(words, pa.string()), pa.array(keys.view(np.int64)), pa.array(np.bincount(word, minlength=len(words)).astype(np.int32)), pa.array(np.diff(at[order], prepend=np.int32(0)))]
        one = [pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) for c in columns]
        name = xxhash.xxh3_64_intdigest(np.concatenate([at, word]).tobytes() + keys.tobytes())
        return pa.RecordBatch.from_arrays([pa.array(np.array([name], U64).view(np.int64)), *one], names=["block", "langs", "lang", "words", "keys", "lengths", "gaps"])


def _blocks(most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A row for each block of about ``most`` bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = _Block()
        for b in steps(batches, "text"):
            langs, texts = one_array(b, "lang"), one_array(b, "text")
            for lang in pc.unique(langs).to_pylist():
                block.add(lang, texts.filter(pc.equal(langs, lang)))
            if block.size >= most:
                yield block.row()
                block = _Block()
        if block.at:
            yield block.row()

    return run


def _child(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The key of a phrase from those of its first and its last words but one."""
    return mix(mix(left) * U64(0x9E3779B97F4A7C15) + right)


def _lists(b: pa.RecordBatch, i: int, bitmaps: list, most: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Of one block, level by level: (words, keys, left parents, right parents) of all places whose parents pass, and who themselves do where a bitmap is known."""
    keys, lengths, gaps = (one_array(b, c).slice(i, 1).flatten().to_numpy(zero_copy_only=False) for c in ("keys", "lengths", "gaps"))
    if not len(gaps):
        return
    at = np.cumsum(gaps, dtype=np.int64)
    good = holds(keys.view(U64), bitmaps[0].value)
    word = np.repeat(np.arange(len(keys), dtype=np.int32), lengths)
    line = np.full(int(at.max()) + 1, -1, np.int32)
    line[at] = np.where(good[word], word, -1)
    place = np.flatnonzero(line >= 0)
    key = keys.view(U64)[line[place]]
    for k in range(2, most + 1):
        near = np.flatnonzero(place[1:] == place[:-1] + 1)
        left, right, place = key[near], key[near + 1], place[near]
        key = _child(left, right)
        if k <= len(bitmaps):
            on = holds(key, bitmaps[k - 1].value)
            key, left, right, place = key[on], left[on], right[on], place[on]
        yield k, key, left, right


def _counted(bitmaps: list) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """List lengths of the level after the last bitmap: (key, n, block)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                for k, key, _, _ in _lists(b, i, bitmaps, len(bitmaps) + 1):
                    if k > len(bitmaps):
                        found, n = np.unique(key, return_counts=True)
                        block = np.full(len(n), one_array(b, "block")[i].as_py())
                        yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n.astype(np.int32)), pa.array(block)], names=["key", "n", "block"])

    return run


def _parented(bitmaps: list, picks: list) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(k, key, left, right) of the phrases of each level that a block was picked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                block = one_array(b, "block").slice(i, 1).to_numpy().view(U64)
                for k, key, left, right in _lists(b, i, bitmaps, len(bitmaps)):
                    found, first = np.unique(key, return_index=True)
                    mine = holds(found ^ block, picks[k - 2].value)
                    first = first[mine]
                    columns = [np.full(len(first), k, np.int32), key[first].view(np.int64), left[first].view(np.int64), right[first].view(np.int64)]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["k", "key", "left", "right"])

    return run


def _frequencies(docs: DataFrame, least: int, longest: int) -> tuple[DataFrame, DataFrame]:
    """Words (lang, word, key, n) and phrases (k, key, left, right, f) that occur ``least`` times or more; of words, all. Both are written tables."""
    spark = docs.sparkSession
    texts = in_small_batches(docs.select(F.coalesce("lang", F.lit("und")).cast("string").alias("lang"), F.coalesce("text", F.lit("")).alias("text")))
    blocks = written(texts.mapInArrow(tidy(_blocks(BLOCK_BYTES)), _BLOCK), "postings", ONE_BLOCK)
    each = blocks.select("langs", F.explode(F.arrays_zip("lang", "words", "keys", "lengths")).alias("w"))
    words = each.groupBy(F.col("langs")[F.col("w.lang")].alias("lang"), F.col("w.words").alias("word"), F.col("w.keys").alias("key")).agg(F.sum("w.lengths").alias("n"))
    words = written(words, "words")
    lists = blocks.select("block", "keys", "lengths", "gaps")
    send = spark.sparkContext.broadcast
    bitmaps, picks, levels = [send(bit_array(words.where(F.col("n") >= least), F.col("key")))], [], []
    for _ in range(2, longest + 1):
        level = lists.mapInArrow(tidy(_counted(list(bitmaps))), "key long, n int, block long").groupBy("key").agg(F.sum("n").alias("f"), F.min("block").alias("block")).where(F.col("f") >= least)
        level = written(level, "frequent")
        levels.append(level)
        bitmaps.append(send(bit_array(level, F.col("key"))))
        picks.append(send(bit_array(level, F.col("key").bitwiseXOR(F.col("block")))))
    sent = lists.mapInArrow(tidy(_parented(list(bitmaps), list(picks))), "k int, key long, left long, right long").distinct()
    known = levels[0].select(F.lit(2).alias("k"), "key", "f")
    for k, level in enumerate(levels[1:], 3):
        known = known.unionAll(level.select(F.lit(k), "key", "f"))
    found = written(sent.join(known, ["k", "key"]), "phrases")
    for b in (*bitmaps, *picks):
        b.destroy()
    return words, found


def _named(words: DataFrame, found: DataFrame, longest: int) -> list[DataFrame]:
    """For each number of words k from 2, the phrases with ``firsts``, the frequencies of their first 1 to k - 1 words, and ``lasts``, those of what each of them leaves."""
    none = F.array().cast("array<bigint>")
    below = words.select("lang", "key", F.col("word").alias("phrase"), F.col("word").alias("last"), F.col("n").alias("f"), none.alias("firsts"), none.alias("lasts"))
    out = []
    for k in range(2, longest + 1):
        head = below.select("lang", F.col("key").alias("left"), F.col("phrase").alias("head"), F.concat("firsts", F.array("f")).alias("firsts"))
        tail = below.select(F.col("key").alias("right"), "last", F.concat(F.array("f"), "lasts").alias("lasts"))
        level = found.where(F.col("k") == k).join(head, "left").join(tail, "right")
        below = written(level.select("lang", "key", "left", "right", F.concat_ws(" ", "head", "last").alias("phrase"), "last", "f", "firsts", "lasts"), f"level{k}")
        out.append(below)
    return out


def collocations(docs: DataFrame, least: int = 100, longest: int = 5, top: int = 2000) -> DataFrame:
    """The best phrases of each language: lang, rank, phrase, a, l, r, n, score.

    ``docs`` has lang and text; a null lang counts as ``und``, a null text as empty; other columns play no part. Words are
    runs of anything but space and tab, A-Z in lower case, within pieces that
    ``.,;:!?`` and line ends bound; texts of any length are read whole, and
    repeated rows count each time. A candidate has 2 to ``longest`` words and occurs ``a >= least`` times.
    Each cut into two parts that occur l and r times gives
    floor(1000 * a * n / (l * r)), n the language's words, in decimals of 38
    digits; the lowest counts, of equal ones that with the shorter first part.
    A candidate is dropped if a candidate with one word more has it within and
    occurs as often (then so does any longer one in between). Ties of score go to the
    larger a, then to the lesser phrase in UTF-8 order. Without
    candidates (an empty table) there are no rows.
    """
    with temporary(docs.sparkSession) as stay:
        words, found = _frequencies(docs, least, longest)
        total = words.groupBy("lang").agg(F.sum("n").alias("n"))
        levels = _named(words.where(F.col("n") >= least), found, longest)
        scored = []
        for k, level in enumerate(levels, 2):
            if k < longest:
                more = levels[k - 1]
                longer = more.select(F.col("left").alias("key"), "f").unionAll(more.select("right", "f")).groupBy("key").agg(F.max("f").alias("_longer"))
                level = level.join(longer, "key", "left").where("coalesce(_longer, 0) < f")
            wide = lambda x: f"cast({x} as decimal(19, 0))"
            cuts = [f"struct(({wide('1000 * f')} * {wide('n')}) div ({wide(f'firsts[{j}]')} * {wide(f'lasts[{j}]')}) as score, {j} as cut, firsts[{j}] as l, lasts[{j}] as r)" for j in range(k - 1)]
            best = level.join(total, "lang").withColumn("cut", F.expr(f"array_min(array({', '.join(cuts)}))"))
            scored.append(best.select("lang", "key", "phrase", F.col("f").alias("a"), "cut.l", "cut.r", "n", F.col("cut.score").cast("long").alias("score")))
        every = scored[0]
        for s in scored[1:]:
            every = every.unionByName(s)
        order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
        # A language may have most of the phrases: its best come from the best of each of its parts.
        part = Window.partitionBy("lang", F.pmod("key", F.lit(SALTS))).orderBy(*order)
        some = every.withColumn("rank", F.row_number().over(part)).where(F.col("rank") <= top)
        out = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
        out = written(out.select("lang", "rank", "phrase", "a", "l", "r", "n", "score"), "collocations")
        stay.append(out)
    return out
