"""Document fingerprints from chains of content words that follow common words.

Words are runs of letters in lower case. A common word (an anchor, from a
short list for each language) starts a spot: the anchor and the next ``CHAIN``
content words after it, at ``DISTANCE`` content words from one another. A
text's signature is the set of its spots. Words before a text's first anchor, and
those more than ``GAP`` words after the last one, are anchors themselves, so
that lists, headings and junk have a signature too, and an edit elsewhere
leaves it as it is; only a text without letters has none.

The fingerprint writes the whole set down, as sorted 32-bit hashes in
hexadecimal, so equal texts have equal fingerprints. The likeness of two
fingerprints is the Jaccard index of their sets. Whether two are near
duplicates is decided with less: signatures are partitioned by length, with
borders chosen so that two sets at the level or above are in one partition or
in neighbouring ones, so others are not compared, and of those compared, sets
whose lengths alone hold the index below the level are not intersected.

``neighbours`` compares each document with the next one by descending id and
with a text edited from both. Ids are cut into ranges of about equal numbers
of rows, an id of many rows further by a hash of the text; the head of each range also goes, as a ghost row, to the range whose
last document it follows. Texts are shuffled once, and each task sorts its own
range.

``near_duplicates`` searches all documents: distinct signatures meet in their
partitions by the rarest of their spots.
"""

from __future__ import annotations

import hashlib
import math
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from cambium.llm.words import U64, hashed, in_small_batches, letters_only, mix, one_array, steps, words_of
from cambium.scratch import written

CHAIN, DISTANCE, GAP = 2, 1, 12
#: Likeness from which two documents are near duplicates.
LEVEL = 0.8
#: Anchors: frequent function words of English, French, German and Spanish.
ANCHORS = frozenset(
    """a an and are as at be by for from in is it of on only or that the this to was what when which with
    au aux avec ce dans de des du elle en est et il la le les ne ou par pas pour qui que se sur un une
    als am auf aus bei das dem den der des die ein eine er es für ich im ist mit nicht sie sich und von zu
    al como con del el ella ese los las lo más no para pero por se sin su una y o""".split()
)
ROWS_A_RANGE, MAX_RANGES = 2000, 4096
#: Rows that are compared in one step, and characters of two rows after which a step ends sooner.
STEP_ROWS, STEP_CHARS = 256, 1 << 20


def spots(texts: list[str], chain: int = CHAIN, distance: int = DISTANCE) -> list[np.ndarray]:
    """Each text's sorted distinct spot hashes."""
    w = words_of(letters_only(pa.array(texts, pa.string())))
    n, docs = len(w.ids), len(texts)
    if not n:
        return [np.zeros(0, np.uint32)] * docs
    names = w.unique.to_pylist()
    anchor = np.array([x in ANCHORS for x in names], bool)[w.ids]
    h, doc = hashed(w.unique)[w.ids], w.doc_of()
    place = np.arange(n)
    last = np.maximum.accumulate(np.where(anchor, place, -1))
    bare = ~anchor & ((last < w.first[:-1][doc]) | (place - last > GAP))  # content words that are anchors too
    content = np.flatnonzero(~anchor | bare)
    after = np.searchsorted(content, np.arange(n), side="right")
    at = np.flatnonzero(anchor | bare)
    spot = mix(h[at])
    for k in range(chain):
        where = after[at] + k * distance
        there = np.minimum(where, max(len(content) - 1, 0))
        inside = (where < len(content)) & (doc[content[there]] == doc[at]) if len(content) else np.zeros(len(at), bool)
        spot = mix(spot * U64(31) + np.where(inside, h[content[there]] if len(content) else U64(0), U64(1)))
    spot, owner = (spot >> U64(32)).astype(np.uint32), doc[at]
    key = np.unique((owner.astype(U64) << U64(32)) | spot.astype(U64))
    ends = np.searchsorted(key, np.arange(docs + 1).astype(U64) << U64(32))
    low = key.astype(np.uint32)
    return [low[a:b] for a, b in zip(ends, ends[1:], strict=False)]


def fingerprint(s: np.ndarray) -> str:
    return s.astype(">u4").tobytes().hex()


def partition_of(length: int, level: float) -> int:
    """The partition of signatures of this length: numbers ``borders`` from the least length on; -1 for empty ones."""
    return bisect_right(borders(level, length), length) - 1


_borders: dict[float, list[int]] = {}


def borders(level: float, most: int) -> list[int]:
    """First lengths of the partitions up to that of ``most``: each begins where no set of the one before the last reaches the level."""
    out = _borders.setdefault(level, [1])
    while out[-1] <= most:
        out.append(max(out[-1] + 1, math.floor(out[-1] / level) + 1))
    return out


def likeness(a: np.ndarray, b: np.ndarray, level: float = 0.0) -> float:
    """Jaccard index of two signatures; 0 where it is below ``level``. Two empty signatures are alike."""
    if not len(a) and not len(b):
        return 1.0
    if level and abs(partition_of(len(a), level) - partition_of(len(b), level)) > 1:
        return 0.0
    low, high = sorted((len(a), len(b)))
    if low < level * high or not low:
        return 0.0
    common = len(np.intersect1d(a, b, assume_unique=True))
    out = common / (low + high - common)
    return out if out >= level else 0.0


def neighbours(docs: DataFrame, rows: int = ROWS_A_RANGE) -> DataFrame:
    """Fingerprints of every document and of its edited text, their likenesses, and whether they are near duplicates at ``LEVEL``.

    Order: descending id, null ids last, rows of one id by a hash of the text
    (null counts as empty), descending. The edited text is the document's with
    its last third (rounded down, code points) replaced by the first as many of
    the next document's, or all if it has fewer; the first document is next to
    the last. A table of one row is next to itself; an empty one gives no rows.
    Ids must be integers. Beyond ``MAX_RANGES`` ranges these grow with the data, and Spark
    sorts them on disk.
    """
    if not isinstance(docs.schema["doc_id"].dataType, IntegralType):
        raise ValueError("doc_id must be an integer")
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, edited_is_near boolean, next_is_near boolean"
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n_rows, nulls = d.agg(F.count("*"), F.count_if(F.col("doc_id").isNull())).first()
    parts = min(MAX_RANGES, max(least, -(-n_rows // rows)))
    found = d.agg(F.percentile_approx("doc_id", [k / parts for k in range(1, parts)], 10 * parts)).first()[0] if parts > 1 else []
    d = d.withColumn("h", F.shiftrightunsigned(F.xxhash64("text"), 1))
    d = d.withColumn("range", _range_of(F.col("doc_id"), F.col("h"), Counter(found or []), max(1, -(-nulls * parts // max(1, n_rows)))))
    heads = [tuple(r) for r in d.groupBy("range").agg(F.max(F.struct("doc_id", "h")).alias("head")).select("range", "head.doc_id", "head.h").orderBy("range").collect()]
    # A range's first row follows the last row of the range before it; the first range comes after the last.
    ghosts = [(k, heads[at - 1][0], i, h) for at, (k, i, h) in enumerate(heads)]
    ghosts = spark.createDataFrame(ghosts, f"range long, before long, head {kind}, head_h long")
    ghosts = d.join(F.broadcast(ghosts), "range").where(F.col("doc_id").eqNullSafe(F.col("head")) & (F.col("h") == F.col("head_h")))
    ghosts = ghosts.groupBy("before").agg(F.max(F.struct("doc_id", "h", "text")).alias("row")).select(F.col("before").alias("range"), F.lit(True).alias("ghost"), "row.*")
    dealt = d.select("range", F.lit(False).alias("ghost"), "doc_id", "h", "text").unionByName(ghosts)
    dealt = dealt.repartition(parts, "range").sortWithinPartitions("range", "ghost", F.desc_nulls_last("doc_id"), F.desc("h"), F.desc("text"))
    return in_small_batches(dealt.select("range", "ghost", "doc_id", "text")).mapInArrow(_compared, schema)


def _range_of(doc_id: Column, h: Column, cuts: Counter, nulls: int) -> Column:
    """Number of the range by descending cuts, found in two levels; null ids have the last ones.

    An id that is a cut several times has as many ranges of its own, by descending hash, and null ids have ``nulls``.
    """
    keys = sorted(cuts, reverse=True)
    most = max([nulls, *cuts.values()])
    width = max(1, int(len(keys) ** 0.5))
    groups = [keys[a : a + width] for a in range(0, len(keys), width)] or [[]]

    def over(col: Column) -> Column:
        return F.size(F.filter(col, lambda c: c >= doc_id))

    lists = [F.array(*[F.lit(int(c)).cast("long") for c in g]) if g else F.array().cast("array<long>") for g in groups]
    whole = over(F.array(*[F.lit(int(g[-1])).cast("long") for g in groups if g]) if keys else F.array().cast("array<long>"))
    inner = over(F.coalesce(F.get(F.array(*lists), whole), F.array().cast("array<long>")))
    own = F.lit(0)
    if often := {c: k for c, k in cuts.items() if k > 1}:
        shares = F.create_map(*[x for c, k in often.items() for x in (F.lit(int(c)).cast("long"), F.lit(k))])
        own = F.coalesce(F.get(F.array(F.element_at(shares, doc_id.cast("long"))), F.lit(0)), F.lit(0))
    part = lambda k: F.greatest(F.lit(0), F.least(k - 1, F.floor((F.lit(2.0**63) - h) / F.lit(2.0**63) * k)))
    inside = F.when(own > 1, part(own)).otherwise(most)
    return F.when(doc_id.isNull(), F.lit(len(keys) + 1) * (most + 1) + part(F.lit(nulls))).otherwise((whole * width + inner).cast("long") * (most + 1) + inside).cast("long")


def near_duplicates(docs: DataFrame, level: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """Near-duplicate documents: members (doc_id, class_id) and links (a, b, likeness) of classes, a < b.

    A class is a distinct signature, named by the least doc_id that has it (null ids are above all others); texts without
    letters are in no class and have a null class_id. All links at the level or above are found: of two such sets, the rarest
    spots of each (all but ``ceil(level * length) - 1`` of them) have one in common. Each set looks in its own length
    partition and, as the shorter one, in the next. An empty table gives empty tables; repeated rows are members of one class.
    """

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches, "text"):
            signatures = spots(pc.fill_null(one_array(b, "text"), "").to_pylist())
            flat = np.concatenate([np.zeros(0, np.uint32), *signatures]).astype(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(x) for x in signatures])]), pa.int32()), pa.array(flat))
            parts = pa.array([partition_of(len(x), level) for x in signatures], pa.int32())
            prints = pa.array([hashlib.sha256(x.tobytes()).digest() for x in signatures], pa.binary())
            yield pa.RecordBatch.from_arrays([one_array(b, "doc_id"), prints, parts, lists], names=["doc_id", "print", "part", "spots"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = written(in_small_batches(docs.select("doc_id", "text")).mapInArrow(signed, f"doc_id {kind}, print binary, part int, spots array<long>"), "signatures")
    named = rows.where(F.size("spots") > 0).groupBy("print").agg(F.min("doc_id").alias("class_id"), F.first("part").alias("part"), F.first("spots").alias("spots"))
    sets = written(named.withColumn("sid", F.monotonically_increasing_id()), "sets")
    members = rows.select("doc_id", "print").join(sets.select("print", "class_id"), "print", "left").select("doc_id", "class_id")
    each = sets.select("sid", "part", F.size("spots").alias("n"), F.explode("spots").alias("spot"))
    often = each.groupBy("spot").agg(F.count("*").alias("f")).where("f > 1")
    order = each.join(often, "spot").groupBy("sid", "part", "n").agg(F.sort_array(F.collect_list(F.struct("f", "spot"))).alias("shared"))
    # The first spots from rare to frequent; those of one set only come first of all and lead nowhere.
    first = F.greatest(F.lit(0), F.size("shared") - F.ceil(F.lit(level) * F.col("n") - 1e-9) + 1).cast("int")
    heads = order.select("sid", "part", "n", F.explode(F.slice("shared", 1, first)).alias("s")).select("sid", "part", "n", F.col("s.spot").alias("spot"))
    own = heads.select("spot", "part", F.col("sid").alias("b"), F.col("n").alias("nb"))
    look = heads.select("spot", F.explode(F.array("part", F.col("part") + 1)).alias("part"), F.col("sid").alias("a"), F.col("n").alias("na"))
    pairs = look.join(own, ["spot", "part"]).where("(na < nb or na = nb and a < b)").where(F.col("na") >= F.lit(level) * F.col("nb") - 1e-9).select("a", "b").distinct()
    x, y = (sets.select(F.col("sid").alias(k), F.col("class_id").alias(f"i{k}"), F.col("spots").alias(f"s{k}")) for k in ("a", "b"))
    both = F.size(F.array_intersect("sa", "sb"))
    checked = pairs.join(x, "a").join(y, "b").withColumn("likeness", both / (F.size("sa") + F.size("sb") - both)).where(F.col("likeness") >= level)
    return members, checked.select(F.least("ia", "ib").alias("a"), F.greatest("ia", "ib").alias("b"), "likeness")


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a range are consecutive and in order, with its ghosts at the end."""
    rows: list[tuple] = []
    for b in batches:
        for row in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
            rows.append(row)
            if len(rows) > STEP_ROWS or sum(len(r[3]) for r in rows[-2:]) > STEP_CHARS:
                yield from _pairs(rows, b.schema)
                rows = rows[-1:]
    if rows:
        yield from _pairs(rows, b.schema)


def _pairs(rows: list[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Compare each row but ghosts with the row after it; the last row is only a next one."""
    at = [i for i in range(len(rows) - 1) if not rows[i][1]]
    if not at:
        return
    own, nexts = [rows[i][3] for i in at], [rows[i + 1][3] for i in at]
    edited = [t[: len(t) - len(t) // 3] + n[: len(t) // 3] for t, n in zip(own, nexts, strict=True)]
    place = {i: k for k, i in enumerate(dict.fromkeys([*at, *(i + 1 for i in at)]))}
    plain = spots([rows[i][3] for i in place])
    changed = spots(edited)
    mine = [plain[place[i]] for i in at]
    near = [likeness(a, b) for a, b in zip(mine, changed, strict=True)]
    near_next = [likeness(a, plain[place[i + 1]]) for a, i in zip(mine, at, strict=True)]
    yield pa.RecordBatch.from_arrays(
        [
            pa.array([rows[i][2] for i in at], schema.field("doc_id").type), pa.array([len(t) for t in own], pa.int64()),
            pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], pa.string()),
            pa.array([fingerprint(x) for x in mine], pa.string()), pa.array([fingerprint(x) for x in changed], pa.string()),
            pa.array(near, pa.float64()), pa.array(near_next, pa.float64()),
            pa.array([likeness(a, b, LEVEL) > 0 for a, b in zip(mine, changed, strict=True)]), pa.array([likeness(a, plain[place[i + 1]], LEVEL) > 0 for a, i in zip(mine, at, strict=True)]),
        ],
        names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "edited_is_near", "next_is_near"],
    )
