"""Exact de-duplication with a log-structured merge index of text digests.

*Memtables and runs.* Rows are dealt over runs by a hash of the whole row, so
copies of one text spread over all runs; there is a run for each ``RUN_ROWS``
rows. Runs are flushed once to a shared table, each sorted by digest within
one file, one entry for each row. The files carry Parquet Bloom filters on the
digest, by which ``lookup`` of given digests passes over runs without them.

*Compaction.* Runs are merged in two levels. Each merge keeps one entry for a
digest: its size and the identifier to keep. Entries of a digest are combined
before they are shuffled, so a group that holds a third of all rows arrives
as one entry from each task.

*Byte verification.* Digests with more than one row are hits. A bitmap over
the hits' digests, of a bounded size, is broadcast and lets
pass the rows that may be hits; only these carry their text, to be grouped by
the text itself, combined before the shuffle. Should texts that differ have one digest, the rows under
it are grouped anew by their texts.

*Look-up.* Results go down the levels: from the digest to its entry in each
run, then to the run's rows, so no key of the last join has more than one
run's share of a group.

Only built-in functions run on rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cambium.llm.columns import lower_ascii
from cambium.llm.filters import bitmap_of, flagged, may_contain
from cambium.scratch import written

#: Rows of a run, the least number of runs, and how many of them one compaction of the second level merges.
RUN_ROWS, LEAST_RUNS, FAN_IN = 1 << 20, 256, 16
Digest = Callable[[Column], Column]


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def normalised(text: Column) -> Column:
    """The text that is compared: null counts as empty, A-Z is lower-cased, nothing else changes."""
    return lower_ascii(F.coalesce(text, F.lit("")))


class Index:
    """One run of the operator over a table: its runs, both levels of compaction, and the digests that collide."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, digest: Digest):
        self.docs, self.id, self.text, self.digest = docs, id_col, text_col, digest
        self.runs = max(LEAST_RUNS, -(-docs.count() // RUN_ROWS))
        entries = self.digested(docs).select("run", "digest", F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("seq"))
        #: One entry (run, digest, id, seq) for each row; ``seq`` tells apart rows that are equal in every column.
        self.entries = written(entries.repartition("run").sortWithinPartitions("run", "digest"), "runs", {"parquet.bloom.filter.enabled#digest": "true"})
        self.low, top = compact(self.entries)
        self.top = written(top, "compacted")
        differ = self.collisions()
        self.differ = None if differ.isEmpty() else written(differ, "differ")

    def digested(self, docs: DataFrame) -> DataFrame:
        """Adds ``run`` and ``digest`` (binary) to whole rows."""
        run = F.pmod(F.xxhash64(F.col(self.id), F.col(self.text)), F.lit(self.runs)).cast("int")
        return docs.withColumn("digest", self.digest(normalised(F.col(self.text)))).withColumn("run", run)

    def collisions(self) -> DataFrame:
        """Digests under which rows differ in their bytes, from the texts of all rows that hit."""
        hits = self.top.where("n > 1").select("digest")
        #: A bitmap over the digests of several rows, and its bits.
        self.filter = bitmap_of(hits, F.col("digest"), hits.count())
        rows = self.digested(self.docs.select(self.id, self.text))
        rows = may_contain(rows, F.col("digest"), *self.filter).select("run", "digest", normalised(F.col(self.text)).alias("text"))
        texts = rows.groupBy("run", "digest", "text").agg(F.lit(1).alias("one"))
        return texts.groupBy("digest").agg(F.min("text").alias("a"), F.max("text").alias("b")).where("a <> b").select("digest")


def compact(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Merge runs. Returns the run level (run, digest, keep, n), and the top level (digest, keep, n).

    ``keep`` is a struct (id, seq): the largest id, null before all others.
    """
    best = F.max(F.struct("id", "seq")).alias("keep")
    low = entries.groupBy("run", "digest").agg(best, F.count("*").alias("n"))
    merge = (F.max("keep").alias("keep"), F.sum("n").alias("n"))
    mid = low.withColumn("level", F.floor(F.col("run") / FAN_IN)).groupBy("level", "digest").agg(*merge)
    return low, mid.groupBy("digest").agg(*merge)


def lookup(entries: DataFrame, digests: list[bytes]) -> DataFrame:
    """The entries of given digests, from the runs whose filters may have them."""
    return entries.where(F.col("digest").isin([F.lit(d) for d in digests]))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Digest = sha256) -> DataFrame:
    """One row for each row of ``docs``: id, keep_id, group_size, kept, text_sha256.

    Null texts are empty texts. Of equal texts the largest id stays, a null id
    only if there is no other; of rows with that id and text exactly one stays.
    An empty table gives an empty table. Columns but the two named ones play no part.
    """
    index = Index(docs, id_col, text_col, digest)
    down = index.low.select("run", "digest").join(index.top, "digest")
    out = index.entries.join(down, ["run", "digest"])
    hexed = F.lower(F.hex("digest")) if digest is sha256 else F.lit(None).cast("string")
    kept = (F.col("seq") == F.col("keep.seq")).alias("kept")
    if index.differ is None:
        return out.select(F.col("id").alias(id_col), F.col("keep.id").alias("keep_id"), F.col("n").alias("group_size"), kept, hexed.alias("text_sha256"))
    alike = out.join(index.differ, "digest", "left_anti").select(F.col("id").alias(id_col), F.col("keep.id").alias("keep_id"), F.col("n").alias("group_size"), kept, hexed.alias("text_sha256"))
    odd = index.digested(docs.select(F.col(id_col), F.col(text_col))).join(index.differ, "digest", "left_semi")
    odd = written(odd.select(F.col(id_col).alias("id"), normalised(F.col(text_col)).alias("text"), F.monotonically_increasing_id().alias("seq")), "odd")
    groups = odd.groupBy("text").agg(F.max(F.struct("id", "seq")).alias("keep"), F.count("*").alias("n"))
    odd = odd.join(groups, "text").select(F.col("id").alias(id_col), F.col("keep.id").alias("keep_id"), F.col("n").alias("group_size"), kept, F.sha2("text", 256).alias("text_sha256"))
    return alike.unionByName(odd)


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Digest = sha256) -> DataFrame:
    """``docs`` with one row of each group of equal texts, that with the largest id; columns as they were.

    Rows outside the filter are unique and pass as they are, without a shuffle; the others are
    joined with their group on (run, digest). Rows alike in id and text are
    one row in the result. An empty table gives an empty table.
    """
    named = {c: f"_c{i}" for i, c in enumerate(docs.columns)}
    i, t = named[id_col], named[text_col]
    index = Index(docs.select(*[F.col(c).alias(n) for c, n in named.items()]), i, t, digest)
    hits = index.top.where("n > 1")
    stays = index.low.select("run", "digest").join(hits.select("digest", F.col("keep.id").alias("_keep")), "digest")
    rows = index.digested(index.docs)
    odd = None
    if index.differ is not None:
        odd = rows.join(index.differ, "digest", "left_semi").select(*named.values(), normalised(F.col(t)).alias("_norm"))
        best = odd.groupBy("_norm").agg(F.max(F.struct(i)).alias("_best"))
        odd = odd.join(best, "_norm").where(F.col(i).eqNullSafe(F.col(f"_best.{i}"))).dropDuplicates(["_norm"]).select(*named.values())
        rows = rows.join(index.differ, "digest", "left_anti")
    # Rows that the filter rules out are unique; only the others, hits and a few that merely look so, are shuffled.
    rows = flagged(rows, F.col("digest"), *index.filter)
    single = rows.where("not _maybe")
    maybe = rows.where("_maybe").join(stays.withColumn("_hit", F.lit(True)), ["run", "digest"], "left")
    maybe = maybe.where(F.col("_hit").isNull() | F.col(i).eqNullSafe(F.col("_keep"))).dropDuplicates(["digest"])
    kept = single.select(*named.values()).unionByName(maybe.select(*named.values()))
    return (kept if odd is None else kept.unionByName(odd)).toDF(*docs.columns)
