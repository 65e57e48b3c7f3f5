"""Mixing sources to target weights by capped water-filling.

A budget of words is shared among sources by weight. No source is repeated
more than ``max_epochs`` times: sources whose share exceeds that are clamped
and what they leave is reshared by weight among the rest, until none is above
its cap. The fixed point has a closed form. Order the sources by cap over
weight; with the first k clamped, the rest get ``(budget - caps) / weights``
words per unit of weight, and the clamped ones are those that this level still
overflows. That needs two running sums over one row per source, no loop.

A source's target divides into whole repetitions of each of its documents and
a remainder, which a seeded order fills: documents are sorted by a hash draw
and taken until the remainder is met, the last of them in part, so a source's
taken words equal its rounded target. The order is never materialised for a
whole source: draws fall into ``BUCKETS`` equal ranges, bucket sums locate each
bucket's start, and only inside one (source, bucket) pair are rows sorted. A
source that holds a third of all rows is therefore spread over all buckets.

Only built-in functions run on rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cambium.llm.columns import WORD, draw60, n_words
from cambium.scratch import written

#: Draws are 60 bits; the top 12 choose the bucket.
BUCKET_BITS = 12
BUCKETS = 1 << BUCKET_BITS
WEIGHTS, BUDGET, MAX_EPOCHS, SEED = (3, 1, 2), 1.5, 2, 20240501


def water_fill(sources: DataFrame, budget: float, max_epochs: int) -> DataFrame:
    """Targets for ``sources(skey, weight, source_size)``: adds ``target``.

    ``budget`` is a multiple of all sizes. The windows run over one row per
    source. Sources of size 0 get 0; an empty table gives an empty table.
    """
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), "skey")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    out = (
        sources.withColumn("cap", F.lit(max_epochs) * F.col("source_size"))
        .withColumn("budget", F.lit(budget) * F.sum("source_size").over(everything))
        .withColumn("caps", F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("weights", F.sum("weight").over(rest))
        .withColumn("clamped", (F.col("budget") - F.col("caps")) * F.col("weight") >= F.col("cap") * F.col("weights"))
    )
    # The clamped sources come first in this order; the first that isn't sets the level for all others.
    open_ = F.when(~F.col("clamped"), F.struct(F.col("cap") / F.col("weight"), "skey", "caps", "weights"))
    out = out.withColumn("level", F.min(open_).over(everything))
    share = (F.col("budget") - F.col("level.caps")) * F.col("weight") / F.col("level.weights")
    return out.withColumn("target", F.when(F.col("clamped"), F.col("cap").cast("double")).otherwise(share)).select("skey", "weight", "source_size", "target")


def source_key(source: Column) -> Column:
    """A key without nulls that sorts by code point with null last."""
    return F.when(source.isNull(), F.lit("n")).otherwise(F.concat(F.lit("k"), source))


def mix(docs: DataFrame, weights=WEIGHTS, budget: float = BUDGET, max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """How many words of each document the mix takes.

    ``docs`` needs ``doc_id``, ``source`` and ``size``. Sources by code point,
    null last, weigh ``weights``, repeating. Returns doc_id, source, size,
    source_size, target, taken. A document is taken at most ``max_epochs``
    times its size; documents of size 0 are taken with 0 words. Rows that are
    equal in every column draw alike, and which of them comes first then makes
    no difference to the rows returned. Null ids draw as the word "null".
    """
    drawn = written(
        docs.select("doc_id", "source", "size", source_key(F.col("source")).alias("skey"), draw60(F.lit(seed), F.col("doc_id")).alias("u")).withColumn("bucket", F.shiftright("u", 60 - BUCKET_BITS).cast("int")),
        "mix",
    )
    buckets = drawn.groupBy("skey", "bucket").agg(F.sum("size").alias("bucket_size"))
    in_order = Window.orderBy("skey")
    sources = buckets.groupBy("skey").agg(F.sum("bucket_size").alias("source_size")).withColumn("rank", F.row_number().over(in_order))
    wlist = F.array(*[F.lit(int(w)) for w in weights])
    sources = sources.withColumn("weight", F.element_at(wlist, ((F.col("rank") - 1) % len(weights) + 1).cast("int"))).drop("rank")
    targets = (
        water_fill(sources, budget, max_epochs)
        .withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
        .withColumn("need", F.round("target").cast("long") - F.col("whole") * F.col("source_size"))
    )
    before = Window.partitionBy("skey").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = buckets.withColumn("start", F.coalesce(F.sum("bucket_size").over(before), F.lit(0))).join(targets, "skey")
    inside = Window.partitionBy("skey", "bucket").orderBy("u", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        drawn.withColumn("upto", F.sum("size").over(inside))
        .join(starts.select("skey", "bucket", "start", "source_size", "target", "whole", "need"), ["skey", "bucket"])
        .withColumn("part", F.greatest(F.lit(0), F.least(F.col("size"), F.col("need") - (F.col("start") + F.col("upto") - F.col("size")))))
        .select("doc_id", "source", "size", "source_size", "target", (F.col("whole") * F.col("size") + F.col("part")).cast("long").alias("taken"))
    )


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: every document repeated as often as it is taken.

    Whole repetitions return the row as it is; a fraction of one returns the
    words up to the fraction, with ``n_chars`` of that text where the column
    exists. Columns stay as in ``docs``. Rows are told apart by (doc_id,
    source, size) and a hash of their text; rows alike in these share their
    taken words evenly, the first of them one word more as far as words are
    left over. Null texts and texts without words have no size and are left
    out; an empty table gives an empty table.
    """
    cols = docs.columns
    sized = docs.withColumn("_size", n_words(F.col("text"))).withColumn("_tie", F.xxhash64("doc_id", "text"))
    plan = mix(sized.select(F.struct("doc_id", "_tie").alias("doc_id"), "source", F.col("_size").alias("size")), **how)
    plan = plan.groupBy(F.col("doc_id.doc_id").alias("_id"), F.col("doc_id._tie").alias("_t"), F.col("source").alias("_source")).agg(F.sum("taken").alias("_all"), F.count("*").alias("_rows"))
    same = sized["doc_id"].eqNullSafe(plan["_id"]) & (sized["_tie"] == plan["_t"]) & sized["source"].eqNullSafe(plan["_source"])
    out = sized.join(plan, same).withColumn("_over", F.col("_all") % F.col("_rows")).withColumn("_taken", F.floor(F.col("_all") / F.col("_rows")))
    # Only rows alike with words left over need a place among their like.
    place = F.row_number().over(Window.partitionBy("_id", "_t", "_source").orderBy(F.lit(0)))
    uneven = out.where("_over > 0").withColumn("_taken", F.col("_taken") + (place <= F.col("_over")).cast("long"))
    out = out.where("_over = 0").unionByName(uneven)
    copies = F.when(F.col("_size") > 0, F.ceil(F.col("_taken") / F.col("_size"))).otherwise(0).cast("int")
    out = out.withColumn("_n", copies).where("_n > 0").withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("_n"))))
    rest = (F.col("_taken") - (F.col("_i") - 1) * F.col("_size")).cast("int")
    part = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(f"({WORD})"), 1), F.lit(1), F.greatest(F.lit(0), rest)), " ")
    text = F.when(rest >= F.col("_size"), F.col("text")).otherwise(part)
    out = out.withColumn("text", text)
    if "n_chars" in cols:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*cols)
