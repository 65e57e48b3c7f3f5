"""Aggregations: robust summaries, concentration, modes, weighted quantiles, dispersion."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cambium.functions.scalars import c, ratio, robust_scale
from cambium.scratch import temporary, written

#: Rows of one group, about 100 bytes each in a map, up to which one task takes their quantiles.
FEW_VALUES = 1 << 20
#: Groups, each of some bins, up to which counts by value are narrowed.
FEW_GROUPS = 1 << 12
BINS = 256


def median(x) -> Column:
    """Exact median with linear interpolation; NULLs are left out."""
    return F.percentile(c(x), F.lit(0.5))


def quantiles(x, qs: list[float]) -> Column:
    return F.percentile(c(x), F.array(*[F.lit(q) for q in qs]))


def cumulated(df: DataFrame, keys: list[str], order: str, amount: str, name: str) -> DataFrame:
    """Running totals by group in order, without sorting a group in one task: by range partition, then by the ranges' totals."""
    parts = written(df.repartitionByRange(*keys, order).sortWithinPartitions(*keys, order).withColumn("_part", F.spark_partition_id()), "ranges")
    sums = parts.groupBy(*keys, "_part").agg(F.sum(amount).alias("_s"))
    before = F.coalesce(F.sum("_s").over(Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.withColumn("_before", before).drop("_s")  # as many rows a group as ranges
    inner = F.sum(amount).over(Window.partitionBy(*keys, "_part").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return parts.join(sums, [*keys, "_part"]).withColumn(name, inner + F.col("_before")).drop("_part", "_before")


def counts_near(use: DataFrame, keys: list[str], qs: list[float]) -> DataFrame:
    """(keys, _v, _n): counts by value where the quantiles ``qs`` of ``_v`` lie, and elsewhere counts by bin at the bin's last value.

    So most values are not shuffled. Bins rise with the values; NaN is beyond the last.
    """
    number = F.when(~F.isnan("_v"), F.col("_v"))
    width = F.col("_hi") - F.col("_lo")
    place = F.when(F.isnan("_v"), BINS).when((width > 0) & (width < float("inf")), F.least(F.lit(BINS - 1), F.floor((F.col("_v") - F.col("_lo")) / width * BINS))).otherwise(0)
    with temporary(use.sparkSession) as stay:
        ends = written(use.groupBy(*keys).agg(F.count("*").alias("_all"), F.min(number).alias("_lo"), F.max(number).alias("_hi")), "ends")
        binned = use.join(F.broadcast(ends), keys) if keys else use.crossJoin(F.broadcast(ends))
        binned = binned.withColumn("_bin", place.cast("int")).drop("_lo", "_hi")
        bins = binned.groupBy(*keys, "_bin").agg(F.first("_all").alias("_all"), F.max("_v").alias("_v"), F.count("*").alias("_n"))
        upto = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0))  # as many rows a group as bins
        bins = bins.withColumn("_to", upto)
        low = [F.floor((F.col("_all") - 1) * F.lit(float(q))) + 1 for q in qs]
        held = [(F.col("_to") >= k) & (F.col("_to") - F.col("_n") < k) for lo in low for k in (lo, F.least(F.col("_all"), lo + 1))]
        bins = written(bins.withColumn("_held", reduce(lambda a, b: a | b, held)), "bins")
        inside = binned.drop("_all").join(F.broadcast(bins.where("_held").select(*keys, "_bin")), [*keys, "_bin"]).groupBy(*keys, "_v").agg(F.count("*").alias("_n"))
        out = written(inside.unionByName(bins.where("not _held").select(*keys, "_v", "_n")), "counts")
        stay.append(out)
    return out


def exact_quantiles(df: DataFrame, keys: list[str], x: str, qs: list[float], narrow: bool = False) -> DataFrame:
    """(keys, n, q), q an array of the quantiles of ``x`` with linear interpolation, from counts by value: no group is held by one task. NULLs are left out.

    ``narrow``, for few groups of many values, counts by value only in the bins that hold a quantile; ``df`` is then read three times.
    """
    use = df.where(F.col(x).isNotNull()).select(*keys, F.col(x).cast("double").alias("_v"))
    narrow = narrow and use.groupBy(*keys).agg(F.lit(1)).limit(FEW_GROUPS + 1).count() <= FEW_GROUPS
    counts = counts_near(use, keys, qs) if narrow else use.groupBy(*keys, "_v").agg(F.count("*").alias("_n"))
    upto = cumulated(counts, keys, "_v", "_n", "_to")
    total = use.groupBy(*keys).agg(F.count("*").alias("n"))
    near = upto.join(total, keys) if keys else upto.crossJoin(F.broadcast(total))
    place = [F.floor((F.col("n") - 1) * F.lit(float(q))) for q in qs]
    at = lambda k: F.min(F.when(F.col("_to") >= k, F.col("_v")))
    got = near.groupBy(*keys).agg(F.first("n").alias("n"), *[at(k + 1).alias(f"_l{i}") for i, k in enumerate(place)], *[at(F.least(F.col("n"), k + 2)).alias(f"_h{i}") for i, k in enumerate(place)])
    share = [(F.col("n") - 1) * F.lit(float(q)) - k for q, k in zip(qs, place, strict=True)]
    return got.select(*keys, "n", F.array(*[F.col(f"_l{i}") + share[i] * (F.col(f"_h{i}") - F.col(f"_l{i}")) for i in range(len(qs))]).alias("q"))


def summary(df: DataFrame, keys: list[str], x: str, prefix: str = "") -> DataFrame:
    """Count, mean, sd (population), extremes and seven quantiles of ``x`` by group, in one pass, and the MAD in a second."""
    qs = [0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95]
    one = df.groupBy(*keys).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("sd"), F.min(x).alias("min"), F.max(x).alias("max"), quantiles(x, qs).alias("q"))
    centre = one.select(*keys, F.get("q", F.lit(3)).alias("_m"))
    mad = (df.join(centre, keys) if keys else df.crossJoin(F.broadcast(centre))).groupBy(*keys).agg(median(F.abs(F.col(x) - F.col("_m"))).alias("mad"))
    one = one.join(mad, keys) if keys else one.crossJoin(F.broadcast(mad))
    names = [f"q{int(q * 100):02d}" for q in qs]
    out = one.select(*keys, "n", "mean", "sd", "min", "max", "mad", *[F.get("q", F.lit(i)).alias(n) for i, n in enumerate(names)])
    return out.withColumnsRenamed({n: prefix + n for n in out.columns if n not in keys}) if prefix else out


def centre_and_scale(df: DataFrame, keys: list[str], x: str) -> DataFrame:
    """Median and robust scale (IQR, else MAD, else sd) of ``x`` by group; a table of many rows that is one group goes by counts by value."""
    if not keys and df.count() > FEW_VALUES:
        q = exact_quantiles(df, [], x, [0.25, 0.5, 0.75])  # one row
        mad = exact_quantiles(df.crossJoin(F.broadcast(q.select(F.get("q", F.lit(1)).alias("_m")))).select(F.abs(F.col(x) - F.col("_m")).alias("_d")), [], "_d", [0.5])
        s = q.select("n", *[F.get("q", F.lit(i)).alias(k) for i, k in enumerate(("q25", "q50", "q75"))]).crossJoin(mad.select(F.get("q", F.lit(0)).alias("mad"))).crossJoin(df.agg(F.stddev_pop(x).alias("sd")))
    else:
        s = summary(df, keys, x)
    return s.select(*keys, "n", F.col("q50").alias("centre"), robust_scale(F.col("q75") - F.col("q25"), "mad", "sd", "n").alias("scale"))


def positive_scale(x) -> Column:
    """Median of the positive values, else the 75 % quantile of all, else 1."""
    q75 = F.percentile(c(x), F.lit(0.75))
    return F.coalesce(F.percentile(F.when(c(x) > 0, c(x)), F.lit(0.5)), F.when(q75 > 0, q75), F.lit(1.0))


def mode_by(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Most frequent value by group, the least one on ties; NULL values don't count."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"))
    return counts.groupBy(*keys).agg(F.min_by(value, F.struct(-F.col("n"), F.col(value))).alias("mode"), F.max("n").alias("mode_count"), F.sum("n").alias("n"))


def relation_summary(edges: DataFrame, values: list[str], complete: Column, i: str = "super_i", j: str = "super_j") -> DataFrame:
    """By pair: count, medians of ``values`` over complete rows only, and the share of these. ``edges`` is read several times.

    Pairs are few where nodes are large, so that no pair's values are held by one task.
    """
    counts = edges.groupBy(i, j).agg(F.count("*").alias("n_boundary_edges"), F.avg(F.coalesce(complete, F.lit(False)).cast("double")).alias("support_fraction"))
    each = edges.where(complete).select(i, j, F.explode(F.array(*[F.struct(F.lit(k).alias("_k"), F.col(v).cast("double").alias("_v")) for k, v in enumerate(values)])).alias("_e")).select(i, j, "_e._k", "_e._v")
    mid = exact_quantiles(each, [i, j, "_k"], "_v", [0.5], narrow=edges.limit(FEW_VALUES + 1).count() > FEW_VALUES)
    mid = mid.groupBy(i, j).agg(*[F.max(F.when(F.col("_k") == k, F.get("q", F.lit(0)))).alias(v) for k, v in enumerate(values)])
    return counts.join(mid, [i, j], "left").select(i, j, "n_boundary_edges", *values, "support_fraction")


def scatter(edges: DataFrame, i: str, j: str, value: Column) -> DataFrame:
    """Incidence sums: each edge's value counts at both of its ends."""
    v = edges.select(F.col(i).alias("a"), F.col(j).alias("b"), value.alias("v"))
    ends = v.withColumn("node", F.explode(F.array("a", "b")))
    return ends.groupBy("node").agg(F.count("v").alias("n"), F.sum("v").alias("total"), F.avg("v").alias("mean"))


def shares(df: DataFrame, keys: list[str], mass: str) -> DataFrame:
    """Each row's share of its group's mass."""
    return df.withColumn("share", ratio(mass, F.sum(mass).over(Window.partitionBy(*keys))))


def entropy(df: DataFrame, keys: list[str], mass: str) -> DataFrame:
    """Shannon entropy in nats of the masses by group."""
    p = F.col("share")
    return shares(df.where(F.col(mass) > 0), keys, mass).groupBy(*keys).agg((-F.sum(p * F.ln(p))).alias("entropy"), F.count("*").alias("n"))


def concentration(df: DataFrame, keys: list[str], mass: str, order: list[str]) -> DataFrame:
    """Gini, effective number 1 / sum p^2, K50/K80/K90 and the largest share by group.

    The ranks need a total order: ``order`` breaks ties of mass. Groups are
    ranked by windows over the group's keys.
    """
    down = Window.partitionBy(*keys).orderBy(F.desc(mass), *order)
    up = Window.partitionBy(*keys).orderBy(F.asc(mass), *order)
    ranked = shares(df.where(F.col(mass) >= 0), keys, mass).select(*keys, mass, "share", F.row_number().over(up).alias("i"), F.row_number().over(down).alias("k"), F.sum("share").over(down.rowsBetween(Window.unboundedPreceding, 0)).alias("cum"))

    def k_at(f: float) -> Column:
        return F.min(F.when(F.col("cum") >= f - 1e-12, F.col("k")))

    n = F.count("*")
    gini = ratio(2 * F.sum(F.col("i") * F.col(mass)), n * F.sum(mass)) - (n + 1) / n
    return ranked.groupBy(*keys).agg(n.alias("n"), gini.alias("gini"), ratio(F.lit(1.0), F.sum(F.col("share") * F.col("share"))).alias("effective_number"), k_at(0.5).alias("k50"), k_at(0.8).alias("k80"), k_at(0.9).alias("k90"), F.max("share").alias("top_share"))


def dominant_set(df: DataFrame, keys: list[str], mass: str, order: list[str], fraction: float = 0.8) -> DataFrame:
    """Flags the smallest set of largest masses that reaches ``fraction`` of the group's."""
    down = Window.partitionBy(*keys).orderBy(F.desc(mass), *order)
    cum = F.sum("share").over(down.rowsBetween(Window.unboundedPreceding, -1))
    return shares(df, keys, mass).withColumn("dominant", F.coalesce(cum, F.lit(0.0)) < fraction - 1e-12)


def dispersion(df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Within-group variance as E[x^2] - E[x]^2, floored at 0, and its sum over the values."""
    out = df.groupBy(*keys).agg(F.count("*").alias("n"), *[F.greatest(F.lit(0.0), F.avg(F.col(v) * F.col(v)) - F.avg(v) * F.avg(v)).alias(f"var_{v}") for v in values])
    return out.withColumn("mse", sum((F.col(f"var_{v}") for v in values[1:]), F.col(f"var_{values[0]}")))


def weighted_mean(x, w) -> Column:
    """Sum of w x over sum of w, where both are there."""
    ok = c(x).isNotNull() & c(w).isNotNull()
    return ratio(F.sum(F.when(ok, c(w) * c(x))), F.sum(F.when(ok, c(w))))


def weighted_quantile(df: DataFrame, keys: list[str], x: str, w: str, q: float) -> DataFrame:
    """The least value whose running weight reaches q of the total (a step function)."""
    run = Window.partitionBy(*keys).orderBy(x).rangeBetween(Window.unboundedPreceding, 0)
    use = df.where(F.col(x).isNotNull() & (F.col(w) > 0))
    cum = use.select(*keys, x, ratio(F.sum(w).over(run), F.sum(w).over(Window.partitionBy(*keys))).alias("cum"))
    return cum.where(F.col("cum") >= q - 1e-12).groupBy(*keys).agg(F.min(x).alias("weighted_quantile"))


def block_rms(df: DataFrame, keys: list[str], block: str, value: str) -> DataFrame:
    """RMS within a block, then RMS of the blocks, so every block counts the same."""
    inner = df.groupBy(*keys, block).agg(F.sqrt(F.avg(F.col(value) * F.col(value))).alias("rms"))
    return inner.groupBy(*keys).agg(F.sqrt(F.avg(F.col("rms") * F.col("rms"))).alias("balanced_norm"), F.count("rms").alias("blocks"))


def contribution(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Each row's share of its group's sum of squares."""
    sq = F.col(value) * F.col(value)
    return df.withColumn("contribution", ratio(sq, F.sum(sq).over(Window.partitionBy(*keys))))


def set_union(values: str) -> Column:
    """Distinct values, sorted, joined by a bar."""
    return F.array_join(F.array_sort(F.collect_set(values)), "|")


def threshold_grid(df: DataFrame, x: str, qs: list[float]) -> DataFrame:
    """For each quantile of a fixed grid: its value over ``df`` and the share of rows at or below it."""
    q = exact_quantiles(df, [], x, qs).select(F.col("q").alias("t"))  # one row
    grid = F.arrays_zip(F.col("t").alias("threshold"), F.array(*[F.lit(v) for v in qs]).alias("quantile"))
    return df.select(x).crossJoin(F.broadcast(q)).select(x, F.inline(grid).alias("threshold", "quantile")).groupBy("quantile", "threshold").agg(F.avg((F.col(x) <= F.col("threshold")).cast("double")).alias("share"))


def failure_counts(df: DataFrame, gates: list[str]) -> DataFrame:
    """By gate, how many rows fail it and the share that passes; a NULL gate fails. Gates overlap."""
    wide = df.select(*[F.coalesce(F.col(g), F.lit(False)).cast("int").alias(g) for g in gates])
    long = wide.unpivot([], gates, "gate", "passes")
    return long.groupBy("gate").agg(F.sum(1 - F.col("passes")).alias("failures"), F.avg("passes").alias("pass_fraction"))


def duplicates(df: DataFrame, key: str) -> DataFrame:
    """One row: rows, distinct keys, repeated keys, NULL keys."""
    per = df.groupBy(key).agg(F.count("*").alias("n"))
    return per.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count(key).alias("distinct_keys"),
        F.count_if((F.col("n") > 1) & F.col(key).isNotNull()).alias("repeated_keys"), F.coalesce(F.sum(F.when(F.col(key).isNull(), F.col("n"))), F.lit(0)).alias("null_keys"),
    )
