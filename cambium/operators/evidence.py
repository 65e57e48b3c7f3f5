"""Summaries of evidence: means over what was observed, statuses, exact look-ups, contrasts and selections."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StructType

from cambium.functions.scalars import ratio
from cambium.scratch import written


def median(x) -> Column:
    return F.percentile(x, F.lit(0.5))


def relation_means(edges: DataFrame, columns: list[str], keys: tuple[str, str] = ("super_i", "super_j")) -> DataFrame:
    """Mean of each named column that is there, NULL left out, and the number of edges of each relation."""
    there = [x for x in columns if x in edges.columns]
    return edges.groupBy(*keys).agg(*[F.avg(x).alias(x) for x in there], F.count("*").alias("n_level0_edges"))


def observed_means(df: DataFrame, keys: list[str], masks: dict[str, Column]) -> DataFrame:
    """Mean of each column over the rows where its mask holds; NULL where it never does."""
    return df.groupBy(*keys).agg(*[F.avg(F.when(m, F.col(x))).alias(x) for x, m in masks.items()])


def loop_incidence(loops: DataFrame, cells: DataFrame) -> DataFrame:
    """Loops that each cell is in: counts by status, sums and greatest density over directional loops with a density.

    ``loops`` has nodes (array), resolved, directional, defined, angle, area and density. Cells without loops count 0.
    """
    each = loops.select(F.explode("nodes").alias("cell"), "resolved", "directional", "defined", "angle", "area", "density")
    both = F.col("directional") & F.col("defined")
    got = each.groupBy("cell").agg(
        F.count_if("resolved").alias("resolved_loops"), F.count_if("directional").alias("directional_loops"), F.count_if("defined").alias("defined_loops"),
        F.sum(F.when(both, F.col("angle"))).alias("angle_sum"), F.sum(F.when(both, F.col("area"))).alias("area_sum"),
        F.sum(F.when(both, F.col("density"))).alias("density_sum"), F.max(F.when(both, F.greatest(F.lit(0.0), "density"))).alias("_most"),
    )
    counts = ("resolved_loops", "directional_loops", "defined_loops")
    out = cells.select("cell").join(got, "cell", "left")
    out = out.withColumns({n: F.coalesce(n, F.lit(0)) for n in counts} | {n: F.coalesce(n, F.lit(0.0)) for n in ("angle_sum", "area_sum", "density_sum")})
    return out.select(
        "cell", *counts, "angle_sum", "area_sum", "density_sum", F.when(F.col("directional_loops") > 0, F.coalesce("_most", F.lit(0.0))).alias("density_max"),
        F.when(F.col("resolved_loops") > 0, F.col("directional_loops") / F.col("resolved_loops")).otherwise(0.0).alias("directional_fraction"),
        F.when(F.col("directional_loops") > 0, F.col("density_sum") / F.col("directional_loops")).alias("mean_density"), F.when(F.col("area_sum") > 0, F.col("angle_sum") / F.col("area_sum")).alias("area_weighted_density"),
    )


def evidence_status(df: DataFrame, keys: list[str], status: str, residual: str, observable: str = "OBSERVABLE", marginal: str = "NUMERICALLY_MARGINAL") -> DataFrame:
    """Status of an object over its occurrences: robust with two certifications, local with one, else marginal if any is, else unresolved."""
    n = df.groupBy(*keys).agg(
        F.count("*").alias("occurrences"), F.count_if(F.col(status) == observable).alias("certified"), F.count_if(F.col(status) == marginal).alias("marginal"),
        F.min(residual).alias("best_residual"), median(F.col(residual)).alias("median_residual"),
    )
    kind = F.when(F.col("certified") >= 2, "ROBUST_OBSERVABLE").when(F.col("certified") == 1, "LOCAL_OBSERVABLE").when(F.col("marginal") > 0, "NUMERICALLY_MARGINAL").otherwise("UNRESOLVED")
    return n.withColumn("status", kind)


def first_and_size(df: DataFrame, keys: list[str], first: list[str], order: list[str]) -> DataFrame:
    """The first row's columns by a deterministic order, and the number of rows of each composite key."""
    best = F.min_by(F.struct(*first), F.struct(*order))
    return df.groupBy(*keys).agg(best.alias("_f"), F.count("*").alias("size")).select(*keys, *[F.col(f"_f.{x}").alias(x) for x in first], "size")


def patch_summary(df: DataFrame, keys: list[str], nullity: str, means: list[tuple[str, str]], tails: tuple[float, ...] = (20, 100)) -> DataFrame:
    """Share of patches with nullity 0, its median and 0.9 quantile, weighted means (column, weight) and the shares above each tail."""
    n = F.col(nullity)
    share = lambda p: F.avg(F.when(p, 1.0).otherwise(0.0))
    weighted = []
    for x, w in means:
        use = F.col(x).isNotNull() & (F.col(w) > 0)
        weighted.append(ratio(F.sum(F.when(use, F.col(x) * F.col(w))), F.sum(F.when(use, F.col(w)))).alias(f"mean_{x}"))
    return df.groupBy(*keys).agg(
        F.count("*").alias("patches"), share(n == 0).alias("identifiable"), median(n).alias("median_nullity"), F.percentile(n, F.lit(0.9)).alias("q90_nullity"), *weighted, *[share(n > t).alias(f"tail_{t:g}") for t in tails]
    )


def quadrants(df: DataFrame, keys: list[str], mass: str, spread: str, mass_q: float, spread_q: float) -> DataFrame:
    """``quadrant`` by the quantiles of mass and spread within a group; unresolved where a value is missing."""
    cut = df.groupBy(*keys).agg(F.percentile(mass, F.lit(mass_q)).alias("mass_cut"), F.percentile(spread, F.lit(spread_q)).alias("spread_cut"))
    size = F.when(F.col(mass) >= F.col("mass_cut"), "large").otherwise("small")
    kind = F.when(F.col(spread) >= F.col("spread_cut"), "heterogeneous").otherwise("coherent")
    known = F.col(mass).isNotNull() & F.col(spread).isNotNull() & F.col("mass_cut").isNotNull() & F.col("spread_cut").isNotNull()
    return df.join(cut, keys).withColumn("quadrant", F.when(known, F.concat_ws("_", size, kind, F.lit("candidate"))).otherwise("unresolved"))


def best_source(df: DataFrame, keys: list[str], source: list[str], u: str) -> DataFrame:
    """The rows of each key's source with most distinct u, ties by the source's name; sources are never mixed."""
    n = df.groupBy(*keys, *source).agg(F.count_distinct(u).alias("n_u"))
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n_u"), *source))
    return df.join(n.withColumn("_k", first).where("_k = 1").drop("_k"), [*keys, *source])


def confusion(a: DataFrame, b: DataFrame, keys: list[str], class_a: str, class_b: str) -> DataFrame:
    """Counts of class pairs over rows that agree in a composite key."""
    x, y = a.select(*keys, F.col(class_a).alias("class_a")), b.select(*keys, F.col(class_b).alias("class_b"))
    return x.join(y, keys, "inner").groupBy("class_a", "class_b").agg(F.count("*").alias("n"))


def exact_lookup(landmarks: DataFrame, table: DataFrame, ident: str, order: str, tolerance: float = 1e-10) -> DataFrame:
    """For each landmark one row of a table, by explicit scale keys alone: index, else nodes, else removed fraction, else ell.

    A landmark has ``index``, ``nodes``, ``removed`` and ``ell``, and so has the
    table. Of several rows with an equal index the first by ``order`` is taken.
    Equal nodes count if one row has them, or if the nearest of them in removed
    fraction is within the tolerance; removed fraction and ell are compared
    within it. Values near one another fall into the same or a neighbouring bin of the
    tolerance's width, so no pairs but near ones are formed. Landmarks without a row have ``how`` NULL.
    """
    t = table.select(*[F.col(c).alias(f"t_{c}") for c in table.columns])
    picked = []
    one = landmarks.join(t, F.col("index") == F.col("t_index"))
    picked.append(one.withColumns({"_tier": F.lit(1), "_gap": F.lit(0.0), "how": F.lit("index")}))
    same = t.where("t_nodes is not null").groupBy("t_nodes").agg(F.count("*").alias("_same"))
    nodes = landmarks.join(t.join(same, "t_nodes"), F.col("nodes") == F.col("t_nodes")).withColumn("_gap", F.abs(F.col("removed") - F.col("t_removed")))
    nodes = nodes.where((F.col("_same") == 1) | (F.col("_gap") <= tolerance)).withColumns({"_tier": F.lit(2), "how": F.when(F.col("_same") == 1, "nodes").otherwise("nodes_removed"), "_gap": F.coalesce("_gap", F.lit(0.0))}).drop("_same")
    picked.append(nodes)
    for tier, x in ((3, "removed"), (4, "ell")):
        cell = lambda c: F.floor(F.col(c) / tolerance)
        near = t.withColumn("_bin", F.explode(F.array(*[cell(f"t_{x}") + d for d in (-1, 0, 1)])))
        got = landmarks.withColumn("_bin", cell(x)).join(near, "_bin").drop("_bin").withColumn("_gap", F.abs(F.col(x) - F.col(f"t_{x}"))).where(F.col("_gap") <= tolerance)
        picked.append(got.withColumns({"_tier": F.lit(tier), "how": F.lit(x)}))
    every = reduce(DataFrame.unionByName, [p.select(*landmarks.columns, *t.columns, "_tier", "_gap", "how") for p in picked])
    best = every.withColumn("_k", F.row_number().over(Window.partitionBy(ident).orderBy("_tier", "_gap", f"t_{order}"))).where("_k = 1")
    return landmarks.join(best.select(ident, *t.columns, "how"), ident, "left")


def numbered(df: DataFrame, order: list[str], name: str = "position") -> DataFrame:
    """Rows with their place in a total order: sorted by range, counted by partition; only the counts go to the driver."""
    ranked = written(df.orderBy(*order).withColumn("_part", F.spark_partition_id()), "numbered")
    counts = ranked.groupBy("_part").agg(F.count("*").alias("n")).collect()
    offset, rows = 0, []
    for r in sorted(counts):
        rows.append((r["_part"], offset))
        offset += r["n"]
    offsets = df.sparkSession.createDataFrame(rows, "_part int, _offset long")
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) + F.col("_offset")
    return ranked.join(F.broadcast(offsets), "_part").withColumn(name, place.cast("long")).drop("_part", "_offset")


def side_by_side(a: DataFrame, b: DataFrame, order_a: list[str], order_b: list[str]) -> DataFrame:
    """Rows of two aligned tables joined by position; an error if one has more rows."""
    x, y = numbered(a, order_a), numbered(b, order_b)
    there = x.withColumn("_a", F.lit(True)).join(y.withColumn("_b", F.lit(True)), "position", "full_outer")
    bad = F.raise_error(F.lit("tables of different length")).cast("boolean")
    return there.where(F.when(F.col("_a").isNull() | F.col("_b").isNull(), bad).otherwise(True)).drop("_a", "_b")


def typed_rows(df: DataFrame, source: str, sender: str, receiver: str, kind: str, allowed: tuple[str, ...] = ("contact", "diffusible")) -> DataFrame:
    """Interactions with both ends named, of the tables (``source``) whose kinds are all known; one unknown kind rejects its table."""
    named = df.where((F.trim(F.coalesce(F.col(sender), F.lit(""))) != "") & (F.trim(F.coalesce(F.col(receiver), F.lit(""))) != ""))
    known = F.coalesce(F.lower(F.trim(F.col(kind))).isin(*allowed), F.lit(False))
    return named.join(named.where(~known).select(source).distinct(), source, "left_anti")


def mean_contrast(values: DataFrame, before: DataFrame, after: DataFrame, top: int, total: float = 10000.0) -> DataFrame:
    """Difference of means of ln(1 + share * total) between two sets of cells, the ``top`` largest in size.

    ``values`` is long: cell, feature, value; a share is of the cell's sum, where a sum of 0 counts as 1.
    """
    sums = values.groupBy("cell").agg(F.sum("value").alias("_s"))
    logs = values.join(sums, "cell").withColumn("_l", F.log1p(F.col("value") / F.when(F.col("_s") > 0, F.col("_s")).otherwise(1.0) * total))
    sides = []
    for name, cells in (("a", before), ("b", after)):
        n = cells.select("cell").distinct()
        sides.append(logs.join(n, "cell", "left_semi").groupBy("feature").agg(F.avg("_l").alias(name)))
    eff = sides[0].join(sides[1], "feature").select("feature", (F.col("b") - F.col("a")).alias("effect"))
    return eff.orderBy(F.desc(F.abs("effect")), "feature").limit(top)


def precursors(snapshots: DataFrame, terminal: DataFrame, most: int) -> DataFrame:
    """For the ``most`` largest terminal objects the number of different earlier labels at each checkpoint.

    ``snapshots`` has checkpoint, cell, node; ``terminal`` cell, node.
    """
    large = terminal.groupBy("node").agg(F.count("*").alias("mass")).orderBy(F.desc("mass"), "node").limit(most)
    cells = terminal.join(F.broadcast(large), "node").select("cell", F.col("node").alias("terminal"), "mass")
    return snapshots.join(cells, "cell").groupBy("terminal", "mass", "checkpoint").agg(F.count_distinct("node").alias("precursors"))


def selection_audit(df: DataFrame, ident: str, methods: dict[str, Column], reference: str, allowed: str, k: int) -> DataFrame:
    """The k first rows by each method's order: overlap with the reference method's (Jaccard) and the share of allowed ones."""
    firsts = {n: df.orderBy(o, ident).limit(k).select(F.col(ident), F.lit(n).alias("method")) for n, o in methods.items()}
    picked = reduce(DataFrame.unionByName, firsts.values()).join(df.select(ident, allowed), ident)
    ref = firsts[reference].select(ident, F.lit(True).alias("_r"))
    n_ref = F.least(F.lit(k), F.lit(df.count()))
    got = picked.join(ref, ident, "left").groupBy("method").agg(F.count("*").alias("selected"), F.count_if(F.col("_r")).alias("common"), F.avg(F.when(F.col(allowed), 1.0).otherwise(0.0)).alias("admissible_share"))
    return got.withColumn("jaccard", F.col("common") / (F.col("selected") + n_ref - F.col("common"))).drop("common")


def certified_values(df: DataFrame, keys: list[str], status: str, value: str, residuals: DataFrame, on: list[str], certified: str = "CERTIFIED") -> DataFrame:
    """Certified rows alone, each key once (an error else), with the residual of its class; others are left out."""
    rows = df.where(F.col(status) == certified).select(*dict.fromkeys([*keys, *on, value]))
    many = F.count("*").over(Window.partitionBy(*keys))
    once = F.when(F.col("_n") > 1, F.raise_error(F.lit("a certified key occurs twice")).cast("boolean")).otherwise(True)
    return rows.withColumn("_n", many).where(once).drop("_n").join(residuals.dropDuplicates(on), on, "left")


def relative_convergence(df: DataFrame, keys: list[str], k: str, value: str) -> DataFrame:
    """Change of a value from each resolution to the next, relative to the finest one's, and its greatest by key."""
    w = Window.partitionBy(*keys).orderBy(k)
    last = F.last(value).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    step = F.abs(F.col(value) - F.lag(value).over(w)) / F.greatest(F.abs(last), F.lit(1e-12))
    return df.withColumn("_c", step).groupBy(*keys).agg(F.count("*").alias("resolutions"), F.max("_c").alias("largest_change"), F.max_by("_c", k).alias("last_change"))


def normal_name(name: str) -> str:
    return re.sub(r"[^a-z0-9]+", "_", name.lower()).strip("_")


def pattern_column(schema: StructType, patterns: list[str]) -> str | None:
    """The first numeric column whose normalised name matches one of the patterns."""
    return next((f.name for f in schema for p in patterns if re.search(p, normal_name(f.name)) and isinstance(f.dataType, NumericType)), None)
