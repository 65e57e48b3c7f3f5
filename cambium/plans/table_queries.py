"""Queries over cells, contacts, masses and partitions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cambium.functions import scalars as X
from cambium.operators import aggregates as A
from cambium.operators import audits, filters, geometry, graph, hierarchy, joins, partitions, selection, statistics, vectors
from cambium.plans.bindings import CONTACTS, LABELS, MASSES, MERGES, MESH, POINTS, cells, contacts, masses, merges, mesh, points
from cambium.plans.registry import query
from cambium.plans.series_queries import r6, rounded
from cambium.scratch import temporary, written
from cambium.sources.sinks import table_digest
from cambium.sources.tables import table


def sql(select: str, *ctes: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(ctes) + "\n" + select


# --- one level of the hierarchy -----------------------------------------------------------------------------------

OK = "tension IS NOT NULL AND pressure IS NOT NULL"
SUPER = f"""super AS (
  SELECT least(a.node, b.node) AS super_i, greatest(a.node, b.node) AS super_j, CAST(count(*) AS BIGINT) AS n_boundary_edges, CAST(sum(contacts.n) AS BIGINT) AS shared,
         quantile_cont(CASE WHEN {OK} THEN abs(tension) END, 0.5) AS tension, quantile_cont(CASE WHEN {OK} THEN abs(pressure) END, 0.5) AS pressure,
         avg(CASE WHEN {OK} THEN 1.0 ELSE 0.0 END) AS support_fraction
  FROM contacts JOIN cells a ON a.cell = i JOIN cells b ON b.cell = j WHERE a.node <> b.node GROUP BY 1, 2)"""


def supers(spark: SparkSession, sf: str) -> DataFrame:
    """Written, for the gates read it several times and each reading would form all contacts again."""
    ok = F.col("tension").isNotNull() & F.col("pressure").isNotNull()
    with temporary(spark) as stay:
        labels = written(cells(spark, sf).select("cell", "node"), "cells")
        e = contacts(spark, sf, lambda e: joins.relabel_edges(e, labels, "i", "j").select("super_i", "super_j", "n", F.abs("tension").alias("tension"), F.abs("pressure").alias("pressure")))
        e = e if hasattr(e, "_scratch") else written(e, "contacts")
        shared = e.groupBy("super_i", "super_j").agg(F.sum("n").alias("shared"))
        out = written(A.relation_summary(e, ["tension", "pressure"], ok).join(shared, ["super_i", "super_j"]), "relations")
        stay.append(out)
    return out


@query("ag01_relation_summary", sql(f"SELECT super_i, super_j, n_boundary_edges, shared, {r6('tension')} AS tension, {r6('pressure')} AS pressure, {r6('support_fraction')} AS support_fraction FROM super", CONTACTS, LABELS, SUPER))
def relation_summary(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(supers(spark, sf))


SCALED = """q AS (SELECT quantile_cont(tension, 0.5) AS tm, quantile_cont(tension, 0.25) AS t1, quantile_cont(tension, 0.75) AS t3, quantile_cont(pressure, 0.5) AS pm, quantile_cont(pressure, 0.25) AS p1, quantile_cont(pressure, 0.75) AS p3 FROM super),
z AS (SELECT super.*, round((tension - tm) / (t3 - t1 + 1e-9), 9) AS tension_z, round((pressure - pm) / (p3 - p1 + 1e-9), 9) AS pressure_z FROM super, q)"""
GATE = "coalesce(support_fraction >= 0.25, false) AND coalesce(abs(tension_z) <= 1.0, false) AND coalesce(abs(pressure_z) <= 1.0, false) AND coalesce(shared >= 1, false)"


def gated(spark: SparkSession, sf: str) -> DataFrame:
    s = supers(spark, sf)
    q = s.agg(A.quantiles("tension", [0.5, 0.25, 0.75]).alias("t"), A.quantiles("pressure", [0.5, 0.25, 0.75]).alias("p"))
    z = s.crossJoin(F.broadcast(q)).withColumns({"tension_z": F.round(X.robust_z("tension", F.col("t")[0], F.col("t")[1], F.col("t")[2]), 9), "pressure_z": F.round(X.robust_z("pressure", F.col("p")[0], F.col("p")[1], F.col("p")[2]), 9), "molecular_z": F.lit(0.0), "comm_support": F.col("shared").cast("double")}).drop("t", "p")
    return filters.conjunctive_gate(z, filters.boundary_gates(0.0, 0.25, 1.0, 1.0, 1.0))


@query("flt01_conjunctive_gate", sql(f"SELECT super_i, super_j, {r6('tension_z')} AS tension_z, {r6('pressure_z')} AS pressure_z, {GATE} AS admissible FROM z", CONTACTS, LABELS, SUPER, SCALED))
def gate(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(gated(spark, sf).select("super_i", "super_j", "tension_z", "pressure_z", "admissible"))


@query("ag15_failure_counts", sql(f"""SELECT gate, CAST(sum(CASE WHEN p THEN 0 ELSE 1 END) AS BIGINT) AS failures, {r6("avg(CASE WHEN p THEN 1.0 ELSE 0.0 END)")} AS pass_fraction FROM (
  SELECT 'pass_support' AS gate, coalesce(support_fraction >= 0.25, false) AS p FROM z UNION ALL SELECT 'pass_tension', coalesce(abs(tension_z) <= 1.0, false) FROM z UNION ALL SELECT 'pass_pressure', coalesce(abs(pressure_z) <= 1.0, false) FROM z) GROUP BY gate""", CONTACTS, LABELS, SUPER, SCALED))  # fmt: skip
def failures(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(A.failure_counts(gated(spark, sf), ["pass_support", "pass_tension", "pass_pressure"]))


def matched(spark: SparkSession, sf: str) -> DataFrame:
    g = gated(spark, sf).where("admissible")
    return selection.maximal_matching(g.select("super_i", "super_j", "shared", "tension"), [("shared", False), ("tension", True)])


# The sequential greedy choice: the best edge left, then the best that touches none taken, and so on.
GREEDY = f"""ok AS (SELECT *, row_number() OVER (ORDER BY shared DESC, tension, super_i, super_j) AS r FROM z WHERE {GATE}),
seq AS (SELECT list({{'r': r, 'i': super_i, 'j': super_j}} ORDER BY r) AS e FROM ok),
pick(k, used, taken) AS (
  SELECT 1::BIGINT, []::BIGINT[], []::BIGINT[] UNION ALL
  SELECT k + 1, CASE WHEN list_contains(used, e[k].i) OR list_contains(used, e[k].j) THEN used ELSE list_concat(used, [e[k].i, e[k].j]) END,
         CASE WHEN list_contains(used, e[k].i) OR list_contains(used, e[k].j) THEN taken ELSE list_append(taken, k) END
  FROM pick, seq WHERE k <= len(e)),
chosen AS (SELECT super_i, super_j FROM ok WHERE list_contains((SELECT arg_max(taken, k) FROM pick), r))"""


@query("so04_maximal_matching", sql("SELECT super_i, super_j FROM chosen", CONTACTS, LABELS, SUPER, SCALED, GREEDY))
def matching(spark: SparkSession, sf: str) -> DataFrame:
    return matched(spark, sf).select("super_i", "super_j")


LEVEL = "after AS (SELECT cell, coalesce(super_i, node) AS node FROM cells LEFT JOIN chosen ON super_j = node)"


@query("hi01_hierarchy_level", sql("SELECT node, CAST(count(*) AS BIGINT) AS size FROM after GROUP BY node", CONTACTS, LABELS, SUPER, SCALED, GREEDY, LEVEL))
def level(spark: SparkSession, sf: str) -> DataFrame:
    """One level end to end: contacts, relations, robust scale, gates, matching, contraction, sizes."""
    return hierarchy.sizes(hierarchy.contract(cells(spark, sf).select("cell", "node"), matched(spark, sf)))


# --- aggregates ----------------------------------------------------------------------------------------------------


@query("ag07_scatter", sql(f"SELECT node, count(v) AS n, {r6('sum(v)')} AS total, {r6('avg(v)')} AS mean FROM (SELECT i AS node, tension AS v FROM contacts UNION ALL SELECT j, tension FROM contacts) GROUP BY node", CONTACTS))
def scatter(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(A.scatter(contacts(spark, sf), "i", "j", F.col("tension")))


@query("ag08_mode", sql("SELECT c_nationkey, arg_min(c_mktsegment, {'k': -n, 'v': c_mktsegment}) AS mode, max(n) AS mode_count, CAST(sum(n) AS BIGINT) AS n FROM (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY ALL) GROUP BY c_nationkey", "one AS (SELECT 1)"))
def mode(spark: SparkSession, sf: str) -> DataFrame:
    return A.mode_by(table(spark, sf, "customer"), ["c_nationkey"], "c_mktsegment")


@query("ag09_11_robust_summary", sql("SELECT c_nationkey, n, " + ", ".join(f"{r6(x)} AS {x}" for x in ("mean", "sd", '"min"', '"max"', "mad", "q05", "q25", "q50", "q75", "q95")) + " FROM s JOIN m USING (c_nationkey)",
  "s AS (SELECT c_nationkey, count(c_acctbal) AS n, avg(c_acctbal) AS mean, stddev_pop(c_acctbal) AS sd, min(c_acctbal) AS \"min\", max(c_acctbal) AS \"max\", quantile_cont(c_acctbal, 0.05) AS q05, quantile_cont(c_acctbal, 0.25) AS q25, quantile_cont(c_acctbal, 0.5) AS q50, quantile_cont(c_acctbal, 0.75) AS q75, quantile_cont(c_acctbal, 0.95) AS q95 FROM customer GROUP BY c_nationkey)",
  "m AS (SELECT c.c_nationkey, quantile_cont(abs(c_acctbal - q50), 0.5) AS mad FROM customer c JOIN s USING (c_nationkey) GROUP BY ALL)"))
def robust(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(A.summary(table(spark, sf, "customer"), ["c_nationkey"], "c_acctbal").select("c_nationkey", "n", "mean", "sd", "min", "max", "mad", "q05", "q25", "q50", "q75", "q95"))


@query("ag10_centre_scale", sql(f"SELECT c_nationkey, n, {r6('q50')} AS centre, {r6('CASE WHEN n >= 4 THEN CASE WHEN q75 > q25 THEN (q75 - q25) / 1.349 END END')} AS scale FROM (SELECT c_nationkey, count(c_acctbal) AS n, quantile_cont(c_acctbal, 0.25) AS q25, quantile_cont(c_acctbal, 0.5) AS q50, quantile_cont(c_acctbal, 0.75) AS q75 FROM customer GROUP BY ALL)", "one AS (SELECT 1)"))
def centre(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(A.centre_and_scale(table(spark, sf, "customer"), ["c_nationkey"], "c_acctbal"))


@query("ag12_positive_scale", sql(f"SELECT c_mktsegment, {r6('coalesce(quantile_cont(CASE WHEN c_acctbal > 0 THEN c_acctbal END, 0.5), CASE WHEN quantile_cont(c_acctbal, 0.75) > 0 THEN quantile_cont(c_acctbal, 0.75) END, 1.0)')} AS scale FROM customer GROUP BY ALL", "one AS (SELECT 1)"))
def positive(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(table(spark, sf, "customer").groupBy("c_mktsegment").agg(A.positive_scale("c_acctbal").alias("scale")))


@query("ag13_14_threshold_grid", sql(f"SELECT k.q AS quantile, {r6('t')} AS threshold, {r6('avg(CASE WHEN c_acctbal <= t THEN 1.0 ELSE 0.0 END)')} AS share FROM customer, k GROUP BY ALL",
  "k AS (SELECT q, CASE q WHEN 0.1 THEN quantile_cont(c_acctbal, 0.1) WHEN 0.35 THEN quantile_cont(c_acctbal, 0.35) WHEN 0.5 THEN quantile_cont(c_acctbal, 0.5) ELSE quantile_cont(c_acctbal, 0.9) END AS t FROM customer, (SELECT unnest([0.1, 0.35, 0.5, 0.9]::DOUBLE[]) AS q) GROUP BY q)"))
def grid(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(A.threshold_grid(table(spark, sf, "customer"), "c_acctbal", [0.1, 0.35, 0.5, 0.9]))


@query("ag16_size_histogram", sql("SELECT mass AS size, count(*) AS n FROM objects GROUP BY mass", MASSES))
def histogram(spark: SparkSession, sf: str) -> DataFrame:
    return masses(spark, sf).groupBy(F.col("mass").alias("size")).agg(F.count("*").alias("n"))


@query("ag17_entropy", sql(f"SELECT sample, {r6('-sum(p * ln(p))')} AS entropy, count(*) AS n FROM (SELECT sample, mass / sum(mass) OVER (PARTITION BY sample) AS p FROM objects) GROUP BY sample", MASSES))
def entropy(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(A.entropy(masses(spark, sf), ["sample"], "mass"))


RANKED = """ranked AS (SELECT *, mass / sum(mass) OVER (PARTITION BY sample) AS p, row_number() OVER (PARTITION BY sample ORDER BY mass, id) AS i, row_number() OVER (PARTITION BY sample ORDER BY mass DESC, id) AS k,
  sum(mass) OVER (PARTITION BY sample ORDER BY mass DESC, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / sum(mass) OVER (PARTITION BY sample) AS cum FROM objects)"""


@query("ag18_concentration", sql(f"SELECT sample, count(*) AS n, {r6('2 * sum(i * mass) / (count(*) * sum(mass)) - (count(*) + 1) / count(*)')} AS gini, {r6('1 / sum(p * p)')} AS effective_number, min(k) FILTER (WHERE cum >= 0.5 - 1e-12) AS k50, min(k) FILTER (WHERE cum >= 0.8 - 1e-12) AS k80, min(k) FILTER (WHERE cum >= 0.9 - 1e-12) AS k90, {r6('max(p)')} AS top_share FROM ranked GROUP BY sample", MASSES, RANKED))
def concentration(spark: SparkSession, sf: str) -> DataFrame:
    out = A.concentration(masses(spark, sf), ["sample"], "mass", ["id"])
    return rounded(out.withColumns({n: F.col(n).cast("long") for n in ("k50", "k80", "k90")}))


@query("ag19_dispersion", sql(f"SELECT sample, count(*) AS n, {r6('greatest(0, avg(x * x) - avg(x) * avg(x))')} AS var_x, {r6('greatest(0, avg(y * y) - avg(y) * avg(y))')} AS var_y, {r6('greatest(0, avg(x * x) - avg(x) * avg(x)) + greatest(0, avg(y * y) - avg(y) * avg(y))')} AS mse FROM points GROUP BY sample", POINTS))
def dispersion(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(A.dispersion(points(spark, sf), ["sample"], ["x", "y"]))


@query("ag04_centroids", sql(f"SELECT p.sample, {r6('any_value(cx)')} AS cx, {r6('any_value(cy)')} AS cy, {r6('max(sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy)))')} AS radius, count(*) AS n FROM points p JOIN c USING (sample) GROUP BY p.sample", POINTS, "c AS (SELECT sample, avg(x) AS cx, avg(y) AS cy FROM points GROUP BY sample)"))
def centroids(spark: SparkSession, sf: str) -> DataFrame:
    p = points(spark, sf)
    c = p.groupBy("sample").agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"))
    d = F.sqrt((F.col("x") - F.col("cx")) * (F.col("x") - F.col("cx")) + (F.col("y") - F.col("cy")) * (F.col("y") - F.col("cy")))
    return rounded(p.join(c, "sample").groupBy("sample").agg(F.first("cx").alias("cx"), F.first("cy").alias("cy"), F.max(d).alias("radius"), F.count("*").alias("n")))


@query("ag03_mean_state", sql(f"SELECT sample AS node, CAST(d AS INTEGER) AS dim, {r6('avg(state[d + 1])')} AS v FROM points, range(64) t(d) GROUP BY ALL", POINTS))
def mean_state(spark: SparkSession, sf: str) -> DataFrame:
    p = points(spark, sf)
    m = vectors.mean_state(p.withColumnRenamed("id", "cell"), p.select(F.col("id").alias("cell"), F.col("sample").alias("node")), "state")
    return rounded(m.select("node", F.posexplode("state").alias("dim", "v")))


@query("ag21_component_summary", sql(f"SELECT i % 7 AS g, count(*) AS n, {r6('sum(tension) / nullif(sum(n), 0)')} AS ratio, {r6('quantile_cont(abs(tension), 0.5)')} AS mid, {r6('quantile_cont(abs(tension), 0.95)')} AS q95, {r6('max(abs(tension))')} AS most FROM contacts GROUP BY ALL", CONTACTS))
def component_summary(spark: SparkSession, sf: str) -> DataFrame:
    with temporary(spark) as stay:
        c = written(contacts(spark, sf).select((F.col("i") % 7).alias("g"), "n", "tension", F.abs("tension").alias("t")), "contacts")
        sums = c.groupBy("g").agg(F.count("*").alias("n"), X.ratio(F.sum("tension"), F.sum("n")).alias("ratio"), F.max("t").alias("most"))
        q = A.exact_quantiles(c.select("g", "t"), ["g"], "t", [0.5, 0.95]).select("g", F.get("q", F.lit(0)).alias("mid"), F.get("q", F.lit(1)).alias("q95"))
        out = written(rounded(sums.join(q, "g", "left").select("g", "n", "ratio", "mid", "q95", "most")), "components")
        stay.append(out)
    return out


@query("ag24_set_union", sql("SELECT c_nationkey, array_to_string(list_sort(list(DISTINCT c_mktsegment)), '|') AS segments FROM customer GROUP BY ALL", "one AS (SELECT 1)"))
def set_union(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").groupBy("c_nationkey").agg(A.set_union("c_mktsegment").alias("segments"))


@query("ag25_weighted_mean", sql(f"SELECT l_returnflag, {r6('sum(l_quantity * l_discount) / sum(l_quantity)')} AS discount FROM lineitem GROUP BY ALL", "one AS (SELECT 1)"))
def weighted(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(table(spark, sf, "lineitem").groupBy("l_returnflag").agg(A.weighted_mean("l_discount", "l_quantity").alias("discount")))


@query("ag26_weighted_quantile", sql("SELECT l_returnflag, min(l_quantity) AS weighted_quantile FROM (SELECT l_returnflag, l_quantity, sum(l_linenumber) OVER (PARTITION BY l_returnflag ORDER BY l_quantity RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / sum(l_linenumber) OVER (PARTITION BY l_returnflag) AS c FROM lineitem) WHERE c >= 0.7 - 1e-12 GROUP BY l_returnflag", "one AS (SELECT 1)"))
def weighted_quantile(spark: SparkSession, sf: str) -> DataFrame:
    # Values are few: weights are added up before the window, so no group is sorted whole.
    li = table(spark, sf, "lineitem").groupBy("l_returnflag", "l_quantity").agg(F.sum("l_linenumber").alias("w"))
    return A.weighted_quantile(li, ["l_returnflag"], "l_quantity", "w", 0.7)


@query("ag30_duplicates", sql("SELECT CAST(sum(n) AS BIGINT) AS rows, count(k) AS distinct_keys, count(*) FILTER (WHERE n > 1 AND k IS NOT NULL) AS repeated_keys, CAST(coalesce(sum(n) FILTER (WHERE k IS NULL), 0) AS BIGINT) AS null_keys FROM (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY ALL)", "one AS (SELECT 1)"))
def duplicates(spark: SparkSession, sf: str) -> DataFrame:
    return A.duplicates(table(spark, sf, "orders"), "o_custkey")


@query("wn30_dominant_set", sql("SELECT sample, id, coalesce(sum(mass) OVER (PARTITION BY sample ORDER BY mass DESC, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) / sum(mass) OVER (PARTITION BY sample), 0) < 0.8 - 1e-12 AS dominant FROM objects", MASSES))
def dominant(spark: SparkSession, sf: str) -> DataFrame:
    return A.dominant_set(masses(spark, sf), ["sample"], "mass", ["id"]).select("sample", "id", "dominant")


# --- filters and scalars ---------------------------------------------------------------------------------------------


@query("flt03_scale_threshold", sql(f"SELECT i, j, {r6('least(8.0, 2.0 * (1 + 0.4 * ln(1 + greatest(0, n - 1))))')} AS tau, coalesce(abs(pressure) * 100 <= least(8.0, 2.0 * (1 + 0.4 * ln(1 + greatest(0, n - 1)))), false) AS merge_allowed FROM contacts", CONTACTS))
def threshold(spark: SparkSession, sf: str) -> DataFrame:
    c = contacts(spark, sf).withColumns({"cost": F.abs("pressure") * 100, "tau": X.scale_threshold(F.lit(2.0), F.lit(8.0), F.col("n"))})
    return rounded(filters.below_cost(c, "cost", F.col("tau")).select("i", "j", "tau", "merge_allowed"))


@query("flt04_05_eligible", sql("SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_totalprice > 100000 AND o_totalprice IS NOT NULL", "one AS (SELECT 1)"))
def eligible(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").withColumn("big", F.col("o_totalprice") > 100000)
    o = filters.at_least(o, "o_orderpriority", ["5-LOW", "4-NOT SPECIFIED", "3-MEDIUM", "2-HIGH", "1-URGENT"], "2-HIGH")
    return filters.eligible(o, ["o_totalprice"], ["big"]).select("o_orderkey")


@query("flt06_alive_at", sql("SELECT removed FROM ledger WHERE microstep <= 6 AND (microstep + removed % 5 > 6 OR removed % 5 = 0)", MERGES))
def alive(spark: SparkSession, sf: str) -> DataFrame:
    m = merges(spark, sf).withColumn("death", F.when(F.col("removed") % 5 != 0, F.col("microstep") + F.col("removed") % 5))
    return filters.alive_at(m, "microstep", "death", 6).select("removed")


@query("flt08_10_status", sql("SELECT id, v IS NULL OR upper(trim(v)) IN ('', 'UNASSIGNED', '0', '-1', 'NONE', 'NAN', 'NULL', '4294967295') AS unassigned, CASE WHEN upper(trim(v)) IN ('PASS', 'PASSED', 'TRUE', 'YES', 'OK', '1', '1.0') THEN 1.0 WHEN upper(trim(v)) IN ('FAIL', 'FAILED', 'FALSE', 'NO', '0', '0.0') THEN 0.0 END::DOUBLE AS status FROM s",
  "s AS (SELECT event_id AS id, CASE event_id % 6 WHEN 0 THEN NULL WHEN 1 THEN ' pass' WHEN 2 THEN 'unassigned' WHEN 3 THEN 'No' WHEN 4 THEN '0' ELSE event_type END AS v FROM events)"))
def status(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("event_id") % 6
    v = F.when(k == 0, F.lit(None).cast("string")).when(k == 1, " pass").when(k == 2, "unassigned").when(k == 3, "No").when(k == 4, "0").otherwise(F.col("event_type"))
    return table(spark, sf, "events").select(F.col("event_id").alias("id"), X.unassigned(v).alias("unassigned"), X.status_to_float(v).alias("status"))


@query("flt09_nearest_to_centre", sql("SELECT sample, id FROM (SELECT p.sample, id, row_number() OVER (PARTITION BY p.sample ORDER BY (x - cx) ** 2 + (y - cy) ** 2, id) AS r FROM points p JOIN c USING (sample)) WHERE r <= 5", POINTS, "c AS (SELECT sample, quantile_cont(x, 0.5) AS cx, quantile_cont(y, 0.5) AS cy FROM points GROUP BY sample)"))
def near_centre(spark: SparkSession, sf: str) -> DataFrame:
    return filters.nearest_to_centre(points(spark, sf), ["sample"], "x", "y", "id", 5).select("sample", "id")


@query("sc03_directionality", sql(f"SELECT i, j, {r6('f + b')} AS support, {r6('CASE WHEN f + b >= 0.5 AND f + b > 0 THEN greatest(-1, least(1, (f - b) / (f + b + 1e-12))) END')} AS direction, {r6('CASE WHEN f + b >= 0.5 AND f + b > 0 THEN greatest(0, least(1, 1 - abs(f - b) / (f + b + 1e-12))) END')} AS reciprocity FROM d",
  CONTACTS, "d AS (SELECT i, j, greatest(0, coalesce(pressure, 0)) * 100 AS f, greatest(0, -coalesce(pressure, 0)) * 50 + n * 0.1 AS b FROM contacts)"))
def direction(spark: SparkSession, sf: str) -> DataFrame:
    p = F.coalesce("pressure", F.lit(0.0))
    d = contacts(spark, sf).withColumns({"f": F.greatest(F.lit(0.0), p) * 100, "b": F.greatest(F.lit(0.0), -p) * 50 + F.col("n") * 0.1})
    return rounded(d.select("i", "j", X.support("f", "b").alias("support"), X.directionality("f", "b", 0.5).alias("direction"), X.reciprocity("f", "b", 0.5).alias("reciprocity")))


PEN = "CASE WHEN pressure IS NOT NULL THEN ln(1 + abs(pressure) / 0.01) END"
PEN_N = "exp(-greatest(n, 0) / 2.0)"


@query("sc05_composite_cost", sql(f"SELECT i, j, {r6('m + ln((CASE WHEN p1 IS NULL THEN 0 ELSE 0.8 * exp(3 * (p1 - m)) END + 0.4 * exp(3 * (p2 - m))) / (CASE WHEN p1 IS NULL THEN 0 ELSE 0.8 END + 0.4)) / 3 + 0.35 * (1 - (CASE WHEN p1 IS NULL THEN 0 ELSE 0.8 END + 0.4) / 1.4)')} AS cost FROM (SELECT *, coalesce(greatest(p1, p2), p2) AS m FROM k)", CONTACTS, f"k AS (SELECT i, j, {PEN} AS p1, {PEN_N} AS p2 FROM contacts)"))
def composite(spark: SparkSession, sf: str) -> DataFrame:
    c = contacts(spark, sf)
    p1, p2 = X.penalty(F.abs("pressure"), F.lit(0.01)), X.affinity_penalty("n", F.lit(2.0))
    p1 = F.when(F.col("pressure").isNotNull(), p1)
    return rounded(c.select("i", "j", X.log_sum_exp_cost([(p1, F.lit(0.8), 1.0, F.col("pressure").isNotNull()), (p2, F.lit(1.0), 0.4, F.lit(True))]).alias("cost")))


@query("sc12_lists", sql("SELECT p_partkey, list_distinct_keep AS parts FROM (SELECT p_partkey, array_to_string(list_transform(list_filter(list_zip(w, range(len(w))), lambda x: list_position(w, x[1]) = x[2] + 1), lambda x: x[1]), '|') AS list_distinct_keep FROM (SELECT p_partkey, list_filter(list_transform(regexp_split_to_array(p_name || ' ' || p_brand, '[_+&|:/\\s]+'), lambda v: upper(trim(v))), lambda v: v <> '') AS w FROM part))", "one AS (SELECT 1)"))
def lists(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    return p.select("p_partkey", F.array_join(X.complex_parts(F.concat_ws(" ", "p_name", "p_brand")), "|").alias("parts"))


@query("sc15_json_leaves", sql("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events", "one AS (SELECT 1)"))
def leaves(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("sc18_tail_threshold", sql(f"SELECT l_returnflag, {r6('greatest(quantile_cont(l_extendedprice, 0.999), quantile_cont(l_extendedprice, 0.5) + 50 * (quantile_cont(l_extendedprice, 0.75) - quantile_cont(l_extendedprice, 0.25)))')} AS threshold FROM lineitem GROUP BY ALL", "one AS (SELECT 1)"))
def tail(spark: SparkSession, sf: str) -> DataFrame:
    q = table(spark, sf, "lineitem").groupBy("l_returnflag").agg(A.quantiles("l_extendedprice", [0.999, 0.5, 0.25, 0.75]).alias("q"))
    return rounded(q.select("l_returnflag", X.tail_threshold(F.col("q")[0], F.col("q")[1], F.col("q")[3] - F.col("q")[2]).alias("threshold")))


@query("sc21_log_normalise", sql(f"SELECT l_orderkey, l_linenumber, {r6('ln(1 + l_quantity * t / lib)')} AS value FROM (SELECT *, sum(l_quantity) OVER (PARTITION BY l_orderkey) AS lib FROM lineitem), (SELECT quantile_cont(s, 0.5) AS t FROM (SELECT sum(l_quantity) AS s FROM lineitem GROUP BY l_orderkey))", "one AS (SELECT 1)"))
def log_normalise(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    lib = li.groupBy("l_orderkey").agg(F.sum("l_quantity").alias("lib"))
    t = lib.agg(A.median("lib").alias("t"))
    return rounded(li.join(lib, "l_orderkey").crossJoin(F.broadcast(t)).select("l_orderkey", "l_linenumber", X.normalised_expression("l_quantity", "lib", "t").alias("value")))


# --- joins -------------------------------------------------------------------------------------------------------------


@query("jn01_relabel_edges", sql("SELECT i, j, least(a.node, b.node) AS super_i, greatest(a.node, b.node) AS super_j, a.node > b.node AS flipped FROM contacts JOIN cells a ON a.cell = i JOIN cells b ON b.cell = j WHERE a.node <> b.node", CONTACTS, LABELS))
def relabel(spark: SparkSession, sf: str) -> DataFrame:
    return joins.relabel_edges(contacts(spark, sf), cells(spark, sf).select("cell", "node"), "i", "j").select("i", "j", "super_i", "super_j", "flipped")


@query("jn02_attach_ends", sql(f"SELECT i, j, {r6('a.mass')} AS mass_i, {r6('b.mass')} AS mass_j FROM contacts JOIN cells a ON a.cell = i JOIN cells b ON b.cell = j", CONTACTS, LABELS))
def ends(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(joins.attach_ends(contacts(spark, sf).select("i", "j"), cells(spark, sf), "cell", "i", "j", ["mass"]))


@query("jn03_04_validated", sql("SELECT o_orderkey, c_name FROM orders LEFT JOIN customer ON c_custkey = o_custkey", "one AS (SELECT 1)"))
def validated(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    return joins.many_to_one(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), c, ["o_custkey"]).select("o_orderkey", "c_name")


@query("jn06_semi_anti", sql("SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) AS active FROM customer", "one AS (SELECT 1)"))
def semi_anti(spark: SparkSession, sf: str) -> DataFrame:
    c, o = table(spark, sf, "customer").select("c_custkey"), table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return c.join(o, "c_custkey", "left_semi").withColumn("active", F.lit(True)).unionByName(c.join(o, "c_custkey", "left_anti").withColumn("active", F.lit(False)))


@query("jn07_cascade", sql("SELECT s_suppkey, coalesce(a.v, b.v) AS value, CASE WHEN a.v IS NOT NULL THEN 1 WHEN b.v IS NOT NULL THEN 2 END AS source FROM supplier LEFT JOIN a ON a.k = s_suppkey LEFT JOIN b ON b.n = s_nationkey",
  "a AS (SELECT c_custkey AS k, c_acctbal AS v FROM customer WHERE c_custkey % 3 = 0)", "b AS (SELECT c_nationkey AS n, min(c_acctbal) AS v FROM customer WHERE c_nationkey % 2 = 0 GROUP BY ALL)"))
def cascade(spark: SparkSession, sf: str) -> DataFrame:
    s, c = table(spark, sf, "supplier").select("s_suppkey", "s_nationkey"), table(spark, sf, "customer")
    one = c.where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("s_suppkey"), F.col("c_acctbal").alias("value"))
    two = c.where("c_nationkey % 2 = 0").select(F.col("c_nationkey").alias("s_nationkey"), F.col("c_acctbal").alias("value"))
    return joins.cascade(s, [(one, ["s_suppkey"]), (two, ["s_nationkey"])], "value").select("s_suppkey", "value", "source")


@query("jn09_nearest", sql(f"""SELECT s_suppkey, r_c_custkey, {r6("gap")} AS gap FROM (SELECT s_suppkey, c_custkey AS r_c_custkey, abs(s_acctbal - c_acctbal) AS gap, row_number() OVER (PARTITION BY s_suppkey ORDER BY abs(s_acctbal - c_acctbal), c_acctbal, c_custkey) AS k FROM supplier JOIN customer ON c_nationkey = s_nationkey) WHERE k = 1""", "one AS (SELECT 1)"))
def nearest(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "supplier").select("s_suppkey", F.col("s_nationkey").alias("nation"), "s_acctbal")
    c = table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("nation"), "c_acctbal")
    return rounded(joins.nearest(s, c, ["nation"], "s_acctbal", "c_acctbal", [F.asc("c_custkey")]).where("r_c_custkey is not null").select("s_suppkey", "r_c_custkey", "gap"))


@query("jn10_11_nearest_log", sql("SELECT c_custkey, arg_min(mass, {'g': round(abs(ln(mass) - ln(c_custkey)), 12), 'm': mass}) AS mass FROM customer, (SELECT DISTINCT mass FROM objects) GROUP BY c_custkey", MASSES))
def nearest_log(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").select("c_custkey", F.lit(1).alias("g"))
    m = masses(spark, sf).select("mass").distinct().withColumn("g", F.lit(1))
    return joins.nearest(c, m, ["g"], "c_custkey", "mass", [F.asc("mass")], log=True).select("c_custkey", F.col("r_mass").alias("mass"))


@query("jn12_within_range", sql("SELECT span, count(*) AS n FROM (SELECT p_partkey AS span, p_size AS lo, p_size + p_partkey % 4 AS hi FROM part) s JOIN part p ON p.p_size BETWEEN lo AND hi GROUP BY span", "one AS (SELECT 1)"))
def within(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").select("p_partkey", "p_size")
    s = p.select(F.col("p_partkey").alias("span"), F.col("p_size").alias("lo"), (F.col("p_size") + F.col("p_partkey") % 4).alias("hi"))
    return joins.count_within_range(p, s, [], "span", "p_size", "lo", "hi", 4.0)


FRONT = "SELECT p_partkey FROM part p WHERE NOT EXISTS (SELECT 1 FROM part o WHERE o.p_brand = p.p_brand AND o.p_size >= p.p_size AND o.p_retailprice >= p.p_retailprice AND (o.p_size > p.p_size OR o.p_retailprice > p.p_retailprice))"


@query("jn13_pareto_front", FRONT)
def front(spark: SparkSession, sf: str) -> DataFrame:
    return joins.pareto_front(table(spark, sf, "part").select("p_partkey", "p_brand", "p_size", "p_retailprice"), ["p_brand"], "p_partkey", ["p_size", "p_retailprice"]).select("p_partkey")


@query("so09_pareto_layers", f"""WITH f1 AS ({FRONT}), rest AS (SELECT * FROM part WHERE p_partkey NOT IN (SELECT p_partkey FROM f1))
SELECT p_partkey, 1 AS layer FROM f1 UNION ALL SELECT p_partkey, 2 AS layer FROM rest p WHERE NOT EXISTS (SELECT 1 FROM rest o WHERE o.p_brand = p.p_brand AND o.p_size >= p.p_size AND o.p_retailprice >= p.p_retailprice AND (o.p_size > p.p_size OR o.p_retailprice > p.p_retailprice))""")
def layers(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").select("p_partkey", "p_brand", "p_size", "p_retailprice")
    return joins.pareto_layers(p, ["p_brand"], "p_partkey", ["p_size", "p_retailprice"], 2).select("p_partkey", "layer")


KNN = """knn AS (SELECT sample, a, b, distance, rank FROM (SELECT p.sample, p.id AS a, q.id AS b, sqrt((p.x - q.x) ** 2 + (p.y - q.y) ** 2) AS distance,
  row_number() OVER (PARTITION BY p.id ORDER BY sqrt((p.x - q.x) ** 2 + (p.y - q.y) ** 2), q.id) AS rank FROM points p JOIN points q ON p.sample = q.sample AND p.id <> q.id) WHERE rank <= 6)"""


@query("jn14_nearest_neighbours", sql(f"SELECT sample, a, b, CAST(rank AS INTEGER) AS rank, {r6('distance')} AS distance FROM knn", POINTS, KNN))
def neighbours(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(joins.nearest_neighbours(points(spark, sf), ["sample"], "id", "x", "y", 6, 0.1).select("sample", "a", "b", "rank", "distance"))


@query("jn14_backbone", sql("SELECT cell_i, cell_j, bool_or(c) AS source_contact, bool_or(NOT c) AS source_knn FROM (SELECT least(k.a, k.b) AS cell_i, greatest(k.a, k.b) AS cell_j, false AS c FROM knn k JOIN s p ON p.id = k.a JOIN s q ON q.id = k.b WHERE k.distance <= 1.5 * greatest(p.d, q.d) UNION ALL SELECT id, id + 10, true FROM points WHERE id % 20 = 0 AND (id + 10) IN (SELECT id FROM points)) GROUP BY ALL", POINTS, KNN, "s AS (SELECT a AS id, distance AS d FROM knn WHERE rank = 3)"))
def backbone(spark: SparkSession, sf: str) -> DataFrame:
    p = points(spark, sf)
    there = p.select((F.col("id") - 10).alias("id"))
    con = p.where("id % 20 = 0").join(there, "id", "left_semi").select("sample", F.col("id").alias("cell_i"), (F.col("id") + 10).alias("cell_j"))
    b = joins.backbone(p, con, ["sample"], "id", "x", "y", 6, 3, 1.5, 0.1)
    return b.groupBy("cell_i", "cell_j").agg(F.bool_or("source_contact").alias("source_contact"), F.bool_or("source_knn").alias("source_knn"))


@query("jn15_radius_pairs", sql(f"SELECT p.id AS a, q.id AS b, {r6('sqrt((p.x - q.x) ** 2 + (p.y - q.y) ** 2)')} AS distance FROM points p JOIN points q ON p.sample = q.sample AND p.id < q.id WHERE sqrt((p.x - q.x) ** 2 + (p.y - q.y) ** 2) <= 0.05", POINTS))
def radius(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(joins.grid_pairs(points(spark, sf), ["sample"], "id", "x", "y", 0.05).select("a", "b", "distance"))


@query("jn17_matched_candidates", sql(f"SELECT c_custkey, match, rank, {r6('gap')} AS gap FROM (SELECT a.c_custkey, b.c_custkey AS match, abs(a.c_acctbal - b.c_acctbal) AS gap, row_number() OVER (PARTITION BY a.c_custkey ORDER BY abs(a.c_acctbal - b.c_acctbal), b.c_custkey) AS rank FROM customer a JOIN customer b ON a.c_nationkey = b.c_nationkey AND a.c_custkey <> b.c_custkey WHERE a.c_mktsegment = 'BUILDING' AND b.c_mktsegment <> 'BUILDING') WHERE rank <= 3", "one AS (SELECT 1)"))
def matched_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Customers of one market segment as cases, all others as controls."""
    c = table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")
    m = joins.matched_candidates(c.where("c_mktsegment = 'BUILDING'"), c.where("c_mktsegment <> 'BUILDING'"), ["c_nationkey"], "c_acctbal", "c_custkey", 3)
    return rounded(m.select("c_custkey", "match", F.col("rank").cast("long").alias("rank"), "gap"))


@query("jn19_assignment")
def assigned(spark: SparkSession, sf: str) -> DataFrame:
    p = points(spark, sf)
    a, b = p.where("id % 2 = 0"), p.where("id % 2 = 1").select("sample", F.col("id").alias("other"), F.col("x").alias("ox"), F.col("y").alias("oy"))
    cost = F.sqrt(F.pow(F.col("x") - F.col("ox"), 2) + F.pow(F.col("y") - F.col("oy"), 2))
    pairs = a.join(b, "sample").withColumn("cost", cost).where("cost <= 0.2").select("sample", "id", "other", "cost")
    return rounded(geometry.match_by_cost(pairs, "sample", "id", "other", "cost"))


@query("jn20_best_overlap", sql("SELECT p, arg_min(r, {'k': -n, 'r': r}) AS best, max(n) AS overlap, CAST(sum(n) AS BIGINT) AS size FROM (SELECT c_nationkey AS p, c_mktsegment AS r, count(*) AS n FROM customer GROUP BY ALL) GROUP BY p", "one AS (SELECT 1)"))
def overlap(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer")
    return joins.best_overlap(c.select("c_custkey", F.col("c_nationkey").alias("part")), c.select("c_custkey", F.col("c_mktsegment").alias("part")), "c_custkey", "part")


# --- selection and sets -----------------------------------------------------------------------------------------------


@query("so02_top_k", sql("SELECT c_nationkey, c_custkey, rank FROM (SELECT c_nationkey, c_custkey, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS INTEGER) AS rank FROM customer) WHERE rank <= 3", "one AS (SELECT 1)"))
def top_k(spark: SparkSession, sf: str) -> DataFrame:
    return selection.top_k(table(spark, sf, "customer").select("c_nationkey", "c_custkey", "c_acctbal"), ["c_nationkey"], [F.desc("c_acctbal"), F.asc("c_custkey")], 3).select("c_nationkey", "c_custkey", "rank")


@query("so03_top_fraction", sql("SELECT sample, id FROM (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY mass DESC, id) AS r, count(*) OVER (PARTITION BY sample) AS n FROM objects) WHERE r <= ceil(0.1 * n)", MASSES))
def top_fraction(spark: SparkSession, sf: str) -> DataFrame:
    return selection.top_fraction(masses(spark, sf), ["sample"], [F.desc("mass"), F.asc("id")], 0.1).select("sample", "id")


def routes_sql(cap: int) -> list[str]:
    """For each route the sequential greedy choice, and the scores that choose among them."""
    out = ["e AS (SELECT super_i, super_j, n_boundary_edges, coalesce(tension, 1e4) AS cost, shared::DOUBLE AS merit FROM super)"]
    for name, order in selection.ROUTES.items():
        by = ", ".join([*(f"{c} {'ASC' if up else 'DESC'}" for c, up in order), "super_i", "super_j"])
        taken = f"list_contains(used, e[k].i) OR list_contains(used, e[k].j) OR len(taken) = {cap}"
        out += [
            f"o_{name} AS (SELECT *, row_number() OVER (ORDER BY {by}) AS r FROM e)",
            f"s_{name} AS (SELECT list({{'r': r, 'i': super_i, 'j': super_j}} ORDER BY r) AS e FROM o_{name})",
            f"p_{name}(k, used, taken) AS (SELECT 1::BIGINT, []::BIGINT[], []::BIGINT[] UNION ALL SELECT k + 1, CASE WHEN {taken} THEN used ELSE list_concat(used, [e[k].i, e[k].j]) END, CASE WHEN {taken} THEN taken ELSE list_append(taken, k) END FROM p_{name}, s_{name} WHERE k <= len(e))",
            f"b_{name} AS (SELECT '{name}' AS route, o.* EXCLUDE (r) FROM o_{name} o WHERE list_contains((SELECT arg_max(taken, k) FROM p_{name}), r))",
        ]
    out.append("b AS (" + " UNION ALL ".join(f"SELECT * FROM b_{n}" for n in selection.ROUTES) + ")")
    out.append("best AS (SELECT route FROM (SELECT route, count(*) AS n, round(sum(cost), 12) AS s, max(cost) AS m, round(sum(merit), 12) AS q FROM b GROUP BY route) ORDER BY n DESC, s, m, q DESC, route LIMIT 1)")
    return out


@query("so05_06_batch_by_routes", sql(f"SELECT super_i, super_j, n_boundary_edges, {r6('cost')} AS cost, {r6('merit')} AS merit, route FROM b WHERE route = (SELECT route FROM best)", CONTACTS, LABELS, SUPER, *routes_sql(4)))
def routes(spark: SparkSession, sf: str) -> DataFrame:
    s = supers(spark, sf).select("super_i", "super_j", "n_boundary_edges", F.coalesce("tension", F.lit(1e4)).alias("cost"), F.col("shared").cast("double").alias("merit"))
    name, batch = selection.batch_by_routes(s, 4)
    return rounded(batch.withColumn("route", F.lit(name)))


@query("se01_union_sources", sql("SELECT k, bool_or(s = 'a') AS source_a, bool_or(s = 'b') AS source_b FROM (SELECT o_custkey AS k, 'a' AS s FROM orders UNION ALL SELECT c_custkey, 'b' FROM customer WHERE c_custkey % 3 = 0) GROUP BY k", "one AS (SELECT 1)"))
def union_sources(spark: SparkSession, sf: str) -> DataFrame:
    a = table(spark, sf, "orders").select(F.col("o_custkey").alias("k"))
    b = table(spark, sf, "customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("k"))
    return selection.union_with_sources({"a": a, "b": b}, ["k"])


AB = "a AS (SELECT DISTINCT o_custkey AS k FROM orders), b AS (SELECT DISTINCT c_custkey AS k FROM customer WHERE c_custkey % 3 = 0), c AS (SELECT (SELECT count(*) FROM a) AS na, (SELECT count(*) FROM b) AS nb, (SELECT count(*) FROM a JOIN b USING (k)) AS nx)"


@query("se02_05_jaccard", sql(f"SELECT na AS n_a, nb AS n_b, nx AS n_both, na + nb - nx AS n_union, {r6('nx / (na + nb - nx)')} AS jaccard FROM c", AB))
def jaccard(spark: SparkSession, sf: str) -> DataFrame:
    a = table(spark, sf, "orders").select(F.col("o_custkey").alias("k"))
    b = table(spark, sf, "customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("k"))
    return rounded(selection.jaccard(a, b, ["k"]))


@query("se03_detection_scores", sql(f"SELECT {r6('nx / na')} AS precision, {r6('nx / nb')} AS recall, {r6('2 * (nx / na) * (nx / nb) / (nx / na + nx / nb)')} AS f1, {r6('1 - nx / na')} AS new_burden, {r6('1 - nx / nb')} AS lost_fraction FROM c", AB))
def scores(spark: SparkSession, sf: str) -> DataFrame:
    a = table(spark, sf, "orders").select(F.col("o_custkey").alias("k"))
    b = table(spark, sf, "customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("k"))
    return rounded(selection.detection_scores(a, b, ["k"]))


# --- vectors -----------------------------------------------------------------------------------------------------------

REGISTRY = [(0, 1, "contact"), (2, 3, "contact"), (4, 5, "diffusible"), (6, 7, "diffusible")]
PAIRS = "pairs AS (SELECT a.id AS i, b.id AS j, a.state AS si, b.state AS sj FROM points a JOIN points b ON b.id = a.id + 1)"
REG = "reg AS (SELECT * FROM (VALUES (0, 0, 1, 'contact'), (1, 2, 3, 'contact'), (2, 4, 5, 'diffusible'), (3, 6, 7, 'diffusible')) v(channel, s, t, kind))"
FLUX = "flux AS (SELECT i, j, kind, sqrt(greatest(0, si[s + 1]) * greatest(0, sj[t + 1])) AS f, sqrt(greatest(0, sj[s + 1]) * greatest(0, si[t + 1])) AS b FROM pairs, reg)"


def state_pairs(spark: SparkSession, sf: str) -> DataFrame:
    p = points(spark, sf)
    return p.select(F.col("id").alias("i"), F.col("state").alias("state_i")).join(p.select((F.col("id") - 1).alias("i"), F.col("id").alias("j"), F.col("state").alias("state_j")), "i")


@query("vx01_metric_distance", sql(f"SELECT i, j, {r6('sqrt(greatest(0, list_sum(list_transform(range(1, 65), lambda k: (sj[k] - si[k]) ** 2)) * 1.5))')} AS distance FROM pairs", POINTS, PAIRS))
def metric_distance(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(vectors.metric_distance(state_pairs(spark, sf), "state_i", "state_j", np.eye(64), 0.5).select("i", "j", "distance"))


@query("vx02_cosine", sql(f"SELECT i, j, {r6('list_dot_product(si, sj) / (sqrt(list_dot_product(si, si)) * sqrt(list_dot_product(sj, sj)))')} AS cosine FROM pairs", POINTS, PAIRS))
def cosine(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(state_pairs(spark, sf).select("i", "j", X.cosine("state_i", "state_j").alias("cosine")))


@query("vx03_functional_prior", sql(f"SELECT i, j, {r6('w')} AS w, {r6('-w / sqrt(di * dj)')} AS laplacian FROM (SELECT w.i, w.j, w.w, a.d AS di, b.d AS dj FROM w JOIN d a ON a.i = w.i JOIN d b ON b.i = w.j) UNION ALL SELECT i, i, 0, 1 FROM d",
  "sets AS (SELECT DISTINCT l_linenumber % 2 AS layer, l_orderkey AS s, l_suppkey AS m FROM lineitem), sz AS (SELECT *, count(*) OVER (PARTITION BY layer, s) AS k FROM sets)",
  "l AS (SELECT a.layer, a.m AS i, b.m AS j, sum(1.0 / (a.k - 1)) AS w FROM sz a JOIN sz b ON a.layer = b.layer AND a.s = b.s AND a.m <> b.m GROUP BY ALL)",
  "md AS (SELECT layer, quantile_cont(d, 0.5) AS md FROM (SELECT layer, i, sum(w) AS d FROM l GROUP BY ALL) GROUP BY layer)",
  "w AS (SELECT i, j, sum(w / md) / (SELECT count(DISTINCT layer) FROM sets) AS w FROM l JOIN md USING (layer) GROUP BY ALL), d AS (SELECT i, sum(w) AS d FROM w GROUP BY i)"))
def prior(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "lineitem").select((F.col("l_linenumber") % 2).alias("layer"), F.col("l_orderkey").alias("set"), F.col("l_suppkey").alias("member"))
    return rounded(vectors.functional_prior(s))


@query("vx04_communication", sql(f"SELECT i, j, {r6('avg(f)')} AS comm_ij, {r6('avg(b)')} AS comm_ji, count(*) AS n_kinds, {r6('ln(1 + avg(f) + avg(b))')} AS comm_strength, {r6('greatest(0, least(1, 1 - abs(avg(f) - avg(b)) / (avg(f) + avg(b) + 1e-12)))')} AS comm_reciprocity FROM (SELECT i, j, kind, avg(f) AS f, avg(b) AS b FROM flux GROUP BY ALL) GROUP BY i, j", POINTS, PAIRS, REG, FLUX))
def communication(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(vectors.communication(vectors.channel_flux(state_pairs(spark, sf), REGISTRY), ["i", "j"]))


@query("vx05_channel_balance", sql(f"SELECT i, j, {r6('(sum(f) - sum(b)) / nullif(sum(f) + sum(b), 0)')} AS net_asymmetry, {r6('sum(abs(f - b)) / nullif(sum(f) + sum(b), 0)')} AS directional_content, {r6('1 - coalesce(abs(sum(f) - sum(b)) / nullif(sum(abs(f - b)), 0), 1)')} AS cancellation FROM flux GROUP BY i, j", POINTS, PAIRS, REG, FLUX))
def balance(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(vectors.channel_balance(vectors.channel_flux(state_pairs(spark, sf), REGISTRY), ["i", "j"]))


@query("vx07_node_covectors", sql(f"SELECT node, dim, {r6('coalesce(v / nullif(support, 0), 0)')} AS b FROM (SELECT node, dim, sum(v) AS v FROM e GROUP BY ALL) JOIN (SELECT node, sum(s) AS support FROM (SELECT i AS node, f + b AS s FROM fx UNION ALL SELECT j, f + b FROM fx) GROUP BY ALL) USING (node)", POINTS, PAIRS, REG,
  "fx AS (SELECT i, j, s, t, sqrt(greatest(0, si[s + 1]) * greatest(0, sj[t + 1])) AS f, sqrt(greatest(0, sj[s + 1]) * greatest(0, si[t + 1])) AS b FROM pairs, reg)",
  "e AS (SELECT i AS node, s AS dim, f - b AS v FROM fx UNION ALL SELECT i, t, b - f FROM fx UNION ALL SELECT j, s, b - f FROM fx UNION ALL SELECT j, t, f - b FROM fx)"))
def covectors(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(vectors.node_covectors(vectors.channel_flux(state_pairs(spark, sf), REGISTRY), REGISTRY, "i", "j"))


@query("vx06_complex_activity", sql(f"SELECT id, {r6('exp((ln(greatest(0, state[1]) + 1e-8) + ln(greatest(0, state[3]) + 1e-8)) / 2)')} AS activity FROM points", POINTS))
def activity(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(points(spark, sf).select("id", vectors.geometric_activity("state", [0, 2]).alias("activity")))


@query("vx12_pair_cost", sql(f"SELECT i, j, {r6('sqrt(list_sum(list_transform(range(1, 65), lambda k: (sj[k] - si[k]) ** 2))) + 0.5 * list_sum(list_transform(range(1, 65), lambda k: 0.01 * (si[k] - sj[k]) * (sj[k] - si[k])))')} AS pair_cost FROM pairs", POINTS, PAIRS))
def pair_cost(spark: SparkSession, sf: str) -> DataFrame:
    s = state_pairs(spark, sf).withColumns({f"b_{k}": F.transform(f"state_{k}", lambda v: v * 0.01) for k in "ij"})
    return rounded(vectors.pair_cost(s, np.eye(64), "state_i", "state_j", "b_i", "b_j").select("i", "j", "pair_cost"))


@query("vx09_11_dual_norms", sql(f"SELECT id, {r6('sqrt(list_dot_product(state, state) / 4)')} AS dual_norm, {r6('sqrt(list_dot_product(state, state) / 4) * 0.5 / max(sqrt(list_dot_product(state, state) / 4)) OVER ()')} AS scaled FROM points", POINTS))
def duals(spark: SparkSession, sf: str) -> DataFrame:
    d = vectors.dual_norms(points(spark, sf).select("id", "state"), 4 * np.eye(64), "state").select("id", "dual_norm")
    return rounded(d.withColumn("scaled", F.col("dual_norm") * vectors.scale_to(d, "dual_norm", 0.5)))


@query("vx14_transport_class", sql("SELECT i, j, CASE WHEN ni <= 1e-12 AND nj <= 1e-12 THEN 'IDENTITY' WHEN ni <= 1e-12 OR nj <= 1e-12 THEN 'ONE_SIDED' WHEN d / (ni * nj) <= -1 + 1e-9 THEN 'ANTIPODAL' ELSE 'ROTATION' END AS status FROM (SELECT i, j, sqrt(list_dot_product(si, si)) * (i % 3) AS ni, sqrt(list_dot_product(sj, sj)) * (j % 3) AS nj, list_dot_product(si, sj) * (i % 3) * (j % 3) AS d FROM pairs)", POINTS, PAIRS))
def transport(spark: SparkSession, sf: str) -> DataFrame:
    # Multiples of each state, so that zero states occur.
    s = state_pairs(spark, sf).withColumns({"q": F.transform("state_i", lambda v: v * (F.col("i") % 3)), "r": F.transform("state_j", lambda v: v * (F.col("j") % 3))})
    return s.select("i", "j", X.transport_class(X.dot("q", "r"), F.sqrt(X.dot("q", "q")), F.sqrt(X.dot("r", "r"))).alias("status"))


# Three least rotations around a loop of three turn its span by the spherical excess of the triangle of directions.
EXCESS = """unit AS (SELECT id, list_transform(state, lambda v: v / sqrt(list_dot_product(state, state))) AS q FROM points),
loop3 AS (SELECT u || ';' || v || ';' || w AS loop_id, list_dot_product(a.q, b.q) AS ab, list_dot_product(b.q, c.q) AS bc, list_dot_product(c.q, a.q) AS ca FROM (SELECT a.i AS u, a.j AS v, b.j AS w FROM mesh a JOIN mesh b ON b.i = a.j JOIN mesh c ON c.i = a.i AND c.j = b.j) t JOIN unit a ON a.id = u JOIN unit b ON b.id = v JOIN unit c ON c.id = w),
turn AS (SELECT loop_id, 2 * atan2(sqrt(greatest(0, 1 + 2 * ab * bc * ca - ab * ab - bc * bc - ca * ca)), 1 + ab + bc + ca) AS e FROM loop3),
angle AS (SELECT loop_id, CASE WHEN e > pi() THEN 2 * pi() - e ELSE e END AS t FROM turn)"""


@query("vx15_16_loop_holonomy", sql(f"SELECT loop_id, 'RESOLVED' AS status, 3 AS rank, {r6('sqrt(2.0 / 3) * t')} AS angle_rms, {r6('t')} AS angle_max, 0.0::DOUBLE AS orthogonality_error FROM angle", POINTS, MESH, EXCESS))
def holonomy(spark: SparkSession, sf: str) -> DataFrame:
    loops = mesh_graph(spark, sf)
    t = graph.triangles(loops).select(F.concat_ws(";", "u", "v", "w").alias("loop_id"), F.array("u", "v", "w").alias("nodes"))
    q = points(spark, sf).select(F.col("id").alias("node"), F.col("state").alias("q"))
    return rounded(vectors.loops_holonomy(t, q))


# --- graph ---------------------------------------------------------------------------------------------------------------


def mesh_graph(spark: SparkSession, sf: str) -> DataFrame:
    return mesh(spark, sf).select("i", "j")


def graph_nodes(spark: SparkSession, sf: str) -> DataFrame:
    return points(spark, sf).select(F.col("id").alias("node"))


BOTH = "both_ AS (SELECT i AS src, j AS dst, n FROM mesh UNION ALL SELECT j, i, n FROM mesh)"


@query("gr01_03_adjacency", sql("SELECT src, dst, CAST(sum(n) AS BIGINT) AS w FROM both_ GROUP BY ALL", POINTS, MESH, BOTH))
def adjacency(spark: SparkSession, sf: str) -> DataFrame:
    return graph.weighted_adjacency(mesh(spark, sf).select("i", "j", "n"), "n")


@query("gr02_unreciprocated", sql("SELECT i AS src, j AS dst FROM mesh WHERE (i + j) % 5 = 0", POINTS, MESH))
def unreciprocated(spark: SparkSession, sf: str) -> DataFrame:
    c = mesh_graph(spark, sf)
    there = c.select(F.col("i").alias("src"), F.col("j").alias("dst"))
    back = c.where("(i + j) % 5 <> 0").select(F.col("j").alias("src"), F.col("i").alias("dst"))
    return graph.unreciprocated(there.unionByName(back))


REACH = "reach(node, other) AS (SELECT id, id FROM points UNION SELECT r.node, b.dst FROM reach r JOIN both_ b ON b.src = r.other)"


@query("gr04_components", sql("SELECT node, min(other) AS component FROM reach GROUP BY node", POINTS, MESH, BOTH, REACH))
def components(spark: SparkSession, sf: str) -> DataFrame:
    return graph.components(mesh_graph(spark, sf), graph_nodes(spark, sf))


@query("gr05_topology", sql(f"SELECT (SELECT count(*) FROM points) AS nodes, {r6('(SELECT count(*) FROM both_) / (SELECT count(*) FROM points)')} AS mean_degree, {r6('(SELECT count(*) FROM points WHERE id NOT IN (SELECT src FROM both_)) / (SELECT count(*) FROM points)')} AS isolated_fraction, (SELECT max(c) FROM (SELECT count(*) AS c FROM both_ GROUP BY src)) AS max_degree, (SELECT count(*) FROM mesh) AS edges, (SELECT count(DISTINCT m) FROM cc) AS components, (SELECT count(*) FROM mesh) - (SELECT count(*) FROM points) + (SELECT count(DISTINCT m) FROM cc) AS cycle_rank", POINTS, MESH, BOTH, REACH, "cc AS (SELECT node, min(other) AS m FROM reach GROUP BY node)"))
def topology(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(graph.topology(mesh_graph(spark, sf), graph_nodes(spark, sf)))


P = "p AS (SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS p FROM (SELECT src, dst, n::DOUBLE AS w FROM both_ UNION ALL SELECT id, id, 1.0 FROM points))"
HOP = "(SELECT a.node, 0.65 * any_value(a.x) + 0.35 * sum(p.p * b.x) AS x FROM {0} a JOIN p ON p.src = a.node JOIN {0} b ON b.node = p.dst GROUP BY a.node)"


@query("gr06_diffuse", sql(f"SELECT node, {r6('x')} AS x FROM h2", POINTS, MESH, BOTH, P, "h0 AS (SELECT id AS node, round(x, 6) AS x FROM points)", "h1 AS " + HOP.format("h0"), "h2 AS " + HOP.format("h1")))
def diffuse(spark: SparkSession, sf: str) -> DataFrame:
    adj = graph.weighted_adjacency(mesh(spark, sf).select("i", "j", F.col("n").cast("double").alias("n")), "n")
    x = points(spark, sf).select(F.col("id").alias("node"), F.round("x", 6).alias("x"))
    return rounded(graph.diffuse(adj, x, ["x"], 2))


# Rounds of weighted means, far more than any value still moves in.
HARMONIC = """start_ AS (SELECT id AS node, CASE WHEN id % 4 = 0 THEN round(x, 6) END AS anchor FROM points),
rounds(k, node, anchor, v, hops) AS (
  SELECT 0, node, anchor, coalesce(anchor, 0.0), CASE WHEN anchor IS NOT NULL THEN 0 END FROM start_
  UNION ALL
  SELECT r.k + 1, r.node, any_value(r.anchor), coalesce(any_value(r.anchor), sum(b.n * o.v) / sum(b.n), any_value(r.v)), least(any_value(r.hops), min(CASE WHEN o.hops < 64 THEN o.hops + 1 END))
  FROM rounds r LEFT JOIN both_ b ON b.src = r.node LEFT JOIN rounds o ON o.node = b.dst WHERE r.k < 3000 GROUP BY r.k, r.node)"""


@query("gr07_harmonic_fill", sql(f"SELECT node, {r6('CASE WHEN hops IS NULL THEN 0.0 ELSE v END')} AS value, hops, {r6('CASE WHEN hops IS NOT NULL THEN exp(-hops / 8.0) ELSE 0.0 END')} AS confidence, true AS converged FROM rounds WHERE k = 3000", POINTS, MESH, BOTH, HARMONIC))
def harmonic(spark: SparkSession, sf: str) -> DataFrame:
    adj = graph.weighted_adjacency(mesh(spark, sf).select("i", "j", F.col("n").cast("double").alias("n")), "n")
    nodes = graph_nodes(spark, sf)
    anchors = points(spark, sf).where("id % 4 = 0").select(F.col("id").alias("node"), F.round("x", 6).alias("value"))
    return rounded(graph.harmonic_fill(adj, anchors, nodes))


TRI = "SELECT a.i AS u, a.j AS v, b.j AS w FROM mesh a JOIN mesh b ON b.i = a.j JOIN mesh c ON c.i = a.i AND c.j = b.j"


@query("gr08_triangles", sql(TRI, POINTS, MESH))
def triangles(spark: SparkSession, sf: str) -> DataFrame:
    return graph.triangles(mesh_graph(spark, sf))


@query("gr09_chordless_quads", sql("SELECT p.src AS a, p.dst AS b, q.dst AS c, s.dst AS d FROM both_ p JOIN both_ q ON q.src = p.dst JOIN both_ r ON r.src = q.dst JOIN both_ s ON s.src = p.src AND s.dst = r.dst WHERE p.src < p.dst AND p.src < q.dst AND p.src < s.dst AND p.dst < s.dst AND q.dst <> p.src AND NOT EXISTS (SELECT 1 FROM both_ t WHERE t.src = p.src AND t.dst = q.dst) AND NOT EXISTS (SELECT 1 FROM both_ t WHERE t.src = p.dst AND t.dst = s.dst)", POINTS, MESH, BOTH))
def quads(spark: SparkSession, sf: str) -> DataFrame:
    return graph.chordless_quads(mesh_graph(spark, sf))


@query("gr10_loop_status", sql(f"SELECT u || ';' || v || ';' || w AS loop_id, 3::BIGINT AS n_edges, CAST((e1 IS NOT NULL)::INT + (e2 IS NOT NULL)::INT + (e3 IS NOT NULL)::INT AS BIGINT) AS n_resolved, e1 IS NOT NULL AND e2 IS NOT NULL AND e3 IS NOT NULL AS fully_resolved FROM (SELECT t.*, x.tension AS e1, y.tension AS e2, z.tension AS e3 FROM ({TRI}) t JOIN mesh x ON x.i = u AND x.j = v JOIN mesh y ON y.i = v AND y.j = w JOIN mesh z ON z.i = u AND z.j = w)", POINTS, MESH))
def loops(spark: SparkSession, sf: str) -> DataFrame:
    m = mesh(spark, sf)
    t = graph.triangles(m.select("i", "j")).select(F.concat_ws(";", "u", "v", "w").alias("loop_id"), F.array("u", "v", "w").alias("nodes"))
    return graph.loop_status(t, m.select("i", "j", F.col("tension").isNotNull().alias("resolved")))


# Least costs over 1, 2, 4 to 64 arcs; on these graphs no least path is longer.
ARCS = "d0 AS (SELECT i AS s, j AS t, n::DOUBLE AS c FROM mesh UNION ALL SELECT j, i, n + 0.5 FROM mesh UNION ALL SELECT id, id, 0.0 FROM points)"
TWICE = [f"d{k + 1} AS (SELECT a.s, b.t, min(a.c + b.c) AS c FROM d{k} a JOIN d{k} b ON b.s = a.t GROUP BY ALL)" for k in range(6)]


@query("gr11_shortest_paths", sql(f"SELECT a.s AS source, a.t AS node, {r6('a.c')} AS cost, {r6('b.c')} AS back, {r6('abs(a.c - b.c) / (a.c + b.c)')} AS asymmetry FROM d6 a JOIN d6 b ON b.s = a.t AND b.t = a.s WHERE a.s < a.t", POINTS, MESH, ARCS, *TWICE))
def paths(spark: SparkSession, sf: str) -> DataFrame:
    c = mesh(spark, sf)
    d = c.select(F.col("i").alias("src"), F.col("j").alias("dst"), F.col("n").cast("double").alias("cost")).unionByName(c.select(F.col("j").alias("src"), F.col("i").alias("dst"), (F.col("n") + 0.5).alias("cost")))
    return rounded(graph.path_asymmetry(graph.shortest_paths(d, graph_nodes(spark, sf))))


@query("gr12_raster_adjacency", sql("SELECT least(a.label, b.label) AS i, greatest(a.label, b.label) AS j, count(*) AS length FROM px a JOIN px b ON (b.y = a.y AND b.x = a.x + 1) OR (b.x = a.x AND b.y = a.y + 1) WHERE a.label <> b.label GROUP BY ALL", "px AS (SELECT p_partkey // 40 AS y, p_partkey % 40 AS x, p_size // 10 AS label FROM part WHERE p_size // 10 <> 0)"))
def raster(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    px = table(spark, sf, "part").select(F.floor(k / 40).alias("y"), (k % 40).alias("x"), F.floor(F.col("p_size") / 10).cast("int").alias("label"))
    return graph.raster_adjacency(px)


# --- ledger, partitions, spectra ----------------------------------------------------------------------------------------

ROOTS = "climb(node, root) AS (SELECT removed, survivor FROM ledger UNION SELECT c.node, l.survivor FROM climb c JOIN ledger l ON l.removed = c.root), ends_ AS (SELECT node, min(root) AS root FROM climb GROUP BY node), replayed AS (SELECT c_custkey AS cell, coalesce(root, c_custkey) AS node FROM customer LEFT JOIN ends_ ON node = c_custkey)"


def start(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("cell"), F.col("c_custkey").alias("node"))


@query("hi15_ledger_replay", sql("SELECT cell, node FROM replayed", MERGES, ROOTS))
def replayed(spark: SparkSession, sf: str) -> DataFrame:
    return hierarchy.replay(start(spark, sf), merges(spark, sf))


@query("hi16_order_parameter", sql(f"SELECT 13 AS microstep, {r6('max(n) / (SELECT count(*) FROM customer)')} AS phi, count(*) AS nodes FROM (SELECT node, count(*) AS n FROM replayed GROUP BY node)", MERGES, ROOTS))
def phi(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(hierarchy.order_parameter(merges(spark, sf), start(spark, sf), [13]).drop("delta_phi"))


@query("hi13_lineage", sql("SELECT microstep, survivor || '@' || microstep AS parent_token, survivor AS child, 'retained' AS child_role FROM ledger UNION ALL SELECT microstep, survivor || '@' || microstep, removed, 'absorbed' FROM ledger", MERGES))
def lineage(spark: SparkSession, sf: str) -> DataFrame:
    return hierarchy.lineage(merges(spark, sf), start(spark, sf).select("node", F.lit(1).alias("mass"))).select("microstep", "parent_token", "child", "child_role")


@query("hi17_nesting", sql("SELECT node AS fine, count(DISTINCT region) AS coarse_parts, count(*) AS cells FROM cells GROUP BY node", LABELS))
def nesting(spark: SparkSession, sf: str) -> DataFrame:
    c = cells(spark, sf)
    return partitions.nesting(c.select("cell", "node"), c.select("cell", F.col("region").alias("node")))


AGREE = "t AS (SELECT o_orderstatus AS a, o_orderpriority AS b, count(*) AS n FROM orders GROUP BY ALL), m AS (SELECT *, sum(n) OVER (PARTITION BY a) AS na, sum(n) OVER (PARTITION BY b) AS nb, sum(n) OVER () AS tot FROM t)"


@query("hi18_ts13_agreement", sql(f"SELECT {r6('sum(n / tot * (log2(na / n) + log2(nb / n)))')} AS vi_bits, {r6('(any_value(tot * (tot - 1) / 2) - (SELECT sum(s * (s - 1) / 2) FROM (SELECT sum(n) AS s FROM t GROUP BY a)) - (SELECT sum(s * (s - 1) / 2) FROM (SELECT sum(n) AS s FROM t GROUP BY b)) + 2 * sum(n * (n - 1) / 2)) / any_value(tot * (tot - 1) / 2)')} AS pair_agreement, {r6('(SELECT avg(j) FROM (SELECT max(n / (na + nb - n)) AS j FROM m GROUP BY a))')} AS mean_best_jaccard FROM m", AGREE))
def agreement(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").withColumnRenamed("o_orderkey", "cell")
    return rounded(partitions.agreement(o.select("cell", F.col("o_orderstatus").alias("node")), o.select("cell", F.col("o_orderpriority").alias("node"))))


@query("hi19_transitions", sql(f"SELECT region AS parent, count(*) AS children, CAST(sum(n) AS BIGINT) AS mass, {r6('max(n) / sum(n)')} AS largest_share FROM (SELECT node, region, count(*) AS n FROM cells GROUP BY ALL) GROUP BY region HAVING count(*) >= 2", LABELS))
def transitions(spark: SparkSession, sf: str) -> DataFrame:
    c = cells(spark, sf)
    return rounded(partitions.transitions(c.select("cell", "node"), c.select("cell", F.col("region").alias("node"))))


@query("ts09_mass_function", sql(f"SELECT sample, mass, count(*) AS count, {r6('count(*) / sum(count(*)) OVER (PARTITION BY sample)')} AS pmf FROM objects WHERE mass >= 2 GROUP BY sample, mass", MASSES))
def pmf(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(partitions.mass_function(masses(spark, sf), ["sample"], "mass"))


@query("hi20_log_bins", sql(f"SELECT sample, bin, count(*) AS count, {r6('count(*) / (pow(10, (bin + 1) / 5) - pow(10, bin / 5)) / sum(count(*)) OVER (PARTITION BY sample)')} AS density FROM (SELECT sample, CAST(floor(log10(mass) * 5 + 1e-9) AS INTEGER) AS bin FROM objects) GROUP BY sample, bin", MASSES))
def log_bins(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(partitions.log_bins(masses(spark, sf), ["sample"], "mass"))


@query("hi20_survival", sql(f"SELECT sample, mass, {r6('sum(n) OVER (PARTITION BY sample ORDER BY mass DESC) / sum(n) OVER (PARTITION BY sample)')} AS ccdf FROM (SELECT sample, mass, count(*) AS n FROM objects GROUP BY ALL)", MASSES))
def survival(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(partitions.survival(masses(spark, sf), ["sample"], "mass"))


@query("hi20_lorenz", sql(f"SELECT sample, mass, id, row_number() OVER (PARTITION BY sample ORDER BY mass, id) AS rank, {r6('row_number() OVER (PARTITION BY sample ORDER BY mass, id) / count(*) OVER (PARTITION BY sample)')} AS object_share, {r6('sum(mass) OVER (PARTITION BY sample ORDER BY mass, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / sum(mass) OVER (PARTITION BY sample)')} AS mass_share FROM objects", MASSES))
def lorenz(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(partitions.lorenz(masses(spark, sf), ["sample"], "mass", ["id"]).withColumn("rank", F.col("rank").cast("long")))


@query("hi20_log_slope", sql(f"SELECT sample, count(*) AS n, {r6('regr_slope(ln(c), ln(mass))')} AS slope, {r6('regr_intercept(ln(c), ln(mass))')} AS intercept, {r6('regr_r2(ln(c), ln(mass))')} AS r2 FROM (SELECT sample, mass, count(*) AS c FROM objects GROUP BY ALL) GROUP BY sample", MASSES))
def log_slope(spark: SparkSession, sf: str) -> DataFrame:
    counts = masses(spark, sf).groupBy("sample", "mass").agg(F.count("*").alias("c"))
    return rounded(partitions.log_slope(counts, ["sample"], "mass", "c"))


# --- statistics -------------------------------------------------------------------------------------------------------------


@query("ts01_correlations", sql(f"SELECT l_returnflag, count(*) AS n, {r6('corr(l_quantity, l_extendedprice)')} AS pearson, {r6('corr(rx, ry)')} AS spearman FROM (SELECT *, rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2 AS rx, rank() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_returnflag, l_extendedprice) - 1) / 2 AS ry FROM lineitem) GROUP BY l_returnflag", "one AS (SELECT 1)"))
def correlations(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(statistics.correlations(table(spark, sf, "lineitem"), ["l_returnflag"], "l_quantity", "l_extendedprice"))


# A resampled median's quantiles are values whose ranks follow from a binomial law: at least h of n draws among the first k.
BINOMIAL = """gains AS (SELECT c_mktsegment AS g, CAST(c_acctbal - 4000 AS DOUBLE) AS v FROM customer),
sorted_ AS (SELECT g, v, row_number() OVER (PARTITION BY g ORDER BY v) AS r, count(*) OVER (PARTITION BY g) AS n FROM gains WHERE v IS NOT NULL),
middles AS (SELECT DISTINCT g, n, unnest([(n + 1) // 2, n // 2 + 1]) AS h FROM sorted_),
chance AS (SELECT m.g, m.n, m.h, k, CASE WHEN k = m.n THEN 1.0 ELSE list_sum(list_transform(range(m.h, m.n + 1), lambda i: exp(lgamma(m.n + 1) - lgamma(i + 1) - lgamma(m.n - i + 1) + i * ln(k / m.n) + (m.n - i) * ln(1 - k / m.n)))) END AS c
  FROM (SELECT *, unnest(range(1, n + 1)) AS k FROM middles) m),
ends_ AS (SELECT g, h, min(k) FILTER (c >= 0.025) AS low, min(k) FILTER (c >= 0.975) AS high FROM chance GROUP BY g, h)"""


@query("ts02_bootstrap", sql(f"SELECT e.g AS c_mktsegment, any_value(m.n) AS n, {r6('avg(m.v)')} AS median, {r6('avg(l.v)')} AS low, {r6('avg(u.v)')} AS high FROM (SELECT g, unnest([(n + 1) // 2, n // 2 + 1]) AS h FROM (SELECT DISTINCT g, n FROM sorted_)) e JOIN ends_ USING (g, h) JOIN sorted_ m ON m.g = e.g AND m.r = e.h JOIN sorted_ l ON l.g = e.g AND l.r = low JOIN sorted_ u ON u.g = e.g AND u.r = high GROUP BY e.g", BINOMIAL))
def bootstrap(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").withColumn("gain", F.col("c_acctbal") - 4000)
    return rounded(statistics.bootstrap_interval(c, ["c_mktsegment"], "gain"))


@query("ts05_calibration", sql(f"SELECT bin, count(*) AS n, {r6('avg(l_discount)')} AS mean_predicted, {r6('avg(l_tax)')} AS mean_observed FROM (SELECT l_discount, l_tax, CAST(len(list_filter(e, lambda v: v < l_discount)) AS INTEGER) AS bin FROM lineitem, (SELECT list_distinct([quantile_cont(l_discount, 0.2), quantile_cont(l_discount, 0.4), quantile_cont(l_discount, 0.6), quantile_cont(l_discount, 0.8)]) AS e FROM lineitem)) GROUP BY bin HAVING count(*) >= 20", "one AS (SELECT 1)"))
def calibration(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(statistics.calibration_curve(table(spark, sf, "lineitem"), "l_discount", "l_tax", 5))


@query("ts06_importance", sql(f"SELECT o_orderstatus, o_orderpriority, {r6('m')} AS mean, {r6('x')} AS max_abs, CAST(row_number() OVER (PARTITION BY o_orderstatus ORDER BY abs(m) DESC, o_orderpriority) AS INTEGER) AS rank FROM (SELECT o_orderstatus, o_orderpriority, avg(o_totalprice) AS m, max(abs(o_totalprice)) AS x FROM orders GROUP BY ALL)", "one AS (SELECT 1)"))
def importance(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(statistics.importance_ranking(table(spark, sf, "orders"), ["o_orderstatus"], "o_orderpriority", "o_totalprice"))


@query("ts11_grid_share", sql(f"SELECT gx, gy, n, {r6('share')} AS share FROM (SELECT least(9, floor((x - x0) * 10 / (x1 - x0))) AS gx, least(9, floor((y - y0) * 10 / (y1 - y0))) AS gy, count(*) AS n, avg(CASE WHEN sample < 5 THEN 1.0 ELSE 0.0 END) AS share FROM points, (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM points) GROUP BY ALL) WHERE n >= 3", POINTS))
def grid_share(spark: SparkSession, sf: str) -> DataFrame:
    p = points(spark, sf).withColumn("flag", F.col("sample") < 5)
    g = statistics.grid_share(p, "x", "y", "flag", 10, 3)
    return rounded(g.withColumns({"gx": F.col("gx").cast("double"), "gy": F.col("gy").cast("double")}))


# --- geometry and mechanics ---------------------------------------------------------------------------------------------------


@query("ge01_outlines", sql(f"SELECT sample, {r6('abs(list_sum(list_transform(range(1, len(v) + 1), lambda k: v[k].x * v[k % len(v) + 1].y - v[k % len(v) + 1].x * v[k].y))) / 2')} AS area, {r6('list_sum(list_transform(range(1, len(v) + 1), lambda k: sqrt((v[k].x - v[k % len(v) + 1].x) ** 2 + (v[k].y - v[k % len(v) + 1].y) ** 2)))')} AS perimeter FROM (SELECT sample, list({{'x': x, 'y': y}} ORDER BY id) AS v FROM points GROUP BY sample)", POINTS))
def outlines(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(geometry.outlines(points(spark, sf), "sample", "id").select("sample", "area", "perimeter"))


MOMENTS = """m AS (SELECT sample, avg(x) AS mx, avg(y) AS my, count(*) AS n FROM points GROUP BY sample),
c AS (SELECT p.sample, any_value(mx) AS mx, any_value(my) AS my, any_value(n) AS n, sum((x - mx) ** 2) AS uu, sum((y - my) ** 2) AS vv, sum((x - mx) * (y - my)) AS uv, sum((x - mx) * ((x - mx) ** 2 + (y - my) ** 2)) AS uz, sum((y - my) * ((x - mx) ** 2 + (y - my) ** 2)) AS vz FROM points p JOIN m USING (sample) GROUP BY p.sample),
f AS (SELECT *, (uz * vv - vz * uv) / (2 * (uu * vv - uv * uv)) AS a, (vz * uu - uz * uv) / (2 * (uu * vv - uv * uv)) AS b FROM c)"""


@query("ge04_circle_fit", sql(f"SELECT sample, n, {r6('a + mx')} AS cx, {r6('b + my')} AS cy, {r6('sqrt(a * a + b * b + (uu + vv) / n)')} AS radius, {r6('1 / sqrt(a * a + b * b + (uu + vv) / n)')} AS curvature FROM f", POINTS, MOMENTS))
def circles(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(geometry.circle_fit(points(spark, sf), ["sample"]))


STRESS = "s AS (SELECT s_suppkey AS cell, (a / 10 - 1) AS sxx, (b / 10 - 1) AS syy, c / 10 AS sxy FROM supplier JOIN (SELECT l_suppkey AS k, sum(l_discount * l_quantity * 0.64) AS a, sum(l_discount * l_quantity * 0.36) AS b, sum(l_discount * l_quantity * 0.48) AS c FROM lineitem GROUP BY ALL) ON k = s_suppkey)"


@query("me04_stress", sql(f"SELECT cell, {r6('sxx')} AS sxx, {r6('syy')} AS syy, {r6('sxy')} AS sxy, {r6('(sxx + syy) / 2 + sqrt(pow((sxx - syy) / 2, 2) + sxy * sxy)')} AS s1, {r6('(sxx + syy) / 2 - sqrt(pow((sxx - syy) / 2, 2) + sxy * sxy)')} AS s2 FROM s", STRESS))
def stress(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("cell"), F.col("l_discount").alias("tension"), F.col("l_quantity").alias("length"), F.lit(0.8).alias("tx"), F.lit(0.6).alias("ty"))
    c = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("cell"), F.lit(1.0).alias("pressure"), F.lit(10.0).alias("area")).join(li.select("cell").distinct(), "cell", "left_semi")
    return rounded(geometry.stress(c, li).select("cell", "sxx", "syy", "sxy", "s1", "s2"))


@query("me02_force_rows", sql("SELECT p * 2 AS row, e AS \"column\", 0.6 AS value FROM x UNION ALL SELECT p * 2 + 1, e, 0.8 FROM x UNION ALL SELECT q * 2, e, -0.6 FROM x UNION ALL SELECT q * 2 + 1, e, -0.8 FROM x", CONTACTS, "x AS (SELECT i AS p, j AS q, i * 100000 + j AS e FROM contacts)"))
def forces(spark: SparkSession, sf: str) -> DataFrame:
    e = contacts(spark, sf).select((F.col("i") * 100000 + F.col("j")).alias("edge"), "i", "j", F.lit(0.6).alias("tx"), F.lit(0.8).alias("ty"))
    return geometry.force_rows(e, "i", "j")


# --- audits ---------------------------------------------------------------------------------------------------------------------


@query("au01_interface_flags", sql("SELECT i, j, (CASE WHEN n IS NOT NULL THEN 1 ELSE 0 END) + (CASE WHEN tension IS NOT NULL THEN 2 ELSE 0 END) + (CASE WHEN pressure IS NOT NULL THEN 4 ELSE 0 END) + 16 AS flags FROM contacts", CONTACTS))
def flags(spark: SparkSession, sf: str) -> DataFrame:
    c = contacts(spark, sf)
    return c.select("i", "j", audits.flags(geometry=F.col("n").isNotNull(), tension=F.col("tension").isNotNull(), pressure=F.col("pressure").isNotNull(), cell_cell=F.lit(True)).alias("flags"))


@query("au02_dangling", sql("SELECT c AS \"column\", v AS value, count(*) AS n FROM (SELECT 'l_partkey' AS c, l_partkey AS v FROM lineitem UNION ALL SELECT 'l_suppkey', l_suppkey FROM lineitem) WHERE v NOT IN (SELECT s_suppkey FROM supplier) GROUP BY ALL", "one AS (SELECT 1)"))
def dangling(spark: SparkSession, sf: str) -> DataFrame:
    return audits.dangling(table(spark, sf, "lineitem"), ["l_partkey", "l_suppkey"], table(spark, sf, "supplier"), "s_suppkey")


@query("au03_level0_audit", sql("SELECT 0::BIGINT AS duplicate_cells, 0::BIGINT AS duplicate_columns, (SELECT count(*) FROM customer WHERE c_custkey % 2 = 1) AS cells_only, 0::BIGINT AS matrix_only, 0::BIGINT AS moved, false AS same_set, false AS same_order", "one AS (SELECT 1)"))
def level0(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.col("c_custkey").alias("position"))
    return audits.level0_audit(c, c.where("k % 2 = 0"), "k")


@query("au04_batch_faults", sql("SELECT 0::BIGINT AS repeated_ends, 0::BIGINT AS node_drop_error, 0::BIGINT AS untouched_changed, 0::BIGINT AS lost_cells", "one AS (SELECT 1)"))
def faults(spark: SparkSession, sf: str) -> DataFrame:
    m = merges(spark, sf).where("microstep = 1").select(F.col("survivor").alias("super_i"), F.col("removed").alias("super_j"))
    before = start(spark, sf)
    return hierarchy.batch_faults(before, hierarchy.contract(before, m), m)


STEPS = "steps AS (SELECT microstep AS step, m AS merges, (SELECT count(*) FROM customer) - c + m AS nodes_before, (SELECT count(*) FROM customer) - c AS nodes_after, c FROM (SELECT microstep, count(*) AS m, CAST(sum(count(*)) OVER (ORDER BY microstep) AS BIGINT) AS c FROM ledger GROUP BY microstep))"


def flow_steps(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "customer").count()
    s = merges(spark, sf).groupBy(F.col("microstep").alias("step")).agg(F.count("*").alias("merges"))
    after = F.lit(n) - F.sum("merges").over(selection.Window.orderBy("step"))
    return s.withColumns({"nodes_after": after, "sample": F.lit("all")}).withColumn("nodes_before", F.col("nodes_after") + F.col("merges"))


@query("au05_ledger_audit", sql(f"SELECT step, merges, c AS cumulative, {r6('c / (SELECT count(*) FROM customer)')} AS u, true AS continuous FROM steps", MERGES, STEPS))
def ledger_audit(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "customer").count()
    return rounded(hierarchy.ledger_audit(flow_steps(spark, sf), n).select("step", "merges", "cumulative", "u", "continuous"))


@query("ag33_construction", sql(f"SELECT 'all' AS sample, max(nodes_before) AS level0, min(nodes_after) AS final, CAST(sum(merges) AS BIGINT) AS merges, count(*) AS microsteps, {r6('sum(merges) / max(nodes_before)')} AS removed_fraction, 0::BIGINT AS accounting_residual FROM steps", MERGES, STEPS))
def construction(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(audits.construction(flow_steps(spark, sf), ["sample"], "step"))


@query("au09_exhaustion", sql("SELECT 'all' AS sample, max(step) AS last_step, 5 AS superedges, 0 AS merge_allowed, true AS exhausted FROM steps", MERGES, STEPS))
def exhaustion(spark: SparkSession, sf: str) -> DataFrame:
    s = flow_steps(spark, sf).withColumns({"superedges": F.lit(5), "merge_allowed": F.when(F.col("step") == 13, 0).otherwise(3)})
    return audits.exhaustion(s, ["sample"], "step")


@query("au08_missing_pattern", sql("SELECT CASE (tension IS NOT NULL)::INT + (pressure IS NOT NULL)::INT WHEN 2 THEN 'complete' WHEN 0 THEN 'missing' ELSE 'partial' END AS pattern, count(*) AS rows FROM contacts GROUP BY ALL", CONTACTS))
def missing(spark: SparkSession, sf: str) -> DataFrame:
    return audits.missing_pattern(contacts(spark, sf), ["tension", "pressure"])


@query("au06_scale_consistency", sql(f"SELECT sample, {r6('e')} AS extent, {r6('e / q')} AS ratio, CASE WHEN e / q BETWEEN 0.05 AND 20 THEN 'PASS' ELSE 'WARN' END AS status FROM (SELECT *, quantile_cont(e, 0.5) OVER () AS q FROM (SELECT sample, greatest(max(x) - min(x), max(y) - min(y)) AS e FROM points GROUP BY sample))", POINTS))
def consistency(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(audits.scale_consistency(points(spark, sf), ["sample"], "x", "y"))


@query("ag34_shape_contract", sql("SELECT sample, count(*) AS rows, count(DISTINCT id) AS cases, CASE WHEN count(*) = 50 AND count(DISTINCT id) = 50 THEN 'PASS' WHEN count(DISTINCT id) = 50 THEN 'WARN' ELSE 'FAIL' END AS status FROM points GROUP BY sample", POINTS))
def contract(spark: SparkSession, sf: str) -> DataFrame:
    return audits.shape_contract(points(spark, sf), ["sample"], "id", 50, 50)


@query("jn03_exact_copy", sql("SELECT count(*) AS rows, count(*) FILTER (WHERE c_custkey % 10 = 0) AS differences FROM customer", "one AS (SELECT 1)"))
def exact_copy(spark: SparkSession, sf: str) -> DataFrame:
    a = table(spark, sf, "customer").select("c_custkey", F.col("c_acctbal").alias("v"))
    return audits.exact_copy(a, a.withColumn("v", F.when(F.col("c_custkey") % 10 == 0, F.col("v") + 1e-6).otherwise(F.col("v"))), "c_custkey", "v")


# Sums of hexadecimal pieces of the row digests.
@query("snk06_table_digest", """SELECT count(*) AS rows, sha256(concat_ws('-', count(*), sum(('0x' || substr(d, 1, 15))::HUGEINT) % 1152921504606846976, sum(('0x' || substr(d, 16, 15))::HUGEINT) % 1152921504606846976, sum(('0x' || substr(d, 31, 15))::HUGEINT) % 1152921504606846976, sum(('0x' || substr(d, 46, 15))::HUGEINT) % 1152921504606846976)) AS digest
  FROM (SELECT sha256(concat_ws(chr(31), coalesce(c_acctbal::VARCHAR, chr(0)), coalesce(c_custkey::VARCHAR, chr(0)), coalesce(c_mktsegment, chr(0)), coalesce(c_name, chr(0)), coalesce(c_nationkey::VARCHAR, chr(0)))) AS d FROM customer)""")
def digest(spark: SparkSession, sf: str) -> DataFrame:
    return table_digest(table(spark, sf, "customer"))
