"""Queries of operators that no other query runs: column choice, region growing, raster pieces, rankings, whitening, flags."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cambium.functions import scalars as X
from cambium.operators import aggregates as A
from cambium.operators import filters, graph, hierarchy, statistics, vectors
from cambium.plans.bindings import MESH, POINTS, mesh, points
from cambium.plans.flow_queries import laplacian
from cambium.plans.registry import query
from cambium.plans.series_queries import r6, rounded
from cambium.plans.table_queries import sql
from cambium.sources.tables import table

ONE = "one AS (SELECT 1)"


@query("prj04_choose_columns", sql("SELECT c AS \"column\" FROM (SELECT unnest(['tension', 'pressure', 'n', 'same']) AS c, unnest([avg((tension IS NOT NULL)::INT), avg((pressure IS NOT NULL)::INT), 1.0, 1.0]) AS f, unnest([stddev_pop(tension), stddev_pop(pressure), stddev_pop(n), 0.0]) AS s FROM mesh) WHERE f >= 0.7 AND s > 0", POINTS, MESH))
def choose(spark: SparkSession, sf: str) -> DataFrame:
    """Columns of the mesh that are mostly there and vary."""
    names = filters.choose_columns(mesh(spark, sf).withColumn("same", F.lit(1.0)), ["tension", "pressure", "n", "same"], 0.7)
    return spark.createDataFrame([(n,) for n in names], "column string")


@query("prj05_by_prefix", "SELECT o_orderkey, 'mol_price' AS \"column\", round(o_totalprice, 6) AS value, 'molecular' AS block FROM orders UNION ALL SELECT o_orderkey, 'mol_net_year', year(o_orderdate)::DOUBLE, 'network' FROM orders UNION ALL SELECT o_orderkey, 'geo_customer', o_custkey::DOUBLE, 'geometry' FROM orders")
def prefixes(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_totalprice").alias("mol_price"), F.year("o_orderdate").alias("mol_net_year"), F.col("o_custkey").alias("geo_customer"), "o_orderstatus")
    return rounded(filters.by_prefix(o, ["o_orderkey"], {"mol_": "molecular", "geo_": "geometry", "mol_net_": "network"}))


@query("sc07_completed_cost", sql(f"SELECT i, j, {r6('coalesce(t / ts, 0) + 0.5 * coalesce(p / ps, 0)')} AS cost FROM (SELECT i, j, abs(tension) AS t, abs(pressure) AS p FROM mesh), (SELECT (quantile_cont(abs(tension), 0.75) - quantile_cont(abs(tension), 0.25)) / 1.349 AS ts, (quantile_cont(abs(pressure), 0.75) - quantile_cont(abs(pressure), 0.25)) / 1.349 AS ps FROM mesh)", POINTS, MESH))
def completed(spark: SparkSession, sf: str) -> DataFrame:
    m = mesh(spark, sf).select("i", "j", F.abs("tension").alias("t"), F.abs("pressure").alias("p"))
    return rounded(hierarchy.completed_cost(m, {"t": 1.0, "p": 0.5}).select("i", "j", "cost"))


RASTER = """px AS (SELECT p_partkey // 40 AS y, p_partkey % 40 AS x, p_size // 10 AS label, p_partkey AS node FROM part WHERE p_size // 10 <> 0),
side AS (SELECT a.node AS a, b.node AS b FROM px a JOIN px b ON a.label = b.label AND abs(a.y - b.y) + abs(a.x - b.x) = 1),
reach(node, other) AS (SELECT node, node FROM px UNION SELECT r.node, s.b FROM reach r JOIN side s ON s.a = r.other)"""


@query("gr17_label_pieces", sql("SELECT label, count(DISTINCT c) AS pieces, count(*) AS pixels FROM px JOIN (SELECT node, min(other) AS c FROM reach GROUP BY node) USING (node) GROUP BY label", RASTER))
def pieces(spark: SparkSession, sf: str) -> DataFrame:
    """Connected pieces of each label of a raster of all parts."""
    k = F.col("p_partkey")
    return graph.label_pieces(table(spark, sf, "part").select(F.floor(k / 40).alias("y"), (k % 40).alias("x"), F.floor(F.col("p_size") / 10).alias("label")))


@query("gr15_grow_region")
def region(spark: SparkSession, sf: str) -> DataFrame:
    """A connected half of the mesh's largest component, round by round."""
    p = points(spark, sf).select(F.col("id").alias("node"), "x", "y")
    return graph.grow_region(mesh(spark, sf).select("i", "j"), p, max(1, p.count() // 20))


TRAJECTORY = """g AS (SELECT l_returnflag, l_suppkey, max(l_quantity) - min(l_quantity) AS spread, avg(l_quantity) FILTER (u < 1 / 3::DOUBLE) AS early, avg(l_quantity) FILTER (u >= 1 / 3::DOUBLE AND u < 2 / 3::DOUBLE) AS middle, avg(l_quantity) FILTER (u >= 2 / 3::DOUBLE) AS late
  FROM (SELECT *, (l_linenumber - 1) / 7::DOUBLE AS u FROM lineitem) GROUP BY ALL)"""


@query("ts07_trajectory_ranking", sql(f"SELECT l_returnflag, l_suppkey, {r6('spread')} AS spread, {r6('early')} AS early, {r6('middle')} AS middle, {r6('late')} AS late, {r6('abs(late - early)')} AS change, {r6('cume_dist() OVER (PARTITION BY l_returnflag ORDER BY spread NULLS FIRST) + cume_dist() OVER (PARTITION BY l_returnflag ORDER BY round(abs(late - early), 9) NULLS FIRST)')} AS score FROM g", TRAJECTORY))
def trajectories(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem").withColumn("u", (F.col("l_linenumber") - 1) / F.lit(7.0))
    return rounded(statistics.trajectory_ranking(li, ["l_returnflag"], "l_suppkey", "u", "l_quantity"))


@query("ts12_smooth_grid", sql(f"SELECT a.gx, a.gy, {r6('avg(b.share)')} AS share FROM cell a JOIN cell b ON abs(a.gx - b.gx) <= 1 AND abs(a.gy - b.gy) <= 1 GROUP BY ALL", POINTS, """ext AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM points),
cell AS (SELECT CAST(least(9, floor((x - x0) * 10 / (x1 - x0))) AS BIGINT) AS gx, CAST(least(9, floor((y - y0) * 10 / (y1 - y0))) AS BIGINT) AS gy, avg((id % 3 = 0)::INT) AS share FROM points, ext GROUP BY ALL)"""))  # fmt: skip
def smoothed(spark: SparkSession, sf: str) -> DataFrame:
    g = statistics.grid_share(points(spark, sf).withColumn("flag", F.col("id") % 3 == 0), "x", "y", "flag", 10, 1)
    return rounded(statistics.smooth_grid(g, "share").select(F.col("gx").cast("long").alias("gx"), F.col("gy").cast("long").alias("gy"), "share"))


@query("vx08_13_whitened", sql(f"SELECT id AS node, d - 1 AS dim, {r6('CASE WHEN d = 65 THEN x / sqrt(2) WHEN d = 66 THEN y / sqrt(3) WHEN d % 2 = 1 THEN (state[d] + state[d + 1]) / 2 + (state[d] - state[d + 1]) / 2 / sqrt(2) ELSE (state[d - 1] + state[d]) / 2 - (state[d - 1] - state[d]) / 2 / sqrt(2) END')} AS q FROM points, range(1, 67) t(d)", POINTS))
def whitened(spark: SparkSession, sf: str) -> DataFrame:
    """States and two mechanics by the inverse root of a block metric."""
    p = points(spark, sf).select(F.col("id").alias("node"), F.concat("state", F.array("x", "y")).alias("b"))
    w = vectors.whitened(p, vectors.block_metric(laplacian(), 0.5, 2.0, 3.0), "b")
    return rounded(w.select("node", F.posexplode("q").alias("dim", "q")).select("node", F.col("dim").cast("long").alias("dim"), "q"))


@query("sc18_tail_flags", sql("SELECT l_orderkey, l_linenumber FROM lineitem JOIN (SELECT l_returnflag AS m, greatest(quantile_cont(l_extendedprice, 0.999), quantile_cont(l_extendedprice, 0.5) + 50 * (quantile_cont(l_extendedprice, 0.75) - quantile_cont(l_extendedprice, 0.25)) / 1000) AS t FROM lineitem GROUP BY 1) ON l_returnflag = m WHERE l_extendedprice > t", ONE))
def flagged(spark: SparkSession, sf: str) -> DataFrame:
    """Rows beyond their group's threshold; the spread is taken in thousandths, so that some are."""
    li = table(spark, sf, "lineitem")
    q = A.exact_quantiles(li, ["l_returnflag"], "l_extendedprice", [0.999, 0.5, 0.25, 0.75])
    t = q.select("l_returnflag", X.tail_threshold(F.col("q")[0], F.col("q")[1], (F.col("q")[3] - F.col("q")[2]) / 1000).alias("t"))
    return li.join(t, "l_returnflag").where(F.col("l_extendedprice") > F.col("t")).select("l_orderkey", "l_linenumber")
