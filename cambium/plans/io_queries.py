"""Queries that write a table in some format, read it back and return it, and those over scalar functions."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cambium.functions import scalars as X
from cambium.plans.bindings import CONTACTS, LABELS, MERGES, cells, contacts, merges
from cambium.plans.registry import query
from cambium.plans.series_queries import r6, rounded
from cambium.plans.table_queries import sql, start
from cambium.scratch import shared_dir
from cambium.sources import readers, sinks
from cambium.sources.tables import table

ONE = "one AS (SELECT 1)"


def place(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the cluster shares."""
    return f"{shared_dir(spark)}/cambium/io-{uuid.uuid4().hex}/{name}"


@query("src02_read_by_ending", sql("SELECT ending, c_custkey, c_name, c_acctbal FROM customer, (SELECT unnest(['csv', 'tsv', 'jsonl', 'orc', 'parquet']) AS ending)", ONE))
def by_ending(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal")
    out = None
    for ending in ("csv", "tsv", "jsonl", "orc", "parquet"):
        path = place(spark, f"customer.{ending}")
        kind, options = readers.FORMATS[ending]
        c.write.format(kind).options(**options).save(path)
        one = readers.read_any(spark, path, "c_custkey long, c_name string, c_acctbal double", ["c_custkey", "c_name", "c_acctbal"]).withColumn("ending", F.lit(ending))
        out = one if out is None else out.unionByName(one)
    return out


@query("src03_column_inventory", "SELECT 9 AS columns, 0 AS order_like, 9 AS customer_like")
def inventory(spark: SparkSession, sf: str) -> DataFrame:
    path = place(spark, "t.parquet")
    c = table(spark, sf, "customer")
    sinks.write_table(c.withColumns({"c_a": F.lit(1), "c_b": F.lit(2), "c_c": F.lit(3), "c_d": F.lit(4)}), path)
    rows = readers.column_inventory(spark, path, {"order_like": ["o_"], "customer_like": ["c_"]})
    return spark.createDataFrame([(r["columns"], r["order_like"], r["customer_like"]) for r in rows], "columns int, order_like int, customer_like int")


@query("src04_sparse_matrix", sql("SELECT l_suppkey AS row, CAST(l_linenumber AS BIGINT) AS \"column\", sum(l_quantity) AS value FROM lineitem GROUP BY ALL", ONE))
def sparse(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("row"), F.col("l_linenumber").cast("long").alias("column"), F.col("l_quantity").alias("value"))
    shape = e.agg(F.max("row"), F.max("column")).first()
    return readers.sparse_matrix(e, (shape[0] + 1, shape[1] + 1))


@query("src05_gene_sets", sql("SELECT DISTINCT p_brand AS \"set\", upper(trim(p_type)) AS member FROM part", ONE))
def gene_sets(spark: SparkSession, sf: str) -> DataFrame:
    path = place(spark, "sets.gmt")
    lines = table(spark, sf, "part").groupBy("p_brand").agg(F.collect_set("p_type").alias("m")).select(F.concat_ws("\t", "p_brand", F.lit("about"), F.concat_ws("\t", "m")).alias("value"))
    lines.unionByName(lines.limit(1).select(F.lit("too\tshort").alias("value"))).write.text(path)
    return readers.read_gene_sets(spark, path)


@query("src06_read_steps", sql("SELECT microstep AS step, count(*) AS merges FROM ledger GROUP BY microstep", MERGES))
def steps(spark: SparkSession, sf: str) -> DataFrame:
    path = place(spark, "steps.jsonl")
    merges(spark, sf).groupBy(F.col("microstep").alias("step")).agg(F.count("*").alias("merges")).write.json(path)
    return readers.read_steps(spark, path, "step int, merges long")


@query("src07_read_landmarks", sql("SELECT CAST(n_nationkey AS INTEGER) AS landmark_index, n_name AS name FROM nation", ONE))
def landmarks(spark: SparkSession, sf: str) -> DataFrame:
    path = place(spark, "landmarks")
    n = table(spark, sf, "nation").select(F.col("n_nationkey").cast("int").alias("landmark_index"), F.col("n_name").alias("name"))
    # The format is one document a file.
    n.repartitionByRange(64, "landmark_index").write.option("maxRecordsPerFile", 1).json(path)
    return readers.read_landmarks(spark, path, "landmark_index int, name string")


@query("src08_read_shards", sql("SELECT CAST(microstep AS BIGINT) AS shard, removed, survivor FROM ledger", MERGES))
def shards(spark: SparkSession, sf: str) -> DataFrame:
    path = place(spark, "shards")
    m = merges(spark, sf)
    for k in range(1, 15):
        sinks.write_table(m.where(F.col("microstep") == k).select("removed", "survivor"), f"{path}/events_{k:06d}.parquet")
    return readers.read_shards(spark, f"{path}/events_*.parquet", "shard").select("shard", "removed", "survivor")


@query("src11_outlines", sql("SELECT c_custkey AS cell_id, c_acctbal AS x, -c_acctbal AS y FROM customer", ONE))
def outlines(spark: SparkSession, sf: str) -> DataFrame:
    return readers.read_outlines(table(spark, sf, "customer").select(F.col("c_custkey").alias("Cell"), F.col("c_acctbal").alias("x_location"), (-F.col("c_acctbal")).alias("Vertex_Y"), F.lit(0).alias("z")))


@query("src12_geojson", sql("SELECT CAST(n_nationkey AS INTEGER) AS feature, part, o, CAST(n_nationkey + px AS DOUBLE) AS x, CAST(n_regionkey + py AS DOUBLE) AS y FROM nation, (VALUES (0, 0, 0, 0), (0, 1, 1, 0), (0, 2, 1, 1), (0, 3, 0, 0), (1, 0, 5, 5), (1, 1, 6, 5), (1, 2, 6, 6), (1, 3, 5, 5)) v(part, o, px, py) WHERE part = 0 OR n_nationkey % 2 = 1", ONE))
def geojson(spark: SparkSession, sf: str) -> DataFrame:
    path = place(spark, "cells.json")
    a, b = F.col("n_nationkey"), F.col("n_regionkey")
    ring = lambda d: F.array(*[F.array(a + d + p, b + d + q) for p, q in ((0, 0), (1, 0), (1, 1), (0, 0))])
    one = F.to_json(F.struct(F.lit("Polygon").alias("type"), F.array(ring(0)).alias("coordinates")))
    two = F.to_json(F.struct(F.lit("MultiPolygon").alias("type"), F.array(F.array(ring(0)), F.array(ring(5))).alias("coordinates")))
    feature = F.concat(F.lit('{"type":"Feature","properties":{"id":"'), a.cast("string"), F.lit('"},"geometry":'), F.when(a % 2 == 1, two).otherwise(one), F.lit("}"))
    whole = table(spark, sf, "nation").agg(F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", feature.alias("f")))), lambda s: s["f"])).alias("all"))
    whole.select(F.concat(F.lit('{"type":"FeatureCollection","features":['), "all", F.lit("]}")).alias("value")).write.text(path)
    return readers.read_geojson(spark, path)


@query("snk01_write_table", sql("SELECT * FROM orders", ONE))
def written_table(spark: SparkSession, sf: str) -> DataFrame:
    path = place(spark, "orders.parquet")
    sinks.write_table(table(spark, sf, "orders"), path)
    return readers.read_any(spark, path)


@query("snk02_ledger", sql("SELECT removed, survivor, microstep, (SELECT max(microstep) FROM ledger) AS resumed_at FROM ledger", MERGES))
def ledger(spark: SparkSession, sf: str) -> DataFrame:
    """Every step is appended, one of them twice as after a failure; labels are checked in at the last."""
    led = sinks.Ledger(spark, place(spark, "ledger"), "all")
    m = merges(spark, sf)
    last = m.agg(F.max("microstep")).first()[0]
    for k in (*range(1, last + 1), last):
        led.step({"step": k}, m.where(F.col("microstep") == k))
    led.checkpoint(last, start(spark, sf))
    return led.merges().select("removed", "survivor", "microstep").withColumn("resumed_at", F.lit(led.latest()[0]))


@query("snk04_text_table", sql("SELECT c_custkey, c_name, c_acctbal FROM customer", ONE))
def text_table(spark: SparkSession, sf: str) -> DataFrame:
    path = place(spark, "customer.tsv")
    sinks.write_text_table(table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal"), path, "\t")
    return readers.read_any(spark, path, "c_custkey long, c_name string, c_acctbal double")


@query("snk05_graph_text", sql("""SELECT line FROM (
  SELECT '<?xml version="1.0" encoding="UTF-8"?>' AS line UNION ALL SELECT '<graphml xmlns="http://graphml.graphdrawing.org/xmlns"><key id="label" for="node" attr.name="label" attr.type="string"/><graph edgedefault="directed">' UNION ALL SELECT '</graph></graphml>'
  UNION ALL SELECT '<node id="' || n_nationkey || '"><data key="label">' || replace(n_name, '&', '&amp;') || '</data></node>' FROM nation
  UNION ALL SELECT '<edge source="' || n_nationkey || '" target="' || n_regionkey || '"/>' FROM nation)""", ONE))
def graph_lines(spark: SparkSession, sf: str) -> DataFrame:
    path = place(spark, "nations.graphml")
    n = table(spark, sf, "nation")
    lines = sinks.graph_text(n.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("label")), n.select(F.col("n_nationkey").alias("src"), F.col("n_regionkey").alias("dst")))
    lines.coalesce(1).write.text(path)
    return readers.read_any(spark, f"{path}/*.txt").select(F.col("value").alias("line"))


@query("snk07_file_digest", sql("SELECT count(*) AS files, true AS same FROM (SELECT 1)", ONE))
def file_digests(spark: SparkSession, sf: str) -> DataFrame:
    """Two copies of one file have one digest."""
    paths = [place(spark, "a.txt"), place(spark, "b.txt")]
    for p in paths:
        table(spark, sf, "nation").select(F.concat_ws(",", "n_nationkey", "n_name").alias("v")).coalesce(1).orderBy("v").write.text(p)
    got = [sinks.file_digest(spark, f"{p}/*.txt").select("sha256", "length") for p in paths]
    return got[0].join(got[1], ["sha256", "length"], "full_outer").agg(F.count("*").alias("files"), F.lit(True).alias("same"))


# --- scalars and projections ---------------------------------------------------------------------------------------------


@query("sc02_mad_z", sql(f"SELECT c_custkey, {r6('(c_acctbal - m) / CASE WHEN mad > 0 THEN mad * 1.4826 WHEN sd > 0 THEN sd ELSE 1 END')} AS z FROM customer JOIN q USING (c_mktsegment)",
  "m0 AS (SELECT c_mktsegment, quantile_cont(c_acctbal, 0.5) AS m, stddev_pop(c_acctbal) AS sd FROM customer GROUP BY ALL)", "q AS (SELECT c_mktsegment, any_value(m) AS m, any_value(sd) AS sd, quantile_cont(abs(c_acctbal - m), 0.5) AS mad FROM customer JOIN m0 USING (c_mktsegment) GROUP BY ALL)"))
def mad_z(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer")
    half = lambda x: F.percentile(x, F.lit(0.5))
    m = c.groupBy("c_mktsegment").agg(half("c_acctbal").alias("m"), F.stddev_pop("c_acctbal").alias("sd"))
    mad = c.join(m, "c_mktsegment").groupBy("c_mktsegment", "m", "sd").agg(half(F.abs(F.col("c_acctbal") - F.col("m"))).alias("mad"))
    return rounded(c.join(mad, "c_mktsegment").select("c_custkey", X.mad_z("c_acctbal", "m", "mad", "sd").alias("z")))


@query("sc04_present_terms", sql(f"SELECT i, j, {r6('list_avg([tension, pressure])')} AS mean, {r6('sqrt(list_avg([tension * tension, pressure * pressure]))')} AS rms FROM contacts", CONTACTS))
def present(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(contacts(spark, sf).select("i", "j", X.mean_of_present("tension", "pressure").alias("mean"), X.rms_of_present("tension", "pressure").alias("rms")))


@query("sc16_adaptive_hops", sql("SELECT node, CAST(least(4, 1 + floor(log2(greatest(size / 2.0, 1.0)))) AS INTEGER) AS hops FROM (SELECT node, count(*) AS size FROM cells GROUP BY node)", LABELS))
def hops(spark: SparkSession, sf: str) -> DataFrame:
    return cells(spark, sf).groupBy("node").agg(F.count("*").alias("size")).select("node", X.adaptive_hops(F.col("size") / 2.0).alias("hops"))


@query("sc08_spatial_weight", sql(f"SELECT i, j, {r6('exp(-power(abs(tension) / 5000, 2) - power(abs(pressure) / 0.05, 2))')} AS weight FROM contacts WHERE tension IS NOT NULL AND pressure IS NOT NULL", CONTACTS))
def spatial(spark: SparkSession, sf: str) -> DataFrame:
    c = contacts(spark, sf).where("tension is not null and pressure is not null")
    return rounded(c.select("i", "j", X.spatial_expression_weight(F.abs("tension"), F.lit(5000.0), F.abs("pressure"), F.lit(0.05)).alias("weight")))


@query("sc11_holonomy_density", sql(f"SELECT i, j, {r6('CASE WHEN pressure IS NOT NULL AND n > 2 THEN n / 7.0 / (n - 2) END')} AS density FROM contacts", CONTACTS))
def density(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(contacts(spark, sf).select("i", "j", X.holonomy_density(F.col("n") / 7.0, F.col("n") - 2, F.col("pressure").isNotNull()).alias("density")))


@query("sc13_member_lists", sql("SELECT l_orderkey, CAST(count(*) AS INTEGER) AS size, CAST(sum(l_suppkey) AS BIGINT) AS total FROM lineitem GROUP BY l_orderkey", ONE))
def member_lists(spark: SparkSession, sf: str) -> DataFrame:
    """Three ways to write a list, by the order's key, read by one parser."""
    o = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.col("l_suppkey").cast("string")).alias("m"))
    k = F.col("l_orderkey") % 3
    text = F.when(k == 0, F.concat(F.lit("["), F.concat_ws(", ", "m"), F.lit("]"))).when(k == 1, F.concat_ws(";", "m")).otherwise(F.concat_ws(",", "m"))
    got = o.select("l_orderkey", X.member_list(text).alias("members"))
    return got.select("l_orderkey", F.size("members").alias("size"), F.aggregate("members", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


@query("sc14_specimens", "SELECT page_id, CASE WHEN u LIKE '% fr %' THEN 'french' WHEN u LIKE '% de %' THEN 'german' WHEN u LIKE '% es %' THEN 'spanish' WHEN u LIKE '%example%' AND u LIKE '% en %' THEN 'english' END AS specimen FROM (SELECT page_id, regexp_replace(lower(url), '[^a-z0-9]+', ' ', 'g') AS u FROM pages)")
def specimens(spark: SparkSession, sf: str) -> DataFrame:
    """Pages by the words of their addresses."""
    known = {"french": [" fr "], "german": [" de "], "spanish": [" es "], "english": ["example", " en "]}
    return table(spark, sf, "pages").select("page_id", readers.specimen_column(F.col("url"), known).alias("specimen"))


@query("prj03_canonical_pairs", sql("SELECT least(l_partkey, l_suppkey) AS i, greatest(l_partkey, l_suppkey) AS j, count(*) AS n FROM lineitem WHERE l_partkey <> l_suppkey GROUP BY ALL", ONE))
def pairs(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("i"), F.col("l_suppkey").alias("j"))
    return X.canonical_pair(li, "i", "j").groupBy("i", "j").agg(F.count("*").alias("n"))


@query("prj01_projection", sql(f"SELECT c_custkey AS id, {r6('c_acctbal')} AS value, c_custkey % 10 = 0 AS missing, CASE c_custkey % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 0.0 END AS passed FROM customer", ONE))
def projected(spark: SparkSession, sf: str) -> DataFrame:
    """Columns by alias, whatever their case; sentinels and status words as flags."""
    k = F.col("c_custkey")
    c = table(spark, sf, "customer").select(k.alias("Cell_ID"), F.col("c_acctbal").alias("AcctBal"), F.when(k % 10 == 0, "UNASSIGNED").otherwise("a").alias("owner"), F.when(k % 3 == 0, " pass").when(k % 3 == 1, "Failed").otherwise("?").alias("state"))
    r = X.resolve_columns(c, {"id": ["id", "cell_id"], "value": ["value", "acctbal"], "owner": ["owner"], "state": ["state"]})
    return rounded(r.select("id", "value", X.unassigned("owner").alias("missing"), X.status_to_float("state").alias("passed")))
