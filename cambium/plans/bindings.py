"""Roles of the operators played by the supplied tables, as DataFrames and as SQL of the same rows."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cambium.operators import joins
from cambium.scratch import dropped, written, written_in_turn
from cambium.sources.tables import table

#: A series for each event type: number and mean value of events by six hours.
SERIES = """traj AS (
  SELECT event_type AS sample, CAST(floor((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 21600000000.0) AS BIGINT) AS bucket,
         CAST(count(*) AS BIGINT) AS n, round(avg(value), 6) AS y
  FROM events GROUP BY ALL)"""


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    us = F.expr("unix_micros(CAST(ts AS TIMESTAMP)) - unix_micros(TIMESTAMP '2024-01-01')")
    return e.groupBy(F.col("event_type").alias("sample"), F.floor(us / 21600000000.0).cast("long").alias("bucket")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("y"))


#: Contacts of suppliers that share a part: how many parts, mean differences of price and discount; some mechanics are missing.
CONTACTS = """offers AS (
  SELECT l_partkey AS p, l_suppkey AS s, avg(l_extendedprice) AS price, avg(l_discount) AS disc
  FROM lineitem GROUP BY ALL),
contacts AS (
  SELECT a.s AS i, b.s AS j, CAST(count(*) AS BIGINT) AS n,
         CASE WHEN (a.s + b.s) % 4 > 0 THEN round(avg(a.price - b.price) + 1.7e-10::DOUBLE, 6) END AS tension,
         CASE WHEN (a.s + b.s) % 3 > 0 THEN round(avg(a.disc - b.disc) + 1.7e-10::DOUBLE, 6) END AS pressure
  FROM offers a JOIN offers b ON a.p = b.p AND a.s < b.s GROUP BY a.s, b.s)"""


#: Pairs of offers that are shuffled at once; more go in slices of suppliers.
FEW_PAIRS = 1 << 27


def contacts(spark: SparkSession, sf_dir: str, then: Callable[[DataFrame], DataFrame] = lambda e: e) -> DataFrame:
    """Lines go by ranges of parts, so that pairs of suppliers who share neighbouring parts add up before they are shuffled.

    ``then`` is applied row by row. Of more than ``FEW_PAIRS`` pairs one slice is
    shuffled after the other, and what ``then`` leaves of it is written.
    """
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)  # a number given is not coalesced: pairs are many more than lines
    li = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s"), "l_extendedprice", "l_discount").where("p is not null and s is not null")
    offers = li.repartitionByRange(n, "p").groupBy("p", "s").agg(F.avg("l_extendedprice").alias("price"), F.avg("l_discount").alias("disc"))
    of_part = offers.groupBy("p").agg(F.collect_list(F.struct("s", "price", "disc")).alias("o")).select("o")  # of one part: no more than there are suppliers
    of_part = written(of_part, "offers")
    size = F.size("o").cast("double")
    slices = math.ceil((of_part.agg(F.sum(size * (size - 1) / 2)).first()[0] or 0) / FEW_PAIRS)
    if slices <= 1:
        return then(_pairs_of(of_part, F.lit(True)))
    out = written_in_turn((then(_pairs_of(of_part, F.pmod(F.xxhash64("a.s"), F.lit(slices)) == k)) for k in range(slices)), "contacts")
    dropped(of_part)
    return out


def _pairs_of(of_part: DataFrame, first: Column) -> DataFrame:
    """Contacts whose lesser supplier ``a.s`` meets a condition."""
    pairs = of_part.select("o", F.explode("o").alias("a")).where(first).select("a", F.explode("o").alias("b")).where("a.s < b.s")
    m = F.col("i") + F.col("j")
    return pairs.groupBy(F.col("a.s").alias("i"), F.col("b.s").alias("j")).agg(F.count("*").alias("n"), F.avg(F.col("a.price") - F.col("b.price")).alias("t"), F.avg(F.col("a.disc") - F.col("b.disc")).alias("q")).select(
        "i", "j", "n", F.when(m % 4 > 0, F.round(F.col("t") + F.lit(1.7e-10), 6)).alias("tension"), F.when(m % 3 > 0, F.round(F.col("q") + F.lit(1.7e-10), 6)).alias("pressure"),
    )


#: Suppliers as cells, labelled by nation and by region.
LABELS = """cells AS (
  SELECT s_suppkey AS cell, CAST(s_nationkey AS BIGINT) AS node, CAST(n_regionkey AS BIGINT) AS region, s_acctbal AS mass
  FROM supplier JOIN nation ON n_nationkey = s_nationkey)"""


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, n = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    return s.join(n, s["s_nationkey"] == n["n_nationkey"]).select(F.col("s_suppkey").alias("cell"), F.col("s_nationkey").cast("long").alias("node"), F.col("n_regionkey").cast("long").alias("region"), F.col("s_acctbal").alias("mass"))


#: Embeddings as points of a sample each, with their state.
POINTS = """points AS (
  SELECT vec_id AS id, CAST(label AS BIGINT) AS sample, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y,
         list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS state
  FROM embeddings)"""


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("id"), F.col("label").cast("long").alias("sample"), F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"), F.col("embedding").cast("array<double>").alias("state"))


#: Orders of each customer as objects with a mass.
MASSES = """objects AS (
  SELECT o_custkey AS id, CAST(c_nationkey AS BIGINT) AS sample, CAST(count(*) AS BIGINT) AS mass
  FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY ALL)"""


def masses(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("mass"))
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_custkey").alias("id"), F.col("c_nationkey").cast("long").alias("sample"), "mass")


#: A ledger over customers: each but the multiples of 50 is merged into a smaller one, in ten steps.
MERGES = """ledger AS (
  SELECT c_custkey AS removed, CASE WHEN c_custkey % 5 = 0 THEN c_custkey - c_custkey % 50 ELSE c_custkey - c_custkey % 5 END AS survivor,
         CAST(CASE WHEN c_custkey % 5 = 0 THEN 5 + c_custkey // 5 % 10 - 1 ELSE c_custkey % 5 END AS INTEGER) AS microstep
  FROM customer WHERE c_custkey % 50 <> 0 AND c_custkey >= 50)"""


def merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    c = table(spark, sf_dir, "customer").where((k % 50 != 0) & (k >= 50))
    five = k % 5 == 0
    return c.select(k.alias("removed"), F.when(five, k - k % 50).otherwise(k - k % 5).alias("survivor"), F.when(five, F.floor(k / 5) % 10 + 4).otherwise(k % 5).cast("int").alias("microstep"))


#: A sparse graph: points of a sample that are among each other's four nearest. Counts are dimensions of like sign; some mechanics are missing.
MESH = """near4 AS (SELECT a, b FROM (SELECT p.id AS a, q.id AS b, row_number() OVER (PARTITION BY p.id ORDER BY sqrt((p.x - q.x) ** 2 + (p.y - q.y) ** 2), q.id) AS rank
  FROM points p JOIN points q ON p.sample = q.sample AND p.id <> q.id) WHERE rank <= 4),
mesh AS (
  SELECT p.id AS i, q.id AS j, p.sample AS sample, CAST(len(list_filter(range(1, 65), lambda k: p.state[k] * q.state[k] > 0)) AS BIGINT) AS n,
         CASE WHEN (p.id + q.id) % 4 > 0 THEN round(p.state[3] - q.state[3], 6) END AS tension, CASE WHEN (p.id + q.id) % 3 > 0 THEN round(p.state[4] - q.state[4], 6) END AS pressure
  FROM near4 u JOIN near4 v ON v.a = u.b AND v.b = u.a JOIN points p ON p.id = u.a JOIN points q ON q.id = u.b WHERE u.a < u.b)"""


def mesh(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir)
    near = joins.nearest_neighbours(p, ["sample"], "id", "x", "y", 4, 0.1)
    pairs = near.select("sample", F.least("a", "b").alias("i"), F.greatest("a", "b").alias("j")).groupBy("sample", "i", "j").agg(F.count("*").alias("_both")).where("_both = 2")
    ends = pairs.join(p.select(F.col("id").alias("i"), F.col("state").alias("si")), "i").join(p.select(F.col("id").alias("j"), F.col("state").alias("sj")), "j")
    alike = F.size(F.filter(F.zip_with("si", "sj", lambda u, v: u * v), lambda v: v > 0)).cast("long")
    m = F.col("i") + F.col("j")
    out = ends.select(
        "i", "j", "sample", alike.alias("n"), F.when(m % 4 > 0, F.round(F.col("si")[2] - F.col("sj")[2], 6)).alias("tension"), F.when(m % 3 > 0, F.round(F.col("si")[3] - F.col("sj")[3], 6)).alias("pressure"),
    )
    return written(out, "mesh")  # graph operators read it several times
