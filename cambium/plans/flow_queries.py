"""Queries of the contextual flow over the mesh of all embeddings."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cambium.operators import flow, vectors
from cambium.plans.bindings import MESH, POINTS, mesh, points
from cambium.plans.registry import query
from cambium.plans.series_queries import r6, rounded
from cambium.plans.table_queries import sql

DIM = 64


def laplacian() -> np.ndarray:
    """Of the graph in which dimensions 2k and 2k + 1 are neighbours."""
    return np.kron(np.eye(DIM // 2), np.array([[1.0, -1.0], [-1.0, 1.0]]))


def metric() -> flow.Metric:
    return flow.Metric(laplacian(), 0.5, vectors.block_metric(laplacian(), 0.5, 2.0, 3.0))


def flow_contacts(spark: SparkSession, sf: str) -> DataFrame:
    m = mesh(spark, sf)
    return m.select(F.col("i").alias("cell_i"), F.col("j").alias("cell_j"), "tension", "pressure", F.when(F.col("n") % 5 > 0, F.col("n") * 0.1).alias("comm_ij"), (F.col("n") * 0.05).alias("comm_ji"))


def flow_cells(spark: SparkSession, sf: str) -> DataFrame:
    p = points(spark, sf)
    covector = F.concat(F.transform("state", lambda v: v * 0.05), F.array(F.lit(0.01), F.lit(0.02)))
    return p.select(F.col("id").alias("cell"), "state", F.when(F.col("id") % 7 > 0, F.col("state")[5]).alias("tension"), F.when(F.col("id") % 11 > 0, F.col("state")[6]).alias("pressure"), covector.alias("covector"))


# Level 0 has one cell a node, so two hops; the five channels are rows of one table.
HOP2 = "(SELECT a.node, a.ch, 0.65 * any_value(a.num) + 0.35 * sum(p.p * b.num) AS num, 0.65 * any_value(a.den) + 0.35 * sum(p.p * b.den) AS den, 0.65 * any_value(a.sup) + 0.35 * sum(p.p * b.sup) AS sup FROM {0} a JOIN p ON p.src = a.node JOIN {0} b ON b.node = p.dst AND b.ch = a.ch GROUP BY a.node, a.ch)"
LEVEL0 = [
    """cell_ AS (SELECT id, state, CASE WHEN id % 7 > 0 THEN state[6] END AS t, CASE WHEN id % 11 > 0 THEN state[7] END AS p FROM points)""",
    """rel AS (
  SELECT i, j, abs(m.tension) AS t, abs(m.pressure) AS p, m.tension IS NOT NULL AND m.pressure IS NOT NULL AS ok, CASE WHEN n % 5 > 0 THEN n * 0.1::DOUBLE ELSE 0 END + n * 0.05::DOUBLE AS comm,
         list_transform(range(1, 65), lambda k: b.state[k] - a.state[k]) AS d, b.t - a.t AS dt, b.p - a.p AS dp, list_transform(range(1, 65), lambda k: 0.05::DOUBLE * a.state[k] - 0.05::DOUBLE * b.state[k]) AS db
  FROM mesh m JOIN cell_ a ON a.id = i JOIN cell_ b ON b.id = j)""",
    """len_ AS (SELECT *, list_dot_product(d, d) + 0.5::DOUBLE * list_sum(list_transform(range(1, 65, 2), lambda k: (d[k] - d[k + 1]) ** 2)) AS q FROM rel)""",
    """local_ AS (
  SELECT i, j, unnest(['molecular', 'mechanics', 'communication', 'geometry', 'topology']) AS ch,
         unnest([sqrt(q), CASE WHEN ok THEN sqrt((t * t + p * p) / 2) END, comm, sqrt(q + 2 * dt * dt + 3 * dp * dp) + 0.5::DOUBLE * list_dot_product(db, d), 1.0]) AS x,
         unnest([1.0::DOUBLE, ok::INT::DOUBLE, 1.0, (dt IS NOT NULL AND dp IS NOT NULL)::INT::DOUBLE, 1.0]) AS r
  FROM len_)""",
    """sides AS (SELECT i AS node, j AS other, ch, x, r FROM local_ UNION ALL SELECT j, i, ch, x, r FROM local_)""",
    """h0 AS (SELECT node, ch, sum(ln(2) * r * coalesce(x, 0)) AS num, sum(ln(2) * r) AS den, sum(ln(2) * r) / sum(ln(2)) AS sup FROM sides GROUP BY node, ch)""",
    """p AS (SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS p FROM (SELECT node AS src, other AS dst, ln(2) AS w FROM sides WHERE ch = 'topology' UNION ALL SELECT DISTINCT node, node, 1.0::DOUBLE FROM sides))""",
    "h1 AS " + HOP2.format("h0"),
    "h2 AS " + HOP2.format("h1"),
    """seen AS (SELECT node, ch, num / greatest(den, 1e-12) AS c, sup AS s FROM h2)""",
    """eff AS (
  SELECT l.i, l.j, l.ch, CASE WHEN l.x IS NOT NULL THEN 0.6 * l.x + 0.4 * (a.c + b.c) / 2 ELSE (a.c + b.c) / 2 END AS e,
         least(1.0, greatest(0.0, l.r + (1 - l.r) * 0.85 * least(1.0, greatest(0.0, (a.s + b.s) / 2)))) AS er
  FROM local_ l JOIN seen a ON a.node = l.i AND a.ch = l.ch JOIN seen b ON b.node = l.j AND b.ch = l.ch)""",
    """scale AS (SELECT ch, coalesce(quantile_cont(CASE WHEN e > 0 THEN e END, 0.5), CASE WHEN quantile_cont(e, 0.75) > 0 THEN quantile_cont(e, 0.75) END, 1.0) AS s FROM eff GROUP BY ch)""",
    """pen AS (
  SELECT i, j, ch, e, CASE WHEN ch = 'communication' THEN exp(-greatest(e, 0) / s) ELSE ln(1 + greatest(e, 0) / s) END AS p,
         er * CASE ch WHEN 'communication' THEN 0.75 WHEN 'topology' THEN 0.4 ELSE 1.0 END AS w
  FROM eff JOIN scale USING (ch))""",
    """costs AS (SELECT i, j, ln(sum(w * exp(3.0 * p)) / sum(w)) / 3.0 + 0.35 * (1 - sum(w) / 4.15) AS cost, sum(w) / 4.15 AS coverage, {channels} FROM pen GROUP BY i, j)""".format(
        channels=", ".join(f"max(CASE WHEN ch = '{ch}' THEN e END) AS e_{ch}" for ch in flow.CHANNELS)
    ),
]


@query("hi07_contextual_costs", sql(f"SELECT i AS super_i, j AS super_j, {', '.join(f'{r6(f'e_{ch}')} AS e_{ch}' for ch in flow.CHANNELS)}, {r6('cost')} AS cost, {r6('coverage')} AS coverage, cost <= (SELECT quantile_cont(cost, 0.35) FROM costs) AS allowed FROM costs", POINTS, MESH, *LEVEL0))
def contextual_costs(spark: SparkSession, sf: str) -> DataFrame:
    """Level 0 of the flow: all five channels with their context, costs, frozen scales and threshold."""
    out = flow.relation_costs(flow_contacts(spark, sf), flow_cells(spark, sf), metric())
    return rounded(out.select("super_i", "super_j", *[f"e_{ch}" for ch in flow.CHANNELS], "cost", "coverage", "allowed"))


#: Large batches, so that a run over the mesh ends within a few steps.
QUICK = flow.Config(stages=(), last_fraction=0.5)


@query("hi07_contextual_flow")
def contextual_flow(spark: SparkSession, sf: str) -> DataFrame:
    """The flow to its natural end; labels of all cells."""
    labels, _, _ = flow.contextual_flow(flow_contacts(spark, sf), flow_cells(spark, sf), metric(), QUICK)
    return labels


@query("hi12_production_run")
def production_run(spark: SparkSession, sf: str) -> DataFrame:
    """Records of all steps of a run with checkpoints, landmarks and a terminal rule."""
    cfg = flow.Config(stages=(), last_fraction=0.4, checkpoint_every=2, landmark=0.05, terminal={"least_blocks": 3, "warm": 3, "confirm": 2})
    _, records, _ = flow.contextual_flow(flow_contacts(spark, sf), flow_cells(spark, sf), metric(), cfg)
    return rounded(records.drop("step"))
