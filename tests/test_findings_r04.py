"""Findings of round 4."""

from __future__ import annotations

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import QUERIES
from cambium.operators import aggregates, graph, joins, vectors
from cambium.plans import bindings

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["jn01_relabel_edges", "jn02_attach_ends"])
def test_the_pairs_are_not_broadcast(spark, name):
    """Spark took the contacts for a small table and sent them to the driver."""
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert re.findall(r"BroadcastHashJoin \[[ij]#.*, (Build\w+)", plan) == ["BuildRight", "BuildRight"]


def test_a_large_look_up_table_is_not_broadcast(spark, monkeypatch):
    edges = spark.createDataFrame([(1, 2), (2, 3), (1, 3)], "i long, j long")
    nodes = spark.range(1, 4).select(F.col("id").alias("cell"), (F.col("id") % 2).alias("node"))
    few = sorted(joins.relabel_edges(edges, nodes, "i", "j").collect())
    monkeypatch.setattr(joins, "FEW_ROWS", 2)
    many = joins.relabel_edges(edges, nodes, "i", "j")
    assert "BroadcastHashJoin" not in many._jdf.queryExecution().executedPlan().toString()
    assert sorted(many.collect()) == few and len(few) == 2


def test_slices_of_contacts_and_narrowed_medians_change_nothing(spark, monkeypatch):
    """Pairs are shuffled in slices and values only near the medians, with the same rows."""
    names = ["ag01_relation_summary", "sc04_present_terms"]
    whole = [sorted(map(str, QUERIES[n](spark, SF).collect())) for n in names]
    monkeypatch.setattr(bindings, "FEW_PAIRS", 1000)
    monkeypatch.setattr(aggregates, "FEW_VALUES", 0)
    calls, kept = [], bindings.written_in_turn
    monkeypatch.setattr(bindings, "written_in_turn", lambda parts, tag: kept([calls.append(1) or p for p in parts], tag))
    assert [sorted(map(str, QUERIES[n](spark, SF).collect())) for n in names] == whole
    assert len(calls) > 2


def test_narrowed_quantiles(spark):
    r = random.Random(4)
    values = {0: [r.gauss(0, 1) for _ in range(900)], 1: [r.choice([0.5, 2.0]) for _ in range(51)], 2: [7.0], 3: [1e300 * r.random() ** 40 for _ in range(300)], 4: [-1e308, 1e308, 3.0, math.inf]}
    df = spark.createDataFrame([(k, v) for k, vs in values.items() for v in [*vs, None]], "k int, v double")
    counted = aggregates.counts_near(df.where("v is not null").select("k", F.col("v").alias("_v")), ["k"], [0.5, 0.9])
    assert counted.count() < 600
    qs = [0.0, 0.25, 0.5, 0.9, 1.0]
    for q in qs:
        got, want = ({r.k: (r.n, r.q) for r in aggregates.exact_quantiles(df, ["k"], "v", [q], narrow=w).collect()} for w in (True, False))
        assert got.keys() == want.keys() and all(str(got[k]) == str(want[k]) for k in want)
    got, want = (aggregates.exact_quantiles(df, [], "v", qs, narrow=w).collect() for w in (True, False))
    assert str(got) == str(want)


def test_least_paths_of_more_than_64_arcs(spark, monkeypatch):
    """F8: a least path may have any number of arcs, and each source is searched in one task and no rounds."""
    arcs = [(k, k + 1, 1.0) for k in range(90)] + [(k + 1, k, 1.5) for k in range(90)] + [(0, 90, 500.0), (200, 201, 2.0), (200, 201, 0.5)]
    d = spark.createDataFrame(arcs, "src long, dst long, cost double")
    nodes = spark.createDataFrame([(k,) for k in (0, 3, 90, 200, 300)], "node long")
    want = {(0, k): float(k) for k in range(91)} | {(3, k): k - 3.0 if k > 3 else 1.5 * (3 - k) for k in range(91)} | {(90, k): 1.5 * (90 - k) for k in range(91)} | {(200, 200): 0.0, (200, 201): 0.5, (300, 300): 0.0}
    assert {(r.source, r.node): r.cost for r in graph.shortest_paths(d, nodes, most_rounds=1).collect()} == want
    short = d.where("src < 5 and dst < 5 or src = 200")
    tasks, rounds = (sorted(graph.shortest_paths(short, nodes, few=f).collect()) for f in (None, 0))
    assert tasks == rounds


def test_the_prior_forms_its_pairs_once(spark):
    """pairs of members were formed anew wherever weights were read; a NULL member counts in its set's size and has no pairs."""
    rows = [(0, 1, 5), (0, 1, 6), (0, 1, 6), (0, 1, None), (0, 2, 5), (0, 2, 6), (0, 2, 7), (1, 1, 6), (1, 1, 7), (1, 3, 8), (1, None, 5), (1, None, 6)]
    out = vectors.functional_prior(spark.createDataFrame(rows, "layer int, set int, member int"))
    assert all("/prior-" in f for f in out.inputFiles())
    one = {(5, 6): 0.5 + 0.5, (5, 7): 0.5, (6, 7): 0.5}  # degrees 1.5, 1.5, 1
    want = {p: v / 1.5 / 2 for p, v in one.items()}
    want[6, 7] += 1.0 / 1.0 / 2
    want |= {(b, a): v for (a, b), v in want.items()} | {(k, k): 0.0 for k in (5, 6, 7)}
    assert {(r.i, r.j): r.w for r in out.collect()} == pytest.approx(want)
