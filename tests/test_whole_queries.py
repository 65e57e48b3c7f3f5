"""Queries against brute force on whole small tables."""

import inspect
import math
import os
import statistics

import pytest

from cambium.plans import table_queries
from cambium.plans.bindings import contacts
from cambium.plans.registry import QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")


def batch(edges, order, cap):
    taken, used = [], set()
    for e in sorted(edges, key=lambda e: (*[e[c] if up else -e[c] for c, up in order], e["super_i"], e["super_j"])):
        if len(taken) < cap and not {e["super_i"], e["super_j"]} & used:
            taken.append(e)
            used |= {e["super_i"], e["super_j"]}
    return taken


@pytest.mark.parametrize(
    ("best", "rows"),
    [
        ("boundary", [(0, 1, 1, 2.0, 5.0), (0, 2, 9, 2.0, 5.0), (2, 3, 1, 9.0, 5.0), (1, 3, 1, 2.0, 4.0)]),
        ("cost_then_merit", [(0, 1, 1, 1.0, 1.0), (0, 2, 1, 1.0, 5.0), (1, 3, 1, 1.0, 5.0), (4, 5, 1, 3.0, 6.0), (5, 6, 1, 2.0, 1.0)]),
    ],
)
def test_batch_is_the_best_of_all_routes(spark, monkeypatch, best, rows):
    edges = [dict(zip(("super_i", "super_j", "n_boundary_edges", "cost", "merit"), r, strict=True)) for r in rows]
    s = spark.createDataFrame(rows, "super_i long, super_j long, n_boundary_edges long, tension double, shared double")
    monkeypatch.setattr(table_queries, "supers", lambda *_: s)
    orders = {"cost": [("cost", 1)], "merit": [("merit", 0)], "cost_then_merit": [("cost", 1), ("merit", 0)], "boundary": [("n_boundary_edges", 0), ("cost", 1)], "merit_then_cost": [("merit", 0), ("cost", 1)]}
    made = {k: batch(edges, o, 4) for k, o in orders.items()}
    name = min(made, key=lambda k: (-len(made[k]), sum(e["cost"] for e in made[k]), max(e["cost"] for e in made[k]), -sum(e["merit"] for e in made[k]), k))
    got = QUERIES["so05_06_batch_by_routes"](spark, SF).collect()
    assert name == best and {r.route for r in got} == {name}
    assert sorted((r.super_i, r.super_j) for r in got) == sorted((e["super_i"], e["super_j"]) for e in made[name])


def test_harmonic_fill_runs_to_the_operators_tolerance(spark, monkeypatch):
    fill, given = table_queries.graph.harmonic_fill, {}

    def seen(adjacency, anchors, nodes, *args, **kwargs):
        given.update(inspect.signature(fill).bind(adjacency, anchors, nodes, *args, **kwargs).arguments)
        return nodes

    monkeypatch.setattr(table_queries.graph, "harmonic_fill", seen)
    QUERIES["gr07_harmonic_fill"](spark, SF)
    default = {k: v.default for k, v in inspect.signature(fill).parameters.items()}
    assert given.get("tolerance", default["tolerance"]) <= 1e-7


def test_joins_and_prior_take_all_rows(spark):
    part = spark.read.parquet(f"{SF}/part.parquet").select("p_partkey", "p_size").collect()
    got = {r.span: r.n for r in QUERIES["jn12_within_range"](spark, SF).collect()}
    assert got == {p.p_partkey: sum(p.p_size <= q.p_size <= p.p_size + p.p_partkey % 4 for q in part) for p in part}
    people = spark.read.parquet(f"{SF}/customer.parquet").collect()
    found = {(r.c_custkey, r.rank): r.match for r in QUERIES["jn17_matched_candidates"](spark, SF).collect()}
    want = {}
    for c in people:
        near = sorted((abs(c.c_acctbal - o.c_acctbal), o.c_custkey) for o in people if o.c_nationkey == c.c_nationkey and o.c_mktsegment != "BUILDING")
        want |= {(c.c_custkey, k + 1): m for k, (_, m) in enumerate(near[:3]) if c.c_mktsegment == "BUILDING"}
    assert found == want and found
    sets = {}
    for r in spark.read.parquet(f"{SF}/lineitem.parquet").select("l_linenumber", "l_orderkey", "l_suppkey").collect():
        sets.setdefault((r.l_linenumber % 2, r.l_orderkey), set()).add(r.l_suppkey)
    w = {0: {}, 1: {}}
    for (layer, _), s in sets.items():
        for i, j in ((i, j) for i in s for j in s if i != j):
            w[layer][i, j] = w[layer].get((i, j), 0.0) + 1 / (len(s) - 1)
    mean = {}
    for pairs in w.values():
        degree = {}
        for (i, _), x in pairs.items():
            degree[i] = degree.get(i, 0.0) + x
        for e, x in pairs.items():
            mean[e] = mean.get(e, 0.0) + x / statistics.median(degree.values()) / 2
    prior = {(r.i, r.j): r.w for r in QUERIES["vx03_functional_prior"](spark, SF).where("i <> j").collect()}
    assert prior == pytest.approx(mean, abs=2e-6)


def test_contacts_of_all_rows(spark):
    offers = {}
    for r in spark.read.parquet(f"{SF}/lineitem.parquet").select("l_partkey", "l_suppkey").collect():
        offers.setdefault(r.l_partkey, set()).add(r.l_suppkey)
    shared = {}
    for s in offers.values():
        for i, j in ((i, j) for i in s for j in s if i != j):
            shared[i, j] = shared.get((i, j), 0) + 1
    assert {(r.i, r.j): r.n for r in contacts(spark, SF).collect()} == {e: n for e, n in shared.items() if e[0] < e[1]}


def test_mesh_of_all_rows(spark):
    """The graph queries take every embedding, and every pair of mutual neighbours."""
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    near = {}
    for r in rows:
        mine = sorted((math.dist(r.embedding[:2], o.embedding[:2]), o.vec_id) for o in rows if o.label == r.label and o.vec_id != r.vec_id)
        near[r.vec_id] = {k for _, k in mine[:4]}
    edges = {(i, j) for i in near for j in near[i] if i < j and i in near[j]}
    assert {(r.src, r.dst) for r in QUERIES["gr01_03_adjacency"](spark, SF).collect()} == edges | {(j, i) for i, j in edges}
    loops = [(u, v, w) for u, v in edges for w in near if v < w and (v, w) in edges and (u, w) in edges]
    assert sorted(tuple(r) for r in QUERIES["gr08_triangles"](spark, SF).collect()) == sorted(loops)
    parts = {r.component for r in QUERIES["gr04_components"](spark, SF).collect()}
    assert 1 < len(parts) < len(rows)
