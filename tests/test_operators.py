"""Operators against small models in plain Python."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cambium.functions import scalars as X
from cambium.operators import audits, geometry, graph, hierarchy, joins, mechanics, selection, vectors
from cambium.operators import series as S
from cambium.sources import readers, sinks
from cambium.streaming import detectors
from cambium.streaming.ledger import replay_stream


def greedy(edges):
    used, out = set(), []
    for i, j, m in sorted(edges, key=lambda e: (-e[2], e[0], e[1])):
        if i not in used and j not in used:
            used |= {i, j}
            out.append((i, j))
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_matching_is_the_sequential_greedy_choice(spark, seed):
    r = random.Random(seed)
    edges = sorted({(*sorted(r.sample(range(14), 2)), r.randint(1, 4)) for _ in range(30)})
    df = spark.createDataFrame(edges, "super_i long, super_j long, merit int")
    got = selection.maximal_matching(df, [("merit", False)])
    assert sorted((a.super_i, a.super_j) for a in got.collect()) == greedy(edges)


def test_exact_matching_is_best():
    r = random.Random(3)
    edges = [(i, j, round(r.random(), 3)) for i, j in itertools.combinations(range(6), 2)][:12]
    best = max((len(c), -sum(e[2] for e in c)) for k in range(1, 4) for c in itertools.combinations(edges, k) if len({x for e in c for x in e[:2]}) == 2 * k)
    got = selection.exact_matching(edges, 3)
    assert (len(got), pytest.approx(-sum(e[2] for e in got))) == best


def test_contraction_keeps_the_lesser_id(spark):
    labels = spark.createDataFrame([(k, k) for k in range(4)], "cell long, node long")
    pairs = spark.createDataFrame([(0, 1), (2, 3)], "super_i long, super_j long")
    assert sorted(r.node for r in hierarchy.contract(labels, pairs).collect()) == [0, 0, 2, 2]


def test_replay_follows_chains_and_stops_at_a_step(spark):
    ledger = spark.createDataFrame([(1, 2, 3), (2, 1, 2), (3, 0, 1)], "microstep int, survivor long, removed long")
    labels = spark.createDataFrame([(k, k) for k in range(4)], "cell long, node long")
    assert [r.node for r in hierarchy.replay(labels, ledger).orderBy("cell").collect()] == [0, 0, 0, 0]
    assert [r.node for r in hierarchy.replay(labels, ledger, 2).orderBy("cell").collect()] == [0, 1, 1, 1]


def test_gradient_is_numpys(spark):
    t = [0.0, 1.0, 2.5, 3.0, 7.0]
    y = [1.0, 4.0, 2.0, 8.0, 5.0]
    df = spark.createDataFrame([("a", a, b) for a, b in zip(t, y)], "k string, t double, y double")
    got = [r[0] for r in df.select(S.gradient("y", "t", S.over(["k"], "t")).alias("g"), "t").orderBy("t").collect()]
    assert np.allclose(got, np.gradient(y, t))


def test_quad_and_triangle(spark):
    e = spark.createDataFrame([(0, 1), (1, 2), (2, 3), (0, 3), (3, 4), (2, 4)], "i long, j long")
    assert [tuple(r) for r in graph.triangles(e).collect()] == [(2, 3, 4)]
    assert [tuple(r) for r in graph.chordless_quads(e).collect()] == [(0, 1, 2, 3)]


def test_harmonic_fill_of_a_path(spark):
    e = spark.createDataFrame([(0, 1), (1, 2)], "i long, j long").withColumn("n", F.lit(1.0))
    anchors = spark.createDataFrame([(0, 0.0), (2, 1.0)], "node long, value double")
    nodes = spark.createDataFrame([(0,), (1,), (2,), (9,)], "node long")
    got = {r.node: (round(r.value, 4), r.hops) for r in graph.harmonic_fill(graph.weighted_adjacency(e, "n"), anchors, nodes).collect()}
    assert got == {0: (0.0, 0), 1: (0.5, 1), 2: (1.0, 0), 9: (0.0, None)}


def test_pressure_potential(spark):
    exact = spark.createDataFrame([(0, 1, 1.0), (1, 2, 1.0), (0, 2, 2.0), (5, 6, 1.0), (6, 7, 1.0), (5, 7, 5.0)], "i long, j long, y double")
    labels = spark.createDataFrame([(0, 0), (1, 0), (2, 0), (5, 5), (6, 5), (7, 5)], "node long, component long")
    got = mechanics.pressure_potential(exact, labels).groupBy("component").agg(F.max(F.abs("residual")).alias("r")).orderBy("component").collect()
    assert got[0].r < 1e-9 and got[1].r > 0.5
    other = mechanics.pressure_potential(exact, labels, "potential_minus_observed").agg(F.max("residual")).first()[0]
    assert other == pytest.approx(1.0)


def test_assignment_is_least(spark):
    r = np.random.default_rng(5)
    c = r.random((4, 6))
    best = min(sum(c[i, p[i]] for i in range(4)) for p in itertools.permutations(range(6), 4))
    assert sum(c[i, j] for i, j in geometry.assignment(c)) == pytest.approx(best)
    assert len(geometry.assignment(c.T)) == 4


def test_rotation_and_holonomy():
    r = np.random.default_rng(2)
    q = {k: r.normal(size=3) for k in range(3)}
    x = vectors.rotate(q[0], q[1], q[0][None] / np.linalg.norm(q[0]))[0]
    assert np.allclose(x, q[1] / np.linalg.norm(q[1]))
    h = vectors.loop_holonomy(q, [0, 1, 2])
    back = vectors.loop_holonomy(q, [0, 2, 1])
    assert h["orthogonality_error"] < 1e-9 and h["angle_max"] == pytest.approx(back["angle_max"])


def test_rotation_between_nearly_opposite_directions_keeps_its_digits():
    a, b = np.array([1.0, 0.0, 0.0]), np.array([-math.cos(1e-3), math.sin(1e-3), 0.0])
    x = np.array([[1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.3, -0.2, 5.0]])
    got = vectors.rotate(a, b, x)
    assert np.allclose(got[0], b, atol=1e-14) and np.allclose(got @ got.T, x @ x.T, atol=1e-13) and got[2, 2] == 5.0
    with pytest.raises(ValueError):
        vectors.rotate(a, -a, x)


def test_basins_keep_the_ends_and_those_without_shoulders(spark):
    rows = [("a", k, v) for k, v in enumerate([1.0, 1.1, 5.0, 9.0, 5.0, 1.0, 1.2])] + [("b", k, 2.0) for k in range(4)] + [("c", 0, None)]
    got = {(r.s, r.centre): r for r in S.persistence_basins(spark.createDataFrame(rows, "s string, t int, v double"), ["s"], "t", "v", 1.5, 0.1, 2).collect()}
    assert (got["a", 1].entry, got["a", 1].exit, got["a", 1].depth) == (1, 2, 4.0) and (got["a", 6].entry, got["a", 6].exit) == (6, 7)
    assert got["b", 2].entry == 1 and got["b", 2].exit == 4 and got["b", 2].depth is None


def test_least_costs_that_do_not_settle_are_an_error(spark):
    arcs = spark.createDataFrame([(1, 2, -1.0), (2, 1, -1.0)], "src long, dst long, cost double")
    with pytest.raises(ValueError, match="still change"):
        graph.shortest_paths(arcs, spark.createDataFrame([(1,)], "node long"), most_rounds=3)


def test_harmonic_fill_solves_a_chain(spark):
    ends = [(k, k + 1, 1.0) for k in range(4)]
    adj = spark.createDataFrame(ends + [(b, a, w) for a, b, w in ends], "src long, dst long, w double")
    nodes = spark.createDataFrame([(k,) for k in range(6)], "node long")
    got = {r.node: r for r in graph.harmonic_fill(adj, spark.createDataFrame([(0, 0.0), (4, 8.0)], "node long, value double"), nodes).collect()}
    assert [got[k].value for k in range(5)] == pytest.approx([0, 2, 4, 6, 8], abs=1e-5) and got[5].confidence == 0 and all(r.converged for r in got.values())


def test_polygons_of_several_parts(spark, tmp_path):
    import json

    ring = [[0, 0], [1, 0], [1, 1], [0, 0]]
    shapes = [{"type": "Polygon", "coordinates": [ring]}, {"type": "MultiPolygon", "coordinates": [[ring], [ring[::-1], ring]]}]
    (tmp_path / "g.json").write_text(json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"id": "a"}, "geometry": g} for g in shapes]}))
    got = readers.read_geojson(spark, str(tmp_path / "g.json")).groupBy("feature", "part").count().orderBy("feature", "part").collect()
    assert [tuple(r) for r in got] == [(0, 0, 4), (1, 0, 4), (1, 1, 4)]


def plain_schedule(edges, cells, weights, fraction, target):
    """Contraction by a fixed fraction, step by step."""
    label = {c: c for c in cells}
    steps = []
    while True:
        groups = {}
        for i, j, values in edges:
            a, b = sorted((label[i], label[j]))
            if a != b:
                groups.setdefault((a, b), []).append(values)
        if not groups:
            return label, steps, "no_relations"
        means = {p: {t: np.mean([v[t] for v in vs if v[t] is not None]) if any(v[t] is not None for v in vs) else None for t in weights} for p, vs in groups.items()}
        cost = dict.fromkeys(means, 0.0)
        for t, w in weights.items():
            x = np.array([m[t] for m in means.values() if m[t] is not None])
            q1, q2, q3 = np.quantile(x, [0.25, 0.5, 0.75])
            mad, sd = np.median(np.abs(x - q2)), x.std()
            scale = None if len(x) < 4 else (q3 - q1) / 1.349 if q3 > q1 else mad * 1.4826 if mad > 0 else sd if sd > 0 else None
            for p, m in means.items():
                if scale and m[t] is not None:
                    cost[p] += w * m[t] / scale
        n = len(set(label.values()))
        cap, used, batch = min(max(1, math.ceil(n * fraction)), n // 2), set(), []
        for p in sorted(cost, key=lambda p: (cost[p], p)):
            if len(batch) < cap and not used & set(p):
                used |= set(p)
                batch.append(p)
        to = {b: a for a, b in batch}
        label = {c: to.get(x, x) for c, x in label.items()}
        steps.append((n, len(batch)))
        if (len(cells) - n + len(batch)) / len(cells) >= target:
            return label, steps, "target"


def test_schedule_equals_plain_contraction(spark):
    r = random.Random(8)
    cells = list(range(24))
    edges = [(i, j, {"a": r.random(), "b": r.random() if r.random() < 0.8 else None}) for i in cells for j in cells if i < j and r.random() < 0.25]
    e = spark.createDataFrame([(i, j, v["a"], v["b"]) for i, j, v in edges], "cell_i long, cell_j long, a double, b double")
    labels = spark.createDataFrame([(c, c) for c in cells], "cell long, node long")
    for fraction, target in ((0.2, 0.6), (0.5, 2.0)):
        want = plain_schedule(edges, cells, {"a": 1.0, "b": 0.5}, fraction, target)
        last, steps, why = hierarchy.run_schedule(e, labels, {"a": 1.0, "b": 0.5}, fraction, target=target)
        assert {x.cell: x.node for x in last.collect()} == want[0] and [(s["nodes_before"], s["merges"]) for s in steps] == want[1] and why == want[2]


def test_evidence_errors_and_edges(spark):
    from cambium.operators import evidence

    a, b = spark.createDataFrame([(1,), (2,)], "x long"), spark.createDataFrame([(5,)], "y long")
    with pytest.raises(Exception, match="different length"):
        evidence.side_by_side(a, b, ["x"], ["y"]).collect()
    twice = spark.createDataFrame([(1, "CERTIFIED", 2.0, 0), (1, "CERTIFIED", 3.0, 0)], "k long, status string, v double, c int")
    with pytest.raises(Exception, match="occurs twice"):
        evidence.certified_values(twice, ["k"], "status", "v", spark.createDataFrame([(0, 1.0)], "c int, residual double"), ["c"]).collect()
    assert evidence.pattern_column(twice.schema, ["^v$"]) == "v" and evidence.pattern_column(twice.schema, ["status"]) is None and evidence.normal_name(" A-b  C ") == "a_b_c"


def test_nearest_neighbours_are_exact(spark):
    r = random.Random(4)
    pts = [("s", k, r.random() * 10, r.random()) for k in range(60)] + [("s", 99, 80.0, 0.0)]
    df = spark.createDataFrame(pts, "s string, id long, x double, y double")
    got = {(p.a, p["rank"]): p.b for p in joins.nearest_neighbours(df, ["s"], "id", "x", "y", 3, 0.5).collect()}
    for _, a, x, y in pts:
        order = sorted((math.hypot(x - u, y - v), b) for _, b, u, v in pts if b != a)
        assert [got[a, k] for k in (1, 2, 3)] == [b for _, b in order[:3]]


def test_null_gate_is_not_met_and_missing_stays_missing(spark):
    df = spark.createDataFrame([(None,), (1.0,), (float("nan"),)], "v double")
    from cambium.operators.filters import conjunctive_gate

    got = conjunctive_gate(X.finite_columns(df), {"p": F.col("v") > 0}).collect()
    assert [(r.v, r.admissible) for r in got] == [(None, False), (1.0, True), (None, False)]


def test_stream_detector_equals_batch(spark, tmp_path):
    kinds = ["WARMUP", "LOW_FLOW", "LOW_FLOW", "UNRESOLVED", "LOW_FLOW", "REGULAR", "LOW_FLOW", "LOW_FLOW", "LOW_FLOW", "LOW_FLOW", "LOW_FLOW", "REGULAR"]
    rows = [("a", k, c) for k, c in enumerate(kinds)]
    df = spark.createDataFrame(rows, "s string, t long, class string")
    batch = [r.decision for r in detectors.detect(df, ["s"], "t").orderBy("t").collect()]
    assert batch == ["CONTINUE"] * 8 + ["ENTER_CONFIRMATION", "CONFIRMING", "STOP_CONFIRMED", "STOPPED"]
    for k in range(3):
        df.where((F.col("t") >= 4 * k) & (F.col("t") < 4 * k + 4)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    src = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = detectors.detect_stream(src, "s", "t").writeStream.format("memory").queryName("said").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert [r.decision for r in spark.table("said").orderBy("t").collect()] == batch


def test_ledger_resume_and_stream_replay(spark, tmp_path):
    led = sinks.Ledger(spark, str(tmp_path / "ledger"), "s1")
    assert led.latest() is None
    labels = spark.createDataFrame([(k, k) for k in range(6)], "cell long, node long")
    for step, (a, b) in enumerate([(0, 1), (2, 3), (0, 2)]):
        m = spark.createDataFrame([(step, a, b)], "microstep int, survivor long, removed long")
        led.step({"step": step}, m)
        m.coalesce(1).write.mode("append").parquet(str(tmp_path / "shards"))
    led.checkpoint(2, hierarchy.replay(labels, led.merges()))
    step, saved = led.latest()
    assert step == 2 and sorted(r.node for r in saved.collect()) == [0, 0, 0, 0, 4, 5]
    end = replay_stream(spark, str(tmp_path / "shards"), "microstep int, survivor long, removed long", labels, str(tmp_path / "replay"))
    assert sorted(r.node for r in end.collect()) == [0, 0, 0, 0, 4, 5]


def test_digest_ignores_order_and_sees_changes(spark):
    a = spark.createDataFrame([(1, "x"), (2, None)], "k long, v string")
    b = spark.createDataFrame([(2, None), (1, "x")], "k long, v string")
    c = spark.createDataFrame([(2, ""), (1, "x")], "k long, v string")
    d = [sinks.table_digest(t).first().digest for t in (a, b, c)]
    assert d[0] == d[1] != d[2]


def test_readers(spark, tmp_path):
    (tmp_path / "a.gmt").write_text("S1\td\tb\tA\nS2\td\nS3\td\tc\n")
    assert sorted(tuple(r) for r in readers.read_gene_sets(spark, str(tmp_path / "a.gmt")).collect()) == [("S1", "A"), ("S1", "B"), ("S3", "C")]
    (tmp_path / "a.tsv").write_text("x\ty\n1\tNaN\n")
    assert tuple(readers.read_any(spark, str(tmp_path / "a.tsv"), "x long, y double").first()) == (1, None)
    with pytest.raises(FileNotFoundError):
        readers.exactly_one(spark, str(tmp_path / "a.*"))
    assert readers.specimen_of("/data/Brain-healthy/x", {"hb": ["brain", "healthy"]}) == "hb"
    lines = [r.line for r in sinks.graph_text(spark.createDataFrame([(1, "a<b")], "id long, label string"), spark.createDataFrame([], "src long, dst long")).collect()]
    assert "a&lt;b" in lines[2]


def test_flags(spark):
    r = spark.range(1).select(audits.flags(geometry=F.lit(True), tension=F.lit(None).cast("boolean"), cell_cell=F.lit(True)).alias("f")).first()
    assert r.f == audits.GEOMETRY + audits.CELL_CELL
