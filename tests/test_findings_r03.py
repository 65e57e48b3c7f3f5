"""What the third review found, each by a case that failed before."""

import random
import statistics

from pyspark.sql import functions as F

from cambium.operators import aggregates, graph, hierarchy, interfaces, joins


def test_matched_candidates_of_equal_values_are_the_least_ids(spark):
    """rows below of one value were cut from the least id on."""
    rng = random.Random(3)
    rows = [(i, i % 2, float(rng.randrange(6)), i % 3 == 0) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, g int, x double, own boolean")
    got = {(r.id, r["rank"]): r.match for r in joins.matched_candidates(df.where("own"), df.where("not own"), ["g"], "x", "id", 3).collect()}
    want = {}
    for i, g, x, own in rows:
        near = sorted((abs(x - v), m) for m, h, v, o in rows if h == g and not o)
        want |= {(i, k + 1): m for k, (_, m) in enumerate(near[:3]) if own}
    assert got == want


def test_matched_candidates_of_one_table_leave_out_the_row_itself(spark):
    df = spark.createDataFrame([(i, 1, 5.0) for i in range(6)] + [(9, 1, None)], "id long, g int, x double")
    got = joins.matched_candidates(df, df, ["g"], "x", "id", 2).groupBy("id").agg(F.sort_array(F.collect_list("match")).alias("m")).collect()
    assert {r.id: r.m for r in got} == {i: [k for k in range(6) if k != i][:2] for i in range(6)}


def cloud(rng):
    """Points of uneven density: copies of one place, a tight cluster, a lattice with equal distances, two far away."""
    pts = [(0.5, 0.5)] * 30 + [(1 + rng.random() * 1e-6, 2.0) for _ in range(40)] + [(float(a % 6), float(a // 6)) for a in range(36)] + [(90.0, 0.0), (90.0, 7.0)]
    return [("s", i, *p) for i, p in enumerate(pts)] + [("t", 200, 0.0, 0.0), ("t", 201, 4.0, 4.0)]


def test_nearest_neighbours_of_copies_and_clusters(spark):
    rows = cloud(random.Random(5))
    df = spark.createDataFrame(rows, "s string, id long, x double, y double")
    for k in (1, 4):
        got = {(r.a, r["rank"]): (r.b, r.distance) for r in joins.nearest_neighbours(df, ["s"], "id", "x", "y", k, 0.5).collect()}
        want = {}
        for s, a, x, y in rows:
            near = sorted((((x - u) ** 2 + (y - v) ** 2) ** 0.5, b) for g, b, u, v in rows if g == s and b != a)
            want |= {(a, n + 1): (b, d) for n, (d, b) in enumerate(near[:k])}
        assert got == want


def test_nearest_neighbours_form_few_pairs_in_dense_places(spark, monkeypatch):
    """Cells of one width held all points of a dense place, so pairs grew with the square of the points."""
    rng, sizes = random.Random(6), {}
    kept = joins.written
    for n in (500, 2000):
        made = []
        monkeypatch.setattr(joins, "written", lambda df, tag, made=made: made.append((tag, kept(df, tag))) or made[-1][1])
        df = spark.createDataFrame([(0, i, rng.random(), rng.random()) for i in range(n)], "g int, id long, x double, y double")
        joins.nearest_neighbours(df, ["g"], "id", "x", "y", 4, 10.0)
        rows = [d for t, d in made if t == "levels"]
        cells = rows[0].select(F.floor(F.col("_tx") * F.pow(F.lit(2.0), "best")).alias("a"), F.floor(F.col("_ty") * F.pow(F.lit(2.0), "best")).alias("b"), "best").groupBy("a", "b", "best").count()
        sizes[n] = cells.agg(F.max("count")).first()[0]
    assert max(sizes.values()) <= 40


def test_counts_within_ranges_form_no_pairs_of_copies(spark):
    """all copies of a size were paired with all copies of a range."""
    points = spark.createDataFrame([(k % 7,) for k in range(700)], "v int")
    spans = spark.createDataFrame([(k, k % 5, k % 5 + k % 3) for k in range(300)] + [(900, 50, 60)], "s int, lo int, hi int")
    got = joins.count_within_range(points, spans, [], "s", "v", "lo", "hi", 2.0)
    assert {r.s: r.n for r in got.collect()} == {k: 100 * sum(k % 5 <= v <= k % 5 + k % 3 for v in range(7)) for k in range(300)}
    text = got._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("Aggregate") >= 4


def test_nearest_reads_no_frame_anew_for_each_row(spark):
    """the frame to the group's end was read again for every row, so time grew with the square of a group."""
    rng = random.Random(8)
    left = [(i, i % 2, None if i == 5 else float(rng.randrange(40))) for i in range(60)]
    right = [(i, i % 2, float(rng.randrange(40))) for i in range(25)]
    got = joins.nearest(spark.createDataFrame(left, "a int, g int, x double"), spark.createDataFrame(right, "b int, g int, y double"), ["g"], "x", "y", [F.asc("b")])
    want = {a: min((abs(x - y), y, b) for b, h, y in right if h == g)[2] for a, g, x in left if x is not None}
    assert {r.a: r.r_b for r in got.collect() if r.x is not None} == want
    assert "unboundedfollowing" not in got._jdf.queryExecution().optimizedPlan().toString().lower()


def test_calibration_takes_distances_of_pairs_that_meet(spark, monkeypatch):
    """Distances were taken inside the join of tiles, for every pair of a tile."""
    seen = []
    kept = interfaces.written
    monkeypatch.setattr(interfaces, "written", lambda df, tag: seen.append(tag) or kept(df, tag))
    square = lambda i, x: (i, [(x, 0.0), (x + 1, 0.0), (x + 1, 1.0), (x, 1.0)])
    cells = spark.createDataFrame([square(0, 0.0), square(1, 1.0), square(2, 2.1)], "cell long, points array<struct<x: double, y: double>>")
    got = {(r.epsilon, r.cell_i, r.cell_j): (round(r.support, 6), r.present) for r in interfaces.calibrated(cells, [0.0, 0.2])[1].collect()}
    assert seen.index("met") < seen.index("pairs")
    assert got[0.0, 0, 1] == (1.0, True) and got[0.0, 1, 2] == (0.0, False) and got[0.2, 1, 2][1]


def test_contacts_and_relations_are_formed_once(spark):
    """The gates read the lines anew each time, and pairs of suppliers went through a join in few tasks."""
    from cambium.plans.bindings import contacts
    from cambium.plans.table_queries import gated

    sf = "/root/testdata/sf0.001"
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "l_partkey" not in plan(gated(spark, sf))
    assert "Join" not in plan(contacts(spark, sf))


def test_relation_summary_holds_no_pair_in_one_task(spark):
    rng = random.Random(9)
    rows = [(i % 3, 5 + i % 2, rng.randrange(50) / 8 if i % 5 else None, float(rng.randrange(9))) for i in range(200)] + [(8, 9, None, 1.0)]
    df = spark.createDataFrame(rows, "super_i long, super_j long, t double, p double")
    out = aggregates.relation_summary(df, ["t", "p"], F.col("t").isNotNull())
    assert "percentile" not in out._jdf.queryExecution().optimizedPlan().toString()
    for r in out.collect():
        own = [(t, p) for i, j, t, p in rows if (i, j) == (r.super_i, r.super_j)]
        whole = [(t, p) for t, p in own if t is not None]
        want = tuple(statistics.median(v) for v in zip(*whole, strict=True)) if whole else (None, None)
        assert (r.n_boundary_edges, r.t, r.p, r.support_fraction) == (len(own), *want, len(whole) / len(own))


def test_component_summary_holds_no_component_in_one_task(spark):
    """seven groups held the values of all contacts."""
    from cambium.plans.registry import QUERIES

    df = QUERIES["ag21_component_summary"](spark, "/root/testdata/sf0.001")
    assert df.count() == 7 and "percentile" not in df._jdf.queryExecution().optimizedPlan().toString()


def jobs(spark, run):
    """Stages that ``run`` takes."""
    store = spark.sparkContext._jsc.sc().statusTracker()
    group = f"jobs-{random.random()}"
    spark.sparkContext.setJobGroup(group, group)
    run()
    spark.sparkContext._jsc.clearJobGroup()
    return len(store.getJobIdsForGroup(group))


def test_small_searches_end_in_one_task(spark):
    """Each round of a search was several jobs, however few edges were left."""
    rng = random.Random(11)
    rows = sorted({(min(a, b), max(a, b), rng.randrange(6) / 4) for a, b in ((rng.randrange(300), rng.randrange(300)) for _ in range(330)) if a != b})
    rows = list({(a, b): (a, b, d) for a, b, d in rows}.values())
    edges = spark.createDataFrame(rows, "i long, j long, distance double")
    nodes = spark.createDataFrame([(k,) for k in range(295)], "node long")
    plain = lambda df: sorted(map(tuple, df.collect()))
    assert plain(graph.components(edges, nodes)) == plain(graph.components(edges, nodes, few=0))
    pairs = edges.select(F.col("i").alias("a"), F.col("j").alias("b"), "distance")
    up, want = list(range(300)), []
    top = lambda v: v if up[v] == v else top(up[v])
    for a, b, d in sorted(rows, key=lambda r: (r[2], r[0], r[1])):
        if top(a) != top(b):
            up[top(a)] = top(b)
            want.append((a, b, d))
    for few in (200, None):
        assert plain(interfaces.spanning_forest(pairs, few)) == sorted(want)
    spots = nodes.select("node", (F.col("node") % 17 * 1.0).alias("x"), (F.col("node") % 23 * 1.0).alias("y"))
    for target in (1, 30):
        assert plain(graph.grow_region(edges, spots, target)) == plain(graph.grow_region(edges, spots, target, few=0))
    assert jobs(spark, lambda: interfaces.spanning_forest(pairs).collect()) <= 8


def test_schedule_reads_all_edges_once(spark, monkeypatch):
    """each step relabelled and averaged all edges anew."""
    calls, kept = [], joins.relabel_edges
    monkeypatch.setattr(hierarchy.joins, "relabel_edges", lambda *a: calls.append(1) or kept(*a))
    edges = spark.createDataFrame([(k, k + 1, float(k % 3 + 1)) for k in range(9)], "cell_i long, cell_j long, t double")
    labels, steps, why = hierarchy.run_schedule(edges, spark.createDataFrame([(k, k) for k in range(10)], "cell long, node long"), {"t": 1.0}, 0.5)
    assert len(steps) > 1 and why == "no_relations" and len(calls) == 1 and {r.node for r in labels.collect()} == {0}


def test_scale_of_many_rows_goes_by_counts(spark, monkeypatch):
    df = spark.createDataFrame([(float(k * k % 101),) for k in range(60)] + [(None,)], "v double")
    want = aggregates.centre_and_scale(df, [], "v").first()
    monkeypatch.setattr(aggregates, "FEW_VALUES", 0)
    got = aggregates.centre_and_scale(df, [], "v")
    assert "percentile" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert [round(v, 9) for v in got.first()] == [round(v, 9) for v in want]
