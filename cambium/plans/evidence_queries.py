"""Queries over summaries of evidence, look-ups, selections and landmarks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cambium.operators import evidence as V
from cambium.operators import filters, graph, hierarchy, joins, landmarks, partitions
from cambium.operators import series as S
from cambium.plans.bindings import CONTACTS, LABELS, MASSES, MERGES, MESH, POINTS, SERIES, cells, contacts, masses, merges, mesh, points, series
from cambium.plans.registry import query
from cambium.plans.series_queries import BASINS, KEYS, r6, rounded
from cambium.plans.table_queries import ROOTS, SUPER, TRI, sql, start, supers
from cambium.scratch import written
from cambium.sources.tables import table

ONE = "one AS (SELECT 1)"


@query("ag02_relation_means", sql(f"SELECT least(a.node, b.node) AS super_i, greatest(a.node, b.node) AS super_j, {r6('avg(n)')} AS n, {r6('avg(tension)')} AS tension, {r6('avg(pressure)')} AS pressure, count(*) AS n_level0_edges FROM contacts JOIN cells a ON a.cell = i JOIN cells b ON b.cell = j WHERE a.node <> b.node GROUP BY 1, 2", CONTACTS, LABELS))
def means(spark: SparkSession, sf: str) -> DataFrame:
    e = joins.relabel_edges(contacts(spark, sf), cells(spark, sf).select("cell", "node"), "i", "j")
    return rounded(V.relation_means(e, ["n", "tension", "pressure", "gap_guard_ratio"]))


@query("ag05_observed_means", sql(f"SELECT c_nationkey, {r6('avg(CASE WHEN c_custkey % 3 = 0 THEN c_acctbal END)')} AS c_acctbal, {r6('avg(CASE WHEN c_acctbal < 0 THEN c_custkey END)')} AS c_custkey FROM customer GROUP BY c_nationkey", ONE))
def observed(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(V.observed_means(table(spark, sf, "customer"), ["c_nationkey"], {"c_acctbal": F.col("c_custkey") % 3 == 0, "c_custkey": F.col("c_acctbal") < 0}))


LOOPS = f"""lp AS (SELECT u, v, w, (u + v + w) % 3 > 0 AS resolved, (u + v) % 2 = 0 AS directional, w % 5 > 0 AS defined, (u % 7) / 7.0 AS angle, 1.0 + v % 4 AS area FROM ({TRI})),
ex AS (SELECT unnest([u, v, w]) AS cell, * FROM lp),
inc AS (SELECT cell, count(*) FILTER (resolved) AS rl, count(*) FILTER (directional) AS dl, count(*) FILTER (defined) AS fl, sum(angle) FILTER (directional AND defined) AS an, sum(area) FILTER (directional AND defined) AS ar, sum(angle / area) FILTER (directional AND defined) AS de, max(angle / area) FILTER (directional AND defined) AS dm FROM ex GROUP BY cell)"""


@query("ag20_loop_incidence", sql(f"""SELECT id AS cell, coalesce(rl, 0) AS resolved_loops, coalesce(dl, 0) AS directional_loops, coalesce(fl, 0) AS defined_loops, {r6('coalesce(an, 0)')} AS angle_sum, {r6('coalesce(ar, 0)')} AS area_sum, {r6('coalesce(de, 0)')} AS density_sum,
  {r6('CASE WHEN dl > 0 THEN coalesce(dm, 0) END')} AS density_max, {r6('CASE WHEN rl > 0 THEN dl / rl ELSE 0 END')} AS directional_fraction, {r6('CASE WHEN dl > 0 THEN coalesce(de, 0) / dl END')} AS mean_density, {r6('CASE WHEN ar > 0 THEN an / ar END')} AS area_weighted_density
  FROM points LEFT JOIN inc ON cell = id""", POINTS, MESH, LOOPS))  # fmt: skip
def incidence(spark: SparkSession, sf: str) -> DataFrame:
    u, v, w = F.col("u"), F.col("v"), F.col("w")
    t = graph.triangles(mesh(spark, sf).select("i", "j"))
    t = t.select(F.array("u", "v", "w").alias("nodes"), ((u + v + w) % 3 > 0).alias("resolved"), ((u + v) % 2 == 0).alias("directional"), (w % 5 > 0).alias("defined"), ((u % 7) / 7.0).alias("angle"), (1.0 + v % 4).alias("area"))
    return rounded(V.loop_incidence(t.withColumn("density", F.col("angle") / F.col("area")), points(spark, sf).select(F.col("id").alias("cell"))))


STATUS = "CASE l_returnflag WHEN 'R' THEN 'OBSERVABLE' WHEN 'A' THEN 'NUMERICALLY_MARGINAL' ELSE 'UNRESOLVED' END"


@query("ag22_evidence_status", sql(f"SELECT l_orderkey, count(*) AS occurrences, count(*) FILTER (s = 'OBSERVABLE') AS certified, count(*) FILTER (s = 'NUMERICALLY_MARGINAL') AS marginal, {r6('min(l_discount)')} AS best_residual, {r6('quantile_cont(l_discount, 0.5)')} AS median_residual, CASE WHEN count(*) FILTER (s = 'OBSERVABLE') >= 2 THEN 'ROBUST_OBSERVABLE' WHEN count(*) FILTER (s = 'OBSERVABLE') = 1 THEN 'LOCAL_OBSERVABLE' WHEN count(*) FILTER (s = 'NUMERICALLY_MARGINAL') > 0 THEN 'NUMERICALLY_MARGINAL' ELSE 'UNRESOLVED' END AS status FROM (SELECT *, {STATUS} AS s FROM lineitem) GROUP BY l_orderkey", ONE))
def status(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(V.evidence_status(table(spark, sf, "lineitem").withColumn("s", F.expr(STATUS)), ["l_orderkey"], "s", "l_discount"))


@query("ag23_first_and_size", sql("SELECT l_orderkey, l_returnflag, arg_min(l_suppkey, (l_linenumber, l_partkey, l_suppkey)) AS l_suppkey, count(*) AS size FROM lineitem GROUP BY ALL", ONE))
def first_size(spark: SparkSession, sf: str) -> DataFrame:
    return V.first_and_size(table(spark, sf, "lineitem"), ["l_orderkey", "l_returnflag"], ["l_suppkey"], ["l_linenumber", "l_partkey", "l_suppkey"])


@query("ag32_patch_summary", sql(f"SELECT p_brand, count(*) AS patches, {r6('avg(CASE WHEN p_size = 1 THEN 1.0 ELSE 0.0 END)')} AS identifiable, quantile_cont(p_size - 1, 0.5) AS median_nullity, {r6('quantile_cont(p_size - 1, 0.9)')} AS q90_nullity, {r6('sum(p_retailprice * p_size) / sum(p_size)')} AS mean_p_retailprice, {r6('avg(CASE WHEN p_size - 1 > 20 THEN 1.0 ELSE 0.0 END)')} AS tail_20, {r6('avg(CASE WHEN p_size - 1 > 40 THEN 1.0 ELSE 0.0 END)')} AS tail_40 FROM part GROUP BY p_brand", ONE))
def patches(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").withColumn("nullity", F.col("p_size") - 1)
    return rounded(V.patch_summary(p, ["p_brand"], "nullity", [("p_retailprice", "p_size")], (20, 40)))


@query("sc17_quadrants", sql("SELECT c_custkey, CASE WHEN c_custkey % 11 = 0 THEN 'unresolved' ELSE concat(CASE WHEN c_acctbal >= mq THEN 'large' ELSE 'small' END, '_', CASE WHEN h >= hq THEN 'heterogeneous' ELSE 'coherent' END, '_candidate') END AS quadrant FROM k JOIN (SELECT c_nationkey, quantile_cont(c_acctbal, 0.8) AS mq, quantile_cont(h, 0.5) AS hq FROM k GROUP BY ALL) USING (c_nationkey)",
  "k AS (SELECT *, CASE WHEN c_custkey % 11 <> 0 THEN c_custkey % 97 END AS h FROM customer)"))
def quadrant(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").withColumn("h", F.when(F.col("c_custkey") % 11 != 0, F.col("c_custkey") % 97))
    return V.quadrants(c, ["c_nationkey"], "c_acctbal", "h", 0.8, 0.5).select("c_custkey", "quadrant")


@query("so10_best_source", sql(f"SELECT event_type, source, n_u, count(*) AS rows, {r6('avg(value)')} AS mean FROM e JOIN (SELECT event_type, source, n_u FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY n_u DESC, source) AS k FROM (SELECT event_type, source, count(DISTINCT u) AS n_u FROM e GROUP BY ALL)) WHERE k = 1) USING (event_type, source) GROUP BY ALL",
  "e AS (SELECT *, user_id % 7 AS source, user_id // 7 AS u FROM events)"))
def sources(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").withColumns({"source": F.col("user_id") % 7, "u": F.floor(F.col("user_id") / 7)})
    return rounded(V.best_source(e, ["event_type"], ["source"], "u").groupBy("event_type", "source", "n_u").agg(F.count("*").alias("rows"), F.avg("value").alias("mean")))


@query("jn05_confusion", sql("SELECT a.l_linestatus AS class_a, b.l_returnflag AS class_b, count(*) AS n FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber AND a.l_partkey = b.l_partkey GROUP BY ALL", ONE))
def confused(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    return V.confusion(li, li, ["l_orderkey", "l_linenumber", "l_partkey"], "l_linestatus", "l_returnflag")


LOOK = """lm AS (SELECT c_custkey AS "index", c_custkey % 400 AS nodes, c_acctbal / 1000 AS removed, c_custkey / 64.0 AS ell FROM customer),
tb AS (SELECT CASE WHEN k % 4 = 0 THEN k END AS "index", CASE WHEN k % 4 = 1 THEN k % 400 END AS nodes, CASE WHEN k % 4 IN (1, 2) THEN c_acctbal / 1000 END AS removed, CASE WHEN k % 4 = 3 THEN k / 64.0 END AS ell, k AS value FROM (SELECT *, c_custkey AS k FROM customer)),
sm AS (SELECT nodes, count(*) AS same FROM tb WHERE nodes IS NOT NULL GROUP BY nodes),
got AS (
  SELECT l."index", value, 1 AS tier, 0.0 AS gap, 'index' AS how FROM lm l JOIN tb t ON t."index" = l."index"
  UNION ALL SELECT l."index", value, 2, coalesce(abs(l.removed - t.removed), 0), CASE WHEN same = 1 THEN 'nodes' ELSE 'nodes_removed' END FROM lm l JOIN tb t ON t.nodes = l.nodes JOIN sm ON sm.nodes = t.nodes WHERE same = 1 OR abs(l.removed - t.removed) <= 1e-6
  UNION ALL SELECT l."index", value, 3, abs(l.removed - t.removed), 'removed' FROM lm l JOIN tb t ON abs(l.removed - t.removed) <= 1e-6
  UNION ALL SELECT l."index", value, 4, abs(l.ell - t.ell), 'ell' FROM lm l JOIN tb t ON abs(l.ell - t.ell) <= 1e-6)"""


@query("jn08_exact_lookup", sql('SELECT l."index", value, how FROM lm l LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY "index" ORDER BY tier, gap, value) AS k FROM got) g ON g."index" = l."index" AND k = 1', LOOK))
def lookup(spark: SparkSession, sf: str) -> DataFrame:
    k, c = F.col("c_custkey"), table(spark, sf, "customer")
    lm = c.select(k.alias("index"), (k % 400).alias("nodes"), (F.col("c_acctbal") / 1000).alias("removed"), (k / 64.0).alias("ell"))
    removed = F.when((k % 4).isin(1, 2), F.col("c_acctbal") / 1000)
    tb = c.select(F.when(k % 4 == 0, k).alias("index"), F.when(k % 4 == 1, k % 400).alias("nodes"), removed.alias("removed"), F.when(k % 4 == 3, k / 64.0).alias("ell"), k.alias("value"))
    return V.exact_lookup(lm, tb, "index", "value", 1e-6).select("index", F.col("t_value").alias("value"), "how")


@query("jn18_side_by_side", sql("SELECT position, a.c_custkey, b.c_custkey AS other FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal, c_custkey) AS position FROM customer) a JOIN (SELECT c_custkey, row_number() OVER (ORDER BY c_name) AS position FROM customer) b USING (position)", ONE))
def aligned(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer")
    a, b = c.select("c_custkey", "c_acctbal"), c.select(F.col("c_custkey").alias("other"), "c_name")
    return V.side_by_side(a, b, ["c_acctbal", "c_custkey"], ["c_name"]).select("position", "c_custkey", "other")


EFFECTIVE = "ef AS (SELECT super_i, super_j, 1.0 / shared AS molecular_distance, support_fraction AS mechanics_support_fraction, tension / 1000 AS abs_tension_z, pressure AS abs_delta_p_z, ln(1 + shared) AS comm_strength, (super_i * 7 + super_j) % 10 / 10.0 AS comm_reciprocity, shared >= 20 AS comm_supported, shared::DOUBLE AS comm_support FROM super)"
LIMITS = {"molecular": 0.05, "support_fraction": 0.25, "tension_z": 4.0, "delta_p_z": 0.02, "strength": 2.0, "reciprocity": 0.3}
_BASE = "coalesce(molecular_distance <= 0.05, false) AND coalesce(mechanics_support_fraction >= 0.25, false) AND coalesce(abs_tension_z <= 4.0, false) AND coalesce(abs_delta_p_z <= 0.02, false)"
_MARGIN = "(0.05 - molecular_distance) / (0.05 + 1e-12), (4.0 - abs_tension_z) / (4.0 + 1e-12), (0.02 - abs_delta_p_z) / (0.02 + 1e-12), mechanics_support_fraction - 0.25"
_LAST = {
    "strength": ("comm_strength >= 2.0 AND comm_reciprocity >= 0.3", "(comm_strength - 2.0) / 3.0, comm_reciprocity - 0.3"),
    "support": ("comm_supported AND comm_reciprocity >= 0.3", "CASE WHEN comm_supported THEN ln(1 + comm_support) ELSE -1.0 END, CASE WHEN comm_supported THEN comm_reciprocity - 0.3 ELSE -1.0 END"),
    "open": ("comm_supported", "CASE WHEN comm_supported THEN ln(1 + comm_support) ELSE -1.0 END"),
}
_VARIANTS = " UNION ALL ".join(f"SELECT super_i, super_j, '{n}' AS version, {_BASE} AND {g} AS admissible, {r6(f'list_avg([{_MARGIN}, {m}])')} AS ordering_merit FROM ef" for n, (g, m) in _LAST.items())


@query("flt02_effective_gates", sql(_VARIANTS, CONTACTS, LABELS, SUPER, EFFECTIVE))
def effective(spark: SparkSession, sf: str) -> DataFrame:
    s, n = supers(spark, sf), F.col("shared")
    e = s.select(
        "super_i", "super_j", (1.0 / n).alias("molecular_distance"), F.col("support_fraction").alias("mechanics_support_fraction"), (F.col("tension") / 1000).alias("abs_tension_z"), F.col("pressure").alias("abs_delta_p_z"),
        F.log1p(n).alias("comm_strength"), ((F.col("super_i") * 7 + F.col("super_j")) % 10 / 10.0).alias("comm_reciprocity"), (n >= 20).alias("comm_supported"), n.cast("double").alias("comm_support"),
    )
    versions = [filters.effective_gates(e, LIMITS, v).select("super_i", "super_j", F.lit(v).alias("version"), "admissible", "ordering_merit") for v in _LAST]
    return rounded(reduce(DataFrame.unionByName, versions))


@query("flt07_typed_rows", sql("SELECT p_partkey, src FROM rs WHERE trim(coalesce(sender, '')) <> '' AND src NOT IN (SELECT src FROM rs WHERE trim(coalesce(sender, '')) <> '' AND kind NOT IN ('contact', 'diffusible'))",
  "rs AS (SELECT p_partkey, p_size AS src, CASE WHEN p_partkey % 13 = 0 THEN ' ' ELSE p_brand END AS sender, CASE WHEN p_partkey % 89 = 0 THEN 'unknown' WHEN p_partkey % 2 = 0 THEN 'contact' ELSE 'diffusible' END AS kind FROM part)"))
def typed(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    kind = F.when(k % 89 == 0, "unknown").when(k % 2 == 0, "contact").otherwise("diffusible")
    rows = table(spark, sf, "part").select("p_partkey", F.col("p_size").alias("src"), F.when(k % 13 == 0, " ").otherwise(F.col("p_brand")).alias("sender"), F.col("p_type").alias("receiver"), kind.alias("kind"))
    return V.typed_rows(rows, "src", "sender", "receiver", "kind").select("p_partkey", "src")


@query("ts08_mean_contrast", sql(f"SELECT feature, {r6('effect')} AS effect FROM (SELECT feature, avg(l) FILTER (sample = 1) - avg(l) FILTER (sample = 0) AS effect FROM lg GROUP BY feature) ORDER BY abs(effect) DESC, feature LIMIT 12", POINTS,
  "lv AS (SELECT id, sample, unnest(range(0, 64)) AS feature, unnest(state) AS x FROM points)", "lx AS (SELECT id, sample, feature, greatest(x, 0.0) AS value FROM lv)",
  "lg AS (SELECT x.sample, feature, ln(1 + value / CASE WHEN s > 0 THEN s ELSE 1 END * 10000) AS l FROM lx x JOIN (SELECT id, sum(value) AS s FROM lx GROUP BY id) USING (id))"))
def contrast(spark: SparkSession, sf: str) -> DataFrame:
    p = points(spark, sf)
    long = p.select(F.col("id").alias("cell"), F.posexplode("state").alias("feature", "x")).select("cell", F.col("feature").cast("long").alias("feature"), F.greatest(F.lit(0.0), "x").alias("value"))
    return rounded(V.mean_contrast(long, p.where("sample = 0").select(F.col("id").alias("cell")), p.where("sample = 1").select(F.col("id").alias("cell")), 12))


#: A cell's node at a checkpoint: its ledger is followed as far as the checkpoint.
SNAP = """ck AS (SELECT unnest([3, 6, 9]) AS checkpoint),
cb(checkpoint, cell, node) AS (SELECT checkpoint, c_custkey, c_custkey FROM ck, customer UNION ALL SELECT b.checkpoint, b.cell, l.survivor FROM cb b JOIN ledger l ON l.removed = b.node AND l.microstep <= b.checkpoint),
sn AS (SELECT checkpoint, cell, min(node) AS node FROM cb GROUP BY ALL),
tm AS (SELECT node, count(*) AS mass FROM replayed GROUP BY node ORDER BY mass DESC, node LIMIT 6)"""


@query("hi23_precursors", sql("SELECT r.node AS terminal, mass, checkpoint, count(DISTINCT s.node) AS precursors FROM sn s JOIN replayed r USING (cell) JOIN tm ON tm.node = r.node GROUP BY ALL", MERGES, ROOTS, SNAP))
def earlier(spark: SparkSession, sf: str) -> DataFrame:
    at, ledger = start(spark, sf), merges(spark, sf)
    snaps = reduce(DataFrame.unionByName, [hierarchy.replay(at, ledger, k).withColumn("checkpoint", F.lit(k)) for k in (3, 6, 9)])
    return V.precursors(snaps, hierarchy.replay(at, ledger), 6)


_METHODS = {"shared": "shared DESC", "tension": "tension ASC", "edges": "n_boundary_edges DESC"}
_PICKED = " UNION ALL ".join(f"SELECT * FROM (SELECT '{m}' AS method, super_i * 1000 + super_j AS k, support_fraction >= 0.5 AS ok FROM super ORDER BY {o} NULLS LAST, k LIMIT 40)" for m, o in _METHODS.items())


@query("hi26_selection_audit", sql(f"SELECT method, count(*) AS selected, {r6('avg(CASE WHEN ok THEN 1.0 ELSE 0.0 END)')} AS admissible_share, {r6('count(*) FILTER (k IN (SELECT k FROM pd WHERE method = $$shared$$)) / (count(*) + 40 - count(*) FILTER (k IN (SELECT k FROM pd WHERE method = $$shared$$)))')} AS jaccard FROM pd GROUP BY method", CONTACTS, LABELS, SUPER, f"pd AS ({_PICKED})"))
def audit(spark: SparkSession, sf: str) -> DataFrame:
    s = supers(spark, sf).select((F.col("super_i") * 1000 + F.col("super_j")).alias("k"), "shared", "tension", "n_boundary_edges", (F.col("support_fraction") >= 0.5).alias("ok"))
    how = {"shared": F.desc_nulls_last("shared"), "tension": F.asc_nulls_last("tension"), "edges": F.desc_nulls_last("n_boundary_edges")}
    return rounded(V.selection_audit(s, "k", how, "shared", "ok", 40))


@query("me07_certified_values", sql(f"SELECT i, j, {r6('tension')} AS tension, m.residual FROM contacts JOIN (SELECT k, 10.0 * k AS residual FROM (SELECT unnest(range(0, 5)) AS k)) m ON m.k = (i + j) % 7 WHERE tension IS NOT NULL UNION ALL SELECT i, j, {r6('tension')}, NULL FROM contacts WHERE tension IS NOT NULL AND (i + j) % 7 >= 5", CONTACTS))
def certified(spark: SparkSession, sf: str) -> DataFrame:
    c = contacts(spark, sf).withColumns({"status": F.when(F.col("tension").isNotNull(), "CERTIFIED").otherwise("UNRESOLVED"), "k": ((F.col("i") + F.col("j")) % 7).cast("long")})
    residuals = spark.range(5).select(F.col("id").alias("k"), (F.col("id") * 10.0).alias("residual"))
    return rounded(V.certified_values(c, ["i", "j"], "status", "tension", residuals, ["k"]).select("i", "j", "tension", "residual"))


@query("ts14_relative_convergence", sql(f"SELECT sample, count(*) AS resolutions, {r6('max(c)')} AS largest_change, {r6('arg_max(c, mass)')} AS last_change FROM (SELECT sample, mass, abs(v - lag(v) OVER (PARTITION BY sample ORDER BY mass)) / greatest(abs(last_value(v) OVER (PARTITION BY sample ORDER BY mass ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)), 1e-12) AS c FROM (SELECT sample, mass, count(*)::DOUBLE AS v FROM objects GROUP BY ALL)) GROUP BY sample", MASSES))
def converged(spark: SparkSession, sf: str) -> DataFrame:
    m = masses(spark, sf).groupBy("sample", "mass").agg(F.count("*").cast("double").alias("v"))
    return rounded(V.relative_convergence(m, ["sample"], "mass", "v"))


@query("prj06_pattern_column", "SELECT 'l_extendedprice' AS price, CAST(NULL AS VARCHAR) AS missing, 'l_orderkey' AS \"key\"")
def found(spark: SparkSession, sf: str) -> DataFrame:
    schema = table(spark, sf, "lineitem").schema
    row = (V.pattern_column(schema, [r"(^|_)extended_?price$"]), V.pattern_column(schema, [r"returnflag", r"volume"]), V.pattern_column(schema, [r"key$"]))
    return spark.createDataFrame([row], "price string, missing string, key string")


MARKS = f"""bz AS (SELECT sample, centre, entry, "exit", CAST("exit" - entry + 1 AS DOUBLE) AS width, CAST("exit" - entry AS DOUBLE) AS lifetime, depth, CASE WHEN centre % 9 > 0 THEN (centre % 10) / 10.0 END AS coherence FROM bs),
rk AS (SELECT *, {", ".join(f"CASE WHEN {t} IS NOT NULL THEN CASE WHEN count({t}) OVER (PARTITION BY sample) > 1 THEN (rank() OVER (PARTITION BY sample ORDER BY {t} NULLS LAST) + (count(*) OVER (PARTITION BY sample, {t}) - 1) / 2.0 - 1) / (count({t}) OVER (PARTITION BY sample) - 1) ELSE 1.0 END END AS r_{t}" for t in landmarks.TERMS)} FROM bz)"""


def basins(spark: SparkSession, sf: str) -> DataFrame:
    b = S.persistence_basins(series(spark, sf), KEYS, "bucket", "y", 1.2, 4.0, 2)
    width = (F.col("exit") - F.col("entry") + 1).cast("double")
    return b.withColumns({"width": width, "lifetime": width - 1, "coherence": F.when(F.col("centre") % 9 > 0, (F.col("centre") % 10) / 10.0)})


@query("hi21_landmark_strength", "WITH " + ",\n".join([SERIES, BASINS, MARKS]) + f"""
SELECT sample, centre, {r6("list_avg([r_lifetime, r_depth, r_coherence])")} AS strength, width >= 4 AND coalesce(coherence >= 0.4, false) AS landmark, CAST(row_number() OVER (PARTITION BY sample ORDER BY centre) AS INTEGER) AS landmark_order,
  CASE WHEN width >= 4 AND coalesce(coherence >= 0.4, false) AND depth IS NOT NULL THEN 'none' ELSE concat_ws(';', CASE WHEN width < 4 THEN 'width' END, CASE WHEN depth IS NULL THEN 'depth' END, CASE WHEN NOT coalesce(coherence >= 0.4, false) THEN 'coherence' END) END AS reasons FROM rk""")
def strength(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(landmarks.strengths(basins(spark, sf), KEYS, "centre", "width", 4, 0.4).select("sample", "centre", "strength", "landmark", "landmark_order", "reasons"))


DOMINATED = "EXISTS (SELECT 1 FROM {0} o WHERE o.sample = p.sample AND o.lifetime >= p.lifetime AND o.depth >= p.depth AND o.coherence >= p.coherence AND (o.lifetime > p.lifetime OR o.depth > p.depth OR o.coherence > p.coherence))"
_UNIT = "CASE WHEN {0} IS NOT NULL THEN CASE WHEN max({0}) OVER (PARTITION BY sample) - min({0}) OVER (PARTITION BY sample) > 1e-12 THEN ({0} - min({0}) OVER (PARTITION BY sample)) / (max({0}) OVER (PARTITION BY sample) - min({0}) OVER (PARTITION BY sample)) ELSE 1.0 END END"


@query("hi21_landmark_index", "WITH " + ",\n".join([SERIES, BASINS, MARKS,
  "k0 AS (SELECT * FROM bz WHERE depth IS NOT NULL AND coherence IS NOT NULL)", f"f1 AS (SELECT sample, centre FROM k0 p WHERE NOT {DOMINATED.format('k0')})",
  "k1 AS (SELECT * FROM k0 ANTI JOIN f1 USING (sample, centre))", f"f2 AS (SELECT sample, centre FROM k1 p WHERE NOT {DOMINATED.format('k1')})",
  "ly AS (SELECT *, 1 AS layer FROM f1 UNION ALL SELECT *, 2 FROM f2)", "iv AS (SELECT bz.*, layer, 1.0 / layer AS inv FROM bz LEFT JOIN ly USING (sample, centre))"]) + f"""
SELECT sample, centre, layer, {r6("list_avg([" + ", ".join(_UNIT.format(t) for t in (*landmarks.TERMS, "inv")) + "])")} AS lsi FROM iv""")  # fmt: skip
def index(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(landmarks.landmark_index(basins(spark, sf), KEYS, "centre", 2).select("sample", "centre", "layer", "lsi"))


@query("hi09_schedule_sweep")
def sweep(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers contracted by two fractions to the same share of removed nodes, and how far the two partitions agree."""
    e = written(contacts(spark, sf).select(F.col("i").alias("cell_i"), F.col("j").alias("cell_j"), F.abs("tension").alias("tension"), (1.0 / F.col("n")).alias("apart")), "contacts")
    labels = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("cell"), F.col("s_suppkey").alias("node"))
    rows, parts = [], []
    for fraction in (0.5, 0.25):
        last, steps, why = hierarchy.run_schedule(e, labels, {"tension": 1.0, "apart": 0.5}, fraction, target=0.8)
        parts.append(last)
        rows += [(fraction, s["step"], s["nodes_before"], s["nodes_after"], s["merges"], s["relations"], s["mean_cost"], why) for s in steps]
    out = spark.createDataFrame(rows, "fraction double, step int, nodes_before long, nodes_after long, merges long, relations long, mean_cost double, stopped string")
    return rounded(out.crossJoin(F.broadcast(partitions.agreement(*parts).select("vi_bits"))))
