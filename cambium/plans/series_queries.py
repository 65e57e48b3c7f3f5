"""Queries over ordered series and windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cambium.functions.scalars import ratio
from cambium.operators import series as S
from cambium.plans.bindings import SERIES, series
from cambium.plans.registry import query
from cambium.streaming import detectors

W = "OVER (PARTITION BY sample ORDER BY bucket"
KEYS = ["sample"]
#: Far below a millionth and far above rounding errors.
NUDGE = 1.7e-10


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to six places, a hair up so that exact halves fall alike in every engine, without negative zeros."""
    return df.withColumns({n: F.round(F.col(n) + F.lit(NUDGE), 6) + F.lit(0.0) for n, t in df.dtypes if t == "double"})


def r6(expr: str) -> str:
    return f"(round({expr} + {NUDGE}::DOUBLE, 6) + 0)"


def sql(select: str, *ctes: str, base: str = SERIES) -> str:
    return "WITH " + ",\n".join([base, *ctes]) + "\n" + select


def at(df: DataFrame, **columns) -> DataFrame:
    return rounded(df.select("sample", "bucket", *[c.alias(n) for n, c in columns.items()]))


def w() -> S.WindowSpec:
    return S.over(KEYS, "bucket")


@query("wn01_04_rolling_medians", sql(f"""SELECT sample, bucket, {r6(f"quantile_cont(y, 0.5) {W} ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)")} AS smooth,
  {r6(f"quantile_cont(y, 0.5) {W} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)")} AS trailing,
  {r6(f"quantile_cont(y, 0.5) {W} ROWS BETWEEN 10 PRECEDING AND 3 PRECEDING)")} AS historical,
  {r6(f"quantile_cont(y, 0.5) {W} ROWS BETWEEN 9 PRECEDING AND 5 PRECEDING)")} AS before FROM traj"""))  # fmt: skip
def rolling(spark: SparkSession, sf: str) -> DataFrame:
    now, before = S.adjacent_windows("y", w(), 5)
    return at(series(spark, sf), smooth=S.smooth_median("y", w(), 5), trailing=now, historical=S.lagged_median("y", w(), 3, 8), before=before)


@query("wn05_backward_difference", sql(f"SELECT sample, bucket, {r6(f'(y - lag(y, 3) {W})) / (bucket - lag(bucket, 3) {W}))')} AS speed FROM traj"))
def backward(spark: SparkSession, sf: str) -> DataFrame:
    return at(series(spark, sf), speed=S.backward_difference("y", "bucket", w(), 3))


@query("wn06_clamped_gradient", sql(f"""SELECT sample, bucket, {r6(f"(coalesce(lead(y, 2) {W}), last_value(y) {W} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) - coalesce(lag(y, 2) {W}), first_value(y) {W}))) / (coalesce(lead(bucket, 2) {W}), last_value(bucket) {W} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) - coalesce(lag(bucket, 2) {W}), first_value(bucket) {W})))")} AS slope FROM traj"""))
def clamped(spark: SparkSession, sf: str) -> DataFrame:
    return at(series(spark, sf), slope=S.clamped_gradient("y", "bucket", w(), 2))


@query("wn07_unit_gradient", sql(f"""SELECT sample, bucket, {r6("CASE WHEN bp IS NULL THEN (yn - y) / (bn - bucket) WHEN bn IS NULL THEN (y - yp) / (bucket - bp) ELSE (yn - yp) / (bn - bp) END")} AS slope FROM g""",
  f"g AS (SELECT *, lag(y) {W}) AS yp, lead(y) {W}) AS yn, lag(bucket) {W}) AS bp, lead(bucket) {W}) AS bn FROM traj)"))
def unit(spark: SparkSession, sf: str) -> DataFrame:
    return at(series(spark, sf), slope=S.unit_gradient("y", "bucket", w()))


@query("wn08_gradient", sql(f"""SELECT sample, bucket, {r6("CASE WHEN bp IS NULL THEN (yn - y) / (bn - bucket) WHEN bn IS NULL THEN (y - yp) / (bucket - bp) ELSE ((bucket - bp) * (bucket - bp) * yn + ((bn - bucket) * (bn - bucket) - (bucket - bp) * (bucket - bp)) * y - (bn - bucket) * (bn - bucket) * yp) / ((bucket - bp) * (bn - bucket) * (bn - bp)) END")} AS slope FROM g""",
  f"g AS (SELECT *, lag(y) {W}) AS yp, lead(y) {W}) AS yn, lag(bucket) {W}) AS bp, lead(bucket) {W}) AS bn FROM traj)"))
def uneven(spark: SparkSession, sf: str) -> DataFrame:
    return at(series(spark, sf), slope=S.gradient("y", "bucket", w()))


def holes(spark: SparkSession, sf: str) -> DataFrame:
    return series(spark, sf).withColumn("y", F.when(F.col("bucket") % 4 != 1, F.col("y")))


HOLES = "holes AS (SELECT sample, bucket, n, CASE WHEN bucket % 4 <> 1 THEN y END AS y FROM traj)"


@query("wn09_fill_gaps", sql(f"""SELECT sample, bucket, {r6("coalesce(y, b.v + (a.v - b.v) * (pos - b.p) / (a.p - b.p))")} AS filled FROM f""", HOLES,
  f"p AS (SELECT *, row_number() {W}) AS pos FROM holes)",
  f"f AS (SELECT *, last_value(CASE WHEN y IS NOT NULL THEN {{'p': pos, 'v': y}} END IGNORE NULLS) {W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS b, first_value(CASE WHEN y IS NOT NULL THEN {{'p': pos, 'v': y}} END IGNORE NULLS) {W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS a FROM p)"))
def filled(spark: SparkSession, sf: str) -> DataFrame:
    out = S.fill_gaps(holes(spark, sf), KEYS, "bucket", "y")
    return rounded(out.select("sample", "bucket", F.col("y").alias("filled")))


GRID = [float(k) + 0.5 for k in range(-5, 125, 5)]


@query("wn10_common_grid", sql(f"""SELECT sample, u, {r6("CASE WHEN b.u = u THEN b.v ELSE b.v + (a.v - b.v) * (u - b.u) / (a.u - b.u) END")} AS y FROM g""",
  f"asked AS (SELECT DISTINCT sample, unnest({GRID}::DOUBLE[]) AS u FROM traj)",
  "g AS (SELECT q.sample, q.u, max_by({'u': t.bucket::DOUBLE, 'v': t.y}, t.bucket) FILTER (WHERE t.bucket <= q.u) AS b, min_by({'u': t.bucket::DOUBLE, 'v': t.y}, t.bucket) FILTER (WHERE t.bucket >= q.u) AS a FROM asked q JOIN traj t ON t.sample = q.sample GROUP BY ALL)"))
def common_grid(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(S.on_grid(series(spark, sf), KEYS, "bucket", "y", GRID))


NODES = f"nodes AS (SELECT sample, bucket, CAST(1000000 - sum(n) {W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS nodes FROM traj)"


@query("wn11_scale_coordinates", sql(f"""SELECT sample, bucket, {r6("ln(n0::DOUBLE / nodes)")} AS ell, {r6("1 - nodes::DOUBLE / n0")} AS removed_fraction, {r6("(n0 - nodes)::DOUBLE / nullif(n0 - nf, 0)")} AS progress FROM q""", NODES,
  f"q AS (SELECT *, first_value(nodes) {W}) AS n0, last_value(nodes) {W} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS nf FROM nodes)"))
def coordinates(spark: SparkSession, sf: str) -> DataFrame:
    s = series(spark, sf).withColumn("nodes", F.lit(1_000_000) - F.sum("n").over(w().rowsBetween(S.Window.unboundedPreceding, 0)))
    return rounded(S.scale_coordinates(s, KEYS, "bucket", "nodes").select("sample", "bucket", "ell", "removed_fraction", "progress"))


@query("wn12_true_runs", sql("""SELECT sample, min(p) AS run_start, max(p) AS run_end, count(*) AS length FROM g GROUP BY sample, grp HAVING count(*) >= 2""",
  f"m AS (SELECT sample, y, row_number() {W}) AS p FROM traj)", "g AS (SELECT *, p - row_number() OVER (PARTITION BY sample ORDER BY p) AS grp FROM m WHERE y > 50)"))
def runs(spark: SparkSession, sf: str) -> DataFrame:
    return S.true_runs(series(spark, sf), KEYS, "bucket", F.col("y") > 50, 2).select("sample", F.col("run_start").cast("long"), F.col("run_end").cast("long"), "length")


def kinetics(spark: SparkSession, sf: str) -> DataFrame:
    s = series(spark, sf).withColumn("v", S.gradient("y", "bucket", w()))
    return s.withColumn("a", S.gradient("v", "bucket", w()))


KIN = f"""g0 AS (SELECT *, lag(y) {W}) AS yp, lead(y) {W}) AS yn, lag(bucket) {W}) AS bp, lead(bucket) {W}) AS bn FROM traj),
g1 AS (SELECT sample, bucket, n, y, CASE WHEN bp IS NULL THEN (yn - y) / (bn - bucket) WHEN bn IS NULL THEN (y - yp) / (bucket - bp) ELSE ((bucket - bp) * (bucket - bp) * yn + ((bn - bucket) * (bn - bucket) - (bucket - bp) * (bucket - bp)) * y - (bn - bucket) * (bn - bucket) * yp) / ((bucket - bp) * (bn - bucket) * (bn - bp)) END AS v FROM g0)"""


@query("wn13_stationary_windows", sql(f"""SELECT sample, min(p) AS run_start, max(p) AS run_end, count(*) AS length, arg_min(bucket, {{'v': round(abs(v), 9), 'b': bucket}}) AS representative, {r6("1 - avg(abs(v)) / any_value(lim)")} AS persistence FROM i GROUP BY sample, grp HAVING count(*) >= 2""", KIN,
  "lims AS (SELECT sample, quantile_cont(abs(v), 0.6) AS lim FROM g1 GROUP BY sample)", f"p AS (SELECT g1.*, lim, row_number() OVER (PARTITION BY g1.sample ORDER BY bucket) AS p FROM g1 JOIN lims USING (sample))",
  "i AS (SELECT *, p - row_number() OVER (PARTITION BY sample ORDER BY p) AS grp FROM p WHERE abs(v) <= lim)"))
def stationary(spark: SparkSession, sf: str) -> DataFrame:
    k = kinetics(spark, sf)
    out = S.stationary_windows(k, KEYS, "bucket", "v", "v", 0.6, 2)
    return rounded(out.select("sample", F.col("run_start").cast("long"), F.col("run_end").cast("long"), "length", "representative", "persistence"))


# Second derivatives, their local maxima as scores, and the greedy choice pick by pick.
PICKS = f"""k1 AS (SELECT *, lag(v) {W}) AS vp, lead(v) {W}) AS vn, lag(bucket) {W}) AS bp, lead(bucket) {W}) AS bn FROM g1),
k2 AS (SELECT sample, bucket, CASE WHEN bp IS NULL THEN (vn - v) / (bn - bucket) WHEN bn IS NULL THEN (v - vp) / (bucket - bp) ELSE ((bucket - bp) * (bucket - bp) * vn + ((bn - bucket) * (bn - bucket) - (bucket - bp) * (bucket - bp)) * v - (bn - bucket) * (bn - bucket) * vp) / ((bucket - bp) * (bn - bucket) * (bn - bp)) END AS a FROM k1),
scored AS (SELECT sample, bucket, CASE WHEN a >= max(a) {W} ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) THEN abs(a) END AS score, row_number() {W}) AS r FROM k2),
pick(sample, k, taken) AS (
  SELECT DISTINCT sample, 0, []::BIGINT[] FROM scored UNION ALL
  SELECT p.sample, p.k + 1, list_append(p.taken, arg_max(s.r, {{'s': s.score, 'r': -s.r}})) FROM pick p JOIN scored s ON s.sample = p.sample
  WHERE p.k < 5 AND s.score IS NOT NULL AND len(list_filter(p.taken, lambda t: abs(t - s.r) < 3)) = 0 GROUP BY p.sample, p.k, p.taken)"""


@query("wn14_change_points", sql(f"SELECT s.sample, bucket, {r6('score')} AS score, CAST(k AS INTEGER) AS pick FROM pick p JOIN scored s ON s.sample = p.sample AND s.r = p.taken[k] WHERE k > 0", KIN, PICKS).replace("WITH ", "WITH RECURSIVE ", 1))
def change_points(spark: SparkSession, sf: str) -> DataFrame:
    k = kinetics(spark, sf).withColumn("score", F.when(S.is_local_extremum("a", w(), 1, False), F.abs("a"))).select("sample", "bucket", "score")
    return rounded(S.greedy_separated(k, KEYS, "bucket", "score", 3, 5))


@query("wn15_16_local_extrema", sql(f"""SELECT sample, bucket, y <= min(y) {W} ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS low, y >= max(y) {W} ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS high FROM traj"""))
def extrema(spark: SparkSession, sf: str) -> DataFrame:
    return series(spark, sf).select("sample", "bucket", S.is_local_extremum("y", w(), 2).alias("low"), S.is_local_extremum("y", w(), 2, False).alias("high"))


BASINS = """pr AS (SELECT sample, y AS s, CAST(row_number() OVER (PARTITION BY sample ORDER BY bucket) AS INTEGER) AS p, y <= min(y) OVER (PARTITION BY sample ORDER BY bucket ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS low FROM traj),
lw AS (SELECT sample, p AS centre, s AS bottom, greatest(1.2 * s, s + 4.0) AS lim FROM pr WHERE low),
rc AS (SELECT l.sample, centre, bottom, coalesce(max(CASE WHEN s > lim AND p < centre THEN p END), 0) AS b, coalesce(min(CASE WHEN s > lim AND p > centre THEN p END), max(p) + 1) AS a FROM lw l JOIN pr USING (sample) GROUP BY ALL),
md AS (SELECT r.sample, centre, bottom, b, a, quantile_cont(CASE WHEN p BETWEEN b - 3 AND b THEN s END, 0.5) AS l, quantile_cont(CASE WHEN p BETWEEN a AND a + 3 THEN s END, 0.5) AS r FROM rc r JOIN pr USING (sample) WHERE a - b - 1 >= 2 GROUP BY ALL),
bs AS (SELECT sample, centre, CAST(b + 1 AS INTEGER) AS entry, CAST(a - 1 AS INTEGER) AS "exit", bottom, coalesce((l + r) / 2, l, r) - bottom AS depth FROM md)"""


@query("wn17_persistence_basins", sql(f'SELECT sample, centre, entry, "exit", {r6("bottom")} AS bottom, {r6("depth")} AS depth FROM bs', BASINS))
def persistence(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(S.persistence_basins(series(spark, sf), KEYS, "bucket", "y", 1.2, 4.0, 2))


@query("wn19_enclosed_basins", sql(f"""SELECT sample, centre, entry, "exit", {r6("bottom")} AS bottom, {r6("least(lv, rv) - bottom")} AS depth, "exit" - entry AS lifetime FROM
  (SELECT *, row_number() OVER (PARTITION BY sample, entry, "exit" ORDER BY bottom, centre) AS k FROM c) WHERE k = 1""",
  f"p AS (SELECT sample, y, row_number() {W}) AS p, y <= min(y) {W} ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS lo, y >= max(y) {W} ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS hi FROM traj)",
  """c AS (SELECT m.sample, m.p AS centre, m.y AS bottom, l.p AS entry, l.y AS lv, r.p AS "exit", r.y AS rv FROM p m
    JOIN p l ON l.sample = m.sample AND l.hi AND l.p = (SELECT max(x.p) FROM p x WHERE x.sample = m.sample AND x.hi AND x.p < m.p)
    JOIN p r ON r.sample = m.sample AND r.hi AND r.p = (SELECT min(x.p) FROM p x WHERE x.sample = m.sample AND x.hi AND x.p > m.p)
    WHERE m.lo AND l.y > m.y AND r.y > m.y)"""))  # fmt: skip
def basins(spark: SparkSession, sf: str) -> DataFrame:
    b = S.enclosed_basins(series(spark, sf), KEYS, "bucket", "y")
    return rounded(b.select("sample", *[F.col(n).cast("long").alias(n) for n in ("centre", "entry", "exit")], "bottom", "depth", F.col("lifetime").cast("long")))


# The best interval left is kept unless one kept before overlaps it; one list of intervals for each sample.
DEDUP = """ls AS (SELECT sample, list({'c': centre, 'a': entry, 'b': "exit"} ORDER BY bottom, depth DESC, centre) AS e FROM bs GROUP BY sample),
pk(sample, k, kept) AS (SELECT sample, 1::BIGINT, []::BIGINT[] FROM ls UNION ALL
  SELECT p.sample, k + 1, CASE WHEN len(list_filter(kept, lambda j: greatest(0, least(e[j].b, e[k].b) - greatest(e[j].a, e[k].a) + 1) / (e[j].b - e[j].a + e[k].b - e[k].a + 2 - greatest(0, least(e[j].b, e[k].b) - greatest(e[j].a, e[k].a) + 1)) >= 0.65)) > 0 THEN kept ELSE list_append(kept, k) END
  FROM pk p JOIN ls USING (sample) WHERE k <= len(e)),
fin AS (SELECT sample, arg_max(kept, k) AS kept FROM pk GROUP BY sample),
ch AS (SELECT sample, e[u].c AS centre FROM (SELECT f.sample, e, unnest(kept) AS u FROM fin f JOIN ls USING (sample)))"""


@query("wn20_interval_dedup", sql(f'SELECT sample, centre, entry, "exit", {r6("bottom")} AS bottom, {r6("depth")} AS depth FROM bs SEMI JOIN ch USING (sample, centre)', BASINS, DEDUP).replace("WITH ", "WITH RECURSIVE ", 1))
def dedup(spark: SparkSession, sf: str) -> DataFrame:
    b = S.persistence_basins(series(spark, sf), KEYS, "bucket", "y", 1.2, 4.0, 2)
    return rounded(S.overlap_dedup(b, KEYS, "entry", "exit", [("bottom", True), ("depth", False), ("centre", True)], 0.65))


@query("wn21_displacement", sql(f"""SELECT bucket, "block", {r6("sqrt(avg(d * d))")} AS displacement FROM
  (SELECT bucket, CASE WHEN sample IN ('click', 'view') THEN 'traffic' ELSE 'other' END AS "block", y - lag(y, 2) {W}) AS d FROM traj) GROUP BY ALL"""))  # fmt: skip
def displacement(spark: SparkSession, sf: str) -> DataFrame:
    s = series(spark, sf).withColumn("block", F.when(F.col("sample").isin("click", "view"), "traffic").otherwise("other"))
    return rounded(S.displacement(s, [], "bucket", "block", "sample", "y", 2))


@query("wn22_closure_ratio", sql(f"""SELECT sample, bucket, {r6(f"(quantile_cont(y, 0.5) {W} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)) / (quantile_cont(y, 0.5) {W} ROWS BETWEEN 10 PRECEDING AND 3 PRECEDING))")} AS closure FROM traj"""))
def closure(spark: SparkSession, sf: str) -> DataFrame:
    return at(series(spark, sf), closure=S.closure_ratio("y", w(), 3, 8))


RANK = "(rank() OVER (PARTITION BY sample ORDER BY n) + (count(*) OVER (PARTITION BY sample, n) - 1) / 2.0)"


@query("wn24_26_ranks", sql(f"""SELECT sample, bucket, {r6(f"CASE WHEN count(*) OVER (PARTITION BY sample) > 1 THEN ({RANK} - 1) / (count(*) OVER (PARTITION BY sample) - 1) ELSE 1.0 END")} AS rank01, {r6(f"{RANK} / count(*) OVER (PARTITION BY sample)")} AS pct_rank, {r6("cume_dist() OVER (PARTITION BY sample ORDER BY n)")} AS percentile, dense_rank() OVER (PARTITION BY sample ORDER BY n DESC NULLS LAST) AS place FROM traj"""))
def ranks(spark: SparkSession, sf: str) -> DataFrame:
    r = S.empirical_percentile(S.percentile_rank(S.rank01(series(spark, sf), KEYS, "n"), KEYS, "n"), KEYS, "n")
    place = F.dense_rank().over(S.Window.partitionBy("sample").orderBy(F.desc_nulls_last("n"))).cast("long")
    return rounded(r.select("sample", "bucket", "rank01", "pct_rank", "percentile", place.alias("place")))


@query("wn28_29_chain", sql(f"""SELECT sample, bucket, id AS landmark_id, lag(id) {W}) AS previous_id, lead(id) {W}) AS next_id, bucket - lag(bucket) {W}) AS gap_before, lead(bucket) {W}) - bucket AS gap_after FROM
  (SELECT *, 'L' || lpad(CAST(row_number() {W}) AS VARCHAR), 4, '0') AS id FROM traj)"""))  # fmt: skip
def chain(spark: SparkSession, sf: str) -> DataFrame:
    return S.chain(series(spark, sf).withColumns(S.spacing("bucket", w())), KEYS, ["bucket"], "L").select("sample", "bucket", "landmark_id", "previous_id", "next_id", "gap_before", "gap_after")


@query("wn31_relative_change", sql(f"""SELECT sample, bucket, {r6(f"2 * abs(y - lag(y) {W})) / greatest(abs(y) + abs(lag(y) {W})), 1e-12)")} AS change FROM traj"""))
def relative(spark: SparkSession, sf: str) -> DataFrame:
    return at(series(spark, sf), change=S.relative_change("y", w()))


@query("wn32_plateau", sql(f"""SELECT sample, bucket, {r6("change")} AS change, coalesce(sum(CASE WHEN change <= 0.2 THEN 1 ELSE 0 END) {W} ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) = 2, false) AS plateau FROM
  (SELECT *, abs(y - lag(y) {W})) / greatest(abs(lag(y) {W})), 1e-12) AS change FROM traj)"""))  # fmt: skip
def plateau(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(S.plateau(series(spark, sf), KEYS, "bucket", "y", 0.2, 2).select("sample", "bucket", "change", "plateau"))


@query("wn33_landmark_due", sql(f"""SELECT sample, bucket, coalesce(floor(bucket / 7) > lag(floor(bucket / 7)) {W}), true) AS due FROM traj"""))
def due(spark: SparkSession, sf: str) -> DataFrame:
    return series(spark, sf).select("sample", "bucket", S.due("bucket", w(), 7).alias("due"))


@query("sc19_range_stability", sql(f"""SELECT sample, bucket, {r6(f"(max(y) {W} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) - min(y) {W} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)) / greatest(quantile_cont(abs(y), 0.5) {W} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 1e-12)")} AS stability FROM traj"""))
def stable(spark: SparkSession, sf: str) -> DataFrame:
    return at(series(spark, sf), stability=S.stability("y", w(), 5))


RECENT, EARLIER = "OVER (PARTITION BY sample ORDER BY bucket ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)", "OVER (PARTITION BY sample ORDER BY bucket ROWS BETWEEN 9 PRECEDING AND 5 PRECEDING)"
KNOWN = {b: f"count({b}) {RECENT} >= 3 AND count({b}) {EARLIER} >= 3 AND coalesce(quantile_cont({b}, 0.5) {EARLIER} > 0, false)" for b in ("speed", "level", "cnt")}
SLOW = {b: f"{k} AND coalesce(quantile_cont({b}, 0.5) {RECENT} <= 1.05 * (quantile_cont({b}, 0.5) {EARLIER}) AND max({b}) {RECENT} <= 1.5 * (quantile_cont({b}, 0.5) {EARLIER}), false)" for b, k in KNOWN.items()}
TERMINAL = f"""hx AS (SELECT *, abs((y - lag(y) {W})) / (bucket - lag(bucket) {W}))) AS speed, abs(y) AS level, n::DOUBLE AS cnt FROM traj),
hk AS (SELECT sample, bucket, {" + ".join(f"({k})::INT" for k in KNOWN.values())} AS resolved_blocks, {" + ".join(f"({k})::INT" for k in SLOW.values())} AS slow_blocks,
  coalesce(max(n) {RECENT} - min(n) {RECENT} <= 3.0 * (quantile_cont(abs(n), 0.5) {RECENT}), false) AS stable, row_number() {W}) AS r FROM hx),
hc AS (SELECT *, resolved_blocks >= 2 AND slow_blocks >= 0.5 * resolved_blocks AND stable AND r >= 12 AS candidate FROM hk)"""


@query("hi14_terminal_rule", sql(f"SELECT sample, bucket, resolved_blocks, slow_blocks, candidate, sum(candidate::INT) {W} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) = 3 AS confirmed FROM hc", TERMINAL))
def terminal(spark: SparkSession, sf: str) -> DataFrame:
    from cambium.operators.hierarchy import terminal_rule

    h = series(spark, sf).withColumns({"speed": F.abs(S.backward_difference("y", "bucket", w(), 1)), "level": F.abs("y"), "count": F.col("n").cast("double")})
    return rounded(terminal_rule(h, KEYS, "bucket", ["speed", "level", "count"], ["n"], slow=1.05, least_blocks=2, spread=3.0, share=0.5).select("sample", "bucket", "resolved_blocks", "slow_blocks", "candidate", "confirmed"))


def classes_sql(low: float) -> list[str]:
    """Votes of nine settings and the class of each landmark."""
    speed = lambda k: f"abs((y - lag(y, {k}) {W})) / (bucket - lag(bucket, {k}) {W})))"
    votes = " UNION ALL ".join(f"SELECT sample, bucket, 's{k}w{n}' AS setting, quantile_cont(d{k}, 0.5) {W} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS speed FROM dv" for k in (1, 2, 3) for n in (3, 5, 7))
    return [
        "dv AS (SELECT sample, bucket, " + ", ".join(f"{speed(k)} AS d{k}" for k in (1, 2, 3)) + " FROM traj)", f"vt AS ({votes})",
        f"vq AS (SELECT sample, setting, quantile_cont(speed, {low}) AS lo, quantile_cont(speed, 0.9) AS hi FROM vt GROUP BY ALL)",
        "vc AS (SELECT sample, bucket, count(*) AS settings, count(speed) AS known, count(*) FILTER (speed <= lo) AS slow, count(*) FILTER (speed >= hi) AS fast FROM vt JOIN vq USING (sample, setting) GROUP BY ALL)",
        f"""cl AS (SELECT *, CASE WHEN row_number() {W}) <= 8 THEN 'WARMUP' WHEN known * 2 < settings THEN 'UNRESOLVED' WHEN fast * 2 > known THEN 'FAST_CHANGE' WHEN slow * 2 > known THEN 'LOW_FLOW' ELSE 'REGULAR' END AS "class" FROM vc)""",
    ]


@query("st01_landmark_classes", sql('SELECT sample, bucket, settings, known, slow, fast, "class" FROM cl', *classes_sql(0.25)))
def classes(spark: SparkSession, sf: str) -> DataFrame:
    return detectors.classified(detectors.votes(series(spark, sf), KEYS, "bucket", "y"), KEYS, "bucket").select("sample", "bucket", "settings", "known", "slow", "fast", "class")


# The state machine row by row: run, confirming rows, whether a confirmation is open, whether it was completed.
MACHINE = f"""nr AS (SELECT sample, bucket, "class", row_number() {W}) AS r FROM cl),
ma(sample, r, run, held, op, st, decision) AS (SELECT DISTINCT sample, 0::BIGINT, 0, 0, false, false, '' FROM nr UNION ALL
  SELECT m.sample, m.r + 1,
    CASE WHEN st THEN run WHEN op THEN CASE WHEN "class" = 'LOW_FLOW' THEN run ELSE 0 END WHEN "class" = 'LOW_FLOW' THEN run + 1 ELSE 0 END,
    CASE WHEN st THEN held WHEN op AND "class" = 'LOW_FLOW' THEN held + 1 ELSE 0 END,
    st OR (op AND "class" = 'LOW_FLOW') OR (NOT op AND "class" = 'LOW_FLOW' AND run + 1 >= 2),
    st OR (op AND "class" = 'LOW_FLOW' AND held + 1 >= 1),
    CASE WHEN st THEN 'STOPPED' WHEN NOT op THEN CASE WHEN "class" = 'LOW_FLOW' AND run + 1 >= 2 THEN 'ENTER_CONFIRMATION' ELSE 'CONTINUE' END
         WHEN "class" <> 'LOW_FLOW' THEN 'CONFIRMATION_FAILED' WHEN held + 1 >= 1 THEN 'STOP_CONFIRMED' ELSE 'CONFIRMING' END
  FROM ma m JOIN nr n ON n.sample = m.sample AND n.r = m.r + 1)"""


@query("st02_03_detector_replay", sql('SELECT sample, bucket, "class", decision FROM ma JOIN nr USING (sample, r)', *classes_sql(0.5), MACHINE).replace("WITH ", "WITH RECURSIVE ", 1))
def replay(spark: SparkSession, sf: str) -> DataFrame:
    c = detectors.classified(detectors.votes(series(spark, sf), KEYS, "bucket", "y"), KEYS, "bucket", low=0.5)
    return detectors.detect(c, KEYS, "bucket", detectors.Rule(2, 1))


@query("ag28_contribution", sql(f"""SELECT sample, bucket, {r6("y * y / nullif(sum(y * y) OVER (PARTITION BY bucket), 0)")} AS contribution FROM traj"""))
def contribution(spark: SparkSession, sf: str) -> DataFrame:
    from cambium.operators.aggregates import contribution as share

    return rounded(share(series(spark, sf), ["bucket"], "y").select("sample", "bucket", "contribution"))


@query("ag27_block_rms", sql(f"""SELECT bucket, {r6("sqrt(avg(r * r))")} AS balanced_norm, count(r) AS blocks FROM
  (SELECT bucket, sample IN ('click', 'view') AS b, sqrt(avg(y * y)) AS r FROM traj GROUP BY ALL) GROUP BY bucket"""))  # fmt: skip
def rms(spark: SparkSession, sf: str) -> DataFrame:
    from cambium.operators.aggregates import block_rms

    return rounded(block_rms(series(spark, sf).withColumn("b", F.col("sample").isin("click", "view")), ["bucket"], "b", "y"))


@query("ag29_pivot", sql("""SELECT bucket, max(CASE WHEN sample = 'click' THEN n END) AS click, max(CASE WHEN sample = 'view' THEN n END) AS view, max(CASE WHEN sample = 'purchase' THEN n END) AS purchase FROM traj GROUP BY bucket"""))
def pivoted(spark: SparkSession, sf: str) -> DataFrame:
    return series(spark, sf).groupBy("bucket").pivot("sample", ["click", "view", "purchase"]).agg(F.max("n"))


@query("ts04_curve_distances", sql(f"""SELECT a.sample AS a, b.sample AS b, {r6("sqrt(avg((a.s - b.s) * (a.s - b.s)))")} AS distance, count(*) AS points FROM sh a JOIN sh b ON a.bucket = b.bucket AND a.sample < b.sample GROUP BY ALL HAVING count(*) >= 10""",
  "sh AS (SELECT sample, bucket, (y - avg(y) OVER (PARTITION BY sample)) / nullif(stddev_pop(y) OVER (PARTITION BY sample), 0) AS s FROM traj)"))
def curves(spark: SparkSession, sf: str) -> DataFrame:
    from cambium.operators.statistics import curve_distances, normalised_curves

    return rounded(curve_distances(normalised_curves(series(spark, sf), KEYS, "y"), "sample", ["bucket"], "shape"))


@query("ts04_leave_one_out", sql(f"""SELECT sample, {r6("sqrt(avg(e * e))")} AS rmse, count(e) AS points FROM
  (SELECT sample, y - (sum(y) OVER (PARTITION BY bucket) - y) / nullif(count(y) OVER (PARTITION BY bucket) - 1, 0) AS e FROM traj) GROUP BY sample"""))  # fmt: skip
def loo(spark: SparkSession, sf: str) -> DataFrame:
    from cambium.operators.statistics import leave_one_out

    return rounded(leave_one_out(series(spark, sf), "sample", ["bucket"], "y"))


@query("hi24_schedule_drift", sql(f"""SELECT t.sample, {r6("avg(abs(t.y - r.y) / greatest(abs(r.y), 1e-12))")} AS mean_drift, {r6("max(abs(t.y - r.y) / greatest(abs(r.y), 1e-12))")} AS max_drift, count(*) AS points FROM traj t JOIN traj r ON r.bucket = t.bucket AND r.sample = 'view' GROUP BY t.sample"""))
def drift(spark: SparkSession, sf: str) -> DataFrame:
    from cambium.operators.statistics import schedule_drift

    return rounded(schedule_drift(series(spark, sf), "sample", "bucket", "y", "view"))


@query("sc09_lsi", sql(f"""SELECT sample, bucket, {r6("(y - min(y) OVER (PARTITION BY sample)) / nullif(max(y) OVER (PARTITION BY sample) - min(y) OVER (PARTITION BY sample), 0)")} AS level FROM traj"""))
def lsi(spark: SparkSession, sf: str) -> DataFrame:
    p = S.Window.partitionBy("sample")
    return at(series(spark, sf), level=ratio(F.col("y") - F.min("y").over(p), F.max("y").over(p) - F.min("y").over(p)))


NOW, HIST = "ROWS BETWEEN 2 PRECEDING AND CURRENT ROW", "ROWS BETWEEN 10 PRECEDING AND 3 PRECEDING"


def mid(x: str, frame: str) -> str:
    return f"(quantile_cont({x}, 0.5) {W} {frame}))"


FEATURES = f"""fa AS (SELECT *, abs(y - lag(y) {W})) / (bucket - lag(bucket) {W})) AS v, {", ".join(f"abs(y - lag(y, {k}) {W})) AS d{k}" for k in (1, 2, 4))} FROM traj),
fb AS (SELECT *, abs(v - lag(v) {W})) / (bucket - lag(bucket) {W})) AS a FROM fa),
fc AS (SELECT sample, bucket, {mid("v", NOW)} / nullif({mid("v", HIST)}, 0) AS velocity_ratio, {mid("a", NOW)} / nullif({mid("a", HIST)}, 0) AS acceleration_ratio, {", ".join(f"d{k} / nullif({mid(f'd{k}', HIST)}, 0) AS c{k}" for k in (1, 2, 4))} FROM fb),
fd AS (SELECT *, (c1 IS NOT NULL)::INT + (c2 IS NOT NULL)::INT + (c4 IS NOT NULL)::INT AS resolved_closure_lags, list_median([c1, c2, c4]) AS closure_median_ratio, coalesce(((c1 <= 0.5)::INT::DOUBLE), 0) + coalesce(((c2 <= 0.5)::INT::DOUBLE), 0) + coalesce(((c4 <= 0.5)::INT::DOUBLE), 0) AS below FROM fc),
fe AS (SELECT *, CASE WHEN resolved_closure_lags > 0 THEN below / resolved_closure_lags ELSE 0 END AS closure_support, coalesce(velocity_ratio <= 0.6 AND acceleration_ratio <= 0.6, false) AS slowdown FROM fd)"""


@query("wn22_causal_features", sql(f"SELECT sample, bucket, {r6('velocity_ratio')} AS velocity_ratio, {r6('acceleration_ratio')} AS acceleration_ratio, {r6('closure_median_ratio')} AS closure_median_ratio, {r6('closure_support')} AS closure_support, resolved_closure_lags, slowdown FROM fe", FEATURES))
def causal(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(S.causal_features(series(spark, sf), KEYS, "bucket", "y").drop("n", "y"))


@query("wn23_gate_table", sql(f"""SELECT sample, bucket, coalesce(velocity_ratio <= 0.6, false) AS pass_velocity, coalesce(acceleration_ratio <= 0.6, false) AS pass_acceleration, closure_support >= 0.6 AS pass_closure, resolved_closure_lags >= 2 AS pass_resolution,
  coalesce(velocity_ratio <= 0.6, false)::INT + coalesce(acceleration_ratio <= 0.6, false)::INT + (closure_support >= 0.6)::INT + (resolved_closure_lags >= 2)::INT AS gate_count,
  {r6("sqrt((coalesce((velocity_ratio / 0.6) ** 2, 0) + coalesce((acceleration_ratio / 0.6) ** 2, 0) + coalesce((closure_median_ratio / 0.5) ** 2, 0)) / nullif((velocity_ratio IS NOT NULL)::INT + (acceleration_ratio IS NOT NULL)::INT + (closure_median_ratio IS NOT NULL)::INT, 0))")} AS plateau_distance FROM fe""", FEATURES))
def gates(spark: SparkSession, sf: str) -> DataFrame:
    g = S.gate_table(S.causal_features(series(spark, sf), KEYS, "bucket", "y"))
    return rounded(g.select("sample", "bucket", "pass_velocity", "pass_acceleration", "pass_closure", "pass_resolution", "gate_count", "plateau_distance"))
