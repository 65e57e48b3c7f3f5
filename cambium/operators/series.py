"""Ordered series by group: windows, derivatives, interpolation, runs, extrema, basins.

All take the group keys and the column that orders a group; that order must be
total. Frames named trailing or causal see no later row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from cambium.functions.scalars import ratio


def over(keys: list[str], order: str | list[str]) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(*([order] if isinstance(order, str) else order))


def frame_median(x: str, w: WindowSpec, low: int, high: int) -> Column:
    """Exact median of the values in rows [low, high] around the current one."""
    return F.percentile(F.col(x), F.lit(0.5)).over(w.rowsBetween(low, high))


def smooth_median(x: str, w: WindowSpec, width: int) -> Column:
    """Centred rolling median over ``width`` rows, shorter at the ends."""
    return frame_median(x, w, -(width // 2), width // 2)


def trailing_median(x: str, w: WindowSpec, width: int) -> Column:
    return frame_median(x, w, -(width - 1), 0)


def lagged_median(x: str, w: WindowSpec, recent: int, history: int) -> Column:
    """Median of the ``history`` rows before the ``recent`` last ones."""
    return frame_median(x, w, -(recent - 1 + history), -recent)


def backward_difference(y: str, t: str, w: WindowSpec, stride: int) -> Column:
    return ratio(F.col(y) - F.lag(y, stride).over(w), F.col(t) - F.lag(t, stride).over(w))


def clamped_gradient(y: str, t: str, w: WindowSpec, stride: int) -> Column:
    """Difference over ``stride`` rows to both sides, clamped to the group's ends."""
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)

    def at(x: str, ahead: bool) -> Column:
        # struct: a NULL value that exists is not the same as no row
        cell = F.struct(F.col(x).alias("v"))
        moved = (F.lead if ahead else F.lag)(cell, stride).over(w)
        end = (F.last if ahead else F.first)(cell).over(whole)
        return F.coalesce(moved, end)["v"]

    return ratio(at(y, True) - at(y, False), at(t, True) - at(t, False))


def gradient(y: str, t: str, w: WindowSpec) -> Column:
    """Second-order gradient on an uneven grid, one-sided at the ends."""
    yp, yn, tp, tn = F.lag(y).over(w), F.lead(y).over(w), F.lag(t).over(w), F.lead(t).over(w)
    hs, hd = F.col(t) - tp, tn - F.col(t)
    inner = ratio(hs * hs * yn + (hd * hd - hs * hs) * F.col(y) - hd * hd * yp, hs * hd * (hd + hs))
    return F.when(tp.isNull(), ratio(yn - F.col(y), hd)).when(tn.isNull(), ratio(F.col(y) - yp, hs)).otherwise(inner)


def unit_gradient(y: str, t: str, w: WindowSpec) -> Column:
    """Gradient by position over gradient of ``t`` by position."""

    def by_row(x: str) -> Column:
        p, n = F.lag(x).over(w), F.lead(x).over(w)
        return F.when(F.row_number().over(w) == 1, n - F.col(x)).when(F.lead(F.lit(1)).over(w).isNull(), F.col(x) - p).otherwise((n - p) / 2)

    return ratio(by_row(y), by_row(t))


def fill_gaps(df: DataFrame, keys: list[str], order: str, x: str, ends: bool = False) -> DataFrame:
    """Linear interpolation of NULLs by row position; with ``ends`` also carried outward."""
    w = over(keys, order)
    df = df.withColumn("_pos", F.row_number().over(w))
    known = F.when(F.col(x).isNotNull(), F.struct(F.col("_pos").alias("p"), F.col(x).alias("v")))
    before = F.last(known, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first(known, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    df = df.withColumns({"_b": before, "_a": after})
    lerp = F.col("_b.v") + (F.col("_a.v") - F.col("_b.v")) * ratio(F.col("_pos") - F.col("_b.p"), F.col("_a.p") - F.col("_b.p"))
    value = F.coalesce(F.col(x), lerp, *([F.col("_b.v"), F.col("_a.v")] if ends else []))
    return df.withColumn(x, value).drop("_pos", "_b", "_a")


def on_grid(df: DataFrame, keys: list[str], u: str, x: str, grid: list[float]) -> DataFrame:
    """Values at the grid's points by interpolation in ``u``; NULL outside a group's support. Equal u are averaged first."""
    points = df.where(F.col(u).isNotNull() & F.col(x).isNotNull()).groupBy(*keys, F.col(u).cast("double").alias("u")).agg(F.avg(x).alias("v"))
    asked = points.select(*keys).distinct().withColumn("u", F.explode(F.array(*[F.lit(float(g)) for g in grid])))
    both = points.select(*keys, "u", "v", F.lit(0).alias("ask")).unionByName(asked.select(*keys, "u", F.lit(None).cast("double").alias("v"), F.lit(1).alias("ask")))
    w = Window.partitionBy(*keys).orderBy("u", "ask")
    known = F.when(F.col("v").isNotNull(), F.struct("u", "v"))
    both = both.withColumn("_b", F.last(known, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    both = both.withColumn("_a", F.first(known, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))).where("ask = 1")
    exact = F.when(F.col("_b.u") == F.col("u"), F.col("_b.v"))
    lerp = F.col("_b.v") + (F.col("_a.v") - F.col("_b.v")) * ratio(F.col("u") - F.col("_b.u"), F.col("_a.u") - F.col("_b.u"))
    return both.select(*keys, F.col("u"), F.coalesce(exact, lerp).alias(x))


def scale_coordinates(df: DataFrame, keys: list[str], order: str, nodes: str) -> DataFrame:
    """``ell`` = ln(N0 / N), ``removed_fraction`` = 1 - N / N0 and progress from the first to the last row."""
    whole = over(keys, order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    n0, nf = F.first(nodes).over(whole), F.last(nodes).over(whole)
    return df.withColumns({"ell": F.ln(ratio(n0, nodes)), "removed_fraction": 1 - ratio(nodes, n0), "progress": ratio(n0 - F.col(nodes), n0 - nf)})


def true_runs(df: DataFrame, keys: list[str], order: str, flag: Column, least: int = 1) -> DataFrame:
    """Maximal runs of consecutive rows where ``flag`` holds: start, end (positions from 1) and length."""
    w = over(keys, order)
    marked = df.withColumn("_p", F.row_number().over(w)).where(F.coalesce(flag, F.lit(False)))
    island = marked.withColumn("_g", F.col("_p") - F.row_number().over(w))
    return island.groupBy(*keys, "_g").agg(F.min("_p").alias("run_start"), F.max("_p").alias("run_end"), F.count("*").alias("length")).where(F.col("length") >= least).drop("_g")


def stationary_windows(df: DataFrame, keys: list[str], order: str, v: str, a: str, quantile: float, least: int) -> DataFrame:
    """Runs where |v| and |a| are within their quantiles over the group; the slowest row represents a run."""
    limits = df.groupBy(*keys).agg(F.percentile(F.abs(v), F.lit(quantile)).alias("_v"), F.percentile(F.abs(a), F.lit(quantile)).alias("_a"))
    w = over(keys, order)
    low = df.join(limits, keys).withColumn("_p", F.row_number().over(w)).where((F.abs(v) <= F.col("_v")) & (F.abs(a) <= F.col("_a")))
    low = low.withColumn("_g", F.col("_p") - F.row_number().over(w))
    runs = low.groupBy(*keys, "_g").agg(
        F.min("_p").alias("run_start"), F.max("_p").alias("run_end"), F.count("*").alias("length"),
        F.min_by(order, F.struct(F.abs(v), F.col(order))).alias("representative"), (1 - ratio(F.avg(F.abs(v)), F.first("_v"))).alias("persistence"),
    )
    return runs.where(F.col("length") >= least).drop("_g")


def is_local_extremum(x: str, w: WindowSpec, radius: int, lowest: bool = True) -> Column:
    """Whether a row holds the least (largest) value of the rows within ``radius``."""
    frame = w.rowsBetween(-radius, radius)
    return F.col(x) <= F.min(x).over(frame) if lowest else F.col(x) >= F.max(x).over(frame)


def enclosed_basins(df: DataFrame, keys: list[str], order: str, x: str, radius: int = 1) -> DataFrame:
    """Local minima between their nearest higher local maxima; one minimum, the deepest, for each pair of shoulders.

    The nearest shoulders are carried along the series from either side, so no
    minimum is compared with every maximum. A maximum is a shoulder if it is
    higher than its neighbours, and so than the minimum next to it.
    """
    w = over(keys, order)
    p = df.withColumns({"_p": F.row_number().over(w), "_min": is_local_extremum(x, w, radius), "_max": is_local_extremum(x, w, radius, False)})
    top = F.when(F.col("_max"), F.struct(F.col("_p").alias("p"), F.col(x).alias("v")))
    left = F.last(top, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    right = F.first(top, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    b = p.withColumns({"_l": left, "_r": right}).where(F.col("_min") & (F.col("_l.v") > F.col(x)) & (F.col("_r.v") > F.col(x)))
    one = Window.partitionBy(*keys, "_l.p", "_r.p").orderBy(x, "_p")
    b = b.withColumn("_k", F.row_number().over(one)).where("_k = 1")
    depth = F.least(F.col("_l.v"), F.col("_r.v")) - F.col(x)
    return b.select(*keys, F.col("_p").alias("centre"), F.col("_l.p").alias("entry"), F.col("_r.p").alias("exit"), F.col(x).alias("bottom"), depth.alias("depth"), (F.col("_r.p") - F.col("_l.p")).alias("lifetime"))


def adjacent_windows(x: str, w: WindowSpec, width: int) -> tuple[Column, Column]:
    """Medians of the last ``width`` rows and of the ``width`` rows before them."""
    return trailing_median(x, w, width), lagged_median(x, w, width, width)


def displacement(long: DataFrame, keys: list[str], order: str, block: str, column: str, value: str, lag: int) -> DataFrame:
    """RMS over a block's columns of the change against ``lag`` rows before."""
    w = Window.partitionBy(*keys, block, column).orderBy(order)
    d = long.withColumn("_d", F.col(value) - F.lag(value, lag).over(w))
    return d.groupBy(*keys, order, block).agg(F.sqrt(F.avg(F.col("_d") * F.col("_d"))).alias("displacement"))


def closure_ratio(x: str, w: WindowSpec, recent: int, history: int) -> Column:
    """Recent trailing median over the median of the history before it."""
    return ratio(trailing_median(x, w, recent), lagged_median(x, w, recent, history))


def rank01(df: DataFrame, keys: list[str], x: str, name: str = "rank01") -> DataFrame:
    """Average rank scaled to [0, 1] over the group's values; NULL stays NULL, a single value gets 1."""
    w = Window.partitionBy(*keys).orderBy(x)
    there = Window.partitionBy(*keys)
    n = F.count(x).over(there)
    nulls = F.sum(F.col(x).isNull().cast("int")).over(there)
    ties = F.count("*").over(Window.partitionBy(*keys, x))
    average = F.rank().over(w) - nulls + (ties - 1) / 2
    return df.withColumn(name, F.when(F.col(x).isNotNull(), F.when(n > 1, (average - 1) / (n - 1)).otherwise(1.0)))


def percentile_rank(df: DataFrame, keys: list[str], x: str, name: str = "pct_rank") -> DataFrame:
    """Average rank over the number of values."""
    w = Window.partitionBy(*keys).orderBy(x)
    there = Window.partitionBy(*keys)
    ties = F.count("*").over(Window.partitionBy(*keys, x))
    average = F.rank().over(w) - F.sum(F.col(x).isNull().cast("int")).over(there) + (ties - 1) / 2
    return df.withColumn(name, F.when(F.col(x).isNotNull(), average / F.count(x).over(there)))


def empirical_percentile(df: DataFrame, keys: list[str], x: str, name: str = "percentile") -> DataFrame:
    """Share of the group's values at or below the row's."""
    use = df.where(F.col(x).isNotNull())
    return use.withColumn(name, F.cume_dist().over(Window.partitionBy(*keys).orderBy(x)))


def spacing(x: str, w: WindowSpec) -> dict[str, Column]:
    return {"gap_before": F.col(x) - F.lag(x).over(w), "gap_after": F.lead(x).over(w) - F.col(x)}


def chain(df: DataFrame, keys: list[str], order: list[str], prefix: str) -> DataFrame:
    """Ids in order with the ids before and after: a chain, each row the parent of the next."""
    w = over(keys, order)
    df = df.withColumn("landmark_id", F.concat(F.lit(prefix), F.lpad(F.row_number().over(w).cast("string"), 4, "0")))
    return df.withColumns({"previous_id": F.lag("landmark_id").over(w), "next_id": F.lead("landmark_id").over(w)})


def relative_change(x: str, w: WindowSpec, eps: float = 1e-12) -> Column:
    """2 |b - a| / max(|a| + |b|, eps) against the row before."""
    a, b = F.lag(x).over(w), F.col(x)
    return 2 * F.abs(b - a) / F.greatest(F.abs(a) + F.abs(b), F.lit(eps))


def plateau(df: DataFrame, keys: list[str], order: str, x: str, tolerance: float, rows: int) -> DataFrame:
    """Flags rows at which the relative change was within ``tolerance`` for ``rows`` rows in a row."""
    w = over(keys, order)
    change = ratio(F.abs(F.col(x) - F.lag(x).over(w)), F.greatest(F.abs(F.lag(x).over(w)), F.lit(1e-12)))
    df = df.withColumn("change", change).withColumn("_ok", F.coalesce(F.col("change") <= tolerance, F.lit(False)).cast("int"))
    frame = w.rowsBetween(-(rows - 1), 0)
    return df.withColumn("plateau", (F.sum("_ok").over(frame) == rows)).drop("_ok")


def due(u: str, w: WindowSpec, step: float) -> Column:
    """Whether the row is the first beyond another multiple of ``step``."""
    return F.coalesce(F.floor(F.col(u) / step) > F.lag(F.floor(F.col(u) / step)).over(w), F.lit(True))


def stability(x: str, w: WindowSpec, rows: int, eps: float = 1e-12) -> Column:
    """Range over the median of absolute values in a trailing frame."""
    frame = w.rowsBetween(-(rows - 1), 0)
    return (F.max(x).over(frame) - F.min(x).over(frame)) / F.greatest(F.percentile(F.abs(x), F.lit(0.5)).over(frame), F.lit(eps))


def greedy_separated(df: DataFrame, keys: list[str], order: str, score: str, separation: int, most: int) -> DataFrame:
    """Positions taken by descending score, each at least ``separation`` rows from those taken before.

    Greedy choice needs the order of choices: one group, a series of
    landmarks, is handled at a time.
    """
    import pandas as pd

    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in df.schema)}, pick int"

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(order, kind="mergesort").reset_index(drop=True)
        taken: list[int] = []
        for i in g[score].dropna().sort_values(ascending=False, kind="mergesort").index:
            if len(taken) < most and all(abs(i - j) >= separation for j in taken):
                taken.append(i)
        out = g.loc[taken].copy()
        out["pick"] = range(1, len(out) + 1)
        return out

    return df.groupBy(*keys).applyInPandas(run, schema)


def overlap_dedup(df: DataFrame, keys: list[str], low: str, high: str, order: list[tuple[str, bool]], level: float) -> DataFrame:
    """Intervals kept in order of quality unless one kept before overlaps by intersection over union of ``level`` or more."""
    import pandas as pd

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values([n for n, _ in order], ascending=[a for _, a in order], kind="mergesort")
        kept: list[int] = []
        for i in g.index:
            a, b = g.at[i, low], g.at[i, high]
            for j in kept:
                c, d = g.at[j, low], g.at[j, high]
                inter = max(0, min(b, d) - max(a, c) + 1)
                if inter / (b - a + d - c + 2 - inter) >= level:
                    break
            else:
                kept.append(i)
        return g.loc[kept]

    return df.groupBy(*keys).applyInPandas(run, df.schema)


def persistence_basins(df: DataFrame, keys: list[str], order: str, score: str, factor: float = 1.75, floor: float = 0.08, width: int = 3, shoulder: int = 4) -> DataFrame:
    """Basins around local minima of ``score``: as far as it stays within max(factor * s0, s0 + floor), at least ``width`` rows.

    The first and last row may be minima too. A row without a score ends a
    basin. Depth is the median of the shoulders' medians, ``shoulder`` rows on
    either side, minus s0; it is NULL without any shoulder. A key is one
    series of landmarks, whose minima are joined with its rows.
    """
    w = over(keys, order)
    rows = df.select(*keys, F.col(score).cast("double").alias("_s"), F.row_number().over(w).cast("int").alias("_p"), is_local_extremum(score, w, 1).alias("_low"))
    low = rows.where("_low and _s is not null").select(*keys, F.col("_p").alias("centre"), F.col("_s").alias("bottom"), F.greatest(factor * F.col("_s"), F.col("_s") + floor).alias("_limit"))
    beyond = F.col("_s").isNull() | (F.col("_s") > F.col("_limit"))
    reach = low.join(rows, keys).groupBy(*keys, "centre", "bottom").agg(
        F.coalesce(F.max(F.when(beyond & (F.col("_p") < F.col("centre")), F.col("_p"))), F.lit(0)).alias("_before"),
        F.coalesce(F.min(F.when(beyond & (F.col("_p") > F.col("centre")), F.col("_p"))), F.max("_p") + 1).alias("_after"),
    )
    wide = reach.where(F.col("_after") - F.col("_before") - 1 >= width)
    half = lambda side: F.percentile(F.when(side, F.col("_s")), F.lit(0.5))
    out = wide.join(rows, keys).groupBy(*keys, "centre", "bottom", "_before", "_after").agg(
        half(F.col("_p").between(F.col("_before") - (shoulder - 1), F.col("_before"))).alias("_l"), half(F.col("_p").between(F.col("_after"), F.col("_after") + (shoulder - 1))).alias("_r"),
    )
    level = F.coalesce((F.col("_l") + F.col("_r")) / 2, "_l", "_r")
    return out.select(*keys, "centre", (F.col("_before") + 1).alias("entry"), (F.col("_after") - 1).alias("exit"), "bottom", (level - F.col("bottom")).alias("depth"))


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 1e-15, a / b)


def causal_features(df: DataFrame, keys: list[str], order: str, x: str, lags: tuple[int, ...] = (1, 2, 4), recent: int = 3, history: int = 8, closure_max: float = 0.5, velocity_max: float = 0.6, acceleration_max: float = 0.6) -> DataFrame:
    """Ratios of recent to earlier medians of velocity, acceleration and displacements; every row sees earlier rows only.

    Velocity is the displacement by one row over the step of ``order``,
    acceleration its change over the step. Recent is the trailing frame of
    ``recent`` rows, history the ``history`` rows before it. Closure ratios set the
    displacement by each lag against its history.
    """
    w = over(keys, order)
    hist = w.rowsBetween(-(recent - 1) - history, -recent)
    now = w.rowsBetween(-(recent - 1), 0)
    step = F.col(order) - F.lag(order).over(w)
    out = df.withColumn("_v", _ratio(F.abs(F.col(x) - F.lag(x).over(w)), step))
    out = out.withColumn("_a", _ratio(F.abs(F.col("_v") - F.lag("_v").over(w)), step))
    for lag in lags:
        out = out.withColumn(f"_d{lag}", F.abs(F.col(x) - F.lag(x, lag).over(w)))
    middle = lambda n, frame: F.percentile(F.col(n), F.lit(0.5)).over(frame)
    for n, name in (("_v", "velocity_ratio"), ("_a", "acceleration_ratio")):
        out = out.withColumn(name, _ratio(middle(n, now), middle(n, hist)))
    for lag in lags:
        out = out.withColumn(f"_c{lag}", _ratio(F.col(f"_d{lag}"), middle(f"_d{lag}", hist)))
    closures = F.filter(F.array(*[f"_c{lag}" for lag in lags]), lambda v: v.isNotNull())
    out = out.withColumn("_c", F.array_sort(closures)).withColumn("resolved_closure_lags", F.size("_c"))
    n = F.col("resolved_closure_lags")
    mid = (F.get("_c", F.floor((n - 1) / 2).cast("int")) + F.get("_c", F.floor(n / 2).cast("int"))) / 2
    support = F.when(n > 0, F.size(F.filter("_c", lambda v: v <= closure_max)) / n).otherwise(F.lit(0.0))
    slow = F.coalesce((F.col("velocity_ratio") <= velocity_max) & (F.col("acceleration_ratio") <= acceleration_max), F.lit(False))
    out = out.withColumns({"closure_median_ratio": F.when(n > 0, mid), "closure_support": support, "slowdown": slow})
    return out.select(*df.columns, "velocity_ratio", "acceleration_ratio", "closure_median_ratio", "closure_support", "resolved_closure_lags", "slowdown")


def gate_table(features: DataFrame, velocity_max: float = 0.6, acceleration_max: float = 0.6, closure_max: float = 0.5, support: float = 0.6, least_lags: int = 2) -> DataFrame:
    """The gates of ``causal_features`` one by one, their count, and the root mean square of ratio over limit, of those that are known."""
    limits = {"velocity_ratio": velocity_max, "acceleration_ratio": acceleration_max, "closure_median_ratio": closure_max}
    ok = lambda p: F.coalesce(p, F.lit(False))
    out = features.withColumns({
        "pass_velocity": ok(F.col("velocity_ratio") <= velocity_max), "pass_acceleration": ok(F.col("acceleration_ratio") <= acceleration_max),
        "pass_closure": ok(F.col("closure_support") >= support), "pass_resolution": F.col("resolved_closure_lags") >= least_lags,
    })
    gates = [F.col(g).cast("int") for g in ("pass_velocity", "pass_acceleration", "pass_closure", "pass_resolution")]
    known = [F.col(n).isNotNull().cast("int") for n in limits]
    squares = [F.coalesce(F.pow(F.col(n) / m, 2), F.lit(0.0)) for n, m in limits.items()]
    count = sum(known[1:], known[0])
    return out.withColumns({"gate_count": sum(gates[1:], gates[0]), "plateau_distance": F.when(count > 0, F.sqrt(sum(squares[1:], squares[0]) / count))})
