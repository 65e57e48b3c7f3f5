"""Vector state on nodes and edges: distances, communication channels, covectors, metrics, transport.

States are arrays of double. Dense matrices (a metric over a few hundred
dimensions) are parameters and travel in closures; kernels that need linear
algebra are NumPy over Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cambium.functions.scalars import c, clip, ratio
from cambium.scratch import dropped, written


def functional_prior(sets: DataFrame, layer: str = "layer") -> DataFrame:
    """(i, j, w, laplacian) of members: cliques of 1 / (k - 1) by set, each layer over its median positive degree, layers averaged.

    ``sets`` has (layer, set, member); L = D^-1/2 (D - W) D^-1/2, without rows for isolated members.
    """
    s = sets.where(F.col(layer).isNotNull() & F.col("set").isNotNull()).groupBy(layer, "set").agg(F.collect_set("member").alias("m"), F.max(F.col("member").isNull().cast("int")).alias("_null"))
    s = s.withColumn("k", F.size("m") + F.col("_null")).where("k >= 2")
    pairs = s.select(layer, "m", "k", F.explode("m").alias("i")).select(layer, "k", "i", F.explode("m").alias("j")).where("i <> j")
    w = written(pairs.groupBy(layer, "i", "j").agg(F.sum(1.0 / (F.col("k") - 1)).alias("w")), "layers")  # read twice, as the average is
    degree = w.groupBy(layer, "i").agg(F.sum("w").alias("d")).groupBy(layer).agg(F.percentile("d", F.lit(0.5)).alias("md"))
    layers = sets.agg(F.count_distinct(layer).alias("n"))
    avg = w.join(degree, layer).crossJoin(F.broadcast(layers)).groupBy("i", "j").agg((F.sum(F.col("w") / F.col("md")) / F.first("n")).alias("w"))
    avg = written(avg, "prior")
    dropped(w)
    d = avg.groupBy("i").agg(F.sum("w").alias("d"))
    out = avg.join(d.select("i", F.col("d").alias("di")), "i").join(d.select(F.col("i").alias("j"), F.col("d").alias("dj")), "j")
    off = out.select("i", "j", "w", (-F.col("w") / F.sqrt(F.col("di") * F.col("dj"))).alias("laplacian"))
    return off.unionByName(d.select("i", F.col("i").alias("j"), F.lit(0.0).alias("w"), F.lit(1.0).alias("laplacian")))


def metric_distance(edges: DataFrame, a: str, b: str, laplacian: np.ndarray, lam: float, name: str = "distance") -> DataFrame:
    """sqrt(max(0, d.d + lam d' L d)) of d = b - a for each edge; NULL if a state is."""

    @F.pandas_udf("double")
    def kernel(x: pd.Series, y: pd.Series) -> pd.Series:
        ok = (x.notna() & y.notna()).to_numpy()
        out = np.full(len(x), np.nan)
        if ok.any():
            d = np.stack(y[ok].to_numpy()).astype(float) - np.stack(x[ok].to_numpy()).astype(float)
            out[ok] = np.sqrt(np.maximum(0.0, (d * d).sum(1) + lam * np.einsum("ni,ij,nj->n", d, laplacian, d)))
        return pd.Series(out).where(ok, None)

    return edges.withColumn(name, kernel(a, b))


def channel_flux(edges: DataFrame, registry: list[tuple[int, int, str]], a: str = "state_i", b: str = "state_j") -> DataFrame:
    """One row for each edge and registered interaction (sender, receiver dimension, kind): flux both ways.

    flux(i -> j) = sqrt(max(0, i's sender) * max(0, j's receiver)).
    """
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("channel"), F.lit(s).alias("s"), F.lit(t).alias("t"), F.lit(kind).alias("kind")) for k, (s, t, kind) in enumerate(registry)]))
    e = edges.withColumn("r", rows)

    def pos(v: str, at: Column) -> Column:
        return F.greatest(F.lit(0.0), F.element_at(F.col(v), at + 1).cast("double"))

    flux = lambda x, y: F.sqrt(pos(x, F.col("r.s")) * pos(y, F.col("r.t")))
    return e.select(*[n for n in edges.columns if n not in (a, b)], "r.channel", "r.kind", flux(a, b).alias("f_ij"), flux(b, a).alias("f_ji"))


def communication(flux: DataFrame, keys: list[str]) -> DataFrame:
    """By edge: mean over kinds of the mean flux of a kind, both ways, strength ln(1 + total) and reciprocity."""
    kind = flux.groupBy(*keys, "kind").agg(F.avg("f_ij").alias("ij"), F.avg("f_ji").alias("ji"))
    e = kind.groupBy(*keys).agg(F.avg("ij").alias("comm_ij"), F.avg("ji").alias("comm_ji"), F.count("*").alias("n_kinds"))
    total = F.col("comm_ij") + F.col("comm_ji")
    return e.withColumns({"comm_strength": F.log1p(total), "comm_reciprocity": clip(1 - F.abs(F.col("comm_ij") - F.col("comm_ji")) / (total + 1e-12), 0.0, 1.0)})


def channel_balance(flux: DataFrame, keys: list[str]) -> DataFrame:
    """By edge: net asymmetry of totals, directional content of channels, and how much of it cancels."""
    t = flux.groupBy(*keys).agg(F.sum("f_ij").alias("ij"), F.sum("f_ji").alias("ji"), F.sum(F.abs(F.col("f_ij") - F.col("f_ji"))).alias("content"))
    total = F.col("ij") + F.col("ji")
    return t.select(*keys, ratio(F.col("ij") - F.col("ji"), total).alias("net_asymmetry"), ratio("content", total).alias("directional_content"), (1 - F.coalesce(ratio(F.abs(F.col("ij") - F.col("ji")), "content"), F.lit(1.0))).alias("cancellation"))


def node_covectors(flux: DataFrame, registry: list[tuple[int, int, str]], i: str, j: str) -> DataFrame:
    """(node, dim, b): signed channel differences at both ends over the node's total flux."""
    dims = F.element_at(F.array(*[F.array(F.lit(s), F.lit(t)) for s, t, _ in registry]), F.col("channel") + 1)
    d = (F.col("f_ij") - F.col("f_ji")).alias("d")
    f = flux.select(F.col(i).alias("i"), F.col(j).alias("j"), dims.alias("dims"), d, (F.col("f_ij") + F.col("f_ji")).alias("s"))
    rows = F.explode(F.array(
        F.struct(F.col("i").alias("node"), F.col("dims")[0].alias("dim"), F.col("d").alias("v")), F.struct(F.col("i").alias("node"), F.col("dims")[1].alias("dim"), (-F.col("d")).alias("v")),
        F.struct(F.col("j").alias("node"), F.col("dims")[0].alias("dim"), (-F.col("d")).alias("v")), F.struct(F.col("j").alias("node"), F.col("dims")[1].alias("dim"), F.col("d").alias("v")),
    ))
    signed = f.select(rows.alias("r")).select("r.*").groupBy("node", "dim").agg(F.sum("v").alias("v"))
    ends = f.select(F.explode(F.array("i", "j")).alias("node"), "s").groupBy("node").agg(F.sum("s").alias("support"))
    return signed.join(ends, "node").select("node", "dim", F.coalesce(ratio("v", "support"), F.lit(0.0)).alias("b"))


def pair_cost(edges: DataFrame, metric: np.ndarray, a: str, b: str, beta_a: str, beta_b: str, name: str = "pair_cost") -> DataFrame:
    """sqrt(max(0, v'Gv)) + (b_A - b_B).v / 2 of v = B - A: half the cost there plus half the cost back. NULL if a part is missing."""

    @F.pandas_udf("double")
    def kernel(x: pd.Series, y: pd.Series, p: pd.Series, q: pd.Series) -> pd.Series:
        def whole(v):
            return v is not None and not np.isnan(np.asarray(v, float)).any()

        ok = np.array([all(whole(v) for v in r) for r in zip(x, y, p, q, strict=True)], bool)
        out = np.full(len(x), np.nan)
        if ok.any():
            s = [np.stack(z[ok].to_numpy()).astype(float) for z in (x, y, p, q)]
            v = s[1] - s[0]
            out[ok] = np.sqrt(np.maximum(0.0, np.einsum("ni,ij,nj->n", v, metric, v))) + 0.5 * ((s[2] - s[3]) * v).sum(1)
        return pd.Series(out).where(ok, None)

    return edges.withColumn(name, kernel(a, b, beta_a, beta_b))


def block_metric(laplacian: np.ndarray, lam: float, tension_weight: float, pressure_weight: float) -> np.ndarray:
    """Block diagonal of I + lam L and the weights of the two mechanical dimensions."""
    n = len(laplacian)
    g = np.zeros((n + 2, n + 2))
    g[:n, :n] = np.eye(n) + lam * laplacian
    g[n, n], g[n + 1, n + 1] = tension_weight, pressure_weight
    return g


def certify_metric(g: np.ndarray) -> dict:
    """Symmetry error, extreme eigenvalues, condition number, and whether the metric is positive definite."""
    values = np.linalg.eigvalsh((g + g.T) / 2)
    return {"symmetry_error": float(np.abs(g - g.T).max()), "least": float(values[0]), "largest": float(values[-1]), "condition": float(values[-1] / values[0]) if values[0] > 0 else float("inf"), "positive": bool(values[0] > 0)}


def dual_norms(nodes: DataFrame, metric: np.ndarray, b: str, name: str = "dual_norm") -> DataFrame:
    """sqrt(b' G^-1 b) by Cholesky."""
    lower = np.linalg.cholesky(metric)

    @F.pandas_udf("double")
    def kernel(x: pd.Series) -> pd.Series:
        z = np.linalg.solve(lower, np.stack(x.to_numpy()).astype(float).T)
        return pd.Series(np.sqrt((z * z).sum(0)))

    return nodes.withColumn(name, kernel(b))


def whitened(nodes: DataFrame, metric: np.ndarray, b: str, name: str = "q") -> DataFrame:
    """H^-1 b for the symmetric square root H of the metric."""
    values, vectors = np.linalg.eigh(metric)
    inverse = (vectors / np.sqrt(values)) @ vectors.T

    @F.pandas_udf("array<double>")
    def kernel(x: pd.Series) -> pd.Series:
        return pd.Series(list(np.stack(x.to_numpy()).astype(float) @ inverse))

    return nodes.withColumn(name, kernel(b))


def scale_to(df: DataFrame, norm: str, target: float) -> Column:
    """kappa = target / largest norm, as one number; 1 if all are 0."""
    most = df.agg(F.max(norm)).first()[0]
    return F.lit(target / most if most else 1.0)


def directional_norm(g: np.ndarray, b: np.ndarray, v: np.ndarray) -> float:
    """sqrt(v'Gv) + b.v."""
    return float(np.sqrt(max(0.0, v @ g @ v)) + b @ v)


def reversal_ratio(g: np.ndarray, b: np.ndarray, v: np.ndarray, eps: float = 1e-12) -> float:
    """max of F(v) / F(-v) and its inverse."""
    there, back = directional_norm(g, b, v), directional_norm(g, b, -v)
    return max(there / max(back, eps), back / max(there, eps))


def reversal_bound(rho: float) -> float:
    """(1 + rho) / (1 - rho), the worst reversal ratio for a dual norm rho below 1."""
    return (1 + rho) / (1 - rho) if rho < 1 else float("inf")


def rotate(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The least rotation that takes direction a to direction b, applied to x (rows); undefined for opposite ones.

    Written in the orthonormal basis (p, q) of the plane of a and b, so that
    nothing is divided by 1 + cos and directions that are nearly opposite keep
    their digits.
    """
    p, w = a / np.linalg.norm(a), b / np.linalg.norm(b)
    cos = float(np.clip(p @ w, -1.0, 1.0))
    if cos <= -1 + 1e-9:
        raise ValueError("opposite directions have no least rotation")
    rest = w - cos * p
    sin = float(np.linalg.norm(rest))
    if sin <= 1e-14:
        return x.copy()
    plane = np.stack([p, rest / sin])
    length = np.hypot(cos, sin)
    turn = np.array([[cos, sin], [-sin, cos]]) / length
    inside = x @ plane.T
    return x + (inside @ turn - inside) @ plane


def loop_holonomy(q: dict[int, np.ndarray], loop: list[int]) -> dict:
    """Product of least rotations around a loop in the span of its vectors: spectral angles and checks."""
    basis = np.linalg.svd(np.stack([q[n] for n in loop]), full_matrices=False)
    u = basis[2][basis[1] > 1e-12 * max(basis[1][0], 1e-300)]
    h = np.eye(len(u))
    for a, b in zip(loop, [*loop[1:], loop[0]], strict=True):
        h = rotate(u @ q[a], u @ q[b], h.T).T
    angles = np.abs(np.angle(np.linalg.eigvals(h)))
    return {"rank": len(u), "angle_rms": float(np.sqrt(np.mean(angles**2))), "angle_max": float(angles.max()), "orthogonality_error": float(np.abs(h @ h.T - np.eye(len(u))).max()), "matrix": h}


def loops_holonomy(loops: DataFrame, vectors: DataFrame) -> DataFrame:
    """For each loop (loop_id, array of nodes) its holonomy, from (node, q): vectors join their loops, kernels see one loop."""
    steps = loops.select("loop_id", F.posexplode("nodes").alias("pos", "node")).join(vectors.select("node", "q"), "node")
    packed = steps.groupBy("loop_id").agg(F.array_sort(F.collect_list(F.struct("pos", "node", "q"))).alias("s"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in frames:
            rows = []
            for ident, s in zip(g["loop_id"], g["s"], strict=True):
                nodes = [int(r["node"]) for r in s]
                q = {int(r["node"]): np.asarray(r["q"], float) for r in s}
                try:
                    m = loop_holonomy(q, nodes)
                    rows.append((ident, "RESOLVED", m["rank"], m["angle_rms"], m["angle_max"], m["orthogonality_error"]))
                except (ValueError, ZeroDivisionError, FloatingPointError):
                    rows.append((ident, "UNRESOLVED", None, None, None, None))
            yield pd.DataFrame(rows, columns=["loop_id", "status", "rank", "angle_rms", "angle_max", "orthogonality_error"]).astype({"rank": "Int32"})

    return packed.mapInPandas(run, f"loop_id {loops.schema['loop_id'].dataType.simpleString()}, status string, rank int, angle_rms double, angle_max double, orthogonality_error double")


def mean_state(cells: DataFrame, labels: DataFrame, state: str, cell: str = "cell") -> DataFrame:
    """Mean vector of a node's cells and their number, dimension by dimension."""
    long = cells.select(cell, F.posexplode(state).alias("dim", "v")).join(labels.select(cell, "node"), cell)
    dims = long.groupBy("node", "dim").agg(F.avg(F.col("v").cast("double")).alias("v"), F.count("*").alias("size"))
    return dims.groupBy("node").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "v"))), lambda x: x["v"]).alias("state"), F.first("size").alias("size"))


def geometric_activity(state: str, members: list[int], eps: float = 1e-8) -> Column:
    """Geometric mean of the members' values, each raised by eps."""
    logs = [F.ln(F.greatest(F.lit(0.0), F.element_at(c(state), m + 1).cast("double")) + eps) for m in members]
    return F.exp(sum(logs[1:], logs[0]) / len(logs))
