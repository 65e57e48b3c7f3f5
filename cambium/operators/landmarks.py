"""Landmarks of a hierarchy from its basins: strength, why some are rejected, layers and the landmark index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cambium.functions.scalars import mean_of_present
from cambium.operators.joins import pareto_layers

TERMS = ("lifetime", "depth", "coherence")


def rank_share(x: str, keys: list[str]) -> Column:
    """(mean rank - 1) / (n - 1) among the values that are there; 1 for a single one."""
    w = Window.partitionBy(*keys, F.col(x).isNotNull())
    rank = F.rank().over(w.orderBy(x)) + (F.count("*").over(Window.partitionBy(*keys, x)) - 1) / 2
    n = F.count("*").over(w)
    return F.when(F.col(x).isNotNull(), F.when(n > 1, (rank - 1) / (n - 1)).otherwise(1.0))


def strengths(basins: DataFrame, keys: list[str], order: str, width: str, least_width: int, least_coherence: float) -> DataFrame:
    """``strength`` as the mean rank of what is known, ``landmark`` by width, coherence and strength, and ``landmark_order``.

    ``reasons`` lists the criteria that fail, separated by ``;``, or ``none``.
    """
    ok = lambda p: F.coalesce(p, F.lit(False))
    out = basins.withColumns({f"_r_{t}": rank_share(t, keys) for t in TERMS})
    out = out.withColumn("strength", mean_of_present(*[F.col(f"_r_{t}") for t in TERMS]))
    checks = {
        "width": F.col(width) >= least_width, "lifetime": F.col("lifetime").isNotNull(), "depth": F.col("depth").isNotNull(),
        "coherence": F.col("coherence") >= least_coherence, "strength": F.col("strength").isNotNull(),
    }
    reasons = F.concat_ws(";", *[F.when(~ok(p), F.lit(n)) for n, p in checks.items()])
    landmark = ok(checks["width"]) & ok(checks["coherence"]) & ok(checks["strength"])
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    return out.withColumns({"reasons": F.when(reasons == "", "none").otherwise(reasons), "landmark": landmark, "landmark_order": place}).drop(*[f"_r_{t}" for t in TERMS])


def _unit(x: str, keys: list[str]) -> Column:
    w = Window.partitionBy(*keys)
    low, high = F.min(x).over(w), F.max(x).over(w)
    return F.when(F.col(x).isNotNull(), F.when(high - low > 1e-12, (F.col(x) - low) / (high - low)).otherwise(1.0))


def landmark_index(basins: DataFrame, keys: list[str], ident: str, layers: int) -> DataFrame:
    """``layer`` by Pareto fronts over the terms (NULL beyond ``layers``), and ``lsi``, the mean of the scaled terms and of 1 / layer."""
    known = basins.where(" and ".join(f"{t} is not null" for t in TERMS))
    layer = pareto_layers(known, keys, ident, list(TERMS), layers).select(*keys, ident, "layer")
    out = basins.join(layer, [*keys, ident], "left").withColumn("_inv", 1 / F.col("layer"))
    terms = [*[_unit(t, keys) for t in TERMS], _unit("_inv", keys)]
    out = out.withColumns({f"_t{i}": t for i, t in enumerate(terms)})
    return out.withColumn("lsi", mean_of_present(*[F.col(f"_t{i}") for i in range(len(terms))])).drop("_inv", *[f"_t{i}" for i in range(len(terms))])
