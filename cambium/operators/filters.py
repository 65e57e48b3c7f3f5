"""Gates, eligibility and region filters. A predicate that is NULL is not met."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cambium.functions.scalars import c, finite, mean_of_present


def met(p: Column) -> Column:
    return F.coalesce(p, F.lit(False))


def conjunctive_gate(df: DataFrame, gates: dict[str, Column], name: str = "admissible") -> DataFrame:
    """One boolean column for each gate, and their conjunction."""
    return df.withColumns({g: met(p) for g, p in gates.items()}).withColumn(name, reduce(lambda a, b: a & b, [F.col(g) for g in gates]))


def boundary_gates(molecular_z: float, support: float, tension_z: float, pressure_z: float, floor: float, reciprocity: float | None = None) -> dict[str, Column]:
    """The boundary gates: molecular distance, mechanics support and both its z scores, communication floor, and reciprocity if asked for."""
    gates = {
        "pass_molecular": F.col("molecular_z") <= molecular_z, "pass_support": F.col("support_fraction") >= support,
        "pass_tension": F.abs("tension_z") <= tension_z, "pass_pressure": F.abs("pressure_z") <= pressure_z, "pass_communication": F.col("comm_support") >= floor,
    }
    return gates | ({} if reciprocity is None else {"pass_reciprocity": F.col("reciprocity") >= reciprocity})


def effective_gates(df: DataFrame, limits: dict[str, float], version: str) -> DataFrame:
    """Gates on a relation's effective states, and the mean of their margins as ``ordering_merit``.

    ``strength``: communication by strength and reciprocity. ``support``: by
    support, and reciprocity only where it is supported. ``open``: by support
    alone. Limits: molecular, support_fraction, tension_z, delta_p_z, strength, reciprocity.
    """
    if version not in ("strength", "support", "open"):
        raise ValueError(version)
    x = F.col
    gates = {
        "pass_molecular": x("molecular_distance") <= limits["molecular"], "pass_mechanics_support": x("mechanics_support_fraction") >= limits["support_fraction"],
        "pass_tension": x("abs_tension_z") <= limits["tension_z"], "pass_delta_p": x("abs_delta_p_z") <= limits["delta_p_z"],
    }
    inside = lambda name, most: (F.lit(most) - x(name)) / (most + 1e-12)
    margins = [inside("molecular_distance", limits["molecular"]), inside("abs_tension_z", limits["tension_z"]), inside("abs_delta_p_z", limits["delta_p_z"]), x("mechanics_support_fraction") - limits["support_fraction"]]
    if version == "strength":
        gates |= {"pass_communication_strength": x("comm_strength") >= limits["strength"], "pass_communication_reciprocity": x("comm_reciprocity") >= limits["reciprocity"]}
        margins += [(x("comm_strength") - limits["strength"]) / (abs(limits["strength"]) + 1), x("comm_reciprocity") - limits["reciprocity"]]
    else:
        there = met(x("comm_supported"))
        gates["pass_communication_support"] = there
        margins.append(F.when(there, F.log1p("comm_support")).otherwise(-1.0))
        if version == "support":
            gates["pass_communication_reciprocity"] = there & (x("comm_reciprocity") >= limits["reciprocity"])
            margins.append(F.when(there, x("comm_reciprocity") - limits["reciprocity"]).otherwise(-1.0))
    return conjunctive_gate(df, gates).withColumn("ordering_merit", mean_of_present(*margins))


def below_cost(df: DataFrame, cost: str, threshold: Column) -> DataFrame:
    """``merge_allowed``: a finite cost at or below the threshold."""
    return df.withColumn("merge_allowed", met(finite(cost) <= threshold))


def eligible(df: DataFrame, costs: list[str], flags: list[str]) -> DataFrame:
    """Rows whose flags all hold and whose costs are all finite."""
    return df.where(reduce(lambda a, b: a & b, [met(F.col(f)) for f in flags] + [finite(x).isNotNull() for x in costs]))


def at_least(df: DataFrame, level: str, order: list[str], least: str) -> DataFrame:
    """Rows whose ordinal class is ``least`` or higher; unknown classes are below all."""
    rank = F.coalesce(*[F.when(F.col(level) == v, F.lit(i)) for i, v in enumerate(order)], F.lit(-1))
    return df.where(rank >= order.index(least))


def alive_at(df: DataFrame, birth: str, death: str, t) -> DataFrame:
    """Rows whose interval [birth, death) holds t; a NULL death never comes."""
    return df.where((F.col(birth) <= c(t)) & (F.col(death).isNull() | (F.col(death) > c(t))))


def within_box(df: DataFrame, x: str, y: str, box: tuple[float, float, float, float]) -> DataFrame:
    return df.where(F.col(x).between(box[0], box[2]) & F.col(y).between(box[1], box[3]))


def nearest_to_centre(df: DataFrame, keys: list[str], x: str, y: str, ident: str, k: int) -> DataFrame:
    """The k rows of each group that are nearest its median centre, ties by id."""
    centre = df.groupBy(*keys).agg(F.percentile(F.col(x), F.lit(0.5)).alias("cx"), F.percentile(F.col(y), F.lit(0.5)).alias("cy"))
    d2 = F.pow(F.col(x) - F.col("cx"), 2) + F.pow(F.col(y) - F.col("cy"), 2)
    ranked = df.join(centre, keys).withColumn("d2", d2).withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy("d2", ident)))
    return ranked.where(F.col("rank") <= k).drop("cx", "cy")


def choose_columns(df: DataFrame, names: list[str], least_finite: float = 0.65) -> list[str]:
    """Of the named columns those with enough finite values and some spread, from one aggregate row."""
    if not names:
        return []
    aggs = [x for n in names for x in (F.avg(finite(n).isNotNull().cast("double")).alias(f"f_{n}"), F.stddev_pop(finite(n)).alias(f"s_{n}"))]
    row = df.agg(*aggs).first()
    return [n for n in names if (row[f"f_{n}"] or 0) >= least_finite and (row[f"s_{n}"] or 0) > 0]


def by_prefix(df: DataFrame, keys: list[str], blocks: dict[str, str]) -> DataFrame:
    """Long form (keys, column, value, block) of all columns whose name starts with a block's prefix; the longest prefix wins."""
    order = sorted(blocks, key=len, reverse=True)
    names = [n for n in df.columns if n not in keys and any(n.startswith(p) for p in order)]
    long = df.select(*keys, *[F.col(n).cast("double").alias(n) for n in names]).unpivot(keys, names, "column", "value")
    return long.withColumn("block", F.coalesce(*[F.when(F.col("column").startswith(p), F.lit(blocks[p])) for p in order]))
