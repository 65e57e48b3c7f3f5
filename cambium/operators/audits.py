"""Data-quality audits as one-row or few-row tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cambium.functions.scalars import ratio, verdict

#: Bits of an interface's flags.
GEOMETRY, TENSION, PRESSURE, PROVENANCE, CELL_CELL, BACKGROUND = (1 << k for k in range(6))


def flags(**bits: Column) -> Column:
    """One integer of the named bits; a NULL condition leaves its bit 0."""
    names = {"geometry": GEOMETRY, "tension": TENSION, "pressure": PRESSURE, "provenance": PROVENANCE, "cell_cell": CELL_CELL, "background": BACKGROUND}
    return reduce(lambda a, b: a + b, [F.when(F.coalesce(cond, F.lit(False)), names[n]).otherwise(0) for n, cond in bits.items()])


def has_flag(x: str, bit: int) -> Column:
    return F.col(x).bitwiseAND(F.lit(bit)) != 0


def build_cells(order: DataFrame, measured: DataFrame, patches: DataFrame) -> DataFrame:
    """Cells in matrix order (barcode, position) with their measurements; without a patch they are kept in patch -1."""
    return order.join(measured, "cell_id", "left").join(patches, "cell_id", "left").select(F.col("position").alias("cell_index"), "cell_id", F.coalesce("patch_id", F.lit(-1)).cast("int").alias("patch_id"), "x", "y", "area")


def build_interfaces(raw: DataFrame, cells: DataFrame, tension: DataFrame, pressure: DataFrame) -> DataFrame:
    """Interfaces by cell index with certified mechanics attached where there are any, and flags.

    An interface without a second cell faces the background and carries no mechanics.
    """
    ix = cells.select("cell_id", "cell_index")
    i = ix.withColumnsRenamed({"cell_id": "cell_i", "cell_index": "cell_i_index"})
    j = ix.withColumnsRenamed({"cell_id": "cell_j", "cell_index": "cell_j_index"})
    out = raw.join(i, "cell_i", "left").join(j, "cell_j", "left").join(tension, "interface_id", "left").join(pressure, "interface_id", "left")
    pair = F.col("cell_j_index").isNotNull()
    out = out.withColumns({"tension": F.when(pair, F.col("tension")), "pressure": F.when(pair, F.col("pressure"))})
    return out.withColumn("flags", flags(geometry=F.col("length").isNotNull(), tension=F.col("tension").isNotNull(), pressure=F.col("pressure").isNotNull(), cell_cell=pair, background=~pair))


def dangling(refs: DataFrame, columns: list[str], valid: DataFrame, key: str) -> DataFrame:
    """References (column, value, n) that point at no valid row; NULL points at nothing and is no fault."""
    long = refs.select(F.explode(F.array(*[F.struct(F.lit(x).alias("column"), F.col(x).alias("value")) for x in columns])).alias("r")).select("r.*").where("value is not null")
    return long.join(valid.select(F.col(key).alias("value")).distinct(), "value", "left_anti").groupBy("column", "value").agg(F.count("*").alias("n"))


def level0_audit(cells: DataFrame, matrix: DataFrame, key: str) -> DataFrame:
    """One row: duplicates on either side, keys on one side only, whether sets and order agree."""
    a = cells.groupBy(key).agg(F.count("*").alias("na"), F.min("position").alias("pa"))
    b = matrix.groupBy(key).agg(F.count("*").alias("nb"), F.min("position").alias("pb"))
    j = a.join(b, key, "full_outer")
    out = j.agg(F.count_if(F.col("na") > 1).alias("duplicate_cells"), F.count_if(F.col("nb") > 1).alias("duplicate_columns"), F.count_if(F.col("nb").isNull()).alias("cells_only"), F.count_if(F.col("na").isNull()).alias("matrix_only"), F.count_if(F.col("pa") != F.col("pb")).alias("moved"))
    return out.withColumns({"same_set": (F.col("cells_only") + F.col("matrix_only")) == 0, "same_order": (F.col("cells_only") + F.col("matrix_only") + F.col("moved")) == 0})


def missing_pattern(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows by pattern: all values there, none (allowed), or some (a fault)."""
    n = reduce(lambda a, b: a + b, [F.col(x).isNotNull().cast("int") for x in columns])
    kind = F.when(n == len(columns), "complete").when(n == 0, "missing").otherwise("partial")
    return df.groupBy(kind.alias("pattern")).agg(F.count("*").alias("rows"))


def exhaustion(steps: DataFrame, keys: list[str], order: str) -> DataFrame:
    """By sample: the last step's candidates and admissible edges, and whether it ended for want of these."""
    last = steps.groupBy(*keys).agg(F.max_by(F.struct("superedges", "merge_allowed"), order).alias("l"), F.max(order).alias("last_step"))
    return last.select(*keys, "last_step", "l.superedges", "l.merge_allowed", ((F.col("l.merge_allowed") == 0) & (F.col("l.superedges") > 0)).alias("exhausted"))


def construction(steps: DataFrame, keys: list[str], order: str) -> DataFrame:
    """By sample: nodes at both ends, merges, removed fraction and the residual N0 - merges - final, which must be 0."""
    g = steps.groupBy(*keys).agg(F.min_by("nodes_before", order).alias("level0"), F.max_by("nodes_after", order).alias("final"), F.sum("merges").alias("merges"), F.count("*").alias("microsteps"))
    return g.withColumns({"removed_fraction": ratio("merges", "level0"), "accounting_residual": F.col("level0") - F.col("merges") - F.col("final")})


def shape_contract(df: DataFrame, keys: list[str], case: str, rows: int, cases: int) -> DataFrame:
    """By group: rows and distinct cases against what is expected."""
    g = df.groupBy(*keys).agg(F.count("*").alias("rows"), F.count_distinct(case).alias("cases"))
    return g.withColumn("status", verdict((F.col("rows") == rows) & (F.col("cases") == cases), F.col("cases") == cases))


def scale_consistency(df: DataFrame, keys: list[str], x: str, y: str, worst: float = 20.0) -> DataFrame:
    """By sample: extent, and its ratio to the median extent; a ratio beyond ``worst`` either way warns."""
    e = df.groupBy(*keys).agg(F.greatest(F.max(x) - F.min(x), F.max(y) - F.min(y)).alias("extent"))
    mid = F.percentile("extent", F.lit(0.5)).over(Window.partitionBy())
    r = ratio("extent", mid)
    return e.withColumns({"ratio": r, "status": verdict(r.between(1 / worst, worst), F.lit(True))})


def exact_copy(left: DataFrame, right: DataFrame, key: str, value: str) -> DataFrame:
    """One row: rows, keys on one side only, values that differ in any bit."""
    j = left.select(key, F.col(value).alias("a")).join(right.select(key, F.col(value).alias("b")), key, "full_outer").withColumn("n", F.lit(1))
    a, b = F.col("a"), F.col("b")
    return j.agg(F.count("n").alias("rows"), F.count_if(~a.eqNullSafe(b)).alias("differences"))
