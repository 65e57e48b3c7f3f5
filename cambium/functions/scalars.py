"""Scalar expressions. NULL means missing or unresolved; nothing is imputed."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def c(x: Column | str | float) -> Column:
    """A column from a name, or a literal from a number."""
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def finite(x: Column | str) -> Column:
    """The value, or NULL if it is NaN or infinite."""
    x = c(x).cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def finite_columns(df: DataFrame) -> DataFrame:
    """Every float column through ``finite``: the rule at ingest."""
    return df.withColumns({n: finite(n) for n, t in df.dtypes if t in ("float", "double")})


def ratio(a, b) -> Column:
    """a / b, NULL if b is 0 or either is NULL."""
    return F.try_divide(c(a).cast("double"), c(b).cast("double"))


def clip(x, low: float, high: float) -> Column:
    """Clamp to [low, high]; NULL stays NULL."""
    x = c(x)
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def robust_z(x, median, q25, q75, eps: float = 1e-9) -> Column:
    """(x - median) / (IQR + eps), without the normal-consistency factor."""
    return (c(x) - c(median)) / (c(q75) - c(q25) + eps)


def mad_z(x, median, mad, sd) -> Column:
    """(x - median) over 1.4826 MAD, else over the standard deviation, else over 1."""
    scale = F.when(c(mad) > 0, c(mad) * 1.4826).when(c(sd) > 0, c(sd)).otherwise(1.0)
    return (c(x) - c(median)) / scale


def robust_scale(iqr, mad, sd, n) -> Column:
    """IQR / 1.349, else 1.4826 MAD, else the standard deviation; NULL below 4 values or without spread."""
    return F.when(c(n) >= 4, F.when(c(iqr) > 0, c(iqr) / 1.349).when(c(mad) > 0, c(mad) * 1.4826).when(c(sd) > 0, c(sd)))


def support(ij, ji) -> Column:
    """What flows both ways in total; NULL counts as no flow."""
    return F.greatest(F.lit(0.0), F.coalesce(c(ij), F.lit(0.0))) + F.greatest(F.lit(0.0), F.coalesce(c(ji), F.lit(0.0)))


def directionality(ij, ji, floor: float = 0.0, eps: float = 1e-12) -> Column:
    """Signed (ij - ji) / (ij + ji) in [-1, 1] where the support reaches the floor, else NULL."""
    s = support(ij, ji)
    return F.when((s >= floor) & (s > 0), clip((F.coalesce(c(ij), F.lit(0.0)) - F.coalesce(c(ji), F.lit(0.0))) / (s + eps), -1.0, 1.0))


def reciprocity(ij, ji, floor: float = 0.0, eps: float = 1e-12) -> Column:
    """1 - |ij - ji| / (ij + ji) in [0, 1] where the support reaches the floor, else NULL."""
    s = support(ij, ji)
    return F.when((s >= floor) & (s > 0), clip(1 - F.abs(c(ij) - c(ji)) / (s + eps), 0.0, 1.0))


def mean_of_present(*terms) -> Column:
    """Mean of the terms that aren't NULL; NULL if all are."""
    there = F.filter(F.array(*[c(t).cast("double") for t in terms]), lambda x: x.isNotNull())
    return F.when(F.size(there) > 0, F.aggregate(there, F.lit(0.0), lambda a, x: a + x) / F.size(there))


def rms_of_present(*terms) -> Column:
    """Root mean square of the terms that aren't NULL."""
    return F.sqrt(mean_of_present(*[c(t) * c(t) for t in terms]))


def log_sum_exp_cost(terms: list[tuple[Column, Column, float, Column]], beta: float = 3.0, missing: float = 0.35) -> Column:
    """Composite cost of channels (penalty, reliability, weight, resolved).

    Soft maximum of the penalties, weighted by reliability times weight, plus
    a charge for the share of weight that has no evidence. Infinite without any.
    """
    w = [F.when(ok & p.isNotNull(), r * k).otherwise(0.0) for p, r, k, ok in terms]
    total = reduce(lambda a, b: a + b, w)
    shift = F.greatest(*[F.when(x > 0, p) for x, (p, *_) in zip(w, terms, strict=True)], F.lit(None).cast("double"))
    mixed = reduce(lambda a, b: a + b, [F.when(x > 0, x * F.exp(beta * (p - shift))).otherwise(0.0) for x, (p, *_) in zip(w, terms, strict=True)])
    cost = shift + F.ln(mixed / total) / beta + missing * (1 - total / sum(k for *_, k, _ in terms))
    return F.when(total > 1e-12, cost).otherwise(float("inf"))


def penalty(x, scale) -> Column:
    """ln(1 + max(x, 0) / scale)."""
    return F.log1p(F.greatest(c(x), F.lit(0.0)) / c(scale))


def affinity_penalty(x, scale) -> Column:
    """exp(-max(x, 0) / scale): more of x costs less."""
    return F.exp(-F.greatest(c(x), F.lit(0.0)) / c(scale))


def scale_threshold(tau0, tau_max, mean_size) -> Column:
    """min(tau_max, tau0 * (1 + 0.4 ln(1 + max(0, size - 1))))."""
    return F.least(c(tau_max), c(tau0) * (1 + 0.4 * F.log1p(F.greatest(F.lit(0.0), c(mean_size) - 1))))


def adaptive_hops(mean_size, base: int = 1, most: int = 4) -> Column:
    """min(most, base + floor(log2(mean size)))."""
    return F.least(F.lit(most), F.lit(base) + F.floor(F.log2(F.greatest(c(mean_size), F.lit(1.0))))).cast("int")


def spatial_expression_weight(distance, radius, dissimilarity, scale) -> Column:
    """exp(-(d / r)^2 - (e / s)^2)."""
    return F.exp(-F.pow(ratio(distance, radius), 2) - F.pow(ratio(dissimilarity, scale), 2))


def normalised_expression(x, library, target) -> Column:
    """ln(1 + x * target / library); an empty library gives 0."""
    return F.log1p(F.coalesce(ratio(c(x) * c(target), library), F.lit(0.0)))


def canonical_pair(df: DataFrame, i: str, j: str) -> DataFrame:
    """Endpoints as (least, greatest), without self-pairs and pairs with a NULL end."""
    df = df.where(F.col(i).isNotNull() & F.col(j).isNotNull() & (F.col(i) != F.col(j)))
    return df.withColumns({i: F.least(i, j), j: F.greatest(i, j)})


def pick_column(columns: list[str], aliases: list[str]) -> str | None:
    """The first alias that is a column, ignoring case."""
    there = {n.lower(): n for n in columns}
    return next((there[a.lower()] for a in aliases if a.lower() in there), None)


def resolve_columns(df: DataFrame, wanted: dict[str, list[str]]) -> DataFrame:
    """Select columns under their standard names, each from the first alias present. A missing one is an error."""
    found = {name: pick_column(df.columns, aliases) for name, aliases in wanted.items()}
    if gone := [n for n, a in found.items() if a is None]:
        raise ValueError(f"no column for {', '.join(gone)}")
    return df.select(*[F.col(a).alias(n) for n, a in found.items()])


def status_to_float(x) -> Column:
    """PASS-like strings to 1, FAIL-like ones to 0, others NULL."""
    s = F.upper(F.trim(c(x).cast("string")))
    return F.when(s.isin("PASS", "PASSED", "TRUE", "YES", "OK", "1", "1.0"), 1.0).when(s.isin("FAIL", "FAILED", "FALSE", "NO", "0", "0.0"), 0.0)


def unassigned(x) -> Column:
    """Whether an id says "not assigned": NULL, blank, or one of the sentinels."""
    s = F.upper(F.trim(c(x).cast("string")))
    return F.coalesce(s.isin("", "UNASSIGNED", "0", "-1", "NONE", "NAN", "NULL", "4294967295"), F.lit(True))


def complex_parts(x) -> Column:
    """Members of a complex name: split at separators, upper case, no blanks, each once, in order."""
    parts = F.transform(F.split(c(x), r"[_+&|:/\s]+"), lambda p: F.upper(F.trim(p)))
    return F.array_distinct(F.filter(parts, lambda p: p != ""))


def member_list(x) -> Column:
    """Integers of a member list written as ``[1, 2]``, ``1;2`` or ``1,2``."""
    parts = F.split(F.regexp_replace(c(x), r"[\[\]\(\)\s]", ""), "[;,]")
    return F.transform(F.filter(parts, lambda p: p != ""), lambda p: p.cast("long"))


def polygon_area(points) -> Column:
    """Shoelace area of an array of structs (x, y)."""
    p = c(points)
    nxt = F.concat(F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(0))), F.slice(p, 1, 1))
    cross = F.zip_with(p, nxt, lambda a, b: a["x"] * b["y"] - b["x"] * a["y"])
    return F.abs(F.aggregate(cross, F.lit(0.0), lambda s, v: s + v)) / 2


def polygon_perimeter(points) -> Column:
    p = c(points)
    nxt = F.concat(F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(0))), F.slice(p, 1, 1))
    side = F.zip_with(p, nxt, lambda a, b: F.sqrt(F.pow(a["x"] - b["x"], 2) + F.pow(a["y"] - b["y"], 2)))
    return F.aggregate(side, F.lit(0.0), lambda s, v: s + v)


def compactness(area, perimeter) -> Column:
    """4 pi area / perimeter^2; NULL for a degenerate outline."""
    return ratio(4 * 3.141592653589793 * c(area), F.pow(c(perimeter), 2))


def holonomy_density(angle, area, resolved, tolerance: float = 1e-12) -> Column:
    """angle / area where the loop is resolved and its area isn't degenerate."""
    return F.when(F.coalesce(c(resolved), F.lit(False)) & (c(area) > tolerance), c(angle) / c(area))


def tail_threshold(q999, median, spread) -> Column:
    """max(99.9 % quantile, median + 50 spreads)."""
    return F.greatest(c(q999), c(median) + 50 * c(spread))


def verdict(passes, warns) -> Column:
    """PASS, WARN or FAIL from two conditions; NULL counts as not met."""
    return F.when(F.coalesce(passes, F.lit(False)), "PASS").when(F.coalesce(warns, F.lit(False)), "WARN").otherwise("FAIL")


# --- vectors as arrays ---


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(c(a), c(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def distance(a, b) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(c(a), c(b), lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, v: s + v))


def cosine(a, b) -> Column:
    """Cosine in [-1, 1]; 0 if either vector is zero."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, clip(dot(a, b) / norm, -1.0, 1.0)).otherwise(0.0)


def transport_class(dot_ij, norm_i, norm_j, eps: float = 1e-12, antipodal: float = 1e-9) -> Column:
    """IDENTITY (both zero), ONE_SIDED, ANTIPODAL or ROTATION of two whitened vectors."""
    cos = clip(ratio(dot_ij, c(norm_i) * c(norm_j)), -1.0, 1.0)
    zero_i, zero_j = c(norm_i) <= eps, c(norm_j) <= eps
    return F.when(zero_i & zero_j, "IDENTITY").when(zero_i | zero_j, "ONE_SIDED").when(cos <= -1 + antipodal, "ANTIPODAL").otherwise("ROTATION")
