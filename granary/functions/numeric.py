"""Numbers as the scoring contract has them: scores in doubles, rounded half up to six places."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: The rank offset of reciprocal fusion, the least norm and scale, and the largest code.
RRF_OFFSET, LEAST, TOP_CODE = 60, 1e-12, 127


def vector(xs: Sequence[float]) -> Column:
    """A constant array<double>, as one piece of SQL: a call for each number would cost more than the search."""
    return F.expr("array(" + ", ".join(f"{float(x)!r}D" for x in xs) + ")")


def round_half_up(x: Column, places: int) -> Column:
    """floor(x * 10^p + 0.5) / 10^p; unlike round(), halves of negative numbers go up too."""
    by = float(10**places)
    return F.floor(x * by + 0.5) / F.lit(by)


def round6(x: Column) -> Column:
    return round_half_up(x, 6)


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def l2_normalize(v: Column) -> Column:
    """A zero vector is divided by LEAST, and so stays zero."""
    return F.transform(F.array(F.struct(doubles(v).alias("v"), norm(v).alias("n"))), lambda s: F.transform(s["v"], lambda x: x / F.when(s["n"] == 0, LEAST).otherwise(s["n"])))[0]


def scale_of(v: Column) -> Column:
    return F.greatest(F.lit(LEAST), F.array_max(F.transform(doubles(v), F.abs))) / F.lit(float(TOP_CODE))


def quantize(v: Column, scale: Column) -> Column:
    """Symmetric codes in -127..127 with one scale a vector."""
    code = lambda x: F.greatest(F.lit(-TOP_CODE), F.least(F.lit(TOP_CODE), F.floor(x / scale + 0.5)))
    return F.transform(doubles(v), lambda x: code(x).cast("tinyint"))


def dequantize(codes: Column, scale: Column) -> Column:
    """Each product is rounded to single precision, as stored vectors are."""
    return F.transform(codes, lambda c: (c.cast("double") * scale.cast("double")).cast("float"))


def project(v: Column, components: list[list[float]], mean: list[float]) -> Column:
    """Rows of ``components`` times the centred vector, normalised; between the steps values are in single precision."""
    if any(len(r) != len(mean) for r in components):
        raise ValueError("components and mean differ in their dimension")
    centred = F.zip_with(v, vector(mean), lambda x, m: (x.cast("double") - m).cast("float"))
    rows = F.array(*map(vector, components))
    out = F.transform(F.array(centred), lambda c: F.transform(rows, lambda r: dot(r, c).cast("float")))[0]
    return l2_normalize(out).cast("array<float>")


def clamp_limit(value: object, default: int = 20, most: int = 1000) -> int:
    """A limit: absent or not finite gives the default, else rounded down into 0..most."""
    try:
        x = float(value)  # type: ignore[arg-type]
    except (TypeError, ValueError):
        return default
    return default if not math.isfinite(x) else max(0, min(most, math.floor(x)))


def masked_mean(states: Column, mask: Column, dim: int) -> Column:
    """The mean of the states that the mask leaves; zeros if it leaves none."""
    zero = F.array_repeat(F.lit(0.0), dim)
    total = F.aggregate(F.zip_with(states, mask, lambda s, m: F.transform(s, lambda x: x.cast("double") * m)), zero, lambda a, s: F.zip_with(a, s, lambda x, y: x + y))
    n = F.aggregate(mask, F.lit(0.0), lambda a, m: a + m)
    return F.transform(total, lambda x: x / F.greatest(n, F.lit(1e-9)))


def at_share(rows: DataFrame, group: str, value: str, share: float) -> DataFrame:
    """(group, value): of each group's values in order that at place floor(n * share), from 0. No group is collected."""
    w = Window.partitionBy(group)
    placed = rows.select(group, value, F.row_number().over(w.orderBy(F.asc(value))).alias("r"), F.count("*").over(w).alias("n"))
    return placed.filter(F.col("r") == F.floor(F.col("n") * share) + 1).select(group, value)


def limit_of(v: Column, default: int = 20, most: int = 1000) -> Column:
    """:func:`clamp_limit` of a number, as an expression."""
    x = v.cast("double")
    finite = x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return F.when(finite, F.greatest(F.lit(0.0), F.least(F.lit(float(most)), F.floor(x))).cast("int")).otherwise(default)


def clamp_k(k: float, n: int) -> int:
    """How many of ``n`` rows to give for ``k``: rounded down; NaN or under one gives none."""
    if math.isnan(k) or k < 1:
        return 0
    return n if k >= n else math.floor(k)
