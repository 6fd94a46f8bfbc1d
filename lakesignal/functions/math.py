"""Scalar and window formulas that several operators share."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def average_rank(value: str, partition: list[str]) -> Column:
    """Rank with ties at their mean."""
    ties = Window.partitionBy(*partition, value)
    return F.rank().over(Window.partitionBy(*partition).orderBy(value)) + (F.count("*").over(ties) - 1) / 2.0


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column, eps: float = 1e-8) -> Column:
    return dot(a, b) / (norm(a) * norm(b) + eps)


def l2_normalise(a: Column) -> Column:
    return F.transform(a, lambda x: x.cast("double") / F.greatest(norm(a), F.lit(1e-12)))


def clamp01(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def sigmoid(c: Column) -> Column:
    return 1 / (1 + F.exp(-c))


def hamming_similarity(a: Column, b: Column, bits: int = 64) -> Column:
    return 1 - F.bit_count(a.bitwiseXOR(b)) / float(bits)


def histogram_intersection(a: Column, b: Column) -> Column:
    """Shared mass of two three-channel histograms."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.least(x, y)), F.lit(0.0), lambda s, x: s + x) / 3.0


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Lentz's continued fraction for the incomplete beta function."""
    tiny, c = 1e-300, 1.0
    d = 1 / (1 - (a + b) * x / (a + 1) or tiny)
    out = d
    for m in range(1, 300):
        for step in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d, c = 1 / (1 + step * d or tiny), 1 + step / c or tiny
            out *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return out


def student_p(t: float, df: float) -> float:
    """Two-sided p-value of Student's t."""
    if df <= 0 or math.isnan(t):
        return float("nan")
    x = df / (df + t * t)
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    a, b = df / 2, 0.5
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return min(1.0, front * _beta_fraction(a, b, x) / a)
    return min(1.0, max(0.0, 1 - front * _beta_fraction(b, a, 1 - x) / b))


def student_p_value(t: Column, df: Column) -> Column:
    """Two-sided p of Student's t with df degrees of freedom; null where either is."""

    @F.pandas_udf("double")
    def p(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for t, df in batches:
            pairs = zip(t, df, strict=True)
            yield pd.Series([None if pd.isna(a) or pd.isna(b) else student_p(a, b) for a, b in pairs], dtype="float64")

    return p(t, df)
