"""Feature formulas as columns, each clamped to [0, 1]."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from kinweave import settings


def clamp(value: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))


def share(part: Column, whole: Column) -> Column:
    """part / whole, 0 where the whole is empty."""
    return F.when(whole > 0, clamp(part.cast("double") / whole.cast("double"))).otherwise(F.lit(0.0))


def jaccard(common: Column, left: Column, right: Column) -> Column:
    """Jaccard overlap from the size of the intersection and of both sets."""
    return share(common, left + right - common)


def tversky(common: Column, left: Column, right: Column, alpha: float = 0.5, beta: float = 0.5) -> Column:
    """Tversky similarity from the size of the intersection and of both sets."""
    return share(common, common + F.lit(alpha) * (left - common) + F.lit(beta) * (right - common))


def proximity(hops: Column, max_hops: int = settings.MAX_COAUTHOR_HOPS) -> Column:
    """1 for a direct co-author, falling linearly; 0 for unreachable and for the team itself."""
    return F.when(
        hops.between(1, max_hops), clamp(F.lit(1.0) - (hops - 1).cast("double") / F.lit(float(max_hops)))
    ).otherwise(F.lit(0.0))


def recency(
    year: Column,
    reference_year: int = settings.RANKING_REFERENCE_YEAR,
    half_life: float = settings.RANKING_HALF_LIFE_YEARS,
) -> Column:
    """Halves each ``half_life`` years before the reference year."""
    if half_life <= 0:
        return F.lit(0.0)
    age = F.greatest(F.lit(0), F.lit(reference_year) - year).cast("double")
    return F.when(year.isNotNull(), clamp(F.pow(F.lit(2.0), -age / F.lit(half_life)))).otherwise(F.lit(0.0))


def decay(year: Column, reference_year: int, half_life: float) -> Column:
    """Weight of one publication year; 0 for an unknown year."""
    age = F.greatest(F.lit(0), F.lit(reference_year) - year).cast("double")
    return F.when(year.isNotNull(), F.pow(F.lit(0.5), age / F.lit(half_life))).otherwise(F.lit(0.0))


# A scorer turns feature columns and weights into (total, contributions).
Scorer = Callable[[dict[str, Column], dict[str, float]], tuple[Column, dict[str, Column]]]


def linear_scorer(features: dict[str, Column], weights: dict[str, float]) -> tuple[Column, dict[str, Column]]:
    """Weighted sum. Contributions are rounded on their own; the total is rounded after summing."""
    products = {name: features.get(name, F.lit(0.0)) * F.lit(float(w)) for name, w in weights.items()}
    total = F.lit(0.0)
    for product in products.values():
        total = total + product
    return F.round(total, 6), {name: F.round(p, 6) for name, p in products.items()}
