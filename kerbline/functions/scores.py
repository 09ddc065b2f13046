"""Scores and levels: congestion, identity, attributes, renormalised weighted means."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Alike colours, families of vehicle classes.
ALIKE_COLOURS = [("white", "silver"), ("silver", "grey"), ("grey", "black"), ("red", "orange"), ("orange", "brown"), ("orange", "yellow")]
LIGHT_OR_HEAVY = ["car", "truck", "bus"]


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """x within the limits; null stays null, which least and greatest alone would skip."""
    return F.when(x.isNotNull(), F.least(F.lit(high), F.greatest(F.lit(low), x)))


def weighted_mean(parts: dict[str, tuple[Column | float, Column]]) -> Column:
    """Mean of the parts that aren't null, their weights renormalised; null without any. parts: name to (weight, value)."""
    pairs = [(F.lit(w) if isinstance(w, (int, float)) else w, v) for w, v in parts.values()]
    total = sum((F.when(v.isNotNull(), w).otherwise(0.0) for w, v in pairs), F.lit(0.0))
    summed = sum((F.coalesce(w * v, F.lit(0.0)) for w, v in pairs), F.lit(0.0))
    return F.try_divide(summed, F.nullif(total, F.lit(0.0)))


def congestion_level(score: Column, moderate: float = 30, heavy: float = 55, severe: float = 75) -> Column:
    return F.when(score.isNull(), "NO_DATA").when(score >= severe, "SEVERE").when(score >= heavy, "HEAVY").when(score >= moderate, "MODERATE").otherwise("FREE")


def confidence_level(score: Column, high: float = 0.8, medium: float = 0.65) -> Column:
    return F.when(score >= high, "HIGH").when(score >= medium, "MEDIUM").otherwise("LOW")


def colour_score(a: Column, b: Column) -> Column:
    alike = F.array(*[F.lit("|".join(sorted(p))) for p in ALIKE_COLOURS])
    known = (F.coalesce(a, F.lit("")) != "") & (F.coalesce(b, F.lit("")) != "") & (a != "unknown") & (b != "unknown")
    return F.when(known, F.when(a == b, 1.0).when(F.array_contains(alike, F.concat_ws("|", F.least(a, b), F.greatest(a, b))), 0.4).otherwise(0.0))


def class_score(a: Column, b: Column) -> Column:
    known = (F.coalesce(a, F.lit("")) != "") & (F.coalesce(b, F.lit("")) != "")
    return F.when(known, F.when(a == b, 1.0).when(a.isin(LIGHT_OR_HEAVY) & b.isin(LIGHT_OR_HEAVY), 0.4).otherwise(0.0))


def time_score(dt: Column, expected: Column, spread: float = 0.8) -> Column:
    """1 up to the expected time, then a bell curve of the logarithm of the ratio."""
    ratio = dt / F.greatest(expected, F.lit(1.0))
    return F.when(ratio <= 1, 1.0).otherwise(F.exp(-F.pow(F.log(ratio), F.lit(2.0)) / (2 * spread**2)))


def route_score(hops: Column, loops: Column, skipped: Column) -> Column:
    return F.when(loops, 0.6).when(hops == 1, 1.0).otherwise(F.greatest(F.lit(0.2), 1 - 0.3 * skipped))


def appearance_score(cosine: Column, floor: float = 0.75, ceiling: float = 0.97) -> Column:
    return clamp((cosine - floor) / (ceiling - floor))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, p: s + p)


def norm(a: Column) -> Column:
    return F.sqrt(_dot(a, a))


def cosine(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """Cosine of two arrays with a small term against division by zero, summed in the arrays' order; null for different lengths. Norms that are known are taken."""
    norms = (norm(a) if norm_a is None else norm_a) * (norm(b) if norm_b is None else norm_b)
    return F.when(F.size(a) == F.size(b), _dot(a, b) / (norms + 1e-9))


def plate_veto(a: Column, b: Column, reliability: Column, distance: Column, similarity: Column) -> Column:
    """Why two reads can't be of one vehicle, null if they can."""
    return F.when(a == b, None).when((reliability >= 1) & (distance >= 1), "plates_differ").when((reliability >= 0.5) & (F.coalesce(similarity, F.lit(0.0)) < 0.5), "plates_unlike")
