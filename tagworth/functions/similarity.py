"""Similarity of image features held in array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .base import ColumnOrName, col, let

# distance between black and white, rounded as the colour scale uses it
MAX_COLOR_DISTANCE = 441.0


def dot(a: ColumnOrName, b: ColumnOrName) -> Column:
    products = F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(a: ColumnOrName) -> Column:
    return F.sqrt(dot(a, a))


def cosine01(a: ColumnOrName, b: ColumnOrName, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """Cosine mapped from [-1, 1] to [0, 1]; inputs need not be unit vectors.

    Pass precomputed norms when one vector is compared with many.
    """
    length = (norm(a) if norm_a is None else norm_a) * (norm(b) if norm_b is None else norm_b)
    return (F.try_divide(dot(a, b), length) + 1.0) / 2.0


def color_similarity(a: ColumnOrName, b: ColumnOrName) -> Column:
    """1 minus the mean distance of each colour in ``a`` to its nearest in ``b``."""

    def distance(x: Column, y: Column) -> Column:
        squares = F.zip_with(x, y, lambda p, q: (p - q).cast("double") * (p - q).cast("double"))
        return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda acc, v: acc + v))

    nearest = F.transform(col(a), lambda x: F.array_min(F.transform(col(b), lambda y: distance(x, y))))
    mean = F.aggregate(nearest, F.lit(0.0), lambda acc, v: acc + v) / F.size(col(a))
    clamped = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(1.0) - mean / MAX_COLOR_DISTANCE))
    empty = (F.coalesce(F.size(col(a)), F.lit(0)) <= 0) | (F.coalesce(F.size(col(b)), F.lit(0)) <= 0)
    return F.when(empty, F.lit(0.0)).otherwise(clamped)


def hamming(a: ColumnOrName, b: ColumnOrName) -> Column:
    """Number of differing bits of two hashes held as arrays of longs."""
    bits = F.zip_with(col(a), col(b), lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    return F.aggregate(bits, F.lit(0), lambda acc, v: acc + v)


def hash_penalty(similarity: ColumnOrName, distance: ColumnOrName, threshold: int = 12) -> Column:
    """Lower the similarity of pairs whose hashes lie apart."""
    sim, d = col(similarity), col(distance)
    return (
        F.when(d > 2 * threshold, sim * 0.3)
        .when(d > threshold, sim * (1.0 - 0.4 * F.least(F.lit(1.0), d / (2.0 * threshold))))
        .otherwise(sim)
    )


def hu_log(moments: ColumnOrName) -> Column:
    """Log-scaled Hu moments with the sign kept apart."""

    def scale(m: Column) -> Column:
        v = F.when(m == 0, F.lit(1e-12)).otherwise(m)
        return -F.signum(v) * F.log10(F.abs(v))

    return F.transform(col(moments), scale)


def shape_score(hu_a: ColumnOrName, hu_b: ColumnOrName, iou: ColumnOrName, area_a: ColumnOrName, area_b: ColumnOrName) -> Column:
    """Silhouette similarity of log-scaled moments, mask overlap and area ratio."""
    gaps = F.zip_with(col(hu_a), col(hu_b), lambda x, y: F.abs(x - y))

    def score(mean_gap: Column) -> Column:
        larger = F.greatest(col(area_a), col(area_b))
        ratio = F.when(larger > 0, F.least(col(area_a), col(area_b)) / larger).otherwise(F.lit(0.0))
        total = 0.55 * F.exp(-0.35 * mean_gap) + 0.30 * col(iou) + 0.15 * ratio
        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), total))

    mean_gap = F.aggregate(gaps, F.lit(0.0), lambda acc, v: acc + v) / F.size(col(hu_a))
    return let(mean_gap, score)
