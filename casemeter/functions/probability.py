"""Per-row probability-vector expressions (JVM-side, no UDF)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Lower clip of the log loss, and the inner edges of ten equal confidence bins.
LOG_LOSS_FLOOR = 1e-15
CONFIDENCE_EDGES = (0.1, 0.2, 0.30000000000000004, 0.4, 0.5, 0.6000000000000001, 0.7000000000000001, 0.8, 0.9)


def confidence(p: Column) -> Column:
    return F.array_max(p)


def top_class(p: Column) -> Column:
    """Index of the largest probability, the lowest class on ties."""
    return (F.array_position(p, F.array_max(p)) - 1).cast("int")


def brier_row(p: Column, label: Column) -> Column:
    hit = F.transform(p, lambda x, i: F.pow(x - F.when(i == label, 1.0).otherwise(0.0), F.lit(2.0)))
    return F.aggregate(hit, F.lit(0.0), lambda a, x: a + x)


def log_loss_row(p: Column, label: Column, floor: float = LOG_LOSS_FLOOR) -> Column:
    return -F.log(F.least(F.greatest(F.element_at(p, label + 1), F.lit(floor)), F.lit(1.0)))


def confidence_bin(conf: Column) -> Column:
    """Bin number 0-9; comparisons with the literal edges, the last bin closed."""
    return sum(((conf >= F.lit(e)).cast("int") for e in CONFIDENCE_EDGES), F.lit(0))


def is_distribution(p: Column, classes: int, tolerance: float = 1e-8) -> Column:
    """True for ``classes`` finite non-negative values that sum to one."""
    finite = F.forall(p, lambda x: x.isNotNull() & ~F.isnan(x) & (x >= 0.0) & (x <= F.lit(1.0 + tolerance)))
    total = F.aggregate(p, F.lit(0.0), lambda a, x: a + x)
    return (F.size(p) == classes) & finite & (F.abs(total - 1.0) <= F.lit(tolerance + 1e-5))


def normalised(p: Column) -> Column:
    total = F.aggregate(p, F.lit(0.0), lambda a, x: a + x)
    return F.transform(p, lambda x: x / total)
