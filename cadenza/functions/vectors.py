"""Vector column expressions over ``array<float|double>`` columns.

Native higher-order expressions: good for per-row work (norms, one distance
per row).  Many-against-many scoring goes through the blocked NumPy kernels
in :mod:`cadenza.operators.topk` and :mod:`cadenza.operators.silhouette`.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def as_double(v) -> Column:
    """``array<float>`` -> ``array<double>`` (arithmetic is done in double)."""
    return F.transform(_col(v), lambda x: x.cast("double"))


def dot(a, b) -> Column:
    prods = F.zip_with(as_double(a), as_double(b), lambda x, y: x * y)
    return F.aggregate(prods, F.lit(0.0).cast("double"), lambda acc, x: acc + x)


def sq_norm(v) -> Column:
    return F.aggregate(as_double(v), F.lit(0.0).cast("double"), lambda acc, x: acc + x * x)


def norm(v) -> Column:
    return F.sqrt(sq_norm(v))


def cosine(a, b) -> Column:
    """(a.b)/(|a||b|); 0.0 when either vector is all zeros."""
    den = norm(a) * norm(b)
    return F.when(den == 0, F.lit(0.0)).otherwise(dot(a, b) / den)


def sq_euclidean(a, b) -> Column:
    diffs = F.zip_with(as_double(a), as_double(b), lambda x, y: (x - y) * (x - y))
    return F.aggregate(diffs, F.lit(0.0).cast("double"), lambda acc, x: acc + x)


def euclidean(a, b) -> Column:
    return F.sqrt(sq_euclidean(a, b))
