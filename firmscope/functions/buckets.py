"""Company-size bucket and its display order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that must equal the reference: upper bounds (inclusive) and labels of the
# company-size buckets, in natural order; the last bucket has no upper bound.
SIZE_BUCKETS = [
    (10, "1-10"),
    (50, "11-50"),
    (200, "51-200"),
    (500, "201-500"),
    (1000, "501-1000"),
    (5000, "1001-5000"),
    (10000, "5001-10000"),
    (None, "10001+"),
]

SIZE_LABELS = [label for _, label in SIZE_BUCKETS]


def size_bucket(n: str | Column) -> Column:
    """Employee count → size label (NULL stays NULL)."""
    c = F.col(n) if isinstance(n, str) else n
    expr = None
    for upper, label in SIZE_BUCKETS:
        if upper is None:
            expr = expr.otherwise(F.lit(label))
        elif expr is None:
            expr = F.when(c <= upper, F.lit(label))
        else:
            expr = expr.when(c <= upper, F.lit(label))
    return F.when(c.isNull(), F.lit(None).cast("string")).otherwise(expr)
