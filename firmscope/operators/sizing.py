"""Size checks in front of every broadcast.

A side is broadcast only when its rows and bytes are proven to be under a bound; beyond it
the join falls back to a shuffle join (and AQE may still pick a broadcast at runtime).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Bytes (as JSON text, which is more than Spark's own rows take) that a broadcast side may have.
MAX_BYTES = 64 << 20


def bounded_broadcast(df: DataFrame, max_rows: int, max_bytes: int = MAX_BYTES) -> DataFrame:
    """``broadcast(df)`` if ``df`` has at most ``max_rows`` rows and ``max_bytes``, else ``df`` unchanged."""
    return F.broadcast(df) if is_small(df, max_rows, max_bytes) else df


def is_small(df: DataFrame, max_rows: int, max_bytes: int = MAX_BYTES) -> bool:
    """Whether ``df`` keeps both bounds. At most ``max_rows + 1`` rows are looked at, so the check is cheap
    for both small and huge inputs."""
    size = F.coalesce(F.sum(F.octet_length(F.to_json(F.struct("*")))), F.lit(0))
    n, used = df.limit(max_rows + 1).agg(F.count(F.lit(1)), size).first()
    return n <= max_rows and used <= max_bytes


def attach_scalars(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Add the columns of a one-row aggregate (e.g. corpus statistics) to every row of
    ``df`` as literals — a scalar subquery: the single row is fetched (proven size: one
    row), so the plan has no join at all."""
    rows = one_row.limit(2).collect()
    if len(rows) != 1:
        raise ValueError(f"expected exactly one row, got {len(rows)}")
    r = rows[0]
    return df.withColumns({c: F.lit(r[c]).cast(t) for c, t in one_row.dtypes})


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores, for costly steps on each row: when the input has fewer partitions than the cluster has cores
    (e.g. one file of few row groups) its rows are dealt out; a large, well-split input is left as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
