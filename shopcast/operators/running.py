"""Exact running totals over a whole table without sorting it in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shopcast.sources import stage

# Rows that one task sorts and adds up, about.
BUCKET_ROWS = 200_000


def running_totals(
    df: DataFrame,
    order_col: str,
    sums: Sequence[str],
    descending: bool = False,
    bucket_rows: int | None = None,
) -> DataFrame:
    """Add ``<sum>_upto`` columns: totals over all rows up to and including this one.

    ``order_col`` must be distinct per row (aggregate to one row per value
    first).  Rows are cut into ranges of about ``bucket_rows`` rows, as many as
    the table needs; only a range is sorted.  What lies before a range follows
    from running totals over the ranges, by the same step where they are many.
    """
    bucket_rows = bucket_rows or BUCKET_ROWS
    rows = stage(df, "running-rows")
    buckets = max(1, -(-rows.count() // bucket_rows))
    inner = F.col(order_col).desc() if descending else F.col(order_col).asc()
    reach = (Window.unboundedPreceding, Window.currentRow)
    if buckets == 1:
        upto = Window.orderBy(inner).rowsBetween(*reach)
        return rows.withColumns({f"{s}_upto": F.sum(s).over(upto) for s in sums})
    # A name of its own: the order column of the totals is itself such a number.
    bucket = f"{order_col}_bucket"
    # Stored, as the ranges come from a sample: computed again they could differ.
    placed = stage(
        rows.repartitionByRange(buckets, inner).withColumn(bucket, F.spark_partition_id()), "running-ranges"
    )
    totals = placed.groupBy(bucket).agg(*[F.sum(s).alias(f"_{s}") for s in sums])
    offsets = running_totals(totals, bucket, [f"_{s}" for s in sums], bucket_rows=bucket_rows)
    offsets = stage(
        offsets.select(bucket, *[(F.col(f"_{s}_upto") - F.col(f"_{s}")).alias(f"_{s}") for s in sums]), "running-offsets"
    )
    upto = Window.partitionBy(bucket).orderBy(inner).rowsBetween(*reach)
    return (
        placed.withColumns({f"{s}_upto": F.sum(s).over(upto) for s in sums})
        .join(offsets, bucket)
        .select(*df.columns, *[(F.col(f"{s}_upto") + F.col(f"_{s}")).alias(f"{s}_upto") for s in sums])
    )
