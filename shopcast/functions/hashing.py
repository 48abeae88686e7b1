"""Reproducible pseudo-random order that does not depend on partitioning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Rows of a hash bucket, about: how many buckets there are follows from the row count.
BUCKET_ROWS = 100_000


def hash_order(keys: Sequence[str | Column], seed: int | str) -> Column:
    """md5 of ``key:seed``; several keys are joined with a colon."""
    parts = [(F.col(k) if isinstance(k, str) else k).cast("string") for k in keys]
    return F.md5(F.concat_ws(":", *parts, F.lit(str(seed))))


def bucket_digits(rows: int, bucket_rows: int | None = None) -> int:
    """First hex digits of the hash that make buckets of at most ``bucket_rows`` rows, about."""
    digits, bound = 1, bucket_rows or BUCKET_ROWS
    while bound * 16**digits < rows and digits < 16:
        digits += 1
    return digits


def hash_bucket(order: Column, digits: int) -> Column:
    return F.substring(order, 1, digits)
