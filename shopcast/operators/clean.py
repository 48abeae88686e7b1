"""Transaction cleaning, numeric coercion, imputation, winsorizing and scaling."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shopcast import fixed
from shopcast.functions.hashing import hash_order
from shopcast.operators.quantiles import order_statistics

_NUMBER = r"^[+-]?((\d+(_?\d)*)(\.(\d+(_?\d)*)?)?|\.\d+(_?\d)*)([eE][+-]?\d+)?$"
_SPECIAL = r"(?i)^[+-]?(nan|inf|infinity)$"


def clean_transactions(raw: DataFrame) -> DataFrame:
    """Product lines of known customers with positive price and quantity.

    Expects customer_id, invoice_no, stock_code, description, quantity,
    unit_price; other columns pass through.
    """
    return (
        raw.where(
            F.col("customer_id").isNotNull()
            & ~F.col("stock_code").isin(*fixed.NON_PRODUCT_CODES)
            & (F.col("unit_price") > 0)
            & (F.col("quantity") > 0)
        )
        .withColumns(
            {
                "description": F.coalesce("description", F.lit(fixed.UNKNOWN_DESCRIPTION)),
                "customer_id": F.col("customer_id").cast("bigint").cast("string"),
                "sales": F.col("unit_price") * F.col("quantity"),
            }
        )
    )


def year_month(text: Column, pattern: str = "M/d/yyyy H:mm") -> Column:
    """``yyyy-MM`` key of a date text."""
    return F.date_format(F.try_to_timestamp(text, F.lit(pattern)), "yyyy-MM")


def in_period(df: DataFrame, start: str, end: str, column: str = "yearmon") -> DataFrame:
    """Rows of a period, both ends included; prunes partitions when stored by month."""
    return df.where(F.col(column).between(start, end))


def _is_numeric(data_type: T.DataType) -> bool:
    return isinstance(data_type, T.NumericType)


def looks_numeric(text: Column) -> Column:
    bare = F.trim(text)
    return bare.rlike(_NUMBER) | bare.rlike(_SPECIAL)


def to_number(text: Column) -> Column:
    """A number, or null; suffixes such as ``1d`` that the JVM parser takes are refused."""
    return F.when(looks_numeric(text), F.trim(text).try_cast("double"))


def numeric_string_columns(
    df: DataFrame,
    columns: Sequence[str],
    key_cols: Sequence[str],
    sample_size: int | None = 100,
    numeric_threshold: float = 0.7,
    seed: int = 112,
) -> list[str]:
    """String columns whose sampled non-null values parse as numbers often enough.

    The sample is the ``sample_size`` values lowest in hash order, which a
    bounded top-n per scan task finds without a shuffle of the column.
    """
    if not columns:
        return []
    if sample_size is None:
        shares = df.agg(
            *[F.avg(looks_numeric(F.col(c)).cast("double")).alias(c) for c in columns]
        ).first()
        return [c for c in columns if shares[c] is not None and shares[c] >= numeric_threshold]
    samples = [
        df.where(F.col(c).isNotNull())
        .select(F.lit(c).alias("column"), F.col(c).alias("value"), hash_order(key_cols, seed).alias("h"))
        .orderBy("h")
        .limit(sample_size)
        for c in columns
    ]
    shares = (
        reduce(DataFrame.unionByName, samples)
        .groupBy("column")
        .agg(F.avg(looks_numeric(F.col("value")).cast("double")).alias("share"))
        .collect()
    )
    passed = {row["column"] for row in shares if row["share"] >= numeric_threshold}
    return [c for c in columns if c in passed]


def convert_to_float(
    df: DataFrame,
    key_cols: Sequence[str],
    sample_size: int | None = 100,
    numeric_threshold: float = 0.7,
    do_not_convert: Sequence[str] = ("customer_id",),
) -> DataFrame:
    """Numeric columns and mostly-numeric string columns as double."""
    strings = [
        f.name
        for f in df.schema.fields
        if isinstance(f.dataType, T.StringType) and f.name not in do_not_convert
    ]
    numeric_strings = set(
        numeric_string_columns(df, strings, key_cols, sample_size, numeric_threshold)
    )
    out = []
    for field in df.schema.fields:
        column = F.col(field.name)
        if field.name in do_not_convert:
            column = column.cast("string")
        elif _is_numeric(field.dataType):
            column = column.cast("double")
        elif field.name in numeric_strings:
            column = to_number(column)
        out.append(column.alias(field.name))
    return df.select(out)


def impute(df: DataFrame) -> DataFrame:
    """Fill recency with its cap, other numbers with 0, strings with an empty text."""
    out = []
    for field in df.schema.fields:
        column = F.col(field.name)
        if field.name.startswith(fixed.RECENCY_PREFIX):
            column = F.when(
                column.isNull() | (column > fixed.RECENCY_CAP), F.lit(float(fixed.RECENCY_CAP))
            ).otherwise(column)
        elif _is_numeric(field.dataType):
            column = F.coalesce(column, F.lit(0).cast(field.dataType))
        elif isinstance(field.dataType, T.StringType):
            column = F.coalesce(column, F.lit(""))
        out.append(column.alias(field.name))
    return df.select(out)


def winsorize(df: DataFrame, column: str, q: float = 0.99, both_sides: bool = False) -> DataFrame:
    """Clip a column at its nearest-rank quantiles; null stays null.

    One-sided: the cutoff is taken over the positive values only.  The cutoffs
    enter the plan as scalar subqueries, so no join is needed.
    """
    if column not in df.columns:
        raise ValueError(f"column not found: {column}")
    value = F.col(column)
    if both_sides:
        tail = (1 - q) / 2
        cuts = order_statistics(df, [column], [tail, 1 - tail])
        low = cuts.where(F.col("prob") == tail).select("value").scalar()
        high = cuts.where(F.col("prob") == 1 - tail).select("value").scalar()
        clipped = F.when(value < low, low).when(value > high, high).otherwise(value)
    else:
        cuts = order_statistics(df.where(value > 0), [column], [q])
        cut = cuts.select("value").scalar()
        clipped = F.when(value > cut, cut).otherwise(value)
    return df.withColumn(column, clipped)


def min_max_scale(df: DataFrame, columns: Sequence[str], fitted_on: DataFrame) -> DataFrame:
    """Scale to the range of ``fitted_on`` without clipping; constant columns give 0."""
    bounds = fitted_on.agg(
        F.struct(
            *[F.min(c).cast("double").alias(f"{c}_min") for c in columns],
            *[F.max(c).cast("double").alias(f"{c}_max") for c in columns],
        ).alias("bounds")
    ).scalar()
    scaled = {}
    for c in columns:
        low, high = bounds[f"{c}_min"], bounds[f"{c}_max"]
        ratio = F.try_divide(F.col(c).cast("double") - low, high - low)
        scaled[c] = F.when(high == low, F.col(c).cast("double") - low).otherwise(ratio)
    return df.withColumns(scaled)


def z_score(df: DataFrame, columns: Sequence[str], fitted_on: DataFrame) -> DataFrame:
    """Population z-score with the statistics of ``fitted_on``; null is 0, constant std is 1."""
    filled = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns]
    stats = fitted_on.agg(
        F.struct(
            *[F.avg(v).alias(f"{c}_mean") for c, v in zip(columns, filled)],
            *[F.stddev_pop(v).alias(f"{c}_std") for c, v in zip(columns, filled)],
        ).alias("stats")
    ).scalar()
    return df.withColumns(
        {
            c: (v - stats[f"{c}_mean"])
            / F.when(stats[f"{c}_std"] == 0, F.lit(1.0)).otherwise(stats[f"{c}_std"])
            for c, v in zip(columns, filled)
        }
    )


def numeric_features(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    """Numeric column names without the item columns and ``exclude``."""
    return [
        f.name
        for f in df.schema.fields
        if _is_numeric(f.dataType)
        and f.name not in exclude
        and not f.name.startswith(fixed.ITEM_PREFIXES)
    ]


def treatment_grid(df: DataFrame, column: str, values: Sequence[str]) -> DataFrame:
    """Every row once under each treatment value."""
    return df.withColumn(column, F.explode(F.array(*[F.lit(v) for v in values])))
