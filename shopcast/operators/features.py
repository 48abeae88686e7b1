"""One feature row per customer from transaction lines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shopcast.sources import stage

Period = tuple[str, str]
TEXTS = ("target_descriptions", "target_categories", "bought_descriptions", "bought_categories")


def with_category(tx: DataFrame, categories: DataFrame) -> DataFrame:
    """Left join of the product dimension; broadcast only below Spark's own size limit."""
    return tx.join(categories.select("stock_code", "category"), "stock_code", "left")


def _within(period: Period) -> Column:
    return F.col("yearmon").between(*period)


def column_name(category: str) -> str:
    return category.lower().replace(" ", "_")


def period_sales(tx: DataFrame, feature: Period, outcome: Period) -> DataFrame:
    """Sales per customer and period in one pass."""
    return (
        tx.where(_within(feature) | _within(outcome))
        .groupBy("customer_id")
        .agg(
            F.sum(F.when(_within(feature), F.col("sales"))).alias("feature_sales"),
            F.sum(F.when(_within(outcome), F.col("sales"))).alias("outcome_sales"),
        )
    )


def _days_to_last(column: str) -> Column:
    """Whole days from a date to the last date of all rows, in ``_last``."""
    return F.date_part(F.lit("DAY"), F.col("_last") - F.col(column)).cast("bigint")


def rfm_features(tx: DataFrame, purchase_unit: str = "timestamp") -> DataFrame:
    """Recency, frequency, spend and diversity per customer.

    Recency and lifetime count whole days up to the last date of all rows.
    ``purchase_unit`` is ``timestamp`` (distinct purchase times) or ``day``.
    """
    if purchase_unit not in ("timestamp", "day"):
        raise ValueError("purchase_unit must be 'timestamp' or 'day'")
    last = tx.agg(F.max("invoice_date")).scalar()
    unit = F.col("invoice_date") if purchase_unit == "timestamp" else F.to_date("invoice_date")
    per_customer = tx.groupBy("customer_id").agg(
        F.max("invoice_date").alias("last_purchase_date"),
        F.min("invoice_date").alias("first_purchase_date"),
        F.count_distinct(unit).alias("purchase_day"),
        F.count_distinct("invoice_no").alias("nb_invoice"),
        F.round(F.sum("sales"), 2).alias("total_sales"),
        F.count_distinct("stock_code").alias("nb_product"),
        F.count_distinct("category").alias("nb_category"),
    )

    return per_customer.withColumn("_last", last).select(
        "customer_id",
        _days_to_last("last_purchase_date").alias("recency"),
        "first_purchase_date",
        "purchase_day",
        "nb_invoice",
        "total_sales",
        "nb_product",
        "nb_category",
        _days_to_last("first_purchase_date").alias("customer_lifetime"),
    )


def with_rates(rfm: DataFrame) -> DataFrame:
    """Average days and spend per purchase day."""
    return rfm.withColumns(
        {
            "avg_purchase_frequency": F.col("customer_lifetime") / F.col("purchase_day"),
            "avg_purchase_value": F.col("total_sales") / F.col("purchase_day"),
        }
    )


def category_pivot(tx: DataFrame, categories: Sequence[str]) -> DataFrame:
    """Sales per customer and category, and each category's share of all sales.

    The category list is given, so no extra job looks for it, and each column
    is a conditional sum that is combined before the shuffle.
    """
    names = {c: column_name(c) for c in categories}
    sums = tx.groupBy("customer_id").agg(
        F.round(F.sum("sales"), 2).alias("total_sales"),
        *[
            F.round(F.sum(F.when(F.col("category") == c, F.col("sales")).otherwise(0.0)), 2).alias(n)
            for c, n in names.items()
        ],
    )
    return sums.select(
        "customer_id",
        *names.values(),
        *[(F.col(n) / F.col("total_sales")).alias(f"per_{n}") for n in names.values()],
    )


def bought_lists(
    tx: DataFrame,
    lists: dict[str, tuple[str, Period]],
    separator: str = "|",
) -> DataFrame:
    """Distinct values per customer, in order of first purchase, as joined text.

    ``lists`` maps an output column to (source column, period).  All lists come
    from one pass: lines are first reduced to one row per customer, list and
    value, so what is gathered per customer is distinct values only.
    """
    entries = F.array(
        *[
            F.struct(F.lit(i).alias("list"), F.when(_within(period), F.col(source)).alias("value"))
            for i, (source, period) in enumerate(lists.values())
        ]
    )
    firsts = (
        tx.select(
            "customer_id",
            F.struct("invoice_date", "invoice_no", "line_no").alias("at"),
            F.inline(entries),
        )
        .where(F.col("value").isNotNull())
        .groupBy("customer_id", "list", "value")
        .agg(F.min("at").alias("at"))
    )
    return firsts.groupBy("customer_id").agg(
        *[
            F.array_join(
                F.transform(
                    F.array_sort(
                        F.collect_list(F.when(F.col("list") == i, F.struct("at", "value")))
                    ),
                    lambda entry: entry["value"],
                ),
                separator,
            ).alias(name)
            for i, name in enumerate(lists)
        ]
    )


def outcome_table(tx: DataFrame, feature: Period, outcome: Period) -> DataFrame:
    """Customers of the feature period with their outcome-period sales and lists.

    Customers without a later purchase are kept: sales 0 and empty lists.
    """
    active = tx.where(_within(feature) | _within(outcome))
    sales = period_sales(tx, feature, outcome).where(F.col("feature_sales").isNotNull())
    lists = bought_lists(
        active,
        {
            "target_descriptions": ("description", outcome),
            "target_categories": ("category", outcome),
            "bought_descriptions": ("description", feature),
            "bought_categories": ("category", feature),
        },
    )
    return sales.join(lists, "customer_id", "left").select(
        "customer_id",
        F.round(F.coalesce("outcome_sales", F.lit(0.0)), 2).alias("target_sales"),
        *[
            F.coalesce(c, F.lit("")).alias(c)
            for c in (
                "target_descriptions",
                "target_categories",
                "bought_descriptions",
                "bought_categories",
            )
        ],
    )


def _counted_values(tx: DataFrame, feature: Period, outcome: Period) -> DataFrame:
    """One row per customer, kind and value, with first and last date and sales.

    Every line is listed once under each kind that applies to its period.
    Distinct counts and sums follow from these rows, so the lines are read once
    for all of them; everything aggregated is of fixed width, which keeps the
    aggregation hash-based, and a customer with very many lines is spread over
    as many keys as it has values.  Every line of the feature period is under its
    time, even if it has none, so that sums and dates of all lines follow from there.
    """
    listed = {
        "time": (F.col("invoice_date").cast("string"), feature),
        "product": (F.col("stock_code"), feature),
        "category": (F.col("category"), feature),
        "later_line": (F.lit(""), outcome),
    }
    always = ("time",)
    entries = [
        F.when(
            _within(period) & (F.lit(True) if kind in always else value.isNotNull()),
            F.struct(F.lit(kind).alias("kind"), value.alias("value")),
        ).alias("entry")
        for kind, (value, period) in listed.items()
    ]
    return (
        tx.select("customer_id", "invoice_date", "sales", F.explode(F.array(*entries)).alias("entry"))
        .where(F.col("entry").isNotNull())
        .groupBy("customer_id", F.col("entry.kind").alias("kind"), F.col("entry.value").alias("value"))
        .agg(
            F.min("invoice_date").alias("first"),
            F.max("invoice_date").alias("last"),
            F.sum("sales").alias("sales"),
        )
    )


def customer_dataset(
    tx: DataFrame,
    feature: Period,
    outcome: Period,
    categories: Sequence[str],
    texts: Sequence[str] = TEXTS,
) -> DataFrame:
    """The wide customer table: outcome columns and feature columns.

    Equal to joining :func:`outcome_table`, :func:`rfm_features` with
    :func:`with_rates`, and :func:`category_pivot`, from one pass for counts
    and sums and one for the ordered lists, which ``texts`` names: what a caller
    does not read is not gathered.  Both passes read the staged lines.  The counts
    are staged, one row per customer, and the last date of all is taken from there.
    """
    told = (("description", outcome), ("category", outcome), ("description", feature), ("category", feature))
    texts = {name: source for name, source in zip(TEXTS, told) if name in texts}
    active = tx.where(_within(feature) | _within(outcome))
    if texts:
        read = {"customer_id", "yearmon", "invoice_date", "sales", "stock_code", "category", "invoice_no", "line_no"}
        read |= {source for source, _ in texts.values()}
        active = stage(active.select(*[c for c in active.columns if c in read]), "lines")

    def of(kind: str, column: str) -> Column:
        return F.when(F.col("kind") == kind, F.col(column))

    names = {c: column_name(c) for c in categories}
    counted = (
        _counted_values(active, feature, outcome)
        .groupBy("customer_id")
        .agg(
            F.round(F.sum(of("time", "sales")), 2).alias("total_sales"),
            F.round(F.coalesce(F.sum(of("later_line", "sales")), F.lit(0.0)), 2).alias("target_sales"),
            F.max(of("time", "last")).alias("last_purchase_date"),
            F.min(of("time", "first")).alias("first_purchase_date"),
            *[
                F.count(of(kind, "value")).alias(name)
                for kind, name in (
                    ("time", "purchase_day"), ("product", "nb_product"), ("category", "nb_category")
                )
            ],
            *[
                F.round(
                    F.sum(F.when((F.col("kind") == "category") & (F.col("value") == c), F.col("sales"))),
                    2,
                ).alias(n)
                for c, n in names.items()
            ],
        )
        .where(F.col("total_sales").isNotNull())
    )
    counted = stage(counted, "customer-counts")
    last = counted.agg(F.max("last_purchase_date")).scalar()
    rows = counted.join(bought_lists(active, texts), "customer_id", "left") if texts else counted
    rows = (
        rows.withColumn("_last", last)
        .withColumns(
            {
                "recency": _days_to_last("last_purchase_date"),
                "customer_lifetime": _days_to_last("first_purchase_date"),
            }
        )
    )
    return with_rates(rows).select(
        "customer_id",
        "target_sales",
        *[F.coalesce(t, F.lit("")).alias(t) for t in texts],
        "recency", "purchase_day", "total_sales", "nb_product", "nb_category", "customer_lifetime",
        "avg_purchase_frequency", "avg_purchase_value",
        *[
            (F.coalesce(n, F.lit(0.0)) / F.col("total_sales")).alias(f"per_{n}")
            for n in names.values()
        ],
    )
