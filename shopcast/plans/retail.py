"""The supplied tables in the roles the operators expect."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shopcast.config import FeatureSpec, ModelSettings
from shopcast.operators import features
from shopcast.operators.clean import clean_transactions
from shopcast.operators.profile import SentenceGroup, SentenceTemplate

FEATURE_PERIOD = ("1999-01", "2000-12")
OUTCOME_PERIOD = ("2001-01", "2001-08")
CATEGORIES = ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")
TREATMENTS = ("No Promotion", "Buy 2 get 10%", "Buy 3 get 20%")
SHARES = tuple(f"per_{features.column_name(c)}" for c in CATEGORIES)
BRAND_CATEGORY = {f"Brand#{i}": f"Category {i % 5 + 1}" for i in range(1, 26)}

PROFILE_SPECS = (
    FeatureSpec("customer_lifetime", "Days since first purchase", "integer", "Membership"),
    FeatureSpec("bought_categories", "Categories bought so far", "string", "Purchase History"),
    FeatureSpec("recency", "Days since last purchase", "integer", "Recency"),
    FeatureSpec("purchase_day", "Number of purchase days", "integer", "Frequency"),
    FeatureSpec("avg_purchase_frequency", "Average days between purchases", "float", "Frequency"),
    FeatureSpec("total_sales", "Total sales", "float", "Monetary"),
    FeatureSpec("avg_purchase_value", "Average basket size", "float", "Monetary"),
    FeatureSpec("nb_product", "Number of different products", "integer", "Diversity"),
    FeatureSpec("nb_category", "Number of different categories", "integer", "Diversity"),
) + tuple(
    FeatureSpec(s, f"Share of spend on {c.lower()} products", "percent", "Category Preference")
    for c, s in zip(CATEGORIES, SHARES)
)
TREATMENT_SPECS = (FeatureSpec("promotion", "Promotion offered", "string"),)
OUTCOME_SPECS = (
    FeatureSpec("target_sales", "Sales in the outcome period", "float"),
    FeatureSpec("target_categories", "Categories bought in the outcome period", "string"),
)
OUTCOME_CONTEXT = "These figures describe customers without any promotion."
SYSTEM_TEXT = "You estimate what a customer will buy."

# Joined lists that profiles, and outcomes, are written from.
PROFILE_TEXTS = ("bought_categories",)
OUTCOME_TEXTS = ("target_categories",)
EXAMPLE_TEXTS = (*PROFILE_TEXTS, *OUTCOME_TEXTS)

# Columns of the similarity search and of the local ranking.
SIMILARITY_FEATURES = (
    "recency", "purchase_day", "total_sales", "nb_product", "nb_category",
    "customer_lifetime", "avg_purchase_frequency", "avg_purchase_value",
)
RANKING_FEATURES = (*SIMILARITY_FEATURES, *SHARES)
# Fewer than the train rows of the smallest table that is compared, so that the cut matters there.
RANKING_NEIGHBOURS = 600
SCREEN_NEIGHBOURS = 300

NUMERIC_NAMES = {
    "recency": "Days since last purchase",
    "purchase_day": "No. of purchase days",
    "total_sales": "Total sales",
    "avg_purchase_value": "Average basket size",
    "nb_product": "Number of different products",
    "segment": "Market segment",
    "label": "Flag for a purchase in the outcome period",
}
SENTENCES = SentenceTemplate(
    "The customer ",
    (
        SentenceGroup(
            {
                "customer_lifetime": ("joined [VALUE] days ago, ", "joined today, "),
                "segment": ("belongs to [VALUE], ", "belongs to [VALUE], "),
            }
        ),
        SentenceGroup(
            {
                "recency": ("last bought [VALUE] days ago, ", "last bought today, "),
                "purchase_day": ("bought on [VALUE] days, ", "bought on [VALUE] days, "),
                "total_sales": ("spent [VALUE], ", "spent nothing, "),
            },
            guard="purchase_day",
            empty_text="did not buy anything, ",
        ),
        SentenceGroup(
            {"promo": ("bought promoted goods for [VALUE], ", "bought no promoted goods, ")},
            guard="promo",
            empty_text="did not look at promoted goods, ",
        ),
    ),
)
SEGMENT_NAMES = {"AUTOMOBILE": "car owners", "BUILDING": "builders"}
SETTINGS = ModelSettings(batch_size=20, max_workers=2)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_transactions(
    spark: SparkSession, sf_dir: str, since: str | None = None, before: str | None = None
) -> DataFrame:
    """Invoice lines; ``since`` and ``before`` are dates that are pushed into the scan of orders."""
    orders = table(spark, sf_dir, "orders")
    kind = orders.schema["o_orderdate"].dataType
    if since:
        orders = orders.where(F.col("o_orderdate") >= F.lit(since).cast(kind))
    if before:
        orders = orders.where(F.col("o_orderdate") < F.lit(before).cast(kind))
    lines = table(spark, sf_dir, "lineitem")
    parts = table(spark, sf_dir, "part")
    return (
        lines.join(orders, lines.l_orderkey == orders.o_orderkey)
        .join(parts, lines.l_partkey == parts.p_partkey)
        .select(
            F.col("o_custkey").cast("string").alias("customer_id"),
            F.col("o_orderkey").cast("string").alias("invoice_no"),
            F.col("l_linenumber").alias("line_no"),
            F.col("o_orderdate").alias("invoice_date"),
            F.col("l_partkey").cast("string").alias("stock_code"),
            F.col("p_name").alias("description"),
            F.col("p_type").alias("category"),
            F.col("p_brand").alias("brand"),
            F.col("l_quantity").alias("quantity"),
            (F.col("l_extendedprice") / F.col("l_quantity")).alias("unit_price"),
            F.date_format("o_orderdate", "yyyy-MM").alias("yearmon"),
        )
    )


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean lines of the feature and outcome periods."""
    return _between(spark, sf_dir, FEATURE_PERIOD[0], OUTCOME_PERIOD[1])


def _between(spark: SparkSession, sf_dir: str, first: str, last: str) -> DataFrame:
    """Clean lines from the first month to the last one."""
    year, month = (int(part) for part in last.split("-"))
    after = f"{year + month // 12}-{month % 12 + 1:02d}-01"
    return clean_transactions(raw_transactions(spark, sf_dir, f"{first}-01", after))


def feature_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _between(spark, sf_dir, *FEATURE_PERIOD)


def customer_table(
    spark: SparkSession, sf_dir: str, texts: Sequence[str] = features.TEXTS
) -> DataFrame:
    """Wide customer rows with segment, label and click; of the joined lists those in ``texts``."""
    rows = features.customer_dataset(
        transactions(spark, sf_dir), FEATURE_PERIOD, OUTCOME_PERIOD, CATEGORIES, texts
    )
    segments = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("string").alias("customer_id"),
        F.col("c_mktsegment").alias("segment"),
    )
    return rows.join(segments, "customer_id").withColumns(
        {
            "label": (F.col("target_sales") > 0).cast("int"),
            "promotion": F.lit(TREATMENTS[0]),
        }
    )


def rfm_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.with_rates(features.rfm_features(feature_transactions(spark, sf_dir)))


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plain customer rows with a string id."""
    c = table(spark, sf_dir, "customer")
    return c.withColumn("customer_id", F.col("c_custkey").cast("string"))


def scored_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents with a made score that has ties."""
    return table(spark, sf_dir, "labels").select(
        "doc_id", "quality", "toxic", ((F.col("doc_id") * 37 % 101) / 100.0).alias("score")
    )
