"""One query per operator over the supplied tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shopcast import sources
from shopcast.functions import replies as rt
from shopcast.functions.render import format_value
from shopcast.operators import (
    baseline,
    clean,
    evaluate,
    factors,
    features,
    forest,
    inference,
    profile,
    prompts,
    reconcile,
    sampling,
    similarity,
    skeleton,
    stats,
)
from shopcast.plans import flows, retail
from shopcast.plans import replies as made

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

FULL_NAMES = {
    "recency": "Recency", "purchase_day": "Days", "total_sales": "Total",
    "nb_product": "Products", "nb_category": "Categories", "customer_lifetime": "Lifetime",
    "avg_purchase_frequency": "Frequency", "avg_purchase_value": "Basket",
}
ADAPTIVE_LEAD = "You describe customers. Here is the distribution of each feature:\n"


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _round(df: DataFrame, columns: dict[str, int]) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), digits) for c, digits in columns.items()})


# Cleaning and features -----------------------------------------------------


@query
def clean_transactions(spark, sf):
    tx = clean.clean_transactions(retail.raw_transactions(spark, sf))
    return _round(
        tx.select("customer_id", "invoice_no", "line_no", "stock_code", "description", "quantity", "sales"),
        {"sales": 2},
    )


@query
def yearmon_sales(spark, sf):
    text = F.date_format("o_orderdate", "M/d/yyyy H:mm")
    orders = retail.table(spark, sf, "orders").select(
        clean.year_month(text).alias("yearmon"), "o_totalprice"
    )
    return orders.groupBy("yearmon").agg(
        F.count(F.lit(1)).alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("sales")
    )


@query
def period_split(spark, sf):
    tx = retail.transactions(spark, sf)
    parts = [
        clean.in_period(tx, *bounds).withColumn("period", F.lit(name))
        for name, bounds in (
            ("feature", retail.FEATURE_PERIOD),
            ("outcome", retail.OUTCOME_PERIOD),
        )
    ]
    return (
        parts[0]
        .unionByName(parts[1])
        .groupBy("period", "yearmon")
        .agg(F.count(F.lit(1)).alias("lines"), F.round(F.sum("sales"), 2).alias("sales"))
    )


@query
def category_join(spark, sf):
    tx = clean.clean_transactions(retail.raw_transactions(spark, sf)).drop("category")
    dim = retail.table(spark, sf, "part").select(
        F.col("p_partkey").cast("string").alias("stock_code"), F.col("p_type").alias("category")
    )
    return _round(
        features.with_category(tx, dim).select("invoice_no", "line_no", "stock_code", "category", "sales"),
        {"sales": 2},
    )


@query
def period_sales(spark, sf):
    return _round(
        features.period_sales(
            retail.transactions(spark, sf), retail.FEATURE_PERIOD, retail.OUTCOME_PERIOD
        ),
        {"feature_sales": 2, "outcome_sales": 2},
    )


@query
def rfm_features(spark, sf):
    rfm = features.rfm_features(retail.feature_transactions(spark, sf))
    return rfm.withColumn(
        "first_purchase_date", F.date_format("first_purchase_date", "yyyy-MM-dd")
    )


@query
def rfm_derived(spark, sf):
    return _round(
        retail.rfm_table(spark, sf).select(
            "customer_id", "customer_lifetime", "avg_purchase_frequency", "avg_purchase_value"
        ),
        {"avg_purchase_frequency": 6, "avg_purchase_value": 6},
    )


@query
def category_pivot(spark, sf):
    out = features.category_pivot(retail.feature_transactions(spark, sf), retail.CATEGORIES)
    return _round(out, {s: 6 for s in retail.SHARES})


@query
def bought_lists(spark, sf):
    return features.bought_lists(
        retail.feature_transactions(spark, sf),
        {
            "bought_descriptions": ("description", retail.FEATURE_PERIOD),
            "bought_categories": ("category", retail.FEATURE_PERIOD),
        },
    )


@query
def outcome_table(spark, sf):
    return features.outcome_table(
        retail.transactions(spark, sf), retail.FEATURE_PERIOD, retail.OUTCOME_PERIOD
    )


_CUSTOMER_ROUNDING = {
    "avg_purchase_frequency": 6, "avg_purchase_value": 6, **{s: 6 for s in retail.SHARES}
}


@query
def customer_dataset(spark, sf):
    out = features.customer_dataset(
        retail.transactions(spark, sf),
        retail.FEATURE_PERIOD,
        retail.OUTCOME_PERIOD,
        retail.CATEGORIES,
    )
    return _round(out, _CUSTOMER_ROUNDING)


def _mixed_customers(spark, sf):
    c = retail.customers(spark, sf)
    return c.select(
        "customer_id",
        "c_nationkey",
        "c_acctbal",
        F.concat(F.lit(" "), F.col("c_acctbal").cast("string")).alias("balance_text"),
        F.when(F.col("c_nationkey") < 22, F.col("c_nationkey").cast("string"))
        .otherwise(F.lit("none"))
        .alias("mostly_number"),
        F.when(F.col("c_nationkey") < 8, F.col("c_nationkey").cast("string"))
        .otherwise(F.lit("none"))
        .alias("mostly_text"),
        "c_mktsegment",
    )


@query
def convert_to_float(spark, sf):
    return clean.convert_to_float(_mixed_customers(spark, sf), ["customer_id"])


def _last_orders(spark, sf):
    """Customers with days since their last order, null without one."""
    orders = retail.table(spark, sf, "orders")
    last = orders.agg(F.max("o_orderdate")).scalar()
    per = orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.max("o_orderdate").alias("d"),
        F.sum(F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice"))).alias("f_sales"),
        F.max(F.when(F.col("o_orderstatus") == "P", F.col("o_orderpriority"))).alias("p_priority"),
    )
    return (
        retail.customers(spark, sf)
        .join(per, "c_custkey", "left")
        .select(
            "customer_id",
            F.date_diff(last, "d").cast("double").alias("days_since_last_order"),
            F.round("f_sales", 2).alias("f_sales"),
            "p_priority",
        )
    )


@query
def impute_cols(spark, sf):
    return clean.impute(_last_orders(spark, sf))


@query
def winsorize_upper(spark, sf):
    return clean.winsorize(
        retail.table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", 0.95
    )


@query
def winsorize_both(spark, sf):
    return clean.winsorize(
        retail.customers(spark, sf).select("customer_id", "c_acctbal"), "c_acctbal", 0.9, True
    )


@query
def counterfactual_grid(spark, sf):
    rows = retail.customers(spark, sf).select("customer_id", "c_mktsegment")
    return clean.treatment_grid(rows, "promotion", retail.TREATMENTS)


def _split_customers(spark, sf):
    return sampling.train_valid_test(
        retail.customers(spark, sf), ["customer_id"], strata=["c_mktsegment"]
    )


@query
def minmax_scale(spark, sf):
    split = _split_customers(spark, sf)
    scaled = clean.min_max_scale(
        split.select("customer_id", "c_acctbal", "c_nationkey"),
        ["c_acctbal", "c_nationkey"],
        split.where("split = 'train'"),
    )
    return _round(scaled, {"c_acctbal": 8, "c_nationkey": 8})


@query
def zscore_features(spark, sf):
    split = _split_customers(spark, sf)
    scaled = clean.z_score(
        split.select("customer_id", "c_acctbal", "c_nationkey"),
        ["c_acctbal", "c_nationkey"],
        split.where("split = 'train'"),
    )
    return _round(scaled, {"c_acctbal": 8, "c_nationkey": 8})


# Summaries -----------------------------------------------------------------


@query
def nearest_deciles(spark, sf):
    lines = retail.table(spark, sf, "lineitem")
    return stats.deciles(lines, ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])


@query
def feature_stats(spark, sf):
    out = stats.feature_stats(retail.customer_table(spark, sf), retail.PROFILE_SPECS)
    return _round(out, {"min": 6, "max": 6, "mean": 6, "share": 8})


@query
def value_shares(spark, sf):
    out = stats.value_shares(
        retail.table(spark, sf, "orders"), ["o_orderstatus", "o_orderpriority"]
    )
    return _round(out, {"share": 8})


@query
def feature_distribution_text(spark, sf):
    return stats.feature_distribution_text(
        sources.stage(retail.customer_table(spark, sf), "customers"),
        retail.PROFILE_SPECS,
        exclude="bought_categories",
    )


@query
def outcome_distribution_text(spark, sf):
    return stats.outcome_distribution_text(
        sources.stage(retail.customer_table(spark, sf), "customers"),
        retail.OUTCOME_SPECS,
        retail.OUTCOME_CONTEXT,
    )


@query
def quartile_text(spark, sf):
    return stats.quartile_text(
        retail.table(spark, sf, "lineitem"),
        {"l_quantity": "Quantity", "l_extendedprice": "Price", "l_discount": "Discount"},
    )


# Sampling ------------------------------------------------------------------


def _orders(spark, sf):
    return retail.table(spark, sf, "orders").select(
        "o_orderkey", "o_orderpriority",
        (F.col("o_orderstatus") == "F").cast("int").alias("outcome"),
    )


@query
def resample_outcome(spark, sf):
    return sampling.resample_by_outcome(
        _orders(spark, sf), "outcome", ["o_orderkey"], 0.5, strata=["o_orderpriority"]
    )


@query
def stratified_sample(spark, sf):
    return sampling.stratified_sample(_orders(spark, sf), 500, ["o_orderpriority"], ["o_orderkey"])


@query
def stratified_split(spark, sf):
    return sampling.two_way_split(_orders(spark, sf), 0.3, ["o_orderpriority"], ["o_orderkey"])


@query
def train_valid_test(spark, sf):
    return _split_customers(spark, sf).select("customer_id", "c_mktsegment", "split")


@query
def split_check(spark, sf):
    out = sampling.split_check(_split_customers(spark, sf), ["c_mktsegment"], tolerance=0.0015)
    return _round(out, {"original_share": 8, "split_share": 8})


@query
def row_limit_sample(spark, sf):
    return sampling.sample_rows(_orders(spark, sf), 100, ["o_orderkey"])


@query
def fraction_sample(spark, sf):
    return sampling.sample_fraction(_orders(spark, sf), 0.1, ["o_orderkey"])


@query
def holdout(spark, sf):
    return sampling.hold_out(
        retail.customers(spark, sf).select("customer_id", "c_mktsegment"), 1000, ["customer_id"]
    )


# Similarity ----------------------------------------------------------------


def _rounded_features(spark, sf, texts):
    """Customer rows with rounded rates, so that text and distances are stable, and the lists in ``texts``."""
    return _round(retail.customer_table(spark, sf, texts), _CUSTOMER_ROUNDING)


def _all_pairs(vectors: DataFrame, id_col: str, k: int, metric: str, **options) -> DataFrame:
    """Every row of a vector table searched in the same table."""
    return similarity.nearest(
        vectors.withColumnRenamed(id_col, "query_id"), None, "query_id", "ref_id", k, metric, **options
    )


def _knn(spark, sf, metric, **options):
    rows = sources.stage(
        _rounded_features(spark, sf, ()).select("customer_id", *retail.SIMILARITY_FEATURES), "features"
    )
    vectors = similarity.z_scored(rows, "customer_id", retail.SIMILARITY_FEATURES, rows)
    out = _all_pairs(vectors, "customer_id", 5, metric, **options)
    return _round(out, {"distance": 6, "score": 6})


@query
def knn_euclidean(spark, sf):
    return _knn(spark, sf, "euclidean")


@query
def knn_angular(spark, sf):
    return _knn(spark, sf, "angular")


@query
def knn_manhattan(spark, sf):
    return _knn(spark, sf, "manhattan")


@query
def knn_hamming(spark, sf):
    return _knn(spark, sf, "hamming")


@query
def knn_dot(spark, sf):
    return _knn(spark, sf, "dot").drop("score")


@query
def knn_cosine(spark, sf):
    """All numeric columns but the outcomes are compared."""
    rows = _rounded_features(spark, sf, ())
    columns = clean.numeric_features(rows, exclude=("target_sales", "label"))
    rows = sources.stage(rows.select("customer_id", *columns), "features")
    vectors = similarity.min_max_scaled(rows, "customer_id", columns, rows)
    out = _all_pairs(vectors, "customer_id", 10, "cosine")
    return _round(out.drop("distance"), {"score": 6})


@query
def knn_probed(spark, sf):
    return _knn(spark, sf, "euclidean", n_pivots=16, probes=4)


@query
def knn_probed_all(spark, sf):
    """With as many probes as cells the probed search is exact."""
    return _knn(spark, sf, "euclidean", n_pivots=16, probes=16)


@query
def knn_probed_rows(spark, sf):
    """Neighbours per customer when one small cell is probed: always as many as asked for."""
    found = _knn(spark, sf, "euclidean", n_pivots=400, probes=1)
    return found.groupBy("query_id").agg(F.count(F.lit(1)).alias("neighbours"))


@query
def knn_recall(spark, sf):
    """Whether the probed search finds at least nine of ten exact neighbours."""
    exact, found = knn_euclidean(spark, sf), knn_probed(spark, sf)
    recall = similarity.recall(found, exact, "query_id", "ref_id")
    return recall.select((F.col("recall") >= 0.9).alias("enough"))


def _customer_vectors(spark, sf):
    rows = sources.stage(
        _rounded_features(spark, sf, ()).select("customer_id", *retail.SIMILARITY_FEATURES), "features"
    )
    return similarity.z_scored(rows, "customer_id", retail.SIMILARITY_FEATURES, rows)


@query
def knn_forest(spark, sf):
    """Five nearest customers by a forest of ten trees."""
    vectors = _customer_vectors(spark, sf).withColumnRenamed("customer_id", "query_id")
    out = forest.nearest_in_forest(vectors, None, "query_id", "ref_id", 5)
    return _round(out, {"distance": 6, "score": 6})


@query
def knn_forest_recall(spark, sf):
    """Whether the forest finds nine of ten exact neighbours, and compares no more rows than stated."""
    exact, found = knn_euclidean(spark, sf), knn_forest(spark, sf)
    recall = similarity.recall(found, exact, "query_id", "ref_id")
    sizes = forest.leaf_sizes(_customer_vectors(spark, sf), "customer_id")
    met = sizes.groupBy().agg((F.max("rows") <= 2 * forest.LEAF_ROWS).alias("within"))
    return recall.select((F.col("recall") >= 0.9).alias("enough")).join(met)


@query
def embedding_topk(spark, sf):
    rows = retail.table(spark, sf, "embeddings")
    vectors = similarity.z_scored_array(rows, "vec_id", "embedding", rows)
    out = _all_pairs(vectors, "vec_id", 5, "euclidean", exclude_self=True)
    return _round(out, {"distance": 5, "score": 6})


def _clicked_neighbours(spark, sf):
    """Clicked texts only are candidates; a text counts as clicked when its label is good."""
    clicked = (
        retail.table(spark, sf, "labels").where("quality = 1").select(F.col("doc_id").alias("vec_id"))
    )
    vectors = retail.table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("vec"))
    return similarity.nearest(
        vectors.withColumnRenamed("vec_id", "query_id"),
        vectors.join(clicked, "vec_id").withColumnRenamed("vec_id", "ref_id"),
        "query_id", "ref_id", 5, "cosine",
    )


@query
def similar_text_cosine(spark, sf):
    e = retail.table(spark, sf, "embeddings")
    docs = retail.table(spark, sf, "documents").select("doc_id", "text")
    texts = e.join(docs, e.vec_id == docs.doc_id).select(
        F.col("vec_id").alias("ref_id"), "text", "label"
    )
    near = _clicked_neighbours(spark, sf)
    return factors.similar_texts(near, texts, "query_id", "ref_id", "text", "label", "rec")


@query
def similar_text_answers(spark, sf):
    """The same neighbours with an answer and a confidence by rank."""
    docs = retail.table(spark, sf, "documents").select("doc_id", "text")
    texts = docs.join(retail.table(spark, sf, "labels"), "doc_id").select(
        F.col("doc_id").alias("ref_id"), "text", "toxic"
    )
    near = _clicked_neighbours(spark, sf)
    return factors.similar_texts(near, texts, "query_id", "ref_id", "text", "toxic", "cls")


# Local ranking -------------------------------------------------------------


def _ranking_rows(spark, sf):
    rows = _rounded_features(spark, sf, ()).select("customer_id", *retail.RANKING_FEATURES, "label")
    split = _split_customers(spark, sf).select("customer_id", "split")
    return sources.stage(rows.join(split, "customer_id"), "ranking-rows")


def _neighbourhood(rows: DataFrame, k: int, ranks) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Neighbours of the test rows at ``ranks`` among the train rows, and both tables with vectors and values."""
    columns = list(retail.RANKING_FEATURES)
    train, test = rows.where("split = 'train'").drop("split"), rows.where("split = 'test'")
    scaled = clean.min_max_scale(train, columns, train).select(
        F.col("customer_id").alias("ref_id"),
        F.array(*columns).alias("vec"),
        F.array(*[F.round(c, 9) for c in columns], F.col("label").cast("double")).alias("values"),
    )
    asked = similarity.min_max_scaled(test, "customer_id", columns, train).withColumnRenamed(
        "customer_id", "query_id"
    )
    near = similarity.nearest(asked, scaled.drop("values"), "query_id", "ref_id", k, "cosine", ranks=ranks)
    return near, asked, scaled


def _limits(rows: DataFrame, k: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The same with the last neighbour only, which is all that sums need."""
    return _neighbourhood(rows, k, [k])


def _sums(near, asked, scaled, *views):
    return sources.stage(
        similarity.nearest_sums(near, asked, scaled, "query_id", "ref_id", views, "cosine"), "neighbour-sums"
    )


_N_RANKED = len(retail.RANKING_FEATURES)
_BINS = (retail.RANKING_NEIGHBOURS, factors.bin_view(_N_RANKED))
_PAIRS = factors.all_pairs(_N_RANKED + 1)
_MOMENTS = (retail.SCREEN_NEIGHBOURS, factors.moment_view(_N_RANKED + 1, _PAIRS))


@query
def corr_ranking(spark, sf):
    pairs = [(i, _N_RANKED) for i in range(_N_RANKED)]
    view = (retail.RANKING_NEIGHBOURS, factors.moment_view(_N_RANKED + 1, pairs))
    sums = _sums(*_limits(_ranking_rows(spark, sf), retail.RANKING_NEIGHBOURS), view)
    found = factors.correlations(sums, "query_id", "sums_0", _N_RANKED + 1, pairs)
    out = factors.correlation_ranking_of(found, "query_id", retail.RANKING_FEATURES)
    return _round(out, {"score": 6})


@query
def mi_ranking(spark, sf):
    sums = _sums(*_limits(_ranking_rows(spark, sf), retail.RANKING_NEIGHBOURS), _BINS)
    out = factors.information_ranking_of(sums, "query_id", "sums_0", retail.RANKING_FEATURES)
    return _round(out, {"score": 6})


@query
def fisher_z_screen(spark, sf):
    sums = _sums(*_limits(_ranking_rows(spark, sf), retail.SCREEN_NEIGHBOURS), _MOMENTS)
    found = factors.correlations(sums, "query_id", "sums_0", _N_RANKED + 1, _PAIRS)
    out = factors.dependence_screen_of(found, "query_id", retail.RANKING_FEATURES)
    return _round(out, {"correlation": 6, "weakest_z": 5})


@query
def dependence_skeleton(spark, sf):
    """Pairs of eight features and the label that stay dependent given up to two others."""
    names = [*retail.SIMILARITY_FEATURES, "label"]
    places = [*range(len(names) - 1), _N_RANKED]
    pairs = [(places[i], places[j]) for i, j in factors.all_pairs(len(names))]
    view = (retail.SCREEN_NEIGHBOURS, factors.moment_view(_N_RANKED + 1, pairs))
    sums = _sums(*_limits(_ranking_rows(spark, sf), retail.SCREEN_NEIGHBOURS), view)
    found = factors.correlations(sums, "query_id", "sums_0", _N_RANKED + 1, pairs)
    out = skeleton.skeleton_from(found, "query_id", names, max_order=2)
    return _round(out, {"correlation": 6}).withColumn("separated_by", F.array_join("separated_by", "+"))


def _factor_order(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nearest cases and factor order of every row; one search serves both."""
    ks = [retail.RANKING_NEIGHBOURS, retail.SCREEN_NEIGHBOURS]
    near, asked, scaled = _neighbourhood(rows, retail.RANKING_NEIGHBOURS, [*range(1, 6), *ks])
    near = sources.stage(similarity.first_and_last(near, scaled, 5, ks), "neighbours")
    sums = _sums(near, asked, scaled, _BINS, _MOMENTS)
    ranking = factors.information_ranking_of(sums, "query_id", "sums_0", retail.RANKING_FEATURES)
    found = factors.correlations(sums, "query_id", "sums_1", _N_RANKED + 1, _PAIRS)
    screen = factors.dependence_screen_of(found, "query_id", retail.RANKING_FEATURES)
    return near, factors.factor_order(ranking, screen, "query_id")


@query
def factor_text(spark, sf):
    _, order = _factor_order(_ranking_rows(spark, sf))
    return factors.factor_text(order, "query_id", FULL_NAMES)


def _case_text(rows: DataFrame, near: DataFrame, order: DataFrame) -> DataFrame:
    reference = rows.withColumnRenamed("customer_id", "ref_id").withColumn(
        "answer", rt.class_text(F.col("label"))
    )
    return factors.case_text(
        near, order, reference, "query_id", "ref_id", retail.RANKING_FEATURES, "answer"
    )


@query
def case_text(spark, sf):
    rows = _ranking_rows(spark, sf)
    near, order = _factor_order(rows)
    return _case_text(rows, near, order)


@query
def case_text_rec(spark, sf):
    """Cases with the item columns that are not zero, answered by preferred categories."""
    rows = _ranking_rows(spark, sf)
    near, order = _factor_order(rows)
    reference = rows.withColumnRenamed("customer_id", "ref_id").withColumn(
        "answer", F.concat(F.lit("group "), F.col("nb_category").cast("string"))
    )
    return factors.case_text(
        near, order, reference, "query_id", "ref_id", retail.RANKING_FEATURES, "answer",
        item_columns=retail.SHARES, task="rec",
    )


@query
def factor_prompt(spark, sf):
    rows = _ranking_rows(spark, sf)
    near, order = _factor_order(rows)
    order = sources.stage(order, "factor-order")
    texts = rows.select(
        F.col("customer_id").alias("query_id"),
        profile.numeric_text(
            rows, {c: FULL_NAMES.get(c, c) for c in retail.SIMILARITY_FEATURES}
        ).alias("text"),
    )
    joined = (
        texts.join(factors.factor_text(order, "query_id", FULL_NAMES), "query_id")
        .join(_case_text(rows, near, order), "query_id")
    )
    return joined.select(
        "query_id",
        prompts.factor_prompt(
            joined, "Start.", "End.", "text", "Factors:\n", "Cases:\n"
        ).alias("prompt"),
    )


@query
def factor_prompt_layouts(spark, sf):
    """The prompt without factors, without cases, and without both."""
    rows = _ranking_rows(spark, sf)
    near, order = _factor_order(rows)
    order = sources.stage(order, "factor-order")
    joined = factors.factor_text(order, "query_id", FULL_NAMES).join(
        _case_text(rows, near, order), "query_id"
    ).withColumn("text", F.concat(F.lit("Customer "), "query_id"))
    intros = {"factors": ("Factors:\n", None), "cases": (None, "Cases:\n"), "text": (None, None)}
    layouts = F.array(
        *[
            F.struct(
                F.lit(name).alias("layout"),
                prompts.factor_prompt(joined, "Start.", "End.", "text", *intro).alias("prompt"),
            )
            for name, intro in intros.items()
        ]
    )
    return joined.select("query_id", F.inline(layouts))


# Text ----------------------------------------------------------------------


@query
def format_values(spark, sf):
    o = retail.table(spark, sf, "orders")
    share = F.col("o_totalprice") / F.lit(500000.0)
    return o.select(
        "o_orderkey",
        format_value(F.col("o_orderkey") % 2, "binary", "bigint").alias("as_binary"),
        format_value(share, "percent", "double").alias("as_percent"),
        format_value(F.col("o_totalprice"), "integer", "double").alias("as_integer"),
        format_value(F.col("o_totalprice"), "float", "double").alias("as_float"),
        format_value(F.col("o_totalprice"), "string", "double").alias("as_string"),
        format_value(
            F.when(F.col("o_orderstatus") == "O", F.col("o_totalprice")), "float", "double"
        ).alias("with_nulls"),
    )


@query
def template_profile(spark, sf):
    rows = retail.customer_table(spark, sf)
    return rows.select(
        "customer_id", profile.template_profile(rows, retail.PROFILE_SPECS).alias("template_profile")
    )


@query
def template_profile_shuffled(spark, sf):
    rows = retail.customer_table(spark, sf)
    text = profile.template_profile(rows, retail.PROFILE_SPECS, True, True)
    return rows.select("customer_id", text.alias("template_profile"))


@query
def template_treatment(spark, sf):
    rows = clean.treatment_grid(
        retail.customers(spark, sf).select("customer_id"), "promotion", retail.TREATMENTS
    )
    return rows.select(
        "customer_id",
        F.array_join(profile.raw_values(rows, retail.TREATMENT_SPECS), "|").alias("treatment"),
        profile.template_sentences(rows, retail.TREATMENT_SPECS).alias("template_treatment"),
    )


@query
def template_outcome(spark, sf):
    rows = features.outcome_table(
        retail.transactions(spark, sf), retail.FEATURE_PERIOD, retail.OUTCOME_PERIOD
    )
    return rows.select(
        "customer_id",
        F.array_join(profile.raw_values(rows, retail.OUTCOME_SPECS, "None"), "~").alias("outcome"),
        profile.template_sentences(rows, retail.OUTCOME_SPECS).alias("template_outcome"),
    )


def _profiles(spark, sf):
    return profile.profile_dataset(
        retail.customer_table(spark, sf),
        retail.PROFILE_SPECS,
        retail.TREATMENT_SPECS,
        retail.OUTCOME_SPECS,
    )


@query
def profile_dataset(spark, sf):
    return _profiles(spark, sf).withColumns(
        {"treatment": F.array_join("treatment", "|"), "outcome": F.array_join("outcome", "~")}
    )


def _described(spark, sf):
    """Customers with their purchases, zero for those without any."""
    promo = features.category_pivot(retail.feature_transactions(spark, sf), ["PROMO"])
    rfm = features.rfm_features(retail.feature_transactions(spark, sf))
    c = retail.customers(spark, sf).select("customer_id", F.col("c_mktsegment").alias("segment"))
    return (
        c.join(rfm, "customer_id", "left")
        .join(promo.select("customer_id", "promo"), "customer_id", "left")
        .fillna(0)
        .fillna(0.0)
    )


@query
def sentence_template(spark, sf):
    rows = _described(spark, sf)
    text = profile.sentence_text(rows, retail.SENTENCES, retail.SEGMENT_NAMES)
    return rows.select("customer_id", text.alias("human_template"))


@query
def numeric_template(spark, sf):
    rows = _rounded_features(spark, sf, ())
    text = profile.numeric_text(rows, retail.NUMERIC_NAMES, label_columns=["label"])
    return rows.select("customer_id", text.alias("numerical_template"))


@query
def strip_labels(spark, sf):
    rows = _rounded_features(spark, sf, ())
    text = profile.numeric_text(rows, retail.NUMERIC_NAMES)
    return rows.select(
        "customer_id",
        rt.strip_label_sentences(text, [retail.NUMERIC_NAMES["label"]]).alias("text"),
    )


@query
def clean_reply(spark, sf):
    d = retail.table(spark, sf, "documents")
    lead = F.when(F.col("doc_id") % 3 == 0, F.lit("Here is the Profile:\n")).otherwise(F.lit("Note: "))
    return d.select("doc_id", rt.profile_body(F.concat(lead, F.col("text"))).alias("reply"))


@query
def label_codecs(spark, sf):
    d = retail.table(spark, sf, "labels")
    text = rt.class_text(F.col("quality"))
    return d.select(
        "doc_id",
        text.alias("class_text"),
        rt.class_number(F.concat(F.lit("I "), text)).alias("class_number"),
        rt.label_sentence(F.col("quality")).alias("label_text"),
        rt.click_flag(F.col("toxic")).alias("click"),
    )


def _brand_text(spark, sf):
    """Comma list of the brands of each order's lines, with quotes and a final dot."""
    lines = retail.table(spark, sf, "lineitem")
    parts = retail.table(spark, sf, "part")
    brands = (
        lines.join(parts, lines.l_partkey == parts.p_partkey)
        .groupBy("l_orderkey")
        .agg(F.array_sort(F.collect_set("p_brand")).alias("b"))
    )
    return brands.select("l_orderkey", F.array_join("b", ", ").alias("brands"))


@query
def map_labels(spark, sf):
    rows = _brand_text(spark, sf)
    return rows.select(
        "l_orderkey", rt.map_items(F.col("brands"), retail.BRAND_CATEGORY).alias("categories")
    )


@query
def brand_lists(spark, sf):
    rows = _brand_text(spark, sf)
    text = F.concat(F.lit("{brand: '"), F.replace("brands", F.lit("Brand#"), F.lit("brand")), F.lit("'}."))
    cleaned = rt.clean_brands(text)
    return rows.select(
        "l_orderkey",
        cleaned.alias("cleaned"),
        F.array_join(rt.brand_list(cleaned), "|").alias("items"),
    )


def _loose_text(spark, sf):
    """Replies in free text about each labelled document."""
    d = retail.table(spark, sf, "labels")
    key = F.col("doc_id").cast("string")
    answer = rt.class_text(F.col("quality"))
    share = (F.col("doc_id") % 130).cast("string")
    return d.select(
        "doc_id",
        F.when(
            F.col("doc_id") % 5 == 0,
            F.concat(F.lit("response follows, answer: "), answer, F.lit("; confidence: "), share,
                     F.lit("% of 200; reason: case "), key),
        )
        .when(
            F.col("doc_id") % 5 == 1,
            F.concat(F.lit('Sure: {"answer": "'), answer, F.lit('", "confidence": "'), share,
                     F.lit('", "reason": "case '), key, F.lit('"}')),
        )
        .when(F.col("doc_id") % 5 == 2, F.concat(F.lit("I "), answer, F.lit(" this")))
        .otherwise(
            F.concat(F.lit("The answer is "), answer, F.lit(" with confidence "), share,
                     F.lit(" for the reason "), key, F.lit("<|eot_id|>")),
        )
        .alias("reply"),
    )


@query
def parse_confidence(spark, sf):
    d = retail.table(spark, sf, "documents")
    return d.select("doc_id", rt.confidence_number(F.col("text")).alias("confidence"))


@query
def parse_loose_reply(spark, sf):
    return _loose_text(spark, sf).select(
        "doc_id", F.inline(F.array(rt.loose_reply(F.col("reply"), "cls")))
    )


@query
def parse_reply(spark, sf):
    out = _loose_text(spark, sf).select(
        "doc_id", F.inline(F.array(rt.reply_fields(F.col("reply"), "cls")))
    )
    return _round(out, {"confidence": 4})


def _brand_replies(spark, sf):
    """Free-text and structured replies that name the brands of each order."""
    rows = _brand_text(spark, sf)
    key = F.col("l_orderkey").cast("string")
    share = (F.col("l_orderkey") % 130).cast("string")
    names = F.replace("brands", F.lit("Brand#"), F.lit("brand"))
    return rows.select(
        "l_orderkey",
        F.when(
            F.col("l_orderkey") % 3 == 0,
            F.concat(F.lit('Sure: {"brand": "'), names, F.lit('", "confidence": "'), share,
                     F.lit('", "reason": "order '), key, F.lit('"}')),
        )
        .when(F.col("l_orderkey") % 3 == 1, F.concat(F.lit("I like "), names))
        .otherwise(
            F.concat(F.lit("The answer is "), names, F.lit(" with confidence "), share,
                     F.lit(" for the reason "), key, F.lit("<|eot_id|>")),
        )
        .alias("reply"),
    )


@query
def parse_loose_brands(spark, sf):
    return _brand_replies(spark, sf).select(
        "l_orderkey", F.inline(F.array(rt.loose_reply(F.col("reply"), "rec")))
    )


@query
def parse_brands(spark, sf):
    out = _brand_replies(spark, sf).select(
        "l_orderkey", F.inline(F.array(rt.reply_fields(F.col("reply"), "rec")))
    )
    return _round(out, {"confidence": 4})


# Prompts and replies -------------------------------------------------------


def _chunked_profiles(spark, sf):
    return prompts.assign_chunks(sources.stage(_profiles(spark, sf), "profiles"), retail.SETTINGS)


def _chunked_customers(spark, sf):
    rows = retail.customers(spark, sf).select("customer_id", "c_acctbal", "c_mktsegment")
    return prompts.assign_chunks(rows, retail.SETTINGS)


def _narrative_replies(rows: DataFrame) -> DataFrame:
    text = F.concat(F.lit("Spends on "), F.col("c_mktsegment"))
    return made.chunk_replies(rows, made.narrative_entry(F.col("customer_id"), text))


def _prediction_replies(rows: DataFrame) -> DataFrame:
    return made.chunk_replies(
        rows, made.prediction_entry(F.col("customer_id"), F.col("c_acctbal"), F.col("c_mktsegment"))
    )


@query
def chunk_assign(spark, sf):
    return _chunked_customers(spark, sf).drop("c_acctbal", "c_mktsegment")


@query
def profile_prompt(spark, sf):
    return prompts.profile_prompts(_chunked_profiles(spark, sf))


@query
def prediction_prompt(spark, sf):
    rows = _chunked_profiles(spark, sf)
    return prompts.prediction_prompts(rows, "template_profile")


@query
def prompt_size(spark, sf):
    return prompts.prompt_sizes(
        prompts.profile_prompts(_chunked_profiles(spark, sf)), len(retail.SYSTEM_TEXT)
    )


def _examples(spark, sf, k=3, keep=lambda profiles: profiles):
    """Customers' texts, as ``keep`` returns them, and the three nearest other customers of each with theirs."""
    rows = sources.stage(_rounded_features(spark, sf, retail.EXAMPLE_TEXTS), "customers")
    vectors = similarity.z_scored(rows, "customer_id", retail.SIMILARITY_FEATURES, rows)
    near = _all_pairs(vectors, "customer_id", k, "euclidean", exclude_self=True)
    profiles = keep(
        profile.profile_dataset(rows, retail.PROFILE_SPECS, retail.TREATMENT_SPECS, retail.OUTCOME_SPECS)
    )
    return rows, profiles, similarity.neighbour_examples(near, profiles, "query_id", "ref_id")


@query
def fewshot_examples(spark, sf):
    _, _, examples = _examples(spark, sf)
    return _round(examples.drop("distance"), {"score": 6})


def _example_blocks(spark, sf):
    # Texts are written once, for the examples and for the prompts.
    rows, profiles, examples = _examples(spark, sf, keep=lambda p: sources.stage(p, "profiles"))
    asked = profiles.drop("outcome", "template_outcome")
    chunked = sources.stage(prompts.assign_chunks(asked, retail.SETTINGS), "chunks")
    sections = prompts.example_sections(examples, "query_id")
    return rows, chunked, prompts.example_blocks(sections, chunked, "query_id")


@query
def fewshot_block(spark, sf):
    return _example_blocks(spark, sf)[2]


@query
def prompt_context(spark, sf):
    rows, chunked, blocks = _example_blocks(spark, sf)
    distribution = stats.outcome_distribution_text(
        rows, retail.OUTCOME_SPECS, retail.OUTCOME_CONTEXT, "target_categories"
    )
    return prompts.prompt_context(
        prompts.prediction_prompts(chunked, "template_profile"),
        retail.SYSTEM_TEXT,
        retail.OUTCOME_SPECS,
        distribution,
        blocks,
    )


@query
def prompt_layouts(spark, sf):
    """The prompt without examples, without distribution, and without both."""
    rows, chunked, blocks = _example_blocks(spark, sf)
    distribution = stats.outcome_distribution_text(
        rows, retail.OUTCOME_SPECS, retail.OUTCOME_CONTEXT, "target_categories"
    )
    asked = sources.stage(prompts.prediction_prompts(chunked, "template_profile"), "prompts")
    parts = {"distribution": (distribution, None), "examples": (None, blocks), "profiles": (None, None)}
    made_ = [
        prompts.prompt_context(asked, retail.SYSTEM_TEXT, retail.OUTCOME_SPECS, *given)
        .withColumn("layout", F.lit(name))
        for name, given in parts.items()
    ]
    return made_[0].unionByName(made_[1]).unionByName(made_[2])


@query
def extract_json_array(spark, sf):
    replies = _narrative_replies(_chunked_customers(spark, sf))
    return reconcile.reply_rows(replies, ["customer_id", "narrative_profile"])


@query
def reconcile_replies(spark, sf):
    rows = sources.stage(_chunked_customers(spark, sf), "chunks")
    parsed = reconcile.reply_rows(_narrative_replies(rows), ["customer_id", "narrative_profile"])
    matched = reconcile.match_replies(rows, parsed, ["narrative_profile"], on_duplicate="all")
    return matched.select("chunk_no", "customer_id", "narrative_profile", "matched")


@query
def narrative_profiles(spark, sf):
    rows = sources.stage(_chunked_customers(spark, sf), "chunks")
    replies = _narrative_replies(rows)
    templated = rows.withColumn(
        "template_profile", F.concat(F.lit("[Segment Domain] Segment: "), F.col("c_mktsegment"), F.lit("."))
    )
    return reconcile.narrative_profiles(templated, replies, append_template=True).select(
        "customer_id", "narrative_profile", "is_fallback"
    )


@query
def validate_predictions(spark, sf):
    rows = _chunked_customers(spark, sf)
    fields = reconcile.prediction_fields(retail.OUTCOME_SPECS)
    parsed = reconcile.reply_rows(_prediction_replies(rows), ["customer_id", *fields], True)
    good = reconcile.validated(retail.OUTCOME_SPECS)
    return parsed.select("customer_id", *[c.alias(n) for n, c in good.items()])


@query
def predictions(spark, sf):
    rows = sources.stage(_chunked_customers(spark, sf), "chunks")
    out = reconcile.predictions(rows, _prediction_replies(rows), retail.OUTCOME_SPECS)
    return out.drop("window_no", "position", "c_acctbal", "c_mktsegment")


@query
def fallback_report(spark, sf):
    rows = sources.stage(_chunked_customers(spark, sf), "chunks")
    return reconcile.fallback_report(
        rows, _narrative_replies(rows), ["customer_id", "narrative_profile"]
    )


def _product_lines(spark, sf):
    rows = prompts.assign_chunks(
        retail.table(spark, sf, "part").select(
            F.col("p_partkey").cast("string").alias("stock_code"),
            F.concat("p_name", F.lit(" "), F.col("p_partkey").cast("string")).alias("description"),
            "p_type",
        ),
        retail.SETTINGS,
        ["stock_code"],
    )
    line = F.when(
        F.col("stock_code").cast("bigint") % 9 != 0,
        F.concat(F.lit('"'), F.col("description"), F.lit('"|"'), F.col("p_type"), F.lit('"')),
    ).otherwise(F.col("description"))
    replies = rows.groupBy("chunk_no").agg(
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct("position", line.alias("l")))), lambda e: e["l"]
            ),
            "\n",
        ).alias("reply")
    )
    return rows, replies


@query
def category_lines(spark, sf):
    rows, replies = _product_lines(spark, sf)
    out = reconcile.assign_categories(rows, reconcile.category_lines(replies))
    return out.select("stock_code", "description", "category")


@query
def narrative_stub(spark, sf):
    rows = sources.stage(_chunked_profiles(spark, sf), "chunks")
    replies = inference.staged_replies(
        prompts.profile_prompts(rows), made.stub_narratives, retail.SETTINGS, workers=4
    )
    return reconcile.narrative_profiles(rows, replies).select(
        "customer_id", "narrative_profile", "is_fallback"
    )


@query
def prediction_stub(spark, sf):
    rows = sources.stage(_chunked_profiles(spark, sf), "chunks")
    replies = inference.staged_replies(
        prompts.prediction_prompts(rows, "template_profile"),
        made.stub_predictions, retail.SETTINGS, workers=4,
    )
    fields = reconcile.prediction_fields(retail.OUTCOME_SPECS)
    out = reconcile.predictions(rows, replies, retail.OUTCOME_SPECS)
    return out.select("customer_id", *fields, "is_fallback")


@query
def counterfactual_predictions(spark, sf):
    """Every customer predicted under every treatment, and the effect against the first one."""
    rows = clean.treatment_grid(
        retail.customers(spark, sf).select(
            "customer_id", F.concat(F.lit("Segment: "), "c_mktsegment").alias("template_profile")
        ),
        "promotion",
        retail.TREATMENTS,
    ).withColumn("template_treatment", F.concat(F.lit("Promotion offered: "), "promotion", F.lit(".")))
    predicted = flows.predict_outcomes(
        rows, rows, retail.OUTCOME_SPECS, made.stub_treatments, retail.SETTINGS, retail.SYSTEM_TEXT,
        profile_col="template_profile", treatment_col="promotion",
    )
    out = reconcile.treatment_effects(
        predicted, "promotion", retail.TREATMENTS[0], retail.OUTCOME_SPECS
    )
    return out.select(
        "customer_id", "promotion", "pred_target_sales", "effect_target_sales", "is_fallback"
    )


@query
def resume_prompts(spark, sf):
    """A second run over more customers, some with a changed prompt, sends only prompts without a reply."""
    path = sources.staged_path(spark, "stored-replies")
    people = retail.customers(spark, sf)
    text = F.concat_ws(" ", "customer_id", "c_mktsegment")
    changed = F.when(people.c_custkey % 7 == 0, F.concat(F.lit("earlier "), text)).otherwise(text)
    first = people.where("c_nationkey < 20").select(people.c_custkey.alias("chunk_no"), changed.alias("prompt"))
    second = people.select(people.c_custkey.alias("chunk_no"), text.alias("prompt"))
    flows.prompt_replies(first, made.stub_marked("first"), retail.SETTINGS, path, rounds=2)
    replies = flows.prompt_replies(second, made.stub_marked("second"), retail.SETTINGS, path, rounds=2)
    return replies.select(F.col("chunk_no").alias("c_custkey"), "reply")


@query
def adaptive_stub(spark, sf):
    rows = sources.stage(_rounded_features(spark, sf, ()), "customers")
    text = profile.numeric_text(rows, retail.NUMERIC_NAMES)
    numbers = rt.strip_label_sentences(text, [retail.NUMERIC_NAMES["label"]])
    spread = stats.quartile_text(
        rows, {c: FULL_NAMES[c] for c in ("recency", "purchase_day", "total_sales")}
    ).scalar()
    prompt = F.concat(F.lit(ADAPTIVE_LEAD), spread, F.lit("\nCustomer Profile: "), numbers)
    replies = inference.staged_replies(
        rows.select("customer_id", prompt.alias("prompt")), made.stub_profile, retail.SETTINGS, 4
    )
    return replies.select("customer_id", rt.profile_body(F.col("reply")).alias("adaptive_template"))


@query
def narratives(spark, sf):
    """The narrative flow over all customers; the model leaves some of them out."""
    rows = sources.stage(_rounded_features(spark, sf, retail.PROFILE_TEXTS), "customers")
    told = flows.write_narratives(
        rows, retail.PROFILE_SPECS, made.stub_narrator, retail.SETTINGS, retail.SYSTEM_TEXT,
        replies_path=sources.staged_path(spark, "told"), workers=8,
    )
    return told.select("customer_id", "narrative_profile", "is_fallback")


@query
def fewshot_predictions(spark, sf):
    """Test customers predicted from examples of the train customers; the model repeats the nearest one."""
    split = _split_customers(spark, sf).select("customer_id", "split")
    rows = _rounded_features(spark, sf, retail.EXAMPLE_TEXTS).join(split, "customer_id")
    rows = sources.stage(rows, "split-customers")
    test, train = rows.where("split = 'test'"), rows.where("split = 'train'")
    predicted = flows.predict_outcomes(
        profile.profile_dataset(test, retail.PROFILE_SPECS, retail.TREATMENT_SPECS),
        test, retail.OUTCOME_SPECS, made.stub_examples, retail.SETTINGS, retail.SYSTEM_TEXT,
        outcome_context=retail.OUTCOME_CONTEXT, outcome_exclude="target_categories",
        reference_profiles=profile.profile_dataset(
            train, retail.PROFILE_SPECS, retail.TREATMENT_SPECS, retail.OUTCOME_SPECS
        ),
        reference_df=train, similarity_features=retail.SIMILARITY_FEATURES, top_k=3,
        profile_col="template_profile", workers=8,
    )
    return predicted.select("customer_id", "pred_target_sales", "pred_target_categories", "is_fallback")


@query
def adaptive_resumed(spark, sf):
    """Adaptive texts in two runs: the second asks only for customers whose prompt has no reply yet."""
    rows = sources.stage(_rounded_features(spark, sf, ()), "customers")
    text = rt.strip_label_sentences(profile.numeric_text(rows, retail.NUMERIC_NAMES), [retail.NUMERIC_NAMES["label"]])
    prompted = rows.select("customer_id", F.concat(F.lit("Customer Profile: "), text).alias("prompt"))
    path = sources.staged_path(spark, "adaptive")
    some = prompted.where(F.col("customer_id").cast("long") % 3 > 0)
    flows.adaptive_texts(some, made.stub_marked_profile("first"), retail.SETTINGS, path, rounds=2)
    return flows.adaptive_texts(prompted, made.stub_marked_profile("second"), retail.SETTINGS, path, workers=8)


@query
def resume_pending(spark, sf):
    """Orders still to be done when those of finished status have a stored result."""
    orders = retail.table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    done = orders.where("o_orderstatus = 'F'")
    return sources.pending_rows(orders, done, ["o_orderkey"])


def _stored(spark, suffix: str) -> str:
    return sources.staged_path(spark, "written", suffix)


@query
def parquet_sink(spark, sf):
    """Orders written as parquet and read back."""
    path = _stored(spark, "parquet")
    sources.write_table(retail.table(spark, sf, "orders").drop("o_orderdate"), path)
    return sources.read_table(spark, path)


@query
def csv_sink(spark, sf):
    """Customers in shuffled order written as CSV, with a list as JSON text, and read back."""
    rows = retail.customers(spark, sf).select(
        "customer_id", "c_acctbal", F.array("c_mktsegment", F.lit('a "quoted", one')).alias("listed")
    )
    path = _stored(spark, "csv")
    sources.write_table(sampling.shuffled(rows, ["customer_id"]), path)
    schema = T.StructType([*rows.schema.fields[:2], T.StructField("listed", T.StringType())])
    return sources.read_csv(spark, path, schema)


@query
def json_sink(spark, sf):
    """Orders with nulls written as JSON lines and read back."""
    rows = retail.table(spark, sf, "orders").select(
        "o_orderkey", F.when(F.col("o_orderstatus") == "O", F.col("o_totalprice")).alias("open_price")
    )
    path = _stored(spark, "json")
    sources.write_json_lines(rows, path)
    return spark.read.schema(rows.schema).json(path)


@query
def ft_export_cls(spark, sf):
    rows = _rounded_features(spark, sf, ())
    texts = rows.select(
        "customer_id", "label",
        profile.numeric_text(rows, retail.NUMERIC_NAMES, ["label"]).alias("text"),
    )
    return sources.classification_export(texts, retail.SYSTEM_TEXT, "text", "label")


@query
def ft_export_rec(spark, sf):
    rows = _rounded_features(spark, sf, retail.OUTCOME_TEXTS)
    texts = rows.select(
        "label",
        F.concat(F.replace("target_categories", F.lit("|"), F.lit(", ")), F.lit(".")).alias("response"),
        profile.numeric_text(rows, retail.NUMERIC_NAMES, ["label"]).alias("text"),
    )
    out = sources.preference_export(texts, retail.SYSTEM_TEXT, "text", "response", "label")
    return out


# Baseline and evaluation ---------------------------------------------------


def _baseline(spark, sf):
    """Split customers and the baseline fitted on their train part."""
    split = _split_customers(spark, sf).select("customer_id", "split")
    rows = sources.stage(_rounded_features(spark, sf, ()).join(split, "customer_id"), "split-customers")
    train = rows.where("split = 'train'")
    return rows, baseline.fit_baseline(train, retail.RANKING_FEATURES, "target_sales")


@query
def gbt_baseline(spark, sf):
    """Boosted trees on the reference part, scored on the hold-out; importances."""
    rows, model = _baseline(spark, sf)
    scored = baseline.baseline_predictions(model, rows.where("split != 'train'"), "base_sales")
    errors = evaluate.regression_errors(scored, "target_sales", ["base_sales"])
    top = baseline.importances(model, rows)
    return top.select("feature", "importance").unionByName(
        errors.select(F.inline(F.array(
            F.struct(F.lit("mse").alias("feature"), F.col("mse").alias("importance")),
            F.struct(F.lit("mae").alias("feature"), F.col("mae").alias("importance")),
        )))
    )


@query
def baseline_errors(spark, sf):
    """Rows that the baseline scores per part, and whether its error is below the constant's.

    All rounds are held against the train part, those that validation keeps (none, if
    none helps) against the validation part.
    """
    rows, model = _baseline(spark, sf)
    best = baseline.cut_to_best(model, rows.where("split = 'valid'"), "target_sales")
    scored = baseline.baseline_predictions(model, rows.where("split != 'test'"), "base_sales")
    scored = baseline.baseline_predictions(best, scored, "best_sales").withColumn("constant", F.lit(model.start))
    squared = lambda c: F.avg((F.col("target_sales") - F.col(c)) ** 2)
    return scored.groupBy("split").agg(
        F.count("base_sales").alias("scored"),
        F.when(F.col("split") == "train", squared("base_sales") < squared("constant"))
        .otherwise(squared("best_sales") <= squared("constant"))
        .alias("helps"),
    )


@query
def binary_metrics(spark, sf):
    out = evaluate.binary_metrics(retail.scored_documents(spark, sf), "quality", "score")
    return _round(out, {c: 8 for c in out.columns})


@query
def roc_pr_auc(spark, sf):
    out = evaluate.ranking_metrics(retail.scored_documents(spark, sf), "quality", "score")
    return _round(out, {c: 8 for c in out.columns})


@query
def classification_report(spark, sf):
    rows = retail.table(spark, sf, "orders").select(
        "o_orderstatus",
        F.when(F.col("o_orderkey") % 3 == 0, F.lit("F"))
        .when(F.col("o_orderkey") % 7 == 1, F.lit("P"))
        .otherwise(F.col("o_orderstatus"))
        .alias("predicted"),
    )
    out = evaluate.classification_report(
        evaluate.usable(rows, "predicted"), "o_orderstatus", "predicted"
    )
    return _round(out, {"precision": 8, "recall": 8, "f1_score": 8})


def _sales_predictions(spark, sf):
    """Outcome sales with two simple predictions from the feature period."""
    sales = features.period_sales(
        retail.transactions(spark, sf), retail.FEATURE_PERIOD, retail.OUTCOME_PERIOD
    ).where(F.col("feature_sales").isNotNull())
    pred = sales.select(
        "customer_id",
        F.round(F.coalesce("outcome_sales", F.lit(0.0)), 2).alias("actual"),
        (F.round("feature_sales", 2) / 3).alias("predicted"),
    )
    baseline_rows = retail.rfm_table(spark, sf).select(
        "customer_id", F.col("avg_purchase_value").alias("baseline")
    )
    return pred.join(baseline_rows, "customer_id")


@query
def regression_errors(spark, sf):
    out = evaluate.regression_errors(
        _sales_predictions(spark, sf), "actual", ["predicted", "baseline"]
    )
    return _round(out, {"mse": 2, "mae": 4})


@query
def confusion_matrix(spark, sf):
    out = evaluate.confusion_matrix(retail.scored_documents(spark, sf), "toxic", "score", 0.3)
    return _round(out, {"share": 8})


@query
def calibration_uniform(spark, sf):
    out = evaluate.calibration_table(retail.scored_documents(spark, sf), "quality", "score", 20)
    return _round(out, {"mean_predicted": 8, "share_positive": 8})


@query
def calibration_quantile(spark, sf):
    out = evaluate.calibration_table(
        retail.scored_documents(spark, sf), "quality", "score", 10, "quantile"
    )
    return _round(out, {"mean_predicted": 8, "share_positive": 8})


@query
def sales_histogram(spark, sf):
    return evaluate.histograms(
        _sales_predictions(spark, sf), ["actual", "predicted", "baseline"], 20
    )


@query
def rec_report(spark, sf):
    """Brands of each order against made predictions that miss the brand of some lines."""
    lines = retail.table(spark, sf, "lineitem")
    parts = retail.table(spark, sf, "part")
    joined = lines.join(parts, lines.l_partkey == parts.p_partkey)
    rows = joined.groupBy("l_orderkey").agg(
        F.collect_set("p_brand").alias("answer"),
        F.collect_set(
            F.when((F.col("l_orderkey") + F.col("l_partkey")) % 5 == 0, F.lit("Brand#11"))
            .otherwise(F.col("p_brand"))
        ).alias("predicted"),
        F.max((F.col("l_returnflag") == "R").cast("int")).alias("click"),
    )
    out = evaluate.recommendation_report(rows, "answer", "predicted", "click")
    return _round(out, {c: 8 for c in out.columns})
