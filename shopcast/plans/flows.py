"""The end-to-end flows: dataset, narrative profiles, outcome predictions, ranked prompts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopcast.config import FeatureSpec, ModelSettings
from shopcast.functions.replies import profile_body
from shopcast.operators import clean, factors, features, prompts, reconcile, sampling, similarity, stats
from shopcast.operators.inference import ModelFactory, resumed_replies, staged_replies
from shopcast.operators.profile import profile_dataset
from shopcast.sources import pending_rows, stage

Period = features.Period


def build_dataset(
    raw: DataFrame,
    categories: DataFrame,
    category_names: Sequence[str],
    feature: Period,
    outcome: Period,
) -> DataFrame:
    """Invoice lines as they come (text dates, numeric customer) to one row per customer."""
    lines = raw.select(
        F.col("CustomerID").alias("customer_id"),
        F.col("InvoiceNo").alias("invoice_no"),
        F.col("StockCode").alias("stock_code"),
        F.col("Description").alias("description"),
        F.col("Quantity").alias("quantity"),
        F.col("UnitPrice").alias("unit_price"),
        F.try_to_timestamp("InvoiceDate", F.lit("M/d/yyyy H:mm")).alias("invoice_date"),
        clean.year_month(F.col("InvoiceDate")).alias("yearmon"),
        (F.col("line_no") if "line_no" in raw.columns else F.lit(0)).alias("line_no"),
    )
    dim = categories.select(F.col("StockCode").alias("stock_code"), "category")
    tx = features.with_category(clean.clean_transactions(lines), dim)
    return features.customer_dataset(tx, feature, outcome, category_names)


def prompt_replies(
    prompted: DataFrame, model: ModelFactory, settings: ModelSettings, path: str | None,
    rounds: int | None = None, workers: int | None = None, key: str = "chunk_no",
):
    """Replies by ``key``.  Stored ones are found by the content of their prompt, not by its number."""
    if not path:
        return staged_replies(prompted, model, settings, workers)
    keyed = prompted.withColumn("prompt_key", F.sha2("prompt", 256))
    different = keyed.select("prompt_key", "prompt").dropDuplicates(["prompt_key"])
    replies = resumed_replies(different, model, settings, path, "prompt_key", workers, rounds)
    return keyed.select(key, "prompt_key").join(replies, "prompt_key", "left").drop("prompt_key")


def adaptive_texts(
    prompted: DataFrame,
    model: ModelFactory,
    settings: ModelSettings,
    replies_path: str | None = None,
    rounds: int | None = None,
    workers: int | None = None,
    key: str = "customer_id",
) -> DataFrame:
    """(key, adaptive_template) of rows with a ``prompt`` each: the profile body of the model's reply.

    ``replies_path`` keeps the replies, so that a later run sends only prompts
    without one.  A failed call gives a null text.
    """
    replies = prompt_replies(prompted, model, settings, replies_path, rounds, workers, key)
    return replies.select(key, profile_body(F.col("reply")).alias("adaptive_template"))


def _require_unique(rows: DataFrame, keys: Sequence[str]) -> None:
    """Error when rows share a key: replies are matched by it."""
    repeated = rows.groupBy(*keys).count().where("count > 1").limit(1).collect()
    if repeated:
        raise ValueError(f"rows share {', '.join(keys)}: {list(repeated[0])[:-1]}")


def write_narratives(
    df: DataFrame,
    specs: Sequence[FeatureSpec],
    model: ModelFactory,
    settings: ModelSettings,
    system: str,
    treatments: Sequence[FeatureSpec] | None = None,
    outcomes: Sequence[FeatureSpec] | None = None,
    row_limit: int | None = None,
    distribution_exclude: str | Sequence[str] | None = None,
    append_template: bool = False,
    replies_path: str | None = None,
    rounds: int | None = None,
    workers: int | None = None,
) -> DataFrame:
    """Template profiles, then a narrative per customer from the model.

    The distribution text describes all rows, also those beyond ``row_limit``.
    ``replies_path`` keeps the replies, so that a later run asks only for
    prompts without one; they are sent and stored in ``rounds`` parts, small ones
    by default, by ``workers`` tasks.
    """
    distribution = stats.feature_distribution_text(df, specs, distribution_exclude).scalar()
    rows = df if row_limit is None else sampling.sample_rows(df, row_limit, ["customer_id"])
    profiles = stage(profile_dataset(rows, specs, treatments, outcomes), "profiles")
    chunked = stage(prompts.assign_chunks(profiles, settings), "profile-chunks")
    batches = prompts.profile_prompts(chunked)
    prompted = batches.select(
        "chunk_no",
        F.concat_ws("\n\n", F.lit(system), F.concat(F.lit("Feature distribution:\n"), distribution),
                    F.concat(F.lit("Customer profiles:\n"), F.col("prompt"))).alias("prompt"),
    )
    replies = prompt_replies(prompted, model, settings, replies_path, rounds, workers)
    narrated = reconcile.narrative_profiles(chunked, replies, append_template)
    return narrated.drop("window_no", "chunk_no", "position")


def predict_outcomes(
    profiles: DataFrame,
    df: DataFrame,
    outcomes: Sequence[FeatureSpec],
    model: ModelFactory,
    settings: ModelSettings,
    system: str,
    outcome_context: str | None = None,
    outcome_exclude: str | Sequence[str] | None = None,
    reference_profiles: DataFrame | None = None,
    reference_df: DataFrame | None = None,
    similarity_features: Sequence[str] | None = None,
    top_k: int = 5,
    metric: str = "euclidean",
    exclude_self: bool = False,
    profile_col: str = "narrative_profile",
    replies_path: str | None = None,
    rounds: int | None = None,
    treatment_col: str | None = None,
    workers: int | None = None,
) -> DataFrame:
    """Profiles with a typed prediction per outcome.

    ``treatment_col`` is given when a customer has one row per treatment: prompts
    and replies then go by ``<customer>|<treatment>``.  Rows that share their key
    are an error.  The outcome distribution is taken from the reference rows when there are
    any; with them come ``top_k`` similar customers per row as examples.
    """
    with_examples = reference_profiles is not None and reference_df is not None
    if with_examples and not similarity_features:
        raise ValueError("similarity_features are needed with a reference")
    _require_unique(profiles, ["customer_id", treatment_col] if treatment_col else ["customer_id"])
    customers = profiles.select("customer_id").distinct()
    profiles = profiles.withColumn("_customer", F.col("customer_id"))
    if treatment_col:
        under = F.coalesce(F.col(treatment_col).cast("string"), F.lit(""))
        profiles = profiles.withColumn("customer_id", F.concat_ws("|", F.col("customer_id").cast("string"), under))
    chunked = stage(prompts.assign_chunks(profiles, settings), "prediction-chunks")
    distribution = None
    if outcome_context is not None:
        base = reference_df if with_examples else df
        distribution = stats.outcome_distribution_text(base, outcomes, outcome_context, outcome_exclude)
    blocks = None
    if with_examples:
        similarity.require_rows(customers, df, "customer_id")
        wanted = df.join(customers, "customer_id", "left_semi")
        near = similarity.nearest(
            similarity.z_scored(wanted, "customer_id", similarity_features, reference_df)
            .withColumnRenamed("customer_id", "query_id"),
            similarity.z_scored(reference_df, "customer_id", similarity_features, reference_df)
            .withColumnRenamed("customer_id", "ref_id"),
            "query_id", "ref_id", top_k, metric, exclude_self,
        )
        examples = similarity.neighbour_examples(
            near, reference_profiles, "query_id", "ref_id", profile_col
        )
        sections = prompts.example_sections(examples, "query_id")
        by_customer = chunked.withColumn("customer_id", F.col("_customer"))
        blocks = prompts.example_blocks(sections, by_customer, "query_id")
    prompted = prompts.prompt_context(
        prompts.prediction_prompts(chunked, profile_col), system, outcomes, distribution, blocks
    ).select("chunk_no", "prompt")
    replies = prompt_replies(prompted, model, settings, replies_path, rounds, workers)
    predicted = reconcile.predictions(chunked, replies, outcomes).withColumn("customer_id", F.col("_customer"))
    return predicted.drop("_customer", "window_no", "chunk_no", "position")


def ranked_factors(
    test: DataFrame,
    train: DataFrame,
    features_: Sequence[str],
    target: str,
    answer: str,
    labels: dict[str, str] | None = None,
    neighbours: int = 2000,
    screen_neighbours: int = 1000,
    max_features: int = 30,
    top_k: int = 15,
    examples: int = 5,
    item_columns: Sequence[str] = (),
    task: str = "cls",
    done: DataFrame | None = None,
) -> DataFrame:
    """Factor and case text per test row, from its neighbourhood in the train rows.

    ``done`` holds texts of an earlier run (customer_id, factor_text, case_text):
    customers with both are not searched again, their rows are returned as they are.

    Rows hold ``customer_id``, the features, a 0/1 ``target`` and an ``answer``
    text.  The target takes no part in scaling or in the search.
    """
    columns = list(features_)
    if done is not None:
        wanted = test.select("customer_id").distinct()
        done = done.where("factor_text IS NOT NULL AND case_text IS NOT NULL").join(wanted, "customer_id", "left_semi")
        done = done.select("customer_id", "factor_text", "case_text")
        test = pending_rows(test, done, ["customer_id"])
    scaled = clean.min_max_scale(train, columns, train).select(
        F.col("customer_id").alias("ref_id"),
        F.array(*columns).alias("vec"),
        F.array(*columns, F.col(target).cast("double")).alias("values"),
    )
    asked = similarity.min_max_scaled(test, "customer_id", columns, train).withColumnRenamed("customer_id", "query_id")
    most = max(neighbours, screen_neighbours, examples)
    ranks = [*range(1, examples + 1), neighbours, screen_neighbours]
    near = similarity.nearest(asked, scaled.drop("values"), "query_id", "ref_id", most, "cosine", ranks=ranks)
    near = stage(similarity.first_and_last(near, scaled, examples, [neighbours, screen_neighbours]), "neighbours")
    size, pairs = len(columns) + 1, factors.all_pairs(len(columns) + 1)
    views = [(neighbours, factors.bin_view(len(columns))), (screen_neighbours, factors.moment_view(size, pairs))]
    sums = stage(
        similarity.nearest_sums(near, asked, scaled, "query_id", "ref_id", views, "cosine"), "neighbour-sums"
    )
    ranking = factors.information_ranking_of(sums, "query_id", "sums_0", columns, max_features)
    screen = factors.dependence_screen_of(
        factors.correlations(sums, "query_id", "sums_1", size, pairs), "query_id", columns
    )
    order = stage(factors.factor_order(ranking, screen, "query_id", top_k), "factor-order")
    reference = train.withColumnRenamed("customer_id", "ref_id")
    cases = factors.case_text(
        near, order, reference, "query_id", "ref_id", columns, answer, examples, item_columns, task
    )
    texts = (
        factors.factor_text(order, "query_id", labels)
        .join(cases, "query_id")
        .withColumnRenamed("query_id", "customer_id")
    )
    return texts if done is None else texts.unionByName(done)
