"""Chunks of rows and the prompt texts made of them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shopcast import fixed
from shopcast.config import FeatureSpec, ModelSettings
from shopcast.functions.hashing import hash_order
from shopcast.operators.running import running_totals


def assign_chunks(
    df: DataFrame,
    settings: ModelSettings,
    key_cols: Sequence[str] = ("customer_id",),
    seed: int | str = 112,
) -> DataFrame:
    """Add window_no, chunk_no and position in a reproducible global order.

    Windows hold ``batch_size`` rows and are cut into chunks of ``chunk_size``.
    Only hashes and their counts are ranked; rows with their texts meet the rank
    of their hash in a join.  Rows that share a key follow each other.
    """
    keyed = df.withColumn("_h", hash_order(key_cols, seed))
    ranks = running_totals(keyed.groupBy("_h").agg(F.count(F.lit(1)).alias("_n")), "_h", ["_n"])
    ranks = ranks.select("_h", (F.col("_n_upto") - F.col("_n")).alias("_before"))
    ranked = keyed.join(ranks, "_h").withColumn(
        "_rank", F.row_number().over(Window.partitionBy("_h").orderBy(*key_cols))
    )
    zero = F.col("_rank") + F.col("_before") - 1
    per_window = -(-settings.batch_size // settings.chunk_size)
    window_no = F.floor(zero / settings.batch_size)
    in_window = zero % settings.batch_size
    return ranked.select(
        *df.columns,
        window_no.cast("bigint").alias("window_no"),
        (window_no * per_window + F.floor(in_window / settings.chunk_size))
        .cast("bigint")
        .alias("chunk_no"),
        (in_window % settings.chunk_size + 1).cast("int").alias("position"),
    )


def _gather(rows: DataFrame, text: Column) -> DataFrame:
    """Texts of a chunk in position order, with a blank line between."""
    return rows.groupBy("chunk_no").agg(
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct("position", text.alias("text")))),
                lambda e: e["text"],
            ),
            "\n\n",
        ).alias("prompt"),
        F.count(F.lit(1)).cast("int").alias("rows"),
    )


def profile_prompts(rows: DataFrame) -> DataFrame:
    """``Customer <id>: <template profile>`` per row, one prompt per chunk."""
    return _gather(
        rows, F.concat(F.lit(fixed.CUSTOMER_LINE), F.col("customer_id"), F.lit(": "), F.col("template_profile"))
    )


def prediction_prompts(rows: DataFrame, profile_col: str = "narrative_profile") -> DataFrame:
    """Profile and treatment per row, one prompt per chunk; missing parts are N/A."""

    def part(column: str) -> Column:
        if column not in rows.columns:
            return F.lit(fixed.MISSING)
        return F.coalesce(F.col(column), F.lit(fixed.MISSING))

    return _gather(
        rows,
        F.concat(
            F.lit(fixed.CUSTOMER_LINE), F.col("customer_id"),
            F.lit(":\n" + fixed.PROFILE_LINE), part(profile_col),
            F.lit("\n" + fixed.TREATMENT_LINE), part("template_treatment"),
        ),
    )


def example_sections(examples: DataFrame, query_id: str) -> DataFrame:
    """One ``examples`` text per query row from its ranked neighbour examples.

    A metric without a score, the plain product, shows the product.
    """
    score = F.coalesce("score", "distance") if "distance" in examples.columns else F.col("score")
    entry = F.concat(
        F.lit("\n" + fixed.EXAMPLE_LINE), F.col("rank").cast("string"),
        F.lit(fixed.SIMILARITY_LINE), F.format_number(score, 3),
        F.lit("):\n" + fixed.PROFILE_LINE), F.col("profile"),
        F.lit("\n" + fixed.TREATMENT_LINE), F.col("treatment"),
        F.lit("\n" + fixed.OUTCOMES_LINE), F.col("outcome"),
    )
    return examples.groupBy(query_id).agg(
        F.concat(
            F.lit(fixed.EXAMPLES_HEAD), F.col(query_id), F.lit(":\n"),
            F.array_join(
                F.transform(
                    F.array_sort(F.collect_list(F.struct("rank", entry.alias("text")))),
                    lambda e: e["text"],
                ),
                "\n",
            ),
        ).alias("examples")
    )


def example_blocks(sections: DataFrame, rows: DataFrame, query_id: str) -> DataFrame:
    """Sections of a chunk's customers, in position order, as one block."""
    placed = rows.select("chunk_no", "position", F.col("customer_id").alias(query_id)).join(
        sections, query_id
    )
    return _gather(placed, F.col("examples")).withColumnRenamed("prompt", "examples")


def reply_format(outcomes: Sequence[FeatureSpec]) -> str:
    """What the model is asked to return for the described outcomes."""
    fields = [
        (fixed.PREDICTION_PREFIX + s.name, f"{fixed.PREDICTED_FIELD}{s.description.lower()} ({s.data_type})")
        for s in outcomes
    ] + [
        (fixed.CONFIDENCE_FIELD, fixed.CONFIDENCE_TEXT),
        (fixed.REASONING_FIELD, fixed.REASONING_TEXT),
    ]
    return fixed.REPLY_FORMAT + "{" + ", ".join(f'"{n}": {d}' for n, d in fields) + "}"


def prompt_context(
    prompts: DataFrame,
    system: str,
    outcomes: Sequence[FeatureSpec],
    distribution: DataFrame | None = None,
    examples: DataFrame | None = None,
) -> DataFrame:
    """Full prompt per chunk; distribution and examples are each optional.

    The distribution is a one-row text and enters as a scalar subquery.
    """
    parts = [F.lit(system)]
    if distribution is not None:
        text = distribution.select("distribution").scalar()
        parts.append(F.concat(F.lit("Outcome distribution:\n"), text))
    joined = prompts
    if examples is not None:
        joined = prompts.join(examples.select("chunk_no", "examples"), "chunk_no", "left")
        parts.append(F.concat(F.lit("Similar examples:\n"), F.col("examples")))
    parts.append(F.concat(F.lit("Customer profiles:\n"), F.col("prompt")))
    parts.append(F.lit("Reply with a JSON array, one object per customer with customer_id. "
                       + reply_format(outcomes)))
    return joined.select("chunk_no", F.concat_ws("\n\n", *parts).alias("prompt"), "rows")


def prompt_sizes(prompts: DataFrame, extra_chars: Column | int = 0) -> DataFrame:
    """Characters of each prompt and a token estimate of a quarter of them."""
    extra = extra_chars if isinstance(extra_chars, Column) else F.lit(extra_chars)
    chars = (F.length("prompt") + extra).cast("bigint")
    return prompts.select(
        "chunk_no", chars.alias("chars"), F.floor(chars / 4).cast("bigint").alias("tokens")
    )


def factor_prompt(
    df: DataFrame,
    start: str,
    end: str,
    text_col: str,
    factors_intro: str | None = None,
    cases_intro: str | None = None,
) -> Column:
    """Instruction, optional ranked factors and similar cases, then the row's text.

    Factors come from ``factor_text`` with commas as line breaks, cases from
    ``case_text``; an intro of None leaves the part out.
    """
    parts = [F.lit(start + "\n")]
    if factors_intro is not None:
        parts += [F.lit(factors_intro), F.replace(F.col("factor_text"), F.lit(","), F.lit("\n")), F.lit("\n")]
    if cases_intro is not None:
        parts += [F.lit(cases_intro), F.col("case_text"), F.lit("\n")]
    return F.concat(*parts, F.lit(end + "\n"), F.col(text_col))
