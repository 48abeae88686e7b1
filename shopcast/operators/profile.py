"""Rows written as templated text, as plain column expressions."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shopcast.config import FeatureSpec, by_domain, resolve
from shopcast.functions.render import (
    bare_number_text,
    format_value,
    plain_text,
    whole_number_text,
)


def _types(df: DataFrame) -> dict[str, str]:
    return dict(df.dtypes)


def _sentence(spec: FeatureSpec, types: dict[str, str]) -> Column:
    value = format_value(F.col(spec.name), spec.data_type, types[spec.name])
    return F.concat(F.lit(f"{spec.description}: "), value)


def template_profile(
    df: DataFrame,
    specs: Sequence[FeatureSpec],
    shuffle_features: bool = False,
    shuffle_domains: bool = False,
    key_cols: Sequence[str] = ("customer_id",),
    seed: int | str = 112,
    missing: str = "error",
) -> Column:
    """``[<domain> Domain] <description>: <value>. ...`` lines, one per domain.

    Shuffling orders domains or features per row by a hash of key, seed and
    name, so a row always gets the same text.
    """
    types = _types(df)
    groups = by_domain(resolve(specs, df.columns, missing))

    def order(name: str) -> Column:
        return F.md5(F.concat_ws(":", *[F.col(k).cast("string") for k in key_cols], F.lit(str(seed)), F.lit(name)))

    def arranged(entries: list[tuple[str, Column]], shuffle: bool, separator: str) -> Column:
        if not shuffle:
            return F.concat_ws(separator, *[text for _, text in entries])
        pairs = F.array(*[F.struct(order(n).alias("o"), t.alias("t")) for n, t in entries])
        return F.array_join(F.transform(F.array_sort(pairs), lambda p: p["t"]), separator)

    domains = [
        (
            domain,
            F.concat(
                F.lit(f"[{domain} Domain] "),
                arranged([(s.name, _sentence(s, types)) for s in members], shuffle_features, ". "),
                F.lit("."),
            ),
        )
        for domain, members in groups.items()
    ]
    return arranged(domains, shuffle_domains, "\n")


def template_sentences(df: DataFrame, specs: Sequence[FeatureSpec]) -> Column:
    """``<description>: <value>.`` sentences joined by a space."""
    types = _types(df)
    return F.concat_ws(" ", *[F.concat(_sentence(s, types), F.lit(".")) for s in specs])


def raw_values(df: DataFrame, specs: Sequence[FeatureSpec], null_text: str | None = None) -> Column:
    """The values of the described columns as an array of strings."""
    types = _types(df)
    texts = [plain_text(F.col(s.name), types[s.name]) for s in specs]
    if null_text is not None:
        texts = [F.coalesce(t, F.lit(null_text)) for t in texts]
    return F.array(*texts)


def profile_dataset(
    df: DataFrame,
    specs: Sequence[FeatureSpec],
    treatments: Sequence[FeatureSpec] | None = None,
    outcomes: Sequence[FeatureSpec] | None = None,
    **options,
) -> DataFrame:
    """customer_id, profile text and, where described, treatment and outcome columns."""
    out = [F.col("customer_id"), template_profile(df, specs, **options).alias("template_profile")]
    if treatments:
        treatments = resolve(treatments, df.columns)
        out += [
            raw_values(df, treatments).alias("treatment"),
            template_sentences(df, treatments).alias("template_treatment"),
        ]
    if outcomes:
        outcomes = resolve(outcomes, df.columns)
        out += [
            raw_values(df, outcomes, null_text="None").alias("outcome"),
            template_sentences(df, outcomes).alias("template_outcome"),
        ]
    return df.select(out)


@dataclass(frozen=True)
class SentenceGroup:
    """Sentences about one topic; skipped with ``empty_text`` when ``guard`` is 0."""

    sentences: dict[str, tuple[str, str]]
    guard: str | None = None
    empty_text: str = ""


@dataclass(frozen=True)
class SentenceTemplate:
    prefix: str
    groups: Sequence[SentenceGroup] = field(default_factory=list)


def sentence_text(
    df: DataFrame,
    template: SentenceTemplate,
    value_names: dict[str, str] | None = None,
    shuffle: bool = False,
    key_cols: Sequence[str] = ("customer_id",),
    seed: int | str = 112,
) -> Column:
    """Fill a sentence template: each column has a text and a text for the value 0."""
    types = _types(df)

    def one(column: str, texts: tuple[str, str]) -> Column:
        value = whole_number_text(F.col(column), types[column], value_names)

        def fill(text: str) -> Column:
            return F.replace(F.lit(text), F.lit("[VALUE]"), value)

        if types[column] == "string":
            return fill(texts[0])
        return F.when(F.col(column) == 0, fill(texts[-1])).otherwise(fill(texts[0]))

    pieces = [F.lit(template.prefix)]
    for group in template.groups:
        if shuffle:
            pairs = [
                F.struct(
                    F.md5(F.concat_ws(":", *[F.col(k).cast("string") for k in key_cols], F.lit(str(seed)), F.lit(c))).alias("o"),
                    one(c, t).alias("t"),
                )
                for c, t in group.sentences.items()
            ]
            body = F.array_join(F.transform(F.array_sort(F.array(*pairs)), lambda p: p["t"]), "")
        else:
            body = F.concat(*[one(c, t) for c, t in group.sentences.items()])
        if group.guard:
            body = F.when(F.col(group.guard) == 0, F.lit(group.empty_text)).otherwise(body)
        pieces.append(body)
    return F.concat(*pieces)


def numeric_text(
    df: DataFrame, names: dict[str, str], label_columns: Sequence[str] = ()
) -> Column:
    """``<name> is <value>. `` for each column; label columns are left out by name."""
    types = _types(df)
    parts = [
        F.concat(F.lit(label.replace(".", "") + " is "), bare_number_text(F.col(c), types[c]))
        for c, label in names.items()
        if c in types and c not in label_columns
    ]
    return F.concat(F.concat_ws(". ", *parts), F.lit(". "))
