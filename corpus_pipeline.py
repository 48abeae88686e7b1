"""From raw documents to token ids: five stages, each one corpus operator.

Every stage takes (spark, docs, sf_dir) and works on all rows that the stage
before it kept.  All but the last return rows of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shopcast.llm import bpe_codec, decontaminate, exact_dedup, quality, simhash
from shopcast.llm.common import fresh
from shopcast.sources import stage

#: Documents with a lower score are rejected.
LEAST_QUALITY = 0.3
TOKENIZER = "word_bpe_49k.json"

#: The stages need models and fingerprints that SQL does not express.
ORACLE_SQL = None


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject; it is fitted on labelled ones of other folds."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    model = quality.train_quality(docs, labels.where(quality.hash_fold(F.col("doc_id"), 5) != 0))
    (score,) = fresh(docs, "score")
    scored = quality.score_quality(docs, model, score_col=score)
    return scored.where(F.col(score) >= LEAST_QUALITY).drop(score)


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts the one with the smallest id."""
    return exact_dedup.drop_duplicates(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by their fingerprints the one with the smallest id."""
    return simhash.drop_near_duplicates(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a word inside a benchmark window."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    names = fresh(docs, "n_words", "n_hit", "items", "hit_spans")
    found = decontaminate.find_contamination(docs, benchmark, names=tuple(names))
    return found.where(F.col(names[1]) == 0).drop(*names)


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, packed as little-endian 32-bit numbers, and digests of both ways."""
    path = public_tokenizers.path(TOKENIZER)
    texts = docs.select("doc_id", "lang", "source", "text")
    return bpe_codec.round_trip(texts, path).select(
        "doc_id",
        "lang",
        "source",
        (F.octet_length("token_ids") / 4).cast("long").alias("n_tokens"),
        "token_ids",
        F.sha2("token_ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("quality classifier", quality_classifier),
    ("exact dedup", exact_duplicates),
    ("SimHash near-dedup", near_duplicates),
    ("benchmark decontamination", benchmark_decontamination),
    ("BPE encoding and decoding", bpe_encoding),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order; each result is written to the shared folder and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
