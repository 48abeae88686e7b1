"""Input columns that have the names of outputs stay as they are; outputs give way."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from shopcast.llm import (
    bpe_codec, decontaminate, exact_dedup, langid, licenses, merkle, quality, secret_scan, simhash, token_counts,
)

WORD_BPE, BYTE_BPE = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json"))
TAKEN = (
    "Base", "spans", "lang_pred", "score", "rejected", "n_words", "places", "detections", "token_ids", "decoded",
    "n_tokens", "prefix_tokens", "truncated", "n_hit", "items", "hit_spans", "subroot", "root", "path", "digest", "met",
    "of", "repeated", "fingerprint", "component_id", "_scan_text", "_scan_low", "_scan_found", "found", "h", "at", "share",
)


def _models(spark):
    docs = spark.createDataFrame([(i, f"some words {i}", "en", i % 2) for i in range(20)], "doc_id int, text string, lang string, quality int")
    return {
        "lang": langid.train_languages(docs),
        "quality": quality.train_quality(docs, docs),
        "secret": secret_scan.train_markov(secret_scan.labelled_samples(docs)),
    }


ADDING = {
    "scan_secrets": (lambda d, m: secret_scan.scan_secrets(d, m["secret"]), ["base_", "spans_"]),
    "identify": (lambda d, m: langid.identify(d, m["lang"]), ["lang_pred_", "score_", "rejected_"]),
    "scan_licenses": (lambda d, m: licenses.scan_licenses(d), ["n_words_", "places_", "detections_"]),
    "encode": (lambda d, m: bpe_codec.encode(d, WORD_BPE), ["token_ids_"]),
    "round_trip": (lambda d, m: bpe_codec.round_trip(d, WORD_BPE), ["token_ids_", "decoded_"]),
    "score_quality": (lambda d, m: quality.score_quality(d, m["quality"]), ["score_"]),
    "count_tokens": (lambda d, m: token_counts.count_tokens(d, BYTE_BPE), ["n_tokens_"]),
    "prefix_token_counts": (lambda d, m: token_counts.prefix_token_counts(d, BYTE_BPE), ["prefix_tokens_"]),
    "truncate_to_budget": (lambda d, m: token_counts.truncate_to_budget(d, BYTE_BPE, 2), ["truncated_"]),
    "find_contamination": (
        lambda d, m: decontaminate.find_contamination(d, d.select(F.col("doc_id").alias("item_id"), "text")),
        ["n_words_", "n_hit_", "items_", "hit_spans_"],
    ),
    "merkle_proofs": (lambda d, m: merkle.merkle_proofs(d, "text", ["doc_id"], "score"), ["subroot_", "root_", "path_"]),
    "drop_duplicates": (lambda d, m: exact_dedup.drop_duplicates(d), []),
    "drop_near_duplicates": (lambda d, m: simhash.drop_near_duplicates(d), []),
}


@pytest.fixture(scope="module")
def models(spark):
    return _models(spark)


@pytest.fixture(scope="module")
def taken(spark):
    rows = [(1, "token = abcdefgh12 mit license"), (2, None), (3, "one two three four")]
    return spark.createDataFrame(rows, "doc_id long, text string").select("*", *(F.lit(n).alias(n) for n in TAKEN))


@pytest.mark.parametrize("name", list(ADDING))
def test_taken_names(taken, models, name):
    run, added = ADDING[name]
    out = run(taken, models)
    assert out.columns[: len(taken.columns)] == taken.columns
    assert out.columns[len(taken.columns) :] == added
    rows = out.collect()
    assert len(rows) == 3 and all(r[n] == n for r in rows for n in TAKEN)


@pytest.mark.parametrize("name", list(ADDING))
def test_no_rows(taken, models, name):
    assert ADDING[name][0](taken.limit(0), models).count() == 0
