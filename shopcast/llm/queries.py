"""One query per corpus operator over the supplied tables, the pipeline, and their SQL."""

from __future__ import annotations

import posixpath
import uuid

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from shopcast.llm import (
    bpe_codec,
    chat,
    decontaminate,
    exact_dedup,
    langid,
    licenses,
    merkle,
    quality,
    ranked_search,
    secret_scan,
    simhash,
    token_counts,
    warc,
)
from shopcast.sources import run_folder


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", "text")


def _kinds(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def secret_scan_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _texts(spark, sf_dir)
    models = secret_scan.train_markov(secret_scan.labelled_samples(docs))
    found = secret_scan.scan_secrets(docs, models)
    return found.select(
        "doc_id",
        _kinds(F.col("base"), "assign").alias("n_assign"),
        _kinds(F.col("base"), "access").alias("n_access"),
        _kinds(F.col("base"), "hex").alias("n_hex"),
        F.sha2(secret_scan.span_list(F.col("base")), 256).alias("base_sha256"),
        secret_scan.span_list(F.col("spans")).alias("spans"),
    )


def warc_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = posixpath.join(run_folder(spark), f"warc-{uuid.uuid4().hex}")
    marked = warc.mark_revisits(_table(spark, sf_dir, "pages"))
    manifest = warc.write_monolithic(marked, posixpath.join(folder, "monolithic"))
    warc.normalise(manifest, posixpath.join(folder, "records"))
    index = warc.read_index(spark, posixpath.join(folder, "records"))
    return warc.read_records(index, with_payload=False).select(
        F.col("record_id").cast("long").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        F.col("refers_to").cast("long").alias("refers_to"),
    )


def simhash_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_texts(spark, sf_dir))


def exact_dedup_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    decided = exact_dedup.exact_duplicates(_texts(spark, sf_dir), all_digests=True)
    return decided.withColumnRenamed("digest", "text_sha256")


def langid_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    fold = quality.hash_fold(F.col("doc_id"), 4)
    held_out = F.coalesce(fold == 2, F.lit(False))
    # A row without an id has no fold: it is scored, not learned from.
    model = langid.train_languages(docs.where(fold != 2))
    return langid.identify(docs.select("doc_id", "text", held_out.alias("held_out")), model).drop("text")


def licenses_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan_licenses(_texts(spark, sf_dir))
    base = F.transform("places", lambda p: p["label"])
    method = F.transform("detections", lambda d: d["label"])
    best = F.array_max(F.transform("detections", lambda d: d["score"]))
    named = lambda labels: F.concat_ws(",", F.array_sort(F.array_distinct(labels)))
    return found.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.when(F.size("places") > 0, F.element_at("places", 1)["word"]).cast("long").alias("first_word"),
        F.when(F.size("places") > 0, F.element_at("places", -1)["word"]).cast("long").alias("last_word"),
        named(base).alias("base_labels"),
        named(F.concat(base, method)).alias("labels"),
        F.coalesce(best, F.when(F.size("places") > 0, F.lit(0.5)).otherwise(F.lit(0.0))).alias("score"),
    )


def bpe_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    return bpe_codec.round_trip(_texts(spark, sf_dir), path).select(
        "doc_id",
        (F.octet_length("token_ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("token_ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def quality_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _texts(spark, sf_dir)
    labels = _table(spark, sf_dir, "labels").where(quality.hash_fold(F.col("doc_id"), 5) != 0)
    model = quality.train_quality(docs, labels)
    scored = quality.score_quality(docs, model)
    return scored.select(
        "doc_id",
        F.coalesce(quality.hash_fold(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= corpus_pipeline.LEAST_QUALITY).cast("int").alias("predicted"),
    )


def token_counts_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _texts(spark, sf_dir)
    counted = token_counts.count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return counted.select(
        "doc_id",
        F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"),
        "n_tokens",
        (F.col("n_tokens") > 512).alias("over_limit"),
    )


def decontaminate_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    benchmark = _table(spark, sf_dir, "benchmark")
    found = decontaminate.find_contamination(_texts(spark, sf_dir), benchmark)
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def chat_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = "\\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", planted), (-7, 1, "assistant", planted)], rows.schema)
    return chat.read_conversations(chat.format_conversations(rows.unionByName(more)))


def merkle_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    changed = [*fields[:3], F.col("n_chars") + 1, fields[4]]
    tampered = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    leaves = docs.select(
        "doc_id",
        "lang",
        merkle.row_digest(fields).alias("leaf"),
        F.when(tampered, merkle.row_digest(changed)).alias("tampered"),
    )
    proofs = merkle.merkle_proofs(leaves, "lang", ["doc_id"], "leaf")
    proofs = proofs.withColumn("folded_root", merkle.folded(F.coalesce("tampered", "leaf"), F.col("path")))
    return proofs.select(
        "doc_id",
        "leaf",
        "subroot",
        "root",
        merkle.proof_digest(F.col("path")).alias("proof_sha256"),
        "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


def ranked_search_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.search(_texts(spark, sf_dir), _table(spark, sf_dir, "benchmark"))


QUERIES = {
    "op1_secret_scan": secret_scan_query,
    "op2_warc": warc_query,
    "op3_simhash": simhash_query,
    "op4_exact_dedup": exact_dedup_query,
    "op5_langid": langid_query,
    "op6_licenses": licenses_query,
    "op7_bpe": bpe_query,
    "op8_quality": quality_query,
    "op9_token_counts": token_counts_query,
    "op10_decontaminate": decontaminate_query,
    "op11_chat": chat_query,
    "op12_merkle": merkle_query,
    "op13_ranked_search": ranked_search_query,
    "pipeline": corpus_pipeline.run,
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_TERMS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"


def _value(column: str) -> str:
    text = f"CAST({column} AS VARCHAR)"
    return f"coalesce(octet_length(encode({text})) || ':' || {text}, '-')"


_LEAF = " || ".join(_value(c) for c in ("doc_id", "source", "lang", "{n}", "text"))


def _crc32_mod7(column: str) -> str:
    """Whether 7 divides the CRC-32 of the number's decimal text: bitwise, byte by byte."""
    text = f"CAST({column} AS VARCHAR)"
    step = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
    return f"""(
      xor(list_reduce([4294967295::BIGINT] || list_transform(range(1, len({text}) + 1), lambda i: ascii({text}[i])::BIGINT),
        lambda a, b: list_reduce([xor(a, b)] || range(8), lambda c, k: {step})), 4294967295) % 7 = 0)"""


SQL = {
    "op2_warc": """
        WITH p AS (
          SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes,
                 sha1(coalesce(html, '')) AS payload_digest
          FROM pages),
        g AS (
          SELECT *, CASE WHEN payload_bytes >= 1000
                    THEN max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) END AS first
          FROM p)
        SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
               CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first
                    THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
        FROM g""",
    "op4_exact_dedup": r"""
        WITH d AS (
          SELECT doc_id,
                 sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
          FROM documents)
        SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = min(doc_id) OVER w AS kept, text_sha256
        FROM d WINDOW w AS (PARTITION BY text_sha256)""",
    "op10_decontaminate": rf"""
        WITH d AS (SELECT doc_id, {_WORDS} AS words FROM documents),
        b AS (
          SELECT item_id, words, least(10, len(words)) AS k
          FROM (SELECT item_id, {_WORDS} AS words FROM benchmark) WHERE len(words) > 0),
        bw AS (
          SELECT DISTINCT item_id, k, array_to_string(words[i : i + k - 1], ' ') AS win
          FROM (SELECT item_id, k, words, unnest(range(1, len(words) - k + 2)) AS i FROM b)),
        dw AS (
          SELECT doc_id, k, i, array_to_string(words[i : i + k - 1], ' ') AS win
          FROM (SELECT doc_id, words, k, unnest(range(1, len(words) - k + 2)) AS i
                FROM d, (SELECT DISTINCT k FROM bw) WHERE len(words) >= k)),
        hits AS (SELECT doc_id, i, dw.k, item_id FROM dw JOIN bw USING (win, k)),
        covered AS (
          SELECT doc_id, count(DISTINCT w) AS n_hit
          FROM (SELECT doc_id, unnest(range(i, i + k)) AS w FROM hits) GROUP BY doc_id),
        items AS (
          SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
        SELECT d.doc_id, CAST(len(d.words) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
               coalesce(n_items, 0) AS n_items, sha256(coalesce(listed, '')) AS items_sha256,
               coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op11_chat": r"""
        WITH c AS (
          SELECT conv_id, turn, role, text FROM conversations
          UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
          UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
        t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM c),
        e AS (
          SELECT *, CASE WHEN role = 'assistant' THEN text ELSE '' END AS trained,
                 14 + length(regexp_replace(role, '(\\|:|### |</turn>)', '\\\1', 'g'))
                    + length(regexp_replace(text, '(\\|### |</turn>)', '\\\1', 'g')) AS chars
          FROM t)
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
               CAST(sum(length(trained)) AS BIGINT) AS loss_chars,
               sha256(string_agg(trained, '' ORDER BY turn NULLS FIRST, role, text)) AS loss_sha256,
               CAST(sum(chars) AS BIGINT) AS formatted_chars
        FROM e GROUP BY conv_id""",
    "op12_merkle": f"""
        WITH RECURSIVE
        leaves AS (
          SELECT doc_id, coalesce('=' || lang, '') AS g,
                 sha256({_LEAF.format(n='n_chars')}) AS leaf, sha256({_LEAF.format(n='n_chars + 1')}) AS changed
          FROM documents),
        placed AS (
          SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
                 count(*) OVER (PARTITION BY g) AS n
          FROM leaves),
        low AS (
          SELECT g, 0 AS k, pos, leaf AS h, n FROM placed
          UNION ALL
          SELECT g, k + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (any_value(n) + 1) // 2
          FROM low WHERE n > 1 GROUP BY g, k, pos // 2),
        subroots AS (
          SELECT g, h AS subroot, row_number() OVER (ORDER BY g) - 1 AS pos, count(*) OVER () AS n
          FROM low WHERE n = 1),
        high AS (
          SELECT 0 AS k, pos, subroot AS h, n FROM subroots
          UNION ALL
          SELECT k + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (any_value(n) + 1) // 2
          FROM high WHERE n > 1 GROUP BY k, pos // 2),
        own AS (
          SELECT p.*, s.subroot, s.pos AS spot, row_number() OVER () AS id FROM placed p JOIN subroots s USING (g)),
        steps AS (
          SELECT id, l.k AS k, l.pos % 2 AS side, coalesce(b.h, '') AS sib
          FROM own o JOIN low l ON l.g = o.g AND l.n > 1 AND l.pos = (o.pos >> l.k)
          LEFT JOIN low b ON b.g = l.g AND b.k = l.k AND b.pos = xor(l.pos, 1)
          UNION ALL
          SELECT id, 1000 + l.k, l.pos % 2, coalesce(b.h, '')
          FROM own o JOIN high l ON l.n > 1 AND l.pos = (o.spot >> l.k)
          LEFT JOIN high b ON b.k = l.k AND b.pos = xor(l.pos, 1)),
        ordered AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY k) AS step FROM steps),
        proofs AS (SELECT id, sha256(string_agg(sib, '' ORDER BY step)) AS proof FROM ordered GROUP BY id),
        fold AS (
          SELECT id, 0 AS step, CASE WHEN {_crc32_mod7('doc_id')} THEN changed ELSE leaf END AS h FROM own
          UNION ALL
          SELECT f.id, f.step + 1, sha256(CASE WHEN o.side = 1 THEN o.sib || f.h ELSE f.h || o.sib END)
          FROM fold f JOIN ordered o ON o.id = f.id AND o.step = f.step + 1),
        folded AS (SELECT id, arg_max(h, step) AS folded_root FROM fold GROUP BY id)
        SELECT doc_id, leaf, subroot, r.h AS root, coalesce(proof, sha256('')) AS proof_sha256, folded_root,
               folded_root = r.h AS verified
        FROM own JOIN folded USING (id) LEFT JOIN proofs USING (id), (SELECT h FROM high WHERE n = 1) r""",
    "op13_ranked_search": rf"""
        WITH d AS (SELECT doc_id, row_number() OVER () AS id, {_TERMS} AS terms FROM documents),
        b AS (SELECT item_id, row_number() OVER () AS item, list_distinct({_TERMS}) AS terms FROM benchmark),
        s AS (SELECT count(*) AS docs, sum(len(terms)) AS tokens FROM d WHERE len(terms) > 0),
        p AS (
          SELECT id, term, count(*) AS tf
          FROM (SELECT id, unnest(terms) AS term FROM d) GROUP BY id, term),
        w AS (
          SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * docs + 2) / (2.0::DOUBLE * count(*) + 1))) AS BIGINT) AS w
          FROM p, s GROUP BY term, docs),
        m AS (SELECT id, doc_id, CAST(50 + (50 * len(terms) * docs) // tokens AS BIGINT) AS m FROM d, s),
        x AS (
          SELECT item, id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score
          FROM (SELECT item, unnest(terms) AS term FROM b) JOIN p USING (term) JOIN w USING (term) JOIN m USING (id)
          GROUP BY item, id HAVING score > 0),
        r AS (
          SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST) AS rank
          FROM x JOIN m USING (id))
        SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
        FROM r JOIN b USING (item) WHERE rank <= 50""",
}
if corpus_pipeline.ORACLE_SQL is not None:
    SQL["pipeline"] = corpus_pipeline.ORACLE_SQL
