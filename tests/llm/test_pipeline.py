"""The pipeline's stages on a small table with clashing columns, nulls and planted rows."""

import random

import corpus_pipeline
from shopcast.llm.queries import QUERIES, SQL


def test_stages(spark, tmp_path):
    draw = random.Random(2)
    text = lambda n: " ".join("".join(draw.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    clean = [text(60) for _ in range(60)]
    passage = text(20)
    near = " ".join(text(200).split())
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(clean)]
    rows += [(100, clean[0].replace(" ", "  "), "en", "s", 1), (101, clean[3] + " " + passage, "en", None, None)]
    rows += [(102, near, None, "s", 1), (103, near.rsplit(" ", 1)[0], "en", "s", 1), (104, None, "en", "s", 1)]
    bad = [" ".join(w + "%%%" for w in text(40).split()) for _ in range(40)]
    rows += [(200 + i, t, "en", "s", 1) for i, t in enumerate(bad)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame(rows, schema)
    spark.createDataFrame([(r[0], int(r[0] < 200)) for r in rows if r[0] % 2], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    at = docs.selectExpr("*", "1 as score", "2 as n_hit", "3 as digest")
    seen = []
    for _, function in corpus_pipeline.STAGES[:-1]:
        after = function(spark, at, str(tmp_path))
        assert after.columns == at.columns
        at = after.cache()
        seen.append({r.doc_id for r in at.collect()})
    first = seen[0]
    assert not any(i >= 200 for i in first) and set(range(60)) <= first
    assert first - seen[1] == {100}
    assert seen[1] - seen[2] == {103}
    assert seen[2] - seen[3] == {101}
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(got) == seen[3] and got[104].n_tokens == 0
    assert all(len(r.token_ids) == 4 * r.n_tokens for r in got.values())


def test_registry():
    assert [n for n, _ in corpus_pipeline.STAGES][2] == "SimHash near-dedup"
    assert set(SQL) <= set(QUERIES) and len([n for n in QUERIES if n.startswith("op")]) == 13
