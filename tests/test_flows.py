import json
import re

import pytest
from pyspark.sql import functions as F

from shopcast import sources
from shopcast.config import FeatureSpec, ModelSettings, model_settings
from shopcast.operators import inference, reconcile
from shopcast.plans import flows

SPECS = [FeatureSpec("visits", "Visits", "integer", "Habits"), FeatureSpec("spent", "Spent", "float", "Money")]
TREATMENT = [FeatureSpec("promotion", "Offer", "string")]
OUTCOMES = [FeatureSpec("later", "Later sales", "float")]
SETTINGS = ModelSettings(batch_size=4, max_workers=2, retries=0)


def frame(spark, start, n):
    rows = [(str(i), i % 9, float(i), "None", i * 2.0) for i in range(start, start + n)]
    return spark.createDataFrame(rows, "customer_id string, visits int, spent double, promotion string, later double")


def narrator():
    def make():
        def answer(prompt):
            ids = re.findall(r"^Customer (\S+): ", prompt, re.MULTILINE)
            assert "Feature distribution:\n[Habits Domain]\n" in prompt
            return json.dumps([{"customer_id": i, "narrative_profile": f"about {i}"} for i in ids if i != "3"])

        return answer

    return make


def predictor():
    def make():
        def answer(prompt):
            ids = re.findall(r"^Customer (\d+):$", prompt, re.MULTILINE)
            for i in ids:
                assert f"Similar Examples for Customer {i}:\n\nExample 1 (similarity: " in prompt
            assert "Distribution of Later sales" in prompt
            return json.dumps([{"customer_id": i, "pred_later": i, "pred_confidence": 0.5} for i in ids])

        return answer

    return make


def test_narratives_and_predictions(spark, tmp_path):
    infer, reference = frame(spark, 0, 11), frame(spark, 100, 40)
    kept = str(tmp_path / "replies.parquet")
    told = flows.write_narratives(infer, SPECS, narrator(), SETTINGS, "S", TREATMENT, OUTCOMES, replies_path=kept)
    rows = {r.customer_id: r for r in told.collect()}
    assert len(rows) == 11 and rows["1"].narrative_profile == "about 1"
    assert rows["3"].is_fallback and rows["3"].narrative_profile == rows["3"].template_profile
    assert spark.read.parquet(kept).count() == 6  # windows of 4 rows in chunks of 2
    limited = flows.write_narratives(infer, SPECS, narrator(), SETTINGS, "S", row_limit=5)
    assert limited.count() == 5

    base = flows.write_narratives(reference, SPECS, narrator(), SETTINGS, "S", TREATMENT, OUTCOMES)
    out = flows.predict_outcomes(
        sources.stage(told, "told"), infer, OUTCOMES, predictor(), SETTINGS, "S", "Context.",
        reference_profiles=base, reference_df=reference, similarity_features=["visits", "spent"], top_k=3,
    )
    got = {r.customer_id: (r.pred_later, r.pred_confidence, r.is_fallback) for r in out.collect()}
    assert got == {str(i): (float(i), 0.5, False) for i in range(11)}
    with pytest.raises(ValueError):
        flows.predict_outcomes(told, infer, OUTCOMES, predictor(), SETTINGS, "S", None, None, base, reference)


def test_rounds_store_each_part(spark, tmp_path):
    from shopcast.operators.inference import resumed_replies

    df = spark.range(20).select(F.col("id").alias("k"), F.col("id").cast("string").alias("prompt"))

    def make():
        return lambda prompt: prompt + "!"

    path = str(tmp_path / "r.parquet")
    got = {r.k: r.reply for r in resumed_replies(df, make, SETTINGS, path, "k", rounds=3).collect()}
    assert got == {i: f"{i}!" for i in range(20)}
    assert spark.read.parquet(path).count() == 20


def test_pacing_and_settings(spark):
    import time

    from shopcast.operators.inference import staged_replies

    settings = model_settings(
        {"batch_processing": {"profile_batch_size": 20, "profile_max_workers": 2, "profile_seconds_per_batch": 0.3}},
        "profile",
    )
    assert (settings.chunk_size, ModelSettings(chunk_rows=3).chunk_size) == (10, 3)
    df = spark.createDataFrame([(i, "p") for i in range(4)], "k int, prompt string")

    def make():
        return lambda prompt: prompt

    start = time.time()
    staged_replies(df, make, settings, workers=1)
    assert time.time() - start > 4 * 0.3


def test_dataset_from_raw_lines(spark, tmp_path):
    path = tmp_path / "lines.csv"
    path.write_text(
        "InvoiceNo,StockCode,Description,Quantity,InvoiceDate,UnitPrice,CustomerID,Country\n"
        "1,A,mug,2,1/5/2011 10:00,5.0,17850,UK\n1,POST,postage,1,1/5/2011 10:00,9.0,17850,UK\n"
        "2,B,,1,10/2/2011 09:00,7.0,17850,UK\n3,A,mug,-1,1/6/2011 10:00,5.0,17850,UK\n4,A,mug,1,1/6/2011 10:00,5.0,,UK\n"
    )
    raw = sources.read_csv(spark, str(path), sources.TRANSACTION_SCHEMA)
    dim = spark.createDataFrame([("A", "mug", "Kitchen and Dining")], "StockCode string, Description string, category string")
    row = flows.build_dataset(raw, dim, ["Kitchen and Dining"], ("2011-01", "2011-09"), ("2011-10", "2011-12")).first()
    assert (row.customer_id, row.total_sales, row.target_sales, row.target_descriptions) == ("17850", 10.0, 7.0, "UNKNOWN")
    assert row.per_kitchen_and_dining == 1.0 and row.recency == 0


def test_ranked_factors(spark):
    import random

    rng = random.Random(4)

    def rows(start, n):
        out = []
        for i in range(start, start + n):
            a, b = rng.random(), rng.random()
            y = int(a > 0.5)
            out.append((str(i), a, b, y, "accept" if y else "refuse"))
        return spark.createDataFrame(out, "customer_id string, a double, b double, y int, answer string")

    got = flows.ranked_factors(rows(0, 5), rows(10, 200), ["a", "b"], "y", "answer", {"a": "Age"}, 100, 80, examples=2).collect()
    assert len(got) == 5
    assert all(r.factor_text in ("Age > b.", "b > Age.") for r in got)
    assert sum(r.factor_text == "Age > b." for r in got) >= 4
    assert all(r.case_text.count("Customer Profile: ") == 2 for r in got)


def test_predictions_under_treatments(spark):
    def make():
        def answer(prompt):
            keys = dict.fromkeys(re.findall(r"\b(\d+\|[abc])\b", prompt))
            rows = [
                {"customer_id": k, "pred_later": "abc".index(k[-1]) + 1, "pred_confidence": 0.5, "pred_reasoning": "r"}
                for k in keys
            ]
            return json.dumps(rows)

        return answer

    rows = [(str(i), t, f"profile {i}", f"profile {i}", t) for i in range(8) for t in "abc"]
    profiles = spark.createDataFrame(
        rows, "customer_id string, promotion string, template_profile string, narrative_profile string, template_treatment string"
    )
    out = flows.predict_outcomes(
        profiles, profiles, OUTCOMES, make, SETTINGS, "S", treatment_col="promotion"
    ).collect()
    assert len(out) == 24 and not any(r.is_fallback for r in out)
    assert all(r.pred_later == "abc".index(r.promotion) + 1 for r in out)
    assert {r.customer_id for r in out} == {str(i) for i in range(8)}
    told = spark.createDataFrame(out).withColumn("is_fallback", F.expr("customer_id = '3' AND promotion = 'c'"))
    effects = reconcile.treatment_effects(told, "promotion", "b", OUTCOMES).collect()
    assert {(r.promotion, r.effect_later) for r in effects if r.customer_id == "3"} == {("a", -1), ("b", 0), ("c", None)}
    with pytest.raises(ValueError, match="share"):
        flows.predict_outcomes(profiles, profiles, OUTCOMES, make, SETTINGS, "S")


def test_resume_after_rows_were_added(spark, tmp_path):
    path = str(tmp_path / "replies.parquet")

    def make():
        def answer(prompt):
            ids = dict.fromkeys(re.findall(r"^Customer (\d+):", prompt, re.MULTILINE))
            return json.dumps([{"customer_id": i, "pred_later": i, "pred_confidence": 0.5} for i in ids])

        return answer

    def told(n):
        rows = [(str(i), f"profile {i}", f"profile {i}", "t") for i in range(n)]
        return spark.createDataFrame(
            rows, "customer_id string, template_profile string, narrative_profile string, template_treatment string"
        )

    for n in (12, 20):
        out = flows.predict_outcomes(
            told(n), told(n), OUTCOMES, make, SETTINGS, "S", replies_path=path, rounds=2
        ).collect()
        assert len(out) == n and not any(r.is_fallback for r in out)


def _dies_once(folder, at):
    """A factory that notes every call, and whose process dies the first time it meets one prompt."""

    def make():
        import os

        def answer(prompt):
            with open(f"{folder}/calls-{os.getpid()}", "a") as f:
                f.write(prompt + "\n")
            if prompt == at and not os.path.exists(f"{folder}/died"):
                open(f"{folder}/died", "w").close()
                os._exit(1)
            return prompt + "!"

        return answer

    return make


def test_a_killed_task_loses_one_commit_at_most(spark, tmp_path):
    from shopcast.operators.inference import resumed_replies

    calls, path = tmp_path / "calls", str(tmp_path / "r.parquet")
    calls.mkdir()
    df = spark.range(60).select(F.col("id").alias("k"), F.col("id").cast("string").alias("prompt")).repartition(3)
    send = lambda: resumed_replies(df, _dies_once(str(calls), "41"), SETTINGS, path, "k", workers=2, commit_prompts=4)
    with pytest.raises(Exception):
        send()
    kept = spark.read.parquet(path).count()
    made = [line for f in calls.glob("calls-*") for line in f.read_text().split()]
    assert kept >= len(made) - 2 * 4 and kept < 60
    got = {r.k: r.reply for r in send().collect()}
    assert got == {i: f"{i}!" for i in range(60)}
    again = [line for f in calls.glob("calls-*") for line in f.read_text().split()]
    assert len(again) <= 60 + 2 * 4


@pytest.mark.parametrize("folder", ["r.parquet", "a b%/r é.parquet"])
def test_commits_are_files_of_one_job(spark, tmp_path, monkeypatch, folder):
    """A job per few prompts takes as many jobs as there are prompts; null replies and odd paths are kept."""
    from shopcast.operators import inference

    def make():
        def answer(prompt):
            if prompt == "7":
                raise RuntimeError("no")
            return prompt + "!"

        return answer

    monkeypatch.setattr(inference, "append_results", lambda df, p: (df.write.mode("append").parquet(p), calls.append(p)))
    calls, path = [], str(tmp_path / folder)
    df = spark.range(50).select(F.col("id").alias("k"), F.col("id").cast("string").alias("prompt"))
    send = lambda rows: inference.resumed_replies(rows, make, ModelSettings(retries=0), path, "k", workers=2, commit_prompts=4)
    got = {r.k: (r.reply, r.error) for r in send(df.where("k < 40")).collect()}
    assert got == {i: (f"{i}!", None) if i != 7 else (None, "RuntimeError: no") for i in range(40)}
    assert len(calls) == 1
    assert {r.k for r in send(df).where("reply is null").collect()} == {7}
    # 40, and 10 with the one that failed.
    assert spark.read.parquet(path).count() == 51
    most = max(r[1] for r in spark.read.parquet(path).groupBy(F.input_file_name()).count().collect())
    assert most == 4


def test_a_later_attempt_goes_on_after_its_files(spark, tmp_path, monkeypatch):
    import pandas as pd
    import pyarrow as pa

    from shopcast.operators import inference

    class Attempt:
        number = 0
        partitionId = lambda self: 3
        taskAttemptId = lambda self: 10 + self.number

    attempt, made = Attempt(), []
    monkeypatch.setattr(inference.TaskContext, "get", lambda: attempt)

    def answer(batches):
        for batch in batches:
            made.extend(batch["k"])
            yield batch.drop(columns="prompt").assign(reply=["x"] * len(batch), error=None, tries=1)

    kind = pa.schema([("k", pa.int64()), ("reply", pa.string()), ("error", pa.string()), ("tries", pa.int32())])
    run = inference._store_partition(answer, kind, f"file:{tmp_path}", "k", 3)
    rows = pd.DataFrame({"k": range(10), "prompt": ["p"] * 10})
    first = run(iter([rows]))
    next(first), next(first)
    attempt.number = 1
    assert sum(f["stored"].sum() for f in run(iter([rows]))) == 4
    assert made == [*range(6), 6, 7, 8, 9]
    assert sorted(r.k for r in spark.read.parquet(str(tmp_path)).collect()) == list(range(10))


def test_adaptive_texts_are_resumed(spark, tmp_path):
    df = spark.range(9).select(F.col("id").alias("customer_id"), F.format_string("row %d", "id").alias("prompt"))
    path = str(tmp_path / "r.parquet")
    mark = lambda m: lambda: lambda prompt: f"Customer Profile:\n{m} {prompt}"
    flows.adaptive_texts(df.where("customer_id < 4"), mark("a"), SETTINGS, path)
    got = {r.customer_id: r.adaptive_template for r in flows.adaptive_texts(df, mark("b"), SETTINGS, path).collect()}
    assert got == {i: f"{'a' if i < 4 else 'b'} row {i}" for i in range(9)}
    assert flows.adaptive_texts(df, mark("c"), SETTINGS).where("adaptive_template like 'c%'").count() == 9


def test_ranked_factors_leave_out_what_is_done(spark):
    rows = [(str(i), float(i % 7), float(i % 5), i % 2, "yes" if i % 2 else "no") for i in range(60)]
    df = spark.createDataFrame(rows, "customer_id string, a double, b double, y int, answer string")
    test, train = df.where("customer_id < '2'"), df.where("customer_id >= '2'")
    run = lambda **k: flows.ranked_factors(test, train, ["a", "b"], "y", "answer", neighbours=20, screen_neighbours=10, **k)
    whole = {r.customer_id: tuple(r) for r in run().collect()}
    done = spark.createDataFrame(
        [("1", "kept.", "case"), ("10", None, "case"), ("59", "not asked for", "x")],
        "customer_id string, factor_text string, case_text string",
    )
    got = {r.customer_id: tuple(r) for r in run(done=done).collect()}
    assert got == whole | {"1": ("1", "kept.", "case")}


def test_a_worker_holds_few_prompts(spark, tmp_path, monkeypatch):
    """Long prompts come a few at a time; before, one worker got 10,000 of them at once."""
    import pandas as pd

    sizes = tmp_path / "sizes"
    sizes.mkdir()

    def watched(answer, schema, folder, key, commit_prompts):
        def run(batches):
            for place, batch in enumerate(batches):
                (sizes / f"{place}-{len(batch)}").touch()
                yield pd.DataFrame({"stored": [len(batch)]})

        return run

    monkeypatch.setattr(inference, "_store_partition", watched)
    setting = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    prompts = spark.range(1_000).selectExpr("id AS chunk_no", "repeat('x', 100) AS prompt")
    inference.resumed_replies(prompts, lambda: str, ModelSettings(), str(tmp_path / "replies"), "chunk_no", workers=1)
    held = [int(f.name.split("-")[1]) for f in sizes.iterdir()]
    assert sum(held) == 1_000 and max(held) <= 200
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == setting
