import hashlib
import json

import pytest
from pyspark.sql import functions as F

from shopcast.config import FeatureSpec, ModelSettings
from shopcast.operators import inference, prompts, reconcile
from shopcast.operators.profile import (
    SentenceGroup,
    SentenceTemplate,
    numeric_text,
    profile_dataset,
    sentence_text,
    template_profile,
)

OUTCOMES = [FeatureSpec("sales", "Sales", "float"), FeatureSpec("n", "Items", "int"), FeatureSpec("item", "Best item", "string")]
FIELDS = reconcile.prediction_fields(OUTCOMES)


def rows(spark, ids, chunk=0):
    return spark.createDataFrame(
        [(chunk, i, f"template {i}") for i in ids], "chunk_no long, customer_id string, template_profile string"
    )


def reply(spark, text, chunk=0):
    return spark.createDataFrame([(chunk, text)], "chunk_no long, reply string")


@pytest.mark.parametrize(
    "text,want",
    [
        ('x [{"customer_id": "1", "narrative_profile": "a"}] y', {"1": "a", "2": "template 2"}),
        ('[{"customer_id": 2, "narrative_profile": "b [1,200]"}]', {"1": "template 1", "2": "b [1,200]"}),
        ('[{"customer_id": "1", "narrative_profile": ""}]', {"1": "template 1", "2": "template 2"}),
        ('[{"customer_id": "9", "narrative_profile": "a"}]', {"1": "template 1", "2": "template 2"}),
        ('[{"customer_id": "1", "narrative_profile": "a"},', {"1": "template 1", "2": "template 2"}),
        ("no array", {"1": "template 1", "2": "template 2"}),
        ('{"customer_id": "1", "narrative_profile": "a"}', {"1": "template 1", "2": "template 2"}),
        (None, {"1": "template 1", "2": "template 2"}),
        (
            '[{"customer_id": "1", "narrative_profile": "a"}, {"customer_id": "1", "narrative_profile": "z"}]',
            {"1": "a", "2": "template 2"},
        ),
    ],
)
def test_narratives_never_lose_or_double_a_row(spark, text, want):
    got = reconcile.narrative_profiles(rows(spark, ["1", "2"]), reply(spark, text)).collect()
    assert len(got) == 2 and {r.customer_id: r.narrative_profile for r in got} == want
    assert all(r.is_fallback == (r.narrative_profile == f"template {r.customer_id}") for r in got)


def test_duplicates_can_be_kept(spark):
    text = '[{"customer_id": "1", "narrative_profile": "a"}, {"customer_id": "1", "narrative_profile": "z"}]'
    got = reconcile.narrative_profiles(rows(spark, ["1"]), reply(spark, text), True, "all").collect()
    assert sorted(r.narrative_profile for r in got) == ["a\ntemplate 1", "z\ntemplate 1"]
    with pytest.raises(ValueError):
        reconcile.match_replies(rows(spark, ["1"]), reply(spark, ""), [], "last")


def test_replies_match_only_their_own_chunk(spark):
    both = rows(spark, ["1"], 0).unionByName(rows(spark, ["2"], 1))
    text = '[{"customer_id": "1", "narrative_profile": "a"}, {"customer_id": "2", "narrative_profile": "b"}]'
    got = reconcile.narrative_profiles(both, reply(spark, text, 1)).collect()
    assert {r.customer_id: r.narrative_profile for r in got} == {"1": "template 1", "2": "b"}


def predict(spark, *entries):
    text = "[" + ", ".join(entries) + "]"
    ids = [str(i) for i in range(len(entries))]
    got = reconcile.predictions(rows(spark, ids), reply(spark, text), OUTCOMES).collect()
    return {r.customer_id: tuple(r[f] for f in FIELDS) for r in got}


def test_validation_defaults(spark):
    got = predict(
        spark,
        '{"customer_id": "0", "pred_sales": "2.5", "pred_n": 3.9, "pred_item": "mug", "pred_confidence": 1.7, "pred_reasoning": "r"}',
        '{"customer_id": "1", "pred_sales": "high", "pred_n": "x", "pred_confidence": -1}',
        '{"customer_id": "2", "pred_sales": null, "pred_n": "4", "pred_item": 5, "pred_confidence": "high"}',
        '{"customer_id": "x"}',
    )
    assert got["0"] == (2.5, 3, "mug", 1.0, "r")
    assert got["1"] == (0.0, 0, "", 0.0, "No reasoning provided")
    assert got["2"] == (0.0, 4, "5", 0.5, "No reasoning provided")
    assert got["3"] == (0.0, 0, "", 0.0, "Fallback prediction due to processing error")


def test_number_commas_are_repaired_only_after_a_failure(spark):
    broken = predict(spark, '{"customer_id": "0", "pred_sales": 12,005}')
    assert broken["0"][0] == 12005.0
    whole = predict(spark, '{"customer_id": "0", "pred_sales": 1, "pred_item": "1,200 mugs"}')
    assert whole["0"][2] == "1,200 mugs"


def test_fallback_report(spark):
    text = '[{"customer_id": "1", "a": "x"}, {"customer_id": "9", "a": "x"}]'
    got = reconcile.fallback_report(rows(spark, ["1", "2"]), reply(spark, text), ["customer_id", "a"]).first()
    assert (got.expected, got.received, got.fallbacks) == (2, 2, 1)


def test_category_lines(spark):
    lines = reconcile.category_lines(reply(spark, '"red mug"|"Kitchen"\nno category\n"lamp"|"Home"\n'))
    assert [(r.line_no, r.description, r.category) for r in lines.orderBy("line_no").collect()] == [
        (0, "red mug", "Kitchen"), (2, "lamp", "Home")
    ]
    products = spark.createDataFrame([(0, "lamp"), (0, "box")], "chunk_no long, description string")
    got = {r.description: r.category for r in reconcile.assign_categories(products, lines).collect()}
    assert got == {"lamp": "Home", "box": "Others"}


@pytest.mark.parametrize("parts", [1, 8])
def test_chunks_follow_windows(spark, parts):
    df = spark.range(53).select(F.col("id").cast("string").alias("customer_id")).repartition(parts)
    got = prompts.assign_chunks(df, ModelSettings(batch_size=20, max_workers=3)).collect()
    sizes = {}
    for r in got:
        sizes.setdefault(r.window_no, {}).setdefault(r.chunk_no, []).append(r.position)
    assert {w: [len(p) for _, p in sorted(c.items())] for w, c in sizes.items()} == {
        0: [6, 6, 6, 2], 1: [6, 6, 6, 2], 2: [6, 6, 1]
    }
    assert all(sorted(p) == list(range(1, len(p) + 1)) for c in sizes.values() for p in c.values())


def test_prompts(spark):
    df = spark.createDataFrame([(0, 2, "b", None), (0, 1, "a", "A")], "chunk_no long, position int, customer_id string, template_profile string")
    text = prompts.prediction_prompts(df, "template_profile").first()
    assert text.prompt == "Customer a:\nProfile: A\nTreatment: N/A\n\nCustomer b:\nProfile: N/A\nTreatment: N/A"
    assert text.rows == 2
    sizes = prompts.prompt_sizes(prompts.prediction_prompts(df, "template_profile"), 3).first()
    assert sizes.chars == len(text.prompt) + 3 and sizes.tokens == sizes.chars // 4


def test_prompt_context_layouts(spark):
    df = spark.createDataFrame([(0, "P", 1)], "chunk_no long, prompt string, rows int")
    dist = spark.createDataFrame([("D",)], "distribution string")
    ex = spark.createDataFrame([(0, "E", 1)], "chunk_no long, examples string, rows int")
    texts = [
        prompts.prompt_context(df, "S", OUTCOMES, d, e).first().prompt
        for d, e in ((None, None), (dist, None), (None, ex), (dist, ex))
    ]
    assert ["D" in t.split("Customer profiles")[0] for t in texts] == [False, True, False, True]
    assert ["Similar examples:\nE" in t for t in texts] == [False, False, True, True]
    assert all('"pred_n": Predicted items (int)' in t for t in texts)


def model_factory():
    """A local function, so that it travels to the workers by value."""

    def make():
        seen = {}

        def answer(prompt):
            seen[prompt] = seen.get(prompt, 0) + 1
            if prompt == "never" or (prompt == "second" and seen[prompt] < 2):
                raise RuntimeError("busy")
            return prompt.upper()

        return answer

    return make


def test_model_calls_keep_every_row(spark):
    df = spark.createDataFrame([(1, "first"), (2, "second"), (3, "never")], "k int, prompt string")
    got = {r.k: r for r in inference.staged_replies(df, model_factory(), ModelSettings(retries=2)).collect()}
    assert (got[1].reply, got[1].tries) == ("FIRST", 1)
    assert (got[2].reply, got[2].tries) == ("SECOND", 2)
    assert (got[3].reply, got[3].tries, got[3].error) == (None, 3, "RuntimeError: busy")


def test_resumed_calls(spark, tmp_path):
    path = str(tmp_path / "replies.parquet")
    one = spark.createDataFrame([(1, "a"), (2, "never")], "k int, prompt string")
    two = spark.createDataFrame([(1, "changed"), (2, "ok"), (3, "c")], "k int, prompt string")
    settings = ModelSettings(retries=0)
    first = {r.k: r.reply for r in inference.resumed_replies(one, model_factory(), settings, path, "k").collect()}
    assert first == {1: "A", 2: None}
    second = {r.k: r.reply for r in inference.resumed_replies(two, model_factory(), settings, path, "k").collect()}
    assert second == {1: "A", 2: "OK", 3: "C"}


SPECS = [
    FeatureSpec("days", "Days as customer", "integer", "Membership"),
    FeatureSpec("rate", "Share", "percent", "Habits"),
    FeatureSpec("city", "City", "string", "Membership"),
]


def test_template_profile(spark):
    df = spark.createDataFrame([("7", 1470, 0.052, None)], "customer_id string, days int, rate double, city string")
    assert df.select(template_profile(df, SPECS).alias("t")).first().t == (
        "[Membership Domain] Days as customer: 1,470. City: N/A.\n[Habits Domain] Share: 5.2%."
    )
    shuffled = template_profile(df, SPECS, True, True)
    first, again = (df.repartition(n).select(shuffled.alias("t")).first().t for n in (1, 3))
    assert first == again and sorted(first.replace("\n", " ").split()) != []
    with pytest.raises(ValueError):
        template_profile(df.drop("city"), SPECS)
    short = df.drop("city")
    assert "City" not in short.select(template_profile(short, SPECS, missing="drop").alias("t")).first().t


def test_profile_dataset_lists(spark):
    df = spark.createDataFrame([("7", 1, 0.5, "x", 345.26, None)], "customer_id string, days int, rate double, city string, sales double, item string")
    row = profile_dataset(df, SPECS, [SPECS[2]], [OUTCOMES[0], OUTCOMES[2]]).first()
    assert row.treatment == ["x"] and row.template_treatment == "City: x."
    assert row.outcome == ["345.26", "None"]
    assert row.template_outcome == "Sales: 345.26. Best item: N/A."


def test_sentences_and_numbers(spark):
    df = spark.createDataFrame([("1", 0, 5, 0.5), ("2", 3, 0, 1234.5)], "customer_id string, visits int, orders int, spent double")
    template = SentenceTemplate(
        "Who ",
        [SentenceGroup({"orders": ("ordered [VALUE], ", "did not order, "), "spent": ("spent [VALUE], ",) * 2},
                       guard="visits", empty_text="did not visit, ")],
    )
    got = [r.t for r in df.orderBy("customer_id").select(sentence_text(df, template).alias("t")).collect()]
    assert got == ["Who did not visit, ", "Who did not order, spent 1,234, "]
    names = {"visits": "No. of visits", "spent": "Spent", "orders": "Orders"}
    text = df.orderBy("customer_id").select(numeric_text(df, names, ["orders"]).alias("t")).collect()
    assert [r.t for r in text] == ["No of visits is 0. Spent is 0.50. ", "No of visits is 3. Spent is 1234.50. "]


def test_factor_prompt(spark):
    df = spark.createDataFrame([("a,b.", "cases", "body")], "factor_text string, case_text string, t string")
    full = df.select(prompts.factor_prompt(df, "S", "E", "t", "F:\n", "C:\n").alias("p")).first().p
    assert full == "S\nF:\na\nb.\nC:\ncases\nE\nbody"
    assert df.select(prompts.factor_prompt(df, "S", "E", "t").alias("p")).first().p == "S\nE\nbody"


def test_json_is_never_evaluated(spark):
    text = json.dumps([{"customer_id": "1", "narrative_profile": "__import__('os')"}])
    got = reconcile.narrative_profiles(rows(spark, ["1"]), reply(spark, text)).first()
    assert got.narrative_profile == "__import__('os')"


@pytest.mark.parametrize("bound", [10, 200_000])
def test_chunks_follow_the_hash_order(spark, monkeypatch, bound):
    from shopcast.operators import running

    monkeypatch.setattr(running, "BUCKET_ROWS", bound)
    keys = [str(i) for i in range(95)] + ["7", "7"]
    df = spark.createDataFrame([(k, f"text {i}") for i, k in enumerate(keys)], "customer_id string, t string").repartition(4)
    got = prompts.assign_chunks(df, ModelSettings(batch_size=20, max_workers=4)).collect()
    order = sorted(keys, key=lambda k: hashlib.md5(f"{k}:112".encode()).hexdigest())
    placed = sorted((r.chunk_no, r.position, r.customer_id) for r in got)
    assert [k for _, _, k in placed] == order and len({r.t for r in got}) == 97
    assert [(c, p) for c, p, _ in placed] == [(i // 5, i % 5 + 1) for i in range(97)]
    assert all(r.window_no == r.chunk_no // 4 for r in got)
