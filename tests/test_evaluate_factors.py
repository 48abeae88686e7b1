import math
import random

import pytest

from shopcast.operators import evaluate, factors


def scored(spark, rows):
    return spark.createDataFrame(rows, "y int, p double")


def auc_by_pairs(rows):
    pos, neg = [p for y, p in rows if y == 1], [p for y, p in rows if y == 0]
    won = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg)
    return won / (len(pos) * len(neg))


def pr_by_hand(rows):
    total, points = sum(y for y, _ in rows), [(0.0, 1.0)]
    for cut in sorted({p for _, p in rows}, reverse=True):
        chosen = [y for y, p in rows if p >= cut]
        points.append((sum(chosen) / total, sum(chosen) / len(chosen)))
    return sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(points, points[1:]))


@pytest.mark.parametrize("levels", [1, 7, 100000])
def test_auc(spark, levels):
    rng = random.Random(levels)
    rows = [(rng.randint(0, 1), rng.randint(0, levels - 1) / levels) for _ in range(400)]
    got = evaluate.ranking_metrics(scored(spark, rows), "y", "p").first()
    assert got.roc_auc == pytest.approx(auc_by_pairs(rows))
    assert got.pr_auc == pytest.approx(pr_by_hand(rows))


def test_single_class(spark):
    df = scored(spark, [(0, 0.5), (0, 0.1)])
    got = evaluate.binary_metrics(df, "y", "p").first()
    assert (got.accuracy, got.precision, got.recall, got.f1_score) == (0.5, 0.0, 0.0, 0.0)
    auc = evaluate.ranking_metrics(df, "y", "p").first()
    assert auc.roc_auc is None and auc.pr_auc is None


def test_binary_metrics_at_the_threshold(spark):
    got = evaluate.binary_metrics(scored(spark, [(1, 0.5), (0, 0.5), (1, 0.4), (0, 0.0)]), "y", "p").first()
    assert (got.accuracy, got.precision, got.recall, got.f1_score) == (0.5, 0.5, 0.5, 0.5)
    assert got.brier_score_loss == pytest.approx((0.25 + 0.25 + 0.36) / 4)


def test_classification_report(spark):
    df = spark.createDataFrame([(1, 1), (1, 0), (0, 0), (0, 2)], "y int, p int")
    got = {r["class"]: r for r in evaluate.classification_report(df, "y", "p").collect()}
    assert (got["1"].precision, got["1"].recall, got["1"].support) == (1.0, 0.5, 2)
    assert (got["2"].precision, got["2"].recall, got["2"].support) == (0.0, 0.0, 0)
    assert got["accuracy"].f1_score == 0.5 and got["accuracy"].support == 4
    assert got["macro avg"].precision == pytest.approx(0.5)
    assert got["weighted avg"].recall == pytest.approx(0.5)


def test_calibration_bins(spark):
    rows = [(1, 0.0), (0, 0.1), (1, 0.1000001), (1, 1.0), (0, 0.25), (1, None)]
    got = evaluate.calibration_table(scored(spark, rows), "y", "p", 10).orderBy("bin").collect()
    assert [(r.bin, r.cnt, r.share_positive) for r in got] == [(0, 2, 0.5), (1, 1, 1.0), (2, 1, 0.0), (9, 1, 1.0)]
    edges = [i * (1.0 / 100) for i in range(1, 100)]
    values = [i / 100 for i in range(101)] + [e for e in edges]
    table = evaluate.calibration_table(scored(spark, [(1, v) for v in values]), "y", "p", 100).collect()
    want = {}
    for v in values:
        b = sum(e < v for e in edges)
        want[b] = want.get(b, 0) + 1
    assert {r.bin: r.cnt for r in table} == want
    with pytest.raises(ValueError):
        evaluate.calibration_table(scored(spark, rows), "y", "p", 10, "none")


def test_quantile_calibration_with_ties(spark):
    rows = [(i % 2, 0.5) for i in range(10)] + [(1, 0.9), (0, 0.1)]
    got = evaluate.calibration_table(scored(spark, rows), "y", "p", 4, "quantile").orderBy("bin").collect()
    assert [(r.bin, r.cnt) for r in got] == [(0, 11), (3, 1)]


def test_histogram(spark):
    df = spark.createDataFrame([(0.0, 3.0), (5.0, 3.0), (10.0, 3.0), (None, 3.0)], "a double, b double")
    got = {(r.series, r.bin): r.cnt for r in evaluate.histograms(df, ["a", "b"], 4).collect()}
    assert got == {("a", 0): 1, ("a", 2): 1, ("a", 3): 1, ("b", 2): 4}


def test_confusion_and_errors(spark):
    got = {(r.actual, r.predicted): (r.cnt, r.share) for r in
           evaluate.confusion_matrix(scored(spark, [(1, 0.9), (1, 0.1), (0, 0.1)]), "y", "p").collect()}
    assert got == {(1, 1): (1, 0.5), (1, 0): (1, 0.5), (0, 0): (1, 1.0)}
    df = spark.createDataFrame([(1.0, 2.0, 1.0), (3.0, 0.0, 3.0)], "y double, a double, b double")
    errors = {r.model: (r.mse, r.mae) for r in evaluate.regression_errors(df, "y", ["a", "b"]).collect()}
    assert errors == {"a": (5.0, 2.0), "b": (0.0, 0.0)}


def test_recommendation_report(spark):
    df = spark.createDataFrame(
        [(["a", "b"], ["b", "a"], 1), (["a", "b"], ["a", "c"], 1), (["a"], [], 0), (["c"], ["c", "c"], 1)],
        "answer array<string>, pred array<string>, click int",
    )
    got = evaluate.recommendation_report(df, "answer", "pred", "click").first()
    assert (got.exact_match, got.expected_ctr, got.true_ctr) == (0.5, 2.5 / 4, 0.75)


def local(spark, n=200, seed=2):
    """Two queries' neighbourhoods: y follows ``a``; ``b`` copies ``a`` with noise; ``c`` is constant."""
    rng = random.Random(seed)
    rows = []
    for q in (1, 2):
        for i in range(n):
            a = rng.random()
            rows.append((q, i, i + 1, a, min(1.0, max(0.0, a + rng.gauss(0, 0.3))), 0.5, rng.random(), int(a > 0.5)))
    return spark.createDataFrame(rows, "query_id int, ref_id int, rank int, a double, b double, c double, d double, y int")


FEATURES = ["a", "b", "c", "d"]


def test_correlation_ranking(spark):
    import numpy as np

    df = local(spark)
    got = factors.correlation_ranking(df, "query_id", FEATURES, "y").where("query_id = 1").orderBy("rank").collect()
    assert [r.feature for r in got][:2] == ["a", "b"] and got[-1].feature == "c" and got[-1].score == 0.0
    rows = df.where("query_id = 1").toPandas()
    assert got[0].score == pytest.approx(abs(np.corrcoef(rows.a, rows.y)[0, 1]), abs=1e-9)
    top = factors.correlation_ranking(df, "query_id", FEATURES, "y", max_features=1)
    assert top.count() == 2


def test_mutual_information(spark):
    df = local(spark)
    got = {r.feature: r.score for r in factors.mutual_information_ranking(df, "query_id", FEATURES, "y").where("query_id = 1").collect()}
    rows = df.where("query_id = 1").collect()
    joint, n = {}, len(rows)
    for r in rows:
        key = (min(int(r.a * 10), 9), r.y)
        joint[key] = joint.get(key, 0) + 1
    px, py = {}, {}
    for (x, y), c in joint.items():
        px[x], py[y] = px.get(x, 0) + c, py.get(y, 0) + c
    want = sum(c / n * math.log(c * n / (px[x] * py[y])) for (x, y), c in joint.items())
    assert got["a"] == pytest.approx(want, abs=1e-8) and got["c"] == 0.0
    assert got["a"] > got["b"] > got["d"]


def test_dependence_screen(spark):
    got = {r.feature: r for r in factors.dependence_screen(local(spark), "query_id", FEATURES, "y").where("query_id = 1").collect()}
    assert got["a"].passed and not got["c"].passed and not got["d"].passed
    assert got["c"].weakest_z == 0.0


def test_factor_order_and_text(spark):
    df = local(spark)
    ranking = factors.mutual_information_ranking(df, "query_id", FEATURES, "y")
    screen = spark.createDataFrame([(1, "d", True), (1, "a", False), (2, "b", True)], "query_id int, feature string, passed boolean")
    order = factors.factor_order(ranking, screen, "query_id", top_k=3)
    text = {r.query_id: r.factor_text for r in factors.factor_text(order, "query_id", {"a": "Age"}).collect()}
    assert text[1].startswith("d > Age > b") and text[2].startswith("b > Age")


def test_cases(spark):
    near = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (1, 12, 3)], "query_id int, ref_id int, rank int")
    order = spark.createDataFrame([(1, "b", 1), (1, "a", 2)], "query_id int, feature string, place int")
    ref = spark.createDataFrame(
        [(10, 1, 2.5, 0, 3, "accept"), (11, 2, 4.0, 7, 0, "refuse"), (12, 0, 0.0, 0, 0, "x")],
        "ref_id int, a int, b double, item1 int, item2 int, answer string",
    )
    text = factors.case_text(near, order, ref, "query_id", "ref_id", ["a", "b"], "answer", n=2).first().case_text
    assert text == "Customer Profile: b is 2.5, a is 1.Answer: accept.\nCustomer Profile: b is 4.0, a is 2.Answer: refuse."
    rec = factors.case_text(near, order, ref, "query_id", "ref_id", ["a", "b"], "answer", 2, ["item1", "item2"], "rec", True)
    assert rec.first().case_text == (
        "Customer Profile: b is 2, a is 1, item2 is 3.Preferred Categories: accept.\n"
        "Customer Profile: b is 4, a is 2, item1 is 7.Preferred Categories: refuse."
    )


def test_similar_texts(spark):
    near = spark.createDataFrame([(1, i, i) for i in range(1, 8)], "query_id int, ref_id int, rank int")
    ref = spark.createDataFrame([(i, f"t{i}", i % 2) for i in range(1, 8)], "ref_id int, text string, label int")
    lines = factors.similar_texts(near, ref, "query_id", "ref_id", "text", "label").first().similar_text.split("\n")
    assert lines[0] == "t1. Answer: accept. Confidence: 85."
    assert [x.rsplit(" ", 1)[1] for x in lines] == ["85.", "80.", "75.", "70.", "65.", "80.", "80."]
