import math
import random

import pytest
from pyspark.sql import functions as F

from shopcast.config import FeatureSpec, by_domain, name_list, resolve
from shopcast.operators import clean, stats
from shopcast.operators.quantiles import order_statistics
from shopcast.operators.running import running_totals


def test_clean_transactions_drops_and_fills(spark):
    rows = [
        (17850.0, "1", "A", None, 2, 3.0),
        (None, "2", "A", "x", 1, 1.0),
        (1.0, "3", "POST", "x", 1, 1.0),
        (1.0, "4", "A", "x", 0, 1.0),
        (1.0, "5", "A", "x", 1, 0.0),
    ]
    df = spark.createDataFrame(
        rows,
        "customer_id double, invoice_no string, stock_code string, description string, quantity long, unit_price double",
    )
    got = clean.clean_transactions(df).collect()
    assert [(r.customer_id, r.description, r.sales) for r in got] == [("17850", "UNKNOWN", 6.0)]


def test_year_month(spark):
    df = spark.createDataFrame([("12/1/2010 8:26",), ("1/31/2011 23:59",), ("bad",)], "t string")
    assert [r[0] for r in df.select(clean.year_month(F.col("t"))).collect()] == ["2010-12", "2011-01", None]


@pytest.mark.parametrize("sample", [None, 100])
def test_numeric_strings_and_threshold(spark, sample):
    good = ["1.5", " 2 ", "1e3", "-.5", "nan", "1_000", "7"]
    rows = [
        (str(i), good[i % 7] if i < 70 else "abc", good[i % 7] if i < 69 else "abc", None, "1d", True, i)
        for i in range(100)
    ]
    df = spark.createDataFrame(
        rows, "customer_id string, at string, below string, empty string, suffix string, flag boolean, n int"
    )
    out = clean.convert_to_float(df, ["customer_id"], sample_size=sample)
    kinds = dict(out.dtypes)
    assert kinds["at"] == "double" and kinds["n"] == "double" and kinds["customer_id"] == "string"
    assert kinds["below"] == "string" and kinds["empty"] == "string" and kinds["suffix"] == "string"
    assert kinds["flag"] == "boolean"
    values = {r.customer_id: r["at"] for r in out.collect()}
    assert values["1"] == 2.0 and values["2"] == 1000.0 and values["5"] is None and values["99"] is None


def test_impute(spark):
    df = spark.createDataFrame(
        [(None, None, None, None), (360.0, 1, "a", True), (361.0, 2, "", False)],
        "days_since_last_x double, n int, s string, b boolean",
    )
    assert [tuple(r) for r in clean.impute(df).collect()] == [
        (360.0, 0, "", None), (360.0, 1, "a", True), (360.0, 2, "", False)
    ]


def nearest(values, q):
    ordered = sorted(v for v in values if v is not None)
    return ordered[math.floor((len(ordered) - 1) * q + 0.5)] if ordered else None


def test_winsorize(spark):
    values = [None, -5.0, 0.0] + [float(i) for i in range(1, 101)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    top = nearest([v for v in values if v and v > 0], 0.9)
    got = sorted(r.v for r in clean.winsorize(df, "v", 0.9).where("v is not null").collect())
    assert got == sorted(min(v, top) for v in values if v is not None)
    low, high = nearest(values, (1 - 0.9) / 2), nearest(values, 1 - (1 - 0.9) / 2)
    both = clean.winsorize(df, "v", 0.9, both_sides=True)
    assert sorted(r.v for r in both.where("v is not null").collect()) == sorted(
        max(low, min(v, high)) for v in values if v is not None
    )
    assert both.where("v is null").count() == 1


def test_winsorize_without_positive_values(spark):
    df = spark.createDataFrame([(-1.0,), (0.0,), (None,)], "v double")
    assert sorted(str(r.v) for r in clean.winsorize(df, "v").collect()) == ["-1.0", "0.0", "None"]
    with pytest.raises(ValueError):
        clean.winsorize(df, "absent")


def test_scaling_of_constant_and_null(spark):
    train = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, b double")
    rows = spark.createDataFrame([(5.0, 5.0), (None, 7.0)], "a double, b double")
    got = [tuple(r) for r in clean.min_max_scale(rows, ["a", "b"], train).collect()]
    assert got == [(2.0, 0.0), (None, 2.0)]
    z = [tuple(r) for r in clean.z_score(rows, ["a", "b"], train).collect()]
    assert z == [(3.0, 0.0), (-2.0, 2.0)]


@pytest.mark.parametrize("n", [1, 2, 4, 10, 1000])
def test_order_statistics(spark, n):
    rng = random.Random(n)
    values = [float(rng.randint(0, n)) for _ in range(n)] + [None] * 3
    same = [7.0] * len(values)
    df = spark.createDataFrame(list(zip(values, same)), "v double, same double")
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    got = {(r.feature, r.prob): r.value for r in order_statistics(df, ["v", "same"], probs).collect()}
    for p in probs:
        assert got["v", p] == nearest(values, p)
        assert got["same", p] == 7.0


@pytest.mark.parametrize("bracket_rows", [10**6, 200])
@pytest.mark.parametrize("interpolation", ["nearest", "linear"])
def test_order_statistics_with_brackets(spark, interpolation, bracket_rows):
    """Bracketed and narrowed: skewed values, a third of them equal."""
    import numpy as np

    rng = random.Random(5)
    values = [0.0] * 7000 + [rng.lognormvariate(0, 3) for _ in range(14000)]
    df = spark.createDataFrame([(v,) for v in values], "v double").repartition(5)
    probs = [0.0, 0.01, 0.2, 1 / 3, 0.5, 0.75, 0.99, 1.0]
    rows = order_statistics(
        df, ["v"], probs, interpolation, accuracy=200, small_column=1000, bracket_rows=bracket_rows
    ).collect()
    got = {r.prob: r.value for r in rows}
    for p in probs:
        want = nearest(values, p) if interpolation == "nearest" else float(np.quantile(values, p))
        assert got[p] == pytest.approx(want, rel=1e-12)


@pytest.mark.parametrize("rows_per_bucket,n", [(10, 400), (100, 3000), (10_000, 3000)])
def test_running_totals_equal_a_plain_sum(spark, rows_per_bucket, n):
    rng = random.Random(3)
    rows = sorted({rng.random() ** 6 for _ in range(n)})
    df = spark.createDataFrame([(v, i % 7) for i, v in enumerate(rows)], "v double, n int")
    got = {r.v: r.n_upto for r in running_totals(df, "v", ["n"], bucket_rows=rows_per_bucket).collect()}
    total = 0
    for i, v in enumerate(rows):
        total += i % 7
        assert got[v] == total
    down = {r.v: r.n_upto for r in running_totals(df, "v", ["n"], True, rows_per_bucket).collect()}
    assert down[rows[0]] == total and down[rows[-1]] == (len(rows) - 1) % 7


SPECS = [
    FeatureSpec("age", "Age", "integer", "Person"),
    FeatureSpec("vip", "Member", "binary", "Person"),
    FeatureSpec("days_since_visit", "Days since visit", "integer", "Visits"),
    FeatureSpec("city", "City", "string", "Person"),
]


def test_distribution_text(spark):
    df = spark.createDataFrame(
        [(1, 1, 10, "B"), (3, 0, 400, "A"), (None, None, 360, None), (1234, 1, 5, "A")],
        "age int, vip int, days_since_visit int, city string",
    )
    text = stats.feature_distribution_text(df, SPECS).first()[0]
    assert text == (
        "[Person Domain]\nDistribution of Age:\n- Range: 1 to 1,234\n- Percent of non-zero values: 100.00%\n"
        "- Mean: 412\n- Percentiles:\n  10th: 1\n  20th: 1\n  30th: 3\n  40th: 3\n  50th: 3\n  60th: 3\n"
        "  70th: 3\n  80th: 1,234\n  90th: 1,234\n"
        "Distribution of Member:\n- Mean: 66.67%\n"
        "Distribution of City:\n- Value counts:\n  A: 50.00%\n  B: 25.00%\n  None: 25.00%\n"
        "[Visits Domain]\nDistribution of Days since visit:\n- Range: 5 to 400\n"
        "- Percent of values under 360 days: 50.00%\n- Mean: 193\n- Percentiles:\n  10th: 5\n  20th: 10\n"
        "  30th: 10\n  40th: 10\n  50th: 360\n  60th: 360\n  70th: 360\n  80th: 360\n  90th: 400"
    )
    short = stats.feature_distribution_text(df, SPECS, exclude=["age", "days_since_visit", "city"])
    assert short.first()[0] == "[Person Domain]\nDistribution of Member:\n- Mean: 66.67%"


def test_outcome_text_excludes_by_whole_name(spark):
    df = spark.createDataFrame([(1.0, "a"), (0.0, "a")], "target double, target_text string")
    specs = [FeatureSpec("target", "Sales", "float"), FeatureSpec("target_text", "Text", "string")]
    text = stats.outcome_distribution_text(df, specs, "Context.", exclude="target_text").first()[0]
    assert text.startswith("Context.\n\nDistribution of Sales:\n- Range: 0.00 to 1.00\n") and "Text" not in text
    assert stats.outcome_distribution_text(df, specs, "C.", ["target", "target_text"]).first()[0] == "C."


def test_all_values_or_the_most_frequent_are_listed(spark):
    df = spark.createDataFrame([(f"c{i}",) for i in range(300)] + [("c7",)], "city string")
    city = [FeatureSpec("city", "City", "string", "P")]
    assert stats.feature_distribution_text(df, city).first()[0].count("\n  c") == 300
    text = stats.feature_distribution_text(df, city, top=2).first()[0]
    assert text.endswith("  c7: 0.66%\n  c0: 0.33%")


def test_value_shares_top(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "c string")
    got = {r.value: r.share for r in stats.value_shares(df, ["c"]).collect()}
    assert got == {"a": 0.5, "b": 0.25, None: 0.25}
    assert [r.value for r in stats.value_shares(df, ["c"], top=2).orderBy("cnt").collect()] == ["b", "a"]


def test_specs(tmp_path):
    from shopcast.config import feature_specs, listed_specs, read_settings

    path = tmp_path / "features.yaml"
    path.write_text(
        "customer_features:\n  a: {description: A, domain: D, data_type: float}\n"
        "  b: {description: B, domain: E, data_type: string}\n"
        "outcome_features:\n  - {feature_name: t, feature_description: T, data_type: float}\n"
    )
    settings = read_settings(str(path))
    specs = feature_specs(settings)
    assert [s.name for s in specs] == ["a", "b"] and list(by_domain(specs)) == ["D", "E"]
    assert listed_specs(settings, "outcome_features")[0].description == "T"
    with pytest.raises(ValueError):
        resolve(specs, ["a"])
    assert [s.name for s in resolve(specs, ["a"], "drop")] == ["a"]
    assert name_list("abc") == ["abc"] and name_list(None) == []
