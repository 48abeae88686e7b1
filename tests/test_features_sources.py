import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from shopcast import sources
from shopcast.operators import baseline, features

F_PERIOD, O_PERIOD = ("2011-01", "2011-09"), ("2011-10", "2011-12")
CATEGORIES = ["Home Decor", "Toys and Games"]


@pytest.fixture
def tx(spark):
    rows = [
        ("1", "A1", 1, "2011-01-05 10:00:00", "s1", "mug", "Home Decor", 10.0),
        ("1", "A1", 2, "2011-01-05 10:00:00", "s2", "ball", "Toys and Games", 30.0),
        ("1", "A2", 1, "2011-01-05 18:00:00", "s1", "mug", "Home Decor", 20.0),
        ("1", "A3", 1, "2011-10-02 09:00:00", "s3", "lamp", None, 7.0),
        ("2", "B1", 1, "2011-09-30 09:59:59", "s4", "box", None, 5.0),
        ("3", "C1", 1, "2011-11-01 00:00:00", "s1", "mug", "Home Decor", 9.0),
    ]
    df = spark.createDataFrame(
        rows,
        "customer_id string, invoice_no string, line_no int, at string, stock_code string, description string, category string, sales double",
    )
    stamp = F.to_timestamp("at")
    return df.select("*", stamp.alias("invoice_date"), F.date_format(stamp, "yyyy-MM").alias("yearmon")).drop("at")


def test_rfm(tx):
    rows = features.rfm_features(tx.where(F.col("yearmon") <= F_PERIOD[1]))
    got = {r.customer_id: r for r in features.with_rates(rows).collect()}
    # 268 days minus one second and some hours from the first purchase: whole days only.
    assert got["1"].customer_lifetime == 267 and got["1"].recency == 267 and got["2"].recency == 0
    assert (got["1"].purchase_day, got["1"].nb_invoice, got["1"].nb_product, got["1"].nb_category) == (2, 2, 2, 2)
    assert got["2"].nb_category == 0 and got["1"].avg_purchase_value == 30.0
    by_day = features.rfm_features(tx.where(F.col("yearmon") <= F_PERIOD[1]), "day").where("customer_id = '1'").first()
    assert by_day.purchase_day == 1 and by_day.first_purchase_date == dt.datetime(2011, 1, 5, 10)


def test_lists_in_first_seen_order(tx):
    got = {r.customer_id: r for r in features.outcome_table(tx, F_PERIOD, O_PERIOD).collect()}
    assert set(got) == {"1", "2"}
    assert got["1"].bought_descriptions == "mug|ball" and got["1"].target_descriptions == "lamp"
    assert got["1"].target_categories == "" and got["2"].bought_categories == ""
    assert (got["1"].target_sales, got["2"].target_sales) == (7.0, 0.0)


def test_dataset_equals_its_parts(tx):
    whole = features.customer_dataset(tx, F_PERIOD, O_PERIOD, CATEGORIES)
    feature_tx = tx.where(F.col("yearmon") <= F_PERIOD[1])
    parts = (
        features.outcome_table(tx, F_PERIOD, O_PERIOD)
        .join(features.with_rates(features.rfm_features(feature_tx)), "customer_id")
        .join(features.category_pivot(feature_tx, CATEGORIES), "customer_id")
    )
    assert sorted(whole.collect()) == sorted(parts.select(whole.columns).collect())
    assert whole.where("customer_id = '1'").first().per_toys_and_games == 0.5


@pytest.mark.parametrize("texts", [(), ("bought_categories",), ("target_categories", "bought_descriptions")])
def test_dataset_gathers_only_named_lists(tx, texts):
    whole = features.customer_dataset(tx, F_PERIOD, O_PERIOD, CATEGORIES)
    some = features.customer_dataset(tx, F_PERIOD, O_PERIOD, CATEGORIES, texts)
    assert some.columns == [c for c in whole.columns if c not in features.TEXTS or c in texts]
    assert sorted(some.collect()) == sorted(whole.select(some.columns).collect())
    read = some._jdf.queryExecution().optimizedPlan().toString()
    assert "bought_descriptions" in texts or "description" not in read


def test_lines_without_a_time_count_in_sums(tx):
    lost = tx.withColumn("invoice_date", F.when(F.col("line_no") > 0, F.col("invoice_date")))
    whole, part = (features.customer_dataset(t, F_PERIOD, O_PERIOD, CATEGORIES, ()) for t in (tx, lost))
    sums = ["customer_id", "total_sales", "target_sales", "nb_product", "nb_category"]
    assert sorted(whole.select(sums).collect()) == sorted(part.select(sums).collect())


def test_category_join_keeps_unknown_products(spark, tx):
    dim = spark.createDataFrame([("s1", "Home Decor")], "stock_code string, category string")
    got = features.with_category(tx.drop("category"), dim)
    assert got.count() == tx.count() and got.where("category is null").count() == 3


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("1", ["a", "b"], 'x,"y"\nz')], "id string, items array<string>, text string")
    sources.write_table(df, str(tmp_path / "t.parquet"))
    assert sources.read_table(spark, str(tmp_path / "t.parquet")).collect() == df.collect()
    sources.write_table(df.drop("text"), str(tmp_path / "t.csv"))
    back = sources.read_csv(spark, str(tmp_path / "t.csv"), "id string, items string").first()
    assert (back.id, back.items) == ("1", '["a","b"]')
    with pytest.raises(ValueError):
        sources.write_table(df, str(tmp_path / "t.txt"))
    sources.write_json_lines(spark.createDataFrame([(1, None)], "a int, b string"), str(tmp_path / "t.json"))
    assert [r.value for r in spark.read.text(str(tmp_path / "t.json")).collect()] == ['{"a":1,"b":null}']


def test_transaction_csv(spark, tmp_path):
    path = tmp_path / "retail.csv"
    path.write_text(
        "InvoiceNo,StockCode,Description,Quantity,InvoiceDate,UnitPrice,CustomerID,Country\n"
        '536365,85123A,"WHITE, HEART",6,12/1/2010 8:26,2.55,17850,UK\n536366,22633,,1,12/1/2010 8:28,1.85,,UK\n'
    )
    rows = sources.read_csv(spark, str(path), sources.TRANSACTION_SCHEMA).collect()
    assert rows[0].Description == "WHITE, HEART" and rows[0].CustomerID == 17850.0
    assert rows[1].Description is None and rows[1].CustomerID is None


@pytest.mark.parametrize("done,left", [(None, 3), ([], 3), ([1], 2), ([1, 2, 3], 0)])
def test_pending_rows(spark, done, left):
    df = spark.createDataFrame([(1,), (2,), (3,)], "id int")
    stored = None if done is None else spark.createDataFrame([(i,) for i in done], "id int")
    assert sources.pending_rows(df, stored, ["id"]).count() == left


def test_stage_uses_the_named_folder(spark):
    df = sources.stage(spark.range(5), "five")
    folder = sources.staging_folder(spark)
    assert df.count() == 5 and all(folder.rstrip("/") in f for f in df.inputFiles())


def test_staged_tables_can_be_dropped(spark):
    sources.stage(spark.range(5), "five")
    assert sources.table_exists(spark, sources.run_folder(spark))
    sources.drop_staged(spark)
    assert not sources.table_exists(spark, sources.run_folder(spark))


def test_exports(spark):
    df = spark.createDataFrame([("t", 1, "a."), ("u", 0, "b.")], "text string, label int, response string")
    cls = sources.classification_export(df, "I", "text", "label").collect()
    assert [tuple(r) for r in cls] == [("I", "t", "accept."), ("I", "u", "refuse.")]
    rec = sources.preference_export(df, "S", "text", "response", "label").collect()
    assert [tuple(r) for r in rec] == [("S", "t", "a.", True), ("S", "u", "b.", False)]


def _slow_baseline(x, y, borders, rounds, rate, depth, shrink):
    """Boosted symmetric trees row by row: predictions of all rows."""
    out = [sum(y) / len(y)] * len(y)
    for _ in range(rounds):
        rest, leaf = [a - b for a, b in zip(y, out)], [0] * len(y)

        def score(leaves):
            total = 0.0
            for g in set(leaves):
                held = [r for r, l in zip(rest, leaves) if l == g]
                total += sum(held) ** 2 / (len(held) + shrink)
            return total

        for level in range(depth):
            best = max(
                ((score([2 * g + (row[f] > c) for g, row in zip(leaf, x)]), -f, -i) for f in range(len(borders))
                 for i, c in enumerate(borders[f])), default=(0, 0, 0),
            )
            if best[0] - score(leaf) <= 1e-9:
                break
            f, c = -best[1], borders[-best[1]][-best[2]]
            leaf = [2 * g + (row[f] > c) for g, row in zip(leaf, x)]
        for g in set(leaf):
            at = [i for i, l in enumerate(leaf) if l == g]
            for i in at:
                out[i] += rate * sum(rest[j] for j in at) / (len(at) + shrink)
    return out


def test_sums_of_joint_features_are_those_of_each():
    """Groups of features counted as one give the same rows and residuals, whichever side is added up."""
    rng, sizes = np.random.default_rng(3), [128, 6, 128, 1, 40]
    n = baseline.STEP_ROWS + 1_000
    binned = np.stack([rng.integers(0, size, n).astype(np.uint8) for size in sizes])
    leaf, rest = rng.integers(-1, 2, n).astype(np.int8), rng.integers(-9, 9, n).astype(float)
    joint = baseline._Joint(binned, sizes)
    assert sorted(f for group in joint.groups for f in group) == list(range(len(sizes)))
    assert max(joint.cells) <= baseline.JOINT_CELLS and len(joint.groups) < len(sizes)
    alone = baseline._sums(binned, leaf, rest, 2, 128)
    assert (baseline._sums(binned, leaf, rest, 2, 128, joint) == alone).all()
    assert (baseline._sums(binned, leaf, rest, 2, 128, joint, alone[0]) == alone).all()
    inside, over = np.maximum(leaf, 0), binned[0] > 10
    whole = baseline._sums(binned, inside, rest, 2, 128)
    right = baseline._sums(binned, np.where(over, inside, -1), rest, 2, 128)
    assert (baseline._one_side(binned, inside, over, rest, 2, 128, joint, whole) == right).all()


@pytest.mark.parametrize("task_rows", [500_000, 40])
def test_baseline_against_a_slow_one(spark, monkeypatch, task_rows):
    monkeypatch.setattr(baseline, "SEGMENT", 3)
    draw = random.Random(8)
    x = [(float(draw.randrange(9)), draw.choice([0.0, 1.5]), draw.uniform(-2, 2)) for _ in range(120)]
    y = [3 * a + (2 if b else -1) * c + draw.gauss(0, 0.1) for a, b, c in x]
    df = spark.createDataFrame([(*a, b) for a, b in zip(x, y)], "a double, b double, c double, y double").repartition(3)
    model = baseline.fit_baseline(df, ["a", "b", "c"], "y", iterations=7, depth=3, bins=16, task_rows=task_rows)
    assert model.splits.shape == (7, 3, 2)
    want = _slow_baseline(x, y, model.borders, 7, 0.1, 3, 3.0)
    scored = baseline.baseline_predictions(model, df, "p").collect()
    want = dict(zip(x, want))
    assert all(abs(r.p - want[r.a, r.b, r.c]) < 1e-6 for r in scored) and len(scored) == 120
    errors = {r["round"]: r for r in baseline.round_errors(model, df, "y").collect()}
    assert sorted(errors) == list(range(8)) and errors[0].rows == 120
    assert errors[7].squared == pytest.approx(sum((r.p - r.y) ** 2 for r in scored))
    assert errors[0].squared == pytest.approx(sum((r.y - model.start) ** 2 for r in scored))
    assert len(baseline.cut_to_best(model, df, "y").splits) == 7
    assert len(baseline.cut_to_best(model, df.withColumn("y", F.lit(model.start)), "y").splits) == 0
    top = baseline.importances(model, df).collect()
    assert top[0].feature == "a" and abs(sum(r.importance for r in top) - 1) < 1e-9


def test_many_rows_are_fitted_without_a_barrier(spark, monkeypatch):
    """Sums of several tasks give the trees of one task; a barrier takes up to a second a level."""
    waits, real = [], type(spark.range(1)).mapInArrow

    def seen(self, func, schema, barrier=False, **more):
        waits.append(barrier)
        return real(self, func, schema, barrier, **more)

    monkeypatch.setattr(type(spark.range(1)), "mapInArrow", seen)
    monkeypatch.setattr(baseline, "CACHED_ROUNDS", 2)
    draw = random.Random(3)
    rows = [(float(draw.randrange(6)), draw.uniform(0, 1), draw.choice([None, 2.0]), draw.gauss(0, 1)) for _ in range(300)]
    df = spark.createDataFrame([(*r[:3], r[0] * r[1] + r[3]) for r in rows], "a double, b double, c double, y double")
    fit = lambda n: baseline.fit_baseline(df.repartition(3), ["a", "b", "c"], "y", 5, depth=4, bins=8, task_rows=n)
    one, several = fit(1_000), fit(5)
    assert not any(waits)
    assert (one.splits == several.splits).all()
    assert abs(one.leaves - several.leaves).max() < 1e-9
    # A target that no split improves: trees without levels.
    flat = baseline.fit_baseline(df.withColumn("y", F.lit(2.0)), ["a", "b"], "y", 3, depth=2, task_rows=50)
    assert (flat.splits == -1).all() and not flat.leaves.any()


def test_baseline_of_odd_rows(spark):
    nan = float("nan")
    rows = [(None, 1.0, 5.0), (nan, 2.0, None), (1.0, None, nan), (0.0, 1.0, 5.0), (4.0, 1.0, 9.0)]
    df = spark.createDataFrame(rows, "x0 double, row double, y double")
    model = baseline.fit_baseline(df, ["x0", "row"], "y", iterations=50)
    scored = {str(r.x0): r.p for r in baseline.baseline_predictions(model, df, "p").collect()}
    assert scored["None"] == scored["nan"] == scored["0.0"] < scored["1.0"] <= scored["4.0"]
    nothing = baseline.fit_baseline(df.limit(0), ["x0", "row"], "y")
    assert [r.p for r in baseline.baseline_predictions(nothing, df, "p").collect()] == [None] * 5
    with pytest.raises(ValueError, match="already"):
        baseline.baseline_predictions(model, df, "Y")
