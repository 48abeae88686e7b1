import hashlib

import pytest
from pyspark.sql import functions as F

from shopcast.operators import sampling


def digest(key, seed):
    return hashlib.md5(f"{key}:{seed}".encode()).hexdigest()


def frame(spark, sizes, parts=3):
    rows, n = [], 0
    for stratum, size in sizes.items():
        for _ in range(size):
            rows.append((n, stratum))
            n += 1
    return rows, spark.createDataFrame(rows, "id long, s string").repartition(parts)


SIZES = {"big": 4000, "one": 1, None: 30, "half": 5, "tiny": 2}


def test_split_is_disjoint_complete_and_exact(spark):
    rows, df = frame(spark, SIZES)
    got = {r.id: r.split for r in sampling.train_valid_test(df, ["id"], strata=["s"]).collect()}
    assert len(got) == len(rows)
    for stratum, size in SIZES.items():
        ids = sorted((i for i, s in rows if s == stratum), key=lambda i: digest(i, 112))
        train = round(size * 0.6)
        valid = round((size - train) * 0.5)
        want = ["train"] * train + ["valid"] * valid + ["test"] * (size - train - valid)
        assert [got[i] for i in ids] == want


@pytest.mark.parametrize("parts", [1, 8])
def test_same_sample_for_any_partitioning(spark, parts):
    rows, df = frame(spark, SIZES, parts)
    got = {r.id for r in sampling.stratified_sample(df, 100, ["s"], ["id"]).collect()}
    total, want = len(rows), set()
    for stratum, size in SIZES.items():
        ids = sorted((i for i, s in rows if s == stratum), key=lambda i: digest(i, 112))
        want |= set(ids[: round(size / total * 100)])
    assert got == want


def test_sample_rows(spark):
    rows, df = frame(spark, {"a": 500})
    got = {r.id for r in sampling.sample_rows(df, 7, ["id"]).collect()}
    assert got == set(sorted((i for i, _ in rows), key=lambda i: digest(i, 42))[:7])
    assert sampling.sample_rows(df, 10_000, ["id"]).count() == 500
    assert sampling.sample_rows(df, 0, ["id"]).count() == 0


def test_hold_out_is_disjoint(spark):
    _, df = frame(spark, {"a": 50})
    roles = sampling.hold_out(df, 20, ["id"]).groupBy("role").count().collect()
    assert {r.role: r["count"] for r in roles} == {"infer": 20, "reference": 30}


def test_two_way_split_of_tiny_strata(spark):
    _, df = frame(spark, {"a": 10, "b": 1})
    parts = sampling.two_way_split(df, 0.3, ["s"], ["id"])
    assert parts.where("s = 'b' and part = 'second'").count() == 1
    assert parts.where("s = 'a' and part = 'first'").count() == 3
    assert sampling.two_way_split(df, 0.3, ["s"], ["id"], drop_tiny_strata=True).where("s = 'b'").count() == 0


def test_resample(spark):
    rows = [(i, 1 if i < 10 else 0 if i < 100 else (None if i < 105 else 2), "x" if i % 3 else "y") for i in range(110)]
    df = spark.createDataFrame(rows, "id long, y int, s string")
    got = sampling.resample_by_outcome(df, "y", ["id"], 2.5)
    counts = {r.y: r["count"] for r in got.groupBy("y").count().collect()}
    assert counts == {1: 10, 0: 25}
    everything = sampling.resample_by_outcome(df, "y", ["id"], 50.0, strata=["s"])
    assert {r.y: r["count"] for r in everything.groupBy("y").count().collect()} == {1: 10, 0: 90}
    by_stratum = sampling.resample_by_outcome(df, "y", ["id"], 3.0, strata=["s"])
    got = {r.s: r["count"] for r in by_stratum.where("y = 0").groupBy("s").count().collect()}
    assert got == {"x": 20, "y": 10}
    with pytest.raises(ValueError):
        sampling.resample_by_outcome(df, "none", ["id"])


def test_split_arguments(spark):
    _, df = frame(spark, {"a": 3})
    with pytest.raises(ValueError):
        sampling.train_valid_test(df, ["id"], 0.5, 0.2, 0.2, ["s"])
    with pytest.raises(ValueError):
        sampling.train_valid_test(df, ["id"], 1.0, 0.0, 0.0, ["s"])
    with pytest.raises(ValueError):
        sampling.train_valid_test(df, ["id"], strata=["none"])


def test_split_check_reports_missing_strata(spark):
    df = spark.createDataFrame([(1, "a", "train"), (2, "b", "train"), (3, "a", "test")], "id int, s string, split string")
    got = {(r.split, r.s): (round(r.split_share, 3), r.deviates) for r in sampling.split_check(df, ["s"]).collect()}
    assert got["test", "b"] == (0.0, True) and got["test", "a"] == (1.0, True)
    assert got["train", "a"] == (0.5, True)


def test_fraction_sample(spark):
    _, df = frame(spark, {"a": 2000})
    n = sampling.sample_fraction(df, 0.25, ["id"]).count()
    assert 400 < n < 600
    assert sampling.sample_fraction(df, 1.0, ["id"]).count() == 2000


def test_one_stratum_with_a_third_of_all_rows(spark):
    """The cut of a very large stratum never ranks more than one hash bucket of it."""
    df = spark.range(60_000).select(
        F.col("id"), F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("s")
    )
    counts = sampling.two_way_split(df, 0.25, ["s"], ["id"]).groupBy((F.col("s") == "hot").alias("hot"), "part").count()
    got = {(r.hot, r.part): r["count"] for r in counts.collect()}
    assert got == {(True, "first"): 5000, (True, "second"): 15000, (False, "second"): 40000}


@pytest.mark.parametrize("bound", [10, 100_000])
def test_cuts_do_not_depend_on_the_buckets(spark, monkeypatch, bound):
    from shopcast.functions import hashing
    from shopcast.functions.hashing import bucket_digits

    monkeypatch.setattr(hashing, "BUCKET_ROWS", bound)
    assert bucket_digits(700) == (2 if bound == 10 else 1) and bucket_digits(10**12, 10) == 10
    df = spark.range(700).select(F.col("id").cast("string").alias("k"), (F.col("id") % 3 == 0).alias("s"))
    order = {str(i): hashlib.md5(f"{i}:7".encode()).hexdigest() for i in range(700)}
    parts = sampling.train_valid_test(df, ["k"], strata=["s"], seed=7).collect()
    for s in (True, False):
        keys = sorted((r.k for r in parts if r.s == s), key=order.get)
        train, rest = round(len(keys) * 0.6), len(keys) - round(len(keys) * 0.6)
        want = ["train"] * train + ["valid"] * round(rest * 0.5) + ["test"] * (rest - round(rest * 0.5))
        assert [next(r.split for r in parts if r.k == k) for k in keys] == want
