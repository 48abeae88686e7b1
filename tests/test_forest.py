"""Nearest rows by a forest of random hyperplane trees."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from shopcast.operators import forest, similarity


def vectors(spark, n, width, seed=3, id_col="query_id"):
    points = np.random.default_rng(seed).normal(size=(n, width))
    rows = [(i, p.tolist()) for i, p in enumerate(points)]
    return spark.createDataFrame(rows, f"{id_col} long, vec array<double>").repartition(4)


@pytest.mark.parametrize("metric", ["euclidean", "cosine"])
def test_recall(spark, metric):
    q, r = vectors(spark, 150, 6), vectors(spark, 2_000, 6, 4, "ref_id")
    exact = similarity.nearest(q, r, "query_id", "ref_id", 5, metric)
    found = forest.nearest_in_forest(q, r, "query_id", "ref_id", 5, metric, trees=10, leaf_rows=200)
    assert found.columns == exact.columns
    assert found.count() == 750
    assert similarity.recall(found, exact, "query_id", "ref_id").first().recall >= 0.9
    both = found.join(exact, ["query_id", "ref_id"], "inner").select(
        F.max(F.abs(found["distance"] - exact["distance"]))
    )
    assert both.first()[0] < 1e-9


def test_more_trees_more_recall(spark):
    q, r = vectors(spark, 100, 8), vectors(spark, 3_000, 8, 4, "ref_id")
    exact = similarity.nearest(q, r, "query_id", "ref_id", 5)
    recall = [
        similarity.recall(
            forest.nearest_in_forest(q, r, "query_id", "ref_id", 5, trees=t, leaf_rows=100), exact, "query_id", "ref_id"
        ).first().recall
        for t in (1, 8)
    ]
    assert recall[0] < recall[1] and recall[1] >= 0.7


@pytest.mark.parametrize("n", [90, 9_000])
def test_leaves_do_not_grow_with_the_table(spark, n):
    rows = vectors(spark, n, 4).select("query_id", F.expr("transform(vec, x -> round(x, 1))").alias("vec"))
    sizes = forest.leaf_sizes(rows, "query_id", trees=3, leaf_rows=50).collect()
    assert max(s.rows for s in sizes) <= 2.1 * 50
    different = rows.select("vec").distinct().count()
    assert all(sum(s.rows for s in sizes if s.tree == t) == different for t in range(3))


def test_copies_and_few_rows(spark):
    rows = [(i, [1.0, 2.0]) for i in range(300)] + [(1000 + i, [float(i), 0.5 * i]) for i in range(40)]
    df = spark.createDataFrame(rows, "query_id long, vec array<double>")
    found = forest.nearest_in_forest(df, None, "query_id", "ref_id", 3, exclude_self=True, leaf_rows=4)
    got = {}
    for r in found.collect():
        got.setdefault(r.query_id, []).append((r.rank, r.ref_id, r.distance))
    assert len(got) == 340 and all(len(v) == 3 for v in got.values())
    assert sorted(got[250]) == [(1, 0, 0.0), (2, 1, 0.0), (3, 2, 0.0)]
    assert sorted(got[0]) == [(1, 1, 0.0), (2, 2, 0.0), (3, 3, 0.0)]
    few = forest.nearest_in_forest(df.limit(2), None, "query_id", "ref_id", 9)
    assert few.count() == 4
    none = forest.nearest_in_forest(df, df.withColumnRenamed("query_id", "ref_id").limit(0), "query_id", "ref_id", 2)
    assert none.count() == 0 and forest.leaf_sizes(df.limit(0), "query_id").count() == 0


def test_carried_columns(spark):
    q = vectors(spark, 20, 3)
    r = vectors(spark, 50, 3, 4, "ref_id").withColumn("name", F.concat(F.lit("n"), "ref_id"))
    found = forest.nearest_in_forest(q, r, "query_id", "ref_id", 2, carry=["name"], leaf_rows=10).collect()
    assert len(found) == 40 and all(x.name == f"n{x.ref_id}" for x in found)


def test_levels_by_summaries_and_in_tasks(spark, monkeypatch):
    """Large nodes are cut by summaries, smaller ones in tasks; a query row's best of a tree are one row."""
    monkeypatch.setattr(forest, "NODE_ROWS", 400)
    monkeypatch.setattr(forest, "SUMMARY_ROWS", 700)
    rows = vectors(spark, 5_000, 4)
    sizes = forest.leaf_sizes(rows, "query_id", trees=3, leaf_rows=50).collect()
    assert max(s.rows for s in sizes) <= 2.1 * 50 and sum(s.rows for s in sizes) == 15_000
    exact = similarity.nearest(rows, None, "query_id", "ref_id", 3)
    found = forest.nearest_in_forest(rows, None, "query_id", "ref_id", 3, leaf_rows=50)
    assert found.count() == 15_000
    assert similarity.recall(found, exact, "query_id", "ref_id").first().recall >= 0.9
