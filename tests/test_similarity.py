import math
import random
import time
from functools import partial

import numpy as np
import pytest
from pyspark.sql import functions as F

from shopcast import sources
from shopcast.operators import similarity


def brute(queries, refs, k, metric, exclude_self=False):
    """All distances by hand, ties by id."""

    def unit(v):
        n = max(math.sqrt(sum(x * x for x in v)), 1e-10)
        return [x / n for x in v]

    def value(a, b):
        if metric == "euclidean":
            return math.dist(a, b)
        if metric == "manhattan":
            return sum(abs(x - y) for x, y in zip(a, b))
        if metric == "hamming":
            return float(sum((x > 0.5) != (y > 0.5) for x, y in zip(a, b)))
        if metric == "dot":
            return -sum(x * y for x, y in zip(a, b))
        return -sum(x * y for x, y in zip(unit(a), unit(b)))

    out = {}
    for qid, q in queries:
        found = sorted((round(value(q, r), 9), rid) for rid, r in refs if not (exclude_self and rid == qid))
        out[qid] = [rid for _, rid in found[:k]]
    return out


def frames(spark, queries, refs):
    q = spark.createDataFrame(queries, "query_id long, vec array<double>").repartition(3)
    r = spark.createDataFrame(refs, "ref_id long, vec array<double>").repartition(3)
    return q, r


def ranked(df):
    out = {}
    for row in df.orderBy("query_id", "rank").collect():
        out.setdefault(row.query_id, []).append(row.ref_id)
    return out


def vectors(n, d, seed, hot=0):
    """Clustered vectors with zero rows, and ``hot`` equal copies of one row."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 5, (5, d))
    rows = [(i, [round(float(x), 3) for x in centres[i % 5] + rng.normal(0, 1, d)]) for i in range(n)]
    rows[0] = (0, [0.0] * d)
    return rows + [(n + i, rows[1][1]) for i in range(hot)]


@pytest.mark.parametrize("metric", similarity.METRICS)
def test_every_metric_against_all_pairs(spark, metric, monkeypatch):
    """Small cells and blocks, so that pruning and block splits are at work."""
    monkeypatch.setattr(similarity, "ROWS_PER_CELL", 40)
    monkeypatch.setattr(similarity, "QUERY_BLOCK", 16)
    monkeypatch.setattr(similarity, "MIN_QUERY_BLOCK", 16)
    monkeypatch.setattr(similarity, "MATRIX_NUMBERS", 300)
    refs = vectors(400, 4, 1, hot=200)
    queries = vectors(60, 4, 2) + [(1000 + i, v) for i, v in refs[:20]]
    q, r = frames(spark, queries, refs)
    got = ranked(similarity.nearest(q, r, "query_id", "ref_id", 7, metric))
    assert got == brute(queries, refs, 7, metric)


@pytest.mark.parametrize("exclude_self", [False, True])
def test_a_third_of_the_rows_are_copies(spark, exclude_self):
    """Equal rows on both sides: searched once, handed out to all, ties by id."""
    rows = vectors(60, 3, 8, hot=40)
    q, _ = frames(spark, rows, rows)
    r = q.withColumnRenamed("query_id", "rid")
    assert similarity._lowest_copies(r, 4).count() == 60 - 1 + 4
    got = ranked(similarity.nearest(q, None, "query_id", "ref_id", 4, exclude_self=exclude_self))
    assert got == brute(rows, rows, 4, "euclidean", exclude_self)


@pytest.mark.parametrize("probes", [None, 2])
def test_few_copies_are_collapsed_too(spark, probes, monkeypatch):
    """One large group among many different vectors: the search sees each query vector once."""
    rng, seen, search = random.Random(8), [], similarity._search
    rows = [(i, [rng.random(), rng.random()]) for i in range(90)] + [(100 + i, [0.5, 0.5]) for i in range(10)]

    def watched(q, r, *rest):
        seen.append((q.count(), r.count()))
        return search(q, r, *rest)

    monkeypatch.setattr(similarity, "_search", watched)
    q, r = frames(spark, rows, rows)
    found = similarity.nearest(q, r, "query_id", "ref_id", 3, probes=probes).collect()
    assert seen == [(91, 93)]
    got = {}
    for row in sorted(found, key=lambda f: f["rank"]):
        got.setdefault(row["query_id"], []).append(row["ref_id"])
    assert len(got) == 100 and all(got[100 + i] == [100, 101, 102] for i in range(10))
    if probes is None:
        assert got == brute(rows, rows, 3, "euclidean")


@pytest.mark.parametrize("exclude_self", [False, True])
def test_rows_that_all_differ_are_not_looked_at_for_copies(spark, exclude_self, monkeypatch):
    """No join hands out results, no window looks for copies."""
    leads, handed = [], similarity._handed_out

    def watched(q, lead, *rest):
        leads.append(lead)
        return handed(q, lead, *rest)

    monkeypatch.setattr(similarity, "_handed_out", watched)
    monkeypatch.setattr(similarity, "_lowest_copies", None)
    rows = vectors(80, 3, 5)
    q, _ = frames(spark, rows, rows)
    got = ranked(similarity.nearest(q, None, "query_id", "ref_id", 3, exclude_self=exclude_self))
    assert got == brute(rows, rows, 3, "euclidean", exclude_self) and leads == [None]


@pytest.mark.parametrize("cells, rows, most", [(600, 1000, 16_500), (100, 1024, 2_850), (40, 37, 250)])
def test_blocks_are_hardly_more_than_their_rows_ask_for(cells, rows, most):
    """Every block is passed by the units that it needs: halves of halves gave up to twice as many."""
    rng = np.random.default_rng(3)
    counts = [(i, int(n)) for i, n in enumerate(rng.integers(rows // 2, rows * 3 // 2, cells))]
    table = similarity._bisected(rng.normal(size=(cells, 4)), counts, most)
    assert sorted(cell for cell, _, _ in table) == list(range(cells)) and all(parts == 1 for _, _, parts in table)
    held = {}
    for cell, block, _ in table:
        held[block] = held.get(block, 0) + counts[cell][1]
    whole = sum(n for _, n in counts)
    assert sorted(held) == list(range(len(held))) and max(held.values()) <= most * (1 + similarity.BLOCK_ROOM)
    assert len(held) <= 1.15 * whole / most + 1


def test_one_large_cell_is_dealt_over_blocks():
    table = similarity._bisected(np.array([[0.0], [9.0]]), [(0, 10_000), (1, 90)], 1_000)
    assert table == [(0, 0, 10), (1, 10, 1)]


def test_exclude_self_and_k_beyond_size(spark):
    rows = vectors(12, 3, 4, hot=3)
    q, _ = frames(spark, rows, rows)
    got = ranked(similarity.nearest(q, None, "query_id", "ref_id", 50, exclude_self=True))
    assert got == brute(rows, rows, 50, "euclidean", exclude_self=True)
    first = ranked(similarity.nearest(q, None, "query_id", "ref_id", 1))
    assert first[5] == [5] and first[13] == [1]


def test_scores(spark):
    q, r = frames(spark, [(1, [1.0, 0.0])], [(1, [0.0, 0.0]), (2, [2.0, 0.0])])

    def one(metric):
        rows = similarity.nearest(q, r, "query_id", "ref_id", 2, metric).orderBy("ref_id").collect()
        return [(x.distance, x.score) for x in rows]

    assert one("euclidean") == [(1.0, math.exp(-1)), (1.0, math.exp(-1))]
    assert one("dot") == [(0.0, None), (2.0, None)]
    assert one("cosine") == [(1.0, 0.0), (0.0, 1.0)]
    assert one("angular") == [(pytest.approx(math.sqrt(2)), pytest.approx(math.exp(-math.sqrt(2)))), (0.0, 1.0)]


def test_string_ids_and_empty_reference(spark):
    q = spark.createDataFrame([("a", [0.0]), ("b", [5.0])], "query_id string, vec array<double>")
    got = similarity.nearest(q, None, "query_id", "ref_id", 1, exclude_self=True).collect()
    assert sorted((r.query_id, r.ref_id) for r in got) == [("a", "b"), ("b", "a")]
    none = spark.createDataFrame([], "ref_id string, vec array<double>")
    assert similarity.nearest(q, none, "query_id", "ref_id", 1).count() == 0


def test_pruning_visits_few_units(spark, monkeypatch):
    """Far clusters: a query is compared with its own cluster only."""
    monkeypatch.setattr(similarity, "ROWS_PER_CELL", 20)
    rows = [(i, [1000.0 * (i % 10) + (i // 10) * 0.01, 0.0]) for i in range(1000)]
    q, _ = frames(spark, rows, rows)
    r = q.withColumnRenamed("query_id", "rid")
    units, placed = similarity._build_units(r, similarity._pivots(r, 1000, 2, None, 42, 20), "l2", 1e4, 20)
    nearest = partial(similarity._nearest_units, need=3)
    chosen = q.withColumnRenamed("query_id", "qid").mapInArrow(
        similarity._visits(units, "l2", 1e4, nearest, "first"), "qid long, vec array<double>, first array<int>"
    )
    limited = chosen.withColumn("limit", F.lit(0.05)).mapInArrow(
        similarity._visits(units, "l2", 1e4, similarity._within_limit, "further"),
        "qid long, vec array<double>, first array<int>, limit double, further array<int>",
    )
    visits = limited.agg(F.sum(F.size("first") + F.size("further"))).first()[0]
    assert visits < 0.1 * 1000 * len(units.count)
    assert sum(units.count) == 1000 and placed.count() == 1000


@pytest.mark.parametrize("k", [5, 60])
def test_few_rows_leave_the_blocks(spark, k, monkeypatch):
    """Beyond the first units only rows within the limit leave a task: at most four times k per query row."""
    monkeypatch.setattr(similarity, "ROWS_PER_CELL", 100)
    rng = np.random.default_rng(9)
    rows = [(i, [float(x) for x in rng.normal(0, 1, 3)]) for i in range(3000)]
    q, _ = frames(spark, rows, rows)
    q = q.withColumnRenamed("query_id", "qid")
    r = q.withColumnRenamed("qid", "rid")
    found = similarity._search(q, r, similarity._head(r), "l2", k, False, None, None, 42)
    assert found.count() <= 4 * k * 3000


def test_carried_columns(spark):
    rows = vectors(60, 3, 8, hot=40)
    q, _ = frames(spark, rows, rows)
    r = q.select(F.col("query_id").alias("ref_id"), "vec", (F.col("query_id") * 2).alias("value"))
    for found in (
        similarity.nearest(q, r, "query_id", "ref_id", 4, carry=["value"]),
        similarity.nearest(q.withColumn("value", F.col("query_id") * 2), None, "query_id", "ref_id", 4, carry=["value"]),
    ):
        assert found.count() == 400 and found.where("value <> 2 * ref_id").isEmpty()


def test_probed_recall(spark):
    rng = random.Random(1)
    rows = [(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(1500)]
    q, _ = frames(spark, rows, rows)
    exact = similarity.nearest(q, None, "query_id", "ref_id", 5)
    found = similarity.nearest(q, None, "query_id", "ref_id", 5, n_pivots=16, probes=6)
    assert similarity.recall(found, exact, "query_id", "ref_id").first()[0] > 0.85


@pytest.mark.parametrize("exclude_self", [False, True])
def test_one_probe_gives_all_rows_asked_for(spark, exclude_self):
    """Cells of a few rows: the probed one alone would not hold ten."""
    rows = vectors(400, 4, 6)
    q, _ = frames(spark, rows, rows)
    found = similarity.nearest(
        q, None, "query_id", "ref_id", 10, n_pivots=100, probes=1, exclude_self=exclude_self
    )
    assert {r["count"] for r in found.groupBy("query_id").count().collect()} == {10}
    assert found.select("query_id").distinct().count() == 400


def test_z_scores(spark):
    df = spark.createDataFrame([("a", 1.0, 4), ("b", 3.0, 4), ("c", None, 4)], "id string, x double, y int")
    got = {r.id: r.vec for r in similarity.z_scored(df, "id", ["x", "y"], df).collect()}
    xs = np.array([1.0, 3.0, 0.0])
    assert got["a"] == [pytest.approx((1 - xs.mean()) / xs.std()), 0.0]
    with pytest.raises(ValueError):
        similarity.z_scored(df, "id", ["none"], df)
    arrays = spark.createDataFrame([(1, [1.0, 5.0]), (2, [3.0, 5.0])], "id int, e array<float>")
    assert sorted(r.vec for r in similarity.z_scored_array(arrays, "id", "e", arrays).collect()) == [
        [-1.0, 0.0], [1.0, 0.0]
    ]


def test_examples(spark):
    near = spark.createDataFrame([("q", "a", 1, 0.5), ("q", "z", 2, 0.25)], "query_id string, ref_id string, rank int, score double")
    profiles = spark.createDataFrame(
        [("a", "old", "t", "x", 1), ("a", "new", "t", "x", 2)],
        "customer_id string, template_profile string, template_treatment string, template_outcome string, position int",
    )
    rows = similarity.neighbour_examples(near, profiles, "query_id", "ref_id").orderBy("rank").collect()
    assert [(r.profile, r.treatment, r.outcome) for r in rows] == [("new", "t", "x"), ("N/A", "N/A", "N/A")]
    with pytest.raises(ValueError):
        similarity.require_rows(near, near.where("rank = 1"), "ref_id")


def test_null_and_nan_are_refused(spark):
    refs = spark.createDataFrame([(1, [0.0, 1.0]), (2, [None, 1.0])], "ref_id int, vec array<double>")
    queries = spark.createDataFrame([(1, [0.0, 1.0])], "query_id int, vec array<double>")
    for bad in (refs, refs.withColumn("vec", F.expr("if(ref_id = 1, vec, null)")),
                refs.withColumn("vec", F.expr("array(double('NaN'), 1D)"))):
        with pytest.raises(Exception, match="fill it before"):
            similarity.nearest(queries, bad, "query_id", "ref_id", 1).collect()


def test_an_id_that_stands_for_several_rows_has_k_neighbours_in_all(spark):
    rows = [(1, [0.0, 0.0]), (1, [0.0, 0.0]), (2, [5.0, 0.0]), (3, [9.0, 1.0])]
    q, _ = frames(spark, rows, rows)
    r = spark.createDataFrame([(i, [float(i), 0.0]) for i in range(10)], "ref_id long, vec array<double>")
    found = ranked(similarity.nearest(q, r, "query_id", "ref_id", 3))
    assert found[1] == [0, 0, 1] and found[2][0] == 5 and len(found[2]) == 3


def test_only_the_wanted_ranks_leave_the_search(spark, monkeypatch):
    """A query row leaves as one row with the ranks asked for; before, all 40 neighbours left as rows."""
    monkeypatch.setattr(similarity, "ROWS_PER_CELL", 30)
    sizes, search = [], similarity._search

    def watched(*args):
        found = search(*args)
        sizes.append((found.count(), found.agg(F.max(F.size("near"))).first()[0]))
        return found

    monkeypatch.setattr(similarity, "_search", watched)
    rows = vectors(500, 3, 5)
    q, r = frames(spark, rows[:60], rows)
    found = similarity.nearest(q, r, "query_id", "ref_id", 40, ranks=[1, 2, 40, 900])
    want = brute(rows[:60], rows, 40, "euclidean")
    assert sizes == [(60, 3)]
    assert {i: found for i, found in ranked(found).items()} == {i: [w[0], w[1], w[39]] for i, w in want.items()}


def test_sums_of_a_query_row_leave_once(spark, monkeypatch):
    """Many small units: one row of sums per query row is made, not one per unit; repeated ids add up."""
    monkeypatch.setattr(similarity, "ROWS_PER_CELL", 20)
    rows = vectors(300, 3, 7)
    q, r = frames(spark, [*rows[:30], rows[2]], rows)
    r = r.withColumn("values", F.array(F.lit(1.0), F.col("ref_id").cast("double")))
    near = similarity.nearest(q.dropDuplicates(["query_id"]), r.drop("values"), "query_id", "ref_id", 25)
    sums = similarity.nearest_sums(near, q, r, "query_id", "ref_id", [(25, lambda x: x)])
    got = {s.query_id: s.sums_0 for s in sums.collect()}
    want = brute(rows[:30], rows, 25, "euclidean")
    assert len(got) == 30 and got[2] == [50.0, 2.0 * sum(want[2])]
    assert all(got[i] == [25.0, float(sum(w))] for i, w in want.items() if i != 2)


def test_units_of_a_block_are_looked_at_once(spark, monkeypatch):
    """A unit that one row of a block needs is not held against every other row of it."""
    pa, np = similarity.pa, similarity.np
    rng = np.random.default_rng(5)
    size, rows = 40, 3_000
    low = rng.normal(size=(size, 3))
    units = similarity.Units(
        low, np.arange(size), np.full(size, 9), np.zeros(size), np.ones(size), np.zeros(size, int), low, low + 0.3, np.full(size, 9.0)
    )
    vectors, limit = rng.normal(size=(rows, 3)), rng.uniform(0.1, 0.6, rows)
    part = pa.RecordBatch.from_pydict(
        {"block": pa.array(np.repeat([0, 1], rows // 2), pa.int32()), "vec": vectors.tolist(), "limit": limit}
    )
    want = {(b, int(u)) for b in (0, 1) for u in np.flatnonzero(
        similarity._within_limit(part.slice(b * rows // 2, rows // 2), units, low, "l2", 9.0).any(axis=0))}
    looked, real = [0], similarity._least_values

    def counted(low, high, some, family):
        looked[0] += len(low) * len(some.count)
        return real(low, high, some, family)

    monkeypatch.setattr(similarity, "_least_values", counted)
    runs = []

    class Asked:
        columns = ["block", "vec", "limit"]
        select = lambda self, *c: self
        mapInArrow = lambda self, run, kind: runs.append(run) or self
        distinct = lambda self: self

    monkeypatch.setattr(similarity, "stage", lambda df, name: df)
    similarity._needed(Asked(), units, "l2", 9.0)
    got = [r for b in runs[0](iter([part])) for r in zip(*b.to_pydict().values())]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 20
    assert looked[0] < 0.75 * rows * size


def test_rows_of_a_unit_are_compared_by_boxes(monkeypatch):
    """A query row meets the few rows of a unit that lie near it, and finds the same as among all."""
    pa, np = similarity.pa, similarity.np
    rng = np.random.default_rng(11)
    refs, asked = rng.uniform(size=(512, 2)), rng.uniform(size=(200, 2))
    far = np.sqrt(((asked[:, None] - refs[None]) ** 2).sum(axis=2))
    want = np.argsort(far, axis=1)[:, :3]
    one = [np.zeros(1, int), np.array([512]), np.zeros(1), np.full(1, 2.0), np.zeros(1, int)]
    units = similarity.Units(refs[:1], *one, refs.min(axis=0)[None], refs.max(axis=0)[None], np.full(1, 2.0))
    near = pa.list_(pa.struct([("rid", pa.int64()), ("value", pa.float64()), ("rank", pa.int32())]))
    held = {"qid": np.arange(200), "vec": asked.tolist(), "limit": np.sort(far, axis=1)[:, 2]}
    block = similarity._Best(
        3, False, "l2", units, 2.0, 3, None, pa.schema([("qid", pa.int64()), ("near", near)]), [pa.RecordBatch.from_pydict(held)]
    )
    pairs, real = [0], similarity._candidates

    def counted(part, refs, *rest):
        pairs[0] += len(part) * len(refs)
        return real(part, refs, *rest)

    monkeypatch.setattr(similarity, "_candidates", counted)
    block.meet(0, pa.RecordBatch.from_pydict({"rid": np.arange(512), "vec": refs.tolist()}))
    got = {r["qid"]: [n["rid"] for n in r["near"]] for b in block.finish() for r in b.to_pylist()}
    assert got == {i: w.tolist() for i, w in enumerate(want)}
    assert pairs[0] < 0.2 * 200 * 512


def test_a_unit_passes_in_few_pieces(spark):
    """Rows of a unit pass as one value; columns that come along and nulls in them stay."""
    rows = [(i, [float(i), 1.0], None if i % 5 == 0 else f"c{i}", i % 4) for i in range(2_000)]
    refs = spark.createDataFrame(rows, "rid long, vec array<double>, carry_0 string, unit int")
    pieces = similarity._pieces(refs).collect()
    assert 4 <= len(pieces) < 40
    got = [
        (r["rid"], r["vec"], r["carry_0"], p["unit"])
        for p in pieces for b in similarity.pa.ipc.open_stream(p["ref"]) for r in b.to_pylist()
    ]
    assert sorted(got, key=lambda r: r[0]) == rows


def test_neighbours_are_searched_once_for_sums(spark):
    """Neighbours that are not stored yet are made once; before, a look at repeated ids made them again."""
    rows = vectors(300, 3, 7)
    q, r = frames(spark, rows[:30], rows)
    r = r.withColumn("values", F.array(F.lit(1.0), F.col("ref_id").cast("double")))
    near = similarity.nearest(q, r.drop("values"), "query_id", "ref_id", 25)
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    counted = near.mapInArrow(count, near.schema)
    similarity.nearest_sums(counted, q, r, "query_id", "ref_id", [(25, lambda x: x)]).collect()
    assert made.value == 30 * 25


def test_equal_query_rows_are_summed_once(spark, monkeypatch):
    """Copies of a query row get the sums of the one that was added up."""
    rows, sizes, blocks = vectors(200, 3, 7), [], similarity._query_blocks
    asked = [(1_000 + i, rows[i % 10][1]) for i in range(60)]
    q, r = frames(spark, asked, rows)
    r = r.withColumn("values", F.array(F.lit(1.0), F.col("ref_id").cast("double")))
    near = similarity.nearest(q, r.drop("values"), "query_id", "ref_id", 25)
    monkeypatch.setattr(similarity, "_query_blocks", lambda q, *rest: sizes.append(q.count()) or blocks(q, *rest))
    sums = similarity.nearest_sums(near, q, r, "query_id", "ref_id", [(25, lambda x: x), (7, lambda x: x)]).collect()
    want = brute(asked, rows, 25, "euclidean")
    assert sizes == [10] and {s.query_id: s.sums_0 for s in sums} == {i: [25.0, float(sum(w))] for i, w in want.items()}
    assert {s.query_id: s.sums_1 for s in sums} == {i: [7.0, float(sum(w[:7]))] for i, w in want.items()}


def test_the_search_leaves_its_result_only(spark):
    """Pieces are read from files where they are needed, and what the search stores is gone with it."""
    from pathlib import Path

    folder = Path(sources.run_folder(spark).removeprefix("file:"))
    rows = vectors(300, 3, 7)
    q, r = frames(spark, rows[:30], rows)
    before = set(folder.glob("*"))
    found = similarity.nearest(q, r, "query_id", "ref_id", 5)
    left = sorted(p.name.rsplit("-", 1)[0] for p in set(folder.glob("*")) - before)
    assert left == ["different-vectors", "found", "query-vectors"]
    assert ranked(found) == brute(rows[:30], rows, 5, "euclidean")


@pytest.mark.parametrize("metric", ["euclidean", "cosine"])
def test_pieces_in_files_give_the_same(spark, metric, monkeypatch):
    """Where tasks cannot read files of a folder the pieces themselves are passed, to the same end."""
    monkeypatch.setattr(similarity, "ROWS_PER_CELL", 20)
    passed, packed = [], similarity._pieces
    rows = vectors(300, 3, 7, hot=40)
    q, r = frames(spark, rows[:50], rows)
    monkeypatch.setattr(similarity, "_pieces", lambda refs: passed.append(1) or packed(refs))
    files = ranked(similarity.nearest(q, r, "query_id", "ref_id", 12, metric))
    assert not passed and files == brute(rows[:50], rows, 12, metric)
    monkeypatch.setattr(similarity, "temporary_folder", lambda spark, name: None)
    assert ranked(similarity.nearest(q, r, "query_id", "ref_id", 12, metric)) == files and passed


def test_limits_hold_few_values(spark):
    """Of many values of a query row no more than twice the wanted ones are held; the limit is the last wanted."""
    pa, rng = similarity.pa, np.random.default_rng(4)
    refs, asked = rng.uniform(size=(700, 2)), rng.uniform(size=(40, 2))
    held = pa.RecordBatch.from_pydict(
        {"qid": np.arange(40), "vec": asked.tolist(), "limit": np.full(40, np.inf), "first": [list(range(7))] * 40}
    )
    schema = pa.schema([("qid", pa.int64()), ("limit", pa.float64())])
    block = similarity._Limits(90, False, "l2", 2.0, schema, [held])
    for unit in range(7):
        block.meet(unit, pa.RecordBatch.from_pydict({"rid": np.arange(100), "vec": refs[unit::7].tolist()}))
        assert block.values.shape[1] <= 180 and not block.found
    got = np.concatenate([b.column("limit").to_numpy() for b in block.finish()])
    far = np.sort(np.sqrt(((asked[:, None] - refs[None]) ** 2).sum(axis=2)), axis=1)
    assert np.allclose(got, far[:, 89], atol=1e-6)


def test_candidates_with_equal_values_are_cut_by_id(monkeypatch):
    """More equal candidates than there is room for: the lowest ids stay, whenever a block is cut."""
    pa = similarity.pa
    near = pa.list_(pa.struct([("rid", pa.string()), ("value", pa.float64()), ("rank", pa.int32())]))
    monkeypatch.setattr(similarity, "HELD_NUMBERS", 50)
    one = [np.zeros(1, int), np.array([400]), np.zeros(1), np.full(1, 2.0), np.zeros(1, int)]
    units = similarity.Units(np.zeros((1, 2)), *one, np.zeros((1, 2)), np.ones((1, 2)), np.full(1, 2.0))
    held = pa.RecordBatch.from_pydict({"qid": ["a", "b"], "vec": [[0.0, 0.0], [1.0, 1.0]], "limit": np.full(2, np.inf)})
    block = similarity._Best(
        3, False, "l2", units, 2.0, 3, None, pa.schema([("qid", pa.string()), ("near", near)]), [held]
    )
    ids = [f"r{i:03d}" for i in np.random.default_rng(2).permutation(400)]
    for at in range(0, 400, 40):
        block.meet(0, pa.RecordBatch.from_pydict({"rid": ids[at : at + 40], "vec": [[0.5, 0.5]] * 40}))
    got = {r["qid"]: [n["rid"] for n in r["near"]] for b in block.finish() for r in b.to_pylist()}
    assert got == {"a": ["r000", "r001", "r002"], "b": ["r000", "r001", "r002"]}


def test_a_staged_table_leaves_no_shuffle_files(spark):
    """Files of the shuffles behind a staged table go when it is stored; they would stay as long as the session."""
    import os

    def shuffled():
        top = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
        return sum(f.startswith("shuffle_") for d in top for _, _, files in os.walk(d.getPath()) for f in files)

    before = shuffled()
    setting = spark.conf.get(sources.CLEAN_SHUFFLES, None)
    out = sources.stage(spark.range(1_000).repartition(7).groupBy(F.col("id") % 10).count(), "counts")
    for _ in range(50):
        if shuffled() <= before:
            break
        time.sleep(0.1)
    assert shuffled() <= before and out.count() == 10
    assert spark.conf.get(sources.CLEAN_SHUFFLES, None) == setting
