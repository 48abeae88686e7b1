"""Dependence skeletons against a slow search and the one-variable screen."""

import math
from itertools import combinations
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from shopcast.operators import factors, skeleton

NAMES = ["a", "b", "c", "d", "e", "t"]


@pytest.fixture(scope="module")
def local(spark):
    """Neighbour rows of four query rows: a chain, a fork, a common effect, a constant column."""
    draw, rows = np.random.default_rng(5), []
    for q, n in enumerate((400, 60, 12, 3)):
        a, e = draw.normal(size=n), draw.normal(size=n)
        b = a + 0.5 * draw.normal(size=n)
        c = b + 0.5 * draw.normal(size=n) if q != 2 else np.ones(n)
        d = a + e + 0.3 * draw.normal(size=n)
        t = c + e + 0.5 * draw.normal(size=n)
        rows += [(q, *map(float, x)) for x in zip(a, b, c, d, e, t)]
    return spark.createDataFrame(rows, "q int, " + ", ".join(f"{c} double" for c in NAMES)).repartition(3)


def slow(r, n, critical, order, near_only):
    size = len(r)

    def independent(i, j, given):
        sub = np.linalg.pinv(r[np.ix_([i, j, *given], [i, j, *given])])
        value = min(abs(-sub[0, 1] / math.sqrt(sub[0, 0] * sub[1, 1])), 0.999999999)
        return math.sqrt(max(n - len(given) - 3, 0)) * 0.5 * math.log((1 + value) / (1 - value)) <= critical

    near = {i: set(range(size)) - {i} for i in range(size)}
    parted = {}
    for k in range(order + 1):
        before = {i: set(v) for i, v in near.items()}
        for i, j in combinations(range(size), 2):
            for given in combinations([v for v in range(size) if v not in (i, j)], k):
                s = set(given)
                if j in near[i] and (not near_only or s <= before[i] or s <= before[j]) and independent(i, j, given):
                    near[i].discard(j), near[j].discard(i)
                    parted[i, j] = [NAMES[g] for g in given]
    return near, parted


@pytest.mark.parametrize("order,near_only", [(0, True), (1, False), (2, True), (3, True)])
def test_against_a_slow_search(local, order, near_only):
    got = skeleton.dependence_skeleton(local, "q", NAMES, 0.05, order, near_only).collect()
    assert len(got) == 4 * 15
    table = {q: [] for q in range(4)}
    for row in local.collect():
        table[row.q].append(row[1:])
    for q, rows in table.items():
        values = np.array(rows)
        flat = values.var(axis=0) < 1e-9
        values[:, flat] = np.random.default_rng(1).normal(size=(len(values), flat.sum()))
        r = np.corrcoef(values.T)
        r[flat, :], r[:, flat] = 0, 0
        np.fill_diagonal(r, 1)
        near, parted = slow(r, len(values), NormalDist().inv_cdf(0.975), order, near_only)
        for row in (x for x in got if x.q == q):
            i, j = NAMES.index(row.first), NAMES.index(row.second)
            assert row.joined == (j in near[i]), (q, row)
            assert row.separated_by == parted.get((i, j))
            assert row.correlation == pytest.approx(r[i, j], abs=1e-6)


def test_equals_the_screen_with_one_other_variable(local):
    found = skeleton.dependence_skeleton(local, "q", NAMES, 0.1, 1, among_neighbours=False)
    passed = {(r.q, r.feature): r.passed for r in skeleton.joined_to(found, "q", "t").collect()}
    screen = factors.dependence_screen(local, "q", NAMES[:-1], "t", 0.1).collect()
    assert passed == {(r.q, r.feature): r.passed for r in screen}


def test_chain_is_parted_by_its_middle(local):
    rows = {(r.first, r.second): r for r in skeleton.dependence_skeleton(local, "q", NAMES, 0.01).where("q = 0").collect()}
    assert rows["a", "c"].separated_by == ["b"] and rows["a", "b"].joined and rows["b", "c"].joined
    assert rows["a", "e"].separated_by == []


def test_no_rows(local):
    assert skeleton.dependence_skeleton(local.limit(0), "q", NAMES).count() == 0
    with pytest.raises(ValueError, match="two variables"):
        skeleton.dependence_skeleton(local, "q", ["a"])
    assert skeleton.dependence_skeleton(local.withColumn("a", F.lit(None)), "q", ["a", "b"]).where("joined").count() == 0
