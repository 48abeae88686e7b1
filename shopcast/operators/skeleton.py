"""Which features depend on each other and on a target, given any few of the others, per query row.

The search starts with all pairs joined and removes a pair once the Fisher-z
test finds it independent given a set of its neighbours; sets grow by one
variable a round.  A round looks at the neighbours of the round's start, so the
result does not depend on the order of variables.  Only sums leave the
neighbour rows: one correlation matrix per query row, worked on in array
batches, all query rows of a batch at once.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import combinations
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopcast.operators.factors import _FLAT, _moments, all_pairs

#: Query rows whose matrices are searched at once; a round holds an array of them per test.
BATCH_ROWS = 512


class _Partials:
    """Partial correlations of a batch of correlation matrices, each worked out once."""

    def __init__(self, r: np.ndarray) -> None:
        self.r = r
        self.known: dict[tuple, np.ndarray] = {}

    def of(self, i: int, j: int, given: tuple[int, ...]) -> np.ndarray:
        if not given:
            return self.r[:, i, j]
        key = (min(i, j), max(i, j), given)
        if key not in self.known:
            rest, k = given[:-1], given[-1]
            own, left, right = self.of(i, j, rest), self.of(i, k, rest), self.of(j, k, rest)
            spread = (1 - left * left) * (1 - right * right)
            with np.errstate(divide="ignore", invalid="ignore"):
                value = (own - left * right) / np.sqrt(spread)
            self.known[key] = np.where(spread > _FLAT, value, 0.0)
        return self.known[key]


def _z(r: np.ndarray, n: np.ndarray, given: int) -> np.ndarray:
    size = np.minimum(np.abs(r), 0.999999999)
    return np.sqrt(np.maximum(n - given - 3, 0.0)) * 0.5 * np.log((1 + size) / (1 - size))


def skeleton_of(
    r: np.ndarray, n: np.ndarray, critical: float, max_order: int, among_neighbours: bool = True
) -> tuple[np.ndarray, np.ndarray]:
    """(joined, separating): matrices of pairs that stay, and per pair the set that parts it, padded with -1.

    ``separating`` is -2 throughout for a pair that stays.  Of several sets of
    one size the first by place counts.
    """
    rows, size, _ = r.shape
    joined = np.broadcast_to(~np.eye(size, dtype=bool), r.shape).copy()
    separating = np.full((rows, size, size, max(1, max_order)), -2, np.int32)
    partials = _Partials(r)
    for order in range(max_order + 1):
        before = joined.copy()
        for i, j in combinations(range(size), 2):
            live = before[:, i, j].copy()
            for given in combinations([v for v in range(size) if v not in (i, j)], order):
                tested = live
                if among_neighbours and order:
                    near = before[:, i, given].all(axis=1) | before[:, j, given].all(axis=1)
                    tested = live & near
                if not tested.any():
                    continue
                parted = tested & ~(_z(partials.of(i, j, given), n, order) > critical)
                if parted.any():
                    joined[parted, i, j] = joined[parted, j, i] = False
                    separating[parted, i, j] = [*given, *[-1] * (separating.shape[3] - order)]
                    live &= ~parted
    return joined, separating


def dependence_skeleton(
    local: DataFrame,
    query_id: str,
    variables: Sequence[str],
    alpha: float = 0.1,
    max_order: int = 2,
    among_neighbours: bool = True,
) -> DataFrame:
    """Every pair of variables per query row: (query_id, first, second, correlation, joined, separated_by).

    ``separated_by`` lists the variables given which a pair was found
    independent, none for a plain test, and is null for a pair that stays.
    ``max_order`` bounds the size of these sets.  They are taken from the
    neighbours of either variable; with ``among_neighbours=False`` from all
    variables, as :func:`factors.dependence_screen` does with one.  The
    correlation of a constant column counts as 0.  An empty table has no pairs.
    """
    if len(variables) < 2:
        raise ValueError("a skeleton needs two variables and an order of 0 or more")
    found = _moments(local, query_id, list(variables), all_pairs(len(variables)))
    return skeleton_from(found, query_id, variables, alpha, max_order, among_neighbours)


def skeleton_from(
    found: DataFrame,
    query_id: str,
    variables: Sequence[str],
    alpha: float = 0.1,
    max_order: int = 2,
    among_neighbours: bool = True,
) -> DataFrame:
    """The same from ``n`` and ``r``, the correlations of all pairs, as :func:`factors.correlations` gives them."""
    names, size = list(variables), len(variables)
    if size < 2 or max_order < 0:
        raise ValueError("a skeleton needs two variables and an order of 0 or more")
    pairs = all_pairs(size)
    critical = NormalDist().inv_cdf(1 - alpha / 2)
    left, right = (np.array(side) for side in zip(*pairs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH_ROWS):
                batch = whole.slice(at, BATCH_ROWS)
                rows = batch.num_rows
                flat = batch.column("r").flatten().to_numpy().reshape(rows, len(pairs))
                r = np.broadcast_to(np.eye(size), (rows, size, size)).copy()
                r[:, left, right] = r[:, right, left] = flat
                joined, separating = skeleton_of(
                    r, batch.column("n").to_numpy(), critical, max_order, among_neighbours
                )
                stays = joined[:, left, right].reshape(-1)
                sets = separating[:, left, right].reshape(rows * len(pairs), -1).tolist()
                parted = [None if s else [names[v] for v in given if v >= 0] for s, given in zip(stays, sets)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(query_id).take(pa.array(np.repeat(np.arange(rows), len(pairs)))),
                        pa.array([names[i] for i in left] * rows),
                        pa.array([names[j] for j in right] * rows),
                        pa.array(flat.reshape(-1)),
                        pa.array(stays),
                        pa.array(parted, pa.list_(pa.string())),
                    ],
                    names=[query_id, "first", "second", "correlation", "joined", "separated_by"],
                )

    kind = found.schema[query_id].dataType.simpleString()
    return found.mapInArrow(
        run,
        f"`{query_id}` {kind}, first string, second string, correlation double, joined boolean, "
        "separated_by array<string>",
    )


def joined_to(skeleton: DataFrame, query_id: str, target: str) -> DataFrame:
    """(query_id, feature, passed) of a skeleton's pairs with the target, as :func:`factors.factor_order` reads them."""
    other = F.when(F.col("first") == target, F.col("second")).otherwise(F.col("first"))
    with_target = skeleton.where((F.col("first") == target) | (F.col("second") == target))
    return with_target.select(query_id, other.alias("feature"), F.col("joined").alias("passed"))
