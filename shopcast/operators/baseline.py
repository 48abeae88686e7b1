"""Gradient-boosted regression baseline of symmetric trees.

Features are binned once to bytes.  A level of a tree is one table of sums by
(leaf, feature, bin).  Only the right children are summed; the left ones are what
remains of their parents.  Few rows are fitted by one task, many rounds in one job.
More are kept as cached blocks with their residuals: each level is a job that adds
up the sums of all blocks and returns them, and the driver chooses the split.
Rounds run in segments, each of which starts from the stored blocks and the trees
so far: a lost executor repeats no more than the segment it was in.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shopcast.sources import stage

#: Rows that one task fits alone; it holds a byte a feature, two a group of features and 16 more a row.
TASK_ROWS = 1_000_000
#: Tasks of a level, unless they would get more than this many times those rows; the driver gets the sums of each.
MOST_TASKS = 16
TASK_SHARE = 4
#: Tasks from which sums are added up in part before the driver gets them.
MANY_TASKS = 64
#: Rounds of one Spark job, where one task fits all.
SEGMENT = 250
#: Rounds whose residuals follow from those of the round before, where a level is a job.
CACHED_ROUNDS = 25
#: Rows that one step inside a task works on.
STEP_ROWS = 1 << 18
#: Cells of the features that are counted as one, where a step has this many times as many rows as it has cells.
JOINT_CELLS = 1 << 14
JOINT_SHARE = 2
#: Rows that all trees are added to in one go.
ADD_ROWS = 1 << 15


@dataclass(frozen=True)
class BoostedTrees:
    """Symmetric trees: a level asks one question of all rows, so a leaf is a number of ``depth`` bits.

    ``borders`` has each feature's ascending cuts; a row is right of a split
    when its value is over the border.  ``splits`` has (feature, border) by tree
    and level, -1 where a level splits nothing; ``leaves`` has a value per leaf.
    """

    features: tuple[str, ...]
    borders: tuple[tuple[float, ...], ...]
    start: float | None
    splits: np.ndarray
    leaves: np.ndarray
    gains: np.ndarray

    def binned(self, columns: Sequence[np.ndarray]) -> np.ndarray:
        """A row of bytes per feature: how many borders lie below a value."""
        return np.stack([np.searchsorted(b, c, "left").astype(np.uint8) for b, c in zip(self.borders, columns)])

    def add(self, binned: np.ndarray, out: np.ndarray) -> np.ndarray:
        """Add all trees to predictions."""
        trees = list(zip(self.splits.tolist(), self.leaves))
        for at in range(0, len(out), ADD_ROWS):
            part, some = binned[:, at : at + ADD_ROWS], out[at : at + ADD_ROWS]
            for splits, leaves in trees:
                some += leaves[_leaf(part, splits)]
        return out


def _leaf(binned: np.ndarray, splits: Sequence[tuple[int, int]]) -> np.ndarray:
    """The leaf of every row after the given levels."""
    kind = np.uint8 if len(splits) <= 8 else np.int64
    leaf = np.zeros(binned.shape[1], kind)
    for level, (feature, border) in enumerate(splits):
        if feature >= 0:
            leaf |= (binned[feature] > border).astype(kind) << kind(level)
    return leaf


def _filled(df: DataFrame, features: Sequence[str]) -> list:
    """Feature columns as doubles; null and NaN are 0."""
    columns = [F.col(c).cast("double") for c in features]
    return [F.when(c.isNull() | F.isnan(c), F.lit(0.0)).otherwise(c).alias(f"x{i}") for i, c in enumerate(columns)]


def _columns(batch: pa.RecordBatch, size: int) -> list[np.ndarray]:
    return [batch.column(f"x{i}").to_numpy(zero_copy_only=False) for i in range(size)]


def _joint(sizes: Sequence[int]) -> list[list[int]]:
    """Features in groups whose bins together make at most ``JOINT_CELLS`` cells, the largest first."""
    groups: list[list[int]] = []
    cells: list[int] = []
    for f in sorted(range(len(sizes)), key=lambda f: -sizes[f]):
        fits = [g for g in range(len(groups)) if cells[g] * sizes[f] <= JOINT_CELLS]
        if fits:
            best = max(fits, key=lambda g: cells[g])
            groups[best].append(f)
            cells[best] *= sizes[f]
        else:
            groups.append([f])
            cells.append(sizes[f])
    return groups


class _Joint:
    """Cells of features counted as one, by row: a pass per group of features instead of one per feature."""

    def __init__(self, binned: np.ndarray, sizes: Sequence[int]) -> None:
        self.sizes, self.groups = sizes, _joint(sizes)
        self.cells = [int(np.prod([sizes[f] for f in group])) for group in self.groups]
        self.places = []
        for group in self.groups:
            place = np.zeros(binned.shape[1], np.uint16)
            for f in group:
                place = place * np.uint16(sizes[f]) + binned[f]
            self.places.append(place)

    def add(self, out: np.ndarray, leaf: np.ndarray, use: np.ndarray, weight: np.ndarray, n_leaves: int) -> None:
        """Add rows (unless ``out`` has one table only) and residuals by (feature, leaf, bin) of the rows ``use``."""
        bins = out.shape[-1] // n_leaves
        for group, cells, place in zip(self.groups, self.cells, self.places):
            at = leaf * cells + place[use]
            shape = (n_leaves, *(self.sizes[f] for f in group))
            for table, values in zip(out[::-1], (weight, None)):
                held = np.bincount(at, values, minlength=n_leaves * cells).reshape(shape)
                for i, f in enumerate(group):
                    rest = tuple(axis + 1 for axis in range(len(group)) if axis != i)
                    table[f].reshape(n_leaves, bins)[:, : self.sizes[f]] += held.sum(axis=rest)


def _sums(
    binned: np.ndarray, leaf: np.ndarray, rest: np.ndarray, n_leaves: int, bins: int, joint: _Joint | None = None,
    counts: np.ndarray | None = None,
) -> np.ndarray:
    """Rows and residuals by (leaf, feature, bin) of the rows whose ``leaf`` is not negative.

    ``counts`` are the rows, where they are known.
    """
    out = np.zeros((2, binned.shape[0], n_leaves * bins))
    tables = out if counts is None else out[1:]
    places = np.flatnonzero(leaf >= 0)
    for at in range(0, len(places), STEP_ROWS):
        use = places[at : at + STEP_ROWS]
        base, weight = leaf[use].astype(np.int64), rest[use]
        if joint is not None and len(use) >= JOINT_SHARE * n_leaves * max(joint.cells, default=0):
            joint.add(tables, base, use, weight, n_leaves)
            continue
        base *= bins
        for f in range(binned.shape[0]):
            place = base + binned[f][use]
            if counts is None:
                out[0, f] += np.bincount(place, minlength=n_leaves * bins)
            out[1, f] += np.bincount(place, weight, minlength=n_leaves * bins)
    out = out.reshape(2, binned.shape[0], n_leaves, bins).transpose(0, 2, 1, 3)
    if counts is not None:
        out[0] = counts
    return out


def _one_side(binned, leaf, over, rest, n_leaves: int, bins: int, joint: _Joint, whole: np.ndarray) -> np.ndarray:
    """Sums of the rows right of a split, by leaf; of many rows those of the smaller side are added up."""
    none = leaf.dtype.type(-1)
    if len(leaf) < STEP_ROWS or 2 * np.count_nonzero(over) <= len(leaf):
        return _sums(binned, np.where(over, leaf, none), rest, n_leaves, bins, joint)
    return whole - _sums(binned, np.where(over, none, leaf), rest, n_leaves, bins, joint)


def _best_split(sums: np.ndarray, shrink: float) -> tuple[int, int, float]:
    """The (feature, border) with the highest gain over all leaves together; ties by position."""
    left = np.cumsum(sums, axis=3)[..., :-1]
    right = sums.sum(axis=3, keepdims=True) - left
    score = left[1] ** 2 / (left[0] + shrink) + right[1] ** 2 / (right[0] + shrink)
    whole = sums[:, :, 0, :].sum(axis=2)
    gain = score.sum(axis=0) - (whole[1] ** 2 / (whole[0] + shrink)).sum()
    # Borders that split no leaf gain nothing; rounding must not make them a split.
    gain[((left[0] > 0) & (right[0] > 0)).sum(axis=0) == 0] = 0.0
    best = int(np.argmax(gain))
    feature, border = divmod(best, gain.shape[1])
    return feature, border, float(gain[feature, border])


def _grow(
    model: BoostedTrees, binned: np.ndarray, target: np.ndarray, rounds: int, rate: float, depth: int, shrink: float
) -> Iterator[tuple]:
    """Trees after those of ``model``: splits, leaf values and gains of each."""
    rest = target - model.add(binned, np.full(len(target), model.start))
    bins = max((len(b) for b in model.borders), default=0) + 1
    joint, counts = _Joint(binned, [len(b) + 1 for b in model.borders]), None
    for _ in range(rounds):
        leaf = np.zeros(len(target), np.int8 if depth < 8 else np.int64)
        splits, gains = np.full((depth, 2), -1, np.int64), np.zeros(depth)
        sums = _sums(binned, leaf, rest, 1, bins, joint, counts)
        counts = sums[0]
        for level in range(depth):
            feature, border, gain = _best_split(sums, shrink)
            if gain <= 0:
                break
            splits[level], gains[level] = (feature, border), gain
            over = binned[feature] > border
            if level + 1 < depth:
                right = _one_side(binned, leaf, over, rest, 1 << level, bins, joint, sums)
                sums = np.concatenate((sums - right, right), axis=1)
            leaf |= over.astype(leaf.dtype) << leaf.dtype.type(level)
        size = 1 << depth
        held = np.stack([np.bincount(leaf, minlength=size), np.bincount(leaf, rest, minlength=size)])
        values = rate * held[1] / (held[0] + shrink)
        rest -= values[leaf]
        yield splits, values, gains


def _in_one_task(
    rows: DataFrame, model: BoostedTrees, rounds: int, rate: float, depth: int, shrink: float
) -> list[tuple]:
    """The next ``rounds`` trees, from one task of one Spark job."""
    size = len(model.features)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        binned, target = [np.zeros((size, 0), np.uint8)], [np.zeros(0)]
        for batch in batches:
            binned.append(model.binned(_columns(batch, size)))
            target.append(batch.column("y").to_numpy())
        grown = _grow(model, np.concatenate(binned, 1), np.concatenate(target), rounds, rate, depth, shrink)
        for splits, values, gains in grown:
            told = json.dumps([splits.tolist(), values.tolist(), gains.tolist()])
            yield pa.RecordBatch.from_pydict({"tree": [told]})

    dealt = rows.repartition(1, F.xxhash64(*rows.columns))
    return [json.loads(r[0]) for r in dealt.mapInArrow(run, "tree string").collect()]


def _blocks(rows: DataFrame, model: BoostedTrees, tasks: int) -> DataFrame:
    """Rows as stored blocks of bytes per feature and of targets, with the task that they belong to."""
    size = len(model.features)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for place, batch in enumerate(batches):
            binned, target = model.binned(_columns(batch, size)), batch.column("y").to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_pydict(
                {"part": pa.array([part], pa.int32()), "place": pa.array([place], pa.int32()),
                 "bytes": [binned.tobytes()], "targets": [target.tobytes()]}
            )

    kind = "part int, place int, bytes binary, targets binary"
    return stage(rows.mapInArrow(run, kind).repartition(tasks, "part", "place"), "baseline-blocks")


def _level_sums(state: RDD, tasks: int, splits: list, bins: int) -> np.ndarray:
    """Sums of the rows right of the last of ``splits``, by the leaf before it; of all rows without any."""

    def run(blocks):
        for binned, rest in blocks:
            leaf = _leaf(binned, splits[:-1]).astype(np.int64)
            if splits:
                leaf[binned[splits[-1][0]] <= splits[-1][1]] = -1
            yield _sums(binned, leaf, rest, 1 << max(0, len(splits) - 1), bins)

    parts = state.mapPartitions(run)
    return parts.treeReduce(np.add) if tasks > MANY_TASKS else sum(parts.collect())


def _by_jobs(
    blocks: DataFrame, model: BoostedTrees, tasks: int, rounds: int, rate: float, depth: int, shrink: float
) -> list[tuple]:
    """The next ``rounds`` trees, a Spark job per level; residuals are cached after every tree."""
    size, bins = len(model.features), max(len(b) for b in model.borders) + 1

    def load(rows):
        binned, target = [], []
        for row in rows:
            target.append(np.frombuffer(row["targets"]))
            binned.append(np.frombuffer(row["bytes"], np.uint8).reshape(size, len(target[-1])))
        if binned:
            binned, target = np.concatenate(binned, 1), np.concatenate(target)
            yield binned, target - model.add(binned, np.full(len(target), model.start))

    # Rows of a task in one order, so that the same numbers are added up whenever they are.
    dealt = blocks.repartition(tasks, "part", "place").sortWithinPartitions("part", "place")
    state = dealt.select("bytes", "targets").rdd.mapPartitions(load).persist(StorageLevel.MEMORY_AND_DISK)
    trees, used = [], [state]
    for _ in range(rounds):
        splits, gains, made = np.full((depth, 2), -1, np.int64), np.zeros(depth), []
        sums = _level_sums(state, tasks, made, bins)
        # With the first sums these residuals are cached; those before them are not needed any more.
        for before in used[:-1]:
            before.unpersist()
        used = used[-1:]
        for level in range(depth):
            feature, border, gain = _best_split(sums, shrink)
            if gain <= 0:
                held = sums[:, :, 0, :].sum(axis=2)
                break
            splits[level], gains[level] = (feature, border), gain
            made.append((feature, border))
            if level + 1 < depth:
                right = _level_sums(state, tasks, made, bins)
                sums = np.concatenate((sums - right, right), axis=1)
            else:
                left = sums[:, :, feature, : border + 1].sum(axis=2)
                held = np.concatenate((left, sums[:, :, feature].sum(axis=2) - left), axis=1)
        values = np.zeros(1 << depth)
        values[: held.shape[1]] = rate * held[1] / (held[0] + shrink)
        trees.append((splits, values, gains))
        state = state.map(partial(_after, made, values)).persist(StorageLevel.MEMORY_AND_DISK)
        used.append(state)
    for before in used:
        before.unpersist()
    return trees


def _after(splits: list, values: np.ndarray, block: tuple) -> tuple:
    """A block with the residuals that a tree leaves."""
    binned, rest = block
    return binned, rest - values[_leaf(binned, splits)]


def _with_trees(model: BoostedTrees, trees: list[tuple]) -> BoostedTrees:
    more = [np.array([t[i] for t in trees]) for i in range(3)]
    return replace(
        model,
        splits=np.concatenate((model.splits, more[0])),
        leaves=np.concatenate((model.leaves, more[1])),
        gains=np.concatenate((model.gains, more[2])),
    )


def fit_baseline(
    train: DataFrame,
    features: Sequence[str],
    target: str,
    iterations: int = 1000,
    rate: float = 0.1,
    depth: int = 6,
    bins: int = 128,
    shrink: float = 3.0,
    task_rows: int = TASK_ROWS,
) -> BoostedTrees:
    """Boosted symmetric trees for squared error, ``iterations`` of them with ``depth`` levels.

    Null and NaN features are 0; rows with a null or NaN target are left out,
    and without any row all predictions are null.  Borders are quantiles of a
    sketch with a rank error of 0.1 %, at most ``bins - 1`` (255) a feature.  A
    leaf's value is shrunk by ``shrink`` rows of value 0.  The driver gets the
    trees, and for fits of over ``task_rows`` rows the sums of every level.
    """
    spark, features = train.sparkSession, tuple(features)
    y = F.col(target).cast("double")
    rows = stage(
        train.where(y.isNotNull() & ~F.isnan(y)).select(*_filled(train, features), y.alias("y")), "baseline-rows"
    )
    count, start = rows.agg(F.count("*"), F.avg("y")).first()
    bins = min(bins, 256)
    names, at = [f"x{i}" for i in range(len(features))], [i / bins for i in range(1, bins)]
    cuts = rows.approxQuantile(names, at, 0.001) if count else [[] for _ in features]
    model = BoostedTrees(
        features, tuple(tuple(sorted(set(c))) for c in cuts), start,
        np.zeros((0, depth, 2), np.int64), np.zeros((0, 1 << depth)), np.zeros((0, depth)),
    )
    if not count or not any(model.borders):
        return model
    if count <= task_rows:
        while len(model.splits) < iterations:
            rounds = min(SEGMENT, iterations - len(model.splits))
            model = _with_trees(model, _in_one_task(rows, model, rounds, rate, depth, shrink))
        return model
    tasks = max(min(MOST_TASKS, spark.sparkContext.defaultParallelism), -(-count // (TASK_SHARE * task_rows)))
    blocks = _blocks(rows, model, tasks)
    while len(model.splits) < iterations:
        rounds = min(CACHED_ROUNDS, iterations - len(model.splits))
        model = _with_trees(model, _by_jobs(blocks, model, tasks, rounds, rate, depth, shrink))
    return model


def baseline_predictions(model: BoostedTrees, df: DataFrame, output: str) -> DataFrame:
    """Every row of ``df`` with the model's prediction; an ``output`` column that exists is an error."""
    if output.lower() in {c.lower() for c in df.columns}:
        raise ValueError(f"there is a column {output} already")
    size, names = len(model.features), [*df.columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if model.start is None:
                out = pa.nulls(batch.num_rows, pa.float64())
            else:
                held = model.binned(_columns(batch, size))
                out = pa.array(model.add(held, np.full(batch.num_rows, model.start)))
            rows = batch.column("row")
            yield pa.RecordBatch.from_arrays([rows, out], names=["row", "value"])

    row = F.struct(*(df[c] for c in names)).alias("row")
    told = df.select(row, *_filled(df, model.features))
    kind = T.StructType([told.schema["row"], T.StructField("value", T.DoubleType())])
    return told.mapInArrow(run, kind).select("row.*", F.col("value").alias(output))


def round_errors(model: BoostedTrees, df: DataFrame, target: str) -> DataFrame:
    """Summed squared error on ``df`` after every round: (round, rows, squared), round 0 the constant.

    Rows with a null or NaN target are left out; without any the result is empty.
    """
    size, rounds = len(model.features), len(model.splits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squared, seen = np.zeros(rounds + 1), 0
        for batch in batches:
            binned, target = model.binned(_columns(batch, size)), batch.column("y").to_numpy()
            out, seen = np.full(len(target), model.start), seen + len(target)
            squared[0] += ((target - out) ** 2).sum()
            for i in range(rounds):
                replace(model, splits=model.splits[i : i + 1], leaves=model.leaves[i : i + 1]).add(binned, out)
                squared[i + 1] += ((target - out) ** 2).sum()
        if seen:
            yield pa.RecordBatch.from_pydict(
                {"round": np.arange(rounds + 1), "rows": np.full(rounds + 1, seen), "squared": squared}
            )

    y = F.col(target).cast("double")
    rows = df.where(y.isNotNull() & ~F.isnan(y)).select(*_filled(df, model.features), y.alias("y"))
    if model.start is None:
        rows = rows.limit(0)
    parts = rows.mapInArrow(run, "round long, rows long, squared double")
    return parts.groupBy("round").agg(F.sum("rows").alias("rows"), F.sum("squared").alias("squared"))


def cut_to_best(model: BoostedTrees, valid: DataFrame, target: str) -> BoostedTrees:
    """The model with the rounds after which its error on ``valid`` is least, the fewest of several."""
    best = round_errors(model, valid, target).orderBy("squared", "round").first()
    rounds = best["round"] if best else len(model.splits)
    return replace(
        model, splits=model.splits[:rounds], leaves=model.leaves[:rounds], gains=model.gains[:rounds]
    )


def importances(model: BoostedTrees, df: DataFrame, top: int = 10) -> DataFrame:
    """The features that gained most, as shares of all gains: one row per feature column, ties by name."""
    gained = dict.fromkeys(model.features, 0.0)
    for (feature, _), gain in zip(model.splits.reshape(-1, 2), model.gains.reshape(-1)):
        if feature >= 0:
            gained[model.features[feature]] += float(gain)
    whole = sum(gained.values()) or 1.0
    return (
        df.sparkSession.createDataFrame([(n, v / whole) for n, v in gained.items()], "feature string, importance double")
        .orderBy(F.col("importance").desc(), "feature")
        .limit(top)
    )
