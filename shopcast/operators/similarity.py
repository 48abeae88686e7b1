"""k nearest rows: exact by units with bounds, or approximate by probed cells.

Reference rows are put into cells around pivot rows and, within a cell, into
rings by distance from the pivot.  The summary of the units (runs of rings:
count, nearest, farthest, the box around the rows) is small whatever the data
size.  A query row first meets the units of its nearest cells, which hold several
times k rows.  The k-th distance found there is its limit: it then meets only the
units that its box and the triangle inequality cannot rule out.

Query rows of neighbouring cells form a block of bounded size.  A block is in one
place; the units that any of its rows needs come to it and pass by piece by
piece, so no task holds the reference rows, and what leaves it is one row per
query row.  Pairs are never joined or shuffled as rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, fields
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from shopcast import fixed
from shopcast.functions.hashing import hash_order
from shopcast.operators.clean import min_max_scale, z_score
from shopcast.sources import open_folder, stage, temporaries, temporary_folder

METRICS = ("euclidean", "angular", "manhattan", "hamming", "dot", "cosine")
# Rank order is taken on values rounded to this many digits, ties by row id.
ORDER_DIGITS = 9
# Bounds of what the driver holds: pivots, and numbers in all pivot vectors.
MAX_PIVOTS = 4_096
MAX_PIVOT_NUMBERS = 2_000_000
ROWS_PER_CELL = 1_024
# The units of the first visit hold this many times the wanted rows; a cell holds as many at least.
FIRST_SHARE = 4
# Rows of a query block, and numbers in their vectors: as many as this, fewer while that leaves cores
# idle.  Each block is passed by the units that it needs, so more blocks mean more copies of those.
QUERY_BLOCK = 262_144
BLOCK_NUMBERS = 16_000_000
MIN_QUERY_BLOCK = 256
# Blocks per core, where there are query rows enough, and how much more than its share a block may hold.
BLOCKS_PER_CORE = 2
BLOCK_ROOM = 0.25
# Candidates, or numbers of sums, that a block of query rows holds.
HELD_NUMBERS = 4_000_000
# Cells that are looked at before all of them are put in order.
NEAR_CELLS = 16
# Of so many query rows of a block one is asked first which units the block needs.
FEW_STEP = 64
# Numbers in the vectors of a piece of a unit.
PIECE_NUMBERS = 32_768
# Inside a task, rows of a boxed part of a unit, and query rows of a boxed part of a block.
BOX_ROWS = 32
GROUP_ROWS = 64
# Boxes are worth it while they leave at most this share of the pairs; products of whole units are quick.
BOX_SHARE = 0.5
PRODUCT_SHARE = 0.04
# Numbers of a step that goes over them many times.
STEP_NUMBERS = 32_768
# Sums are added row by row while at most this share of the compared rows is inside.
SPARSE_SHARE = 0.05
# Copies are thinned out in so many parts first.
COPY_SALTS = 64
# Ring of a distance: quarter powers of two, within this range.
RING_STEP = 4
RING_RANGE = 128
# Numbers in one distance matrix inside a task.
MATRIX_NUMBERS = 4_000_000
_SLACK = 1e-7


@dataclass(frozen=True)
class Units:
    """Pivot vectors and the summary of the units the cells are cut into.

    ``probe`` is the probed cell of a unit, where such cells are asked for;
    ``low`` and ``high`` are the box around its rows, ``norm`` their greatest length.
    """

    pivots: np.ndarray
    cell: np.ndarray
    count: np.ndarray
    nearest: np.ndarray
    farthest: np.ndarray
    probe: np.ndarray
    low: np.ndarray
    high: np.ndarray
    norm: np.ndarray


def _family(metric: str) -> str:
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}")
    if metric in ("manhattan", "hamming"):
        return "l1"
    return "l2" if metric == "euclidean" else "product"


def prepare_vector(vector: Column, metric: str) -> Column:
    """The array the metric compares: bits for hamming, unit length for angles.

    A null or NaN would spread through pivots and bounds to every other row, so
    a vector that is null or holds one is an error.
    """
    refused = F.raise_error(F.lit("a vector is null or has a null or NaN: fill it before the search"))
    whole = F.when(vector.isNull(), refused.cast("array<double>")).otherwise(vector.cast("array<double>"))
    vector = F.transform(
        whole, lambda x: F.when(x.isNull() | F.isnan(x), refused.cast("double")).otherwise(x)
    )
    if metric == "hamming":
        return F.transform(vector, lambda x: F.when(x > 0.5, F.lit(1.0)).otherwise(F.lit(0.0)))
    if metric in ("angular", "cosine"):
        norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda acc, x: acc + x * x))
        floor = F.greatest(norm, F.lit(1e-10))
        return F.transform(vector, lambda x: x / floor)
    return vector


# Vectors from columns ------------------------------------------------------


def z_scored(df: DataFrame, id_col: str, columns: Sequence[str], fitted_on: DataFrame) -> DataFrame:
    """``id_col`` and ``vec``: the columns as z-scores of ``fitted_on``."""
    absent = [c for c in columns if c not in df.columns or c not in fitted_on.columns]
    if absent:
        raise ValueError(f"similarity features not found: {absent}")
    return z_score(df, columns, fitted_on).select(id_col, F.array(*columns).alias("vec"))


def min_max_scaled(
    df: DataFrame, id_col: str, columns: Sequence[str], fitted_on: DataFrame
) -> DataFrame:
    """``id_col`` and ``vec``: the columns scaled to the range of ``fitted_on``."""
    return min_max_scale(df, columns, fitted_on).select(id_col, F.array(*columns).alias("vec"))


def z_scored_array(df: DataFrame, id_col: str, array_col: str, fitted_on: DataFrame) -> DataFrame:
    """``id_col`` and ``vec``: an array column as z-scores per position."""
    filled = F.coalesce(F.col("x").cast("double"), F.lit(0.0))
    stats = (
        fitted_on.select(F.posexplode(array_col).alias("i", "x"))
        .groupBy("i")
        .agg(F.avg(filled).alias("mean"), F.stddev_pop(filled).alias("std"))
        .agg(F.array_sort(F.collect_list(F.struct("i", "mean", "std"))).alias("s"))
        .scalar()
    )
    scaled = F.zip_with(
        F.col(array_col),
        F.col("_stats"),
        lambda x, s: (F.coalesce(x.cast("double"), F.lit(0.0)) - s["mean"])
        / F.when(s["std"] == 0, F.lit(1.0)).otherwise(s["std"]),
    )
    return df.withColumn("_stats", stats).select(id_col, scaled.alias("vec"))


# Work inside tasks ---------------------------------------------------------


def _matrix(column) -> np.ndarray:
    """List column of an Arrow table as a dense matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    if not len(column):
        return np.zeros((0, 0))
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return flat.reshape(len(column), -1)


def _space(matrix: np.ndarray, family: str, top_norm: float, is_query: bool) -> np.ndarray:
    """Vectors in a metric space whose near rows are the wanted rows.

    The largest product is the nearest row after reference rows get one more
    coordinate that brings them all to the same length.
    """
    if family != "product":
        return matrix
    if is_query:
        extra = np.zeros((len(matrix), 1))
    else:
        rest = top_norm * top_norm - np.einsum("ij,ij->i", matrix, matrix)
        extra = np.sqrt(np.maximum(rest, 0.0))[:, None]
    return np.hstack([matrix, extra])


def _absolute_gaps(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    out = np.zeros((len(left), len(right)))
    for j in range(left.shape[1]):
        out += np.abs(left[:, j, None] - right[None, :, j])
    return out


def _squared_gaps(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    lengths = np.einsum("ij,ij->i", left, left)[:, None] + np.einsum("ij,ij->i", right, right)
    return np.maximum(lengths - 2.0 * (left @ right.T), 0.0)


def _distances(left: np.ndarray, right: np.ndarray, family: str) -> np.ndarray:
    return _absolute_gaps(left, right) if family == "l1" else np.sqrt(_squared_gaps(left, right))


def _parts(batch: pa.RecordBatch, width: int):
    """Slices of a batch whose distance matrix stays within bounds."""
    step = max(1, MATRIX_NUMBERS // max(1, width))
    for at in range(0, batch.num_rows, step):
        yield batch.slice(at, step)


def _nearest_pivot(part: pa.RecordBatch, space: np.ndarray, family: str, top_norm: float):
    vectors = _space(_matrix(part.column("vec")), family, top_norm, is_query=False)
    distance = _distances(vectors, space, family)
    cell = distance.argmin(axis=1)
    own = distance[np.arange(len(cell)), cell]
    with np.errstate(divide="ignore"):
        ring = np.floor(RING_STEP * np.log2(own))
    return cell, np.clip(ring, -RING_RANGE, RING_RANGE).astype(np.int32), own


def _assign(pivots, family, top_norm, probed=None):
    """Arrow map: reference rows with their cell, ring, distance to the pivot and probed cell added."""

    def run(batches):
        space = _space(pivots, family, top_norm, is_query=False)
        coarse = None if probed is None else _space(probed, family, top_norm, is_query=False)
        for batch in batches:
            for part in _parts(batch, len(pivots)):
                cell, ring, own = _nearest_pivot(part, space, family, top_norm)
                probe = np.zeros(len(cell)) if probed is None else np.concatenate(
                    [_nearest_pivot(p, coarse, family, top_norm)[0] for p in _parts(part, len(coarse))] or [[]]
                )
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(cell.astype(np.int32)), pa.array(ring), pa.array(own),
                     pa.array(probe.astype(np.int32))],
                    [*part.schema.names, "cell", "ring", "dist", "probe"],
                )

    return run


def _least_values(low, high, units: Units, family: str) -> np.ndarray:
    """The least rank value that rows of a unit can have to vectors between ``low`` and ``high``."""
    gaps = np.zeros((len(low), len(units.count)))
    near, far = np.ascontiguousarray(units.low.T), np.ascontiguousarray(units.high.T)
    step = max(1, STEP_NUMBERS // max(1, len(units.count)))
    for at in range(0, len(low), step):
        out, below, above = gaps[at : at + step], low[at : at + step], high[at : at + step]
        gap, other = np.empty_like(out), np.empty_like(out)
        for j in range(low.shape[1]):
            np.subtract(near[j], above[:, j, None], out=gap)
            np.subtract(below[:, j, None], far[j], out=other)
            np.maximum(gap, other, out=gap)
            np.maximum(gap, 0.0, out=gap)
            if family != "l1":
                np.multiply(gap, gap, out=gap)
            out += gap
    if family != "product":
        return gaps if family == "l1" else np.sqrt(gaps)
    if low is high:
        # The greatest product with a point: its numbers over 0 meet the high side, those below it the low one.
        product = -(np.maximum(low, 0.0) @ far + np.minimum(low, 0.0) @ near)
    else:
        product = np.zeros(gaps.shape)
        for j in range(low.shape[1]):
            sides = [side[:, j, None] * edge[j] for side in (low, high) for edge in (near, far)]
            product -= np.maximum.reduce(sides)
    # A product follows from the distance and both lengths, too.
    length = np.square(np.maximum(np.abs(low), np.abs(high))).sum(axis=1)[:, None]
    return np.maximum(product, (gaps - length - np.square(units.norm)) / 2)


def _room(vectors: np.ndarray, limit: np.ndarray, family: str, top_norm: float) -> np.ndarray:
    """The limits with room for rounding: near equal values count as equal when rows are ranked."""
    if family == "product":
        square = np.einsum("ij,ij->i", vectors, vectors) + top_norm * top_norm
        return limit + 4e-9 + 1e-12 * square
    return limit * (1 + _SLACK) + _SLACK * (1 + top_norm)


def _held_before(order: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Rows in the places ahead of each one, along an order of places per query row."""
    held = np.take_along_axis(np.broadcast_to(count, (len(order), count.shape[-1])), order, axis=1)
    return np.cumsum(held, axis=1) - held


def _nearest_cells(to_pivot: np.ndarray, rows: np.ndarray, need: int) -> np.ndarray:
    """Boolean matrix: the nearest cells that together hold ``need`` rows; ``rows`` per cell, or query row and cell."""
    rows = np.broadcast_to(rows, to_pivot.shape)
    chosen = np.zeros(to_pivot.shape, dtype=bool)
    rest = np.arange(len(to_pivot))
    for width in (min(NEAR_CELLS, to_pivot.shape[1]), to_pivot.shape[1]):
        near, held = to_pivot[rest], rows[rest]
        if width < near.shape[1]:
            some = np.argpartition(near, width - 1, axis=1)[:, :width]
            order = np.take_along_axis(some, np.argsort(np.take_along_axis(near, some, 1), axis=1, kind="stable"), 1)
        else:
            order = np.argsort(near, axis=1, kind="stable")
        taken = np.zeros(near.shape, dtype=bool)
        np.put_along_axis(taken, order, _held_before(order, held) < need, axis=1)
        chosen[rest] = taken
        rest = rest[np.where(taken, held, 0).sum(axis=1) < need]
        if not len(rest):
            break
    return chosen


def _probed_cells(part, probed, rows, family, top_norm, probes, need):
    """Boolean matrix: that many cells nearest to a query row, and further ones while those hold too few rows."""
    space = _space(probed, family, top_norm, is_query=False)
    to_pivot = _distances(_space(_matrix(part.column("vec")), family, top_norm, is_query=True), space, family)
    order = np.argsort(to_pivot, axis=1, kind="stable")
    taken = (np.arange(order.shape[1]) < probes) | (_held_before(order, rows) < need)
    chosen = np.zeros(order.shape, dtype=bool)
    np.put_along_axis(chosen, order, taken, axis=1)
    return chosen


def _nearest_units(part, units, space, family, top_norm, need, allowed=None, home=None):
    """Boolean matrix: the units a query row visits first; with those before, the nearest cells hold ``need`` rows.

    ``allowed`` tells which probed cells a query row may visit; ``home`` gets the nearest cells.
    """
    vectors = _space(_matrix(part.column("vec")), family, top_norm, is_query=True)
    to_pivot = _distances(vectors, space, family)
    if home is not None:
        home.append(to_pivot.argmin(axis=1).astype(np.int32))
    size = to_pivot.shape[1]
    if allowed is None:
        rows = np.bincount(units.cell, weights=units.count, minlength=size)
        return _nearest_cells(to_pivot, rows, need)[:, units.cell]
    held = np.zeros((allowed.shape[1], size))
    np.add.at(held, (units.probe, units.cell), units.count)
    return _nearest_cells(to_pivot, allowed @ held, need)[:, units.cell] & allowed[:, units.probe]


def _allowed(column, cells: int) -> np.ndarray:
    """Lists of probed cells as a boolean matrix."""
    out = np.zeros((len(column), cells), dtype=bool)
    row = np.repeat(np.arange(len(column)), column.value_lengths().to_numpy(zero_copy_only=False))
    out[row, column.flatten().to_numpy(zero_copy_only=False)] = True
    return out


def _within_limit(part, units, space, family, top_norm, known=None):
    """Boolean matrix: units not visited yet that may hold rows within the limit of a query row.

    Units that are ``known`` to be needed are not looked at.
    """
    vectors = _matrix(part.column("vec"))
    limit = part.column("limit").to_numpy(zero_copy_only=False)
    wanted = np.zeros((len(vectors), len(units.count)), dtype=bool)
    if not len(vectors):
        return wanted
    edge = _room(vectors, limit, family, top_norm)
    # What the box around all these query rows rules out need not be looked at for each of them.
    low, high = vectors.min(axis=0)[None, :], vectors.max(axis=0)[None, :]
    near = _least_values(low, high, units, family)[0] <= edge.max()
    near = np.flatnonzero(near if known is None else near & ~known)
    for at in range(0, len(near), 1024):
        some = near[at : at + 1024]
        wanted[:, some] = _least_values(vectors, vectors, _some(units, some), family) <= edge[:, None]
    if "first" in part.schema.names:
        first = part.column("first")
        row = np.repeat(np.arange(part.num_rows), first.value_lengths().to_numpy(zero_copy_only=False))
        wanted[row, first.flatten().to_numpy(zero_copy_only=False)] = False
    if "probed" in part.schema.names:
        wanted &= _allowed(part.column("probed"), int(units.probe.max()) + 1)[:, units.probe]
    return wanted


def _boxed(vectors: np.ndarray, most: int) -> list[np.ndarray]:
    """Places of the rows in parts of at most ``most``, halved where they spread most."""
    out, rest = [], [np.arange(len(vectors))]
    while rest:
        places = rest.pop()
        if len(places) <= most:
            out.append(places)
            continue
        part = vectors[places]
        along = part[:, int((part.max(axis=0) - part.min(axis=0)).argmax())]
        half = len(places) // 2
        order = np.argpartition(along, half)
        rest += [places[order[half:]], places[order[:half]]]
    return out


def _box_units(vectors: np.ndarray, parts: Sequence[np.ndarray]) -> Units:
    """Parts of a unit as units of their own: what bounds need of them."""
    order = np.concatenate(parts)
    count = np.array([len(places) for places in parts])
    starts = np.cumsum(count) - count
    square = np.einsum("ij,ij->i", vectors, vectors)[order]
    none = np.zeros(len(parts))
    return Units(
        vectors[:1], none, count, none, none, none,
        np.minimum.reduceat(vectors[order], starts), np.maximum.reduceat(vectors[order], starts),
        np.sqrt(np.maximum.reduceat(square, starts)),
    )


def _some(units: Units, places) -> Units:
    rest = (getattr(units, f.name)[places] for f in fields(units) if f.name != "pivots")
    return Units(units.pivots, *rest)


def _listed(wanted: np.ndarray) -> pa.ListArray:
    ends = np.concatenate([[0], np.cumsum(wanted.sum(axis=1))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.nonzero(wanted)[1].astype(np.int32)))


def _visits(units: Units, family, top_norm, choose, name):
    """Arrow map: query rows with the list of units that ``choose`` gives them, as column ``name``."""

    def run(batches):
        space = _space(units.pivots, family, top_norm, is_query=False)
        width = max(len(units.pivots), len(units.cell))
        for batch in batches:
            for part in _parts(batch, width):
                listed = _listed(choose(part, units, space, family, top_norm))
                yield pa.RecordBatch.from_arrays([*part.columns, listed], [*part.schema.names, name])

    return run


def _placed_queries(units: Units, family, top_norm, need, probed, rows, probes):
    """Arrow map: query rows with their nearest cell, the units they visit first and the cells they may visit."""

    def run(batches):
        space = _space(units.pivots, family, top_norm, is_query=False)
        width = max(len(units.pivots), len(units.cell), 1 if probed is None else len(probed))
        for batch in batches:
            for part in _parts(batch, width):
                home, more, allowed = [], [], None
                if probed is not None:
                    allowed = _probed_cells(part, probed, rows, family, top_norm, probes, need)
                    more = [_listed(allowed)]
                first = _nearest_units(part, units, space, family, top_norm, FIRST_SHARE * need, allowed, home)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(home[0]), _listed(first), *more],
                    [*part.schema.names, "home", "first", *(["probed"] if more else [])],
                )

    return run


def _compare_blocks(family, k, exclude_self, schema: pa.Schema):
    """Arrow function of two blocks: the k best reference rows per query row, none beyond its limit."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        queries, refs = _matrix(left.column("vec")), _matrix(right.column("vec"))
        qids, rids = left.column("qid").to_numpy(), right.column("rid").to_numpy()
        limits = left.column("limit").to_numpy()
        # Reference rows in id order, so that position breaks ties by id.
        by_id = np.argsort(rids, kind="stable")
        refs, rids = refs[by_id], rids[by_id]
        out = []
        step = max(1, MATRIX_NUMBERS // len(rids))
        for at in range(0, len(queries), step):
            part, ids = queries[at : at + step], qids[at : at + step]
            need = min(k + int(exclude_self), len(rids))
            keep = _candidates(part, refs, family, need, limits[at : at + step])
            if exclude_self:
                own = np.minimum(np.searchsorted(rids, ids), len(rids) - 1)
                same = np.nonzero(rids[own] == ids)[0]
                keep[same, own[same]] = False
            qi, ri = np.nonzero(keep)
            value = np.empty(len(qi))
            wide = max(1, MATRIX_NUMBERS // max(1, refs.shape[1]))
            for i in range(0, len(qi), wide):
                these = slice(i, i + wide)
                value[these] = _rank_value(part[qi[these]], refs[ri[these]], family)
            order = np.lexsort((ri, np.round(value, ORDER_DIGITS), qi))
            qi, ri, value = qi[order], ri[order], value[order]
            first = np.searchsorted(qi, qi, side="left")
            best = np.arange(len(qi)) - first < k
            out.append((ids[qi[best]], rids[ri[best]], value[best], by_id[ri[best]]))
        *columns, row = [np.concatenate(c) for c in zip(*out)]
        carried = [right.column(f.name).take(pa.array(row)) for f in list(schema)[3:]]
        return pa.table(
            [*[pa.array(c, f.type) for c, f in zip(columns, schema)], *carried], schema=schema
        )

    return run


def _candidates(part, refs, family, need, limit):
    """Rows that can be among the ``need`` best and within the limit, with room for rounding."""
    if need >= len(refs) and np.isinf(limit).all():
        return np.ones((len(part), len(refs)), dtype=bool)
    own = np.einsum("ij,ij->i", part, part)[:, None]
    top = np.einsum("ij,ij->i", refs, refs).max()
    if family == "product":
        near = -(part @ refs.T)
        room = 1e-12 * np.sqrt(own * top) + 4e-9
    elif family == "l1":
        near = _absolute_gaps(part, refs)
        room = 4e-9
    else:
        near = _squared_gaps(part, refs)
        room = 1e-12 * (own + top)
    edge = (limit * limit if family == "l2" else limit)[:, None]
    if need < len(refs) and np.isinf(limit).any():
        edge = np.minimum(edge, np.partition(near, need - 1, axis=1)[:, need - 1 : need])
    if family == "l2":
        room = room + 4e-9 * (2 * np.sqrt(edge) + 4e-9)
    return near <= edge + room


def _products_within(part, refs, limit) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query rows, reference rows, values) of products within the limits, with room for rounding.

    Single precision, a few rows at a time, tells which pairs are worth a second look.
    """
    own, top = np.einsum("ij,ij->i", part, part), np.einsum("ij,ij->i", refs, refs).max()
    length = np.sqrt(own * top)
    room = 4e-9 + 2.0**-22 * (part.shape[1] + 2) * length
    least = np.nextafter(-(limit + room).astype(np.float32), np.float32(-np.inf))[:, None]
    left, right, size, found = part.astype(np.float32), refs.astype(np.float32).T, len(refs), []
    step = max(1, 8 * STEP_NUMBERS // size)
    for at in range(0, len(part), step):
        found.append(np.flatnonzero((left[at : at + step] @ right >= least[at : at + step]).reshape(-1)) + at * size)
    flat = np.concatenate(found)
    qi = flat // size
    ri = flat - qi * size
    value = np.empty(len(qi))
    wide = max(1, MATRIX_NUMBERS // max(1, refs.shape[1]))
    for at in range(0, len(qi), wide):
        value[at : at + wide] = _rank_value(part[qi[at : at + wide]], refs[ri[at : at + wide]], "product")
    near = value <= (limit + 4e-9 + 1e-12 * length)[qi]
    return qi[near], ri[near], value[near]


def _rank_value(left, right, family):
    """Value to rank paired rows by: smaller is nearer."""
    if family == "product":
        return -np.einsum("ij,ij->i", left, right)
    gap = left - right
    if family == "l1":
        return np.abs(gap).sum(axis=1)
    return np.sqrt(np.einsum("ij,ij->i", gap, gap))


# The join ------------------------------------------------------------------


def _cell_rows(need: int) -> int:
    """Rows a cell should hold: several times as many as a query row wants."""
    return max(ROWS_PER_CELL, FIRST_SHARE * need)


def _pivots(
    refs: DataFrame, n_refs: int, width: int, n_pivots: int | None, seed, cell_rows: int
) -> np.ndarray:
    """A bounded set of different reference vectors, lowest in hash order."""
    wanted = n_pivots or max(1, round(n_refs / cell_rows))
    wanted = int(min(wanted, MAX_PIVOTS, max(1, MAX_PIVOT_NUMBERS // max(1, width))))
    rows = (
        refs.select("vec", hash_order(["rid"], seed).alias("h")).orderBy("h").limit(wanted).collect()
    )
    return np.unique(np.array([r["vec"] for r in rows], dtype=np.float64), axis=0)


def _packed(batches, names: Sequence[str]) -> Iterator[tuple[int, bytes]]:
    """Rows in order of ``unit`` as (unit, Arrow value of a bounded number of its rows)."""
    for batch in batches:
        unit, rows = batch.column("unit").to_numpy(), batch.select(names)
        edges = [0, *(np.flatnonzero(np.diff(unit)) + 1).tolist(), len(unit)]
        step = max(1, PIECE_NUMBERS // max(1, _matrix(rows.column("vec").slice(0, 1)).shape[1]))
        for a, b in zip(edges, edges[1:]):
            for at in range(a, b, step):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, rows.schema) as out:
                    out.write_batch(rows.slice(at, min(step, b - at)))
                yield int(unit[a]), sink.getvalue().to_pybytes()


def _pieces(refs: DataFrame) -> DataFrame:
    """``unit`` and, as one Arrow value, up to a bounded number of its rows: they pass a block as one row."""
    names = [c for c in refs.columns if c != "unit"]

    def run(batches):
        for unit, value in _packed(batches, names):
            yield pa.RecordBatch.from_arrays([pa.array([unit], pa.int32()), pa.array([value], pa.binary())], ["unit", "ref"])

    rows = refs.repartition("unit").sortWithinPartitions("unit")
    return stage(rows.mapInArrow(run, "unit int, ref binary"), "pieces")


def _placed_pieces(refs: DataFrame) -> tuple[DataFrame, str | None]:
    """The pieces, or their places in files of the folder that comes second: a block reads them there, so that
    no copy of a piece is shuffled. Without a folder that tasks can read in, the pieces themselves."""
    folder = temporary_folder(refs.sparkSession, "piece-files")
    if folder is None:
        return _pieces(refs), None
    names = [c for c in refs.columns if c != "unit"]

    def run(batches):
        store, base = open_folder(folder)
        # A name of its own: what an attempt that failed has written is never read.
        name, at, out, told = f"{TaskContext.get().partitionId()}-{uuid.uuid4().hex}", 0, None, []
        try:
            for unit, value in _packed(batches, names):
                out = out or store.open_output_stream(f"{base}/{name}")
                out.write(value)
                told.append((unit, name, at, len(value)))
                at += len(value)
        finally:
            if out is not None:
                out.close()
        if told:
            unit, file, start, size = zip(*told)
            ref = pa.StructArray.from_arrays(
                [pa.array(file), pa.array(start, pa.int64()), pa.array(size, pa.int64())], ["file", "start", "size"]
            )
            yield pa.RecordBatch.from_arrays([pa.array(unit, pa.int32()), ref], ["unit", "ref"])

    rows = refs.repartition("unit").sortWithinPartitions("unit")
    kind = "unit int, ref struct<file: string, start: bigint, size: bigint>"
    return stage(rows.mapInArrow(run, kind), "pieces"), folder


def _read_pieces(refs, folder: str | None, files: dict) -> Iterator[pa.RecordBatch]:
    """The rows of pieces, which are given themselves or by their places in files; ``files`` are those open."""
    if folder is None:
        for piece in refs:
            yield from pa.ipc.open_stream(piece.as_buffer())
        return
    for piece in refs.to_pylist():
        if piece["file"] not in files:
            # One at a time: the pieces of a unit are in one file.
            for held in files.values():
                held.close()
            files.clear()
            store, base = open_folder(folder)
            files[piece["file"]] = store.open_input_file(f"{base}/{piece['file']}")
        yield from pa.ipc.open_stream(files[piece["file"]].read_at(piece["size"], piece["start"]))


def _boxes(refs: DataFrame) -> dict[int, tuple]:
    """Lowest and highest number by place, and greatest length, of the rows of each ``unit``."""

    def run(batches):
        held = {}
        for batch in batches:
            vectors, unit = _matrix(batch.column("vec")), batch.column("unit").to_numpy()
            order = np.argsort(unit, kind="stable")
            names, starts = np.unique(unit[order], return_index=True)
            if not len(names):
                continue
            square = np.einsum("ij,ij->i", vectors, vectors)[order]
            low = np.minimum.reduceat(vectors[order], starts)
            high = np.maximum.reduceat(vectors[order], starts)
            for name, *one in zip(names.tolist(), low, high, np.maximum.reduceat(square, starts)):
                old = held.get(name)
                held[name] = one if old is None else [
                    np.minimum(old[0], one[0]), np.maximum(old[1], one[1]), max(old[2], one[2])
                ]
        if held:
            low, high, square = zip(*held.values())
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(held), pa.int32()), _lists(np.array(low)), _lists(np.array(high)),
                 pa.array(np.sqrt(np.array(square)))],
                ["unit", "low", "high", "norm"],
            )

    kind = "unit int, low array<double>, high array<double>, norm double"
    rows = refs.select("unit", "vec").repartition("unit").mapInArrow(run, kind).collect()
    return {r["unit"]: (r["low"], r["high"], r["norm"]) for r in rows}


def _build_units(
    refs: DataFrame, pivots, family, top_norm, cell_rows: int, probed: np.ndarray | None = None
) -> tuple[Units, DataFrame]:
    """Units of neighbouring rings of a cell, and the reference rows with their unit.

    The cell and ring of a row are stored once, so that the summary and the rows
    agree whichever machine computes them.  What is collected has at most one
    row per pivot and ring.  ``probed`` are pivots of cells that units stay within.
    """
    schema = T.StructType(
        [
            *refs.schema.fields,
            T.StructField("cell", T.IntegerType()),
            T.StructField("ring", T.IntegerType()),
            T.StructField("dist", T.DoubleType()),
            T.StructField("probe", T.IntegerType()),
        ]
    )
    placed = stage(refs.mapInArrow(_assign(pivots, family, top_norm, probed), schema), "placed")
    rings = (
        placed.groupBy("cell", "probe", "ring")
        .agg(F.count(F.lit(1)).alias("n"), F.min("dist").alias("lo"), F.max("dist").alias("hi"))
        .collect()
    )
    merged: list[list] = []
    unit_of = []
    for row in sorted(rings, key=lambda r: (r["cell"], r["probe"], r["ring"])):
        last = merged[-1] if merged else None
        if last and last[:2] == [row["cell"], row["probe"]] and last[2] + row["n"] <= cell_rows // 2:
            last[2] += row["n"]
            last[3], last[4] = min(last[3], row["lo"]), max(last[4], row["hi"])
        else:
            merged.append([row["cell"], row["probe"], row["n"], row["lo"], row["hi"]])
        unit_of.append((row["cell"], row["probe"], row["ring"], len(merged) - 1))
    table = refs.sparkSession.createDataFrame(unit_of, "cell int, probe int, ring int, unit int")
    rows = placed.join(F.broadcast(table), ["cell", "probe", "ring"]).drop("cell", "probe", "ring", "dist")
    boxes = _boxes(rows)
    cell, probe, count, lo, hi = (np.array(column) for column in zip(*merged))
    low, high, norm = (np.array(column) for column in zip(*(boxes[i] for i in range(len(merged)))))
    return Units(pivots, cell, count, lo, hi, probe, low, high, norm), rows


def nearest(
    queries: DataFrame,
    refs: DataFrame | None,
    query_id: str,
    ref_id: str,
    k: int,
    metric: str = "euclidean",
    exclude_self: bool = False,
    probes: int | None = None,
    n_pivots: int | None = None,
    seed: int | str = 42,
    carry: Sequence[str] = (),
    ranks: Sequence[int] | None = None,
) -> DataFrame:
    """The ``k`` nearest reference rows of every query row, by their ``vec`` columns.

    Gives query_id, ref_id, rank, distance, score.  Exact for ``probes=None``;
    otherwise that many cells nearest to the query are compared, and further ones
    until they hold ``k`` rows, so that every query row gets as many as there are.
    ``score`` is ``exp(-distance)``, the cosine for ``cosine``, and null for
    ``dot``, whose distance column holds the product itself.  The two id
    columns have different names; vectors have no nulls.  With ``refs=None`` the
    query rows are searched among themselves.  ``carry`` names columns of the
    reference rows that come along with each neighbour, so that no join with
    the reference table has to follow.  With ``ranks`` only the neighbours in
    these places are returned, the last one for places beyond it.
    """
    family = _family(metric)
    if query_id == ref_id:
        raise ValueError("query and reference ids need different column names")
    ready = prepare_vector(F.col("vec"), metric).alias("vec")
    with_it = [F.col(c).alias(f"carry_{i}") for i, c in enumerate(carry)]
    if refs is None:
        both = stage(queries.select(F.col(query_id).alias("qid"), ready, *with_it), "vectors")
        q = both.select("qid", "vec")
    else:
        id_type = refs.schema[ref_id].dataType
        q = stage(
            queries.select(F.col(query_id).cast(id_type).alias("qid"), ready), "query-vectors"
        )
    # Rows wanted per query before the query itself is taken out.
    need = k + int(exclude_self)
    # Equal query rows have equal neighbours: search once, then hand out.
    lead = q.groupBy(F.xxhash64("vec").alias("hash"), "vec").agg(F.min("qid").alias("qid")).drop("hash")
    lead = stage(lead, "different-vectors")
    alone = lead.count() == q.count()
    # What the search stores on its way is gone when its result is stored.
    with temporaries(queries.sparkSession) as made:
        if refs is None:
            r = both.withColumnRenamed("qid", "rid")
        else:
            r = stage(refs.select(F.col(ref_id).alias("rid"), ready, *with_it), "reference-vectors")
        # Of rows that all differ there are no copies to leave out.
        r = r if refs is None and alone else _lowest_copies(r, need)
        head = _head(r)
        if not head["n"]:
            best = q.sparkSession.createDataFrame([], _result_type(r)).withColumn("rank", F.lit(1))
            return _scored(best, query_id, ref_id, metric, carry)
        places = None if ranks is None else sorted({min(rank, head["n"] - int(exclude_self)) for rank in ranks})
        again = _repeated(q)
        told = None if exclude_self or again else places
        found = _search(lead, r, head, family, need, False, probes, n_pivots, seed, told)
        found = made.kept(stage(found, "found"))
    best = _handed_out(q, None if alone else lead, found, k, need, exclude_self, again, places)
    return _scored(best, query_id, ref_id, metric, carry)


def _repeated(q: DataFrame) -> bool:
    """Whether an id stands for several query rows."""
    counts = q.where(F.col("qid").isNotNull()).groupBy("qid").agg(F.count(F.lit(1)).alias("n"))
    return not counts.where("n > 1").isEmpty()


def _handed_out(
    q: DataFrame, lead: DataFrame | None, found: DataFrame, k: int, need: int, exclude_self: bool, again: bool,
    places=None,
) -> DataFrame:
    """Ranked rows of every query row from ``near`` of the row that was searched for all with its vector.

    Without ``lead`` every row was searched for itself.
    Query rows that share an id are ranked together: it has ``k`` rows in all.
    """
    if lead is None:
        shared = q.select(F.col("qid").alias("own"), "qid")
    else:
        # A hash is sorted by quickly, an array number by number.
        by = [F.xxhash64("vec").alias("hash"), "vec"]
        shared = q.select(F.col("qid").alias("own"), *by).join(lead.select("qid", *by), ["hash", "vec"])
        shared = shared.select("own", "qid")
    if again:
        best = _top(found.select("qid", F.inline("near")).drop("rank"), need).drop("rank")
        best = shared.join(best, "qid").drop("qid").withColumnRenamed("own", "qid")
        best = _top(best.where(F.col("qid") != F.col("rid")) if exclude_self else best, k)
        return best if places is None else best.where(F.col("rank").isin(places))
    if lead is None:
        best = found.where(F.col("qid").isNotNull())
    else:
        best = shared.join(found, "qid").select(F.col("own").alias("qid"), "near")
    if not exclude_self:
        best = best.select("qid", F.inline("near"))
        return best if places is None else best.where(F.col("rank").isin(places))
    others = F.slice(F.filter("near", lambda x: x["rid"] != F.col("qid")), 1, k)
    best = best.select("qid", F.posexplode(others).alias("place", "one"))
    best = best.select("qid", "one.*", "place").withColumn("rank", F.col("place") + 1).drop("place")
    return best if places is None else best.where(F.col("rank").isin(places))


def _result_type(refs: DataFrame) -> T.StructType:
    id_type = refs.schema["rid"].dataType
    return T.StructType(
        [
            T.StructField("qid", id_type),
            T.StructField("rid", id_type),
            T.StructField("value", T.DoubleType()),
            *[f for f in refs.schema.fields if f.name not in ("rid", "vec")],
        ]
    )


def _head(rows: DataFrame):
    norm = F.aggregate("vec", F.lit(0.0), lambda acc, x: acc + x * x)
    return rows.agg(
        F.count(F.lit(1)).alias("n"),
        F.max(F.size("vec")).alias("width"),
        F.sqrt(F.max(norm)).alias("norm"),
    ).first()


def _lowest_copies(refs: DataFrame, need: int) -> DataFrame:
    """Of equal reference rows only the lowest ids can be among the nearest.

    Copies are thinned per salt first, so that no task gets all of a large group.
    """
    salt = F.pmod(F.xxhash64("rid"), F.lit(COPY_SALTS))
    refs = refs.withColumn("hash", F.xxhash64("vec"))
    for keys in (["hash", "vec", salt], ["hash", "vec"]):
        order = Window.partitionBy(*keys).orderBy("rid")
        refs = refs.withColumn("copy", F.row_number().over(order)).where(F.col("copy") <= need)
        refs = refs.drop("copy")
    return stage(refs.drop("hash"), "lowest-copies")


def _search(
    q: DataFrame, r: DataFrame, head, family, k, exclude_self, probes, n_pivots, seed, ranks=None
) -> DataFrame:
    """Every query row (qid) with its ``k`` best as ``near``, or those at ``ranks``: structs of rid, value, rank and more."""
    top_norm = float(head["norm"])
    need = k + int(exclude_self)
    cell_rows = _cell_rows(need)
    probed = None if probes is None else _pivots(r, head["n"], head["width"], n_pivots, seed, cell_rows)
    pivots = _pivots(r, head["n"], head["width"], None if probes else n_pivots, seed, cell_rows)
    units, rows = _build_units(r, pivots, family, top_norm, cell_rows, probed)
    placed, folder = _placed_pieces(rows)
    blocks, names = _query_blocks(q, units, family, top_norm, need, head["n"], probed, probes)
    count = max(names) + 1
    # Of a table of one cell nothing is worth ruling out.
    if probes is None and len(pivots) == 1:
        limited = blocks.withColumn("limit", F.lit(float("inf")))
    else:
        asked = blocks.withColumn("limit", F.lit(float("inf")))
        first = asked.select("block", F.explode("first").alias("unit")).distinct()
        keep = [c for c in blocks.columns if c != "first"]
        limited = asked.select(*keep, "limit", "first")
        state = partial(_Limits, need, exclude_self, family, top_norm)
        kind = T.StructType([asked.schema[c] for c in (*keep, "limit")])
        limited = stage(_met(limited, placed, first, count, state, kind, folder), "limits")
    needed = _needed(limited, units, family, top_norm)
    state = partial(_Best, need, exclude_self, family, units, top_norm, k, ranks)
    near = T.StructType(
        [*(f for f in _result_type(r).fields if f.name != "qid"), T.StructField("rank", T.IntegerType())]
    )
    kind = T.StructType([q.schema["qid"], T.StructField("near", T.ArrayType(near))])
    return _met(limited.drop("first"), placed, needed, count, state, kind, folder)


def _query_blocks(
    q: DataFrame, units: Units, family, top_norm, need, held, probed=None, probes=None
) -> tuple[DataFrame, list[int]]:
    """Query rows with the block of neighbouring rows that they are searched in, stored in its order; blocks."""
    spark = q.sparkSession
    rows = None if probed is None else np.bincount(units.probe, weights=units.count, minlength=len(probed))
    lists = T.ArrayType(T.IntegerType())
    kind = T.StructType(
        [
            *q.schema.fields,
            T.StructField("home", T.IntegerType()),
            T.StructField("first", lists),
            *([] if probed is None else [T.StructField("probed", lists)]),
        ]
    )
    # Computed again, a row could get another block: stored once.
    homed = stage(q.mapInArrow(_placed_queries(units, family, top_norm, need, probed, rows, probes), kind), "homes")
    counts = homed.groupBy("home").agg(F.count(F.lit(1)).alias("n")).collect()
    if not counts:
        return homed.withColumn("block", F.lit(0)), [0]
    whole = sum(c["n"] for c in counts)
    share = whole // (BLOCKS_PER_CORE * spark.sparkContext.defaultParallelism)
    # A block's candidates are bounded; what it compares them with is not held.
    wide = BLOCK_NUMBERS // max(1, units.pivots.shape[1])
    most = max(MIN_QUERY_BLOCK, min(QUERY_BLOCK, wide, HELD_NUMBERS // min(need, held), share))
    table = _bisected(units.pivots, [(c["home"], c["n"]) for c in counts], most)
    names = [block + i for _, block, parts in table for i in range(parts)]
    dealt = homed.join(F.broadcast(spark.createDataFrame(table, "home int, from int, parts int")), "home")
    block = (F.col("from") + F.pmod(F.xxhash64("qid"), F.col("parts"))).cast("int").alias("block")
    blocks = dealt.select(block, *homed.columns)
    ordered = blocks.repartitionById(max(names) + 1, F.col("block")).sortWithinPartitions("block", "home")
    return stage(ordered, "query-blocks"), names


def _bisected(pivots: np.ndarray, counts: Sequence[tuple[int, int]], most: int) -> list[tuple[int, int, int]]:
    """(cell, first block, blocks): cells cut where they spread most, into blocks of nearly ``most`` rows or one cell."""
    out, block, rest = [], 0, [sorted(counts)]
    while rest:
        cells = rest.pop()
        weight = np.array([n for _, n in cells])
        parts = max(1, int(np.ceil(weight.sum() / most - BLOCK_ROOM)))
        if len(cells) == 1 or parts == 1:
            out += [(cell, block, parts) for cell, _ in cells]
            block += parts
            continue
        points = pivots[[cell for cell, _ in cells]]
        order = np.argsort(points[:, int(np.ptp(points, axis=0).argmax())], kind="stable")
        # As many whole blocks on one side as on the other, or one more.
        before, share = np.cumsum(weight[order]), (parts // 2) / parts
        cut = int(np.clip(np.abs(before - before[-1] * share).argmin() + 1, 1, len(cells) - 1))
        rest += [[cells[i] for i in order[cut:]], [cells[i] for i in order[:cut]]]
    return out


def _needed(limited: DataFrame, units: Units, family, top_norm) -> DataFrame:
    """(block, unit): the units that any query row of a block needs."""
    asked = limited.select("block", *[c for c in ("vec", "limit", "probed") if c in limited.columns])

    def run(batches):
        space, width = _space(units.pivots, family, top_norm, is_query=False), len(units.count)
        for batch in batches:
            block = batch.column("block").to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(block)]
            for a, b in zip(edges, edges[1:]):
                found = np.zeros(width, dtype=bool)
                whole = batch.slice(a, b - a)
                # Any row of the block will do: a few rows, dealt over it, find most of the units.
                few = whole.take(pa.array(np.arange(0, whole.num_rows, FEW_STEP)))
                # The box around rows that lie together rules out most of the rest for all of them.
                together = _boxed(_matrix(whole.column("vec")), GROUP_ROWS)
                for rows in (few, *(whole.take(pa.array(places)) for places in together)):
                    for part in _parts(rows, width):
                        found |= _within_limit(part, units, space, family, top_norm, found).any(axis=0)
                unit = np.flatnonzero(found)
                if len(unit):
                    names = [pa.array(np.full(len(unit), block[a], np.int32)), pa.array(unit.astype(np.int32))]
                    yield pa.RecordBatch.from_arrays(names, ["block", "unit"])

    return stage(asked.mapInArrow(run, "block int, unit int").distinct(), "needed-units")


def _met(
    queries: DataFrame, placed: DataFrame, needed: DataFrame, blocks: int, state: Callable, kind: T.StructType,
    folder: str | None = None,
) -> DataFrame:
    """What ``state`` makes of the query rows of a block as the rows of the needed units pass by.

    A block's query rows come first, in the order of their cells; then its units,
    as pieces or as the places of pieces in files of ``folder``.
    """
    asked = queries.withColumn("unit", -1 - F.col("home") if "home" in queries.columns else F.lit(-1))
    passing = needed.join(placed, "unit").select("block", "unit", "ref")
    first = F.struct(*[c for c in asked.columns if c != "unit"]).alias("query")
    rows = asked.select("block", "unit", first).unionByName(passing, allowMissingColumns=True)
    rows = rows.repartitionById(blocks, F.col("block")).sortWithinPartitions("block", "unit")
    schema = to_arrow_schema(kind)

    def run(batches):
        block, held, now, files = None, [], None, {}
        for batch in batches:
            of, unit = batch.column("block").to_numpy(), batch.column("unit").to_numpy()
            edges = np.flatnonzero((np.diff(of) != 0) | (np.diff(np.maximum(unit, -1)) != 0)) + 1
            edges = [0, *edges.tolist(), len(of)]
            for a, b in zip(edges, edges[1:]):
                if a == b:
                    continue
                if of[a] != block:
                    if held:
                        yield from (now or state(schema, held)).finish()
                    block, held, now = of[a], [], None
                part = batch.slice(a, b - a)
                if unit[a] < 0:
                    held.append(pa.RecordBatch.from_struct_array(part.column("query")))
                elif held:
                    now = now or state(schema, held)
                    for refs in _read_pieces(part.column("ref"), folder, files):
                        now.meet(int(unit[a]), refs)
        if held:
            yield from (now or state(schema, held)).finish()
        for file in files.values():
            file.close()

    return rows.mapInArrow(run, kind)


class _Block:
    """Query rows of a block, and the candidates met so far."""

    def __init__(self, need, exclude_self, family, top_norm, schema, held):
        self.need, self.exclude_self, self.family, self.schema = need, exclude_self, family, schema
        self.top_norm, self.held = top_norm, 0
        self.rows = pa.Table.from_batches(held).combine_chunks()
        self.vectors = _matrix(self.rows.column("vec"))
        self.limit = self.rows.column("limit").to_numpy().copy()
        self.ids = self.rows.column("qid").to_numpy() if exclude_self else None
        # Beyond these lengths products are no numbers of single precision.
        self.single = max(top_norm, np.abs(self.vectors).max(initial=0.0)) < 1e15
        self.found, self.taken, self.size, self.room = [], [], 0, max(HELD_NUMBERS, 2 * need * len(self.limit))

    def chosen(self, unit: int) -> np.ndarray:
        """Places of the query rows that meet a unit."""
        raise NotImplementedError

    def needs(self, places: np.ndarray, units: Units) -> np.ndarray:
        """Boolean matrix: units that may hold rows within the limits of the query rows in ``places``."""
        part = self.vectors[places]
        room = _room(part, self.limit[places], self.family, self.top_norm)
        return _least_values(part, part, units, self.family) <= room[:, None]

    def pairs(self, ask: np.ndarray, vectors: np.ndarray):
        """(query rows, reference rows) to compare: in boxes of a few rows, where those rule out enough."""
        whole, few = [(ask, None)], ask[::FEW_STEP]
        if len(vectors) <= BOX_ROWS or not np.isfinite(self.limit[few]).any():
            return whole
        parts = _boxed(vectors, BOX_ROWS)
        boxes = _box_units(vectors, parts)
        if self.needs(few, boxes).mean() > (PRODUCT_SHARE if self.family == "product" and self.single else BOX_SHARE):
            return whole
        step = max(1, MATRIX_NUMBERS // len(parts))
        rows = (ask[at : at + step] for at in range(0, len(ask), step))
        wanted = np.concatenate([self.needs(places, boxes) for places in rows])
        return [(ask[wanted[:, i]], places) for i, places in enumerate(parts) if wanted[:, i].any()]

    def meet(self, unit: int, refs: pa.RecordBatch) -> None:
        ask = self.chosen(unit)
        if not len(ask):
            return
        vectors, rows = _matrix(refs.column("vec")), refs.drop_columns(["vec"])
        for places, box in self.pairs(ask, vectors):
            self.compare(places, vectors if box is None else vectors[box], box, rows)

    def compare(self, ask: np.ndarray, vectors: np.ndarray, box, rows: pa.RecordBatch) -> None:
        """Candidates of the query rows among ``vectors``, which are ``rows`` or those in places ``box`` of them."""
        step = max(1, MATRIX_NUMBERS // len(vectors))
        for at in range(0, len(ask), step):
            places = ask[at : at + step]
            part = self.vectors[places]
            if self.family == "product" and self.single and np.isfinite(self.limit[places]).all():
                qi, ri, value = _products_within(part, vectors, self.limit[places])
            else:
                qi, ri, value = self.near(part, vectors, self.limit[places])
            if not len(qi):
                continue
            met = np.zeros(len(vectors), bool)
            met[ri] = True
            used, place = np.flatnonzero(met), np.cumsum(met) - 1 + self.held
            self.found.append((places[qi].astype(np.int32), value, place[ri].astype(np.int32)))
            self.taken.append(rows.take(pa.array(used if box is None else box[used])))
            self.held += len(used)
            self.size += len(qi)
            if self.size > self.room:
                self.cut()

    def near(self, part, vectors, limit) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query rows, reference rows, values) of candidates."""
        qi, ri = np.nonzero(_candidates(part, vectors, self.family, min(self.need, len(vectors)), limit))
        value = np.empty(len(qi))
        wide = max(1, MATRIX_NUMBERS // max(1, vectors.shape[1]))
        for i in range(0, len(qi), wide):
            these = slice(i, i + wide)
            value[these] = _rank_value(part[qi[these]], vectors[ri[these]], self.family)
        return qi, ri, value

    def cut(self, last: bool = False) -> None:
        """Keep what can be among the best; the limits follow. With ``last`` the best, in order of query row, value and id."""
        if not self.found:
            return
        qi, value, place = (np.concatenate(c) for c in zip(*self.found))
        taken = pa.Table.from_batches(self.taken).combine_chunks()
        self.found, self.taken = [], []
        if self.exclude_self:
            other = taken.column("rid").to_numpy()[place] != self.ids[qi]
            qi, value, place = qi[other], value[other], place[other]
        # Beyond the last of the wanted values nothing is needed; what equals it is told apart by id.
        rows, (ranked, order) = len(self.limit), (np.round(value, ORDER_DIGITS), _stable(qi))
        count = np.bincount(qi, minlength=rows)
        edge, starts, sorted_values = np.full(rows, np.inf), np.cumsum(count) - count, ranked[order]
        for these, at, real in _padded(np.flatnonzero(count > self.need), count, starts):
            values = np.where(real, sorted_values[at], np.inf)
            edge[these] = np.partition(values, self.need - 1, axis=1)[:, self.need - 1]
        full = np.flatnonzero(count >= self.need)
        exact = full[np.isinf(edge[full])]
        for these, at, _ in _padded(exact, count, starts):
            edge[these] = sorted_values[at].max(axis=1)
        self.limit[full] = np.minimum(self.limit[full], edge[full] + 10.0**-ORDER_DIGITS)
        order = order[sorted_values <= np.repeat(edge, count)]
        if last or len(order) > 0.75 * self.room:
            rid = pa.compute.rank(taken.column("rid"), sort_keys="ascending", tiebreaker="dense").to_numpy()
            by_id = _stable(rid[place[order]])
            order = order[by_id]
            order = order[_stable(qi[order])]
            count = np.bincount(qi[order], minlength=rows)
            starts, sorted_values = np.cumsum(count) - count, ranked[order]
            within = np.arange(len(order))
            for _, at, real in _padded(np.flatnonzero(count), count, starts):
                by_value = np.argsort(np.where(real, sorted_values[at], np.inf), axis=1, kind="stable")
                within[at[real]] = np.take_along_axis(at, by_value, axis=1)[real]
            self.at = np.arange(len(order)) - np.repeat(starts, count)
            best = self.at < self.need
            order, self.at = order[within][best], self.at[best]
        qi, value, place = qi[order], value[order], place[order]
        met = np.zeros(taken.num_rows, bool)
        met[place] = True
        used, place = np.flatnonzero(met), (np.cumsum(met) - 1)[place].astype(np.int32)
        self.taken = taken.take(pa.array(used)).combine_chunks().to_batches()
        self.found, self.size, self.held = [(qi, value, place)], len(qi), len(used)


def _stable(numbers: np.ndarray) -> np.ndarray:
    """Places of numbers from 0 on in ascending order, equal ones as they come: 16 bits at a time, by counting."""
    order = np.argsort((numbers & 0xFFFF).astype(np.uint16), kind="stable")
    if not len(numbers) or numbers.max() <= 0xFFFF:
        return order
    high = (numbers[order] >> 16).astype(np.int64)
    return order[np.argsort(high.astype(np.uint16) if high.max() <= 0xFFFF else high, kind="stable")]


def _padded(rows: np.ndarray, count: np.ndarray, starts: np.ndarray):
    """(rows, places, which are real): places of the entries of some rows as a matrix of bounded size, rows of like counts together."""
    rows = rows[np.argsort(-count[rows], kind="stable")]
    while len(rows):
        width = max(1, int(count[rows[0]]))
        these, rows = np.split(rows, [max(1, MATRIX_NUMBERS // width)])
        within = np.arange(width)
        real = within < count[these][:, None]
        yield these, starts[these][:, None] + np.where(real, within, 0), real


class _Limits(_Block):
    """Limits from the units that are visited first: of a query row's values only the least are held, without rows."""

    def __init__(self, need, exclude_self, family, top_norm, schema, held):
        super().__init__(need, exclude_self, family, top_norm, schema, held)
        first = self.rows.column("first").combine_chunks()
        row = np.repeat(np.arange(len(first)), first.value_lengths().to_numpy(zero_copy_only=False))
        unit = first.flatten().to_numpy(zero_copy_only=False)
        order = np.argsort(unit, kind="stable")
        self.unit, self.row = unit[order], row[order]
        self.values = np.full((len(self.limit), min(2 * need, 64)), np.inf)
        self.count = np.zeros(len(self.limit), np.int64)

    def chosen(self, unit):
        return self.row[slice(*np.searchsorted(self.unit, [unit, unit + 1]))]

    def compare(self, ask, vectors, box, rows):
        step = max(1, MATRIX_NUMBERS // len(vectors))
        top = np.einsum("ij,ij->i", vectors, vectors).max()
        for at in range(0, len(ask), step):
            places = ask[at : at + step]
            part = self.vectors[places]
            # Never less than the values that rows are ranked by, but for the room that limits get.
            if self.family == "product":
                near = -(part @ vectors.T)
            elif self.family == "l1":
                near = _absolute_gaps(part, vectors)
            else:
                own = np.einsum("ij,ij->i", part, part)[:, None]
                near = np.sqrt(_squared_gaps(part, vectors) + 1e-12 * (own + top))
            self.hold(places, near)

    def hold(self, places: np.ndarray, near: np.ndarray) -> None:
        """Put values to those of their query rows; where there is no room, the greatest give way."""
        if near.shape[1] > self.need:
            near = np.partition(near, self.need - 1, axis=1)[:, : self.need]
        more = near.shape[1]
        while (most := int(self.count[places].max()) + more) > self.values.shape[1] and self.values.shape[1] < 2 * self.need:
            wide = min(2 * self.need, max(most, 2 * self.values.shape[1])) - self.values.shape[1]
            self.values = np.hstack([self.values, np.full((len(self.values), wide), np.inf)])
        self.least(places[self.count[places] + more > self.values.shape[1]])
        self.values[places[:, None], self.count[places][:, None] + np.arange(more)] = near
        self.count[places] += more

    def least(self, places: np.ndarray) -> None:
        """Keep as many values as are wanted; the last of them is the limit."""
        places = places[self.count[places] >= self.need]
        step = max(1, MATRIX_NUMBERS // self.values.shape[1])
        for at in range(0, len(places), step):
            some = places[at : at + step]
            held = np.partition(self.values[some], self.need - 1, axis=1)
            held[:, self.need :] = np.inf
            self.values[some], self.count[some] = held, self.need
            self.limit[some] = np.minimum(self.limit[some], held[:, self.need - 1])

    def finish(self):
        self.least(np.arange(len(self.limit)))
        columns = [pa.array(self.limit) if n == "limit" else self.rows.column(n) for n in self.schema.names]
        yield from pa.table(columns, self.schema.names).cast(self.schema).to_batches()


class _Best(_Block):
    """The best rows of all units within the limits."""

    def __init__(self, need, exclude_self, family, units, top_norm, k, ranks, schema, held):
        super().__init__(need, exclude_self, family, top_norm, schema, held)
        self.units, self.k, self.ranks = units, k, ranks
        # Query rows that lie together are looked at as one first; limits only get lower later.
        parts = _boxed(self.vectors, GROUP_ROWS)
        self.order = np.concatenate(parts)
        self.group = np.repeat(np.arange(len(parts)), [len(places) for places in parts])
        boxes = _box_units(self.vectors, parts)
        starts = np.cumsum(boxes.count) - boxes.count
        room = _room(self.vectors, self.limit, family, top_norm)[self.order]
        self.groups = boxes.low, boxes.high, np.maximum.reduceat(room, starts)
        probed = self.rows.column("probed").combine_chunks() if "probed" in self.rows.column_names else None
        self.allowed = None if probed is None else _allowed(probed, int(units.probe.max()) + 1)

    def chosen(self, unit):
        one, (low, high, room) = _some(self.units, [unit]), self.groups
        near = _least_values(low, high, one, self.family)[:, 0] <= room
        places = np.sort(self.order[near[self.group]])
        wanted = self.needs(places, one)[:, 0]
        if self.allowed is not None:
            wanted &= self.allowed[places, one.probe[0]]
        return places[wanted]

    def finish(self):
        self.cut(last=True)
        if not self.found:
            return
        (qi, value, place), rank = self.found[0], self.at + 1
        wanted = rank <= self.k
        if self.ranks is not None:
            wanted &= np.isin(rank, self.ranks)
        qi, value, place, rank = qi[wanted], value[wanted], place[wanted], rank[wanted]
        taken = pa.Table.from_batches(self.taken).take(pa.array(place)).combine_chunks()
        kind = self.schema.field("near").type.value_type
        columns = {**{n: taken.column(n) for n in taken.column_names}, "value": pa.array(value), "rank": pa.array(rank)}
        arrays = []
        for field in kind:
            column = columns[field.name]
            column = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
            arrays.append(column.cast(field.type))
        ends = np.searchsorted(qi, np.arange(self.rows.num_rows + 1)).astype(np.int32)
        near = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(arrays, fields=list(kind)))
        out = pa.table([self.rows.column("qid"), near.cast(self.schema.field("near").type)], ["qid", "near"])
        for at in range(0, out.num_rows, 4_096):
            yield from out.slice(at, 4_096).combine_chunks().cast(self.schema).to_batches()


def _top(best: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("qid").orderBy(F.round("value", ORDER_DIGITS), "rid")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _scored(
    ranked: DataFrame, query_id: str, ref_id: str, metric: str, carry: Sequence[str] = ()
) -> DataFrame:
    value = F.col("value")
    if metric == "dot":
        distance, score = -value, F.lit(None).cast("double")
    elif metric == "cosine":
        distance, score = 1 + value, -value
    elif metric == "angular":
        distance = F.sqrt(F.greatest(2 + 2 * value, F.lit(0.0)))
        score = F.exp(-distance)
    else:
        distance, score = value, F.exp(-value)
    return ranked.select(
        F.col("qid").alias(query_id),
        F.col("rid").alias(ref_id),
        "rank",
        distance.alias("distance"),
        score.alias("score"),
        *[F.col(f"carry_{i}").alias(c) for i, c in enumerate(carry)],
    )


# Sums over nearest rows ----------------------------------------------------


def _inside(part, refs, rids, limit, edge, family) -> np.ndarray:
    """Boolean matrix: reference rows up to the limit in rank order; at the limit up to the row ``edge``."""
    own = np.einsum("ij,ij->i", part, part)[:, None]
    top = np.einsum("ij,ij->i", refs, refs).max()
    bound = limit[:, None]
    if family == "product":
        near, room = -(part @ refs.T), 1e-12 * np.sqrt(own * top) + 4e-9
    elif family == "l1":
        near, room = _absolute_gaps(part, refs), 4e-9
    else:
        near, room = _squared_gaps(part, refs), 1e-12 * (own + top) + 4e-9 * (2 * bound + 4e-9)
        bound = bound * bound
    inside = near < bound - room
    # What lies within rounding of the limit is ranked as the search has ranked it.
    qi, ri = np.nonzero(~inside & (near <= bound + room))
    wide = max(1, MATRIX_NUMBERS // max(1, refs.shape[1]))
    for at in range(0, len(qi), wide):
        q, r = qi[at : at + wide], ri[at : at + wide]
        value = np.round(_rank_value(part[q], refs[r], family), ORDER_DIGITS)
        last = np.round(limit[q], ORDER_DIGITS)
        inside[q, r] = (value < last) | ((value == last) & (rids[r] <= edge[q]))
    return inside


class _Sums:
    """Sums over the rows within the limits of each view, per query row of a block."""

    def __init__(self, family, views, units, top_norm, schema, held):
        self.family, self.views, self.units, self.top_norm, self.schema = family, views, units, top_norm, schema
        self.rows = pa.Table.from_batches(held).combine_chunks()
        self.vectors = _matrix(self.rows.column("vec"))
        self.bounds = [
            tuple(self.rows.column(f"{name}_{i}").to_numpy() for name in ("limit", "edge")) for i in range(len(views))
        ]
        self.sums: list = [None] * len(views)

    def meet(self, unit: int, refs: pa.RecordBatch) -> None:
        vectors, values = _matrix(refs.column("vec")), _matrix(refs.column("values"))
        rids = refs.column("rid").to_numpy(zero_copy_only=False)
        least = _least_values(self.vectors, self.vectors, _some(self.units, [unit]), self.family)[:, 0]
        step = max(1, MATRIX_NUMBERS // len(vectors))
        for i, view in enumerate(self.views):
            numbers, (limit, edge) = view(values), self.bounds[i]
            if self.sums[i] is None:
                self.sums[i] = np.zeros((len(limit), numbers.shape[1]))
            ask = np.flatnonzero(least <= _room(self.vectors, limit, self.family, self.top_norm))
            for at in range(0, len(ask), step):
                places = ask[at : at + step]
                inside = _inside(self.vectors[places], vectors, rids, limit[places], edge[places], self.family)
                if np.count_nonzero(inside) > SPARSE_SHARE * inside.size:
                    self.sums[i][places] += inside.astype(np.float64) @ numbers
                else:
                    self.few(self.sums[i], places, inside, numbers)

    @staticmethod
    def few(sums: np.ndarray, places: np.ndarray, inside: np.ndarray, numbers: np.ndarray) -> None:
        """Add the numbers of the few rows inside."""
        qi, ri = np.nonzero(inside)
        step = max(1, MATRIX_NUMBERS // numbers.shape[1])
        for at in range(0, len(qi), step):
            own, rows = qi[at : at + step], ri[at : at + step]
            starts = np.flatnonzero(np.diff(own, prepend=-1))
            sums[places[own[starts]]] += np.add.reduceat(numbers[rows], starts, axis=0)

    def finish(self):
        if any(s is None for s in self.sums):
            return
        for at in range(0, self.rows.num_rows, 1_024):
            these = slice(at, at + 1_024)
            columns = [self.rows.column("qid").slice(at, 1_024), *(_lists(s[these]) for s in self.sums)]
            yield from pa.table(columns, self.schema.names).combine_chunks().cast(self.schema).to_batches()


def _lists(matrix: np.ndarray) -> pa.ListArray:
    ends = np.arange(len(matrix) + 1, dtype=np.int32) * matrix.shape[1]
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(matrix.reshape(-1)))


def _added(parts: DataFrame) -> DataFrame:
    """Arrays of one ``qid`` added up, number by number, as its rows pass by."""

    def run(batches):
        held = None
        for batch in batches:
            if held is not None:
                batch = pa.concat_batches([held, batch])
            ids = batch.column(0)
            differ = [True, *np.asarray(pa.compute.not_equal(ids.slice(1), ids.slice(0, len(ids) - 1)))] if len(ids) else []
            starts = np.flatnonzero(differ)
            if not len(starts):
                continue
            sums = [_lists(np.add.reduceat(_matrix(batch.column(i)), starts, axis=0)) for i in range(1, batch.num_columns)]
            whole = pa.RecordBatch.from_arrays([ids.take(pa.array(starts)), *sums], names=batch.schema.names)
            yield whole.slice(0, whole.num_rows - 1)
            held = whole.slice(whole.num_rows - 1)
        if held is not None:
            yield held

    return parts.repartition("qid").sortWithinPartitions("qid").mapInArrow(run, parts.schema)


def first_and_last(near: DataFrame, refs: DataFrame, first: int, ks: Sequence[int]) -> DataFrame:
    """Of neighbours the ``first`` nearest, and those that :func:`nearest_sums` takes as limits for counts ``ks``."""
    rows = refs.count()
    return near.where((F.col("rank") <= first) | F.col("rank").isin([min(k, rows) for k in ks]))


def nearest_sums(
    near: DataFrame,
    queries: DataFrame,
    refs: DataFrame,
    query_id: str,
    ref_id: str,
    views: Sequence[tuple[int, Callable[[np.ndarray], np.ndarray]]],
    metric: str = "euclidean",
    seed: int | str = 42,
) -> DataFrame:
    """Per query row sums over its nearest reference rows: query_id and ``sums_0``, ``sums_1``, ...

    ``near`` is the result of :func:`nearest` for the same tables, with as many
    rows per query as any view asks for; of it only the last row that a view
    takes is read, its limit.  A view is a count of rows and a function from
    their ``values`` (a matrix of the array column of ``refs``) to the numbers
    that are added up.  The reference rows within the limit pass by the blocks
    of query rows, whose sums are matrix products: no neighbour row is joined,
    and a block's sums leave it once.
    """
    family = _family(metric)
    with temporaries(queries.sparkSession) as made:
        found = _nearest_sums(near, queries, refs, query_id, ref_id, views, metric, family, seed)
        found = made.kept(stage(found, "sums"))
    return found.withColumnRenamed("qid", query_id)


def _nearest_sums(near, queries, refs, query_id, ref_id, views, metric, family, seed) -> DataFrame:
    ready = prepare_vector(F.col("vec"), metric).alias("vec")
    r = stage(refs.select(F.col(ref_id).alias("rid"), ready, "values"), "reference-values")
    head = {**_head(r).asDict(), "values": r.agg(F.max(F.size("values"))).first()[0]}
    # The value that rows are ranked by, from the distance that the search tells.
    value = {"dot": -F.col("distance"), "cosine": F.col("distance") - 1}.get(metric, F.col("distance"))
    if metric == "angular":
        value = (F.col("distance") * F.col("distance") - 2) / 2
    places = [min(k, head["n"]) for k, _ in views]
    of = lambda i: F.max(F.when(F.col("rank") == places[i], F.struct(value.alias("limit"), ref_id)))
    limits = near.where(F.col("rank").isin(places)).groupBy(query_id).agg(*[of(i).alias(f"v{i}") for i in range(len(views))])
    limits = limits.select(
        F.col(query_id).alias("qid"),
        *[F.col(f"v{i}.limit").alias(f"limit_{i}") for i in range(len(views))],
        *[F.col(f"v{i}.{ref_id}").alias(f"edge_{i}") for i in range(len(views))],
    )
    id_type = refs.schema[ref_id].dataType
    # Stored: it is read more than once, and the search may be behind it.
    limited = queries.select(F.col(query_id).cast(id_type).alias("qid"), ready).join(limits, "qid")
    q = stage(limited, "query-limits")
    result = T.StructType(
        [T.StructField("qid", id_type)]
        + [T.StructField(f"sums_{i}", T.ArrayType(T.DoubleType())) for i in range(len(views))]
    )
    if not head["n"]:
        return q.sparkSession.createDataFrame([], result)
    # An id that stands for several query rows gets the sums of all of them.
    again = _repeated(q.select("qid"))
    # Equal query rows with equal limits have equal sums: added up once, then handed out.
    lead, same = q, [c for c in q.columns if c != "qid"]
    if not again:
        lead = q.groupBy(F.xxhash64(*same).alias("hash"), *same).agg(F.min("qid").alias("qid")).drop("hash")
        lead = stage(lead, "different-limits")
    alone = again or lead.count() == q.count()
    cell_rows, top_norm = _cell_rows(max(places)), float(head["norm"])
    pivots = _pivots(r, head["n"], head["width"], None, seed, cell_rows)
    units, rows = _build_units(r, pivots, family, top_norm, cell_rows)
    placed, folder = _placed_pieces(rows)
    farthest = F.greatest(*[F.col(f"limit_{i}") for i in range(len(views))], F.lit(float("-inf")))
    # Every number of a block's sums is held.
    numbers = sum(view(np.zeros((1, head["values"]))).shape[1] for _, view in views)
    asked = (q if alone else lead).withColumn("limit", farthest)
    blocks, names = _query_blocks(asked, units, family, top_norm, numbers, numbers)
    needed = _needed(blocks, units, family, top_norm)
    state = partial(_Sums, family, [view for _, view in views], units, top_norm)
    found = _met(blocks.drop("first"), placed, needed, max(names) + 1, state, result, folder)
    if alone:
        return _added(found) if again else found
    key = F.xxhash64(*same).alias("hash")
    own, first = q.select(F.col("qid").alias("own"), key, *same), lead.select("qid", key, *same)
    equal = own["hash"] == first["hash"]
    for c in same:
        equal = equal & own[c].eqNullSafe(first[c])
    shared = own.join(first, equal).select("own", "qid")
    return shared.join(stage(found, "different-sums"), "qid").drop("qid").withColumnRenamed("own", "qid").select(*result.names)


def recall(found: DataFrame, exact: DataFrame, query_id: str, ref_id: str) -> DataFrame:
    """Share of the exact neighbours that were found, over all query rows."""
    hits = exact.select(query_id, ref_id).join(
        found.select(query_id, ref_id).withColumn("hit", F.lit(1)), [query_id, ref_id], "left"
    )
    return hits.agg(F.avg(F.coalesce("hit", F.lit(0)).cast("double")).alias("recall"))


# Examples from neighbours --------------------------------------------------


def neighbour_examples(
    neighbours: DataFrame,
    reference_profiles: DataFrame,
    query_id: str,
    ref_id: str,
    profile_col: str = "narrative_profile",
) -> DataFrame:
    """Neighbours with the reference row's texts; missing texts become N/A.

    The profile falls back to the template; of repeated reference rows the one
    with the highest ``position`` counts, where that column exists.
    """
    have = reference_profiles.columns

    def text(column: str) -> Column:
        return F.col(column) if column in have else F.lit(None).cast("string")

    rows = reference_profiles.select(
        F.col("customer_id").alias(ref_id),
        F.coalesce(text(profile_col), text("template_profile")).alias("profile"),
        text("template_treatment").alias("treatment"),
        text("template_outcome").alias("outcome"),
        *([F.col("position")] if "position" in have else []),
    )
    if "position" in have:
        rows = rows.groupBy(ref_id).agg(
            F.max_by(F.struct("profile", "treatment", "outcome"), "position").alias("r")
        ).select(ref_id, "r.*")
    joined = neighbours.join(rows, ref_id, "left")
    return joined.select(
        *neighbours.columns,
        *[F.coalesce(c, F.lit(fixed.MISSING)).alias(c) for c in ("profile", "treatment", "outcome")],
    )


def require_rows(ids: DataFrame, df: DataFrame, column: str) -> None:
    """Error when an id of ``ids`` has no row in ``df`` (one bounded look)."""
    absent = ids.select(column).join(df.select(column), column, "left_anti").limit(5).collect()
    if absent:
        raise ValueError(f"no row for {column}: {[r[0] for r in absent]}")
