"""Approximate nearest rows by a forest of random hyperplane trees.

A tree halves the reference rows level after level: rows of a node go left or
right of the median of their projection on a random direction.  The depth
follows from the row count, so a leaf holds about ``leaf_rows`` rows whatever
the table's size.  While nodes are large, a level is one pass that sends short
summaries of each node and brings back its median; the driver holds one number
per such node.  Nodes of up to ``NODE_ROWS`` rows are then cut into leaves where
their rows are, with the query rows that reach them, and compared leaf by leaf:
rows move once per tree, and a query row gets its best rows of a tree as one row.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from shopcast.operators import similarity as s
from shopcast.sources import stage

TREES = 10
LEAF_ROWS = 256
#: Accuracy of a node's median: its rank is off by one part in as many.
MEDIAN_ACCURACY = 1_000
#: Nodes of as many rows at most are cut further in one task.
NODE_ROWS = 32_768
#: Rows that one summary of a node's projections is made from, at most.
SUMMARY_ROWS = 131_072


def depth_for(rows: int, leaf_rows: int) -> int:
    """Levels after which the nodes hold ``leaf_rows`` to twice as many rows each."""
    return max(0, int(math.floor(math.log2(rows / leaf_rows)))) if rows > leaf_rows else 0


def _directions(trees: int, depth: int, width: int, seed: int) -> np.ndarray:
    """A unit vector per tree and level; the same for any machine."""
    drawn = np.random.default_rng(seed).normal(size=(trees, depth, width))
    return drawn / np.maximum(np.linalg.norm(drawn, axis=2, keepdims=True), 1e-12)


class _Trees:
    """Directions, and the cuts of the levels that have been grown so far (a row per tree and node of a level)."""

    def __init__(self, directions: np.ndarray, family: str, top_norm: float):
        self.directions, self.family, self.top_norm, self.cuts = directions, family, top_norm, []

    def space(self, vectors: np.ndarray, is_query: bool) -> np.ndarray:
        return s._space(vectors, self.family, self.top_norm, is_query)

    def along(self, space: np.ndarray, tree: int, level: int) -> np.ndarray:
        # Added up number by number, so that equal rows get equal sums in any task.
        out = np.zeros(len(space))
        for j, x in enumerate(self.directions[tree, level, : space.shape[1]]):
            out += space[:, j] * x
        return out

    def node(self, space: np.ndarray, tree: int) -> np.ndarray:
        """Places of rows among the nodes of the last level grown."""
        node = np.zeros(len(space), np.int64)
        for level, cuts in enumerate(self.cuts):
            node = 2 * node + (self.along(space, tree, level) > cuts[tree][node])
        return node


def _summaries(trees: _Trees):
    """Arrow map: evenly spaced projections of the rows of each node, and how many rows each stands for."""
    level, count = len(trees.cuts), len(trees.directions)

    def told(batches):
        space = trees.space(np.concatenate(batches), False)
        rows = []
        for tree in range(count):
            node, at = trees.node(space, tree), trees.along(space, tree, level)
            order = np.lexsort((at, node))
            names, starts = np.unique(node[order], return_index=True)
            for name, values in zip(names.tolist(), np.split(at[order], starts[1:])):
                size = min(len(values), MEDIAN_ACCURACY)
                places = ((np.arange(size) + 0.5) * len(values) / size).astype(int)
                rows.append((tree, name, values[places].tolist(), len(values) / size))
        kinds = [pa.int32(), pa.int64(), pa.list_(pa.float64()), pa.float64()]
        columns = [pa.array(column, kind) for column, kind in zip(zip(*rows), kinds)]
        return pa.RecordBatch.from_arrays(columns, ["tree", "node", "values", "weight"])

    def run(batches):
        held = []
        for batch in batches:
            if batch.num_rows:
                held.append(s._matrix(batch.column("vec")))
            if sum(map(len, held)) >= SUMMARY_ROWS:
                yield told(held)
                held = []
        if held:
            yield told(held)

    return run


def _median(of: pa.Table) -> pa.Table:
    values, length = of.column("values").combine_chunks(), of.column("values").combine_chunks().value_lengths()
    flat, weight = values.flatten().to_numpy(), np.repeat(of.column("weight").to_numpy(), length.to_numpy())
    order = np.argsort(flat, kind="stable")
    before = np.cumsum(weight[order])
    cut = flat[order[min(np.searchsorted(before, before[-1] / 2), len(flat) - 1)]]
    return pa.table({"tree": of.column("tree")[:1], "node": of.column("node")[:1], "cut": pa.array([cut])})


def _grown(refs: DataFrame, head, trees: int, leaf_rows: int, seed: int, family: str) -> tuple[_Trees, int]:
    """The trees down to nodes that one task can hold, and the levels below those."""
    depth = depth_for(head["n"], leaf_rows)
    top = min(depth, math.ceil(math.log2(head["n"] / NODE_ROWS))) if head["n"] > NODE_ROWS else 0
    out = _Trees(_directions(trees, depth, head["width"] + (family == "product"), seed), family, float(head["norm"]))
    for level in range(top):
        parts = refs.select("vec").mapInArrow(_summaries(out), "tree int, node long, values array<double>, weight double")
        cuts = parts.groupBy("tree", "node").applyInArrow(_median, "tree int, node long, cut double").collect()
        held = np.zeros((trees, 1 << level))
        for row in cuts:
            held[row["tree"], row["node"]] = row["cut"]
        out.cuts.append(held)
    return out, depth - top


def _sent(rows: DataFrame, trees: _Trees, is_query: bool) -> DataFrame:
    """Every row once per tree, with the node that it reaches."""
    count = len(trees.directions)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            space = trees.space(s._matrix(batch.column("vec")), is_query)
            for tree in range(count):
                names = [pa.array(np.full(batch.num_rows, tree, np.int32)), pa.array(trees.node(space, tree))]
                yield pa.RecordBatch.from_arrays([*names, *batch.columns], ["tree", "node", *batch.schema.names])

    head = [T.StructField("tree", T.IntegerType()), T.StructField("node", T.LongType())]
    return rows.mapInArrow(run, T.StructType([*head, *rows.schema.fields]))


def _cut(trees: _Trees, below: int, tree: int, refs: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The leaf of every row of a node, from exact medians, and of the query rows that reached it."""
    r, q = trees.space(refs, False), trees.space(queries, True)
    leaf, asked = np.zeros(len(r), np.int64), np.zeros(len(q), np.int64)
    depth = trees.directions.shape[1]
    for level in range(depth - below, depth):
        at = trees.along(r, tree, level)
        order = np.lexsort((at, leaf))
        names, starts, counts = np.unique(leaf[order], return_index=True, return_counts=True)
        cuts = np.full(1 << (level - depth + below), np.inf)
        cuts[names] = at[order[starts + (counts - 1) // 2]]
        leaf = 2 * leaf + (at > cuts[leaf])
        asked = 2 * asked + (trees.along(q, tree, level) > cuts[asked])
    return leaf, asked


def _compare_leaves(trees: _Trees, below: int, need: int, schema: pa.Schema):
    """Arrow function of a node's query rows and rows: per query row its best rows of its leaf."""
    kind = schema.field("near").type

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        right = right.take(pa.compute.sort_indices(right.column("rid"))).combine_chunks()
        refs, queries = s._matrix(right.column("vec")), s._matrix(left.column("vec"))
        leaf, asked = _cut(trees, below, left.column("tree")[0].as_py(), refs, queries)
        rows, asks = np.argsort(leaf, kind="stable"), np.argsort(asked, kind="stable")
        out = []
        for name in np.unique(asked):
            mine = rows[slice(*np.searchsorted(leaf[rows], [name, name + 1]))]
            those = asks[slice(*np.searchsorted(asked[asks], [name, name + 1]))]
            step = max(1, s.MATRIX_NUMBERS // max(1, len(mine)))
            for at in range(0, len(those) if len(mine) else 0, step):
                places = those[at : at + step]
                endless = np.full(len(places), np.inf)
                keep = s._candidates(queries[places], refs[mine], trees.family, min(need, len(mine)), endless)
                qi, ri = np.nonzero(keep)
                value = s._rank_value(queries[places[qi]], refs[mine[ri]], trees.family)
                order = np.lexsort((ri, np.round(value, s.ORDER_DIGITS), qi))
                qi, ri, value = qi[order], ri[order], value[order]
                best = np.arange(len(qi)) - np.searchsorted(qi, qi, side="left") < need
                out.append((places[qi[best]], mine[ri[best]], value[best]))
        if not out:
            return schema.empty_table()
        qi, ri, value = (np.concatenate(c) for c in zip(*out))
        order = np.argsort(qi, kind="stable")
        taken = right.take(pa.array(ri[order])).combine_chunks()
        columns = {"value": pa.array(value[order])}
        arrays = [columns[f.name] if f.name in columns else taken.column(f.name).combine_chunks() for f in kind.value_type]
        arrays = [pa.concat_arrays(a.chunks) if isinstance(a, pa.ChunkedArray) else a for a in arrays]
        arrays = [a.cast(f.type) for a, f in zip(arrays, kind.value_type)]
        ends = np.searchsorted(qi[order], np.arange(left.num_rows + 1)).astype(np.int32)
        near = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(arrays, fields=list(kind.value_type)))
        return pa.table([left.column("qid"), near.cast(kind)], ["qid", "near"]).cast(schema)

    return run


def _best_of_trees(met: DataFrame, need: int) -> DataFrame:
    """Per query row the best of all trees; a pair that was met in several trees counts once."""
    every = met.groupBy("qid").agg(F.flatten(F.collect_list("near")).alias("near"))
    item = met.schema["near"].dataType.elementType
    near = T.ArrayType(T.StructType([*item.fields, T.StructField("rank", T.IntegerType())]))
    kind = T.StructType([met.schema["qid"], T.StructField("near", near)])
    schema = to_arrow_schema(kind)
    told = schema.field("near").type

    def run(batches):
        for batch in batches:
            held = batch.column("near").value_lengths().to_numpy(zero_copy_only=False)
            for part in s._parts(batch, int(held.max(initial=1))):
                lists = part.column("near")
                row = np.repeat(np.arange(part.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
                flat = pa.RecordBatch.from_struct_array(lists.flatten())
                rid = pa.compute.rank(flat.column("rid"), sort_keys="ascending", tiebreaker="dense").to_numpy()
                value = np.round(flat.column("value").to_numpy(), s.ORDER_DIGITS)
                order = np.lexsort((value, rid, row))
                again = (np.diff(row[order], prepend=-1) == 0) & (np.diff(rid[order].astype(np.int64), prepend=-1) == 0)
                once = order[~again]
                once = once[np.lexsort((rid[once], value[once], row[once]))]
                place = np.arange(len(once)) - np.searchsorted(row[once], row[once], side="left")
                once, place = once[place < need], place[place < need]
                taken = flat.take(pa.array(once))
                columns = [taken.column(f.name) for f in item.fields] + [pa.array((place + 1).astype(np.int32))]
                columns = [c.cast(f.type) for c, f in zip(columns, told.value_type)]
                ends = np.searchsorted(row[once], np.arange(part.num_rows + 1)).astype(np.int32)
                best = pa.ListArray.from_arrays(
                    pa.array(ends), pa.StructArray.from_arrays(columns, fields=list(told.value_type))
                )
                yield pa.RecordBatch.from_arrays([part.column("qid"), best.cast(told)], ["qid", "near"])

    return every.mapInArrow(run, kind)


def _prepared(queries, refs, query_id, ref_id, metric, carry):
    ready = s.prepare_vector(F.col("vec"), metric).alias("vec")
    with_it = [F.col(c).alias(f"carry_{i}") for i, c in enumerate(carry)]
    if refs is None:
        both = stage(queries.select(F.col(query_id).alias("qid"), ready, *with_it), "vectors")
        return both.select("qid", "vec"), both.withColumnRenamed("qid", "rid")
    kind = refs.schema[ref_id].dataType
    r = stage(refs.select(F.col(ref_id).alias("rid"), ready, *with_it), "reference-vectors")
    return stage(queries.select(F.col(query_id).cast(kind).alias("qid"), ready), "query-vectors"), r


def nearest_in_forest(
    queries: DataFrame,
    refs: DataFrame | None,
    query_id: str,
    ref_id: str,
    k: int,
    metric: str = "euclidean",
    exclude_self: bool = False,
    trees: int = TREES,
    leaf_rows: int = LEAF_ROWS,
    seed: int = 42,
    carry: Sequence[str] = (),
) -> DataFrame:
    """The ``k`` nearest reference rows that share a leaf with a query row in any of ``trees`` trees.

    Arguments and result are those of :func:`similarity.nearest`.  A leaf holds
    ``leaf_rows`` (four times ``k`` at least) to twice as many different rows, so
    a query row is compared with ``2 * trees * leaf_rows`` rows at most, whatever
    the table's size; more trees give more recall.  Of equal reference vectors
    the lowest ids count; equal query vectors are searched once.  Distances are
    exact.  Medians of nodes of over ``NODE_ROWS`` rows are those of a sketch, so
    leaf sizes may be off by a few thousandths of the rows of those nodes.
    """
    family = s._family(metric)
    if query_id == ref_id:
        raise ValueError("query and reference ids need different column names")
    if trees < 1:
        raise ValueError("a forest has one tree or more")
    q, r = _prepared(queries, refs, query_id, ref_id, metric, carry)
    need = k + int(exclude_self)
    r = s._lowest_copies(r, need)
    head = s._head(r)
    result = s._result_type(r)
    if not head["n"]:
        best = q.sparkSession.createDataFrame([], result).withColumn("rank", F.lit(1))
        return s._scored(best, query_id, ref_id, metric, carry)
    lead = stage(q.groupBy("vec").agg(F.min("qid").alias("qid")), "different-vectors")
    grown, below = _grown(r, head, trees, max(leaf_rows, s.FIRST_SHARE * need), seed, family)
    # The rows of a node and the query rows that reach it meet in blocks of bounded size.
    grid = ["tree", "node", "query_block"]
    visits = _sent(lead.select("qid", "vec"), grown, True)
    asked = visits.groupBy("tree", "node").agg(F.ceil(F.count("*") / (2 * NODE_ROWS)).cast("int").alias("query_blocks"))
    asked = stage(asked, "forest-nodes")
    block = F.pmod(F.xxhash64("qid"), F.col("query_blocks")).cast("int").alias("query_block")
    left = visits.join(asked, ["tree", "node"]).select("tree", "node", block, "qid", "vec")
    blocks = F.explode(F.sequence(F.lit(0), F.col("query_blocks") - 1)).alias("query_block")
    right = _sent(r, grown, False).join(asked, ["tree", "node"]).select("tree", "node", blocks, *r.columns)
    near = T.ArrayType(T.StructType([f for f in result.fields if f.name != "qid"]))
    kind = T.StructType([lead.schema["qid"], T.StructField("near", near)])
    compare = _compare_leaves(grown, below, need, to_arrow_schema(kind))
    met = left.groupBy(*grid).cogroup(right.groupBy(*grid)).applyInArrow(compare, kind)
    best = s._handed_out(q, lead, _best_of_trees(met, need), k, need, exclude_self, s._repeated(q))
    if not exclude_self:
        best = best.where(F.col("rank") <= k)
    return s._scored(best, query_id, ref_id, metric, carry)


def leaf_sizes(
    rows: DataFrame, id_col: str, metric: str = "euclidean", trees: int = TREES, leaf_rows: int = LEAF_ROWS, seed: int = 42
) -> DataFrame:
    """(tree, node, rows) of the forest over the different vectors of ``rows``."""
    family = s._family(metric)
    ready = s.prepare_vector(F.col("vec"), metric).alias("vec")
    refs = stage(rows.select(F.col(id_col).alias("rid"), ready).groupBy("vec").agg(F.min("rid").alias("rid")), "vectors")
    head = s._head(refs)
    if not head["n"]:
        return rows.sparkSession.createDataFrame([], "tree int, node long, rows long")
    grown, below = _grown(refs, head, trees, leaf_rows, seed, family)

    def counted(rows: pa.Table) -> pa.Table:
        vectors, tree = s._matrix(rows.column("vec")), rows.column("tree")[0].as_py()
        leaf, _ = _cut(grown, below, tree, vectors, vectors[:0])
        names, counts = np.unique(leaf + (rows.column("node")[0].as_py() << below), return_counts=True)
        return pa.table({"tree": pa.array([tree] * len(names), pa.int32()), "node": names, "rows": counts})

    sent = _sent(refs.select("vec"), grown, False)
    return sent.groupBy("tree", "node").applyInArrow(counted, "tree int, node long, rows long")
