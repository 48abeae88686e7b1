"""Merkle tree over the rows of a table, one subtree per group, with proofs for every row.

The nodes of a level are numbered inside their group.  Conditional aggregates
spread the nodes below one parent into a column per slot; the parent's digest is
the hash of the slot columns joined, and the siblings of a slot are the same
columns without its own.  One aggregate covers as many levels as fit into
``SLOTS`` columns, so a tree over N rows takes log(N) / log(SLOTS) of them, and
paths are handed down by joins of parents, of which there are few.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from shopcast.llm.common import fresh
from shopcast.sources import stage

#: Slot columns of one aggregate, at least one level of the tree.
SLOTS = 16
#: Bits of ``monotonically_increasing_id`` that number the rows of a partition.
ROW_BITS = 33

PATH = T.ArrayType(
    T.StructType([T.StructField("left", T.StringType()), T.StructField("right", T.StringType())])
)


def row_digest(values: Sequence[str | Column]) -> Column:
    """SHA-256 of the values joined, each as byte count, colon and value; ``-`` for null."""
    parts = []
    for value in values:
        text = (F.col(value) if isinstance(value, str) else value).cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def proof_digest(path: Column) -> Column:
    """SHA-256 of all siblings of a path, from the row upwards, left to right."""
    return F.sha2(F.concat_ws("", F.transform(path, lambda x: F.concat(x["left"], x["right"]))), 256)


def folded(digest: Column, path: Column) -> Column:
    """The root that follows from a digest and the siblings on its path."""
    return F.aggregate(path, digest, lambda at, x: F.sha2(F.concat(x["left"], at, x["right"]), 256))


def _numbered(rows: DataFrame, order: Sequence[Column]) -> DataFrame:
    """``rows`` (group, digest, kept) with their place in the group and its size.

    Range partitions are numbered inside; one row per partition and group says
    how many rows came before, so no group is ordered in one task.
    """
    keys = [F.col("group"), *order]
    ordered = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    marked = ordered.withColumn("id", F.monotonically_increasing_id()).withColumn(
        "part", F.shiftright("id", ROW_BITS)
    )
    marked = stage(marked, "merkle-numbered")
    runs = marked.groupBy("group", "part").agg(F.count("*").alias("rows"), F.min("id").alias("first"))
    of_group = Window.partitionBy("group")
    before = of_group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(
        "group",
        "part",
        (F.coalesce(F.sum("rows").over(before), F.lit(0)) - F.col("first")).alias("shift"),
        F.sum("rows").over(of_group).alias("n"),
    )
    placed = marked.join(stage(runs, "merkle-runs"), ["group", "part"])
    return placed.select("group", (F.col("id") + F.col("shift")).alias("pos"), "n", "digest", "kept")


def _joined(level: int, places: range) -> str:
    """The digests of some nodes of a level joined, as SQL."""
    parts = ["''", *(f"coalesce(d{level}_{i}, '')" for i in places)]
    return f"concat({', '.join(parts)})"


def _spread(nodes: DataFrame, fanout: int, depth: int) -> DataFrame:
    """One row per run of ``fanout ** depth`` nodes: slots, levels between, digest and node count."""
    slots = fanout**depth
    runs = nodes.selectExpr("group", f"pos div {slots} AS block", "n", f"pos % {slots} AS slot", "struct(digest, kept) AS own")
    df = runs.groupBy("group", "block").agg(
        F.max("n").alias("n0"),
        *(F.expr(f"first(CASE WHEN slot = {s} THEN own END, true)").alias(f"s{s}") for s in range(slots)),
    )
    df = df.selectExpr("*", *(f"s{s}.digest AS d0_{s}" for s in range(slots)))
    for level in range(depth):
        # A group whose nodes are down to one is finished: its digest goes on unchanged.
        hashed = [
            f"CASE WHEN d{level}_{i} IS NULL THEN NULL WHEN n{level} > 1 "
            f"THEN sha2({_joined(level, range(i, i + fanout))}, 256) ELSE d{level}_{i} END AS d{level + 1}_{i // fanout}"
            for i in range(0, slots // fanout**level, fanout)
        ]
        df = df.selectExpr("*", *hashed, f"ceil(n{level} / {fanout}) AS n{level + 1}")
    return df


def _above(df: DataFrame, depth: int) -> DataFrame:
    """The nodes of the next aggregate."""
    return df.select(
        "group",
        F.col("block").alias("pos"),
        F.col(f"n{depth}").alias("n"),
        F.col(f"d{depth}_0").alias("digest"),
        F.lit(None).cast("string").alias("kept"),
    )


def _below(df: DataFrame, fanout: int, depth: int) -> DataFrame:
    """The nodes that an aggregate has spread, each with its path to the root."""
    slots = fanout**depth
    # Per node and level what stands left and right of it; null where a level is finished.
    steps = []
    for level in range(depth):
        for at in range(fanout ** (depth - level)):
            first = at - at % fanout
            left, right = _joined(level, range(first, at)), _joined(level, range(at + 1, first + fanout))
            struct = f"named_struct('left', {left}, 'right', {right})"
            steps.append(f"CASE WHEN n{level} > 1 THEN {struct} END AS step{level}_{at}")
    children = ", ".join(
        f"struct({s} AS slot, s{s} AS own, array({', '.join(f'step{k}_{s // fanout**k}' for k in range(depth))}) AS steps)"
        for s in range(slots)
    )
    kids = df.selectExpr("*", *steps).selectExpr("group", "subroot", "block", "path", f"explode(array({children})) AS c")
    return kids.where("c.own IS NOT NULL").selectExpr(
        "group",
        "subroot",
        f"block * {slots} + c.slot AS pos",
        "c.own.digest",
        "c.own.kept",
        "concat(array_compact(c.steps), path) AS path",
    )


def _climb(nodes: DataFrame, fanout: int, name: str) -> tuple[list[DataFrame], int]:
    """Aggregates from the rows up to one node per group; levels that each of them covers."""
    depth = 1
    while fanout ** (depth + 1) <= SLOTS:
        depth += 1
    left = nodes.agg(F.max("n")).first()[0] or 0
    spread = []
    while True:
        spread.append(stage(_spread(nodes, fanout, depth), f"merkle-{name}-{len(spread)}"))
        left = -(-left // fanout**depth)
        if left <= 1:
            return spread, depth
        nodes = _above(spread[-1], depth)


def _descend(spread: list[DataFrame], tops: DataFrame, fanout: int, depth: int) -> DataFrame:
    """Nodes of the lowest aggregate with subroot and path; ``tops``: group, subroot, path."""
    at = spread[-1].join(tops, "group")
    for lower in reversed(spread[:-1]):
        parents = _below(at, fanout, depth).select("group", F.col("pos").alias("block"), "subroot", "path")
        at = lower.join(parents, ["group", "block"])
    return _below(at, fanout, depth)


def merkle_proofs(
    rows: DataFrame, group_col: str, order_cols: Sequence[str], digest_col: str, fanout: int = 2
) -> DataFrame:
    """Every row with ``subroot``, ``root`` and ``path``, its siblings up to the root.

    Leaves are the values of ``digest_col`` (text); those of a group, compared as
    text, stand in ascending order of ``order_cols``, null first, equal ones by
    digest.  While a group has more than one node, every ``fanout`` consecutive
    ones, fewer in the last run, become the hash of their texts joined; a lone
    leaf stays as it is.  The subroots, by group as UTF-8 bytes, null first, give
    the root the same way.  Repeated rows are leaves of their own; an empty
    table gives an empty table.  Rows keep all their columns, but ``subroot``,
    ``root`` and ``path`` must be free: a table that has one of them is refused.
    """
    if fanout < 2:
        raise ValueError("fanout must be 2 or more")
    names = fresh(rows, "subroot", "root", "path")
    text = F.col(group_col).cast("string")
    # Null groups get a key of their own that sorts first.
    key = F.coalesce(F.concat(F.lit("="), text), F.lit(""))
    leaves = rows.select(
        key.alias("group"), F.col(digest_col).alias("digest"), F.struct(*(rows[c] for c in rows.columns)).alias("kept")
    )
    leaves = stage(leaves, "merkle-leaves")
    order = [F.col(f"kept.`{c}`").asc_nulls_first() for c in order_cols] + [F.col("digest")]
    spread, depth = _climb(_numbered(leaves, order), fanout, "rows")
    subroots = _above(spread[-1], depth).select(
        F.lit("").alias("group"), "digest", F.struct(F.col("group").alias("of")).alias("kept")
    )
    upper, _ = _climb(_numbered(subroots, [F.col("kept.of")]), fanout, "groups")
    top = _above(upper[-1], depth).select("digest").first()
    root = F.lit(top["digest"] if top else None).cast("string")
    nothing = F.array().cast(PATH).alias("path")
    whole = upper[-1].select("group", F.lit("").alias("subroot"), nothing)
    tops = _descend(upper, whole.distinct(), fanout, depth).select(
        F.col("kept.of").alias("group"), F.col("digest").alias("subroot"), "path"
    )
    found = _descend(spread, stage(tops, "merkle-tops"), fanout, depth)
    added = (c.alias(n) for c, n in zip((F.col("subroot"), root, F.col("path")), names))
    return found.select("kept.*", *added)
