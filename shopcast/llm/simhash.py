"""Near duplicates: 64-bit SimHash and vantage-point trees under Hamming distance.

The 64 bits are cut into three blocks.  Fingerprints at most ``MOST_BITS`` apart
differ in one bit at most in some block, so each block has a tree of its own
that searches with radius one: a whole-fingerprint tree with radius four would
cross nearly every boundary, since distances to a vantage point gather around
32.  The upper levels of a tree are shards: a fingerprint lives in the shard of
its rings around the vantage points and visits the shards whose ring its radius
reaches.  Inside a shard the tree goes on, until few pairs are left, and those
are compared by the whole fingerprint.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shopcast.llm.common import fresh, map_text
from shopcast.llm.components import components
from shopcast.sources import stage

SHINGLE_WORDS = 4
MOST_BITS = 4
SEED = 42
#: Bits of each block of a fingerprint.
BLOCKS = ((0, 21), (21, 21), (42, 22))
#: Distances that one ring of a shard level spans, and the radius of the search in a block.
RING, RADIUS = 3, 1
#: Fingerprints that a shard should hold, and those that a task takes of one side.
SHARD_ROWS, SIDE_ROWS = 20_000, 60_000
#: Pairs that are compared without going down another level.
LEAF_PAIRS = 1 << 17
LOCAL_LEVELS = 8
_ROWS_AT_ONCE = 1 << 15


def fingerprint(text: str | None, shingle: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """SimHash of the word shingles of a whole text; 0 without words (null, empty, blank).

    A bit is set if it is set in over half of the shingles' hashes, repeats
    included.  A text of fewer words is one shingle.
    """
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    span = min(shingle, len(words))
    starts = [0, *ends[: len(words) - span].tolist()]
    stops = (ends[span - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    for at in range(0, len(starts), _ROWS_AT_ONCE):
        pairs = zip(starts[at : at + _ROWS_AT_ONCE], stops[at : at + _ROWS_AT_ONCE], strict=True)
        hashes = np.array([digest(line[a:b], seed) for a, b in pairs], "<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    set_bits = (counts * 2 > len(starts)).astype(np.uint8)
    return int(np.packbits(set_bits, bitorder="little").view("<u8")[0])


def with_fingerprints(
    docs: DataFrame, text_col: str = "text", out_col: str = "simhash", shingle: int = SHINGLE_WORDS
) -> DataFrame:
    """Rows of ``docs`` with the fingerprint of the text as a signed 64-bit number."""

    def make() -> Callable[[list], list]:
        def work(texts: list) -> list:
            made = np.array([fingerprint(t, shingle) for t in texts], "<u8")
            return [made.view("<i8")]

        return work

    return map_text(docs, text_col, [(out_col, T.LongType(), pa.int64())], make)


def _vantage_points(tree: int, levels: int) -> list[int]:
    """The vantage points of a tree: random bits inside its block."""
    start, width = BLOCKS[tree]
    draw = np.random.default_rng([SEED, tree])
    return [int(draw.integers(0, 1 << width)) << start for _ in range(levels)]


def _mask(tree: int) -> int:
    start, width = BLOCKS[tree]
    return ((1 << width) - 1) << start


def _signed(n: int) -> int:
    return n - (1 << 64) if n >> 63 else n


def _block_distance(tree: int, vantage: int) -> Column:
    return F.bit_count(F.col("fp").bitwiseXOR(F.lit(_signed(vantage))).bitwiseAND(F.lit(_signed(_mask(tree)))))


def _deeper(paths: Column, reach: Column) -> Column:
    return F.flatten(F.transform(paths, lambda p: F.transform(reach, lambda ring: p * 16 + ring)))


def _dealt(points: DataFrame, tree: int, levels: int) -> DataFrame:
    """Each fingerprint in its shard, and as a visitor in earlier shards within its radius.

    A pair across a boundary is met in the earlier of the two shards only.
    """
    home, paths = F.lit(0).cast("long"), F.array(F.lit(0).cast("long"))
    for vantage in _vantage_points(tree, levels):
        far = _block_distance(tree, vantage)
        rings = [F.floor((far + r + RADIUS) / RING).cast("long") for r in (-RADIUS, 0, RADIUS)]
        reach = F.array_distinct(F.array(*rings))
        home = home * 16 + rings[1]
        paths = _deeper(paths, reach)
    rows = points.select("fp", home.alias("home"), paths.alias("paths"))
    earlier = F.filter("paths", lambda p: p <= F.col("home"))
    return rows.select("fp", "home", F.explode(earlier).alias("shard")).select(
        F.lit(tree).alias("tree"), "shard", "fp", (F.col("shard") == F.col("home")).alias("resident")
    )


class _Joined:
    """Union of linked positions, by arrays."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = self.parent[a], self.parent[b]
            apart = a != b
            a, b = a[apart], b[apart]
            self.parent[np.maximum(a, b)] = np.minimum(a, b)
            while True:
                up = self.parent[self.parent]
                if np.array_equal(up, self.parent):
                    break
                self.parent = up


def _search(points, seekers, held, vantage, mask, level, joined, most_bits) -> None:
    """Link positions in ``seekers`` to those in ``held`` within ``most_bits``."""
    if len(seekers) * len(held) <= LEAF_PAIRS or level == len(vantage):
        step = max(1, (1 << 20) // max(1, len(held)))
        right = points[held]
        for at in range(0, len(seekers), step):
            some = seekers[at : at + step]
            i, j = np.nonzero(np.bitwise_count(points[some][:, None] ^ right[None, :]) <= most_bits)
            joined.link(some[i], held[j])
        return
    there = np.bitwise_count((points[held] ^ vantage[level]) & mask).astype(np.int16)
    here = np.bitwise_count((points[seekers] ^ vantage[level]) & mask).astype(np.int16)
    for ring in np.unique(there):
        # Triangle bound: what is further from the vantage point than the radius allows is pruned.
        near = seekers[np.abs(here - ring) <= RADIUS]
        if len(near):
            _search(points, near, held[there == ring], vantage, mask, level + 1, joined, most_bits)


def _cell_links(levels: int, most_bits: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def run(cell: pd.DataFrame) -> pd.DataFrame:
        tree = int(cell["tree"].iloc[0])
        points, where = np.unique(cell["fp"].to_numpy().astype("<i8").view("<u8"), return_inverse=True)
        held = np.unique(where[cell["holds"].to_numpy()])
        seekers = np.unique(where[cell["seeks"].to_numpy()])
        vantage = np.array(_vantage_points(tree, levels + LOCAL_LEVELS)[levels:], np.uint64)
        joined = _Joined(len(points))
        _search(points, seekers, held, vantage, np.uint64(_mask(tree)), 0, joined, most_bits)
        moved = np.flatnonzero(joined.parent != np.arange(len(points)))
        return pd.DataFrame(
            {"u": points[moved].view("<i8"), "v": points[joined.parent[moved]].view("<i8")}
        )

    return run


def hamming_links(points: DataFrame, most_bits: int = MOST_BITS) -> DataFrame:
    """Edges (u, v) that connect what fingerprints within ``most_bits`` bits connect.

    ``points`` has distinct fingerprints in ``fp``.  A cell of the search gives
    a spanning forest of its links, never all pairs.  Shards that are too large
    for a task are cut on both sides, and every part meets every other; shards
    that are only visited are left out.
    """
    if most_bits >= len(BLOCKS) * (RADIUS + 1):
        raise ValueError("the blocks do not cover so many bits")
    levels = round(math.log(max(1.0, points.count() / SHARD_ROWS), 3.0))
    rows = None
    for tree in range(len(BLOCKS)):
        dealt = _dealt(points, tree, levels)
        rows = dealt if rows is None else rows.unionByName(dealt)
    rows = stage(rows, "simhash-shards")
    large = F.col("n") > SIDE_ROWS
    # Visitors of a shard without residents have nothing to meet there.
    shards = stage(
        rows.groupBy("tree", "shard")
        .agg(F.count("*").alias("n"), F.count(F.when(F.col("resident"), 1)).alias("r"))
        .where("r > 0")
        .select(
            "tree",
            "shard",
            F.when(large, F.ceil(F.col("r") / SIDE_ROWS)).cast("int").alias("held_parts"),
            F.when(large, F.ceil(F.col("n") / SIDE_ROWS)).cast("int").alias("seek_parts"),
        ),
        "simhash-held",
    )
    spread = F.xxhash64("fp")
    one = F.array(
        F.struct(
            F.lit(0).alias("held"),
            F.lit(0).alias("seek"),
            F.col("resident").alias("holds"),
            F.lit(True).alias("seeks"),
        )
    )

    def cells(count: str, made: Callable[[Column], Column]) -> Column:
        return F.transform(F.sequence(F.lit(0), F.col(count) - 1), made)

    def cell(held: Column, seek: Column, holds: bool) -> Column:
        return F.struct(
            held.cast("int").alias("held"),
            seek.cast("int").alias("seek"),
            F.lit(holds).alias("holds"),
            F.lit(not holds).alias("seeks"),
        )

    as_seeker = cells("held_parts", lambda i: cell(i, F.pmod(spread, "seek_parts"), False))
    as_held = cells("seek_parts", lambda j: cell(F.pmod(spread, "held_parts"), j, True))
    many = F.when(F.col("resident"), F.concat(as_seeker, as_held)).otherwise(as_seeker)
    placed = rows.join(shards, ["tree", "shard"]).select(
        "tree",
        "shard",
        "fp",
        F.explode(F.when(F.col("held_parts").isNull(), one).otherwise(many)).alias("cell"),
    )
    return (
        placed.select("tree", "shard", "fp", "cell.*")
        .groupBy("tree", "shard", "held", "seek")
        .applyInPandas(_cell_links(levels, most_bits), "u long, v long")
    )


def _grouped(docs: DataFrame, id_col: str, text_col: str, shingle: int, most_bits: int):
    """(id, fp) of every row, and (fp, root, component_id) of every fingerprint."""
    marked = stage(
        with_fingerprints(
            docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "text", "fp", shingle
        ).drop("text"),
        "simhash",
    )
    points = stage(marked.groupBy("fp").agg(F.min("id").alias("least")), "simhash-points")
    roots = components(hamming_links(points.select("fp"), most_bits))
    named = stage(
        points.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
            "fp", "least", F.coalesce("root", "fp").alias("root")
        ),
        "simhash-roots",
    )
    firsts = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return marked, named.join(firsts, "root").select("fp", "root", "component_id")


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = SHINGLE_WORDS,
    most_bits: int = MOST_BITS,
) -> DataFrame:
    """One row per row of ``docs``: id, fingerprint (16 hex digits), component_id.

    Texts are linked when their fingerprints differ in ``most_bits`` bits or
    fewer; component_id is the smallest id reachable, null only when all ids of
    a component are null.  Copies share one fingerprint and are searched once.
    Texts without words have fingerprint zero and are linked like any other.
    """
    marked, by_print = _grouped(docs, id_col, text_col, shingle, most_bits)
    return marked.join(by_print, "fp").select(
        F.col("id").alias(id_col),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
    )


def drop_near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = SHINGLE_WORDS,
    most_bits: int = MOST_BITS,
) -> DataFrame:
    """Rows of ``docs``, one per component: that with the smallest id, null ids last.

    Of rows of a component repeated with that id one stays.  Only ids that lose
    rows are looked up.
    """
    marked, by_print = _grouped(docs, id_col, text_col, shingle, most_bits)
    by_print = stage(by_print, "simhash-components")
    first = F.col("id").eqNullSafe(F.col("component_id"))
    ids = (
        marked.join(by_print, "fp")
        .groupBy("id")
        .agg(F.count("*").alias("n"), F.count(F.when(first, 1)).alias("stay"))
    )
    lost = stage(
        ids.where("stay = 0 or n > 1").select("id", (F.col("stay") > 0).alias("some")), "simhash-drops"
    )
    of, some = fresh(docs, "of", "some")
    marks = lost.toDF(of, some)
    kept = docs.join(marks, docs[id_col].eqNullSafe(marks[of]), "left_anti")
    if lost.where("some").isEmpty():
        return kept
    # Ids that occur more than once: each row goes by its own fingerprint.
    again = docs.join(marks.where(F.col(some)), docs[id_col].eqNullSafe(marks[of]), "left_semi")
    own, root, component = fresh(docs, "own", "root", "component")
    again = with_fingerprints(again, text_col, own, shingle).join(by_print.toDF(own, root, component), own)
    firsts = again.where(F.col(id_col).eqNullSafe(F.col(component))).dropDuplicates([id_col, root])
    return kept.unionByName(firsts.select(docs.columns))
