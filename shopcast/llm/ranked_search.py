"""The best documents for every query item, by masks of the terms they hold.

A first pass over the texts keeps, of every document, its length and the counts
of the terms that any item asks for.  Scoring then runs over blocks of these
rows, in tasks: the presence bits of an item's terms form a mask per document,
equal masks are grouped, and every distinct mask has a maximum score from the
highest contribution of each of its terms in the block.  Masks are evaluated by
descending maximum, until the documents found so far cannot be beaten by the
rest.  Only the best rows of a task leave it.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shopcast.llm.common import slices
from shopcast.sources import stage

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
#: Distinct query terms that go to every task, about 150 bytes each there; more are joined by shuffle.
MOST_TERMS = 200_000
#: Terms of the items, with repeats, that one scoring pass holds, about 16 bytes each in a task; items
#: beyond it are scored in further passes over the counted terms.
PASS_TERMS = 2_000_000
#: Documents whose masks are compared at once, and their counted terms (about: one document may have more).
BLOCK_DOCS = 4_096
BLOCK_TERMS = 250_000
#: Counted terms that a task holds, 40 bytes each: documents are put in order of length among as many.
HELD_TERMS = 1_000_000

_COUNTED = "doc long, n long, terms array<int>, counts array<long>"


def terms_of(text: str | None) -> list[str]:
    """Words with A-Z in lower case, in order; null has none."""
    return WORD.findall((text or "").translate(LOWER))


def _term_lists(df: DataFrame, kind: str, wanted: frozenset | None, name: str) -> DataFrame:
    """(id, n, words, counts) of every row with a term; of ``wanted`` words only, where given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                ids, sizes, words, counts = [], [], [], []
                for i, text in zip(part.column("id").to_pylist(), part.column("text").to_pylist()):
                    found = terms_of(text)
                    if not found:
                        continue
                    seen = Counter(found if wanted is None else filter(wanted.__contains__, found))
                    ids.append(i)
                    sizes.append(len(found))
                    words.append(list(seen))
                    counts.append(list(seen.values()))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids, part.schema.field("id").type),
                        pa.array(sizes, pa.int64()),
                        pa.array(words, pa.list_(pa.string())),
                        pa.array(counts, pa.list_(pa.int64())),
                    ],
                    names=["id", "n", "words", "counts"],
                )

    return stage(
        df.mapInArrow(run, f"id {kind}, n long, words array<string>, counts array<long>"), name
    )


def _vocabulary(items: DataFrame, name: str) -> DataFrame:
    """Distinct words of the items, numbered from 0 without a gap."""
    words = items.select(F.explode("words").alias("word")).distinct()
    ordered = words.repartitionByRange("word").sortWithinPartitions("word")
    marked = stage(ordered.withColumn("id", F.monotonically_increasing_id()), name)
    runs = marked.groupBy(F.shiftright("id", 33).alias("part")).agg(
        F.count("*").alias("rows"), F.min("id").alias("first")
    )
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # One row per task that has numbered words.
    shift = runs.select("part", (F.coalesce(F.sum("rows").over(before), F.lit(0)) - F.col("first")).alias("shift"))
    placed = marked.withColumn("part", F.shiftright("id", 33)).join(shift, "part")
    return placed.select("word", (F.col("id") + F.col("shift")).cast("int").alias("term"))


def _counted(docs: DataFrame, vocabulary: DataFrame, size: int) -> DataFrame:
    """(doc, n, terms, counts) of every document with a term at all."""
    if size <= MOST_TERMS:
        number = {r["word"]: r["term"] for r in vocabulary.toLocalIterator()}

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            get = number.get
            for batch in batches:
                for part in slices(batch, "text"):
                    ids, sizes, terms, counts, bounds = [], [], [], [], [0]
                    for i, text in zip(part.column("id").to_pylist(), part.column("text").to_pylist()):
                        found = terms_of(text)
                        if not found:
                            continue
                        seen = Counter(map(get, found))
                        seen.pop(None, None)
                        ids.append(i)
                        sizes.append(len(found))
                        terms.extend(seen)
                        counts.extend(seen.values())
                        bounds.append(len(terms))
                    cuts = pa.array(bounds, pa.int32())
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(ids, pa.int64()),
                            pa.array(sizes, pa.int64()),
                            pa.ListArray.from_arrays(cuts, pa.array(terms, pa.int32())),
                            pa.ListArray.from_arrays(cuts, pa.array(counts, pa.int64())),
                        ],
                        names=["doc", "n", "terms", "counts"],
                    )

        return stage(docs.mapInArrow(run, _COUNTED), "search-counted")
    # Too many words to send: all terms of the documents meet them by shuffle.  Rows, not ids, are
    # brought together again, as ids may repeat.
    every = _term_lists(docs, "long", None, "search-terms").withColumn("row", F.monotonically_increasing_id())
    every = stage(every, "search-rows")
    flat = every.select("row", F.inline(F.arrays_zip(F.col("words").alias("word"), "counts")))
    met = flat.join(vocabulary, "word").groupBy("row").agg(F.collect_list(F.struct("term", "counts")).alias("t"))
    joined = every.select("row", F.col("id").alias("doc"), "n").join(met, "row", "left")
    none = F.array().cast("array<struct<term:int,counts:bigint>>")
    return stage(
        joined.select("doc", "n", F.coalesce("t", none).alias("t")).select(
            "doc", "n", F.col("t.term").alias("terms"), F.col("t.counts").alias("counts")
        ),
        "search-counted",
    )


def _document_counts(counted: DataFrame) -> DataFrame:
    """(term, df); every task adds up its own rows first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(0, np.int64)
        for batch in batches:
            terms = batch.column("terms").flatten().to_numpy()
            if len(terms):
                more = np.bincount(terms, minlength=len(seen))
                more[: len(seen)] += seen
                seen = more
        held = np.flatnonzero(seen)
        for at in range(0, len(held), 1 << 16):
            some = held[at : at + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(seen[some])], names=["term", "df"])

    return counted.select("terms").mapInArrow(run, "term int, df long").groupBy("term").agg(F.sum("df").alias("df"))


class _Best:
    """The best rows of every item seen so far: score, then smaller id, null ids last."""

    def __init__(self, items: int, top: int) -> None:
        self.top = top
        self.scores = [np.empty(0, np.int64)] * items
        self.docs = [np.empty(0, np.int64)] * items
        self.blank = [np.empty(0, bool)] * items

    def least(self, item: int) -> int:
        """A score below this one cannot enter any more."""
        held = self.scores[item]
        return int(held[-1]) if len(held) == self.top else 1

    def add(self, item: int, scores: np.ndarray, docs: np.ndarray, blank: np.ndarray) -> None:
        use = scores >= self.least(item)
        if not use.any():
            return
        s = np.concatenate((self.scores[item], scores[use]))
        d = np.concatenate((self.docs[item], docs[use]))
        b = np.concatenate((self.blank[item], blank[use]))
        order = np.lexsort((d, b, -s))[: self.top]
        self.scores[item], self.docs[item], self.blank[item] = s[order], d[order], b[order]


def _within(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places of several ranges one after the other, and where each range begins among them."""
    lengths = ends - starts
    begin = np.concatenate(([0], np.cumsum(lengths)))
    return np.repeat(starts - begin[:-1], lengths) + np.arange(begin[-1]), begin


def _search_block(best: _Best, items: list, weights: np.ndarray, scale: tuple, rows: tuple) -> None:
    """All items over one block: (docs, blank, n, term per entry, count per entry, entries' bounds)."""
    docs, blank, n, terms, counts, bounds = rows
    base, total, tokens = scale
    if not len(terms):
        return
    of = np.repeat(np.arange(len(docs)), np.diff(bounds))
    m = 100 - base + base * n * total // tokens
    worth = weights[terms] * (1_000_000_000 * counts // (1000 * counts + 20 * m[of]))
    # What a term adds at most to a document of the block, and the bitmap of its documents.
    held, local = np.unique(terms, return_inverse=True)
    most = np.zeros(len(held), np.int64)
    np.maximum.at(most, local, worth)
    presence = np.zeros((len(held), -(-len(docs) // 8)), np.uint8)
    np.bitwise_or.at(presence, (local, of >> 3), (128 >> (of & 7)).astype(np.uint8))
    place = np.full(len(weights), -1, np.int32)
    place[held] = np.arange(len(held))
    asked = np.zeros(len(held), bool)
    for item, wanted in items:
        at = place[wanted]
        at = at[at >= 0]
        if not len(at) or most[at].sum() < best.least(item):
            continue
        # One mask per document, 64 terms a word: the terms' bitmaps, read across.
        words = [at[i : i + 64] for i in range(0, len(at), 64)]
        across = lambda some: np.unpackbits(presence[some], axis=1, count=len(docs))
        masks = np.zeros((len(docs), 8 * len(words)), np.uint8)
        for i, some in enumerate(words):
            packed = np.packbits(across(some), axis=0).T
            masks[:, 8 * i : 8 * i + packed.shape[1]] = packed
        keys = masks.view(np.uint64 if len(words) == 1 else np.dtype((np.void, 8 * len(words))))[:, 0]
        _, member, group = np.unique(keys, return_index=True, return_inverse=True)
        bound = sum(most[some] @ across(some)[:, member].astype(np.int64) for some in words)
        ranked = np.argsort(-bound, kind="stable")
        ranked = ranked[bound[ranked] >= best.least(item)]
        # Documents in the order of their masks' maxima, in growing steps, until the rest cannot reach.
        rank = np.full(len(bound), len(ranked))
        rank[ranked] = np.arange(len(ranked))
        of_doc = rank[group]
        line = np.argsort(of_doc, kind="stable")
        line = line[: np.searchsorted(of_doc[line], len(ranked))]
        asked[at] = True
        done, step = 0, best.top
        while done < len(line):
            some = line[done : done + step]
            some = some[bound[ranked[of_doc[some]]] >= best.least(item)]
            if not len(some):
                break
            entries, begin = _within(bounds[some], bounds[some + 1])
            sums = np.concatenate(([0], np.cumsum(np.where(asked[local[entries]], worth[entries], 0))))
            best.add(item, sums[begin[1:]] - sums[begin[:-1]], docs[some], blank[some])
            done, step = done + step, step * 2
        asked[at] = False


def _cuts(sizes: np.ndarray, most_rows: int, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows with at most ``most_rows`` rows and about ``most`` entries each."""
    ends, start = np.cumsum(sizes), 0
    while start < len(sizes):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, min(start + most_rows, int(np.searchsorted(ends, before + most, "right"))))
        yield start, stop
        start = stop


def _scored(counted: DataFrame, items: list, weights: np.ndarray, scale: tuple, top: int) -> DataFrame:
    """The best rows of every task for every item: (item, doc, score)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(len(items), top)
        numbered = list(enumerate(items))

        def search(held: list[pa.RecordBatch]) -> None:
            rows = pa.concat_batches(held)
            n = rows.column("n").to_numpy()
            # Documents of like lengths share a block: its maxima are then near their scores.
            rows = rows.take(pa.array(np.argsort(n, kind="stable")))
            sizes = rows.column("terms").value_lengths().to_numpy()
            for start, stop in _cuts(sizes, BLOCK_DOCS, BLOCK_TERMS):
                block = rows.slice(start, stop - start)
                lists = block.column("terms")
                bounds = np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy())))
                ids = block.column("doc")
                _search_block(
                    best, numbered, weights, scale,
                    (
                        ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False),
                        block.column("n").to_numpy(), lists.flatten().to_numpy(),
                        block.column("counts").flatten().to_numpy(), bounds,
                    ),
                )

        held, size = [], 0
        for batch in batches:
            sizes = batch.column("terms").value_lengths().to_numpy()
            for start, stop in _cuts(sizes, len(sizes), HELD_TERMS):
                held.append(batch.slice(start, stop - start))
                size += int(sizes[start:stop].sum())
                if size >= HELD_TERMS:
                    search(held)
                    held, size = [], 0
        if held:
            search(held)
        for item in range(len(items)):
            found = len(best.docs[item])
            if found:
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(found, item)),
                        pa.array(best.docs[item], mask=best.blank[item]),
                        pa.array(best.scores[item]),
                    ],
                    names=["item", "doc", "score"],
                )

    return counted.mapInArrow(run, "item long, doc long, score long")


def _passes(items: DataFrame) -> Iterator[list]:
    """Items in groups of bounded size, streamed through the driver."""
    held, size = [], 0
    for row in items.toLocalIterator():
        held.append((row["id"], np.array(sorted(row["terms"]), np.int64)))
        size += len(row["terms"]) + 1
        if size >= PASS_TERMS:
            yield held
            held, size = [], 0
    if held:
        yield held


def search(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    top: int = 50,
    base: int = 50,
) -> DataFrame:
    """For every item its ``top`` documents with a score above 0: item, rank, document, score.

    Terms are the words of the whole text with A-Z in lower case; null has none.
    A term of an item that tf of a document's n words equal adds
    ``w * (10**9 * tf // (1000 * tf + 20 * m))``, with
    ``w = floor(1000 * ln((2 N + 2) / (2 df + 1)))`` and
    ``m = 100 - base + base * n * N // L``; N documents hold L terms, df of them
    the term.  Equal scores go by ascending id, null last.  Every row is a
    document and every row of ``items`` is an item, repeated ones too; ids of
    documents are integers, ids of items of any type; both need names of their own,
    other than ``rank`` and ``score``, or the call is refused.
    Other columns are not read, whatever their names.  Without documents or
    items the result is empty.

    Texts are read once.  Up to ``MOST_TERMS`` query words are sent to tasks,
    more meet the documents' terms by shuffle; items beyond ``PASS_TERMS`` are
    scored in further passes over the counted terms.  A task holds
    ``HELD_TERMS`` counted terms and ``top`` rows per item.
    """
    spark = docs.sparkSession
    if len({c.lower() for c in (item_col, "rank", id_col, "score")}) < 4:
        raise ValueError("ids of items and documents need names of their own, other than rank and score")
    if docs.schema[id_col].dataType.typeName() not in ("byte", "short", "integer", "long"):
        raise ValueError(f"{id_col} must be an integer column")
    kind = items.schema[item_col].dataType.simpleString()
    named = items.select(F.col(item_col).alias("id"), F.col(item_text_col).alias("text"))
    asked = _term_lists(named, kind, None, "search-items")
    vocabulary = stage(_vocabulary(asked, "search-words"), "search-vocabulary")
    size = vocabulary.count()
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    counted = _counted(texts, vocabulary, size)
    total, tokens = counted.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    # Numbers of documents, one per query word: 8 bytes each on the driver.
    weights = np.zeros(size, np.int64)
    weight = F.floor(1000 * F.log((2.0 * total + 2) / (2.0 * F.col("df") + 1))).cast("long")
    for row in _document_counts(counted).select("term", weight.alias("w")).toLocalIterator():
        weights[row["term"]] = row["w"]
    listed = asked.withColumn("row", F.monotonically_increasing_id())
    flat = stage(listed, "search-listed").select("row", "id", F.explode("words").alias("word"))
    listed = flat.join(vocabulary, "word").groupBy("row").agg(F.first("id").alias("id"), F.collect_list("term").alias("terms"))
    out = spark.createDataFrame([], f"id {kind}, doc long, score long, item long, pass int")
    for number, group in enumerate(_passes(stage(listed, "search-asked"))):
        ids = spark.createDataFrame([(i, item) for i, (item, _) in enumerate(group)], f"item long, id {kind}")
        found = _scored(counted, [t for _, t in group], weights, (base, total, tokens), top)
        found = found.join(F.broadcast(ids), "item").withColumn("pass", F.lit(number))
        out = out.unionByName(found.select(out.columns))
    order = Window.partitionBy("pass", "item").orderBy(F.col("score").desc(), F.col("doc").asc_nulls_last())
    ranked = out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select(F.col("id").alias(item_col), "rank", F.col("doc").alias(id_col), "score")
