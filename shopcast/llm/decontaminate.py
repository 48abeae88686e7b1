"""Benchmark decontamination with one Aho-Corasick automaton.

Texts are normalised to words; every window of ``n`` consecutive words of a
benchmark item is a pattern, and a text is scanned once for all of them.  Hits
are spans of words, mapped back to offsets in the original text.  Patterns
that are too many for one automaton are dealt to several by their hash; texts
are then scanned once for each, and the hits of a row are joined.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shopcast.llm.common import fresh, map_text
from shopcast.llm.spans import running
from shopcast.sources import stage

WINDOW = 10
#: Bytes of patterns that one automaton is built from: measured, it takes 45 bytes for each, and the lists 3.
MOST_BYTES = 8_000_000

#: Upper-case ASCII to lower case, all other ASCII but letters and digits to a space.
_TABLE = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)
)
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words_of(text: str | None) -> list[bytes]:
    """Words of a text in UTF-8; null has none."""
    return (text or "").encode("utf-8", "replace").translate(_TABLE).split()


@dataclass(frozen=True)
class Windows:
    """Distinct patterns, and for each the positions of its items in ``items``."""

    patterns: list[str]
    owners: list[list[int]]
    items: list


def item_windows(
    benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", n: int = WINDOW
) -> DataFrame:
    """(id, window) of all items: ``n`` consecutive words, or all words of a shorter item.

    Items without words (null, empty) have no window.
    """
    def make() -> Callable[[list], list]:
        def work(texts: list) -> list:
            out = []
            for words in map(words_of, texts):
                starts = range(max(1, len(words) - n + 1)) if words else ()
                out.append([b" ".join(words[at : at + n]).decode("utf-8", "replace") for at in starts])
            return [out]

        return work

    rows = benchmark.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    cut = map_text(rows, "text", [("windows", T.ArrayType(T.StringType()), pa.list_(pa.string()))], make)
    return cut.select("id", F.explode("windows").alias("window"))


def collected(windows: DataFrame) -> Windows:
    """Windows as patterns on the driver, ``MOST_BYTES`` or about so."""
    found: dict[str, set[int]] = {}
    items: dict = {}
    for row in windows.distinct().collect():
        found.setdefault(row["window"], set()).add(items.setdefault(row["id"], len(items)))
    patterns = sorted(found)
    return Windows([f" {p} " for p in patterns], [sorted(found[p]) for p in patterns], list(items))


def _automaton(windows: Windows) -> ahocorasick.Automaton:
    made = ahocorasick.Automaton()
    for i, pattern in enumerate(windows.patterns):
        made.add_word(pattern, (i, pattern.count(" ") - 1, len(pattern)))
    if windows.patterns:
        made.make_automaton()
    return made


def _occurrences(machine: ahocorasick.Automaton, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
    """Word spans that windows cover, joined where they touch or overlap, and the patterns."""
    line = f" {b' '.join(words).decode('utf-8', 'replace')} "
    hits = list(machine.iter(line))
    if not hits:
        return [], set()
    blanks = np.flatnonzero(np.frombuffer(line.encode("utf-32-le"), "<u4") == 32)
    spans = sorted(
        (int(np.searchsorted(blanks, end)) - size, int(np.searchsorted(blanks, end)))
        for end, (_, size, _) in hits
    )
    joined = [list(spans[0])]
    for start, end in spans[1:]:
        if start <= joined[-1][1]:
            joined[-1][1] = max(joined[-1][1], end)
        else:
            joined.append([start, end])
    return [(a, b) for a, b in joined], {i for _, (i, _, _) in hits}


def _text_spans(text: str, spans: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """Code point offsets in the original text of spans of words."""
    places = [m.span() for m in _WORD.finditer(text)]
    for start, end in spans:
        yield places[start][0], places[end - 1][1]


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    n: int = WINDOW,
    names: tuple[str, str, str, str] = ("n_words", "n_hit", "items", "hit_spans"),
) -> DataFrame:
    """Rows of ``docs`` with word count, words hit, items found and spans in the text.

    A word is hit when any occurrence of a window covers it.  ``items`` lists the
    ids, as text and in that order, of items with an occurring window; an item
    without an id is listed as an empty text.  ``hit_spans`` are code point
    offsets, end exclusive.  Null and empty texts have no words; an empty
    benchmark hits nothing.  A column of ``docs`` with the name of an output
    stays; the output gets an underscore.
    """
    names = tuple(fresh(docs, *names))
    every = item_windows(benchmark, item_col, item_text_col, n)
    size = every.agg(F.sum(F.octet_length("window"))).collect()[0][0] or 0
    parts = math.ceil(size / MOST_BYTES)
    if parts > 1:
        return _found_by_parts(docs, every, parts, text_col, names)
    (found,) = fresh(docs, "found")
    rows = _scanned(docs, collected(every), text_col, found)
    parts_of = (F.col(f"{found}.{c}") for c in ("spans", "items", "n_words"))
    return _with_results(rows, docs.columns, *parts_of, names)


def _scanned(docs: DataFrame, windows: Windows, text_col: str, out_col: str) -> DataFrame:
    """``docs`` with (n_words, spans, items) of one automaton; spans in words and in code points."""
    labels = ["" if i is None else str(i) for i in windows.items]

    def make() -> Callable[[list], list]:
        machine = _automaton(windows)

        def work(texts: list) -> list:
            out = []
            for text in texts:
                words = words_of(text)
                spans, patterns = _occurrences(machine, words) if words and windows.patterns else ([], set())
                owners = {labels[o] for p in patterns for o in windows.owners[p]}
                places = _text_spans(text, spans) if spans else ()
                out.append({
                    "n_words": len(words),
                    "spans": [
                        {"first": a, "last": b, "start": start, "end": end}
                        for (a, b), (start, end) in zip(spans, places)
                    ],
                    "items": sorted(owners),
                })
            return [out]

        return work

    names = ("first", "last", "start", "end")
    span = T.StructType([T.StructField(c, T.LongType()) for c in names])
    found = T.StructType([
        T.StructField("n_words", T.LongType()), T.StructField("spans", T.ArrayType(span)),
        T.StructField("items", T.ArrayType(T.StringType())),
    ])
    arrow = pa.struct([
        ("n_words", pa.int64()), ("spans", pa.list_(pa.struct([(c, pa.int64()) for c in names]))),
        ("items", pa.list_(pa.string())),
    ])
    return map_text(docs, text_col, [(out_col, found, arrow)], make)


def _with_results(
    rows: DataFrame, keep: list[str], spans: Column, items: Column, n_words: Column, names: tuple[str, str, str, str]
) -> DataFrame:
    hit = F.aggregate(spans, F.lit(0).cast("long"), lambda acc, s: acc + s["last"] - s["first"])
    places = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
    return rows.select(*keep, *(c.alias(name) for c, name in zip((n_words, hit, items, places), names, strict=True)))


def _joined(spans: Column) -> Column:
    """Spans joined where they touch or overlap, in words."""
    kind = "struct<first:bigint,last:bigint,start:bigint,end:bigint>"
    none, last = (
        F.struct(*(F.lit(v).cast("long").alias(c) for c in ("first", "last", "start", "end"))) for v in (-1, 1 << 62)
    )

    def step(open_: Column, x: Column) -> tuple[Column, Column, Column]:
        touch = x["first"] <= open_["last"]
        both = F.struct(
            open_["first"].alias("first"), F.greatest(open_["last"], x["last"]).alias("last"),
            open_["start"].alias("start"), F.greatest(open_["end"], x["end"]).alias("end"),
        )
        return F.when(touch, both).otherwise(x), ~touch & (open_["first"] >= 0), open_

    return running(F.concat(F.array_sort(spans), F.array(last)), none, kind, step)


def _found_by_parts(
    docs: DataFrame, every: DataFrame, parts: int, text_col: str, names: tuple[str, str, str, str]
) -> DataFrame:
    """One automaton after the other; the hits of a row come together by its place."""
    place, found, spans, items = fresh(docs, "place", "found", "spans", "items")
    rows = stage(docs.withColumn(place, F.monotonically_increasing_id()), "decontaminate-docs")
    windows = stage(
        every.distinct().withColumn("part", F.pmod(F.xxhash64("window"), F.lit(parts))), "decontaminate-windows"
    )
    texts, hits = rows.select(place, text_col), None
    for part in range(parts):
        some = collected(windows.where(F.col("part") == part).drop("part"))
        seen = _scanned(texts, some, text_col, found).where(F.size(f"{found}.spans") > 0).select(place, f"{found}.*")
        seen = stage(seen.select(place, "spans", "items"), "decontaminate-hits")
        hits = seen if hits is None else hits.unionByName(seen)
    by_row = hits.groupBy(F.col(place).alias("at")).agg(
        F.flatten(F.collect_list("spans")).alias(spans), F.flatten(F.collect_list("items")).alias(items)
    )
    by_row = by_row.select(
        F.col("at").alias(place), _joined(F.col(spans)).alias(spans), F.array_sort(F.array_distinct(items)).alias(items)
    )
    counted = _scanned(rows, Windows([], [], []), text_col, found).join(by_row, place, "left")
    no_spans = F.array().cast("array<struct<first:bigint,last:bigint,start:bigint,end:bigint>>")
    whole = counted.withColumn(spans, F.coalesce(spans, no_spans)).withColumn(
        items, F.coalesce(items, F.array().cast("array<string>"))
    )
    return _with_results(whole, docs.columns, F.col(spans), F.col(items), F.col(f"{found}.n_words"), names)
