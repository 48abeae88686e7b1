"""Spans of pattern matches as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPAN = "struct<start:int,end:int,hit:string>"
#: Items that a running list holds before it is set aside: appending copies the list.
_PART = 128


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once.

    A lambda that mentions an expression computes it again for each element;
    its own variables are plain values.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def running(
    items: Column, start: Column, item_type: str, step: Callable[[Column, Column], tuple[Column, Column, Column]]
) -> Column:
    """List made by going through ``items`` with a state.

    ``step`` takes (state, item) and returns (next state, whether to append,
    what to append).  Finished parts are set aside, so that time stays close
    to linear in the length.
    """
    empty = F.array().cast(f"array<{item_type}>")
    zero = F.struct(
        start.alias("state"), empty.alias("out"), F.array().cast(f"array<array<{item_type}>>").alias("done")
    )

    def merge(acc: Column, x: Column) -> Column:
        state, wanted, value = step(acc["state"], x)
        full = F.size(acc["out"]) >= _PART
        one = F.array(value)
        return F.struct(
            state.alias("state"),
            F.when(~wanted, acc["out"])
            .when(full, one)
            .otherwise(F.concat(acc["out"], one))
            .alias("out"),
            F.when(wanted & full, F.concat(acc["done"], F.array(acc["out"])))
            .otherwise(acc["done"])
            .alias("done"),
        )

    return F.aggregate(
        items, zero, merge, lambda acc: F.flatten(F.concat(acc["done"], F.array(acc["out"])))
    )


def match_spans(text: Column, pattern: Column | str) -> Column:
    """Leftmost non-overlapping matches: array of (start, end, hit), offsets in code points.

    The pattern must not match the empty text.  ``text`` should be a plain
    column: it is read twice.
    """
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    between = F.split(text, pattern, -1)
    hits = F.regexp_extract_all(text, pattern, F.lit(0))
    items = F.zip_with(between, hits, lambda p, h: F.struct(F.length(p).alias("gap"), h.alias("hit")))

    def step(at: Column, x: Column) -> tuple[Column, Column, Column]:
        begin = at + x["gap"]
        end = begin + F.coalesce(F.length(x["hit"]), F.lit(0))
        return end, x["hit"].isNotNull(), F.struct(
            begin.alias("start"), end.alias("end"), x["hit"].alias("hit")
        )

    return running(items, F.lit(0), _SPAN, step)
