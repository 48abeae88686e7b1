"""Helpers that several corpus operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: ASCII white space, as a regular expression of Java and Python.
SPACES = r"[\x20\x09-\x0D]+"
#: Bytes of text that one step inside a task works on.
SLICE_BYTES = 1 << 20


def single_spaced(text: Column) -> Column:
    """The text with each run of ASCII white space as one space; null as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that ``df`` does not use yet, with underscores appended where it does.

    This is the rule of all corpus operators that add columns: columns of the
    table stay as they are, in any letter case, and the added ones give way.
    """
    used, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out


def bind(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are computed once per row.

    A lambda that mentions an expression computes it again for every element;
    a generated column is a plain value to it.
    """
    for name, value in columns.items():
        df = df.select("*", F.explode(F.array(value)).alias(name))
    return df


def slices(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Parts of ``batch`` with about ``SLICE_BYTES`` of ``column`` each, in order."""
    start, held = 0, 0
    for i, value in enumerate(batch.column(column)):
        data = value.as_buffer()
        held += len(data) if data is not None else 0
        if held >= SLICE_BYTES:
            yield batch.slice(start, i + 1 - start)
            start, held = i + 1, 0
    if start < batch.num_rows:
        yield batch.slice(start)


def map_text(
    df: DataFrame,
    column: str,
    added: Sequence[tuple[str, T.DataType, pa.DataType]],
    make: Callable[[], Callable[[list], Sequence[Sequence]]],
) -> DataFrame:
    """Every row of ``df`` with columns computed from ``column`` by Python in tasks.

    ``make`` runs once per task and returns a function from a list of values to
    one list per added column.  Rows are neither moved nor reordered.  An added
    column whose name ``df`` uses already is named as :func:`fresh` says.
    """
    added = [(n, t, a) for n, (_, t, a) in zip(fresh(df, *(n for n, _, _ in added)), added)]
    schema = T.StructType([*df.schema.fields, *(T.StructField(n, t) for n, t, _ in added)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for part in slices(batch, column):
                found = work(part.column(column).to_pylist())
                arrays = [pa.array(v, type=a) for v, (_, _, a) in zip(found, added, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, *arrays], names=[*part.schema.names, *(n for n, _, _ in added)]
                )

    return df.mapInArrow(run, schema)
