"""Column expressions that render typed values as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shopcast import fixed


def _plain(value: Column, digits: int) -> Column:
    """Fixed digits, half-even on the exact binary value, no thousands mark."""
    return F.translate(F.format_number(value, digits), ",", "")


def percent_text(fraction: Column, digits: int) -> Column:
    return F.concat(_plain(fraction.cast("double") * 100, digits), F.lit("%"))


def number_text(value: Column) -> Column:
    """A double as the shortest decimal text: 1e-4 <= |v| < 1e16 plain, else 1e+16."""
    value = value.cast("double")
    short = value.cast("string")
    size = F.abs(value)
    mantissa = F.regexp_replace(F.split_part(short, F.lit("E"), F.lit(1)), r"\.0$", "")
    exponent = F.split_part(short, F.lit("E"), F.lit(2)).cast("int")
    wide = F.regexp_replace(short.try_cast("decimal(38,10)").cast("string"), r"(\.\d+?)0*$", "$1")
    small = F.regexp_replace(short.try_cast("decimal(38,28)").cast("string"), r"(\.\d+?)0*$", "$1")
    scientific = F.concat(
        mantissa,
        F.when(exponent < 0, F.lit("e-")).otherwise(F.lit("e+")),
        F.lpad(F.abs(exponent).cast("string"), 2, "0"),
    )
    return (
        F.when(F.isnan(value), F.lit("nan"))
        .when(size == float("inf"), F.when(value > 0, F.lit("inf")).otherwise(F.lit("-inf")))
        .when(~short.contains("E"), short)
        .when((size >= 1e7) & (size < 1e16), wide)
        .when((size >= 1e-4) & (size < 1), small)
        .otherwise(scientific)
    )


def plain_text(value: Column, physical: str = "string") -> Column:
    """Text of any value; doubles through :func:`number_text`."""
    if physical in ("double", "float"):
        return number_text(value)
    if physical == "boolean":
        return F.when(value, F.lit("True")).otherwise(F.when(~value, F.lit("False")))
    return value.cast("string")


def format_value(value: Column, data_type: str, physical: str = "string") -> Column:
    """Render one value by its logical type; null and NaN give ``N/A``."""
    floating = physical in ("double", "float")
    missing = (value.isNull() | F.isnan(value)) if floating else value.isNull()
    if data_type == "binary":
        truthy = value if physical == "boolean" else (
            value != "" if physical == "string" else value != 0
        )
        text = F.when(truthy, F.lit(fixed.YES)).otherwise(F.lit(fixed.NO))
    elif data_type == "percent":
        text = percent_text(value, 1)
    elif data_type == "integer":
        text = F.format_number(value.cast("bigint"), 0)
    elif data_type == "float":
        text = _plain(value.cast("double"), 2)
    else:
        text = plain_text(value, physical)
    return F.when(missing, F.lit(fixed.MISSING)).otherwise(text)


def whole_number_text(value: Column, physical: str, names: dict[str, str] | None = None) -> Column:
    """Half-even whole number with thousands marks; strings through a dictionary."""
    if physical == "string":
        text = value
    else:
        text = F.format_number(F.bround(value.cast("double")), 0)
    if names:
        lookup = F.create_map(*[F.lit(part) for pair in names.items() for part in pair])
        text = F.coalesce(F.try_element_at(lookup, text), text)
    return F.coalesce(text, F.lit(fixed.MISSING))


def bare_number_text(value: Column, physical: str) -> Column:
    """Whole numbers without decimals or marks, others with two decimals."""
    if physical == "string":
        text = value
    else:
        number = value.cast("double")
        text = F.when(number == F.floor(number), number.cast("bigint").cast("string")).otherwise(
            _plain(number, 2)
        )
    return F.coalesce(text, F.lit(fixed.MISSING))


def one_decimal_text(value: Column) -> Column:
    return _plain(value.cast("double"), 1)
