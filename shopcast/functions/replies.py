"""Column expressions that read labels, brands and confidence from reply text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shopcast import fixed


def class_text(value: Column) -> Column:
    """A text holding 1 means accept, else one holding 0 means refuse, else null."""
    text = value.cast("string")
    return F.when(text.contains("1"), F.lit(fixed.ACCEPT)).when(
        text.contains("0"), F.lit(fixed.REFUSE)
    )


def class_number(text: Column) -> Column:
    return F.when(text.contains(fixed.ACCEPT), F.lit(1)).when(
        text.contains(fixed.REFUSE), F.lit(0)
    )


def label_sentence(label: Column) -> Column:
    return F.when(label == 1, F.lit(fixed.ACCEPT + ".")).when(
        label == 0, F.lit(fixed.REFUSE + ".")
    )


def click_flag(click: Column) -> Column:
    return F.when(click.cast("int") == 1, F.lit(True)).when(
        click.cast("int") == 0, F.lit(False)
    )


def clean_brands(text: Column) -> Column:
    """Drop the word brand, quotes, braces, dots and spaces; end the list with a dot."""
    bare = F.translate(F.replace(text, F.lit("brand"), F.lit("")), "':\"{}. ", "")
    return F.concat(F.array_join(F.split(bare, ","), ", "), F.lit("."))


def brand_list(text: Column) -> Column:
    return F.filter(F.split(F.translate(text, "\n. ", ""), ","), lambda item: item != "")


def confidence_number(text: Column) -> Column:
    """The largest whole number up to 100 in the text, else 0."""
    numbers = F.transform(
        F.regexp_extract_all(text.cast("string"), F.lit(r"(\d+)"), F.lit(1)),
        lambda digits: digits.try_cast("int"),
    )
    return F.coalesce(F.array_max(F.filter(numbers, lambda n: n <= 100)), F.lit(0))


def _find(text: Column, mark: str) -> Column:
    """Zero-based position of ``mark``, -1 when absent."""
    return F.locate(mark, text) - 1


def _cut(text: Column, start: Column, end: Column) -> Column:
    """Text from ``start`` up to ``end``; negative positions count from the end."""
    size = F.length(text)
    first = F.greatest(F.when(start < 0, size + start).otherwise(start), F.lit(0))
    last = F.greatest(F.when(end < 0, size + end).otherwise(end), F.lit(0))
    return F.substring(text, first + 1, F.greatest(last - first, F.lit(0)))


def loose_reply(text: Column, task: str) -> Column:
    """Cut a free-text reply at its answer, confidence and reason words."""
    answer_at, response_at = _find(text, fixed.ANSWER_MARK), _find(text, fixed.RESPONSE_MARK)
    start = F.when(
        (F.greatest(answer_at, F.lit(0)) != 0) & (response_at >= 0), response_at
    ).otherwise(F.greatest(answer_at, F.lit(0)))
    confidence_at = _find(text, fixed.CONFIDENCE_MARK)
    reason_at = _find(text, fixed.REASON_MARK)
    answer = _cut(text, start, confidence_at)
    return F.struct(
        _answer(answer, task).alias("answer"),
        confidence_number(_cut(text, confidence_at, reason_at)).alias("confidence"),
        F.replace(
            _cut(text, reason_at, F.length(text)), F.lit(fixed.END_OF_TURN), F.lit("")
        ).alias("reason"),
    )


def _answer(text: Column, task: str) -> Column:
    if task == "rec":
        return clean_brands(text)
    if task == "cls":
        return F.coalesce(class_number(text).cast("string"), F.lit(""))
    raise ValueError("task must be 'cls' or 'rec'")


def reply_fields(text: Column, task: str) -> Column:
    """Read the reply as an object first, and loosely where that fails.

    The text is parsed as data, never evaluated.
    """
    brace = F.locate("{", text)
    body = F.when(brace > 0, F.substring(text, brace, F.length(text))).otherwise(text)
    parsed = F.from_json(
        body,
        "answer string, brand string, confidence string, reason string",
        {"allowSingleQuotes": "true"},
    )
    field = parsed["brand"] if task == "rec" else parsed["answer"]
    usable = field.isNotNull() & parsed["confidence"].isNotNull() & parsed["reason"].isNotNull()
    loose = loose_reply(body, task)
    return F.struct(
        F.when(usable, _answer(field, task)).otherwise(loose["answer"]).alias("answer"),
        (
            F.when(usable, confidence_number(parsed["confidence"])).otherwise(loose["confidence"])
            * F.lit(0.01)
        ).alias("confidence"),
        F.when(usable, parsed["reason"]).otherwise(loose["reason"]).alias("reason"),
    )


def strip_label_sentences(text: Column, names: list[str]) -> Column:
    """Remove ``<name> is <value>.`` for each label column name."""
    for name in names:
        quoted = "".join(ch if ch.isalnum() or ch == " " else "\\" + ch for ch in name)
        text = F.regexp_replace(text, quoted + r" is [^.]+\.", "")
    return text


def profile_body(reply: Column) -> Column:
    """Newlines out, then the text after the first ``profile:`` if there is one."""
    flat = F.replace(reply, F.lit("\n"), F.lit(""))
    at = F.locate(fixed.PROFILE_MARK, F.lower(flat))
    return F.when(
        at > 0, F.substring(flat, at + F.lit(len(fixed.PROFILE_MARK)), F.length(flat))
    ).otherwise(flat)


def map_items(text: Column, names: dict[str, str]) -> Column:
    """Map each item of a comma list through a dictionary; unknown items stay."""
    lookup = F.create_map(*[F.lit(part) for pair in names.items() for part in pair])
    items = F.split(F.translate(text, ". ", ""), ",")
    return F.array_join(
        F.transform(items, lambda item: F.coalesce(F.try_element_at(lookup, item), item)), ", "
    )
