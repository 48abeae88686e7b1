"""Token counts at every prefix of a text, by dynamic programming over prefixes.

The number of tokens of a prefix is one more than that of the prefix before its
last token.  The counts of every prefix of every distinct piece are kept, so
that totals, truncation and budgets are lookups and sums.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from shopcast.llm.bpe import MergeTable
from shopcast.llm.common import map_text

#: Distinct pieces whose prefix counts a task remembers, at most.
PIECES_KEPT = 200_000
SEGMENT = 1 << 19

#: The piece pattern of byte-level vocabularies of this kind; a fixed value.
_PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
_CUT = re.compile(r"(?<=[0-9A-Za-z.,;:!?])(?=[ \n])")
_SHORT = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")


class PrefixCounter:
    """Exact token counts of texts and of all their prefixes."""

    def __init__(self, path: str):
        self.table = MergeTable(path)
        self._known: dict[str, array] = {}
        special = "|".join(re.escape(s) for s in sorted(self.table.special, key=len, reverse=True))
        self._special = re.compile(f"({special})") if special else None

    def learn(self, pieces: list[str]) -> None:
        """Counts by code point of all pieces not met yet, in one walk over their trie."""
        fresh = set(pieces)
        if len(self._known) + len(fresh) > PIECES_KEPT:
            self._known.clear()
        fresh.difference_update(self._known)
        spelled = {p.encode("utf-8"): p for p in fresh}
        for data, counts in self.table.prefix_counts(spelled):
            if len(data) != len(spelled[data]):
                counts = [counts[0], *(c for i, c in enumerate(counts[1:], 1)
                                       if i == len(data) or data[i] & 0xC0 != 0x80)]
            self._known[spelled[data]] = array("I", counts)

    def _counts(self, pieces: list[str]) -> list[array]:
        try:
            return [self._known[p] for p in pieces]
        except KeyError:
            self.learn(pieces)
            return [self._known[p] for p in pieces]

    def _parts(self, text: str) -> list[tuple[str, bool]]:
        """The text around special tokens, and those tokens."""
        if self._special is None or "<|" not in text:
            return [(text, False)]
        return [(p, bool(i % 2)) for i, p in enumerate(self._special.split(text)) if p]

    def _segments(self, text: str):
        at = 0
        while len(text) - at > SEGMENT:
            cut = _CUT.search(text, at + SEGMENT)
            if cut is None:
                break
            yield text[at : cut.start()]
            at = cut.start()
        yield text[at:]

    def count(self, texts: list) -> list[int]:
        """Tokens of each whole text; null and empty have none.

        Short texts are learned together, so that they share prefixes.
        """
        short = [t and len(t) <= SEGMENT and "<|" not in t for t in texts]
        pieces = [_PIECES.findall(t) if s else None for t, s in zip(texts, short, strict=True)]
        self.learn([p for found in pieces for p in found or ()])
        out = []
        for text, found in zip(texts, pieces, strict=True):
            total = 0
            if found is not None:
                total = sum([c[-1] for c in self._counts(found)])
            elif text:
                for part, whole in self._parts(text):
                    if whole:
                        total += 1
                        continue
                    for segment in self._segments(part):
                        total += sum([c[-1] for c in self._counts(_PIECES.findall(segment))])
            out.append(total)
        return out

    def at_prefixes(self, text: str | None) -> array:
        """Tokens of every prefix of the text, from the empty one to the whole.

        A prefix counts as the library would encode it alone: one that ends in a
        run of white space, in a contraction or in a special token is split
        differently from the whole text there.
        """
        out, base, before = array("I", [0]), 0, ""
        for part, whole in self._parts(text or ""):
            if whole:
                # Short of its end the token is ordinary text that goes on from what precedes it.
                start = base - (self._plain_prefixes(before)[-1] if before else 0)
                plain = self._plain_prefixes(before + part[:-1])
                out.extend(start + c for c in plain[len(before) + 1 :])
                base += 1
                out.append(base)
                before = ""
                continue
            plain = self._plain_prefixes(part)
            out.extend(base + c for c in plain[1:])
            base += plain[-1]
            before = part
        return out

    def _plain_prefixes(self, text: str) -> array:
        out, base = array("I", [0]), 0
        pieces = _PIECES.findall(text)
        blank_from, blank = 0, ""
        for piece, counts in zip(pieces, self._counts(pieces), strict=True):
            if piece in _SHORT:
                # "'r" alone is a mark and a letter.
                mark, letters = self._counts([piece[0], piece[1:]])
                inner = [mark[1], *(mark[1] + c for c in letters[1:-1])]
                out.extend(base + c for c in inner)
                out.append(base + counts[-1])
            elif piece.isspace():
                # A run of white space is one piece until something follows it.
                run = blank + piece
                [whole] = self._counts([run])
                out.extend(blank_from + c for c in whole[len(blank) + 1 :])
                if not blank:
                    blank_from = base
                    del out[len(out) - len(piece) :]
                    out.extend(base + c for c in whole[1:])
                blank = run
                base += counts[-1]
                continue
            elif blank and piece[0] == " ":
                [whole] = self._counts([blank + " "])
                out.append(blank_from + whole[-1])
                out.extend(base + c for c in counts[2:])
            else:
                out.extend(base + c for c in counts[1:])
            base += counts[-1]
            blank = ""
        return out

    def longest_within(self, text: str | None, budget: int) -> int:
        """Code points of the longest prefix with at most ``budget`` tokens."""
        counts = self.at_prefixes(text)
        return next(i for i in range(len(counts) - 1, -1, -1) if counts[i] <= budget)


def _with(docs: DataFrame, path: str, text_col: str, name: str, spark_type, arrow_type, use) -> DataFrame:
    def make() -> Callable[[list], list]:
        counter = PrefixCounter(path)
        return lambda texts: [use(counter, texts)]

    return map_text(docs, text_col, [(name, spark_type, arrow_type)], make)


def count_tokens(
    docs: DataFrame, tokenizer_path: str, text_col: str = "text", count_col: str = "n_tokens"
) -> DataFrame:
    """Rows of ``docs`` with the number of tokens of the whole text; null and empty have none.

    A column of ``docs`` with the name of the output stays; the output gets an underscore.
    """
    return _with(docs, tokenizer_path, text_col, count_col, T.LongType(), pa.int64(),
                 lambda c, ts: c.count(ts))


def prefix_token_counts(
    docs: DataFrame, tokenizer_path: str, text_col: str = "text", counts_col: str = "prefix_tokens"
) -> DataFrame:
    """Rows of ``docs`` with the token count of every prefix, by code points; null has one, 0.

    Names are kept free as by :func:`count_tokens`.
    """
    return _with(docs, tokenizer_path, text_col, counts_col, T.ArrayType(T.LongType()),
                 pa.list_(pa.int64()), lambda c, ts: [c.at_prefixes(t).tolist() for t in ts])


def truncate_to_budget(
    docs: DataFrame, tokenizer_path: str, budget: int, text_col: str = "text", out_col: str = "truncated"
) -> DataFrame:
    """Rows of ``docs`` with the longest prefix of the text within ``budget`` tokens; null stays null.

    Names are kept free as by :func:`count_tokens`.
    """
    if budget < 0:
        raise ValueError("a budget is not negative")
    return _with(docs, tokenizer_path, text_col, out_col, T.StringType(), pa.string(),
                 lambda c, ts: [None if t is None else t[: c.longest_within(t, budget)] for t in ts])
