"""Encoding and decoding with a byte pair vocabulary whose words carry an end mark.

Texts are split into words as the vocabulary's file says; a task encodes each
distinct word once, by a walk over the trie of the words it has not met yet.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from tokenizers import Tokenizer

from shopcast.llm.bpe import MergeTable, byte_letters, token_names
from shopcast.llm.common import map_text

#: Distinct words whose encoding a task remembers, at most; then it forgets and goes on.
WORDS_KEPT = 100_000
#: Characters that are split into words at once.
SEGMENT = 1 << 19

#: The word pattern of the vocabulary file; a fixed value.
_WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: Texts of these characters only need no composing, and lower case letter by letter.
_SIMPLE = re.compile(r"[\x00-˿‐-‧‰-⁞₠-₿]*")
_BLANK = re.compile(r"[\t-\r \x85\xa0]")


class WordCodec:
    """Encodes whole texts to packed ids; keeps what it has met."""

    def __init__(self, path: str):
        self.table = MergeTable(path)
        library = Tokenizer.from_file(path)
        self._normalise = library.normalizer.normalize_str
        self._split = library.pre_tokenizer.pre_tokenize_str
        self._letters = byte_letters()
        self._known: dict[str, bytes] = {}
        self._earlier: dict[str, bytes] = {}
        special = "|".join(re.escape(s) for s in sorted(self.table.special, key=len, reverse=True))
        self._special = re.compile(f"({special})") if special else None

    def _words(self, text: str) -> list[str]:
        if _SIMPLE.fullmatch(text):
            return _WORDS.findall(text.lower())
        # Other scripts: the library's own normaliser and splitter, then back to characters.
        pieces = self._split(self._normalise(text))
        return [bytes(self._letters[c] for c in p).decode("utf-8") for p, _ in pieces]

    def _segments(self, text: str) -> Iterator[str]:
        """Parts of a long text, cut at white space, which no word contains."""
        at = 0
        while len(text) - at > SEGMENT:
            cut = _BLANK.search(text, at + SEGMENT)
            if cut is None:
                break
            yield text[at : cut.start()]
            at = cut.start()
        yield text[at:]

    def _parts(self, text: str) -> Iterator[tuple[int | None, list[str]]]:
        """Special ids and lists of words, in order."""
        parts = [text]
        if self._special is not None and "<|" in text:
            parts = self._special.split(text)
        for i, part in enumerate(parts):
            if i % 2:
                yield self.table.special[part], []
            else:
                for segment in self._segments(part):
                    yield None, self._words(segment)

    def learn(self, words: set[str]) -> None:
        """Encode the words not met yet in one walk over their trie.

        A full memory becomes the earlier one, from which words that occur again
        come back: frequent words are not encoded anew.
        """
        fresh = words.difference(self._known)
        if len(self._known) + len(fresh) > WORDS_KEPT // 2:
            self._earlier, self._known, fresh = self._known, {}, words
        known, earlier, spelled = self._known, self._earlier, {}
        for word in fresh:
            packed = earlier.get(word)
            if packed is None:
                spelled[word.encode("utf-8")] = word
            else:
                known[word] = packed
        for word, ids in self.table.encoded(spelled):
            known[spelled[word]] = array("I", ids).tobytes()

    def _packed(self, words: list[str]) -> bytes:
        try:
            return b"".join([self._known[w] for w in words])
        except KeyError:
            self.learn(set(words))
            return b"".join([self._known[w] for w in words])

    def pack(self, texts: list) -> list[bytes]:
        """Ids of each text as little-endian 32-bit numbers; null and empty give none.

        Short texts are learned together, so that they share prefixes; of a long
        one the words of a segment only are in memory.
        """
        held = [list(self._parts(t or "")) if len(t or "") <= SEGMENT else None for t in texts]
        fresh: set[str] = set()
        for parts in held:
            for _, words in parts or ():
                fresh.update(words)
        self.learn(fresh)
        out = []
        for text, parts in zip(texts, held, strict=True):
            out.append(
                b"".join(
                    [
                        self._packed(words) if special is None else special.to_bytes(4, "little")
                        for special, words in (self._parts(text) if parts is None else parts)
                    ]
                )
            )
        return out


def unpacked(packed: bytes | None, names: list[str]) -> str:
    """Text of packed ids: token texts joined by a space, as without a decoder."""
    return " ".join([names[i] for i in np.frombuffer(packed or b"", "<u4").tolist()])


def encode(
    docs: DataFrame, tokenizer_path: str, text_col: str = "text", ids_col: str = "token_ids"
) -> DataFrame:
    """Rows of ``docs`` with the ids of the whole text, packed as little-endian 32-bit numbers.

    Null and empty texts, and texts of white space only, have no ids.  A column of
    ``docs`` with the name of the output stays; the output gets an underscore.
    """

    def make() -> Callable[[list], list]:
        codec = WordCodec(tokenizer_path)
        return lambda texts: [codec.pack(texts)]

    return map_text(docs, text_col, [(ids_col, T.BinaryType(), pa.binary())], make)


def decode(
    docs: DataFrame, tokenizer_path: str, ids_col: str = "token_ids", decoded_col: str = "decoded"
) -> DataFrame:
    """Rows of ``docs`` with the text of their packed ids; null ids decode to an empty text.

    Names are kept free as by :func:`encode`.
    """

    def make() -> Callable[[list], list]:
        names = token_names(tokenizer_path)
        return lambda packed: [[unpacked(p, names) for p in packed]]

    return map_text(docs, ids_col, [(decoded_col, T.StringType(), pa.string())], make)


def round_trip(
    docs: DataFrame,
    tokenizer_path: str,
    text_col: str = "text",
    ids_col: str = "token_ids",
    decoded_col: str = "decoded",
) -> DataFrame:
    """:func:`encode` and then :func:`decode` in one pass, so that ids cross to Python once."""

    def make() -> Callable[[list], list]:
        codec, names = WordCodec(tokenizer_path), token_names(tokenizer_path)

        def work(texts: list) -> list:
            packed = codec.pack(texts)
            return [packed, [unpacked(p, names) for p in packed]]

        return work

    added = [(ids_col, T.BinaryType(), pa.binary()), (decoded_col, T.StringType(), pa.string())]
    return map_text(docs, text_col, added, make)
