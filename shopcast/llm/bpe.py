"""Byte pair encoding by last-token states over a trie of words.

A sequence of tokens is what the merges give exactly when each two neighbours
are, and each prefix of a word has one such sequence.  So a prefix's encoding
is known from its last token alone: what precedes is the encoding of the
shorter prefix.  Distinct words in sorted order are the depth-first order of
their trie, and the states of the current path are a stack: a shared prefix is
computed once.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

#: Pairs of tokens whose validity is remembered at once.
PAIRS_KEPT = 250_000


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def token_names(path: str) -> list[str]:
    """The text of each token of a tokenizer file by id, special tokens included."""
    with open(path, encoding="utf-8") as f:
        described = json.load(f)
    names = {i: t for t, i in described["model"]["vocab"].items()}
    names.update({a["id"]: a["content"] for a in described["added_tokens"]})
    return [names.get(i, "") for i in range(max(names) + 1)]


class MergeTable:
    """Vocabulary and merges of a tokenizer file, in bytes.

    ``plain`` maps the bytes of a token to its id.  With a suffix that marks the
    end of a word, ``ending`` does so for tokens that end a word; else it is the
    same mapping.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            described = json.load(f)
        model, letters = described["model"], byte_letters()
        suffix = model.get("end_of_word_suffix") or ""
        vocabulary: dict[str, int] = model["vocab"]
        self.special = {a["content"]: a["id"] for a in described["added_tokens"]}
        self.suffixed = bool(suffix)
        parents: dict[int, tuple[int, int]] = {}
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            ids = (vocabulary[left], vocabulary[right])
            made = vocabulary[left + right]
            self.merges[ids] = (rank, made)
            parents[made] = ids
        self.plain: dict[bytes, int] = {}
        self.ending: dict[bytes, int] = {} if suffix else self.plain
        self.bytes_of: dict[int, bytes] = {}
        for token, i in vocabulary.items():
            ends = bool(suffix) and token.endswith(suffix) and len(token) > len(suffix)
            bare = token[: len(token) - len(suffix)] if ends else token
            data = bytes(letters[c] for c in bare)
            (self.ending if ends else self.plain)[data] = i
            self.bytes_of[i] = data
        self._parents = parents
        self._spines: dict[tuple[int, int], tuple[tuple[int, int, int], ...]] = {}
        if any(bytes([b]) not in d for b in range(256) for d in (self.plain, self.ending)):
            raise ValueError("the vocabulary lacks single bytes")
        self.longest = max(map(len, self.plain))
        self.longest_end = max(map(len, self.ending))
        self._valid: dict[int, bool] = {}

    def symbols(self, token: int) -> list[int]:
        """The single bytes that a token is merged from."""
        pair = self._parents.get(token)
        return [token] if pair is None else [*self.symbols(pair[0]), *self.symbols(pair[1])]

    def _spine(self, token: int, side: int) -> tuple[tuple[int, int, int], ...]:
        """(token, rank that makes it, rank that ends it) down one side, the token itself first."""
        known = self._spines.get((token, side))
        if known is None:
            out, until, at = [], 1 << 30, token
            while at in self._parents:
                pair = self._parents[at]
                made = self.merges[pair][0]
                out.append((at, made, until))
                at, until = pair[side], made
            known = self._spines[token, side] = (*out, (at, -1, until))
        return known

    def _apart(self, before: int, token: int) -> bool:
        """Whether no merge joins the two tokens while they are built.

        Both sides are taken apart from the last merge to the first.  Two parts
        join if their merge comes before the one that ends either; at equal rank
        the leftmost comes first.
        """
        lefts, rights, i, j = self._spine(before, 1), self._spine(token, 0), 0, 0
        while True:
            a, a_made, a_until = lefts[i]
            b, b_made, b_until = rights[j]
            found = self.merges.get((a, b))
            if found is not None and found[0] < a_until and found[0] <= b_until:
                return False
            if a_made < 0 and b_made < 0:
                return True
            if a_made >= b_made:
                i += 1
            else:
                j += 1

    def merged(self, symbols: list[int]) -> list[int]:
        """Merges in order of rank, the leftmost first: the definition, for short inputs."""
        while len(symbols) > 1:
            best, at = None, -1
            for i in range(len(symbols) - 1):
                found = self.merges.get((symbols[i], symbols[i + 1]))
                if found is not None and (best is None or found[0] < best[0]):
                    best, at = found, i
            if best is None:
                break
            symbols[at : at + 2] = [best[1]]
        return symbols

    def follows(self, before: int, token: int) -> bool:
        """Whether ``token`` stays whole after ``before`` (-1: at the start of a word)."""
        key = (before << 20) + token
        known = self._valid.get(key)
        if known is None:
            if len(self._valid) >= PAIRS_KEPT:
                self._valid.clear()
            if before < 0:
                known = self.merged(self.symbols(token)) == [token]
            else:
                known = self._apart(before, token)
            self._valid[key] = known
        return known

    def walk(self, words: Iterable[bytes]) -> Iterator[tuple[bytes, int, list[int], list[int]]]:
        """(word, length shared with the one before, last tokens, their sizes) in trie order.

        The lists hold the state of every prefix of the word, the empty one
        first; they are the path of the walk and the next step changes them.
        Exactly one token can end a prefix, so the order of trying is free:
        short tokens end most prefixes.
        """
        known, valid, follows, longest = self.plain.get, self._valid, self.follows, self.longest
        last, sizes, before = [-1], [0], b""
        for word in sorted(words):
            shared = len(last) - 1
            if word[:shared] != before[:shared]:
                shared = 0
                for x, y in zip(word, before):
                    if x != y:
                        break
                    shared += 1
            shared = min(shared, len(word))
            del last[shared + 1 :], sizes[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                for size in range(1, min(end, longest) + 1):
                    token = known(word[end - size : end])
                    if token is not None:
                        left = last[end - size]
                        fits = valid.get((left << 20) + token)
                        if fits is None:
                            fits = follows(left, token)
                        if fits:
                            last.append(token)
                            sizes.append(size)
                            break
                else:
                    raise ValueError("no token ends here")
            before = word
            yield word, shared, last, sizes

    def _closing(self, word: bytes, last: list[int]) -> tuple[int, int]:
        """The token that ends the whole word, and its size."""
        for size in range(1, min(len(word), self.longest_end) + 1):
            token = self.ending.get(word[len(word) - size :])
            if token is not None and self.follows(last[len(word) - size], token):
                return token, size
        raise ValueError("no token ends here")

    def encoded(self, words: Iterable[bytes]) -> Iterator[tuple[bytes, list[int]]]:
        """Each distinct word with its token ids, shared prefixes computed once."""
        for word, _, last, sizes in self.walk(words):
            end, ids = len(word), []
            if self.suffixed and word:
                token, size = self._closing(word, last)
                ids.append(token)
                end -= size
            while end:
                ids.append(last[end])
                end -= sizes[end]
            ids.reverse()
            yield word, ids

    def prefix_counts(self, words: Iterable[bytes]) -> Iterator[tuple[bytes, list[int]]]:
        """Each distinct word with the number of tokens of every prefix, the empty one first."""
        if self.suffixed:
            raise ValueError("a prefix does not end a word: no counts with word ends")
        counts = [0]
        for word, shared, _, sizes in self.walk(words):
            del counts[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                counts.append(counts[end - sizes[end]] + 1)
            yield word, counts[:]
