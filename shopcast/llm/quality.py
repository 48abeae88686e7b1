"""Quality classifier: hashed word n-grams, logistic regression, FTRL updates.

A text becomes a stream of tokens: words in lower case, runs of punctuation,
and three stand-ins (a word in capitals, a number, a word that repeats the one
before).  Unigrams and bigrams of that stream are hashed into one weight table;
a text's score is the logistic of the mean weight of its n-grams, that is, a
sparse dot product with its relative counts.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shopcast.llm.common import map_text

#: Labelled rows that a model is fitted on, at most.
SAMPLE_ROWS = 4_000
#: Buckets of one labelled row that the fit gets, at most: the most frequent of its whole text, 8 bytes each.
ROW_BUCKETS = 8_192
BUCKET_BITS = 18
#: Texts are hashed in pieces of at most so many bytes, cut at white space where there is some.
PIECE_BYTES = 1 << 20

_STEP = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_UP, _NUMBER, _AGAIN = (np.uint64(n) for n in (11, 13, 17))


def _classes() -> np.ndarray:
    """0: blank, 1: word byte, 2: punctuation."""
    kinds = np.full(256, 1, np.uint8)
    for b in range(128):
        kinds[b] = 0 if b <= 32 or b == 127 else 1 if chr(b).isalnum() else 2
    return kinds


_KIND = _classes()
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint64)
_powers: dict[str, np.ndarray] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2**64, for positions below ``n``."""
    if len(_powers.get("up", ())) < n:
        size = max(n, PIECE_BYTES + 1)
        base = 0x100000001B3
        with np.errstate(over="ignore"):
            for name, factor in (("up", base), ("down", pow(base, -1, 1 << 64))):
                table = np.full(size, np.uint64(factor))
                table[0] = 1
                _powers[name] = np.cumprod(table, dtype=np.uint64)
    return _powers["up"], _powers["down"]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _MIX
    return h ^ (h >> np.uint64(29))


def _piece_tokens(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    kind = _KIND[raw]
    first = np.empty(len(raw), bool)
    first[0] = kind[0] != 0
    first[1:] = (kind[1:] != kind[:-1]) & (kind[1:] != 0)
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.empty(0, np.uint64)
    last = np.empty(len(raw), bool)
    last[-1] = kind[-1] != 0
    last[:-1] = (kind[1:] != kind[:-1]) & (kind[:-1] != 0)
    ends = np.flatnonzero(last) + 1
    up, down = _power_tables(len(raw))
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((_LOWER[raw] + np.uint64(1)) * up[: len(raw)], dtype=np.uint64, out=sums[1:])
    tokens = _mixed((sums[ends] - sums[starts]) * down[starts])
    sizes = ends - starts
    counts = np.zeros(len(raw) + 1, np.int64)
    np.cumsum((raw >= 65) & (raw <= 90), out=counts[1:])
    tokens[(counts[ends] - counts[starts] == sizes) & (sizes > 1)] = _UP
    np.cumsum((raw >= 48) & (raw <= 57), out=counts[1:])
    tokens[counts[ends] - counts[starts] == sizes] = _NUMBER
    return tokens


def token_hashes(text: str) -> np.ndarray:
    """Hashes of the tokens of a whole text, in order."""
    data, parts, at = text.encode("utf-8", "replace"), [], 0
    while at < len(data):
        to = at + PIECE_BYTES
        if to < len(data):
            blank = data.rfind(b" ", at, to)
            to = blank + 1 if blank > at else to
        parts.append(_piece_tokens(data[at:to]))
        at = to
    tokens = np.concatenate(parts) if parts else np.empty(0, np.uint64)
    if len(tokens) > 1:
        again = np.flatnonzero(tokens[1:] == tokens[:-1]) + 1
        tokens[again] = _AGAIN
    return tokens


def ngram_buckets(text: str | None, bits: int = BUCKET_BITS) -> np.ndarray:
    """Bucket of every unigram and bigram of the text."""
    tokens = token_hashes(text or "")
    pairs = _mixed(tokens[:-1] * _STEP + tokens[1:])
    return (np.concatenate([tokens, pairs]) * _STEP >> np.uint64(64 - bits)).astype(np.int32)


@dataclass(frozen=True)
class QualityModel:
    """``weights`` holds one number per bucket; ``bias`` the log-odds of an empty text."""

    weights: np.ndarray
    bias: float
    bits: int

    def score(self, text: str | None) -> float:
        buckets = ngram_buckets(text, self.bits)
        z = self.bias + (float(self.weights[buckets].mean()) if len(buckets) else 0.0)
        return float(1.0 / (1.0 + np.exp(-np.clip(z, -35.0, 35.0))))


def fit_ftrl(
    rows: list[tuple[np.ndarray, np.ndarray, int]],
    bits: int = BUCKET_BITS,
    epochs: int = 6,
    alpha: float = 1.0,
    beta: float = 1.0,
    l1: float = 1e-4,
    l2: float = 1e-3,
    scale: float = 24.0,
) -> QualityModel:
    """Follow-the-regularised-leader over rows of (buckets, relative counts, label).

    No rows give the score 0.5 to every text.  ``scale`` is folded into the
    weights, so that a score needs the mean weight only.
    """
    size = 1 << bits
    z, n = np.zeros(size + 1), np.zeros(size + 1)
    order = np.random.default_rng(7)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            at, value, label = rows[i]
            at, value = np.append(at, size), np.append(value * scale, 1.0)
            zi, ni = z[at], n[at]
            w = np.where(
                np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(ni)) / alpha + l2)
            )
            p = 1.0 / (1.0 + np.exp(-np.clip(w @ value, -35.0, 35.0)))
            g = (p - label) * value
            z[at] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / alpha * w
            n[at] = ni + g * g
    w = np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))
    return QualityModel((w[:size] * scale).astype(np.float32), float(w[size]), bits)


def train_quality(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    sample_rows: int = SAMPLE_ROWS,
    bits: int = BUCKET_BITS,
) -> QualityModel:
    """Fit on rows of ``docs`` with one of ``sample_rows`` labels, those with the smallest hash of their id.

    Labels without an id or a value are left out.  The chosen labels, a bounded
    table, go to the texts; hashing runs in tasks; the driver gets the counts of
    at most ``ROW_BUCKETS`` buckets per row, the most frequent ones.  Where ids
    repeat, the first ``sample_rows`` rows by hash, label and buckets count.
    """
    chosen = (
        labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
        .select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
        .withColumn("h", F.xxhash64("id"))
        .orderBy("h", "label")
        .limit(sample_rows)
    )
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    chosen = texts.join(F.broadcast(chosen), "id").select("h", "label", "text")

    def make() -> Callable[[list], list]:
        def work(texts: list) -> list:
            at, share = [], []
            for text in texts:
                buckets, counts = np.unique(ngram_buckets(text, bits), return_counts=True)
                total = max(1, counts.sum())
                if len(buckets) > ROW_BUCKETS:
                    most = np.sort(np.argsort(-counts, kind="stable")[:ROW_BUCKETS])
                    buckets, counts = buckets[most], counts[most]
                at.append(buckets.astype("<i4").tobytes())
                share.append((counts / total).astype("<f4").tobytes())
            return [at, share]

        return work

    added = [("at", T.BinaryType(), pa.binary()), ("share", T.BinaryType(), pa.binary())]
    seen = map_text(chosen, "text", added, make).drop("text")
    seen = seen.orderBy("h", "label", "at", "share").limit(sample_rows).collect()
    return fit_ftrl(
        [
            (np.frombuffer(r["at"], "<i4"), np.frombuffer(r["share"], "<f4").astype(float), r["label"])
            for r in seen
        ],
        bits,
    )


def score_quality(
    docs: DataFrame, model: QualityModel, text_col: str = "text", score_col: str = "score"
) -> DataFrame:
    """Rows of ``docs`` with a score from 0 to 1: higher means label 1 is likelier.

    Null and empty texts, and texts without a token, get the model's bias alone.  A
    column of ``docs`` with the name of the output stays; the output gets an underscore.
    """

    def make() -> Callable[[list], list]:
        return lambda texts: [[model.score(t) for t in texts]]

    return map_text(docs, text_col, [(score_col, T.DoubleType(), pa.float64())], make)


def hash_fold(id_col: Column, folds: int) -> Column:
    """Remainder of the crc32 of the id as text."""
    return F.crc32(id_col.cast("string").cast("binary")) % folds
