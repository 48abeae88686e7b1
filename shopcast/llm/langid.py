"""Language identification: averaged hashed subword embeddings, linear softmax, numpy SGD.

A text is the mean of the embeddings of its hashed letter n-grams (bytes of
words, with one blank at word bounds), followed by a linear layer.  Scores are
calibrated by a temperature on rows that the fit has not seen, and texts below
a score that keeps the wanted precision on those rows are rejected.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shopcast.llm.common import map_text

#: Labelled rows that a model is fitted and calibrated on, at most.
SAMPLE_ROWS = 3_000
#: Buckets of one labelled row that the fit gets, at most: the most frequent of its whole text, 8 bytes each.
ROW_BUCKETS = 8_192
BUCKET_BITS = 15
WIDTH = 16
#: Lengths of subwords, in bytes.
SIZES = (2, 3, 4)
UNKNOWN = "und"
_PIECE = 1 << 19

#: A letter of any script: numbers in circles, fractions and the like are none.
_LETTER = regex.compile(r"\p{L}")
#: ASCII that is not a letter becomes a blank.
_TABLE = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))
_MULTIPLIERS = np.array([0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F], np.uint32)


def subword_buckets(text: str | None, bits: int = BUCKET_BITS):
    """Buckets of all subwords of a whole text, in pieces of bounded size."""
    words = (text or "").lower().encode("utf-8", "replace").translate(_TABLE).split()
    line = b" " + b" ".join(words) + b" " if words else b""
    longest = SIZES[-1]
    for at in range(0, len(line), _PIECE):
        raw = np.frombuffer(line[at : at + _PIECE + longest - 1], np.uint8)
        starts = min(len(raw), _PIECE, len(line) - at)
        blank = np.zeros(len(raw) + 1, np.int32)
        np.cumsum(raw == 32, out=blank[1:])
        wide = raw.astype(np.uint32)
        for size in SIZES:
            n = min(starts, len(raw) - size + 1)
            if n <= 0:
                continue
            h = np.full(n, size, np.uint32)
            for k in range(size):
                h = (h ^ wide[k : k + n]) * _MULTIPLIERS[k]
                h ^= h >> np.uint32(15)
            # A blank may open or close a subword, not stand inside.
            inside = blank[size - 1 : size - 1 + n] - blank[1 : 1 + n]
            yield (h[inside == 0] >> np.uint32(32 - bits)).astype(np.int32)


@dataclass(frozen=True)
class LanguageModel:
    """``votes`` is the embedding table times the linear layer: one row per bucket."""

    languages: list[str]
    votes: np.ndarray
    bias: np.ndarray
    temperature: float
    reject_below: float
    bits: int

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language, calibrated score, rejected).

        Null texts, texts without a letter, and every text for a model that has
        learned no language give ``und``, 0 and rejected.
        """
        if not text or not self.languages or not _LETTER.search(text):
            return UNKNOWN, 0.0, True
        total, n = np.zeros(len(self.languages)), 0
        for buckets in subword_buckets(text, self.bits):
            total += self.votes[buckets].sum(axis=0, dtype=np.float64)
            n += len(buckets)
        p = _softmax((total / max(1, n) + self.bias) / self.temperature)
        best = int(p.argmax())
        return self.languages[best], float(p[best]), bool(p[best] < self.reject_below)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def _calibrated(logits: np.ndarray, labels: np.ndarray, precision: float) -> tuple[float, float]:
    """Temperature of least log loss, and the lowest score that keeps the precision.

    The loss counts one wrong row more than there are, or a fit without errors
    would take every score for certain.
    """
    if not len(labels):
        return 1.0, 0.0
    rows = np.arange(len(labels))
    grid = np.geomspace(0.05, 20.0, 61)
    others = max(1, logits.shape[1] - 1)
    doubt = 1.0 / (len(labels) + 2)
    loss = []
    for t in grid:
        log_p = np.log(_softmax(logits / t) + 1e-12)
        right = log_p[rows, labels]
        loss.append(-((1 - doubt) * right + doubt * (log_p.sum(axis=1) - right) / others).mean())
    temperature = float(grid[int(np.argmin(loss))])
    p = _softmax(logits / temperature)
    order = np.argsort(-p.max(axis=1), kind="stable")
    right = np.cumsum((p.argmax(axis=1) == labels)[order]) / (rows + 1)
    enough = np.flatnonzero(right >= precision)
    if not len(enough) or enough[-1] == len(rows) - 1:
        return temperature, 0.0
    return temperature, float(p.max(axis=1)[order[enough[-1]]])


def fit_languages(
    rows: list[tuple[np.ndarray, np.ndarray, str]],
    bits: int = BUCKET_BITS,
    width: int = WIDTH,
    epochs: int = 8,
    rate: float = 4.0,
    precision: float = 0.995,
) -> LanguageModel:
    """SGD over rows of (buckets, relative counts, language); every fifth row calibrates."""
    languages = sorted({lang for _, _, lang in rows})
    index = {lang: i for i, lang in enumerate(languages)}
    draw = np.random.default_rng(11)
    table = draw.normal(0.0, 0.1, (1 << bits, width))
    layer, bias = np.zeros((width, len(languages))), np.zeros(len(languages))
    layer += draw.normal(0.0, 0.1, layer.shape)
    fitted = [r for i, r in enumerate(rows) if i % 5] or rows
    steps, done = epochs * max(1, len(fitted)), 0
    for _ in range(epochs):
        for i in draw.permutation(len(fitted)):
            at, share, lang = fitted[i]
            now = rate * (1.0 - done / steps)
            done += 1
            hidden = share @ table[at]
            error = _softmax(hidden @ layer + bias)
            error[index[lang]] -= 1.0
            back = layer @ error
            layer -= now * 0.1 * np.outer(hidden, error)
            bias -= now * 0.01 * error
            table[at] -= now * share[:, None] * back[None, :] * min(len(at), 50)
    votes = table @ layer
    held = [r for i, r in enumerate(rows) if i % 5 == 0 and len(fitted) < len(rows)]
    logits = np.array([share @ votes[at] + bias for at, share, _ in held]).reshape(len(held), len(languages))
    labels = np.array([index[lang] for _, _, lang in held], int)
    temperature, floor = _calibrated(logits, labels, precision)
    return LanguageModel(languages, votes.astype(np.float32), bias, temperature, floor, bits)


def train_languages(
    labelled: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    sample_rows: int = SAMPLE_ROWS,
    bits: int = BUCKET_BITS,
) -> LanguageModel:
    """Fit on at most ``sample_rows`` labelled rows, those with the smallest hash of their id.

    Rows with a null language or without a subword are left out.  Hashing runs
    in tasks; the driver gets the counts of at most ``ROW_BUCKETS`` buckets per row,
    the most frequent ones.  Where ids repeat, the first ``sample_rows`` rows by
    hash, language and buckets count.
    """
    rows = labelled.where(F.col(lang_col).isNotNull())
    cut = (
        rows.select(F.xxhash64(id_col).alias("h")).orderBy("h").limit(sample_rows).agg(F.max("h"))
    ).collect()[0][0]
    if cut is None:
        return fit_languages([], bits)
    chosen = rows.where(F.xxhash64(id_col) <= cut).select(
        F.xxhash64(id_col).alias("h"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")
    )

    def make() -> Callable[[list], list]:
        def work(texts: list) -> list:
            at, share = [], []
            for text in texts:
                counts = np.zeros(1 << bits, np.int64)
                for buckets in subword_buckets(text, bits):
                    counts += np.bincount(buckets, minlength=1 << bits)
                met = np.flatnonzero(counts)
                if len(met) > ROW_BUCKETS:
                    met = np.sort(met[np.argsort(-counts[met], kind="stable")[:ROW_BUCKETS]])
                at.append(met.astype("<i4").tobytes())
                share.append((counts[met] / max(1, counts.sum())).astype("<f4").tobytes())
            return [at, share]

        return work

    added = [("at", T.BinaryType(), pa.binary()), ("share", T.BinaryType(), pa.binary())]
    seen = map_text(chosen, "text", added, make).drop("text").where("length(at) > 0")
    seen = seen.orderBy("h", "lang", "at", "share").limit(sample_rows).collect()
    return fit_languages(
        [(np.frombuffer(r["at"], "<i4"), np.frombuffer(r["share"], "<f4").astype(float), r["lang"]) for r in seen],
        bits,
    )


def identify(
    docs: DataFrame,
    model: LanguageModel,
    text_col: str = "text",
    names: tuple[str, str, str] = ("lang_pred", "score", "rejected"),
) -> DataFrame:
    """Rows of ``docs`` with language, calibrated score (0 to 1) and rejection; see ``predict``.

    A column of ``docs`` with the name of an output stays; the output gets an underscore.
    """

    def make() -> Callable[[list], list]:
        return lambda texts: list(zip(*map(model.predict, texts), strict=True))

    added = [
        (names[0], T.StringType(), pa.string()),
        (names[1], T.DoubleType(), pa.float64()),
        (names[2], T.BooleanType(), pa.bool_()),
    ]
    return map_text(docs, text_col, added, make)
