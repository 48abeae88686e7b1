"""Secret scan with column expressions only: patterns and character Markov models.

Three patterns give the base spans.  Other long runs of key characters, or what
base spans leave of them, are scored by two first-order Markov models over
characters, one of random strings and one of ordinary identifiers; a run whose
log-likelihood ratio is high enough is a secret too.  In a run that is not, the
pieces between separators are scored, as a key can stand at the end of a path.
The models are counts of character pairs in labelled samples, the threshold comes
from samples held out; scoring is a sum of table entries.
"""

from __future__ import annotations

import functools
import math
import string
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shopcast.llm.common import fresh
from shopcast.llm.spans import let, match_spans, running
from shopcast.sources import stage

#: The characters of keys, in the order of the models' tables.
ALPHABET = string.ascii_uppercase + string.ascii_lowercase + string.digits + "+/_=-"
#: Base patterns by kind, in the order in which spans are listed; fixed values.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{32,}"
LEAST_ASSIGN, LEAST_ACCESS = 8, 16
#: Runs that the models look at.
LEAST_RUN = 20
RUN = rf"[A-Za-z0-9+/_=-]{{{LEAST_RUN},}}"
#: Pieces of a run between separators; a base64 text ends with its padding.
PIECE = r"[A-Za-z0-9+]+(?:={1,2}\z)?"
MARKOV = "markov"
#: What drawn lines repeat.
RULERS = ("-", "=", "_", "/", "+", "-=", "_-", "+-")
#: Rows that samples are taken from, at most, and random strings of each make.
SAMPLE_DOCS, SAMPLE_RANDOM = 400, 1_500

_FOUND = "array<struct<start:int,rank:int,end:int,kind:string,value:string>>"


@dataclass(frozen=True)
class MarkovModels:
    """Log-likelihood ratio (random to ordinary) of each pair of characters.

    ``ratios`` is in rows by the first character, the row 0 for the start of a
    run.  A run is random when its ratio per character is at least ``threshold``.
    """

    ratios: tuple[float, ...]
    threshold: float

    def column(self) -> Column:
        return F.split(F.lit(",".join(f"{r:.6f}" for r in self.ratios)), ",").cast("array<double>")


def _codes(token: Column) -> Column:
    """Places in the alphabet of a token's characters, 1-based; 0 for other characters."""
    return F.transform(F.split(token, ""), lambda c: F.instr(F.lit(ALPHABET), c))


def _counted(samples: DataFrame, smoothing: float) -> tuple[float, ...]:
    """Log-likelihood ratios from the pairs of characters in (label, codes)."""
    size = len(ALPHABET)
    pairs = (
        samples.select(
            "label",
            F.explode(
                F.zip_with(
                    F.concat(F.array(F.lit(0)), "codes"),
                    "codes",
                    lambda a, b: F.struct(a.alias("a"), b.alias("b")),
                )
            ).alias("p"),
        )
        .where("p.b is not null")
        .groupBy("label", "p.a", "p.b")
        .count()
    )
    counts = {(r["label"], r["a"], r["b"]): r["count"] for r in pairs.collect()}
    ratios: list[float] = []
    for a in range(size + 1):
        rows = [[counts.get((label, a, b), 0) for b in range(1, size + 1)] for label in (0, 1)]
        totals = [sum(row) + smoothing * size for row in rows]
        ratios += [
            math.log((rows[1][b] + smoothing) / totals[1]) - math.log((rows[0][b] + smoothing) / totals[0])
            for b in range(size)
        ]
    return tuple(ratios)


def train_markov(
    samples: DataFrame, token_col: str = "token", label_col: str = "label", smoothing: float = 0.5,
    threshold: float | None = None, false_rate: float = 0.001,
) -> MarkovModels:
    """Fit both models on tokens labelled 1 (random string) or 0 (ordinary identifier).

    Without a stated threshold, a quarter of the tokens is held out, and the
    threshold lies midway between the score that ``false_rate`` of its ordinary
    runs exceed and the one that all but 5 % of its random ones exceed; where
    these overlap it is the latter.  Null tokens and labels, and characters outside the alphabet, are
    left out.  Without ordinary or without random tokens nothing is found.  The
    driver gets a count per pair of characters and two scores.
    """
    codes = F.filter(_codes(F.col(token_col)), lambda c: c > 0)
    known = samples.where(
        F.col(token_col).isNotNull() & (F.col(token_col) != "") & F.col(label_col).isNotNull()
    ).select(
        F.col(label_col).cast("int").alias("label"),
        F.col(token_col).alias("token"),
        codes.alias("codes"),
        (F.pmod(F.xxhash64(token_col), F.lit(4)) == 0).alias("held_out"),
    )
    ratios = _counted(known if threshold is not None else known.where("not held_out"), smoothing)
    if threshold is None:
        score = _ratio(F.col("token"), MarkovModels(ratios, 0.0).column())
        runs = known.where(F.col("held_out") & (F.length("token") >= LEAST_RUN) & (F.size("codes") == F.length("token")))
        of = {r["label"]: r for r in runs.groupBy("label").agg(
            F.percentile(score, 1.0 - false_rate).alias("high"), F.percentile(score, 0.05).alias("low")
        ).collect()}
        threshold = math.inf
        if 0 in of and 1 in of:
            high, low = max(0.0, of[0]["high"]), of[1]["low"]
            threshold = (high + low) / 2 if high < low else low
    return MarkovModels(ratios, threshold)


def _ordinary(words: DataFrame) -> DataFrame:
    """Runs as programs and texts hold them: the four words of each row (pos, w) joined in one of many ways."""
    a, b, c, d, n, way = (F.col(name) for name in ("a", "b", "c", "d", "n", "way"))
    words = words.select(
        *(F.element_at("w", i + 1).alias(name) for i, name in enumerate("abcd")),
        F.pmod(F.xxhash64("w", "pos"), F.lit(1 << 30)).alias("n"),
        F.pmod(F.xxhash64("w", "pos", F.lit("way")), F.lit(1 << 30)).alias("way"),
    )
    part = lambda step, most: F.pmod(F.floor(n / step), F.lit(most)).cast("string")
    two = lambda step, most: F.lpad(part(step, most), 2, "0")
    date = F.concat_ws("-", F.concat(F.lit("20"), two(3, 30)), two(5, 12), two(7, 28))
    time = F.concat_ws("-", two(11, 24), two(13, 60), two(17, 60))
    caps = lambda w: F.upper(F.substring(w, 1, 4))
    hexed = F.sha2(F.concat_ws(" ", a, b, c, d), 256)
    uuid = F.regexp_replace(F.substring(hexed, 1, 32), "(.{8})(.{4})(.{4})(.{4})(.{12})", "$1-$2-$3-$4-$5")
    upper, lower, digits = string.ascii_uppercase, string.ascii_lowercase, "1234567890"
    cut = lambda text: F.substr(F.lit(text), F.pmod(n, F.lit(20)) + 1, 20 + F.pmod(F.floor(n / 31), F.lit(30)))
    forms = [
        F.concat_ws("_", a, b, c, d),
        F.concat_ws("-", a, b, c, d),
        F.concat(a, F.initcap(b), F.initcap(c), F.initcap(d)),
        F.upper(F.concat_ws("_", a, b, c, d)),
        F.concat_ws("/", a, b, F.concat_ws("_", c, d)),
        F.concat_ws("_", a, b, c, part(3, 1000)),
        F.concat(a, F.initcap(b), part(3, 100), F.initcap(c), F.initcap(d)),
        F.concat(caps(a), F.initcap(b), caps(c), part(3, 300), F.initcap(d)),
        F.concat(F.initcap(a), part(3, 10), F.initcap(b), F.initcap(c), caps(d), part(5, 1000)),
        F.concat(a, F.lit("-v"), part(3, 20), F.lit("-"), part(5, 10), F.lit("-"), part(7, 40), F.lit("-"), b, F.lit("_"), c),
        F.concat(date, F.lit("T"), time, F.lit("-"), F.lpad(part(19, 1_000_000), 6, "0")),
        F.concat_ws("_", a, b, F.regexp_replace(date, "-", ""), part(3, 100_000)),
        F.concat(F.regexp_replace(F.concat(date, time), "-", ""), F.lpad(part(19, 1_000_000), 9, "0")),
        F.lpad(n.cast("string"), 24, "0"),
        uuid,
        F.concat_ws("/", F.lit("id"), uuid),
        cut(digits * 7),
        cut((upper + lower + "0123456789") * 2),
        cut((lower + "0123456789" + upper) * 2),
    ]
    # Every second run has one of the first five forms.
    half = F.floor(way / 2)
    at = F.when(way % 2 == 0, F.pmod(half, F.lit(5))).otherwise(F.pmod(half, F.lit(len(forms))))
    made = [words.where(at == i).select(form.alias("token")) for i, form in enumerate(forms)]
    return functools.reduce(DataFrame.unionByName, made)


def labelled_samples(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_docs: int = SAMPLE_DOCS
) -> DataFrame:
    """Labelled tokens: strings made from digests, and runs and words of at most ``sample_docs`` rows.

    Random strings are hexadecimal, base64 and mixed alphanumeric texts of
    digests of numbers.  Ordinary ones are the long runs of the rows with the
    smallest hash of their id, and their words joined four by four as programs
    do: identifiers with and without numbers, paths, versions, dates, UUIDs,
    counted digits, alphabets and rulers; nothing that the base patterns find.
    """
    spark: SparkSession = docs.sparkSession
    digest = F.sha2(F.col("id").cast("string"), 256)
    packed = F.base64(F.unhex(digest))
    made = spark.range(SAMPLE_RANDOM).select(
        F.explode(
            F.array(
                F.upper(F.substring(digest, 1, 40)),
                F.substring(packed, 1, 24),
                packed,
                F.regexp_replace(packed, "[+/=]", ""),
                F.upper(F.regexp_replace(packed, "[+/=]", "")),
                F.translate(packed, "+/=", "-_"),
            )
        ).alias("token"),
        F.lit(1).alias("label"),
    )
    hashed = F.xxhash64(id_col)
    cut = docs.select(hashed.alias("h")).orderBy("h").limit(sample_docs).agg(F.max("h")).collect()[0][0]
    if cut is None:
        return made.limit(0)
    rest = F.col(text_col)
    for pattern in (ASSIGN, ACCESS, HEX):
        rest = F.regexp_replace(rest, pattern, " ")
    found = docs.where(hashed <= cut).select(
        F.regexp_extract_all(rest, F.lit("[A-Za-z]{2,}"), F.lit(0)).alias("words"),
        F.regexp_extract_all(rest, F.lit(RUN), F.lit(0)).alias("runs"),
    )
    starts = F.when(F.size("words") >= 4, F.sequence(F.lit(1), F.size("words") - 3, F.lit(2)))
    four = F.transform(starts, lambda i: F.slice("words", i, 4))
    # Rulers of every kind and length, however few rows there are.
    ruler = F.element_at(F.array(*map(F.lit, RULERS)), (F.col("id") % len(RULERS) + 1).cast("int"))
    rulers = spark.range(40 * len(RULERS)).select(
        F.repeat(ruler, (LEAST_RUN + F.floor(F.col("id") / len(RULERS))).cast("int")).alias("token")
    )
    ordinary = (
        _ordinary(stage(found.select(F.posexplode(four).alias("pos", "w")), "secret-words"))
        .unionByName(found.select(F.explode("runs").alias("token")))
        .unionByName(rulers)
        .withColumn("label", F.lit(0))
    )
    return stage(made.unionByName(ordinary), "secret-samples")


def _of_kind(spans: Column, rank: int, kind: str) -> Column:
    return F.transform(
        spans,
        lambda s: F.struct(
            s["start"].alias("start"),
            F.lit(rank).alias("rank"),
            s["end"].alias("end"),
            F.lit(kind).alias("kind"),
            s["hit"].alias("value"),
        ),
    )


def _ratio(token: Column, ratios: Column) -> Column:
    """Log-likelihood ratio of a run, per character."""
    size = len(ALPHABET)
    summed = F.aggregate(
        _codes(token),
        F.struct(F.lit(0).alias("last"), F.lit(0.0).alias("sum")),
        lambda acc, c: F.struct(
            c.alias("last"), (acc["sum"] + F.element_at(ratios, acc["last"] * size + c)).alias("sum")
        ),
        lambda acc: acc["sum"],
    )
    return summed / F.length(token)


def _free_runs(runs: Column, known: Column) -> Column:
    """What the spans ``known`` leave of runs, in parts of ``LEAST_RUN`` characters and more."""
    def items(spans: Column, is_run: bool, hit: Callable[[Column], Column]) -> Column:
        return F.transform(
            spans,
            lambda s: F.struct(
                s["start"].alias("start"), F.lit(is_run).alias("is_run"), s["end"].alias("end"), hit(s).alias("hit")
            ),
        )

    no_text = F.lit(None).cast("string")
    last = F.array(
        F.struct(
            F.lit((1 << 31) - 1).alias("start"), F.lit(True).alias("is_run"), F.lit(0).alias("end"), no_text.alias("hit")
        )
    )
    both = F.array_sort(F.concat(items(known, False, lambda s: no_text), items(runs, True, lambda s: s["hit"]), last))

    def state(done: Column, begin: Column, at: Column, end: Column, hit: Column) -> Column:
        return F.struct(done.alias("done"), begin.alias("begin"), at.alias("at"), end.alias("end"), hit.alias("hit"))

    def step(open_: Column, x: Column) -> tuple[Column, Column, Column]:
        # The part from ``at`` on of the run that starts at ``begin`` is open until a known span or another run.
        upto = F.least(open_["end"], x["start"])
        part = F.struct(
            open_["at"].alias("start"),
            upto.alias("end"),
            F.substring(open_["hit"], open_["at"] - open_["begin"] + 1, upto - open_["at"]).alias("hit"),
        )
        after = F.when(
            x["is_run"],
            state(open_["done"], x["start"], F.greatest(x["start"], open_["done"]), x["end"], x["hit"]),
        ).otherwise(
            state(
                F.greatest(open_["done"], x["end"]), open_["begin"], F.greatest(open_["at"], x["end"]),
                open_["end"], open_["hit"],
            )
        )
        return after, upto - open_["at"] >= LEAST_RUN, part

    zero = F.lit(0)
    return running(both, state(zero, zero, zero, zero, no_text), "struct<start:int,end:int,hit:string>", step)


def _random_pieces(run: Column, ratios: Column, threshold: float) -> Column:
    """Random parts of a run: pieces over the threshold, joined while what they gain outweighs those between."""
    ends = F.array(F.struct(F.lit(0).alias("start"), F.lit(0).alias("end"), F.lit(float("-inf")).alias("gain")))
    pieces = F.transform(
        match_spans(run["hit"], PIECE),
        lambda p: F.struct(
            p["start"].alias("start"),
            p["end"].alias("end"),
            ((_ratio(p["hit"], ratios) - threshold) * F.length(p["hit"])).alias("gain"),
        ),
    )

    def state(start: Column, end: Column, gain: Column) -> Column:
        return F.struct(start.alias("start"), end.alias("end"), gain.alias("gain"))

    def step(group: Column, x: Column) -> tuple[Column, Column, Column]:
        is_open, random, gain = group["gain"] >= 0, x["gain"] >= 0, group["gain"] + x["gain"]
        after = (
            F.when(is_open & random, state(group["start"], x["end"], gain))
            .when(random, state(x["start"], x["end"], x["gain"]))
            .otherwise(state(group["start"], group["end"], F.when(is_open, gain).otherwise(F.lit(-1.0))))
        )
        return after, is_open & ~random & (gain < 0), F.struct(group["start"].alias("start"), group["end"].alias("end"))

    groups = running(
        F.concat(pieces, ends), state(F.lit(0), F.lit(0), F.lit(-1.0)), "struct<start:int,end:int>", step
    )
    return F.transform(
        F.filter(groups, lambda g: g["end"] - g["start"] >= LEAST_RUN),
        lambda g: F.struct(
            (run["start"] + g["start"]).alias("start"),
            (run["start"] + g["end"]).alias("end"),
            F.substring(run["hit"], g["start"] + 1, g["end"] - g["start"]).alias("hit"),
        ),
    )


def scan_secrets(
    docs: DataFrame, models: MarkovModels | None, text_col: str = "text",
    names: tuple[str, str] = ("base", "spans"),
) -> DataFrame:
    """Rows of ``docs`` with two arrays of (start, rank, end, kind, value), ordered by start and kind.

    ``base`` has the spans of the patterns: assignments whose value has at least
    8 characters, access keys of at least 16, and runs of at least 32
    hexadecimal digits.  ``spans`` has these and the random runs, or random parts
    of runs, beside them.  Null and empty texts have none.  A column of ``docs``
    with the name of an output stays; the output gets an underscore.
    """
    text, low, found = fresh(docs, "_scan_text", "_scan_low", "_scan_found")
    names = fresh(docs, *names)
    rows = docs.withColumn(text, F.coalesce(F.col(text_col), F.lit(""))).withColumn(low, F.lower(text))
    nothing = F.array().cast(_FOUND)
    hinted = F.lit(False)
    # The long s and the Kelvin sign aside, a keyword in either case is in the lower-case text.
    for word in ("passw", "secret", "token", "api_key", "apikey"):
        hinted = hinted | F.contains(low, F.lit(word))
    assign = F.filter(
        match_spans(F.col(text), ASSIGN),
        lambda s: F.length(F.regexp_extract(s["hit"], ASSIGN, 2)) >= LEAST_ASSIGN,
    )
    access = F.filter(match_spans(F.col(text), ACCESS), lambda s: s["end"] - s["start"] >= LEAST_ACCESS)
    base = F.array_sort(
        F.concat(
            F.when(hinted | F.contains(low, F.lit("passwd")), _of_kind(assign, 0, "assign")).otherwise(nothing),
            F.when(F.contains(text, F.lit("AKIA")), _of_kind(access, 1, "access")).otherwise(nothing),
            F.when(F.col(text).rlike(HEX), _of_kind(match_spans(F.col(text), HEX), 2, "hex")).otherwise(nothing),
        )
    )
    def both(known: Column) -> Column:
        extra = nothing
        if models is not None:
            ratios = models.column()
            runs = F.transform(
                _free_runs(match_spans(F.col(text), RUN), known),
                lambda s: F.when(_ratio(s["hit"], ratios) >= models.threshold, F.array(s)).otherwise(
                    _random_pieces(s, ratios, models.threshold)
                ),
            )
            extra = F.when(F.col(text).rlike(RUN), _of_kind(F.flatten(runs), 3, MARKOV)).otherwise(nothing)
        return F.struct(known.alias("base"), F.array_sort(F.concat(known, extra)).alias("all"))

    return (
        rows.withColumn(found, let(base, both))
        .withColumn(names[0], F.col(f"{found}.base"))
        .withColumn(names[1], F.col(f"{found}.all"))
        .drop(text, low, found)
    )


def span_list(spans: Column) -> Column:
    """Spans as text: kind:start:end, comma-joined."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))
