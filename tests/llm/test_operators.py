"""Corpus operators against brute force, and on nulls, empty texts, ties and odd tables."""

import hashlib
import itertools
import random
import re
from re import _constants as sre
from re import _parser

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from shopcast.llm import (
    bpe_codec, components, decontaminate, exact_dedup, langid, licenses, quality, secret_scan, simhash,
    token_counts, warc,
)

SCHEMA = "doc_id long, text string, score string, items string"
WORD_BPE, BYTE_BPE = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty, blank, repeated and long texts, with columns that clash."""
    long = "word " * 60_000
    rows = [
        (1, "One two  three four five", "x", "y"), (2, None, None, None), (3, "", "x", "y"), (4, " \t\n", "x", None),
        (5, "one two three four five", "x", "y"), (6, "One two three\tfour five", "x", "y"), (7, long, "x", "y"),
        (8, long, "x", "y"), (None, "One two three four five", "x", "y"), (1, "One two  three four five", "x", "y"),
        (9, "É token = 'abcdefgh12' mit license", "x", "y"),
    ]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_exact_dedup(odd, empty):
    got = exact_dedup.exact_duplicates(odd, all_digests=True).collect()
    assert len(got) == 11
    by = {}
    for r in got:
        by.setdefault(r.digest, []).append(r)
    same = hashlib.sha256(b"One two three four five").hexdigest()
    assert sorted((r.doc_id or 0, r.keep_id, r.group_size, r.kept) for r in by[same]) == [
        (0, 1, 4, False), (1, 1, 4, False), (1, 1, 4, True), (6, 1, 4, False)
    ]
    assert {(r.doc_id, r.keep_id, r.kept) for r in by[hashlib.sha256(b"").hexdigest()]} == {(2, 2, True), (3, 2, False)}
    kept = exact_dedup.drop_duplicates(odd)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 4, 5, 7, 9]
    assert exact_dedup.exact_duplicates(empty).count() == exact_dedup.drop_duplicates(empty).count() == 0


def test_exact_dedup_beyond_the_broadcast(odd, monkeypatch):
    want = sorted(map(str, exact_dedup.exact_duplicates(odd, all_digests=True).drop("kept").collect()))
    monkeypatch.setattr(exact_dedup, "BROADCAST_KEYS", 0)
    monkeypatch.setattr(exact_dedup, "BROADCAST_GROUPS", 1)
    assert sorted(map(str, exact_dedup.exact_duplicates(odd, all_digests=True).drop("kept").collect())) == want
    assert sorted(r.doc_id for r in exact_dedup.drop_duplicates(odd).collect()) == [1, 2, 4, 5, 7, 9]


def slow_fingerprint(text):
    words = [w for w in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes)) if hashes else 0


def test_fingerprint():
    for text in (None, "", " \t", "A b", "a B c d e f", "Äß x\x0by z\x0cw q", "w " * 70_000):
        assert simhash.fingerprint(text) == slow_fingerprint(text)


@pytest.mark.parametrize("shard,side", [(20_000, 60_000), (60, 60_000), (60, 100)])
def test_hamming_links(spark, monkeypatch, shard, side):
    monkeypatch.setattr(simhash, "SHARD_ROWS", shard)
    monkeypatch.setattr(simhash, "SIDE_ROWS", side)
    monkeypatch.setattr(simhash, "LEAF_PAIRS", 64)
    draw, points = random.Random(5), set()
    for _ in range(300):
        x = draw.getrandbits(64)
        points.add(x)
        for _ in range(draw.randrange(4)):
            for b in draw.sample(range(64), draw.randrange(1, 7)):
                x ^= 1 << b
            points.add(x)
    points = sorted(points)
    f = np.array(points, np.uint64)
    root = list(range(len(points)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(points)):
        for j in np.flatnonzero(np.bitwise_count(f[i] ^ f) <= 4):
            a, b = find(i), find(int(j))
            root[max(a, b)] = min(a, b)
    want = {}
    for i, p in enumerate(points):
        want.setdefault(find(i), set()).add(p)
    df = spark.createDataFrame([(int(v),) for v in f.view(np.int64)], "fp long")
    got = {}
    for r in components.components(simhash.hamming_links(df)).collect():
        got.setdefault(r.root, set()).add(r.node % (1 << 64))
    assert sorted(map(sorted, got.values())) == sorted(sorted(s) for s in want.values() if len(s) > 1)


def test_visited_shards_without_residents(spark, monkeypatch):
    """Equal block values at the edge of a ring all visit the empty shard before it."""
    monkeypatch.setattr(simhash, "SHARD_ROWS", 1000)
    monkeypatch.setattr(simhash, "SIDE_ROWS", 500)
    block = simhash._vantage_points(0, 1)[0] ^ 0b11
    draw = random.Random(3)
    points = {(simhash._signed(draw.getrandbits(43) << 21 | block),) for _ in range(3000)}

    def sizes(levels, most_bits):
        return lambda cell: pd.DataFrame({"u": [len(cell)], "v": [int(cell["holds"].sum())]})

    monkeypatch.setattr(simhash, "_cell_links", sizes)
    cells = simhash.hamming_links(spark.createDataFrame(list(points), "fp long")).collect()
    assert all(c.v > 0 for c in cells)
    assert max(c.u for c in cells) < 3 * 500


def test_components(spark):
    path = [(i, i + 1) for i in range(60)] + [(100, 101), (7, 7)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(path, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100}


def test_near_duplicates(odd, empty):
    got = simhash.near_duplicates(odd).collect()
    assert len(got) == 11
    for r in got:
        if r.doc_id in (2, 3, 4):
            assert (r.fingerprint, r.component_id) == ("0" * 16, 2)
        if r.doc_id in (None, 1, 5, 6):
            assert r.component_id == 1
    kept = simhash.drop_near_duplicates(odd)
    assert kept.columns == odd.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2, 7, 9]
    assert simhash.near_duplicates(empty).count() == simhash.drop_near_duplicates(empty).count() == 0


TEXTS = [None, "", "  ", "Hello World's it's <|endoftext|> ΑΣ é 日本 42½ \x1c 'LL", "thnterble ANEA, anea.\nthe"]


def test_bpe_round_trip(spark, odd, empty):
    library = Tokenizer.from_file(WORD_BPE)
    df = odd.unionByName(spark.createDataFrame([(50 + i, t, None, None) for i, t in enumerate(TEXTS)], SCHEMA))
    rows = bpe_codec.decode(bpe_codec.encode(df, WORD_BPE), WORD_BPE).collect()
    assert len(rows) == 16
    for r in rows:
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        assert np.frombuffer(r.token_ids, "<u4").tolist() == ids
        assert r.decoded == library.decode(ids, skip_special_tokens=False)
    assert sorted(map(str, bpe_codec.round_trip(df, WORD_BPE).collect())) == sorted(map(str, rows))
    assert bpe_codec.decode(bpe_codec.encode(empty, WORD_BPE), WORD_BPE).count() == 0


def test_long_texts_in_segments(monkeypatch):
    monkeypatch.setattr(bpe_codec, "SEGMENT", 40)
    monkeypatch.setattr(token_counts, "SEGMENT", 40)
    text = " ".join(f"word{i}, it's  x" for i in range(200)) + "<|endoftext|>" + "y" * 100
    ids = np.frombuffer(bpe_codec.WordCodec(WORD_BPE).pack([text])[0], "<u4").tolist()
    assert ids == Tokenizer.from_file(WORD_BPE).encode(text, add_special_tokens=False).ids
    want = len(Tokenizer.from_file(BYTE_BPE).encode(text, add_special_tokens=False).ids)
    assert token_counts.PrefixCounter(BYTE_BPE).count([text]) == [want]


def test_prefix_counts(spark, odd, empty):
    library, counter, draw = Tokenizer.from_file(BYTE_BPE), token_counts.PrefixCounter(BYTE_BPE), random.Random(3)
    count = lambda t: len(library.encode(t, add_special_tokens=False).ids)
    parts = ["a", "the", " ", "  ", "'s", "'re", "'", "12", "½", "é", "\n", "\t", "!!", "<|endoftext|>", "日", "can't"]
    for _ in range(120):
        text = "".join(draw.choice(parts) for _ in range(12))
        assert list(counter.at_prefixes(text)) == [count(text[:i]) for i in range(len(text) + 1)]
        cut = counter.longest_within(text, 5)
        assert cut == max(i for i in range(len(text) + 1) if count(text[:i]) <= 5)
    rows = token_counts.count_tokens(odd, BYTE_BPE).collect()
    assert all(r.n_tokens == count(r.text or "") for r in rows)
    short = odd.where("doc_id < 7")
    for r in token_counts.truncate_to_budget(short, BYTE_BPE, 2).collect():
        assert (r.truncated is None) == (r.text is None) and count(r.truncated or "") <= 2
    assert token_counts.prefix_token_counts(short.where("text is null"), BYTE_BPE).first().prefix_tokens == [0]
    assert token_counts.count_tokens(empty, BYTE_BPE).count() == 0


def test_decontamination(spark, odd, empty):
    passage = "Alpha, beta gamma! Delta epsilon zeta eta theta iota kappa lambda"
    bench = spark.createDataFrame(
        [(7, passage), (7, passage), (8, "short item"), (9, None), (10, "!!"), (None, "five")],
        "item_id long, text string",
    )
    docs = odd.unionByName(
        spark.createDataFrame([(30, "x (alpha beta gamma delta EPSILON zeta eta theta iota kappa lambda) Short-item", None, None)], SCHEMA)
    )
    got = {r.doc_id: r for r in decontaminate.find_contamination(docs, bench, names=("n", "hit", "found", "spans")).collect()}
    r = got[30]
    assert (r.n, r.hit, r.found) == (14, 13, ["7", "8"])
    assert [r.text[s.start : s.end] for s in r.spans] == [r.text[3:r.text.index(")")] + ") Short-item"]
    assert (got[1].n, got[1].hit, got[1].found) == (5, 1, [""]) and (got[2].n, got[2].hit) == (0, 0)
    assert decontaminate.find_contamination(empty, bench).count() == 0
    assert decontaminate.find_contamination(odd, bench.limit(0)).where("n_hit > 0").count() == 0


def test_decontamination_by_parts(spark, odd, monkeypatch):
    """A benchmark beyond one automaton gives the same rows."""
    draw = random.Random(9)
    words = [f"w{i}é" for i in range(40)]
    text = lambda n: " ".join(draw.choice(words) for _ in range(n))
    items = [(i, text(draw.randrange(1, 60))) for i in range(30)] + [(None, "five"), (40, None), (3, "One two three")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = [(100 + i, f"{text(9)}, {t} {text(5)}; {t}", None, None) for i, (_, t) in enumerate(items)]
    docs = odd.unionByName(spark.createDataFrame(rows, SCHEMA))
    names = ("n", "hit", "found", "hits")
    want = decontaminate.find_contamination(docs, bench, names=names)
    monkeypatch.setattr(decontaminate, "MOST_BYTES", 20_000)
    got = decontaminate.find_contamination(docs, bench, names=names)
    assert got.columns == want.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert got.where("hit > 20").count() > 10


def test_secret_spans(odd, empty):
    text = (
        'é token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" AKIAABCDEFGHIJKLMN1 AKIASHORT token: token: abcdefgh '
        "passwd='hunter2222' k8Jz3xQ9vLmN2pRt7Wy5Bc1Df4Gh6 thisIsALongOrdinaryIdentifierName"
    )
    spark = odd.sparkSession
    words = (
        "this is a long ordinary identifier name of another value for some other thing the quick brown fox "
        "jumps over lazy dogs while zebras vex judges who make copies of hidden keys with extra joy "
    ) * 60
    models = secret_scan.train_markov(
        secret_scan.labelled_samples(spark.createDataFrame([(1, words)], "doc_id long, text string"))
    )
    df = odd.unionByName(spark.createDataFrame([(40, text, None, None)], SCHEMA))
    got = {r.doc_id: r for r in secret_scan.scan_secrets(df, models).collect()}
    found = [(s.kind, text[s.start : s.end]) for s in got[40].base]
    assert found == [
        ("assign", 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962'),
        ("hex", "04dbebab91ab85687d33eeaaf9ac699e1188f962"),
        ("access", "AKIAABCDEFGHIJKLMN1"),
        ("assign", "passwd='hunter2222"),
    ]
    extra = [text[s.start : s.end] for s in got[40].spans if s.kind == "markov"]
    assert extra == ["k8Jz3xQ9vLmN2pRt7Wy5Bc1Df4Gh6"]
    assert got[2].spans == [] and [s.kind for s in got[9].base] == ["assign"]
    assert secret_scan.scan_secrets(empty, None).count() == 0
    none = secret_scan.train_markov(empty.select(F.col("text").alias("token"), F.lit(1).alias("label")))
    assert set(none.ratios) == {0.0}


def test_secrets_in_parts_of_runs(spark):
    """Keys at the end of a path, between names, with a separator inside, and beside a base span."""
    words = (
        "this is a long ordinary identifier name of another value for some other thing the quick brown fox "
        "jumps over lazy dogs while zebras vex judges who make copies of hidden keys with extra joy "
    ) * 60
    models = secret_scan.train_markov(
        secret_scan.labelled_samples(spark.createDataFrame([(1, words)], "doc_id long, text string"))
    )
    path = "some/other/place/long/ordinary/identifier/name/quick/brown/fox/jumps/over/lazy/dogs/while/judges/copies/"
    key, other, hexed = "k8Jz3xQ9vLmN2pRt7Wy5Bc1D", "Zq4Xw8Kd2Vb6Nf9Hs3Lm7Rt5Pj", "04dbebab91ab85687d33eeaaf9ac699e"
    cases = [
        (f"at {path}{key} end", [key]),
        (f"{path}{key}/{path}{other}", [key, other]),
        (f"{path}{key}/{other}==", [f"{key}/{other}=="]),
        (f"{path}{key[:12]}/{key[12:]}", [f"{key[:12]}/{key[12:]}"]),
        (path, []),
        (f"{hexed}{other}", [other]),
        (f"{other}{hexed}{key}", [other, key]),
        (f"{key} {path}token=abcdefgh {other}", [key, other]),
        (f"{key}", [key]),
    ]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "doc_id int, text string")
    for row in secret_scan.scan_secrets(df, models).collect():
        text, want = cases[row.doc_id]
        extra = [s for s in row.spans if s.kind == "markov"]
        assert [s.value for s in extra] == [text[s.start : s.end] for s in extra] == want, text
        assert [s for s in row.spans if s.kind != "markov"] == row.base


def test_many_spans(spark):
    text = "token=abcdefgh " * 700
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    spans = secret_scan.scan_secrets(df, None).first().base
    assert [(s.start, s.end) for s in spans] == [(15 * i, 15 * i + 14) for i in range(700)]


def test_license_rules(odd, empty, spark):
    rules = licenses.signature_rules()
    assert len(rules) >= 300 and len({r.name for r in rules}) == len(rules)
    texts = {
        60: "Released under the MIT License. É-mit  license mit.license General public license amit license mit licenses",
        61: "This work is licensed under the GNU General Public License, version 3.",
        62: "Licensed under CC BY-NC 4.0.\nSPDX-License-Identifier: BSD-3-Clause",
        63: "Licensed under the Apache License, Version 2.0. See https://opensource.org/licenses/MIT",
    }
    df = odd.unionByName(spark.createDataFrame([(k, t, None, None) for k, t in texts.items()], SCHEMA))
    got = {r.doc_id: r for r in licenses.scan_licenses(df).collect()}
    assert [(p.word, p.label) for p in got[60].places] == [(3, "mit"), (6, "mit"), (8, "mit"), (10, "gpl")]
    assert got[60].n_words == 17
    assert {d.label for d in got[61].detections} == {"gpl-3.0"}
    assert [d.label for d in got[62].detections] == ["cc-by-nc", "bsd-3-clause"]
    assert [d.label for d in got[63].detections] == ["apache-2.0", "mit"]
    assert got[2].detections == [] and got[2].n_words == 0 and [p.label for p in got[9].places] == ["mit"]
    assert licenses.scan_licenses(empty).count() == 0


def test_suppression(spark):
    found = [(0, -30, -4, 30, "a", 0.9, "x"), (5, -20, -2, 20, "b", 0.8, "y"), (5, -20, -5, 20, "c", 0.9, "z"),
             (25, -40, -1, 40, "d", 0.5, "w"), (0, -30, -4, 30, "a", 0.9, "x2")]
    df = spark.createDataFrame([(found,)], f"d array<{licenses._DETECTION}>")
    kept = df.select(licenses.unsuppressed(F.col("d")).alias("k")).first().k
    assert [k.rule for k in kept] == ["x", "z", "w"]


def test_suppression_by_all_that_went_before(spark):
    """Each detection against all others, with a longer one of middle priority behind a short one of a high one."""
    draw = random.Random(5)
    cases = [[(0, 100, 4), (10, 20, 6), (30, 40, 2)]]
    for _ in range(60):
        spans = {(draw.randrange(40), draw.randrange(1, 30), draw.randrange(1, 6)) for _ in range(12)}
        cases.append([(a, a + n, priority) for a, n, priority in spans])
    rows = [
        (i, [(a, -b, -p, b, "x", 0.5, f"{a} {b} {p}") for a, b, p in case]) for i, case in enumerate(cases)
    ]
    df = spark.createDataFrame(rows, f"i int, d array<{licenses._DETECTION}>")
    got = {r.i: {k.rule for k in r.k} for r in df.select("i", licenses.unsuppressed(F.col("d")).alias("k")).collect()}
    for i, case in enumerate(cases):
        assert got[i] == {
            f"{a} {b} {p}" for a, b, p in case
            if not any(c <= a and b <= d and q >= p and (c, d, q) != (a, b, p) for c, d, q in case)
        }
    assert got[0] == {"0 100 4", "10 20 6"}


def test_rules_hold_their_keywords(spark):
    """What a rule matches has its keyword and one of the stems."""
    samples = {r.name: r for r in licenses.signature_rules()}
    texts = ["SPDX-License-Identifier: MIT", "licensed under the Boost Software License", "the ISC license",
             "https://www.mozilla.org/en-US/MPL/2.0", "https://unlicense.org", "CC-BY-SA-4.0", "GPLv3",
             "Permission is hereby granted, free of charge, to any person obtaining a copy"]
    for text in texts:
        hit = [r for r in samples.values() if re.search(r.pattern.replace("(?i)", ""), text, re.I)]
        assert hit and all(r.keyword in text.lower() for r in hit)
        assert any(s in text.lower() for s in licenses.STEMS)


def _made(tree, gap):
    """Texts that an expression can match, each branch and option taken, with ``gap`` for white space."""
    parts = []
    for op, arg in tree:
        if op is sre.LITERAL:
            parts.append([chr(arg)])
        elif op is sre.IN and (sre.CATEGORY, sre.CATEGORY_SPACE) in arg:
            parts.append([gap])
        elif op is sre.IN:
            parts.append([chr(a) if o is sre.LITERAL else "3" for o, a in arg if o is not sre.NEGATE])
        elif op is sre.BRANCH:
            parts.append([t for b in arg[1] for t in _made(b, gap)])
        elif op is sre.SUBPATTERN:
            parts.append(_made(arg[3], gap))
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
            parts.append(_made(arg[2], gap) + [""] * (arg[0] == 0))
        elif op in (sre.ANY, sre.CATEGORY):
            parts.append(["3"])
        else:
            assert op in (sre.AT, sre.ASSERT_NOT), op
    return ["".join(p) for p in itertools.product(*parts)]


@pytest.mark.parametrize("gap", [" ", "\n # ", "**"])
def test_all_matches_hold_keyword_and_stem(gap):
    """Matches made from the expression of every rule, all branches of it."""
    for rule in licenses.signature_rules():
        pattern = re.compile(rule.pattern.replace("(?i)", ""), re.I)
        found = [m[0].lower() for m in map(pattern.search, _made(_parser.parse(pattern.pattern), gap)) if m]
        assert found, rule.name
        for text in found:
            assert rule.keyword in text, (rule.name, text)
            assert any(s in text for s in licenses.STEMS) or re.search(licenses.SPLIT_STEM, text), (rule.name, text)


def _labels(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = licenses.scan_licenses(rows).orderBy("doc_id").collect()
    return [{d.label for d in r.detections} for r in got]


def test_names_without_the_usual_keyword(spark):
    want = {
        "Licensed under the Expat license": "mit", "X11 License": "mit", "the X11 (Expat) license": "mit",
        "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE": "wtfpl", "do what the f*ck\n * you want to public license": "wtfpl",
        "Permission to use, copy, modify, and/or distribute this software for any purpose": "isc",
        "CC\nBY-SA 4.0": "cc-by-sa", "released into the\n# public domain": "public-domain",
    }
    assert _labels(spark, want) == [{label} for label in want.values()]


def test_usual_spelling_of_each_family(spark):
    want = {
        "MIT License": "mit", "MIT No Attribution License": "mit-0", "MIT-0 license": "mit-0",
        "Apache License 2.0": "apache-2.0", "Apache-2.0 license": "apache-2.0", "Apache License 1.1": "apache-1.1",
        "GNU General Public License v3.0": "gpl-3.0", "GNU General Public License v2.0": "gpl-2.0",
        "GNU Lesser General Public License v3.0": "lgpl-3.0", "GNU Lesser General Public License v2.1": "lgpl-2.1",
        "GNU Library General Public License v2": "lgpl-2.0", "GNU Affero General Public License v3.0": "agpl-3.0",
        "GNU Free Documentation License v1.3": "gfdl-1.3", "BSD 3-Clause License": "bsd-3-clause",
        'BSD 3-Clause "New" or "Revised" License': "bsd-3-clause", "New BSD License": "bsd-3-clause",
        "BSD 2-Clause License": "bsd-2-clause", 'BSD 2-Clause "Simplified" License': "bsd-2-clause",
        "BSD Zero Clause License": "bsd", "BSD License": "bsd", "Mozilla Public License 2.0": "mpl-2.0",
        "Mozilla Public License 1.1": "mpl-1.1", "Eclipse Public License 2.0": "epl-2.0",
        "Eclipse Public License 1.0": "epl-1.0", "Eclipse Distribution License 1.0": "edl-1.0",
        "Common Development and Distribution License 1.0": "cddl-1.0", "Common Public License 1.0": "cpl-1.0",
        "ISC License": "isc", "zlib License": "zlib", "libpng License": "libpng", "Boost Software License 1.0": "bsl-1.0",
        "The Unlicense": "unlicense", "Do What The F*ck You Want To Public License": "wtfpl",
        "Artistic License 2.0": "artistic-2.0", "Artistic License 1.0": "artistic-1.0",
        "Python Software Foundation License 2.0": "psf-2.0", "PSF License": "psf-2.0", "PHP License v3.01": "php-3.01",
        "Ruby License": "ruby", "OpenSSL License": "openssl", "PostgreSQL License": "postgresql",
        "SIL Open Font License 1.1": "ofl-1.1", "University of Illinois/NCSA Open Source License": "ncsa",
        "Microsoft Public License": "ms-pl", "Microsoft Reciprocal License": "ms-rl",
        "European Union Public License 1.2": "eupl-1.2", "CeCILL Free Software License Agreement v2.1": "cecill-2.1",
        "Universal Permissive License v1.0": "upl-1.0", "Academic Free License v3.0": "afl-3.0",
        "Open Software License 3.0": "osl-3.0", "Educational Community License v2.0": "ecl-2.0",
        "Open Data Commons Open Database License v1.0": "odbl-1.0",
        "Open Data Commons Attribution License v1.0": "odc-by-1.0",
        "Open Data Commons Public Domain Dedication & License 1.0": "pddl-1.0",
        "Open Government Licence v3.0": "ogl-uk-3.0", "Business Source License 1.1": "busl-1.1",
        "Server Side Public License, v 1": "sspl-1.0", "Elastic License 2.0": "elastic-2.0",
        "CreativeML OpenRAIL-M License": "openrail", "licensed under the OpenRAIL license": "openrail",
        "CreativeML Open RAIL-M License": "openrail",
    }
    assert set(want.values()) == {f[0] for f in licenses.FAMILIES}
    found = dict(zip(want, _labels(spark, want)))
    assert {text: found[text] for text in want if want[text] not in found[text]} == {}
    assert found["CreativeML OpenRAIL-M License"] == {"openrail"} and found["BSD 3-Clause License"] == {"bsd-3-clause"}
    assert found["Apache License 1.1"] == {"apache-1.1"} and found["Artistic License 1.0"] == {"artistic-1.0"}


def test_warc_round_trip(spark, tmp_path):
    long = "<p>é" + "x" * 2000
    rows = [(1, "http://a/\n", long), (2, None, long), (3, "u", long), (4, "u", None), (5, "u", ""), (6, "u", "small"),
            (7, "u", "small"), (None, "u", long), (3, "u", long), (8, "u", "y" * 3_000_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("archive", F.lit(1))
    folder = f"file://{tmp_path}"
    manifest = warc.write_monolithic(warc.mark_revisits(pages.repartition(2)), f"{folder}/a", archive_bytes=4000)
    done = warc.normalise(manifest, f"{folder}/b")
    assert done.agg(F.sum("records")).first()[0] == 10
    got = warc.read_records(warc.read_index(spark, f"{folder}/b")).collect()
    assert sorted((r.record_id or "", r.record_type, r.refers_to or "") for r in got) == sorted(
        [("1", "revisit", "3"), ("2", "revisit", "3"), ("3", "response", ""), ("3", "response", ""), ("", "revisit", "3")]
        + [(str(i), "response", "") for i in (4, 5, 6, 7, 8)]
    )
    texts = {str(i): (h or "").encode() for i, _, h in rows} | {"": long.encode()}
    for r in got:
        want = texts[r.record_id or ""]
        assert (r.payload_bytes, r.payload_digest) == (len(want), hashlib.sha1(want).hexdigest())
        assert r.payload is None if r.record_type == "revisit" else bytes(r.payload) == want
    nothing = warc.write_monolithic(warc.mark_revisits(pages.limit(0)), f"{folder}/c")
    assert warc.normalise(nothing, f"{folder}/d").count() == 0
    assert warc.read_records(warc.read_index(spark, f"{folder}/d")).count() == 0


def _corpus(spark):
    draw, rows = random.Random(9), []
    bits = {"aa": ["tha", "ing", "er"], "bb": ["ung", "sch", "ein"], "cc": ["eau", "é", "tion"]}
    for i in range(360):
        lang = sorted(bits)[i % 3]
        words = ["".join(draw.choice(bits[lang]) for _ in range(draw.randrange(1, 4))) for _ in range(40)]
        bad = i % 4 == 0
        rows.append((i, " ".join(w + "***" if bad else w for w in words), lang, 0 if bad else 1))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, quality int")


def test_languages(spark, odd, empty):
    docs = _corpus(spark)
    model = langid.train_languages(docs.where("doc_id % 5 <> 0"))
    got = langid.identify(docs.where("doc_id % 5 = 0"), model).collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) >= 0.95
    edges = {r.doc_id: r for r in langid.identify(odd, model, names=("lang_pred", "p", "rejected")).collect()}
    for i in (2, 3, 4):
        assert (edges[i].lang_pred, edges[i].p, edges[i].rejected) == ("und", 0.0, True)
    assert 0 <= edges[7].p <= 1 and edges[7].lang_pred in model.languages
    nothing = langid.train_languages(docs.limit(0))
    assert nothing.predict("some text") == ("und", 0.0, True)
    assert langid.identify(empty, model).count() == 0


def test_subwords_by_pieces(monkeypatch):
    whole = np.concatenate(list(langid.subword_buckets("Ab cde fghij " * 50)))
    monkeypatch.setattr(langid, "_PIECE", 37)
    assert sorted(np.concatenate(list(langid.subword_buckets("Ab cde fghij " * 50)))) == sorted(whole)


def test_quality(spark, odd, empty):
    docs = _corpus(spark)
    labels = docs.select("doc_id", "quality").unionByName(
        spark.createDataFrame([(1, None), (None, 1), (10**9, 0)], "doc_id long, quality int")
    )
    model = quality.train_quality(docs, labels.where("doc_id % 5 <> 0 or doc_id is null"))
    got = quality.score_quality(docs.where("doc_id % 5 = 0"), model).collect()
    assert np.mean([(r.score >= 0.3) == r.quality for r in got]) >= 0.95
    edges = quality.score_quality(odd, model, score_col="q").collect()
    assert len(edges) == 11 and all(0 <= r.q <= 1 for r in edges)
    assert len({r.q for r in edges if r.doc_id in (2, 3, 4)}) == 1
    assert quality.train_quality(docs, labels.limit(0)).score("x") == 0.5
    assert quality.score_quality(empty, model, score_col="q").count() == 0


def test_long_text_tokens_by_pieces(monkeypatch):
    text = "One two two 12 *** TWO three, " * 40
    whole = quality.token_hashes(text)
    monkeypatch.setattr(quality, "PIECE_BYTES", 64)
    assert (quality.token_hashes(text) == whole).all()


def _random_strings(draw):
    """Keys of several alphabets, 20 to 64 characters."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    alphabets = (letters, letters + "+/", letters + "-_", letters[:26] + letters[-10:])
    return ["".join(draw.choices(alphabets[i % 4], k=draw.randrange(20, 65))) for i in range(400)]


ORDINARY = (
    "-" * 28, "=" * 40, "_" * 31, "1234567890123456789012345", "2024-01-02T10-11-12-000000",
    "123e4567-e89b-12d3-a456-426614174000", "XMLHttpRequestUpload2FormDataSHA256",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "this_is_a_long_identifier_name_42", "AbstractSingletonProxyFactoryBean",
    "src/main/java/org/apache/commons/lang3/StringUtils", "max_position_embeddings_per_layer",
    "linux-image-5-15-0-105-generic", "0000000000000000000001", "getElementsByTagNameNS2WithPrefix",
)


def test_random_strings_are_told_from_ordinary_runs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    models = secret_scan.train_markov(secret_scan.labelled_samples(docs))
    draw = random.Random(21)
    uuids = ["-".join("".join(draw.choices("0123456789abcdef", k=k)) for k in (8, 4, 4, 4, 12)) for _ in range(50)]
    rows = [(1, f"key {t} end") for t in _random_strings(draw)] + [(0, f"see {t}, then") for t in (*ORDINARY, *uuids)]
    df = spark.createDataFrame(rows, "random int, text string").repartition(8)
    found = secret_scan.scan_secrets(df, models).select("random", "text", F.size("spans").alias("n")).collect()
    assert [r.text for r in found if not r.random and r.n] == []
    assert np.mean([r.n > 0 for r in found if r.random]) >= 0.95
    # Nothing is taken for a key in ordinary documents.
    scanned = secret_scan.scan_secrets(docs, models)
    assert scanned.where(F.exists("spans", lambda s: s["kind"] == "markov")).count() == 0


def test_models_without_one_of_the_classes_find_nothing(spark):
    for label in (0, 1):
        samples = spark.createDataFrame([("abcdefghijklmnopqrstuvw", label)] * 5, "token string, label int")
        models = secret_scan.train_markov(samples)
        df = spark.createDataFrame([("kJ8s7Df6g5H4j3K2l1Qw0Er9",)], "text string")
        assert secret_scan.scan_secrets(df, models).first().spans == []


def test_given_license_rules(spark):
    rule = licenses.Rule("foo", "foo-eula", "eula", 4, 0.9, r"(?i)foo corp eula")
    df = spark.createDataFrame([("Covered by the Foo Corp EULA here",), ("nothing",), (None,)], "text string")
    found = [[d.label for d in r.detections] for r in licenses.scan_licenses(df, rules=[rule]).collect()]
    assert found == [["foo-eula"], [], []]
    assert [r.detections for r in licenses.scan_licenses(df, rules=[]).collect()] == [[], [], []]


def test_license_notices(spark):
    want = {
        "// you may not use this file except in compliance\n// with the License.": "apache-2.0",
        "This program is free software: you can redistribute it and/or modify it under": "gpl",
        "either version 3 of the License, or (at your option) any later version": "gpl-3.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.": "mpl-2.0",
        "# Redistributions of source code must retain the above copyright\n# notice": "bsd",
        "Neither the name of the University nor the names of its contributors may be used to endorse or promote products": "bsd-3-clause",
        "This file is subject to the terms of the Common Development and Distribution License": "cddl-1.0",
        "When distributing Covered Code, include this CDDL HEADER in each file": "cddl-1.0",
        "shall be included in all copies. The Software shall be used for Good, not Evil.": "json",
        "this permission notice shall be included in all copies or substantial portions of the Software": "mit",
        "altered source versions must be plainly marked as such": "zlib",
    }
    found = dict(zip(want, _labels(spark, want)))
    assert {t: found[t] for t in want if want[t] not in found[t]} == {}


def test_frequent_buckets_of_long_texts(spark, monkeypatch):
    docs = _corpus(spark)
    for module, train in ((langid, langid.train_languages), (quality, lambda d: quality.train_quality(d, d))):
        whole = train(docs)
        monkeypatch.setattr(module, "ROW_BUCKETS", 40)
        few = train(docs.repartition(7))
        assert few.bias is not None and whole.bias is not None
    held = langid.identify(docs, langid.train_languages(docs))
    assert held.where("lang = lang_pred").count() >= 340


def test_samples_do_not_depend_on_partitions(spark):
    docs = _corpus(spark).drop("doc_id").withColumn("doc_id", F.lit(1).cast("long"))
    one, two = (quality.train_quality(d, d.limit(1), sample_rows=50) for d in (docs.coalesce(1), docs.repartition(9)))
    assert (one.weights == two.weights).all() and one.bias == two.bias


def test_pipeline_dedup_hashes_only_ids_that_lose_rows(odd):
    plan = exact_dedup.drop_duplicates(odd)._jdf.queryExecution().optimizedPlan().toString()
    hashed = [line for line in plan.splitlines() if "sha2" in line]
    assert hashed and all("CASE WHEN met" in line for line in hashed)
