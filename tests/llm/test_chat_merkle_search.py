"""Conversation formatting, Merkle proofs and ranked search against brute force."""

import hashlib
import math
import random
import re
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from shopcast.llm import chat, merkle, ranked_search


def sha(*texts):
    return hashlib.sha256("".join(texts).encode()).hexdigest()


# Conversations -------------------------------------------------------------

TURNS = [
    (1, 0, "user", "hi \\ ### x </turn> \\"), (1, 1, "assistant", "\\### Assistant: </turn> ok"), (None, 0, None, None),
    (2, 0, "a:b\n### ", "é" * 10), (2, 1, "assistant", ""), (2, 1, "assistant", ""), (2, None, "assistant", "zß"),
    (3, 0, "assistant", "### assistant: x</turn>\n### user: y</turn>\n"), (4, 0, "", "#### \\\\### </turn></turn>"),
    (5, 0, "assistant", "</turn> \U0001f600 " * 20_000),
    *((7, i, "assistant" if i % 2 else "user", "</turn" * 50 + str(i)) for i in range(300)),
]


def slow_conversation(rows):
    rows = sorted(rows, key=lambda x: (x[1] is not None, x[1] or 0, x[2] or "", x[3] or ""))
    loss = "".join(x[3] or "" for x in rows if x[2] == "assistant")
    turns = "".join(f"{x[2] or ''}\n{x[3] or ''}\n" for x in rows)
    esc = lambda s, marks: re.sub(marks, lambda m: "\\" + m[0], s or "")
    text = "".join(
        f"### {esc(x[2], r'\\|:|### |</turn>')}: {esc(x[3], r'\\|### |</turn>')}</turn>\n" for x in rows
    )
    return (len(rows), sha(turns), len(loss), sha(loss), len(text)), text


@pytest.fixture(scope="module")
def turns(spark):
    df = spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string")
    return df.select("*", F.lit(1).alias("part"), F.lit("x").alias("formatted"), F.lit(2).alias("loss")).repartition(3)


@pytest.mark.parametrize("piece_bytes", [chat.PIECE_BYTES, 700])
def test_conversations(spark, monkeypatch, turns, piece_bytes):
    if piece_bytes == 700:
        # Pieces end with a batch of rows.
        monkeypatch.setattr(chat, "slices", lambda batch, _: (batch.slice(i, 20) for i in range(0, batch.num_rows, 20)))
    pieces = chat.format_conversations(turns, piece_bytes=piece_bytes)
    want = {c: slow_conversation([x for x in TURNS if x[0] == c]) for c in {x[0] for x in TURNS}}
    texts, spans = {}, Counter()
    for p in sorted(pieces.collect(), key=lambda p: (p.part, p.piece)):
        texts[p.conv_id] = texts.get(p.conv_id, "") + p.formatted
        spans[p.conv_id] += len(p.loss)
    assert texts == {c: text for c, (_, text) in want.items()}
    assert spans[7] == 150 and spans[2] == 3 and spans[None] == 0
    got = {r.conv_id: tuple(r)[1:] for r in chat.read_conversations(pieces).collect()}
    assert got == {c: row for c, (row, _) in want.items()}
    if piece_bytes == 700:
        assert pieces.where("conv_id = 7").count() > 1


def test_conversations_of_an_empty_table(turns):
    assert chat.read_conversations(chat.format_conversations(turns.limit(0))).collect() == []


def test_broken_text_is_refused(spark, turns):
    pieces = chat.format_conversations(turns).withColumn("formatted", F.concat("formatted", F.lit("rest")))
    with pytest.raises(Exception, match="does not end with a turn"):
        chat.read_conversations(pieces).collect()


def test_assembly_of_sliced_arrays():
    roles, texts = pa.array(["x", "user", "assistant"]).slice(1), pa.array(["", "a\\b", "é"]).slice(1)
    formatted, loss = chat.assemble(roles, texts, chat._firsts(pa.array([1, 1])))
    (text,), ((span,),) = formatted.to_pylist(), loss.to_pylist()
    assert text == "### user: a\\\\b</turn>\n### assistant: é</turn>\n"
    assert text[span["start"] : span["end"]] == "é"


# Merkle proofs ---------------------------------------------------------------


def levels_of(leaves, fanout):
    levels = [leaves]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([sha(*below[i : i + fanout]) for i in range(0, len(below), fanout)])
    return levels


def path_of(levels, i, fanout):
    out = []
    for level in levels[:-1]:
        first = i - i % fanout
        out.append(("".join(level[first:i]), "".join(level[i + 1 : first + fanout])))
        i //= fanout
    return out


@pytest.mark.parametrize("fanout,slots", [(2, 16), (2, 2), (3, 16), (20, 16)])
def test_merkle_proofs(spark, monkeypatch, fanout, slots):
    monkeypatch.setattr(merkle, "SLOTS", slots)
    draw = random.Random(fanout)
    rows = [(i if i else None, draw.choice([None, "a", "b", "é", "A", ""]), sha(str(i)), "x") for i in range(150)]
    rows += [(999, "alone", sha("x"), "x"), *rows[:3]]
    df = spark.createDataFrame(rows, "id long, g string, d string, digest string").repartition(5)
    found = merkle.merkle_proofs(df, "g", ["id"], "d", fanout).select(
        "*", merkle.proof_digest(F.col("path")).alias("p"), merkle.folded(F.col("d"), F.col("path")).alias("f")
    )
    groups = {}
    for x in sorted(rows, key=lambda x: (x[1] is not None, (x[1] or "").encode(), x[0] is not None, x[0] or 0, x[2])):
        groups.setdefault(x[1], []).append(x)
    trees = {g: levels_of([x[2] for x in v], fanout) for g, v in groups.items()}
    top = levels_of([tree[-1][0] for tree in trees.values()], fanout)
    want = Counter()
    for j, g in enumerate(groups):
        for i, x in enumerate(groups[g]):
            path = path_of(trees[g], i, fanout) + path_of(top, j, fanout)
            want[(*x, trees[g][-1][0], top[-1][0], tuple(path), sha(*(a + b for a, b in path)), top[-1][0])] += 1
    got = Counter((*r[:6], tuple((s.left, s.right) for s in r.path), r.p, r.f) for r in found.collect())
    assert got == want


def test_merkle_of_few_rows(spark):
    kind = "id long, g string, d string"
    assert merkle.merkle_proofs(spark.createDataFrame([], kind), "g", ["id"], "d").collect() == []
    (one,) = merkle.merkle_proofs(spark.createDataFrame([(None, None, "q")], kind), "g", ["id"], "d").collect()
    assert (one.subroot, one.root, one.path) == ("q", "q", [])


def test_row_digest(spark):
    df = spark.createDataFrame([(12, "é", None), (None, "", "x" * 300_000)], "a long, b string, c string")
    got = [r[0] for r in df.select(merkle.row_digest(["a", "b", F.col("c")])).collect()]
    assert got == [sha("2:12", "2:é", "-"), sha("-", "0:", "300000:" + "x" * 300_000)]


# Ranked search ---------------------------------------------------------------


def slow_search(docs, items, top, base=50):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    held = [(i, split(t)) for i, t in docs if split(t)]
    total, tokens = len(held), sum(len(w) for _, w in held)
    df = Counter(w for _, words in held for w in set(words))
    out = []
    for item, text in items:
        found = []
        for i, words in held:
            m, count, score = 100 - base + base * len(words) * total // tokens, Counter(words), 0
            for t in set(split(text)):
                if count[t]:
                    w = math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1)))
                    score += w * (1_000_000_000 * count[t] // (1000 * count[t] + 20 * m))
            if score > 0:
                found.append((-score, i is None, i or 0))
        out += [(item, k + 1, None if n else i, -s) for k, (s, n, i) in enumerate(sorted(found)[:top])]
    return Counter(out)


@pytest.fixture(scope="module")
def corpus():
    draw = random.Random(3)
    words = ["w%d" % i for i in range(150)] + ["É", "ß", "the", "The"] * 5
    docs = [(i, " ".join(draw.choices(words, k=draw.choice([1, 5, 30, 200])))) for i in range(400)]
    docs += [(500, None), (501, ""), (502, " \t..,1_"), (None, "the w1"), (None, "the w1 w2"), (3, docs[3][1]), (503, "w1 " * 50_000)]
    docs += [(600 + i, "the w1, w2") for i in range(150)]
    items = [(i, " ".join(draw.choices(words, k=draw.choice([1, 12, 90])))) for i in range(8)]
    items += [(8, None), (9, "nowhere to be found"), (None, "the W1"), (2, items[2][1]), (10, " ".join(words) * 2)]
    return docs, items


@pytest.mark.parametrize("limits", [{}, {"MOST_TERMS": 0, "PASS_TERMS": 30}, {"BLOCK_DOCS": 7, "HELD_TERMS": 300, "BLOCK_TERMS": 200}])
def test_search(spark, monkeypatch, corpus, limits):
    for name, value in limits.items():
        monkeypatch.setattr(ranked_search, name, value)
    docs, items = corpus
    d = spark.createDataFrame(docs, "doc_id long, text string").select(
        "*", F.lit("x").alias("score"), F.lit(1).alias("n"), F.lit(1).alias("word"), F.lit(1).alias("row")
    )
    q = spark.createDataFrame(items, "item_id int, text string").select("*", F.lit(1).alias("rank"))
    got = ranked_search.search(d.repartition(5), q, top=20)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert Counter(map(tuple, got.collect())) == slow_search(docs, items, 20)


def test_search_without_rows(spark, corpus):
    d = spark.createDataFrame(corpus[0], "doc_id long, text string")
    q = spark.createDataFrame(corpus[1], "item_id int, text string")
    assert ranked_search.search(d.limit(0), q).count() == ranked_search.search(d, q.limit(0)).count() == 0
    with pytest.raises(ValueError, match="integer"):
        ranked_search.search(d, q, id_col="text")
