"""Ranked search against a plain scorer, on random texts with ties and on odd rows."""

import math
import random
import re

import pytest

from headwise.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(docs, queries, k):
    """Every document for every query, from the definition."""
    terms = lambda t: [w.translate(LOWER) for w in TERM.findall(t or "")]
    held = [(key, terms(t)) for key, t in docs]
    held = [(key, t) for key, t in held if t]
    n, total = len(held), sum(len(t) for _, t in held)
    out = []
    for item, text in queries:
        scored = []
        for key, words in held:
            m, score = 75 + 25 * len(words) * n // total, 0
            for q in terms(text):
                df = sum(q in w for _, w in held)
                tf = words.count(q)
                if tf:
                    score += math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1))) * (10**9 * tf // (1000 * tf + 12 * m))
            if score > 0:
                scored.append((-score, key is None, key or 0, key))
        out += [(item, i + 1, key, -s) for i, (s, _, _, key) in enumerate(sorted(scored)[:k])]
    return out


@pytest.mark.parametrize("seed,tokens", [(1, 40), (2, 200), (3, 10_000)])
def test_against_plain_scores(spark, monkeypatch, seed, tokens):
    """Small blocks, so that documents spread over many, and few terms, so that scores tie."""
    r = random.Random(seed)
    pool = ["Aa", "b", "c1", "Été", "été", "d-d", "x_y", "7", "ß", "日本"]
    text = lambda n: " ".join(r.choices(pool, weights=range(10, 0, -1), k=n))
    docs = [(r.randint(0, 99), text(r.randint(0, 25))) for _ in range(120)]
    docs += [(None, "b b c1"), (None, None), (200, ""), (201, " .,\n"), (300, docs[3][1]), (301, "b " * 3000), docs[3]]
    queries = [(i, text(r.randint(1, 9))) for i in range(12)] + [(50, None), (51, ""), (52, "unheard of"), (None, "c1 b"), (3, "7")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    asked = spark.createDataFrame(queries, "item_id long, text string")
    monkeypatch.setattr(lexical, "BLOCK_TOKENS", tokens)
    monkeypatch.setattr(lexical, "QUERY_ROWS", 5)
    got = lexical.search(lexical.build(frame), asked, k=6)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    order = lambda rows: sorted(rows, key=str)
    assert order(tuple(x) for x in got.collect()) == order(plain(docs, queries, 6))


def test_index_holds_every_row(spark):
    docs = [(i, f"common word{i % 7} " * (i % 4)) for i in range(80)]
    index = lexical.build(spark.createDataFrame(docs, "doc_id long, text string").repartition(4))
    assert (index.documents, index.terms) == (60, sum(2 * (i % 4) for i in range(80)))
    df = {bytes(r["term"]).decode(): r["df"] for r in index.vocabulary.collect()}
    assert df["common"] == 60 and sum(df.values()) == 120


def test_odd_tables(spark):
    docs = spark.createDataFrame([(1, "one two", "x"), (2, "two", "y")], "doc_id long, text string, Score string")
    asked = spark.createDataFrame([("a", "two two", 5, "r")], "item string, text string, RANK int, more string")
    index = lexical.build(docs)
    got = lexical.search(index, asked)
    assert got.columns == ["item", "more", "rank", "doc_id", "score"]
    assert [tuple(r)[:4] for r in got.orderBy("rank").collect()] == [("a", "r", 1, 2), ("a", "r", 2, 1)]
    assert lexical.search(index, asked.limit(0)).count() == 0
    empty = lexical.build(docs.limit(0))
    assert (empty.documents, empty.terms) == (0, 0) and lexical.search(empty, asked).count() == 0
    twice = lexical.search(index, asked.unionAll(asked))
    assert sorted(r["rank"] for r in twice.collect()) == [1, 1, 2, 2]
