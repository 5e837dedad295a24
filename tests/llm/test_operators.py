"""Mixing, line dedup, URL filter, top-k, and the two classifiers on small and odd rows."""

import math
import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from headwise.llm import lines, mixing, quality, topk, toxicity, urls
from headwise.llm.queries import LLM_ORACLE, LLM_QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("key", sorted(LLM_ORACLE))
def test_queries_against_sql(spark, key):
    con = duckdb.connect()
    for name in ("documents", "embeddings", "pages", "labels", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    cursor = con.execute(LLM_ORACLE[key])
    names = [d[0] for d in cursor.description]
    got = LLM_QUERIES[key](spark, FOLDER)
    assert sorted(got.columns) == sorted(names)
    assert sorted(map(str, (tuple(r[c] for c in names) for r in got.collect()))) == sorted(map(str, cursor.fetchall()))


# --- mixing ----------------------------------------------------------------------------


def test_period_keeps_every_window_and_deviates_by_less_than_a_block(spark):
    for shares in ([1], [1, 1], [16, 9, 9, 7, 7, 5, 5, 3, 39], [1, 1, 1, 97], [3, 5, 7, 11]):
        total = sum(shares)
        rows = mixing.period(spark, shares).orderBy("_in_period").collect()
        assert [r["_in_period"] for r in rows] == list(range(total))
        given = [0] * len(shares)
        for t, r in enumerate(rows):
            i, k = r["_stream"], r["_turn"]
            assert k == given[i]
            assert k * total // shares[i] <= t < -(-(k + 1) * total // shares[i])  # released, and in time
            given[i] += 1
            assert all(abs(shares[j] * (t + 1) / total - given[j]) < 1 for j in range(len(shares)))


def test_mix(spark):
    rows = [(i, "hot" if i % 3 else f"s{i % 5}", "x" * (i % 40), "old") for i in range(900)]
    rows += [(None, None, None, None), (7, "hot", "dup", "d"), (7, "hot", "dup", "d"), (2000, "hot", "y" * 100_000, "long")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, Slot string")
    weights = {"hot": 2.0, "s0": 1.0}
    got = mixing.mix(docs, weights, 1.0, block=10, resolution=4)
    assert got.columns == ["doc_id", "source", "text", "stream", "source_row", "block", "slot"]
    found = got.collect()
    assert len(found) == len(rows)
    for name in ("hot", "s0", None):
        mine = sorted((r for r in found if r["stream"] == name), key=lambda r: r["source_row"])
        assert [r["source_row"] for r in mine] == list(range(1, len(mine) + 1))
        assert [r["block"] for r in mine] == [i // 10 for i in range(len(mine))]
    # While all streams last, no prefix of slots is a block or more away from the target.
    at = {(r["stream"], r["block"]): r["slot"] for r in found}
    ends = min(max(b for s, b in at if s == name) for name in ("hot", "s0", None))
    slots = {s: n for (n, b), s in at.items()}
    for t in range(2 * ends):
        for name, share in (("hot", 0.5), ("s0", 0.25), (None, 0.25)):
            assert abs(share * (t + 1) - sum(slots.get(i, "gap") == name for i in range(t + 1))) < 1
    by_text = mixing.mix(docs, weights, 1.0, size=F.char_length("text"), block=100).collect()
    assert len(by_text) == len(rows)
    assert mixing.mix(docs.limit(0), weights, 1.0).count() == 0
    with pytest.raises(ValueError):
        mixing.mix(docs, {"hot": 0.0}, 1.0)


# --- line dedup ------------------------------------------------------------------------


def brute_lines(docs, least):
    """Runs by comparing every pair of places; docs in order of their keys. Lines without a word
    are looked through."""
    words = lambda x: len(x.split())
    real = {k: [i for i, x in enumerate(t.split("\n")) if words(x)] for k, t in docs}
    gone = {k: set() for k, _ in docs}
    for n, (k, text) in enumerate(docs):
        a = [text.split("\n")[i] for i in real[k]]
        for k0, text0 in docs[: n + 1]:
            b = [text0.split("\n")[i] for i in real[k0]]
            for i in range(len(a)):
                for j in range(len(b)):
                    if k0 == k and j >= i:
                        break
                    m = 0
                    while i + m < len(a) and j + m < len(b) and a[i + m] == b[j + m] and not (k0 == k and j + m >= i):
                        m += 1
                    if m and sum(map(words, a[i : i + m])) >= least:
                        gone[k].update(range(real[k][i], real[k][i + m - 1] + 1))
    return {k: "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone[k]) for k, t in docs}


@pytest.mark.parametrize("seed", range(6))
def test_lines_against_pairs_of_places(spark, seed):
    r = random.Random(seed)
    pool = [" ".join(f"l{i}" for _ in range(r.randint(1, 5))) for i in range(7)]
    docs = [(k, "\n".join(r.choices(pool, k=r.randint(1, 14)))) for k in range(9)]
    docs += [(49, docs[2][1].replace("\n", "\n\n \n")), (50, docs[3][1].replace(" ", "\t")), (54, docs[3][1]), (51, "\n".join(["same line here"] * 9)), (52, ""), (53, "\n\n\n\n\n\n\n\n")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = {x["doc_id"]: x["text"] for x in lines.drop_repeated_lines(frame, 6).collect()}
    want = brute_lines(docs, 6)
    # A window only looks at its first place; where the same one overlaps itself, pairs of
    # places see a little more.
    assert got.keys() == want.keys()
    for k in got:
        if k != 51:
            assert got[k] == want[k], k


def test_words_of_lines(spark):
    """Empty lines hold no words; tabs part words as blanks do."""
    tabbed = "\n".join("\t".join(f"t{i}x{j}" for j in range(20)) for i in range(3))
    rows = [(1, "\n" * 60), (2, "\n" * 60), (3, tabbed), (4, "new\n\n" + tabbed), (5, " " * 70 + "indented"), (6, " " * 70 + "indented")]
    got = {r["doc_id"]: r["text"] for r in lines.drop_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {**dict(rows), 4: "new\n"}


def test_lines_odd_rows(spark):
    passage = "\n".join(" ".join(f"p{i}q{j}" for j in range(20)) for i in range(4))
    rows = [
        (1, "intro\n" + passage, 5, "a"), (2, passage + "\nend", 6, "b"), (2, passage + "\nend", 6, "b"), (3, None, 7, "c"),
        (4, "", 8, "d"), (None, "x\n" + passage, 9, "e"), (5, "short\nshort\nshort", 1, "f"), (6, "\n".join(f"line {i}" for i in range(30_000)), 1, "g"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, N_Lines long, runs string")
    got = lines.drop_repeated_lines(docs)
    assert got.columns == ["doc_id", "text", "runs", "n_lines", "n_removed"]
    by = {}
    for r in got.collect():
        by.setdefault(r["doc_id"], []).append((r["text"], r["n_lines"], r["n_removed"]))
    assert by[None] == [("x\n" + passage, 5, 0)]  # a NULL key is the earliest
    assert by[1] == [("intro", 5, 4)] and by[2] == [("end", 5, 4)] * 2
    assert by[3] == [(None, 0, 0)] and by[4] == [("", 1, 0)] and by[5] == [("short\nshort\nshort", 3, 0)]
    assert by[6][0][1:] == (30_000, 0)
    assert lines.drop_repeated_lines(docs.limit(0)).count() == 0


# --- URLs ------------------------------------------------------------------------------


def test_urls(spark):
    cases = {
        "http://a.example.net/x": ("a.example.net", "/x", None, "allow"),
        "https://WWW.Spam-Farm.net/a?b#c": ("www.spam-farm.net", "/a", None, "block"),
        "http://spam-farms.net/": ("spam-farms.net", "/", None, "allow"),
        "http://x.net/free-loans": ("x.net", "/free-loans", None, "block"),
        "http://x.net/free/freedom/free": ("x.net", "/free/freedom/free", None, "allow"),
        "http://porn.example.org/fr/": ("porn.example.org", "/fr/", "org/", "allow"),
        "http://notexample.org/en/1": ("notexample.org", "/en/1", "org/", "allow"),
        "http://a.example.org/en/12": ("a.example.org", "/en/12", "example.org/en/1", "block"),
        "http://b.com/de/": ("b.com", "/de/", "com/de/", "block"), "http://org": ("org", "", None, "allow"),
        "no scheme xxx": ("", "", None, "block"), "": ("", "", None, "allow"), None: ("", "", None, "allow"),
        "http://h?x://y/z": ("h", "", None, "allow"), "a\nb://h/p": ("h", "/p", None, "allow"),
        "http://l/" + "q" * 200_000: ("l", "/" + "q" * 200_000, None, "allow"),
    }
    rows = [(u, "mine") for u in cases] + [("http://b.com/de/", "mine")]
    pages = spark.createDataFrame(rows, "url string, Verdict string").repartition(2)
    rules = {"org/": "allow", "example.org/es/": "block", "example.org/en/1": "block", "com/fr/": "allow", "com/de/": "block"}
    got = urls.judge(pages, rules)
    assert got.columns == ["url", *urls.OUT]
    found = got.collect()
    assert len(found) == len(rows)
    for r in found:
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == cases[r["url"]], r["url"]
    assert urls.judge(pages.limit(0), rules).count() == 0


# --- top-k -----------------------------------------------------------------------------


def test_top_k_against_all_products(spark):
    r = np.random.default_rng(5)
    vectors = [(i, [float(x) for x in np.round(r.normal(size=6), 1)]) for i in range(230)]
    vectors += [(1000, None), (1001, [1.0, None]), (1002, [float("nan"), 1.0]), (1003, [float("inf")]), (1004, []), (None, [1.0])]
    vectors += [(1005, [1.0, 2.0]), (1006, [0.0] * 6), (7, [0.5] * 6)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>").repartition(4)
    sound = [(k, [math.floor(256 * float(np.float32(x))) for x in v]) for k, v in vectors if k is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    got = {}
    for row in topk.top_k(df, df.filter("vec_id % 10 = 0"), k=5, rows=16, spread=3).collect():
        got.setdefault(row["query_id"], {})[row["rank"]] = (row["vec_id"], row["score"])
    want = {}
    for q, v in sound:
        if q % 10 == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w)), k) for k, w in sound if k != q)
            want[q] = {i + 1: (k, -s) for i, (s, k) in enumerate(scored[:5])}
    assert got == want
    few = df.filter("vec_id IN (10, 11)")
    assert topk.top_k(few, few, k=5).count() == 2
    assert topk.top_k(df.limit(0), df, k=5).count() == 0


# --- classifiers -----------------------------------------------------------------------


@pytest.mark.parametrize("key,label,least,threshold", [("op2_quality", "quality", 0.9, 0.3), ("op8_toxicity", "toxic", 0.6, 0.5)])
def test_held_out_accuracy(spark, key, label, least, threshold):
    folder = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r[label] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    got = LLM_QUERIES[key](spark, folder).collect()
    assert len(got) == 1000
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= threshold)
    pairs = [(a["score"], b["score"]) for a in got for b in got if a["held_out"] and b["held_out"] and labels.get(a["doc_id"]) == 1 and labels.get(b["doc_id"]) == 0]
    assert sum((a > b) + (a == b) / 2 for a, b in pairs) / len(pairs) >= least


@pytest.mark.parametrize("module", [quality, toxicity])
def test_classifier_odd_rows(spark, module):
    r = random.Random(1)
    clean = [" ".join(r.choices(["river", "stone", "walks", "under", "green"], k=20)) for _ in range(120)]
    insults = ["idiotic", "worthless", "disgusting", "pathetic"]
    foul = [" ".join(r.choice(insults) if w == "stone" else w for w in t.split()) + " &&& $$$" for t in clean]
    docs = spark.createDataFrame(
        [(i, t, "s") for i, t in enumerate(clean + foul)] + [(None, clean[0], "s"), (500, None, "s"), (501, "", None), (502, "w " * 200_000, "s"), (3, clean[3], "s")],
        "doc_id long, text string, Score string",
    )
    labels = spark.createDataFrame([(i, int(i >= 120)) for i in range(240)] + [(5, None), (None, 1), (9999, 1)], "doc_id long, y int")
    model = module.fit(docs, labels, "y")
    got = module.classify(docs, model)
    assert got.columns == ["doc_id", "text", "score", "predicted"]
    found = got.collect()
    assert len(found) == docs.count() and all(0 <= x["score"] <= 1 for x in found)
    mean = lambda keys: sum(x["score"] for x in found if x["doc_id"] in keys) / len(keys)
    assert mean(range(120, 240)) > mean(range(4, 120)) + 0.3
    assert module.classify(docs.limit(0), model).count() == 0
    nothing = module.fit(docs, labels.limit(0), "y")
    assert nothing is None and module.classify(docs, nothing).count() == docs.count()


def test_labelled_sample_is_bounded_in_rows(spark):
    """A labelled key that holds most rows, with copies and other texts, gives one row."""
    from pyspark.sql import functions as F

    from headwise.llm.sampling import labelled_sample

    rows = [(1, f"text {i % 7}") for i in range(500)] + [(k, f"own {k}") for k in range(2, 12)] + [(20, None)] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    labels = spark.createDataFrame([(k, k % 2) for k in [*range(1, 12), 20]] + [(1, 1)], "doc_id long, quality int")
    chosen, sizes = labelled_sample(docs, labels, "quality", 100)
    got = sorted(((r.y, r.text) for r in chosen.collect()), key=str)
    one = docs.filter("doc_id = 1").orderBy(F.xxhash64("text")).first().text
    assert got == sorted([(1, one), *[(k % 2, f"own {k}") for k in range(2, 12)], (0, None)], key=str)
    assert sizes == {0: 6, 1: 6}
