import random

import numpy as np
import pytest

from headwise.llm import tiling


def brute_tile(item, doc, least):
    """Greedy string tiling by its definition: one longest common free run after the other."""
    fi, fd = [True] * len(item), [True] * len(doc)
    while True:
        best = None
        for i in range(len(item)):
            for d in range(len(doc)):
                n = 0
                while i + n < len(item) and d + n < len(doc) and fi[i + n] and fd[d + n] and item[i + n] == doc[d + n]:
                    n += 1
                if n >= least and (best is None or (-n, i, d) < best):
                    best = (-n, i, d)
        if best is None:
            return sum(not x for x in fi)
        for k in range(-best[0]):
            fi[best[1] + k] = fd[best[2] + k] = False


@pytest.mark.parametrize("seed", range(40))
def test_tile_against_brute_force(seed):
    r = random.Random(seed)
    letters = r.choice([2, 4, 30])
    item = [r.randrange(letters) for _ in range(r.randint(0, 24))]
    doc = [r.randrange(letters) for _ in range(r.randint(0, 40))]
    if seed % 2 and len(item) > 10:  # reordered pieces of the item
        doc = doc[:9] + item[6:] + doc[:3] + item[:6] + doc[9:]
    for least in (2, 3, 5):
        got = tiling.tile(np.array(item, np.uint64), np.array(doc, np.uint64), least)
        assert got == brute_tile(item, doc, least)


def numbered(n, start=0):
    return [f"w{start + i}" for i in range(n)]


def test_find_contamination(spark):
    item = numbered(40)
    reordered = numbered(12, 500) + item[20:] + numbered(5, 600) + item[:20]
    rows = [
        (1, " ".join(item).upper() + "!", "s", 1.5, 7), (2, " ".join(reordered), "s", 0.0, 8),
        (3, " ".join(item[:10] + numbered(30, 700)), None, 0.0, 9), (4, None, "s", 0.0, 1), (5, "", "s", 0.0, 1),
        (None, ", ".join(item), "s", 0.0, 1), (1, " ".join(item).upper() + "!", "s", 1.5, 7),
        (6, " ".join(numbered(60_000, 10_000) + item), "s", 0.0, 1), (7, "a b c", "s", 0.0, 1),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, coverage double, Item_id long")
    bench = spark.createDataFrame(
        [(9, " ".join(item)), (8, " ".join(item)), (7, "a b c"), (6, None), (None, " ".join(item[:30]))], "item_id long, text string"
    )
    got = tiling.find_contamination(docs, bench)
    assert got.columns == ["doc_id", "text", "source", "item_id", "coverage", "contaminated"]
    found = sorted(((r["doc_id"] or 0, r["item_id"], round(r["coverage"], 3), r["contaminated"]) for r in got.collect()), key=str)
    assert found == sorted(
        [
            (1, 8, 1.0, True), (1, 8, 1.0, True), (2, 8, 1.0, True), (3, None, 0.333, False), (4, None, 0.0, False),
            (5, None, 0.0, False), (0, 8, 1.0, True), (6, 8, 1.0, True), (7, None, 0.0, False),
        ],
        key=str,
    )
    assert tiling.find_contamination(docs.limit(0), bench).count() == 0
    none = tiling.find_contamination(docs, bench.limit(0)).collect()
    assert len(none) == len(rows) and not any(r["contaminated"] for r in none)


def test_query_against_brute_force(spark):
    from headwise.llm.queries import LLM_QUERIES

    folder = "/root/testdata/sf0.001"
    items = {r["item_id"]: tiling.words_of(r["text"]) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()}
    docs = {r["doc_id"]: tiling.words_of(r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    want = {}
    for key, words in docs.items():
        grams = {tuple(words[i : i + 6]) for i in range(len(words) - 5)}
        covered = []
        for item_id, item in items.items():
            if any(tuple(item[i : i + 6]) in grams for i in range(len(item) - 5)):
                covered.append((brute_tile(item, words, 6) / len(item), -item_id))
        best = max(covered, default=(0.0, None))
        want[key] = (best[0] >= 0.5, None if best[1] is None else -best[1], round(best[0], 6))
    got = {
        r["doc_id"]: (r["contaminated"], r["item_id"], r["coverage"])
        for r in LLM_QUERIES["op7_decontaminate"](spark, folder).collect()
    }
    assert got == want
