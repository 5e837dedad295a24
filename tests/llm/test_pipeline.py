"""Each stage against brute force on its own input."""

import itertools
import re

import duckdb
import pytest

import corpus_pipeline
from headwise.llm import quality, tiling
from headwise.llm.sql import LINES_SQL, MIX_SQL
from test_tiling import brute_tile

FOLDER = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """(input, output) folders of every stage."""
    root = tmp_path_factory.mktemp("stages")
    before, out = f"{FOLDER}/documents.parquet", {}
    for name, stage in corpus_pipeline.STAGES:
        path = f"{root}/{name}"
        stage(spark, spark.read.parquet(before), FOLDER).write.parquet(path)
        out[name] = (before, path)
        before = path
    return out


def rows(spark, path):
    return {r["doc_id"]: r.asDict() for r in spark.read.parquet(path).collect()}


def sql(query, path):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path if path.endswith('.parquet') else path + '/*.parquet'}'")
    cursor = con.execute(query)
    names = [d[0] for d in cursor.description]
    return {r["doc_id"]: r for r in (dict(zip(names, x)) for x in cursor.fetchall())}


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "near_dedup", "decontaminate", "mix"]


def test_quality(spark, stages):
    before, after = (rows(spark, p) for p in stages["quality"])
    assert all(before[k] == r for k, r in after.items()) and len(after) < len(before)
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    good = [k for k, y in labels.items() if y == 1]
    bad = [k for k, y in labels.items() if y == 0]
    assert all(k in after for k in good)
    assert sum(k in after for k in bad) <= len(bad) / 4


def test_line_dedup(spark, stages):
    before, after = stages["line_dedup"]
    want, got, had = sql(LINES_SQL, before), rows(spark, after), rows(spark, before)
    assert {k: r["text"] for k, r in got.items()} == {k: r["text"] for k, r in want.items()}
    for k, r in got.items():
        changed = r["text"] != had[k]["text"]
        assert r["n_chars"] == (len(r["text"]) if changed else had[k]["n_chars"])
        assert (r["lang"], r["source"]) == (had[k]["lang"], had[k]["source"])


def test_near_dedup(spark, stages):
    before, after = (rows(spark, p) for p in stages["near_dedup"])
    sets = {k: brute_shingles(r["text"], 5) for k, r in before.items()}
    root = {k: k for k in sets}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    links = 0
    for a, b in itertools.combinations(sorted(sets), 2):
        both, least = sets[a] & sets[b], 0.8
        if (len(both) / len(sets[a] | sets[b]) if sets[a] or sets[b] else 1.0) >= least:
            links += sets[a] != sets[b]
            x, y = sorted((find(a), find(b)))
            root[y] = x
    assert links > 0
    assert after == {k: before[k] for k in sets if find(k) == k}


def brute_shingles(text, n):
    words = "".join(c.lower() if c.isascii() else c for c in text or "")
    words = [w for w in re.split("[ \t-\r]+", words) if w]
    return {" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def test_decontaminate(spark, stages):
    before, after = (rows(spark, p) for p in stages["decontaminate"])
    items = [tiling.words_of(r["text"]) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]

    def leaks(text):
        words = tiling.words_of(text)
        grams = {tuple(words[i : i + 6]) for i in range(len(words) - 5)}
        return any(
            brute_tile(item, words, 6) / len(item) >= 0.5
            for item in items
            if any(tuple(item[i : i + 6]) in grams for i in range(len(item) - 5))
        )

    assert after == {k: r for k, r in before.items() if not leaks(r["text"])} and len(after) < len(before)


def test_mix(spark, stages):
    before, after = stages["mix"]
    want, got = sql(MIX_SQL, before), rows(spark, after)
    assert got.keys() == want.keys()
    for k, r in got.items():
        assert all(r[c] == want[k][c] for c in ("stream", "source_row", "block", "slot"))
    assert spark.read.parquet(after).columns == [*COLUMNS, "stream", "source_row", "block", "slot"]


def test_run(spark, stages):
    got = corpus_pipeline.run(spark, FOLDER)
    assert {r["doc_id"]: r.asDict() for r in got.collect()} == rows(spark, stages["mix"][1])


def odd_documents(spark):
    text = "\n".join(" ".join(f"w{i}x{j}" for j in range(30)) for i in range(6))
    data = [
        (1, text, "en", "a", 9, "x", 0.5), (2, text, "en", "src0", 9, "x", 0.5), (2, text, "en", "src0", 9, "x", 0.5),
        (3, None, None, None, None, None, None), (4, "", "en", "src1", 0, "y", 0.1), (None, "some words here", "en", "a", 15, "z", 0.0),
        (5, "long words " * 40_000, "en", "a", 440_000, "x", 0.1), (6, "other text", "en", None, 10, None, None),
    ]
    return spark.createDataFrame(
        data, "doc_id long, text string, lang string, source string, n_chars long, component_id string, score double"
    ).withColumnsRenamed({"component_id": "fingerprint", "score": "coverage"})


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_odd_rows(spark, name, stage):
    docs = odd_documents(spark)
    got = stage(spark, docs, FOLDER)
    assert got.columns[: len(docs.columns)] == docs.columns
    kept = [r["doc_id"] for r in got.collect()]
    want = {
        "line_dedup": [1, 2, 2, 3, 4, None, 5, 6], "near_dedup": [1, 3, None, 5, 6],
        "decontaminate": [1, 2, 2, 3, 4, None, 5, 6], "mix": [1, 2, 2, 3, 4, None, 5, 6],
    }
    if name in want:
        assert sorted(kept, key=str) == sorted(want[name], key=str)
    assert stage(spark, docs.limit(0), FOLDER).count() == 0
