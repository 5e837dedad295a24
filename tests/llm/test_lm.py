from collections import Counter
import math
import random
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest

from headwise.llm import lm
from headwise.llm.common import tokens
from headwise.llm.elias_fano import Sequence


@pytest.mark.parametrize("n,u", [(1, 1), (1, 2**63), (5, 10), (1000, 1000), (1000, 10**6), (20_000, 2**60), (3, 2**64 - 1)])
def test_sequence_against_sorted_search(n, u):
    r = np.random.default_rng(n)
    values = np.unique(r.integers(0, u, n, dtype=np.uint64, endpoint=True))
    s = Sequence.build(values)
    assert (s.get(np.arange(len(values))) == values).all()
    asked = np.concatenate([values, r.integers(0, u, 500, dtype=np.uint64, endpoint=True), np.array([0, u], np.uint64)])
    want = np.searchsorted(values, asked)
    assert (s.successor(asked) == want).all()
    there = values[np.minimum(want, len(values) - 1)] == asked
    assert (s.find(asked) == np.where(there & (want < len(values)), want, -1)).all()


@pytest.mark.parametrize("n,u", [(20_000, 2**60), (20_000, 30_000), (5_000, 2**63)])
def test_sequence_keeps_nothing_beside_its_arrays(n, u):
    """A worker has thousands of sequences open, whose arrays are mapped files."""
    values = np.unique(np.random.default_rng(n).integers(0, u, n, dtype=np.uint64))
    s = Sequence.build(values)
    mapped = {id(getattr(s, p)) for p in Sequence.PARTS}
    assert (s.get(np.arange(len(values))) == values).all() and (s.find(values) == np.arange(len(values))).all()
    assert all(id(x) in mapped for x in vars(s).values() if isinstance(x, np.ndarray))


def test_empty_sequence():
    s = Sequence.build(np.empty(0, np.uint64))
    assert (s.find(np.array([0, 7], np.uint64)) == -1).all()


def brute(train, order, min_count, discount):
    """Plain dictionaries, unrounded: a function that scores a text."""
    END = b"\n"

    def stream(text):
        return [*(text or "").encode().lower().split(), END]

    grams = [Counter() for _ in range(order + 1)]
    for t in train:
        w = stream(t)
        for i in range(len(w)):
            for k in range(1, order + 1):
                lead = [END, *w[:i]][-(k - 1):] if k > 1 else []
                if len(lead) == k - 1:
                    grams[k][(*lead, w[i])] += 1
    n, v = sum(grams[1].values()), len(grams[1])
    kept = [None, grams[1]] + [Counter({g: c for g, c in grams[k].items() if c >= min_count}) for k in range(2, order + 1)]
    for k in range(3, order + 1):  # a trie: only after nodes that are there
        kept[k] = Counter({g: c for g, c in kept[k].items() if g[:-1] in kept[k - 1]})

    below = {}
    for counted in kept[2:]:
        for g, c in counted.items():
            below.setdefault(g[:-1], []).append(c)

    def left(parent):
        of = kept[len(parent)].get(parent)
        children = below.get(parent)
        return 1 - sum((c - discount) / of for c in children) if children else 1.0

    memo = {}

    def p(context, w):
        key = (context, w)
        if key not in memo:
            if not context:
                memo[key] = (grams[1][(w,)] + 1) / (n + v + 1)
            else:
                c = kept[len(context) + 1].get((*context, w), 0)
                rest = memo.setdefault(context, left(context)) * p(context[1:], w)
                memo[key] = rest + ((c - discount) / kept[len(context)][context] if c else 0.0)
        return memo[key]

    def score(text):
        w, total = stream(text), 0.0
        for i in range(len(w)):
            lead = tuple([END, *w[:i]][-(order - 1):]) if order > 1 else ()
            while lead and not (lead in kept[len(lead)]):
                lead = lead[1:]
            total += math.log10(p(lead, w[i]))
        return len(w), sum((x,) in grams[1] for x in w), n, sum(math.log10((grams[1][(x,)] + 1) / (n + v + 1)) for x in w), total

    return score


@pytest.mark.parametrize("order", [1, 2, 3])
def test_scores_against_dictionaries(spark, order, monkeypatch):
    r = random.Random(order)
    words = [f"w{i}" for i in range(60)] + ["Ä", "the", "THE", "</s>"]
    texts = [" ".join(r.choices(words, [1 / (i + 1) for i in range(len(words))], k=r.randint(0, 60))) for _ in range(80)]
    texts += [None, "", " \n\t", "w1 w2 w3 " * 3000, texts[0], texts[0]]
    train, others = texts[10:], texts[:10] + ["unseen words only", "w1 unseen w2 w3 w1"]
    frame = lambda rows: spark.createDataFrame([(i, t, 1.0) for i, t in enumerate(rows)], "k int, text string, score double")
    model = lm.fit(frame(train).repartition(3), order=order)
    want = brute(train, order, 2, 0.75)
    for rows in (train, others):
        got = lm.score(frame(rows), model)
        assert got.columns == ["k", "text", *lm.OUT]
        for row in got.collect():
            n, known, total, base, full = want(rows[row["k"]])
            assert (row["n_tokens"], row["n_known"], row["train_tokens"]) == (n, known, total)
            assert math.isclose(row["base_score"], base, rel_tol=1e-9)
            # Every probability is one of 256 levels.
            assert abs(row["score"] - full) <= 0.05 * n + 1e-9, (row, full)
    assert lm.score(frame([]), model).count() == 0


@pytest.mark.parametrize("least", [1, 2])
def test_hot_parents_over_many_shards(spark, monkeypatch, least):
    """Parents of over three occurrences count as hot, shards hold few keys."""
    r = random.Random(7)
    words = [f"w{i}" for i in range(40)]
    texts = [" ".join(r.choices(words, [1 / (i + 1) for i in range(40)], k=r.randint(0, 60))) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "k int, text string").repartition(3)
    monkeypatch.setattr(lm, "SHARD_KEYS", 400)
    model = lm.fit(docs, order=3, min_count=least, hot_over=3)
    assert len(model.levels[1].files) > 2 and all(any(x.files) for x in model.hot)
    want = brute(texts, 3, least, 0.75)
    for row in lm.score(docs, model).collect():
        n, _, _, _, full = want(texts[row["k"]])
        assert abs(row["score"] - full) <= 0.05 * n


def test_many_shards_give_the_same_scores(spark, monkeypatch):
    texts = [(i, " ".join(f"x{(i * j) % 31}" for j in range(80))) for i in range(60)]
    docs = spark.createDataFrame(texts, "k int, text string")
    one = {r["k"]: r["score"] for r in lm.score(docs, lm.fit(docs, order=3)).collect()}
    monkeypatch.setattr(lm, "SHARD_KEYS", 400)
    model = lm.fit(docs, order=3)
    assert len(model.levels[1].files) > 4
    many = {r["k"]: r["score"] for r in lm.score(docs, model).collect()}
    assert one.keys() == many.keys() and all(math.isclose(one[k], many[k], abs_tol=1e-6) for k in one)


def test_scoring_takes_little_memory():
    """Beside the stream a flush may hold no more than some 20 numbers per token at once."""
    r = np.random.default_rng(3)
    n = 200_000
    words = r.integers(1, 5000, n).astype(np.int32)
    words[499::500] = 0
    nodes, counts = np.arange(5000), np.bincount(words, minlength=5000) + 1
    parents = np.r_[0, words[:-1]]
    pairs, c = np.unique(parents.astype(np.int64) * 5000 + words, return_counts=True)
    own, begin = np.unique(pairs // 5000, return_index=True)
    edges = np.r_[begin, len(pairs)]
    tops = pairs[edges[1:] - 1] % 5000 + 1
    base = np.repeat(np.cumsum(tops) - tops, np.diff(edges))
    shard = {
        "parents": Sequence.build(own), "pointers": Sequence.build(edges), "children": Sequence.build(base + pairs % 5000 + 1),
        "codes": np.full(len(pairs), 100, np.uint8), "left": np.full(len(own), 50, np.uint8),
    }
    level = lm.Level(0, ((),), (0,))
    model = lm.Model(2, n, 5000, (level, level), (level,), 1, hot_over=n)
    reader = lm.Reader(model)
    reader.levels[1].open[0] = shard
    reader.hot[0].open[0] = {}
    tracemalloc.start()
    scores = reader.score(nodes, counts, words)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(scores) == n and np.isfinite(scores).all()
    assert peak < 20 * 8 * n, peak / n


@pytest.mark.parametrize("flush", [1, 50, 10**6])
def test_streams_against_plain_splitting(monkeypatch, flush):
    texts = ["  Ab\tc \x1cÄb\x85 ", None, "", " \n", "ab AB aB", "\u00a0x\u2003y", "c " * 40, "a\x00b \x0bQ\x0c"]
    monkeypatch.setattr(lm, "PIECE", 16)
    batches = [pa.RecordBatch.from_pydict({"k": [0] * len(t), "t": pa.array(t, pa.string())}) for t in (texts[:3], [], texts[3:])]
    batches.append(pa.RecordBatch.from_pydict({"k": [1, 1], "t": pa.array(["z", *texts[:2]], pa.string()).slice(1)}))
    want = [w for t in (*texts, *texts[:2]) for w in (*tokens(t), lm.END)]
    got = [(known.to_pylist(), stream) for known, stream in lm._streams(iter(batches), flush, 1)]
    assert [known[i] for known, stream in got for i in stream] == want
    assert all(known[0] == lm.END and len(set(known)) == len(known) for known, _ in got)
    counted = Counter()
    for b in lm._count_words(iter([b.select([1]) for b in batches])):
        for w, c in zip(*(b.column(i).to_pylist() for i in (0, 1))):
            counted[w] += c
    assert counted == Counter(want)


def test_scores_without_texts(spark):
    docs = spark.createDataFrame([(1, "a b", 2), (2, None, 3)], "k int, text string, z int")
    model = lm.fit(docs)
    whole, less = lm.score(docs, model), lm.score(docs, model, keep_text=False)
    assert less.columns == ["k", "z", *lm.OUT]
    assert sorted(less.collect()) == sorted(whole.drop("text").collect())


def test_no_training_rows(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "k int, text string")
    got = {r["k"]: r for r in lm.score(docs, lm.fit(docs.limit(0))).collect()}
    assert (got[1]["n_tokens"], got[1]["n_known"], got[1]["score"]) == (3, 0, 0.0) and got[2]["n_tokens"] == 1


def test_shard_expression_agrees(spark):
    keys = [0, 1, 2**31, 2**32, 2**62 + 12345, 2**63 - 1, -1, -(2**63), 987654321987654321]
    df = spark.createDataFrame([(k,) for k in keys], "key long")
    for bits in (0, 1, 5, 20):
        got = [r["s"] for r in df.select(lm._shard_column("key", bits).alias("s")).collect()]
        assert got == lm._shard_of(np.array(keys, np.int64).view(np.uint64), bits).tolist()


def test_query_against_brute_force(spark):
    from headwise.llm.queries import LLM_QUERIES

    folder = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    held = {k: zlib.crc32(str(k).encode()) % 7 == 2 for k in texts}
    want = brute([t for k, t in texts.items() if not held[k]], 3, 1, 0.75)
    gain = 0.0
    for r in LLM_QUERIES["op4_lm_scores"](spark, folder).collect():
        assert r["held_out"] == held[r["doc_id"]]
        if r["doc_id"] % 4 == 0:
            n, known, total, base, full = want(texts[r["doc_id"]])
            assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (n, known, total)
            assert math.isclose(r["base_score"], base, rel_tol=1e-9) and abs(r["score"] - full) < 0.05 * n + 0.01
        if r["held_out"]:
            gain += r["score"] - r["base_score"]
    assert gain > 0


def test_query_keeps_triples_and_what_occurs_once(spark, tmp_path):
    from headwise.llm.queries import LLM_QUERIES

    r = random.Random(9)
    texts = {k: " ".join(f"w{r.randrange(12)}" for _ in range(30)) for k in range(20)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").coalesce(1)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    train = [t for k, t in texts.items() if zlib.crc32(str(k).encode()) % 7 != 2]
    want, less = brute(train, 3, 1, 0.75), brute(train, 2, 2, 0.75)
    got = {x["doc_id"]: x["score"] for x in LLM_QUERIES["op4_lm_scores"](spark, str(tmp_path)).collect()}
    assert all(abs(x - want(texts[k])[4]) < 0.05 * 31 for k, x in got.items())
    assert sum(abs(x - less(texts[k])[4]) > 0.05 * 31 for k, x in got.items()) > 10
