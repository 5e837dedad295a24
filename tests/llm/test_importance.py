"""CRCs of substrings, bucket counts, weights and the draw against plain versions."""

import hashlib
import math
import random
import re
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from headwise.llm import importance

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def grams(text, longest):
    w = words(text)
    return [" ".join(w[i : i + n]).encode() for n in range(1, longest + 1) for i in range(len(w) - n + 1)]


@pytest.mark.parametrize("longest", [1, 2, 5])
def test_crcs_of_substrings(longest):
    r = random.Random(longest)
    texts = ["".join(r.choice("abC Dé9.-_\n日") for _ in range(r.randint(0, 300))) for _ in range(60)]
    texts += ["w" * n for n in (63, 64, 65, 127, 128, 5000)] + [("v" * 200 + " ") * 9, "", "a b"]
    held = importance.Prefixes()
    for t in texts:
        held.scan(t)
    crcs, of = held.crcs(longest)
    got = sorted(zip(of.tolist(), crcs.tolist()))
    assert got == sorted((d, crc32(g)) for d, t in enumerate(texts) for g in grams(t, longest))


def test_shift_appends_zero_bytes():
    r = np.random.default_rng(4)
    lengths = np.array([0, 1, 2, 63, 64, 65, 1000, 70_000, 3])
    heads = [r.bytes(7) for _ in lengths]
    tails = [r.bytes(int(n)) for n in lengths]
    shifted = importance.shifted(np.array([crc32(h) for h in heads], np.uint32), lengths)
    assert [int(x) ^ crc32(t) for x, t in zip(shifted, tails)] == [crc32(h + t) for h, t in zip(heads, tails)]


def plain(docs, target, longest, buckets, percent, least, seed="2024"):
    count = lambda side: np.bincount([crc32(g) % buckets for t in side for g in grams(t, longest)], minlength=buckets)
    s, t = count([x for _, x in docs]), count(target)
    gain = [math.floor(1000 * math.log((int(b) + 1) * (int(s.sum()) + buckets) / ((int(a) + 1) * (int(t.sum()) + buckets)))) for a, b in zip(s, t)]
    rows = []
    for key, text in docs:
        f = grams(text, longest)
        weight = sum(gain[crc32(g) % buckets] for g in f)
        h = int(hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        rows.append([key, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words(text))])
    fit = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for i, r in enumerate(fit[: percent * len(fit) // 100]):
        r[4] = i + 1
    return [tuple(r[:5]) for r in rows]


@pytest.mark.parametrize("longest,buckets,percent", [(1, 50, 30), (2, 10_000, 10), (3, 70_000, 100), (2, 7, 0)])
def test_against_plain_version(spark, longest, buckets, percent):
    r = random.Random(buckets)
    text = lambda n: " ".join(r.choices(["Aa", "b", "c1", "Été", "x_y", "日本", "q"], k=n))
    docs = [(i, text(r.randint(0, 30))) for i in range(300)] + [(None, None), (None, "b " * 9), (500, ""), (501, " .,"), (502, "w " * 20_000)]
    target = [text(8) + " b b" for _ in range(10)] + [None, ""]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    scanned = importance.scan(frame, longest, buckets)
    aims = importance.scan(spark.createDataFrame([(t,) for t in target], "text string"), longest, buckets)
    got = importance.draw(importance.score(scanned, importance.fit(scanned, aims, buckets)), percent, 5)
    found = [tuple(x[c] for c in ("doc_id", "n_features", "weight", "score", "rank")) for x in got.collect()]
    assert sorted(found, key=str) == sorted(plain(docs, target, longest, buckets, percent, 5), key=str)


def test_draw_spreads_a_hot_key(spark):
    """Two thirds of all rows tie in score and key; ranks are still 1, 2, 3 ... over many parts."""
    rows = spark.range(9000).select(
        F.when(F.col("id") % 3 == 0, F.col("id")).otherwise(7).alias("doc_id"), F.lit(30).alias("n_words"),
        F.when(F.col("id") % 3 == 0, F.col("id") % 11).otherwise(5).cast("long").alias("score"), F.lit("old").alias("Rank"),
    )
    got = importance.draw(rows, percent=90, parts=16)
    assert got.columns == ["doc_id", "n_words", "score", "rank"]
    drawn = sorted((r for r in got.collect() if r["rank"]), key=lambda r: r["rank"])
    assert got.count() == 9000 and [r["rank"] for r in drawn] == list(range(1, 8101))
    assert all((-a["score"], a["doc_id"]) <= (-b["score"], b["doc_id"]) for a, b in zip(drawn, drawn[1:]))


def test_odd_tables(spark):
    docs = spark.createDataFrame([(1, "a b c", "x"), (1, "a b c", "x"), (2, None, "y")], "doc_id long, text string, Weight string")
    target = spark.createDataFrame([("a", 1)], "text string, features int")
    got = importance.resample(docs, target, percent=100, least_words=1)
    assert got.columns == ["doc_id", "text", "n_words", "n_features", "weight", "score", "rank"]
    assert sorted(r["rank"] for r in got.collect()) == [1, 2]
    assert importance.resample(docs.limit(0), target).count() == 0
    assert importance.resample(docs, target.limit(0), percent=100, least_words=1).count() == 2
