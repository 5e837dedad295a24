"""Groups of texts whose word shingles have a Jaccard similarity of `least` or more.

Fingerprints propose pairs, the shingle sets decide. Pairs are proposed by

* the trie self-join of `simhash.py` at a small bit budget: each fingerprint with the first
  one within the budget, and each text with the first one of an equal fingerprint;
* BANDS further fingerprints per text, each a hash of ROWS minima of its shingle hashes: two
  texts of similarity s share one of them with probability 1 - (1 - s^ROWS)^BANDS, which is
  0.994 at 0.8 and above 0.999 from 0.85 on. One SimHash cannot do this: at 0.8 the angle is
  worth about ten of its 64 bits.

Of a shared fingerprint each text is first held against the first one, and what passes is
linked; after that only texts that are not yet in one component are held against each other.
A large group of near copies so costs as many comparisons as it has texts.

Texts are known by their 64-bit hash, shingles too.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
import xxhash

from headwise.llm import simhash
from headwise.llm.common import cut
from headwise.llm.graph import components

BANDS, ROWS = 28, 8
BLOCK = 2048
KEPT = 64  # shingle sets that a task remembers while comparing
_TURNS = np.random.default_rng(8).integers(0, 1 << 64, (2, BANDS * ROWS), np.uint64)
_FACTORS, _ADDENDS = _TURNS[0] | np.uint64(1), _TURNS[1]


def bands(hashes: np.ndarray) -> list[int]:
    """The BANDS fingerprints of a text, given its shingle hashes. Without any, all are those
    of the empty text."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), BLOCK):
        turned = hashes[at : at + BLOCK, None] * _FACTORS
        turned += _ADDENDS
        np.minimum(least, turned.min(0), out=least)
    rows = least.reshape(BANDS, ROWS)
    return [xxhash.xxh64_intdigest(row.tobytes(), i) - (1 << 63) for i, row in enumerate(rows)]


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sorted sets; two empty ones are equal."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


def _marks(rows: DataFrame, words: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps, found = [], []
            for x in batch.column("_text"):
                hashes = simhash.shingle_hashes(x.as_py(), words)
                fps.append(simhash.majority(hashes))
                found.append(bands(hashes))
            yield pa.RecordBatch.from_arrays(
                [batch.column("_key"), batch.column("_body"), pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(found, pa.list_(pa.int64()))],
                names=["_key", "_body", "fp", "bands"],
            )

    kind = rows.schema["_key"].dataType.simpleString()
    return rows.mapInArrow(run, f"_key {kind}, _body long, fp long, bands array<long>")


def _verified(pairs: DataFrame, texts: DataFrame, words: int, least: float) -> DataFrame:
    """Those pairs of text hashes (a, b) whose shingles are similar enough."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: OrderedDict[int, np.ndarray] = OrderedDict()

        def shingles(body: int, text: pa.Scalar) -> np.ndarray:
            if body not in known:
                if len(known) >= KEPT:
                    known.popitem(last=False)
                known[body] = np.unique(simhash.shingle_hashes(text.as_py(), words))
            known.move_to_end(body)
            return known[body]

        for batch in batches:
            a, b = (batch.column(i).to_pylist() for i in (0, 1))
            near = [
                jaccard(shingles(x, s), shingles(y, t)) >= least for x, y, s, t in zip(a, b, batch.column(2), batch.column(3))
            ]
            yield batch.select([0, 1]).filter(pa.array(near, pa.bool_()))

    second = texts.select(F.col("_body").alias("b"), F.col("_text").alias("_t"))
    first = texts.select(F.col("_body").alias("a"), F.col("_text").alias("_s"))
    joined = pairs.join(second, "b").join(first, "a").select("a", "b", "_s", "_t")
    return joined.mapInArrow(run, "a long, b long")


def similar_texts(
    docs: DataFrame, words: int, budget: int, least: float, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(_body, _root, _least): per distinct text its hash, the smallest text hash that can be
    reached over links of similar texts, and the smallest key of its rows (NULL if none has
    one). NULL counts as the empty text."""
    rows = docs.select(F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_text")).withColumn(
        "_body", F.xxhash64("_text")
    )
    leaves = cut(_marks(rows, words).groupBy("_body", "fp", "bands").agg(F.min("_key").alias("_least")), "similar-marks")

    # Texts that share a fingerprint, each with the first text of it.
    dealt = leaves.select(F.explode("bands").alias("band"), "_body")
    heads = dealt.groupBy("band").agg(F.min("_body").alias("_head"), F.count("*").alias("n")).filter("n > 1").drop("n")
    shared = cut(dealt.join(heads, "band"), "similar-bands")

    by_fp = cut(leaves.groupBy("fp").agg(F.min("_body").alias("_head")), "similar-leaves")
    close = simhash.linked(by_fp.select("fp"), budget, direct=True)
    x, y = (by_fp.select(F.col("fp").alias(c), F.col("_head").alias(f"_{c}")) for c in "ab")
    proposed = (
        shared.select(F.col("_head").alias("x"), F.col("_body").alias("y"))
        .unionAll(leaves.join(by_fp, "fp").select("_head", "_body"))
        .unionAll(close.join(x, "a").join(y, "b").select("_a", "_b"))
    )
    first = cut(
        proposed.filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(),
        "similar-pairs",
    )
    # One row, that of the smallest key, gives the text; rows may repeat even so.
    named = first.select(F.col("a").alias("_body")).unionAll(first.select("b")).distinct().join(leaves, "_body")
    whole = rows.join(
        named.select(F.col("_body").alias("_b"), F.col("_least").alias("_k")),
        (F.col("_body") == F.col("_b")) & F.col("_key").eqNullSafe(F.col("_k")),
    )
    texts = cut(whole.groupBy("_body").agg(F.first("_text").alias("_text")), "similar-texts")
    links = cut(_verified(first, texts, words, least), "similar-links")

    # What the first texts have not brought together: all pairs across components.
    held = shared.join(components(links), F.col("_body") == F.col("node"), "left").select(
        "band", "_body", F.coalesce("root", "_body").alias("_root")
    )
    mixed = held.groupBy("band").agg(F.min("_root").alias("lo"), F.max("_root").alias("hi")).filter("lo <> hi")
    open_ = cut(held.join(mixed.select("band"), "band"), "similar-open")
    one = open_.select("band", F.col("_body").alias("a"), F.col("_root").alias("_r"))
    other = open_.select("band", F.col("_body").alias("b"), F.col("_root").alias("_q"))
    second = one.join(other, "band").filter("a < b AND _r <> _q").select("a", "b").distinct().join(first, ["a", "b"], "left_anti")
    links = links.unionAll(cut(_verified(second, texts, words, least), "similar-links"))
    roots = components(links)
    return leaves.join(roots, leaves["_body"] == roots["node"], "left").select(
        "_body", F.coalesce("root", "_body").alias("_root"), "_least"
    )
