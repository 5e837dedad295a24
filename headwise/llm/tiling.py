"""Benchmark decontamination by greedy string tiling.

Tokens are runs of letters and digits, lower-cased, so punctuation and line breaks play no
part. Documents and benchmark items are joined on their shared seeds, hashes of `seed`
consecutive tokens. For each pair, running Karp-Rabin matching marks the longest common
unmarked token runs first, from long search lengths down to `seed`, each token at most once
on either side. The marked share of the item is its coverage, in whatever order its
passages stand in the document. A document that covers an item up to the threshold is
contaminated.
"""

from __future__ import annotations

from collections.abc import Iterator
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
import xxhash

from headwise.llm.common import cut, without

SEED = 6
COVERAGE = 0.5
FILTER_BITS = 1 << 24  # of the fixed-size filter of benchmark seeds, 2 MiB
OUT = ("item_id", "coverage", "contaminated")
_TOKEN = re.compile(r"[^\W_]+")
_BASE = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[str]:
    return _TOKEN.findall((text or "").lower())


def _word_codes(words: list[str], known: dict[str, int]) -> np.ndarray:
    """64-bit codes that are the same in every task."""
    if len(known) > 500_000:
        known.clear()
    out = np.empty(len(words), np.uint64)
    for i, w in enumerate(words):
        code = known.get(w)
        if code is None:
            code = known[w] = xxhash.xxh64_intdigest(w)
        out[i] = code
    return out


def rolling(codes: np.ndarray, length: int) -> np.ndarray:
    """Karp-Rabin hashes (modulo 2 ** 64) of all runs of `length` codes."""
    n = len(codes) - length + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(length):
            out = out * _BASE + codes[k : k + n]
    return out


def tile(item: np.ndarray, doc: np.ndarray, least: int) -> int:
    """Tokens of the item that greedy string tiling marks, with tiles of `least` or more."""
    item_free, doc_free = np.ones(len(item), bool), np.ones(len(doc), bool)
    length = len(item)
    while length >= least:
        # The longest tiles of a pass are marked; what they occlude is searched again.
        while found := _matches(item, doc, item_free, doc_free, length):
            longest = max(n for n, _, _ in found)
            for n, i, d in sorted(m for m in found if m[0] == longest):
                if item_free[i : i + n].all() and doc_free[d : d + n].all():
                    item_free[i : i + n] = False
                    doc_free[d : d + n] = False
        length = 0 if length == least else max(length // 2, least)
    return int((~item_free).sum())


def _matches(item, doc, item_free, doc_free, length) -> list[tuple[int, int, int]]:
    """Common runs of unmarked tokens, `length` or more, as far as they go to the right;
    (tokens, start in item, start in doc). Runs start where a run to the left does not."""
    def open_starts(free):
        closed = np.concatenate(([0], np.cumsum(~free)))
        return np.flatnonzero(closed[length:] == closed[:-length]) if len(free) >= length else np.empty(0, int)

    a, b = open_starts(item_free), open_starts(doc_free)
    if not len(a) or not len(b):
        return []
    ha, hb = rolling(item, length)[a], rolling(doc, length)[b]
    b, hb = b[np.isin(hb, ha)], hb[np.isin(hb, ha)]
    places: dict[int, list[int]] = {}
    for at, h in zip(a.tolist(), ha.tolist()):
        places.setdefault(h, []).append(at)
    out = []
    for d, h in zip(b.tolist(), hb.tolist()):
        for i in places[h]:
            if i and d and item_free[i - 1] and doc_free[d - 1] and item[i - 1] == doc[d - 1]:
                continue  # the run began further left
            n = 0
            while (
                i + n < len(item) and d + n < len(doc) and item_free[i + n] and doc_free[d + n]
                and item[i + n] == doc[d + n]
            ):
                n += 1
            if n >= length:
                out.append((n, i, d))
    return out


def _benchmark_seeds(items: DataFrame, seed: int) -> DataFrame:
    """(item_key, seed_hash) of every run of `seed` tokens; items shorter than that have one
    seed for the whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for batch in batches:
            for key, text in zip(batch.column("item_key"), batch.column("item_text")):
                codes = _word_codes(words_of(text.as_py()), known)
                hashes = np.unique(rolling(codes, seed)).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([key.as_py()] * len(hashes), pa.int64()), pa.array(hashes)], names=["item_key", "seed_hash"]
                )

    return items.mapInArrow(run, "item_key long, seed_hash long")


def _filter_of(seeds: DataFrame) -> np.ndarray:
    """A bit set of fixed size with the benchmark's seeds: FILTER_BITS / 64 numbers at most."""
    rows = (
        seeds.select(F.expr(f"seed_hash & {FILTER_BITS - 1}").alias("place"))
        .select(F.expr("place div 64").alias("at"), F.expr("shiftleft(1L, cast(place % 64 AS int))").alias("bit"))
        .groupBy("at")
        .agg(F.bit_or("bit").alias("bits"))
        .collect()
    )
    bits = np.zeros(FILTER_BITS // 64, np.int64)
    for r in rows:
        bits[r["at"]] = r["bits"]
    return bits.view(np.uint64)


def _suspects(docs: DataFrame, bits, seed: int, text: str) -> DataFrame:
    """`docs` with _seeds: the seeds that may be the benchmark's (none: NULL)."""
    schema = docs.withColumn("_seeds", F.array(F.lit(0).cast("long"))).schema
    schema["_seeds"].nullable = True
    names = docs.columns
    at = next(i for i, c in enumerate(names) if c.lower() == text.lower())
    held = docs.sparkSession.sparkContext.broadcast(bits)  # FILTER_BITS, whatever the benchmark

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        table = held.value
        for batch in batches:
            found = []
            for x in batch.column(at):
                hashes = rolling(_word_codes(words_of(x.as_py()), known), seed)
                low = hashes & np.uint64(FILTER_BITS - 1)
                hit = (table[(low >> np.uint64(6)).astype(np.int64)] >> (low & np.uint64(63))) & np.uint64(1)
                hashes = np.unique(hashes[hit == 1])
                found.append(hashes.view(np.int64) if len(hashes) else None)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(found, pa.list_(pa.int64()))], names=[*names, "_seeds"]
            )

    return docs.mapInArrow(run, schema)


def _tiled(pairs: DataFrame, least: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for batch in batches:
            marked, sizes = [], []
            for a, b in zip(batch.column("item_text"), batch.column("_body")):
                item = _word_codes(words_of(a.as_py()), known)
                marked.append(tile(item, _word_codes(words_of(b.as_py()), known), least))
                sizes.append(len(item))
            yield pa.RecordBatch.from_arrays(
                [batch.column("_row"), batch.column("item_id"), pa.array(marked, pa.int64()), pa.array(sizes, pa.int64())],
                names=["_row", "item_id", "_marked", "_size"],
            )

    return pairs.select("_row", "item_id", "item_text", "_body").mapInArrow(
        run, "_row long, item_id long, _marked long, _size long"
    )


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    seed: int = SEED,
    coverage: float = COVERAGE,
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    keep_text: bool = True,
) -> DataFrame:
    """`docs` with item_id (the benchmark item covered most; ties: the smallest id; NULL if no
    seed is shared), coverage (share of its tokens, 0 to 1) and contaminated.

    Whole texts are read. NULL and empty texts share nothing. Items of fewer than `seed`
    tokens cannot be found and count as absent; items that repeat are one candidate each, and
    NULL ids take part as no id at all. Repeated documents are each judged. An empty table
    gives an empty result, an empty benchmark finds nothing; columns named like the new ones
    are replaced. keep_text=False leaves the text column out of the result.

    Documents pass one scan that compares their seeds with a bit set of fixed size; only
    those with a hit are joined with the benchmark, exactly, on the seeds.
    """
    base = without(docs, *OUT)
    items = cut(
        benchmark.select(F.col(item).cast("long").alias("item_id"), F.col(item_text).alias("item_text"))
        .withColumn("item_key", F.monotonically_increasing_id()),
        "benchmark",
    )
    seeds = cut(_benchmark_seeds(items, seed), "seeds")
    marked = _suspects(base, _filter_of(seeds), seed, text)
    if not keep_text:  # the text travels on with suspects only
        marked = marked.withColumn(text, F.when(F.col("_seeds").isNotNull(), F.col(text)))
    marked = cut(marked.withColumn("_row", F.monotonically_increasing_id()), "suspects")
    suspects = marked.filter("_seeds IS NOT NULL")
    met = (
        suspects.select("_row", F.explode("_seeds").alias("seed_hash"))
        .join(seeds, "seed_hash")
        .select("_row", "item_key")
        .distinct()
    )
    pairs = met.join(items, "item_key").join(suspects.select("_row", F.col(text).alias("_body")), "_row")
    share = F.col("_marked") / F.col("_size")
    best = (
        _tiled(pairs, seed)
        .groupBy("_row")
        .agg(F.max(F.struct(share.alias("coverage"), (-F.col("item_id")).alias("minus"))).alias("best"))
        .select("_row", (-F.col("best.minus")).alias("item_id"), F.col("best.coverage").alias("coverage"))
    )
    columns = [F.col(f"`{c}`") for c in base.columns if keep_text or c.lower() != text.lower()]
    judged = suspects.join(best, "_row", "left")
    clean = marked.filter("_seeds IS NULL").withColumns(
        {"item_id": F.lit(None).cast("long"), "coverage": F.lit(None).cast("double")}
    )
    out = None
    for part in (clean, judged):
        part = part.withColumn("coverage", F.coalesce("coverage", F.lit(0.0))).withColumn(
            "contaminated", F.col("coverage") >= coverage
        ).select(*columns, *OUT)
        out = part if out is None else out.unionAll(part)
    return out
