"""Ranked lexical search over a length-stratified index.

A document of n terms has the normaliser m = 75 + (25 * n * N) div L, where N documents hold L
terms in all; the documents of equal m are a stratum. Every task packs its documents into
index blocks of bounded size, files in the shared folder that searching tasks map into memory.
Within a block

* documents stand by stratum, then by id;
* the postings of a term within a stratum stand by descending number of occurrences (tf), so a
  group of equal (stratum, term, tf) is one run of document places.

Score of a document: sum over the query's terms of w * ((1000000000 * tf) div (1000 * tf + 12 * m)).
Within a stratum this depends on tf alone, so an impact is computed once per group, and the
first group of a term bounds what the term can add anywhere in the stratum. The strata of a
block are visited by descending sum of bounds, until the k-th best score so far exceeds the
next sum.

Queries travel in blocks too: files in the shared folder that tasks read one at a time.
"""

from __future__ import annotations

from array import array
import ast
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from headwise.llm.common import cut, without
from headwise.llm.shared_files import map_arrays, write_arrays

BLOCK_TOKENS = 400_000  # terms, with repeats, after which a block is closed
QUERY_ROWS = 256  # queries of a query block
# Bytes that are no part of a term become blanks; A-Z become lower case.
_FOLD = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
    for b in range(256)
)
NO_KEY = np.iinfo(np.int64).max  # places NULL keys behind all others; kept apart by a flag


def terms_of(text: str | None) -> list[bytes]:
    """Maximal runs of ASCII letters, digits and non-ASCII characters, A-Z lower-cased."""
    return text.encode().translate(_FOLD).split() if text else []


@dataclass(frozen=True)
class Index:
    """documents: how many hold a term; terms: all their terms with repeats. blocks: one row (uri,
    places of arrays) per block. vocabulary: (term binary, df long)."""

    documents: int
    terms: int
    blocks: DataFrame
    vocabulary: DataFrame


# --- building ------------------------------------------------------------------------------

# Documents: ids, missing (whether NULL). Strata: m and how many documents. Groups of postings:
# stratum, term, tf and how many; places: their documents. dfs: by term.
_WIDE = ("ids", "missing", "m")
_COUNTS = ("documents", "stratum", "term", "tf", "size", "places", "dfs")  # in as few bytes as they need


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n = total = 0
    for batch in batches:
        for x in batch.column(0):
            size = len(terms_of(x.as_py()))
            n, total = n + (size > 0), total + size
    yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([total])], names=["n", "terms"])


def _block(keys: list[int | None], sizes: list[int], known: dict[bytes, int], stream: array, n: int, total: int) -> dict:
    """The arrays of one block; only documents with terms come here."""
    counts = np.array(sizes, np.int64)
    missing = np.array([k is None for k in keys])
    ids = np.array([NO_KEY if k is None else k for k in keys], np.int64)
    # Exact for counts beyond 64 bits of product.
    m = np.array([75 + 25 * s * n // total for s in sizes], np.int64)
    order = np.lexsort((missing, ids, m))
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    strata, edges = np.unique(m[order], return_index=True)
    words = sorted(known)
    number = np.empty(len(words), np.int64)
    number[[known[w] for w in words]] = np.arange(len(words))
    pairs, tf = np.unique(number[np.frombuffer(stream, np.int32)] * len(order) + np.repeat(place, counts), return_counts=True)
    term, doc = np.divmod(pairs, len(order))
    stratum = np.searchsorted(edges, doc, side="right") - 1
    by = np.lexsort((doc, -tf, stratum * len(words) + term))
    key, tf, doc = (stratum * len(words) + term)[by], tf[by], doc[by]
    begin = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (tf[1:] != tf[:-1])])
    return {
        "words": b"\n".join(words), "ids": ids[order], "missing": missing[order], "m": strata,
        "documents": np.diff(np.r_[edges, len(order)]), "stratum": key[begin] // len(words),
        "term": key[begin] % len(words), "tf": tf[begin], "size": np.diff(np.r_[begin, len(doc)]), "places": doc,
        "dfs": np.bincount(term, minlength=len(words)),
    }


def _pack(n: int, total: int, root: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, sizes, known, stream = [], [], {}, array("i")

        def out() -> pa.RecordBatch:
            block = _block(keys, sizes, known, stream, n, total)
            arrays = {a: block[a] for a in _WIDE} | {a: block[a].astype(np.min_scalar_type(block[a].max())) for a in _COUNTS}
            uri, places = write_arrays(root, {"words": np.frombuffer(block["words"], np.uint8), **arrays})
            return pa.RecordBatch.from_pydict({"uri": [uri], "places": [repr(places)]})

        for batch in batches:
            for key, text in zip(*batch.columns):
                found = terms_of(text.as_py())
                if not found:
                    continue
                for w in dict.fromkeys(found):
                    known.setdefault(w, len(known))
                keys.append(key.as_py())
                sizes.append(len(found))
                stream.extend(map(known.__getitem__, found))
                if len(stream) >= BLOCK_TOKENS:
                    yield out()
                    keys, sizes, known, stream = [], [], {}, array("i")
        if keys:
            yield out()

    return run


def _vocabulary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for uri, places in zip(*batch.columns):
            block = map_arrays(uri.as_py(), ast.literal_eval(places.as_py()))
            columns = [pa.array(block["words"].tobytes().split(b"\n"), pa.binary()), pa.array(block["dfs"], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["term", "df"])


def build(docs: DataFrame, key: str = "doc_id", text: str = "text") -> Index:
    """Index every row of `docs` over its whole text.

    Rows without a term (NULL, empty, separators alone) are in no stratum. Repeated rows and
    repeated keys are documents of their own; a NULL key is kept and orders last. Keys are
    integers. Texts are not shuffled; a lost block is packed again from its rows.
    """
    narrow = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    counts = cut(narrow.select("text").mapInArrow(_count, "n long, terms long").agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("terms"), F.lit(0)).alias("terms")
    ), "lexical-size")
    n, total = counts.first()
    # Beside the table just written, whose files Spark names with their full address.
    root = counts.inputFiles()[0].rpartition("/")[0] + "-blocks"
    made = cut(narrow.mapInArrow(_pack(n, total, root), "uri string, places string"), "lexical")
    # Two small rows a task: the blocks behind them are what takes time.
    blocks = made.repartition(max(1, made.count() // 2))
    vocabulary = blocks.mapInArrow(_vocabulary, "term binary, df long")
    return Index(n, total, blocks, vocabulary.groupBy("term").agg(F.sum("df").alias("df")))


# --- searching -----------------------------------------------------------------------------


def _query_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, found = [], []
        for row, text in zip(*batch.columns):
            terms = terms_of(text.as_py())
            rows.extend([row.as_py()] * len(terms))
            found.extend(terms)
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(found, pa.binary())], names=["_row", "term"])


def _write_queries(root: str):
    """Task: sorted (block, row, term, weight) rows to one file per block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []

        def out() -> pa.RecordBatch:
            words = sorted({r["term"] for r in held})
            number = {w: i for i, w in enumerate(words)}
            arrays = {
                "rows": np.array([r["_row"] for r in held], np.int64),
                "terms": np.array([number[r["term"]] for r in held], np.int64),
                "weights": np.array([r["weight"] for r in held], np.int64),
                "words": np.frombuffer(b"\n".join(words), np.uint8),
            }
            uri, places = write_arrays(root, arrays)
            return pa.RecordBatch.from_pydict({"uri": [uri], "places": [repr(places)]})

        for batch in batches:
            for r in batch.to_pylist():
                if held and held[0]["_part"] != r["_part"]:
                    yield out()
                    held = []
                held.append(r)
        if held:
            yield out()

    return run


class Block:
    """An index block, opened for the words of a query block."""

    def __init__(self, arrays: dict[str, np.ndarray], words: list[bytes]):
        for name in (*_WIDE, *_COUNTS):
            setattr(self, name, arrays[name])
        own = {w: i for i, w in enumerate(arrays["words"].tobytes().split(b"\n"))}
        self.edges = np.r_[0, np.cumsum(self.documents, dtype=np.int64)]
        begin = np.cumsum(self.size, dtype=np.int64) - self.size
        # The groups of the words asked for, by word, stratum and descending tf.
        asked = np.full(len(own), -1, np.int64)
        for i, w in enumerate(words):
            if w in own:
                asked[own[w]] = i
        groups = np.flatnonzero(asked[self.term] >= 0)
        word = asked[self.term[groups]]
        by = np.argsort(word, kind="stable")
        groups = groups[by]
        self.first = np.searchsorted(word[by], np.arange(len(words) + 1))
        self.of, self.begin, self.count = self.stratum[groups].astype(np.int64), begin[groups], self.size[groups].astype(np.int64)
        self.often = self.tf[groups].astype(np.int64)

    def best(self, terms: np.ndarray, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of the k best documents for a query: words by number, once each,
        with their weights times repeats."""
        at, sizes = _ranges(self.first[terms], self.first[terms + 1] - self.first[terms])
        weight, of, tf = np.repeat(weights, sizes), self.of[at], self.often[at]
        tops = np.flatnonzero(np.r_[True, (of[1:] != of[:-1]) | (np.diff(np.repeat(terms, sizes)) != 0)][: len(at)])
        bounds = np.zeros(len(self.m), np.int64)
        np.add.at(bounds, of[tops], weight[tops] * impact(tf[tops], self.m[of[tops]]))
        by = np.argsort(of, kind="stable")
        edges = np.searchsorted(of[by], np.arange(len(self.m) + 1))
        places, scores, least = np.empty(0, np.int64), np.empty(0, np.int64), 1
        for s in np.argsort(-bounds, kind="stable"):
            if bounds[s] < least:  # equal scores may still win by their keys
                break
            mine = by[edges[s] : edges[s + 1]]
            points = weight[mine] * impact(tf[mine], self.m[s])  # once per tf
            postings, n = _ranges(self.begin[at[mine]], self.count[at[mine]])
            total = np.zeros(self.documents[s], np.int64)
            np.add.at(total, self.places[postings] - self.edges[s], np.repeat(points, n))
            found = np.flatnonzero(total)
            places, scores = np.r_[places, found + self.edges[s]], np.r_[scores, total[found]]
            if len(places) > k:
                keep = self.top(places, scores, k)
                places, scores = places[keep], scores[keep]
            if len(places) == k:
                least = int(scores.min())
        return places, scores

    def top(self, places: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
        """Partition selection; among those that tie with the k-th the smaller keys win."""
        least = -np.partition(-scores, k - 1)[k - 1]
        tied = np.flatnonzero(scores == least)
        tied = tied[np.lexsort((self.missing[places[tied]], self.ids[places[tied]]))]
        sure = np.flatnonzero(scores > least)
        return np.r_[sure, tied[: k - len(sure)]]


def _ranges(begin: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places of some runs, one run after the other, and the runs' sizes."""
    ends = np.cumsum(sizes)
    return np.repeat(begin - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0), sizes


def impact(tf, m):
    return 1_000_000_000 * tf // (1000 * tf + 12 * m)


def _search(files: list[tuple[str, list]], k: int):
    """Task: the k best documents of every block for every query; one query block at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                arrays = map_arrays(row["uri"], ast.literal_eval(row["places"]))
                for uri, places in files:
                    asked = map_arrays(uri, places)
                    block = Block(arrays, asked["words"].tobytes().split(b"\n"))
                    edges = np.flatnonzero(np.r_[True, np.diff(asked["rows"]) != 0, True])
                    for a, b in zip(edges[:-1], edges[1:]):
                        found, scores = block.best(asked["terms"][a:b], asked["weights"][a:b], k)
                        columns = [
                            pa.array(np.full(len(found), asked["rows"][a])),
                            pa.array(block.ids[found], mask=block.missing[found]), pa.array(scores),
                        ]
                        yield pa.RecordBatch.from_arrays(columns, names=["_row", "key", "score"])

    return run


def search(
    index: Index, queries: DataFrame, k: int = 20, text: str = "text", key: str = "doc_id"
) -> DataFrame:
    """The k highest-scoring documents with a score above 0 (all, if fewer) of every row of
    `queries`: its columns without the text, then rank (from 1), `key` and score; equal scores by
    ascending key, NULL last.

    A term's weight is floor(1000 * ln((2 N + 2) / (2 df + 1))), counted as often as the query
    repeats the term. NULL, empty and unknown queries have no results; repeated query rows
    have each their own; an empty index or query table gives no rows; query columns named like
    the new ones are replaced. Exact for every index and query: blocks and strata are passed
    over only where no document can be among the best.
    """
    asked = without(queries, "rank", "score", key, "_row", "_part").withColumn("_row", F.monotonically_increasing_id())
    kept = [c for c in asked.columns if c.lower() not in (text.lower(), "_row")]
    asked = cut(asked, "questions")
    terms = asked.select("_row", text).mapInArrow(_query_terms, "_row long, term binary")
    weight = F.floor(1000 * F.log((2.0 * index.documents + 2) / (2.0 * F.col("df") + 1))).cast("long")
    weighed = (
        terms.groupBy("_row", "term").agg(F.count("*").alias("times"))
        .join(index.vocabulary.hint("merge"), "term")  # far larger than the rows it is made from
        .select("_row", "term", (F.col("times") * weight).alias("weight"))
        .filter("weight > 0")
    )
    # Query rows are numbered per file and row, so a block is a run of them.
    numbered = weighed.withColumn("_part", F.expr(f"_row div {QUERY_ROWS}"))
    root = asked.inputFiles()[0].rpartition("/")[0] + "-blocks" if not asked.isEmpty() else ""
    files = [
        (r["uri"], ast.literal_eval(r["places"]))
        for r in numbered.repartition("_part").sortWithinPartitions("_part", "_row", "term")
        .mapInArrow(_write_queries(root), "uri string, places string").collect()
    ] if root else []
    found = index.blocks.mapInArrow(_search(files, k), "_row long, key long, score long")
    best = Window.partitionBy("_row").orderBy(F.desc("score"), F.asc_nulls_last("key"))
    ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.join(asked.select("_row", *[F.col(f"`{c}`") for c in kept]), "_row").select(
        *[F.col(f"`{c}`") for c in kept], "rank", F.col("key").alias(key), "score"
    )
