"""Exact top-k inner products by exhaustive term-at-a-time accumulation.

A term is a dimension; its posting list holds the candidates whose component is not zero.
Candidates and queries travel as packed blocks of bounded size. For one pair of blocks, each
dimension scatters the query's weight times its postings into dense score rows, a partition
selection keeps the k best per query, and the selections of all blocks are merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

BLOCK_ROWS = 4096
_PACKED = "_block binary, _ids binary, _rows int, _dims int, _part int"


def _packed(key: str, vector: str, rows: int, spread: int):
    """Blocks of whole vectors: ids and row-major int64 components, zero-padded to the
    longest vector of the block."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int] = []
        vectors: list[np.ndarray] = []
        turn = 0

        def out() -> pa.RecordBatch:
            dims = max(map(len, vectors))
            dense = np.zeros((len(vectors), dims), np.int64)
            for i, v in enumerate(vectors):
                dense[i, : len(v)] = v
            data = [[dense.tobytes()], [np.array(ids, np.int64).tobytes()], [len(ids)], [dims], [turn % spread]]
            types = [pa.binary(), pa.binary(), pa.int32(), pa.int32(), pa.int32()]
            return pa.RecordBatch.from_arrays(
                [pa.array(x, t) for x, t in zip(data, types)], names=["_block", "_ids", "_rows", "_dims", "_part"]
            )

        for batch in batches:
            values, keys = batch.column(vector), batch.column(key)
            for i in range(batch.num_rows):
                v = np.asarray(values[i].values.to_numpy(zero_copy_only=False), np.float64)
                if turn == 0 and not ids:
                    turn = keys[i].as_py() % spread  # blocks of different tasks spread
                ids.append(keys[i].as_py())
                vectors.append(np.floor(256 * v).astype(np.int64))
                if len(ids) == rows:
                    yield out()
                    ids, vectors, turn = [], [], turn + 1
        if ids:
            yield out()

    return pack


def accumulate(weights: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Scores of all candidates (rows) for all queries (rows), one term after the other."""
    scores = np.zeros((len(weights), len(candidates)), np.int64)
    for d in range(min(weights.shape[1], candidates.shape[1])):
        postings = np.flatnonzero(candidates[:, d])
        asking = np.flatnonzero(weights[:, d])
        if len(postings) == len(candidates):
            scores[asking] += weights[asking, d, None] * candidates[:, d]
        elif len(postings):
            scores[np.ix_(asking, postings)] += weights[asking, d, None] * candidates[postings, d]
    return scores


def _best(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                q = np.frombuffer(r["_block"], np.int64).reshape(r["_rows"], r["_dims"])
                c = np.frombuffer(r["c_block"], np.int64).reshape(r["c_rows"], r["c_dims"])
                q_ids, c_ids = np.frombuffer(r["_ids"], np.int64), np.frombuffer(r["c_ids"], np.int64)
                order = np.argsort(c_ids, kind="stable")  # ties go to the smaller id
                c, c_ids = c[order], c_ids[order]
                for at in range(0, len(q), 64):
                    yield _select(accumulate(q[at : at + 64], c), q_ids[at : at + 64], c_ids, k)

    return run


def _select(scores: np.ndarray, q_ids: np.ndarray, c_ids: np.ndarray, k: int) -> pa.RecordBatch:
    """The k best of each row by partition selection; everything that ties with the k-th is
    looked at, so that the smaller ids win."""
    out_q, out_c, out_s = [], [], []
    for row, query in zip(scores, q_ids):
        others = np.flatnonzero(c_ids != query)
        row = row[others]
        if len(row) > k:
            least = np.partition(row, len(row) - k)[len(row) - k]
            keep = np.concatenate((np.flatnonzero(row > least), np.flatnonzero(row == least)))[:k]
        else:
            keep = np.arange(len(row))
        out_q.append(np.full(len(keep), query))
        out_c.append(c_ids[others[keep]])
        out_s.append(row[keep])
    data = [np.concatenate(x) if x else np.empty(0, np.int64) for x in (out_q, out_c, out_s)]
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in data], names=["query_id", "vec_id", "score"])


def top_k(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 5,
    key: str = "vec_id",
    vector: str = "embedding",
    spread: int = 64,
    rows: int = BLOCK_ROWS,
) -> DataFrame:
    """The k highest integer inner products of every query with all rows of another key:
    query_id, rank (from 1), vec_id, score; ties to the smaller key.

    Components become floor(256 * x), x as double. Rows without a key, and vectors that are
    NULL or hold a NULL or non-finite component, take no part. Vectors of different length
    are compared over their common dimensions (a missing component is 0). Repeated keys are
    separate candidates, except for the query's own key; a key that is asked twice is
    answered once per distinct vector row. An empty table gives no rows. Exact while
    |inner product| < 2 ** 63.

    Work is spread over `spread` groups of candidate blocks; each meets all query blocks.
    A block has at most `rows` vectors, and score rows are held for 64 queries at a time.
    """
    sound = F.col(vector).isNotNull() & F.col(key).isNotNull() & F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf"))
    )

    def blocks(df: DataFrame, ways: int) -> DataFrame:
        narrow = df.filter(sound).select(F.col(key).cast("long").alias(key), vector)
        return narrow.mapInArrow(_packed(key, vector, rows, ways), _PACKED)

    candidates = blocks(vectors, spread).select(
        F.col("_block").alias("c_block"), F.col("_ids").alias("c_ids"),
        F.col("_rows").alias("c_rows"), F.col("_dims").alias("c_dims"), "_part",
    )
    # Every group of candidate blocks gets a copy of every query block.
    asked = blocks(queries, 1).drop("_part").withColumn(
        "_part", F.explode(F.sequence(F.lit(0), F.lit(spread - 1)))
    )
    found = asked.join(candidates, "_part").mapInArrow(_best(k), "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(best))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
