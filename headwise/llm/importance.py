"""Resampling towards a target distribution by hashed n-gram counts.

Every document is normalised to its words, joined by one separator, and scanned once: the
CRC-32 of the bytes so far is stored where words begin and end. Any n-gram is a substring of
the normalised text, so its CRC follows from two stored prefixes. For a text AB,

    crc(B) = crc(AB) xor shift(crc(A), length of B)

where `shift` appends zero bytes, a linear map over GF(2). Maps for 1, 2, 4, ... bytes are
tables of 256 entries per byte, made by squaring; the bits of the length say which to apply.

Buckets (CRC modulo their number) are counted for the documents and for the target; a
document's weight is the sum of its features' log ratios, in thousandths. Gumbel noise from
the document's id turns a draw in proportion to the weights into a choice of the highest sums.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
import hashlib
from itertools import accumulate
import math
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from headwise.llm.common import cut, without

SCANNED = ("n_words", "n_features", "features")
SCORED = ("weight", "score")
FLUSH = 500_000  # words whose substrings are derived at once
# Bytes that are no part of a word become blanks; A-Z become lower case.
_FOLD = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
    for b in range(256)
)
_POLYNOMIAL = 0xEDB88320  # of CRC-32, bits reversed


def words_of(text: str | None) -> list[bytes]:
    """Maximal runs of ASCII letters, digits and non-ASCII characters, A-Z lower-cased."""
    return text.encode().translate(_FOLD).split() if text else []


@cache
def _shift_table(k: int) -> np.ndarray:
    """Appending 2 ** k zero bytes, per byte of the CRC: four rows of 256 values."""
    basis = np.uint32(1) << np.arange(32, dtype=np.uint32)
    if k:
        half = _shift_table(k - 1)
        return _table_of(_shifted_by(_shifted_by(basis, half), half))
    for _ in range(8):
        basis = basis >> 1 ^ np.where(basis & 1, np.uint32(_POLYNOMIAL), np.uint32(0))
    return _table_of(basis)


def _table_of(images: np.ndarray) -> np.ndarray:
    """Per byte and value, what a linear map with these images of the 32 bits makes of it."""
    table = np.zeros((4, 256), np.uint32)
    value = np.arange(256)
    for byte in range(4):
        for bit in range(8):
            table[byte] ^= np.where(value >> bit & 1, images[8 * byte + bit], 0).astype(np.uint32)
    return table


def _shifted_by(crcs: np.ndarray, table: np.ndarray) -> np.ndarray:
    return table[0][crcs & 255] ^ table[1][crcs >> 8 & 255] ^ table[2][crcs >> 16 & 255] ^ table[3][crcs >> 24]


SHORT = 64  # lengths with a table of their own


@cache
def _short_tables() -> np.ndarray:
    """The maps for 0 to SHORT - 1 bytes, one after the other."""
    basis = np.uint32(1) << np.arange(32, dtype=np.uint32)
    rows = [_table_of(basis)]
    for _ in range(SHORT - 1):
        basis = _shifted_by(basis, _shift_table(0))
        rows.append(_table_of(basis))
    return np.array(rows).ravel()


def shifted(crcs: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRCs after appending that many zero bytes: as many single bytes as the length leaves
    over SHORT by one table, the rest bit by bit."""
    tables, at = _short_tables(), (lengths % SHORT) << 10
    out = tables[at + (crcs & 255)]
    for byte in (1, 2, 3):
        out ^= tables[at + (256 * byte) + (crcs >> (8 * byte) & 255)]
    k = SHORT.bit_length() - 1
    while len(lengths) and int(lengths.max()) >> k:
        some = np.flatnonzero(lengths >> k & 1)
        out[some] = _shifted_by(out[some], _shift_table(k))
        k += 1
    return out


class Prefixes:
    """The stored scan of a batch of documents: per word its length and the running CRC of its
    document's normalised text up to its end."""

    def __init__(self):
        self.after: list[int] = []
        self.sizes: list[int] = []  # bytes up to the end of a word, from the end of the one before
        self.words: list[int] = []  # of each document

    def scan(self, text: str | None) -> None:
        words = words_of(text)
        if words:
            pieces = b"\n ".join(words).split(b"\n")  # the separator goes with the word behind it
            running = accumulate(pieces, lambda crc, piece: crc32(piece, crc), initial=0)
            next(running)
            self.after.extend(running)
            self.sizes.extend(map(len, pieces))
        self.words.append(len(words))

    def crcs(self, longest: int) -> tuple[np.ndarray, np.ndarray]:
        """CRCs of all runs of 1 to `longest` words, and the document each is from."""
        counts = np.array(self.words, np.int64)
        doc = np.repeat(np.arange(len(counts)), counts)
        heads = np.zeros(len(doc), bool)
        heads[(np.cumsum(counts) - counts)[counts > 0]] = True
        after, ends = np.array(self.after, np.uint32), np.cumsum(np.array(self.sizes, np.int64))
        # Where a word begins: after the separator, but for the first of a document.
        raw = ~np.roll(after, 1)
        before = np.where(heads, np.uint32(0), ~(_shift_table(0)[0][(raw ^ 0x20) & 255] ^ raw >> 8))
        starts = np.r_[0, ends][: len(ends)] + ~heads
        found, of = [], []
        for n in range(1, longest + 1):
            first = np.flatnonzero(doc[: len(doc) - n + 1] == doc[n - 1 :]) if len(doc) >= n else np.empty(0, int)
            last = first + n - 1
            found.append(after[last] ^ shifted(before[first], ends[last] - starts[first]))
            of.append(doc[first])
        return np.concatenate(found), np.concatenate(of)


def _batches(texts: Iterator[str | None]) -> Iterator[Prefixes]:
    held = Prefixes()
    for text in texts:
        held.scan(text)
        if len(held.after) >= FLUSH:
            yield held
            held = Prefixes()
    if held.words:
        yield held


def _cells(buckets: int) -> type:
    return np.uint16 if buckets <= 1 << 16 else np.uint32


def scan(docs: DataFrame, longest: int = 2, buckets: int = 10_000, text: str = "text") -> DataFrame:
    """`docs` with n_words, n_features and features: the bucket of every run of 1 to `longest`
    words, packed as 16-bit numbers (32-bit ones from 65,537 buckets on).

    Whole texts are read; a NULL, empty or wordless text has no features. Rows are scanned
    alone: no shuffle, repeated rows stay, an empty table gives an empty result; columns named
    like the new ones are replaced.
    """
    base = without(docs, *SCANNED)
    kinds = (LongType(), LongType(), BinaryType())
    schema = StructType([*base.schema, *[StructField(c, t) for c, t in zip(SCANNED, kinds)]])
    at = [c.lower() for c in base.columns].index(text.lower())
    names = [*base.columns, *SCANNED]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, sizes, packed = [], [], []
            for held in _batches(x.as_py() for x in batch.column(at)):
                crcs, of = held.crcs(longest)
                order = np.argsort(of, kind="stable")  # one run length after the other until here
                cells = (crcs[order] % np.uint32(buckets)).astype(_cells(buckets))
                n = np.bincount(of, minlength=len(held.words))
                words.extend(held.words)
                sizes.extend(n.tolist())
                packed.extend(part.tobytes() for part in np.split(cells, np.cumsum(n)[:-1]))
            arrays = [pa.array(words, pa.int64()), pa.array(sizes, pa.int64()), pa.array(packed, pa.binary())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], names=names)

    return base.mapInArrow(run, schema)


def bucket_counts(scanned: DataFrame, buckets: int) -> DataFrame:
    """(bucket, c): how many features of all rows fall in each bucket. Each task adds up its
    own rows first and sends `buckets` rows at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(buckets, np.int64)
        for batch in batches:
            for x in batch.column(0):
                counts += np.bincount(np.frombuffer(x.as_py(), _cells(buckets)), minlength=buckets)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some])], names=["bucket", "c"])

    return scanned.select("features").mapInArrow(run, "bucket long, c long").groupBy("bucket").agg(F.sum("c").alias("c"))


def fit(scanned: DataFrame, target: DataFrame, buckets: int = 10_000) -> list[int]:
    """The gain of each bucket in thousandths: the log ratio of its smoothed shares in the
    target and in the documents, both scanned. `buckets` numbers of either reach the driver."""
    sides = []
    for side in (scanned, target):
        counts = [0] * buckets
        for r in bucket_counts(side, buckets).collect():
            counts[r["bucket"]] = r["c"]
        sides.append(counts)
    s_all, t_all = map(sum, sides)
    return [
        math.floor(1000 * math.log(float(t + 1) * float(s_all + buckets) / (float(s + 1) * float(t_all + buckets))))
        for s, t in zip(*sides)
    ]


def noise(seed: str, key: object) -> int:
    """Gumbel noise in thousandths from `seed:key`; without a key from `seed:` alone."""
    h = int(hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def score(scanned: DataFrame, gains: list[int], seed: str = "2024", key: str = "doc_id") -> DataFrame:
    """Scanned documents with weight (the sum of their features' gains, 0 without features) and
    score (weight plus noise) in place of the features.

    No shuffle; repeated rows score alike, rows without a key share one noise, an empty table
    gives an empty result; columns named like the new ones are replaced.
    """
    base = without(scanned, *SCORED)
    kept = [c for c in base.columns if c.lower() != "features"]
    added = [StructField(c, LongType()) for c in SCORED]
    schema = StructType([*base.select(*[F.col(f"`{c}`") for c in kept]).schema, *added])
    key_at = [c.lower() for c in kept].index(key.lower())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.array(gains, np.int64)
        for batch in batches:
            cells = (np.frombuffer(x.as_py(), _cells(len(table))) for x in batch.column("features"))
            weight = np.array([int(table[c].sum()) for c in cells], np.int64)
            columns = [batch.column(c) for c in kept]
            luck = np.array([noise(seed, k.as_py()) for k in columns[key_at]], np.int64)
            arrays = [pa.array(x, pa.int64()) for x in (weight, weight + luck)]
            yield pa.RecordBatch.from_arrays([*columns, *arrays], names=[*kept, *SCORED])

    return base.mapInArrow(run, schema)


def draw(
    scored: DataFrame, percent: int = 10, least_words: int = 20, key: str = "doc_id", parts: int | None = None
) -> DataFrame:
    """The rows with `rank`: 1, 2, 3... for the floor(percent * N / 100) highest scores of the N
    rows that have at least `least_words` words, ties to the smaller key (NULL last); NULL for
    the others.

    Rows that tie in both are told apart by their place in the stored table, so that a key that
    holds a third of all rows spreads like any other. The rows are stored once (pass the
    columns that are needed); a quantile sketch leaves out most that cannot be drawn, the
    exact count decides whether it did so rightly, and the rest is sorted by range in `parts`
    parts (as many as a shuffle has) whose sizes, `parts` numbers, give each its first rank. A column named rank is
    replaced; an empty table gives an empty result.
    """
    base = without(scored, "rank", "_row")
    parts = parts or int(base.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = base.columns
    rows = cut(base.withColumn("_row", F.monotonically_increasing_id()), "scored")
    fits = F.col("n_words") >= least_words
    share = min(1.0, percent / 100 + 0.01)
    n, bound = rows.filter(fits).agg(
        F.count("*"), F.percentile_approx("score", 1 - share, 10_000)
    ).first()
    most = percent * n // 100
    if not most:
        return rows.select(*names, F.lit(None).cast("long").alias("rank"))
    in_reach = fits & (F.col("score") >= bound)
    if rows.filter(in_reach).count() < most:
        in_reach = fits
    order = [F.desc("score"), F.asc_nulls_last(key), F.asc("_row")]
    schema = StructType([*rows.schema, StructField("_part", LongType()), StructField("_at", LongType())])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            size = batch.num_rows
            added = [pa.array(np.full(size, part)), pa.array(np.arange(n + 1, n + size + 1))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=[*batch.schema.names, "_part", "_at"])
            n += size

    sorted_rows = rows.filter(in_reach).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    placed = cut(sorted_rows.mapInArrow(number, schema), "ranked")
    sizes = {r["_part"]: r["n"] for r in placed.groupBy("_part").agg(F.max("_at").alias("n")).collect()}
    first, begun = {}, 0
    for part in sorted(sizes):  # range partitions are numbered in order
        first[part], begun = begun, begun + sizes[part]
    begins = F.element_at(F.create_map(*[F.lit(x) for kv in first.items() for x in kv]), F.col("_part"))
    ranked = placed.withColumn("rank", begins + F.col("_at"))
    return ranked.select(
        *names, F.when(F.col("rank") <= most, F.col("rank")).alias("rank")
    ).unionAll(rows.filter(F.coalesce(~in_reach, F.lit(True))).select(*names, F.lit(None).cast("long").alias("rank")))


def resample(
    docs: DataFrame, target: DataFrame, longest: int = 2, buckets: int = 10_000, percent: int = 10,
    least_words: int = 20, seed: str = "2024", key: str = "doc_id", text: str = "text",
) -> DataFrame:
    """The drawn documents alone, with all their columns, scores and ranks. Each document is
    scanned once; the scan is stored with the columns of `docs`."""
    scanned = cut(scan(docs, longest, buckets, text), "scan")
    gains = fit(scanned, scan(target.select(text), longest, buckets, text), buckets)
    return draw(score(scanned, gains, seed, key), percent, least_words, key).filter("rank IS NOT NULL")
