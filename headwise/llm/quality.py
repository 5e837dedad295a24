"""Quality classifier: nearest-neighbour voting over latent-semantic vectors.

Terms of a text are its words without their affixes in lower case, the affixes of other
signs, capitals, digits, and how often its words repeat, in all and at once. They are hashed into `dims` term
dimensions, weighted by log frequency and inverse document frequency, and projected on the
leading singular directions of a labelled sample. The sample's vectors are broadcast (at most
`sample` rows of `rank` numbers) and every document's cosines to all of them are computed as
blocked matrix products. The `neighbours` closest vote with their labels, weighted by a power
of their similarity.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
import math
from operator import eq
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from headwise.llm.common import without
from headwise.llm.sampling import labelled_sample

OUT = ("score", "predicted")
BLOCK = 256
_WORD = re.compile(r"^([^\w]*)(.*?)([^\w]*)$", re.S)


@dataclass(frozen=True)
class Settings:
    """sample: labelled rows that are fitted at most, half of them per label where there are
    as many; dims: hashed terms; rank: latent directions."""

    sample: int = 3000
    dims: int = 4096
    rank: int = 64
    neighbours: int = 25
    power: float = 20.0
    style_weight: float = 3.0
    threshold: float = 0.3


STYLE = 512  # term dimensions for everything but words


def _hash(term: str) -> int:
    return zlib.crc32(term.encode()) % STYLE


def _hash_word(word: str, dims: int) -> int:
    return STYLE + zlib.crc32(word.encode()) % (dims - STYLE)


def word_terms(word: str, dims: int) -> tuple[int, ...]:
    before, core, after = _WORD.match(word).groups()
    found, terms = [], []
    if core:
        found.append(_hash_word(core.lower(), dims))
        if len(core) > 1 and core.isupper():
            terms.append("capitals")
        if any(c.isdigit() for c in core):
            terms.append("digits")
    if before:
        terms.append("b:" + before[:8])
    if after:
        terms.append("a:" + after[:8])
    return (*found, *[_hash(t) for t in terms])


class Terms:
    """Term counts of whole texts; remembers the terms of words, up to a fixed number."""

    def __init__(self, dims: int, keep: int = 200_000):
        self.dims, self.keep, self.known = dims, keep, {}

    def counts(self, text: str | None) -> np.ndarray:
        sequence = (text or "").split()
        words = Counter(sequence)
        if len(self.known) > self.keep:
            self.known.clear()
        known, ids, n = self.known, [], []
        for word, times in words.items():
            terms = known.get(word)
            if terms is None:
                terms = known[word] = word_terms(word, self.dims)
            ids.extend(terms)
            n.extend([times] * len(terms))
        total = len(sequence)
        twice = sum(map(eq, sequence, sequence[1:]))
        repeats = int(2 * math.log2(total / len(words))) if words else -1
        ids += [_hash(f"repeats:{repeats}"), _hash(f"length:{total.bit_length()}")]
        n += [1, 1]
        if twice:
            ids += [_hash("twice"), _hash(f"twice:{int(8 * twice / total)}")]
            n += [twice, 1]
        return np.bincount(ids, weights=n, minlength=self.dims).astype(np.float32)


@dataclass(frozen=True)
class Model:
    settings: Settings
    projection: np.ndarray  # dims x rank, term weights included
    vectors: np.ndarray  # sample x rank, unit length
    labels: np.ndarray
    weights: np.ndarray  # per row, undoes the equal share of labels

    def vectors_of(self, counts: np.ndarray) -> np.ndarray:
        return _unit(np.log1p(counts) @ self.projection)

    def score(self, counts: np.ndarray) -> np.ndarray:
        s = self.settings
        cosines = self.vectors_of(counts) @ self.vectors.T
        k = min(s.neighbours, cosines.shape[1])
        near = np.argpartition(-cosines, k - 1, axis=1)[:, :k]
        similar = np.clip(np.take_along_axis(cosines, near, axis=1), 1e-6, None).astype(np.float64) ** s.power
        votes = similar * self.weights[near]
        return (votes * self.labels[near]).sum(1) / votes.sum(1)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def leading_directions(rows: np.ndarray, rank: int, rounds: int = 8) -> np.ndarray:
    """The leading right singular directions by subspace iteration: next to the rows it needs
    only a few columns, and no matrix of all row pairs."""
    width = min(rank + 16, *rows.shape)
    basis = np.random.default_rng(0).standard_normal((rows.shape[1], width)).astype(np.float32)
    for _ in range(rounds):
        basis = np.linalg.qr(rows.T @ (rows @ np.linalg.qr(basis)[0]))[0]
    _, strength, turn = np.linalg.svd(rows @ basis, full_matrices=False)
    kept = max(1, min(rank, int((strength > 1e-5 * max(strength[0], 1e-12)).sum())))
    return basis @ turn[:kept].T


def fit_counts(counts: np.ndarray, labels: np.ndarray, share: float, settings: Settings) -> Model:
    """Term weights, latent directions and vectors. The counts are overwritten.

    share: the share of label 1 among all labelled rows, which the votes are weighted to."""
    idf = np.log((1 + len(counts)) / (1 + np.count_nonzero(counts, axis=0))).astype(np.float32)
    idf[:STYLE] *= settings.style_weight
    weighted = np.log1p(counts, out=counts)
    weighted *= idf
    weighted /= np.maximum(np.linalg.norm(weighted, axis=1, keepdims=True), 1e-12)
    directions = leading_directions(weighted, settings.rank)
    ours = labels.mean() if len(labels) else 0.5
    odd = {1: share / max(ours, 1e-9), 0: (1 - share) / max(1 - ours, 1e-9)}
    weights = np.array([max(odd[int(y)], 1e-6) for y in labels])
    return Model(
        settings, (idf[:, None] * directions).astype(np.float32), _unit(weighted @ directions), labels, weights
    )


def fit(
    docs: DataFrame, labels: DataFrame, label: str, key: str = "doc_id", text: str = "text", settings: Settings = Settings()
) -> Model | None:
    """Fit on at most `settings.sample` documents with a label 0 or 1 in `labels` (key,
    label), the first by md5 of the key within each label. Their term counts are made on the
    executors. Without any labelled document there is no model."""
    chosen, sizes = labelled_sample(docs, labels, label, settings.sample, key, text)
    if not sizes:
        return None
    dims = settings.dims

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Terms(dims)
        for batch in batches:
            found = []
            for x in batch.column("text"):
                n = terms.counts(x.as_py())
                at = np.flatnonzero(n).astype(np.int32)
                found.append((at.tobytes(), n[at].tobytes()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("y"), batch.column("place"), *[pa.array([f[i] for f in found], pa.binary()) for i in (0, 1)]],
                names=["y", "place", "_at", "_n"],
            )

    sample = chosen.mapInArrow(count, "y int, place string, _at binary, _n binary").collect()
    sample.sort(key=lambda r: (r["place"], r["y"], r["_at"]))
    counts = np.zeros((len(sample), dims), np.float32)
    for i, r in enumerate(sample):
        counts[i, np.frombuffer(r["_at"], np.int32)] = np.frombuffer(r["_n"], np.float32)
    share = sizes.get(1, 0) / sum(sizes.values())
    return fit_counts(counts, np.array([r["y"] for r in sample], np.int64), share, settings)


def classify(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """`docs` with score (0 to 1, higher: label 1 likelier) and predicted (1 from the
    threshold on).

    Whole texts are read. A NULL text counts as empty; an empty one is scored by its
    neighbours as any other. Without a model the score is 0.5. Rows are judged alone: no
    shuffle, repeated rows stay, an empty table gives an empty result; columns named like the
    new ones are replaced.
    """
    base = without(docs, *OUT)
    if model is None:
        return base.withColumns({"score": F.lit(0.5), "predicted": F.lit(1)})
    held = docs.sparkSession.sparkContext.broadcast(model)  # size fixed by the settings
    names = base.columns
    at = next(i for i, c in enumerate(names) if c.lower() == text.lower())
    schema = base.withColumns({"score": F.lit(0.5), "predicted": F.lit(1)}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        terms = Terms(m.settings.dims)
        for batch in batches:
            scores = [np.empty(0)]
            for start in range(0, batch.num_rows, BLOCK):
                texts = batch.column(at).slice(start, BLOCK)
                scores.append(m.score(np.stack([terms.counts(x.as_py()) for x in texts])))
            score = np.clip(np.concatenate(scores), 0.0, 1.0)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(score), pa.array((score >= m.settings.threshold).astype(np.int32))],
                names=[*names, *OUT],
            )

    return base.mapInArrow(run, schema)
