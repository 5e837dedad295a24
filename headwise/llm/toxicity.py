"""Toxicity by compression distance.

Two zstandard dictionaries are trained on a bounded labelled sample. Both begin with the same
content, trained on windows of ordinary text. The toxic one ends with the words that set toxic
text apart, the ordinary one with as many that set ordinary text apart (by the likelihood
ratio of the number of distinct neighbourhoods in which a word occurs, so copies of a
document count once). What a window of a text gains from the toxic dictionary, in bytes,
is therefore due to such words, or to words that share their stems.

Every window of a whole text is compressed with both. The largest gains and the share of
windows that gain enter a logistic curve that is calibrated on sampled rows which the
dictionaries have not seen.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
import zstandard

from headwise.llm.common import cut, without
from headwise.llm.sampling import labelled_sample

OUT = ("score", "predicted")
_BREAK = re.compile(r"[\W_]+")


@dataclass(frozen=True)
class Settings:
    """sample: labelled rows fitted at most, half of them per label where there are as many;
    base: bytes trained on ordinary windows; words: distinguishing words kept at most;
    evidence: least likelihood ratio of a word; contrast: how many times commoner it must be;
    window, step: words; gain: bytes from which a window counts."""

    sample: int = 6000
    base: int = 32768
    base_windows: int = 16000
    words: int = 400
    evidence: float = 30.0
    contrast: float = 8.0
    window: int = 12
    step: int = 10
    gain: int = 3
    threshold: float = 0.5


@dataclass(frozen=True)
class Model:
    settings: Settings
    toxic: bytes
    ordinary: bytes
    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray  # of the features; the last is the intercept


def words_of(text: str | None) -> list[str]:
    return _BREAK.sub(" ", (text or "").lower()).split()


class Gains:
    """Compression lengths of the windows of a text under both dictionaries."""

    def __init__(self, settings: Settings, toxic: bytes, ordinary: bytes):
        self.settings = settings
        p = zstandard.ZstdCompressionParameters(
            strategy=zstandard.STRATEGY_BTLAZY2, min_match=5, target_length=32, window_log=17, hash_log=16,
            chain_log=16, search_log=6, write_content_size=False, write_checksum=False, write_dict_id=False,
        )
        self.by = [
            zstandard.ZstdCompressor(
                compression_params=p,
                dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT),
            )
            for d in (ordinary, toxic)
        ]

    def features(self, text: str | None) -> list[float]:
        s, words = self.settings, words_of(text)
        ordinary, toxic = self.by
        gains = []
        for i in range(0, max(1, len(words) - s.window + s.step), s.step):
            window = f" {' '.join(words[i : i + s.window])} ".encode()
            gains.append(len(ordinary.compress(window)) - len(toxic.compress(window)))
        gains.sort(reverse=True)
        hits = sum(g >= s.gain for g in gains)
        return [gains[0], sum(gains[:2]) / 2, sum(gains[:3]) / 3, hits / len(gains) ** 0.5, min(hits, 3)]


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct words with their neighbours, per row."""
    for batch in batches:
        for y, text in zip(batch.column("y"), batch.column("text")):
            words = words_of(text.as_py())
            seen = list({*zip(["", *words], words, [*words[1:], ""])})
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([y.as_py()] * len(seen), pa.int32()), pa.array([w[1] for w in seen], pa.string()),
                    pa.array([f"{w[0]} {w[2]}" for w in seen], pa.string()),
                ],
                names=["y", "word", "around"],
            )


def _distinguishing(train: DataFrame, settings: Settings) -> tuple[list[str], list[str]]:
    """The words that set toxic, and ordinary, text apart; the most telling last."""
    seen = train.mapInArrow(_contexts, "y int, word string, around string").distinct()
    counts = seen.groupBy("word").agg(
        F.count_if(F.col("y") == 1).alias("a"), F.count_if(F.col("y") == 0).alias("b")
    )
    counts = cut(counts, "toxicity-words")
    n, m = counts.agg(F.sum("a"), F.sum("b")).first()
    if not n or not m:
        return [], []
    a, b = F.col("a"), F.col("b")

    def part(seen_, expected):
        return F.when(seen_ > 0, seen_ * F.log(seen_ / expected)).otherwise(0.0)

    share = (a + b) / F.lit(float(n + m))
    ratio = 2 * (part(a, share * n) + part(b, share * m) + part(n - a, (1 - share) * n) + part(m - b, (1 - share) * m))
    told = counts.filter((F.length("word") > 2) & (a + b >= 3)).withColumn("evidence", ratio)
    toxic = told.filter((a / n > settings.contrast * b / m) & (F.col("evidence") >= settings.evidence))
    top = [r["word"] for r in toxic.orderBy(F.desc("evidence"), "word").limit(settings.words).collect()]
    other = told.filter(a / n < b / m).orderBy(F.desc("evidence"), "word")
    return top[::-1], [r["word"] for r in other.limit(4 * len(top) + 1).collect()][::-1]


def _base(train: DataFrame, settings: Settings) -> bytes:
    """Content trained on windows of ordinary text."""

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column("text"):
                whole = " ".join(words_of(text.as_py())).encode()
                pieces = [whole[i : i + 256] for i in range(0, len(whole), 256)]
                yield pa.RecordBatch.from_arrays([pa.array(pieces, pa.binary())], names=["piece"])

    pieces = train.filter("y = 0").mapInArrow(cut_up, "piece binary").filter(F.length("piece") >= 16)
    chosen = pieces.orderBy(F.md5("piece")).limit(settings.base_windows).collect()
    samples = [bytes(r["piece"]) for r in chosen]
    try:
        return zstandard.train_dictionary(settings.base, samples, k=50, d=8).as_bytes()
    except zstandard.ZstdError:  # too few samples to train on
        return b" ".join(samples)[: settings.base]


def fit(
    docs: DataFrame, labels: DataFrame, label: str, key: str = "doc_id", text: str = "text", settings: Settings = Settings()
) -> Model | None:
    """Fit on at most `settings.sample` documents with a label 0 or 1 in `labels` (key,
    label), the first by md5 of the key within each label. None unless both labels occur."""
    chosen, sizes = labelled_sample(docs, labels, label, settings.sample, key, text)
    if len(sizes) < 2:
        return None
    fold = F.conv(F.substring("place", -1, 1), 16, 10).cast("int") < 5
    rows = cut(chosen.withColumn("calibrate", fold).repartition(12, "place"), "toxicity-sample")
    train = rows.filter("NOT calibrate")
    toxic, ordinary = _distinguishing(train, settings)
    base = _base(train, settings)
    first = f" {' '.join(toxic)} ".encode()
    second = f" {' '.join(ordinary)} ".encode()[-len(first) :]
    dictionaries = (base + first, base + second)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gains = Gains(settings, *dictionaries)
        for batch in batches:
            found = [gains.features(x.as_py()) for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("y"), batch.column("place"), pa.array(found, pa.list_(pa.float64()))], names=["y", "place", "x"]
            )

    seen = rows.filter("calibrate").mapInArrow(measure, "y int, place string, x array<double>").collect()
    seen.sort(key=lambda r: (r["place"], r["x"]))
    x, y = np.array([r["x"] for r in seen]).reshape(len(seen), 5), np.array([r["y"] for r in seen], float)
    share = sizes[1] / sum(sizes.values())
    return Model(settings, *dictionaries, *calibrate(x, y, share))


def calibrate(x: np.ndarray, y: np.ndarray, share: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Logistic weights by Newton steps, with rows weighted to the label's true share."""
    mean = x.mean(0) if len(x) else np.zeros(5)
    spread = np.maximum(x.std(0), 1e-6) if len(x) else np.ones(5)
    z = np.column_stack(((x - mean) / spread, np.ones(len(x))))
    ours = y.mean() if len(y) else 0.5
    w = np.where(y == 1, share / max(ours, 1e-9), (1 - share) / max(1 - ours, 1e-9))
    beta = np.zeros(6)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        gradient = z.T @ (w * (y - p)) - 0.5 * np.r_[beta[:5], 0]
        curve = (z * (w * p * (1 - p))[:, None]).T @ z + np.diag([0.5] * 5 + [1e-3])
        beta = beta + np.linalg.solve(curve, gradient)
    return mean, spread, beta


def classify(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """`docs` with score (0 to 1, higher: toxic likelier) and predicted (1 from the threshold
    on).

    Whole texts are read, in overlapping windows. A NULL text counts as empty; an empty one
    gains nothing and scores accordingly. Without a model the score is 0. Rows are judged
    alone: no shuffle, repeated rows stay, an empty table gives an empty result; columns
    named like the new ones are replaced.
    """
    base = without(docs, *OUT)
    schema = base.withColumns({"score": F.lit(0.5), "predicted": F.lit(1)}).schema
    if model is None:
        return base.withColumns({"score": F.lit(0.0), "predicted": F.lit(0)})
    held = docs.sparkSession.sparkContext.broadcast(model)  # size fixed by the settings
    names = base.columns
    at = next(i for i, c in enumerate(names) if c.lower() == text.lower())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        gains = Gains(m.settings, m.toxic, m.ordinary)
        for batch in batches:
            x = np.array([gains.features(t.as_py()) for t in batch.column(at)]).reshape(batch.num_rows, 5)
            odds = ((x - m.mean) / m.spread) @ m.weights[:5] + m.weights[5]
            score = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(score), pa.array((score >= m.settings.threshold).astype(np.int32))],
                names=[*names, *OUT],
            )

    return base.mapInArrow(run, schema)
