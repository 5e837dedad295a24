"""A bounded labelled sample for the classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, sample: int, key: str = "doc_id", text: str = "text"
) -> tuple[DataFrame, dict[int, int]]:
    """(y, place, text) of at most `sample` labelled documents, and how many documents have
    each label in all. Half of the sample per label where there are as many, the first by md5
    of the key (place). NULL labels and labels of no document are left out.

    The choice is made on keys alone; only the chosen keys, `sample` at most, go to the texts.
    Of the rows that repeat a chosen key one text stays, the one with the smallest hash, so the
    rows are bounded as the keys are (a key with both labels counts for each).
    """
    named = labels.filter(F.col(label).isin(0, 1) & F.col(key).isNotNull()).select(key, F.col(label).cast("int").alias("y"))
    known = named.distinct().join(docs.select(key).distinct(), key)
    sizes = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    keyed = known.withColumn("place", F.md5(F.col(key).cast("string").cast("binary")))
    parts = []
    for y in (0, 1):
        most = max(sample // 2, sample - sizes.get(1 - y, 0))
        parts.append(keyed.filter(F.col("y") == y).orderBy("place", key).limit(most))
    chosen = F.broadcast(parts[0].unionAll(parts[1]))  # `sample` keys
    found = docs.select(key, F.col(text).alias("text")).join(chosen, key)
    # Copies are dropped before the shuffle; the hash alone decides, equal hashes are equal texts.
    one = found.groupBy(key, "y", "place").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    return one.select("y", "place", "text"), sizes
