"""From raw documents to a mixed training corpus: five stages, each over all that the one
before has kept, each written as Parquet and read again.

1. quality: documents that the classifier rejects go.
2. line_dedup: lines of later repeated runs of 50 words or more go; a document keeps its row
   (n_chars follows the text).
3. near_dedup: of the documents linked by a similarity of 0.8 or more, the one with the
   smallest doc_id stays.
4. decontaminate: documents that cover a benchmark item go.
5. mix: the rest in the order of the target weights (stream, source_row, block and slot added).

Every stage takes documents with any further columns and keeps them. Rows with a NULL text
count as empty, an empty table passes through, and repeated rows count as copies; each
operator's docstring has the details.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from headwise.llm import lines, quality, similar, tiling
from headwise.llm.common import cut, held_out, table, with_package
from headwise.llm.recipe import mixed
from headwise.sources.store import shared_root

# Jaccard similarity of the sets of five-word shingles, and the bit budget of the SimHash trie
# that proposes pairs beside the other fingerprints.
NEAR_WORDS, NEAR_BITS, NEAR_LEAST = 5, 3, 0.8


@with_package
def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").filter(~held_out("doc_id", 5, 0))
    scored = quality.classify(docs, quality.fit(docs, labels, "quality"))
    return scored.filter("predicted = 1").select(*docs.columns)


@with_package
def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes repeated lines; where n_chars is there, it is counted anew."""
    kept = lines.drop_repeated_lines(docs)
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars")))
    return kept.select(*docs.columns)


@with_package
def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of similar texts: the smallest doc_id (rows without one come
    last), then the smallest text hash. A group is known by its root text, so groups without
    doc_ids, or with the same smallest one, stay apart."""
    groups = cut(similar.similar_texts(docs, NEAR_WORDS, NEAR_BITS, NEAR_LEAST), "near")
    order = F.struct(F.col("_least").isNull().alias("none"), F.col("_least").alias("id"), F.col("_body").alias("body"))
    stay = groups.groupBy("_root").agg(F.min(order).alias("_stay")).select("_stay.id", "_stay.body")
    kept = docs.withColumn("_body", F.xxhash64(F.coalesce("text", F.lit("")))).join(
        stay, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("_body") == F.col("body"))
    )
    return _once(kept, docs.columns)


def _once(kept: DataFrame, columns: list[str]) -> DataFrame:
    """One row per doc_id and text. The join above has already dealt the rows by them."""
    first = Window.partitionBy("doc_id", "_body").orderBy(F.xxhash64(*columns))
    return kept.withColumn("_n", F.row_number().over(first)).filter("_n = 1").select(*columns)


@with_package
def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = tiling.find_contamination(docs, table(spark, sf_dir, "benchmark"))
    return found.filter("NOT contaminated").select(*docs.columns)


@with_package
def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """In the order of the mixture, over the files and within them."""
    return mixed(docs).repartitionByRange("slot", "source_row").sortWithinPartitions("slot", "source_row")


STAGES = [
    ("quality", quality_stage),
    ("line_dedup", line_stage),
    ("near_dedup", near_stage),
    ("decontaminate", benchmark_stage),
    ("mix", mix_stage),
]

# SQL cannot state the classifier or the fingerprints; tests/llm hold the stages against
# brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder, each written below the shared folder."""
    root = f"{shared_root(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for number, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        path = f"{root}/{number}-{name}"
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return docs
