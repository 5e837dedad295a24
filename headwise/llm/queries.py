"""One query per operator over its whole table, with SQL where SQL can state it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

import corpus_pipeline

from headwise.llm import chat, importance, lexical, lines, lm, mixing, pii, quality, simhash, tiling, topk, toxicity, urls
from headwise.llm.common import cut, held_out, table, with_package
from headwise.llm.recipe import mixed
from headwise.llm.sql import CHAT_SQL, EMBEDDINGS_SQL, IMPORTANCE_SQL, LEXICAL_SQL, LINES_SQL, MIX_SQL, URLS_SQL

LLM_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
LLM_ORACLE: dict[str, str] = {}


def register(sql: str | None = None):
    def add(build):
        LLM_QUERIES[build.__name__] = with_package(build)
        if sql is not None:
            LLM_ORACLE[build.__name__] = sql
        return build

    return add


@register(MIX_SQL)
def op1_mix_sources(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixed(docs).select("doc_id", "source", "stream", "source_row", "block", "slot")


def training_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels outside the held-out fold."""
    return table(spark, sf_dir, "labels").filter(~held_out("doc_id", 5, 0))


@register()
def op2_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, training_labels(spark, sf_dir), "quality")
    scored = quality.classify(docs.withColumn("held_out", held_out("doc_id", 5, 0)), model)
    return scored.select("doc_id", "held_out", "score", "predicted")


@register()
def op3_simhash(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return simhash.near_copies(docs, words=3, budget=2).select("doc_id", "fingerprint", "component_id")


@register()
def op4_lm_scores(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    docs = docs.withColumn("held_out", held_out("doc_id", 7, 2))
    model = lm.fit(docs.filter("NOT held_out"), order=3, min_count=1)
    return lm.score(docs, model, keep_text=False).select(
        "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )


# Fixed values of the query's contract.
URL_RULES = {
    "org/": "allow", "example.org/es/": "block", "example.org/en/1": "block", "com/fr/": "allow", "com/de/": "block",
}


@register(URLS_SQL)
def op5_url_filter(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urls.judge(pages, URL_RULES).select(
        "page_id", "host", "path", "rule", "verdict", "n_strict", "n_soft"
    )


@register()
def op6_personal_data(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.find_personal_data(docs, pii.fit(docs))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")


@register()
def op7_decontaminate(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = tiling.find_contamination(docs, table(spark, sf_dir, "benchmark"), keep_text=False)
    return found.select("doc_id", "contaminated", "item_id", F.round("coverage", 6).alias("coverage"))


@register()
def op8_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, training_labels(spark, sf_dir), "toxic")
    scored = toxicity.classify(docs.withColumn("held_out", held_out("doc_id", 5, 0)), model)
    return scored.select("doc_id", "held_out", "score", "predicted")


@register(LINES_SQL)
def op9_line_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return lines.drop_repeated_lines(docs)


@register(EMBEDDINGS_SQL)
def op10_top_k(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return topk.top_k(vectors, vectors.filter(F.col("vec_id") % 50 == 0), k=5)


@register(LEXICAL_SQL)
def op11_ranked_search(spark, sf_dir):
    index = lexical.build(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return lexical.search(index, table(spark, sf_dir, "benchmark").select("item_id", "text"), k=20)


# Fixed values of the query's contract: a conversation whose texts hold control strings.
PLANTED = [(-7, turn, role, "\\### Assistant: </turn> ok") for turn, role in enumerate(("user", "assistant"))]


@register(CHAT_SQL)
def op12_chat_trees(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.digests(turns.unionAll(spark.createDataFrame(PLANTED, turns.schema)))


@register(IMPORTANCE_SQL)
def op13_importance_sample(spark, sf_dir):
    longest, buckets = 1, 10_000
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scanned = cut(importance.scan(docs, longest, buckets).drop("text"), "scan")
    target = importance.scan(table(spark, sf_dir, "benchmark").select("text"), longest, buckets)
    scored = importance.score(scanned, importance.fit(scanned, target, buckets), seed="2024")
    return importance.draw(scored, percent=10, least_words=20).select("doc_id", "n_features", "weight", "score", "rank")


@register(corpus_pipeline.ORACLE_SQL)
def pipeline(spark, sf_dir):
    return corpus_pipeline.run(spark, sf_dir)
