"""Line dedup by winnowing over line hashes. DataFrame functions only.

A run of consecutive lines that holds `min_words` words or more (stretches of other characters
than blanks, tabs and line ends) and equals a run that starts earlier is deleted; the earliest
copy stays. Lines without a word are looked through: they neither make nor break a run, and go
with the run that encloses them. Earlier means: in a document with a smaller key, or further up
in the same one without overlap.

Windows: from every line forwards, and to every line backwards, the fewest lines that hold
`min_words` words. Each window is known by its fingerprint, the minimum of its line hashes,
and the hash of its whole content. Every repeated run holds only such windows that repeat
(so the fingerprints are guaranteed), forward windows carry a match on to the right and
backward windows to the left, and each line of the run lies in one of them: it has
`min_words` words to the end of the run, or from its start, or else the first window of the
run reaches over it. The union of the windows that have an earlier place is therefore the
union of all repeated runs, without comparing pairs of occurrences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from headwise.llm.common import without

MIN_WORDS = 50
OUT = ("n_lines", "n_removed")
_DOC = ["_key", "_body"]


def _lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """One narrow row per line with words: document, position, hash, words. Rows with the same
    key and text are one document here."""
    rows = docs.filter(F.col(text).isNotNull()).select(
        F.col(key).alias("_key"), F.xxhash64(text).alias("_body"),
        F.posexplode(F.split(text, "\n", -1)).alias("_at", "_line"),
    )
    narrow = rows.select(
        *_DOC, "_at", F.xxhash64("_line").alias("_hash"),
        F.regexp_count("_line", F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("_words"),
    ).filter("_words > 0")
    # One shuffle for the distinct rows and both windows.
    return narrow.repartition(*_DOC).groupBy(*_DOC, "_at").agg(
        F.first("_hash").alias("_hash"), F.first("_words").alias("_words")
    )


def _windows(lines: DataFrame, min_words: int) -> DataFrame:
    """All windows: fingerprint, content hash, document, first and last position."""
    by_line = Window.partitionBy(*_DOC).orderBy("_at")
    summed = lines.withColumn("_to", F.sum("_words").over(by_line)).withColumn(
        "_from", F.col("_to") - F.col("_words")
    )
    # Lines that start within the next min_words words, or end within the last ones.
    forward = Window.partitionBy(*_DOC).orderBy("_from").rangeBetween(0, min_words - 1)
    backward = Window.partitionBy(*_DOC).orderBy("_to").rangeBetween(1 - min_words, 0)
    spans = summed.select(
        *_DOC,
        F.when(
            F.max("_to").over(forward) - F.col("_from") >= min_words,
            F.struct(
                F.collect_list("_hash").over(forward).alias("h"), F.col("_at").alias("first"),
                F.max("_at").over(forward).alias("last"),
            ),
        ).alias("_f"),
        F.when(
            F.col("_to") - F.min("_from").over(backward) >= min_words,
            F.struct(
                F.collect_list("_hash").over(backward).alias("h"), F.min("_at").over(backward).alias("first"),
                F.col("_at").alias("last"),
            ),
        ).alias("_b"),
    )
    w = F.col("_w")
    return spans.select(
        *_DOC, F.explode(F.array_compact(F.array("_f", "_b"))).alias("_w")
    ).select(
        F.array_min(w["h"]).alias("_fingerprint"), F.xxhash64(w["h"], F.size(w["h"])).alias("_content"),
        *_DOC, w["first"].alias("_first"), w["last"].alias("_last"),
    )


def repeated_lines(docs: DataFrame, min_words: int = MIN_WORDS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document with repeats: _key, _body (hash of the text), _runs (array of first and
    last position, in order) that are to go."""
    windows = _windows(_lines(docs, key, text), min_words)
    place = F.struct(F.col("_key"), F.col("_body"), F.col("_first").alias("_first"), F.col("_last").alias("_last"))
    earliest = (
        windows.groupBy("_fingerprint", "_content")
        .agg(F.min(place).alias("_origin"), F.count("*").alias("_n"))
        .filter("_n > 1")
        .drop("_n")
    )
    same_doc = F.col("_origin._key").eqNullSafe(F.col("_key")) & (F.col("_origin._body") == F.col("_body"))
    later = F.when(same_doc, F.col("_first") > F.col("_origin._last")).otherwise(
        ~F.col("_origin._key").eqNullSafe(F.col("_key")) | (F.col("_origin._body") < F.col("_body"))
    )
    gone = windows.join(earliest, ["_fingerprint", "_content"]).filter(later).select(*_DOC, "_first", "_last")
    # Merge overlapping and adjoining windows of a document into runs.
    seen = Window.partitionBy(*_DOC).orderBy("_first", "_last").rowsBetween(Window.unboundedPreceding, -1)
    numbered = gone.repartition(*_DOC).distinct().withColumn(
        "_new", F.coalesce(F.col("_first") > F.max("_last").over(seen) + 1, F.lit(True)).cast("int")
    )
    order = Window.partitionBy(*_DOC).orderBy("_first", "_last")
    runs = (
        numbered.withColumn("_run", F.sum("_new").over(order))
        .groupBy(*_DOC, "_run")
        .agg(F.struct(F.min("_first").alias("first"), F.max("_last").alias("last")).alias("_span"))
    )
    return runs.groupBy(*_DOC).agg(F.sort_array(F.collect_list("_span")).alias("_runs"))


def drop_repeated_lines(
    docs: DataFrame, min_words: int = MIN_WORDS, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """`docs` without the lines of later repeated runs, with n_lines (before) and n_removed.

    Lines end at line feeds. A NULL text stays NULL with 0 lines; an empty one has one line.
    Rows that share key and text are one document and are treated alike; of rows with the
    same key and other texts the one with the smaller text hash is the earlier. A NULL key
    is the earliest. A document all of whose lines go keeps its row with an empty text. An
    empty table gives an empty result; columns named like the new ones are replaced. Other
    columns keep their values.
    """
    runs = repeated_lines(docs, min_words, key, text)
    base = without(docs, *OUT)
    lines = F.split(F.col(text), "\n", -1)
    spans = F.coalesce(F.col("_runs"), F.array())
    kept = F.filter(lines, lambda x, i: ~F.exists(spans, lambda r: (i >= r["first"]) & (i <= r["last"])))
    removed = F.aggregate(spans, F.lit(0), lambda n, r: n + r["last"] - r["first"] + 1)
    joined = base.withColumns({"_key": F.col(key), "_body": F.xxhash64(text)}).join(
        runs.withColumnsRenamed({"_key": "_run_key", "_body": "_run_body"}),
        F.col("_key").eqNullSafe(F.col("_run_key")) & (F.col("_body") == F.col("_run_body")),
        "left",
    )
    return joined.withColumns(
        {"n_lines": F.coalesce(F.size(lines), F.lit(0)), "n_removed": removed}
    ).select(
        *[
            F.when(F.col("_runs").isNull(), F.col(text)).otherwise(F.array_join(kept, "\n")).alias(text)
            if c == text else F.col(f"`{c}`")
            for c in base.columns
        ],
        *OUT,
    )
