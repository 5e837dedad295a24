"""Mixing sources to target weights by Pfair scheduling. DataFrame functions only.

Each source (stream) is cut into blocks of about `block` size units in a random but fixed
order. A stream with share n of a period of D slots has, for its k-th block (from 0), the
release time floor(k * D / n) and the deadline ceil((k + 1) * D / n). In every slot the
released block with the earliest deadline runs. The shares add up to D, so every slot is
used, every block meets its window, and while all streams last each of them deviates from
its target by less than one block at any time. The schedule repeats after D slots: it is
found once for one period, and block k of a stream runs in slot

    (k div n) * D + slot_in_period[k mod n].

A stream that has run out leaves its slots empty; the others keep their order and their
ratio to each other. No row is dropped or repeated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from headwise.llm.common import without

OUT = ("stream", "source_row", "block", "slot")


def integer_shares(weights: dict[str, float], rest: float, resolution: int) -> list[int]:
    """Whole shares in proportion to the weights, at least one each; the last is the rest's."""
    values = [*weights.values(), rest]
    if min(values) <= 0:
        raise ValueError("weights must be positive")
    return [max(1, round(v / sum(values) * resolution)) for v in values]


def period(spark: SparkSession, shares: list[int]) -> DataFrame:
    """One period of the schedule: (_stream, _turn, _in_period), sum(shares) rows."""
    total = sum(shares)
    n = f"array({', '.join(map(str, shares))})"
    picks = f"""
        aggregate(
            sequence(0, {total - 1}),
            named_struct('given', array_repeat(0, {len(shares)}), 'picks', cast(array() AS array<int>)),
            (s, t) -> named_struct(
                'given', transform(s.given, (g, i) -> g + IF(i = {_choice(n, total)}, 1, 0)),
                'picks', s.picks || array({_choice(n, total)})),
            s -> s.picks)"""
    turns = Window.partitionBy("_stream").orderBy("_in_period")
    return (
        spark.range(1)
        .select(F.posexplode(F.expr(picks)).alias("_in_period", "_stream"))
        .withColumn("_turn", F.row_number().over(turns) - 1)
    )


def _choice(n: str, total: int) -> str:
    """The stream that runs in slot t: earliest deadline among the released, then lowest."""
    return f"""array_min(filter(
        transform(s.given, (g, i) -> named_struct(
            'deadline', ((g + 1) * {total} + {n}[i] - 1) div {n}[i],
            'stream', i,
            'release', (g * {total}) div {n}[i])),
        x -> x.release <= t)).stream"""


def mix(
    docs: DataFrame,
    weights: dict[str, float],
    rest: float,
    size: Column | None = None,
    block: int = 8192,
    resolution: int = 1000,
    source: str = "source",
    key: str = "doc_id",
    seed: str = "mix",
    bucket_digits: int = 3,
) -> DataFrame:
    """`docs` with `stream` (the source's name; NULL for the rest), `source_row` (place in
    the stream, from 1), `block` and `slot` (both from 0). Ordering by slot, then source_row,
    gives the mixture; a slot belongs to one stream.

    weights: target per listed source; all other sources, NULL too, are one stream of
    weight `rest`. size: what a row counts for its stream's target (default: one per row); a
    row belongs to the block in which it starts, and NULL or negative counts as 0.

    The order within a stream is that of md5(seed:key), then of the key, then of the text.
    It is numbered within buckets of the digest, whose sums are then added up, so a source
    with a third of all rows spreads over 16 ** bucket_digits groups. Repeated rows each keep
    their own place; rows without a key come where the digest of the empty key falls. An
    empty table gives an empty result. Columns named like the new ones are replaced.
    """
    shares = integer_shares(weights, rest, resolution)
    numbers = {name: i for i, name in enumerate(weights)}
    spark = docs.sparkSession
    known = F.create_map(*[F.lit(x) for pair in numbers.items() for x in pair]) if numbers else None
    stream = F.lit(0) if known is None else F.coalesce(
        F.try_element_at(known, F.coalesce(F.col(source).cast("string"), F.lit(""))), F.lit(len(weights))
    )
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))).cast("binary"))
    counted = F.lit(1) if size is None else F.greatest(F.coalesce(size, F.lit(0)), F.lit(0))
    keyed = without(docs, *OUT).withColumns(
        {"_stream": stream, "_digest": digest, "_size": counted.cast("long")}
    ).withColumn("_bucket", F.substring("_digest", 1, bucket_digits))

    bucket = ["_stream", "_bucket"]
    sums = keyed.groupBy(*bucket).agg(F.sum("_size").alias("_units"), F.count("*").alias("_rows"))
    earlier = Window.partitionBy("_stream").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        *bucket,
        F.coalesce(F.sum("_units").over(earlier), F.lit(0)).alias("_units_before"),
        F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_rows_before"),
    )
    ties = [c for c in (key, "text") if c in docs.columns]
    within = Window.partitionBy(*bucket).orderBy("_digest", *ties)
    before = within.rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        keyed.withColumns(
            {"_place": F.row_number().over(within), "_units_in": F.coalesce(F.sum("_size").over(before), F.lit(0))}
        )
        .join(offsets, bucket)
        .withColumn("source_row", (F.col("_rows_before") + F.col("_place")).cast("long"))
        .withColumn("block", F.floor((F.col("_units_before") + F.col("_units_in")) / block).cast("long"))
    )
    share = F.element_at(F.array(*[F.lit(n) for n in shares]), F.col("_stream") + 1)
    names = F.array(*[F.lit(n) for n in weights], F.lit(None).cast("string"))
    # The period has sum(shares) rows, about `resolution`, whatever the data.
    return (
        placed.withColumn("_turn", (F.col("block") % share).cast("int"))
        .join(F.broadcast(period(spark, shares)), ["_stream", "_turn"])
        .withColumn(
            "slot", F.floor(F.col("block") / share) * F.lit(sum(shares)) + F.col("_in_period")
        )
        .withColumn("stream", F.element_at(names, F.col("_stream") + 1))
        .select(*[F.col(f"`{c}`") for c in without(docs, *OUT).columns], *OUT)
    )
