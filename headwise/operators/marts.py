"""Loss marts per route, direction, hour, segment and stop.

Every mart is an aggregate of a few small base relations that are each reduced once from
trip or event level: headway sums, run time loss histograms and event counts. The loss
values of a group are counted per distinct value, so an exact median holds at most one
entry per distinct second of loss, however many trips a route has.
"""

from pyspark.sql import Column, DataFrame, Window, functions as F

from headwise.functions.columns import (
    WINDOW_KEY, asc_nl, desc_nl, effective_wait, join_on, loss_minutes, round6,
    secs_between, text,
)
from headwise.operators.observed import TRIP_DAY

BY_ROUTE = ["route_id"]
BY_DIRECTION = ["route_id", "direction_id"]
BY_HOUR = ["route_id", "direction_id", "hour_local"]
SEGMENT = [
    "route_id", "direction_id", "shape_id", "segment_sequence", "from_stop_id", "to_stop_id",
]

def _squares() -> dict[str, Column]:
    observed, scheduled = F.col("observed_headway_secs"), F.col("scheduled_headway_secs")
    return {
        "observed_sq": observed * observed,
        "observed_sum": observed,
        "scheduled_sq": scheduled * scheduled,
        "scheduled_sum": scheduled,
    }


def headway_sums(headways: DataFrame) -> DataFrame:
    """Sums from which every waiting figure follows, per route, direction, hour and stop."""
    return headways.groupBy(*BY_HOUR, "first_stop_id").agg(
        *[F.sum(c).alias(name) for name, c in _squares().items()],
        F.count("*").alias("headway_count"),
    )


def loss_histogram(full_trips: DataFrame) -> DataFrame:
    return full_trips.groupBy(
        "route_id", "direction_id", F.col("trip_start_hour_local").alias("hour_local"),
        "in_vehicle_loss_minutes",
    ).agg(F.count("*").alias("trip_count"))


def hourly_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*BY_HOUR).agg(F.count("*").alias("n"))


def waiting_loss() -> Column:
    return round6(
        F.greatest(
            F.lit(0.0),
            effective_wait("observed_sq", "observed_sum")
            - effective_wait("scheduled_sq", "scheduled_sum"),
        )
    )


def _summed(sums: DataFrame, keys: list[str]) -> DataFrame:
    return sums.groupBy(*keys).agg(
        *[F.sum(c).alias(c) for c in _squares()], F.sum("headway_count").alias("headway_count")
    )


def waiting_metrics(sums: DataFrame, keys: list[str]) -> DataFrame:
    return _summed(sums, keys).select(
        *keys,
        waiting_loss().alias("waiting_loss_minutes"),
        F.col("headway_count").alias("matched_headway_interval_count"),
    )


def weighted_median(value: str, weight: str) -> Column:
    return F.percentile(F.col(value), F.lit(0.5), F.col(weight))


def runtime_metrics(histogram: DataFrame, keys: list[str]) -> DataFrame:
    return histogram.groupBy(*keys).agg(
        round6(weighted_median("in_vehicle_loss_minutes", "trip_count")).alias(
            "in_vehicle_loss_minutes"
        ),
        F.sum("trip_count").alias("matched_full_trip_count"),
    )


def matched_coverage(counts: DataFrame, keys: list[str]) -> DataFrame:
    return counts.groupBy(*keys).agg(F.sum("n").alias("matched_observed_stop_event_count"))


def unmatched_coverage(counts: DataFrame, keys: list[str]) -> DataFrame:
    return counts.groupBy(*keys).agg(F.sum("n").alias("resolved_unmatched_observation_count"))


def loss_parts(
    sums: DataFrame, histogram: DataFrame, matched: DataFrame, unmatched: DataFrame
) -> DataFrame:
    """The four base relations as one relation of partial figures, tagged by key.

    A summary is then one aggregation of this relation: its groups are the union of the
    keys, and no join between the figures is needed.
    """
    waiting = _summed(sums, BY_HOUR)
    losses = histogram.withColumnRenamed("in_vehicle_loss_minutes", "loss")
    return (
        waiting.unionByName(losses, allowMissingColumns=True)
        .unionByName(matched.withColumnRenamed("n", "matched_n"), allowMissingColumns=True)
        .unionByName(unmatched.withColumnRenamed("n", "unmatched_n"), allowMissingColumns=True)
    )


def group_keys(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Keys with at least one figure: `route_keys`, `route_direction_keys`, `route_hour_keys`."""
    return parts.select(*keys).distinct()


def _figures(parts: DataFrame, keys: list[str]) -> DataFrame:
    if "hour_local" in keys:
        # A row without an hour keeps its key but joins no figure.
        measures = [c for c in parts.columns if c not in keys]
        parts = parts.select(
            *keys, *[F.when(F.col("hour_local").isNotNull(), F.col(c)).alias(c) for c in measures]
        )
    totals = parts.groupBy(*keys).agg(
        *[F.sum(c).alias(c) for c in _squares()],
        F.percentile(F.col("loss"), F.lit(0.5), F.coalesce("trip_count", F.lit(0))).alias("loss"),
        *[
            F.coalesce(F.sum(c), F.lit(0)).alias(name)
            for c, name in (
                ("matched_n", "matched_observed_stop_event_count"),
                ("unmatched_n", "resolved_unmatched_observation_count"),
                ("headway_count", "matched_headway_interval_count"),
                ("trip_count", "matched_full_trip_count"),
            )
        ],
    )
    # Without headways the sums are NULL, and `greatest` would turn that into 0.
    waiting = F.when(F.col("matched_headway_interval_count") > 0, waiting_loss())
    return totals.withColumns(
        {"waiting_loss_minutes": waiting, "in_vehicle_loss_minutes": round6(F.col("loss"))}
    ).withColumn(
        "typical_trip_loss_minutes",
        round6(F.col("waiting_loss_minutes") + F.col("in_vehicle_loss_minutes")),
    )


COUNTS = [
    "matched_observed_stop_event_count", "resolved_unmatched_observation_count",
    "matched_headway_interval_count", "matched_full_trip_count",
]
LOSSES = ["typical_trip_loss_minutes", "waiting_loss_minutes", "in_vehicle_loss_minutes"]
ROUTE_NAMES = ["route_name", "route_short_name", "route_long_name"]


def with_route_names(df: DataFrame, routes: DataFrame) -> DataFrame:
    """Inner join: rows of a route that the schedule does not list disappear."""
    return df.join(
        routes.select("route_id", "route_short_name", "route_long_name"), "route_id"
    ).withColumn("route_name", F.coalesce("route_long_name", "route_short_name", "route_id"))


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], keep: list[str]) -> DataFrame:
    """First row per key. Spark limits the rank before the shuffle, so no group is sorted whole."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).filter("_rank = 1").select(*keys, *keep)


def worst_stop_wait_label(stop_waits: DataFrame, keys: list[str] = BY_ROUTE) -> DataFrame:
    order = [desc_nl("waiting_loss_minutes"), asc_nl("direction_id"), asc_nl("stop_id")]
    return top_per_group(stop_waits, keys, order, ["stop_wait_label"]).withColumnRenamed(
        "stop_wait_label", "worst_stop_wait_label"
    )


def worst_segment_label(segments: DataFrame, keys: list[str] = BY_ROUTE) -> DataFrame:
    order = [
        desc_nl("segment_in_vehicle_loss_minutes"), asc_nl("direction_id"),
        asc_nl("segment_sequence"), asc_nl("shape_id"), asc_nl("segment_label"),
    ]
    return top_per_group(segments, keys, order, ["segment_label"]).withColumnRenamed(
        "segment_label", "worst_segment_label"
    )


def route_window_summary(
    parts: DataFrame, routes: DataFrame, stop_waits: DataFrame, segments: DataFrame
) -> DataFrame:
    return (
        with_route_names(_figures(parts, BY_ROUTE), routes)
        .join(worst_stop_wait_label(stop_waits), "route_id", "left")
        .join(worst_segment_label(segments), "route_id", "left")
        .select(
            "route_id", *ROUTE_NAMES, F.lit(WINDOW_KEY).alias("window_key"), *LOSSES,
            "worst_stop_wait_label", "worst_segment_label", *COUNTS,
            F.current_timestamp().alias("metric_updated_at"),
        )
    )


def route_direction_summary(
    parts: DataFrame,
    routes: DataFrame,
    labels: DataFrame,
    stop_waits: DataFrame,
    segments: DataFrame,
) -> DataFrame:
    rows = with_route_names(_figures(parts, BY_DIRECTION), routes)
    for side in (
        worst_stop_wait_label(stop_waits, BY_DIRECTION),
        worst_segment_label(segments, BY_DIRECTION),
        labels,
    ):
        rows = join_on(rows, side, ["route_id"], ["direction_id"], "left")
    return rows.select(
        "route_id", *ROUTE_NAMES, "direction_id", "direction_label",
        F.lit(WINDOW_KEY).alias("window_key"), *LOSSES,
        "worst_stop_wait_label", "worst_segment_label", *COUNTS,
        F.current_timestamp().alias("metric_updated_at"),
    )


def route_hour_summary(parts: DataFrame, routes: DataFrame, labels: DataFrame) -> DataFrame:
    rows = with_route_names(_figures(parts, BY_HOUR), routes)
    return join_on(rows, labels, ["route_id"], ["direction_id"], "left").select(
        "route_id", *ROUTE_NAMES, "direction_id", "direction_label", "hour_local", *LOSSES,
        *COUNTS, F.current_timestamp().alias("metric_updated_at"),
    )


def observed_segment_pairs(events: DataFrame) -> DataFrame:
    """Matched events with the matched event at the next sequence number of the same run.

    Joined on the number itself, so the work spreads by event and not by trip.
    """
    here = events.select(
        *TRIP_DAY, "route_id", "direction_id", "shape_id",
        F.col("stop_sequence").alias("segment_sequence"),
        F.col("stop_id").alias("from_stop_id"),
        F.col("observed_arrival_ts").alias("from_observed_arrival_ts"),
        F.col("scheduled_arrival_time_secs").alias("from_scheduled_arrival_time_secs"),
    )
    there = events.select(
        *TRIP_DAY,
        (F.col("stop_sequence") - 1).alias("segment_sequence"),
        F.col("stop_sequence").alias("to_stop_sequence"),
        F.col("stop_id").alias("to_stop_id"),
        F.col("observed_arrival_ts").alias("to_observed_arrival_ts"),
        F.col("scheduled_arrival_time_secs").alias("to_scheduled_arrival_time_secs"),
    )
    return here.join(there, [*TRIP_DAY, "segment_sequence"])


def trip_segment_metrics(pairs: DataFrame) -> DataFrame:
    observed = secs_between(F.col("from_observed_arrival_ts"), F.col("to_observed_arrival_ts"))
    scheduled = (
        F.col("to_scheduled_arrival_time_secs") - F.col("from_scheduled_arrival_time_secs")
    ).cast("double")
    return pairs.filter(
        "from_scheduled_arrival_time_secs IS NOT NULL AND to_scheduled_arrival_time_secs IS NOT NULL"
    ).select(
        *TRIP_DAY, *SEGMENT,
        loss_minutes(observed, scheduled).alias("segment_in_vehicle_loss_minutes"),
    )


def route_segment_metrics(
    segments: DataFrame, routes: DataFrame, trip_segments: DataFrame
) -> DataFrame:
    """Median loss per segment. Trips are reduced to segments before the segments are joined."""
    per_loss = trip_segments.groupBy(*SEGMENT, "segment_in_vehicle_loss_minutes").agg(
        F.count("*").alias("n")
    )
    per_segment = per_loss.groupBy(*SEGMENT).agg(
        round6(weighted_median("segment_in_vehicle_loss_minutes", "n")).alias(
            "segment_in_vehicle_loss_minutes"
        ),
        F.sum("n").alias("matched_trip_segment_count"),
    )
    plain = [c for c in SEGMENT if c != "direction_id"]
    return join_on(
        with_route_names(segments, routes), per_segment, plain, ["direction_id"], "left"
    ).select(
        "route_id", *ROUTE_NAMES, "direction_id", "direction_label", "shape_id",
        F.lit("adjacent_stop_pair").alias("segment_strategy"),
        F.lit(WINDOW_KEY).alias("window_key"),
        "segment_sequence", "from_stop_id", "from_stop_name", "to_stop_id", "to_stop_name",
        "segment_label", "scheduled_segment_minutes", "segment_in_vehicle_loss_minutes",
        F.coalesce("matched_trip_segment_count", F.lit(0)).alias("matched_trip_segment_count"),
        F.current_timestamp().alias("metric_updated_at"),
    )


def stop_wait_metrics(
    sums: DataFrame, routes: DataFrame, stops: DataFrame, labels: DataFrame
) -> DataFrame:
    per_stop = _summed(sums, [*BY_DIRECTION, "first_stop_id"]).withColumnRenamed(
        "first_stop_id", "stop_id"
    )
    named = with_route_names(per_stop, routes).join(stops.select("stop_id", "stop_name"), "stop_id")
    name = text("stop_name")
    label = (
        F.when(
            F.col("direction_label").isNotNull(),
            F.concat(name, F.lit(" ("), F.col("direction_label"), F.lit(")")),
        )
        .when(
            F.col("direction_id").isNotNull(),
            F.concat(name, F.lit(" (Direction "), F.col("direction_id").cast("string"), F.lit(")")),
        )
        .otherwise(F.col("stop_name"))
    )
    return join_on(named, labels, ["route_id"], ["direction_id"], "left").select(
        "route_id", *ROUTE_NAMES, "direction_id", "direction_label", "stop_id", "stop_name",
        label.alias("stop_wait_label"),
        F.lit(WINDOW_KEY).alias("window_key"),
        F.lit("first_stop_exact_match").alias("stop_wait_strategy"),
        round6(effective_wait("scheduled_sq", "scheduled_sum")).alias(
            "scheduled_effective_wait_minutes"
        ),
        round6(effective_wait("observed_sq", "observed_sum")).alias(
            "observed_effective_wait_minutes"
        ),
        waiting_loss().alias("waiting_loss_minutes"),
        F.col("headway_count").alias("matched_headway_interval_count"),
        F.current_timestamp().alias("metric_updated_at"),
    )


def coverage_counts(window_summary: DataFrame, map_layer: DataFrame) -> DataFrame:
    """One row: routes with a typical loss, routes on the map, ten worst route ids."""
    ranked = window_summary.filter("typical_trip_loss_minutes IS NOT NULL")
    worst = (
        ranked.orderBy(desc_nl("typical_trip_loss_minutes"), "route_id")
        .limit(10)
        .select(F.struct((-F.col("typical_trip_loss_minutes")).alias("o"), "route_id").alias("s"))
        .agg(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["route_id"]).alias("top_route_ids"))
    )
    on_map = map_layer.agg(F.count("*").alias("n")).scalar()
    return ranked.agg(F.count("*").alias("route_count_with_metrics")).select(
        "route_count_with_metrics", on_map.alias("map_route_count"),
        worst.scalar().alias("top_route_ids"),
    )
