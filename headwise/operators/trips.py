"""Trip-level metric intermediates: terminals, run times, headways, coverage rows."""

import uuid

from pyspark.sql import DataFrame, Window, functions as F

from headwise.functions.columns import (
    LOCAL_TZ, asc_nl, clock_hour, join_on, local_hour, loss_minutes, secs_between, wall_clock_instant,
)
from headwise.operators.observed import MATCHED, TRIP_DAY
from headwise.operators.schedule import trip_days
from headwise.sources.store import Stage, lazily

FIRST_STOP_GROUP = ["route_id", "direction_key", "first_stop_id", "service_date"]


def _trip_ends(stop_times: DataFrame) -> DataFrame:
    """First and last stop of each trip pattern: one aggregation, no self join."""
    stop = F.struct("stop_sequence", "stop_id", "arrival_time_secs")
    return (
        stop_times.filter("stop_sequence IS NOT NULL")
        .groupBy("trip_id")
        .agg(F.min(stop).alias("first"), F.max(stop).alias("last"))
    )


def trip_bounds(trips: DataFrame, dates: DataFrame, stop_times: DataFrame) -> DataFrame:
    bounds = stop_times.groupBy("trip_id").agg(
        F.min("stop_sequence").alias("first_stop_sequence"),
        F.max("stop_sequence").alias("last_stop_sequence"),
    )
    return trip_days(trips, dates).join(bounds, "trip_id").select(
        *TRIP_DAY, "first_stop_sequence", "last_stop_sequence"
    )


def _ranged_by_departure(days: DataFrame) -> DataFrame:
    """`days` sorted by first stop, day, arrival (NULL last) and trip id over all tasks, with
    `_part`, the task, and `_place`, which counts up by one within it.

    The ranges come from a sample of the rows, so a stop that holds most of them is spread like
    any others, whatever its times and trip ids look like."""
    order = [*FIRST_STOP_GROUP, asc_nl("first_arrival_time_secs"), F.asc("trip_id")]
    keyed = days.withColumn("direction_key", F.coalesce("direction_id", F.lit(-1)))
    parts = int(days.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = keyed.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    # The id has the task in its upper bits and counts the task's rows.
    return ranged.withColumns({"_part": F.spark_partition_id(), "_place": F.monotonically_increasing_id()})


def first_stop_trip_order(days: DataFrame, cut=lazily) -> DataFrame:
    """Number the trips that start at the same stop on a day by arrival, then trip id.

    All rows are sorted by range; a group's number is the place in its part, counted from the
    group's first row there, plus the group's rows in earlier parts. Only these counts, one row
    per group and part, are looked at together. The sorted rows are always staged, since their
    places must not change between counting and numbering.
    """
    stage = Stage(days.sparkSession) if cut is lazily else cut
    placed = stage(f"trips_by_departure_{uuid.uuid4().hex}", _ranged_by_departure(days))
    group = [*FIRST_STOP_GROUP, "_part"]
    earlier = Window.partitionBy(*FIRST_STOP_GROUP).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = (
        placed.groupBy(*group).agg(F.count("*").alias("_n"), F.min("_place").alias("_first"))
        .select(*group, "_first", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_shift"))
    )
    # NULL groups are groups, too.
    numbered = join_on(placed, shifts, ["direction_key", "_part"], ["route_id", "first_stop_id", "service_date"])
    return numbered.withColumn(
        "first_stop_trip_order", (F.col("_shift") + F.col("_place") - F.col("_first") + 1)
    ).drop("_part", "_place", "_first", "_shift", "direction_key")


def trip_terminals(
    trips: DataFrame, dates: DataFrame, stop_times: DataFrame, tz: str = LOCAL_TZ, cut=lazily
) -> DataFrame:
    """First and last scheduled stop of every trip and day, with the order of departure.

    The schedule is read and joined once; see `first_stop_trip_order`.
    """
    ends = trip_days(trips, dates).join(_trip_ends(stop_times), "trip_id")
    timed = ends.select(
        "trip_id", "route_id", "service_id", "service_date", "direction_id", "trip_headsign",
        F.col("first.stop_id").alias("first_stop_id"),
        F.col("last.stop_id").alias("last_stop_id"),
        F.col("first.stop_sequence").alias("first_stop_sequence"),
        F.col("last.stop_sequence").alias("last_stop_sequence"),
        F.col("first.arrival_time_secs").alias("first_arrival_time_secs"),
        F.col("last.arrival_time_secs").alias("last_arrival_time_secs"),
    ).withColumns(
        {
            "first_scheduled_arrival_ts": wall_clock_instant(
                F.col("service_date"), F.col("first_arrival_time_secs"), tz
            ),
            "last_scheduled_arrival_ts": wall_clock_instant(
                F.col("service_date"), F.col("last_arrival_time_secs"), tz
            ),
            "trip_start_hour_local": clock_hour("first_arrival_time_secs"),
        }
    )
    return first_stop_trip_order(timed, cut)


def observed_terminals(terminals: DataFrame, events: DataFrame) -> DataFrame:
    """Trips and days with the observed instants of their terminals, where matched.

    One join on trip and day feeds both the run times and the headways.
    """
    seen = events.select(*TRIP_DAY, "stop_sequence", "stop_id", "observed_arrival_ts")
    at_first = (F.col("stop_sequence") == F.col("first_stop_sequence")) & (
        F.col("stop_id") == F.col("first_stop_id")
    )
    at_last = (F.col("stop_sequence") == F.col("last_stop_sequence")) & (
        F.col("stop_id") == F.col("last_stop_id")
    )
    ends = (
        terminals.select(
            *TRIP_DAY, "first_stop_sequence", "first_stop_id", "last_stop_sequence", "last_stop_id"
        )
        .join(seen, TRIP_DAY)
        .filter(at_first | at_last)
        .groupBy(*TRIP_DAY)
        .agg(
            F.min(F.when(at_first, F.col("observed_arrival_ts"))).alias("observed_first_arrival_ts"),
            F.min(F.when(at_last, F.col("observed_arrival_ts"))).alias("observed_last_arrival_ts"),
        )
    )
    return terminals.join(ends, TRIP_DAY)


def full_trip_metrics(terminals_seen: DataFrame) -> DataFrame:
    """Run time loss of trips observed at both terminals."""
    observed = secs_between(F.col("observed_first_arrival_ts"), F.col("observed_last_arrival_ts"))
    scheduled = (F.col("last_arrival_time_secs") - F.col("first_arrival_time_secs")).cast("double")
    return (
        terminals_seen.filter(
            "observed_first_arrival_ts IS NOT NULL AND observed_last_arrival_ts IS NOT NULL"
            " AND first_arrival_time_secs IS NOT NULL AND last_arrival_time_secs IS NOT NULL"
        )
        .select(
            "route_id", "direction_id", "trip_headsign", "service_date", "trip_id",
            "trip_start_hour_local",
            observed.alias("observed_runtime_secs"),
            scheduled.alias("scheduled_runtime_secs"),
            loss_minutes(observed, scheduled).alias("in_vehicle_loss_minutes"),
        )
    )


def matched_first_stop_events(terminals_seen: DataFrame) -> DataFrame:
    return terminals_seen.filter(
        "observed_first_arrival_ts IS NOT NULL AND first_scheduled_arrival_ts IS NOT NULL"
    ).select(
        "route_id", "direction_id", "trip_headsign", "service_date", "trip_id",
        "first_stop_id", "first_stop_trip_order", "first_scheduled_arrival_ts",
        "observed_first_arrival_ts",
    )


def headway_intervals(first_stop_events: DataFrame, tz: str = LOCAL_TZ) -> DataFrame:
    """Scheduled and observed gaps between trips that are neighbours in the schedule.

    The order number is part of the join key, so even a very busy first stop spreads over
    all tasks. A missing middle trip breaks the chain.
    """
    this = first_stop_events.withColumn("direction_key", F.coalesce("direction_id", F.lit(-1)))
    following = this.select(
        *FIRST_STOP_GROUP,
        (F.col("first_stop_trip_order") - 1).alias("first_stop_trip_order"),
        F.col("first_scheduled_arrival_ts").alias("next_scheduled_ts"),
        F.col("observed_first_arrival_ts").alias("next_observed_ts"),
    )
    scheduled = secs_between(F.col("first_scheduled_arrival_ts"), F.col("next_scheduled_ts"))
    observed = secs_between(F.col("observed_first_arrival_ts"), F.col("next_observed_ts"))
    midpoint = F.timestamp_micros(
        F.unix_micros("first_scheduled_arrival_ts") + (scheduled * 500_000).cast("long")
    )
    return (
        this.join(following, [*FIRST_STOP_GROUP, "first_stop_trip_order"])
        .filter((scheduled > 0) & (observed > 0))
        .select(
            "route_id", "direction_id", "trip_headsign", "service_date", "first_stop_id",
            local_hour(midpoint, tz).alias("hour_local"),
            scheduled.alias("scheduled_headway_secs"),
            observed.alias("observed_headway_secs"),
        )
    )


def matched_coverage_rows(events: DataFrame, tz: str = LOCAL_TZ) -> DataFrame:
    return events.select(
        "route_id", "direction_id", "service_date",
        local_hour("scheduled_arrival_ts", tz).alias("hour_local"),
    )


def unmatched_resolved(audit: DataFrame, trips: DataFrame, tz: str = LOCAL_TZ) -> DataFrame:
    """Observations that did not match but whose route is known, directly or by trip."""
    known = trips.select(
        "trip_id", F.col("route_id").alias("trip_route_id"),
        F.col("direction_id").alias("trip_direction_id"),
    )
    route = F.coalesce("route_id", "trip_route_id")
    return (
        audit.filter(F.col("join_status") != MATCHED)
        .join(known, "trip_id", "left")
        .filter(route.isNotNull())
        .select(
            route.alias("route_id"),
            F.coalesce("direction_id", "trip_direction_id").alias("direction_id"),
            "service_date",
            local_hour("observed_arrival_ts", tz).alias("hour_local"),
            "join_status",
        )
    )


def unmatched_counts(audit: DataFrame, trips: DataFrame, tz: str = LOCAL_TZ) -> DataFrame:
    """`unmatched_resolved`, counted by route, direction and hour.

    Counted per trip before the trips are looked up: an unknown or noisy trip id that
    fills a large share of the observations enters the join as a few rows.
    """
    per_trip = (
        audit.filter(F.col("join_status") != MATCHED)
        .groupBy(
            "trip_id", "route_id", "direction_id",
            local_hour("observed_arrival_ts", tz).alias("hour_local"),
        )
        .agg(F.count("*").alias("n"))
    )
    known = trips.select(
        "trip_id", F.col("route_id").alias("trip_route_id"),
        F.col("direction_id").alias("trip_direction_id"),
    )
    route = F.coalesce("route_id", "trip_route_id")
    return (
        per_trip.join(known, "trip_id", "left")
        .filter(route.isNotNull())
        .groupBy(
            route.alias("route_id"),
            F.coalesce("direction_id", "trip_direction_id").alias("direction_id"),
            "hour_local",
        )
        .agg(F.sum("n").alias("n"))
    )
