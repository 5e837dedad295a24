"""Observed stop events: how each observation relates to the schedule.

No window runs over observations or their keys. Keys are counted with partial aggregation,
the schedule is looked up once per distinct key, and the result is joined back on the full
key, so a key that is repeated very often becomes one row before any lookup, and every join
is an equi join that adaptive execution can split.

Shuffles with about a row per observation: the narrow keys three times (to count them, to meet
the trips of their day, to meet the stops of their slot), then their facts and the observations
once each. The totals of trips and slots are partial aggregations of the counted keys.
"""

from pyspark.sql import Column, DataFrame, functions as F

from headwise.functions.columns import (
    DAY_SECS, LOCAL_TZ, secs_between, shift_secs, wall_clock_instant,
)
from headwise.operators.schedule import trip_days
from headwise.schemas import LINEAGE_COLUMNS, METADATA_COLUMNS

TRIP_DAY = ["service_date", "trip_id"]
SLOT = [*TRIP_DAY, "stop_sequence"]
EVENT = [*SLOT, "stop_id"]
OBSERVATION_KEY = [*EVENT, "snapshot_label"]

# The audit statuses, in the order in which they are tried.
DUPLICATE = "duplicate_observation_key"
MATCHED = "matched_exact"
NO_TRIP_DAY = "unmatched_trip_service_date"
NO_SEQUENCE = "unmatched_stop_sequence"
NO_STOP = "unmatched_stop_id"

RUN_FACTS = [
    "route_id", "service_id", "trip_headsign", "direction_id", "shape_id",
    *[f"scheduled_{c}" for c in LINEAGE_COLUMNS],
]
STOP_FACTS = {
    "scheduled_stop_id": "stop_id",
    "shape_dist_traveled": "shape_dist_traveled",
    "scheduled_arrival_time_text": "arrival_time_text",
    "scheduled_departure_time_text": "departure_time_text",
    "scheduled_arrival_time_secs": "arrival_time_secs",
    "scheduled_departure_time_secs": "departure_time_secs",
}


def observation_key_count(observations: DataFrame) -> DataFrame:
    return observations.groupBy(*OBSERVATION_KEY).agg(
        F.count("*").alias("observation_key_row_count")
    )


def _runs_by_day(days: DataFrame, stop_times: DataFrame) -> DataFrame:
    """Per trip and day: its schedule rows (one, unless a trip id is repeated) and stop count.

    Copies of a row are counted before the rows are collected, in the task that collects them.
    """
    stops = stop_times.groupBy("trip_id").agg(F.count("*").alias("stop_count"))
    facts = days.select(
        *TRIP_DAY,
        F.struct(
            "route_id", "service_id", "trip_headsign", "direction_id", "shape_id",
            *[F.col(c).alias(f"scheduled_{c}") for c in LINEAGE_COLUMNS],
        ).alias("run"),
    ).repartition(*TRIP_DAY)
    counted = facts.groupBy(*TRIP_DAY, "run").agg(F.count("*").alias("run_copies"))
    return counted.groupBy(*TRIP_DAY).agg(
        F.collect_list(F.struct("run", "run_copies")).alias("runs"), F.sum("run_copies").alias("run_count")
    ).join(stops, "trip_id")


def _stops_by_slot(stop_times: DataFrame) -> DataFrame:
    """Per trip and sequence number: the distinct stops there (one, by the key of the table).

    Copies of a row are counted before the stops are collected, in the task that collects them.
    """
    slot = ["trip_id", "stop_sequence"]
    counted = (
        stop_times.select(*slot, *[F.col(c).alias(name) for name, c in STOP_FACTS.items()])
        .repartition(*slot)
        .groupBy(*slot, *STOP_FACTS)
        .agg(F.count("*").alias("copies"))
    )
    return counted.groupBy(*slot).agg(
        F.collect_list(F.struct(*STOP_FACTS, "copies")).alias("stops"),
        F.sum("copies").alias("slot_stops"),
    )


def _key_candidates(key_counts: DataFrame, days: DataFrame, stop_times: DataFrame) -> DataFrame:
    """Distinct observed keys with the runs and stops they may match and both counts.

    The totals per slot and per trip and day are aggregations of the key counts. They meet
    the schedule first, at their own level, and reach the keys by equi joins, which adaptive
    execution can split: no window or sort ever holds all keys of a trip and day.
    """
    rows = F.sum("observation_key_row_count")
    by_day = key_counts.groupBy(*TRIP_DAY).agg(rows.alias("_trip")).join(_runs_by_day(days, stop_times), TRIP_DAY)
    by_slot = (
        key_counts.groupBy(*SLOT).agg(rows.alias("_slot")).join(_stops_by_slot(stop_times), ["trip_id", "stop_sequence"])
    )
    return (
        key_counts.join(by_day, TRIP_DAY, "left")
        .join(by_slot, SLOT, "left")
        .withColumns(
            {
                "scheduled_trip_service_date_count": F.coalesce(
                    F.col("_trip") * F.col("run_count") * F.col("stop_count"), F.lit(0)
                ),
                "scheduled_trip_service_sequence_count": F.coalesce(
                    F.col("_slot") * F.col("run_count") * F.col("slot_stops"), F.lit(0)
                ),
            }
        )
        .drop("_slot", "_trip", "stop_count", "slot_stops", "run_count")
    )


def trip_service_candidates(
    key_counts: DataFrame, days: DataFrame, stop_times: DataFrame
) -> DataFrame:
    """Per observed trip and day: observed rows times scheduled stops (0 if it does not run)."""
    name = "scheduled_trip_service_date_count"
    keys = _key_candidates(key_counts, days, stop_times)
    return keys.groupBy(*TRIP_DAY).agg(F.max(name).alias(name))


def trip_service_sequence_candidates(
    key_counts: DataFrame, days: DataFrame, stop_times: DataFrame
) -> DataFrame:
    """The same per observed trip, day and sequence number."""
    name = "scheduled_trip_service_sequence_count"
    keys = _key_candidates(key_counts, days, stop_times)
    return keys.groupBy(*SLOT).agg(F.max(name).alias(name))


def key_facts(key_counts: DataFrame, days: DataFrame, stop_times: DataFrame) -> DataFrame:
    """Distinct observed keys with their counts and the facts of the scheduled stop event
    they name; the facts are NULL where there is none."""
    at_stop = F.filter("stops", lambda s: s["scheduled_stop_id"] == F.col("stop_id"))
    matches = F.flatten(
        F.transform(
            "runs",
            lambda r: F.transform(
                at_stop, lambda s: F.struct(r["run"].alias("run"), r["run_copies"].alias("run_copies"), s.alias("stop"))
            ),
        )
    )
    copies = F.coalesce(F.col("match.stop.copies") * F.col("match.run_copies"), F.lit(1).cast("long"))
    return (
        _key_candidates(key_counts, days, stop_times)
        .withColumn("match", F.explode_outer(matches))
        .withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), copies)))
        .select(
            *OBSERVATION_KEY, "observation_key_row_count",
            "scheduled_trip_service_date_count", "scheduled_trip_service_sequence_count",
            *[f"match.run.{c}" for c in RUN_FACTS], *[f"match.stop.{c}" for c in STOP_FACTS],
        )
    )


def exact_observed_join(
    observations: DataFrame, days: DataFrame, stop_times: DataFrame
) -> DataFrame:
    """Every observation with the schedule facts and candidate counts of its key."""
    facts = key_facts(observation_key_count(observations), days, stop_times)
    return observations.join(facts, OBSERVATION_KEY, "left")


def scheduled_ts(secs: str, tz: str = LOCAL_TZ) -> Column:
    return wall_clock_instant(F.col("service_date"), F.col(secs), tz)


def nearest_day_alignment(observed: Column, scheduled: Column) -> Column:
    """The observed instant, or the same a day later or earlier: whichever is nearest.

    Ties keep the raw instant, then prefer the later day.
    """
    off = secs_between(scheduled, observed)
    raw, later, earlier = F.abs(off), F.abs(off + DAY_SECS), F.abs(off - DAY_SECS)
    return (
        F.when(scheduled.isNull() | ((raw <= later) & (raw <= earlier)), observed)
        .when(later <= earlier, shift_secs(observed, DAY_SECS))
        .otherwise(shift_secs(observed, -DAY_SECS))
    )


def arrival_delay_secs(observed: Column, scheduled: Column) -> Column:
    """Whole seconds, rounded half away from zero."""
    return F.round(secs_between(scheduled, observed)).cast("int")


def join_status() -> Column:
    return (
        F.when(F.col("observation_key_row_count") > 1, DUPLICATE)
        .when(F.col("route_id").isNotNull(), MATCHED)
        .when(F.col("scheduled_trip_service_date_count") == 0, NO_TRIP_DAY)
        .when(F.col("scheduled_trip_service_sequence_count") == 0, NO_SEQUENCE)
        .otherwise(NO_STOP)
    )


def join_audit(
    observations: DataFrame,
    trips: DataFrame,
    dates: DataFrame,
    stop_times: DataFrame,
    tz: str = LOCAL_TZ,
) -> DataFrame:
    """One row per observation with its schedule facts, aligned time, delay and status."""
    joined = exact_observed_join(observations, trip_days(trips, dates), stop_times)
    timed = joined.withColumns(
        {
            "scheduled_arrival_ts": scheduled_ts("scheduled_arrival_time_secs", tz),
            "scheduled_departure_ts": scheduled_ts("scheduled_departure_time_secs", tz),
        }
    ).withColumn(
        "observed_arrival_ts",
        nearest_day_alignment(F.col("observed_arrival_ts"), F.col("scheduled_arrival_ts")),
    )
    return timed.select(
        "service_date", "trip_id", "route_id", "service_id",
        F.col("stop_id").alias("observed_stop_id"),
        "scheduled_stop_id", "stop_sequence", "trip_headsign", "direction_id", "shape_id",
        "shape_dist_traveled", "scheduled_arrival_time_text",
        "scheduled_departure_time_text", "scheduled_arrival_time_secs",
        "scheduled_departure_time_secs", "scheduled_arrival_ts", "scheduled_departure_ts",
        "observed_arrival_time", "observed_arrival_ts",
        arrival_delay_secs(F.col("observed_arrival_ts"), F.col("scheduled_arrival_ts")).alias(
            "arrival_delay_secs"
        ),
        *[F.col(c).alias(f"observed_{c}") for c in METADATA_COLUMNS],
        *[f"scheduled_{c}" for c in LINEAGE_COLUMNS],
        "observation_key_row_count", "scheduled_trip_service_date_count",
        "scheduled_trip_service_sequence_count",
        join_status().alias("join_status"),
    )


def join_summary(audit: DataFrame) -> DataFrame:
    return audit.groupBy("observed_snapshot_label", "join_status").agg(
        F.count("*").alias("row_count")
    )


def observed_stop_events(audit: DataFrame) -> DataFrame:
    return (
        audit.filter(F.col("join_status") == MATCHED)
        .withColumnRenamed("observed_stop_id", "stop_id")
        .drop(
            "join_status", "observation_key_row_count", "scheduled_trip_service_date_count",
            "scheduled_trip_service_sequence_count",
        )
    )
