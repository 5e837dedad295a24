"""Canonical schedule relations."""

from pyspark.sql import DataFrame, functions as F

from headwise.schemas import LINEAGE_COLUMNS


def scheduled_routes(staged: DataFrame) -> DataFrame:
    return staged.select(
        "route_id", "agency_id", "route_short_name", "route_long_name", "route_type",
        "route_color", "route_text_color", *LINEAGE_COLUMNS,
    )


def scheduled_stops(staged: DataFrame) -> DataFrame:
    return staged.select("stop_id", "stop_name", "stop_lat", "stop_lon", *LINEAGE_COLUMNS)


def scheduled_trips(staged: DataFrame) -> DataFrame:
    return staged.select(
        "trip_id", "route_id", "service_id", "trip_headsign", "direction_id", "shape_id",
        *LINEAGE_COLUMNS,
    )


def service_dates(staged: DataFrame) -> DataFrame:
    return staged.select("service_id", "service_date", *LINEAGE_COLUMNS)


def trip_days(trips: DataFrame, dates: DataFrame) -> DataFrame:
    """Trips by the days they run: the schedule without its stop dimension.

    The metrics work on this relation and on `stop_times` separately. The product of the
    two, `scheduled_stop_events`, is many times larger and only built as an output.
    """
    return trips.join(dates.select("service_id", "service_date"), "service_id")


def scheduled_stop_events(trips: DataFrame, dates: DataFrame, stop_times: DataFrame) -> DataFrame:
    """One row per trip, day and stop."""
    return trip_days(trips, dates).join(stop_times.drop(*LINEAGE_COLUMNS), "trip_id").select(
        "trip_id", "route_id", "service_id", "service_date", "stop_id", "stop_sequence",
        "trip_headsign", "direction_id", "shape_id", "arrival_time_text",
        "departure_time_text", "arrival_time_secs", "departure_time_secs",
        "shape_dist_traveled", *LINEAGE_COLUMNS,
    )


def direction_labels(trips: DataFrame) -> DataFrame:
    return trips.groupBy("route_id", "direction_id").agg(
        F.min("trip_headsign").alias("direction_label")
    )
