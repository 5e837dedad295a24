"""Data checks: each returns the offending rows; the report counts them."""

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from headwise.schemas import UNIQUE_KEYS

# Columns that must be filled, and child keys that must exist in a parent.
NOT_NULL = {
    "scheduled_routes": ["route_id"],
    "scheduled_stops": ["stop_id"],
    "scheduled_trips": ["trip_id", "route_id", "service_id"],
    "service_dates": ["service_id", "service_date"],
    "scheduled_stop_events": [
        "trip_id", "route_id", "service_id", "service_date", "stop_id", "stop_sequence",
    ],
    "observed_stop_events": [
        "service_date", "trip_id", "route_id", "service_id", "stop_id", "stop_sequence",
    ],
    "stop_points": ["stop_id"],
    "route_geometries": ["route_id", "shape_id"],
    "route_stop_segments": ["route_id", "from_stop_id", "to_stop_id", "segment_label"],
    "route_window_summary": ["route_id", "window_key"],
    "route_direction_summary": ["route_id", "window_key"],
    "route_hour_summary": ["route_id", "hour_local"],
    "route_segment_metrics": [
        "route_id", "window_key", "from_stop_id", "to_stop_id", "segment_strategy",
    ],
    "stop_wait_metrics": ["route_id", "stop_id", "window_key", "stop_wait_strategy"],
    "route_map_layer": ["route_id"],
    "route_segment_layer": ["route_id", "segment_label"],
    "stop_map_layer": ["stop_id"],
    "stop_wait_hotspots": ["route_id", "stop_id", "stop_wait_strategy"],
    "transit_only_lane_overlay": ["overlay_id"],
}
_ROUTE = ("scheduled_routes", "route_id")
_TRIP = ("scheduled_trips", "trip_id")
_STOP = ("scheduled_stops", "stop_id")
_POINT = ("stop_points", "stop_id")
RELATIONSHIPS = [
    ("scheduled_trips", "route_id", *_ROUTE),
    ("scheduled_stop_events", "trip_id", *_TRIP),
    ("scheduled_stop_events", "route_id", *_ROUTE),
    ("scheduled_stop_events", "stop_id", *_STOP),
    ("observed_stop_events", "trip_id", *_TRIP),
    ("observed_stop_events", "route_id", *_ROUTE),
    ("observed_stop_events", "stop_id", *_STOP),
    ("stop_points", "stop_id", *_STOP),
    ("route_geometries", "route_id", *_ROUTE),
    ("route_stop_segments", "route_id", *_ROUTE),
    ("route_stop_segments", "from_stop_id", *_POINT),
    ("route_stop_segments", "to_stop_id", *_POINT),
    ("route_window_summary", "route_id", *_ROUTE),
    ("route_direction_summary", "route_id", *_ROUTE),
    ("route_hour_summary", "route_id", *_ROUTE),
    ("route_segment_metrics", "route_id", *_ROUTE),
    ("route_segment_metrics", "from_stop_id", *_STOP),
    ("route_segment_metrics", "to_stop_id", *_STOP),
    ("stop_wait_metrics", "route_id", *_ROUTE),
    ("stop_wait_metrics", "stop_id", *_STOP),
]


def dq_unique_combination(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.groupBy(*columns).agg(F.count("*").alias("row_count")).filter("row_count > 1")


def dq_unique(df: DataFrame, column: str) -> DataFrame:
    return dq_unique_combination(df.filter(F.col(column).isNotNull()), [column])


def dq_not_null(df: DataFrame, column: str) -> DataFrame:
    return df.filter(F.col(column).isNull())


def dq_relationships(child: DataFrame, column: str, parent: DataFrame, parent_column: str) -> DataFrame:
    """Child keys missing in the parent, each once, with the number of child rows."""
    keys = (
        child.filter(F.col(column).isNotNull())
        .groupBy(F.col(column).alias("missing_key"))
        .agg(F.count("*").alias("row_count"))
    )
    return keys.join(
        parent.select(F.col(parent_column).alias("missing_key")), "missing_key", "left_anti"
    )


def dq_report(relations: dict[str, DataFrame]) -> DataFrame:
    """Failure count of every declared check whose relations are given."""

    def counted(failures: DataFrame, check: str, relation: str, columns: list[str]) -> DataFrame:
        return failures.agg(F.count("*").alias("failure_count")).select(
            F.lit(check).alias("check_name"), F.lit(relation).alias("relation"),
            F.lit(",".join(columns)).alias("checked_columns"), "failure_count",
        )

    checks = [
        counted(dq_unique_combination(relations[name], keys), "unique", name, keys)
        for name, keys in UNIQUE_KEYS.items() if name in relations
    ]
    for name, columns in NOT_NULL.items():
        if name in relations:
            # All columns of a relation in one pass.
            nulls = relations[name].agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
            pairs = F.explode(F.array(*[
                F.struct(F.lit(c).alias("checked_columns"), F.col(c).alias("failure_count"))
                for c in columns
            ]))
            checks.append(
                nulls.select(pairs.alias("p")).select(
                    F.lit("not_null").alias("check_name"), F.lit(name).alias("relation"),
                    "p.checked_columns", "p.failure_count",
                )
            )
    for child, column, parent, parent_column in RELATIONSHIPS:
        if child in relations and parent in relations:
            failures = dq_relationships(
                relations[child], column, relations[parent], parent_column
            )
            checks.append(counted(failures, f"relationships:{parent}", child, [column]))
    return reduce(DataFrame.unionByName, checks)
