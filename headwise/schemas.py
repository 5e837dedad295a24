"""Declared columns of the raw tables. Nothing is inferred from the data."""

from pyspark.sql import types as T

# The columns each schedule file must carry, in file order.
FEED_COLUMNS = {
    "routes": [
        "route_id", "agency_id", "route_short_name", "route_long_name",
        "route_type", "route_color", "route_text_color",
    ],
    "trips": [
        "route_id", "service_id", "trip_id", "trip_headsign", "direction_id", "shape_id",
    ],
    "stops": ["stop_id", "stop_name", "stop_lat", "stop_lon"],
    "stop_times": [
        "trip_id", "arrival_time", "departure_time", "stop_id", "stop_sequence",
        "shape_dist_traveled",
    ],
    "shapes": [
        "shape_id", "shape_pt_lat", "shape_pt_lon", "shape_pt_sequence",
        "shape_dist_traveled",
    ],
    "calendar": [
        "service_id", "monday", "tuesday", "wednesday", "thursday", "friday",
        "saturday", "sunday", "start_date", "end_date",
    ],
    "calendar_dates": ["service_id", "date", "exception_type"],
}
OPTIONAL_FEED_TABLES = ("calendar", "calendar_dates")
WEEKDAYS = FEED_COLUMNS["calendar"][1:8]

# Columns of the two observation file layouts.
OBSERVATION_ISO_COLUMNS = [
    "service_date", "trip_id", "stop_id", "stop_sequence", "observed_arrival_time",
]
OBSERVATION_ARCHIVE_COLUMNS = [
    "service_date", "trip_id", "stop_sequence", "to_stop_id", "observed_arrival_time",
]

# What is kept of every load, and the columns of observations and overlays.
METADATA_COLUMNS = [
    "source_system", "feed_scope", "operator_id", "snapshot_label", "ingested_at",
]
# What staged and canonical relations keep of the metadata.
LINEAGE_COLUMNS = METADATA_COLUMNS[:4]

METADATA_FIELDS = [
    T.StructField(name, T.TimestampType() if name == "ingested_at" else T.StringType())
    for name in METADATA_COLUMNS
]


def feed_schema(table: str) -> T.StructType:
    """All business columns of a schedule file are text, as they arrive."""
    return T.StructType(
        [T.StructField(c, T.StringType()) for c in FEED_COLUMNS[table]] + METADATA_FIELDS
    )


OBSERVATION_SCHEMA = T.StructType(
    [
        T.StructField("service_date", T.DateType()),
        T.StructField("trip_id", T.StringType()),
        T.StructField("stop_id", T.StringType()),
        T.StructField("stop_sequence", T.IntegerType()),
        T.StructField("observed_arrival_time", T.StringType()),
        T.StructField("observed_arrival_ts", T.TimestampType()),
    ]
    + METADATA_FIELDS
)

OVERLAY_SCHEMA = T.StructType(
    [
        T.StructField(c, T.StringType())
        for c in ("overlay_id", "street_name", "segment_name", "route_hint", "geom_geojson")
    ]
    + METADATA_FIELDS
)

RAW_SCHEMAS = {
    **{table: feed_schema(table) for table in FEED_COLUMNS},
    "stop_observations": OBSERVATION_SCHEMA,
    "lane_overlays": OVERLAY_SCHEMA,
}

POINT = T.StructType(
    [T.StructField("lon", T.DoubleType()), T.StructField("lat", T.DoubleType())]
)
LINE = T.ArrayType(POINT)
MULTILINE = T.ArrayType(LINE)

# Columns that must identify one row; the quality report checks each of them.
UNIQUE_KEYS = {
    "scheduled_routes": ["route_id"],
    "scheduled_stops": ["stop_id"],
    "scheduled_trips": ["trip_id"],
    "service_dates": ["service_id", "service_date"],
    "scheduled_stop_events": ["trip_id", "service_date", "stop_sequence"],
    "observed_stop_events": ["service_date", "trip_id", "stop_id", "stop_sequence"],
    "stop_points": ["stop_id"],
    "route_geometries": ["route_id", "direction_id", "shape_id"],
    "route_stop_segments": ["route_id", "direction_id", "shape_id", "segment_sequence"],
    "route_window_summary": ["route_id", "window_key"],
    "route_direction_summary": ["route_id", "direction_id", "window_key"],
    "route_hour_summary": ["route_id", "direction_id", "hour_local"],
    "route_segment_metrics": [
        "route_id", "direction_id", "shape_id", "segment_sequence", "window_key",
    ],
    "stop_wait_metrics": ["route_id", "direction_id", "stop_id", "window_key"],
    "route_map_layer": ["route_id"],
    "stop_map_layer": ["stop_id"],
    "transit_only_lane_overlay": ["overlay_id"],
    "route_segment_layer": [
        "route_id", "direction_id", "shape_id", "segment_sequence", "window_key",
    ],
    "stop_wait_hotspots": ["route_id", "direction_id", "stop_id", "window_key"],
}
