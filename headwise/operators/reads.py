"""Read queries over the marts and layers, as DataFrames."""

import uuid

from pyspark.sql import Column, DataFrame, Window, functions as F

from headwise.functions.columns import WINDOW_KEY, asc_nl, desc_nl, join_on, text
from headwise.functions.geometry import line_geojson, multiline_geojson, point_geojson
from headwise.operators.marts import BY_DIRECTION, BY_ROUTE, COUNTS, LOSSES, top_per_group
from headwise.sources.store import Stage

# What a reader may ask for.
WINDOWS = (WINDOW_KEY,)
METRICS = ("typical_trip_loss_minutes", "waiting_loss_minutes", "in_vehicle_loss_minutes")
MODES = ("routes",)


class NotFound(LookupError):
    """The requested route, direction or set of routes has no rows."""


def _one_of(name: str, value, allowed) -> None:
    if value not in allowed:
        raise ValueError(f"{name} must be one of {', '.join(map(str, allowed))}; got {value!r}")


def found(df: DataFrame, message: str) -> DataFrame:
    if df.isEmpty():
        raise NotFound(message)
    return df


def worst_time_band(hours: DataFrame, keys: list[str] = BY_ROUTE) -> DataFrame:
    order = [desc_nl("typical_trip_loss_minutes"), asc_nl("direction_id"), asc_nl("hour_local")]
    hour = text(F.lpad(F.col("hour_local").cast("string"), 2, "0"))
    band = F.concat(hour, F.lit(":00-"), hour, F.lit(":59"))
    return top_per_group(hours, keys, order, ["hour_local"]).select(
        *keys, band.alias("worst_time_band")
    )


def _with_band(summary: DataFrame, hours: DataFrame) -> DataFrame:
    return summary.join(worst_time_band(hours), "route_id", "left")


def rankings(
    summary: DataFrame,
    hours: DataFrame,
    window: str = WINDOW_KEY,
    metric: str = "typical_trip_loss_minutes",
    mode: str = "routes",
) -> DataFrame:
    """Routes by metric, worst first; routes without the metric come last and are ranked too.

    The rank runs over one row per route, after all aggregation.
    """
    _one_of("window", window, WINDOWS)
    _one_of("metric", metric, METRICS)
    _one_of("mode", mode, MODES)
    rank = F.row_number().over(Window.orderBy(desc_nl(metric), "route_id"))
    rows = _with_band(summary.filter(F.col("window_key") == window), hours)
    return rows.withColumn("rank", rank).orderBy("rank")


def route_summary(
    summary: DataFrame,
    direction_summary: DataFrame,
    hours: DataFrame,
    route_id: str,
    window: str = WINDOW_KEY,
    direction: int | None = None,
) -> DataFrame:
    """One row, or none if the route or direction is unknown (see `found`)."""
    _one_of("window", window, WINDOWS)
    wanted = (F.col("route_id") == route_id) & (F.col("window_key") == window)
    of_route = hours.filter(F.col("route_id") == route_id)
    if direction is None:
        return _with_band(summary.filter(wanted), of_route)
    _one_of("direction", direction, (0, 1))
    rows = direction_summary.filter(wanted & (F.col("direction_id") == direction))
    return join_on(
        rows, worst_time_band(of_route, BY_DIRECTION), ["route_id"], ["direction_id"], "left"
    )


def _directional(layer: DataFrame, route_id: str, window: str, direction: int) -> DataFrame:
    _one_of("window", window, WINDOWS)
    _one_of("direction", direction, (0, 1))
    return layer.filter(
        (F.col("route_id") == route_id)
        & (F.col("window_key") == window)
        & (F.col("direction_id") == direction)
    )


def route_segments(
    segment_layer: DataFrame, route_id: str, direction: int, window: str = WINDOW_KEY
) -> DataFrame:
    rows = _directional(segment_layer, route_id, window, direction)
    return rows.withColumn("geometry_json", line_geojson(F.col("geom"))).orderBy(
        asc_nl("segment_sequence"), asc_nl("shape_id"), asc_nl("to_stop_id")
    )


def route_stop_wait(
    hotspots: DataFrame, route_id: str, direction: int, window: str = WINDOW_KEY
) -> DataFrame:
    rows = _directional(hotspots, route_id, window, direction)
    return rows.withColumn("geometry_json", point_geojson(F.col("geom"))).orderBy(
        desc_nl("waiting_loss_minutes"), asc_nl("stop_id")
    )


def compare_ids(ids: str | list[str]) -> list[str]:
    """Two to four distinct route ids, from a list or a comma-separated text."""
    parts = ids.split(",") if isinstance(ids, str) else ids
    wanted = [p.strip() for p in parts if p.strip()]
    if not 2 <= len(wanted) <= 4:
        raise ValueError("compare needs 2 to 4 route ids")
    if len(set(wanted)) != len(wanted):
        raise ValueError("compare was given a route id twice")
    return wanted


def compare(
    summary: DataFrame, hours: DataFrame, ids: str | list[str], window: str = WINDOW_KEY
) -> DataFrame:
    """The requested routes in the requested order; no rows at all if one is unknown."""
    _one_of("window", window, WINDOWS)
    wanted = compare_ids(ids)
    position = F.array_position(F.array(*[F.lit(i) for i in wanted]), F.col("route_id"))
    rows = summary.filter((F.col("window_key") == window) & F.col("route_id").isin(wanted))
    known = rows.agg(F.count_distinct("route_id").alias("n")).scalar()
    return (
        _with_band(rows, hours.filter(F.col("route_id").isin(wanted)))
        .filter(known == len(wanted))
        .withColumn("position", position)
        .orderBy("position")
    )


def map_routes(
    map_layer: DataFrame,
    summary: DataFrame,
    hours: DataFrame,
    window: str = WINDOW_KEY,
    metric: str = "typical_trip_loss_minutes",
) -> DataFrame:
    _one_of("window", window, WINDOWS)
    _one_of("metric", metric, METRICS)
    counts = summary.select("route_id", "window_key", *COUNTS)
    rows = map_layer.filter(F.col("window_key") == window).join(
        counts, ["route_id", "window_key"]
    )
    return (
        _with_band(rows, hours)
        .withColumns(
            {
                "metric_value": F.col(metric),
                "geometry_json": multiline_geojson(F.col("geom")),
            }
        )
        .orderBy(desc_nl(metric), "route_id")
    )


# --- GeoJSON responses -----------------------------------------------------------------

_NAMES = ("route_id", "route_name", "route_short_name", "route_long_name")
_HEADER = (*_NAMES, "window", "direction_id", "direction_label")
# The members of each response and of its features, in order.
RESPONSES = {
    "segments": {
        "keys": ("route_id", "direction_id", "window"),
        "header": _HEADER,
        "properties": (
            *_HEADER, "shape_id", "segment_strategy", "segment_sequence", "from_stop_id", "from_stop_name",
            "to_stop_id", "to_stop_name", "segment_label", "scheduled_segment_minutes",
            "segment_in_vehicle_loss_minutes", "matched_trip_segment_count", "metric_updated_at",
        ),
    },
    "stop_wait": {
        "keys": ("route_id", "direction_id", "window"),
        "header": _HEADER,
        "properties": (
            *_HEADER, "stop_id", "stop_name", "stop_wait_label", "stop_wait_strategy",
            "scheduled_effective_wait_minutes", "observed_effective_wait_minutes", "waiting_loss_minutes",
            "matched_headway_interval_count", "metric_updated_at",
        ),
    },
    "map": {
        "keys": ("window", "metric"),
        "header": ("window", "metric"),
        "properties": (
            *_NAMES, "window", "direction_id", "direction_label", *METRICS, "worst_time_band",
            "worst_stop_wait_label", "worst_segment_label", *COUNTS, "metric_updated_at", "metric",
            "metric_value",
        ),
    },
}


def _json(columns: list[str]) -> Column:
    """A JSON object of the columns; NULL members are left out."""
    return F.to_json(F.struct(*[F.col(c) for c in columns]))


def _ascending(c: str) -> Column:
    return F.struct(F.col(c).isNull(), F.col(c))


def _descending(c: str) -> Column:
    return F.struct(F.col(c).isNull(), -F.col(c))


def _features(rows: DataFrame, kind: str, geometry_json: Column, order: list[Column]) -> DataFrame:
    named = rows.withColumnRenamed("window_key", "window")
    held = [c for c in RESPONSES[kind]["properties"] if c in named.columns]
    feature = F.concat(
        F.lit('{"type":"Feature","geometry":'), geometry_json, F.lit(',"properties":'), _json(held), F.lit("}")
    )
    at = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])
    return named.withColumns({"_order": at, "feature": feature})


def segment_features(segment_layer: DataFrame) -> DataFrame:
    """The rows of the segment layer with a `feature` text each and `_order`, their order
    within a route, direction and window."""
    order = [_ascending("segment_sequence"), _ascending("shape_id"), _ascending("to_stop_id")]
    return _features(segment_layer, "segments", line_geojson(F.col("geom")), order)


def stop_wait_features(hotspots: DataFrame) -> DataFrame:
    """The same for waiting at stops, the worst first."""
    order = [_descending("waiting_loss_minutes"), _ascending("stop_id")]
    return _features(hotspots, "stop_wait", point_geojson(F.col("geom")), order)


def map_features(rows: DataFrame, metric: str = "typical_trip_loss_minutes") -> DataFrame:
    """The same for the rows of `map_routes`, by the metric they were read with."""
    order = [_descending("metric_value"), _ascending("route_id")]
    return _features(rows.withColumn("metric", F.lit(metric)), "map", F.col("geometry_json"), order)


def feature_lines(features: DataFrame, kind: str, cut=None) -> DataFrame:
    """One row per feature with its place in the response: the keys of the kind, `position` (from
    1), `feature_count` and `feature`. For responses that are too large for one cell, such as
    the map of a large network; written as text lines in order of `position` they are the
    members of the collection.

    All features are sorted by range over the tasks; a place is the one in the part plus what
    earlier parts hold of the key. Only these counts are looked at together.
    """
    keys = list(RESPONSES[kind]["keys"])
    stage = cut or Stage(features.sparkSession)
    parts = int(features.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [*keys, "_order"]
    ranged = features.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    numbered = ranged.select(*order, "feature", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_place"))
    placed = stage(f"features-{uuid.uuid4().hex}", numbered)
    counts = placed.groupBy(*keys, "_part").agg(F.count("*").alias("_n"), F.min("_place").alias("_first"))
    by_key = Window.partitionBy(*keys)
    earlier = by_key.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.withColumns(
        {"_shift": F.coalesce(F.sum("_n").over(earlier), F.lit(0)), "feature_count": F.sum("_n").over(by_key)}
    ).drop("_n")
    return join_on(placed, shifts, ["_part"], keys).select(
        *keys, (F.col("_shift") + F.col("_place") - F.col("_first") + 1).alias("position"), "feature_count", "feature"
    )


def feature_collection(features: DataFrame, kind: str) -> DataFrame:
    """One response text per key of the kind: its header, then all features in order.

    A collection is one cell: the segments or stops of one route, direction and window, or
    the routes of one map. See `feature_lines` where that is too much.
    """
    shape = RESPONSES[kind]
    keys = list(shape["keys"])
    header = [c for c in shape["header"] if c in features.columns]
    stamped = ["metric_updated_at"] if "metric_updated_at" in features.columns and kind != "map" else []
    # Header members come from the first feature.
    listed = features.groupBy(*keys).agg(
        F.array_sort(
            F.collect_list(F.struct("_order", "feature", _json(header).alias("header"), *stamped))
        ).alias("listed")
    )
    first = F.col("listed")[0]
    head = F.concat(
        F.expr("left(listed[0].header, length(listed[0].header) - 1)"),
        F.lit(',"type":"FeatureCollection","features":['),
        F.array_join(F.transform("listed", lambda x: x["feature"]), ","), F.lit("]"),
    )
    if stamped:
        stamp = F.to_json(F.struct(first["metric_updated_at"].alias("metric_updated_at")))
        head = F.concat(head, F.lit(","), F.substring(stamp, 2, 1000))
    else:
        head = F.concat(head, F.lit("}"))
    return listed.select(*keys, F.size("listed").alias("feature_count"), head.alias("collection"))
