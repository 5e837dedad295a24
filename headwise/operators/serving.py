"""Map layers: marts joined with geometry."""

from pyspark.sql import DataFrame

from headwise.functions.columns import join_on
from headwise.functions.linework import line_union_merge
from headwise.operators.marts import SEGMENT
from headwise.schemas import METADATA_COLUMNS


def route_map_layer(window_summary: DataFrame, geometries: DataFrame, cut=None) -> DataFrame:
    """Routes without geometry drop out. `geom` is a list of lines. `cut` as in `line_union_merge`."""
    counts = [c for c in window_summary.columns if c.endswith("_count")]
    return window_summary.drop(*counts).join(line_union_merge(geometries, cut=cut), "route_id")


def route_segment_layer(segment_metrics: DataFrame, segments: DataFrame) -> DataFrame:
    plain = [c for c in SEGMENT if c != "direction_id"]
    return join_on(segment_metrics, segments.select(*SEGMENT, "geom"), plain, ["direction_id"])


def stop_map_layer(points: DataFrame) -> DataFrame:
    return points.select("stop_id", "stop_name", "stop_lat", "stop_lon", "geom")


def stop_wait_hotspots(stop_waits: DataFrame, points: DataFrame) -> DataFrame:
    return stop_waits.join(points.select("stop_id", "geom"), "stop_id")


def transit_only_lane_overlay(overlays: DataFrame) -> DataFrame:
    return overlays.select(
        "overlay_id", "street_name", "segment_name", "route_hint", "geom", *METADATA_COLUMNS
    )
