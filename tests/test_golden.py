"""Published figures of the two-direction and two-route feeds."""

import pytest
from pyspark.sql import functions as F

from feeds import (
    INBOUND, NORTH, OBSERVED, OBSERVED_49, OUTBOUND, STOPS, STRAYS, publication, rows,
    two_route_publication,
)
from headwise.functions.geometry import line_valid, lines_near
from headwise.operators import marts, reads
from headwise.sources.store import Stage


@pytest.fixture(scope="module")
def one_route(spark):
    return publication(
        spark, [INBOUND, OUTBOUND], STOPS, OBSERVED, STRAYS, Stage(spark)
    )


@pytest.fixture(scope="module")
def two_routes(spark):
    return two_route_publication(spark, Stage(spark))


def test_route_summary_figures(one_route):
    got = rows(
        one_route.route_window_summary, "route_id", "window_key", "typical_trip_loss_minutes",
        "waiting_loss_minutes", "in_vehicle_loss_minutes", "worst_stop_wait_label",
        "worst_segment_label", *marts.COUNTS,
    )
    assert got == [
        ("14", "all_day", 2.329804, 0.829804, 1.5, "Gamma (Outbound)", "Beta -> Alpha", 18, 1, 4, 6)
    ]


def test_direction_and_hour_figures(one_route):
    figures = ["typical_trip_loss_minutes", "waiting_loss_minutes", "in_vehicle_loss_minutes"]
    assert sorted(rows(one_route.route_direction_summary, "direction_id", *figures)) == [
        (0, 1.153846, 0.153846, 1.0),
        (1, 3.5, 1.5, 2.0),
    ]
    assert sorted(rows(one_route.route_hour_summary, "direction_id", "hour_local", *figures)) == [
        (0, 8, 1.153846, 0.153846, 1.0),
        (1, 9, 3.5, 1.5, 2.0),
    ]
    assert sorted(rows(one_route.route_direction_summary, "direction_id", "worst_segment_label")) == [
        (0, "Beta -> Gamma"),
        (1, "Beta -> Alpha"),
    ]


def test_join_statuses(one_route):
    assert dict(rows(one_route.join_summary, "join_status", "row_count")) == {
        "matched_exact": 18, "unmatched_stop_id": 1, "unmatched_trip_service_date": 1,
    }


def test_stop_waits_and_segments(one_route):
    assert sorted(
        rows(
            one_route.stop_wait_metrics, "stop_id", "scheduled_effective_wait_minutes",
            "observed_effective_wait_minutes", "waiting_loss_minutes",
        )
    ) == [("A", 6.5, 6.653846, 0.153846), ("C", 6.0, 7.5, 1.5)]
    assert sorted(
        rows(
            one_route.route_segment_metrics, "direction_id", "segment_sequence",
            "segment_label", "segment_in_vehicle_loss_minutes", "matched_trip_segment_count",
        )
    ) == [
        (0, 1, "Alpha -> Beta", 0.0, 3),
        (0, 2, "Beta -> Gamma", 1.0, 3),
        (1, 1, "Gamma -> Beta", 1.0, 3),
        (1, 2, "Beta -> Alpha", 2.0, 3),
    ]


def test_layers_and_overlay(one_route):
    layer = one_route.route_segment_layer
    assert layer.count() == 4
    assert layer.filter(~line_valid(F.col("geom"))).isEmpty()
    overlay = one_route.transit_only_lane_overlay
    assert overlay.count() == 2
    near = lines_near(layer, overlay, 25.0, ["direction_id", "segment_sequence"])
    assert near.count() == 4
    (geom,) = rows(one_route.route_map_layer, "geom")[0]
    assert len(geom) == 1 and len(geom[0]) == 3


def test_rankings_and_bands(two_routes):
    ranked = reads.rankings(two_routes.route_window_summary, two_routes.route_hour_summary)
    assert rows(ranked, "rank", "route_id", "typical_trip_loss_minutes", "worst_time_band") == [
        (1, "14", 2.329804, "09:00-09:59"),
        (2, "49", 1.041667, "07:00-07:59"),
    ]


def test_compare_and_map(two_routes):
    summary, hours = two_routes.route_window_summary, two_routes.route_hour_summary
    both = reads.compare(summary, hours, "49,14")
    assert rows(both, "route_id", "worst_segment_label", "worst_stop_wait_label") == [
        ("49", "Epsilon -> Zeta", "Delta (Downtown)"),
        ("14", "Beta -> Alpha", "Gamma (Outbound)"),
    ]
    assert reads.compare(summary, hours, ["14", "nope"]).isEmpty()
    shown = reads.map_routes(
        two_routes.route_map_layer, summary, hours, metric="waiting_loss_minutes"
    )
    got = rows(shown, "route_id", "metric_value", "geometry_json")
    assert [r[:2] for r in got] == [("14", 0.829804), ("49", 0.041667)]
    assert got[0][2].startswith('{"type":"LineString","coordinates":[[-122.4')


def test_route_detail(two_routes):
    args = (
        two_routes.route_window_summary, two_routes.route_direction_summary,
        two_routes.route_hour_summary,
    )
    assert rows(reads.route_summary(*args, "14"), "worst_time_band", "worst_segment_label") == [
        ("09:00-09:59", "Beta -> Alpha")
    ]
    assert rows(
        reads.route_summary(*args, "14", direction=1),
        "direction_label", "worst_time_band", "typical_trip_loss_minutes",
    ) == [("Outbound", "09:00-09:59", 3.5)]
    segments = reads.route_segments(two_routes.route_segment_layer, "14", 1)
    assert rows(segments, "segment_label", "segment_in_vehicle_loss_minutes")[1] == (
        "Beta -> Alpha", 2.0,
    )
    stops = reads.route_stop_wait(two_routes.stop_wait_hotspots, "14", 1)
    assert rows(stops, "stop_wait_label", "waiting_loss_minutes", "stop_wait_strategy") == [
        ("Gamma (Outbound)", 1.5, "first_stop_exact_match")
    ]


def test_bad_requests_and_missing_rows(two_routes):
    summary, hours = two_routes.route_window_summary, two_routes.route_hour_summary
    with pytest.raises(ValueError):
        reads.rankings(summary, hours, metric="bunching_rate")
    with pytest.raises(ValueError, match="2 to 4"):
        reads.compare(summary, hours, "14")
    with pytest.raises(ValueError, match="twice"):
        reads.compare(summary, hours, "14,14")
    unknown = reads.route_summary(summary, two_routes.route_direction_summary, hours, "999")
    with pytest.raises(reads.NotFound):
        reads.found(unknown, "No summary found for route_id=999")
    assert reads.route_segments(two_routes.route_segment_layer, "49", 1).isEmpty()
    assert reads.route_stop_wait(two_routes.stop_wait_hotspots, "49", 1).isEmpty()


def test_lazy_and_staged_plans_agree(spark, two_routes):
    lazy = two_route_publication(spark)
    for name in ("stop_wait_metrics",):
        left = getattr(lazy, name).drop("metric_updated_at")
        right = getattr(two_routes, name).select(*left.columns)
        assert left.exceptAll(right).isEmpty() and right.exceptAll(left).isEmpty()
