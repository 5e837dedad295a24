"""The whole graph from raw tables to serving layers."""

from functools import cached_property

from pyspark.sql import DataFrame, functions as F

from headwise.functions.columns import LOCAL_TZ
from headwise.operators import (
    marts, observed, schedule, serving, spatial, trips as trip_ops,
)
from headwise.operators.staging import FeedChoice, ObservedChoice, Staging
from headwise.sources.store import Stage, lazily, mart_write


class Publication:
    """Relations by name, each built on first use from the ones it needs.

    With a `Stage` as `cut`, the relations that feed several others are written once and
    read back; by default everything stays one lazy plan.
    """

    def __init__(
        self,
        raw: dict[str, DataFrame],
        feed: FeedChoice = FeedChoice(),
        observations: ObservedChoice = ObservedChoice(),
        tz: str = LOCAL_TZ,
        cut=lazily,
    ):
        self.staging = Staging(raw, feed, observations)
        self.tz, self.cut = tz, cut

    def _by_trip(self, name: str, build, *relations: DataFrame) -> DataFrame:
        """`build(*relations)`, whose rows depend on rows of their own trip id only, cut: a
        `Stage` takes it in slices of trips, which bounds the shuffle files."""
        if isinstance(self.cut, Stage):
            return self.cut.sliced(name, build, "trip_id", *relations)
        return self.cut(name, build(*relations))

    # staging
    @cached_property
    def stop_times(self) -> DataFrame:
        return self.cut("stop_times", self.staging.stop_times())

    @cached_property
    def shapes(self) -> DataFrame:
        return self.staging.shapes()

    @cached_property
    def stop_observations(self) -> DataFrame:
        return self.cut("stop_observations", self.staging.stop_observations())

    @cached_property
    def lane_overlays(self) -> DataFrame:
        return self.staging.lane_overlays()

    # canonical
    @cached_property
    def scheduled_routes(self) -> DataFrame:
        return self.cut("scheduled_routes", schedule.scheduled_routes(self.staging.routes()))

    @cached_property
    def scheduled_stops(self) -> DataFrame:
        return self.cut("scheduled_stops", schedule.scheduled_stops(self.staging.stops()))

    @cached_property
    def scheduled_trips(self) -> DataFrame:
        return self.cut("scheduled_trips", schedule.scheduled_trips(self.staging.trips()))

    @cached_property
    def service_dates(self) -> DataFrame:
        return self.cut("service_dates", schedule.service_dates(self.staging.service_dates()))

    @cached_property
    def scheduled_stop_events(self) -> DataFrame:
        return schedule.scheduled_stop_events(
            self.scheduled_trips, self.service_dates, self.stop_times
        )

    @cached_property
    def join_audit(self) -> DataFrame:
        return self._by_trip(
            "join_audit",
            lambda seen, trips, times: observed.join_audit(seen, trips, self.service_dates, times, self.tz),
            self.stop_observations, self.scheduled_trips, self.stop_times,
        )

    @cached_property
    def join_summary(self) -> DataFrame:
        return observed.join_summary(self.join_audit)

    @cached_property
    def observed_stop_events(self) -> DataFrame:
        return observed.observed_stop_events(self.join_audit)

    @cached_property
    def stop_points(self) -> DataFrame:
        return spatial.stop_points(self.scheduled_stops)

    @cached_property
    def route_geometries(self) -> DataFrame:
        return self.cut(
            "route_geometries", spatial.route_geometries(self.scheduled_trips, self.shapes)
        )

    @cached_property
    def route_stop_segments(self) -> DataFrame:
        return self.cut(
            "route_stop_segments",
            spatial.route_stop_segments(
                self.scheduled_trips, self.stop_times, self.scheduled_stops,
                self.route_geometries, self.stop_points,
            ),
        )

    # trip level
    @cached_property
    def trip_terminals(self) -> DataFrame:
        return self.cut(
            "trip_terminals",
            trip_ops.trip_terminals(
                self.scheduled_trips, self.service_dates, self.stop_times, self.tz, self.cut,
            ),
        )

    @cached_property
    def observed_terminals(self) -> DataFrame:
        return self.cut(
            "observed_terminals",
            trip_ops.observed_terminals(self.trip_terminals, self.observed_stop_events),
        )

    @cached_property
    def full_trip_metrics(self) -> DataFrame:
        return trip_ops.full_trip_metrics(self.observed_terminals)

    @cached_property
    def matched_first_stop_events(self) -> DataFrame:
        return trip_ops.matched_first_stop_events(self.observed_terminals)

    @cached_property
    def headway_intervals(self) -> DataFrame:
        return trip_ops.headway_intervals(self.matched_first_stop_events, self.tz)

    @cached_property
    def matched_coverage_rows(self) -> DataFrame:
        return trip_ops.matched_coverage_rows(self.observed_stop_events, self.tz)

    @cached_property
    def unmatched_resolved(self) -> DataFrame:
        return trip_ops.unmatched_resolved(self.join_audit, self.scheduled_trips, self.tz)

    @cached_property
    def direction_labels(self) -> DataFrame:
        return schedule.direction_labels(self.scheduled_trips)

    # bases and marts
    @cached_property
    def headway_sums(self) -> DataFrame:
        return self.cut("headway_sums", marts.headway_sums(self.headway_intervals))

    @cached_property
    def loss_histogram(self) -> DataFrame:
        return marts.loss_histogram(self.full_trip_metrics)

    @cached_property
    def matched_counts(self) -> DataFrame:
        return marts.hourly_counts(self.matched_coverage_rows)

    @cached_property
    def unmatched_counts(self) -> DataFrame:
        return trip_ops.unmatched_counts(self.join_audit, self.scheduled_trips, self.tz)

    @cached_property
    def loss_parts(self) -> DataFrame:
        return self.cut(
            "loss_parts",
            marts.loss_parts(
                self.headway_sums, self.loss_histogram, self.matched_counts, self.unmatched_counts
            ),
        )

    @cached_property
    def observed_segment_pairs(self) -> DataFrame:
        return marts.observed_segment_pairs(self.observed_stop_events)

    @cached_property
    def trip_segment_metrics(self) -> DataFrame:
        return marts.trip_segment_metrics(self.observed_segment_pairs)

    @cached_property
    def route_segment_metrics(self) -> DataFrame:
        return self.cut(
            "route_segment_metrics",
            marts.route_segment_metrics(
                self.route_stop_segments, self.scheduled_routes, self.trip_segment_metrics
            ),
        )

    @cached_property
    def stop_wait_metrics(self) -> DataFrame:
        return self.cut(
            "stop_wait_metrics",
            marts.stop_wait_metrics(
                self.headway_sums, self.scheduled_routes, self.scheduled_stops,
                self.direction_labels,
            ),
        )

    @cached_property
    def route_window_summary(self) -> DataFrame:
        return self.cut(
            "route_window_summary",
            marts.route_window_summary(
                self.loss_parts, self.scheduled_routes, self.stop_wait_metrics,
                self.route_segment_metrics,
            ),
        )

    @cached_property
    def route_direction_summary(self) -> DataFrame:
        return self.cut(
            "route_direction_summary",
            marts.route_direction_summary(
                self.loss_parts, self.scheduled_routes, self.direction_labels,
                self.stop_wait_metrics, self.route_segment_metrics,
            ),
        )

    @cached_property
    def route_hour_summary(self) -> DataFrame:
        return self.cut(
            "route_hour_summary",
            marts.route_hour_summary(
                self.loss_parts, self.scheduled_routes, self.direction_labels
            ),
        )

    # serving
    @cached_property
    def route_map_layer(self) -> DataFrame:
        return self.cut(
            "route_map_layer",
            serving.route_map_layer(
                self.route_window_summary, self.route_geometries,
                None if self.cut is lazily else self.cut,
            ),
        )

    @cached_property
    def route_segment_layer(self) -> DataFrame:
        return self.cut(
            "route_segment_layer",
            serving.route_segment_layer(self.route_segment_metrics, self.route_stop_segments),
        )

    @cached_property
    def stop_map_layer(self) -> DataFrame:
        return self.cut("stop_map_layer", serving.stop_map_layer(self.stop_points))

    @cached_property
    def stop_wait_hotspots(self) -> DataFrame:
        return self.cut(
            "stop_wait_hotspots",
            serving.stop_wait_hotspots(self.stop_wait_metrics, self.stop_points),
        )

    @cached_property
    def transit_only_lane_overlay(self) -> DataFrame:
        return self.cut(
            "transit_only_lane_overlay", serving.transit_only_lane_overlay(self.lane_overlays)
        )


# The named parts of the graph that can be published on their own.
SCHEDULED = ["scheduled_routes", "scheduled_stops", "scheduled_trips", "service_dates",
             "scheduled_stop_events"]
OBSERVED = ["join_audit", "join_summary", "observed_stop_events"]
CORE = ["stop_wait_metrics", "route_segment_metrics", "route_window_summary",
        "route_direction_summary", "route_hour_summary"]
LAYERS = ["route_map_layer", "route_segment_layer", "stop_map_layer", "stop_wait_hotspots"]
OVERLAY = ["transit_only_lane_overlay"]
PARTS = {
    "scheduled": SCHEDULED,
    "observed": OBSERVED,
    "core": CORE,
    "all": [*CORE, *LAYERS, *OVERLAY],
    "all_but_overlay": [*CORE, *LAYERS],
}


# Tables of events, stored by day.
DATED = ("scheduled_stop_events", "join_audit", "observed_stop_events")


def publish(publication: Publication, part: str = "all", target: str | None = None) -> dict[str, DataFrame]:
    """Build a part of the graph; with `target`, write every relation of the part to a folder
    of its name below, events by service date, and go on from there.

    A `Stage` in the publication only keeps what several relations need."""
    out = {}
    for name in PARTS[part]:
        df = getattr(publication, name)
        if target is not None:
            by = ["service_date"] if name in DATED else []
            # Whole days per task where they are small, and several tasks for a large day.
            rows = df.hint("rebalance", *[F.col(c) for c in by]) if by else df
            path = f"{target.rstrip('/')}/{name}"
            mart_write(rows, path, by)
            df = df.sparkSession.read.schema(df.schema).parquet(path)
        out[name] = df
    return out
