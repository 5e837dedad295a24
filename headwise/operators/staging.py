"""Raw text tables to typed, single-snapshot staging relations."""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from headwise.functions.columns import blank_to_null, clock_secs, required, shift_secs, DAY_SECS
from headwise.functions.geometry import geojson_line
from headwise.schemas import LINEAGE_COLUMNS, METADATA_COLUMNS, WEEKDAYS

# Scope names and the agency that the historic scope is cut to.
ACTIVE_SCOPE = "operator_active"
HISTORIC_SCOPE = "regional_historic"
HISTORIC_AGENCY = "SF"
DATED_TRIP_ID = r"^[^:]+:.+:\d{8}$"


@dataclass(frozen=True)
class FeedChoice:
    """Which raw schedule rows to stage. `label=None` means the latest snapshot."""

    scope: str = ACTIVE_SCOPE
    label: str | None = None
    agency: str = HISTORIC_AGENCY

    @property
    def cut_to_agency(self) -> bool:
        return self.scope == HISTORIC_SCOPE


@dataclass(frozen=True)
class ObservedChoice:
    scope: str = HISTORIC_SCOPE
    label: str | None = None
    agency: str = HISTORIC_AGENCY

    @property
    def historic(self) -> bool:
        return self.scope == HISTORIC_SCOPE


def select_snapshot(raw: DataFrame, scope: str | None, label: str | None = None) -> DataFrame:
    """One row: the explicit label, or the latest by load time, then by label.

    Reduced to one row per label before the ordering, so a large table is only scanned
    for two columns.
    """
    if label is not None:
        return raw.sparkSession.range(1).select(F.lit(label).alias("snapshot_label"))
    rows = raw if scope is None else raw.filter(F.col("feed_scope") == scope)
    return (
        rows.groupBy("snapshot_label")
        .agg(F.max("ingested_at").alias("ingested_at"))
        .orderBy(F.desc("ingested_at"), F.desc("snapshot_label"))
        .limit(1)
        .select("snapshot_label")
    )


def in_snapshot(
    raw: DataFrame, scope: str | None, label: str | None, labels_from: DataFrame
) -> DataFrame:
    """Rows of the scope and snapshot. The latest label is a scalar subquery in the plan, by
    which the scan prunes the partitions of stored tables."""
    rows = raw if scope is None else raw.filter(F.col("feed_scope") == scope)
    if label is not None:
        return rows.filter(F.col("snapshot_label") == label)
    return rows.filter(F.col("snapshot_label") == select_snapshot(labels_from, scope).scalar())


def _lineage() -> list[Column]:
    return [
        blank_to_null(c).alias(c) if c == "operator_id" else F.col(c) for c in LINEAGE_COLUMNS
    ]


def _blank(*names: str) -> list[Column]:
    return [blank_to_null(c).alias(c) for c in names]


def _typed(name: str, kind: str) -> Column:
    return blank_to_null(name).cast(kind).alias(name)


class Staging:
    """Staging relations over one set of raw tables.

    `raw` maps table names to DataFrames: the seven schedule tables, and optionally
    `stop_observations` and `lane_overlays`. `<table>_snapshots` may hold the snapshots of a
    table (see `raw_snapshots`); the latest one is then chosen without reading the table.
    """

    def __init__(
        self,
        raw: dict[str, DataFrame],
        feed: FeedChoice = FeedChoice(),
        observed: ObservedChoice = ObservedChoice(),
    ):
        self.raw, self.feed, self.observed = raw, feed, observed

    def _labels(self, table: str) -> DataFrame:
        return self.raw.get(f"{table}_snapshots", self.raw[table])

    def _rows(self, table: str) -> DataFrame:
        return in_snapshot(self.raw[table], self.feed.scope, self.feed.label, self._labels("routes"))

    def _agency_routes(self) -> DataFrame:
        return self._rows("routes").filter(F.col("agency_id") == self.feed.agency).select("route_id")

    def _agency_trips(self) -> DataFrame:
        trips = self._rows("trips")
        if not self.feed.cut_to_agency:
            return trips
        return trips.join(self._agency_routes(), "route_id", "left_semi")

    def _kept_by(self, rows: DataFrame, parents: DataFrame, key: str) -> DataFrame:
        """Agency cut of a child table; other scopes keep every row."""
        if not self.feed.cut_to_agency:
            return rows
        return rows.join(parents.select(key), key, "left_semi")

    def routes(self) -> DataFrame:
        rows = self._rows("routes")
        if self.feed.cut_to_agency:
            rows = rows.filter(F.col("agency_id") == self.feed.agency)
        return rows.select(
            "route_id",
            *_blank("agency_id", "route_short_name", "route_long_name"),
            _typed("route_type", "int"),
            *_blank("route_color", "route_text_color"),
            *_lineage(),
        ).distinct()

    def trips(self) -> DataFrame:
        return self._agency_trips().select(
            "route_id",
            "service_id",
            "trip_id",
            *_blank("trip_headsign"),
            _typed("direction_id", "int"),
            *_blank("shape_id"),
            *_lineage(),
        ).distinct()

    def stops(self) -> DataFrame:
        rows = self._rows("stops")
        if self.feed.cut_to_agency:
            rows = self._kept_by(rows, self._kept_stop_times(), "stop_id")
        return rows.select(
            "stop_id",
            *_blank("stop_name"),
            _typed("stop_lat", "double"),
            _typed("stop_lon", "double"),
            *_lineage(),
        ).distinct()

    def _kept_stop_times(self) -> DataFrame:
        return self._kept_by(self._rows("stop_times"), self._agency_trips(), "trip_id")

    def stop_times(self) -> DataFrame:
        return self._kept_stop_times().select(
            "trip_id",
            blank_to_null("arrival_time").alias("arrival_time_text"),
            blank_to_null("departure_time").alias("departure_time_text"),
            "stop_id",
            _typed("stop_sequence", "int"),
            _typed("shape_dist_traveled", "double"),
            clock_secs("arrival_time").alias("arrival_time_secs"),
            clock_secs("departure_time").alias("departure_time_secs"),
            *_lineage(),
        )

    def shapes(self) -> DataFrame:
        rows = self._kept_by(
            self._rows("shapes"), self._agency_trips().filter("shape_id <> ''"), "shape_id"
        )
        return rows.select(
            "shape_id",
            _typed("shape_pt_lat", "double"),
            _typed("shape_pt_lon", "double"),
            _typed("shape_pt_sequence", "int"),
            _typed("shape_dist_traveled", "double"),
            *_lineage(),
        )

    def service_dates(self) -> DataFrame:
        """Calendar ranges unfolded to days, plus additions, minus removals (removal wins)."""
        services = self._agency_trips()
        calendar = self._kept_by(self._rows("calendar"), services, "service_id")
        exceptions = self._kept_by(self._rows("calendar_dates"), services, "service_id")

        first, last = (F.to_date(c, "yyyyMMdd") for c in ("start_date", "end_date"))
        # A range that ends before it starts has no days.
        days = F.when(first <= last, F.sequence(first, last, F.expr("interval 1 day")))
        runs = F.array(*WEEKDAYS)[F.weekday("service_date")] == "1"
        regular = (
            calendar.withColumn("service_date", F.explode(days))
            .filter(runs)
            .select("service_id", "service_date", *_lineage())
        )
        dated = exceptions.withColumn("service_date", F.to_date("date", "yyyyMMdd"))
        added = dated.filter("exception_type = '1'").select(
            "service_id", "service_date", *_lineage()
        )
        removed = dated.filter("exception_type = '2'").select("service_id", "service_date")
        return (
            regular.unionByName(added)
            .join(removed, ["service_id", "service_date"], "left_anti")
            .distinct()
        )

    def stop_observations(self) -> DataFrame:
        """In the historic scope: only the agency's trips, with the day-late date repaired."""
        raw = self.raw["stop_observations"]
        rows = in_snapshot(raw, self.observed.scope, self.observed.label, self._labels("stop_observations"))
        if self.observed.historic:
            dated = F.when(
                F.col("trip_id").rlike(DATED_TRIP_ID),
                F.try_to_timestamp(F.right("trip_id", F.lit(8)), F.lit("yyyyMMdd")).cast("date"),
            )
            late = F.coalesce(dated == F.date_add("service_date", 1), F.lit(False))
            rows = (
                rows.filter(F.col("trip_id").startswith(f"{self.observed.agency}:"))
                .withColumn("_late", late)
                .withColumn(
                    "observed_arrival_ts",
                    F.when(
                        F.col("_late"), shift_secs(F.col("observed_arrival_ts"), DAY_SECS)
                    ).otherwise(F.col("observed_arrival_ts")),
                )
                .withColumn(
                    "service_date",
                    F.when(F.col("_late"), F.date_add("service_date", 1)).otherwise(
                        F.col("service_date")
                    ),
                )
            )
        return rows.select(
            "service_date",
            "trip_id",
            "stop_id",
            "stop_sequence",
            "observed_arrival_time",
            "observed_arrival_ts",
            *_lineage(),
            "ingested_at",
        )

    def lane_overlays(self) -> DataFrame:
        """Lanes must be LineStrings; any other geometry is an error, so that none vanishes."""
        raw = self.raw["lane_overlays"]
        rows = required(
            in_snapshot(raw, None, None, self._labels("lane_overlays")), geojson_line("geom_geojson").isNotNull(), "A lane's geometry is a LineString."
        )
        return rows.select(
            "overlay_id",
            "street_name",
            "segment_name",
            *_blank("route_hint"),
            geojson_line("geom_geojson").alias("geom"),
            *[blank_to_null(c).alias(c) if c == "operator_id" else F.col(c) for c in METADATA_COLUMNS],
        )
