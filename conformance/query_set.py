"""Registered queries: one per operator, each with its SQL where SQL can state it."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from conformance.context import Context, context
from conformance.oracle import FIGURES, micro as micro_sql, query, r6
from headwise.functions import geometry, linework
from headwise.functions.columns import round6
from headwise.operators import (
    archive, display, marts, observed, reads, spatial, staging, trips as trip_ops,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(key: str, sql: str | None = None):
    def add(build: Callable[[Context], DataFrame]):
        QUERIES[key] = lambda spark, sf_dir: build(context(spark, sf_dir))
        if sql is not None:
            ORACLE[key] = query(sql)
        return build

    return add


def secs(ts: str, name: str) -> Column:
    return F.unix_seconds(ts).alias(name)


def line_text(line: Column) -> Column:
    """A line as text in whole micro-degrees."""
    def micro(c):
        return F.round(c * 1e6).cast("long").cast("string")

    return F.array_join(F.transform(line, lambda p: F.concat_ws(" ", micro(p["lon"]), micro(p["lat"]))), ",")


def lines_text(lines: Column) -> Column:
    """Several lines in tenths of micro-degrees, in the order of their texts."""
    def tenths(c):
        return F.round(c * 1e7).cast("long").cast("string")

    texts = F.transform(lines, lambda line: F.array_join(F.transform(line, lambda p: F.concat_ws(" ", tenths(p["lon"]), tenths(p["lat"]))), ","))
    return F.array_join(F.array_sort(texts), ";")


def response_lines(geojson: Column) -> Column:
    """The same for the geometry of a response: a line, or several."""
    one = F.from_json(geojson, "type string, coordinates array<array<double>>")
    many = F.from_json(geojson, "type string, coordinates array<array<array<double>>>")
    coordinates = F.when(one["type"] == "LineString", F.array(one["coordinates"])).otherwise(many["coordinates"])
    return lines_text(F.transform(coordinates, lambda line: F.transform(line, lambda p: F.struct(p[0].alias("lon"), p[1].alias("lat")))))


def point_text(point: str) -> Column:
    return line_text(F.array(F.col(point)))


# --- staging and snapshots -------------------------------------------------------------

ROUTE_COLUMNS = "route_id, agency_id, route_short_name, route_long_name, route_type, route_color, route_text_color"
TRIP_COLUMNS = "trip_id, route_id, service_id, trip_headsign, direction_id, shape_id"
STOP_COLUMNS = "stop_id, stop_name, stop_lat, stop_lon"
TIME_COLUMNS = "trip_id, arrival_time_text, departure_time_text, stop_id, stop_sequence, shape_dist_traveled, arrival_time_secs, departure_time_secs"
SHAPE_COLUMNS = "shape_id, shape_pt_lat, shape_pt_lon, shape_pt_sequence, shape_dist_traveled"
OBS_COLUMNS = "service_date, trip_id, stop_id, stop_sequence, observed_arrival_time"


def names(columns: str) -> list[str]:
    return [c.strip() for c in columns.split(",")]


@register("select_gtfs_snapshot", "SELECT 'feed_v2' AS snapshot_label FROM nation LIMIT 1")
def _(c):
    return staging.select_snapshot(c.feed.routes(), "operator_active")


@register(
    "select_observed_snapshot",
    "SELECT max(snapshot_label) AS snapshot_label FROM raw_observations",
)
def _(c):
    return staging.select_snapshot(c.feed.stop_observations(), "fixture")


@register("select_overlay_snapshot", "SELECT 'lanes_v2' AS snapshot_label FROM nation LIMIT 1")
def _(c):
    return staging.select_snapshot(c.feed.lane_overlays(), None)


@register(
    "agency_scope_filter",
    """SELECT 'routes' AS relation, count(*) AS row_count FROM h_stg_routes
       UNION ALL SELECT 'trips', count(*) FROM h_stg_trips
       UNION ALL SELECT 'stops', count(*) FROM h_stg_stops
       UNION ALL SELECT 'stop_times', count(*) FROM h_stg_stop_times
       UNION ALL SELECT 'shapes', count(*) FROM h_stg_shapes
       UNION ALL SELECT 'service_dates', count(*) FROM h_stg_service_dates
       UNION ALL SELECT 'stop_observations', count(*) FROM h_stg_observations""",
)
def _(c):
    s = c.historic_staging
    kept = {
        n: getattr(s, n)()
        for n in ("routes", "trips", "stops", "stop_times", "shapes", "service_dates", "stop_observations")
    }
    return archive.retained_counts(kept).withColumnRenamed("table_name", "relation")


@register("stg_routes", f"SELECT {ROUTE_COLUMNS} FROM stg_routes")
def _(c):
    return c.publication.staging.routes().select(*names(ROUTE_COLUMNS))


@register("stg_trips", f"SELECT {TRIP_COLUMNS} FROM h_stg_trips")
def _(c):
    return c.historic_staging.trips().select(*names(TRIP_COLUMNS))


@register("stg_stops", f"SELECT {STOP_COLUMNS} FROM h_stg_stops")
def _(c):
    return c.historic_staging.stops().select(*names(STOP_COLUMNS))


@register("stg_stop_times", f"SELECT {TIME_COLUMNS} FROM stg_stop_times")
def _(c):
    return c.publication.staging.stop_times().select(*names(TIME_COLUMNS))


@register("stg_shapes", f"SELECT {SHAPE_COLUMNS} FROM h_stg_shapes")
def _(c):
    return c.historic_staging.shapes().select(*names(SHAPE_COLUMNS))


@register("stg_service_dates", "SELECT service_id, service_date FROM h_stg_service_dates")
def _(c):
    return c.historic_staging.service_dates().select("service_id", "service_date")


@register("stg_observations", f"SELECT {OBS_COLUMNS}, observed AS observed_epoch FROM h_stg_observations")
def _(c):
    rows = c.historic_staging.stop_observations()
    return rows.select(*names(OBS_COLUMNS), secs("observed_arrival_ts", "observed_epoch"))


def lane_sql(seq: int) -> str:
    lat = f"37 + (700000 + route * 3000 + {seq} * 1500 + ({seq} * {seq} % 5) * 200 + beside) / 1e6"
    lon = f"-122 - (400000 + route * 2000 + {seq} * 2500) / 1e6"
    return micro_sql(f"({lon})", f"({lat})")


OVERLAY_SQL = f"""SELECT overlay_id, street_name, segment_name, route_hint,
    {lane_sql(1)} || ',' || {lane_sql(2)} AS line FROM overlays"""


@register("stg_overlay", OVERLAY_SQL)
def _(c):
    return c.publication.staging.lane_overlays().select(
        "overlay_id", "street_name", "segment_name", "route_hint", line_text(F.col("geom")).alias("line")
    )


@register("transit_only_lane_overlay", OVERLAY_SQL)
def _(c):
    return c.publication.transit_only_lane_overlay.select(
        "overlay_id", "street_name", "segment_name", "route_hint", line_text(F.col("geom")).alias("line")
    )


# --- canonical schedule ----------------------------------------------------------------


@register("scheduled_routes", f"SELECT {ROUTE_COLUMNS} FROM stg_routes")
def _(c):
    return c.publication.scheduled_routes.select(*names(ROUTE_COLUMNS))


@register("scheduled_trips", f"SELECT {TRIP_COLUMNS} FROM stg_trips")
def _(c):
    return c.publication.scheduled_trips.select(*names(TRIP_COLUMNS))


@register("scheduled_stops", f"SELECT {STOP_COLUMNS} FROM stg_stops")
def _(c):
    return c.publication.scheduled_stops.select(*names(STOP_COLUMNS))


@register("service_dates", "SELECT service_id, service_date FROM stg_service_dates")
def _(c):
    return c.publication.service_dates.select("service_id", "service_date")


EVENT_COLUMNS = f"{TRIP_COLUMNS}, service_date, stop_id, stop_sequence, arrival_time_text, departure_time_text, arrival_time_secs, departure_time_secs, shape_dist_traveled"


@register("scheduled_stop_events", f"SELECT {EVENT_COLUMNS} FROM stop_events")
def _(c):
    return c.publication.scheduled_stop_events.select(*names(EVENT_COLUMNS))


@register("direction_labels", "SELECT route_id, direction_id, direction_label FROM labels_by_direction")
def _(c):
    return c.publication.direction_labels


# --- observed events -------------------------------------------------------------------


@register(
    "observation_key_count",
    """SELECT DISTINCT service_date, trip_id, stop_id, stop_sequence, snapshot_label,
       observation_key_row_count FROM key_count""",
)
def _(c):
    return c.key_counts


@register(
    "trip_service_candidates",
    "SELECT service_date, trip_id, scheduled_trip_service_date_count FROM trip_candidates",
)
def _(c):
    return observed.trip_service_candidates(c.key_counts, c.days, c.publication.stop_times)


@register(
    "trip_service_sequence_candidates",
    "SELECT service_date, trip_id, stop_sequence, scheduled_trip_service_sequence_count FROM slot_candidates",
)
def _(c):
    return observed.trip_service_sequence_candidates(
        c.key_counts, c.days, c.publication.stop_times
    )


@register(
    "scheduled_ts",
    """SELECT trip_id, service_date, stop_sequence,
       cast(date_diff('day', DATE '1970-01-01', service_date) AS bigint) * 86400 + arrival_time_secs + 28800 AS arrival_epoch,
       cast(date_diff('day', DATE '1970-01-01', service_date) AS bigint) * 86400 + departure_time_secs + 28800 AS departure_epoch
       FROM stop_events""",
)
def _(c):
    events = c.publication.scheduled_stop_events
    return events.select(
        "trip_id", "service_date", "stop_sequence",
        F.unix_seconds(observed.scheduled_ts("arrival_time_secs")).alias("arrival_epoch"),
        F.unix_seconds(observed.scheduled_ts("departure_time_secs")).alias("departure_epoch"),
    )


@register(
    "exact_observed_join",
    """SELECT service_date, trip_id, observed_stop_id AS stop_id, stop_sequence, route_id, service_id,
       scheduled_stop_id, trip_headsign, direction_id, shape_id, shape_dist_traveled,
       arrival_time_secs, departure_time_secs, observation_key_row_count,
       scheduled_trip_service_date_count, scheduled_trip_service_sequence_count FROM joined""",
)
def _(c):
    p = c.publication
    rows = observed.exact_observed_join(p.stop_observations, c.days, p.stop_times)
    return rows.select(
        "service_date", "trip_id", "stop_id", "stop_sequence", "route_id", "service_id",
        "scheduled_stop_id", "trip_headsign", "direction_id", "shape_id", "shape_dist_traveled",
        F.col("scheduled_arrival_time_secs").alias("arrival_time_secs"),
        F.col("scheduled_departure_time_secs").alias("departure_time_secs"),
        "observation_key_row_count", "scheduled_trip_service_date_count",
        "scheduled_trip_service_sequence_count",
    )


AUDIT_KEY = "service_date, trip_id, observed_stop_id, stop_sequence, observed_arrival_time"


@register("nearest_day_alignment", f"SELECT {AUDIT_KEY}, scheduled AS scheduled_epoch, observed AS observed_epoch FROM audit")
def _(c):
    return c.publication.join_audit.select(
        *names(AUDIT_KEY), secs("scheduled_arrival_ts", "scheduled_epoch"),
        secs("observed_arrival_ts", "observed_epoch"),
    )


@register("arrival_delay_secs", f"SELECT {AUDIT_KEY}, arrival_delay_secs FROM audit")
def _(c):
    return c.publication.join_audit.select(*names(AUDIT_KEY), "arrival_delay_secs")


@register("join_status", f"SELECT {AUDIT_KEY}, join_status FROM audit")
def _(c):
    return c.publication.join_audit.select(*names(AUDIT_KEY), "join_status")


@register(
    "join_audit",
    f"""SELECT {AUDIT_KEY}, route_id, service_id, scheduled_stop_id, trip_headsign, direction_id,
        shape_id, shape_dist_traveled, arrival_time_secs AS scheduled_arrival_time_secs,
        departure_time_secs AS scheduled_departure_time_secs, scheduled AS scheduled_epoch,
        scheduled_departure AS scheduled_departure_epoch, observed AS observed_epoch,
        arrival_delay_secs, snapshot_label AS observed_snapshot_label, observation_key_row_count,
        scheduled_trip_service_date_count, scheduled_trip_service_sequence_count, join_status
        FROM audit""",
)
def _(c):
    p = c.publication
    audit = observed.join_audit(
        p.stop_observations, p.scheduled_trips, p.service_dates, p.stop_times
    )
    return audit.select(
        *names(AUDIT_KEY), "route_id", "service_id", "scheduled_stop_id", "trip_headsign",
        "direction_id", "shape_id", "shape_dist_traveled", "scheduled_arrival_time_secs",
        "scheduled_departure_time_secs", secs("scheduled_arrival_ts", "scheduled_epoch"),
        secs("scheduled_departure_ts", "scheduled_departure_epoch"),
        secs("observed_arrival_ts", "observed_epoch"), "arrival_delay_secs",
        "observed_snapshot_label", "observation_key_row_count",
        "scheduled_trip_service_date_count", "scheduled_trip_service_sequence_count",
        "join_status",
    )


@register(
    "join_summary",
    """SELECT snapshot_label AS observed_snapshot_label, join_status, count(*) AS row_count
       FROM audit GROUP BY 1, 2""",
)
def _(c):
    return c.publication.join_summary


@register(
    "observed_stop_events",
    """SELECT service_date, trip_id, route_id, service_id, stop_id, stop_sequence, trip_headsign,
       direction_id, shape_id, scheduled AS scheduled_epoch, observed AS observed_epoch,
       arrival_delay_secs FROM matched""",
)
def _(c):
    return c.publication.observed_stop_events.select(
        "service_date", "trip_id", "route_id", "service_id", "stop_id", "stop_sequence",
        "trip_headsign", "direction_id", "shape_id",
        secs("scheduled_arrival_ts", "scheduled_epoch"),
        secs("observed_arrival_ts", "observed_epoch"), "arrival_delay_secs",
    )


# --- spatial ---------------------------------------------------------------------------

POINT_SQL = f"SELECT stop_id, stop_name, stop_lat, stop_lon, {micro_sql('stop_lon', 'stop_lat')} AS point FROM points"


@register("stop_points", POINT_SQL)
def _(c):
    return c.publication.stop_points.select(*names(STOP_COLUMNS), point_text("geom").alias("point"))


@register("stop_map_layer", POINT_SQL)
def _(c):
    return c.publication.stop_map_layer.select(*names(STOP_COLUMNS), point_text("geom").alias("point"))


@register("make_point", f"SELECT stop_id, {micro_sql('stop_lon', 'stop_lat')} AS point FROM points")
def _(c):
    made = c.publication.scheduled_stops.filter("stop_lat IS NOT NULL").select(
        "stop_id", geometry.make_point("stop_lon", "stop_lat").alias("p")
    )
    return made.select("stop_id", point_text("p").alias("point"))


LINE_SQL = f"""SELECT shape_id, string_agg({micro_sql('shape_pt_lon', 'shape_pt_lat')}, ','
    ORDER BY shape_pt_sequence) AS line, max(shape_dist_traveled) AS longest
    FROM stg_shapes GROUP BY 1"""


@register(
    "route_geometries",
    f"""SELECT l.route_id, l.direction_id, l.shape_id, l.direction_label, g.line,
        g.longest AS max_shape_dist_traveled FROM lines l JOIN ({LINE_SQL}) g USING (shape_id)""",
)
def _(c):
    return c.publication.route_geometries.select(
        "route_id", "direction_id", "shape_id", "direction_label",
        line_text(F.col("geom")).alias("line"), "max_shape_dist_traveled",
    )


@register("make_line_ordered", f"SELECT shape_id, line FROM ({LINE_SQL})")
def _(c):
    lines = c.publication.shapes.groupBy("shape_id").agg(
        geometry.make_line_ordered("shape_pt_sequence", "shape_pt_lon", "shape_pt_lat").alias("g")
    )
    return lines.select(
        "shape_id",
        F.array_join(
            F.transform("g", lambda p: F.concat_ws(
                " ",
                F.round(p["lon"] * 1e6).cast("long").cast("string"),
                F.round(p["lat"] * 1e6).cast("long").cast("string"),
            )), ",",
        ).alias("line"),
    )


@register(
    "make_line_2pt",
    f"""SELECT DISTINCT from_stop_id, to_stop_id,
        {micro_sql('a_lon', 'a_lat')} || ',' || {micro_sql('b_lon', 'b_lat')} AS line FROM fractions""",
)
def _(c):
    return _located(c).select(
        "from_stop_id", "to_stop_id",
        line_text(geometry.make_line_2pt("from_point", "to_point")).alias("line"),
    ).distinct()


def _pairs(c):
    p = c.publication
    return spatial.trip_stop_pairs(p.scheduled_trips, p.stop_times, p.scheduled_stops)


def _located(c):
    p = c.publication
    pairs = spatial.dedup_pairs(spatial.adjacent_pairs(_pairs(c)))
    lines = p.route_geometries.select(*spatial.SHAPE, "max_shape_dist_traveled")
    points = p.stop_points.select("stop_id", "geom")
    return (
        marts.join_on(pairs, lines, ["route_id", "shape_id"], ["direction_id"])
        .join(points.toDF("from_stop_id", "from_point"), "from_stop_id")
        .join(points.toDF("to_stop_id", "to_point"), "to_stop_id")
    )


PAIR_COLUMNS = "route_id, direction_id, shape_id, trip_id, from_stop_sequence, from_stop_id, from_stop_name, to_stop_sequence, to_stop_id, to_stop_name"


@register(
    "trip_stop_pairs",
    """SELECT trip_id, from_stop_sequence, from_stop_id,
       CASE WHEN to_stop_sequence = from_stop_sequence + 1 THEN to_stop_id END AS to_stop_id FROM pairs""",
)
def _(c):
    return _pairs(c).select("trip_id", "from_stop_sequence", "from_stop_id", "to_stop_id")


@register("adjacent_pairs", f"SELECT {PAIR_COLUMNS} FROM adjacent")
def _(c):
    return spatial.adjacent_pairs(_pairs(c)).select(*names(PAIR_COLUMNS))


@register("dedup_pairs", f"SELECT {PAIR_COLUMNS} FROM distinct_pairs")
def _(c):
    return spatial.dedup_pairs(spatial.adjacent_pairs(_pairs(c))).select(*names(PAIR_COLUMNS))


@register(
    "segment_fractions",
    f"""SELECT route_id, direction_id, shape_id, from_stop_sequence,
        {r6('start_fraction')} AS start_fraction, {r6('end_fraction')} AS end_fraction FROM fractions""",
)
def _(c):
    return spatial.segment_fractions(_located(c)).select(
        "route_id", "direction_id", "shape_id", "from_stop_sequence",
        round6(F.col("start_fraction")).alias("start_fraction"),
        round6(F.col("end_fraction")).alias("end_fraction"),
    )


@register(
    "scheduled_segment_minutes",
    """SELECT route_id, direction_id, shape_id, segment_sequence, from_stop_id, to_stop_id,
       scheduled_segment_minutes FROM segments""",
)
def _(c):
    return c.publication.route_stop_segments.select(*marts.SEGMENT, "scheduled_segment_minutes")


# Line substring in SQL: vertices between the two lengths, and interpolated ends.
SUBSTRING_SQL = f"""
steps AS (SELECT shape_id, shape_pt_sequence AS i, shape_pt_lon AS lon, shape_pt_lat AS lat,
        coalesce(sqrt(power(shape_pt_lon - lag(shape_pt_lon) OVER w, 2)
            + power(shape_pt_lat - lag(shape_pt_lat) OVER w, 2)), 0.0) AS step
        FROM stg_shapes WINDOW w AS (PARTITION BY shape_id ORDER BY shape_pt_sequence)),
measured AS (SELECT *, sum(step) OVER (PARTITION BY shape_id ORDER BY i) AS m,
        lag(lon) OVER v AS plon, lag(lat) OVER v AS plat
        FROM steps WINDOW v AS (PARTITION BY shape_id ORDER BY i)),
totals AS (SELECT shape_id, max(m) AS total FROM measured GROUP BY 1),
wanted AS (SELECT DISTINCT shape_id, start_fraction AS f0, end_fraction AS f1, total * start_fraction AS t0,
        total * end_fraction AS t1 FROM segments JOIN totals USING (shape_id)
        WHERE end_fraction > start_fraction),
ends_at AS (SELECT w.*, side, CASE side WHEN 0 THEN t0 ELSE t1 END AS t FROM wanted w CROSS JOIN (VALUES (0), (1)) s(side)),
found AS (SELECT a.shape_id, a.f0, a.f1, a.side, m.lon, m.lat, m.plon, m.plat,
        CASE WHEN m.step > 0 THEN least(1.0, (a.t - (m.m - m.step)) / m.step) ELSE 1.0 END AS share
        FROM ends_at a JOIN measured m ON m.shape_id = a.shape_id AND m.m >= a.t - 1e-15
        QUALIFY row_number() OVER (PARTITION BY a.shape_id, a.f0, a.f1, a.side ORDER BY m.i) = 1),
ends AS (SELECT shape_id, f0, f1, side, CASE WHEN plon IS NULL THEN lon ELSE plon + (lon - plon) * share END AS lon,
        CASE WHEN plat IS NULL THEN lat ELSE plat + (lat - plat) * share END AS lat FROM found),
vertices AS (
    SELECT shape_id, f0, f1, CASE side WHEN 0 THEN -1 ELSE 1000000000 END AS i, lon, lat FROM ends
    UNION ALL
    SELECT w.shape_id, w.f0, w.f1, m.i, m.lon, m.lat FROM wanted w JOIN measured m ON m.shape_id = w.shape_id
     AND m.m > w.t0 AND m.m < w.t1),
stretches AS (SELECT shape_id, f0, f1, string_agg({micro_sql('lon', 'lat')}, ',' ORDER BY i) AS line
    FROM vertices GROUP BY 1, 2, 3)"""


def with_substring(select: str) -> str:
    """A statement that may use the relations of `SUBSTRING_SQL` besides the common ones."""
    return query(f"WITH_MARK {SUBSTRING_SQL} {select}").replace("\nWITH_MARK", ",\n", 1)


def register_after(key: str, sql: str):
    """Register with SQL that already is complete."""
    def add(build):
        register(key)(build)
        ORACLE[key] = sql
        return build

    return add


SEGMENT_LINE_SQL = f"""SELECT s.route_id, s.direction_id, s.shape_id, s.segment_sequence,
    coalesce(g.line, {micro_sql('s.a_lon', 's.a_lat')} || ',' || {micro_sql('s.b_lon', 's.b_lat')}) AS line
    FROM segments s LEFT JOIN stretches g ON g.shape_id = s.shape_id AND g.f0 = s.start_fraction
     AND g.f1 = s.end_fraction"""


@register_after("segment_geometry", with_substring(SEGMENT_LINE_SQL))
def _(c):
    return c.publication.route_stop_segments.select(
        "route_id", "direction_id", "shape_id", "segment_sequence", line_text(F.col("geom")).alias("line")
    )


@register_after("line_substring", with_substring("SELECT shape_id, line FROM stretches"))
def _(c):
    p = c.publication
    lines = p.route_geometries.select("shape_id", "geom").dropDuplicates(["shape_id"])
    parts = spatial.segment_fractions(_located(c)).filter("end_fraction > start_fraction").select(
        "shape_id", "start_fraction", "end_fraction"
    ).distinct()
    spans = parts.select("shape_id", F.col("start_fraction").alias("start"), F.col("end_fraction").alias("end"))
    return linework.line_stretches(lines, spans, "shape_id").select("shape_id", line_text(F.col("geom")).alias("line"))


@register(
    "route_stop_segments",
    """SELECT route_id, direction_id, shape_id, representative_trip_id, direction_label,
       segment_sequence, from_stop_id, from_stop_name, to_stop_id, to_stop_name, segment_label,
       scheduled_segment_minutes, from_dist AS from_shape_dist_traveled,
       to_dist AS to_shape_dist_traveled FROM segments""",
)
def _(c):
    p = c.publication
    return spatial.route_stop_segments(
        p.scheduled_trips, p.stop_times, p.scheduled_stops, p.route_geometries, p.stop_points
    ).drop("geom", "source_system", "feed_scope", "operator_id", "snapshot_label")


# --- trip level ------------------------------------------------------------------------


@register(
    "trip_bounds",
    """SELECT trip_id, service_date, min(stop_sequence) AS first_stop_sequence,
       max(stop_sequence) AS last_stop_sequence FROM stop_events GROUP BY 1, 2""",
)
def _(c):
    p = c.publication
    return trip_ops.trip_bounds(p.scheduled_trips, p.service_dates, p.stop_times)


TERMINAL_COLUMNS = "trip_id, route_id, service_id, service_date, direction_id, trip_headsign, first_stop_id, last_stop_id, first_stop_sequence, last_stop_sequence, first_arrival_time_secs, last_arrival_time_secs, trip_start_hour_local, first_stop_trip_order"


@register(
    "trip_terminals",
    f"SELECT {TERMINAL_COLUMNS}, first_scheduled AS first_epoch, last_scheduled AS last_epoch FROM terminals",
)
def _(c):
    p = c.publication
    return trip_ops.trip_terminals(p.scheduled_trips, p.service_dates, p.stop_times).select(
        *names(TERMINAL_COLUMNS), secs("first_scheduled_arrival_ts", "first_epoch"),
        secs("last_scheduled_arrival_ts", "last_epoch"),
    )


@register("trip_start_hour", "SELECT trip_id, service_date, trip_start_hour_local FROM terminals")
def _(c):
    return c.publication.trip_terminals.select("trip_id", "service_date", "trip_start_hour_local")


@register("first_stop_trip_order", "SELECT trip_id, service_date, first_stop_trip_order FROM terminals")
def _(c):
    return c.publication.trip_terminals.select("trip_id", "service_date", "first_stop_trip_order")


FULL_COLUMNS = "route_id, direction_id, trip_headsign, service_date, trip_id, trip_start_hour_local, observed_runtime_secs, scheduled_runtime_secs, in_vehicle_loss_minutes"


@register("full_trip_metrics", f"SELECT {FULL_COLUMNS} FROM full_trips")
def _(c):
    return c.publication.full_trip_metrics.select(*names(FULL_COLUMNS))


FIRST_COLUMNS = "route_id, direction_id, trip_headsign, service_date, trip_id, first_stop_id, first_stop_trip_order"


@register(
    "matched_first_stop_events",
    f"SELECT {FIRST_COLUMNS}, first_scheduled AS scheduled_epoch, first_observed AS observed_epoch FROM first_events",
)
def _(c):
    return c.publication.matched_first_stop_events.select(
        *names(FIRST_COLUMNS), secs("first_scheduled_arrival_ts", "scheduled_epoch"),
        secs("observed_first_arrival_ts", "observed_epoch"),
    )


@register(
    "headway_intervals",
    """SELECT route_id, direction_id, trip_headsign, service_date, first_stop_id, hour_local,
       sh AS scheduled_headway_secs, oh AS observed_headway_secs FROM headways""",
)
def _(c):
    return c.publication.headway_intervals


@register("matched_coverage_rows", "SELECT route_id, direction_id, service_date, hour_local FROM coverage")
def _(c):
    return c.publication.matched_coverage_rows


@register(
    "unmatched_resolved",
    "SELECT route_id, direction_id, service_date, hour_local, join_status FROM resolved",
)
def _(c):
    return c.publication.unmatched_resolved


# --- marts -----------------------------------------------------------------------------

GRAINS = {"route": marts.BY_ROUTE, "direction": marts.BY_DIRECTION, "hour": marts.BY_HOUR}


def _every_grain(build: Callable[[list[str]], DataFrame]) -> DataFrame:
    out = None
    for grain, keys in GRAINS.items():
        rows = build(keys).withColumn("grain", F.lit(grain))
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out


def every_grain_sql(relation: str, columns: str) -> str:
    return f"""SELECT 'route' AS grain, route_id, NULL::integer AS direction_id, NULL::integer AS hour_local, {columns} FROM {relation}_route
        UNION ALL SELECT 'direction', route_id, direction_id, NULL, {columns} FROM {relation}_direction
        UNION ALL SELECT 'hour', route_id, direction_id, hour_local, {columns} FROM {relation}_hour"""


@register("waiting_metrics", every_grain_sql("waiting", "waiting_loss_minutes, matched_headway_interval_count"))
def _(c):
    sums = c.publication.headway_sums
    return _every_grain(lambda keys: marts.waiting_metrics(sums, keys))


@register("runtime_metrics", every_grain_sql("runtime", "in_vehicle_loss_minutes, matched_full_trip_count"))
def _(c):
    histogram = c.publication.loss_histogram
    return _every_grain(lambda keys: marts.runtime_metrics(histogram, keys))


@register("matched_coverage", every_grain_sql("covered", "matched_observed_stop_event_count"))
def _(c):
    counts = c.publication.matched_counts
    return _every_grain(lambda keys: marts.matched_coverage(counts, keys))


@register("unmatched_coverage", every_grain_sql("uncovered", "resolved_unmatched_observation_count"))
def _(c):
    counts = c.publication.unmatched_counts
    return _every_grain(lambda keys: marts.unmatched_coverage(counts, keys))


@register("route_keys", "SELECT route_id FROM keys_route")
def _(c):
    return marts.group_keys(c.publication.loss_parts, marts.BY_ROUTE)


@register("route_direction_keys", "SELECT route_id, direction_id FROM keys_direction")
def _(c):
    return marts.group_keys(c.publication.loss_parts, marts.BY_DIRECTION)


@register("route_hour_keys", "SELECT route_id, direction_id, hour_local FROM keys_hour")
def _(c):
    return marts.group_keys(c.publication.loss_parts, marts.BY_HOUR)


@register(
    "worst_stop_wait_label",
    """SELECT 'route' AS grain, route_id, NULL::integer AS direction_id, worst_stop_wait_label FROM worst_stops
       UNION ALL SELECT 'direction', route_id, direction_id, worst_stop_wait_label FROM worst_stops_by_direction""",
)
def _(c):
    waits = c.publication.stop_wait_metrics
    by_route = marts.worst_stop_wait_label(waits).withColumn("grain", F.lit("route"))
    by_direction = marts.worst_stop_wait_label(waits, marts.BY_DIRECTION)
    return by_direction.withColumn("grain", F.lit("direction")).unionByName(
        by_route, allowMissingColumns=True
    )


@register(
    "worst_segment_label",
    """SELECT 'route' AS grain, route_id, NULL::integer AS direction_id, worst_segment_label FROM worst_segments
       UNION ALL SELECT 'direction', route_id, direction_id, worst_segment_label FROM worst_segments_by_direction""",
)
def _(c):
    rows = c.publication.route_segment_metrics
    by_route = marts.worst_segment_label(rows).withColumn("grain", F.lit("route"))
    by_direction = marts.worst_segment_label(rows, marts.BY_DIRECTION)
    return by_direction.withColumn("grain", F.lit("direction")).unionByName(
        by_route, allowMissingColumns=True
    )


@register("route_window_summary", "SELECT * FROM window_summary")
def _(c):
    return c.publication.route_window_summary.drop("metric_updated_at")


@register("route_direction_summary", "SELECT * FROM direction_summary")
def _(c):
    return c.publication.route_direction_summary.drop("metric_updated_at")


@register("route_hour_summary", "SELECT * FROM hour_summary")
def _(c):
    return c.publication.route_hour_summary.drop("metric_updated_at")


@register(
    "observed_segment_pairs",
    """SELECT trip_id, service_date, segment_sequence, from_stop_id, to_stop_id,
       cast(run AS bigint) AS observed_secs, cast(plan AS bigint) AS scheduled_secs FROM trip_segments""",
)
def _(c):
    return c.publication.observed_segment_pairs.select(
        "trip_id", "service_date", "segment_sequence", "from_stop_id", "to_stop_id",
        (F.unix_seconds("to_observed_arrival_ts") - F.unix_seconds("from_observed_arrival_ts")).alias("observed_secs"),
        (F.col("to_scheduled_arrival_time_secs") - F.col("from_scheduled_arrival_time_secs")).cast("long").alias("scheduled_secs"),
    )


@register(
    "trip_segment_metrics",
    """SELECT route_id, direction_id, shape_id, trip_id, service_date, segment_sequence,
       from_stop_id, to_stop_id, segment_in_vehicle_loss_minutes FROM segment_losses""",
)
def _(c):
    return c.publication.trip_segment_metrics


@register("route_segment_metrics", "SELECT * FROM segment_metrics")
def _(c):
    return c.publication.route_segment_metrics.drop("metric_updated_at")


@register("stop_wait_metrics", "SELECT * FROM stop_waits")
def _(c):
    return c.publication.stop_wait_metrics.drop("metric_updated_at")


# --- serving and reads -----------------------------------------------------------------


@register(
    "route_map_layer",
    f"""SELECT route_id, route_name, window_key, {FIGURES}, worst_stop_wait_label, worst_segment_label, merged_lines
        FROM window_summary JOIN merged_routes USING (route_id)""",
)
def _(c):
    return c.publication.route_map_layer.select(
        "route_id", "route_name", "window_key", *marts.LOSSES, "worst_stop_wait_label",
        "worst_segment_label", lines_text(F.col("geom")).alias("merged_lines"),
    )


SEGMENT_LAYER_SQL = f"""SELECT m.*, coalesce(g.line, {micro_sql('s.a_lon', 's.a_lat')} || ',' || {micro_sql('s.b_lon', 's.b_lat')}) AS line
    FROM segment_metrics m JOIN segments s ON s.route_id = m.route_id
     AND s.direction_id IS NOT DISTINCT FROM m.direction_id AND s.shape_id = m.shape_id
     AND s.segment_sequence = m.segment_sequence AND s.from_stop_id = m.from_stop_id
     AND s.to_stop_id = m.to_stop_id
    LEFT JOIN stretches g ON g.shape_id = s.shape_id AND g.f0 = s.start_fraction AND g.f1 = s.end_fraction"""


@register_after(
    "route_segment_layer",
    with_substring(SEGMENT_LAYER_SQL),
)
def _(c):
    layer = c.publication.route_segment_layer
    return layer.withColumn("line", line_text(F.col("geom"))).drop("geom", "metric_updated_at")


@register(
    "stop_wait_hotspots",
    f"""SELECT w.*, {micro_sql('p.stop_lon', 'p.stop_lat')} AS point
        FROM stop_waits w JOIN points p ON p.stop_id = w.stop_id""",
)
def _(c):
    rows = c.publication.stop_wait_hotspots
    return rows.withColumn("point", point_text("geom")).drop("geom", "metric_updated_at")


@register("worst_time_band", "SELECT route_id, worst_time_band FROM bands")
def _(c):
    return reads.worst_time_band(c.publication.route_hour_summary)


@register("rankings", "SELECT * FROM ranked")
def _(c):
    p = c.publication
    return reads.rankings(p.route_window_summary, p.route_hour_summary).drop("metric_updated_at")


@register(
    "route_summary",
    f"""SELECT d.route_id, d.direction_id, d.direction_label, d.window_key, {FIGURES.replace('typical', 'd.typical').replace(' waiting', ' d.waiting').replace(' in_', ' d.in_')},
        h.band AS worst_time_band FROM direction_summary d
        LEFT JOIN (SELECT route_id, direction_id,
            coalesce(lpad(cast(hour_local AS varchar), 2, '0'), '') || ':00-' || coalesce(lpad(cast(hour_local AS varchar), 2, '0'), '') || ':59' AS band
            FROM hour_summary WHERE route_id = '7' QUALIFY row_number() OVER (PARTITION BY direction_id
                ORDER BY typical_trip_loss_minutes DESC NULLS LAST, hour_local NULLS LAST) = 1) h
          ON h.direction_id = d.direction_id WHERE d.route_id = '7' AND d.direction_id = 1""",
)
def _(c):
    p = c.publication
    return reads.route_summary(
        p.route_window_summary, p.route_direction_summary, p.route_hour_summary, "7", direction=1
    ).select(
        "route_id", "direction_id", "direction_label", "window_key", *marts.LOSSES, "worst_time_band"
    )


@register(
    "route_segments",
    """SELECT shape_id, segment_sequence, segment_label, scheduled_segment_minutes,
       segment_in_vehicle_loss_minutes, matched_trip_segment_count FROM segment_metrics
       WHERE route_id = '7' AND direction_id = 1""",
)
def _(c):
    return reads.route_segments(c.publication.route_segment_layer, "7", 1).select(
        "shape_id", "segment_sequence", "segment_label", "scheduled_segment_minutes",
        "segment_in_vehicle_loss_minutes", "matched_trip_segment_count",
    )


@register(
    "route_stop_wait",
    """SELECT w.stop_id, stop_wait_label, waiting_loss_minutes, matched_headway_interval_count
       FROM stop_waits w JOIN points p ON p.stop_id = w.stop_id WHERE route_id = '7' AND direction_id = 1""",
)
def _(c):
    return reads.route_stop_wait(c.publication.stop_wait_hotspots, "7", 1).select(
        "stop_id", "stop_wait_label", "waiting_loss_minutes", "matched_headway_interval_count"
    )


@register(
    "compare",
    f"""SELECT list_position(['12', '3', '7'], s.route_id) AS position, s.route_id, {FIGURES}, worst_time_band
        FROM window_summary s LEFT JOIN bands b ON b.route_id = s.route_id WHERE s.route_id IN ('12', '3', '7')""",
)
def _(c):
    p = c.publication
    return reads.compare(p.route_window_summary, p.route_hour_summary, "12, 3,7").select(
        F.col("position").cast("int").alias("position"), "route_id", *marts.LOSSES, "worst_time_band"
    )


@register(
    "map_routes",
    """SELECT s.route_id, s.waiting_loss_minutes AS metric_value, s.matched_full_trip_count, worst_time_band, merged_lines
       FROM window_summary s JOIN merged_routes m ON m.route_id = s.route_id LEFT JOIN bands b ON b.route_id = s.route_id""",
)
def _(c):
    p = c.publication
    return reads.map_routes(
        p.route_map_layer, p.route_window_summary, p.route_hour_summary, metric="waiting_loss_minutes"
    ).select(
        "route_id", "metric_value", "matched_full_trip_count", "worst_time_band",
        response_lines(F.col("geometry_json")).alias("merged_lines"),
    )


def unfolded(collections: DataFrame, coordinates: str, properties: dict[str, str]) -> DataFrame:
    """The features of response texts, parsed again: their place, geometry and properties."""
    fields = ", ".join(f"{c} {kind}" for c, kind in properties.items())
    parsed = F.from_json(
        "collection",
        f"type string, features array<struct<geometry: struct<type: string, coordinates: {coordinates}>, properties: struct<{fields}>>>",
    )
    return (
        collections.filter(F.get_json_object("collection", "$.type") == "FeatureCollection")
        .select("feature_count", F.posexplode(parsed["features"]).alias("at", "f"))
        .select(
            (F.col("at") + 1).alias("position"), "feature_count", F.col("f.geometry.type").alias("geometry_type"),
            F.col("f.geometry.coordinates").alias("coordinates"), *[f"f.properties.{c}" for c in properties],
        )
    )


def pairs_text(line: Column) -> Column:
    """Coordinate pairs as text in whole micro-degrees."""
    def micro(c):
        return F.round(c * 1e6).cast("long").cast("string")

    return F.array_join(F.transform(line, lambda p: F.concat_ws(" ", micro(p[0]), micro(p[1]))), ",")


@register_after(
    "feature_collection",
    with_substring(
        f"""SELECT CAST(row_number() OVER w AS INTEGER) AS position, CAST(count(*) OVER (PARTITION BY route_id, direction_id) AS INTEGER) AS feature_count,
        'LineString' AS geometry_type, line, route_id, direction_id, window_key AS "window", shape_id, segment_sequence,
        segment_label, segment_in_vehicle_loss_minutes FROM ({SEGMENT_LAYER_SQL})
        WINDOW w AS (PARTITION BY route_id, direction_id ORDER BY segment_sequence, shape_id, to_stop_id)"""
    ),
)
def _(c):
    texts = reads.feature_collection(reads.segment_features(c.publication.route_segment_layer), "segments")
    found = unfolded(
        texts, "array<array<double>>",
        {
            "route_id": "string", "direction_id": "int", "window": "string", "shape_id": "string", "segment_sequence": "int",
            "segment_label": "string", "segment_in_vehicle_loss_minutes": "double",
        },
    )
    return found.withColumn("line", pairs_text(F.col("coordinates"))).drop("coordinates")


@register(
    "feature_collection_stop_wait",
    f"""SELECT CAST(row_number() OVER p AS INTEGER) AS position, CAST(count(*) OVER (PARTITION BY route_id, direction_id) AS INTEGER) AS feature_count,
        'Point' AS geometry_type, {micro_sql('p.stop_lon', 'p.stop_lat')} AS point, route_id, direction_id,
        window_key AS "window", w.stop_id, stop_wait_label, waiting_loss_minutes, matched_headway_interval_count
        FROM stop_waits w JOIN points p ON p.stop_id = w.stop_id
        WINDOW p AS (PARTITION BY route_id, direction_id ORDER BY waiting_loss_minutes DESC NULLS LAST, w.stop_id)""",
)
def _(c):
    texts = reads.feature_collection(reads.stop_wait_features(c.publication.stop_wait_hotspots), "stop_wait")
    found = unfolded(
        texts, "array<double>",
        {
            "route_id": "string", "direction_id": "int", "window": "string", "stop_id": "string",
            "stop_wait_label": "string", "waiting_loss_minutes": "double", "matched_headway_interval_count": "bigint",
        },
    )
    return found.withColumn("point", pairs_text(F.array("coordinates"))).drop("coordinates")


MAP_SQL = """SELECT CAST(row_number() OVER (ORDER BY s.waiting_loss_minutes DESC NULLS LAST, s.route_id) AS INTEGER) AS position,
       CAST(count(*) OVER () AS INTEGER) AS feature_count, s.route_id, s.window_key AS "window", 'waiting_loss_minutes' AS metric,
       s.waiting_loss_minutes AS metric_value, s.typical_trip_loss_minutes, s.matched_full_trip_count, worst_time_band,
       s.worst_stop_wait_label, merged_lines
       FROM window_summary s JOIN merged_routes m ON m.route_id = s.route_id LEFT JOIN bands b ON b.route_id = s.route_id"""
MAP_PROPERTIES = {
    "route_id": "string", "window": "string", "metric": "string", "metric_value": "double",
    "typical_trip_loss_minutes": "double", "matched_full_trip_count": "bigint", "worst_time_band": "string",
    "worst_stop_wait_label": "string",
}


def _map_features(c: Context) -> DataFrame:
    p, metric = c.publication, "waiting_loss_minutes"
    rows = reads.map_routes(p.route_map_layer, p.route_window_summary, p.route_hour_summary, metric=metric)
    return reads.map_features(rows, metric)


@register("feature_collection_map", MAP_SQL)
def _(c):
    found = unfolded(reads.feature_collection(_map_features(c), "map"), "string", MAP_PROPERTIES)
    geometry_json = F.concat(F.lit('{"type":"'), "geometry_type", F.lit('","coordinates":'), "coordinates", F.lit("}"))
    return found.withColumn("merged_lines", response_lines(geometry_json)).drop("coordinates", "geometry_type")


@register("feature_lines_map", MAP_SQL)
def _(c):
    """The same response as lines, one per feature."""
    lines = reads.feature_lines(_map_features(c), "map")
    fields = ", ".join(f"{k} {kind}" for k, kind in MAP_PROPERTIES.items())
    parsed = F.from_json("feature", f"geometry string, properties struct<{fields}>")
    return lines.select(
        F.col("position").cast("int").alias("position"), F.col("feature_count").cast("int").alias("feature_count"), parsed.alias("f")
    ).select(
        "position", "feature_count", *[f"f.properties.{k}" for k in MAP_PROPERTIES],
        response_lines(F.col("f.geometry")).alias("merged_lines"),
    )


@register(
    "coverage_counts",
    """SELECT (SELECT count(*) FROM window_summary WHERE typical_trip_loss_minutes IS NOT NULL) AS route_count_with_metrics,
       (SELECT count(*) FROM window_summary WHERE route_id IN (SELECT route_id FROM drawn_routes)) AS map_route_count,
       (SELECT string_agg(route_id, ',' ORDER BY rank) FROM ranked
         WHERE rank <= 10 AND typical_trip_loss_minutes IS NOT NULL) AS top_route_ids FROM nation LIMIT 1""",
)
def _(c):
    p = c.publication
    counts = marts.coverage_counts(p.route_window_summary, p.route_map_layer)
    return counts.withColumn("top_route_ids", F.array_join("top_route_ids", ","))


# --- display figures -------------------------------------------------------------------

MEDIAN_SQL = r6("median(coalesce(typical_trip_loss_minutes, 0))")


@register("system_median", f"SELECT {MEDIAN_SQL} AS system_median_minutes FROM window_summary")
def _(c):
    return display.system_median(c.publication.route_window_summary)


@register(
    "peer_gap",
    f"""SELECT route_id, typical_trip_loss_minutes, m AS system_median_minutes,
        {r6('coalesce(typical_trip_loss_minutes, 0) - m')} AS peer_gap_minutes
        FROM window_summary CROSS JOIN (SELECT {MEDIAN_SQL} AS m FROM window_summary)""",
)
def _(c):
    return display.peer_gap(c.publication.route_window_summary)


SHARE = "greatest(0.0, least(coalesce({0}, 0.0) / CASE WHEN coalesce(typical_trip_loss_minutes, 0) = 0 THEN 1.0 ELSE typical_trip_loss_minutes END, 1.0))"


@register(
    "loss_shares",
    f"""SELECT route_id, {r6(SHARE.format('waiting_loss_minutes'))} AS waiting_share,
        {r6(SHARE.format('in_vehicle_loss_minutes'))} AS travel_share FROM window_summary""",
)
def _(c):
    return display.loss_shares(c.publication.route_window_summary)


@register(
    "dominant_problem",
    """SELECT route_id, CASE WHEN coalesce(waiting_loss_minutes, 0) >= coalesce(in_vehicle_loss_minutes, 0)
       THEN 'waiting loss' ELSE 'in-vehicle loss' END AS dominant_problem FROM window_summary""",
)
def _(c):
    return display.dominant_problem(c.publication.route_window_summary)


@register(
    "route_peers",
    """SELECT a.route_id, a.rank, b.rank AS peer_rank, b.route_id AS peer_route_id FROM ranked a JOIN ranked b
       ON b.rank BETWEEN a.rank - 2 AND a.rank + 2 AND b.rank <> a.rank""",
)
def _(c):
    p = c.publication
    return display.route_peers(reads.rankings(p.route_window_summary, p.route_hour_summary))


@register(
    "segment_rollup",
    """SELECT route_id, segment_label, max(loss) AS loss_minutes,
       first(minutes ORDER BY loss DESC, direction_id NULLS LAST, segment_sequence, shape_id, to_stop_id) AS scheduled_minutes,
       count(*) AS variant_count, string_agg(DISTINCT label, ', ' ORDER BY label) AS direction_labels
       FROM (SELECT *, coalesce(segment_in_vehicle_loss_minutes, 0) AS loss,
           coalesce(scheduled_segment_minutes, 0) AS minutes,
           coalesce(direction_label, 'Direction ' || coalesce(cast(direction_id AS varchar), '?')) AS label
           FROM segment_metrics) GROUP BY 1, 2""",
)
def _(c):
    return display.segment_rollup(c.publication.route_segment_metrics)


@register(
    "top_stop_wait",
    """SELECT route_id, w.stop_id, stop_wait_label, waiting_loss_minutes FROM stop_waits w
       JOIN points p ON p.stop_id = w.stop_id
       QUALIFY row_number() OVER (PARTITION BY route_id ORDER BY coalesce(waiting_loss_minutes, 0) DESC,
           coalesce(direction_id, 0), w.stop_id) = 1""",
)
def _(c):
    return display.top_stop_wait(c.publication.stop_wait_hotspots)


def band_sql(value: str, bounds: list, last: str) -> str:
    whens = " ".join(f"WHEN coalesce({value}, 0) >= {b} THEN '{n}'" for b, n in bounds)
    return f"CASE {whens} {last} END"


LOW_OR_NONE = "WHEN coalesce({0}, 0) > 0 THEN 'low' ELSE 'none'"


@register(
    "severity_band",
    f"""SELECT 'route' AS kind, route_id AS item, {band_sql('typical_trip_loss_minutes', [(10, 'severe'), (5, 'high'), (2, 'moderate')], LOW_OR_NONE.format('typical_trip_loss_minutes'))} AS band, 1::bigint AS n FROM window_summary
        UNION ALL SELECT 'segment', route_id, {band_sql('segment_in_vehicle_loss_minutes', [(2, 'severe'), (1.4, 'high'), (0.8, 'moderate')], LOW_OR_NONE.format('segment_in_vehicle_loss_minutes'))}, count(*) FROM segment_metrics GROUP BY ALL
        UNION ALL SELECT 'stop', stop_id, {band_sql('waiting_loss_minutes', [(3, 'severe'), (2, 'high'), (1, 'moderate')], "ELSE 'low'")}, 1 FROM stop_waits""",
)
def _(c):
    p = c.publication
    routes = p.route_window_summary.select(
        F.lit("route").alias("kind"), F.col("route_id").alias("item"),
        display.severity_band(F.col("typical_trip_loss_minutes"), "route").alias("band"), F.lit(1).cast("long").alias("n"),
    )
    segments = p.route_segment_metrics.groupBy(
        F.lit("segment").alias("kind"), F.col("route_id").alias("item"),
        display.severity_band(F.col("segment_in_vehicle_loss_minutes"), "segment").alias("band"),
    ).agg(F.count("*").alias("n"))
    stops = p.stop_wait_metrics.select(
        F.lit("stop").alias("kind"), F.col("stop_id").alias("item"),
        display.severity_band(F.col("waiting_loss_minutes"), "stop").alias("band"), F.lit(1).cast("long").alias("n"),
    )
    return routes.unionByName(segments).unionByName(stops)


@register(
    "leading_route",
    """SELECT route_id, typical_trip_loss_minutes FROM window_summary WHERE route_id IN ('12', '3', '7')
       ORDER BY coalesce(typical_trip_loss_minutes, 0) DESC, list_position(['12', '3', '7'], route_id) LIMIT 1""",
)
def _(c):
    p = c.publication
    return display.leading_route(
        reads.compare(p.route_window_summary, p.route_hour_summary, ["12", "3", "7"])
    )


@register(
    "featured_routes",
    """SELECT rank, route_id, typical_trip_loss_minutes FROM ranked
       WHERE route_id IN (SELECT route_id FROM drawn_routes) ORDER BY rank LIMIT 3""",
)
def _(c):
    p = c.publication
    ranked = reads.rankings(p.route_window_summary, p.route_hour_summary)
    return display.featured_routes(ranked, p.route_map_layer)
