"""Registered queries for sources, archive preparation, geometry and data checks."""

from pyspark.sql import DataFrame, functions as F

from conformance.oracle import RELATIONS, clock, epoch_day, micro, r6
from conformance.query_set import (
    OVERLAY_SQL, line_text, lines_text, names, point_text, register, register_after, with_substring,
)
from headwise.functions import geometry, linework
from headwise.functions.columns import round6
from headwise.operators import archive, display, quality
from headwise.schemas import FEED_COLUMNS, OBSERVATION_SCHEMA, UNIQUE_KEYS
from headwise.sources import feed_files, store

AGENCY = "SF"
META_ARGS = ("orders", "archive", "archive_v1", "OP")


def meta():
    return feed_files.metadata(*META_ARGS)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).option("ignoreLeadingWhiteSpace", False).option(
        "ignoreTrailingWhiteSpace", False
    ).option("escape", '"').csv(path)


# --- sources ---------------------------------------------------------------------------


FEED_ROWS_SQL = "\nUNION ALL ".join(
    f"SELECT '{t}' AS table_name, concat_ws('|', {', '.join(columns)}) AS row_text, 'archive_v1' AS snapshot_label FROM raw_{t}"
    for t, columns in FEED_COLUMNS.items()
    if t != "calendar_dates"
)


@register("src_gtfs_csv", FEED_ROWS_SQL)
def _(c):
    """All files of a feed, each with a further column, whose texts hold line breaks and quotes here
    and there, and padded text; one optional file is missing."""
    folder = c.folder("csv")
    tables = c.feed.archive() | {"routes": c.feed.routes().filter("snapshot_label = 'feed_v2'")}
    for name, rows in tables.items():
        if name in FEED_COLUMNS and name != "calendar_dates":
            padded = rows.select(*[F.concat(F.lit(" "), k, F.lit(" ")).alias(k) for k in FEED_COLUMNS[name]])
            broken = F.when(F.xxhash64(*padded.columns) % 5 == 0, 'x"\n,"y').otherwise("x")
            write_csv(padded.withColumn("extra", broken), f"{folder}/{name}.txt")
    out = None
    for name, rows in feed_files.read_feed(c.spark, folder, meta()).items():
        text = F.concat_ws("|", *FEED_COLUMNS[name])
        part = rows.select(F.lit(name).alias("table_name"), text.alias("row_text"), "snapshot_label")
        out = part if out is None else out.unionByName(part)
    return out


@register(
    "src_gtfs_optional",
    """SELECT 'calendar' AS table_name, count(*) AS row_count FROM raw_calendar
       UNION ALL SELECT 'calendar_dates', 0 FROM (SELECT 1)""",
)
def _(c):
    folder = c.folder("optional")
    write_csv(c.feed.archive()["calendar"], f"{folder}/calendar.txt")
    tables = {
        t: feed_files.read_feed_table(c.spark, folder, t, meta())
        for t in ("calendar", "calendar_dates")
    }
    return archive.retained_counts(tables)


@register(
    "src_obs_iso",
    "SELECT service_date, trip_id, stop_id, stop_sequence, observed AS observed_epoch FROM raw_observations",
)
def _(c):
    path = c.folder("iso")
    local = F.from_utc_timestamp("observed_arrival_ts", "America/Los_Angeles")
    write_csv(
        c.feed.stop_observations().select(
            "service_date", "trip_id", "stop_id", "stop_sequence",
            F.concat(F.date_format(local, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("-08:00")).alias("observed_arrival_time"),
        ),
        path,
    )
    rows = feed_files.read_iso_observations(c.spark, path, meta())
    return rows.select(
        "service_date", "trip_id", "stop_id", "stop_sequence",
        F.unix_seconds("observed_arrival_ts").alias("observed_epoch"),
    )


ARCHIVE_EPOCH = f"{epoch_day('service_date')} + 28800 + secs"


@register(
    "src_obs_archive",
    f"""SELECT service_date, trip_id, stop_id, stop_sequence, {clock('secs')} AS observed_arrival_time,
        {ARCHIVE_EPOCH} AS observed_epoch FROM seen WHERE pk % 23 <> 0""",
)
def _(c):
    path = c.folder("archive_obs")
    write_csv(c.feed.archive_observations(), path)
    rows = feed_files.read_archive_observations(c.spark, path, meta())
    return rows.select(
        "service_date", "trip_id", "stop_id", "stop_sequence", "observed_arrival_time",
        F.unix_seconds("observed_arrival_ts").alias("observed_epoch"),
    )


@register(
    "obs_archive_load_counts",
    """SELECT count(*) FILTER (observed_arrival_time <> '') AS inserted_row_count,
       count(*) FILTER (observed_arrival_time = '') AS skipped_missing_required_count
       FROM archive_observations""",
)
def _(c):
    return feed_files.archive_load_counts(c.feed.archive_observations())


@register(
    "obs_archive_ts",
    f"SELECT trip_id, stop_sequence, {ARCHIVE_EPOCH} AS observed_epoch FROM seen WHERE pk % 23 <> 0",
)
def _(c):
    rows = c.feed.archive_observations().filter("observed_arrival_time <> ''")
    ts = feed_files.obs_archive_ts(F.to_date("service_date", "yyyyMMdd"), F.col("observed_arrival_time"))
    return rows.select(
        "trip_id", F.col("stop_sequence").cast("int").alias("stop_sequence"),
        F.unix_seconds(ts).alias("observed_epoch"),
    )


@register(
    "src_overlay_geojson",
    """SELECT CASE WHEN route % 5 = 0 THEN 'overlay_' || row_number() OVER (ORDER BY route)
            ELSE 'lane_' || route END AS overlay_id, n_name AS street_name,
        'Lane ' || route AS segment_name, CASE WHEN route % 4 = 1 THEN '' ELSE cast(route AS varchar) END AS route_hint
        FROM nations""",
)
def _(c):
    lanes = c.feed.lane_overlays().filter("snapshot_label = 'lanes_v2'")
    route = F.substring("segment_name", 6, 9).cast("int")
    feature = F.concat(
        F.lit('{"type":"Feature","properties":'),
        F.to_json(F.struct(
            F.when(route % 5 != 0, F.col("overlay_id")).alias("overlay_id"),
            F.concat(F.lit(" "), "street_name").alias("street_name"), "segment_name", "route_hint",
        )),
        F.lit(',"geometry":'), "geom_geojson", F.lit("}"),
    )
    # A GeoJSON file is one document; this one has a feature per nation.
    features = F.transform(
        F.array_sort(F.collect_list(F.struct(route.alias("r"), feature.alias("f")))), lambda x: x["f"]
    )
    collection = lanes.agg(
        F.concat(
            F.lit('{"type":"FeatureCollection","features":['), F.array_join(features, ","), F.lit("]}")
        ).alias("value")
    )
    path = c.folder("overlay")
    collection.write.text(path)
    return feed_files.read_overlays(c.spark, path, meta()).select(
        "overlay_id", "street_name", "segment_name", "route_hint"
    )


@register("snapshot_label", "SELECT trip_id, 'archive_feed.' || trip_id AS snapshot_label FROM trip_base")
def _(c):
    name = F.concat(F.lit("months/2001.01/feed."), "trip_id", F.lit(".zip"))
    return c.feed.trip_base.select("trip_id", feed_files.snapshot_label(name).alias("snapshot_label"))


@register(
    "raw_write",
    """SELECT snapshot_label, count(*) AS row_count FROM (
           SELECT snapshot_label FROM raw_observations WHERE snapshot_label = 'obs_v1'
           UNION ALL SELECT snapshot_label FROM raw_observations WHERE snapshot_label = 'obs_v1'
           UNION ALL SELECT snapshot_label FROM raw_observations WHERE snapshot_label = 'obs_v2' AND stop_sequence < 3)
       GROUP BY 1""",
)
def _(c):
    path = c.folder("raw_observations")
    rows = c.feed.stop_observations()
    store.raw_write(rows, path)
    store.raw_write(rows.filter("snapshot_label = 'obs_v2' AND stop_sequence < 3"), path)
    store.raw_write(rows.filter("snapshot_label = 'obs_v1'"), path, replace=False)
    written = store.raw_read(c.spark, path, OBSERVATION_SCHEMA)
    return written.groupBy("snapshot_label").agg(F.count("*").alias("row_count"))


@register(
    "raw_snapshot_present",
    """SELECT 'feed_v1' AS snapshot_label, false AS present FROM (SELECT count(*) FROM raw_routes)
       UNION ALL SELECT 'feed_v2', count(*) > 0 FROM raw_stop_times""",
)
def _(c):
    return store.snapshots_present(c.feed.raw())


@register("mart_write", "SELECT * FROM hour_summary")
def _(c):
    path = c.folder("mart")
    store.mart_write(c.publication.route_hour_summary, path)
    return c.spark.read.parquet(path).drop("metric_updated_at")


# --- archive: ids and agency extract ---------------------------------------------------

NORMAL = "regexp_replace(regexp_replace(trip_id, '^SF:', ''), ':\\d{8}$', '')"


@register("strip_operator_prefix", "SELECT trip_id, regexp_replace(trip_id, '^SF:', '') AS stripped FROM h_raw_trips")
def _(c):
    trips = c.archive_feed.archive()["trips"]
    return trips.select("trip_id", archive.strip_operator_prefix("trip_id", AGENCY).alias("stripped"))


@register("normalize_trip_id", f"SELECT trip_id, {NORMAL} AS normalized FROM h_raw_trips")
def _(c):
    trips = c.archive_feed.archive()["trips"]
    return trips.select("trip_id", archive.normalize_trip_id("trip_id", AGENCY).alias("normalized"))


RELATIONS |= {
    "x_routes": "SELECT * FROM h_raw_routes WHERE agency_id = 'SF'",
    "x_trips0": f"""SELECT * REPLACE (CASE WHEN shape_id = '' THEN 'SF:shape_api:' || {NORMAL} ELSE shape_id END AS shape_id)
        FROM h_raw_trips WHERE route_id IN (SELECT route_id FROM x_routes)""",
    "x_stop_times": "SELECT * FROM h_raw_stop_times WHERE trip_id IN (SELECT trip_id FROM x_trips0)",
    "x_observations": """SELECT * FROM h_archive_observations WHERE agency_id = 'SF'
        OR trip_id IN (SELECT trip_id FROM x_trips0) OR route_id IN (SELECT route_id FROM x_routes)
        OR trip_id LIKE 'SF:%' OR route_id LIKE 'SF:%'""",
    "x_patterns": """SELECT trip_id, sha256(string_agg(stop_sequence || ':' || stop_id, chr(10)
        ORDER BY cast(stop_sequence AS integer))) AS pattern FROM x_stop_times GROUP BY 1""",
    # The current feed of the agency: all trips, three quarters under another headsign, some
    # with a second shape.
    "a_trips": """SELECT * REPLACE (CASE WHEN shape_id <> '' AND cast(route_id AS integer) % 3 = 0
            AND cast(trip_id AS bigint) % 16 = 0 THEN shape_id || 'b' ELSE shape_id END AS shape_id,
            CASE WHEN cast(trip_id AS bigint) % 4 = 0 THEN trip_headsign ELSE 'local-' || trip_headsign END AS trip_headsign)
        FROM raw_trips""",
    "a_stop_times": "SELECT * FROM raw_stop_times",
    "a_shapes": "SELECT * FROM raw_shapes WHERE right(shape_id, 2) <> '_9'",
    "a_patterns": """SELECT trip_id, sha256(string_agg(stop_sequence || ':' || stop_id, chr(10)
        ORDER BY cast(stop_sequence AS integer))) AS pattern FROM a_stop_times GROUP BY 1""",
    "a_by_headsign": """SELECT route_id AS route_key, direction_id, trip_headsign, min(shape_id) AS only_shape
        FROM a_trips WHERE shape_id <> '' GROUP BY 1, 2, 3 HAVING count(DISTINCT shape_id) = 1""",
    "a_by_pattern": """SELECT route_id AS route_key, direction_id, trip_headsign, pattern, min(shape_id) AS only_shape
        FROM a_trips JOIN a_patterns USING (trip_id) WHERE shape_id <> ''
        GROUP BY 1, 2, 3, 4 HAVING count(DISTINCT shape_id) = 1""",
    "x_trips": """SELECT route_id, service_id, t.trip_id, t.trip_headsign, t.direction_id, t.route_key, t.pattern,
        CASE WHEN shape_id NOT LIKE 'SF:shape_api:%' THEN shape_id
             WHEN t.pattern IS NOT NULL AND p.only_shape IS NOT NULL THEN 'SF:active_shape:' || p.only_shape
             WHEN t.pattern IS NULL AND h.only_shape IS NOT NULL THEN 'SF:active_shape:' || h.only_shape
             WHEN t.pattern IS NOT NULL THEN 'SF:shape_pattern:' || substr(sha256(encode(t.route_key) || '\\x00'::blob
                || encode(t.direction_id) || '\\x00'::blob || encode(t.trip_headsign) || '\\x00'::blob || encode(substr(t.pattern, 1, 16))), 1, 16)
             ELSE shape_id END AS shape_id
        FROM (SELECT x.*, regexp_replace(route_id, '^SF:', '') AS route_key, pattern
              FROM x_trips0 x LEFT JOIN x_patterns USING (trip_id)) t
        LEFT JOIN a_by_pattern p ON p.route_key = t.route_key AND p.direction_id = t.direction_id
         AND p.trip_headsign = t.trip_headsign AND p.pattern = t.pattern
        LEFT JOIN a_by_headsign h ON h.route_key = t.route_key AND h.direction_id = t.direction_id
         AND h.trip_headsign = t.trip_headsign""",
    "x_missing": f"""SELECT m.shape_id, t.trip_id, {NORMAL} AS normal, t.route_key, t.direction_id, t.trip_headsign, t.pattern
        FROM (SELECT shape_id, min(trip_id) AS trip_id FROM x_trips
              WHERE shape_id NOT IN (SELECT shape_id FROM h_raw_shapes) GROUP BY 1) m
        JOIN x_trips t USING (trip_id)""",
    "x_found": """
        SELECT m.shape_id, 1 AS priority, a.trip_id, coalesce(nullif(a.shape_id, ''), chr(1) || a.trip_id) AS same
        FROM x_missing m JOIN (SELECT * FROM a_trips JOIN a_patterns USING (trip_id)) a ON a.route_id = m.route_key
         AND a.direction_id = m.direction_id AND a.trip_headsign = m.trip_headsign AND a.pattern = m.pattern
        UNION ALL
        SELECT m.shape_id, 2, a.trip_id, coalesce(nullif(a.shape_id, ''), chr(1) || a.trip_id)
        FROM x_missing m JOIN a_trips a ON a.route_id = m.route_key AND a.direction_id = m.direction_id
         AND a.trip_headsign = m.trip_headsign
        UNION ALL
        SELECT m.shape_id, 3, a.trip_id, coalesce(nullif(a.shape_id, ''), chr(1) || a.trip_id)
        FROM x_missing m JOIN a_trips a ON a.route_id = m.route_key AND a.direction_id = m.direction_id""",
    "x_candidates": """SELECT shape_id, trip_id, priority, cast(row_number() OVER (PARTITION BY shape_id
            ORDER BY priority, trip_id) AS integer) AS position
        FROM (SELECT shape_id, trip_id, min(priority) AS priority FROM (
            SELECT shape_id, trip_id, 0 AS priority FROM x_missing
            UNION ALL
            SELECT shape_id, trip_id, priority FROM x_found
            QUALIFY row_number() OVER (PARTITION BY shape_id, same ORDER BY priority, trip_id) = 1)
          GROUP BY 1, 2)""",
    "x_targets": """SELECT shape_id, source_id FROM (
            SELECT m.shape_id, a.shape_id AS source_id, 1 AS priority FROM x_missing m
            JOIN a_trips a ON a.trip_id = m.normal WHERE a.shape_id <> ''
            UNION ALL
            SELECT m.shape_id, p.only_shape, 2 FROM x_missing m JOIN a_by_pattern p ON p.route_key = m.route_key
             AND p.direction_id = m.direction_id AND p.trip_headsign = m.trip_headsign AND p.pattern = m.pattern
            WHERE m.shape_id LIKE 'SF:active_shape:%'
            UNION ALL
            SELECT m.shape_id, h.only_shape, 2 FROM x_missing m JOIN a_by_headsign h ON h.route_key = m.route_key
             AND h.direction_id = m.direction_id AND h.trip_headsign = m.trip_headsign
            WHERE m.pattern IS NULL AND m.shape_id LIKE 'SF:active_shape:%')
        WHERE source_id IN (SELECT shape_id FROM a_shapes)
        QUALIFY row_number() OVER (PARTITION BY shape_id ORDER BY priority, source_id) = 1""",
    # Stored shape answers of all trips, two or three positions each; a third have arrived.
    "all_payload_points": """SELECT cast(k AS varchar) AS lookup_trip_id,
        '37.' || lpad(cast((k * 7 + i * 11) % 1000000 AS varchar), 6, '0') AS shape_pt_lat,
        '-122.' || lpad(cast((k * 13 + i * 17) % 1000000 AS varchar), 6, '0') AS shape_pt_lon,
        cast(i AS varchar) AS shape_pt_sequence, '' AS shape_dist_traveled
        FROM trip_base CROSS JOIN range(1, 4) AS r(i) WHERE i <= 2 + k % 2""",
    "payload_points": "SELECT * FROM all_payload_points WHERE cast(lookup_trip_id AS bigint) % 3 = 0",
    "x_backfill": """SELECT t.shape_id, s.shape_pt_lat, s.shape_pt_lon, s.shape_pt_sequence
        FROM x_targets t JOIN a_shapes s ON s.shape_id = t.source_id
        UNION ALL
        SELECT c.shape_id, p.shape_pt_lat, p.shape_pt_lon, p.shape_pt_sequence
        FROM (SELECT shape_id, lookup FROM (SELECT shape_id, position, """
    + NORMAL
    + """ AS lookup FROM x_candidates WHERE shape_id NOT IN (SELECT shape_id FROM x_targets))
            WHERE lookup IN (SELECT lookup_trip_id FROM payload_points)
            QUALIFY row_number() OVER (PARTITION BY shape_id ORDER BY position) = 1) c
        JOIN payload_points p ON p.lookup_trip_id = c.lookup""",
}


def active_feed(c):
    """Staged once: many of the queries below look shapes up in it."""

    def build():
        feed = c.feed.archive()
        number = F.col("trip_id").cast("long")
        second = (F.col("shape_id") != "") & (F.col("route_id").cast("int") % 3 == 0) & (number % 16 == 0)
        shape = F.when(second, F.concat("shape_id", F.lit("b"))).otherwise(F.col("shape_id"))
        sign = F.col("trip_headsign")
        headsign = F.when(number % 4 == 0, sign).otherwise(F.concat(F.lit("local-"), sign))
        return {
            "trips": feed["trips"].withColumns({"shape_id": shape, "trip_headsign": headsign}),
            "stop_times": feed["stop_times"],
            "shapes": feed["shapes"].filter(F.right("shape_id", F.lit(2)) != "_9"),
        }

    return c.staged_feed("active", build)


def agency_feed(c):
    return c.staged_feed(
        "agency",
        lambda: archive.agency_extract_closure(
            c.archive_feed.archive(), AGENCY, active_feed(c), cut=c.cut
        ),
    )


def plain_trips(c):
    feed = c.archive_feed.archive()
    routes = archive.agency_extract_routes(feed["routes"], AGENCY)
    return archive.agency_extract_trips(feed["trips"], routes, AGENCY)


@register("agency_extract_routes", "SELECT route_id, agency_id, route_short_name FROM x_routes")
def _(c):
    routes = archive.agency_extract_routes(c.archive_feed.archive()["routes"], AGENCY)
    return routes.select("route_id", "agency_id", "route_short_name")


TRIPS = ", ".join(FEED_COLUMNS["trips"])


@register("agency_extract_trips", f"SELECT {TRIPS} FROM x_trips0")
def _(c):
    return plain_trips(c).select(*FEED_COLUMNS["trips"])


@register("synth_shape_id", "SELECT trip_id, shape_id FROM x_trips0 WHERE shape_id LIKE 'SF:shape_api:%'")
def _(c):
    return plain_trips(c).filter("shape_id LIKE 'SF:shape_api:%'").select("trip_id", "shape_id")


@register("assign_shape_target", "SELECT trip_id, shape_id FROM x_trips")
def _(c):
    return agency_feed(c)["trips"].select("trip_id", "shape_id")


@register(
    "agency_extract_closure",
    """SELECT 'stops' AS table_name, stop_id AS id, count(*) AS n FROM h_raw_stops
       WHERE stop_id IN (SELECT stop_id FROM x_stop_times) GROUP BY 2
       UNION ALL SELECT 'stop_times', trip_id, count(*) FROM x_stop_times GROUP BY 2
       UNION ALL SELECT 'shapes', shape_id, count(*) FROM h_raw_shapes
         WHERE shape_id IN (SELECT shape_id FROM x_trips) GROUP BY 2
       UNION ALL SELECT 'calendar', service_id, count(*) FROM h_raw_calendar
         WHERE service_id IN (SELECT service_id FROM x_trips) GROUP BY 2
       UNION ALL SELECT 'calendar_dates', service_id, count(*) FROM h_raw_calendar_dates
         WHERE service_id IN (SELECT service_id FROM x_trips) GROUP BY 2""",
)
def _(c):
    feed = agency_feed(c)
    keys = {
        "stops": "stop_id", "stop_times": "trip_id", "shapes": "shape_id",
        "calendar": "service_id", "calendar_dates": "service_id",
    }
    out = None
    for table, key in keys.items():
        one = feed[table].groupBy(F.lit(table).alias("table_name"), F.col(key).alias("id")).agg(
            F.count("*").alias("n")
        )
        out = one if out is None else out.unionByName(one)
    return out


OBS = "service_date, trip_id, stop_sequence, to_stop_id, observed_arrival_time, agency_id, route_id"


@register("agency_extract_obs", f"SELECT {OBS} FROM x_observations")
def _(c):
    return agency_feed(c)["stop_observations"].select(*names(OBS))


@register(
    "retained_counts",
    """SELECT 'routes' AS table_name, count(*) AS row_count FROM x_routes
       UNION ALL SELECT 'trips', count(*) FROM x_trips UNION ALL SELECT 'stop_times', count(*) FROM x_stop_times
       UNION ALL SELECT 'stops', count(*) FROM h_raw_stops WHERE stop_id IN (SELECT stop_id FROM x_stop_times)
       UNION ALL SELECT 'shapes', count(*) FROM h_raw_shapes WHERE shape_id IN (SELECT shape_id FROM x_trips)
       UNION ALL SELECT 'calendar', count(*) FROM h_raw_calendar WHERE service_id IN (SELECT service_id FROM x_trips)
       UNION ALL SELECT 'calendar_dates', count(*) FROM h_raw_calendar_dates WHERE service_id IN (SELECT service_id FROM x_trips)
       UNION ALL SELECT 'stop_observations', count(*) FROM x_observations""",
)
def _(c):
    return archive.retained_counts(agency_feed(c))


# --- archive: shapes -------------------------------------------------------------------


@register("stop_pattern_key", "SELECT trip_id, pattern AS stop_pattern_key FROM a_patterns")
def _(c):
    return archive.stop_pattern_key(active_feed(c)["stop_times"])


@register("unique_shape_lookup", "SELECT route_key, direction_id, trip_headsign, only_shape AS only_shape_id FROM a_by_headsign")
def _(c):
    return archive.unique_shape_lookup(archive.active_trips(active_feed(c), AGENCY))


@register(
    "unique_shape_lookup_by_pattern",
    "SELECT route_key, direction_id, trip_headsign, pattern AS stop_pattern_key, only_shape AS only_shape_id FROM a_by_pattern",
)
def _(c):
    active = active_feed(c)
    return archive.unique_shape_lookup_by_pattern(
        archive.active_trips(active, AGENCY), archive.stop_pattern_key(active["stop_times"])
    )


@register("representative_trip", "SELECT shape_id, min(trip_id) AS trip_id FROM x_trips GROUP BY 1")
def _(c):
    return archive.representative_trip(agency_feed(c)["trips"])


@register("missing_shapes", "SELECT shape_id FROM x_missing")
def _(c):
    feed = agency_feed(c)
    return archive.missing_shapes(feed["trips"], feed["shapes"])


@register("shape_candidates", "SELECT shape_id, trip_id, priority, position FROM x_candidates")
def _(c):
    feed = agency_feed(c)
    return archive.shape_candidates(
        feed["trips"], feed["shapes"], feed["stop_times"], active_feed(c), AGENCY, cut=c.cut
    )


def payloads(c, which: str = "true"):
    """Stored answers in their varying forms: single objects or lists, empty leading journeys."""
    trips = c.feed.trip_base.filter(which).select("k")
    positions = F.expr(
        "transform(sequence(1, cast(2 + k % 2 as int)), i -> concat('\"37.',"
        " lpad(cast((k * 7 + i * 11) % 1000000 as string), 6, '0'), ' -122.',"
        " lpad(cast((k * 13 + i * 17) % 1000000 as string), 6, '0'), '\"'))"
    )
    projection = F.concat(F.lit('{"LineString":{"pos":['), F.array_join(positions, ","), F.lit("]}}"))
    listed = F.when(F.col("k") % 5 == 0, F.concat(F.lit("["), projection, F.lit("]"))).otherwise(projection)
    journey = F.concat(F.lit('{"LinkSequenceProjection":'), listed, F.lit("}"))
    journeys = F.when(
        F.col("k") % 2 == 0,
        F.concat(F.lit('[{"id":"x"},{"LinkSequenceProjection":{"LineString":{"pos":[]}}},'), journey, F.lit("]")),
    ).otherwise(journey)
    frame = F.concat(F.lit('{"vehicleJourneys":{"ServiceJourney":'), journeys, F.lit("}}"))
    frames = F.when(F.col("k") % 7 == 0, F.concat(F.lit('[{"id":1},'), frame, F.lit("]"))).otherwise(frame)
    return trips.select(
        F.col("k").cast("string").alias("lookup_trip_id"),
        F.concat(F.lit('{"Content":{"TimetableFrame":'), frames, F.lit("}}")).alias("payload"),
    )


@register("shapes_payload_parse", "SELECT * FROM all_payload_points")
def _(c):
    return archive.shapes_payload_parse(payloads(c))


@register("shape_backfill", "SELECT shape_id, shape_pt_lat, shape_pt_lon, shape_pt_sequence FROM x_backfill")
def _(c):
    feed = agency_feed(c)
    points = archive.shapes_payload_parse(payloads(c, "k % 3 = 0"))
    return archive.shape_backfill(
        feed["trips"], feed["shapes"], feed["stop_times"], active_feed(c), AGENCY, points, cut=c.cut
    ).select("shape_id", "shape_pt_lat", "shape_pt_lon", "shape_pt_sequence")


# --- archive: months -------------------------------------------------------------------

MONTHS = ["2000-11", "2000-12", "2001-01"]
MONTH_OF = "CASE abs(cast(trip_id AS bigint)) % 3 WHEN 0 THEN '2000-11' WHEN 1 THEN '2000-12' ELSE '2001-01' END"
RELATIONS |= {
    "months": "SELECT * FROM (VALUES ('2000-11'), ('2000-12'), ('2001-01')) AS m(feed_month)",
    "m_trips": f"SELECT {MONTH_OF} AS feed_month, * FROM raw_trips",
    "m_ids": "SELECT *, replace(feed_month, '-', '') || '__' AS token FROM m_trips",
    "m_routes": """SELECT feed_month, route_id, route_short_name || ' ' || feed_month AS name FROM raw_routes
        CROSS JOIN months WHERE NOT (cast(route_id AS integer) % 5 = 0 AND feed_month = '2001-01')""",
    "m_stops": "SELECT feed_month, stop_id, stop_name || ' ' || feed_month AS name FROM raw_stops CROSS JOIN months",
}


def month_feed(c):
    """The current feed spread over three months; routes and stops change their names."""
    feed = c.feed.archive()
    month = F.expr(MONTH_OF)
    each = F.explode(F.array(*[F.lit(m) for m in MONTHS]))
    out = {t: feed[t].withColumn("feed_month", month) for t in ("trips", "stop_times", "stop_observations")}
    out |= {
        t: feed[t].withColumn("feed_month", each) for t in ("shapes", "calendar", "calendar_dates", "stops")
    }
    out["stops"] = out["stops"].withColumn("stop_name", F.concat_ws(" ", "stop_name", "feed_month"))
    out["routes"] = (
        feed["routes"].filter("route_long_name <> 'Old name'").withColumn("feed_month", each)
        .filter("NOT (cast(route_id AS int) % 5 = 0 AND feed_month = '2001-01')")
        .withColumn("route_short_name", F.concat_ws(" ", "route_short_name", "feed_month"))
    )
    return out


@register(
    "month_window",
    """SELECT month, strftime(m - INTERVAL 2 MONTH, '%Y-%m') || ',' || strftime(m - INTERVAL 1 MONTH, '%Y-%m')
        || ',' || month AS window_months
       FROM (SELECT DISTINCT date_trunc('month', o_orderdate) AS m, strftime(o_orderdate, '%Y-%m') AS month FROM orders)""",
)
def _(c):
    day = F.col("o_orderdate").cast("date")
    return c.feed.table("orders", "o_orderdate").select(
        F.date_format(day, "yyyy-MM").alias("month"),
        F.array_join(archive.month_window(day, 3), ",").alias("window_months"),
    ).distinct()


@register(
    "month_namespace",
    """SELECT token || trip_id AS trip_id, token || service_id AS service_id,
       CASE WHEN shape_id = '' THEN '' ELSE token || shape_id END AS shape_id FROM m_ids""",
)
def _(c):
    return month_feed(c)["trips"].select(
        *[archive.month_namespace(k).alias(k) for k in ("trip_id", "service_id", "shape_id")]
    )


USED = "(feed_month, {0}) IN (SELECT feed_month, {0} FROM m_trips)"


@register(
    "month_combine",
    f"""SELECT 'routes' AS table_name, route_id || '|' || arg_max(name, feed_month) AS id, 1::bigint AS n FROM m_routes GROUP BY route_id
        UNION ALL SELECT 'stops', stop_id || '|' || trim(arg_max(name, feed_month)), 1 FROM m_stops GROUP BY stop_id
        UNION ALL SELECT 'trips', token || trip_id, count(*) FROM m_ids GROUP BY 2
        UNION ALL SELECT 'stop_times', token || s.trip_id, count(*) FROM raw_stop_times s JOIN m_ids USING (trip_id) GROUP BY 2
        UNION ALL SELECT 'stop_observations', token || o.trip_id, count(*) FROM archive_observations o JOIN m_ids USING (trip_id) GROUP BY 2
        UNION ALL SELECT 'shapes', replace(feed_month, '-', '') || '__' || shape_id, count(*) FROM raw_shapes CROSS JOIN months
          WHERE {USED.format('shape_id')} GROUP BY 2
        UNION ALL SELECT 'calendar', replace(feed_month, '-', '') || '__' || service_id, count(*) FROM raw_calendar CROSS JOIN months
          WHERE {USED.format('service_id')} GROUP BY 2
        UNION ALL SELECT 'calendar_dates', replace(feed_month, '-', '') || '__' || service_id, count(*) FROM raw_calendar_dates CROSS JOIN months
          WHERE {USED.format('service_id')} GROUP BY 2""",
)
def _(c):
    feed = archive.month_combine(month_feed(c))
    ids = {
        "routes": F.concat_ws("|", "route_id", "route_short_name"),
        "stops": F.concat_ws("|", "stop_id", F.trim("stop_name")),
        "trips": F.col("trip_id"), "stop_times": F.col("trip_id"),
        "stop_observations": F.col("trip_id"), "shapes": F.col("shape_id"),
        "calendar": F.col("service_id"), "calendar_dates": F.col("service_id"),
    }
    out = None
    for table, key in ids.items():
        one = feed[table].groupBy(F.lit(table).alias("table_name"), key.alias("id")).agg(F.count("*").alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


# --- geometry --------------------------------------------------------------------------


@register(
    "as_geojson",
    """SELECT stop_id, '{"type":"Point","coordinates":[' || stop_lon || ',' || stop_lat || ']}' AS geojson FROM points""",
)
def _(c):
    return c.publication.stop_points.select("stop_id", geometry.point_geojson(F.col("geom")).alias("geojson"))


@register(
    "geojson_parse",
    f"""SELECT shape_id, string_agg({micro('shape_pt_lon', 'shape_pt_lat')}, ',' ORDER BY shape_pt_sequence) AS line
        FROM stg_shapes GROUP BY 1""",
)
def _(c):
    lines = c.publication.route_geometries.select("shape_id", geometry.line_geojson(F.col("geom")).alias("text"))
    return lines.dropDuplicates(["shape_id"]).select(
        "shape_id", line_text(geometry.geojson_line("text")).alias("line")
    )


@register(
    "geometry_valid",
    """SELECT shape_id, count(DISTINCT shape_pt_lon || ' ' || shape_pt_lat) >= 2 AS is_valid
       FROM stg_shapes GROUP BY 1""",
)
def _(c):
    lines = c.publication.route_geometries.select("shape_id", "geom").dropDuplicates(["shape_id"])
    return lines.select("shape_id", geometry.line_valid(F.col("geom")).alias("is_valid"))


@register("line_union_merge", "SELECT route_id, merged_lines FROM merged_routes")
def _(c):
    merged = linework.line_union_merge(c.publication.route_geometries)
    return merged.select("route_id", lines_text(F.col("geom")).alias("merged_lines"))


def metres_sql(px, py, ax, ay, bx, yb):
    """Distance in metres of a point to a piece, on the plane touching the earth at the point."""
    phi = f"radians({py})"
    w = f"sqrt(1 - 0.00669437999014 * power(sin({phi}), 2))"
    east = f"(111319.49 * cos({phi}) / {w})"
    north = f"(111319.49 * (1 - 0.00669437999014) / power({w}, 3))"
    dx, dy = f"(({bx} - {ax}) * {east})", f"(({yb} - {ay}) * {north})"
    ux, uy = f"(({px} - {ax}) * {east})", f"(({py} - {ay}) * {north})"
    t = f"greatest(0.0, least(1.0, ({ux} * {dx} + {uy} * {dy}) / nullif({dx} * {dx} + {dy} * {dy}, 0)))"
    return f"sqrt(power({ux} - {t} * {dx}, 2) + power({uy} - {t} * {dy}, 2))"


def side_sql(ax, ay, bx, yb, px, py):
    return f"sign(({bx} - {ax}) * ({py} - {ay}) - ({yb} - {ay}) * ({px} - {ax}))"


def lane_axis(seq: int) -> str:
    lat = f"37 + (700000 + route * 3000 + {seq} * 1500 + ({seq} * {seq} % 5) * 200 + beside) / 1e6"
    lon = f"-(122 + (400000 + route * 2000 + {seq} * 2500) / 1e6)"
    return f"{lon} AS x{seq}, {lat} AS y{seq}"


P, Q = ("s.ax", "s.ay", "s.bx", "s.yb"), ("o.x1", "o.y1", "o.x2", "o.y2")
NEAR_SQL = f"""SELECT DISTINCT s.route_id, s.direction_id, s.shape_id, s.segment_sequence
    FROM (SELECT g.*, lon AS ax, lat AS ay, lead(lon) OVER w AS bx, lead(lat) OVER w AS yb
          FROM (SELECT route_id, direction_id, shape_id, segment_sequence, to_stop_id, i, lon, lat FROM segments
                JOIN vertices v USING (shape_id) WHERE v.f0 = start_fraction AND v.f1 = end_fraction
                UNION ALL SELECT route_id, direction_id, shape_id, segment_sequence, to_stop_id, 0, a_lon, a_lat
                  FROM segments WHERE end_fraction IS NULL
                UNION ALL SELECT route_id, direction_id, shape_id, segment_sequence, to_stop_id, 1, b_lon, b_lat
                  FROM segments WHERE end_fraction IS NULL) g
          WINDOW w AS (PARTITION BY route_id, direction_id, shape_id, segment_sequence, to_stop_id ORDER BY i)) s,
         (SELECT {lane_axis(1)}, {lane_axis(2)} FROM overlays) o
    WHERE s.bx IS NOT NULL AND s.route_id IN (SELECT route_id FROM stg_routes) AND ((
        {side_sql(*P, *Q[:2])} * {side_sql(*P, *Q[2:])} < 0 AND {side_sql(*Q, *P[:2])} * {side_sql(*Q, *P[2:])} < 0)
      OR least({metres_sql(*P[:2], *Q)}, {metres_sql(*P[2:], *Q)}, {metres_sql(*Q[:2], *P)}, {metres_sql(*Q[2:], *P)}) <= 25)"""


@register_after("overlay_near_segments", with_substring(NEAR_SQL))
def _(c):
    p = c.publication
    return geometry.lines_near(
        p.route_segment_layer, p.transit_only_lane_overlay, 25.0,
        ["route_id", "direction_id", "shape_id", "segment_sequence"],
    )


@register(
    "map_bounds",
    f"""SELECT {r6('lo_x - greatest((hi_x - lo_x) * 0.12, 0.006)')} AS west, {r6('lo_y - greatest((hi_y - lo_y) * 0.12, 0.006)')} AS south,
        {r6('hi_x + greatest((hi_x - lo_x) * 0.12, 0.006)')} AS east, {r6('hi_y + greatest((hi_y - lo_y) * 0.12, 0.006)')} AS north
        FROM (SELECT min(x) AS lo_x, max(x) AS hi_x, min(y) AS lo_y, max(y) AS hi_y FROM (
            SELECT shape_pt_lon AS x, shape_pt_lat AS y FROM lines JOIN stg_shapes USING (shape_id)
            UNION ALL SELECT stop_lon, stop_lat FROM points))""",
)
def _(c):
    p = c.publication
    boxes = geometry.box(p.route_geometries, lines=["geom"]).unionByName(
        geometry.box(p.stop_points, points=["geom"])
    )
    bounds = display.map_bounds(boxes)
    return bounds.select(*[round6(F.col(k)).alias(k) for k in bounds.columns])


RATIOS = [0.0, 0.25, 0.5, 1.0]


@register_after(
    "point_at_ratio",
    with_substring(
        f"""SELECT shape_id, ratio, {micro('CASE WHEN plon IS NULL THEN lon ELSE plon + (lon - plon) * share END', 'CASE WHEN plat IS NULL THEN lat ELSE plat + (lat - plat) * share END')} AS point
        FROM (SELECT t.shape_id, t.ratio, m.*, CASE WHEN m.step > 0 THEN least(1.0, (t.t - (m.m - m.step)) / m.step) ELSE 1.0 END AS share
            FROM (SELECT shape_id, ratio, total * ratio AS t FROM totals CROSS JOIN (VALUES (0.0::double), (0.25), (0.5), (1.0)) r(ratio)) t
            JOIN measured m ON m.shape_id = t.shape_id AND m.m >= t.t - 1e-15
            QUALIFY row_number() OVER (PARTITION BY t.shape_id, t.ratio ORDER BY m.i) = 1)"""
    ),
)
def _(c):
    lines = c.publication.route_geometries.select("shape_id", "geom").dropDuplicates(["shape_id"])
    measured = lines.withColumn("measures", geometry.line_measures(F.col("geom")))
    at = measured.withColumn("ratio", F.explode(F.array(*[F.lit(r) for r in RATIOS])))
    return at.withColumn(
        "p", geometry.point_at_ratio(F.col("geom"), F.col("measures"), F.col("ratio"))
    ).select("shape_id", "ratio", point_text("p").alias("point"))


@register_after(
    "stop_anchors",
    with_substring(
        f"""SELECT route_id, stop_id, point FROM (
            SELECT route_id, direction_id, segment_sequence, shape_id, unnest([0, 1]) AS e,
                unnest([from_stop_id, to_stop_id]) AS stop_id,
                unnest([split_part(line, ',', 1), split_part(line, ',', -1)]) AS point
            FROM (SELECT s.*, coalesce(g.line, {micro('s.a_lon', 's.a_lat')} || ',' || {micro('s.b_lon', 's.b_lat')}) AS line
                FROM segments s JOIN stg_routes r ON r.route_id = s.route_id
                LEFT JOIN stretches g ON g.shape_id = s.shape_id AND g.f0 = s.start_fraction AND g.f1 = s.end_fraction)
            WHERE direction_id IN (0, 1))
        QUALIFY row_number() OVER (PARTITION BY route_id, stop_id ORDER BY direction_id DESC, segment_sequence, shape_id, e) = 1"""
    ),
)
def _(c):
    anchors = display.stop_anchors(c.publication.route_segment_layer)
    return anchors.select("route_id", "stop_id", point_text("geom").alias("point"))


# --- data checks -----------------------------------------------------------------------


@register(
    "dq_unique_combination",
    """SELECT service_date, trip_id, stop_id, stop_sequence, count(*) AS row_count FROM raw_observations
       GROUP BY 1, 2, 3, 4 HAVING count(*) > 1""",
)
def _(c):
    keys = ["service_date", "trip_id", "stop_id", "stop_sequence"]
    return quality.dq_unique_combination(c.feed.stop_observations(), keys)


@register("dq_unique", "SELECT stop_id, count(*) AS row_count FROM stg_stop_times GROUP BY 1 HAVING count(*) > 1")
def _(c):
    return quality.dq_unique(c.publication.stop_times, "stop_id")


@register("dq_not_null", "SELECT trip_id, stop_sequence FROM stg_stop_times WHERE arrival_time_secs IS NULL")
def _(c):
    return quality.dq_not_null(c.publication.stop_times, "arrival_time_secs").select("trip_id", "stop_sequence")


@register(
    "dq_relationships",
    """SELECT route_id AS missing_key, count(*) AS row_count FROM stg_trips
       WHERE route_id NOT IN (SELECT route_id FROM stg_routes) GROUP BY 1""",
)
def _(c):
    p = c.publication
    return quality.dq_relationships(p.scheduled_trips, "route_id", p.scheduled_routes, "route_id")


CHECKED = {
    "scheduled_routes": "stg_routes", "scheduled_stops": "stg_stops", "scheduled_trips": "stg_trips",
    "service_dates": "stg_service_dates", "scheduled_stop_events": "stop_events",
    "observed_stop_events": "matched", "stop_points": "points",
    "route_window_summary": "window_summary", "route_direction_summary": "direction_summary",
    "route_hour_summary": "hour_summary", "stop_wait_metrics": "stop_waits",
    "route_segment_metrics": "segment_metrics", "route_geometries": "lines", "route_stop_segments": "segments",
    "route_map_layer": "(SELECT * FROM window_summary WHERE route_id IN (SELECT route_id FROM drawn_routes))",
    "route_segment_layer": "segment_metrics", "stop_map_layer": "points",
    "stop_wait_hotspots": "(SELECT * FROM stop_waits WHERE stop_id IN (SELECT stop_id FROM points))",
    "transit_only_lane_overlay": f"({OVERLAY_SQL})",
}


def report_sql() -> str:
    assert {*UNIQUE_KEYS, *quality.NOT_NULL} == {*CHECKED}
    parts = []
    for name, keys in UNIQUE_KEYS.items():
        if name in CHECKED:
            listed = ", ".join(keys)
            parts.append(
                f"""SELECT 'unique' AS check_name, '{name}' AS relation, '{",".join(keys)}' AS checked_columns,
                count(*) AS failure_count FROM (SELECT 1 FROM {CHECKED[name]} GROUP BY {listed} HAVING count(*) > 1)"""
            )
    for name, columns in quality.NOT_NULL.items():
        if name in CHECKED:
            parts += [
                f"SELECT 'not_null', '{name}', '{k}', count(*) FROM {CHECKED[name]} WHERE {k} IS NULL" for k in columns
            ]
    for child, column, parent, parent_column in quality.RELATIONSHIPS:
        if child in CHECKED and parent in CHECKED:
            parts.append(
                f"""SELECT 'relationships:{parent}', '{child}', '{column}', count(DISTINCT {column}) FROM {CHECKED[child]}
                WHERE {column} IS NOT NULL AND {column} NOT IN (SELECT {parent_column} FROM {CHECKED[parent]})"""
            )
    return "\nUNION ALL ".join(parts)


@register("dq_report", report_sql())
def _(c):
    return quality.dq_report({name: getattr(c.publication, name) for name in CHECKED})
