"""The registered queries in SQL, from the given tables up.

`RELATIONS` holds one SQL text per relation; `query` puts together a WITH clause of those
that a statement refers to. Waits and medians are rounded through DECIMAL, so that both
engines round the same decimal value. All dates lie in January, at UTC-8.
"""

import re

UTC_OFFSET = 28_800
FIGURES = "typical_trip_loss_minutes, waiting_loss_minutes, in_vehicle_loss_minutes"


def r6(expr: str) -> str:
    return f"cast(round(cast({expr} AS decimal(30,12)), 6) AS double)"


def clock(secs: str) -> str:
    parts = [f"({secs}) // 3600", f"(({secs}) // 60) % 60", f"({secs}) % 60"]
    return " || ':' || ".join(f"lpad(cast({p} AS varchar), 2, '0')" for p in parts)


def epoch_day(date: str) -> str:
    return f"cast(date_diff('day', DATE '1970-01-01', {date}) AS bigint) * 86400"


def local_hour(ts: str) -> str:
    return f"cast((({ts} - {UTC_OFFSET}) // 3600) % 24 AS integer)"


def micro(lon: str, lat: str) -> str:
    """A position as text in whole micro-degrees."""
    return f"cast(round(({lon}) * 1e6) AS bigint) || ' ' || cast(round(({lat}) * 1e6) AS bigint)"


def clock_secs(text: str) -> str:
    h, m, s = (f"cast(split_part({text}, ':', {i}) AS integer)" for i in (1, 2, 3))
    return f"CASE WHEN {text} <> '' THEN {h} * 3600 + {m} * 60 + {s} END"


def effective(sq: str, total: str) -> str:
    return f"(sum({sq}) / (2 * sum({total}) * 60.0))"


WAITING = r6(
    f"greatest(0.0, {effective('oh * oh', 'oh')} - {effective('sh * sh', 'sh')})"
)


def mapped(h: str) -> dict[str, str]:
    """The mapping of the order tables; `h` is '' for the current feed, 'h_' for the archive."""
    hist = bool(h)
    dated = "strftime(service_date + CASE WHEN k % 5 = 0 THEN 1 ELSE 0 END, '%Y%m%d')"
    trip_id = f"agency || ':' || k || ':' || {dated}" if hist else "cast(k AS varchar)"
    route_id = "agency || ':' || route" if hist else "cast(route AS varchar)"
    blank_shape = "k % 2 = 0" if hist else "k % 53 = 0"
    wrong_trip = (
        "CASE WHEN pk % 13 = 0 THEN cast(k AS varchar) ELSE trip_id END"
        if hist else "CASE WHEN pk % 50 = 0 THEN cast(-k AS varchar) ELSE trip_id END"
    )
    return {
        f"{h}nations": """SELECT n_nationkey AS route, n_name,
            CASE WHEN n_regionkey < 3 THEN 'SF' ELSE 'OT' END AS agency FROM nation""",
        f"{h}trip_base": f"""SELECT *, {trip_id} AS trip_id FROM (
            SELECT o_orderkey AS k, c_nationkey AS route, agency,
                CASE WHEN o_orderkey % 97 = 0 THEN 9 ELSE o_custkey % 2 END AS dir,
                o_orderkey % 14 AS d, 18000 + (o_orderkey * 37) % 72000 AS start_secs,
                DATE '2001-01-01' + cast(o_orderkey % 14 AS integer) AS service_date
            FROM orders JOIN customer ON o_custkey = c_custkey
            JOIN {h}nations ON route = c_nationkey)""",
        f"{h}stop_base": f"""SELECT *, start_secs + (seq - 1) * 300 AS due,
            'S' || route || '_' || dir || '_' || seq AS stop_id
            FROM (SELECT l_orderkey, min(l_partkey) AS pk, min(l_suppkey) AS sk,
                row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS seq
                FROM lineitem GROUP BY l_orderkey, l_linenumber)
            JOIN {h}trip_base ON l_orderkey = k""",
        f"{h}raw_routes": f"""SELECT {route_id} AS route_id, agency AS agency_id,
            n_name AS route_short_name,
            CASE WHEN route % 4 = 0 THEN '' ELSE n_name || ' Line' END AS route_long_name,
            '3' AS route_type, '' AS route_color, 'FFFFFF' AS route_text_color
            FROM {h}nations WHERE route <> 24""",
        f"{h}raw_trips": f"""SELECT {route_id} AS route_id, 'V' || route || '_' || d AS service_id,
            trip_id,
            CASE WHEN route % 6 = 5 THEN '' WHEN k % 10 = 0 THEN 'Short turn'
                ELSE 'To ' || dir END AS trip_headsign,
            CASE WHEN dir = 9 THEN '' ELSE cast(dir AS varchar) END AS direction_id,
            CASE WHEN {blank_shape} THEN '' ELSE 'SH' || route || '_' || dir END AS shape_id
            FROM {h}trip_base""",
        f"{h}raw_stop_times": f"""SELECT trip_id,
            CASE WHEN pk % 61 = 0 THEN '' ELSE {clock('due')} END AS arrival_time,
            {clock('due + 20')} AS departure_time, stop_id, cast(seq AS varchar) AS stop_sequence,
            CASE WHEN route % 7 = 3 THEN '' ELSE cast(seq - 1 AS varchar) END AS shape_dist_traveled
            FROM {h}stop_base""",
        f"{h}places": f"""SELECT DISTINCT route, dir, seq, stop_id,
            700000 + route * 3000 + seq * 1500 + dir * 100 + (seq * seq % 5) * 200 AS lat_micro,
            400000 + route * 2000 + seq * 2500 + dir * 300 AS lon_micro FROM {h}stop_base""",
        f"{h}raw_stops": f"""SELECT stop_id,
            CASE WHEN (route + seq) % 17 = 0 THEN ''
                ELSE 'Stop ' || route || ' ' || dir || ' ' || seq END AS stop_name,
            CASE WHEN (route * 3 + seq) % 29 = 0 THEN '' ELSE '37.' || lpad(cast(lat_micro AS varchar), 6, '0') END AS stop_lat,
            CASE WHEN (route * 3 + seq) % 29 = 0 THEN '' ELSE '-122.' || lpad(cast(lon_micro AS varchar), 6, '0') END AS stop_lon
            FROM {h}places""",
        f"{h}raw_shapes": f"""SELECT 'SH' || route || '_' || dir AS shape_id,
            '37.' || lpad(cast(lat_micro + mid * 700 AS varchar), 6, '0') AS shape_pt_lat,
            '-122.' || lpad(cast(lon_micro + mid * 900 AS varchar), 6, '0') AS shape_pt_lon,
            cast(seq * 2 - 1 + mid AS varchar) AS shape_pt_sequence,
            CASE WHEN route % 7 = 3 THEN '' ELSE (seq - 1) || CASE WHEN mid = 1 THEN '.5' ELSE '' END END AS shape_dist_traveled
            FROM {h}places CROSS JOIN (VALUES (0), (1)) AS m(mid)""",
        f"{h}services": f"""SELECT route, d, 'V' || route || '_' || d AS service_id
            FROM {h}nations CROSS JOIN range(14) AS days(d)""",
        f"{h}raw_calendar": f"""SELECT service_id, """
        + ", ".join(
            f"CASE WHEN d % 7 = {i} THEN '1' ELSE '0' END AS {n}"
            for i, n in enumerate(
                ["monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"]
            )
        )
        + f""", CASE WHEN d < 7 THEN '20010101' ELSE '20010108' END AS start_date,
            CASE WHEN d < 7 THEN '20010107' ELSE '20010114' END AS end_date FROM {h}services""",
        f"{h}raw_calendar_dates": f"""
            SELECT service_id, '20010115' AS date, '1' AS exception_type FROM {h}services WHERE d = 0
            UNION ALL SELECT service_id, '20010114', '2' FROM {h}services WHERE d = 13 AND route % 5 = 0
            UNION ALL SELECT service_id, '20010116', '1' FROM {h}services WHERE d = 6
            UNION ALL SELECT service_id, '20010116', '2' FROM {h}services WHERE d = 6""",
        f"{h}seen": f"""SELECT route, agency, service_date, pk, sk, k,
            {wrong_trip} AS trip_id,
            CASE WHEN sk % 20 = 0 THEN 'WRONG' ELSE stop_id END AS stop_id,
            CASE WHEN pk % 41 = 0 THEN 99 ELSE cast(seq AS integer) END AS stop_sequence,
            due + pk % 600 - 60 AS secs
            FROM {h}stop_base WHERE pk % 11 <> 0""",
        f"{h}raw_observations": f"""SELECT service_date, trip_id, stop_id, stop_sequence,
            {clock('secs')} AS observed_arrival_time,
            {epoch_day('service_date')} + {UTC_OFFSET} + secs
                + CASE WHEN pk % 29 = 0 THEN -86400 WHEN pk % 31 = 0 THEN 86400 ELSE 0 END AS observed,
            'obs_v' || v AS snapshot_label
            FROM {h}seen JOIN (VALUES (2, 1), (2, 2), (1, 3)) AS c(v, rule)
              ON rule = 1 OR (rule = 2 AND sk % 25 = 7) OR (rule = 3 AND pk % 20 = 3)""",
        f"{h}archive_observations": f"""SELECT strftime(service_date, '%Y%m%d') AS service_date, trip_id,
            cast(stop_sequence AS varchar) AS stop_sequence, stop_id AS to_stop_id,
            CASE WHEN pk % 23 = 0 THEN '' ELSE {clock('secs')} END AS observed_arrival_time,
            CASE WHEN pk % 3 = 0 THEN agency ELSE '' END AS agency_id,
            CASE WHEN pk % 3 = 1 THEN {route_id} ELSE '' END AS route_id
            FROM {h}seen""",
    }


def staged(h: str) -> dict[str, str]:
    """Staging of one feed; the archive scope is cut to one agency."""
    cut = bool(h)

    def where(clause):
        return f"WHERE {clause}" if cut else ""

    own_trips = f"SELECT trip_id FROM {h}stg_trips"
    return {
        f"{h}stg_routes": f"""SELECT DISTINCT route_id, nullif(agency_id, '') AS agency_id,
            nullif(route_short_name, '') AS route_short_name,
            nullif(route_long_name, '') AS route_long_name, cast(route_type AS integer) AS route_type,
            nullif(route_color, '') AS route_color, nullif(route_text_color, '') AS route_text_color
            FROM {h}raw_routes {where("agency_id = 'SF'")}""",
        f"{h}stg_trips": f"""SELECT DISTINCT route_id, service_id, trip_id,
            nullif(trip_headsign, '') AS trip_headsign,
            cast(nullif(direction_id, '') AS integer) AS direction_id,
            nullif(shape_id, '') AS shape_id FROM {h}raw_trips
            {where(f"route_id IN (SELECT route_id FROM {h}stg_routes)")}""",
        f"{h}stg_stop_times": f"""SELECT trip_id, nullif(arrival_time, '') AS arrival_time_text,
            departure_time AS departure_time_text, stop_id,
            cast(stop_sequence AS integer) AS stop_sequence,
            cast(nullif(shape_dist_traveled, '') AS double) AS shape_dist_traveled,
            {clock_secs('arrival_time')} AS arrival_time_secs,
            {clock_secs('departure_time')} AS departure_time_secs FROM {h}raw_stop_times
            {where(f"trip_id IN ({own_trips})")}""",
        f"{h}stg_stops": f"""SELECT DISTINCT stop_id, nullif(stop_name, '') AS stop_name,
            cast(nullif(stop_lat, '') AS double) AS stop_lat,
            cast(nullif(stop_lon, '') AS double) AS stop_lon FROM {h}raw_stops
            {where(f"stop_id IN (SELECT stop_id FROM {h}stg_stop_times)")}""",
        f"{h}stg_shapes": f"""SELECT shape_id, cast(shape_pt_lat AS double) AS shape_pt_lat,
            cast(shape_pt_lon AS double) AS shape_pt_lon,
            cast(shape_pt_sequence AS integer) AS shape_pt_sequence,
            cast(nullif(shape_dist_traveled, '') AS double) AS shape_dist_traveled FROM {h}raw_shapes
            {where(f"shape_id IN (SELECT shape_id FROM {h}stg_trips)")}""",
        f"{h}stg_service_dates": f"""WITH dated AS (
                SELECT service_id, strptime(date, '%Y%m%d')::date AS service_date, exception_type
                FROM {h}raw_calendar_dates),
            days AS (
                SELECT service_id, cast(unnest(generate_series(strptime(start_date, '%Y%m%d'),
                    strptime(end_date, '%Y%m%d'), INTERVAL 1 DAY)) AS date) AS service_date,
                    [monday, tuesday, wednesday, thursday, friday, saturday, sunday] AS flags
                FROM {h}raw_calendar),
            offered AS (
                SELECT service_id, service_date FROM days
                WHERE flags[isodow(service_date)] = '1'
                UNION SELECT service_id, service_date FROM dated WHERE exception_type = '1')
            SELECT service_id, service_date FROM offered
            WHERE (service_id, service_date) NOT IN (
                SELECT service_id, service_date FROM dated WHERE exception_type = '2')
            {f"AND service_id IN (SELECT service_id FROM {h}stg_trips)" if cut else ""}""",
    }


def labelled(side: str, key: str = "route_id") -> str:
    return f"coalesce({side}.route_long_name, {side}.route_short_name, {key})"


RELATIONS: dict[str, str] = {
    **mapped(""),
    **mapped("h_"),
    **staged(""),
    **staged("h_"),
    "stg_observations": """SELECT * FROM raw_observations WHERE snapshot_label = 'obs_v2'""",
    "h_stg_observations": """SELECT service_date + CASE WHEN late THEN 1 ELSE 0 END AS service_date,
        trip_id, stop_id, stop_sequence, observed_arrival_time,
        observed + CASE WHEN late THEN 86400 ELSE 0 END AS observed, snapshot_label
        FROM (SELECT *, coalesce(try_cast(CASE WHEN regexp_matches(trip_id, '^[^:]+:.+:\\d{8}$')
                THEN strptime(right(trip_id, 8), '%Y%m%d') END AS date) = service_date + 1, false) AS late
            FROM h_raw_observations
            WHERE snapshot_label = 'obs_v2' AND trip_id LIKE 'SF:%')""",
    "stop_events": """SELECT t.trip_id, t.route_id, t.service_id, s.service_date, st.stop_id,
        st.stop_sequence, t.trip_headsign, t.direction_id, t.shape_id, st.arrival_time_text,
        st.departure_time_text, st.arrival_time_secs, st.departure_time_secs,
        st.shape_dist_traveled
        FROM stg_trips t JOIN stg_service_dates s USING (service_id)
        JOIN stg_stop_times st ON st.trip_id = t.trip_id""",
    "key_count": """SELECT *, count(*) OVER (PARTITION BY service_date, trip_id, stop_id,
        stop_sequence, snapshot_label) AS observation_key_row_count FROM stg_observations""",
    "trip_candidates": """SELECT o.service_date, o.trip_id,
        count(s.trip_id) AS scheduled_trip_service_date_count
        FROM stg_observations o LEFT JOIN stop_events s
          ON s.service_date = o.service_date AND s.trip_id = o.trip_id
        GROUP BY 1, 2""",
    "slot_candidates": """SELECT o.service_date, o.trip_id, o.stop_sequence,
        count(s.trip_id) AS scheduled_trip_service_sequence_count
        FROM stg_observations o LEFT JOIN stop_events s
          ON s.service_date = o.service_date AND s.trip_id = o.trip_id
         AND s.stop_sequence = o.stop_sequence
        GROUP BY 1, 2, 3""",
    "joined": f"""SELECT o.service_date, o.trip_id, s.route_id, s.service_id,
        o.stop_id AS observed_stop_id, s.stop_id AS scheduled_stop_id, o.stop_sequence,
        s.trip_headsign, s.direction_id, s.shape_id, s.shape_dist_traveled,
        s.arrival_time_secs, s.departure_time_secs, o.observed AS observed_raw,
        o.observed_arrival_time, o.snapshot_label,
        {epoch_day('o.service_date')} + s.arrival_time_secs + {UTC_OFFSET} AS scheduled,
        {epoch_day('o.service_date')} + s.departure_time_secs + {UTC_OFFSET} AS scheduled_departure,
        o.observation_key_row_count, t.scheduled_trip_service_date_count,
        q.scheduled_trip_service_sequence_count
        FROM key_count o
        LEFT JOIN stop_events s ON s.service_date = o.service_date AND s.trip_id = o.trip_id
         AND s.stop_sequence = o.stop_sequence AND s.stop_id = o.stop_id
        LEFT JOIN trip_candidates t ON t.service_date = o.service_date AND t.trip_id = o.trip_id
        LEFT JOIN slot_candidates q ON q.service_date = o.service_date AND q.trip_id = o.trip_id
         AND q.stop_sequence = o.stop_sequence""",
    "audit": """SELECT *, cast(observed - scheduled AS integer) AS arrival_delay_secs,
        CASE WHEN observation_key_row_count > 1 THEN 'duplicate_observation_key'
             WHEN route_id IS NOT NULL THEN 'matched_exact'
             WHEN scheduled_trip_service_date_count = 0 THEN 'unmatched_trip_service_date'
             WHEN scheduled_trip_service_sequence_count = 0 THEN 'unmatched_stop_sequence'
             ELSE 'unmatched_stop_id' END AS join_status
        FROM (SELECT *, CASE
            WHEN scheduled IS NULL THEN observed_raw
            WHEN abs(off) <= abs(off + 86400) AND abs(off) <= abs(off - 86400) THEN observed_raw
            WHEN abs(off + 86400) <= abs(off - 86400) THEN observed_raw + 86400
            ELSE observed_raw - 86400 END AS observed
            FROM (SELECT *, observed_raw - scheduled AS off FROM joined))""",
    "matched": """SELECT *, observed_stop_id AS stop_id FROM audit WHERE join_status = 'matched_exact'""",
    "points": """SELECT * FROM stg_stops WHERE stop_lat IS NOT NULL AND stop_lon IS NOT NULL""",
    "lines": """SELECT t.route_id, t.direction_id, t.shape_id, min(t.trip_headsign) AS direction_label
        FROM stg_trips t WHERE t.shape_id IS NOT NULL
          AND t.shape_id IN (SELECT shape_id FROM stg_shapes) GROUP BY 1, 2, 3""",
    "shape_extent": """SELECT shape_id, max(shape_dist_traveled) AS longest, count(*) AS point_count
        FROM stg_shapes GROUP BY 1""",
    "known_stops": """SELECT t.route_id, t.direction_id, t.shape_id, t.trip_headsign, st.*, p.stop_name
        FROM stg_trips t JOIN stg_stop_times st ON st.trip_id = t.trip_id
        JOIN stg_stops p ON p.stop_id = st.stop_id""",
    "pairs": """SELECT * FROM (SELECT route_id, direction_id, shape_id, trip_id, trip_headsign,
        stop_sequence AS from_stop_sequence, stop_id AS from_stop_id, stop_name AS from_stop_name,
        shape_dist_traveled AS from_dist, arrival_time_secs AS from_secs,
        lead(stop_sequence) OVER w AS to_stop_sequence, lead(stop_id) OVER w AS to_stop_id,
        lead(stop_name) OVER w AS to_stop_name, lead(shape_dist_traveled) OVER w AS to_dist,
        lead(arrival_time_secs) OVER w AS to_secs
        FROM known_stops WINDOW w AS (PARTITION BY trip_id ORDER BY stop_sequence))""",
    "adjacent": """SELECT * FROM pairs WHERE to_stop_sequence = from_stop_sequence + 1""",
    "distinct_pairs": """SELECT * FROM adjacent QUALIFY row_number() OVER (PARTITION BY route_id,
        direction_id, shape_id, from_stop_sequence, from_stop_id, to_stop_id ORDER BY trip_id) = 1""",
    "fractions": """SELECT p.*, e.longest, a.stop_lon AS a_lon, a.stop_lat AS a_lat,
        b.stop_lon AS b_lon, b.stop_lat AS b_lat,
        CASE WHEN longest > 0 AND to_dist > from_dist THEN greatest(0.0, least(1.0, from_dist / longest)) END AS start_fraction,
        CASE WHEN longest > 0 AND to_dist > from_dist THEN greatest(0.0, least(1.0, to_dist / longest)) END AS end_fraction
        FROM distinct_pairs p JOIN shape_extent e USING (shape_id)
        JOIN points a ON a.stop_id = p.from_stop_id JOIN points b ON b.stop_id = p.to_stop_id""",
    "segments": f"""SELECT route_id, direction_id, shape_id, trip_id AS representative_trip_id,
        trip_headsign AS direction_label, from_stop_sequence AS segment_sequence, from_stop_id,
        from_stop_name, to_stop_id, to_stop_name,
        coalesce(from_stop_name, '') || ' -> ' || coalesce(to_stop_name, '') AS segment_label,
        {r6("greatest(0.0, coalesce((to_secs - from_secs) / 60.0, 0.0))")} AS scheduled_segment_minutes,
        from_dist, to_dist, start_fraction, end_fraction, a_lon, a_lat, b_lon, b_lat
        FROM fractions""",
    "terminals": f"""SELECT f.trip_id, f.route_id, f.service_id, f.service_date, f.direction_id,
        f.trip_headsign, f.stop_id AS first_stop_id, l.stop_id AS last_stop_id,
        f.stop_sequence AS first_stop_sequence, l.stop_sequence AS last_stop_sequence,
        f.arrival_time_secs AS first_arrival_time_secs, l.arrival_time_secs AS last_arrival_time_secs,
        {epoch_day('f.service_date')} + f.arrival_time_secs + {UTC_OFFSET} AS first_scheduled,
        {epoch_day('f.service_date')} + l.arrival_time_secs + {UTC_OFFSET} AS last_scheduled,
        cast((f.arrival_time_secs // 3600) % 24 AS integer) AS trip_start_hour_local,
        row_number() OVER (PARTITION BY f.route_id, f.direction_id, f.stop_id, f.service_date
            ORDER BY f.arrival_time_secs NULLS LAST, f.trip_id) AS first_stop_trip_order
        FROM (SELECT trip_id, service_date, min(stop_sequence) AS lo, max(stop_sequence) AS hi
              FROM stop_events GROUP BY 1, 2) b
        JOIN stop_events f ON f.trip_id = b.trip_id AND f.service_date = b.service_date AND f.stop_sequence = lo
        JOIN stop_events l ON l.trip_id = b.trip_id AND l.service_date = b.service_date AND l.stop_sequence = hi""",
    "full_trips": """SELECT t.route_id, t.direction_id, t.trip_headsign, t.service_date, t.trip_id,
        t.trip_start_hour_local, cast(l.observed - f.observed AS double) AS observed_runtime_secs,
        cast(last_arrival_time_secs - first_arrival_time_secs AS double) AS scheduled_runtime_secs,
        round(greatest(0.0, ((l.observed - f.observed) - (last_arrival_time_secs - first_arrival_time_secs)) / 60.0), 6)
            AS in_vehicle_loss_minutes
        FROM terminals t
        JOIN matched f ON f.trip_id = t.trip_id AND f.service_date = t.service_date
         AND f.stop_sequence = t.first_stop_sequence AND f.stop_id = t.first_stop_id
        JOIN matched l ON l.trip_id = t.trip_id AND l.service_date = t.service_date
         AND l.stop_sequence = t.last_stop_sequence AND l.stop_id = t.last_stop_id
        WHERE first_arrival_time_secs IS NOT NULL AND last_arrival_time_secs IS NOT NULL""",
    "first_events": """SELECT t.route_id, t.direction_id, t.trip_headsign, t.service_date, t.trip_id,
        t.first_stop_id, t.first_stop_trip_order, t.first_scheduled, f.observed AS first_observed
        FROM terminals t JOIN matched f ON f.trip_id = t.trip_id AND f.service_date = t.service_date
         AND f.stop_sequence = t.first_stop_sequence AND f.stop_id = t.first_stop_id
        WHERE first_scheduled IS NOT NULL""",
    "headways": f"""SELECT a.route_id, a.direction_id, a.trip_headsign, a.service_date, a.first_stop_id,
        {local_hour('(a.first_scheduled + (b.first_scheduled - a.first_scheduled) // 2)')} AS hour_local,
        cast(b.first_scheduled - a.first_scheduled AS double) AS sh,
        cast(b.first_observed - a.first_observed AS double) AS oh
        FROM first_events a JOIN first_events b ON b.route_id = a.route_id
         AND b.direction_id IS NOT DISTINCT FROM a.direction_id
         AND b.first_stop_id = a.first_stop_id AND b.service_date = a.service_date
         AND b.first_stop_trip_order = a.first_stop_trip_order + 1
        WHERE b.first_scheduled > a.first_scheduled AND b.first_observed > a.first_observed""",
    "labels_by_direction": """SELECT route_id, direction_id, min(trip_headsign) AS direction_label
        FROM stg_trips GROUP BY 1, 2""",
    "coverage": f"""SELECT route_id, direction_id, service_date, {local_hour('scheduled')} AS hour_local
        FROM matched""",
    "resolved": f"""SELECT coalesce(a.route_id, t.route_id) AS route_id,
        coalesce(a.direction_id, t.direction_id) AS direction_id, a.service_date,
        {local_hour('a.observed')} AS hour_local, a.join_status
        FROM audit a LEFT JOIN stg_trips t ON t.trip_id = a.trip_id
        WHERE a.join_status <> 'matched_exact' AND coalesce(a.route_id, t.route_id) IS NOT NULL""",
    "trip_segments": """SELECT * FROM (SELECT route_id, direction_id, shape_id, trip_id, service_date,
        stop_sequence AS segment_sequence, stop_id AS from_stop_id,
        lead(stop_sequence) OVER w AS to_stop_sequence, lead(stop_id) OVER w AS to_stop_id,
        lead(observed) OVER w - observed AS run, lead(arrival_time_secs) OVER w - arrival_time_secs AS plan
        FROM matched WINDOW w AS (PARTITION BY trip_id, service_date ORDER BY stop_sequence))
        WHERE to_stop_sequence = segment_sequence + 1""",
    "segment_losses": """SELECT route_id, direction_id, shape_id, trip_id, service_date, segment_sequence,
        from_stop_id, to_stop_id, round(greatest(0.0, (run - plan) / 60.0), 6) AS segment_in_vehicle_loss_minutes
        FROM trip_segments WHERE plan IS NOT NULL""",
    "segment_metrics": f"""SELECT s.route_id, {labelled('r', 's.route_id')} AS route_name,
        r.route_short_name, r.route_long_name, s.direction_id, s.direction_label, s.shape_id,
        'adjacent_stop_pair' AS segment_strategy, 'all_day' AS window_key, s.segment_sequence,
        s.from_stop_id, s.from_stop_name, s.to_stop_id, s.to_stop_name, s.segment_label,
        s.scheduled_segment_minutes,
        {r6('quantile_cont(l.segment_in_vehicle_loss_minutes, 0.5)')} AS segment_in_vehicle_loss_minutes,
        count(l.trip_id) AS matched_trip_segment_count
        FROM segments s JOIN stg_routes r ON r.route_id = s.route_id
        LEFT JOIN segment_losses l ON l.route_id = s.route_id
         AND l.direction_id IS NOT DISTINCT FROM s.direction_id AND l.shape_id = s.shape_id
         AND l.segment_sequence = s.segment_sequence AND l.from_stop_id = s.from_stop_id
         AND l.to_stop_id = s.to_stop_id
        GROUP BY ALL""",
    "stop_waits": f"""SELECT h.route_id, {labelled('r', 'h.route_id')} AS route_name,
        r.route_short_name, r.route_long_name, h.direction_id, d.direction_label,
        h.first_stop_id AS stop_id, s.stop_name,
        CASE WHEN d.direction_label IS NOT NULL THEN coalesce(s.stop_name, '') || ' (' || d.direction_label || ')'
             WHEN h.direction_id IS NOT NULL THEN coalesce(s.stop_name, '') || ' (Direction ' || h.direction_id || ')'
             ELSE s.stop_name END AS stop_wait_label,
        'all_day' AS window_key, 'first_stop_exact_match' AS stop_wait_strategy,
        h.scheduled_effective_wait_minutes, h.observed_effective_wait_minutes,
        h.waiting_loss_minutes, h.matched_headway_interval_count
        FROM (SELECT route_id, direction_id, first_stop_id,
                {r6(effective('sh * sh', 'sh'))} AS scheduled_effective_wait_minutes,
                {r6(effective('oh * oh', 'oh'))} AS observed_effective_wait_minutes,
                {WAITING} AS waiting_loss_minutes, count(*) AS matched_headway_interval_count
              FROM headways GROUP BY 1, 2, 3) h
        JOIN stg_routes r ON r.route_id = h.route_id JOIN stg_stops s ON s.stop_id = h.first_stop_id
        LEFT JOIN labels_by_direction d ON d.route_id = h.route_id
         AND d.direction_id IS NOT DISTINCT FROM h.direction_id""",
    "worst_stops": """SELECT route_id, stop_wait_label AS worst_stop_wait_label FROM stop_waits
        QUALIFY row_number() OVER (PARTITION BY route_id ORDER BY waiting_loss_minutes DESC NULLS LAST,
            direction_id NULLS LAST, stop_id) = 1""",
    "worst_stops_by_direction": """SELECT route_id, direction_id, stop_wait_label AS worst_stop_wait_label
        FROM stop_waits QUALIFY row_number() OVER (PARTITION BY route_id, direction_id
            ORDER BY waiting_loss_minutes DESC NULLS LAST, stop_id) = 1""",
    "worst_segments": """SELECT route_id, segment_label AS worst_segment_label FROM segment_metrics
        QUALIFY row_number() OVER (PARTITION BY route_id ORDER BY segment_in_vehicle_loss_minutes DESC NULLS LAST,
            direction_id NULLS LAST, segment_sequence, shape_id, segment_label) = 1""",
    "worst_segments_by_direction": """SELECT route_id, direction_id, segment_label AS worst_segment_label
        FROM segment_metrics QUALIFY row_number() OVER (PARTITION BY route_id, direction_id
            ORDER BY segment_in_vehicle_loss_minutes DESC NULLS LAST, segment_sequence, shape_id, segment_label) = 1""",
}


def _grain(name: str, keys: list[str]) -> dict[str, str]:
    """The figures of one grain: waiting, run time, coverage, joined over the key union."""
    listed = ", ".join(keys)
    trip_keys = ", ".join(
        "trip_start_hour_local AS hour_local" if k == "hour_local" else k for k in keys
    )
    on = {
        s: " AND ".join(
            f"{s}.{k} = k.{k}" if k in ("route_id", "hour_local")
            else f"{s}.{k} IS NOT DISTINCT FROM k.{k}"
            for k in keys
        )
        for s in "wrcu"
    }
    return {
        f"keys_{name}": f"""SELECT {listed} FROM coverage UNION SELECT {listed} FROM resolved
            UNION SELECT {trip_keys} FROM full_trips UNION SELECT {listed} FROM headways""",
        f"waiting_{name}": f"""SELECT {listed}, {WAITING} AS waiting_loss_minutes,
            count(*) AS matched_headway_interval_count FROM headways GROUP BY {listed}""",
        f"runtime_{name}": f"""SELECT {trip_keys},
            {r6('quantile_cont(in_vehicle_loss_minutes, 0.5)')} AS in_vehicle_loss_minutes,
            count(*) AS matched_full_trip_count FROM full_trips
            GROUP BY {", ".join("trip_start_hour_local" if k == "hour_local" else k for k in keys)}""",
        f"covered_{name}": f"""SELECT {listed}, count(*) AS matched_observed_stop_event_count
            FROM coverage GROUP BY {listed}""",
        f"uncovered_{name}": f"""SELECT {listed}, count(*) AS resolved_unmatched_observation_count
            FROM resolved GROUP BY {listed}""",
        f"figures_{name}": f"""SELECT {", ".join("k." + k for k in keys)},
            {r6('w.waiting_loss_minutes + r.in_vehicle_loss_minutes')} AS typical_trip_loss_minutes,
            w.waiting_loss_minutes, r.in_vehicle_loss_minutes,
            coalesce(c.matched_observed_stop_event_count, 0) AS matched_observed_stop_event_count,
            coalesce(u.resolved_unmatched_observation_count, 0) AS resolved_unmatched_observation_count,
            coalesce(w.matched_headway_interval_count, 0) AS matched_headway_interval_count,
            coalesce(r.matched_full_trip_count, 0) AS matched_full_trip_count
            FROM keys_{name} k
            LEFT JOIN waiting_{name} w ON {on["w"]} LEFT JOIN runtime_{name} r ON {on["r"]}
            LEFT JOIN covered_{name} c ON {on["c"]} LEFT JOIN uncovered_{name} u ON {on["u"]}""",
    }


RELATIONS |= _grain("route", ["route_id"])
RELATIONS |= _grain("direction", ["route_id", "direction_id"])
RELATIONS |= _grain("hour", ["route_id", "direction_id", "hour_local"])
RELATIONS |= {
    "window_summary": f"""SELECT f.route_id, {labelled('n', 'f.route_id')} AS route_name,
        n.route_short_name, n.route_long_name, 'all_day' AS window_key,
        f.* EXCLUDE (route_id), worst_stop_wait_label, worst_segment_label
        FROM figures_route f JOIN stg_routes n ON n.route_id = f.route_id
        LEFT JOIN worst_stops ws ON ws.route_id = f.route_id
        LEFT JOIN worst_segments wg ON wg.route_id = f.route_id""",
    "direction_summary": f"""SELECT f.route_id, {labelled('n', 'f.route_id')} AS route_name,
        n.route_short_name, n.route_long_name, f.direction_id, d.direction_label,
        'all_day' AS window_key, f.* EXCLUDE (route_id, direction_id),
        ws.worst_stop_wait_label, wg.worst_segment_label
        FROM figures_direction f JOIN stg_routes n ON n.route_id = f.route_id
        LEFT JOIN labels_by_direction d ON d.route_id = f.route_id
         AND d.direction_id IS NOT DISTINCT FROM f.direction_id
        LEFT JOIN worst_stops_by_direction ws ON ws.route_id = f.route_id
         AND ws.direction_id IS NOT DISTINCT FROM f.direction_id
        LEFT JOIN worst_segments_by_direction wg ON wg.route_id = f.route_id
         AND wg.direction_id IS NOT DISTINCT FROM f.direction_id""",
    "hour_summary": f"""SELECT f.route_id, {labelled('n', 'f.route_id')} AS route_name,
        n.route_short_name, n.route_long_name, f.direction_id, d.direction_label, f.hour_local,
        f.* EXCLUDE (route_id, direction_id, hour_local)
        FROM figures_hour f JOIN stg_routes n ON n.route_id = f.route_id
        LEFT JOIN labels_by_direction d ON d.route_id = f.route_id
         AND d.direction_id IS NOT DISTINCT FROM f.direction_id""",
    "bands": """SELECT route_id, coalesce(lpad(cast(hour_local AS varchar), 2, '0'), '') || ':00-'
            || coalesce(lpad(cast(hour_local AS varchar), 2, '0'), '') || ':59' AS worst_time_band
        FROM hour_summary QUALIFY row_number() OVER (PARTITION BY route_id
            ORDER BY typical_trip_loss_minutes DESC NULLS LAST, direction_id NULLS LAST, hour_local NULLS LAST) = 1""",
    "ranked": """SELECT cast(row_number() OVER (ORDER BY typical_trip_loss_minutes DESC NULLS LAST,
            s.route_id) AS integer) AS rank, s.*, b.worst_time_band
        FROM window_summary s LEFT JOIN bands b ON b.route_id = s.route_id""",
    # The route pieces of the map layer: every route with a drawn shape.
    "drawn_routes": "SELECT DISTINCT route_id FROM lines",
    "overlays": """SELECT route, 'lane_' || route AS overlay_id, n_name AS street_name,
        'Lane ' || route AS segment_name,
        CASE WHEN route % 4 = 1 THEN NULL ELSE cast(route AS varchar) END AS route_hint,
        CASE route % 3 WHEN 0 THEN 0 WHEN 1 THEN 100 ELSE 1000 END AS beside FROM nations""",
}


RELATIONS |= {
    "route_pieces": """SELECT route_id, shape_id, shape_pt_lon AS ax, shape_pt_lat AS ay,
        lead(shape_pt_lon) OVER w AS bx, lead(shape_pt_lat) OVER w AS yb
        FROM lines JOIN stg_shapes USING (shape_id)
        WINDOW w AS (PARTITION BY route_id, direction_id, shape_id ORDER BY shape_pt_sequence)""",
}


RELATIONS |= {
    # Lines cut wherever they cross or touch, every piece once, chained through the nodes that join two.
    "merged": """    WITH RECURSIVE piece AS (
        SELECT DISTINCT route_id, least({'x': ax, 'y': ay}, {'x': bx, 'y': yb}) AS lo, greatest({'x': ax, 'y': ay}, {'x': bx, 'y': yb}) AS hi
        FROM route_pieces WHERE bx IS NOT NULL AND NOT (ax = bx AND ay = yb)),
    near AS (
        SELECT p.route_id, p.lo AS a, p.hi AS b, q.lo AS c, q.hi AS d
        FROM piece p JOIN piece q ON p.route_id = q.route_id AND (p.lo, p.hi) <> (q.lo, q.hi)
         AND p.lo.x <= q.hi.x AND q.lo.x <= p.hi.x AND least(p.lo.y, p.hi.y) <= greatest(q.lo.y, q.hi.y) + 1e-9
         AND least(q.lo.y, q.hi.y) <= greatest(p.lo.y, p.hi.y) + 1e-9),
    sized AS (
        SELECT *, sqrt(power(b.x - a.x, 2) + power(b.y - a.y, 2)) AS n1, sqrt(power(d.x - c.x, 2) + power(d.y - c.y, 2)) AS n2 FROM near),
    met AS (
        SELECT *, ((b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x)) / n1 AS oc, ((b.x - a.x) * (d.y - a.y) - (b.y - a.y) * (d.x - a.x)) / n1 AS od,
            ((d.x - c.x) * (a.y - c.y) - (d.y - c.y) * (a.x - c.x)) / n2 AS oa, ((d.x - c.x) * (b.y - c.y) - (d.y - c.y) * (b.x - c.x)) / n2 AS ob
        FROM sized),
    cut AS (
        SELECT route_id, a, b, unnest([
            CASE WHEN oc * od < 0 AND oa * ob < 0 AND least(abs(oc), abs(od), abs(oa), abs(ob)) > 1e-10 THEN
                CASE WHEN (a, b) < (c, d) THEN {'x': round(c.x + (d.x - c.x) * (oc / (oc - od)), 12), 'y': round(c.y + (d.y - c.y) * (oc / (oc - od)), 12)}
                     ELSE {'x': round(a.x + (b.x - a.x) * (oa / (oa - ob)), 12), 'y': round(a.y + (b.y - a.y) * (oa / (oa - ob)), 12)} END END,
            CASE WHEN abs(oc) <= 1e-10 AND c <> a AND c <> b AND ((c.x - a.x) * (b.x - a.x) + (c.y - a.y) * (b.y - a.y)) / (n1 * n1) BETWEEN 0 AND 1 THEN c END,
            CASE WHEN abs(od) <= 1e-10 AND d <> a AND d <> b AND ((d.x - a.x) * (b.x - a.x) + (d.y - a.y) * (b.y - a.y)) / (n1 * n1) BETWEEN 0 AND 1 THEN d END]) AS p
        FROM met),
    stops AS (
        SELECT DISTINCT route_id, a, b, p FROM (
            SELECT * FROM cut WHERE p IS NOT NULL UNION ALL SELECT route_id, lo, hi, lo FROM piece UNION ALL SELECT route_id, lo, hi, hi FROM piece)),
    part AS (
        SELECT DISTINCT route_id, least(p, q) AS lo, greatest(p, q) AS hi FROM (
            SELECT route_id, p, lead(p) OVER (PARTITION BY route_id, a, b ORDER BY (p.x - a.x) * (b.x - a.x) + (p.y - a.y) * (b.y - a.y)) AS q FROM stops)
        WHERE q IS NOT NULL AND p <> q),
    way AS MATERIALIZED (SELECT route_id, lo AS p, hi AS q FROM part UNION ALL SELECT route_id, hi, lo FROM part),
    degree AS MATERIALIZED (SELECT route_id, p, count(*) AS n FROM way GROUP BY ALL),
    -- From every junction or end in every direction, through the nodes that join two pieces; and from
    -- those, as long as no lower node is met, for rings.
    walk AS (
        SELECT w.route_id, w.p AS first, n = 2 AS ring, [w.p, w.q] AS line, w.p AS before, w.q AS now FROM way w JOIN degree d USING (route_id, p)
        UNION ALL
        SELECT k.route_id, first, ring, list_append(line, w.q), now, w.q
        FROM walk k JOIN degree d ON d.route_id = k.route_id AND d.p = now AND d.n = 2
        JOIN way w ON w.route_id = k.route_id AND w.p = now AND w.q <> before
        WHERE now <> first AND NOT (ring AND now < first))
    SELECT DISTINCT k.route_id, least(line, list_reverse(line)) AS line
    FROM walk k JOIN degree d ON d.route_id = k.route_id AND d.p = now
    WHERE CASE WHEN ring THEN now = first ELSE d.n <> 2 OR now = first END""",
    "merged_routes": """SELECT route_id, string_agg(line, ';' ORDER BY line) AS merged_lines FROM (
        SELECT route_id, array_to_string([CAST(CAST(round(p.x * 1e7) AS BIGINT) AS VARCHAR) || ' ' || CAST(CAST(round(p.y * 1e7) AS BIGINT) AS VARCHAR) FOR p IN line], ',') AS line
        FROM merged) GROUP BY route_id""",
}


def query(statement: str) -> str:
    """The statement with the relations it needs, in dependency order."""
    order: list[str] = []

    def visit(text: str, seen: tuple = ()):
        for word in dict.fromkeys(re.findall(r"[A-Za-z_][A-Za-z0-9_]*", text)):
            if word in RELATIONS and word not in order and word not in seen:
                visit(RELATIONS[word], (*seen, word))
                order.append(word)

    visit(statement)
    if not order:
        return statement
    body = ",\n".join(f"{n} AS MATERIALIZED ({RELATIONS[n]})" for n in order)
    return f"WITH {body}\n{statement}"
