"""Cases where engines or layers easily differ."""

from datetime import date, datetime, timedelta, timezone

import pytest
from pyspark.sql import Row, functions as F

from feeds import (
    DAY, INBOUND, Line, META, OBSERVED, OUTBOUND, STOPS, frame, observation, observations,
    publication, raw_feed, rows,
)
from headwise.functions.columns import (
    clock_hour, clock_secs, elapsed_instant, local_hour, round6, wall_clock_instant,
)
from headwise.operators import marts, observed, schedule, spatial, trips as trip_ops
from headwise.operators.staging import FeedChoice, ObservedChoice, Staging
from headwise.plans.publish import Publication
from headwise.schemas import OBSERVATION_SCHEMA

UTC = timezone.utc


def one(df):
    return tuple(df.collect()[0])


def test_null_direction_matches_null(spark):
    line = Line("7", "", "Loop", "LOOP", ["A", "B", "C"], [0, 1, 2], INBOUND.trips, [0, 7, 15])
    p = publication(spark, [line], STOPS, OBSERVED)
    assert rows(p.headway_intervals.select("direction_id").distinct()) == [(None,)]
    got = rows(p.route_direction_summary, "direction_id", "direction_label", "matched_full_trip_count")
    assert got == [(None, "Loop", 3)]
    assert rows(p.route_segment_metrics, "matched_trip_segment_count") == [(3,), (3,)]


def test_rows_without_an_hour_keep_their_key_but_no_figure(spark):
    schema = "route_id string, direction_id int, hour_local int, n long"
    matched = spark.createDataFrame([("1", 0, None, 5), ("1", 0, 8, 2)], schema)
    none = spark.createDataFrame([], schema)
    sums = spark.createDataFrame(
        [], "route_id string, direction_id int, hour_local int, first_stop_id string,"
        " observed_sq double, observed_sum double, scheduled_sq double, scheduled_sum double,"
        " headway_count long",
    )
    losses = spark.createDataFrame(
        [], "route_id string, direction_id int, hour_local int, in_vehicle_loss_minutes double, trip_count long"
    )
    parts = marts.loss_parts(sums, losses, matched, none)
    routes = spark.createDataFrame([("1", "S", "L")], "route_id string, route_short_name string, route_long_name string")
    labels = spark.createDataFrame([], "route_id string, direction_id int, direction_label string")
    got = rows(
        marts.route_hour_summary(parts, routes, labels),
        "hour_local", "matched_observed_stop_event_count", "waiting_loss_minutes", "typical_trip_loss_minutes",
    )
    assert sorted(got, key=str) == [(8, 2, None, None), (None, 0, None, None)]


def test_ties_put_missing_values_last(spark):
    waits = spark.createDataFrame(
        [("1", None, "A", "none", 1.0), ("1", 0, "B", "zero", 1.0), ("1", 1, "C", "null loss", None)],
        "route_id string, direction_id int, stop_id string, stop_wait_label string, waiting_loss_minutes double",
    )
    assert one(marts.worst_stop_wait_label(waits)) == ("1", "zero")


def test_delay_rounds_half_away_from_zero(spark):
    base = datetime(2026, 1, 1, tzinfo=UTC)
    df = spark.createDataFrame(
        [(base + timedelta(seconds=2.5), base), (base - timedelta(seconds=2.5), base)],
        "o timestamp, s timestamp",
    )
    assert rows(df.select(observed.arrival_delay_secs(F.col("o"), F.col("s")))) == [(3,), (-3,)]


def test_round6_is_decimal(spark):
    df = spark.createDataFrame([(0.016667, 0.05), (33.3333335, 33.3333335)], "a double, b double")
    assert rows(df.select(round6((F.col("a") + F.col("b")) / 2))) == [(0.033334,), (33.333334,)]


def historic(spark, trip_ids, scope, label="v1"):
    meta = ("test", scope, "OP", label, datetime(2026, 5, 2))
    obs = [
        (date(2026, 5, 1), t, "A", 1, "x", datetime(2026, 5, 1, 10, tzinfo=UTC), *meta)
        for t in trip_ids
    ]
    return spark.createDataFrame(obs, OBSERVATION_SCHEMA)


def test_agency_filter_and_date_repair_only_in_the_exact_scope(spark):
    ids = ["SF:1:20260502", "SF:2:20260501", "SF:3", "OT:4:20260502", "SF:5:20261399"]
    for scope, expected in (
        ("regional_historic", {
            "SF:1:20260502": (date(2026, 5, 2), datetime(2026, 5, 2, 10)),
            "SF:2:20260501": (date(2026, 5, 1), datetime(2026, 5, 1, 10)),
            "SF:3": (date(2026, 5, 1), datetime(2026, 5, 1, 10)),
            "SF:5:20261399": (date(2026, 5, 1), datetime(2026, 5, 1, 10)),
        }),
        ("regional_historic_sf", dict.fromkeys(ids, (date(2026, 5, 1), datetime(2026, 5, 1, 10)))),
    ):
        staging = Staging({"stop_observations": historic(spark, ids, scope)}, FeedChoice(), ObservedChoice(scope))
        got = staging.stop_observations().select("trip_id", "service_date", "observed_arrival_ts")
        assert {r[0]: (r[1], r[2]) for r in rows(got)} == expected


def test_latest_snapshot_wins_and_an_explicit_one_can_be_chosen(spark):
    old, new = historic(spark, ["a"], "fixture", "v1"), historic(spark, ["b"], "fixture", "v2")
    raw = {"stop_observations": old.unionByName(new)}
    latest = Staging(raw, FeedChoice(), ObservedChoice("fixture")).stop_observations()
    chosen = Staging(raw, FeedChoice(), ObservedChoice("fixture", "v1")).stop_observations()
    assert (rows(latest, "trip_id"), rows(chosen, "trip_id")) == ([("b",)], [("a",)])


@pytest.mark.parametrize(
    "day, secs, wall, elapsed",
    [
        # No clock change: both conventions agree.
        ("2026-05-01", 28_800, "2026-05-01 15:00:00", "2026-05-01 15:00:00"),
        # Clocks go forward at 02:00, back at 02:00.
        ("2026-03-08", 28_800, "2026-03-08 15:00:00", "2026-03-08 16:00:00"),
        ("2026-11-01", 28_800, "2026-11-01 16:00:00", "2026-11-01 15:00:00"),
        # Past midnight of the service day.
        ("2026-02-13", 92_760, "2026-02-14 09:46:00", "2026-02-14 09:46:00"),
    ],
)
def test_time_conventions(spark, day, secs, wall, elapsed):
    df = spark.createDataFrame([(date.fromisoformat(day), secs)], "d date, s int")
    got = df.select(
        wall_clock_instant(F.col("d"), F.col("s")).cast("string"),
        elapsed_instant(F.col("d"), F.col("s")).cast("string"),
    )
    assert one(got) == (wall, elapsed)


def test_instants_do_not_depend_on_the_session_zone(spark):
    df = spark.createDataFrame([(date(2026, 5, 1), 28_800)], "d date, s int")
    ts = wall_clock_instant(F.col("d"), F.col("s"))
    query = df.select(F.unix_seconds(ts), F.unix_seconds(elapsed_instant(F.col("d"), F.col("s"))), local_hour(ts))
    expected = one(query)
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        assert one(query) == expected == (1_777_647_600, 1_777_647_600, 8)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_clock_text(spark):
    df = spark.createDataFrame([("25:46:07",), ("8:00:00",), ("",), (None,)], "t string")
    got = rows(df.select(clock_secs("t").alias("s")).select("s", clock_hour("s")))
    assert got == [(92_767, 1), (28_800, 8), (None, None), (None, None)]


def test_labels_treat_missing_names_as_empty(spark):
    stops = {**STOPS, "B": ("", *STOPS["B"][1:])}
    p = publication(spark, [INBOUND], stops, OBSERVED)
    assert sorted(rows(p.route_segment_metrics, "segment_label")) == [(" -> Gamma",), ("Alpha -> ",)]


def test_missing_arrival(spark):
    raw = raw_feed(spark, [INBOUND], STOPS)
    blank = (F.col("trip_id") == "in1") & (F.col("stop_sequence") == "2")
    raw["stop_times"] = raw["stop_times"].withColumn(
        "arrival_time", F.when(blank, "").otherwise(F.col("arrival_time"))
    )
    raw["stop_observations"] = observations(spark, [INBOUND], OBSERVED)
    p = Publication(raw, FeedChoice(), ObservedChoice("fixture"))
    # The lowest trip stands for the segment; without its arrival the minutes are 0, not NULL.
    assert sorted(rows(p.route_stop_segments, "segment_sequence", "scheduled_segment_minutes")) == [(1, 0.0), (2, 0.0)]
    assert sorted(rows(p.route_segment_metrics, "segment_sequence", "matched_trip_segment_count")) == [(1, 2), (2, 2)]
    event = p.join_audit.filter("trip_id = 'in1' AND stop_sequence = 2")
    assert rows(event, "join_status", "arrival_delay_secs", "scheduled_arrival_ts") == [("matched_exact", None, None)]


def test_duplicates_are_excluded_but_counted(spark):
    again = observation("in1", "A", 1, DAY + timedelta(minutes=482))
    p = publication(spark, [INBOUND], STOPS, OBSERVED, [again])
    assert dict(rows(p.join_summary, "join_status", "row_count")) == {
        "matched_exact": 8, "duplicate_observation_key": 2,
    }
    summary = p.route_window_summary
    assert rows(summary, "resolved_unmatched_observation_count", "matched_headway_interval_count") == [(2, 1)]
    # Counts follow the observed rows: 4 rows of the trip times its 3 stops.
    audit = p.join_audit.filter("trip_id = 'in1'")
    assert set(rows(audit, "stop_sequence", "scheduled_trip_service_date_count", "scheduled_trip_service_sequence_count")) == {
        (1, 12, 2), (2, 12, 1), (3, 12, 1),
    }


def test_repeated_trip_ids_multiply_matches_only(spark):
    raw = raw_feed(spark, [INBOUND], STOPS)
    again = raw["trips"].filter("trip_id = 'in1'").withColumn("trip_headsign", F.lit("Other"))
    raw["trips"] = raw["trips"].unionByName(again)
    stray = observation("in1", "WRONG", 2, DAY + timedelta(minutes=500))
    raw["stop_observations"] = observations(spark, [INBOUND], OBSERVED, [stray])
    p = Publication(raw, FeedChoice(), ObservedChoice("fixture"))
    got = p.join_audit.filter("trip_id = 'in1'").groupBy("join_status").count()
    assert dict(rows(got)) == {"matched_exact": 6, "unmatched_stop_id": 1}


def test_copies_of_a_stop_time_multiply_matches_only(spark):
    raw = raw_feed(spark, [INBOUND], STOPS)
    again = raw["stop_times"].filter("trip_id = 'in1' AND stop_sequence = '2'")
    raw["stop_times"] = raw["stop_times"].unionByName(again).unionByName(again)
    stray = observation("in1", "WRONG", 2, DAY + timedelta(minutes=500))
    raw["stop_observations"] = observations(spark, [INBOUND], OBSERVED, [stray])
    p = Publication(raw, FeedChoice(), ObservedChoice("fixture"))
    got = p.join_audit.filter("trip_id = 'in1' AND stop_sequence = 2")
    assert sorted(rows(got, "join_status", "scheduled_trip_service_sequence_count", "scheduled_trip_service_date_count")) == [
        ("matched_exact", 6, 20), ("matched_exact", 6, 20), ("matched_exact", 6, 20), ("unmatched_stop_id", 6, 20),
    ]


def test_a_missing_middle_trip_breaks_the_headway_chain(spark):
    seen = {**OBSERVED}
    p = publication(spark, [OUTBOUND], STOPS, seen)
    events = p.matched_first_stop_events
    assert trip_ops.headway_intervals(events).count() == 2
    assert trip_ops.headway_intervals(events.filter("trip_id <> 'out2'")).isEmpty()


def test_trip_order_over_many_trips_matches_one_window(spark):
    days = spark.range(3000).select(
        F.lit("1").alias("route_id"),
        F.when(F.col("id") % 3 == 0, None).otherwise((F.col("id") % 3).cast("int")).alias("direction_id"),
        F.lit("A").alias("first_stop_id"),
        F.lit(date(2026, 5, 1)).alias("service_date"),
        F.format_string("t%05d", (F.col("id") * 7919) % 3001).alias("trip_id"),
        F.when(F.col("id") % 50 == 0, None).otherwise((F.col("id") * 37 % 90_000).cast("int")).alias("first_arrival_time_secs"),
    )
    ordered = trip_ops.first_stop_trip_order(days).toPandas()
    ordered["key"] = ordered["first_arrival_time_secs"].fillna(10**9)
    ordered["direction_id"] = ordered["direction_id"].fillna(-1)
    for _, group in ordered.groupby("direction_id"):
        expected = group.sort_values(["key", "trip_id"])["first_stop_trip_order"].tolist()
        assert expected == list(range(1, len(group) + 1))


def test_removal_beats_addition_and_ranges_expand(spark):
    raw = raw_feed(
        spark, [INBOUND], STOPS,
        calendar=[
            ("FRI", 1, 1, 1, 1, 1, 0, 0, "20260501", "20260531"),
            ("BACK", 1, 1, 1, 1, 1, 1, 1, "20260510", "20260501"),
        ],
        calendar_dates=[
            ("FRI", "20260525", 2), ("FRI", "20260530", 1), ("FRI", "20260531", 1), ("FRI", "20260531", 2),
        ],
    )
    dates = [r[0].isoformat() for r in rows(Staging(raw).service_dates(), "service_date")]
    assert len(dates) == len(set(dates)) == 21
    assert "2026-05-30" in dates and not {"2026-05-25", "2026-05-31"} & set(dates)
    first = Staging(raw)
    events = schedule.scheduled_stop_events(first.trips(), first.service_dates(), first.stop_times())
    assert events.count() == 21 * 9


def test_unlisted_route_disappears_from_the_marts(spark):
    raw = raw_feed(spark, [INBOUND], STOPS)
    raw["routes"] = raw["routes"].withColumn("route_id", F.lit("other"))
    raw["stop_observations"] = observations(spark, [INBOUND], OBSERVED)
    p = Publication(raw, FeedChoice(label="v1"), ObservedChoice("fixture"))
    assert p.observed_stop_events.count() == 9
    for name in ("route_window_summary", "route_hour_summary", "stop_wait_metrics", "route_segment_metrics"):
        assert getattr(p, name).isEmpty(), name


def test_nearest_day(spark):
    night = Line("91", 0, "Owl", "OWL", ["A", "B"], [0, 1], [("owl1", 1546), ("owl2", 1576)], [0, 10])
    at = [
        observation("owl1", "A", 1, datetime(2026, 5, 1, 1, 46, 10, tzinfo=DAY.tzinfo)),
        observation("owl2", "A", 1, datetime(2026, 5, 2, 2, 16, 0, tzinfo=DAY.tzinfo)),
    ]
    raw = raw_feed(spark, [night], STOPS)
    raw["stop_observations"] = spark.createDataFrame(at, OBSERVATION_SCHEMA)
    p = Publication(raw, FeedChoice(), ObservedChoice("fixture"))
    got = p.observed_stop_events.select(
        "trip_id", F.col("observed_arrival_ts").cast("string"), "arrival_delay_secs"
    )
    assert sorted(rows(got)) == [("owl1", "2026-05-02 08:46:10", 10), ("owl2", "2026-05-02 09:16:00", 0)]
    assert rows(p.headway_intervals, "scheduled_headway_secs", "observed_headway_secs") == [(1800.0, 1790.0)]


@pytest.mark.parametrize("off, expected", [(43_200, 43_200), (-43_200, -43_200), (43_201, -43_199), (-43_201, 43_199)])
def test_nearest_day_ties_keep_the_raw_instant(spark, off, expected):
    base = datetime(2026, 1, 2, tzinfo=UTC)
    df = spark.createDataFrame([(base + timedelta(seconds=off), base)], "o timestamp, s timestamp")
    moved = observed.nearest_day_alignment(F.col("o"), F.col("s"))
    assert one(df.select(F.unix_seconds(moved) - F.unix_seconds("s"))) == (expected,)


def test_two_headsigns_on_one_shape_do_not_repeat_points(spark):
    other = Line("14", 0, "Airport", "IN", INBOUND.stops, INBOUND.dists, [("x1", 600)], INBOUND.runs)
    raw = raw_feed(spark, [INBOUND, other], STOPS)
    raw["shapes"] = raw["shapes"].distinct()
    staging = Staging(raw)
    got = rows(spatial.route_geometries(staging.trips(), staging.shapes()), "direction_label", F.size("geom"))
    assert got == [("Airport", 3)]


def test_gap_in_stop_sequence_makes_no_segment(spark):
    raw = raw_feed(spark, [INBOUND], STOPS)
    raw["stop_times"] = raw["stop_times"].filter("NOT (stop_sequence = '2')")
    raw["stop_observations"] = observations(spark, [INBOUND], OBSERVED)
    p = Publication(raw, FeedChoice(), ObservedChoice("fixture"))
    assert p.route_stop_segments.isEmpty() and p.trip_segment_metrics.isEmpty()
    assert p.full_trip_metrics.count() == 3
