"""Agency extract, shapes and month merging on small text feeds."""

from datetime import date
import hashlib

import pytest
from pyspark.sql import functions as F

from feeds import rows
from headwise.operators import archive
from headwise.schemas import FEED_COLUMNS


def table(spark, columns, data):
    return spark.createDataFrame([tuple(map(str, r)) for r in data], ", ".join(f"{c} string" for c in columns))


def feed(spark, **tables):
    return {name: table(spark, FEED_COLUMNS[name], data) for name, data in tables.items()}


def sha16(text):
    return hashlib.sha256(text.encode()).hexdigest()[:16]


OBS = ["service_date", "trip_id", "route_id", "agency_id", "stop_sequence", "to_stop_id", "observed_arrival_time"]


@pytest.fixture(scope="module")
def regional(spark):
    f = feed(
        spark,
        routes=[("SF:1", " SF ", "1", "One", "3", "", ""), ("AC:9", "AC", "9", "Nine", "3", "", "")],
        trips=[
            ("SF:1", "WK", "SF:T1:20230215", "Up", "0", "SH1"),
            ("SF:1", "WK", "SF:T2:20230215", "Up", "0", " "),
            ("AC:9", "AK", "AC:T9", "Out", "1", "SH9"),
        ],
        stops=[("S1", "a", "37", "-122"), ("S2", "b", "37", "-122"), ("S9", "z", "37", "-122")],
        stop_times=[
            ("SF:T1:20230215", "08:00:00", "08:00:00", "S1", "2", ""),
            ("SF:T1:20230215", "08:05:00", "08:05:00", "S2", "10", ""),
            ("AC:T9", "08:00:00", "08:00:00", "S9", "1", ""),
        ],
        shapes=[("SH1", "37", "-122", "1", ""), ("SH9", "37", "-122", "1", "")],
        calendar_dates=[("WK", "20230215", "1"), ("AK", "20230215", "1")],
    )
    f["stop_observations"] = table(spark, OBS, [
        ("20230215", "x", "", "SF", "1", "S1", "08:00:00"),
        ("20230215", "SF:other", "", "", "1", "S1", "08:00:00"),
        ("20230215", "y", "SF:1", "", "1", "S1", "08:00:00"),
        ("20230215", "AC:T9", "AC:9", "AC", "1", "S9", "08:00:00"),
        ("20230215", "SF:T1:20230215", "SF:1", "SF", "1", "S1", "08:00:00"),
    ])
    return f


def test_extract_keeps_what_the_agency_needs(regional):
    out = archive.agency_extract_closure(regional, "SF")
    assert dict(rows(archive.retained_counts(out))) == {
        "routes": 1, "trips": 2, "stop_times": 2, "stops": 2, "shapes": 1,
        "calendar_dates": 1, "stop_observations": 4,
    }
    assert out["stop_observations"].columns == OBS
    # T2 has neither a shape nor stops, so its derived id stays.
    assert dict(rows(out["trips"], "trip_id", "shape_id")) == {
        "SF:T1:20230215": "SH1", "SF:T2:20230215": "SF:shape_api:T2",
    }


def test_extract_of_an_unknown_agency_is_an_error(regional):
    with pytest.raises(ValueError, match="no route of the agency"):
        archive.agency_extract_closure(regional, "XX")


def test_trip_id_forms(spark):
    df = table(spark, ["t"], [("SF:A:B:20230215",), ("20230215",), ("SF:20230215",), ("OT:1:2023021",), (" SF:9 ",)])
    assert [r[0] for r in rows(df.select(archive.normalize_trip_id("t", "SF")))] == [
        "A:B", "20230215", "20230215", "OT:1:2023021", "9",
    ]


def test_stop_pattern_orders_numbers_not_text(spark):
    times = table(spark, FEED_COLUMNS["stop_times"], [("T", "", "", "S2", "10", ""), ("T", "", "", "S1", "9", ""), ("T", "", "", "", "11", "")])
    assert rows(archive.stop_pattern_key(times)) == [("T", hashlib.sha256(b"9:S1\n10:S2").hexdigest())]


def test_stop_pattern_orders_any_whole_number(spark):
    given = [("10000000001", "B"), ("9", "A"), ("-1", "Z"), ("x", "Y"), ("99999999999999999999", "C")]
    times = spark.createDataFrame([("T", n, s) for n, s in given], "trip_id string, stop_sequence string, stop_id string")
    text = "x:Y\n-1:Z\n9:A\n10000000001:B\n99999999999999999999:C"
    assert rows(archive.stop_pattern_key(times)) == [("T", hashlib.sha256(text.encode()).hexdigest())]


@pytest.fixture(scope="module")
def shapeless(spark):
    """Trips without shapes: p matches a current pattern, q has an unknown pattern, h none."""
    kept = feed(
        spark,
        trips=[
            ("SF:1", "W", "SF:p", "Up", "0", "SF:shape_api:p"), ("SF:1", "W", "SF:q", "Up", "0", "SF:shape_api:q"),
            ("SF:1", "W", "SF:h", "Up", "0", "SF:shape_api:h"), ("SF:1", "W", "SF:k", "Up", "0", "OWN"),
        ],
        stop_times=[
            ("SF:p", "", "", "A", "1", ""), ("SF:p", "", "", "B", "2", ""),
            ("SF:q", "", "", "A", "1", ""), ("SF:q", "", "", "Z", "2", ""), ("SF:k", "", "", "A", "1", ""),
        ],
        shapes=[("OWN", "1", "2", "1", "")],
    )
    current = feed(
        spark,
        trips=[("1", "W", "c1", "Up", "0", "CUR"), ("1", "W", "c2", "Up", "0", "CUR"), ("1", "W", "c3", "Down", "0", "")],
        stop_times=[(t, "", "", s, i, "") for t in ("c1", "c2") for i, s in ((1, "A"), (2, "B"))],
        shapes=[("CUR", "37.5", "-122.5", "1", ""), ("CUR", "37.6", "-122.6", "2", "")],
    )
    return kept, current


def test_shape_targets(shapeless):
    kept, current = shapeless
    trips = archive.assign_shape_target(kept["trips"], kept["stop_times"], current, "SF")
    pattern = sha16("1:A\n2:Z")
    assert dict(rows(trips, "trip_id", "shape_id")) == {
        "SF:p": "SF:active_shape:CUR",
        "SF:q": "SF:shape_pattern:" + sha16("\0".join(["1", "0", "Up", pattern])),
        "SF:h": "SF:active_shape:CUR",
        "SF:k": "OWN",
    }


def test_shape_backfill_in_order_of_preference(spark, shapeless):
    kept, current = shapeless
    trips = archive.assign_shape_target(kept["trips"], kept["stop_times"], current, "SF")
    args = (trips, kept["shapes"], kept["stop_times"], current, "SF")
    assert sorted(r[0].split(":")[1] for r in rows(archive.missing_shapes(trips, kept["shapes"]))) == [
        "active_shape", "shape_pattern",
    ]
    candidates = archive.shape_candidates(*args).filter("shape_id LIKE '%pattern%'").orderBy("position")
    assert rows(candidates, "trip_id", "priority") == [("SF:q", 0), ("c1", 2), ("c3", 3)]
    filled = archive.shape_backfill(*args)
    assert sorted(rows(filled, "shape_id", "shape_pt_lat")) == [
        ("SF:active_shape:CUR", "37.5"), ("SF:active_shape:CUR", "37.6"),
    ]
    with pytest.raises(RuntimeError, match="shape_pattern"):
        archive.shape_backfill(*args, check=True)
    payload = '{"Content":{"TimetableFrame":{"vehicleJourneys":{"ServiceJourney":{"LinkSequenceProjection":{"LineString":{"pos":["1 2","3 4"]}}}}}}}'
    points = archive.shapes_payload_parse(
        spark.createDataFrame([("c1", payload)], "lookup_trip_id string, payload string")
    )
    full = archive.shape_backfill(*args, points, check=True)
    assert full.count() == 4


def test_candidates_of_shapes_with_the_same_keys(spark):
    """Missing shapes of one route and direction share the order of the current trips, which is
    worked out once; each leaves out its own trip. Against the pairs one by one."""
    columns = "route_id service_id trip_id trip_headsign direction_id shape_id".split()
    owns = ["c0003", "SF:x:20260401", "c1100"]
    trips = table(spark, columns, [("SF:1", "w", t, "To A", "0", f"SF:shape_api:{t}") for t in owns])
    trips = trips.unionAll(trips.filter("trip_id = 'c0003'").withColumn("trip_headsign", F.lit("To B")))
    signs = {f"c{i:04d}": f"To {'ABC'[i % 3]}" for i in range(1500)}
    shapes = {t: "drawn" if int(t[1:]) % 100 == 0 else "" for t in signs}
    active = {
        "trips": table(spark, columns, [("1", "w", t, sign, "0", shapes[t]) for t, sign in signs.items()]),
        "stop_times": table(spark, ["trip_id", "stop_id", "stop_sequence"], [("other", "s", "1")]),
    }
    none = table(spark, ["shape_id"], [("there",)])
    found = archive.shape_candidates(trips, none, active["stop_times"], active, "SF")
    text = found._jdf.queryExecution().executedPlan().toString()
    assert text.index("Join") < text.index("Window"), "the pairs must not be sorted"

    want = set()
    for own in owns:
        mine = {"To A", "To B"} if own == "c0003" else {"To A"}
        best = {}
        for t, sign in signs.items():
            same = shapes[t] or t
            for priority in ([2] if sign in mine else []) + [3]:
                best[same] = min(best.get(same, (9, "")), (priority, t))
        unique = {t: priority for priority, t in best.values()} | {own: 0}
        for at, (priority, t) in enumerate(sorted((p, t) for t, p in unique.items()), 1):
            want.add((f"SF:shape_api:{own}", t, priority, at))
    got = [tuple(r) for r in found.select("shape_id", "trip_id", "priority", "position").collect()]
    assert len(got) == len(want) and set(got) == want


def test_current_trip_of_the_same_id_comes_first(spark, shapeless):
    kept, current = shapeless
    same = {**current, "trips": current["trips"].unionByName(
        table(spark, FEED_COLUMNS["trips"], [("1", "W", "q", "Else", "1", "SAME")])
    ), "shapes": current["shapes"].unionByName(table(spark, FEED_COLUMNS["shapes"], [("SAME", "9", "9", "1", "")]))}
    trips = archive.assign_shape_target(kept["trips"], kept["stop_times"], same, "SF")
    filled = archive.shape_backfill(trips, kept["shapes"], kept["stop_times"], same, "SF")
    got = filled.filter("shape_id LIKE '%pattern%'")
    assert rows(got, "shape_pt_lat") == [("9",)]


@pytest.mark.parametrize(
    "payload",
    [
        '{"Content":{}}',
        '{"Content":{"TimetableFrame":{"vehicleJourneys":{"ServiceJourney":{"LinkSequenceProjection":{"LineString":{"pos":["1"]}}}}}}}',
        '{"Content":{"TimetableFrame":{"vehicleJourneys":{"ServiceJourney":{"LinkSequenceProjection":{"LineString":{"pos":["a b"]}}}}}}}',
    ],
)
def test_bad_shape_answers_are_errors(spark, payload):
    df = spark.createDataFrame([("t", payload)], "lookup_trip_id string, payload string")
    with pytest.raises(Exception, match="USER_RAISED_EXCEPTION|Shape"):
        archive.shapes_payload_parse(df).collect()


def test_months():
    assert archive.newest_completed_month(date(2026, 5, 24)) == "2026-04"
    assert archive.newest_completed_month(date(2026, 1, 1)) == "2025-12"
    assert archive.trailing_months("2026-01", 3) == ["2025-11", "2025-12", "2026-01"]
    for bad in ("2026-13", "2026-1", "x"):
        with pytest.raises(ValueError):
            archive.validate_month(bad)
    with pytest.raises(ValueError):
        archive.trailing_months("2026-01", 0)


def month(spark, token, name, extra=False):
    trip = f"SF:TRIP:{token}01"
    f = feed(
        spark,
        trips=[("SF:14", "WKD", trip, "Up", "1", f"sh{token}"), ("SF:14", "WKD", f"{trip}b", "Up", "1", "")],
        stop_times=[(trip, "08:00:00", "08:00:00", "S1", "1", ""), ("gone", "", "", "S1", "1", "")],
        shapes=[(f"sh{token}", "37.0", "-122.0", "1", "")],
        stops=[("S1", f"{name} stop", "37.0", "-122.0")],
        calendar_dates=[("WKD", f"{token}01", "1"), ("NO", f"{token}01", "1")],
        routes=[("SF:14", "SF", "14", f"{name} route", "3", "", "")],
    )
    f["stop_observations"] = table(spark, OBS, [(f"{token}01", trip, "", "", "1", "S1", "08:01:00")])
    if extra:
        f["routes"] = f["routes"].withColumn("route_desc", F.lit("d"))
    return archive.with_month(f, f"{token[:4]}-{token[4:]}")


def test_months_merge(spark):
    joined = archive.union_months([month(spark, "202604", "Newer"), month(spark, "202603", "Older", extra=True)])
    out = archive.month_combine(joined)
    assert rows(out["routes"], "route_long_name", "route_desc") == [("Newer route", "")]
    assert rows(out["stops"], "stop_name") == [("Newer stop",)]
    assert sorted(rows(out["trips"], "trip_id", "service_id", "shape_id"))[0] == (
        "202603__SF:TRIP:20260301", "202603__WKD", "202603__sh202603",
    )
    assert sorted(r[0] for r in rows(out["trips"], "shape_id")).count("") == 2
    assert sorted(rows(out["stop_times"], "trip_id")) == [
        ("202603__SF:TRIP:20260301",), ("202604__SF:TRIP:20260401",),
    ]
    assert out["calendar_dates"].count() == 2 and out["stop_observations"].count() == 2
    assert "feed_month" not in out["trips"].columns


def test_months_without_shapes_or_observations_are_errors(spark):
    one = month(spark, "202604", "x")
    with pytest.raises(ValueError, match="has shapes"):
        archive.month_combine({**one, "shapes": one["shapes"].limit(0)})
    with pytest.raises(ValueError, match="has observations"):
        archive.month_combine({**one, "stop_observations": one["stop_observations"].limit(0)})
    with pytest.raises(ValueError, match="required"):
        archive.month_combine({k: v for k, v in one.items() if k != "shapes"})
