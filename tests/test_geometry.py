import json
"""Geometry expressions against direct computation."""

from fractions import Fraction
import math
import random

import pytest
from pyspark.sql import functions as F

from feeds import rows
from headwise.functions import geometry as g, linework
from headwise.operators import display, reads
from headwise.schemas import LINE


def lines(spark, *geoms, route="1"):
    data = [(route, i, [{"lon": float(x), "lat": float(y)} for x, y in geom]) for i, geom in enumerate(geoms)]
    return spark.createDataFrame(data, f"route_id string, i int, geom {LINE.simpleString()}")


def points(value):
    return [(round(p["lon"], 9), round(p["lat"], 9)) for p in value]


def stretches(spark, line, *bounds):
    df = lines(spark, line).select(F.lit("k").alias("k"), "geom")
    spans = spark.createDataFrame([("k", a, b) for a, b in bounds], "k string, start double, end double")
    return {(r["start"], r["end"]): points(r["geom"]) for r in linework.line_stretches(df, spans, "k").collect()}


def test_stretches_and_ratio(spark):
    line = [(0, 0), (3, 4), (3, 10)]
    got = stretches(spark, line, (0.0, 1.0), (1 / 11, 8 / 11), (6 / 11, 7 / 11), (0.5, 0.5), (0.0, 5 / 11))
    assert got == {
        (0.0, 1.0): line, (1 / 11, 8 / 11): [(0.6, 0.8), (3, 4), (3, 7)], (6 / 11, 7 / 11): [(3, 5), (3, 6)], (0.0, 5 / 11): line[:2],
    }
    df = lines(spark, line).withColumn("m", g.line_measures(F.col("geom")))
    at = lambda r: points([rows(df.select(g.point_at_ratio(F.col("geom"), F.col("m"), F.lit(r))))[0][0]])[0]
    assert [at(0.0), at(0.5), at(1.0)] == [(0, 0), (3, 4.5), (3, 10)]


def test_stretches_of_odd_lines(spark):
    # A line without length, of one vertex, and one that stands still in between.
    assert stretches(spark, [(1, 1)], (0.2, 0.8)) == {(0.2, 0.8): [(1, 1), (1, 1)]}
    assert stretches(spark, [(1, 1)] * 3, (0.0, 1.0)) == {(0.0, 1.0): [(1, 1), (1, 1)]}
    still = [(0, 0), (1, 0), (1, 0), (4, 0)]
    assert stretches(spark, still, (0.0, 1.0), (0.25, 1.0), (0.0, 0.25)) == {
        (0.0, 1.0): still, (0.25, 1.0): [(1, 0), (4, 0)], (0.0, 0.25): [(0, 0), (1, 0)],
    }


def test_stretches_of_a_long_line(spark):
    """20,000 vertices and as many spans, one piece of half the length, against plain walking."""
    n = 20_000
    xs = [float(i) for i in range(n)] + [2.0 * n]
    df = spark.createDataFrame([("k", [{"lon": x, "lat": 0.0} for x in xs])], f"k string, geom {LINE.simpleString()}")
    spans = spark.range(n).select(
        F.lit("k").alias("k"), (F.col("id") / n).alias("start"), ((F.col("id") + 1) / n).alias("end")
    )
    got = linework.line_stretches(df, spans, "k").collect()
    assert len(got) == n
    for r in got:
        a, b = r["start"] * 2 * n, r["end"] * 2 * n
        want = [a, *[x for x in xs[max(0, int(a) - 1) : int(b) + 3] if a < x < b], b]
        assert [p["lon"] for p in r["geom"]] == pytest.approx(want, abs=1e-6), r


def test_degenerate_lines(spark):
    df = lines(spark, [(1, 1)], [(1, 1), (1, 1), (1, 1)]).withColumn("m", g.line_measures(F.col("geom")))
    got = rows(df.orderBy("i").select(g.point_at_ratio(F.col("geom"), F.col("m"), F.lit(0.5)), g.line_valid(F.col("geom"))))
    assert [(points([p])[0], ok) for p, ok in got] == [((1, 1), False), ((1, 1), False)]


def merged(spark, *geoms):
    (geom,) = rows(linework.line_union_merge(lines(spark, *geoms)), "geom")[0]
    return sorted(sorted((points(line), points(line)[::-1]))[0] for line in geom)


def test_union_merge(spark):
    # The return direction dissolves into the first line.
    assert merged(spark, [(0, 0), (1, 0), (2, 0)], [(2, 0), (1, 0), (0, 0)]) == [[(0, 0), (1, 0), (2, 0)]]
    # Consecutive lines chain, a branch stops the chaining.
    assert merged(spark, [(0, 0), (1, 0)], [(1, 0), (2, 0)]) == [[(0, 0), (1, 0), (2, 0)]]
    assert len(merged(spark, [(0, 0), (1, 0), (2, 0)], [(1, 0), (1, 1)])) == 3
    ring = merged(spark, [(0, 0), (1, 0), (1, 1), (0, 0)])
    assert len(ring) == 1 and len(ring[0]) == 4 and ring[0][0] == ring[0][-1]


def test_union_merge_keeps_every_piece(spark):
    rnd = random.Random(3)
    walks = []
    for _ in range(12):
        x = y = 5
        walk = [(x, y)]
        for _ in range(15):
            dx, dy = rnd.choice([(1, 0), (0, 1), (-1, 0), (0, -1)])
            x, y = x + dx, y + dy
            walk.append((x, y))
        walks.append(walk)
    expected = {frozenset(p) for walk in walks for p in zip(walk, walk[1:])}
    got = [frozenset(p) for line in merged(spark, *walks) for p in zip(line, line[1:])]
    assert len(got) == len(set(got)) and set(got) == expected


def test_union_merge_cuts_where_lines_meet(spark):
    # Between vertices, and where a vertex touches another line.
    assert merged(spark, [(0, 0), (2, 2)], [(0, 2), (2, 0)]) == [
        [(0, 0), (1, 1)], [(0, 2), (1, 1)], [(1, 1), (2, 0)], [(1, 1), (2, 2)]
    ]
    assert merged(spark, [(0, 0), (4, 0)], [(1, 0), (3, 0)], [(2, 0), (2, 1)]) == [
        [(0, 0), (1, 0), (2, 0)], [(2, 0), (2, 1)], [(2, 0), (3, 0), (4, 0)]
    ]
    # A ring of four lines, and a loop that ends in itself.
    assert merged(spark, [(0, 0), (1, 0)], [(1, 1), (1, 0)], [(1, 1), (0, 1)], [(0, 0), (0, 1)]) == [
        [(0, 0), (0, 1), (1, 1), (1, 0), (0, 0)]
    ]
    assert merged(spark, [(0, 0), (3, 0), (3, 2), (2, 2), (2, -1)]) == [
        [(0, 0), (2, 0)], [(2, -1), (2, 0)], [(2, 0), (2, 2), (3, 2), (3, 0), (2, 0)]
    ]


def plain_merge(lines):
    """All pairs of pieces, then a walk from every junction; integer vertices, exact fractions."""
    cross = lambda o, p, q: (p[0] - o[0]) * (q[1] - o[1]) - (p[1] - o[1]) * (q[0] - o[0])
    pieces = {tuple(sorted(p)) for line in lines for p in zip(line, line[1:]) if p[0] != p[1]}
    parts = set()
    for a, b in pieces:
        at = {a, b}
        for c, d in pieces - {(a, b)}:
            for v in (c, d):
                if cross(a, b, v) == 0 and min(a[0], b[0]) <= v[0] <= max(a[0], b[0]) and min(a[1], b[1]) <= v[1] <= max(a[1], b[1]):
                    at.add(v)
            if cross(a, b, c) * cross(a, b, d) < 0 and cross(c, d, a) * cross(c, d, b) < 0:
                t = Fraction(cross(a, b, c), cross(a, b, c) - cross(a, b, d))
                at.add((c[0] + (d[0] - c[0]) * t, c[1] + (d[1] - c[1]) * t))
        order = sorted(at)
        parts |= set(zip(order, order[1:]))
    near = {}
    for p, q in parts:
        near.setdefault(p, set()).add(q)
        near.setdefault(q, set()).add(p)
    out = set()
    for first in near:
        for second in near[first]:
            walk = [first, second]
            while len(near[walk[-1]]) == 2 and walk[-1] != first:
                walk.append(next(n for n in near[walk[-1]] if n != walk[-2]))
            if len(near[first]) != 2 or (walk[-1] == first and first == min(walk)):
                out.add(min(tuple(walk), tuple(walk[::-1])))
    return sorted([(round(float(x), 9), round(float(y), 9)) for x, y in line] for line in out)


@pytest.mark.parametrize("seed", range(3))
def test_union_merge_against_plain_walks(spark, seed):
    rnd = random.Random(seed)
    routes = {}
    for route in "abc":
        routes[route] = [[(rnd.randint(0, 6), rnd.randint(0, 6)) for _ in range(rnd.randint(1, 6))] for _ in range(5)]
        routes[route].append(routes[route][0][::-1])
    data = [(k, [(float(x), float(y)) for x, y in line]) for k, lines in routes.items() for line in lines]
    df = spark.createDataFrame(data, "route_id string, geom array<struct<lon:double,lat:double>>")
    got = {r["route_id"]: sorted([(round(p["lon"], 9), round(p["lat"], 9)) for p in line] for line in r["geom"]) for r in linework.line_union_merge(df).collect()}
    assert got == {k: plain_merge(lines) for k, lines in routes.items()}


def test_geojson_round_trip(spark):
    df = lines(spark, [(-122.418445, 37.752239), (-122.4, 37.75)])
    text = df.select(g.line_geojson(F.col("geom")).alias("t"))
    assert rows(text) == [('{"type":"LineString","coordinates":[[-122.418445,37.752239],[-122.4,37.75]]}',)]
    back = text.select(g.geojson_line("t").alias("g"))
    assert points(rows(back)[0][0]) == [(-122.418445, 37.752239), (-122.4, 37.75)]
    assert rows(spark.createDataFrame([('{"type":"Point","coordinates":[1,2]}',)], "t string").select(g.geojson_line("t"))) == [(None,)]


def metres(a, b, c, d):
    """Shortest distance between two pieces, sampled densely on a local plane."""
    lat = math.radians(a[1])
    kx, ky = 111_320 * math.cos(lat), 111_132.0

    def at(p, q, t):
        return ((p[0] + (q[0] - p[0]) * t) * kx, (p[1] + (q[1] - p[1]) * t) * ky)

    n = 60
    return min(
        math.dist(at(a, b, i / n), at(c, d, j / n)) for i in range(n + 1) for j in range(n + 1)
    )


def test_lines_near_equals_brute_force(spark):
    rnd = random.Random(5)

    def piece(reach):
        x, y = -122.45 + rnd.random() * 0.03, 37.70 + rnd.random() * 0.03
        return [(x, y), (x + (rnd.random() - 0.5) * reach, y + (rnd.random() - 0.5) * reach)]

    left, right = [piece(0.02) for _ in range(40)], [piece(0.01) for _ in range(15)]
    found = {r[0] for r in rows(g.lines_near(lines(spark, *left), lines(spark, *right), 150.0, ["i"]))}
    for i, a in enumerate(left):
        nearest = min(metres(*a, *b) for b in right)
        # Distances close to the limit may fall on either side of the sampling.
        if abs(nearest - 150) > 15:
            assert (i in found) == (nearest < 150), (i, nearest)


def test_map_bounds(spark):
    df = lines(spark, [(0, 0), (1, 0.01)], [(0.5, 0.002), (0.6, 0.005)])
    assert [round(v, 9) for v in rows(g.map_bounds(g.box(df, lines=["geom"])))[0]] == [-0.12, -0.006, 1.12, 0.016]
    assert g.map_bounds(g.box(df.limit(0), lines=["geom"])).isEmpty()


@pytest.mark.parametrize(
    "kind, value, band",
    [
        ("route", 10.0, "severe"), ("route", 5.0, "high"), ("route", 2.0, "moderate"), ("route", 0.1, "low"), ("route", 0.0, "none"),
        ("segment", 2.0, "severe"), ("segment", 1.4, "high"), ("segment", 0.8, "moderate"), ("segment", None, "none"),
        ("stop", 3.0, "severe"), ("stop", 2.0, "high"), ("stop", 1.0, "moderate"), ("stop", 0.0, "low"),
    ],
)
def test_severity(spark, kind, value, band):
    df = spark.createDataFrame([(value,)], "v double")
    assert rows(df.select(display.severity_band(F.col("v"), kind))) == [(band,)]


def test_peers(spark):
    ranked = spark.createDataFrame([(i, str(i), 10.0 - i) for i in range(1, 8)], "rank int, route_id string, typical_trip_loss_minutes double")
    peers = lambda route: sorted(r[0] for r in rows(display.route_peers(ranked, route), "peer_rank"))
    assert peers("4") == [2, 3, 5, 6]
    assert peers("1") == [2, 3]
    assert peers("unknown") == [1, 2, 3, 4]


def test_shares_of_a_route_without_loss(spark):
    df = spark.createDataFrame(
        [("1", 0.0, 0.0, 0.0), ("2", None, 1.5, None), ("3", 2.0, 0.5, 1.5)],
        "route_id string, typical_trip_loss_minutes double, waiting_loss_minutes double, in_vehicle_loss_minutes double",
    )
    assert rows(display.loss_shares(df)) == [("1", 0.0, 0.0), ("2", 1.0, 0.0), ("3", 0.25, 0.75)]
    assert rows(display.dominant_problem(df), "dominant_problem") == [
        ("waiting loss",), ("waiting loss",), ("in-vehicle loss",),
    ]
    assert rows(display.system_median(df)) == [(0.0,)]


def test_segment_responses(spark):
    """Order by sequence where longitudes run the other way; one response per direction."""
    layer = spark.createDataFrame(
        [
            ("1", "One", 0, "Out", "all_day", s, f"{s}", lon, label)
            for s, lon, label in ((2, -122.9, None), (1, -122.1, "a"), (10, -122.5, "c"))
        ]
        + [("1", "One", 1, None, "all_day", 1, "x", -122.0, "b")],
        "route_id string, route_name string, direction_id int, direction_label string, window_key string,"
        " segment_sequence int, shape_id string, lon double, segment_label string",
    ).withColumn("to_stop_id", F.lit("t")).withColumn(
        "geom", F.expr("array(named_struct('lon', lon, 'lat', 37.0D), named_struct('lon', lon, 'lat', 38.0D))")
    )
    got = reads.feature_collection(reads.segment_features(layer), "segments")
    found = {r["direction_id"]: json.loads(r["collection"]) for r in got.collect()}
    assert [f["properties"]["segment_sequence"] for f in found[0]["features"]] == [1, 2, 10]
    assert list(found[0]) == ["route_id", "route_name", "window", "direction_id", "direction_label", "type", "features"]
    assert (found[0]["type"], found[0]["window"], found[0]["direction_label"]) == ("FeatureCollection", "all_day", "Out")
    assert "segment_label" not in found[0]["features"][1]["properties"] and "lon" not in found[0]["features"][0]["properties"]
    assert found[0]["features"][0]["geometry"] == {"type": "LineString", "coordinates": [[-122.1, 37.0], [-122.1, 38.0]]}
    assert "direction_label" not in found[1] and len(found[1]["features"]) == 1


def test_stop_wait_and_map_responses(spark):
    stops = spark.createDataFrame(
        [("1", 0, "all_day", "b", 2.0), ("1", 0, "all_day", "a", 2.0), ("1", 0, "all_day", "c", None), ("1", 0, "all_day", "d", 10.0)],
        "route_id string, direction_id int, window_key string, stop_id string, waiting_loss_minutes double",
    ).withColumn("geom", F.expr("named_struct('lon', -122.0D, 'lat', 37.0D)")).withColumn(
        "metric_updated_at", F.timestamp_seconds(F.lit(0))
    )
    (row,) = reads.feature_collection(reads.stop_wait_features(stops), "stop_wait").collect()
    response = json.loads(row["collection"])
    assert [f["properties"]["stop_id"] for f in response["features"]] == ["d", "a", "b", "c"]
    assert row["feature_count"] == 4 and response["metric_updated_at"].startswith("1970-01-01T00:00:00")
    routes = spark.createDataFrame(
        [("2", "all_day", None, "{}"), ("1", "all_day", 0.5, "{}"), ("3", "all_day", 4.0, "{}")],
        "route_id string, window_key string, metric_value double, geometry_json string",
    )
    (row,) = reads.feature_collection(reads.map_features(routes, "waiting_loss_minutes"), "map").collect()
    response = json.loads(row["collection"])
    assert [f["properties"]["route_id"] for f in response["features"]] == ["3", "1", "2"]
    assert (response["window"], response["metric"]) == ("all_day", "waiting_loss_minutes")


def test_feature_lines_follow_the_order_over_all_tasks(spark):
    """Many features of one response and a few of another: places 1, 2, 3 ... per response."""
    df = spark.range(5000).select(
        F.when(F.col("id") < 4990, "a").otherwise("b").alias("window"), F.lit("m").alias("metric"),
        F.struct((F.col("id") * 7919 % 5000).alias("o0")).alias("_order"), F.col("id").cast("string").alias("feature"),
    )
    got = reads.feature_lines(df, "map").collect()
    for window, ids in (("a", range(4990)), ("b", range(4990, 5000))):
        want = [str(i) for i in sorted(ids, key=lambda i: i * 7919 % 5000)]
        mine = sorted((r["position"], r["feature"]) for r in got if r["window"] == window)
        assert mine == list(enumerate(want, 1)) and {r["feature_count"] for r in got if r["window"] == window} == {len(want)}
    assert reads.feature_lines(df.limit(0), "map").count() == 0
