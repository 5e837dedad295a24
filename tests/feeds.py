"""Small hand-made feeds. Rows are generated from trip plans, so each plan reads as a table."""

from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from headwise.operators.staging import FeedChoice, ObservedChoice
from headwise.plans.publish import Publication
from headwise.schemas import FEED_COLUMNS, OBSERVATION_SCHEMA, OVERLAY_SCHEMA, feed_schema

LOADED = datetime(2026, 5, 2)
META = ("test", "fixture", "OP", "v1", LOADED)
ACTIVE_META = ("test", "operator_active", "OP", "v1", LOADED)


def clock(secs):
    return f"{secs // 3600:02d}:{secs // 60 % 60:02d}:{secs % 60:02d}"


def minutes(*values):
    return [v * 60 for v in values]


def frame(spark, table, rows, meta=ACTIVE_META):
    width = len(FEED_COLUMNS[table])
    full = [tuple(map(str, r)) + ("",) * (width - len(r)) + meta for r in rows]
    return spark.createDataFrame(full, feed_schema(table))


class Line:
    """A route direction: its stops with positions, and trips as (id, start, run minutes)."""

    def __init__(self, route, direction, headsign, shape, stops, dists, trips, runs):
        self.route, self.direction, self.headsign, self.shape = route, direction, headsign, shape
        self.stops, self.dists, self.trips, self.runs = stops, dists, trips, runs


# Stop positions along one street; the observed times give the published golden figures.
STOPS = {
    "A": ("Alpha", "37.752239", "-122.418445"),
    "B": ("Beta", "37.765051", "-122.419671"),
    "C": ("Gamma", "37.778646", "-122.414173"),
}
STOPS_49 = {
    "D": ("Delta", "37.742813", "-122.421045"),
    "E": ("Epsilon", "37.779861", "-122.413498"),
    "F": ("Zeta", "37.805892", "-122.424956"),
}
INBOUND = Line(
    "14", 0, "Downtown", "IN", ["A", "B", "C"], [0.0, 1.4, 3.1],
    [("in1", 480), ("in2", 490), ("in3", 505)], [0, 7, 15],
)
OUTBOUND = Line(
    "14", 1, "Outbound", "OUT", ["C", "B", "A"], [0.0, 1.7, 3.1],
    [("out1", 540), ("out2", 552), ("out3", 564)], [0, 7, 14],
)
NORTH = Line(
    "49", 0, "Downtown", "NORTH", ["D", "E", "F"], [0.0, 2.8, 5.4],
    [("n1", 420), ("n2", 432), ("n3", 444)], [0, 6, 14],
)
# Observed minutes of the day per trip and stop.
OBSERVED = {
    "in1": [481, 488, 497], "in2": [492, 500, 511], "in3": [507, 514, 523],
    "out1": [540, 548, 554], "out2": [558, 566, 576], "out3": [567, 574, 583],
}
OBSERVED_49 = {"n1": [421, 427, 435], "n2": [434, 440, 449], "n3": [445, 451, 460]}
PACIFIC_SUMMER = timezone(timedelta(hours=-7))
DAY = datetime(2026, 5, 1, tzinfo=PACIFIC_SUMMER)


def raw_feed(spark, lines, stops, calendar=None, calendar_dates=()):
    routes = sorted({line.route for line in lines})
    trips, times, shapes = [], [], []
    for line in lines:
        for trip, start in line.trips:
            trips.append((line.route, "FRI", trip, line.headsign, line.direction, line.shape))
            for i, stop in enumerate(line.stops):
                at = clock((start + line.runs[i]) * 60)
                times.append((trip, at, at, stop, i + 1, line.dists[i]))
        for i, stop in enumerate(line.stops):
            _, lat, lon = stops[stop]
            shapes.append((line.shape, lat, lon, i + 1, line.dists[i]))
    calendar = calendar or [("FRI", 0, 0, 0, 0, 1, 0, 0, "20260501", "20260501")]
    names = {"14": "Mission", "49": "Van Ness"}
    return {
        "routes": frame(spark, "routes", [(r, "OP", r, names.get(r, r), 3, "", "") for r in routes]),
        "trips": frame(spark, "trips", trips),
        "stops": frame(spark, "stops", [(s, *v) for s, v in stops.items()]),
        "stop_times": frame(spark, "stop_times", times),
        "shapes": frame(spark, "shapes", shapes),
        "calendar": frame(spark, "calendar", calendar),
        "calendar_dates": frame(spark, "calendar_dates", list(calendar_dates)),
    }


def observation(trip, stop, sequence, at, day=DAY.date(), meta=META):
    return (day, trip, stop, sequence, at.isoformat(), at.astimezone(timezone.utc), *meta)


def observations(spark, lines, seen, extra=()):
    rows = [
        observation(trip, line.stops[i], i + 1, DAY + timedelta(minutes=seen[trip][i]))
        for line in lines
        for trip, _ in line.trips
        for i in range(len(line.stops))
    ]
    return spark.createDataFrame(rows + list(extra), OBSERVATION_SCHEMA)


STRAYS = [
    observation("in2", "WRONG", 2, DAY + timedelta(minutes=500, seconds=30)),
    observation("nobody", "A", 1, DAY + timedelta(minutes=535)),
]


def overlays(spark):
    def lane(a, b):
        ends = ",".join(f"[{STOPS[s][2]},{STOPS[s][1]}]" for s in (a, b))
        return f'{{"type":"LineString","coordinates":[{ends}]}}'

    rows = [
        ("south", "Street", "A to B", "14", lane("A", "B"), *META),
        ("north", "Street", "B to C", "14", lane("B", "C"), *META),
    ]
    return spark.createDataFrame(rows, OVERLAY_SCHEMA)


def publication(spark, lines, stops, seen, extra=(), cut=None, **feed):
    raw = raw_feed(spark, lines, stops, **feed)
    raw["stop_observations"] = observations(spark, lines, seen, extra)
    raw["lane_overlays"] = overlays(spark)
    more = {} if cut is None else {"cut": cut}
    return Publication(raw, FeedChoice(), ObservedChoice(scope="fixture"), **more)


def two_route_publication(spark, cut=None):
    return publication(
        spark, [INBOUND, OUTBOUND, NORTH], {**STOPS, **STOPS_49}, {**OBSERVED, **OBSERVED_49},
        STRAYS, cut,
    )


def rows(df, *columns):
    df = df.select(*columns) if columns else df
    return [tuple(r) for r in df.collect()]
