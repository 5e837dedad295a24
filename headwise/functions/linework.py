"""Whole lines as sets of pieces: stretches between fractions of their length, and merging.

A stretch is found by an interval join of the measures of a line's pieces with the bounds that
are asked for, so its cost goes with the vertices and the stretches, not with their product.

Merging cuts lines where they meet, keeps every piece once and chains the rest. All steps are joins and aggregations over pieces. Pieces meet in the cells of a grid whose size
is the mean length of a route's pieces, so a piece lies in a few cells whatever the scale of
the drawing. Chains are found by pointer doubling over runs (stretches of one line without a
junction), which takes as many rounds as the logarithm of the runs in the longest chain. Only
output cells are collected: the points of a line, the lines of a route.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window, functions as F

from headwise.sources.store import Stage

# Degrees within which a vertex lies on a piece (some 0.01 mm), and digits of a crossing.
TOUCHING = 1e-10
CROSSING_DIGITS = 12


def measured_pieces(lines: DataFrame, key: str, line: str = "geom") -> DataFrame:
    """(key, at, a, b, since, upto): the pieces of every line with the length walked before and
    behind them, in degrees. Lines are walked vertex by vertex, in order."""
    vertices = lines.select(key, F.posexplode(line).alias("at", "b"))
    by_line = Window.partitionBy(key).orderBy("at")
    steps = vertices.withColumn("a", F.lag("b").over(by_line)).withColumn(
        "step", F.coalesce(F.hypot(F.col("b.lon") - F.col("a.lon"), F.col("b.lat") - F.col("a.lat")), F.lit(0.0))
    )
    walked = steps.withColumn("upto", F.sum("step").over(by_line.rowsBetween(Window.unboundedPreceding, 0)))
    return walked.withColumn("since", F.lag("upto").over(by_line)).filter("at > 0").select(key, "at", "a", "b", "since", "upto")


def line_stretches(lines: DataFrame, spans: DataFrame, key: str, line: str = "geom") -> DataFrame:
    """(key, start, end, geom): the part of a line, one per key, between two fractions of its
    length, for the distinct (key, start, end) of `spans` with start < end.

    A line without length gives its first vertex twice; spans of unknown lines give nothing.
    Pieces and spans meet in as many buckets of the length as the line has pieces, each pair in
    the first bucket that both reach, so a long piece or span is copied no more often than
    there are others beside it.
    """
    pieces = measured_pieces(lines, key, line)
    totals = pieces.groupBy(key).agg(F.max("upto").alias("total"), F.count("*").alias("many"))
    asked = spans.select(key, "start", "end").distinct().filter("start < end").join(
        lines.select(key, F.col(line)[0].alias("origin")), key
    )
    bounded = asked.join(totals, key, "left").withColumns(
        {"first": F.col("total") * F.col("start"), "last": F.col("total") * F.col("end")}
    )
    bucket = lambda measure: F.least(F.floor(measure / F.col("total") * F.col("many")), F.col("many") - 1)
    placed = pieces.join(totals.filter("total > 0"), key).withColumn("low", bucket(F.col("since"))).withColumn(
        "bucket", F.explode(F.sequence("low", bucket(F.col("upto"))))
    ).select(key, "at", "a", "b", "since", "upto", F.col("low").alias("piece_low"), "bucket")
    reach = bounded.filter("total > 0").withColumn("low", bucket(F.col("first"))).withColumn(
        "bucket", F.explode(F.sequence("low", bucket(F.col("last"))))
    ).select(key, "start", "end", "first", "last", F.col("low").alias("span_low"), "bucket")
    met = placed.join(reach, [key, "bucket"]).filter(
        (F.col("upto") > F.col("first")) & (F.col("since") < F.col("last")) & (F.col("bucket") == F.greatest("piece_low", "span_low"))
    )

    def at(measure: str) -> Column:
        share = F.least((F.col(measure) - F.col("since")) / (F.col("upto") - F.col("since")), F.lit(1.0))
        between = lambda axis: (F.col(f"a.{axis}") + (F.col(f"b.{axis}") - F.col(f"a.{axis}")) * share).alias(axis)
        return F.when(share == 1.0, F.col("b")).otherwise(F.struct(between("lon"), between("lat")))

    ends = F.when(F.col("upto") < F.col("last"), F.col("b")).otherwise(at("last"))
    begins = F.when(F.col("since") <= F.col("first"), at("first"))
    parts = met.groupBy(key, "start", "end").agg(
        F.array_sort(F.collect_list(F.struct("at", ends.alias("to"), begins.alias("from")))).alias("p")
    )
    geom = F.concat(F.array(F.col("p")[0]["from"]), F.transform("p", lambda x: x["to"]))
    flat = bounded.filter("total IS NULL OR total = 0").select(key, "start", "end", F.array("origin", "origin").alias("geom"))
    return parts.select(key, "start", "end", geom.alias("geom")).unionAll(flat)


def _off(a: Column, b: Column, p: Column) -> Column:
    """Distance of a point from the straight line through a and b, signed by its side."""
    dx, dy = b["lon"] - a["lon"], b["lat"] - a["lat"]
    return (dx * (p["lat"] - a["lat"]) - dy * (p["lon"] - a["lon"])) / F.hypot(dx, dy)


def _along(a: Column, b: Column, p: Column) -> Column:
    """How far along a-b the foot of the point lies: 0 at a, 1 at b."""
    dx, dy = b["lon"] - a["lon"], b["lat"] - a["lat"]
    return ((p["lon"] - a["lon"]) * dx + (p["lat"] - a["lat"]) * dy) / (dx * dx + dy * dy)


def _inside(a: Column, b: Column, p: Column) -> Column:
    """Whether a vertex lies on a piece between its ends."""
    t = _along(a, b, p)
    return (F.abs(_off(a, b, p)) <= TOUCHING) & (t > 0) & (t < 1) & (p != a) & (p != b)


def _apart(x: Column, y: Column) -> Column:
    """Whether two distances lie on different sides, neither within touch."""
    return (x * y < 0) & (F.abs(x) > TOUCHING) & (F.abs(y) > TOUCHING)


def _crossing(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Where two pieces cross between their ends, else NULL."""
    away, beyond = _off(a, b, c), _off(a, b, d)
    t = away / (away - beyond)
    at = lambda axis: F.round(c[axis] + (d[axis] - c[axis]) * t, CROSSING_DIGITS)
    crosses = _apart(away, beyond) & _apart(_off(c, d, a), _off(c, d, b))
    return F.when(crosses, F.struct(at("lon").alias("lon"), at("lat").alias("lat")))


def _undirected(a: Column, b: Column) -> list[Column]:
    return [F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")]


def _in_cells(distinct: DataFrame) -> DataFrame:
    """Distinct pieces with the grid cells they pass: long ones cell by cell."""
    extent = F.greatest(F.abs(F.col("hi.lon") - F.col("lo.lon")), F.abs(F.col("hi.lat") - F.col("lo.lat")))
    sizes = distinct.groupBy("route_id").agg(F.greatest(F.avg(extent), F.lit(1e-7)).alias("cell"))
    sized = distinct.join(sizes, "route_id")
    n = F.greatest(F.lit(1).cast("long"), F.ceil(extent / F.col("cell")))
    steps = sized.withColumn("n", n).withColumn("i", F.explode(F.sequence(F.lit(1).cast("long"), n)))

    def span(axis: str) -> Column:
        step = (F.col(f"hi.{axis}") - F.col(f"lo.{axis}")) / F.col("n")
        one, other = F.col(f"lo.{axis}") + step * (F.col("i") - 1), F.col(f"lo.{axis}") + step * F.col("i")
        pad = 2 * TOUCHING
        return F.sequence(
            F.floor((F.least(one, other) - pad) / F.col("cell")), F.floor((F.greatest(one, other) + pad) / F.col("cell"))
        )

    cells = steps.withColumn("x", F.explode(span("lon"))).withColumn("y", F.explode(span("lat")))
    return cells.select("route_id", "lo", "hi", "x", "y").distinct()


def cuts(distinct: DataFrame) -> DataFrame:
    """(route_id, lo, hi, points): where other pieces of the route cross or touch a piece
    between its ends."""
    cells = _in_cells(distinct)
    one = cells.select("route_id", "x", "y", F.col("lo").alias("a"), F.col("hi").alias("b"))
    other = cells.select("route_id", "x", "y", F.col("lo").alias("c"), F.col("hi").alias("d"))
    a, b, c, d = map(F.col, "abcd")
    # Pieces that only share an end are most pairs of a cell; a third vertex may still touch.
    met = one.join(other, ["route_id", "x", "y"]).filter(F.struct("a", "b") < F.struct("c", "d")).select("route_id", *"abcd").distinct()

    def on(x: Column, y: Column, *vertices: Column) -> list[Column]:
        return [F.when(_inside(x, y, v), v) for v in vertices]

    found = met.withColumn("at", _crossing(a, b, c, d)).select(
        "route_id", *"abcd", F.array_compact(F.array("at", *on(a, b, c, d))).alias("p"), F.array_compact(F.array("at", *on(c, d, a, b))).alias("q")
    )
    first = found.select("route_id", F.col("a").alias("lo"), F.col("b").alias("hi"), F.explode("p").alias("point"))
    second = found.select("route_id", F.col("c").alias("lo"), F.col("d").alias("hi"), F.explode("q").alias("point"))
    return first.unionAll(second).groupBy("route_id", "lo", "hi").agg(F.collect_set("point").alias("points"))


def noded(lines: DataFrame, line: str, cut) -> DataFrame:
    """(route_id, line, at, part, a, b): the pieces of every line in its direction, cut wherever
    pieces of the route cross or touch."""
    geom = F.col("_g")
    spans = F.when(
        F.size(geom) >= 2,
        F.transform(F.sequence(F.lit(1), F.size(geom) - 1), lambda i: F.struct(geom[i - 1].alias("a"), geom[i].alias("b"))),
    )
    walked = cut(
        "pieces",
        lines.select("route_id", F.col(line).alias("_g")).distinct()
        .withColumn("line", F.monotonically_increasing_id())
        .select("route_id", "line", F.posexplode(spans).alias("at", "p"))
        .select("route_id", "line", "at", "p.a", "p.b").filter("a <> b"),
    )
    distinct = walked.select("route_id", *_undirected(F.col("a"), F.col("b"))).distinct()
    whole = walked.withColumns({"lo": F.least("a", "b"), "hi": F.greatest("a", "b")})
    joined = whole.join(cuts(distinct), ["route_id", "lo", "hi"], "left")
    a, b = F.col("a"), F.col("b")
    inner = F.transform(F.coalesce("points", F.array()), lambda p: F.struct(_along(a, b, p).alias("t"), p.alias("p")))
    stops = F.concat(F.array(a), F.transform(F.array_sort(inner), lambda s: s["p"]), F.array(b))
    parts = F.transform(
        F.sequence(F.lit(1), F.size("_s") - 1), lambda i: F.struct(F.col("_s")[i - 1].alias("a"), F.col("_s")[i].alias("b"))
    )
    split = joined.withColumn("_s", stops).select("route_id", "line", "at", F.posexplode(parts).alias("part", "p"))
    return split.select("route_id", "line", "at", "part", "p.a", "p.b").filter("a <> b")


def _runs(pieces: DataFrame, cut) -> tuple[DataFrame, DataFrame]:
    """(runs, degrees). Every distinct piece belongs to the first line that has it; a run is a
    stretch of a line's own pieces without a junction inside."""
    owned = cut("owned", pieces.groupBy("route_id", *_undirected(F.col("a"), F.col("b"))).agg(
        F.min(F.struct("line", "at", "part", "a", "b")).alias("own")
    ).select("route_id", "own.*"))
    ends = owned.select("route_id", F.explode(F.array("a", "b")).alias("node"))
    degrees = ends.groupBy("route_id", "node").agg(F.count("*").alias("degree"))
    by_line = Window.partitionBy("route_id", "line").orderBy("at", "part")
    before = F.lag("b").over(by_line)
    begins = before.isNull() | (before != F.col("a")) | (F.col("degree") != 2)
    counted = owned.join(degrees.withColumnRenamed("node", "a"), ["route_id", "a"]).withColumn("_new", begins.cast("int"))
    numbered = counted.withColumn("run", F.sum("_new").over(by_line))
    steps = F.array_sort(F.collect_list(F.struct("at", "part", "a", "b")))
    runs = numbered.groupBy("route_id", "line", "run").agg(steps.alias("s")).select(
        "route_id", F.struct("line", "run").alias("run"),
        F.concat(F.array(F.col("s")[0]["a"]), F.transform("s", lambda x: x["b"])).alias("points"),
    )
    return cut("runs", runs), degrees


def _ranked(steps: DataFrame, cut) -> DataFrame:
    """Pointer doubling over (id, nxt): the last id that can be reached (`to`), how many steps it
    is away, whether there is no last one (a ring, `open`), and the lowest id on the way."""
    now = cut("rank", steps.select(
        "id", F.coalesce("nxt", "id").alias("to"), F.col("nxt").isNotNull().cast("long").alias("dist"),
        F.col("nxt").isNotNull().alias("open"), F.col("id").alias("low"),
    ))
    seen = None
    while True:
        state = now.agg(F.count_if("open"), F.bit_xor(F.xxhash64("id", "low"))).first()
        if not state[0] or state == seen:
            return now
        seen = state
        there = now.select(F.col("id").alias("to"), F.col("to").alias("t"), F.col("dist").alias("d"), F.col("open").alias("o"), F.col("low").alias("l"))
        now = cut("rank", now.join(there, "to").select(
            "id", F.col("t").alias("to"), (F.col("dist") + F.col("d")).alias("dist"), F.col("o").alias("open"), F.least("low", "l").alias("low")
        ))


def _chained(runs: DataFrame, degrees: DataFrame, cut) -> DataFrame:
    """(route_id, points) of the merged lines."""
    ends = runs.select(
        "route_id", "run", F.explode(F.array(
            F.struct(F.lit(0).alias("at_end"), F.col("points")[0].alias("node")),
            F.struct(F.lit(1).alias("at_end"), F.element_at("points", -1).alias("node")),
        )).alias("e"),
    ).select("route_id", "run", "e.*").join(degrees.filter("degree = 2"), ["route_id", "node"])
    # Two ends meet in such a node, or none does. A run that meets itself is a ring.
    pair = ends.groupBy("route_id", "node").agg(F.min(F.struct("run", "at_end")).alias("x"), F.max(F.struct("run", "at_end")).alias("y"))
    met = cut("met", pair.filter("x.run <> y.run").select("route_id", "x", "y"))
    if met.isEmpty():
        return runs.select("route_id", "points")
    both = met.unionAll(met.select("route_id", F.col("y").alias("x"), F.col("x").alias("y")))
    # Walking a run forwards (turned = 0) leaves it at its end, backwards at its beginning.
    onward = both.select(
        F.struct("route_id", F.col("x.run").alias("run"), (1 - F.col("x.at_end")).alias("turned")).alias("id"),
        F.struct("route_id", F.col("y.run").alias("run"), F.col("y.at_end").alias("turned")).alias("nxt"),
    )
    linked = both.select("route_id", F.col("x.run").alias("run")).distinct()
    halves = linked.select(F.explode(F.array(*[F.struct("route_id", "run", F.lit(i).alias("turned")) for i in (0, 1)])).alias("id"))
    steps = cut("steps", halves.join(onward, "id", "left"))
    ranked = _ranked(steps, cut)
    rings = ranked.filter("open AND low.turned = 0")
    lists = ranked.filter("NOT open").select("id", "to", "dist")
    if not rings.isEmpty():
        # Of the two ways round the one on which the lowest run is walked forwards; it begins there.
        opened = rings.select("id", "low").join(steps, "id").select("id", F.when(F.col("nxt") != F.col("low"), F.col("nxt")).alias("nxt"))
        lists = lists.unionAll(_ranked(opened, cut).select("id", "to", F.col("dist")))
    pieces = lists.select(F.col("id.route_id").alias("route_id"), F.col("id.run").alias("run"), F.col("id.turned").alias("turned"), "to", "dist")
    held = pieces.join(runs, ["route_id", "run"]).withColumn("way", F.when(F.col("turned") == 1, F.reverse("points")).otherwise(F.col("points")))
    chains = held.groupBy("route_id", "to").agg(F.array_sort(F.collect_list(F.struct((-F.col("dist")).alias("at"), "way"))).alias("w")).select(
        "route_id",
        F.concat(
            F.col("w")[0]["way"],
            F.flatten(F.transform(F.slice("w", 2, F.size("w")), lambda x: F.slice(x["way"], 2, F.size(x["way"])))),
        ).alias("points"),
    )
    alone = runs.join(linked, ["route_id", "run"], "left_anti").select("route_id", "points")
    return alone.unionAll(chains)


def _told_one_way(points: Column, free: Column) -> Column:
    """Of a line and its reverse the lower one; a ring without a junction from its lowest point."""
    open_ring = F.slice(points, 1, F.size(points) - 1)
    low = F.array_position(open_ring, F.array_min(open_ring)).cast("int")
    turned = F.concat(F.slice(open_ring, low, F.size(open_ring)), F.slice(open_ring, F.lit(1), low))
    start = F.when((points[0] == F.element_at(points, -1)) & free, turned).otherwise(points)
    return F.least(start, F.reverse(start))


def line_union_merge(lines: DataFrame, line: str = "geom", cut=None) -> DataFrame:
    """Per route: its lines cut where they cross or touch, every piece once, chained through the
    nodes that join exactly two pieces. `geom` lists the merged lines in ascending order.

    Lines without two distinct vertices give nothing. `cut` stages what later steps read more
    than once.
    """
    stage = cut or Stage(lines.sparkSession)
    cut = lambda name, df: stage(f"merge-{name}-{uuid.uuid4().hex}", df)
    pieces = noded(lines, line, cut)
    runs, degrees = _runs(pieces, cut)
    merged = _chained(runs, degrees, cut).withColumn("node", F.col("points")[0])
    told = merged.join(degrees, ["route_id", "node"]).select(
        "route_id", _told_one_way(F.col("points"), F.col("degree") == 2).alias("points")
    ).distinct()
    return told.groupBy("route_id").agg(F.array_sort(F.collect_list("points")).alias("geom"))
