"""Planar geometry on `struct<lon,lat>` points and arrays of them, without UDFs. Merging lines is
and cutting them is in `linework.py`."""

from pyspark.sql import Column, DataFrame, functions as F

EARTH_EQUATOR_M_PER_DEG = 111_319.49


def make_point(lon, lat) -> Column:
    return F.struct(F.col(lon).cast("double").alias("lon"), F.col(lat).cast("double").alias("lat"))


def make_line_2pt(a, b) -> Column:
    return F.array(F.col(a), F.col(b))


def make_line_ordered(order: str, lon: str, lat: str) -> Column:
    """Aggregate: the points of a group, in order, as one line."""
    points = F.array_sort(F.collect_list(F.struct(F.col(order), F.col(lon), F.col(lat))))
    return F.transform(points, lambda p: F.struct(p[lon].alias("lon"), p[lat].alias("lat")))


def _planar(a: Column, b: Column) -> Column:
    return F.hypot(b["lon"] - a["lon"], b["lat"] - a["lat"])


def line_measures(line: Column) -> Column:
    """Length walked from the start of the line to each of its vertices, in degrees.

    Compute it once per line: the running array costs more than its later uses.
    """
    steps = F.transform(
        F.sequence(F.lit(1), F.size(line) - 1), lambda i: _planar(line[i - 1], line[i])
    )
    return F.when(
        F.size(line) >= 2,
        F.aggregate(
            steps,
            F.array(F.lit(0.0)),
            lambda acc, step: F.concat(acc, F.array(F.element_at(acc, -1) + step)),
        ),
    ).otherwise(F.array(F.lit(0.0)))


def point_at_measure(line: Column, measures: Column, target: Column) -> Column:
    """Point after walking `target` degrees along the line."""
    passed = F.size(F.filter(measures, lambda m: m < target))
    last = F.size(line) - 1
    to = F.least(passed, last)
    a, b = line[F.greatest(to - 1, F.lit(0))], line[to]
    start, end = measures[F.greatest(to - 1, F.lit(0))], measures[to]
    share = F.when(end > start, (target - start) / (end - start)).otherwise(F.lit(1.0))
    share = F.least(share, F.lit(1.0))
    return (
        F.when(passed == 0, line[0])
        .when(share == 1.0, b)
        .otherwise(
            F.struct(
                (a["lon"] + (b["lon"] - a["lon"]) * share).alias("lon"),
                (a["lat"] + (b["lat"] - a["lat"]) * share).alias("lat"),
            )
        )
    )


def point_at_ratio(line: Column, measures: Column, ratio: Column) -> Column:
    total = F.element_at(measures, -1)
    standing = line[F.floor((F.size(line) - 1) * ratio).cast("int")]
    return F.when((F.size(line) == 1) | (total == 0), standing).otherwise(
        point_at_measure(line, measures, total * ratio)
    )


def _xy(p: Column) -> Column:
    return F.array(F.round(p["lon"], 9), F.round(p["lat"], 9))


def _geojson(kind: str, coordinates: Column) -> Column:
    return F.to_json(F.struct(F.lit(kind).alias("type"), coordinates.alias("coordinates")))


def point_geojson(point: Column) -> Column:
    return F.when(point.isNotNull(), _geojson("Point", _xy(point)))


def line_geojson(line: Column) -> Column:
    return F.when(line.isNotNull(), _geojson("LineString", F.transform(line, _xy)))


def multiline_geojson(lines: Column) -> Column:
    """A single member is written as a LineString."""
    return F.when(F.size(lines) == 1, line_geojson(lines[0])).when(
        lines.isNotNull(),
        _geojson("MultiLineString", F.transform(lines, lambda line: F.transform(line, _xy))),
    )


def geojson_line(geojson) -> Column:
    """Parse a LineString; anything else gives NULL."""
    parsed = F.from_json(geojson, "type string, coordinates array<array<double>>")
    return F.when(
        parsed["type"] == "LineString",
        F.transform(
            parsed["coordinates"], lambda c: F.struct(c[0].alias("lon"), c[1].alias("lat"))
        ),
    )


def line_valid(line: Column) -> Column:
    """At least two distinct points and no missing coordinate."""
    complete = F.forall(line, lambda p: p["lon"].isNotNull() & p["lat"].isNotNull())
    return F.coalesce(complete & (F.size(F.array_distinct(line)) >= 2), F.lit(False))


def pieces(df: DataFrame, line: str, keep: list[str]) -> DataFrame:
    """One row per two-point piece of a line: `a`, `b`."""
    geom = F.col(line)
    spans = F.when(
        F.size(geom) >= 2,
        F.transform(
            F.sequence(F.lit(1), F.size(geom) - 1),
            lambda i: F.struct(geom[i - 1].alias("a"), geom[i].alias("b")),
        ),
    )
    return df.select(*keep, F.explode(spans).alias("piece")).select(*keep, "piece.a", "piece.b")


def _metres(a: Column, b: Column, origin: Column) -> tuple[Column, Column]:
    """Vector a->b in metres on the plane that touches the ellipsoid at `origin`."""
    phi = F.radians(origin["lat"])
    e2 = 0.00669437999014
    w = F.sqrt(1 - e2 * F.pow(F.sin(phi), 2))
    east = EARTH_EQUATOR_M_PER_DEG * F.cos(phi) / w
    north = EARTH_EQUATOR_M_PER_DEG * (1 - e2) / F.pow(w, 3)
    return (b["lon"] - a["lon"]) * east, (b["lat"] - a["lat"]) * north


def _point_piece_metres(p: Column, a: Column, b: Column) -> Column:
    dx, dy = _metres(a, b, p)
    px, py = _metres(a, p, p)
    length2 = dx * dx + dy * dy
    t = F.when(length2 > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (px * dx + py * dy) / length2)))
    t = F.coalesce(t, F.lit(0.0))
    return F.hypot(px - t * dx, py - t * dy)


def _side(a: Column, b: Column, p: Column) -> Column:
    return F.signum(
        (b["lon"] - a["lon"]) * (p["lat"] - a["lat"]) - (b["lat"] - a["lat"]) * (p["lon"] - a["lon"])
    )


def pieces_metres(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Distance in metres between pieces a-b and c-d; zero if they cross."""
    cross = (_side(a, b, c) * _side(a, b, d) < 0) & (_side(c, d, a) * _side(c, d, b) < 0)
    return F.when(cross, F.lit(0.0)).otherwise(
        F.least(
            _point_piece_metres(a, c, d),
            _point_piece_metres(b, c, d),
            _point_piece_metres(c, a, b),
            _point_piece_metres(d, a, b),
        )
    )


CELL_DEG = 0.0025


def _short_pieces(df: DataFrame) -> DataFrame:
    """Cut distinct pieces to at most one cell length, so each touches few cells."""
    n = F.greatest(
        F.lit(1),
        F.ceil(
            F.greatest(F.abs(F.col("b.lon") - F.col("a.lon")), F.abs(F.col("b.lat") - F.col("a.lat")))
            / CELL_DEG
        ),
    )

    def at(i):
        return F.struct(
            (F.col("a.lon") + (F.col("b.lon") - F.col("a.lon")) * i / n).alias("lon"),
            (F.col("a.lat") + (F.col("b.lat") - F.col("a.lat")) * i / n).alias("lat"),
        )

    return df.select(
        "a",
        "b",
        F.explode(
            F.transform(
                F.sequence(F.lit(1).cast("long"), n),
                lambda i: F.struct(at(i - 1).alias("s"), at(i).alias("e")),
            )
        ).alias("sub"),
    ).select("a", "b", "sub.s", "sub.e")


def _cells(df: DataFrame, metres: float) -> DataFrame:
    """Grid cells touched by the bounding box of `s`-`e`, widened by `metres`; `low_x` and
    `low_y` are the lowest of them."""
    lat_pad = F.lit(metres / 110_000.0)
    widest = F.greatest(F.abs(F.col("s.lat")), F.abs(F.col("e.lat")))
    lon_pad = metres / (110_000.0 * F.greatest(F.cos(F.radians(widest + 0.01)), F.lit(0.01)))

    def low(axis, pad):
        return F.floor((F.least(f"s.{axis}", f"e.{axis}") - pad) / CELL_DEG)

    def high(axis, pad):
        return F.floor((F.greatest(f"s.{axis}", f"e.{axis}") + pad) / CELL_DEG)

    placed = df.withColumns({"low_x": low("lon", lon_pad), "low_y": low("lat", lat_pad)})
    return placed.withColumn("cell_x", F.explode(F.sequence("low_x", high("lon", lon_pad)))).withColumn(
        "cell_y", F.explode(F.sequence("low_y", high("lat", lat_pad)))
    )


def lines_near(left: DataFrame, right: DataFrame, metres: float, keep: list[str]) -> DataFrame:
    """Rows of `left` whose `geom` comes within `metres` of any `geom` of `right`.

    An equi join on grid cells between the distinct short pieces of both sides; copies of
    a piece are matched once. Two pieces that share several cells are measured in the lowest one
    only. Returns the distinct `keep` columns.
    """
    left_pieces = pieces(left, "geom", keep)
    probe = _cells(_short_pieces(left_pieces.select("a", "b").distinct()), metres)
    near = _cells(_short_pieces(pieces(right, "geom", []).distinct()), 0.0).select(
        "cell_x", "cell_y", F.col("low_x").alias("near_x"), F.col("low_y").alias("near_y"), F.col("s").alias("c"), F.col("e").alias("d")
    )
    lowest = (F.col("cell_x") == F.greatest("low_x", "near_x")) & (F.col("cell_y") == F.greatest("low_y", "near_y"))
    matched = (
        probe.join(near, ["cell_x", "cell_y"])
        .filter(lowest)
        .filter(pieces_metres(F.col("s"), F.col("e"), F.col("c"), F.col("d")) <= metres)
        .select("a", "b")
        .distinct()
    )
    return left_pieces.join(matched, ["a", "b"], "left_semi").select(*keep).distinct()


def box(df: DataFrame, lines: list[str] = (), points: list[str] = ()) -> DataFrame:
    """Per row: lowest and highest coordinates of the given geometry columns."""

    def bound(axis, pick):
        parts = [
            (F.array_min if pick is F.min else F.array_max)(F.transform(F.col(c), lambda p: p[axis]))
            for c in lines
        ] + [F.col(c)[axis] for c in points]
        return pick(parts[0] if len(parts) == 1 else (F.least if pick is F.min else F.greatest)(*parts))

    return df.agg(
        bound("lon", F.min).alias("min_lon"),
        bound("lat", F.min).alias("min_lat"),
        bound("lon", F.max).alias("max_lon"),
        bound("lat", F.max).alias("max_lat"),
    )


def map_bounds(boxes: DataFrame) -> DataFrame:
    """Padded box around all given boxes: 12 % of each span, at least 0.006 degrees."""
    total = boxes.agg(
        F.min("min_lon").alias("min_lon"),
        F.min("min_lat").alias("min_lat"),
        F.max("max_lon").alias("max_lon"),
        F.max("max_lat").alias("max_lat"),
    ).filter("min_lon IS NOT NULL")
    pad_lon = F.greatest((F.col("max_lon") - F.col("min_lon")) * 0.12, F.lit(0.006))
    pad_lat = F.greatest((F.col("max_lat") - F.col("min_lat")) * 0.12, F.lit(0.006))
    return total.select(
        (F.col("min_lon") - pad_lon).alias("west"),
        (F.col("min_lat") - pad_lat).alias("south"),
        (F.col("max_lon") + pad_lon).alias("east"),
        (F.col("max_lat") + pad_lat).alias("north"),
    )
