"""Stop points, route lines and stop-to-stop segments."""

from pyspark.sql import DataFrame, functions as F

from headwise.functions.columns import join_on, round6, text
from headwise.functions.geometry import make_line_2pt, make_line_ordered, make_point
from headwise.functions.linework import line_stretches
from headwise.schemas import LINEAGE_COLUMNS

SHAPE = ["route_id", "direction_id", "shape_id"]
PAIR = [*SHAPE, "from_stop_sequence", "from_stop_id", "to_stop_id"]


def stop_points(stops: DataFrame) -> DataFrame:
    return stops.filter("stop_lat IS NOT NULL AND stop_lon IS NOT NULL").select(
        "stop_id", "stop_name", "stop_lat", "stop_lon",
        make_point("stop_lon", "stop_lat").alias("geom"), *LINEAGE_COLUMNS,
    )


def route_geometries(trips: DataFrame, shapes: DataFrame) -> DataFrame:
    """One line per route, direction and shape.

    Lines are built once per shape and then attached to its routes, so a shape shared by
    routes, directions or headsigns is collected and sorted a single time.
    """
    lines = (
        shapes.filter("shape_pt_lat IS NOT NULL AND shape_pt_lon IS NOT NULL")
        .select(
            "shape_id", "shape_pt_sequence", "shape_dist_traveled",
            F.col("shape_pt_lon").alias("lon"), F.col("shape_pt_lat").alias("lat"),
        )
        .groupBy("shape_id")
        .agg(
            make_line_ordered("shape_pt_sequence", "lon", "lat").alias("geom"),
            F.max("shape_dist_traveled").alias("max_shape_dist_traveled"),
        )
    )
    served = (
        trips.filter("shape_id IS NOT NULL")
        .groupBy(*SHAPE)
        .agg(
            F.min("trip_headsign").alias("direction_label"),
            *[F.min(c).alias(c) for c in LINEAGE_COLUMNS],
        )
    )
    return served.join(lines, "shape_id").select(
        *SHAPE, "direction_label", "geom", "max_shape_dist_traveled", *LINEAGE_COLUMNS
    )


def _stop_pairs(trips: DataFrame, stop_times: DataFrame, stops: DataFrame) -> DataFrame:
    """Known stops of each trip paired with the stop at the next sequence number, if any.

    Paired by an equi join on trip and sequence number instead of a window per trip: the
    next number is all that later steps keep, and the key spreads any long trip. Names are
    left for later, when far fewer rows need them.
    """
    known = stop_times.select(
        "trip_id", "stop_sequence", "stop_id", "shape_dist_traveled", "arrival_time_secs"
    ).join(stops.select("stop_id"), "stop_id", "left_semi")
    here = known.select(
        "trip_id",
        F.col("stop_sequence").alias("from_stop_sequence"),
        F.col("stop_id").alias("from_stop_id"),
        F.col("shape_dist_traveled").alias("from_shape_dist_traveled"),
        F.col("arrival_time_secs").alias("from_arrival_time_secs"),
    )
    there = known.select(
        "trip_id",
        (F.col("stop_sequence") - 1).alias("from_stop_sequence"),
        F.col("stop_sequence").alias("to_stop_sequence"),
        F.col("stop_id").alias("to_stop_id"),
        F.col("shape_dist_traveled").alias("to_shape_dist_traveled"),
        F.col("arrival_time_secs").alias("to_arrival_time_secs"),
    )
    return trips.select(*SHAPE, "trip_id", "trip_headsign", *LINEAGE_COLUMNS).join(
        here.join(there, ["trip_id", "from_stop_sequence"], "left"), "trip_id"
    )


def trip_stop_pairs(trips: DataFrame, stop_times: DataFrame, stops: DataFrame) -> DataFrame:
    """The pairs with the names of both stops."""
    def named(side: str) -> DataFrame:
        return stops.select(F.col("stop_id").alias(f"{side}_stop_id"), F.col("stop_name").alias(f"{side}_stop_name"))

    pairs = _stop_pairs(trips, stop_times, stops)
    return pairs.join(named("from"), "from_stop_id").join(named("to"), "to_stop_id", "left")


def adjacent_pairs(pairs: DataFrame) -> DataFrame:
    return pairs.filter(F.col("to_stop_sequence") == F.col("from_stop_sequence") + 1)


def dedup_pairs(adjacent: DataFrame) -> DataFrame:
    """The pair of the lowest trip id per route, direction, shape and stops.

    A minimum over a struct: reduced before the shuffle, unlike a rank.
    """
    rest = ["trip_id"] + [c for c in adjacent.columns if c not in {*PAIR, "trip_id"}]
    best = adjacent.groupBy(*PAIR).agg(F.min(F.struct(*rest)).alias("_first"))
    return best.select(*PAIR, "_first.*")


def segment_fractions(pairs: DataFrame) -> DataFrame:
    """Where the pair lies on its line, as shares of the travelled distance."""
    longest = F.col("max_shape_dist_traveled")
    begin, end = F.col("from_shape_dist_traveled"), F.col("to_shape_dist_traveled")
    usable = (longest > 0) & (end > begin)

    def share(d):
        return F.when(usable, F.greatest(F.lit(0.0), F.least(F.lit(1.0), d / longest)))

    return pairs.withColumns({"start_fraction": share(begin), "end_fraction": share(end)})


def scheduled_segment_minutes():
    """Never negative; 0 if one of the arrivals is missing."""
    secs = F.col("to_arrival_time_secs") - F.col("from_arrival_time_secs")
    return round6(F.greatest(F.lit(0.0), secs / 60.0))


def segment_geometry(located: DataFrame, geometries: DataFrame) -> DataFrame:
    """`located` with `geom`: the stretch of the route line, or a straight line between the stops.

    A stretch is cut once per shape and pair of fractions, whatever routes share it.
    """
    bounds = [F.col("start_fraction").alias("start"), F.col("end_fraction").alias("end")]
    lines = geometries.groupBy("shape_id").agg(F.first("geom").alias("geom"))  # one line per shape
    cut = line_stretches(lines, located.select("shape_id", *bounds), "shape_id").select(
        "shape_id", F.col("start").alias("start_fraction"), F.col("end").alias("end_fraction"), F.col("geom").alias("_stretch")
    )
    return located.join(cut, ["shape_id", "start_fraction", "end_fraction"], "left").withColumn(
        "geom", F.coalesce("_stretch", make_line_2pt("from_point", "to_point"))
    ).drop("_stretch")


def route_stop_segments(
    trips: DataFrame,
    stop_times: DataFrame,
    stops: DataFrame,
    geometries: DataFrame,
    points: DataFrame,
) -> DataFrame:
    pairs = dedup_pairs(adjacent_pairs(_stop_pairs(trips, stop_times, stops)))

    def place(side: str) -> DataFrame:
        return points.select(
            F.col("stop_id").alias(f"{side}_stop_id"), F.col("stop_name").alias(f"{side}_stop_name"),
            F.col("geom").alias(f"{side}_point"),
        )

    lengths = geometries.select(*SHAPE, "max_shape_dist_traveled")
    located = (
        join_on(pairs, lengths, ["route_id", "shape_id"], ["direction_id"])
        .join(place("from"), "from_stop_id")
        .join(place("to"), "to_stop_id")
    )
    return segment_geometry(segment_fractions(located), geometries).select(
        *SHAPE,
        F.col("trip_id").alias("representative_trip_id"),
        F.col("trip_headsign").alias("direction_label"),
        F.col("from_stop_sequence").alias("segment_sequence"),
        "from_stop_id", "from_stop_name", "to_stop_id", "to_stop_name",
        F.concat(text("from_stop_name"), F.lit(" -> "), text("to_stop_name")).alias("segment_label"),
        scheduled_segment_minutes().alias("scheduled_segment_minutes"),
        "from_shape_dist_traveled", "to_shape_dist_traveled",
        "geom",
        *LINEAGE_COLUMNS,
    )
