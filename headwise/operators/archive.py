"""Archive preparation: cut a regional feed to one agency, complete its shapes, join months.

A feed is a dict of text DataFrames named like the schedule tables, plus
`stop_observations` in the archive layout.
"""

from datetime import date
import re
import uuid

from pyspark.sql import Column, DataFrame, Window, functions as F

from headwise.functions.columns import is_blank, require_rows, text
from headwise.operators.marts import top_per_group
from headwise.schemas import FEED_COLUMNS
from headwise.sources.store import lazily

Feed = dict[str, DataFrame]

# Id forms that mark where a shape comes from.
SHAPE_API = "shape_api"
ACTIVE_SHAPE = "active_shape"
SHAPE_PATTERN = "shape_pattern"
HEADSIGN_KEY = ["route_key", "direction_id", "trip_headsign"]
PATTERN_KEY = [*HEADSIGN_KEY, "stop_pattern_key"]
# Fixed value: candidates that a shape is paired with in one join key, so that shapes of the same
# lookup keys spread over all tasks.
PAIRED = 1024


# --- ids -----------------------------------------------------------------------------


def strip_operator_prefix(c, operator: str) -> Column:
    value = F.col(c) if isinstance(c, str) else c
    prefix = f"{operator}:"
    return F.when(value.startswith(prefix), F.substr(value, F.lit(len(prefix) + 1))).otherwise(value)


def normalize_trip_id(c, operator: str) -> Column:
    """Trip id without the operator prefix and without a trailing `:YYYYMMDD`."""
    value = F.trim(F.col(c) if isinstance(c, str) else c)
    return F.regexp_replace(strip_operator_prefix(value, operator), r":\d{8}$", "")


def synth_shape_id(operator: str) -> Column:
    """The trip's shape id, or one derived from its trip id if that is blank."""
    derived = F.concat(F.lit(f"{operator}:{SHAPE_API}:"), normalize_trip_id("trip_id", operator))
    return F.when(is_blank("shape_id") & ~is_blank("trip_id"), derived).otherwise(
        F.trim("shape_id")
    )


def short_hash(c: Column) -> Column:
    return F.substr(F.sha2(c, 256), F.lit(1), F.lit(16))


def trimmed(df: DataFrame) -> DataFrame:
    """Every text column trimmed, missing values as blank text."""
    return df.select(
        *[
            F.trim(text(c)).alias(c) if kind == "string" else F.col(c)
            for c, kind in df.dtypes
        ]
    )


# --- agency extract ------------------------------------------------------------------


def agency_extract_routes(routes: DataFrame, agency: str) -> DataFrame:
    """Routes whose id belongs to the agency."""
    own = routes.filter((F.trim("agency_id") == agency) & ~is_blank("route_id"))
    ids = own.select(F.trim("route_id").alias("_id")).distinct()
    return routes.join(ids, F.trim(routes["route_id"]) == F.col("_id"), "left_semi")


def agency_extract_trips(trips: DataFrame, routes: DataFrame, operator: str) -> DataFrame:
    """Trips on the kept routes, trimmed, each with a shape id."""
    kept = trimmed(trips).join(
        routes.select(F.trim("route_id").alias("route_id")).distinct(), "route_id", "left_semi"
    )
    return kept.withColumn("shape_id", synth_shape_id(operator))


def _referenced(child: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    ids = parents.filter(~is_blank(key)).select(F.trim(key).alias("_id")).distinct()
    return child.join(ids, F.trim(child[key]) == F.col("_id"), "left_semi")


def agency_extract_obs(
    observations: DataFrame, trips: DataFrame, routes: DataFrame, agency: str
) -> DataFrame:
    """Observations of the agency, of a kept trip or route, or with the agency's id prefix.

    The cheap tests come first: only rows that fail them need the key lookups, which are
    two joins with distinct keys, so that no row is repeated.
    """
    given = [c for c in ("agency_id", "route_id", "trip_id") if c in observations.columns]
    value = {c: F.trim(text(c)) for c in given}
    absent = F.lit("")
    trip, route = value["trip_id"], value.get("route_id", absent)
    prefix = f"{agency}:"
    obvious = (
        (value.get("agency_id", absent) == agency)
        | trip.startswith(prefix)
        | route.startswith(prefix)
    )
    rows = observations.withColumns({"_trip": trip, "_route": route, "_own": obvious})
    # A row that is kept anyway gets no lookup key, so it cannot crowd a join task.
    rows = rows.withColumns(
        {c: F.when(~F.col("_own"), F.col(c)) for c in ("_trip", "_route")}
    )
    trip_ids = trips.filter(~is_blank("trip_id")).select(
        F.trim("trip_id").alias("_trip"), F.lit(True).alias("_known_trip")
    ).distinct()
    route_ids = routes.select(
        F.trim("route_id").alias("_route"), F.lit(True).alias("_known_route")
    ).distinct()
    return (
        rows.join(trip_ids, "_trip", "left")
        .join(route_ids, "_route", "left")
        .filter(F.col("_own") | F.col("_known_trip") | F.col("_known_route"))
        .select(*observations.columns)
    )


def agency_extract_closure(
    feed: Feed, agency: str, active: Feed | None = None, check: bool = True, cut=lazily
) -> Feed:
    """The part of a regional feed that one agency needs.

    `active` is the agency's current feed; with it, derived shape ids are pointed at its
    shapes. `check=False` skips the two emptiness tests (one row each is read otherwise).
    With a `Stage` as `cut`, the kept trips, which every other table depends on, are
    worked out once.
    """
    routes = agency_extract_routes(feed["routes"], agency)
    trips = cut("kept_trips", agency_extract_trips(feed["trips"], routes, agency))
    if check:
        require_rows(routes, f"The feed has no route of the agency {agency!r}.")
        require_rows(trips, "The agency's routes have no trips.")
    stop_times = _referenced(feed["stop_times"], trips, "trip_id")
    trips = cut("shaped_trips", assign_shape_target(trips, stop_times, active, agency))
    out = {
        "routes": routes,
        "trips": trips,
        "stop_times": stop_times,
        "stops": _referenced(feed["stops"], stop_times, "stop_id"),
    }
    if "shapes" in feed:
        out["shapes"] = _referenced(feed["shapes"], trips, "shape_id")
    for table in ("calendar", "calendar_dates"):
        if table in feed:
            out[table] = _referenced(feed[table], trips, "service_id")
    if "stop_observations" in feed:
        out["stop_observations"] = agency_extract_obs(
            feed["stop_observations"], trips, routes, agency
        )
    return out


def retained_counts(feed: Feed) -> DataFrame:
    counts = [
        df.agg(F.count("*").alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
        for name, df in sorted(feed.items())
    ]
    out = counts[0]
    for one in counts[1:]:
        out = out.unionByName(one)
    return out


# --- shapes --------------------------------------------------------------------------


def stop_pattern_key(stop_times: DataFrame) -> DataFrame:
    """Per trip: SHA-256 of its `sequence:stop` lines in sequence order.

    Sequence numbers are ordered as whole numbers of up to 38 digits, signed or not; text
    that is no such number comes first, by its line. A group is one trip's stop list, the
    text that is hashed.
    """
    line = F.concat_ws(":", F.trim("stop_sequence"), F.trim("stop_id"))
    number = F.expr("try_cast(trim(stop_sequence) AS decimal(38, 0))")
    place = F.struct(number.isNotNull().alias("known"), number.alias("n"), line.alias("line"))
    lines = F.transform(F.array_sort(F.collect_list(place)), lambda p: p["line"])
    return (
        stop_times.filter(~is_blank("stop_id") & ~is_blank("trip_id"))
        .groupBy(F.trim("trip_id").alias("trip_id"))
        .agg(F.sha2(F.concat_ws("\n", lines), 256).alias("stop_pattern_key"))
    )


def active_trips(active: Feed, operator: str) -> DataFrame:
    """Trips of the current feed under the keys by which shapes are looked up."""
    return (
        trimmed(active["trips"])
        .filter("route_id <> '' AND trip_id <> ''")
        .select(
            strip_operator_prefix("route_id", operator).alias("route_key"),
            "direction_id", "trip_headsign", "trip_id", "shape_id",
        )
    )


def _only_shape(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """Keys whose candidates have exactly one shape. Lowest and highest being equal needs
    no distinct count."""
    return (
        candidates.filter("shape_id <> ''")
        .groupBy(*keys)
        .agg(F.min("shape_id").alias("only_shape_id"), F.max("shape_id").alias("_other"))
        .filter("only_shape_id = _other")
        .drop("_other")
    )


def unique_shape_lookup(candidates: DataFrame) -> DataFrame:
    return _only_shape(candidates, HEADSIGN_KEY)


def unique_shape_lookup_by_pattern(candidates: DataFrame, patterns: DataFrame) -> DataFrame:
    return _only_shape(candidates.join(patterns, "trip_id"), PATTERN_KEY)


def shape_pattern_id(operator: str) -> Column:
    """The published id. Only here is the pattern's digest shortened; joins use all of it."""
    short = [F.substring(c, 1, 16) if c == "stop_pattern_key" else F.col(c) for c in PATTERN_KEY]
    parts = F.concat_ws("\0", *short)
    return F.concat(F.lit(f"{operator}:{SHAPE_PATTERN}:"), short_hash(parts))


def assign_shape_target(
    trips: DataFrame, stop_times: DataFrame, active: Feed | None, operator: str
) -> DataFrame:
    """Replace derived shape ids by a shape of the current feed or by a pattern id.

    The stop pattern decides if the trip has one; the headsign only if it has none.
    """
    keyed = trips.withColumn("route_key", strip_operator_prefix("route_id", operator)).join(
        stop_pattern_key(stop_times), "trip_id", "left"
    )
    if active is None:
        matched = keyed.withColumns(
            {"_by_pattern": F.lit(None).cast("string"), "_by_headsign": F.lit(None).cast("string")}
        )
    else:
        candidates = active_trips(active, operator)
        by_pattern = unique_shape_lookup_by_pattern(
            candidates, stop_pattern_key(active["stop_times"])
        ).withColumnRenamed("only_shape_id", "_by_pattern")
        by_headsign = unique_shape_lookup(candidates).withColumnRenamed(
            "only_shape_id", "_by_headsign"
        )
        matched = keyed.join(by_pattern, PATTERN_KEY, "left").join(
            by_headsign, HEADSIGN_KEY, "left"
        )
    has_pattern = F.col("stop_pattern_key").isNotNull()
    only = F.when(has_pattern, F.col("_by_pattern")).otherwise(F.col("_by_headsign"))
    derived = F.col("shape_id").startswith(f"{operator}:{SHAPE_API}:")
    target = (
        F.when(~derived, F.col("shape_id"))
        .when(only.isNotNull(), F.concat(F.lit(f"{operator}:{ACTIVE_SHAPE}:"), only))
        .when(has_pattern, shape_pattern_id(operator))
        .otherwise(F.col("shape_id"))
    )
    return matched.withColumn("shape_id", target).select(*trips.columns)


def representative_trip(trips: DataFrame) -> DataFrame:
    """One trip per shape: the lowest id, as a table has no first row."""
    return trips.filter("shape_id <> ''").groupBy("shape_id").agg(F.min("trip_id").alias("trip_id"))


def missing_shapes(trips: DataFrame, shapes: DataFrame) -> DataFrame:
    present = shapes.select(F.trim("shape_id").alias("shape_id"))
    return (
        trips.filter("shape_id <> ''").select("shape_id").distinct()
        .join(present, "shape_id", "left_anti")
    )


def _missing_with_keys(
    trips: DataFrame, shapes: DataFrame, stop_times: DataFrame, operator: str
) -> DataFrame:
    """Missing shapes with the lookup keys of their representative trip."""
    chosen = missing_shapes(trips, shapes).join(representative_trip(trips), "shape_id")
    keys = trips.select(
        "trip_id", "direction_id", "trip_headsign",
        strip_operator_prefix("route_id", operator).alias("route_key"),
    )
    return chosen.join(keys, "trip_id").join(stop_pattern_key(stop_times), "trip_id", "left")


def _staged(cut, name: str, df: DataFrame) -> DataFrame:
    """Under a new name, since a stage may be shared by several calls."""
    return cut(f"{name}-{uuid.uuid4().hex}", df)


def _by_lookup_keys(missing: DataFrame) -> DataFrame:
    """One row per missing shape: its own trip and `keys`, a digest of all its lookup keys (one
    set, unless its trip id is repeated), with the `_keys` themselves."""
    keys = F.array_sort(F.collect_set(F.struct(*PATTERN_KEY)))
    rows = missing.groupBy("shape_id").agg(F.min("trip_id").alias("own_trip_id"), keys.alias("_keys"))
    return rows.withColumn("keys", F.sha2(F.to_json("_keys"), 256))


def _current_by_place(shapes: DataFrame, active: Feed, operator: str) -> DataFrame:
    """(keys, trip_id, priority, place): the current trips that may stand in, best first, once for
    all missing shapes of the same lookup keys, however many there are."""
    groups = shapes.select("keys", "_keys").dropDuplicates(["keys"]).select("keys", F.explode("_keys").alias("k")).select("keys", "k.*")
    current = active_trips(active, operator).distinct()
    # One trip stands for all of the same shape before any join, per lookup key.
    same_shape = F.coalesce(F.nullif("shape_id", F.lit("")), F.concat(F.lit("\0"), "trip_id"))

    def ranked(rows, by, priority):
        best = rows.groupBy(*by, same_shape.alias("same_shape")).agg(
            F.min("trip_id").alias("trip_id")
        )
        return groups.join(best, by).select("keys", "same_shape", "trip_id", F.lit(priority).alias("priority"))

    with_pattern = current.join(stop_pattern_key(active["stop_times"]), "trip_id")
    found = (
        ranked(with_pattern, PATTERN_KEY, 1)
        .unionByName(ranked(current, HEADSIGN_KEY, 2))
        .unionByName(ranked(current, HEADSIGN_KEY[:2], 3))
    )
    order = F.struct("priority", "trip_id")
    best = found.groupBy("keys", "same_shape").agg(F.min(order).alias("best"))
    unique = best.groupBy("keys", F.col("best.trip_id").alias("trip_id")).agg(F.min("best.priority").alias("priority"))
    place = F.row_number().over(Window.partitionBy("keys").orderBy("priority", "trip_id"))
    return unique.withColumn("place", place)


def shape_candidates(
    trips: DataFrame, shapes: DataFrame, stop_times: DataFrame, active: Feed, operator: str, cut=lazily
) -> DataFrame:
    """Per missing shape, the trips whose shape may stand in, best first.

    The representative trip, then current trips with the same stop pattern, the same
    headsign, the same route and direction; one trip per current shape. The current trips are
    put in order once per set of lookup keys; the pairs with the shapes, which are the result,
    are neither grouped nor sorted. With a `Stage` as `cut` the missing shapes are worked out once.
    """
    missing = _by_lookup_keys(_staged(cut, "missing_shapes", _missing_with_keys(trips, shapes, stop_times, operator)))
    current = _current_by_place(missing, active, operator)
    own_place = current.select("keys", F.col("trip_id").alias("own_trip_id"), F.col("place").alias("own_place"))
    known = missing.drop("_keys").join(own_place, ["keys", "own_trip_id"], "left")
    own = missing.select(
        "shape_id", F.col("own_trip_id").alias("trip_id"), F.lit(0).alias("priority"), F.lit(1).alias("position")
    )
    # The own trip comes first; if it is a current one, it leaves its place there.
    moved = F.when(F.col("own_place") < F.col("place"), 0).otherwise(1)
    bucket = lambda c: F.expr(f"cast({c} div {PAIRED} as int)")
    many = current.groupBy("keys").agg(F.max("place").alias("last"))
    spread = known.join(many, "keys").withColumn("bucket", F.explode(F.sequence(F.lit(0), bucket("last"))))
    pairs = spread.join(current.withColumn("bucket", bucket("place")), ["keys", "bucket"])
    rest = pairs.filter("trip_id <> own_trip_id").select(
        "shape_id", "trip_id", "priority", (F.col("place") + moved).alias("position")
    )
    return own.unionByName(rest)


def _copied(targets: DataFrame, shapes: DataFrame, source: str) -> DataFrame:
    """Shape rows of `source` under the target's shape id."""
    points = trimmed(shapes).withColumnRenamed("shape_id", source)
    return targets.join(points, source).select(
        "shape_id", *[c for c in FEED_COLUMNS["shapes"] if c != "shape_id"]
    )


def shape_backfill(
    trips: DataFrame,
    shapes: DataFrame,
    stop_times: DataFrame,
    active: Feed,
    operator: str,
    payload_points: DataFrame | None = None,
    check: bool = False,
    cut=lazily,
) -> DataFrame:
    """Rows for the missing shapes.

    First from the current trip with the same normalised id, then, for ids that name a
    current shape, from that shape, then from looked-up trip shapes (`payload_points`, see
    `shapes_payload_parse`) of the best candidate that has any. With `check`, a shape that
    stays without rows is an error. With a `Stage` as `cut` the missing shapes and their
    targets are worked out once.
    """
    missing = _staged(cut, "missing_shapes", _missing_with_keys(trips, shapes, stop_times, operator))
    active_shapes = trimmed(active["shapes"])
    drawn = active_shapes.select("shape_id").distinct()
    current = active_trips(active, operator).filter("shape_id <> ''")

    same_trip = (
        missing.select("shape_id", normalize_trip_id("trip_id", operator).alias("trip_id"))
        .join(current.select("trip_id", F.col("shape_id").alias("source_id")), "trip_id")
        .select("shape_id", "source_id", F.lit(1).alias("priority"))
    )
    named = f"{operator}:{ACTIVE_SHAPE}:"
    pointed = missing.filter(F.col("shape_id").startswith(named))
    by_pattern = unique_shape_lookup_by_pattern(current, stop_pattern_key(active["stop_times"]))
    by_headsign = unique_shape_lookup(current)
    lookups = pointed.join(by_pattern, PATTERN_KEY).unionByName(
        pointed.filter("stop_pattern_key IS NULL").join(by_headsign, HEADSIGN_KEY)
    )
    same_pattern = lookups.select(
        "shape_id", F.col("only_shape_id").alias("source_id"), F.lit(2).alias("priority")
    )
    usable = same_trip.unionByName(same_pattern).join(
        drawn.withColumnRenamed("shape_id", "source_id"), "source_id", "left_semi"
    )
    targets = _staged(
        cut, "shape_targets",
        top_per_group(usable, ["shape_id"], [F.col("priority"), F.col("source_id")], ["source_id"]),
    )
    filled = _copied(targets, active_shapes, "source_id")

    if payload_points is not None:
        open_shapes = _by_lookup_keys(missing.join(targets, "shape_id", "left_anti"))
        looked_up = payload_points.select("lookup_trip_id").distinct()
        # In the order of `shape_candidates`: the own trip, else the first of the current ones.
        first = top_per_group(
            _current_by_place(open_shapes, active, operator)
            .withColumn("lookup_trip_id", normalize_trip_id("trip_id", operator))
            .join(looked_up, "lookup_trip_id", "left_semi"),
            ["keys"], [F.col("place")], ["lookup_trip_id"],
        ).withColumnRenamed("lookup_trip_id", "_other")
        own = looked_up.select(F.col("lookup_trip_id").alias("_own"), F.lit(True).alias("_known"))
        choice = (
            open_shapes.withColumn("_own", normalize_trip_id("own_trip_id", operator))
            .join(own, "_own", "left").join(first, "keys", "left")
            .select("shape_id", F.when(F.col("_known"), F.col("_own")).otherwise(F.col("_other")).alias("lookup_trip_id"))
        )
        filled = filled.unionByName(
            choice.join(payload_points, "lookup_trip_id").select(*FEED_COLUMNS["shapes"][:1],
                "shape_pt_lat", "shape_pt_lon", "shape_pt_sequence", "shape_dist_traveled")
        )
    if check:
        unfilled = missing.select("shape_id").join(
            filled.select("shape_id").distinct(), "shape_id", "left_anti"
        )
        if not unfilled.isEmpty():
            some = ", ".join(sorted(r.shape_id for r in unfilled.limit(5).collect()))
            raise RuntimeError(f"Shapes without any source, among them: {some}")
    return filled


def _object_list(json: Column) -> Column:
    """JSON object or list of objects as an array of JSON texts."""
    listed = F.from_json(json, "array<string>")
    return F.coalesce(
        F.when(F.ltrim(json).startswith("["), listed).when(json.isNotNull(), F.array(json)),
        F.expr("array()").cast("array<string>"),
    )


def shapes_payload_parse(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """Stored shape answers to numbered points; the first usable geometry of an answer wins.

    Keeps the other columns of `payloads`. A malformed position or an answer without
    geometry is an error.
    """

    def inner(items: Column, path: str) -> Column:
        return F.flatten(
            F.transform(items, lambda j: _object_list(F.get_json_object(j, path)))
        )

    frames = _object_list(F.get_json_object(payload, "$.Content.TimetableFrame"))
    journeys = inner(frames, "$.vehicleJourneys.ServiceJourney")
    projections = inner(journeys, "$.LinkSequenceProjection")
    lines = F.transform(
        projections,
        lambda j: F.from_json(F.get_json_object(j, "$.LineString.pos"), "array<string>"),
    )
    usable = F.filter(lines, lambda line: F.coalesce(F.size(line), F.lit(0)) > 0)
    line = F.when(F.size(usable) > 0, usable[0]).otherwise(
        F.raise_error(F.lit("A stored shape answer holds no list of positions.")).cast(
            "array<string>"
        )
    )
    keep = [c for c in payloads.columns if c != payload]
    number = r"[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?"
    position = F.when(
        F.trim("pos").rlike(rf"^{number}\s+{number}$"), F.split(F.trim("pos"), r"\s+")
    ).otherwise(
        F.raise_error(F.lit("A position of a stored shape answer is not a pair of numbers.")).cast(
            "array<string>"
        )
    )
    return (
        payloads.select(*keep, F.posexplode(line).alias("_at", "pos"))
        .select(*keep, "_at", position.alias("latlon"))
        .select(
            *keep,
            F.col("latlon")[0].alias("shape_pt_lat"),
            F.col("latlon")[1].alias("shape_pt_lon"),
            (F.col("_at") + 1).cast("string").alias("shape_pt_sequence"),
            F.lit("").alias("shape_dist_traveled"),
        )
    )


# --- months --------------------------------------------------------------------------


def validate_month(month: str) -> str:
    if not re.fullmatch(r"\d{4}-\d{2}", month):
        raise ValueError(f"not a month (four digits, a dash, two digits): {month!r}")
    if not 1 <= int(month[5:]) <= 12:
        raise ValueError(f"there is no such month in a year: {month!r}")
    return month


def shift_month(month: str, by: int) -> str:
    year, number = map(int, validate_month(month).split("-"))
    index = year * 12 + number - 1 + by
    if index < 0:
        raise ValueError("the window begins before the calendar does")
    return f"{index // 12:04d}-{index % 12 + 1:02d}"


def newest_completed_month(today: date | None = None) -> str:
    return shift_month((today or date.today()).strftime("%Y-%m"), -1)


def trailing_months(latest: str, window_months: int) -> list[str]:
    if window_months <= 0:
        raise ValueError("a window has at least one month")
    return [shift_month(latest, -back) for back in range(window_months - 1, -1, -1)]


def month_window(latest: Column, window_months: int) -> Column:
    """The trailing months of a date column as `YYYY-MM` texts, oldest first."""
    last = F.trunc(latest, "MM")
    months = F.sequence(
        F.add_months(last, -(window_months - 1)), last, F.expr("interval 1 month")
    )
    return F.transform(months, lambda m: F.date_format(m, "yyyy-MM"))


def month_namespace(c: str, month: str = "feed_month") -> Column:
    """Prefix an id with `YYYYMM__`; blank stays blank."""
    value = F.trim(text(c))
    token = F.replace(F.col(month), F.lit("-"), F.lit(""))
    return F.when(value != "", F.concat(token, F.lit("__"), value)).otherwise("")


def with_month(feed: Feed, month: str) -> Feed:
    validate_month(month)
    return {name: df.withColumn("feed_month", F.lit(month)) for name, df in feed.items()}


def union_months(feeds: list[Feed]) -> Feed:
    """Month-tagged feeds as one, table by table; columns missing in a month become NULL.

    Feeds stored as Parquet partitioned by `feed_month` need no union: read them as one.
    """
    out: Feed = {}
    for feed in feeds:
        for name, df in feed.items():
            out[name] = (
                out[name].unionByName(df, allowMissingColumns=True) if name in out else df
            )
    return out


def _latest_per_id(df: DataFrame, key: str) -> DataFrame:
    """Row of the latest month per id: a maximum, reduced before the shuffle."""
    rows = trimmed(df).filter(F.col(key) != "")
    rest = [c for c in rows.columns if c not in (key, "feed_month")]
    best = rows.groupBy(key).agg(F.max(F.struct("feed_month", *rest)).alias("_last"))
    return best.select(*[F.col(key) if c == key else F.col(f"_last.{c}") for c in df.columns if c != "feed_month"])


def month_combine(feed: Feed, check: bool = True) -> Feed:
    """One feed from month-tagged tables.

    Trip, service and shape ids get their month as a prefix; child rows survive only if a
    trip of the same month refers to them; of routes and stops the latest month wins.
    """
    for table in ("trips", "stop_times", "shapes", "stop_observations"):
        if table not in feed:
            raise ValueError(f"{table} is required in every month")
    trips = trimmed(feed["trips"])
    out: Feed = {
        "routes": _latest_per_id(feed["routes"], "route_id"),
        "stops": _latest_per_id(feed["stops"], "stop_id"),
        "trips": trips.withColumns(
            {c: month_namespace(c) for c in ("trip_id", "service_id", "shape_id")}
        ).drop("feed_month"),
    }
    owners = {
        "stop_times": "trip_id", "stop_observations": "trip_id", "shapes": "shape_id",
        "calendar": "service_id", "calendar_dates": "service_id",
    }
    for table, key in owners.items():
        if table not in feed:
            continue
        used = trips.filter(F.col(key) != "").select("feed_month", key).distinct()
        out[table] = (
            trimmed(feed[table])
            .join(used, ["feed_month", key], "left_semi")
            .withColumn(key, month_namespace(key))
            .drop("feed_month")
            .select(*[c for c in feed[table].columns if c != "feed_month"])
        )
    if check:
        require_rows(out["shapes"], "None of the months has shapes.")
        require_rows(
            out["stop_observations"], "None of the months has observations."
        )
    return out
