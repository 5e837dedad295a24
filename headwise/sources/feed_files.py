"""Readers of schedule files, observation files and lane overlays.

Inputs are unpacked folders on any file system Spark can read. Column checks look at the
header only; value checks are part of the plan and fail the job on the first bad row. Quoted
fields may hold line breaks; records of a wrong number of fields are refused.
"""

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.utils import AnalysisException

from headwise.functions.columns import LOCAL_TZ, clock_secs, elapsed_instant, is_blank, required, text
from headwise.schemas import (
    FEED_COLUMNS, METADATA_COLUMNS, OBSERVATION_ARCHIVE_COLUMNS, OBSERVATION_ISO_COLUMNS,
    OBSERVATION_SCHEMA, OPTIONAL_FEED_TABLES, OVERLAY_SCHEMA, feed_schema,
)
from headwise.sources.quoted import read_delimited

# Accepted text forms.
ISO_DATE = r"^\d{4}-\d{2}-\d{2}$"
COMPACT_DATE = r"^\d{8}$"
SERVICE_CLOCK = r"^\d{1,2}:[0-5]\d:[0-5]\d$"
ISO_INSTANT = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2}(:?\d{2})?)$"


def snapshot_label(artifact: Column) -> Column:
    """`archive_` and the file name without folder and last extension."""
    name = F.element_at(F.split(artifact, "/"), -1)
    return F.concat(F.lit("archive_"), F.regexp_replace(name, r"(?<=.)\.[^.]*$", ""))


def metadata(
    source_system: str,
    feed_scope: str,
    snapshot_label: str,
    operator_id: str = "",
    ingested_at: datetime | None = None,
) -> dict[str, Column]:
    loaded = F.current_timestamp() if ingested_at is None else F.lit(ingested_at)
    return {
        "source_system": F.lit(source_system),
        "feed_scope": F.lit(feed_scope),
        "operator_id": F.lit(operator_id),
        "snapshot_label": F.lit(snapshot_label),
        "ingested_at": loaded.cast("timestamp"),
    }


def _require_columns(df: DataFrame, columns: list[str], path: str) -> None:
    if not df.columns:
        raise ValueError(f"no columns found in the first line of {path}")
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{path} lacks the columns {', '.join(missing)}")


def _is_missing_path(error: AnalysisException) -> bool:
    return "PATH_NOT_FOUND" in (error.getCondition() or "")


def read_feed_table(
    spark: SparkSession, folder: str, table: str, meta: dict[str, Column], trim: bool = True
) -> DataFrame:
    """One schedule file as text columns plus metadata.

    Archives are trimmed, hand-made folders (`trim=False`) are not. A missing calendar or
    calendar_dates file gives no rows; any other missing file is an error.
    """
    path = f"{folder}/{table}.txt"
    try:
        rows = read_delimited(spark, path)
    except AnalysisException as error:
        if not _is_missing_path(error):
            raise
        if table in OPTIONAL_FEED_TABLES:
            return spark.createDataFrame([], feed_schema(table))
        raise FileNotFoundError(f"Required schedule file is missing: {path}") from error
    _require_columns(rows, FEED_COLUMNS[table], path)
    return rows.select(
        *[(F.trim(text(c)) if trim else text(c)).alias(c) for c in FEED_COLUMNS[table]],
        *[meta[c].alias(c) for c in METADATA_COLUMNS],
    )


def read_feed(
    spark: SparkSession, folder: str, meta: dict[str, Column], trim: bool = True
) -> dict[str, DataFrame]:
    return {t: read_feed_table(spark, folder, t, meta, trim) for t in FEED_COLUMNS}


NO_WHOLE_SEQUENCE = "A stop_sequence is a whole number."


def _is_whole(column: str) -> Column:
    return F.expr(f"try_cast({column} AS int)").isNotNull()


def _filled(columns: list[str]) -> Column:
    blank = is_blank(columns[0])
    for c in columns[1:]:
        blank = blank | is_blank(c)
    return ~blank


def parse_iso_observations(rows: DataFrame, meta: dict[str, Column]) -> DataFrame:
    """ISO dates and instants; a blank field, a malformed date, instant or sequence number, or
    a missing zone offset is an error, whatever columns are read afterwards."""
    t = rows.select(*[F.trim(text(c)).alias(c) for c in OBSERVATION_ISO_COLUMNS])
    filled = required(t, _filled(OBSERVATION_ISO_COLUMNS), "No field of an observation may be blank.")
    dated = required(
        filled,
        F.col("service_date").rlike(ISO_DATE) & F.expr("try_cast(service_date AS date)").isNotNull(),
        "A service_date is a day written YYYY-MM-DD.",
    )
    timed = required(
        dated,
        F.col("observed_arrival_time").rlike(ISO_INSTANT)
        & F.expr("try_cast(observed_arrival_time AS timestamp)").isNotNull(),
        "An observed_arrival_time is an ISO-8601 instant with its zone offset.",
    )
    sound = required(timed, _is_whole("stop_sequence"), NO_WHOLE_SEQUENCE)
    return sound.select(
        F.col("service_date").cast("date").alias("service_date"),
        "trip_id",
        "stop_id",
        F.col("stop_sequence").cast("int").alias("stop_sequence"),
        "observed_arrival_time",
        F.col("observed_arrival_time").cast("timestamp").alias("observed_arrival_ts"),
        *[meta[c].alias(c) for c in METADATA_COLUMNS],
    )


def read_iso_observations(spark: SparkSession, path: str, meta: dict[str, Column]) -> DataFrame:
    rows = read_delimited(spark, path)
    _require_columns(rows, OBSERVATION_ISO_COLUMNS, path)
    return parse_iso_observations(rows, meta)


def obs_archive_ts(service_date: Column, clock: Column, tz: str = LOCAL_TZ) -> Column:
    """Local midnight of the service date as an instant, plus the elapsed clock time."""
    return elapsed_instant(service_date, clock_secs(clock), tz)


def parse_archive_observations(rows: DataFrame, meta: dict[str, Column], tz: str = LOCAL_TZ) -> DataFrame:
    """Compact archive rows. Rows without an observed time are left out (see
    `archive_load_counts`); blank key fields or malformed dates, times and sequence numbers
    are errors, whatever columns are read afterwards."""
    keys = [c for c in OBSERVATION_ARCHIVE_COLUMNS if c != "observed_arrival_time"]
    t = rows.select(*[F.trim(text(c)).alias(c) for c in OBSERVATION_ARCHIVE_COLUMNS])
    # Keys must be there on rows without a time, too.
    keyed = required(t, _filled(keys), "service_date, trip_id, to_stop_id and stop_sequence may not be blank.")
    timed = keyed.filter(F.col("observed_arrival_time") != "")
    dated = required(
        timed,
        F.col("service_date").rlike(COMPACT_DATE) & F.try_to_date("service_date", "yyyyMMdd").isNotNull(),
        "An archived service_date is a day written YYYYMMDD.",
    )
    clocked = required(
        dated, F.col("observed_arrival_time").rlike(SERVICE_CLOCK), "An archived observed_arrival_time is written HH:MM:SS."
    )
    sound = required(clocked, _is_whole("stop_sequence"), NO_WHOLE_SEQUENCE)
    day = F.to_date("service_date", "yyyyMMdd")
    return sound.select(
        day.alias("service_date"),
        "trip_id",
        F.col("to_stop_id").alias("stop_id"),
        F.col("stop_sequence").cast("int").alias("stop_sequence"),
        "observed_arrival_time",
        obs_archive_ts(day, F.col("observed_arrival_time"), tz).alias("observed_arrival_ts"),
        *[meta[c].alias(c) for c in METADATA_COLUMNS],
    )


def archive_load_counts(rows: DataFrame) -> DataFrame:
    """How many archive rows load and how many are skipped for want of an observed time."""
    skipped = is_blank("observed_arrival_time")
    return rows.agg(
        F.count_if(~skipped).alias("inserted_row_count"),
        F.count_if(skipped).alias("skipped_missing_required_count"),
    )


def read_archive_observations(
    spark: SparkSession,
    path: str,
    meta: dict[str, Column],
    tz: str = LOCAL_TZ,
) -> DataFrame:
    rows = read_delimited(spark, path)
    _require_columns(rows, OBSERVATION_ARCHIVE_COLUMNS, path)
    return parse_archive_observations(rows, meta, tz)


def parse_overlays(texts: DataFrame, meta: dict[str, Column]) -> DataFrame:
    """Feature collections (one text per row, column `value`) to overlay rows.

    Each feature's geometry is kept as its own GeoJSON text.
    """
    collection = F.from_json(
        "value", "type string, features array<struct<properties:map<string,string>,geometry:string>>"
    )
    features = F.when(
        collection["type"] == "FeatureCollection", collection["features"]
    ).otherwise(
        F.raise_error(F.lit("An overlay must be a GeoJSON FeatureCollection.")).cast(
            "array<struct<properties:map<string,string>,geometry:string>>"
        )
    )
    found = texts.select(F.posexplode(features).alias("at", "feature"))

    def prop(name: str) -> Column:
        return F.trim(text(F.col("feature.properties")[name]))


    default_id = F.concat(F.lit("overlay_"), (F.col("at") + 1).cast("string"))
    given_id = F.nullif(text(F.col("feature.properties")["overlay_id"]), F.lit(""))
    geometry = F.col("feature.geometry")
    rows = found
    for name in ("street_name", "segment_name"):
        rows = required(rows, prop(name) != "", f"A feature lacks the property {name}.")
    rows = required(rows, geometry.isNotNull() & (geometry != "{}"), "A feature lacks its geometry.")
    return rows.select(
        F.coalesce(given_id, default_id).alias("overlay_id"),
        prop("street_name").alias("street_name"),
        prop("segment_name").alias("segment_name"),
        prop("route_hint").alias("route_hint"),
        geometry.alias("geom_geojson"),
        *[meta[c].alias(c) for c in METADATA_COLUMNS],
    )


def read_overlays(spark: SparkSession, path: str, meta: dict[str, Column]) -> DataFrame:
    """GeoJSON files; each file is one collection and therefore one row until it is unfolded."""
    return parse_overlays(spark.read.text(path, wholetext=True), meta)


def empty_observations(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], OBSERVATION_SCHEMA)


def empty_overlays(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], OVERLAY_SCHEMA)
