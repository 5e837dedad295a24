"""Parquet layout of raw snapshots and results, and cut points between plan stages."""

from collections.abc import Callable
from contextlib import contextmanager
import json
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

RAW_PARTITIONS = ["feed_scope", "snapshot_label"]
CALENDARS = ("calendar", "calendar_dates")
REQUIRED = ("routes", "trips", "stops", "stop_times", "shapes")


def raw_write(df: DataFrame, path: str, replace: bool = True) -> None:
    """Store raw rows, partitioned by scope and snapshot. `replace` swaps out exactly the
    snapshots that `df` holds; otherwise rows are added.

    `df` is evaluated once, into a folder of this load that nobody reads yet. What it holds is
    then read off the stored rows, and one rename of a small register file makes it part of the
    table. A load that ends before leaves the table as it was. Of two loads at a time the later
    one is added to what the earlier one has registered.
    """
    spark, load = df.sparkSession, uuid.uuid4().hex
    _write_load(df, path, load)
    _commit(spark, path, _held(spark, path, load, df.schema), replace)


def _write_load(df: DataFrame, path: str, load: str) -> None:
    df.write.partitionBy(*RAW_PARTITIONS).parquet(f"{path.rstrip('/')}/data/load={load}")


def _held(spark: SparkSession, path: str, load: str, schema: StructType) -> list[dict]:
    """One entry per snapshot of a stored load; the newest load time, as microseconds."""
    rows = spark.read.schema(schema).parquet(f"{path.rstrip('/')}/data/load={load}")
    newest = F.max(F.unix_micros("ingested_at")) if "ingested_at" in rows.columns else F.lit(None).cast("long")
    found = rows.groupBy(*RAW_PARTITIONS).agg(newest.alias("ingested_at")).collect()
    return [{"load": load, **r.asDict()} for r in found]


def _file_system(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    return jvm.org.apache.hadoop.fs.Path, jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _register(spark: SparkSession, path: str) -> tuple[int, list[dict]]:
    """Version and entries (load, scope, snapshot, load time) of the table as it stands: one per
    snapshot and load. Files of other names, such as unfinished ones, are not looked at."""
    to_path, fs = _file_system(spark, path)
    folder = to_path(f"{path.rstrip('/')}/register")
    if not fs.exists(folder):
        return 0, []
    names = [status.getPath().getName() for status in fs.listStatus(folder)]
    versions = [int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()]
    if not versions:
        return 0, []
    text = spark.read.text(f"{folder}/{max(versions):012d}.json", wholetext=True).first()[0]
    return max(versions), json.loads(text)


def _commit(spark: SparkSession, path: str, entries: list[dict], replace: bool) -> None:
    to_path, fs = _file_system(spark, path)
    folder = f"{path.rstrip('/')}/register"
    fs.mkdirs(to_path(folder))
    new = {(e["feed_scope"], e["snapshot_label"]) for e in entries}
    while True:
        version, now = _register(spark, path)
        kept = [e for e in now if not (replace and (e["feed_scope"], e["snapshot_label"]) in new)]
        draft, final = to_path(f"{folder}/_{uuid.uuid4().hex}"), to_path(f"{folder}/{version + 1:012d}.json")
        out = fs.create(draft, False)
        out.write(bytearray(json.dumps([*kept, *entries]).encode()))
        out.close()
        if not fs.exists(final) and fs.rename(draft, final):
            return


def raw_snapshots(spark: SparkSession, path: str) -> DataFrame:
    """The snapshots of a table written by `raw_write`, with their load times. Given to a
    `Publication` as `<table>_snapshots`, they take the place of the table when the latest
    label is looked for."""
    rows = [(e["ingested_at"], e["feed_scope"], e["snapshot_label"]) for e in _register(spark, path)[1]]
    listed = spark.createDataFrame(rows, "micros long, feed_scope string, snapshot_label string")
    return listed.groupBy(*RAW_PARTITIONS).agg(F.max(F.timestamp_micros("micros")).alias("ingested_at")).select("ingested_at", *RAW_PARTITIONS)


def raw_read(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Stored raw rows under their declared schema (see `RAW_SCHEMAS`), so that a table
    without rows reads as empty and scope and label stay text whatever they look like. Only
    registered snapshots are read."""
    _, entries = _register(spark, path)
    if not entries:
        return spark.createDataFrame([], schema)
    data = f"{path.rstrip('/')}/data"
    folder = spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.getPartitionPathString
    # A load may hold snapshots that a later one has replaced: only the folders of live ones.
    live = ["/".join([data, f"load={e['load']}", *[folder(c, e[c]) for c in RAW_PARTITIONS]]) for e in entries]
    return spark.read.schema(schema).option("basePath", data).parquet(*live).select(*schema.names)


def raw_snapshot_present(raw: dict[str, DataFrame], label: str) -> bool:
    """All required tables and at least one calendar table have rows of the snapshot.

    Reads at most one row per table.
    """

    def has(table: str) -> bool:
        return table in raw and not raw[table].filter(F.col("snapshot_label") == label).isEmpty()

    return all(has(t) for t in REQUIRED) and any(has(t) for t in CALENDARS)


def snapshots_present(raw: dict[str, DataFrame]) -> DataFrame:
    """The same test for every label at once: one row per label of any table."""
    labels = None
    for table in (*REQUIRED, *CALENDARS):
        if table in raw:
            one = raw[table].select("snapshot_label", F.lit(table).alias("table_name")).distinct()
            labels = one if labels is None else labels.unionByName(one)
    held = F.collect_set("table_name")
    complete = F.size(F.array_intersect(held, F.array(*[F.lit(t) for t in REQUIRED]))) == len(REQUIRED)
    dated = F.size(F.array_intersect(held, F.array(*[F.lit(t) for t in CALENDARS]))) > 0
    return labels.groupBy("snapshot_label").agg((complete & dated).alias("present"))


def mart_write(df: DataFrame, path: str, partition_by: list[str] = ()) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def shared_root(spark: SparkSession) -> str:
    """The folder for intermediate tables: the cluster's `spark.checkpoint.dir`, else a folder
    of the session's warehouse, which on a cluster may not be a folder of one machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    warehouse = spark.conf.get("spark.sql.warehouse.dir")
    if not root and warehouse.startswith("file:") and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return (root or f"{warehouse.rstrip('/')}/headwise-cuts").rstrip("/")


# Removes the shuffle files of an execution as soon as it has ended.
_SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
# A relation that is built part by part has a slice for so many bytes that it is
# built from, but so many slices at most, as each of them reads all of those.
SLICE_BYTES, SLICES = 16 << 20, 4


@contextmanager
def _without_shuffle_files(spark: SparkSession):
    """What is executed inside leaves no shuffle files: a written table is read back, so nobody
    reads them again, and else they stay until the driver happens to collect its garbage."""
    before = spark.conf.get(_SHUFFLES_GO, None)
    spark.conf.set(_SHUFFLES_GO, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_SHUFFLES_GO)
        else:
            spark.conf.set(_SHUFFLES_GO, before)


class Stage:
    """Cut points: write a relation once and go on from the written table.

    Tables go to a new folder below `shared_root`, which all executors share, so a lost
    executor costs a re-read and not a recomputation. `root` overrides the place, for instance
    to keep the tables as the published result.
    """

    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark = spark
        if root is None:
            root = f"{shared_root(spark)}/headwise-{uuid.uuid4().hex}"
        self.root = root

    def __call__(self, name: str, df: DataFrame, partition_by: list[str] = ()) -> DataFrame:
        return self._written(name, df, "overwrite", partition_by)

    def _written(self, name: str, df: DataFrame, mode: str, partition_by: list[str] = ()) -> DataFrame:
        path = f"{self.root}/{name}"
        writer = df.write.mode(mode).option("compression", "zstd")
        with _without_shuffle_files(self.spark):
            (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def sliced(self, name: str, build: Callable[..., DataFrame], key: str, *relations: DataFrame) -> DataFrame:
        """`build(*relations)` written in slices of `key`, one after the other, so that no more
        than one slice's shuffle files are there at a time. Every row of what is built must
        depend on rows of its own key only; NULL is a key like others."""
        held = sum(int(r._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) for r in relations)
        many = min(SLICES, 1 + held // SLICE_BYTES)
        for i in range(many):
            own = F.pmod(F.xxhash64(key), F.lit(many)) == i
            out = self._written(name, build(*[r.filter(own) for r in relations]), "append" if i else "overwrite")
        return out


def lazily(name: str, df: DataFrame, partition_by: list[str] = ()) -> DataFrame:
    """Stand-in for `Stage` that cuts nothing."""
    return df
