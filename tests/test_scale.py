"""Plans and results under skew: no cross joins, no window over observations, pruned scans."""

from datetime import datetime, timedelta
import time

import pytest
from pyspark.sql import functions as F

from feeds import (
    DAY, INBOUND, OBSERVED, OUTBOUND, STOPS, observation, observations, publication, raw_feed, rows,
)
from headwise.operators.staging import FeedChoice, ObservedChoice
from headwise.operators.trips import _ranged_by_departure, first_stop_trip_order
from headwise.plans.publish import Publication, publish
from headwise.schemas import RAW_SCHEMAS
from headwise.sources.feed_files import metadata, parse_overlays
from headwise.sources import store
from headwise.sources.store import Stage, raw_read, raw_snapshots, raw_write

HOT = 20_000


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def hot(spark):
    """One observed key holds a third of the rows, one unknown trip another third."""
    raw = raw_feed(spark, [INBOUND, OUTBOUND], STOPS)
    usual = observations(spark, [INBOUND, OUTBOUND], OBSERVED)
    noise = spark.createDataFrame([observation("in2", "WRONG", 2, DAY)], usual.schema)
    key = spark.createDataFrame([observation("in1", "A", 1, DAY + timedelta(minutes=481))], usual.schema)
    lost = spark.createDataFrame([observation("nobody", "A", 1, DAY)], usual.schema)
    many = spark.range(HOT).select("id")

    def times(df, *columns):
        return many.join(df).select(*usual.columns) if not columns else many.join(df).select(*columns)

    stray = times(lost, *[
        F.col("id").cast("int").alias("stop_sequence") if c == "stop_sequence" else F.col(c)
        for c in usual.columns
    ])
    raw["stop_observations"] = usual.unionByName(times(key)).unionByName(stray).unionByName(noise)
    return Publication(raw, FeedChoice(), ObservedChoice("fixture"), cut=Stage(spark))


def test_hot_keys_keep_every_row(hot):
    assert dict(rows(hot.join_summary, "join_status", "row_count")) == {
        "matched_exact": 17, "duplicate_observation_key": HOT + 1,
        "unmatched_trip_service_date": HOT, "unmatched_stop_id": 1,
    }
    counts = hot.join_audit.filter("join_status = 'duplicate_observation_key'")
    assert rows(counts.select("observation_key_row_count", "scheduled_trip_service_date_count").distinct()) == [
        (HOT + 1, (HOT + 3) * 3)
    ]
    got = rows(hot.unmatched_counts.groupBy("route_id").agg(F.sum("n")))
    assert got == [("14", HOT + 2)]
    assert hot.unmatched_resolved.count() == HOT + 2


def test_counts_per_trip_come_before_the_trip_lookup(hot):
    text = plan(hot.unmatched_counts)
    lookup = text.index("Join")
    assert "HashAggregate" in text[lookup:], "the observations must be counted below the join"


RELATIONS = [
    "join_audit", "trip_terminals", "observed_terminals", "headway_intervals", "loss_parts",
    "route_stop_segments", "route_segment_metrics", "stop_wait_metrics", "unmatched_resolved",
    "route_segment_layer",
]


@pytest.fixture(scope="module")
def lazy(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("raw"))
    raw = raw_feed(spark, [INBOUND, OUTBOUND], STOPS)
    raw["stop_observations"] = observations(spark, [INBOUND, OUTBOUND], OBSERVED)
    for name, df in raw.items():
        raw_write(df, f"{root}/{name}")
    back = {name: raw_read(spark, f"{root}/{name}", RAW_SCHEMAS[name]) for name in raw}
    return Publication(back, FeedChoice(label="v1"), ObservedChoice("fixture", label="v1"))


@pytest.mark.parametrize("name", RELATIONS)
def test_no_cross_join_and_no_python(lazy, name):
    text = plan(getattr(lazy, name))
    for operator in ("CartesianProduct", "NestedLoopJoin", "Python", "Pandas"):
        assert operator not in text, operator


def test_snapshot_prunes_partitions_and_columns(lazy):
    text = plan(lazy.staging.stop_times().select("trip_id", "arrival_time_secs"))
    scan = next(line for line in text.splitlines() if "FileScan" in line)
    assert "snapshot_label" in scan and "PartitionFilters: [" in scan
    read = scan[scan.index("ReadSchema"):]
    assert "arrival_time" in read and "departure_time" not in read and "stop_sequence" not in read


def test_the_latest_snapshot_is_chosen_and_pruned_without_reading_the_table(spark, tmp_path):
    raw = raw_feed(spark, [INBOUND, OUTBOUND], STOPS)
    raw["stop_observations"] = observations(spark, [INBOUND, OUTBOUND], OBSERVED)
    lane = (
        '{"type":"FeatureCollection","features":[{"properties":{"street_name":"A","segment_name":"s"},'
        '"geometry":{"type":"LineString","coordinates":[[-122.5,37.5],[-122.4,37.6]]}}]}'
    )
    raw["lane_overlays"] = parse_overlays(
        spark.createDataFrame([(lane,)], "value string"), metadata("x", "lanes", "v1", ingested_at=datetime(2026, 5, 1))
    )
    stored = {}
    for name, df in raw.items():
        older = df.withColumns({"snapshot_label": F.lit("v0"), "ingested_at": F.col("ingested_at") - F.expr("INTERVAL 1 DAY")})
        raw_write(df.unionByName(older), f"{tmp_path}/{name}")
        stored[name] = raw_read(spark, f"{tmp_path}/{name}", RAW_SCHEMAS[name])
        stored[f"{name}_snapshots"] = raw_snapshots(spark, f"{tmp_path}/{name}")
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    p = Publication(stored, FeedChoice(), ObservedChoice("fixture"))
    for staged in (p.staging.stop_observations(), p.staging.stop_times(), p.staging.lane_overlays()):
        text = plan(staged)
        scan = next(line for line in text.splitlines() if "FileScan" in line)
        assert "snapshot_label" in scan[scan.index("PartitionFilters"):] and "ubquery" in scan
        assert {r["snapshot_label"] for r in staged.select("snapshot_label").collect()} <= {"v1"}
        labels = [line for line in text.splitlines() if "FileScan" in line][1:]
        assert all("-snapshots" in line for line in labels)
    assert p.staging.stop_observations().count() == raw["stop_observations"].count()


def test_the_audit_has_no_window_and_few_wide_exchanges(lazy):
    """Totals come from aggregations; every exchange but those of the observations is of keys."""
    text = plan(lazy.join_audit)
    assert "Window" not in text
    wide = [line for line in text.splitlines() if "Exchange" in line and "observed_arrival_ts" in line]
    assert len(wide) <= 1


def test_published_parts_are_on_disk(hot, tmp_path):
    out = publish(hot, "observed", str(tmp_path))
    assert sorted(p.name for p in tmp_path.iterdir()) == ["join_audit", "join_summary", "observed_stop_events"]
    assert any(p.name.startswith("service_date=") for p in (tmp_path / "join_audit").iterdir())
    assert out["join_audit"].count() == hot.join_audit.count()
    assert rows(out["join_summary"]) == rows(hot.join_summary)


def test_trips_without_arrivals_spread_and_keep_their_order(spark):
    days = spark.createDataFrame(
        [("r", 0, "s", DAY, t, None) for t in ("b12345", "a1", "b12340", "b2", "a")] + [("r", 0, "s", DAY, "z", 100)],
        "route_id string, direction_id int, first_stop_id string, service_date date, trip_id string, first_arrival_time_secs int",
    )
    got = rows(first_stop_trip_order(days), "trip_id", "first_stop_trip_order")
    assert sorted(got, key=lambda r: r[1]) == [("z", 1), ("a", 2), ("a1", 3), ("b12340", 4), ("b12345", 5), ("b2", 6)]


def test_a_busy_stop_spreads_over_all_tasks(spark):
    """Namespaced trip ids at one stop and day, all without an arrival, or all at one time."""
    for arrival in (None, 28_800):
        many = spark.range(HOT).select(
            F.lit("r").alias("route_id"), F.lit(None).cast("int").alias("direction_id"), F.lit("s").alias("first_stop_id"),
            F.lit(DAY.date()).alias("service_date"), F.format_string("202604__%06d", F.col("id")).alias("trip_id"),
            F.lit(arrival).cast("int").alias("first_arrival_time_secs"),
        )
        days = many.unionAll(many.filter("trip_id < '202604__000007'").withColumn("route_id", F.lit("q")))
        spread = [r["count"] for r in _ranged_by_departure(days).groupBy("_part").count().collect()]
        assert len(spread) == int(spark.conf.get("spark.sql.shuffle.partitions")) and max(spread) < 2 * HOT / len(spread)
        got = first_stop_trip_order(days).select("route_id", "trip_id", "first_stop_trip_order").collect()
        assert len(got) == HOT + 7
        assert all(r["first_stop_trip_order"] == int(r["trip_id"][8:]) + 1 for r in got)


def test_the_audit_is_staged_in_slices_of_trips(spark, monkeypatch):
    """A slice for each of `SLICES` parts of the trips; together they hold every observation, those
    without a trip id and those with a repeated key, too."""
    raw = raw_feed(spark, [INBOUND, OUTBOUND], STOPS)
    usual = observations(spark, [INBOUND, OUTBOUND], OBSERVED)
    odd = usual.limit(3).withColumn("trip_id", F.lit(None).cast("string"))
    raw["stop_observations"] = usual.unionAll(usual.filter("trip_id = 'in1'")).unionAll(odd)
    choices = (FeedChoice(), ObservedChoice("fixture"))
    monkeypatch.setattr(store, "SLICE_BYTES", 1)
    written = []
    plain = Stage._written

    def counted(self, name, df, mode, partition_by=()):
        written.append((name, mode))
        return plain(self, name, df, mode, partition_by)

    monkeypatch.setattr(Stage, "_written", counted)
    got = Publication(raw, *choices, cut=Stage(spark)).join_audit
    assert [mode for name, mode in written if name == "join_audit"] == ["overwrite", *["append"] * (store.SLICES - 1)]
    whole = Publication(raw, *choices).join_audit
    assert got.count() == raw["stop_observations"].count()
    assert got.exceptAll(whole).isEmpty() and whole.exceptAll(got).isEmpty()


def test_a_stage_leaves_no_shuffle_files(spark):
    def shuffle_files():
        found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {found.apply(i).getName() for i in range(found.size()) if found.apply(i).getName().startswith("shuffle_")}

    before = shuffle_files()
    staged = Stage(spark)("counted", spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count())
    until = time.time() + 30
    while shuffle_files() - before and time.time() < until:  # they go in the background
        time.sleep(0.2)
    assert not shuffle_files() - before
    assert staged.count() == 7
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
