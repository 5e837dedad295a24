"""Readers and writers."""

import csv
from datetime import datetime
import io
import json
import random

import pytest
from pyspark.sql import functions as F

from feeds import rows
from headwise.schemas import RAW_SCHEMAS
from headwise.sources import feed_files as files, quoted, store


def meta(label="v1"):
    return files.metadata("test", "fixture", label, "OP")


def test_feed_table(spark, tmp_path):
    (tmp_path / "stops.txt").write_text(
        'stop_id,extra,stop_name,stop_lat,stop_lon\n S1 ,x," Main, ""Old"" St ",37.0,\n'
    )
    got = files.read_feed_table(spark, str(tmp_path), "stops", meta())
    assert rows(got, "stop_id", "stop_name", "stop_lat", "stop_lon", "snapshot_label") == [
        ("S1", 'Main, "Old" St', "37.0", "", "v1")
    ]
    raw = files.read_feed_table(spark, str(tmp_path), "stops", meta(), trim=False)
    assert rows(raw, "stop_id") == [(" S1 ",)]
    assert files.read_feed_table(spark, str(tmp_path), "calendar", meta()).count() == 0
    with pytest.raises(FileNotFoundError):
        files.read_feed_table(spark, str(tmp_path), "trips", meta())
    (tmp_path / "shapes.txt").write_text("shape_id\nx\n")
    with pytest.raises(ValueError, match="shape_pt_lat"):
        files.read_feed_table(spark, str(tmp_path), "shapes", meta())


def written(path, rows, ends="\n"):
    text = io.StringIO()
    csv.writer(text, lineterminator=ends).writerows(rows)
    path.write_text(text.getvalue(), newline="")
    return str(path)


def small_splits(spark, size):
    """Splits of so many bytes, for as long as the test runs."""
    names = {"maxPartitionBytes": size, "openCostInBytes": "1b", "minPartitionNum": "64"}
    for name, value in names.items():
        spark.conf.set(f"spark.sql.files.{name}", value)
    return [f"spark.sql.files.{name}" for name in names]


@pytest.mark.parametrize("seed", range(4))
def test_breaks_inside_quotes_over_splits(spark, tmp_path, seed):
    """Random fields with breaks, quotes and separators over splits of 60 bytes, so that records
    cross several, against the reader of the standard library."""
    r = random.Random(seed)
    field = lambda: "".join(r.choices(["a", "b,", '"', "\n", "\r\n", "é", "long text "], k=r.randint(0, 12)))
    table = [["id", "u", "v"], *[[str(i), field(), field()] for i in range(30)]]
    path = written(tmp_path / "t.txt", table, ["\n", "\r\n"][seed % 2])
    changed = small_splits(spark, "60b")
    try:
        assert quoted._lines(spark, path).select("block").distinct().count() > 10
        got = {x[0]: tuple(y or "" for y in x[1:]) for x in quoted.read_delimited(spark, path).collect()}
        assert got == {x[0]: tuple(x[1:]) for x in table[1:]}
    finally:
        for name in changed:
            spark.conf.unset(name)


def test_lines_are_looked_through_in_chunks_of_one_split(spark, tmp_path):
    """No window holds all lines of a split: 9,000 lines in one split, with a record over more
    lines than a chunk has."""
    long = "\n".join(f"line {i}," for i in range(3000))
    table = [["id", "text"], *[[str(i), 'x"\n,"y' if i % 3 == 0 else "x"] for i in range(4500)], ["long", long], ["end", "z"]]
    path = written(tmp_path / "t.txt", table)
    staged = []

    def cut(name, df):
        staged.append(store.Stage(spark)(name, df))
        return staged[-1]

    got = {x[0]: x[1] for x in quoted.read_delimited(spark, path, cut).collect()}
    assert got == {x[0]: x[1] for x in table[1:]}
    assert staged[0].select("file", "block").distinct().count() == 1
    sizes = [x["count"] for x in staged[0].groupBy("file", "block", "chunk").count().collect()]
    assert sum(sizes) == 9002 and max(sizes) == 1024


def test_quoted_records(spark, tmp_path):
    folder = tmp_path / "several"
    folder.mkdir()
    written(folder / "1.txt", [["id", "name"], ["1", "Main\nStreet"], ["2", ""]])
    written(folder / "2.txt", [["id", "name"], ["3", "plain"], ["4", 'say ""\n\n"yes"']])
    (folder / "3.txt").write_text('id,name\n5,6" pipe\n6,"a" b\n7,"x\ny"\n\n8,last')
    got = quoted.read_delimited(spark, str(folder))
    want = {"1": "Main\nStreet", "2": None, "3": "plain", "4": 'say ""\n\n"yes"', "5": '6" pipe', "7": "x\ny", "8": "last"}
    found = dict(rows(got, "id", "name"))
    assert {k: v for k, v in found.items() if k != "6"} == want
    assert got.select("name").count() == 8


@pytest.mark.parametrize("body", ["1,a\n", "1,a,b,c\n", '1,"a\nb"\n', '1,"a\nb",c,d\n', '1,"a\nb",c\n2,"never closed,\n'])
def test_bad_records_are_refused(spark, tmp_path, body):
    (tmp_path / "t.txt").write_text("id,name,x\n0,z,z\n" + body)
    for read in (lambda d: d.collect(), lambda d: d.count(), lambda d: d.select("id").collect()):
        with pytest.raises(Exception, match="fields|never closed"):
            read(quoted.read_delimited(spark, str(tmp_path / "t.txt")))


def iso(spark, **change):
    row = {
        "service_date": "2026-05-01", "trip_id": "t", "stop_id": "s", "stop_sequence": "1",
        "observed_arrival_time": "2026-05-01T08:01:15-07:00", **change,
    }
    return files.parse_iso_observations(spark.createDataFrame([row]), meta())


def test_iso_observations(spark):
    df = iso(spark)
    assert rows(df.select(F.col("service_date").cast("string"), F.col("observed_arrival_ts").cast("string"))) == [
        ("2026-05-01", "2026-05-01 15:01:15")
    ]
    assert rows(iso(spark, observed_arrival_time="2026-05-01T15:01:15Z"), F.unix_seconds("observed_arrival_ts")) == rows(
        df, F.unix_seconds("observed_arrival_ts")
    )


@pytest.mark.parametrize(
    "change",
    [
        {"observed_arrival_time": "2026-05-01T08:01:15"}, {"service_date": "20260501"},
        {"trip_id": " "}, {"service_date": "2026-02-30"}, {"observed_arrival_time": "soon"}, {"stop_sequence": "1.5"},
    ],
)
def test_bad_iso_observations(spark, change):
    with pytest.raises(Exception):
        iso(spark, **change).collect()
    for unrelated in (lambda df: df.select("stop_id").collect(), lambda df: df.count()):
        with pytest.raises(Exception):
            unrelated(iso(spark, **change))


def archived(spark, *changes):
    base = {
        "service_date": "20260213", "trip_id": "t", "stop_sequence": "1", "to_stop_id": "s",
        "observed_arrival_time": "25:46:10", "agency_id": "SF",
    }
    return files.parse_archive_observations(
        spark.createDataFrame([{**base, **c} for c in changes]), meta()
    )


def test_archive_observations(spark):
    got = archived(spark, {}, {"observed_arrival_time": " "}, {"observed_arrival_time": "8:00:00"})
    assert rows(got, "stop_id", F.col("observed_arrival_ts").cast("string")) == [
        ("s", "2026-02-14 09:46:10"), ("s", "2026-02-13 16:00:00"),
    ]


@pytest.mark.parametrize(
    "change",
    [
        {"trip_id": ""}, {"to_stop_id": "", "observed_arrival_time": ""}, {"service_date": "2026-02-13"},
        {"observed_arrival_time": "08:60:00"}, {"observed_arrival_time": "8am"},
        {"stop_sequence": "one"}, {"service_date": "20260230"},
    ],
)
def test_bad_archive_observations(spark, change):
    for read in (lambda df: df.collect(), lambda df: df.select("stop_id").collect(), lambda df: df.count()):
        with pytest.raises(Exception):
            read(archived(spark, change))


def collection(*features, kind="FeatureCollection"):
    return json.dumps({"type": kind, "features": list(features)})


LINE = {"type": "LineString", "coordinates": [[-122.5, 37.5], [-122.4, 37.6]]}


def test_overlays(spark, tmp_path):
    named = {"properties": {"overlay_id": "x", "street_name": " A ", "segment_name": "s", "route_hint": 14}, "geometry": LINE}
    plain = {"properties": {"street_name": "B", "segment_name": "s"}, "geometry": LINE}
    (tmp_path / "lanes.geojson").write_text(json.dumps(json.loads(collection(named, plain)), indent=2))
    got = files.read_overlays(spark, str(tmp_path / "lanes.geojson"), meta())
    assert rows(got, "overlay_id", "street_name", "route_hint") == [("x", "A", "14"), ("overlay_2", "B", "")]
    assert json.loads(rows(got, "geom_geojson")[0][0]) == LINE


@pytest.mark.parametrize(
    "text",
    [
        collection(kind="Feature"),
        collection({"properties": {"street_name": "A", "segment_name": "s"}}),
        collection({"properties": {"segment_name": "s"}, "geometry": LINE}),
    ],
)
def test_bad_overlays(spark, text):
    df = spark.createDataFrame([(text,)], "value string")
    if '"features": []' in text:
        text = text.replace("[]", json.dumps([{"geometry": LINE}]))
        df = spark.createDataFrame([(text,)], "value string")
    with pytest.raises(Exception):
        files.parse_overlays(df, meta()).collect()


def test_snapshot_label(spark):
    df = spark.createDataFrame([("a/b.c/feed_2023.02.zip",), ("plain",)], "f string")
    assert rows(df.select(files.snapshot_label(F.col("f")))) == [("archive_feed_2023.02",), ("archive_plain",)]


def test_raw_snapshots_are_replaced_or_added(spark, tmp_path):
    path = str(tmp_path / "raw")
    df = spark.createDataFrame(
        [("a", "s", "2026"), ("b", "s", "2026"), ("c", "s", "2027")],
        "id string, feed_scope string, snapshot_label string",
    )
    store.raw_write(df, path)
    store.raw_write(df.filter("id = 'a'"), path)
    store.raw_write(df.filter("id = 'c'"), path, replace=False)
    back = store.raw_read(spark, path, df.schema)
    assert sorted(rows(back, "id", "snapshot_label")) == [("a", "2026"), ("c", "2027"), ("c", "2027")]
    pruned = back.filter("snapshot_label = '2027'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in pruned and "2027" in pruned


def test_a_load_that_ends_early_leaves_the_table(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "stops")
    schema = "id string, ingested_at timestamp, feed_scope string, snapshot_label string"
    frame = lambda *r: spark.createDataFrame([(i, datetime(2026, 1, d), "s", label) for i, d, label in r], schema)
    store.raw_write(frame(("a", 1, "v1"), ("b", 1, "v2")), path)
    reader = store.raw_read(spark, path, frame(("a", 1, "v1")).schema)
    # The rows are there, but the register is not written.
    store._write_load(frame(("x", 2, "v1")), path, "unfinished")
    now = lambda: sorted(rows(store.raw_read(spark, path, reader.schema), "id", "snapshot_label"))
    assert now() == [("a", "v1"), ("b", "v2")]
    # Nor does a draft of the register count.
    (tmp_path / "stops" / "register" / "_draft").write_text("[]")
    assert now() == [("a", "v1"), ("b", "v2")]
    store.raw_write(frame(("c", 3, "v1")), path)
    assert now() == [("b", "v2"), ("c", "v1")]
    # A reader from before still sees what it was given.
    assert sorted(rows(reader, "id")) == [("a",), ("b",)]
    found = rows(store.raw_snapshots(spark, path).orderBy("snapshot_label"), "snapshot_label", F.day("ingested_at"))
    assert found == [("v1", 3), ("v2", 1)]
    # Another load registers in between: both are kept.
    version, entries = store._register(spark, path)
    seen = []

    def late(s, p):
        if not seen:
            seen.append(1)
            store.raw_write(frame(("d", 4, "v3")), path)
            return version, entries
        return register(s, p)

    register = store._register
    store._write_load(frame(("e", 5, "v4")), path, "late")
    held = store._held(spark, path, "late", reader.schema)
    monkeypatch.setattr(store, "_register", late)
    seen.clear()
    store._commit(spark, path, held, True)
    monkeypatch.setattr(store, "_register", register)
    assert now() == [("b", "v2"), ("c", "v1"), ("d", "v3"), ("e", "v4")]


def test_the_input_of_a_load_is_evaluated_once(spark, tmp_path):
    counter = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            counter.add(batch.num_rows)
            yield batch

    df = spark.range(10).select(F.col("id").cast("string"), F.lit("s").alias("feed_scope"), F.lit("v").alias("snapshot_label"))
    store.raw_write(df.mapInArrow(count, df.schema), str(tmp_path / "t"))
    assert counter.value == 10


def test_a_table_without_rows_reads_as_empty(spark, tmp_path):
    path = str(tmp_path / "calendar_dates")
    store.raw_write(spark.createDataFrame([], RAW_SCHEMAS["calendar_dates"]), path)
    back = store.raw_read(spark, path, RAW_SCHEMAS["calendar_dates"])
    assert back.isEmpty() and "exception_type" in back.columns


def test_snapshot_presence(spark):
    one = spark.createDataFrame([("v1",)], "snapshot_label string")
    raw = dict.fromkeys(("routes", "trips", "stops", "stop_times", "shapes", "calendar_dates"), one)
    assert store.raw_snapshot_present(raw, "v1") and not store.raw_snapshot_present(raw, "v2")
    assert not store.raw_snapshot_present({k: v for k, v in raw.items() if k != "calendar_dates"}, "v1")
    assert rows(store.snapshots_present(raw)) == [("v1", True)]


def test_stage_needs_a_shared_folder(spark, tmp_path):
    assert store.Stage(spark).root.startswith(spark.conf.get("spark.checkpoint.dir"))
    kept = store.Stage(spark, str(tmp_path / "out"))
    back = kept("numbers", spark.range(3), [])
    assert back.count() == 3 and (tmp_path / "out" / "numbers").exists()


def test_a_lane_that_is_not_a_line_is_an_error(spark):
    from headwise.operators.staging import FeedChoice, ObservedChoice, Staging

    several = json.dumps({"type": "MultiLineString", "coordinates": [LINE["coordinates"]]})
    named = {"properties": {"street_name": "A", "segment_name": "s"}, "geometry": json.loads(several)}
    texts = spark.createDataFrame([(collection(named),)], "value string")
    staging = Staging({"lane_overlays": files.parse_overlays(texts, meta())}, FeedChoice(), ObservedChoice())
    for read in (lambda df: df.collect(), lambda df: df.select("street_name").collect(), lambda df: df.count()):
        with pytest.raises(Exception, match="LineString"):
            read(staging.lane_overlays())


@pytest.mark.parametrize("lack", ["street_name", "segment_name", "geometry"])
def test_a_feature_that_lacks_something_is_an_error(spark, lack):
    feature = {"properties": {"street_name": "A", "segment_name": "s"}, "geometry": LINE}
    (feature if lack == "geometry" else feature["properties"]).pop(lack)
    texts = spark.createDataFrame([(collection(feature),)], "value string")
    with pytest.raises(Exception):
        files.parse_overlays(texts, meta()).select("overlay_id").collect()
