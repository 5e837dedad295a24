"""Time the raw load, the whole graph, its headline parts and the archive jobs; print one
JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

A tenth of the data, where it lies beside, is loaded and built first: it warms the engine up,
and its figures show how the times grow. Deriving the feed from the order tables is not part of
any figure but `derive`.
"""

import json
import os
import re
import time
import uuid

import conformance.archive_set  # noqa: F401 (registers its queries)
from conformance.context import CHOICES
from conformance.feed_map import OrderFeed
from conformance.query_set import QUERIES
from headwise.functions.geometry import lines_near
from headwise.operators import observed, reads
from headwise.plans.publish import Publication, publish
from headwise.schemas import RAW_SCHEMAS
from headwise.session import build_session
from headwise.sources.store import Stage, raw_read, raw_snapshots, raw_write, shared_root


def noop(df):
    df.write.format("noop").mode("overwrite").save()


def session(cpus: str):
    return build_session(
        "headwise-bench",
        **{
            "spark.master": f"local[{cpus}]",
            "spark.sql.shuffle.partitions": cpus,
            # Small inputs: let the few megabytes of a table spread over the cores.
            "spark.sql.adaptive.coalescePartitions.minPartitionSize": "256k",
            "spark.sql.files.openCostInBytes": "64k",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "16g",
        },
    )


def smaller(sf_dir: str) -> str | None:
    """The folder with a tenth of the data, if there is one."""
    parent, name = os.path.split(sf_dir.rstrip("/"))
    try:
        path = f"{parent}/sf{float(name.removeprefix('sf')) / 10:g}"
    except ValueError:
        return None
    return path if os.path.isdir(path) else None


def load_and_build(spark, sf_dir: str, timed):
    """Raw tables written from staged ones, and the whole graph; the publication and the
    rows of its two large inputs."""
    root = f"{shared_root(spark)}/bench-{uuid.uuid4().hex}"
    derive = Stage(spark, f"{root}/derived")
    derived = timed("derive", lambda: {n: derive(n, df) for n, df in OrderFeed(spark, sf_dir).raw().items()})
    rows = {n: df.count() for n, df in derived.items()}

    def load():
        for name, df in derived.items():
            raw_write(df, f"{root}/raw/{name}")

    seconds = timed("raw_load", load, own=True)
    timed.times["raw_load_rows_per_sec"] = round(sum(rows.values()) / seconds)
    raw = {n: raw_read(spark, f"{root}/raw/{n}", schema) for n, schema in RAW_SCHEMAS.items()}
    raw |= {f"{n}_snapshots": raw_snapshots(spark, f"{root}/raw/{n}") for n in RAW_SCHEMAS}
    stage = Stage(spark, f"{root}/stage")

    def cut(name, df, partition_by=()):
        label = re.sub("[-_][0-9a-f]{32}$", "", name)  # some names are new in every run
        return timed(f"write_{label}", lambda: stage(name, df, partition_by))

    p = Publication(raw, *CHOICES, cut=cut)
    seconds = timed("graph", lambda: publish(p, "all"), own=True)
    facts = p.stop_observations.count() + p.stop_times.count()
    timed.times["graph_rows_per_sec"] = round(facts / seconds)
    return p


class Timer:
    def __init__(self):
        self.times = {}

    def __call__(self, name, work, own=False):
        """Run and time; the result, or with `own` the seconds."""
        start = time.time()
        out = work()
        self.times[name] = round(time.time() - start, 3)
        return self.times[name] if own else out


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session(os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    first, timed = Timer(), Timer()
    if small := smaller(sf_dir):
        load_and_build(spark, small, first)
    p = load_and_build(spark, sf_dir, timed)
    times = timed.times
    for name in ("derive", "raw_load", "graph", "graph_rows_per_sec"):
        if name in first.times:
            times[f"tenth_{name}"] = first.times[name]

    timed("scheduled_stop_events", lambda: noop(p.scheduled_stop_events))
    timed(
        "join_audit",
        lambda: noop(
            observed.join_audit(p.stop_observations, p.scheduled_trips, p.service_dates, p.stop_times)
        ),
    )
    timed("headway_intervals", lambda: noop(p.headway_intervals))
    timed("full_trip_metrics", lambda: noop(p.full_trip_metrics))
    timed("trip_segment_metrics", lambda: noop(p.trip_segment_metrics))
    timed(
        "overlay_near_segments",
        lambda: noop(
            lines_near(
                p.route_segment_layer, p.transit_only_lane_overlay, 25.0,
                ["route_id", "direction_id", "segment_sequence"],
            )
        ),
    )
    timed("rankings", lambda: noop(reads.rankings(p.route_window_summary, p.route_hour_summary)))
    timed(
        "compare",
        lambda: noop(reads.compare(p.route_window_summary, p.route_hour_summary, ["12", "3", "7"])),
    )
    timed(
        "map_routes",
        lambda: noop(
            reads.map_routes(p.route_map_layer, p.route_window_summary, p.route_hour_summary)
        ),
    )
    for name in ("agency_extract_closure", "shape_backfill", "month_combine"):
        timed(name, lambda: noop(QUERIES[name](spark, sf_dir)))
    print(
        json.dumps(
            {
                "metric": "graph_seconds",
                "value": times["graph"],
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")),
                "observations": p.stop_observations.count(),
                "stop_times": p.stop_times.count(),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
