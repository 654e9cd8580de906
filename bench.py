"""Headline timings at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402

from headwater.operators import attributes as attr  # noqa: E402
from headwater.operators import reports  # noqa: E402
from headwater.plans import critical  # noqa: E402
from headwater.plans.model import build_model  # noqa: E402
from headwater.sources.events import derived_events, stream_events  # noqa: E402
from headwater.storage import materialize, new_path  # noqa: E402
from headwater.streaming.ingest import ModelStream  # noqa: E402

STREAM_BATCHES = 4
#: Files of each batch.
LANDED_FILES = 8


def drain(df: DataFrame) -> None:
    """Compute every column of every row and keep nothing."""
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        # Parsing is heavy for its bytes: let a small log still use every core.
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds: dict[str, float] = {}

    def timed(name, run):
        start = time.perf_counter()
        result = run()
        seconds[name] = round(time.perf_counter() - start, 3)
        return result

    events = timed("derive_events", lambda: materialize(derived_events(spark, sf_dir), "events"))
    count = events.count()
    model = timed("full_model", lambda: build_model(events))
    timed("critical_tables", lambda: drain(critical.critical_tables(model)))
    graph = timed(
        "attribute_graph", lambda: attr.attribute_graph(model.current_transformations(), model.current_attributes())
    )
    timed("downstream_attributes", lambda: drain(attr.downstream_attributes(graph)))
    timed("upstream_attributes", lambda: drain(attr.upstream_attributes(graph)))

    def table_reports():
        pairs = reports.consecutive(model.table_versions(), "tbl")
        diff = materialize(reports.table_version_diff(pairs, model.attribute_versions()), "diff")
        drain(reports.table_impact(graph, diff))

    def job_reports():
        pairs = reports.consecutive(model.logs["jobs"], "job")
        rows = model.logs["transformations"]
        diff = materialize(reports.job_version_diff(pairs, rows), "diff")
        drain(reports.job_impact(graph, diff, reports.job_logic_changed(pairs, diff, model.logs["jobs"], rows)))

    timed("impact_report_table", table_reports)
    timed("impact_report_job", job_reports)

    landing = new_path(spark, "landing")
    step = count // STREAM_BATCHES + 1
    for n in range(STREAM_BATCHES):
        part = events.filter(f"seq > {n * step} AND seq <= {(n + 1) * step}" if n else f"seq <= {step}")
        part.repartition(LANDED_FILES).write.mode("append").parquet(landing)

    def stream():
        query = ModelStream(spark, new_path(spark, "stream")).start(
            stream_events(spark, landing, files_per_batch=LANDED_FILES), availableNow=True
        )
        query.awaitTermination()

    timed("stream_ingest_tables", stream)
    print(
        json.dumps(
            {
                "metric": "total seconds of the headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "events": count,
                "events_per_sec_full_model": round(count / seconds["full_model"], 1),
                "stream_batches": STREAM_BATCHES,
                "cpus": int(cpus),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
