"""Run history and usage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from headwater.operators.parse import FINAL_TYPES
from headwater.storage import spread


def run_aggregates(order: Column) -> list[Column]:
    """State of a run from its events; shared by the batch and the streaming form."""
    kind, at = F.col("event_type"), F.col("event_time")
    return [
        F.max_by("event_type", F.struct(at, order)).alias("status"),
        F.max(F.when(kind == "START", at)).alias("started_at"),
        F.min(F.when(kind.isin(FINAL_TYPES), at)).alias("finished_at"),
        F.max("event_type").alias("last_type"),
        F.min("event_type").alias("first_type"),
    ]


def job_runs(events: DataFrame, links: DataFrame) -> DataFrame:
    """Runs of every job: all events of a run count, linked or not.

    A run is summarised before it meets its jobs, so a run with very many events is reduced
    on the map side and never multiplied.
    """
    runs = events.groupBy("run_id").agg(*run_aggregates(F.col("seq")))
    return links.select("job", "run_id").distinct().join(spread(runs), "run_id")


def sorted_job_runs(runs: DataFrame) -> DataFrame:
    return runs.orderBy("job", F.desc_nulls_last("last_type"), F.desc_nulls_last("first_type"), "run_id")


def table_usage(links: DataFrame, job_tables: DataFrame, current_tables: DataFrame) -> DataFrame:
    """Events linked to current job versions that read the table's current version.

    Events are counted per job version first, so only one row per version meets the bridge.
    """
    events = links.groupBy("job", "version").agg(F.count(F.lit(1)).alias("n"))
    reads = job_tables.filter(F.col("to_seq").isNull() & (F.col("role") == "input")).select(
        "job", "version", "tbl", "tbl_version"
    )
    current = current_tables.select("tbl", F.col("version").alias("tbl_version"))
    return (
        reads.join(spread(events), ["job", "version"])
        .join(spread(current), ["tbl", "tbl_version"])
        .groupBy("tbl")
        .agg(F.sum("n").alias("usage"))
    )
