"""The dependency graph as flat tables: nodes, edges, and what each edge carries.

An edge between two busy tables may carry any number of mappings and runs, so they stay rows
instead of one nested document per edge.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def graph_nodes(current_tables: DataFrame) -> DataFrame:
    """Current tables with their attributes in name order."""
    return current_tables.select(
        F.col("tbl").alias("id"),
        "namespace",
        "schema_name",
        "table_name",
        F.array_sort("fields").alias("attributes"),
    )


def edge_attributes(transformations: DataFrame) -> DataFrame:
    """Attribute mappings of every edge; sort by (source, target, job, output, input) to read."""
    return transformations.filter(F.col("input_table").isNotNull()).select(
        F.col("input_table").alias("source_table"),
        F.col("output_table").alias("target_table"),
        "job",
        "input_attribute",
        "output_attribute",
        "lineage_type",
        "lineage_subtype",
        "lineage_description",
        "lineage_masking",
        "lineage_scope",
        "source",
        "expression",
    )


def edge_jobs(transformations: DataFrame) -> DataFrame:
    """Jobs behind every edge with their SQL and the number of mappings."""
    return (
        transformations.filter(F.col("input_table").isNotNull())
        .groupBy(F.col("input_table").alias("source_table"), F.col("output_table").alias("target_table"), "job", "job_sql")
        .agg(F.count(F.lit(1)).alias("mappings"))
    )


def edge_runs(transformations: DataFrame, runs: DataFrame) -> DataFrame:
    """Runs of the jobs behind every edge."""
    jobs = edge_jobs(transformations).select("source_table", "target_table", "job").distinct()
    return jobs.join(runs, "job").select(
        "source_table", "target_table", "job", "run_id", "status", "started_at", "finished_at"
    )
