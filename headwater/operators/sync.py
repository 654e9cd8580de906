"""Schema-snapshot sync: what changed, what vanished, and the log of sync runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headwater.functions.names import mask_credentials
from headwater.storage import spread

# The kinds of warehouse a sync can read.
SOURCE_TYPES = ["postgresql", "greenplum", "clickhouse", "hadoop_spark"]
DEFAULT_SOURCE = "postgresql"


def sync_scope(sources: DataFrame) -> DataFrame:
    """What each configured source inspects and which scope of the model its result replaces."""
    kind = F.coalesce(F.nullif("source_type", F.lit("")), F.lit(DEFAULT_SOURCE))
    namespace, schema = F.col("namespace"), F.col("schema_name")
    by_namespace, by_schema = kind == "clickhouse", kind == "hadoop_spark"
    known = kind.isin(SOURCE_TYPES)

    def scoped(column):
        return F.when(by_namespace, namespace).when(by_schema, schema).when(known, column)

    return sources.select(
        "source_id",
        kind.alias("source_type"),
        scoped(schema).alias("inspect_schema"),
        scoped(namespace).alias("result_namespace"),
        scoped(schema).alias("result_schema"),
        F.when(~known, F.concat(F.lit("Unsupported source_type: "), kind)).alias("error"),
    )


def masked_sources(sources: DataFrame) -> DataFrame:
    """Configured sources as they may be shown."""
    return sources.withColumn("dsn", mask_credentials(F.col("dsn")))


def sync_status(runs: DataFrame) -> DataFrame:
    """Latest state per source from the append-only run log (source_id, run_no, run_at, result, error).

    A failed run sets the error and keeps the last success and its result.
    """
    at = F.struct("run_at", "run_no")
    ok = F.when(F.col("error").isNull(), at)
    return runs.groupBy("source_id").agg(
        F.max("run_at").alias("last_run_at"),
        F.max(F.when(F.col("error").isNull(), F.col("run_at"))).alias("last_success_at"),
        F.max_by("error", at).alias("last_error"),
        F.max_by("result", ok).alias("last_result"),
    )


def scopes_of(specs: DataFrame) -> DataFrame:
    return specs.select("namespace", "schema_name").distinct()


def sync_removed(specs: DataFrame, current_tables: DataFrame, scopes: DataFrame) -> DataFrame:
    """Current tables of the synced scopes that the snapshot no longer lists."""
    return (
        current_tables.join(scopes, ["namespace", "schema_name"], "left_semi")
        .join(spread(specs), "tbl", "left_anti")
        .select("tbl", "namespace", "schema_name")
    )


def sync_diff(specs: DataFrame, current_tables: DataFrame, scopes: DataFrame | None = None) -> DataFrame:
    """(tbl, status): changed, unchanged or removed."""
    scopes = scopes_of(specs) if scopes is None else scopes
    known = current_tables.select("tbl", F.col("fields").alias("known_fields"))
    same = F.col("known_fields").isNotNull() & ((F.size("fields") == 0) | (F.col("fields") == F.col("known_fields")))
    listed = specs.join(spread(known), "tbl", "left").select(
        "tbl", F.when(same, "unchanged").otherwise("changed").alias("status")
    )
    gone = sync_removed(specs, current_tables, scopes).select("tbl", F.lit("removed").alias("status"))
    return listed.unionByName(gone)
