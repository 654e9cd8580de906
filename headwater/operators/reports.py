"""Version differences and the impact reports built on them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headwater.operators.attributes import AttributeGraph, impact_paths
from headwater.storage import spread

TABLE_REPORT = ["tbl", "old_version", "new_version"]
JOB_REPORT = ["job", "old_version", "new_version"]


def consecutive(versions: DataFrame, key: str) -> DataFrame:
    """(key, old_version, new_version) of every version and the one before it."""
    return versions.filter(F.col("version") > 1).select(
        key, (F.col("version") - 1).alias("old_version"), F.col("version").alias("new_version")
    )


def check_pairs(pairs: DataFrame, versions: DataFrame, key: str) -> None:
    """Reject a request that compares a version with itself or names an unknown one."""
    if not pairs.filter(F.col("old_version") == F.col("new_version")).isEmpty():
        raise ValueError("cannot compare a version with itself")
    asked = pairs.select(key, F.explode(F.array("old_version", "new_version")).alias("version"))
    if not asked.join(versions.select(key, "version"), [key, "version"], "left_anti").isEmpty():
        raise LookupError("version not found")


def _sides(pairs: DataFrame, rows: DataFrame, key: str, version: str) -> tuple[DataFrame, DataFrame]:
    renamed = rows.withColumnRenamed(version, "_version")
    return tuple(
        pairs.withColumnRenamed(side, "_version")
        .join(spread(renamed), [key, "_version"])
        .withColumnRenamed("_version", side)
        for side in ("old_version", "new_version")
    )


def table_version_diff(pairs: DataFrame, attributes: DataFrame) -> DataFrame:
    """Attribute changes between two versions of a table, compared by name."""
    old, new = _sides(pairs, attributes.select("tbl", "version", "attr", "data_type"), "tbl", "version")
    on = [*TABLE_REPORT, "attr"]
    both = old.withColumnRenamed("data_type", "old_type").join(
        new.withColumnRenamed("data_type", "new_type"), on, "full_outer"
    )
    change = (
        F.when(F.col("old_type").isNull(), "ADDED")
        .when(F.col("new_type").isNull(), "REMOVED")
        .when(F.col("old_type") != F.col("new_type"), "MODIFIED")
    )
    return both.select(*on, change.alias("change_type"), "old_type", "new_type").filter(
        F.col("change_type").isNotNull()
    ).select(
        *on,
        "change_type",
        F.when(F.col("change_type") != "ADDED", F.col("old_type")).alias("old_type"),
        F.when(F.col("change_type") != "REMOVED", F.col("new_type")).alias("new_type"),
    )


_POINT = ["input_table", "input_attribute", "output_table", "output_attribute"]
_PAYLOAD = [
    "lineage_type", "lineage_subtype", "lineage_description", "lineage_masking", "lineage_scope", "source", "expression",
]


def job_version_diff(pairs: DataFrame, transformations: DataFrame) -> DataFrame:
    """Transformation changes between two versions of a job.

    Compared by input and output attribute; of several rows for the same two, the latest stored
    stands. ``transformations`` holds every row ever stored, closed or not.
    """
    order = [c for c in ("from_seq", "seq", "pos") if c in transformations.columns]
    latest = transformations.groupBy("job", "job_version", F.struct(*_POINT).alias("point")).agg(
        F.max_by(F.struct(*_PAYLOAD), F.struct(*order)).alias("payload")
    )
    old, new = _sides(pairs, latest, "job", "job_version")
    on = [*JOB_REPORT, "point"]
    both = old.withColumnRenamed("payload", "old").join(new.withColumnRenamed("payload", "new"), on, "full_outer")
    change = (
        F.when(F.col("old").isNull(), "ADDED")
        .when(F.col("new").isNull(), "REMOVED")
        .when(~F.col("old").eqNullSafe(F.col("new")), "MODIFIED")
    )
    return (
        both.select(*JOB_REPORT, "point", change.alias("change_type"), F.coalesce("new", "old").alias("item"))
        .filter(F.col("change_type").isNotNull())
        .select(*JOB_REPORT, "point.*", "change_type", "item.expression")
    )


def job_logic_changed(pairs: DataFrame, diff: DataFrame, jobs: DataFrame, transformations: DataFrame) -> DataFrame:
    """Where only the SQL text differs: one change per output attribute of the new version."""
    sql = jobs.select("job", "version", "sql")
    texts = (
        pairs.join(spread(diff.select(*JOB_REPORT).distinct()), JOB_REPORT, "left_anti")
        .join(spread(sql.select("job", F.col("version").alias("old_version"), F.col("sql").alias("old_sql"))), ["job", "old_version"])
        .join(spread(sql.select("job", F.col("version").alias("new_version"), F.col("sql").alias("new_sql"))), ["job", "new_version"])
        .filter(~F.col("old_sql").eqNullSafe(F.col("new_sql")))
        .select(*JOB_REPORT)
    )
    outputs = transformations.select(
        "job", F.col("job_version").alias("new_version"), "output_table", "output_attribute"
    ).distinct()
    return texts.join(spread(outputs), ["job", "new_version"]).select(
        *JOB_REPORT, "output_table", "output_attribute", F.lit("LOGIC_CHANGED").alias("change_type")
    )


def table_changes(diff: DataFrame) -> DataFrame:
    """Changed attributes of each report, in name order, as the start of an impact walk."""
    return diff.select(
        F.struct(*TABLE_REPORT).alias("report"), "tbl", "attr", "change_type", F.struct("attr").alias("place")
    )


def job_changes(diff: DataFrame, logic: DataFrame) -> DataFrame:
    """Changed output attributes of each report; several changes may meet in one attribute."""
    none = F.lit(None).cast("string")
    alike = logic.withColumn("input_table", none).withColumn("input_attribute", none)
    return (
        diff.select(*JOB_REPORT, *_POINT, "change_type")
        .unionByName(alike.select(*JOB_REPORT, *_POINT, "change_type"))
        .select(
            F.struct(*JOB_REPORT).alias("report"),
            F.col("output_table").alias("tbl"),
            F.col("output_attribute").alias("attr"),
            "change_type",
            F.struct(*_POINT).alias("place"),
        )
    )


def affected_attributes(paths: DataFrame, starts: DataFrame | None = None) -> DataFrame:
    """(report, affected_table, affected_attr, change_type, distance).

    The change type is that of the source of the last path to the attribute; ``starts`` adds the
    changed attributes themselves at distance 0, which any path replaces.
    """
    rank = F.struct("depth", "place", "route")
    reached = paths.groupBy("report", "affected_table", "affected_attr").agg(
        F.max_by("change_type", rank).alias("change_type"), F.min("depth").alias("distance")
    )
    if starts is None:
        return reached
    own = starts.groupBy("report", F.col("tbl").alias("affected_table"), F.col("attr").alias("affected_attr")).agg(
        F.max_by("change_type", "place").alias("own_type")
    )
    on = ["report", "affected_table", "affected_attr"]
    return own.join(reached, on, "full_outer").select(
        *on,
        F.coalesce("change_type", "own_type").alias("change_type"),
        F.when(F.col("own_type").isNotNull(), 0).otherwise(F.col("distance")).alias("distance"),
    )


def impact_report(affected: DataFrame) -> DataFrame:
    """One row per report and affected table; its attributes are at most the table's columns."""
    return affected.groupBy("report", "affected_table").agg(
        F.count(F.lit(1)).alias("affected_attributes"),
        F.min("distance").alias("distance"),
        F.array_sort(F.collect_list(F.struct(F.col("affected_attr").alias("name"), "change_type"))).alias("attributes"),
    ).select("report.*", "affected_table", "affected_attributes", "distance", "attributes")


def sorted_report(report: DataFrame, key: str) -> DataFrame:
    return report.orderBy(key, "new_version", "distance", "affected_table")


def table_impact(graph: AttributeGraph, diff: DataFrame) -> DataFrame:
    return impact_report(affected_attributes(impact_paths(graph, table_changes(diff))))


def job_impact(graph: AttributeGraph, diff: DataFrame, logic: DataFrame) -> DataFrame:
    changes = job_changes(diff, logic)
    return impact_report(affected_attributes(impact_paths(graph, changes), changes))
