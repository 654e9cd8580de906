"""Warehouse schema sources. Each gives one row per column; :func:`table_specs` folds them.

A snapshot has (namespace, schema_name, table_name, column_name, ordinal, data_type).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from headwater.functions.names import normalize_type, sized_type
from headwater.schemas import COLUMNS

_INFORMATION_SCHEMA = """
    SELECT current_database() AS namespace, table_schema, table_name, column_name, ordinal_position, data_type,
           character_maximum_length, numeric_precision, numeric_scale, datetime_precision
    FROM information_schema.columns WHERE table_schema = '{schema}'
"""


def read_information_schema(spark: SparkSession, url: str, schema: str = "public", **options: str) -> DataFrame:
    """PostgreSQL and Greenplum: the filter runs in the database, only its result travels."""
    query = _INFORMATION_SCHEMA.format(schema=schema.replace("'", "''"))
    rows = spark.read.format("jdbc").options(url=url, query=query, **options).load()
    return information_schema_columns(rows)


def information_schema_columns(rows: DataFrame) -> DataFrame:
    """``information_schema.columns`` rows (plus ``namespace``) with full type text."""
    data_type = sized_type(
        F.col("data_type"),
        F.col("character_maximum_length"),
        F.col("numeric_precision"),
        F.col("numeric_scale"),
        F.col("datetime_precision"),
    )
    return rows.select(
        "namespace",
        F.col("table_schema").alias("schema_name"),
        "table_name",
        "column_name",
        F.col("ordinal_position").cast("int").alias("ordinal"),
        data_type.alias("data_type"),
    )


def read_column_lines(spark: SparkSession, path: str, database: str | None = None) -> DataFrame:
    """ClickHouse: JSON lines of ``system.columns``. Namespace and schema are the database."""
    rows = spark.read.schema("database string, `table` string, name string, type string, position int").json(path)
    if database is not None:
        rows = rows.filter(F.col("database") == (database or "default"))
    return rows.select(
        F.col("database").alias("namespace"),
        F.col("database").alias("schema_name"),
        F.col("table").alias("table_name"),
        F.col("name").alias("column_name"),
        F.col("position").alias("ordinal"),
        normalize_type(F.col("type")).alias("data_type"),
    )


def read_catalog(spark: SparkSession, database: str = "default") -> DataFrame:
    """Hive and Spark: the session catalog's non-temporary tables; one catalog call per table."""
    rows = []
    for table in spark.catalog.listTables(database):
        if table.isTemporary:
            continue
        full = ".".join(f"`{part.replace('`', '``')}`" for part in (database, table.name))
        for position, column in enumerate(spark.catalog.listColumns(full), 1):
            if column.name.strip():
                rows.append((database, database, table.name, column.name.strip(), position, column.dataType))
    return _typed(spark.createDataFrame(rows, COLUMNS))


def read_parquet_schemas(spark: SparkSession, paths: dict[str, str], namespace: str, schema: str) -> DataFrame:
    """A catalogue from Parquet footers: ``paths`` maps table names to their location."""
    rows = [
        (namespace, schema, name, column.name, position, column.dataType.simpleString())
        for name, path in paths.items()
        for position, column in enumerate(spark.read.parquet(path).schema, 1)
    ]
    return _typed(spark.createDataFrame(rows, COLUMNS))


def _typed(columns: DataFrame) -> DataFrame:
    return columns.withColumn("data_type", normalize_type(F.col("data_type")))


def table_specs(columns: DataFrame) -> DataFrame:
    """(namespace, schema_name, table_name, tbl, fields) with the columns in ordinal order.

    A group is the columns of one table.
    """
    column = F.struct("ordinal", F.col("column_name").alias("name"), "data_type")
    return (
        columns.groupBy("namespace", "schema_name", "table_name")
        .agg(F.array_sort(F.collect_list(column)).alias("c"))
        .select(
            "namespace",
            "schema_name",
            "table_name",
            F.concat_ws(".", "namespace", "schema_name", "table_name").alias("tbl"),
            F.transform("c", lambda c: F.struct(c["name"].alias("name"), c["data_type"].alias("data_type"))).alias("fields"),
        )
    )
