"""Sync inputs derived from the test tables; their size follows the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from headwater.storage import new_path


def derived_catalog_rows(current_tables: DataFrame) -> DataFrame:
    """``information_schema.columns`` rows for layers 1 to 3 of the derived warehouse.

    Some tables are missing, some have retyped columns, some are new, most are unchanged.
    """
    n = F.regexp_extract("table_name", "([0-9]+)$", 1).cast("bigint")
    layers = current_tables.filter(F.col("schema_name").isin("l1", "l2", "l3")).withColumn("n", n)
    kept = (
        layers.filter(F.col("n") % 7 != 3)
        .select("namespace", "schema_name", "table_name", "n", F.posexplode("fields").alias("p", "f"))
        .select(
            "namespace",
            F.col("schema_name").alias("table_schema"),
            "table_name",
            F.col("f.name").alias("column_name"),
            (F.col("p") + 1).alias("ordinal_position"),
            F.col("f.data_type").alias("t"),
            "n",
        )
    )
    added = layers.filter(F.col("n") % 11 == 5).select(
        "namespace",
        F.col("schema_name").alias("table_schema"),
        F.concat(F.lit("new"), F.col("n").cast("string")).alias("table_name"),
        F.lit("c0").alias("column_name"),
        F.lit(1).alias("ordinal_position"),
        F.lit("bigint").alias("t"),
        "n",
    )
    c1_number = (F.col("column_name") == "c1") & (F.col("n") % 5 == 1)
    c2_text = (F.col("column_name") == "c2") & (F.col("n") % 5 == 2)
    c2_time = (F.col("column_name") == "c2") & (F.col("n") % 5 == 4)
    return kept.unionByName(added).select(
        "namespace",
        "table_schema",
        "table_name",
        "column_name",
        "ordinal_position",
        F.when(c1_number, "numeric")
        .when(c2_text, "character varying")
        .when(c2_time, "timestamp with time zone")
        .otherwise(F.concat(F.lit(" "), F.replace(F.col("t"), F.lit("("), F.lit(" (")), F.lit(" ")))
        .alias("data_type"),
        F.when(c2_text, 20).alias("character_maximum_length"),
        F.when(c1_number, 12).alias("numeric_precision"),
        F.when(c1_number, 3).alias("numeric_scale"),
        F.when(c2_time, 6).alias("datetime_precision"),
    )


def derived_column_lines(catalog_rows: DataFrame) -> str:
    """The same catalogue dumped as JSON lines, one per column; returns the folder."""
    path = new_path(catalog_rows.sparkSession, "columns-jsonl")
    catalog_rows.select(
        F.col("table_schema").alias("database"),
        F.col("table_name").alias("table"),
        F.col("column_name").alias("name"),
        F.col("data_type").alias("type"),
        F.col("ordinal_position").alias("position"),
    ).write.json(path)
    return path


def derived_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One configured sync source per supplier."""
    key = F.col("s_suppkey")
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    kinds = ["postgresql", "greenplum", "clickhouse", "hadoop_spark", "", "oracle"]
    return spark.read.parquet(f"{sf_dir}/supplier.parquet").select(
        key.alias("source_id"),
        F.element_at(F.array(*[F.lit(k) for k in kinds]), (key % 6 + 1).cast("int")).alias("source_type"),
        F.when(key % 4 == 0, text("postgresql://user", key, ":pw", key, "@host", key, ":5432/"))
        .when(key % 4 == 1, text("http://token", key, "@host/"))
        .when(key % 4 == 2, text("spark://host", key, ":7077"))
        .otherwise(text("postgresql://u:p:", key, "@h@x/"))
        .alias("dsn"),
        text("db", F.col("s_nationkey")).alias("namespace"),
        text("s", key % 10).alias("schema_name"),
    )


def derived_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One user's question per supplier: about a table, and an attribute of it."""
    key = F.col("s_suppkey")
    return spark.read.parquet(f"{sf_dir}/supplier.parquet").select(
        F.concat(F.lit("wh.l"), (F.col("s_nationkey") % 6).cast("string"), F.lit(".t"), key.cast("string")).alias("tbl"),
        F.concat(F.lit("c"), (key % 3).cast("string")).alias("attr"),
    )
