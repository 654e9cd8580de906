"""Run-event sources, batch and stream, and the event log derived from the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from headwater.functions.chunks import running_count
from headwater.schemas import RAW_EVENTS


def _placed(lines: DataFrame) -> DataFrame:
    return lines.select(
        F.col("value").alias("raw"),
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.col("_metadata.file_modification_time").alias("ts"),
    )


def number_placed(placed: DataFrame, start: int = 0) -> DataFrame:
    """``events(seq, ts, raw)`` of lines that carry their file and split: dense numbers by file name, then place in it.

    Only one row per file split is ordered globally; the lines themselves are not sorted.
    """
    placed = placed.withColumn("_id", F.monotonically_increasing_id())
    splits = placed.groupBy("_file", "_block").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1)
    bases = splits.withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first") + start)
    return placed.join(bases.select("_file", "_block", "_base"), ["_file", "_block"]).select(
        (F.col("_base") + F.col("_id")).cast("bigint").alias("seq"), "ts", "raw"
    )


def number_lines(lines: DataFrame, start: int = 0) -> DataFrame:
    """Give text lines a dense arrival number: file name, then place in the file."""
    return number_placed(_placed(lines), start)


def read_event_lines(spark: SparkSession, path: str) -> DataFrame:
    """``events(seq, ts, raw)`` from files of JSON lines; ``ts`` is the file's arrival time."""
    return number_lines(spark.read.text(path))


def read_events(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """``events(seq, ts, raw)`` from landed files that already carry the arrival number."""
    return spark.read.schema(RAW_EVENTS).format(fmt).load(path)


def stream_events(spark: SparkSession, path: str, fmt: str = "parquet", files_per_batch: int = 100) -> DataFrame:
    """The same as a stream."""
    return (
        spark.readStream.schema(RAW_EVENTS).format(fmt).option("maxFilesPerTrigger", files_per_batch).load(path)
    )


def stream_lines(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """Files of JSON lines as a stream, each line with its file and split; a batch numbers them with
    :func:`number_placed`, from where the one before ended."""
    return _placed(spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(path))


def append_events(events: DataFrame, path: str) -> None:
    """Append events to a log partitioned by arrival date."""
    (
        events.withColumn("ingest_date", F.to_date("ts"))
        .write.mode("append")
        .partitionBy("ingest_date")
        .parquet(path)
    )


_RAW = (
    """concat('{"eventType":"', event_type, '","eventTime":"', date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), 'Z","run":{"runId":"', run_id,
    '"},"job":{"namespace":"etl","name":"', job, '","facets":{"sql":{"dialect":"postgres","query":"SELECT a.c0, a.c1 + b.c1 AS c1 FROM ',
    in1, ' a JOIN ', in2, ' b ON a.c0 = b.c0', CASE WHEN k >= 95 THEN ' WHERE a.c1 > 0' ELSE '' END, '"}}},"inputs":[{"name":"', in1, '"',
    CASE WHEN l = 0 THEN ',"facets":{"schema":{"fields":[{"name":"c0","type":"bigint"},{"name":"c1","type":"double"},{"name":"c2","type":"string"}]}}' ELSE '' END,
    '}', CASE WHEN in2 <> in1 THEN concat(',{"name":"', in2, '"}') ELSE '' END, '],"outputs":[',
    CASE WHEN k = 0 THEN '' ELSE concat('{"name":"', out1, '","facets":{"schema":{"fields":[{"name":"c0","type":"bigint"},{"name":"c1","type":"',
      CASE WHEN k >= 90 THEN 'decimal(10,2)' ELSE 'double' END, '"}', CASE WHEN k >= 10 THEN ',{"name":"c2","type":"string"}' ELSE '' END, ']}',
      CASE WHEN k % 10 = 9 THEN '' ELSE concat(
        ',"columnLineage":{"fields":{"c0":{"inputFields":[{"name":"', in1, '","field":"c0","transformations":[{"type":"direct","subtype":"identity"}]}]},',
        '"c1":{"inputFields":[{"name":"', in1, '","field":"c1","transformations":[{"type":"DIRECT","subtype":"TRANSFORMATION","description":"sum","masking":false}]},',
        '{"name":"', in2, '","field":"c1","transformations":[{"type":"DIRECT","subtype":"TRANSFORMATION","description":"sum","masking":false}]}]},',
        '"c2":{"inputFields":[{"name":"', in2, '","field":"c2","transformations":[{"type":"DIRECT","subtype":"AGGREGATION"}]}]}},',
        '"dataset":[{"name":"', in2, '","field":"c0","transformations":[{"type":"INDIRECT","subtype":"JOIN"}]}]}') END,
      '}}') END, ']}')"""
)


def derived_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run-event log built from the ``events`` table: one job per user, six table layers.

    Each user's rows form runs of three events; users are numbered with
    :func:`running_count`, so a user with a third of all rows is still many tasks.
    """
    base = (
        spark.read.parquet(f"{sf_dir}/events.parquet")
        .select(
            F.col("event_id").alias("seq"),
            F.col("ts").cast("timestamp").alias("ts"),
            F.col("user_id").alias("u"),
            F.col("event_type").alias("et"),
            F.regexp_extract("props", "[0-9]+", 0).cast("int").alias("k"),
        )
    )
    step = F.col("rn") - 1
    i, h, l = F.floor(F.col("u") / 5), F.floor(F.col("u") / 10), F.col("u") % 5
    table = lambda layer, n: F.concat(F.lit("wh.l"), layer.cast("string"), F.lit(".t"), n.cast("string"))
    return (
        running_count(base, ["u"], "seq", "rn")
        .select(
            "seq",
            "ts",
            "k",
            l.alias("l"),
            F.concat(F.lit("run-"), F.col("u"), F.lit("-"), F.floor(step / 3)).alias("run_id"),
            F.when(step % 3 == 0, "START")
            .when(step % 3 == 1, "RUNNING")
            .when(F.col("et") == "error", "FAIL")
            .when(F.col("et") == "purchase", "ABORT")
            .otherwise("COMPLETE")
            .alias("event_type"),
            F.concat(F.lit("etl.job_"), F.col("u")).alias("job"),
            table(l, i).alias("in1"),
            table(l, h).alias("in2"),
            F.when(F.col("u") % 50 == 49, table(F.lit(1), i)).otherwise(table(l + 1, i)).alias("out1"),
        )
        .select("seq", "ts", F.expr(_RAW).alias("raw"))
    )
