"""Report sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def json_documents(report: DataFrame) -> DataFrame:
    """One JSON document per report row."""
    return report.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))


def write_json(report: DataFrame, path: str, mode: str = "errorifexists") -> None:
    json_documents(report).write.mode(mode).text(path)
