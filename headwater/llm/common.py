"""Small helpers that several operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def text_of(df: DataFrame, column: str = "text") -> Column:
    """The text, with null as the empty text."""
    return F.coalesce(df[column].cast("string"), F.lit(""))


#: Rows of a batch that are Python objects at the same time.
SLICE = 512


def _sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, SLICE):
            yield b.slice(at, SLICE)


def map_texts(
    df: DataFrame,
    columns: dict[str, Column],
    rows: Callable[[Iterator[dict[str, list]]], Iterator[dict[str, list]]],
    schema: str,
) -> DataFrame:
    """Run ``rows`` over each partition, as lists by column name of at most ``SLICE`` rows at a time.

    ``columns`` names what is read, so a table's other columns never reach Python and their names cannot clash.
    """
    from pyspark.sql.types import StructType
    from pyspark.sql.pandas.types import to_arrow_schema

    target = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in rows({n: c.to_pylist() for n, c in zip(b.schema.names, b.columns)} for b in _sliced(batches)):
            yield pa.RecordBatch.from_pydict(out, schema=target)

    return df.select(*[c.alias(n) for n, c in columns.items()]).mapInArrow(run, schema)


def keep_rows(df: DataFrame, text: str, decide: Callable[[], Callable[[list], list]]) -> DataFrame:
    """The rows of ``df``, with all their columns, whose text passes. ``decide`` is called once a task for a function
    from texts (null as empty) to one boolean each."""
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passes = decide()
        for b in _sliced(batches):
            yield b.filter(pa.array(passes([t or "" for t in b.column(at).to_pylist()]), type=pa.bool_()))

    numbered = df.toDF(*[f"c{i}" for i in range(len(df.columns))])  # names with dots do not resolve there
    return numbered.mapInArrow(run, numbered.schema).toDF(*df.columns)


def columns_of(df: DataFrame) -> list[Column]:
    """All columns by name, also names with dots."""
    return [df[f"`{c}`"] for c in df.columns]


def same_document(a: DataFrame, b: DataFrame, text: str = "text") -> Column:
    """Rows of ``a`` are those that ``b(doc_id, text_hash)`` names: by id, null like null, and by a hash of the text."""
    return a["doc_id"].eqNullSafe(b["doc_id"]) & (F.xxhash64(text_of(a, text)) == b["text_hash"])
