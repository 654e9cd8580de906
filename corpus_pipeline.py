"""From raw documents to packed training sequences: quality, lines, near copies, test items, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from headwater.llm import decontam, linededup, packing, quality, simhash
from headwater.llm.common import read, text_of
from headwater.llm.queries import held_out, word_tokenizer
from headwater.storage import materialize

#: A document goes only if it is likelier bad than good.
REJECT_BELOW = 0.5


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the compression classifier, fitted on the labels, rejects."""
    labels = read(spark, sf_dir, "labels").where(~held_out())
    model = quality.fit_quality(docs, docs["doc_id"], text_of(docs), labels)
    return quality.keep_good(docs, model, REJECT_BELOW)


def without_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes lines that many sources share out of the texts, but for the first place of each."""
    return linededup.with_clean_lines(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves one document of each group of exact and near copies."""
    return simhash.without_copies(docs)


def without_test_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item."""
    return decontam.without_leaks(docs, read(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents left, in sequences."""
    return packing.pack_documents(docs, docs["doc_id"], text_of(docs), word_tokenizer)


STAGES = [
    ("quality", good_documents),
    ("lines", without_boilerplate),
    ("near_copies", without_near_copies),
    ("test_items", without_test_items),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs


#: The classifier and the tokenizer cannot be said in SQL; tests hold the stages against direct computations.
ORACLE_SQL = None
