"""One registered query per operator, over the whole of its table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from headwater.llm import (
    collocations, conversations, decontam, linededup, packing, prefixcounts, pseudolikelihood, quality, secrets, simhash,
    urlfilter, warc, winnow,
)
from headwater.llm.common import read, text_of
from headwater.llm.oracle import ORACLE as ORACLE


def word_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_pseudolikelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return pseudolikelihood.score_corpus(docs, docs["doc_id"], text_of(docs))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return decontam.find_leaks(docs, docs["doc_id"], text_of(docs), read(spark, sf_dir, "benchmark"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    archive = warc.write_archive(pages, pages["page_id"], pages["url"], pages["html"])
    return warc.parse_records(warc.read_records(archive)).drop("record_bytes")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return packing.pack_documents(docs, docs["doc_id"], text_of(docs), word_tokenizer)


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table names one holder, its source: it is the owner, and its part in one language a repository."""
    docs = read(spark, sf_dir, "documents")
    repository = F.concat_ws("/", docs["source"], docs["lang"])
    return secrets.scan_secrets(docs, docs["doc_id"], text_of(docs), repository, docs["source"])


def held_out() -> Column:
    """The fold that no label is learned from."""
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4))
    return F.coalesce(fold == 2, F.lit(False))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    labels = read(spark, sf_dir, "labels").where(~held_out())
    model = quality.fit_quality(docs, docs["doc_id"], text_of(docs), labels)
    scored = quality.score_documents(docs, docs["doc_id"], text_of(docs), model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return simhash.simhash_components(docs, docs["doc_id"], text_of(docs), words=3)


def op8_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return winnow.winnow_documents(docs, docs["doc_id"], text_of(docs))


def op9_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return linededup.dedup_lines(docs, docs["doc_id"], text_of(docs), docs["source"])


def op10_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    rules = [urlfilter.site_rule(*r) for r in urlfilter.SITE_RULES] + urlfilter.method_rules()
    return urlfilter.filter_urls(pages, pages["page_id"], pages["url"], urlfilter.rules_table(spark, rules)).drop("pattern")


def byte_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return prefixcounts.count_tokens(docs, docs["doc_id"], docs["text"], byte_tokenizer)


def op12_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations")
    return conversations.repair(conversations.damage(turns, *[turns[c] for c in ("conv_id", "turn", "role", "text")]))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return collocations.collocations(docs, docs["lang"], docs["text"])


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pseudolikelihood": op1_pseudolikelihood,
    "op2_decontamination": op2_decontamination,
    "op3_warc": op3_warc,
    "op4_packing": op4_packing,
    "op5_secrets": op5_secrets,
    "op6_quality": op6_quality,
    "op7_simhash": op7_simhash,
    "op8_winnowing": op8_winnowing,
    "op9_lines": op9_lines,
    "op10_urls": op10_urls,
    "op11_token_counts": op11_token_counts,
    "op12_conversations": op12_conversations,
    "op13_collocations": op13_collocations,
}
