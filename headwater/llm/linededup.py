"""Removal of boilerplate lines: those that very many sites hold, counted by mergeable sketches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from headwater.llm.common import same_document, text_of
from headwater.storage import materialize

#: Lines on so many sites are boilerplate.
MIN_SITES = 4
#: HyperLogLog sketches of 2^LG_K registers; the relative standard error is about 1.04 / sqrt(2^LG_K).
LG_K = 12
#: Estimates within so many standard errors of the threshold are counted exactly.
ERRORS = 6


def _lines(rows: DataFrame) -> DataFrame:
    """``rows`` exploded into non-blank lines: ``pos`` and ``line``, a 128-bit key of the line's exact text."""
    lines = rows.select("*", F.posexplode(F.split("text", "\n", -1)).alias("pos", "content"))
    key = F.struct(F.xxhash64("content").alias("a"), F.xxhash64(F.lit(1), F.reverse("content")).alias("b"))
    return lines.where(F.col("content").rlike("\\S")).select("*", key.alias("line")).drop("text", "content")


def boilerplate(lines: DataFrame, min_sites: int = MIN_SITES, lg_k: int = LG_K) -> DataFrame:
    """``(line, sites, first)`` of the lines of ``lines(line, site, place)`` that at least ``min_sites`` distinct sites
    hold; ``first`` is the least place.

    Every line has a HyperLogLog sketch of its sites, begun on the map side and merged after the shuffle. The estimate
    decides, but for lines where it lies within ``ERRORS`` standard errors of the threshold, and at least 1: their sites are
    counted exactly. ``sites`` is the estimate or the exact count, whichever decided.
    """
    margin = max(1.0, ERRORS * 1.04 / 2 ** (lg_k / 2) * min_sites)
    marked = F.concat(F.lit("="), F.col("site"))  # a sketch leaves out empty strings
    sketched = lines.groupBy("line").agg(
        F.hll_sketch_estimate(F.hll_sketch_agg(marked, lg_k)).alias("sites"), F.min("place").alias("first")
    )
    sketched = materialize(sketched.where(F.col("sites") >= min_sites - margin), "sketched-lines")
    clear = F.col("sites") > min_sites + margin
    near = sketched.where(~clear).select("line", "first")
    counted = lines.join(near.select("line"), "line", "left_semi").groupBy("line").agg(F.count_distinct("site").alias("sites"))
    counted = counted.where(F.col("sites") >= min_sites).join(near, "line")
    return sketched.where(clear).select("line", "sites", "first").union(counted.select("line", "sites", "first"))


def clean_lines(
    docs: DataFrame, doc_id: Column, text: Column, site: Column, min_sites: int = MIN_SITES, lg_k: int = LG_K
) -> DataFrame:
    """``(doc_id, text_hash, drop)``: the line numbers to remove, for the documents that have any.

    A boilerplate line stays in one place, its first line in the document of the smallest id, so nothing is lost from
    the corpus. Lines are compared exactly as written between line feeds; blank lines always stay. A null site counts as
    one of its own. Rows repeating an id and text are one document.
    """
    rows = docs.select(
        doc_id.alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"),
        F.coalesce(site.cast("string"), F.lit("")).alias("site"),
    )
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_hash", "pos").alias("place")
    lines = _lines(rows).select("line", "site", place)
    known = materialize(boilerplate(lines, min_sites, lg_k).select("line", "first"), "boilerplate")
    found = lines.join(known, "line").where(F.col("place") != F.col("first")).select("place.*")
    found = materialize(found, "boilerplate-lines")
    return found.groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_set("pos")).alias("drop"))


def without_lines(text: Column, drop: Column) -> Column:
    """A text without the numbered lines."""
    lines = F.transform(F.split(text, "\n", -1), lambda x, i: F.when(~F.array_contains(drop, i), x))
    return F.when(F.size(drop) > 0, F.array_join(F.filter(lines, lambda x: x.isNotNull()), "\n")).otherwise(text)


def dedup_lines(
    docs: DataFrame, doc_id: Column, text: Column, site: Column, min_sites: int = MIN_SITES, lg_k: int = LG_K
) -> DataFrame:
    """``(doc_id, text, n_lines, n_removed)`` per row, the text without its boilerplate lines (``clean_lines``).

    Null and empty texts have one blank line, which stays. No rows give no rows.
    """
    rows = docs.select(doc_id.alias("doc_id"), text.alias("text"))
    drops = clean_lines(docs, doc_id, text, site, min_sites, lg_k)
    drop = F.coalesce(drops["drop"], F.array().cast("array<int>"))
    return rows.join(drops, same_document(rows, drops), "left").select(
        rows["doc_id"],
        without_lines(rows["text"], drop).alias("text"),
        F.size(F.split(rows["text"], "\n", -1)).alias("n_lines"),
        F.size(drop).alias("n_removed"),
    )


def with_clean_lines(docs: DataFrame, site: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """``docs(doc_id, text, n_chars, ...)`` with boilerplate lines out of the text, and ``n_chars`` that of the new one.

    Every row stays, also one whose lines all stand elsewhere. Null texts stay null.
    """
    text = text_of(docs)
    drops = clean_lines(docs, docs["doc_id"], text, docs[site], min_sites)
    joined = docs.join(drops, same_document(docs, drops), "left")
    new = F.when(drops["drop"].isNotNull(), without_lines(text, drops["drop"])).otherwise(docs["text"])
    columns = []
    for c in docs.columns:
        column = docs[f"`{c}`"]
        if c == "text":
            column = new.alias(c)
        elif c == "n_chars":
            column = F.when(drops["drop"].isNotNull(), F.length(new)).otherwise(column).cast(docs.schema[c].dataType).alias(c)
        columns.append(column)
    return joined.select(*columns)
