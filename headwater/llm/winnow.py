"""Winnowing fingerprints in built-in functions: k-gram hashes, the least in each window, rightmost of equal ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from headwater.storage import materialize

#: A k-gram is so many pieces of text: words in lower case, long ones cut every PIECE characters.
GRAM, PIECE = 3, 8
#: k-grams in a window, a power of two. Texts sharing WINDOW + GRAM - 1 pieces in a row share a fingerprint.
WINDOW = 8
_PLACE = 24


def with_fingerprint(df: DataFrame, text: str, name: str) -> DataFrame:
    """``df`` with ``name``: ``array<bigint>`` of the selected k-grams in text order, hash (39 bits) over place (24 bits).

    Places count k-grams from the text's start, modulo 2^24, and are stored as their complement, so that the least value
    of a window is that of the least hash and among equal ones the rightmost. Texts of fewer pieces than a k-gram have
    one value for all of them; texts without a piece have none.
    """
    p, h, g, c = (f"hw_{x}_{name}" for x in "phgc")
    parts = ", ".join(f"{h}[i + {j}]" for j in range(GRAM))
    grams = (
        f"if(size({h}) >= {GRAM}, transform(sequence(0, greatest(0, size({h}) - {GRAM})), i -> xxhash64({parts})), "
        f"if(size({h}) > 0, array(xxhash64({h})), array()))"
    )
    top = (1 << _PLACE) - 1
    placed = f"transform({g}, (x, i) -> shiftleft(shiftrightunsigned(x, 25), {_PLACE}) | ({top} - (i & {top})))"
    kept = [x for x in df.columns]
    df = df.select("*", F.expr(f"transform(regexp_extract_all(lower({text}), '[^\\\\s]{{1,{PIECE}}}', 0), x -> xxhash64(x))").alias(h))
    df = df.select(*kept, F.expr(grams).alias(g))
    df = df.select(*kept, F.expr(placed).alias(c))
    step = 1
    while step < WINDOW:
        # The least of a window shorter than WINDOW is that of all there are.
        wide = f"size({c}) > {step}"
        df = df.select(
            *kept,
            F.expr(
                f"if({wide}, zip_with(slice({c}, 1, size({c}) - {step}), slice({c}, {step} + 1, size({c}) - {step}), "
                f"(x, y) -> least(x, y)), if(size({c}) > 0, array(array_min({c})), {c}))"
            ).alias(c),
        )
        step *= 2
    return df.select(*kept, F.array_distinct(c).alias(name))


def hashes(name: str) -> str:
    """SQL for the distinct hashes of a fingerprint."""
    return f"array_distinct(transform({name}, x -> shiftright(x, {_PLACE})))"


def places(name: str) -> str:
    """SQL for the k-gram numbers of a fingerprint."""
    top = (1 << _PLACE) - 1
    return f"transform({name}, x -> {top} - (x & {top}))"


def likeness(a: str, b: str) -> str:
    """SQL for twice the shared hashes over all hashes of two hash sets; two empty ones are alike."""
    return f"if(size({a}) + size({b}) = 0, 1D, 2D * size(array_intersect({a}, {b})) / (size({a}) + size({b})))"


def as_text(name: str) -> str:
    return f"array_join(transform({name}, x -> lower(hex(x))), ' ')"


def _chain(keys: DataFrame) -> DataFrame:
    """Each key of ``(doc_id, text_hash, n_chars)`` with the one before it in descending order, the first with the last.

    Ids are dealt into ranges; inside a range the neighbour is a window's, and over the edge of a range it is looked up
    in the list of first and last keys per range. No task sees more than a range.
    """
    n = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    down = F.col("doc_id").desc_nulls_last()
    ranged = keys.repartitionByRange(n, down, F.col("text_hash")).withColumn("range", F.spark_partition_id())
    ranged = materialize(ranged, "ranges")
    w = W.partitionBy("range").orderBy(down, F.col("text_hash"))
    key = F.struct("doc_id", "text_hash", "n_chars")
    near = ranged.select("range", "doc_id", "text_hash", F.lag(key).over(w).alias("before"), F.lead(F.lit(True)).over(w).isNull().alias("last"), "n_chars")
    near = materialize(near, "chain")
    edges = near.where("last").select("range", key.alias("last_key"))  # one row per range
    order = W.orderBy("range")
    whole = W.orderBy("range").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    joins = edges.select("range", F.coalesce(F.lag("last_key").over(order), F.last("last_key").over(whole)).alias("edge"))
    return near.join(joins, "range").select(
        "doc_id", "text_hash", "n_chars", F.coalesce("before", "edge").alias("before")
    )


def winnow_documents(docs: DataFrame, doc_id: Column, text: Column) -> DataFrame:
    """Fingerprint each text and its edited form, whose last third is the start of the next document's text.

    The next document is the one with the next smaller id, and after the smallest the largest. Rows sharing an id follow
    each other by a hash of their text; rows repeating both are one document, and each gets its row. Null ids come last.

    A document's start and hashes travel to its predecessor; the whole text is shuffled once, by its key. Returns
    ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint`` (hex values, hash over place), ``near_edited``,
    ``near_next``. Null texts are empty. No rows give no rows.
    """
    rows = docs.select(doc_id.alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_hash"))
    keys = rows.select("doc_id", "text_hash", F.length("text").cast("bigint").alias("n_chars")).distinct()
    chain = materialize(_chain(keys), "chained")

    def same(a: DataFrame, b: DataFrame) -> Column:
        return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["text_hash"] == b["text_hash"])

    lent = rows.join(chain, same(rows, chain)).select(
        rows["text"], rows["doc_id"].alias("own_id"), rows["text_hash"].alias("own_hash"), "before"
    )
    lent = with_fingerprint(lent, "text", "fp").selectExpr(
        "own_id", "own_hash", "before.doc_id doc_id", "before.text_hash text_hash",
        "substring(text, 1, int(before.n_chars div 3)) start", f"{hashes('fp')} next_hashes",
    )
    # Rows repeating an id and text lend the same.
    if chain.agg(F.count(F.lit(1))).first()[0] < rows.select("doc_id").count():
        lent = lent.dropDuplicates(["doc_id", "text_hash"])
    lent = lent.drop("own_id", "own_hash")
    full = rows.join(lent, same(rows, lent)).select(rows["doc_id"], rows["text"], "start", "next_hashes")
    full = full.selectExpr(
        "doc_id", "text", "next_hashes", "bigint(length(text)) n_chars",
        "concat(substring(text, 1, length(text) - length(text) div 3), start) edited",
    )
    full = with_fingerprint(with_fingerprint(full, "text", "fp"), "edited", "edited_fp")
    full = full.selectExpr("*", f"{hashes('fp')} own_hashes", f"{hashes('edited_fp')} edited_hashes")
    return full.selectExpr(
        "doc_id", "n_chars", "sha2(edited, 256) edited_sha256",
        f"{as_text('fp')} fingerprint", f"{as_text('edited_fp')} edited_fingerprint",
        f"{likeness('own_hashes', 'edited_hashes')} near_edited", f"{likeness('own_hashes', 'next_hashes')} near_next",
    )
