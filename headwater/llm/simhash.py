"""SimHash fingerprints, and near copies as components of fingerprints that differ in few bits.

The join: a fingerprint's segments are mapped to their bit counts. A flipped bit moves one count by one, so the Manhattan
distance of two count vectors is a lower bound of the number of differing bits. Fingerprints within two bits therefore
both lie within distance one of a common grid cell (the counts of the fingerprint half-way between them). Each
fingerprint is dealt to the few cells within distance one; only cells with company go on. There, members name the actual
half-way fingerprints in the cell, themselves or themselves with one bit flipped: two fingerprints name the same one
exactly if they differ in at most two bits. No pair is ever formed, at most 65 fingerprints can name one, and a group
of any size costs its members times a constant.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from headwater.llm import slots
from headwater.llm.common import columns_of, map_texts, same_document
from headwater.llm.components import components
from headwater.storage import materialize, scratch

BITS, SEGMENT = 64, 4
#: The join finds fingerprints within this many differing bits, which is what one common half-way point means.
RADIUS = 2


def shingle_hashes(data: bytes, words: int, seed: int) -> np.ndarray:
    """XXH64 of every run of ``words`` words of lower-cased UTF-8 text; of all of them if there are fewer."""
    found = data.split()
    if len(found) <= words:
        return np.array([xxhash.xxh64_intdigest(b" ".join(found), seed)] if found else [], dtype="<u8")
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), dtype=np.int64, count=len(found)) + 1) - 1
    starts = [0, *(ends[: len(found) - words] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    hashes = [digest(joined[a:b], seed) for a, b in zip(starts, ends[words - 1 :].tolist())]
    return np.array(hashes, dtype="<u8")


def fingerprint(hashes: np.ndarray) -> int:
    """A bit is set if it is in over half of the hashes; no hashes give zero. Signed, as Spark's bigint."""
    if not len(hashes):
        return 0
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 14):
        part = hashes[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, doc_id: Column, text: Column, words: int = 3, seed: int = 42) -> DataFrame:
    """``(doc_id, fp bigint, text_hash bigint)`` per row: SimHash over ``words``-word shingles, repeats included.

    A-Z count as a-z; words end at ASCII white space. Null, empty and blank texts have fingerprint zero.
    ``text_hash`` tells apart rows that share an id.
    """

    def rows(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        for batch in batches:
            data = [(t or "").encode() for t in batch["text"]]
            yield {
                "doc_id": batch["doc_id"],
                "fp": [fingerprint(shingle_hashes(d.lower(), words, seed)) for d in data],
                "text_hash": [int(np.uint64(xxhash.xxh64_intdigest(d)).astype(np.int64)) for d in data],
            }

    return map_texts(docs, {"doc_id": doc_id, "text": text}, rows, "doc_id bigint, fp bigint, text_hash bigint")


def _cells(fps: DataFrame) -> DataFrame:
    """``(fp, cell, half)``: the cells within distance one, and in each the fingerprints at most one bit away."""
    segments = BITS // SEGMENT
    width = SEGMENT.bit_length()  # of a count, so that a vector of counts fits a bigint
    mask = (1 << SEGMENT) - 1
    counted = fps.selectExpr(
        "fp", f"transform(sequence(0, {segments - 1}), s -> bit_count(shiftrightunsigned(fp, {SEGMENT} * s) & {mask})) n"
    ).selectExpr(
        "fp", "n", f"aggregate(sequence(0, {segments - 1}), 0L, (a, s) -> a + shiftleft(bigint(n[s]), {width} * s)) home"
    )
    flips = f"""transform(
        filter(sequence(0, {SEGMENT - 1}), b -> shiftrightunsigned(fp, {SEGMENT} * s + b) & 1 = bit),
        b -> fp ^ shiftleft(1L, {SEGMENT} * s + b))"""
    moves = f"""flatten(transform(sequence(0, {segments - 1}), s -> transform(array(0, 1), bit -> named_struct(
        'cell', home + if(bit = 0, 1, -1) * shiftleft(1L, {width} * s), 'half', {flips}))))"""
    near = f"concat(array(named_struct('cell', home, 'half', array(fp))), filter({moves}, x -> size(x.half) > 0))"
    return counted.selectExpr("fp", f"inline({near})")


def links(fps: DataFrame, put: Callable[[DataFrame, str], DataFrame] = materialize) -> DataFrame:
    """``(src, dst)``: of all distinct ``fp`` values that share a half-way fingerprint, each with the smallest.

    The components of these links are those of all pairs within ``RADIUS`` bits.
    """
    cells = put(_cells(fps), "cells")
    company = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("cell")
    halves = cells.join(company, "cell", "left_semi").select("fp", F.explode("half").alias("half"))
    near = halves.groupBy("half").agg(F.collect_set("fp").alias("fps")).where("size(fps) > 1")
    return near.select(F.array_min("fps").alias("src"), F.explode("fps").alias("dst")).where("src <> dst").distinct()


def fingerprint_groups(fps: DataFrame) -> DataFrame:
    """``(fp, component_id)`` for every distinct ``fp`` of ``fps(doc_id, fp)``: the smallest ``doc_id`` reachable over
    fingerprints within ``RADIUS`` bits of each other. Null ids are passed over; a component of null ids has null.
    """
    distinct = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "fingerprints")
    linked = components(links(distinct.select("fp"))).select(F.col("node").alias("fp"), "root")
    rooted = materialize(
        distinct.join(linked, "fp", "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root")), "rooted"
    )
    lowest = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return rooted.join(lowest, "root").select("fp", "component_id")


def simhash_components(docs: DataFrame, doc_id: Column, text: Column, words: int = 3, seed: int = 42) -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` per row: 16 hex digits, and the smallest id within reach.

    Repeated rows share their fingerprint's component, as do all texts without words. No rows give no rows.
    """
    fps = materialize(fingerprints(docs, doc_id, text, words, seed), "simhash")
    groups = fingerprint_groups(fps)
    return fps.join(groups, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


#: Near copies: words of a shingle, and the share of shingles two texts have in common.
NEAR_WORDS, NEAR = 5, 0.8
#: Shingles counted at a time for the order of keys, and how many of the most common ones it knows.
CHUNK, COMMON = 1 << 20, 1 << 16
#: Rounds in which holders of a key meet some of those like them, at the cost of their number, before all pairs do, and
#: bytes of the fingerprint that each round looks at.
ROUNDS, BYTES = 2, 4
#: Slots for each key in the table that tells which keys two texts may share.
SLOTS_A_KEY = 8


def common_shingles(docs: DataFrame, text: Column, words: int) -> np.ndarray:
    """Hashes of the most common shingles, the commonest last. Only the cost of ``prefix_keys`` depends on them."""

    def rows(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        def counted(held: list[np.ndarray]) -> dict[str, list]:
            found, n = np.unique(np.concatenate(held), return_counts=True)
            return {"shingle": found[n > 1].view("<i8").tolist(), "n": n[n > 1].tolist()}

        held, waiting = [], 0
        for b in batches:
            for t in b["text"]:
                held.append(np.unique(shingle_hashes(t.encode("utf-8", "replace").lower(), words, 42)))
                waiting += len(held[-1])
                if waiting >= CHUNK:
                    yield counted(held)
                    held, waiting = [], 0
        if held:
            yield counted(held)

    counts = map_texts(docs, {"text": text}, rows, "shingle bigint, n bigint").groupBy("shingle").agg(F.sum("n").alias("n"))
    top = counts.orderBy(F.desc("n"), "shingle").limit(COMMON).collect()
    return np.array([r["shingle"] for r in reversed(top)], dtype="<i8").view("<u8")


def prefix_keys(shingles: np.ndarray, common: tuple[np.ndarray, np.ndarray], similarity: float) -> np.ndarray:
    """The first of distinct shingles, so many that two sets of ``similarity`` have one of them in common.

    Such sets share ``similarity`` of either at least, so the first shared shingle is no later than this in both. That
    holds for any order that all texts have in common; here common ones (sorted hashes, ranks) come last.
    """
    values, ranks = common
    rank = np.full(len(shingles), -1, dtype=np.int64)
    if len(values):
        place = np.minimum(np.searchsorted(values, shingles), len(values) - 1)
        rank = np.where(values[place] == shingles, ranks[place], -1)
    n = len(shingles)
    return shingles[np.lexsort((shingles, rank))][: n - math.ceil(similarity * n - 1e-9) + 1 if n else 0]


def shared_keys(held: DataFrame) -> DataFrame:
    """``(node, n, fp, at, key)`` for the keys of ``held(node, n, fp, keys)`` that two rows may have in common; few others.

    Most keys are in one text alone. A table of bounded size that is counted where the keys are tells, so those never
    travel; where it is too small, more of them do.
    """
    many = held.agg(F.sum(F.size("keys"))).first()[0] or 0
    bits = slots.bits_for(many * SLOTS_A_KEY)
    down = np.uint64(64 - bits)

    def slots_of(keys: list[int]) -> np.ndarray:
        return (np.array(keys, dtype=np.int64).view(np.uint64) >> down).astype(np.int64)

    def count(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        found, waiting = [], 0
        for b in batches:
            for keys in b["keys"]:
                found.append(np.unique(slots_of(keys)))
                waiting += len(keys)
            if waiting >= CHUNK:
                yield slots.counted(np.concatenate(found), bits)
                found, waiting = [], 0
        if waiting:
            yield slots.counted(np.concatenate(found), bits)

    counted = map_texts(held, {"keys": held["keys"]}, count, slots.COUNTED)
    shared = held.sparkSession.sparkContext.broadcast(slots.frequent(counted, bits, 2))  # of bounded size

    def rows(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        for b in batches:
            at = [np.flatnonzero(slots.passes(shared.value, slots_of(keys))) for keys in b["keys"]]
            kept = [np.array(keys, dtype=np.int64)[a].tolist() for keys, a in zip(b["keys"], at)]
            yield {"node": b["node"], "n": b["n"], "fp": b["fp"], "at": [a.tolist() for a in at], "key": kept}

    columns = {c: held[c] for c in ("node", "n", "fp", "keys")}
    kept = map_texts(held, columns, rows, "node bigint, n bigint, fp bigint, at array<int>, key array<bigint>")
    each = kept.select("node", "n", "fp", F.explode(F.arrays_zip("at", "key")).alias("x"))
    return each.select("node", "n", "fp", "x.at", "x.key")


def verified(
    pairs: DataFrame, nodes: DataFrame, docs: DataFrame, doc_id: Column, text: Column, words: int, similarity: float,
    put: Callable[[DataFrame, str], DataFrame],
) -> DataFrame:
    """The ``(src, dst)`` of ``pairs(a, b)`` whose whole shingle sets are ``similarity`` alike."""

    def alike(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        """Texts travel, as they take a third of the disk of their hashes."""

        def shingles(t: str) -> np.ndarray:
            return np.unique(shingle_hashes(t.encode("utf-8", "replace").lower(), words, 42))

        for batch in batches:
            out: dict[str, list] = {"src": [], "dst": []}
            last, y = None, None
            for a, b, left, right in zip(batch["a"], batch["b"], batch["x"], batch["y"]):
                x = shingles(left)
                if b != last:
                    last, y = b, shingles(right)
                common = len(np.intersect1d(x, y, assume_unique=True))
                if common >= similarity * (len(x) + len(y) - common):
                    out["src"].append(a)
                    out["dst"].append(b)
            yield out

    with scratch(docs.sparkSession, "texts") as own_put:
        asked = pairs.select("a").union(pairs.select("b")).distinct()
        whose = nodes.join(asked, nodes["node"] == asked["a"], "left_semi")
        whose = own_put(whose.select("node", "row.doc_id", "row.text_hash"), "asked")
        own = docs.select(doc_id.alias("doc_id"), text.alias("text"))
        texts = own_put(own.join(whose, same_document(own, whose)).select("node", "text"), "texts")
        left = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("x")), "a")
        both = left.join(texts.select(F.col("node").alias("b"), F.col("text").alias("y")), "b")
        columns = {c: both[c] for c in ("a", "b", "x", "y")}
        return put(map_texts(both, columns, alike, "src bigint, dst bigint"), "alike")


def in_several(held: DataFrame) -> DataFrame:
    """The rows of ``held(key, root)`` whose key is held in more than one group."""
    mixed = held.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("key")
    return held.join(mixed, "key", "left_semi")


def hooked(held: DataFrame, hooks: list[DataFrame]) -> DataFrame:
    """``held`` with its roots moved along each of ``hooks(root, low)`` in turn."""
    for hook in hooks:
        held = held.join(hook, "root", "left").withColumn("root", F.coalesce("low", "root")).drop("low")
    return held


def near_copies(
    docs: DataFrame, doc_id: Column, text: Column, words: int = NEAR_WORDS, similarity: float = NEAR,
    put: Callable[[DataFrame, str], DataFrame] = materialize,
) -> DataFrame:
    """``(doc_id, text_hash, root)`` per row: texts whose sets of ``words``-word shingles are ``similarity`` alike, and
    all they lead to, share a root. ``text_hash`` is Spark's hash of the text as it is.

    Texts that read alike are one from the start, so a group of exact copies costs one text. Every pair of
    ``similarity`` has a key in common (``prefix_keys``), whatever the texts' lengths. First each text meets the
    least holder of each of its keys and those of SimHash fingerprints within two bits (``links``), which joins the
    bulk of every group at the cost of its members; in a few rounds, holders of a key meet those that share a part of their
    fingerprint. A round only moves a group to the least one that it is linked with, which is a part of what its links join,
    so that fewer pairs are left; all links are followed to their ends once, at the end. Before that,
    all pairs of a key's holders that are still in different groups, and whose sizes and places of the key leave room
    for ``similarity``, are looked at. Every pair is verified
    on the whole shingle sets, so the groups are those of all pairs.
    Texts without words are one group.
    """
    ranked = common_shingles(docs, text, words)
    order = np.argsort(ranked)
    shared = docs.sparkSession.sparkContext.broadcast((ranked[order], order))  # of bounded size

    def rows(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        for b in batches:
            out: dict[str, list] = {"doc_id": b["doc_id"], "text_hash": b["text_hash"], "node": [], "fp": [], "n": [], "keys": []}
            for t in b["text"]:
                data = t.encode("utf-8", "replace").lower()
                found = shingle_hashes(data, words, 42)
                out["node"].append(int(np.uint64(xxhash.xxh64_intdigest(b" ".join(data.split()))).astype(np.int64)))
                out["fp"].append(fingerprint(found))
                found = np.unique(found)
                out["n"].append(len(found))
                out["keys"].append(prefix_keys(found, shared.value, similarity).view("<i8").tolist())
            yield out

    read = map_texts(
        docs, {"doc_id": doc_id, "text_hash": F.xxhash64(text), "text": text}, rows,
        "doc_id bigint, text_hash bigint, node bigint, fp bigint, n bigint, keys array<bigint>",
    )
    with scratch(docs.sparkSession, "keys") as own:
        read = own(read, "read")
        table = put(read.select("doc_id", "text_hash", "node"), "near")
        # The keys of one row of each text; the others of it, however many, have the same.
        firsts = [F.first(c).alias(c) for c in ("fp", "n", "keys")]
        texts = own(read.groupBy("node").agg(F.min(F.struct("doc_id", "text_hash")).alias("row"), *firsts), "texts")
        nodes = put(texts.drop("keys"), "nodes")
        held = put(shared_keys(texts.drop("row")), "held")
    first = put(nodes.groupBy("fp").agg(F.min_by(F.struct(F.col("node").alias("b"), F.col("n").alias("n_b")), "node").alias("f")), "fps")
    first = first.select("fp", "f.b", "f.n_b")
    with scratch(docs.sparkSession, "cells") as cells:
        far = links(first.select("fp"), cells).join(first.withColumnRenamed("fp", "src"), "src").select("dst", "b", "n_b")
        far = far.join(first.select(F.col("fp").alias("dst"), F.col("b").alias("a"), F.col("n_b").alias("n_a")), "dst")
        far = put(far.select("a", "b", "n_a", "n_b"), "far")
    alike = nodes.join(first, "fp").select(F.col("node").alias("a"), F.col("n").alias("n_a"), "b", "n_b")
    least = held.groupBy("key").agg(
        F.min_by(F.struct(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("at").alias("at_b")), "node").alias("l"),
        F.count(F.lit(1)).alias("holders"),
    )
    least = least.where("holders > 1").select("key", "l.*")
    # Up to their first shared key two sets share nothing, so no more is left than the shorter rest.
    need = lambda a, b: similarity / (1 + similarity) * (F.col(a) + F.col(b)) - 1e-6
    met = held.select("key", F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("at").alias("at_a")).join(least, "key")
    met = met.where(F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b")) >= need("n_a", "n_b"))
    by_bits = far.unionByName(alike).where(F.least("n_a", "n_b") >= need("n_a", "n_b"))
    pairs = by_bits.select("a", "b").unionByName(met.select("a", "b")).where("a <> b")
    pairs = put(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
    edges = verified(pairs, nodes, docs, doc_id, text, words, similarity, put)

    roots = components(edges, put)
    looked, found, hooks = [pairs], [roots.select(F.col("node").alias("src"), F.col("root").alias("dst"))], []
    grouped = held.join(roots, "node", "left").select("key", "node", "n", "at", "fp", F.coalesce("root", "node").alias("root"))
    grouped = put(in_several(grouped), "grouped")

    def unseen(pairs: DataFrame) -> DataFrame:
        """Those of ``pairs(a, b, ...)`` that were not looked at."""
        return pairs.join(reduce(DataFrame.unionByName, [p.select("a", "b") for p in looked]), ["a", "b"], "left_anti")

    # Holders of a key that also agree in eight bits of the fingerprint, as most alike ones do in some, meet the first.
    for turn in range(ROUNDS):
        parts = [f"struct({b} AS byte, shiftrightunsigned(fp, {8 * b}) & 255 AS bits)" for b in range(turn * BYTES, turn * BYTES + BYTES)]
        apart = hooked(grouped, hooks).selectExpr("key", "node", "n", "at", "root", f"inline(array({', '.join(parts)}))")
        lead = F.min_by(F.struct(*[F.col(c).alias(f"{c}_b") for c in ("node", "n", "at", "root")]), "node")
        lead = apart.groupBy("key", "byte", "bits").agg(lead.alias("l")).select("key", "byte", "bits", "l.*")
        new = apart.join(lead, ["key", "byte", "bits"]).where(F.col("root") != F.col("root_b"))
        new = new.where(F.least(F.col("n") - F.col("at"), F.col("n_b") - F.col("at_b")) >= need("n", "n_b"))
        # The lead has the lesser number.
        new = new.select(F.col("node_b").alias("a"), F.col("node").alias("b"), F.col("root_b").alias("x"), F.col("root").alias("y"))
        new = put(unseen(new.distinct()), "new")
        if new.isEmpty():
            continue
        looked.append(new)
        more = verified(new.select("a", "b"), nodes, docs, doc_id, text, words, similarity, put)
        found.append(more)
        met = new.join(more, (F.col("a") == F.col("src")) & (F.col("b") == F.col("dst")), "left_semi")
        met = met.select(F.col("x").alias("root"), "y").unionByName(met.select(F.col("y").alias("root"), F.col("x").alias("y")))
        hook = met.groupBy("root").agg(F.min("y").alias("low")).where("low < root")
        hooks.append(put(hook, "hook"))
    apart = put(in_several(hooked(grouped, hooks)), "apart")
    small = apart.select("key", *[F.col(c).alias(f"{c}_a") for c in ("node", "n", "at", "root")])
    large = apart.select("key", *[F.col(c).alias(f"{c}_b") for c in ("node", "n", "at", "root")])
    room = F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b")) >= need("n_a", "n_b")
    ordered = (F.col("n_a") < F.col("n_b")) | ((F.col("n_a") == F.col("n_b")) & (F.col("node_a") < F.col("node_b")))
    rest = small.join(large, "key").where((F.col("root_a") != F.col("root_b")) & ordered & room)
    rest = rest.select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")).distinct()
    rest = put(unseen(rest), "rest")
    if not rest.isEmpty():
        found.append(verified(rest, nodes, docs, doc_id, text, words, similarity, put))
    if any(not more.isEmpty() for more in found[1:]):
        roots = components(reduce(DataFrame.unionByName, found), put)
    roots = roots.withColumnRenamed("root", "group")
    return table.join(roots, "node", "left").select("doc_id", "text_hash", F.coalesce("group", "node").alias("root"))


def without_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each group of ``near_copies``: the one of the smallest id (null last), then text hash.

    Rows repeating both leave one. All columns stay.
    """
    with scratch(docs.sparkSession, "near") as put:
        groups = near_copies(docs, docs[doc_id], F.coalesce(docs[text].cast("string"), F.lit("")), put=put)
        groups = materialize(groups, "groups")
    rank = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_hash")
    kept = groups.groupBy("root").agg(F.min(rank).alias("kept")).select("kept.doc_id", "kept.text_hash")
    kept = materialize(kept, "kept")
    rows = docs.join(kept, same_document(docs, kept, text), "left_semi").select(*columns_of(docs))
    if rows_repeat(groups):
        rows = rows.dropDuplicates([doc_id, text])
    return rows


def rows_repeat(groups: DataFrame) -> bool:
    """Whether any row has another's id and text."""
    return not groups.groupBy("doc_id", "text_hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()
