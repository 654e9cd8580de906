"""Phrases whose words keep together, from a weighted de Bruijn graph of words.

Nodes are pairs of neighbouring words; an edge is three words in a row and joins the pairs that overlap in it. Only edges
are counted, and where a piece of text ends, what is shorter than an edge. A node's count is the flow out of it: its edges
and the pieces that end in it; a word's is that of its nodes and the pieces that end in it. Nodes with one way in and one
way out add nothing, so the edges around them become one path.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from headwater.llm import slots
from headwater.llm.common import map_texts
from headwater.storage import materialize

#: A phrase's least number of occurrences, and the share (in percent) of it in a longer one that drops it.
LEAST, WITHIN = 10, 50
#: Phrases returned for a language.
TOP = 2000
#: Words counted at a time, and different ones among them at most (they are numbered in 21 bits).
CHUNK, DIFFERENT = 600_000, 1 << 20
#: Phrases that are texts at the same time: the others of a chunk are numbers, and batches to and from a worker stay small.
PHRASES = 1 << 14
#: The table of slots has a bit for every so many bytes of text, as far as it may grow.
BYTES_A_SLOT = 4

# What ends a piece, and what ends a word.
_BREAKS, _BLANKS = b".,;:!?\n\x0b\x0c\r", b" \t"
_END = b"\xff"  # in no text
_CUT = bytes(0xFF if c in _BREAKS else 0x20 if c in _BLANKS else c for c in range(256))
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def words_of(text: bytes) -> list[bytes]:
    """The words of a text in UTF-8, A-Z as a-z, with ``_END`` after each piece."""
    return text.lower().translate(_CUT).replace(_END, b" \xff ").split() + [_END]


class _Words:
    """Words of one language, numbered as they come; 0 ends a piece."""

    def __init__(self, lang: str) -> None:
        self.seed = xxhash.xxh64_intdigest(lang.encode("utf-8", "replace"))
        self.number: defaultdict[bytes, int] = defaultdict()
        self.number.default_factory = self.number.__len__
        self.number[_END]
        self.lines: list[np.ndarray] = []

    def add(self, text: bytes) -> int:
        words = words_of(text)
        self.lines.append(np.fromiter(map(self.number.__getitem__, words), dtype=np.int64, count=len(words)))
        return len(words)

    def clear(self) -> None:
        """Counted: the next chunk is read while this object still has a name."""
        self.number.clear()
        self.lines.clear()

    def grams(self) -> np.ndarray:
        """Rows of a word and the two after it in its piece, 0 where there is none."""
        line = np.concatenate([*self.lines, np.zeros(2, dtype=np.int64)])
        first, second, third = line[:-2], line[1:-1], line[2:]
        third = np.where(second == 0, 0, third)
        at = np.flatnonzero(first)
        return np.stack([first[at], second[at], third[at]])

    def slots(self, grams: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """Slots of the first two words and of all three, by a hash of the words and the language."""
        hashes = np.array([xxhash.xxh64_intdigest(w, self.seed) for w in self.number], dtype=np.uint64)
        down = np.uint64(64 - bits)
        pair = hashes[grams[0]] * _MIX[0] + hashes[grams[1]]
        pair ^= pair >> np.uint64(29)
        pair *= _MIX[1]
        three = (pair ^ (pair >> np.uint64(32))) + hashes[grams[2]]
        three ^= three >> np.uint64(29)
        three *= _MIX[2]
        return (pair >> down).astype(np.int64), (three >> down).astype(np.int64)


def _chunks(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, _Words]]:
    """Texts by language, ``CHUNK`` words at a time or a little more."""
    held: dict[str, _Words] = {}
    waiting = 0
    for b in batches:
        for lang, text in zip(b["lang"], b["text"]):
            words = held.get(lang)
            if words is None:
                words = held[lang] = _Words(lang)
            for piece in _pieces(text or b""):
                waiting += words.add(piece)
                if waiting >= CHUNK or len(words.number) >= DIFFERENT:
                    yield held
                    held, waiting = {lang: _Words(lang)}, 0
                    words = held[lang]
    if held:
        yield held


def _pieces(text: bytes) -> Iterator[bytes]:
    """A very long text in parts, cut where a piece of it ends."""
    size = CHUNK * 4
    at = 0
    while len(text) - at > size:
        end = max(text.rfind(bytes([c]), at, at + size) for c in _BREAKS)
        if end < 0:  # one piece longer than that stays whole
            ends = [e for c in _BREAKS if (e := text.find(bytes([c]), at + size)) >= 0]
            end = min(ends, default=len(text) - 1)
        yield text[at : end + 1]
        at = end + 1
    yield text[at:]


def frequent_slots(texts: DataFrame, bits: int, least: int) -> np.ndarray:
    """One bit a slot: whether pairs and triples of words that fall into it occur ``least`` times or more, together.

    Phrases that share a slot only let each other pass.
    """

    def count(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        for held in _chunks(batches):
            found = []
            for words in held.values():
                grams = words.grams()
                pair, three = words.slots(grams, bits)
                found += [pair[grams[1] != 0], three[grams[2] != 0]]
                words.clear()
            yield slots.counted(np.concatenate(found), bits)

    counted = map_texts(texts, {"lang": texts["lang"], "text": texts["text"]}, count, slots.COUNTED)
    return slots.frequent(counted, bits, least)


def gram_counts(texts: DataFrame, least: int) -> DataFrame:
    """``(lang, phrase, n)``: every word's occurrence counted once, with the words after it as far as they matter.

    A phrase of three words is an edge; a shorter one counts occurrences that end a piece there, or that go on to an edge
    (or pair) rarer than ``least``. So a sum over all rows that begin with a phrase is its number of occurrences, if
    that is ``least`` or more.
    """
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = slots.bits_for(size / BYTES_A_SLOT)
    shared = texts.sparkSession.sparkContext.broadcast(frequent_slots(texts, bits, least))  # of bounded size

    def rows(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        frequent = shared.value

        for held in _chunks(batches):
            for lang, words in held.items():
                grams = words.grams()
                pair, three = words.slots(grams, bits)
                two = slots.passes(frequent, pair) & (grams[1] != 0)
                all_three = two & slots.passes(frequent, three) & (grams[2] != 0)
                keys = grams[0] << 42 | np.where(two, grams[1], 0) << 21 | np.where(all_three, grams[2], 0)
                del grams, pair, three, two, all_three
                keys, n = np.unique(keys, return_counts=True)
                names = [w.decode("utf-8", "replace") for w in words.number]
                for at in range(0, len(keys), PHRASES):
                    some = keys[at : at + PHRASES]
                    first, second, third = some >> 42, some >> 21 & (1 << 21) - 1, some & (1 << 21) - 1
                    phrases = [
                        f"{names[a]} {names[b]} {names[c]}" if c else f"{names[a]} {names[b]}" if b else names[a]
                        for a, b, c in zip(first.tolist(), second.tolist(), third.tolist())
                    ]
                    yield {"lang": [lang] * len(some), "phrase": phrases, "n": n[at : at + PHRASES].tolist()}
                words.clear()
                del keys, n, names

    each = map_texts(texts, {"lang": texts["lang"], "text": texts["text"]}, rows, "lang string, phrase string, n bigint")
    return each.groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


def _first(phrase: str, words: int) -> Column:
    return F.substring_index(phrase, " ", words)


def _last(phrase: str, words: int) -> Column:
    return F.substring_index(phrase, " ", -words)


def _length(phrase: str) -> Column:
    return F.length(phrase) - F.length(F.translate(phrase, " ", "")) + 1


def flows(grams: DataFrame, words: int, least: int) -> DataFrame:
    """``(lang, phrase, n)`` of the phrases of one or two words that occur ``least`` times or more: what flows out of them."""
    begun = grams.where(_length("phrase") >= words)
    summed = begun.groupBy("lang", _first("phrase", words).alias("phrase")).agg(F.sum("n").alias("n"))
    return summed.where(F.col("n") >= least)


def paths(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(lang, words, n, n_first, n_last)``: the edges, compacted along nodes with one way in and one way out.

    All that comes through such a node comes by one edge and leaves by one, so both have the node's count; no piece begins
    or ends there. A path's weight ``n`` is that of each of its edges and inner nodes; ``n_first`` and ``n_last`` are the
    counts of the nodes at its ends. A path is no longer than the pieces it comes from, and lies in no circle, as some
    piece begins it. Places in a path are found by doubling, in rounds logarithmic in the longest path.
    """
    count_of = lambda name: nodes.select("lang", F.col("phrase").alias(name), F.col("n").alias(f"n_{name}"))
    ends = edges.withColumn("tail", _first("phrase", 2)).withColumn("head", _last("phrase", 2))
    known = ends.join(count_of("tail"), ["lang", "tail"]).join(count_of("head"), ["lang", "head"])
    known = materialize(known.withColumn("id", F.monotonically_increasing_id()), "edges")
    comes = known.where("n = n_head").select("lang", F.col("head").alias("node"), F.col("id").alias("back"))
    goes = known.where("n = n_tail").select("lang", F.col("tail").alias("node"), "id")
    jumps = materialize(comes.join(goes, ["lang", "node"]).select("id", "back", F.lit(1).cast("bigint").alias("place")), "jumps")
    # Each round, an edge's jump goes on from where that edge's own jump leads.
    while True:
        beyond = jumps.select(F.col("id").alias("back"), F.col("back").alias("further"), F.col("place").alias("more"))
        longer = jumps.join(beyond, "back", "left")
        jumps = materialize(
            longer.select(
                "id",
                F.coalesce("further", "back").alias("back"),
                (F.col("place") + F.coalesce("more", F.lit(0))).alias("place"),
                F.col("further").isNotNull().alias("moved"),
            ),
            "jumps",
        )
        if jumps.where("moved").isEmpty():
            break
        jumps = jumps.drop("moved")
    placed = known.join(jumps.select("id", "back", "place"), "id", "left")
    step = F.struct(
        F.coalesce("place", F.lit(0)).alias("place"), F.col("phrase"), F.col("n_tail"), F.col("n_head"), F.col("n")
    )
    grouped = placed.groupBy("lang", F.coalesce("back", "id").alias("start")).agg(F.array_sort(F.collect_list(step)).alias("steps"))
    words = F.concat(
        F.split(F.col("steps")[0]["phrase"], " "),
        F.transform(F.slice("steps", 2, F.greatest(F.size("steps") - 1, F.lit(0))), lambda s: F.substring_index(s["phrase"], " ", -1)),
    )
    return grouped.select(
        "lang",
        words.alias("words"),
        F.col("steps")[0]["n"].alias("n"),
        F.col("steps")[0]["n_tail"].alias("n_first"),
        F.element_at("steps", -1)["n_head"].alias("n_last"),
    )


def _score(a: Column, left: Column, right: Column) -> Column:
    """``floor(1000000 a a / (l r))`` in whole numbers of up to 38 digits."""
    whole = lambda c: c.cast("decimal(18,0)")
    return F.call_function("div", F.lit(1_000_000).cast("decimal(7,0)") * (whole(a) * whole(a)), whole(left) * whole(right))


def collocations(
    docs: DataFrame, lang: Column, text: Column, least: int = LEAST, within: int = WITHIN, top: int = TOP
) -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: the phrases of two or three words that keep together best.

    Texts are cut into pieces and words, A-Z as a-z, for each ``lang`` (null: ``und``). A phrase has ``a`` occurrences,
    ``least`` or more. Cut in two, with ``l`` and ``r`` occurrences of the parts, it scores ``floor(10^6 a a / (l r))``; its
    worst cut counts, the first of equal ones. ``n`` is the number of words of the language. A phrase of which
    ``within`` percent or more lie in one longer phrase is left out. The first ``top`` of a language return, ranked by
    score, then ``a``, then phrase.

    All texts and all occurrences are counted; repeated rows count each time. Null and empty texts have no words; no rows
    give no rows. Only counts travel, reduced where the texts are. A table of slots of bounded size, broadcast, tells
    which phrases may be frequent; where it is too small for a corpus, more phrases pass it and are counted.
    """
    texts = docs.select(
        F.coalesce(lang.cast("string"), F.lit("und")).alias("lang"),
        F.coalesce(text.cast("string"), F.lit("")).cast("binary").alias("text"),
    )
    grams = materialize(gram_counts(texts, least), "grams")
    nodes = materialize(flows(grams, 2, least), "nodes")
    single = materialize(flows(grams, 1, least), "words")
    totals = grams.groupBy("lang").agg(F.sum("n").alias("total"))
    edges = grams.where((_length("phrase") == 3) & (F.col("n") >= least))
    path = materialize(paths(edges, nodes), "paths")

    at = F.col("at")
    three = path.select(
        "lang", "words", "n", "n_first", "n_last", F.explode(F.sequence(F.lit(1), F.size("words") - 2)).alias("at")
    ).select(
        "lang",
        F.array_join(F.slice("words", at, 3), " ").alias("phrase"),
        F.col("n").alias("a"),
        F.when(at == 1, F.col("n_first")).otherwise(F.col("n")).alias("n_tail"),
        F.when(at == F.size("words") - 2, F.col("n_last")).otherwise(F.col("n")).alias("n_head"),
        (at == 1).alias("begins"),
        (at == F.size("words") - 2).alias("ends"),
    )
    three = materialize(three, "threes")
    # Pairs inside a path lie in its triples always. Others may, by the triples at the paths' ends.
    cover = (
        three.where("begins").select("lang", _first("phrase", 2).alias("phrase"), "a")
        .unionByName(three.where("ends").select("lang", _last("phrase", 2).alias("phrase"), "a"))
        .groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    )
    inner = three.where("not ends").select("lang", _last("phrase", 2).alias("phrase"))
    two = nodes.join(inner, ["lang", "phrase"], "left_anti").join(cover, ["lang", "phrase"], "left")
    two = two.where(F.coalesce(100 * F.col("longer") < within * F.col("n"), F.lit(True)))
    candidates = three.select("lang", "phrase", "a", "n_tail", "n_head").unionByName(
        two.select("lang", "phrase", F.col("n").alias("a"), *[F.lit(None).cast("bigint").alias(c) for c in ("n_tail", "n_head")])
    )
    word = lambda name: single.select("lang", F.col("phrase").alias(name), F.col("n").alias(f"n_{name}"))
    joined = (
        candidates.withColumn("first", _first("phrase", 1)).withColumn("last", _last("phrase", 1))
        .join(word("first"), ["lang", "first"]).join(word("last"), ["lang", "last"])
    )

    def cut(k: int, left: Column, right: Column) -> Column:
        return F.struct(_score(F.col("a"), left, right).alias("score"), F.lit(k).alias("k"), left.alias("l"), right.alias("r"))

    first, last = F.col("n_first"), F.col("n_last")
    of_three = F.least(cut(1, first, F.col("n_head")), cut(2, F.col("n_tail"), last))
    scored = joined.select(
        "lang", "phrase", "a", F.when(F.col("n_tail").isNull(), cut(1, first, last)).otherwise(of_three).alias("cut")
    ).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")

    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # A language may hold most phrases: each part of it gives its first ones before they are ranked together.
    scored = scored.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    of_part = F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))
    near = scored.withColumn("rank", of_part).where(F.col("rank") <= top).drop("rank", "part")
    of_lang = F.row_number().over(Window.partitionBy("lang").orderBy(*order))
    best = near.withColumn("rank", of_lang.cast("bigint")).where(F.col("rank") <= top)
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", F.col("total").alias("n"), "score")
