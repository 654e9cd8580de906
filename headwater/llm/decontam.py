"""Benchmark decontamination: a BM25 index of test items, asked with every passage of the training texts.

Terms are pairs of neighbouring words, so that unrelated prose shares few with an item; an item of one word has that
word as its term. In scripts without spaces, each character is a word. Items are cut into parts, and the
texts into passages twice as long that overlap by half: wherever a part lies in a text, some passage holds all of it.
The index stands on the passage's side as the query, and scores are divided by the part's score against itself. Block-max
WAND walks the posting lists in part order and skips every part whose bound, from the best weight of each term in its
block, cannot reach the threshold; what it returns are all parts at or above it.
"""

from __future__ import annotations

import heapq
import math
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from headwater.llm.common import columns_of, map_texts, text_of
from headwater.storage import materialize

#: Words of a part of an item, and of a passage.
PART = 32
PASSAGE = 2 * PART
#: Parts of which one weight bound is kept per term.
BLOCK = 16
K1, B = 1.2, 0.75
#: A part is retrieved at this share of its score against itself.
THRESHOLD = 0.5
#: An item leaks if this share of its question's and of its answer's runs of words is in the text.
OVERLAP, RUN = 0.6, 5
#: Characters of items in one index, which goes to every task. More items make more indexes, asked one after the other.
INDEX_CHARS = 4_000_000

HITS = "doc_id bigint, item_id bigint, score double, question_overlap double, answer_overlap double"


# Blocks of scripts written without spaces (Thai to Myanmar, Khmer, kana, Han).
_UNSPACED = "\u0e00-\u0fff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
_WORD = re.compile(rf"[^\W{_UNSPACED}]+|(?=\w)[{_UNSPACED}]")


def words_of(text: str) -> list[str]:
    """Runs of word characters in lower case; of scripts without spaces, single characters."""
    return _WORD.findall(text.lower())


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    """An item's words before its last sentence, and those of it; a single sentence is all question."""
    cut = [w for w in (words_of(s) for s in re.split(r"(?<=[.!?])\s+|\n", text)) if w]
    return ([w for s in cut[:-1] for w in s], cut[-1]) if len(cut) > 1 else (cut[0] if cut else [], [])


@dataclass
class Index:
    """Posting lists of part numbers with weights, all as plain lists for a walk of few entries.

    ``vocabulary`` numbers the items' words; the key of a pair is ``first * len(vocabulary) + second``.
    """

    vocabulary: dict[str, int] = field(default_factory=dict)
    keys: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.int64))
    postings: list[tuple[list[int], list[float]]] = field(default_factory=list)
    #: Per term, the best weight in each block that it occurs in.
    blocks: list[dict[int, float]] = field(default_factory=list)
    best: list[float] = field(default_factory=list)
    item_of: list[int] = field(default_factory=list)
    sides: list[tuple[list[str], list[str]]] = field(default_factory=list)
    ids: list[int | None] = field(default_factory=list)


def build_index(items: list[tuple[int | None, str | None]]) -> Index:
    """Index ``(item_id, text)`` rows. A single word is paired with the empty one; items without words are left out."""
    index = Index()
    parts: list[list[int]] = []
    pairs_of: list[tuple[int, list[str]]] = []
    for item, text in items:
        words = words_of(text or "")
        if not words:
            continue
        if len(words) == 1:
            words.append("")
        index.ids.append(item)
        index.sides.append(question_and_answer(text or ""))
        starts = list(range(0, max(1, len(words) - PART // 2), PART))  # a short rest goes with the part before it
        for n, at in enumerate(starts):
            pairs_of.append((len(index.ids) - 1, words[at : at + PART + 1] if n + 1 < len(starts) else words[max(0, len(words) - PART) if n else 0 :]))
    for _, words in pairs_of:
        for w in words:
            index.vocabulary.setdefault(w, len(index.vocabulary))
    size = len(index.vocabulary)
    for number, words in pairs_of:
        ids = [index.vocabulary[w] for w in words]
        parts.append([a * size + b for a, b in zip(ids, ids[1:])])
        index.item_of.append(number)
    index.keys = np.unique(np.array([k for p in parts for k in p], dtype=np.int64))
    place = {k: n for n, k in enumerate(index.keys.tolist())}
    mean = sum(map(len, parts)) / max(1, len(parts))
    held: list[dict[int, int]] = [{} for _ in place]
    for n, p in enumerate(parts):
        for k in p:
            row = held[place[k]]
            row[n] = row.get(n, 0) + 1
    own = [0.0] * len(parts)
    weights: list[list[tuple[int, float]]] = []
    for row in held:
        idf = math.log(1 + (len(parts) - len(row) + 0.5) / (len(row) + 0.5))
        w = [(n, idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(parts[n]) / mean))) for n, tf in row.items()]
        for n, x in w:
            own[n] += x
        weights.append(w)
    for w in weights:
        w = [(n, x / own[n]) for n, x in sorted(w)]
        index.postings.append(([n for n, _ in w], [x for _, x in w]))
        bound: dict[int, float] = {}
        for n, x in w:
            bound[n // BLOCK] = max(bound.get(n // BLOCK, 0.0), x)
        index.blocks.append(bound)
        index.best.append(max(x for _, x in w))
    return index


def block_max_wand(index: Index, terms: list[int], threshold: float) -> list[tuple[int, float]]:
    """All ``(part, score)`` with a score of ``threshold`` or more for distinct ``terms``, in part order."""
    floor = threshold - 1e-9
    if sum(index.best[t] for t in terms) < floor:
        return []
    at = [0] * len(terms)
    lists = [index.postings[t][0] for t in terms]
    heap = [(lists[i][0], i) for i in range(len(terms))]
    heapq.heapify(heap)
    found = []
    while heap:
        # The pivot: the first part where the best weights of the lists up to it could reach the threshold.
        behind, bound = [], 0.0
        while heap and bound < floor:
            behind.append(heapq.heappop(heap))
            bound += index.best[terms[behind[-1][1]]]
        if bound < floor:
            break
        pivot = behind[-1][0]
        while heap and heap[0][0] == pivot:
            behind.append(heapq.heappop(heap))
        block = pivot // BLOCK
        if sum(index.blocks[terms[i]].get(block, 0.0) for _, i in behind) < floor:
            # No part of this block reaches it from these lists: on to its end, or to where another list begins.
            target = min((block + 1) * BLOCK, heap[0][0] if heap else (block + 1) * BLOCK)
        elif behind[0][0] == pivot:
            score = sum(index.postings[terms[i]][1][at[i]] for _, i in behind)
            if score >= floor:
                found.append((pivot, score))
            target = pivot + 1
        else:
            target = pivot
        for part, i in behind:
            if part < target:
                at[i] = bisect_left(lists[i], target, at[i])
            if at[i] < len(lists[i]):
                heapq.heappush(heap, (lists[i][at[i]], i))
    return found


def _runs(words: list[str], n: int) -> set[tuple[str, ...]]:
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}


def overlap(side: list[str], text: list[str]) -> float:
    """The share of a side's runs of ``RUN`` words (all its words, if fewer) that ``text`` holds; 1 for no words."""
    if not side:
        return 1.0
    n = min(RUN, len(side))
    runs = _runs(side, n)
    return len(runs & _runs(text, n)) / len(runs)


def search_text(index: Index, text: str, threshold: float = THRESHOLD) -> dict[int, tuple[float, int, int]]:
    """Best score and the retrieving passages' extent in words, per item number, over all passages of a text."""
    words = words_of(text)
    ids = np.fromiter(map(index.vocabulary.get, words, [-1] * len(words)), dtype=np.int64, count=len(words))
    pairs = np.where((ids[:-1] >= 0) & (ids[1:] >= 0), ids[:-1] * len(index.vocabulary) + ids[1:], -1)
    spot = np.flatnonzero(pairs >= 0)
    terms = pairs[spot]
    if "" in index.vocabulary:
        known = np.flatnonzero(ids >= 0)
        spot = np.concatenate([spot, known])
        terms = np.concatenate([terms, ids[known] * len(index.vocabulary) + index.vocabulary[""]])
    place = np.searchsorted(index.keys, terms)
    real = index.keys[np.minimum(place, len(index.keys) - 1)] == terms
    spot, place = spot[real], place[real]
    # A pair at word i is in the passages that begin at multiples of PART from i + 2 - PASSAGE to i.
    passages: dict[int, set[int]] = {}
    for i, t in zip(spot.tolist(), place.tolist()):
        for p in range(max(0, (i + 2 - PASSAGE + PART - 1) // PART), i // PART + 1):
            passages.setdefault(p, set()).add(t)
    out: dict[int, tuple[float, int, int]] = {}
    for p, terms in sorted(passages.items()):
        for part, score in block_max_wand(index, sorted(terms), threshold):
            n = index.item_of[part]
            best, a, b = out.get(n, (0.0, p * PART, 0))
            out[n] = (max(best, score), a, p * PART + PASSAGE)
    return out


def find_leaks(
    docs: DataFrame, doc_id: Column, text: Column, items: DataFrame, threshold: float = THRESHOLD, required: float = OVERLAP
) -> DataFrame:
    """``(doc_id, item_id, score, question_overlap, answer_overlap)`` for every row whose text holds an item.

    Every passage of every text is asked; the items it retrieves are verified on the words around the passages, where
    the shares of the question's and of the answer's word runs must both reach ``required``. The answer is an item's
    last sentence. Words are compared in lower case, without marks. An item of one word is in every text that holds
    the word, and an item without words in none.

    Items are dealt by a hash into indexes of about ``INDEX_CHARS`` characters, so a task holds one of bounded size
    however many items there are; each index is asked in a pass of its own. Null texts match nothing, repeated rows
    each give theirs, and no items or no texts give no rows.
    """
    items = items.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text"))
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    shards = max(1, math.ceil(total / INDEX_CHARS * 1.2))
    out = None
    for shard in range(shards):
        here = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(shards)) == shard).distinct()
        index = build_index([tuple(r) for r in here.orderBy("item_id", "text").collect()])
        if not index.item_of:
            continue
        shared = docs.sparkSession.sparkContext.broadcast(tuple(vars(index).values()))

        def rows(batches: Iterator[dict[str, list]], shared=shared) -> Iterator[dict[str, list]]:
            index = Index(*shared.value)
            for b in batches:
                hits: list[tuple] = []
                for doc, t in zip(b["doc_id"], b["text"]):
                    got = search_text(index, t or "", threshold)
                    words = words_of(t or "") if got else []
                    for n, (score, first, end) in got.items():
                        question, answer = index.sides[n]
                        reach = len(question) + len(answer)
                        near = words[max(0, first - reach) : end + reach]
                        q, a = overlap(question, near), overlap(answer, near)
                        if q >= required and a >= required:
                            hits.append((doc, index.ids[n], score, q, a))
                names = [x.split()[0] for x in HITS.split(", ")]
                yield {k: [h[i] for h in hits] for i, k in enumerate(names)}

        part = map_texts(docs, {"doc_id": doc_id, "text": text}, rows, HITS)
        out = part if out is None else out.union(part)
    return docs.sparkSession.createDataFrame([], HITS) if out is None else out


def without_leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs``, with all columns, whose text holds no item of ``items`` (``find_leaks``).

    Rows are told apart by a hash of their text, which decides the matter alone, so shared or null ids do no harm.
    """
    whole = text_of(docs, text)
    found = find_leaks(docs, F.xxhash64(whole), whole, items)
    leaks = materialize(found.select(F.col("doc_id").alias("text_hash")).distinct(), "leaks")
    return docs.join(leaks, F.xxhash64(whole) == leaks["text_hash"], "left_anti").select(*columns_of(docs))
