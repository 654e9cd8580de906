"""Collocations against counting every phrase; the graph's parts against what they say."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from llm_tables import HARD, docs, rows_of
from pyspark.sql import functions as F

from headwater.llm import collocations as c
from headwater.llm import slots

COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def expected(rows, least=10, within=50, top=2000):
    counts = defaultdict(Counter)
    for _, text, lang, _ in rows:
        text = re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\n-\r]", text):
            words = [w for w in re.split(r"[ \t]", piece) if w]
            for k in (1, 2, 3):
                for i in range(len(words) - k + 1):
                    counts["und" if lang is None else lang][tuple(words[i : i + k])] += 1
    out = []
    for lang, f in counts.items():
        scored = []
        for phrase, a in f.items():
            if len(phrase) == 1 or a < least:
                continue
            longer = [n for p, n in f.items() if n >= least and len(phrase) < len(p) and phrase in (p[:2], p[1:])]
            if any(100 * n >= within * a for n in longer):
                continue
            cuts = [(10**6 * a * a // (f[phrase[:k]] * f[phrase[k:]]), k) for k in range(1, len(phrase))]
            score, k = min(cuts)
            scored.append((-score, -a, " ".join(phrase).encode(), f[phrase[:k]], f[phrase[k:]]))
        total = sum(n for p, n in f.items() if len(p) == 1)
        for rank, (score, a, phrase, left, right) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, total, -score))
    return sorted(out, key=repr)


def found(spark, rows, **how):
    df = docs(spark, rows)
    return rows_of(c.collocations(df, df["lang"], df["text"], **how), *COLUMNS)


def made(rng, n, vocabulary, lengths):
    out = []
    for i in range(n):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(*lengths))]
        text = "".join(w + rng.choice([" ", " ", " ", "\t ", ". ", ",", "\n", "; "]) for w in words)
        out.append((i, text, rng.choice(["en", "en", "de", None, ""]), "s"))
    return out


@pytest.mark.parametrize("seed, size, how", [(1, 6, {}), (2, 12, {}), (3, 8, {"top": 7}), (4, 9, {"least": 4, "within": 80})])
def test_all_phrases_of_small_vocabularies(spark, seed, size, how):
    rng = random.Random(seed)
    vocabulary = [f"w{n}" for n in range(size)] + ["The", "THE", "é", "a\x1cb", "\x85", "한"]
    rows = made(rng, 150, vocabulary, (0, 60))
    want = expected(rows, **how)
    assert want and found(spark, rows, **how) == want


def test_passages_that_repeat_are_one_path(spark):
    rng = random.Random(6)
    passage = " ".join(f"p{n}" for n in range(200))
    tail = " ".join(f"p{n}" for n in range(150, 200))
    rows = made(rng, 60, [f"w{n}" for n in range(8)], (5, 40))
    rows += [(1000 + n, f"start{n} {passage} end{n}" if n % 2 else passage, "en", "s") for n in range(24)]
    rows += [(2000 + n, f"other {tail}", "en", "s") for n in range(11)]
    assert found(spark, rows) == expected(rows)
    df = docs(spark, rows)
    texts = df.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.col("text").cast("binary").alias("text"))
    grams = c.gram_counts(texts, 10).cache()
    edges = grams.where("size(split(phrase, ' ')) = 3 and n >= 10")
    lanes = {tuple(r["words"]): r for r in c.paths(edges, c.flows(grams, 2, 10)).where("lang = 'en'").collect()}
    whole = tuple(f"p{n}" for n in range(152))
    assert whole in lanes and lanes[whole]["n"] == 24 and lanes[whole]["n_first"] == 24  # up to where the tail joins
    assert tuple(f"p{n}" for n in range(150, 200)) in lanes and lanes[tuple(f"p{n}" for n in range(150, 200))]["n"] == 35
    windows = [w[i : i + 3] for w in lanes for i in range(len(w) - 2)]
    assert len(windows) == len(set(windows)) == edges.where("lang = 'en'").count()


def test_a_table_of_slots_too_small_for_the_corpus_changes_nothing(spark, monkeypatch):
    rng = random.Random(7)
    rows = made(rng, 200, [f"w{n}" for n in range(7)], (0, 50))
    want = expected(rows)
    monkeypatch.setattr(slots, "MOST_BITS", 3)
    monkeypatch.setattr(slots, "PARTS_BITS", 0)
    assert want and found(spark, rows) == want


def test_many_small_chunks_change_nothing(spark, monkeypatch):
    rng = random.Random(8)
    rows = made(rng, 60, [f"w{n}" for n in range(12)], (0, 300))
    rows.append((999, "one two three four " * 500, "en", "s"))  # a piece longer than a chunk
    want = expected(rows)
    monkeypatch.setattr(c, "CHUNK", 40)
    assert want and found(spark, rows) == want


def test_a_worker_holds_one_chunk_and_few_texts_at_a_time(spark, monkeypatch):
    """A chunk that has been counted is not kept while the next is read, and its phrases leave in small batches."""
    ran = []
    monkeypatch.setattr(c, "map_texts", lambda df, columns, rows, schema: ran.append(rows) or spark.createDataFrame([], schema))
    monkeypatch.setattr(c, "CHUNK", 50)
    monkeypatch.setattr(c, "PHRASES", 16, raising=False)
    made_words, held = [], c._Words

    class Watched(held):
        def __init__(self, lang):
            super().__init__(lang)
            made_words.append(self)

        def add(self, text):
            assert not any(w.lines for w in made_words if w is not self), "a chunk is held beside the next"
            return super().add(text)

    monkeypatch.setattr(c, "_Words", Watched)
    texts = docs(spark, [(1, " ".join(f"w{i % 40}" for i in range(400)), "en", "s")]).select(
        F.lit("en").alias("lang"), F.col("text").cast("binary").alias("text")
    )
    monkeypatch.setattr(c, "frequent_slots", lambda texts, bits, least: np.full(1 << max(0, bits - 3), 255, dtype=np.uint8))
    c.gram_counts(texts, 2)
    lines = [" ".join(f"w{i % 40}" for i in range(60)).encode() for _ in range(5)]
    out = list(ran[-1](iter([{"lang": ["en"] * 5, "text": lines}])))
    assert len(made_words) > 3
    assert max(len(b["phrase"]) for b in out) <= 16
    assert sum(n for b in out for n in b["n"]) == 300


def test_packed_slots():
    rng = np.random.default_rng(1)
    for size, most in ((0, 5), (1, 1), (300, 1000), (50, 10**6), (2000, 2100)):
        some = np.unique(rng.integers(0, most, size))
        assert slots.unpacked(slots.packed(some)).tolist() == some.tolist()


def test_scores_beyond_64_bits(spark):
    big = 3_000_000_000_000
    df = spark.createDataFrame([(big, big + 7, big + 9), (10, 10, 10), (1, 3, 5)], "a bigint, l bigint, r bigint")
    got = [r[0] for r in df.select(c._score(F.col("a"), F.col("l"), F.col("r"))).collect()]
    assert got == [10**6 * a * a // (x * y) for a, x, y in ((big, big + 7, big + 9), (10, 10, 10), (1, 3, 5))]


@pytest.mark.parametrize("rows", [HARD, HARD * 11, []])
def test_hard_tables(spark, rows):
    want = expected(rows)
    assert found(spark, rows) == want and bool(want) == bool(rows)
