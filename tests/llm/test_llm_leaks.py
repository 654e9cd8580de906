"""Decontamination: the walk against exhaustive scoring, the search against looking for the words."""

from __future__ import annotations

import random

from llm_tables import docs

from headwater.llm import decontam as d
from headwater.llm.common import text_of


def words(rng, n, vocabulary=60):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def test_wand_returns_all_at_or_above_the_threshold():
    rng = random.Random(3)
    index = d.build_index([(i, " ".join(words(rng, rng.randint(2, 90), 12))) for i in range(120)])
    for threshold in (0.05, 0.1, 0.3):
        for _ in range(60):
            terms = sorted(rng.sample(range(len(index.keys)), rng.randint(1, 40)))
            full = {}
            for t in terms:
                for n, w in zip(*index.postings[t]):
                    full[n] = full.get(n, 0.0) + w
            got = d.block_max_wand(index, terms, threshold)
            assert [n for n, _ in got] == sorted(n for n, s in full.items() if s >= threshold - 1e-9)
            assert all(abs(s - full[n]) < 1e-9 for n, s in got)


def test_every_contained_item_is_found_and_no_other(spark):
    rng = random.Random(5)
    items = [(i, " ".join(words(rng, rng.randint(6, 130), 4000)) + ".") for i in range(60)]
    rows, want = [], set()
    for i in range(400):
        text = words(rng, rng.randint(0, 400), 4000)
        if i % 4 == 0:
            n = rng.randrange(60)
            at = rng.randint(0, len(text))
            text[at:at] = items[n][1].upper().split()
            want.add((i, n))
        elif i % 4 == 1:  # a short piece of an item is no leak
            piece = items[rng.randrange(60)][1].split()
            text[0:0] = piece[: max(1, len(piece) // 5)]
        rows.append((i, " ".join(text), "en", "s"))
    df = docs(spark, rows)
    found = d.find_leaks(df, df["doc_id"], text_of(df), spark.createDataFrame(items, "item_id bigint, text string"))
    assert {(r[0], r[1]) for r in found.collect()} == want
    kept = d.without_leaks(df, spark.createDataFrame(items, "item_id bigint, text string"))
    assert kept.columns == df.columns
    assert {r[0] for r in kept.select("doc_id").collect()} == {i for i in range(400)} - {i for i, _ in want}


def test_more_items_than_an_index_holds(spark, monkeypatch):
    rng = random.Random(6)
    items = [(i, " ".join(words(rng, 30, 4000))) for i in range(40)]
    df = docs(spark, [(i, "before it " + t + " after it", "en", "s") for i, t in items])
    monkeypatch.setattr(d, "INDEX_CHARS", 1500)
    found = d.find_leaks(df, df["doc_id"], text_of(df), spark.createDataFrame(items, "item_id bigint, text string"))
    assert {(r[0], r[1]) for r in found.collect()} == {(i, i) for i in range(40)}


def test_items_of_one_word_and_of_scripts_without_spaces(spark):
    asked = "東京は日本の首都ですか。はい、東京は日本の首都です。"
    items = [(1, "Photosynthesis!"), (2, asked), (3, "?!"), (4, "เมืองหลวงของประเทศไทยคือกรุงเทพ"), (5, "alpha beta")]
    rows = [
        (1, "all of photosynthesis, in short", "en", "s"), (2, "photosyntheses differ", "en", "s"), (3, "前文。" + asked + "後文", "ja", "s"),
        (4, "日本の料理はとても美味しいと思います。", "ja", "s"), (5, "PHOTOSYNTHESIS", "en", "s"), (6, "ก เมืองหลวงของประเทศไทยคือกรุงเทพ ข", "th", "s"),
        (7, "?!", "en", "s"), (8, "beta alpha", "en", "s"), (9, "word " * 500 + "photosynthesis " + "word " * 500, "en", "s"), (10, "", "en", "s"),
    ]
    df = docs(spark, rows)
    found = d.find_leaks(df, df["doc_id"], text_of(df), spark.createDataFrame(items, "item_id bigint, text string"))
    assert {(r[0], r[1]) for r in found.collect()} == {(1, 1), (3, 2), (5, 1), (6, 4), (9, 1)}


def test_hard_tables(spark):
    df = docs(spark)
    none = spark.createDataFrame([], "item_id bigint, text string, score string")
    some = spark.createDataFrame(
        [(1, None, "x"), (2, "", "x"), (3, "one", "x"), (None, "The first document has a few words. And a second line.", "x")],
        none.schema,
    )
    assert d.find_leaks(df, df["doc_id"], text_of(df), none).count() == 0
    got = d.find_leaks(df, df["doc_id"], text_of(df), some).collect()
    # Document 9 holds the item of one word.
    assert sorted((r[0], r[1]) for r in got if r[1]) == [(9, 3)] and sorted(r[0] for r in got if r[1] is None) == [1, 10, 10]
    assert d.without_leaks(df, none).count() == df.count()
    assert d.without_leaks(df, some).count() == df.count() - 4
    empty = docs(spark, [])
    assert d.find_leaks(empty, empty["doc_id"], text_of(empty), some).count() == 0
