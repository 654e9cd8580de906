"""Pseudo-likelihood and the compression classifier."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
from llm_tables import HARD, docs

from headwater.llm import pseudolikelihood as pll
from headwater.llm import quality
from headwater.llm.common import text_of


def test_gradient_is_that_of_the_loss():
    rng = np.random.default_rng(0)
    flat = pll.initial().astype(np.float64)
    context, target = rng.integers(0, pll.CLASSES + 1, (60, 2 * pll.REACH)), rng.integers(0, pll.CLASSES, 60)
    g = np.zeros_like(flat)
    pll.log_chances(flat, context, target, g)
    for k in [*np.argsort(-abs(g))[:5], len(flat) - 1, (pll.CLASSES + 1) * pll.VECTOR + 3]:
        up, down = flat.copy(), flat.copy()
        up[k] += 1e-5
        down[k] -= 1e-5
        slope = (pll.log_chances(up, context, target).mean() - pll.log_chances(down, context, target).mean()) / 2e-5
        assert abs(g[k] + slope) < 1e-6


def test_chances_sum_to_one():
    context = np.random.default_rng(1).integers(0, pll.CLASSES, (1, 2 * pll.REACH))
    every = np.arange(pll.CLASSES)
    total = np.exp(pll.log_chances(pll.initial(), np.repeat(context, pll.CLASSES, 0), every)).sum()
    assert abs(total - 1) < 1e-3


def test_scores_of_hard_tables_and_against_a_direct_sum(spark):
    df = docs(spark)
    model = pll.fit_windows(df, df["doc_id"], text_of(df))
    got = pll.score_documents(df, df["doc_id"], text_of(df), model).collect()
    assert len(got) == len(HARD)

    def direct(text):
        ids = pll.classes_of(text or "", model.words).astype(np.int64)
        if not len(ids):
            return 0.0
        return float(pll.log_chances(model.parameters, pll._contexts(ids, np.arange(len(ids))), ids).astype(float).sum())

    want = sorted((i is None, i or 0, len((t or "").split()), round(direct(t), 1)) for i, t, *_ in HARD)
    assert [w[:3] for w in want] == sorted((r[0] is None, r[0] or 0, r[1]) for r in got)
    for w, r in zip(want, sorted(got, key=lambda r: (r[0] is None, r[0] or 0, r[1]))):
        assert abs(w[3] - r[2]) <= 0.1 + 1e-4 * abs(w[3])
        assert (r[3] is None) == (r[1] == 0)


def test_every_word_is_a_target_once_over_the_rounds():
    gap = np.full(pll.REACH, pll.CLASSES)
    for sizes in ([], [1], [3, 0, 15, 1], [40_000, 2]):
        texts = [np.random.default_rng(n).integers(0, pll.CLASSES, n) for n in sizes]
        line = np.concatenate([gap, *[x for t in texts for x in (t, gap)]]).astype("<i2")
        for rounds in (1, 3, 8):
            rows = [r.tolist() for turn in range(rounds) for w in pll.masked(line, turn, rounds) for r in w]
            want = [[t[i], *c] for t in texts for i, c in enumerate(pll._contexts(t, np.arange(len(t))).tolist())]
            assert sorted(rows) == sorted(want)


@pytest.mark.parametrize("known", [None, 1, 0])
def test_words_of_a_class_have_their_own_chances(spark, monkeypatch, known):
    if known is not None:
        monkeypatch.setattr(pll, "KNOWN", known)  # all other counts are joined
    named = " ".join(f"n{i} n{i}\x1cn{i} n{i}" for i in range(pll.CLASSES - pll.BUCKETS))
    group = {}
    for w in (f"r{i}" for i in range(10_000)):
        group.setdefault(pll._key(w) % pll.BUCKETS, []).append(w)
    twice, once, never = group[5][:3]
    df = docs(spark, [(1, named, "en", "s"), (2, f"{twice} {once}", "en", "s"), (3, twice, "en", "s")])
    model = pll.fit_windows(df, df["doc_id"], text_of(df))
    test = docs(spark, [(1, twice, "en", "s"), (2, once, "en", "s"), (3, never, "en", "s"), (3, f"n1 {twice} {twice}", "en", "s")])
    got = [(r[1], r[2]) for r in pll.score_documents(test, test["doc_id"], text_of(test), model).orderBy("doc_id", "n_tokens").collect()]
    assert [n for n, _ in got] == [1, 1, 1, 3]
    ids = pll.classes_of(f"n1 {twice} {twice}", model.words).astype(np.int64)

    def direct(ids):
        return pll.log_chances(model.parameters, pll._contexts(ids, np.arange(len(ids))), ids).astype(float).sum()

    want = [direct(ids[1:2]) + np.log(n / 4) for n in (2, 1, 1)] + [direct(ids) + 2 * np.log(2 / 4)]
    assert np.allclose([x for _, x in got], want, atol=1e-4)


def test_scores_of_the_corpus_are_those_of_its_documents(spark, monkeypatch):
    rng = random.Random(3)
    df = docs(spark, [(i, " ".join(f"w{int(rng.paretovariate(0.5))}" for _ in range(rng.randint(0, 90))), "en", "s") for i in range(80)])
    monkeypatch.setattr(pll, "KNOWN", 40)
    model = pll.fit_windows(df, df["doc_id"], text_of(df), 2)
    apart = {r[0]: r for r in pll.score_documents(df, df["doc_id"], text_of(df), model).collect()}
    monkeypatch.setattr(pll, "KNOWN", 1 << 21)
    monkeypatch.setattr(pll, "MEMORY", 50)
    for r in pll.score_corpus(df, df["doc_id"], text_of(df), 2).collect():
        assert r[:2] == apart[r[0]][:2] and np.isclose(r[2], apart[r[0]][2], rtol=1e-3, atol=1e-3)


def test_empty_table_has_no_scores(spark):
    df = docs(spark, [])
    model = pll.fit_windows(df, df["doc_id"], text_of(df))
    assert pll.score_documents(df, df["doc_id"], text_of(df), model).count() == 0


def test_order_is_likelier_than_disorder(spark):
    rng = random.Random(0)
    line = "red dogs bark and grey cats sleep while old men sing".split()
    rows = [(i, " ".join(line * 20), "en", "s") for i in range(300)]
    df = docs(spark, rows)
    model = pll.fit_windows(df, df["doc_id"], text_of(df), rounds=8)
    mixed = line * 20
    rng.shuffle(mixed)
    test = docs(spark, [(1, " ".join(line * 20), "en", "s"), (2, " ".join(mixed), "en", "s")])
    score = {r[0]: r[3] for r in pll.score_documents(test, test["doc_id"], text_of(test), model).collect()}
    assert score[1] > score[2] + 0.5


def quality_rows(n):
    rng = random.Random(1)
    part = "the and of ing tion er re con ver al ous ment".split()

    def word():
        return "".join(rng.choice(part) for _ in range(rng.randint(1, 3)))

    rows, labels = [], []
    for i in range(n):
        words = [word() for _ in range(rng.randint(20, 120))]
        bad = i % 3 == 0
        rows.append((i, " ".join(w.upper() + "!!" if bad else w for w in words), "en", "s"))
        labels.append((i, 0 if bad else 1))
    return rows, labels


def test_quality_on_held_out_documents(spark):
    rows, labels = quality_rows(900)
    df = docs(spark, rows)
    held = {i for i, _ in labels if zlib.crc32(str(i).encode()) % 4 == 2}
    table = spark.createDataFrame([x for x in labels if x[0] not in held], "doc_id bigint, quality int")
    model = quality.fit_quality(df, df["doc_id"], text_of(df), table)
    got = {r[0]: r for r in quality.score_documents(df, df["doc_id"], text_of(df), model).collect()}
    assert len(got) == 900
    right = [got[i][2] == q for i, q in labels if i in held]
    assert sum(right) / len(right) > 0.97
    assert all(0 <= r[1] <= 1 and r[2] == int(r[1] >= quality.THRESHOLD) for r in got.values())
    kept = quality.keep_good(df, model)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r[2]}
    again = quality.fit_quality(df, df["doc_id"], text_of(df), table)
    assert again == model


def test_quality_of_hard_tables(spark):
    df = docs(spark)
    none = spark.createDataFrame([], "doc_id bigint, quality int, score string")
    for labels, want in ((none, 1.0), (none.union(spark.createDataFrame([(1, 0, "x"), (None, 1, "x"), (2, None, "x")], none.schema)), 0.0)):
        model = quality.fit_quality(df, df["doc_id"], text_of(df), labels)
        assert [r[1] for r in quality.score_documents(df, df["doc_id"], text_of(df), model).collect()] == [want] * len(HARD)
    rows, labels = quality_rows(60)
    model = quality.fit_quality(*(lambda d: (d, d["doc_id"], text_of(d)))(docs(spark, rows)), spark.createDataFrame(labels, "doc_id bigint, quality int"))
    assert quality.score_documents(df, df["doc_id"], text_of(df), model).count() == len(HARD)
    assert quality.keep_good(docs(spark, []), model).count() == 0
