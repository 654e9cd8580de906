"""Prefix counts against the library's own count of every prefix."""

from __future__ import annotations

import random

import public_tokenizers
import pytest
from llm_tables import HARD, docs, rows_of
from tokenizers import Tokenizer

from headwater.llm import prefixcounts as p

PATH = public_tokenizers.path("byte_bpe_50k.json")
SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(PATH)
    return lambda text: len(tokenizer.encode(text, add_special_tokens=False).ids)


PARTS = [
    "a", "e", "th", "ing", "'ll", "'l", "'re", "'s", "'", " ", "  ", "   ", "\n", "\n\n", "\t", "1", "23", "!", "==", "====",
    "é", "ß", "한", "😀", "<|endoftext|>", "<|endof", "|>", "́", "\x1c", "\x85", "\xa0", "　", "՘", "\U00016ea0",
    "The", "of", " in", "aaaa", "zzzz", " ", "\x00",
]


def test_every_prefix_has_the_count_of_its_own_encoding(library):
    rng, counter = random.Random(1), p.PrefixCounter(PATH)
    for _ in range(1500):
        text = "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 14)))
        assert counter.counts(text).tolist() == [library(text[:k]) for k in range(1, len(text) + 1)], repr(text)


def test_long_words(library):
    rng, counter = random.Random(2), p.PrefixCounter(PATH)
    for text in ("a" * 300, "=" * 5000, "".join(rng.choice("abcdefgh") for _ in range(6000)), " " * 700 + "x", "é" * 200):
        counts = counter.counts(text)
        for k in (1, 2, 3, 64, 65, 127, 199, len(text) - 1, len(text)):
            assert counts[k - 1] == library(text[:k])


def test_memory_that_is_full_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(p, "MEMORY", 5)
    rng, counter = random.Random(3), p.PrefixCounter(PATH)
    for _ in range(50):
        text = " ".join("".join(rng.choice("abcdest") for _ in range(rng.randint(1, 9))) for _ in range(30))
        assert counter.counts(text)[-1] == library(text)
        assert len(counter._counts) <= 5 and len(counter._counts.before) <= 5


def test_stored_counts_answer_for_every_budget_and_place(spark, library):
    texts = ["one two three, four!", "", "a  b\n\n\nc", "x" * 400, "don't we'll <|endoftext|> é한"]
    df = docs(spark, [(n, t, "en", "s") for n, t in enumerate(texts)])
    stored = p.prefix_counts(df, df["doc_id"], df["text"], lambda: PATH).cache()
    for limit in (0, 1, 3, 7, 1000):
        want = [max([k for k in range(len(t) + 1) if library(t[:k]) <= limit]) for t in texts]
        assert [n for _, n in rows_of(p.truncated(stored, limit), "doc_id", "n_chars")] == want
    for chars in (0, 1, 5, 9, 1000):
        assert [n for _, n in rows_of(p.tokens_before(stored, chars), "doc_id", "n_tokens")] == [library(t[:chars]) for t in texts]


def test_steps_of_any_width():
    import numpy as np

    for values in ([], [1, 2, 2, 1], [1, 300, 2], [100_000, 1], [1, 2**40]):
        assert p.counts_of(p.packed_steps(np.array(values, dtype=np.int64))).tolist() == values


def test_query_over_the_whole_table(spark, library):
    from headwater.llm.queries import QUERIES

    rows = {r["doc_id"]: r for r in QUERIES["op11_token_counts"](spark, SF).collect()}
    table = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(rows) == len(table)
    for d in table:
        r, text = rows[d["doc_id"]], d["text"] or ""
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(text.encode()), library(text), library(text) > 1024)
        cut = text[: r["chars_in_limit"]]
        assert library(cut) <= 1024 and (cut == text or library(text[: len(cut) + 1]) > 1024)


@pytest.mark.parametrize("rows", [HARD, []])
def test_hard_tables(spark, library, rows):
    df = docs(spark, rows)
    got = rows_of(p.count_tokens(df, df["doc_id"], df["text"], PATH), "doc_id", "n_bytes", "n_tokens", "over_limit")
    sized = [(i, len((t or "").encode()), library(t or "")) for i, t, _, _ in rows]
    assert got == sorted(((i, b, n, n > 1024) for i, b, n in sized), key=repr)


def test_other_kinds_of_tokenizer_are_refused():
    with pytest.raises(ValueError):
        p.PrefixCounter(public_tokenizers.path("word_bpe_49k.json"))
