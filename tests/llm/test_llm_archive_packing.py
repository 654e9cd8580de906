"""WARC archive and packing: exact round trips."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from llm_tables import HARD, docs
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from headwater.llm import packing, warc
from headwater.llm.common import text_of
from headwater.llm.queries import word_tokenizer

PAGES = "page_id bigint, url string, html string, digest string, payload string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash") for r in rows], PAGES).repartition(3)


def archived(df):
    return warc.write_archive(df, df["page_id"], df["url"], df["html"])


@pytest.mark.parametrize("hot", [None, 0, 2])
def test_records_come_back_byte_for_byte(spark, monkeypatch, hot):
    big, small = "ä" * 60, "b" * 99
    rows = [
        (5, "http://a.example/", big), (3, "http://b.example/\r\nX: y", big), (9, None, big), (3, "http://b2.example/", big),
        (None, "http://c.example/", big), (1, "u", small), (2, "u", small), (4, "u" * 9000, None), (6, "u", ""),
        (None, "only", "n" * 200), (None, "only", "n" * 200), (7, "z", "\r\n\r\nWARC/1.1\r\nWARC-Type: x\r\n" * 10),
        (8, "http://d.example/WARC-Type: revisit", "like a header " * 20), (11, "WARC/1.1\r\nWARC-Type: revisit\r\n", "another " * 20),
        (12, "http://e.example/\r\nWARC-Type: revisit\r\nX: y", "a third " * 20),
    ]
    if hot is not None:
        monkeypatch.setattr(warc, "HOT", hot)
    archive = archived(pages(spark, rows))
    assert archive.payloads.count() == len({h or "" for _, _, h in rows})
    records = warc.read_records(archive)
    got = [tuple(r) for r in warc.parse_records(records).collect()]
    want = []
    for page, _, html in rows:
        data = (html or "").encode()
        same = [p for p, _, h in rows if (h or "") == (html or "") and p is not None]
        first = min(same) if same else None
        revisit = len(data) >= 100 and page != first
        want.append((page, len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    assert sorted((g[:5] for g in got), key=repr) == sorted(want, key=repr)
    for r in records.collect():
        head, rest = r["record"].split(b"\r\n\r\n", 1)
        fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
        block = rest[: int(fields["Content-Length"])]
        assert rest[len(block) :] == b"\r\n\r\n"
        body = block.split(b"\r\n\r\n", 1)[1]
        assert body == (b"" if fields["WARC-Type"] == "revisit" else bytes(r["payload"]))
        assert fields["WARC-Payload-Digest"] == "sha256:" + hashlib.sha256(bytes(r["payload"])).hexdigest()


def test_a_changed_payload_fails(spark):
    archive = archived(pages(spark, [(1, "u", "x" * 300)]))
    bad = warc.Archive(archive.headers, archive.payloads.withColumn("payload", F.lit(b"y" * 300)))
    with pytest.raises(Exception, match="differs from its digest"):
        warc.read_records(bad).collect()
    gone = warc.Archive(archive.headers, archive.payloads.where("false"))
    with pytest.raises(Exception, match="missing"):
        warc.read_records(gone).collect()


def test_payloads_meet_their_headers_without_a_shuffle(spark):
    df = pages(spark, [(n, "u", f"{n % 7} " * 200) for n in range(50)])
    archive = archived(df)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = warc.read_records(archive)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in plan and "Exchange" not in plan


def test_an_archive_is_opened_by_its_path(spark, tmp_path):
    df = pages(spark, [(n, "u", f"{n % 7} " * 200) for n in range(50)])
    made = warc.write_archive(df, df["page_id"], df["url"], df["html"], path=str(tmp_path / "archive"))
    again = warc.open_archive(spark, str(tmp_path / "archive"))
    for a, b in ((made.headers, again.headers), (made.payloads, again.payloads)):
        assert a.columns == b.columns and sorted(map(repr, a.collect())) == sorted(map(repr, b.collect()))


def test_empty_archive(spark):
    assert warc.parse_records(warc.read_records(archived(pages(spark, [])))).count() == 0


def test_word_encoder_equals_the_tokenizer():
    encoder = packing.WordEncoder(word_tokenizer(), limit=50)
    rng = random.Random(2)
    signs = list("aAbB zZéÉßµª²½ ñÑ'’\"-_.,!?\t\n\x0b\x1c\x1f\x85\xa0ΣςİıſŒœ가́😀<|>0189 ") + ["'s", "'LL", "<|endoftext|>", "\r\n", "  "]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 60))) for _ in range(3000)] + [t or "" for _, t, *_ in HARD]
    texts += ["<|endoftext|> x", "a<|endoftext|>b <|startoftext|>", "<|ENDOFTEXT|>", "ß <|endoftext|>\n가<|endoftext|>", "<|endoftext|"]
    whole = [e.ids for e in Tokenizer.from_file(word_tokenizer()).encode_batch(texts, add_special_tokens=False)]
    assert [49407] == [i for i in whole[-5] if i > 49405]
    for text, ids in zip(texts, whole):
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == ids, text


@pytest.mark.parametrize("seed", range(6))
def test_pools_fill_sequences_without_padding(seed):
    rng = random.Random(seed)
    capacity = rng.choice([4, 64, 2048])
    lengths = [rng.randint(1, rng.choice([3, capacity, 5 * capacity])) for _ in range(rng.choice([0, 1, 7, 500]))]
    used, held = defaultdict(list), defaultdict(list)
    for doc, start, n, sequence, offset in packing.pack_pool(lengths, capacity, 1.0, 0.01):
        used[sequence].append((offset, n))
        held[doc].append((start, n))
    for places, sizes in ((used, None), (held, lengths)):
        for key, parts in places.items():
            at = 0
            for start, n in sorted(parts):
                assert start == at and n > 0
                at += n
            assert at == sizes[key] if sizes else at == capacity or at & (at - 1) == 0 and at < capacity
    assert len(held) == len(lengths)


def test_whole_documents_keep_costs_close():
    rng = random.Random(4)
    pieces = list(packing.pack_pool([rng.randint(20, 900) for _ in range(4000)], 2048, 1.0, 1 / 1024))
    cost = defaultdict(float)
    for _, _, n, sequence, _ in pieces:
        cost[sequence] += packing.cost(n, 1.0, 1 / 1024)
    full = sorted(cost.values())[12:]
    assert max(full) < 1.35 * (sum(full) / len(full))


def test_pieces_hold_every_token_once(spark):
    df = docs(spark)
    got = packing.pack_documents(df, df["doc_id"], text_of(df), word_tokenizer, pool_tokens=3000).collect()
    tokenizer = Tokenizer.from_file(word_tokenizer())
    want = defaultdict(int)
    for i, t, *_ in HARD:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        want[(i, len(ids))] += 1
        parts = [r for r in got if (r.doc_id, r.doc_tokens) == (i, len(ids))]
        for r in parts:
            data = np.array(ids[r.start : r.start + r.length], dtype="<u4").tobytes()
            assert zlib.crc32(data) == r.ids_crc32
    for (i, n), copies in want.items():
        assert sum(r.length for r in got if (r.doc_id, r.doc_tokens) == (i, n)) == n * copies
    used = defaultdict(list)
    for r in got:
        used[r.sequence_id].append((r.offset, r.length))
    for parts in used.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 2048
    empty = docs(spark, [])
    assert packing.pack_documents(empty, empty["doc_id"], text_of(empty), word_tokenizer).count() == 0
