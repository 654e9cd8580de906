"""Conversation repair against a search over all edits, on codes and on whole tables."""

from __future__ import annotations

import hashlib
import itertools
import random
import sys
import zlib
from functools import cache

import pytest
from llm_tables import rows_of

from headwater.llm import conversations as c

SF = "/root/testdata/sf0.01"
sys.setrecursionlimit(20_000)
COLUMNS = "conv_id bigint, turn bigint, role string, text string"


def cheapest(turns):
    """(cost, audit, output roles) over every edit sequence; turns are (initial, must go, truncated)."""

    @cache
    def best(i, out, inserts):
        """``out`` is what the roles so far end in: '', 's', 'u' or 'a'."""
        found = [(0, "", ())] if i == len(turns) and out in ("", "a") else []

        def then(cost, edit, role, rest):
            if rest is not None:
                found.append((cost + rest[0], edit + rest[1], ((role,) if role else ()) + rest[2]))

        follow = {"": "su", "s": "u", "u": "a", "a": "u"}[out]
        for role in follow:
            if role != "s" and inserts < 3:
                then(3, "I", role, best(i, role, inserts + 1))
        if i < len(turns):
            initial, goes, cut = turns[i]
            then(4, "D", None, best(i + 1, out, 0))
            for role in follow:
                if not goes and initial == role:
                    then(3 * cut, "K", role, best(i + 1, role, 0))
                elif not goes and role != "s":
                    then(3 + 3 * cut, "R", role, best(i + 1, role, 0))
        return min(found) if found else None

    return best(0, "", 0)


def code_of(turns):
    return bytes(("sua".index(i) if i in tuple("sua") else 3) + (4 if goes else 8 if cut else 0) for i, goes, cut in turns)


KINDS = [(i, goes, cut) for i in "suat" for goes, cut in ((False, False), (True, False), (False, True))]


def test_every_short_conversation():
    for n in range(4):
        for turns in itertools.product(KINDS, repeat=n):
            want = cheapest(turns)[:2]
            assert c.align(code_of(turns)) == want == c.by_states(code_of(turns)), turns


def test_longer_conversations():
    rng = random.Random(4)
    for k in range(400):
        regular = [("ua"[n % 2], False, False) for n in range(rng.randint(0, 40))]
        turns = [rng.choice(KINDS) if rng.random() < (0.2, 0.5, 1)[k % 3] else t for t in regular]
        want = cheapest(tuple(turns))[:2]
        assert c.align(code_of(turns), 10**9) == want == c.by_states(code_of(turns))


def test_a_long_conversation_is_aligned_by_states_to_the_same_end():
    rng = random.Random(5)
    code = code_of([rng.choice(KINDS) for _ in range(300)])
    assert c.align(code, cells=1000) == c.align(code, cells=10**9) == c.by_states(code)
    cost, audit = c.align(code_of([("s", False, False)] * 20_000))
    assert 3 * 19_999 <= cost <= 3 * 19_999 + 4 and audit.count("R") >= 19_998


def expected(table):
    """The query's rows, straight from its definition."""
    damaged = {}
    said = lambda v: " " if v is None else str(v)
    for conv, turn, role, text in table:
        rows = damaged.setdefault(conv, [])
        fault = zlib.crc32(f"{said(conv)}:{said(turn)}".encode()) % 20
        role, text = said(role), said(text)
        if fault == 0:
            continue
        text = "" if fault == 1 else "".join(x for x in text if x not in ".!?") if fault == 2 else text
        rows += [(turn, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)
    out = []
    for conv, rows in damaged.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
        turns, seen, counts = [], set(), {"blank": 0, "duplicate": 0, "truncated": 0}
        for _, role, text in rows:
            left = text.strip(" \t\n\x0b\x0c\r")
            fault = "blank" if not left else "duplicate" if (role, text) in seen else "truncated" if left[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                counts[fault] += 1
            turns.append((role[:1], fault in ("blank", "duplicate"), fault == "truncated"))
        numbers = {t for t, _, _ in rows if t is not None}
        cost, audit, roles = cheapest(tuple(turns))
        at, lines, left = 0, [], list(roles)
        for edit in audit:
            if edit == "I":
                lines.append({"u": "user", "a": "assistant"}[left.pop(0)] + ":")
                continue
            _, role, text = rows[at]
            at += 1
            if edit != "D":
                new = left.pop(0)
                lines.append((role if edit == "K" else {"u": "user", "a": "assistant"}[new]) + ":" + text)
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in itertools.pairwise(turns))
        out.append(
            (conv, max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0, *counts.values(), illegal, cost, audit,
             hashlib.sha256("\n".join(lines).encode()).hexdigest())
        )
    return sorted(out, key=repr)


NAMES = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def damaged(df):
    return c.damage(df, *[df[x] for x in ("conv_id", "turn", "role", "text")])


def test_query_over_the_whole_table(spark):
    from headwater.llm.queries import QUERIES

    table = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = QUERIES["op12_conversations"](spark, SF)
    assert rows_of(got, *NAMES) == expected(table)
    kept = got.toPandas()
    assert (kept[["blank", "duplicate", "truncated", "illegal", "gaps"]].sum() > 0).all() and set("".join(kept.audit)) == set("DIKR")


HARD = [
    (1, 0, "user", "Hi."), (1, 1, "assistant", "Yes!"), (1, 1, "assistant", "Yes!"), (1, 1, "assistant", "No."), (1, 7, None, None),
    (None, None, None, None), (None, None, "user", "a?"), (None, 3, "user", "a?"), (None, 2, "tool", " \t\x0b\x0c\r\n"),
    (2, None, "system", "x" * 100_000 + "."), (2, 0, "", "ü. \n"), (2, 0, "user", "ü . \x85"), (3, 5, "system", "Only."),
    (4, 0, "assistant", "one?"), (4, 4, "assistant", "two?"), (4, 5, "user", "two? "), (4, 6, "user", "two? "), (5, -3, "émile", "s."),
]


@pytest.mark.parametrize("rows", [HARD, HARD * 3, [(9, n, "user", "same.") for n in range(300)], []])
def test_hard_tables(spark, rows):
    df = spark.createDataFrame(rows, COLUMNS)
    for name in ("copies", "digest", "initial", "again", "head", "kind", "a.b"):
        df = df.selectExpr("*", f"'clash' `{name}`")
    df = df.repartition(5)
    assert rows_of(c.repair(damaged(df)), *NAMES) == expected(rows)


def test_every_conversation_that_loses_all_its_rows(spark):
    gone = [(n, t, "user", "x.") for n in range(2000) for t in (0,) if zlib.crc32(f"{n}:{t}".encode()) % 20 == 0]
    got = rows_of(c.repair(damaged(spark.createDataFrame(gone, COLUMNS))), *NAMES)
    empty = hashlib.sha256(b"").hexdigest()
    assert len(gone) > 50 and got == sorted(((n, 0, 0, 0, 0, 0, 0, "", empty) for n, *_ in gone), key=repr)


def test_repaired_turns_are_legal_and_make_the_digest(spark):
    table = spark.read.parquet(f"{SF}/conversations.parquet")
    rows = damaged(table).cache()
    turns = c.repaired_turns(rows).toPandas().sort_values(["conv_id", "step"])
    digests = {r["conv_id"]: r["repaired_sha256"] for r in c.repair(rows).collect()}
    import re

    for conv, digest in digests.items():
        mine = turns[turns.conv_id == conv]
        kept = mine[mine.edit != "D"]
        assert re.fullmatch("(s?(ua)+)?", "".join(r[:1] for r in kept.role))
        lines = "\n".join(f"{r}:{t}" for r, t in zip(kept.role, kept.text))
        assert hashlib.sha256(lines.encode()).hexdigest() == digest
