"""Conversation repair: turns are aligned with the strings of an alternating grammar at the least cost.

A repaired conversation's role initials are ``(s?(ua)+)?``. For every feasible length of such a string the turns are
aligned with it by Wagner-Fischer, inside Ukkonen's band of the cheapest cost so far; of equally cheap alignments the
one whose edits read least is taken.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from headwater.llm.common import SLICE
from headwater.storage import materialize

# The costs of edits.
DELETE, INSERT, REROLE, TRUNCATED = 4, 3, 3, 3
ROLES = ("system", "user", "assistant")
LEGAL = {"su", "ua", "au"}
SPACE = " \t\n\x0b\x0c\r"
#: Cells of all tables of one conversation; one that needs more is aligned with the grammar's states instead.
CELLS = 2_000_000
#: Conversations remembered by the kinds of their turns.
REMEMBERED = 1 << 16

_NEVER = 1 << 60
# A turn's code: the place of its initial in "sua" (3: another one), plus 4 if it must go, or 8 if it is truncated.
_GOES, _CUT = 4, 8


def _table(code: bytes, m: int, system: bool, most: int) -> list[list[int]] | None:
    """Least costs of aligning the turns from i on with the target from j on, for cells in the band of cost ``most``.

    ``row[i][e - low]`` is the cell of ``j = stays before i + e``. Off the diagonal a cell needs e more insertions
    (3 each) than turns that stay, or fewer, by deletions of turns that could stay (1 more than their fault at least).
    """
    n = len(code)
    stays = [0]
    for c in code:
        stays.append(stays[-1] + (not c & _GOES))
    least = DELETE * (n - stays[n]) + TRUNCATED * sum(1 for c in code if c & _CUT)
    shift = m - stays[n]
    room = (most - least - (INSERT * shift if shift >= 0 else -shift)) // 4
    if room < 0:
        return None
    low, high = min(0, shift) - room, max(0, shift) + room
    width = high - low + 1
    first = 0 if system else 1
    table, below = [], None
    for i in range(n, -1, -1):
        row = [_NEVER] * (width + 1)
        c = code[i] if i < n else 0
        cut, mine, goes = TRUNCATED if c & _CUT else 0, c & 3, c & _GOES
        for e in range(min(high, m - stays[i]), max(low, -stays[i]) - 1, -1):
            j, at = stays[i] + e, e - low
            best = 0 if i == n and j == m else _NEVER
            if j < m:
                place = first + j
                wanted = 0 if place == 0 else 2 - place % 2
                if wanted:
                    best = min(best, INSERT + row[at + 1])
                if i < n and not goes and (wanted or mine == 0):
                    best = min(best, below[at] + cut + (0 if mine == wanted else REROLE))
            if i < n and (goes or at):
                best = min(best, DELETE + below[at if goes else at - 1])
            row[at] = best
        table.append(row)
        below = row
    table.reverse()
    return table if table[0][-low] <= most else None


def _backtrace(code: bytes, m: int, system: bool, most: int, table: list[list[int]]) -> str:
    """The least audit of the table's cost: at every cell the first of D, I, K, R that keeps the cost."""
    n, stays = len(code), 0
    shift = m - sum(1 for c in code if not c & _GOES)
    least = sum(DELETE if c & _GOES else TRUNCATED if c & _CUT else 0 for c in code)
    low = min(0, shift) - (most - least - (INSERT * shift if shift >= 0 else -shift)) // 4
    i, at, audit, first = 0, -low, [], 0 if system else 1
    while True:
        j = stays + at + low
        if i == n and j == m:
            return "".join(audit)
        cost = table[i][at]
        place = first + j
        wanted = 0 if place == 0 else 2 - place % 2
        goes = i < n and code[i] & _GOES
        if i < n and (goes or at) and DELETE + table[i + 1][at if goes else at - 1] == cost:
            audit.append("D")
            if not goes:
                at, stays = at - 1, stays + 1
            i += 1
        elif j < m and wanted and INSERT + table[i][at + 1] == cost:
            audit.append("I")
            at += 1
        else:
            audit.append("K" if code[i] & 3 == wanted else "R")
            i, stays = i + 1, stays + 1


def targets(code: bytes) -> Iterator[tuple[int, int, bool]]:
    """``(bound, length, begins with s)`` of the grammar's strings by rising lower bound of their cost, without end."""
    stay = sum(1 for c in code if not c & _GOES)
    cuts = sum(1 for c in code if c & _CUT)
    least = DELETE * (len(code) - stay) + TRUNCATED * cuts
    system = any(c & 3 == 0 and not c & _GOES for c in code)

    def side(lengths: Iterator[int]) -> Iterator[tuple[int, int, bool]]:
        for m in lengths:
            gone = max(0, stay - m)
            extra = INSERT * max(0, m - stay) + DELETE * gone - TRUNCATED * min(gone, cuts)
            if m % 2 == 0:
                yield least + extra, m, False
            elif system and m > 1:
                yield least + extra, m, True

    from heapq import merge
    from itertools import count

    return merge(side(iter(range(stay, -1, -1))), side(count(stay + 1)), key=lambda t: t[0])


def align(code: bytes, cells: int = CELLS) -> tuple[int, str]:
    """The least cost and, of the alignments of that cost, the least audit, of turns given by their codes."""
    best, audit, spent = _NEVER, "", 0
    least = sum(DELETE if c & _GOES else TRUNCATED if c & _CUT else 0 for c in code)
    # Nothing costs more than to let all go.
    most = sum(DELETE for _ in code)
    for bound, m, system in targets(code):
        if bound > min(best, most):
            return best, audit
        limit = min(best, most)
        spent += (len(code) + 1) * (limit - least + 4) // 2
        if spent > cells:
            return by_states(code)
        table = _table(code, m, system, limit)
        if table is None:
            continue
        shift = m - sum(1 for c in code if not c & _GOES)
        room = (limit - least - (INSERT * shift if shift >= 0 else -shift)) // 4
        cost = table[0][room - min(0, shift)]
        found = _backtrace(code, m, system, limit, table)
        if (cost, found) < (best, audit) or best == _NEVER:
            best, audit = cost, found
    raise AssertionError


def by_states(code: bytes) -> tuple[int, str]:
    """What ``align`` gives, in time and memory linear in the turns, for conversations of any length.

    Costs to the end from each state of the grammar: nothing yet, after s, after u, after a.
    """
    n = len(code)
    ends = [[0, _NEVER, _NEVER, 0]]
    wanted, after = (1, 1, 2, 1), (2, 2, 3, 2)

    def stay(c: int, state: int) -> tuple[int, int, str] | None:
        cut = TRUNCATED if c & _CUT else 0
        if c & _GOES:
            return None
        if c & 3 == 0 and state == 0:  # to make it a user costs and leads to the same as to keep it and insert one
            return cut, 1, "K"
        return (cut, after[state], "K") if c & 3 == wanted[state] else (cut + REROLE, after[state], "R")

    def with_insertions(row: list[int]) -> list[int]:
        for _ in range(3):  # no more than three in a row ever pay
            row = [min(row[s], INSERT + row[after[s]]) for s in range(4)]
        return row

    ends = [with_insertions(ends[0])]
    for c in reversed(code):
        below, row = ends[-1], []
        for state in range(4):
            kept = stay(c, state)
            row.append(min(DELETE + below[state], below[kept[1]] + kept[0] if kept else _NEVER))
        ends.append(with_insertions(row))
    ends.reverse()
    i, state, audit = 0, 0, []
    while i < n or state not in (0, 3):
        cost = ends[i][state]
        kept = stay(code[i], state) if i < n else None
        if i < n and DELETE + ends[i + 1][state] == cost:
            audit.append("D")
            i += 1
        elif INSERT + ends[i][after[state]] == cost:
            audit.append("I")
            state = after[state]
        else:
            audit.append(kept[2])
            i, state = i + 1, kept[1]
    return ends[0][0], "".join(audit)


# -- tables ---------------------------------------------------------------------------------


def damage(rows: DataFrame, conv_id: Column, turn: Column, role: Column, text: Column) -> DataFrame:
    """``(conv_id, turn, role, text, copies)`` with faults by ``crc32(conv_id:turn) % 20``: 0 drops a row (no copies),
    1 empties its text, 2 takes ``[.!?]`` out, 3 repeats it, 4 makes its role user. Nulls are read as one space."""
    said = lambda c: F.coalesce(c.cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(said(conv_id), F.lit(":"), said(turn)).cast("binary")) % 20
    table = rows.select(
        conv_id.alias("conv_id"), turn.cast("bigint").alias("turn"), said(role).alias("role"), said(text).alias("text"), fault.alias("fault")
    )
    kind = F.col("fault")
    return table.select(
        "conv_id",
        "turn",
        F.when(kind == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"),
    )


_ORDER = ["conv_id", "turn", "role", "digest"]


def _digested(rows: DataFrame) -> DataFrame:
    """Rows with the digest of their text, which stands for it wherever texts are compared or ordered."""
    return rows.withColumn("digest", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))


def _coded(rows: DataFrame) -> DataFrame:
    """One row for all equal rows: their number, the code of the first one, and whether an earlier turn has the same."""
    digested = _digested(rows).select(
        *_ORDER,
        "copies",
        F.col("text").rlike(r"[^ \t-\r]").alias("said"),
        F.substring(F.rtrim(F.col("text"), F.lit(SPACE)), -1, 1).isin(".", "!", "?").alias("ended"),
    )
    each = digested.groupBy(*_ORDER).agg(
        F.sum("copies").cast("bigint").alias("copies"), F.first("said").alias("said"), F.first("ended").alias("ended")
    )
    # The first place of a text in a conversation; a missing turn comes before all others.
    firsts = each.where("copies > 0").groupBy(*[F.col(c).alias(f"f_{c}") for c in ("conv_id", "role", "digest")]).agg(
        F.max(F.col("turn").isNull()).alias("first_unknown"), F.min("turn").alias("first_turn")
    )
    on = F.col("conv_id").eqNullSafe(F.col("f_conv_id")) & (F.col("role") == F.col("f_role")) & (F.col("digest") == F.col("f_digest"))
    again = F.col("turn").isNotNull() & (F.col("first_unknown") | (F.col("turn") > F.col("first_turn")))
    place = F.instr(F.lit("sua"), F.substring("role", 1, 1))
    return each.join(firsts, on, "left").select(
        *_ORDER,
        "copies",
        F.when((F.col("role") == "") | (place == 0), 3).otherwise(place - 1).cast("int").alias("initial"),
        "said",
        F.coalesce(again, F.lit(False)).alias("again"),
        "ended",
    )


def _in_order(df: DataFrame, *first: str) -> DataFrame:
    """Each conversation's rows together and in order; rows are spread by conversation, sorted on disk, and streamed."""
    order = ["conv_id", *first, *[F.col(c).asc_nulls_first() for c in _ORDER[1:]]]
    return df.repartition("conv_id").sortWithinPartitions(*order)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        for at in range(0, b.num_rows, SLICE):
            yield from zip(*[c.to_pylist() for c in b.slice(at, SLICE).columns])


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= SLICE:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held), schema)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held), schema)], schema=schema)


def _schema(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


_AUDIT = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string"


def audits(rows: DataFrame) -> DataFrame:
    """``(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit)`` of ``rows(conv_id, turn, role, text, copies)``.

    Turns are ordered by number (missing ones first), then role, then digest of the text; ``copies`` says how often a row
    stands there, 0 keeps only its conversation. A turn counts for its first fault: blank, a duplicate of an earlier turn
    of its role and text, or truncated (no ``.``, ``!`` or ``?`` at the end). ``illegal`` counts neighbours that are not
    ``su``, ``ua`` or ``au``. Null ids are one conversation; a conversation without rows has zeros and an empty audit.

    Texts do not travel: a turn is a byte here, and a conversation of any length is read as a stream of them.
    """
    coded = _coded(rows).select("conv_id", "turn", "copies", "initial", "said", "again", "ended", "role", "digest")
    conv_type = coded.schema["conv_id"].dataType.simpleString()
    ddl = f"conv_id {conv_type}, {_AUDIT}"
    schema = _schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, tuple[int, str]] = {}

        def finished(conv, code: bytearray, turns: list, counts: list[int]) -> tuple:
            kinds = bytes(code)
            if kinds not in known:
                if len(known) >= REMEMBERED:
                    known.clear()
                known[kinds] = align(kinds)
            cost, audit = known[kinds]
            initials = "".join("sua?"[c & 3] for c in kinds)
            illegal = sum(initials[k : k + 2] not in LEGAL for k in range(len(initials) - 1))
            low, high, distinct = turns
            return conv, high - low + 1 - distinct if distinct else 0, *counts, illegal, cost, audit

        def results() -> Iterator[tuple]:
            conv, code, turns, counts = None, None, [None, None, 0], [0, 0, 0]
            for c, turn, copies, initial, said, again, ended in _rows(batches):
                if code is None or c != conv:
                    if code is not None:
                        yield finished(conv, code, turns, counts)
                    conv, code, turns, counts = c, bytearray(), [None, None, 0], [0, 0, 0]
                if not copies:
                    continue
                if turn is not None:
                    if not turns[2] or turn != turns[1]:
                        turns = [turns[0] if turns[2] else turn, turn, turns[2] + 1]
                if not said:
                    counts[0] += copies
                    code += bytes([initial | _GOES]) * copies
                    continue
                if again:
                    code.append(initial | _GOES)
                elif ended:
                    code.append(initial)
                else:
                    counts[2] += 1
                    code.append(initial | _CUT)
                counts[1] += copies - (not again)
                code += bytes([initial | _GOES]) * (copies - 1)
            if code is not None:
                yield finished(conv, code, turns, counts)

        return _batches(results(), schema)

    return _in_order(coded).drop("role", "digest").mapInArrow(run, ddl)


def _streamed(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Each conversation's audit, then its turns, in order, in one stream."""
    none = [F.lit(None).cast(t).alias(c) for c, t in (("turn", "bigint"), ("role", "string"), ("digest", "binary"), ("text", "string"))]
    heads = found.select("conv_id", F.lit(0).alias("kind"), *none, F.lit(0).alias("copies"), F.struct(*found.columns[1:]).alias("head"))
    turns = _digested(rows).where("copies > 0").select(
        "conv_id", F.lit(1).alias("kind"), *_ORDER[1:], "text", "copies", F.lit(None).cast(heads.schema["head"].dataType).alias("head")
    )
    ordered = _in_order(heads.unionByName(turns), "kind")
    return ordered.select("conv_id", "kind", "role", "text", "copies", "head")


def _edited(rows: Iterator[tuple]) -> Iterator[tuple]:
    """``(conv_id, None, head)`` for each conversation, then ``(conv_id, edit, role, text)`` for each of its edits."""
    edits, at, out = "", 0, 0

    def inserted(conv) -> Iterator[tuple]:
        nonlocal at, out
        while at < len(edits) and edits[at] == "I":
            yield conv, "I", _role(out), ""
            at, out = at + 1, out + 1

    def _role(place: int) -> str:
        return ROLES[2 - (place + first) % 2]

    conv, first = None, 1
    for conv_id, kind, role, text, copies, head in rows:
        if kind == 0:
            if edits:
                yield from inserted(conv)
            conv, edits, at, out, first = conv_id, head["audit"], 0, 0, 1
            yield conv, None, head
            continue
        for _ in range(copies):
            yield from inserted(conv)
            edit, at = edits[at], at + 1
            if edit == "K" and out == 0 and role[:1] == "s":
                first = 0
            if edit == "D":
                yield conv, "D", role, text
                continue
            yield conv, edit, role if edit == "K" else _role(out), text
            out += 1
    if edits:
        yield from inserted(conv)


def repaired_turns(rows: DataFrame) -> DataFrame:
    """``(conv_id, step, edit, role, text)``: every edit of every conversation in order, deleted turns included.

    ``rows`` and the order are those of ``audits``.
    """
    stream = _streamed(rows, materialize(audits(rows), "audits"))
    ddl = f"conv_id {stream.schema['conv_id'].dataType.simpleString()}, step bigint, edit string, role string, text string"
    schema = _schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def numbered() -> Iterator[tuple]:
            step = 0
            for conv, edit, *rest in _edited(_rows(batches)):
                step = step + 1 if edit else 0
                if edit:
                    yield conv, step, edit, *rest

        return _batches(numbered(), schema)

    return stream.mapInArrow(run, ddl)


def repair(rows: DataFrame) -> DataFrame:
    """The columns of ``audits`` and ``repaired_sha256``, of the repaired turns as lines ``role:text``.

    A conversation's texts pass through one hash in order, as its digest demands; none is held whole.
    """
    stream = _streamed(rows, materialize(audits(rows), "audits"))
    conv_type = stream.schema["conv_id"].dataType.simpleString()
    ddl = f"conv_id {conv_type}, {_AUDIT}, repaired_sha256 string"
    schema = _schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def results() -> Iterator[tuple]:
            current = None
            for conv, edit, *rest in _edited(_rows(batches)):
                if edit is None:
                    if current:
                        yield (*current, digest.hexdigest())
                    current, digest, begun = (conv, *rest[0].values()), hashlib.sha256(), False
                elif edit != "D":
                    role, text = rest
                    digest.update(f"{chr(10) if begun else ''}{role}:{text}".encode("utf-8", "replace"))
                    begun = True
            if current:
                yield (*current, digest.hexdigest())

        return _batches(results(), schema)

    return stream.mapInArrow(run, ddl)
