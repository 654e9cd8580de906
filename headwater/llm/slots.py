"""A table of fixed size that tells which hashes may occur often enough to matter.

Hashes are counted by slot, a number of some bits. Whatever shares a slot shares its count, so the table lets too much
pass, never too little. It is what makes rare keys cheap: they need not be shuffled to be found rare.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame

from headwater.llm.common import map_texts

#: The table has 2^MOST_BITS bits at most: 64 MB. Parts of it are counted apart.
MOST_BITS, PARTS_BITS = 29, 10
COUNTED = "part bigint, slots binary, n binary"


def packed(slots: np.ndarray) -> bytes:
    """Rising numbers as the steps between them, a byte each; 255 stands for that much and more to come."""
    steps = np.diff(slots, prepend=0)
    more, rest = steps // 255, (steps % 255).astype(np.uint8)
    out = np.full(len(slots) + int(more.sum()), 255, dtype=np.uint8)
    out[np.cumsum(more + 1) - 1] = rest
    return out.tobytes()


def unpacked(data: bytes) -> np.ndarray:
    steps = np.frombuffer(data, dtype=np.uint8)
    return np.cumsum(steps, dtype=np.int64)[steps != 255]


def counted(slots: np.ndarray, bits: int) -> dict[str, list]:
    """Slots as rows of ``COUNTED``: one for each part of the table, with the number of times each slot occurs."""
    inside = max(0, bits - PARTS_BITS)
    slots, n = np.unique(slots, return_counts=True)
    n = np.minimum(n, 255).astype(np.uint8)
    parts, at = np.unique(slots >> inside, return_index=True)
    ends = [*at[1:], len(slots)]
    return {
        "part": parts.tolist(),
        "slots": [packed(slots[a:b] - (p << inside)) for p, a, b in zip(parts.tolist(), at, ends)],
        "n": [n[a:b].tobytes() for a, b in zip(at, ends)],
    }


def frequent(rows: DataFrame, bits: int, least: int) -> np.ndarray:
    """One bit a slot: whether ``rows`` of ``COUNTED`` have it ``least`` times or more, 255 at most."""
    inside = max(0, bits - PARTS_BITS)

    def add(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        def done(part: int, sums: np.ndarray) -> dict[str, list]:
            return {"part": [part], "bits": [np.packbits(sums >= least).tobytes()]}

        part, sums = None, np.zeros(0)
        for b in batches:
            for p, slots, n in zip(b["part"], b["slots"], b["n"]):
                if p != part:
                    if part is not None and (sums >= least).any():
                        yield done(part, sums)
                    part, sums = p, np.zeros(max(8, 1 << inside), dtype=np.int32)
                sums[unpacked(slots)] += np.frombuffer(n, dtype=np.uint8)
        if part is not None and (sums >= least).any():
            yield done(part, sums)

    ordered = rows.repartition("part").sortWithinPartitions("part")
    added = map_texts(ordered, {c: ordered[c] for c in ordered.columns}, add, "part bigint, bits binary")
    table = np.zeros((1 << (bits - inside), max(1, (1 << inside) // 8)), dtype=np.uint8)
    for r in added.collect():  # of the fixed size of the table
        table[r["part"]] = np.frombuffer(r["bits"], dtype=np.uint8)
    return table.reshape(-1)


def passes(table: np.ndarray, slots: np.ndarray) -> np.ndarray:
    return (table[slots >> 3] >> (7 - (slots & 7)).astype(np.uint8)) & 1 != 0


def bits_for(things: float) -> int:
    """Bits of a table with a slot for each of so many things, as far as it may grow."""
    return min(MOST_BITS, max(PARTS_BITS + 3, int(np.ceil(np.log2(things + 1)))))
