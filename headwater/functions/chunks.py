"""Ordered work over keys of any size.

A plain window puts a whole key into one task. Arrival order is numbered, so every key is
cut into pieces of at most ``span`` sequence numbers; the window runs inside a piece and
only one small summary row per (key, piece) is ordered over the whole key. A key that
holds a third of all rows is spread over as many tasks as it has pieces.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPAN = 1_000_000


def chunk_of(seq: Column, span: int) -> Column:
    return F.floor(seq / F.lit(span)).cast("bigint")


def running_count(df: DataFrame, keys: list[str], seq: str, name: str, span: int = SPAN) -> DataFrame:
    """1-based position of each row within its key, in ``seq`` order (``seq`` is unique)."""
    local = df.withColumn("_chunk", chunk_of(F.col(seq), span))
    per_chunk = local.groupBy(*keys, "_chunk").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    base = per_chunk.select(*keys, "_chunk", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_base"))
    within = F.row_number().over(Window.partitionBy(*keys, "_chunk").orderBy(seq))
    return (
        local.withColumn("_rn", within)
        .join(base, [*keys, "_chunk"])
        .withColumn(name, (F.col("_base") + F.col("_rn")).cast("bigint"))
        .drop("_chunk", "_rn", "_base")
    )


# Kinds of rows in a key's history.
STATE = "S"  # carries a signature
INHERIT = "E"  # no signature: keeps the current state, or opens an empty one
CLOSE = "T"  # ends the current state
PROBE = "P"  # only asks which version holds

_CLOSED = ""  # hex digits of the signature that stands for "closed"


#: Gives the states of the keys it is asked for, before the first row: ``(keys, last_sig, last_kind, version)``.
Prior = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class History:
    """What :func:`change_history` adds to its rows, and the state of each of their keys after the last one."""

    rows: DataFrame
    after: DataFrame


@contextmanager
def change_history(
    rows: DataFrame,
    keys: list[str],
    order: list[str],
    *,
    prior: Prior | None = None,
    initial: Column | None = None,
    span: int = SPAN,
) -> Iterator[History]:
    """Number the states each key goes through.

    ``rows`` has ``keys``, ``order`` (starting with ``seq``), ``kind`` and ``sig``. Added
    columns: ``changed`` (this row opens a new version), ``version`` (count of versions so
    far), ``live`` (the key has an open version after this row), ``closed`` (this row ends
    an open version). ``prior`` is asked for the states before the first row of the keys that
    have rows, and for no others; ``initial`` is the signature of a key never seen before.

    The rows, shuffled by (key, piece), are read twice: for the summaries and for the result. They
    are kept on executor disks while the context is open, so what leads to them runs once and
    the join with the summaries finds them already in place. They keep their lineage: a lost
    executor costs its partitions again and nothing else.
    """
    kind, sig = F.col("kind"), F.col("sig")
    position = F.struct(*order)
    is_event = kind != PROBE

    chunked = rows.withColumn("_chunk", chunk_of(F.col("seq"), span)).withColumn(
        "_def", F.when(kind == STATE, sig).when(kind == CLOSE, F.unhex(F.lit(_CLOSED)))
    )
    within = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    before = within.rowsBetween(Window.unboundedPreceding, -1)
    local = chunked.withColumn("_prev_def", F.last("_def", True).over(before)).withColumn(
        "_prev_kind", F.last(F.when(is_event, kind), True).over(before)
    )
    local = local.persist(StorageLevel.DISK_ONLY)

    # What is already decided inside the piece; the first rows wait for the carry.
    settled = ((kind == STATE) & F.col("_prev_def").isNotNull() & (F.col("_prev_def") != sig)) | (
        (kind == INHERIT) & (F.col("_prev_kind") == CLOSE)
    )
    summary = local.groupBy(*keys, "_chunk").agg(
        F.max_by("_def", F.when(F.col("_def").isNotNull(), position)).alias("_last_def"),
        F.max_by("kind", F.when(is_event, position)).alias("_last_kind"),
        F.min_by(F.struct("kind", "sig"), F.when(F.col("_def").isNotNull(), position)).alias("_first_def"),
        F.min_by("kind", F.when(is_event, position)).alias("_first_kind"),
        F.sum(F.coalesce(settled, F.lit(False)).cast("bigint")).alias("_n"),
    )
    if prior is not None:
        seeds = prior(summary.select(*keys).distinct()).select(
            *keys,
            F.lit(-1).cast("bigint").alias("_chunk"),
            F.col("last_sig").alias("_last_def"),
            F.col("last_kind").alias("_last_kind"),
            F.lit(None).cast(summary.schema["_first_def"].dataType).alias("_first_def"),
            F.lit(None).cast("string").alias("_first_kind"),
            F.col("version").cast("bigint").alias("_n"),
        )
        summary = summary.unionByName(seeds)

    earlier = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carry_def = F.last("_last_def", True).over(earlier)
    if initial is not None:
        carry_def = F.coalesce(carry_def, initial)
    opened = (
        (F.col("_first_def.kind") == STATE) & ~F.col("_first_def.sig").eqNullSafe(F.col("_carry_def"))
    ).cast("bigint")
    created = (
        (F.col("_first_kind") == INHERIT) & (F.col("_carry_kind").isNull() | (F.col("_carry_kind") == CLOSE))
    ).cast("bigint")
    made = (
        summary.withColumn("_carry_def", carry_def)
        .withColumn("_carry_kind", F.last("_last_kind", True).over(earlier))
        .withColumn("_made", F.col("_n") + F.coalesce(opened, F.lit(0)) + F.coalesce(created, F.lit(0)))
    )
    carry = made.withColumn("_base", F.coalesce(F.sum("_made").over(earlier), F.lit(0))).select(
        *keys, "_chunk", "_carry_def", "_carry_kind", "_base"
    )
    after = made.groupBy(*keys).agg(
        F.max_by("_last_def", F.when(F.col("_last_def").isNotNull(), F.col("_chunk"))).alias("last_sig"),
        F.max_by("_last_kind", F.when(F.col("_last_kind").isNotNull(), F.col("_chunk"))).alias("last_kind"),
        F.sum("_made").alias("version"),
    )

    prev_def = F.coalesce("_prev_def", "_carry_def")
    prev_kind = F.coalesce("_prev_kind", "_carry_kind")
    was_live = F.coalesce(prev_kind.isin(STATE, INHERIT), F.lit(False))
    changed = F.when(kind == STATE, ~prev_def.eqNullSafe(sig)).when(kind == INHERIT, ~was_live).otherwise(False)
    result = (
        local.join(carry, [*keys, "_chunk"])
        .withColumn("changed", changed)
        .withColumn("closed", (kind == CLOSE) & was_live)
        .withColumn("live", F.when(is_event, kind != CLOSE).otherwise(was_live))
        .withColumn(
            "version",
            (
                F.col("_base")
                + F.sum(F.col("changed").cast("bigint")).over(
                    within.rowsBetween(Window.unboundedPreceding, Window.currentRow)
                )
            ).cast("bigint"),
        )
        .drop("_chunk", "_def", "_prev_def", "_prev_kind", "_carry_def", "_carry_kind", "_base")
    )
    try:
        yield History(result, after)
    finally:
        local.unpersist()
