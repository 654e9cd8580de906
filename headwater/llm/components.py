"""Connected components of a link table, in rounds of small joins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headwater.storage import materialize


def _state(edges: DataFrame) -> tuple:
    """Row count and an order-free digest: equal for two rounds only when nothing changed."""
    mark = F.xxhash64("src", "dst").cast("decimal(38,0)")
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(mark)).first())


def _minimum(edges: DataFrame) -> DataFrame:
    return edges.groupBy("src").agg(F.least(F.min("dst"), F.first("src")).alias("low"))


def components(links: DataFrame, put: Callable[[DataFrame, str], DataFrame] = materialize) -> DataFrame:
    """``(node, root)`` for every node of ``links(src, dst)``: root is the smallest node it is connected with.

    Alternates the two star operations: a node's larger neighbours move to its smallest neighbour, then its smaller
    ones do. Each keeps the components, and both together end in one star per component after a number of rounds
    that grows with the logarithm of the longest chain. A hub is only ever a key of a sum or of a join, which Spark
    reduces on the map side or splits. Rounds are written with ``put``, so lineage stays short.

    Self links, repeated links and links with a null end are ignored; no links give no rows.
    """
    edges = (
        links.select(F.col("src").cast("bigint").alias("a"), F.col("dst").cast("bigint").alias("b"))
        .where("a <> b")
        .select(F.greatest("a", "b").alias("src"), F.least("a", "b").alias("dst"))
        .distinct()
    )
    edges = put(edges, "links")
    before = None
    while (now := _state(edges)) != before:
        before = now
        both = edges.union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        large = (
            both.join(_minimum(both), "src")
            .where("dst > src")
            .select(F.col("dst").alias("src"), F.col("low").alias("dst"))
            .distinct()
        )
        lows = _minimum(large)
        small = large.join(lows, "src").where("dst <> low").select(F.col("dst").alias("src"), F.col("low").alias("dst"))
        small = small.union(lows.select("src", F.col("low").alias("dst"))).where("src <> dst").distinct()
        edges = put(small, "links")
    roots = edges.select(F.col("dst").alias("node"), F.col("dst").alias("root")).distinct()
    return edges.select(F.col("src").alias("node"), F.col("dst").alias("root")).union(roots)
