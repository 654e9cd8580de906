"""Semi-naive iteration: a driver loop whose rounds are written tables.

Each round joins only the newest rows and appends only rows not seen before, so nothing is
rewritten and the plan never grows. Rounds live in the shared folder, so losing executors
costs at most the round in flight.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from headwater.storage import new_path, write_counted


def grow(seed: DataFrame, step: Callable[[DataFrame, DataFrame], DataFrame], name: str) -> DataFrame:
    """All rows reachable from ``seed``.

    ``step(newest, seen)`` returns the rows to add; it must add none after some number of rounds.
    """
    spark, schema = seed.sparkSession, seed.schema
    base = new_path(spark, name)
    paths = [f"{base}/round-0"]
    read = lambda *p: spark.read.schema(schema).parquet(*p)
    fresh = write_counted(seed, paths[0])
    while fresh:
        delta = step(read(paths[-1]), read(*paths)).select(*schema.names)
        path = f"{base}/round-{len(paths)}"
        fresh = write_counted(delta, path)
        if fresh:
            paths.append(path)
    return read(*paths)
