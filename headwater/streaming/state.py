"""State of many keys as merged deltas: a step writes the keys it touched and nothing else."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from headwater.storage import exists, remove, spread


class StateLog:
    """The newest row of each key, under ``path``, after any number of steps.

    Step n adds a run of its own rows. Every ``fan`` runs of a size are merged into one ``fan`` times as long, so a key's
    row is rewritten as often as the logarithm of the steps, and reading takes at most ``fan - 1`` runs of each size.
    Which runs stand for the first n steps follows from n alone, as digits do from a number: a step that is repeated
    writes the same folders again, and there is no list of files to keep.

    Rows lie in ``buckets`` folders by a hash of their key. Whoever asks for some keys reads the buckets of those.
    """

    def __init__(
        self, spark: SparkSession, path: str, keys: list[str], schema: str, *, fan: int = 4, buckets: int = 16
    ) -> None:
        if fan < 2 or buckets < 1:
            raise ValueError("fan must be 2 or more, buckets 1 or more")
        self.spark, self.path, self.keys, self.fan, self.buckets = spark, path, keys, fan, buckets
        self.columns = spark.createDataFrame([], schema).columns
        self.schema = f"{schema}, step bigint, bucket int"

    def _bucket(self):
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _run(self, first: int, last: int) -> str:
        return f"{self.path}/run-{first}-{last}"

    def runs(self, step: int) -> list[tuple[int, int]]:
        """First and last step of each run that stands for the steps up to ``step``."""
        out, first, left = [], 0, step + 1
        size = 1
        while size * self.fan <= left:
            size *= self.fan
        while left:
            while size > left:
                size //= self.fan
            out.append((first, first + size - 1))
            first, left = first + size, left - size
        return out

    def _rows(self, runs: list[tuple[int, int]]) -> DataFrame:
        return reduce(DataFrame.union, [self.spark.read.schema(self.schema).parquet(self._run(*r)) for r in runs])

    def _newest(self, rows: DataFrame) -> DataFrame:
        values = F.struct(*[c for c in self.columns if c not in self.keys], "step")
        return rows.groupBy("bucket", *self.keys).agg(F.max_by(values, "step").alias("v"))

    def read(self, step: int, asked: DataFrame | None = None) -> DataFrame:
        """The rows after ``step``: of all keys, or of those of ``asked(keys)``, whose buckets alone are read."""
        rows = self._rows(self.runs(step)) if step >= 0 else self.spark.createDataFrame([], self.schema)
        if asked is not None:
            asked = asked.select(*self.keys).distinct()
            found = asked.select(self._bucket().alias("b")).distinct().limit(self.buckets).collect()
            rows = rows.where(F.col("bucket").isin([r["b"] for r in found]) if found else F.lit(False))
            rows = rows.join(spread(asked), self.keys, "left_semi")
        return self._newest(rows).select(*self.keys, "v.*").select(*self.columns)

    def _write(self, rows: DataFrame, first: int, last: int) -> None:
        rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(self._run(first, last))

    def write(self, step: int, delta: DataFrame) -> None:
        """Add a step's rows, one a key, and merge what has grown to a longer run."""
        rows = delta.select(*self.columns).withColumn("step", F.lit(step).cast("bigint"))
        self._write(rows.withColumn("bucket", self._bucket()), step, step)
        size = 1
        while (step + 1) % (size * self.fan) == 0:
            size *= self.fan
        if size > 1:
            first = step + 1 - size
            parts = [(step, step)] + [r for r in self.runs(step - 1) if r[0] >= first]
            merged = self._newest(self._rows(parts)).select("bucket", *self.keys, "v.*")
            self._write(merged, first, step)

    def tidy(self, step: int) -> None:
        """Remove the runs that only steps before ``step`` read; to be called when it is done for good."""
        keep = set(self.runs(step))
        old = [*(self.runs(step - 1) if step else []), (step, step)]
        for run in old:
            if run not in keep and exists(self.spark, self._run(*run)):
                remove(self.spark, self._run(*run))
