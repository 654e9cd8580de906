"""Continuous ingest: events and schema syncs as steps of one ordered log, each on the state the one before left."""

from __future__ import annotations

import datetime
import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from headwater.functions.chunks import CLOSE, SPAN
from headwater.operators import sync
from headwater.operators.parse import FINAL_TYPES, good_events, parse_events
from headwater.operators.runs import run_aggregates
from headwater.plans.model import LineageModel, advance, sync_tables
from headwater.schemas import FIELDS, RAW_EVENTS
from headwater.sources.events import number_placed
from headwater.storage import exists, jit_sized_methods, remove, spread, together, write_counted, write_table
from headwater.streaming.state import StateLog

_HELD = "last_sig binary, last_kind string, version bigint"
STATES = {
    "table_state": f"tbl string, {_HELD}",
    "schema_state": f"tbl string, namespace string, schema_name string, version bigint, fields {FIELDS}",
    "job_state": f"job string, {_HELD}",
    "set_state": f"job string, job_version bigint, {_HELD}",
}
LOGS = ["tables", "closings", "jobs", "links", "sets", "transformations", "resolved"]
SYNC_RUN = (
    "source_id bigint, run_no bigint, run_at timestamp, actual_tables bigint, changed bigint, unchanged bigint, removed bigint, error string"
)


class ModelStream:
    """The versioned model kept under ``root`` by a stream of events and by schema syncs.

    Either is a step. The outputs of step n go to folders named after n, written over when it is retried, and it reads what
    the steps before left; a step counts once its mark is written, and one that has its mark is never applied again.
    What a later step must know is kept as deltas (:class:`StateLog`): a step writes the tables and jobs it touched, however
    large the model is. Order is the arrival number; event time never decides a version, so there is no watermark.

    An event whose number is not above all of the batches before came too late to take its place. ``late`` says
    what becomes of it: "quarantine" keeps it out of the model, to be read with :meth:`late_events`; "fail" ends the
    batch with an error, before anything of it is applied.
    """

    def __init__(
        self,
        spark: SparkSession,
        root: str,
        *,
        sql_fallback: bool = True,
        span: int = SPAN,
        late: str = "quarantine",
        fan: int = 4,
        buckets: int = 16,
    ) -> None:
        if late not in ("quarantine", "fail"):
            raise ValueError(f"late must be quarantine or fail, not {late}")
        self.spark, self.root, self.sql_fallback, self.span, self.late = spark, root, sql_fallback, span, late
        self.states = {
            name: StateLog(spark, f"{root}/state/{name}", [schema.split()[0]], schema, fan=fan, buckets=buckets)
            for name, schema in STATES.items()
        }
        self._one_at_a_time = threading.RLock()

    # -- steps ------------------------------------------------------------------------------

    def _done(self) -> tuple[int, int | None, int]:
        """The last step that counts, the highest event number applied, and the last batch of the stream."""
        if not exists(self.spark, f"{self.root}/done"):
            return -1, None, -1
        marks = self.spark.read.schema("last_seq bigint, last_batch bigint, step bigint").parquet(f"{self.root}/done")
        last = marks.agg(F.max(F.struct("step", "last_seq", "last_batch")).alias("m")).first()["m"]
        return (last["step"], last["last_seq"], last["last_batch"]) if last else (-1, None, -1)

    def _mark(self, step: int, last_seq: int | None, last_batch: int) -> None:
        row = self.spark.createDataFrame([(last_seq, last_batch)], "last_seq bigint, last_batch bigint")
        row.coalesce(1).write.mode("overwrite").parquet(f"{self.root}/done/step={step}")
        remove(self.spark, f"{self.root}/done/step={step - 2}")
        for state in self.states.values():
            state.tidy(step)

    def _path(self, name: str, step: int) -> str:
        return f"{self.root}/{name}/step={step}"

    def _write(self, step: int) -> Callable[[str, DataFrame], DataFrame]:
        """Write a step's part of a log. Everything is read back through our own session: the stream hands over one in
        which adaptive execution is off."""

        def write(name: str, df: DataFrame) -> DataFrame:
            write_table(df, self._path(name, step))
            return self.spark.read.schema(df.schema).parquet(self._path(name, step))

        return write

    def _keep(self, step: int) -> Callable[[str, DataFrame], None]:
        return lambda name, df: self.states[name].write(step, df)

    def _keep_nothing(self, step: int, *names: str) -> None:
        jobs = [lambda n=n: self.states[n].write(step, self.spark.createDataFrame([], STATES[n])) for n in names]
        together(self.spark, *jobs)

    def _prior(self, step: int) -> dict[str, Callable[[DataFrame], DataFrame]]:
        if step == 0:
            return {}
        return {name: lambda asked, s=state: s.read(step - 1, asked) for name, state in self.states.items()}

    def apply(self, parsed: DataFrame, batch: int) -> None:
        """Add one batch of parsed events, numbered by the stream; a batch that was added already is left alone."""
        with self._one_at_a_time:
            done, before, last_batch = self._done()
            if batch <= last_batch:
                return
            step = done + 1
            write = self._write(step)
            too_late = F.lit(False) if before is None else F.coalesce(F.col("seq") <= before, F.lit(False))
            arrived = write("events", parsed.withColumn("late", too_late))
            found = arrived.agg(F.max(F.when(~F.col("late"), F.col("seq"))), F.count_if("late")).first()
            if found[1] and self.late == "fail":
                raise ValueError(f"batch {batch}: {found[1]} events are numbered {before} or below, which is applied already")
            last = before if found[0] is None else found[0]
            advance(arrived.filter(~F.col("late")).drop("late"), write, self._prior(step), self.span, self._keep(step))
            self._mark(step, last, batch)

    def start(self, events: DataFrame, **trigger) -> StreamingQuery:
        """``events`` is a streaming (seq, ts, raw); ``trigger`` goes to ``writeStream.trigger``.

        Parsing is part of the stream's own plan, which is analysed once and not per batch.
        """
        with jit_sized_methods(self.spark):  # a stream keeps the settings it was started with
            return (
                parse_events(events, sql_fallback=self.sql_fallback)
                .writeStream.foreachBatch(self.apply)
                .option("checkpointLocation", f"{self.root}/stream")
                .trigger(**trigger)
                .start()
            )

    def _begin(self) -> None:
        """Step 0 of a model whose first step is no batch of events."""
        write = self._write(0)
        none = write("events", parse_events(self.spark.createDataFrame([], RAW_EVENTS)).withColumn("late", F.lit(False)))
        advance(none.drop("late"), write, {}, self.span, self._keep(0))
        self._mark(0, None, -1)

    def start_lines(self, lines: DataFrame, **trigger) -> StreamingQuery:
        """As :meth:`start`, for a stream of raw lines (``sources.events.stream_lines``): each batch goes on numbering
        after the last event applied, so a batch that is repeated gives its lines the same numbers."""

        def batch(placed: DataFrame, number: int) -> None:
            with self._one_at_a_time:
                _, last, last_batch = self._done()
                if number > last_batch:
                    numbered = number_placed(placed, 0 if last is None else last + 1)
                    with jit_sized_methods(placed.sparkSession):
                        self.apply(parse_events(numbered, sql_fallback=self.sql_fallback), number)

        return lines.writeStream.foreachBatch(batch).option("checkpointLocation", f"{self.root}/stream").trigger(**trigger).start()

    # -- schema syncs -----------------------------------------------------------------------

    def _known_tables(self, done: int, scopes: DataFrame, specs: DataFrame) -> DataFrame:
        """Current tables of the synced scopes, and those that the snapshot lists, wherever they are."""
        inside = self.states["schema_state"].read(done).join(scopes, ["namespace", "schema_name"], "left_semi")
        listed = self.states["schema_state"].read(done, specs.select("tbl"))
        tables = inside.unionByName(listed).dropDuplicates(["tbl"])
        state = self.states["table_state"].read(done, tables.select("tbl"))
        closed = state.where(F.col("last_kind") == CLOSE)
        return tables.join(spread(closed), "tbl", "left_anti")

    def sync(
        self,
        source_id: int,
        run_no: int,
        inspect: Callable[[], DataFrame],
        *,
        scopes: DataFrame | None = None,
        at: datetime.datetime | None = None,
    ) -> bool:
        """Run one sync as the next step: ``inspect()`` reads the warehouse's tables (namespace, schema_name, tbl, fields).

        Its place in the log is after the last event applied. Tables listed are upserted; current tables of the
        synced ``scopes(namespace, schema_name)`` (by default those of the tables listed) that are not listed are closed.
        The run leaves a row with its counts and one row a table with its status. An error while reading or applying
        leaves the model as it was and a run row with the error, and is raised again. A run that is recorded is not
        repeated: the result says whether it was run now.
        """
        with self._one_at_a_time:
            if self._done()[0] < 0:
                self._begin()
            done, seq, batch = self._done()
            if exists(self.spark, f"{self.root}/sync_runs"):
                same = (F.col("source_id") == source_id) & (F.col("run_no") == run_no)
                if not self._read("sync_runs").filter(same).isEmpty():
                    return False
            step, at = done + 1, at or datetime.datetime.now(datetime.timezone.utc)
            write = self._write(step)
            head = self.spark.createDataFrame([(source_id, run_no, at)], "source_id bigint, run_no bigint, run_at timestamp")
            try:
                specs = write("snapshots", inspect().select("namespace", "schema_name", "tbl", "fields").dropDuplicates(["tbl"]))
                asked = sync.scopes_of(specs) if scopes is None else scopes
                known = write("sync_known", self._known_tables(done, asked, specs))
                items = write("sync_items", sync.sync_diff(specs, known, asked).selectExpr(
                    f"{int(source_id)}L source_id", f"{int(run_no)}L run_no", "tbl", "status"
                ))
                removed = sync.sync_removed(specs, known, asked)
                prior = self._prior(step)["table_state"]
                sync_tables(specs, removed, 0 if seq is None else seq, at, write, prior, self._keep(step))
                counts = [F.count_if(F.col("status") == s).alias(s) for s in ("changed", "unchanged", "removed")]
                run = items.agg(F.count_if(F.col("status") != "removed").alias("actual_tables"), *counts)
                write("sync_runs", head.crossJoin(run).withColumn("error", F.lit(None).cast("string")))
                self._keep_nothing(step, "job_state", "set_state")
            except Exception as failure:
                for name in ("snapshots", "sync_known", "sync_items", "table_steps", "tables", "closings"):
                    remove(self.spark, self._path(name, step))
                none = [F.lit(None).cast("bigint").alias(c) for c in ("actual_tables", "changed", "unchanged", "removed")]
                write("sync_runs", head.select("*", *none, F.lit(str(failure)).alias("error")))
                self._keep_nothing(step, *STATES)
                self._mark(step, seq, batch)
                raise
            self._mark(step, seq, batch)
            return True

    def sync_runs(self) -> DataFrame:
        """The run log: one row a run, with its counts or its error."""
        return self._read("sync_runs")

    def sync_items(self) -> DataFrame:
        """(source_id, run_no, tbl, status) of every table that a run listed or closed."""
        return self._read("sync_items")

    def sync_results(self) -> DataFrame:
        """``(source_id, run_no, run_at, result, error)``, as :func:`sync.sync_status` reads it: the result of a run is
        the JSON of its table count and its lists of tables, by name."""
        named = lambda s: F.array_sort(F.collect_list(F.when(F.col("status") == s, F.col("tbl")))).alias(f"{s}_tables")
        lists = self.sync_items().groupBy("source_id", "run_no").agg(*map(named, ("changed", "unchanged", "removed")))
        none = F.array().cast("array<string>")
        result = F.to_json(F.struct(
            "actual_tables", *[F.coalesce(c, none).alias(c) for c in ("changed_tables", "unchanged_tables", "removed_tables")]
        ))
        runs = self.sync_runs().join(lists, ["source_id", "run_no"], "left")
        return runs.select("source_id", "run_no", "run_at", F.when(F.col("error").isNull(), result).alias("result"), "error")

    # -- reading ----------------------------------------------------------------------------

    def _read(self, name: str) -> DataFrame:
        """What all finished steps appended: one folder with a part for each step, of which unfinished ones are left out."""
        rows = self.spark.read.option("basePath", f"{self.root}/{name}").parquet(f"{self.root}/{name}")
        return rows.where(F.col("step") <= self._done()[0]).drop("step")

    def model(self) -> LineageModel:
        """The model after the latest finished step."""
        events = self._read("events").filter(~F.col("late")).drop("late")
        return LineageModel(events, {name: self._read(name) for name in LOGS}, self._read("table_steps"))

    def late_events(self) -> DataFrame:
        """``(seq, ts, reason, raw)`` of the events that came too late."""
        late = self._read("events").filter("late")
        return late.select("seq", "ts", F.lit("arrived after a later number was applied").alias("reason"), "raw")


class LineStream:
    """A log of raw lines under ``root``, numbered in the order of their arrival.

    A batch's numbers go on from the mark of the batch before, and its part of the log and its own mark are written over
    when it is repeated: a replay changes nothing. Within a batch, files are taken by name.
    """

    def __init__(self, spark: SparkSession, root: str, first: int = 0) -> None:
        self.spark, self.root, self.first = spark, root, first

    def _next(self, batch: int) -> int:
        """The number of a batch's first line."""
        if batch == 0:
            return self.first
        return self.spark.read.schema("next bigint").parquet(f"{self.root}/marks/batch={batch - 1}").first()["next"]

    def _write(self, placed: DataFrame, batch: int) -> None:
        start, path = self._next(batch), f"{self.root}/lines/batch={batch}"
        rows = write_counted(number_placed(placed, start), path)
        mark = self.spark.createDataFrame([(start + rows,)], "next bigint").coalesce(1)
        mark.write.mode("overwrite").parquet(f"{self.root}/marks/batch={batch}")
        remove(self.spark, f"{self.root}/marks/batch={batch - 2}")

    def start(self, lines: DataFrame, **trigger) -> StreamingQuery:
        """``lines`` is a stream of ``sources.events.stream_lines``; ``trigger`` goes to ``writeStream.trigger``."""
        return lines.writeStream.foreachBatch(self._write).option("checkpointLocation", f"{self.root}/stream").trigger(**trigger).start()

    def events(self) -> DataFrame:
        """``events(seq, ts, raw)`` of the finished batches."""
        last = self.spark.read.schema("next bigint, batch bigint").parquet(f"{self.root}/marks").agg(F.max("batch")).first()[0]
        rows = self.spark.read.schema(f"{RAW_EVENTS}, batch bigint").parquet(f"{self.root}/lines")
        return rows.where(F.col("batch") <= (-1 if last is None else last)).drop("batch")


def running_job_runs(events: DataFrame) -> DataFrame:
    """State of every run so far, from a stream (or a batch) of raw events."""
    parsed = good_events(parse_events(events, sql_fallback=False))
    return (
        parsed.select("run_id", "event_type", "event_time", "seq")
        .groupBy("run_id")
        .agg(*run_aggregates(F.col("seq")))
        .select("run_id", "status", "started_at", "finished_at")
    )


class RunStream:
    """Run states kept under ``root`` as partial rows that merge.

    A batch writes one row for each run it touches, over itself when retried; maxima and minima of the rows of a run are
    those of its events, however they are dealt, late or twice. No state is held between batches. Every ``compact``
    batches the rows so far are merged into one a run, and reading takes the last merged table and what came after.
    """

    def __init__(self, spark: SparkSession, root: str, compact: int = 16) -> None:
        self.spark, self.root, self.compact = spark, root, compact

    @staticmethod
    def _partial(events: DataFrame) -> DataFrame:
        """Mergeable form of :func:`run_aggregates`."""
        latest = F.struct("event_time", "seq", "event_type")
        return events.groupBy("run_id").agg(
            F.max(latest).alias("latest"),
            F.max(F.when(F.col("event_type") == "START", F.col("event_time"))).alias("started_at"),
            F.min(F.when(F.col("event_type").isin(FINAL_TYPES), F.col("event_time"))).alias("finished_at"),
        )

    def _merged(self, upto: int) -> DataFrame:
        base = (upto + 1) // self.compact * self.compact - 1  # the last batch that was merged
        paths = [f"{self.root}/merged/batch-{base}"] if base >= 0 else []
        paths += [f"{self.root}/runs/batch-{n}" for n in range(base + 1, upto + 1)]
        return self._join(paths)

    def _join(self, paths: list[str]) -> DataFrame:
        rows = self.spark.read.parquet(*paths)
        return rows.groupBy("run_id").agg(
            F.max("latest").alias("latest"), F.max("started_at").alias("started_at"), F.min("finished_at").alias("finished_at")
        )

    def _write(self, parsed: DataFrame, batch: int) -> None:
        self._partial(parsed).write.mode("overwrite").parquet(f"{self.root}/runs/batch-{batch}")
        if (batch + 1) % self.compact == 0:
            paths = [f"{self.root}/merged/batch-{batch - self.compact}"] if batch >= self.compact else []
            paths += [f"{self.root}/runs/batch-{n}" for n in range(batch - self.compact + 1, batch + 1)]
            self._join(paths).write.mode("overwrite").parquet(f"{self.root}/merged/batch-{batch}")
        self.spark.createDataFrame([(batch,)], "batch bigint").write.mode("overwrite").parquet(f"{self.root}/done/batch-{batch}")

    def start(self, events: DataFrame, **trigger) -> StreamingQuery:
        parsed = good_events(parse_events(events, sql_fallback=False))
        return (
            parsed.select("run_id", "event_type", "event_time", "seq")
            .writeStream.foreachBatch(self._write)
            .option("checkpointLocation", f"{self.root}/stream")
            .trigger(**trigger)
            .start()
        )

    def runs(self) -> DataFrame:
        done = self.spark.read.option("recursiveFileLookup", True).parquet(f"{self.root}/done")
        merged = self._merged(done.agg(F.max("batch")).first()[0])
        return merged.select("run_id", F.col("latest.event_type").alias("status"), "started_at", "finished_at")
