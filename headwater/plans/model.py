"""The versioned model: append-only Parquet logs and the views over them."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from headwater.functions.chunks import CLOSE, PROBE, SPAN, STATE, Prior
from headwater.operators import versions as v
from headwater.operators.parse import good_events, parse_events
from headwater.operators.sync import sync_removed
from headwater.storage import jit_sized_methods, new_path, spread, together, write_table


@dataclass(frozen=True)
class LineageModel:
    """Logs written by :func:`advance`; everything else is a lazy view over them.

    ``parsed`` is the event store, ``logs`` the append-only change logs, ``steps`` the version of
    every observed table at every observation. ``open`` holds what is in force, ``tables`` and ``transformations``, where
    that is kept as tables of its own; else it is taken from the logs when asked for.
    """

    parsed: DataFrame
    logs: dict[str, DataFrame]
    steps: DataFrame
    open: dict[str, DataFrame] = field(default_factory=dict)

    # -- events ---------------------------------------------------------------------------

    @property
    def events(self) -> DataFrame:
        return good_events(self.parsed)

    @property
    def links(self) -> DataFrame:
        """Model-updating events with the job version each one belongs to."""
        return self.logs["links"]

    def event_log(self) -> DataFrame:
        """Every stored event; events that updated nothing have a null job link."""
        link = self.links.select("seq", F.col("job").alias("job_name"), F.col("version").alias("job_version"))
        return self.events.select("seq", "run_id", "event_type", "event_time", "raw").join(spread(link), "seq", "left")

    def ingest_results(self) -> DataFrame:
        """What each event did: changed the model or not, and how much it carried."""
        sets = self.logs["sets"].select("seq", F.col("changed").alias("set_changed"))
        done = (
            self.links.join(spread(sets), "seq", "left")
            .select(
                "seq",
                (F.col("tables_changed") | F.col("changed") | F.coalesce("set_changed", F.lit(False))).alias(
                    "model_updated"
                ),
                F.col("changed").alias("job_changed"),
                F.col("spec_count").alias("transformations"),
            )
        )
        counted = self.events.select(
            "seq",
            F.when(F.col("is_final"), F.size("inputs")).otherwise(0).alias("inputs"),
            F.when(F.col("is_final"), F.size("outputs")).otherwise(0).alias("outputs"),
        )
        return counted.join(spread(done), "seq", "left").select(
            "seq",
            F.coalesce("model_updated", F.lit(False)).alias("model_updated"),
            F.coalesce("job_changed", F.lit(False)).alias("job_changed"),
            "inputs",
            "outputs",
            F.coalesce("transformations", F.lit(0)).alias("transformations"),
        )

    # -- tables ---------------------------------------------------------------------------

    def table_versions(self) -> DataFrame:
        """Every table version with its validity.

        A version ends where the next number starts, or where a closing row ends it. Joining on
        (table, number) keeps the work spread however many versions one table has.
        """
        starts = self.logs["tables"]
        nexts = starts.select(
            "tbl",
            (F.col("version") - 1).alias("version"),
            F.col("seq").alias("next_seq"),
            F.col("ts").alias("next_ts"),
        )
        closed = self.logs["closings"].select(
            "tbl", "version", F.col("seq").alias("closed_seq"), F.col("ts").alias("closed_ts")
        )
        return (
            starts.join(spread(nexts), ["tbl", "version"], "left")
            .join(spread(closed), ["tbl", "version"], "left")
            .select(
                "tbl",
                "namespace",
                "schema_name",
                F.expr(v.TABLE_NAME).alias("table_name"),
                "version",
                F.col("seq").alias("from_seq"),
                F.col("ts").alias("valid_from"),
                F.coalesce("closed_seq", "next_seq").alias("to_seq"),
                F.coalesce("closed_ts", "next_ts").alias("valid_to"),
                "fields",
            )
        )

    @staticmethod
    def _attributes(tables: DataFrame, *more: str) -> DataFrame:
        fields = tables.select("tbl", "version", F.posexplode("fields").alias("ordinal", "f"), *more)
        return fields.select(
            "tbl", "version", "ordinal", F.col("f.name").alias("attr"), F.col("f.data_type").alias("data_type"), *more
        )

    def attribute_versions(self) -> DataFrame:
        return self._attributes(self.table_versions(), "from_seq", "to_seq")

    def current_tables(self) -> DataFrame:
        return self.open["tables"] if "tables" in self.open else v.open_tables(self.logs["tables"], self.logs["closings"])

    def current_attributes(self) -> DataFrame:
        return self._attributes(self.current_tables())

    def table_history(self) -> DataFrame:
        return self.table_versions().select(
            "tbl", "version", "from_seq", "to_seq", F.size("fields").alias("attribute_count")
        )

    def table_state(self, tbl: str, version: int) -> DataFrame:
        """One version, open or not."""
        return self.table_versions().filter((F.col("tbl") == tbl) & (F.col("version") == version))

    def table_states(self, asked: DataFrame) -> DataFrame:
        """Where the tables of ``asked(tbl)`` stand after all their observations, for one more batch."""
        steps = self.steps.join(asked, "tbl", "left_semi").filter(F.col("kind") != PROBE)
        position, kind = F.struct(*v.TABLE_ORDER), F.col("kind")
        definer = F.when(kind == STATE, F.col("sig")).when(kind == CLOSE, F.unhex(F.lit("")))
        return steps.groupBy("tbl").agg(
            F.max_by(definer, F.when(definer.isNotNull(), position)).alias("last_sig"),
            F.max_by("kind", position).alias("last_kind"),
            F.max("version").alias("version"),
        )

    # -- jobs -----------------------------------------------------------------------------

    def job_versions(self) -> DataFrame:
        starts = self.logs["jobs"]
        nexts = starts.select(
            "job",
            (F.col("version") - 1).alias("version"),
            F.col("seq").alias("to_seq"),
            F.col("ts").alias("valid_to"),
        )
        return starts.join(spread(nexts), ["job", "version"], "left").select(
            "job",
            "version",
            "job_namespace",
            "sql",
            "dialect",
            F.col("seq").alias("from_seq"),
            F.col("ts").alias("valid_from"),
            "to_seq",
            "valid_to",
            "tables",
        )

    def job_tables(self) -> DataFrame:
        """Which table versions each job version reads and writes."""
        return (
            self.job_versions()
            .select("job", "version", F.explode("tables").alias("t"), "from_seq", "to_seq")
            .select(
                "job",
                "version",
                F.col("t.role").alias("role"),
                F.col("t.tbl").alias("tbl"),
                F.col("t.version").alias("tbl_version"),
                "from_seq",
                "to_seq",
            )
        )

    def job_history(self) -> DataFrame:
        """All versions of each job with the number of transformations ever stored for it."""
        stored = (
            self.logs["transformations"]
            .groupBy("job", F.col("job_version").alias("version"))
            .agg(F.count(F.lit(1)).alias("n"))
        )
        return (
            self.job_versions()
            .join(spread(stored), ["job", "version"], "left")
            .select(
                "job", "version", "from_seq", "to_seq", F.coalesce("n", F.lit(0)).alias("transformation_count")
            )
        )

    def job_state(self, job: str, version: int) -> DataFrame:
        return self.job_versions().filter((F.col("job") == job) & (F.col("version") == version))

    def version_transformations(self, versions: DataFrame) -> DataFrame:
        """Every transformation ever stored for the job versions of ``versions(job, version)``."""
        asked = versions.select("job", F.col("version").alias("job_version")).distinct()
        return self.transformation_versions().join(asked, ["job", "job_version"], "left_semi")

    # -- transformations --------------------------------------------------------------------

    def transformation_versions(self) -> DataFrame:
        """Every stored transformation row with the span its set was in force."""
        changes = self.logs["sets"].filter("changed")
        nexts = changes.select(
            "job", "job_version", (F.col("set_no") - 1).alias("set_no"), F.col("seq").alias("set_to"),
            F.col("ts").alias("set_until"),
        )
        ends = self.job_versions().select(
            "job", F.col("version").alias("job_version"), F.col("to_seq").alias("job_to"),
            F.col("valid_to").alias("job_until"),
        )
        return (
            self.logs["transformations"]
            .join(spread(nexts), ["job", "job_version", "set_no"], "left")
            .join(spread(ends), ["job", "job_version"], "left")
            .withColumnRenamed("seq", "from_seq")
            .withColumnRenamed("ts", "valid_from")
            .withColumn("to_seq", F.coalesce("set_to", "job_to"))
            .withColumn("valid_to", F.coalesce("set_until", "job_until"))
            .drop("set_to", "job_to", "set_until", "job_until")
        )

    def current_transformations(self) -> DataFrame:
        """Transformations in force, with the SQL of the job version they belong to."""
        if "transformations" in self.open:
            return self.open["transformations"]
        return v.open_transformations(self.logs["jobs"], self.logs["sets"], self.logs["transformations"])

    # -- point in time ----------------------------------------------------------------------

    def as_of(self, at: Column) -> dict[str, DataFrame]:
        """The model as it stood at a moment, ``valid_from <= at < valid_to``: tables and jobs, the attributes and table
        links of those versions, and the transformations in force."""

        def held(df: DataFrame) -> DataFrame:
            return df.filter((F.col("valid_from") <= at) & (F.col("valid_to").isNull() | (at < F.col("valid_to"))))

        tables, jobs = held(self.table_versions()), held(self.job_versions())
        return {
            "tables": tables,
            "attributes": tables.select(
                "tbl", "version", F.posexplode("fields").alias("ordinal", "f"), "valid_from", "valid_to"
            ).select("tbl", "version", "ordinal", "f.name", "f.data_type", "valid_from", "valid_to")
            .withColumnRenamed("name", "attr"),
            "jobs": jobs,
            "job_tables": jobs.select("job", "version", F.explode("tables").alias("t"), "valid_from", "valid_to").select(
                "job", "version", "t.role", "t.tbl", F.col("t.version").alias("tbl_version"), "valid_from", "valid_to"
            ),
            "transformations": held(self.transformation_versions()),
        }


def advance(
    parsed: DataFrame,
    write: v.Write,
    prior: dict[str, Prior] | None = None,
    span: int = SPAN,
    keep: v.Keep = v._forget,
) -> tuple[dict[str, DataFrame], DataFrame]:
    """Apply a batch of parsed events to the model.

    ``write(name, df)`` stores a DataFrame and returns it read back. ``prior`` is asked for what earlier batches left of
    the keys this one touches, and ``keep(name, df)`` stores what this one leaves of them: the states of tables, of
    their newest schemas, of jobs and of jobs' transformation sets. Returns the rows to append per log and the table steps.
    """
    prior = prior or {}
    events = good_events(parsed)
    observations = v.table_observations(events)
    steps = v.table_steps(write, observations, prior.get("table_state"), span, keep)
    job_rows = v.job_observations(events, v.event_tables(steps))
    starts, closings, links = together(
        parsed.sparkSession,
        lambda: write("tables", v.table_starts(steps, v.schema_dictionary(observations))),
        lambda: write("closings", v.table_closings(steps)),
        lambda: v.job_steps(write, job_rows, prior.get("job_state"), span, keep),
    )

    schemas = starts.select("tbl", "version", "fields")
    if "schema_state" in prior:
        named = links.select(F.explode("refs").alias("t")).select("t.tbl").distinct()
        schemas = schemas.unionByName(prior["schema_state"](named).select("tbl", "version", "fields"))
    attributes = schemas.select("tbl", "version", F.explode("fields.name").alias("attr"))
    jobs, resolved, _ = together(
        parsed.sparkSession,
        lambda: write("jobs", v.job_starts(links, v.sql_dictionary(events))),
        lambda: write("resolved", v.resolved_payloads(links, v.spec_dictionary(events), attributes)),
        lambda: keep("schema_state", v.newest_schemas(starts)),
    )
    set_rows = v.set_observations(links, v.payload_signatures(resolved))
    sets = v.set_steps(write, set_rows, prior.get("set_state"), span, keep)
    transformations = write("transformations", v.transformation_starts(sets, resolved))

    logs = {
        "tables": starts,
        "closings": closings,
        "jobs": jobs,
        "links": links,
        "sets": sets,
        "transformations": transformations,
        "resolved": resolved,
    }
    return logs, steps


def build_model(
    events: DataFrame,
    *,
    sql_fallback: bool = True,
    canonicalize: bool = False,
    span: int = SPAN,
    path: str | None = None,
) -> LineageModel:
    """Build the whole model from ``events(seq, ts, raw)`` in one batch."""
    root = path or new_path(events.sparkSession, "model")
    return model_of(parsed_once(events, f"{root}/events", sql_fallback=sql_fallback, canonicalize=canonicalize), span=span, path=root)


def parsed_once(events: DataFrame, path: str, *, sql_fallback: bool = True, canonicalize: bool = False) -> DataFrame:
    """``events(seq, ts, raw)`` parsed and written to ``path``."""
    with jit_sized_methods(events.sparkSession):
        return write_table(parse_events(events, sql_fallback=sql_fallback, canonicalize=canonicalize), path)


def model_of(parsed: DataFrame, *, span: int = SPAN, path: str | None = None) -> LineageModel:
    """Build the whole model from parsed events in one batch."""
    root = path or new_path(parsed.sparkSession, "model")
    write = lambda name, df: write_table(df, f"{root}/{name}")
    logs, steps = advance(parsed, write, span=span)
    model = LineageModel(parsed, logs, steps)
    tables, transformations = together(
        parsed.sparkSession,
        lambda: write("open_tables", model.current_tables()),
        lambda: write("open_transformations", model.current_transformations()),
    )
    return replace(model, open={"tables": tables, "transformations": transformations})


def sync_tables(
    specs: DataFrame,
    removed: DataFrame,
    seq: int,
    ts,
    write: v.Write,
    prior: Prior,
    keep: v.Keep = v._forget,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Apply a snapshot's tables, and the closing of those it lacks, as observations after the event numbered ``seq``.

    Returns the rows to append to the logs of tables and closings, and the table steps.
    """
    observations = v.snapshot_observations(specs, removed, seq, ts)
    steps = v.table_steps(write, observations, prior, keep=keep)
    starts = write("tables", v.table_starts(steps, v.schema_dictionary(observations)))
    keep("schema_state", v.newest_schemas(starts))
    return starts, write("closings", v.table_closings(steps)), steps


def apply_snapshot(model: LineageModel, specs: DataFrame, scopes: DataFrame, seq: int, ts) -> LineageModel:
    """Sync the model with a warehouse snapshot that arrived at ``seq``.

    Listed tables are upserted and tables of the synced scopes that are not listed are closed, as
    one more batch of observations. A table that comes back later continues its numbering.
    """
    removed = sync_removed(specs, model.current_tables(), scopes)
    root = new_path(model.parsed.sparkSession, "sync")
    write = lambda name, df: write_table(df, f"{root}/{name}")
    starts, closings, steps = sync_tables(specs, removed, seq, ts, write, model.table_states)
    logs = dict(model.logs)
    logs["tables"] = logs["tables"].unionByName(starts)
    logs["closings"] = logs["closings"].unionByName(closings)
    synced = LineageModel(model.parsed, logs, model.steps.unionByName(steps), dict(model.open))
    if "tables" in model.open:
        left = model.open["tables"].join(starts.select("tbl"), "tbl", "left_anti")
        left = left.join(closings.select("tbl", "version"), ["tbl", "version"], "left_anti")
        synced.open["tables"] = write("open_tables", v.open_tables(starts, closings).unionByName(left))
    return synced
