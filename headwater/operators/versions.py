"""Versioning steps: tables, jobs and transformation sets in arrival order.

Each step takes this batch's rows plus the state left by earlier batches and returns rows
to append, so one batch over everything and many micro-batches run the same plans.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headwater.functions.chunks import CLOSE, INHERIT, PROBE, SPAN, STATE, Prior, change_history
from headwater.functions.names import signature
from headwater.schemas import FIELDS
from headwater.storage import spread, together

# Stores a DataFrame under a name and returns it read back.
Write = Callable[[str, DataFrame], DataFrame]
# Stores the states of the keys that a batch touched.
Keep = Callable[[str, DataFrame], None]


def _forget(name: str, state: DataFrame) -> None:
    """For a model that no later batch continues."""


TABLE_ORDER = ["seq", "side", "pos"]
JOB_ORDER = ["seq"]

def _both(df: DataFrame, write: Callable[[], DataFrame], keep: Callable[[], None]) -> DataFrame:
    return together(df.sparkSession, write, keep)[0]


# Sides of an event, in the order the event is applied; a snapshot comes after the event whose number it shares.
_INPUT, _OUTPUT, _PROBE, _LISTED, _REMOVED = 0, 1, 2, 3, 4


def table_observations(events: DataFrame) -> DataFrame:
    """One row per dataset of each model-updating event, plus one probe per dataset its lineage names.

    A probe sorts after the datasets and asks which version holds once the event is applied;
    that replaces an interval join against version ranges.
    """

    def mention(side: int):
        return lambda d, i: F.struct(
            F.lit(side).alias("side"),
            i.alias("pos"),
            d["tbl"].alias("tbl"),
            d["namespace"].alias("namespace"),
            d["schema_name"].alias("schema_name"),
            d["fields"].alias("fields"),
        )

    named = F.array_distinct(
        F.concat(F.col("specs")["output_table"], F.filter(F.col("specs")["input_table"], lambda t: t.isNotNull()))
    )
    probes = F.transform(
        named,
        lambda t, i: F.struct(
            F.lit(_PROBE).alias("side"),
            i.alias("pos"),
            t.alias("tbl"),
            F.lit(None).cast("string").alias("namespace"),
            F.lit(None).cast("string").alias("schema_name"),
            F.lit(None).cast(FIELDS).alias("fields"),
        ),
    )
    rows = F.concat(F.transform("inputs", mention(_INPUT)), F.transform("outputs", mention(_OUTPUT)), probes)
    return (
        events.filter("updates_model")
        .select("seq", "ts", F.explode(rows).alias("o"))
        .select("seq", "ts", "o.*")
        .withColumn(
            "kind",
            F.when(F.col("side") == _PROBE, PROBE).when(F.size("fields") > 0, STATE).otherwise(INHERIT),
        )
        .withColumn("sig", F.when(F.col("kind") == STATE, signature(F.col("fields"))))
    )


def snapshot_observations(snapshot: DataFrame, removed: DataFrame, seq: int, ts) -> DataFrame:
    """A schema snapshot as observations: every table it lists, and a closing row per removed one.

    ``snapshot`` has (namespace, schema_name, tbl, fields); ``removed`` has (namespace, schema_name, tbl).
    """
    listed = snapshot.select("tbl", "namespace", "schema_name", "fields").withColumn(
        "kind", F.when(F.size("fields") > 0, STATE).otherwise(INHERIT)
    )
    gone = removed.select(
        "tbl", "namespace", "schema_name", F.lit(None).cast(FIELDS).alias("fields"), F.lit(CLOSE).alias("kind")
    )
    return (
        listed.unionByName(gone)
        .withColumn("seq", F.lit(seq).cast("bigint"))
        .withColumn("ts", F.lit(ts).cast("timestamp"))
        .withColumn("side", F.when(F.col("kind") == CLOSE, _REMOVED).otherwise(_LISTED))
        .withColumn("pos", F.lit(0))
        .withColumn("sig", F.when(F.col("kind") == STATE, signature(F.col("fields"))))
    )


def schema_dictionary(observations: DataFrame) -> DataFrame:
    """Each distinct schema once: deduplicated before the shuffle, so re-deliveries cost nothing."""
    return observations.filter(F.col("kind") == STATE).select("sig", "fields").distinct()


def table_steps(
    write: Write, observations: DataFrame, prior: Prior | None = None, span: int = SPAN, keep: Keep = _forget
) -> DataFrame:
    """Version of every observed table at every observation."""
    with change_history(observations.drop("fields"), ["tbl"], TABLE_ORDER, prior=prior, span=span) as history:
        return _both(history.after, lambda: write("table_steps", history.rows), lambda: keep("table_state", history.after))


def table_starts(steps: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Rows to append to the table log: one per new version, with its ordered attributes."""
    return (
        steps.filter("changed")
        .join(dictionary, "sig", "left")
        .select(
            "tbl",
            "namespace",
            "schema_name",
            "version",
            "seq",
            "ts",
            F.coalesce("fields", F.array().cast(FIELDS)).alias("fields"),
        )
    )


def table_closings(steps: DataFrame) -> DataFrame:
    return steps.filter("closed").select("tbl", "version", "seq", "ts")


def event_tables(steps: DataFrame) -> DataFrame:
    """Per event: the table versions it used and the versions its lineage names resolve to."""
    used = F.when(
        F.col("side") != _PROBE,
        F.struct(
            F.when(F.col("side") == _INPUT, "input").otherwise("output").alias("role"),
            F.col("tbl"),
            F.col("version"),
        ),
    )
    named = F.when(
        (F.col("side") == _PROBE) & F.col("live"), F.struct(F.col("tbl"), F.col("version"))
    )
    return steps.groupBy("seq").agg(
        F.array_sort(F.collect_set(used)).alias("tables"),
        F.array_sort(F.collect_set(named)).alias("refs"),
        F.bool_or("changed").alias("tables_changed"),
    )


def job_observations(events: DataFrame, tables: DataFrame) -> DataFrame:
    """One row per model-updating event, with its job's signature. SQL text travels as a digest."""
    narrow = events.filter("updates_model").select(
        "seq",
        "ts",
        "run_id",
        "event_type",
        "event_time",
        "job",
        "job_namespace",
        "dialect",
        F.when(F.col("sql").isNotNull(), F.sha2("sql", 256)).alias("sql_key"),
        F.when(F.size("specs") > 0, signature(F.col("specs"))).alias("spec_key"),
        "spec_count",
        F.size("inputs").alias("n_inputs"),
        F.size("outputs").alias("n_outputs"),
    )
    return (
        narrow.join(tables, "seq")
        .withColumn("sig", signature(F.col("sql_key"), F.col("dialect"), F.col("tables")))
        .withColumn("kind", F.lit(STATE))
        .withColumn("payload", F.when(F.col("spec_key").isNotNull(), signature(F.col("spec_key"), F.col("refs"))))
    )


def sql_dictionary(events: DataFrame) -> DataFrame:
    return (
        events.filter(F.col("updates_model") & F.col("sql").isNotNull())
        .select(F.sha2("sql", 256).alias("sql_key"), "sql")
        .distinct()
    )


def job_steps(
    write: Write, observations: DataFrame, prior: Prior | None = None, span: int = SPAN, keep: Keep = _forget
) -> DataFrame:
    """Version of the job at every model-updating event."""
    with change_history(observations, ["job"], JOB_ORDER, prior=prior, span=span) as history:
        rows = history.rows.drop("live", "closed")
        return _both(rows, lambda: write("links", rows), lambda: keep("job_state", history.after))


def job_starts(steps: DataFrame, dictionary: DataFrame) -> DataFrame:
    return (
        steps.filter("changed")
        .join(dictionary, "sql_key", "left")
        .select("job", "version", "job_namespace", "sql", "dialect", "seq", "ts", "tables")
    )


def spec_dictionary(events: DataFrame) -> DataFrame:
    return (
        events.filter(F.col("updates_model") & (F.size("specs") > 0))
        .select(signature(F.col("specs")).alias("spec_key"), "specs")
        .distinct()
    )


def resolved_payloads(steps: DataFrame, dictionary: DataFrame, attributes: DataFrame) -> DataFrame:
    """Resolve each distinct (lineage, table versions) pair once, however many events carry it.

    Rows whose output attribute is unknown are dropped; an unknown input stays as null.
    ``attributes`` has (tbl, version, attr).
    """
    distinct = steps.filter(F.col("payload").isNotNull()).select("payload", "spec_key", "refs").distinct()
    rows = (
        distinct.join(dictionary, "spec_key")
        .select("payload", "refs", F.posexplode("specs").alias("pos", "s"))
        .select("payload", "refs", "pos", "s.*")
    )
    version_of = F.map_from_entries("refs")
    rows = (
        rows.withColumn("_versions", version_of)
        .withColumn("output_version", F.try_element_at("_versions", F.col("output_table")))
        .withColumn("input_version", F.try_element_at("_versions", F.col("input_table")))
        .drop("_versions", "refs")
    )
    known = lambda side: attributes.select(
        F.col("tbl").alias(f"{side}_table"),
        F.col("version").alias(f"{side}_version"),
        F.col("attr").alias(f"{side}_attribute"),
    )
    on = lambda side: [f"{side}_table", f"{side}_version", f"{side}_attribute"]
    resolved = (
        rows.join(known("output"), on("output"), "left_semi")
        .join(known("input").withColumn("_found", F.lit(True)), on("input"), "left")
    )
    found = F.col("_found").isNotNull()
    for column in on("input"):
        resolved = resolved.withColumn(column, F.when(found, F.col(column)))
    return resolved.drop("_found")


_SET_FIELDS = [
    "input_table", "input_version", "input_attribute", "output_table", "output_version", "output_attribute",
    "lineage_type", "lineage_subtype", "lineage_description", "lineage_masking", "lineage_scope", "source", "expression",
]


def payload_signatures(resolved: DataFrame) -> DataFrame:
    """Order-free digest of each payload's resolved rows; its size is one event's lineage."""
    return resolved.groupBy("payload").agg(
        signature(F.array_sort(F.collect_list(F.struct(*_SET_FIELDS)))).alias("sig")
    )


def empty_set_signature():
    return signature(F.array())


def set_observations(steps: DataFrame, signatures: DataFrame) -> DataFrame:
    """One row per event that parsed at least one specification, even if none resolved."""
    return (
        steps.filter(F.col("payload").isNotNull())
        .select("seq", "ts", "job", F.col("version").alias("job_version"), "payload")
        .join(signatures, "payload", "left")
        .withColumn("sig", F.coalesce("sig", empty_set_signature()))
        .withColumn("kind", F.lit(STATE))
    )


def set_steps(
    write: Write, observations: DataFrame, prior: Prior | None = None, span: int = SPAN, keep: Keep = _forget
) -> DataFrame:
    """Number of the transformation set in force within the job version at every such event.

    Only a job's newest version can get another set, so its state is one row a job.
    """
    keys, initial = ["job", "job_version"], empty_set_signature()
    with change_history(observations, keys, JOB_ORDER, prior=prior, initial=initial, span=span) as history:
        state = F.struct("job_version", "last_sig", "last_kind", "version")
        left = history.after.groupBy("job").agg(F.max_by(state, "job_version").alias("s")).select("job", "s.*")
        rows = history.rows.withColumnRenamed("version", "set_no").drop("live", "closed")
        return _both(rows, lambda: write("sets", rows), lambda: keep("set_state", left))


#: A table's name without namespace and schema.
TABLE_NAME = "substr(tbl, length(namespace) + length(schema_name) + 3)"


def newest_schemas(starts: DataFrame) -> DataFrame:
    """``(tbl, namespace, schema_name, version, fields)`` of the last version of each table in ``starts``."""
    newest = F.max_by(F.struct("namespace", "schema_name", "version", "fields"), "version")
    return starts.groupBy("tbl").agg(newest.alias("s")).select("tbl", "s.*")


def open_tables(starts: DataFrame, closings: DataFrame) -> DataFrame:
    """The last version of each table in ``starts`` that no row of ``closings`` ends, as its row of the table history.

    A version that has a later one is not open, so the history need not be joined with itself: the last version is found
    with one row a table from each task.
    """
    newest = F.max_by(F.struct("namespace", "schema_name", "version", "seq", "ts", "fields"), "version")
    last = starts.groupBy("tbl").agg(newest.alias("s")).select("tbl", "s.*")
    return last.join(spread(closings.select("tbl", "version")), ["tbl", "version"], "left_anti").select(
        "tbl",
        "namespace",
        "schema_name",
        F.expr(TABLE_NAME).alias("table_name"),
        "version",
        F.col("seq").alias("from_seq"),
        F.col("ts").alias("valid_from"),
        F.lit(None).cast("bigint").alias("to_seq"),
        F.lit(None).cast("timestamp").alias("valid_to"),
        "fields",
    )


def open_transformations(jobs: DataFrame, sets: DataFrame, transformations: DataFrame) -> DataFrame:
    """The rows of ``transformations`` of the last set of each job's last version, with the version's SQL."""
    last = F.max_by(F.struct(F.col("version").alias("job_version"), F.col("sql").alias("job_sql")), "version")
    versions = jobs.groupBy("job").agg(last.alias("v")).select("job", "v.*")
    newest = sets.filter("changed").groupBy("job", "job_version").agg(F.max("set_no").alias("set_no"))
    return (
        transformations.join(spread(versions.join(spread(newest), ["job", "job_version"])), ["job", "job_version", "set_no"])
        .withColumnRenamed("seq", "from_seq")
        .withColumnRenamed("ts", "valid_from")
    )


def transformation_starts(steps: DataFrame, resolved: DataFrame) -> DataFrame:
    """Rows of every newly stored transformation set; (seq, pos) is the row's identity and order."""
    return (
        steps.filter("changed")
        .select("job", "job_version", "set_no", "seq", "ts", "payload")
        .join(resolved, "payload")
        .drop("payload", "spec_no")
    )


