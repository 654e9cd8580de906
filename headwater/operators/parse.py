"""From raw JSON lines to one typed row per event. Map-only: no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from headwater.functions.names import canonical_name, dataset_parts, name_parts, non_empty
from headwater.functions.sqltext import (
    DATASET_ATTRIBUTE,
    is_readable_dialect,
    is_unsupported,
    with_sql_specs,
)
from headwater.schemas import CORRUPT, DATASETS, EVENT_JSON, FIELDS, SPEC, TRANSFORMATION_JSON

# The event types of a run, and those that end it.
EVENT_TYPES = ["START", "COMPLETE", "FAIL", "FAILED", "ABORT", "ABORTED", "OTHER"]
FINAL_TYPES = ["COMPLETE", "FAIL", "FAILED", "ABORT", "ABORTED"]
UNKNOWN_JOB = "unknown_job"

_NO_SPECS = f"array<{SPEC}>"


def _first_facet(*facets: Column) -> Column:
    """The first facet that is there with any content, whether or not it holds text."""
    return F.coalesce(*[F.when(F.size(f) > 0, f) for f in facets])


def _datasets(items: Column) -> Column:
    """Named datasets with their fields. Names are split in a pass of their own, once each."""

    def split(item: Column) -> Column:
        named = F.filter(item["facets"]["schema"]["fields"], lambda f: non_empty(f["name"]).isNotNull())
        return F.struct(name_parts(item["name"]).alias("parts"), named.alias("fields"))

    def typed(item: Column) -> Column:
        namespace, schema, table = dataset_parts(item["parts"])
        fields = F.transform(
            item["fields"],
            lambda f: F.struct(
                f["name"].alias("name"), F.coalesce(non_empty(f["type"]), F.lit("unknown")).alias("data_type")
            ),
        )
        return F.struct(
            F.concat_ws(".", namespace, schema, table).alias("tbl"),
            namespace.alias("namespace"),
            schema.alias("schema_name"),
            table.alias("table_name"),
            F.coalesce(fields, F.array().cast(FIELDS)).alias("fields"),
        )

    return F.coalesce(F.transform(F.transform(items, split), typed), F.array().cast(DATASETS))


def _field_specs(output_table: Column, attribute: Column, input_fields: Column, scope: str, canonical: bool) -> Column:
    """``array<array<spec>>`` of one lineage entry; each transformation object is one specification."""
    usable = F.filter(
        input_fields, lambda f: non_empty(f["name"]).isNotNull() & non_empty(f["field"]).isNotNull()
    )

    def per_input(field: Column) -> Column:
        source = canonical_name(field["name"]) if canonical else field["name"]
        # Parsed in a pass of its own: inside one lambda the JSON would be read once per use.
        objects = F.transform(
            F.filter(field["transformations"], lambda t: F.startswith(t, F.lit("{"))),
            lambda t: F.from_json(t, TRANSFORMATION_JSON),
        )

        def per_transformation(t: Column) -> Column:
            return F.struct(
                F.lit(0).alias("spec_no"),
                output_table.alias("output_table"),
                attribute.alias("output_attribute"),
                source.alias("input_table"),
                field["field"].alias("input_attribute"),
                F.upper(t["type"]).alias("lineage_type"),
                F.upper(t["subtype"]).alias("lineage_subtype"),
                t["description"].alias("lineage_description"),
                t["masking"].alias("lineage_masking"),
                F.lit(scope).alias("lineage_scope"),
                F.lit("openlineage").alias("source"),
                F.lit(None).cast("string").alias("expression"),
            )

        return F.coalesce(F.transform(objects, per_transformation), F.array().cast(_NO_SPECS))

    return F.coalesce(F.flatten(F.transform(usable, per_input)), F.array().cast(_NO_SPECS))


def _facet_specs(outputs: Column, canonical: bool) -> Column:
    def per_output(item: Column) -> Column:
        name = F.coalesce(non_empty(item["name"]), F.lit("unknown_table"))
        table = canonical_name(name) if canonical else name
        facet = item["facets"]["columnLineage"]
        by_field = F.flatten(
            F.transform(
                F.map_entries(facet["fields"]),
                lambda e: _field_specs(table, e["key"], e["value"]["inputFields"], "FIELD", canonical),
            )
        )
        whole = _field_specs(table, F.lit(DATASET_ATTRIBUTE), facet["dataset"], "DATASET", canonical)
        return F.concat(F.coalesce(by_field, F.array().cast(_NO_SPECS)), whole)

    rows = F.flatten(F.transform(outputs, per_output))
    return F.coalesce(F.transform(rows, lambda r, i: r.withField("spec_no", i)), F.array().cast(_NO_SPECS))


def _sql_candidates(facets: Column) -> list[Column]:
    sql = _first_facet(facets["sql"], facets["sqlQuery"])
    code = facets["sourceCode"]
    query = F.coalesce(non_empty(sql["query"]), non_empty(sql["sql"]))
    text = non_empty(code["sourceCode"])
    return [
        F.when(query.isNotNull(), F.struct(query.alias("sql"), sql["dialect"].alias("dialect"))),
        F.when(text.isNotNull(), F.struct(text.alias("sql"), code["language"].alias("dialect"))),
    ]


def parse_events(events: DataFrame, *, sql_fallback: bool = True, canonicalize: bool = False) -> DataFrame:
    """Type every event of ``events(seq, ts, raw)``.

    Bad events keep their row with ``error`` set, so nothing is lost; :func:`good_events`
    and :func:`quarantined` split them. ``specs`` holds the lineage of events that update the
    model: the column-lineage facet, or the SQL text when the facet gives nothing and
    ``sql_fallback`` is on. ``canonicalize`` applies the table naming rule to lineage names too.
    """
    j = F.col("_json")
    opened = events.withColumn("_json", F.from_json("raw", EVENT_JSON, {"columnNameOfCorruptRecord": CORRUPT}))
    time_text = non_empty(j["eventTime"])
    dated = F.when(time_text.rlike(r"^\d{4}-\d{2}-\d{2}"), F.try_to_timestamp(time_text))
    event_type = F.when(j["eventType"].isin(EVENT_TYPES), j["eventType"]).otherwise(F.lit("OTHER"))
    job = j["job"]
    job_sql, event_sql = F.col("_job_sql"), F.col("_event_sql")
    # SQL facets are picked in columns of their own, so the choice is made once per event.
    opened = opened.withColumn("_job_sql", _first_facet(job["facets"]["sql"], job["facets"]["sqlQuery"]))
    opened = opened.withColumn(
        "_event_sql", F.coalesce(*_sql_candidates(j["facets"]), *_sql_candidates(job["facets"]))
    )

    typed = opened.select(
        "seq",
        "ts",
        "raw",
        F.coalesce(non_empty(j["run"]["run_id"]), non_empty(j["run"]["runId"])).alias("run_id"),
        event_type.alias("event_type"),
        F.coalesce(dated, F.when(time_text.isNull(), F.col("ts"))).alias("event_time"),
        F.coalesce(job["namespace"], F.lit("")).alias("job_namespace"),
        F.coalesce(non_empty(job["name"]), F.lit(UNKNOWN_JOB)).alias("job"),
        F.coalesce(non_empty(job_sql["query"]), job_sql["sql"]).alias("sql"),
        job_sql["dialect"].alias("dialect"),
        event_sql["sql"].alias("event_sql"),
        event_sql["dialect"].alias("event_dialect"),
        _datasets(j["inputs"]).alias("inputs"),
        _datasets(j["outputs"]).alias("outputs"),
        j["outputs"].alias("_outputs"),
        (F.col("raw").isNull() | j.isNull() | j[CORRUPT].isNotNull()).alias("_malformed"),
    )
    is_final = F.col("event_type").isin(FINAL_TYPES)
    updates = is_final & (F.size("outputs") > 0)
    repeated = F.exists(
        F.concat("inputs", "outputs"),
        lambda d: F.size(F.array_distinct(d["fields"]["name"])) < F.size(d["fields"]),
    )
    error = (
        F.when(F.col("_malformed"), F.lit("malformed event"))
        .when(F.col("run_id").isNull(), F.lit("missing run id"))
        .when(F.col("event_time").isNull(), F.lit("bad event time"))
        .when(updates & repeated, F.lit("repeated column"))
    )
    facet_specs = _facet_specs(F.col("_outputs"), canonicalize)
    flagged = typed.withColumn("error", error).withColumn("is_final", is_final)
    flagged = flagged.withColumn("updates_model", updates & F.col("error").isNull())
    flagged = flagged.withColumn(
        "_facet_specs", F.when(F.col("updates_model"), facet_specs).otherwise(F.array().cast(_NO_SPECS))
    )
    specs = F.col("_facet_specs")
    if sql_fallback:
        readable = F.col("updates_model") & is_readable_dialect(F.col("event_dialect"))
        wanted = F.when(readable & (F.size(specs) == 0), F.col("event_sql"))
        flagged = with_sql_specs(
            flagged,
            "_sql_specs",
            wanted,
            F.col("event_dialect"),
            F.transform("inputs", lambda d: d["tbl"]),
            F.get("outputs", F.lit(0))["tbl"],
        )
        specs = F.coalesce("_sql_specs", specs)
    return (
        flagged.withColumn("specs", specs)
        .withColumn("spec_count", F.coalesce(F.array_max(F.col("specs")["spec_no"]) + 1, F.lit(0)))
        .drop("_outputs", "_malformed", "_facet_specs", "_sql_specs")
    )


def good_events(parsed: DataFrame) -> DataFrame:
    return parsed.filter(F.col("error").isNull()).drop("error")


def quarantined(parsed: DataFrame) -> DataFrame:
    """Rejected events with the reason; their raw text is kept."""
    return parsed.filter(F.col("error").isNotNull()).select("seq", "ts", F.col("error").alias("reason"), "raw")


def final_events(parsed: DataFrame) -> DataFrame:
    """Events that may update the model: run-ending ones with at least one output."""
    return parsed.filter(F.col("updates_model"))


def envelopes(parsed: DataFrame) -> DataFrame:
    return good_events(parsed).select("seq", "run_id", "event_type", "event_time")


def job_specs(parsed: DataFrame) -> DataFrame:
    return good_events(parsed).select("seq", "job_namespace", "job", "sql", "dialect")


def event_sql(parsed: DataFrame) -> DataFrame:
    """The SQL text an event's lineage would be read from, and whether it can be."""
    return (
        good_events(parsed)
        .filter(F.col("event_sql").isNotNull())
        .select(
            "seq",
            F.col("event_sql").alias("sql"),
            F.col("event_dialect").alias("dialect"),
            is_readable_dialect(F.col("event_dialect")).alias("supported"),
            is_unsupported(F.col("event_sql"), F.col("event_dialect")).alias("outside_subset"),
        )
    )


def dataset_observations(parsed: DataFrame) -> DataFrame:
    """One row per dataset mention, in event order: inputs first, then outputs."""
    def side(role: str):
        return lambda d, i: F.struct(F.lit(role).alias("role"), i.alias("pos"), d.alias("d"))

    sides = [F.transform("inputs", side("input")), F.transform("outputs", side("output"))]
    return (
        good_events(parsed)
        .select("seq", "ts", F.explode(F.concat(*sides)).alias("o"))
        .select("seq", "ts", "o.role", "o.pos", "o.d.*")
    )


def dataset_fields(parsed: DataFrame) -> DataFrame:
    return dataset_observations(parsed).select(
        "seq", "role", "pos", "tbl", F.posexplode("fields").alias("ordinal", "f")
    ).select("seq", "role", "pos", "tbl", "ordinal", F.col("f.name").alias("attr"), F.col("f.data_type").alias("data_type"))


def lineage_rows(parsed: DataFrame, *, source: str | None = None, scope: str | None = None) -> DataFrame:
    """Parsed lineage, one row per (specification, input attribute)."""
    rows = final_events(parsed).select("seq", F.posexplode("specs").alias("pos", "s")).select("seq", "pos", "s.*")
    if source is not None:
        rows = rows.filter(F.col("source") == source)
    if scope is not None:
        rows = rows.filter(F.col("lineage_scope") == scope)
    return rows

