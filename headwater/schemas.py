"""Types of the run-event JSON and of the rows the model is built from."""

from __future__ import annotations

# A map, as any content at all makes a facet count.
_SQL = "map<string, string>"
_FACETS = f"struct<sql: {_SQL}, sqlQuery: {_SQL}, sourceCode: struct<sourceCode: string, language: string>>"
_SCHEMA_FACET = "struct<fields: array<struct<name: string, type: string>>>"
# Transformations stay text until each element is parsed alone: one element that is not
# an object must not void its neighbours.
_INPUT_FIELD = "struct<name: string, field: string, transformations: array<string>>"
_COLUMN_LINEAGE = (
    f"struct<fields: map<string, struct<inputFields: array<{_INPUT_FIELD}>>>, dataset: array<{_INPUT_FIELD}>>"
)

CORRUPT = "_corrupt_record"

EVENT_JSON = f"""
    eventType string,
    eventTime string,
    run struct<run_id: string, runId: string>,
    facets {_FACETS},
    job struct<namespace: string, name: string, facets: {_FACETS}>,
    inputs array<struct<name: string, facets: struct<schema: {_SCHEMA_FACET}>>>,
    outputs array<struct<name: string, facets: struct<schema: {_SCHEMA_FACET}, columnLineage: {_COLUMN_LINEAGE}>>>,
    {CORRUPT} string
"""

TRANSFORMATION_JSON = "type string, subtype string, description string, masking boolean"

FIELDS = "array<struct<name: string, data_type: string>>"

DATASETS = f"array<struct<tbl: string, namespace: string, schema_name: string, table_name: string, fields: {FIELDS}>>"

# One element per (specification, input attribute) pair of an event.
SPEC = (
    "struct<spec_no: int, output_table: string, output_attribute: string, input_table: string, "
    "input_attribute: string, lineage_type: string, lineage_subtype: string, lineage_description: string, "
    "lineage_masking: boolean, lineage_scope: string, source: string, expression: string>"
)

RAW_EVENTS = "seq bigint, ts timestamp, raw string"

COLUMNS = "namespace string, schema_name string, table_name string, column_name string, ordinal int, data_type string"
