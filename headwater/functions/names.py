"""Column functions for dataset names, type text and connection strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What a dataset without a name is called.
NO_DATASET = "unknown.unknown_table"
NO_TABLE = "unknown_table"
DEFAULT_SCHEMA = "public"


def non_empty(text: Column) -> Column:
    """Null for the empty string: a blank value counts as absent everywhere in event JSON."""
    return F.nullif(text, F.lit(""))


def name_parts(name: Column) -> Column:
    return F.split(F.coalesce(non_empty(name), F.lit(NO_DATASET)), r"\.")


def dataset_parts(parts: Column) -> tuple[Column, Column, Column]:
    """(namespace, schema, table) of a dotted dataset name already split by :func:`name_parts`.

    The schema is the second part only when there are three or more; parts between the
    second and the last are dropped.
    """
    schema = F.when(F.size(parts) > 2, parts[1]).otherwise(F.lit(DEFAULT_SCHEMA))
    return parts[0], schema, F.element_at(parts, -1)


def canonical_name(name: Column) -> Column:
    return F.concat_ws(".", *dataset_parts(name_parts(name)))


def normalize_type(text: Column) -> Column:
    """``numeric (10,2)`` and ``numeric(10,2)`` are the same type."""
    return F.regexp_replace(F.regexp_replace(text, r"^\s+|\s+$", ""), r"\s+\(", "(")


# information_schema type names that carry a length or a precision.
SIZED_TEXT = ["character varying", "character"]
SIZED_TIME = [
    "time without time zone",
    "time with time zone",
    "timestamp without time zone",
    "timestamp with time zone",
]


def sized_type(data_type: Column, length: Column, precision: Column, scale: Column, time_precision: Column) -> Column:
    """Type text of one information_schema row with its length or precision attached."""

    def with_args(*args: Column) -> Column:
        return F.concat(data_type, F.lit("("), F.concat_ws(",", *[a.cast("string") for a in args]), F.lit(")"))

    return normalize_type(
        F.when(data_type.isin(SIZED_TEXT) & length.isNotNull(), with_args(length))
        .when((data_type == "numeric") & precision.isNotNull(), with_args(precision, scale))
        .when(data_type.isin(SIZED_TIME) & time_precision.isNotNull(), with_args(time_precision))
        .otherwise(data_type)
    )


def mask_credentials(dsn: Column) -> Column:
    """Hide the password (or a lone credential) of a connection string."""
    scheme = r"(?s)^((?:(?!://).)*://"
    named = scheme + r"[^:@]*):[^@]*@"
    return F.when(dsn.rlike(named), F.regexp_replace(dsn, named, "$1:***@")).otherwise(
        F.regexp_replace(dsn, scheme + r")[^@]*@", "$1***@")
    )


def signature(*values: Column) -> Column:
    """32-byte digest of a nested value, so that wide schemas and texts never travel with each event."""
    return F.unhex(F.sha2(F.to_json(F.struct(*[v.alias(f"v{i}") for i, v in enumerate(values)])), 256))
