"""Schema snapshots: type text, table folding, differences, closing and return of tables."""

from __future__ import annotations

import json

import duckdb
import pytest
from pyspark.sql import functions as F

from headwater import build_model
from headwater.functions.names import normalize_type
from headwater.operators import sync
from headwater.plans.model import apply_snapshot
from headwater.plans.queries import TABLES
from headwater.sources import columns as cols

INFO = (
    "namespace string, table_schema string, table_name string, column_name string, ordinal_position int, data_type string,"
    " character_maximum_length int, numeric_precision int, numeric_scale int, datetime_precision int"
)


def test_type_text(spark):
    types = {
        ("character varying", 20, None, None, None): "character varying(20)",
        ("character varying", None, None, None, None): "character varying",
        ("numeric", None, 10, 2, None): "numeric(10,2)",
        ("numeric", None, 10, None, None): "numeric(10)",
        ("numeric", None, None, 2, None): "numeric",
        ("timestamp with time zone", None, None, None, 6): "timestamp with time zone(6)",
        ("integer", None, 32, 0, None): "integer",
        (" numeric  (10,2) ", None, None, None, None): "numeric(10,2)",
    }
    rows = spark.createDataFrame([("db", "s", "t", f"c{n}", n, *k) for n, k in enumerate(types)], INFO)
    specs = cols.table_specs(cols.information_schema_columns(rows)).collect()
    assert [s.tbl for s in specs] == ["db.s.t"]
    assert [f.data_type for f in specs[0].fields] == list(types.values())
    assert spark.range(1).select(normalize_type(F.lit("\tarray (x  (y) \n"))).first()[0] == "array(x(y)"


def test_column_lines(spark, tmp_path):
    rows = [
        {"database": "d", "table": "t", "name": "b", "type": "Decimal (1, 2)", "position": 2},
        {"database": "d", "table": "t", "name": "a", "type": "String", "position": 1},
        {"database": "e", "table": "t", "name": "a", "type": "String", "position": 1},
    ]
    path = tmp_path / "columns.json"
    path.write_text("\n".join(map(json.dumps, rows)))
    specs = cols.table_specs(cols.read_column_lines(spark, str(path), "d")).collect()
    assert [(s.tbl, [tuple(f) for f in s.fields]) for s in specs] == [("d.d.t", [("a", "String"), ("b", "Decimal(1, 2)")])]


def test_session_catalog(spark, tmp_path):
    spark.sql("CREATE DATABASE IF NOT EXISTS hw_cat LOCATION '%s'" % (tmp_path / "db"))
    spark.sql("CREATE TABLE hw_cat.t (a INT, `b c` DECIMAL(10,2), p STRING) USING parquet PARTITIONED BY (p)")
    spark.range(1).createOrReplaceTempView("temporary_one")
    rows = cols.read_catalog(spark, "hw_cat").orderBy("ordinal").collect()
    assert [(r.schema_name, r.table_name, r.column_name, r.data_type) for r in rows] == [
        ("hw_cat", "t", "a", "int"), ("hw_cat", "t", "b c", "decimal(10,2)"), ("hw_cat", "t", "p", "string"),
    ]
    spark.sql("DROP TABLE hw_cat.t")


def test_parquet_catalogue_equals_information_schema(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf}/{name}.parquet')")
    kinds = {"BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "DOUBLE": "double", "TIMESTAMP": "timestamp_ntz", "FLOAT[]": "array<float>"}
    want = {
        (t, c, p, kinds[k])
        for t, c, p, k in con.sql("SELECT table_name, column_name, ordinal_position, data_type FROM information_schema.columns").fetchall()
        if t in TABLES
    }
    got = cols.read_parquet_schemas(spark, {t: f"{sf}/{t}.parquet" for t in TABLES}, "w", "w")
    assert {(r.table_name, r.column_name, r.ordinal, r.data_type) for r in got.collect()} == want
    assert len(want) == 63


def table(spark, *rows):
    return spark.createDataFrame(
        [("db", "s", t, f"db.s.{t}", [(c, k) for c, k in fields]) for t, fields in rows],
        "namespace string, schema_name string, table_name string, tbl string, fields array<struct<name: string, data_type: string>>",
    )


@pytest.fixture(scope="module")
def model(events):
    def written(name, fields):
        return {
            "eventType": "COMPLETE", "run": {"runId": "r"}, "job": {"name": "j"},
            "outputs": [{"name": name, "facets": {"schema": {"fields": [{"name": c, "type": k} for c, k in fields]}}}],
        }

    same = [("a", "int"), ("b", "int")]
    return build_model(
        events([written("db.s.same", same), written("db.s.changed", same), written("db.s.gone", same), written("db.other.x", same)])
    )


def test_sync_closes_and_reopens(spark, model):
    same = [("a", "int"), ("b", "int")]
    snapshot = table(spark, ("same", same), ("changed", same[::-1]), ("new", same), ("empty", []))
    scopes = sync.scopes_of(snapshot)
    assert {r.tbl: r.status for r in sync.sync_diff(snapshot, model.current_tables()).collect()} == {
        "db.s.same": "unchanged", "db.s.changed": "changed", "db.s.new": "changed", "db.s.empty": "changed", "db.s.gone": "removed",
    }
    first = apply_snapshot(model, snapshot, scopes, 100, "2030-01-01")
    current = {r.tbl: r.version for r in first.current_tables().collect()}
    assert current == {"db.s.same": 1, "db.s.changed": 2, "db.s.new": 1, "db.s.empty": 1, "db.other.x": 1}
    gone = first.table_versions().filter("tbl = 'db.s.gone'").first()
    assert (gone.version, gone.to_seq) == (1, 100)
    assert first.current_attributes().filter("tbl = 'db.s.gone'").count() == 0
    # An empty listing keeps what is known; a closed table that returns goes on counting.
    back = table(spark, ("gone", same), ("same", []), ("changed", same[::-1]), ("new", same), ("empty", []))
    second = apply_snapshot(first, back, scopes, 200, "2030-02-01")
    assert {r.tbl: r.version for r in second.current_tables().collect()} == {**current, "db.s.gone": 2}
    rows = second.table_versions().filter("tbl = 'db.s.gone'").orderBy("version").collect()
    assert [(r.version, r.from_seq, r.to_seq) for r in rows] == [(1, 2, 100), (2, 200, None)]
    # An empty snapshot of a named scope closes all of it.
    scope = spark.createDataFrame([("db", "s")], "namespace string, schema_name string")
    for synced in (first, second):
        history = synced.table_versions().filter("to_seq IS NULL")
        assert sorted(map(repr, synced.current_tables().collect())) == sorted(map(repr, history.collect()))
    nothing = apply_snapshot(second, table(spark, ("x", [])).filter("false"), scope, 300, "2030-03-01")
    assert [r.tbl for r in nothing.current_tables().collect()] == ["db.other.x"]


def test_sync_status_and_scope(spark):
    runs = spark.createDataFrame(
        [(1, 1, 10, "ok1", None), (1, 2, 20, None, "boom"), (2, 3, 5, None, "bad"), (2, 4, 6, "ok2", None)],
        "source_id int, run_no int, run_at int, result string, error string",
    )
    assert [tuple(r) for r in sync.sync_status(runs).orderBy("source_id").collect()] == [
        (1, 20, 10, "boom", "ok1"), (2, 6, 6, None, "ok2"),
    ]
    sources = spark.createDataFrame(
        [(n, k, "ns", "sc") for n, k in enumerate(["postgresql", "greenplum", "clickhouse", "hadoop_spark", None, "x"])],
        "source_id int, source_type string, namespace string, schema_name string",
    )
    got = [tuple(r)[2:] for r in sync.sync_scope(sources).orderBy("source_id").collect()]
    assert got == [
        ("sc", "ns", "sc", None), ("sc", "ns", "sc", None), ("ns", "ns", "ns", None), ("sc", "sc", "sc", None),
        ("sc", "ns", "sc", None), (None, None, None, "Unsupported source_type: x"),
    ]
