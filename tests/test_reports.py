"""Version differences and impact reports on a hand-written history."""

from __future__ import annotations

import pytest

from headwater import build_model
from headwater.operators import reports
from headwater.operators.attributes import attribute_graph


def step(job, source, target, columns, sql="q", links=None):
    """A finished run of ``job`` copying ``links`` (output column to input column)."""
    links = {c: c for c, _ in columns} if links is None else links
    rows = {
        out: {"inputFields": [{"name": source, "field": col, "transformations": [{"type": "DIRECT", "subtype": "IDENTITY"}]}]}
        for out, col in links.items()
    }
    return {
        "eventType": "COMPLETE", "run": {"runId": "r"},
        "job": {"name": job, "facets": {"sql": {"query": sql, "dialect": "none"}}},
        "inputs": [{"name": source}],
        "outputs": [{"name": target, "facets": {
            "schema": {"fields": [{"name": c, "type": k} for c, k in columns]}, "columnLineage": {"fields": rows}}}],
    }


@pytest.fixture(scope="module")
def model(events):
    xy = [("x", "int"), ("y", "int")]
    return build_model(
        events(
            [
                step("load", "w.raw.r", "w.s.a", xy),
                step("ab", "w.s.a", "w.s.b", xy),
                step("bc", "w.s.b", "w.s.c", xy),
                step("load", "w.raw.r", "w.s.a", [("x", "text"), ("z", "int")]),  # a: x retyped, y gone, z new
                step("bc", "w.s.b", "w.s.c", xy, sql="q2"),  # only the text differs
                step("bc", "w.s.b", "w.s.c", xy, sql="q2", links={"x": "y", "y": "y"}),
                step("bc", "w.s.b", "w.s.c", xy, sql="q3", links={"x": "y"}),
            ]
        )
    )


@pytest.fixture(scope="module")
def graph(model):
    return attribute_graph(model.current_transformations(), model.current_attributes())


def test_table_report(model, graph):
    pairs = reports.consecutive(model.table_versions(), "tbl").filter("tbl = 'w.s.a'")
    diff = reports.table_version_diff(pairs, model.attribute_versions())
    assert {(r.attr, r.change_type, r.old_type, r.new_type) for r in diff.collect()} == {
        ("x", "MODIFIED", "int", "text"), ("y", "REMOVED", "int", None), ("z", "ADDED", None, "int"),
    }
    rows = reports.sorted_report(reports.table_impact(graph, diff), "tbl").collect()
    # The old attribute versions still carry lineage by name, so y's removal reaches b and c.
    assert [(r.affected_table, r.distance, r.affected_attributes, [tuple(a) for a in r.attributes]) for r in rows] == [
        ("w.s.b", 1, 2, [("x", "MODIFIED"), ("y", "REMOVED")]),
        ("w.s.c", 2, 1, [("x", "REMOVED")]),
    ]


def test_job_report(model, graph):
    pairs = reports.consecutive(model.logs["jobs"], "job").filter("job = 'bc'")
    rows = model.logs["transformations"]
    diff = reports.job_version_diff(pairs, rows)
    logic = reports.job_logic_changed(pairs, diff, model.logs["jobs"], rows)
    # Version 2 kept every row of both its sets, so only its text differs from version 1 for y -> y and x -> x,
    # and y -> x is new; version 3 has y -> x alone.
    assert {(r.new_version, r.input_attribute, r.output_attribute, r.change_type) for r in diff.collect()} == {
        (2, "y", "x", "ADDED"), (3, "x", "x", "REMOVED"), (3, "y", "y", "REMOVED"),
    }
    assert logic.count() == 0
    report = reports.sorted_report(reports.job_impact(graph, diff, logic), "job").collect()
    assert [(r.new_version, r.affected_table, r.distance, [tuple(a) for a in r.attributes]) for r in report] == [
        (2, "w.s.c", 0, [("x", "ADDED")]),
        (3, "w.s.c", 0, [("x", "REMOVED"), ("y", "REMOVED")]),
    ]


def test_logic_change_only(events):
    xy = [("x", "int"), ("y", "int")]
    model = build_model(events([step("j", "w.s.a", "w.s.b", xy), step("j", "w.s.a", "w.s.b", xy, sql="other")]))
    pairs = reports.consecutive(model.logs["jobs"], "job")
    rows = model.logs["transformations"]
    diff = reports.job_version_diff(pairs, rows)
    logic = reports.job_logic_changed(pairs, diff, model.logs["jobs"], rows)
    assert diff.count() == 0
    assert {(r.output_attribute, r.change_type) for r in logic.collect()} == {("x", "LOGIC_CHANGED"), ("y", "LOGIC_CHANGED")}


def test_bad_requests(spark, model):
    versions = model.table_versions()
    shape = "tbl string, old_version bigint, new_version bigint"
    with pytest.raises(ValueError):
        reports.check_pairs(spark.createDataFrame([("w.s.a", 1, 1)], shape), versions, "tbl")
    with pytest.raises(LookupError):
        reports.check_pairs(spark.createDataFrame([("w.s.a", 1, 9)], shape), versions, "tbl")
    reports.check_pairs(spark.createDataFrame([("w.s.a", 2, 1)], shape), versions, "tbl")


def test_json_sink(model, tmp_path):
    from headwater.sources.sinks import write_json

    write_json(model.current_tables().select("tbl", "version", "to_seq"), str(tmp_path / "out"))
    lines = [line for f in (tmp_path / "out").glob("part-*") for line in f.read_text().splitlines()]
    assert sorted(lines)[0] == '{"tbl":"w.raw.r","version":1,"to_seq":null}'
