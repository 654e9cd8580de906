"""Nothing to do is a valid input everywhere."""

from __future__ import annotations

from headwater import build_model
from headwater.operators import attributes as at
from headwater.operators import reports
from headwater.operators.parse import parse_events
from headwater.plans.critical import critical_tables
from headwater.streaming.ingest import ModelStream

START = {"eventType": "START", "run": {"runId": "r"}, "job": {"name": "j"}}
ALONE = {"eventType": "COMPLETE", "run": {"runId": "r"}, "job": {"name": "j"}, "outputs": [{"name": "a.b.c"}]}


def test_model_without_updates(events):
    model = build_model(events([START]))
    assert model.event_log().count() == 1
    assert model.table_versions().count() == model.job_versions().count() == model.current_transformations().count() == 0
    assert critical_tables(model).count() == 0
    graph = at.attribute_graph(model.current_transformations(), model.current_attributes())
    assert at.downstream_attributes(graph).count() == at.upstream_attributes(graph).count() == 0
    diff = reports.table_version_diff(reports.consecutive(model.table_versions(), "tbl"), model.attribute_versions())
    assert reports.table_impact(graph, diff).count() == 0


def test_graph_without_edges(events):
    rows = critical_tables(build_model(events([ALONE]))).collect()
    assert [tuple(r) for r in rows] == [("a.b.c", 0.0, 0.0, 0.0, 0.0)]


def test_stream_starting_without_updates(spark, events, tmp_path):
    rows = parse_events(events([START, START, ALONE, START]))
    stream = ModelStream(spark, str(tmp_path))
    stream.apply(rows.filter("seq < 2"), 0)
    stream.apply(rows.filter("seq = 2"), 1)
    stream.apply(rows.filter("seq = 3"), 2)
    assert [(r.tbl, r.version) for r in stream.model().current_tables().collect()] == [("a.b.c", 1)]
    assert stream.model().event_log().count() == 4
