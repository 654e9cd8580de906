"""State as merged deltas, and syncs as steps of the model's log."""

from __future__ import annotations

import datetime
import os
import random

import pytest
from test_model import random_events
from test_stream import content
from test_sync import table

from headwater import build_model
from headwater.operators import sync
from headwater.operators.parse import parse_events
from headwater.plans.model import apply_snapshot
from headwater.streaming.ingest import ModelStream
from headwater.streaming.state import StateLog

AT = datetime.datetime(2030, 1, 1, tzinfo=datetime.timezone.utc)


@pytest.mark.parametrize("fan", [2, 3, 4])
def test_runs_cover_all_steps_and_grow_with_the_logarithm(spark, fan):
    log = StateLog(spark, "unused", ["k"], "k string, v bigint", fan=fan)
    for step in range(200):
        runs = log.runs(step)
        assert [a for a, _ in runs] == [0, *[b + 1 for _, b in runs[:-1]]] and runs[-1][1] == step
        sizes = [b - a + 1 for a, b in runs]
        assert sizes == sorted(sizes, reverse=True) and all(sizes.count(s) < fan for s in sizes)
        assert step == 0 or set(runs[:-1]) <= set(log.runs(step - 1)) or runs[-1][0] < runs[-1][1]
    assert log.runs(-1) == []


def test_newest_rows_over_merges_replays_and_questions(spark, tmp_path):
    rng = random.Random(1)
    log = StateLog(spark, str(tmp_path / "state"), ["k"], "k string, v bigint, w array<string>", fan=2, buckets=3)
    want: dict[str, tuple] = {}
    for step in range(9):
        delta = {f"k{rng.randrange(30)}": (rng.randrange(1000), [f"s{step}"] if step % 2 else None) for _ in range(rng.randrange(6))}
        df = spark.createDataFrame([(k, *v) for k, v in delta.items()], "k string, v bigint, w array<string>")
        for _ in range(2 if step in (3, 5, 6) else 1):  # a step that is repeated
            log.write(step, df)
        log.tidy(step)
        want |= delta
        got = {r.k: (r.v, r.w) for r in log.read(step).collect()}
        assert got == want
        asked = spark.createDataFrame([("k1",), ("k2",), ("k2",), ("none",), (None,)], "k string")
        some = {r.k: (r.v, r.w) for r in log.read(step, asked).collect()}
        assert some == {k: v for k, v in want.items() if k in ("k1", "k2")}
        assert {f"run-{a}-{b}" for a, b in log.runs(step)} == set(os.listdir(tmp_path / "state"))
    assert log.read(-1).count() == 0 and log.read(8, asked.filter("false")).count() == 0


def test_a_step_writes_only_what_it_touches(spark, events, tmp_path):
    rows = events(random_events(random.Random(2), 80))
    parsed = parse_events(rows).cache()
    stream = ModelStream(spark, str(tmp_path / "model"), fan=50)
    stream.apply(parsed.filter("seq < 70"), 0)
    stream.apply(parsed.filter("seq >= 70 AND seq < 73"), 1)
    stream.apply(parsed.filter("false"), 2)
    touched = {t.tbl for r in parsed.filter("seq >= 70 AND seq < 73 AND updates_model").collect() for t in [*r.inputs, *r.outputs]}
    for name, keys in (("table_state", touched), ("job_state", None)):
        state = stream.states[name]
        mine = state._rows([(1, 1)]).collect()
        assert len(mine) < state.read(2).count() and state._rows([(2, 2)]).count() == 0
        assert keys is None or {r.tbl for r in mine} >= keys
    stream.apply(parsed.filter("seq >= 73"), 3)
    stream.apply(parsed.filter("seq >= 73"), 3)  # it has its mark: nothing happens
    assert content(stream.model()) == content(build_model(rows))


def test_a_step_that_failed_half_way_is_repeated(spark, events, tmp_path, monkeypatch):
    rows = events(random_events(random.Random(3), 60))
    parsed = parse_events(rows).cache()
    stream = ModelStream(spark, str(tmp_path / "model"), fan=2)
    stream.apply(parsed.filter("seq < 30"), 0)
    monkeypatch.setattr(stream, "_mark", lambda *_: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        stream.apply(parsed.filter("seq >= 30 AND seq < 50"), 1)
    monkeypatch.undo()
    assert content(stream.model()) == content(build_model(rows.filter("seq < 30")))
    stream = ModelStream(spark, str(tmp_path / "model"), fan=2)  # as after a restart
    stream.apply(parsed.filter("seq >= 30 AND seq < 50"), 1)
    stream.apply(parsed.filter("seq >= 50"), 2)
    assert content(stream.model()) == content(build_model(rows))


SAME = [("a", "int"), ("b", "int")]


def written(name, fields=SAME):
    return {
        "eventType": "COMPLETE", "run": {"runId": "r"}, "job": {"name": "j"},
        "outputs": [{"name": name, "facets": {"schema": {"fields": [{"name": c, "type": k} for c, k in fields]}}}],
    }


def test_syncs_between_batches(spark, events, tmp_path):
    first = events([written("db.s.same"), written("db.s.changed"), written("db.s.gone"), written("db.other.x")])
    stream = ModelStream(spark, str(tmp_path / "model"), fan=2)
    stream.apply(parse_events(first), 0)
    snapshot = table(spark, ("same", SAME), ("changed", SAME[::-1]), ("new", SAME), ("empty", []))
    assert stream.sync(7, 1, lambda: snapshot, at=AT)
    assert not stream.sync(7, 1, lambda: 1 / 0)  # recorded, so not run again
    want = apply_snapshot(build_model(first), snapshot, sync.scopes_of(snapshot), 3, AT)
    assert content(stream.model())[0] == content(want)[0]
    run = stream.sync_runs().first()
    assert tuple(run) == (7, 1, AT.replace(tzinfo=None), 4, 3, 1, 1, None)
    assert {r.tbl: r.status for r in stream.sync_items().collect()} == {
        "db.s.same": "unchanged", "db.s.changed": "changed", "db.s.new": "changed", "db.s.empty": "changed", "db.s.gone": "removed",
    }

    # An error leaves a row and nothing else, and the next run starts from there.
    before = content(stream.model())
    broken = table(spark, ("same", [("x", "int")]))
    with pytest.raises(Exception, match="broken"):
        stream.sync(7, 2, lambda: broken.selectExpr("*", "raise_error('broken') q").filter("q IS NULL"), at=AT)
    assert content(stream.model()) == before
    failed = stream.sync_runs().filter("run_no = 2").first()
    assert "broken" in failed.error and failed.changed is None and stream.sync_items().filter("run_no = 2").count() == 0

    # Events go on from what the sync left: a closed table that is written again goes on counting.
    rest = events([written("db.s.skip")] * 4 + [written("db.s.gone"), written("db.s.changed", SAME[::-1]), written("db.s.new")])
    stream.apply(parse_events(rest.filter("seq >= 4")), 1)
    versions = {r.tbl: r.version for r in stream.model().current_tables().collect()}
    assert versions == {"db.s.same": 1, "db.s.changed": 2, "db.s.new": 1, "db.s.empty": 1, "db.s.gone": 2, "db.other.x": 1}
    rows = stream.model().table_versions().filter("tbl = 'db.s.gone'").orderBy("version").collect()
    assert [(r.version, r.from_seq, r.to_seq) for r in rows] == [(1, 2, 3), (2, 4, None)]
    assert stream.sync(7, 3, lambda: snapshot, at=AT + datetime.timedelta(hours=1))
    status = sync.sync_status(stream.sync_results()).first()
    assert status.last_error is None and '"removed_tables":["db.s.gone"]' in status.last_result
    assert '"changed_tables":[]' in status.last_result and '"actual_tables":4' in status.last_result


def test_an_empty_scope_is_closed_and_a_model_may_begin_with_a_sync(spark, events, tmp_path):
    stream = ModelStream(spark, str(tmp_path / "model"))
    assert stream.sync(1, 1, lambda: table(spark, ("t", SAME), ("u", SAME)), at=AT)
    assert {r.tbl for r in stream.model().current_tables().collect()} == {"db.s.t", "db.s.u"}
    scope = spark.createDataFrame([("db", "s")], "namespace string, schema_name string")
    assert stream.sync(1, 2, lambda: table(spark, ("t", [])).filter("false"), scopes=scope, at=AT)
    assert stream.model().current_tables().count() == 0
    stream.apply(parse_events(events([written("db.s.t")])), 0)
    assert [(r.tbl, r.version) for r in stream.model().current_tables().collect()] == [("db.s.t", 2)]
