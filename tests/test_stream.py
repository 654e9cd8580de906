"""A stream of micro-batches leaves the model one batch would have built."""

from __future__ import annotations

import random

import pytest
from test_model import random_events

from headwater import build_model
from headwater.operators.parse import good_events, parse_events
from headwater.sources.events import _placed, stream_events, stream_lines
from headwater.streaming.ingest import LineStream, ModelStream, RunStream, running_job_runs


def land(events_df, path, cuts):
    bounds = [0, *cuts, 10**9]
    for low, high in zip(bounds, bounds[1:]):
        events_df.filter(f"seq >= {low} AND seq < {high}").coalesce(1).write.mode("append").parquet(path)


def content(model):
    tables = sorted(map(repr, model.table_versions().collect()))
    jobs = sorted(map(repr, model.job_versions().collect()))
    stored = model.transformation_versions()
    return tables, jobs, sorted(map(repr, stored.select(*sorted(stored.columns)).collect()))


@pytest.mark.parametrize("cuts", [[10, 35]])
def test_stream_equals_batch(spark, events, tmp_path, cuts):
    rows = events(random_events(random.Random(9), 60))
    land(rows, str(tmp_path / "in"), cuts)
    stream = ModelStream(spark, str(tmp_path / "model"), span=20)
    source = stream_events(spark, str(tmp_path / "in"), files_per_batch=1)
    stream.start(source, availableNow=True).awaitTermination()
    batch = build_model(rows)
    assert content(stream.model()) == content(batch)
    # A replayed batch overwrites itself.
    last = len(cuts)
    stream.apply(parse_events(rows.filter(f"seq >= {cuts[-1]}")), last)
    assert content(stream.model()) == content(batch)


def land_lines(rows, path, n):
    for k in range(n):
        part = rows.filter(f"seq % {n} = {k}")  # any order: the numbers are those of arrival
        part.repartitionByRange(2, "seq").sortWithinPartitions("seq").select("raw").write.mode("append").text(path)


def test_raw_lines_are_numbered_as_they_arrive(spark, events, tmp_path):
    rows = events(random_events(random.Random(7), 50))
    land_lines(rows, str(tmp_path / "in"), 3)
    lines = stream_lines(spark, str(tmp_path / "in"), files_per_batch=2)
    log = LineStream(spark, str(tmp_path / "log"), 100)
    log.start(lines, availableNow=True).awaitTermination()
    got = log.events().orderBy("seq").collect()
    raw = {r.seq: r.raw for r in rows.collect()}
    want = [raw[s] for k in range(3) for s in sorted(raw) if s % 3 == k]
    assert [(r.seq, r.raw) for r in got] == [(100 + n, x) for n, x in enumerate(want)]
    # A batch that is repeated takes the same numbers again.
    files = [str(p) for p in sorted((tmp_path / "in").glob("part-*"), key=lambda p: p.stat().st_mtime_ns)]
    log._write(_placed(spark.read.text(files[-2:])), 2)
    assert log.events().orderBy("seq").select("seq", "raw").collect() == [r[::2] for r in got]

    stream = ModelStream(spark, str(tmp_path / "model"), span=20)
    stream.start_lines(lines, availableNow=True).awaitTermination()
    arrived = spark.createDataFrame([(n, r.ts, r.raw) for n, r in enumerate(got)], rows.schema)
    names = lambda m: sorted((r.tbl, r.version, r.from_seq, r.to_seq) for r in m.table_versions().collect())
    assert names(stream.model()) == names(build_model(arrived))


def test_running_runs(spark, events, tmp_path):
    rows = events(random_events(random.Random(4), 60))
    land(rows, str(tmp_path / "in"), [20, 40])
    stream = RunStream(spark, str(tmp_path / "runs"))
    stream.start(stream_events(spark, str(tmp_path / "in"), files_per_batch=1), availableNow=True).awaitTermination()
    assert sorted(stream.runs().collect()) == sorted(running_job_runs(rows).collect())


def test_runs_merge_over_replays_late_rows_and_compaction(spark, events, tmp_path):
    rows = events(random_events(random.Random(5), 60))
    parsed = good_events(parse_events(rows, sql_fallback=False)).select("run_id", "event_type", "event_time", "seq")
    stream = RunStream(spark, str(tmp_path / "runs"), compact=2)
    order = [parsed.filter(f"seq % 5 = {n}") for n in (3, 0, 4, 1, 2)]  # each batch is late for the ones before
    for n, part in enumerate(order):
        stream._write(part, n)
        stream._write(part, n)
    assert sorted(stream.runs().collect()) == sorted(running_job_runs(rows).collect())
    assert (tmp_path / "runs" / "merged" / "batch-3").exists()


def test_late_events_stay_out(spark, events, tmp_path):
    rows = events(random_events(random.Random(6), 60))
    parsed = parse_events(rows)
    stream = ModelStream(spark, str(tmp_path / "model"), span=20)
    stream.apply(parsed.filter("seq < 20 OR seq BETWEEN 30 AND 39"), 0)
    stream.apply(parsed.filter("seq BETWEEN 20 AND 29 OR seq >= 40"), 1)
    assert content(stream.model()) == content(build_model(rows.filter("seq < 20 OR seq >= 30")))
    late = stream.late_events().collect()
    assert sorted(r.seq for r in late) == list(range(20, 30)) and all(r.reason and r.raw for r in late)
    assert all(r.valid_to is None or r.valid_from <= r.valid_to for r in stream.model().table_versions().collect())
    strict = ModelStream(spark, str(tmp_path / "strict"), span=20, late="fail")
    strict.apply(parsed.filter("seq >= 30"), 0)
    with pytest.raises(ValueError, match="29|applied already"):
        strict.apply(parsed.filter("seq < 30"), 1)
    with pytest.raises(ValueError):
        ModelStream(spark, "x", late="drop")
