"""Streams and syncs of a data folder read its events; the folder's whole model is not built for them."""

from __future__ import annotations

import datetime

import pytest

from headwater import build_model
from headwater.plans import queries
from headwater.sources.events import derived_events


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("data"))
    start = datetime.datetime(2024, 1, 1)
    kinds = ["view", "purchase", "error", "view"]
    rows = [
        (n, start + datetime.timedelta(minutes=n), (n * 7) % 12, kinds[n % 4], 1.0, f'{{"k": {(n * 13) % 100}}}') for n in range(160)
    ]
    schema = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
    spark.createDataFrame(rows, schema).write.parquet(f"{path}/events.parquet")
    return path


@pytest.fixture
def ask(spark, folder, monkeypatch):
    def built(*_, **__):
        raise AssertionError("the model of all events is built")

    for name in ("build_model", "model_of"):
        monkeypatch.setattr(queries, name, built, raising=False)
    yield lambda name: queries.QUERIES[name](spark, folder)


def rows_of(df):
    return sorted(map(repr, df.collect()))


def test_stream_ingest_tables(spark, folder, ask):
    batch = queries.plain(queries._table_rows(build_model(derived_events(spark, folder)).table_versions()))
    assert rows_of(ask("stream_ingest_tables")) == rows_of(batch) != []


def test_sync_status(ask):
    status = {r["source_id"]: r for r in ask("sync_status").collect()}
    assert sorted(status) == [1, 2, 3, 4]
    assert [status[n]["last_error"] for n in (1, 2, 3, 4)] == [None, None, "no route to host", "Unsupported source_type: oracle"]
    assert status[3]["last_result"] and not status[4]["last_result"]


def test_sync_then_ingest(spark, folder, ask):
    found = ask("sync_then_ingest").collect()
    ingested = build_model(derived_events(spark, folder)).table_versions().collect()
    assert {r["tbl"] for r in ingested} <= {r["tbl"] for r in found}
    assert len(found) > len(ingested)  # the syncs change types, add tables and close some
