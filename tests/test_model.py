"""The versioned model: golden counts, and equality with the one-event-at-a-time simulator."""

from __future__ import annotations

import random
import re
from dataclasses import replace

import pytest
from pyspark.sql import functions as F
from simulator import Simulator

from headwater import build_model
from headwater.operators.graph import table_edges
from headwater.operators.runs import table_usage
from headwater.plans.critical import critical_tables, top_critical
from headwater.sources.events import derived_events

# Counts of FIXTURES.md, without the SQL-text fallback.
GOLDEN = {
    "sf0.001": dict(
        events=1000, runs=338, links=324, jobs=15, job_versions=170, current_tables=18, table_versions=121,
        max_version=14, current_attributes=52, set_changes=156, stored=608, actual=58, null_inputs=1,
        used_tables=15, max_usage=33,
        top=[("wh.l0.t0", 8.0625, 0.164706, 33, 0.98), ("wh.l1.t0", 6.291667, 0.176471, 2, 0.702302),
             ("wh.l2.t0", 5.0, 0.164706, 1, 0.596138)],
    ),
    "sf0.01": dict(
        events=10000, runs=3386, links=3255, jobs=150, job_versions=1977, current_tables=177, table_versions=1287,
        max_version=19, current_attributes=518, set_changes=1817, stored=7010, actual=545, null_inputs=13,
        used_tables=133, max_usage=30,
        top=[("wh.l0.t0", 10.251302, 0.047876, 21, 0.809091), ("wh.l0.t1", 7.025391, 0.060232, 12, 0.635386),
             ("wh.l1.t0", 7.428223, 0.027027, 12, 0.537761)],
    ),
}


def test_open_rows_are_those_of_the_history(spark):
    model = build_model(derived_events(spark, "/root/testdata/sf0.001"), span=64)
    rows = lambda df: sorted(map(repr, df.select(sorted(df.columns)).collect()))
    jobs = model.job_versions().select("job", F.col("version").alias("job_version"), F.col("sql").alias("job_sql"))
    in_force = model.transformation_versions().filter("to_seq IS NULL").drop("to_seq", "valid_to").join(jobs, ["job", "job_version"])
    tables = model.table_versions().filter("to_seq IS NULL")
    attributes = model.attribute_versions().filter("to_seq IS NULL").drop("from_seq", "to_seq")
    for kept in (model, replace(model, open={})):
        assert rows(kept.current_tables()) == rows(tables)
        assert rows(kept.current_attributes()) == rows(attributes)
        assert rows(kept.current_transformations()) == rows(in_force)
    # What is in force is read from its own tables: no closed row is scanned, and nothing is joined or moved.
    for view, name in ((model.current_tables(), "open_tables"), (model.current_transformations(), "open_transformations")):
        assert view.inputFiles() and all(f"/{name}/" in f for f in view.inputFiles())
        assert not {"Exchange", "Join"} & set(re.findall("Exchange|Join", view._jdf.queryExecution().executedPlan().toString()))
    edges = table_edges(model.current_transformations(), model.current_attributes())
    assert all("/open_t" in f for f in edges.inputFiles())


@pytest.mark.parametrize("scale,span", [("sf0.001", 64), ("sf0.01", 1_000_000)])
def test_golden_counts(spark, scale, span):
    model = build_model(derived_events(spark, f"/root/testdata/{scale}"), sql_fallback=False, span=span)
    current = model.current_transformations()
    usage = table_usage(model.links, model.job_tables(), model.current_tables())
    top = top_critical(critical_tables(model), 3).collect()
    got = dict(
        events=model.events.count(),
        runs=model.events.select("run_id").distinct().count(),
        links=model.links.count(),
        jobs=model.links.select("job").distinct().count(),
        job_versions=model.job_versions().count(),
        current_tables=model.current_tables().count(),
        table_versions=model.table_versions().count(),
        max_version=model.table_versions().agg(F.max("version")).first()[0],
        current_attributes=model.current_attributes().count(),
        set_changes=model.logs["sets"].filter("changed").count(),
        stored=model.logs["transformations"].count(),
        actual=current.count(),
        null_inputs=current.filter("input_table IS NULL").count(),
        used_tables=usage.count(),
        max_usage=usage.agg(F.max("usage")).first()[0],
        top=[(r.tbl, round(r.influence, 6), round(r.connectivity_loss, 6), int(r.usage), round(r.score, 6)) for r in top],
    )
    assert got == GOLDEN[scale]


def random_events(rng: random.Random, n: int) -> list[dict]:
    """Few names and few columns, so that every rule fires often; one job in three events is 'hot'."""
    names = ["w.a.x", "w.a.y", "w.b.z", "plain", "two.parts", "w.deep.er.name"]

    def schema():
        columns = rng.sample(["c0", "c1", "c2"], rng.randint(0, 3))
        return {"schema": {"fields": [{"name": c, "type": rng.choice(["int", "text"])} for c in columns]}}

    def dataset():
        return {"name": rng.choice(names), "facets": schema() if rng.random() < 0.7 else {}}

    def inputs():
        return [
            {
                "name": rng.choice(names), "field": rng.choice(["c0", "c1", "zz"]),
                "transformations": rng.choice([[], [{"type": "d", "subtype": "identity"}],
                                               ["x", {"type": "I", "masking": "yes"}, {"type": "D", "masking": True}]]),
            }
            for _ in range(rng.randint(0, 2))
        ]

    out = []
    for i in range(n):
        outputs = []
        for _ in range(rng.choice([0, 1, 1, 2])):
            item = dataset()
            if rng.random() < 0.8:
                item["facets"]["columnLineage"] = {
                    "fields": {c: {"inputFields": inputs()} for c in rng.sample(["c0", "c1", "c2"], 2)},
                    "dataset": inputs(),
                }
            outputs.append(item)
        out.append(
            {
                "eventType": rng.choice(["START", "COMPLETE", "COMPLETE", "FAIL", "ABORTED", "complete"]),
                "eventTime": f"2024-01-01T00:00:{i % 60:02d}Z",
                "run": {"runId": f"r{i % 7}"},
                "job": {"name": rng.choice(["hot", "j1", "j2"]),
                        "facets": {"sql": {"query": rng.choice(["q1", "q2"]), "dialect": "none"}}},
                "inputs": [dataset() for _ in range(rng.randint(0, 2))],
                "outputs": outputs,
            }
        )
    # Delivered twice: nothing may change.
    return out + out[-1:]


def sim_rows(sim: Simulator):
    tables = {
        (t, n + 1, tuple(schema)) for t, versions in sim.tables.items() for n, schema in enumerate(versions)
    }
    jobs = {(j, n + 1, sig[0], sig[2]) for j, versions in sim.jobs.items() for n, sig in enumerate(versions)}
    stored = sorted(
        (
            (seq, job, version, number, *(row[0] or (None, None, None)), *row[1], *row[2:])
            for seq, job, version, number, row in sim.stored
        ),
        key=repr,
    )
    return tables, jobs, stored


@pytest.mark.parametrize("seed,span", [(1, 7), (2, 1_000_000)])
def test_equals_sequential_simulator(events, seed, span):
    payloads = random_events(random.Random(seed), 120)
    sim = Simulator()
    for seq, payload in enumerate(payloads):
        sim.apply(seq, payload)
    tables, jobs, stored = sim_rows(sim)
    model = build_model(events(payloads), span=span)
    assert {
        (r.tbl, r.version, tuple((f["name"], f["data_type"]) for f in r.fields)) for r in model.table_versions().collect()
    } == tables
    assert {
        (r.job, r.version, r.sql, tuple((t.role, t.tbl, t.version) for t in r.tables)) for r in model.job_versions().collect()
    } == jobs
    assert {r.seq: (r.job, r.version) for r in model.links.collect()} == sim.links
    got = sorted(
        (
            (r.seq, r.job, r.job_version, r.set_no, r.input_table, r.input_version, r.input_attribute, r.output_table,
             r.output_version, r.output_attribute, r.lineage_type, r.lineage_subtype, r.lineage_description,
             r.lineage_masking, r.lineage_scope)
            for r in model.logs["transformations"].collect()
        ),
        key=repr,
    )
    assert got == stored


def test_validity_follows_the_next_version(events):
    def write(fields):
        return {
            "eventType": "COMPLETE", "run": {"runId": "r"}, "job": {"name": "j"},
            "outputs": [{"name": "a.b.c", "facets": {"schema": {"fields": fields}}}],
        }

    one, two = [{"name": "x", "type": "int"}], [{"name": "y"}, {"name": "x", "type": "int"}]
    model = build_model(events([write([]), write(one), write(two), write(two[::-1]), write([])]))
    rows = model.table_versions().orderBy("version").collect()
    assert [(r.version, r.from_seq, r.to_seq, len(r.fields)) for r in rows] == [
        (1, 0, 1, 0), (2, 1, 2, 1), (3, 2, 3, 2), (4, 3, None, 2),
    ]
    assert rows[2].fields[0].data_type == "unknown"
    at = model.as_of(F.lit("2024-01-01 00:00:01").cast("timestamp"))
    assert [r.version for r in at["tables"].collect()] == [2]
    assert model.table_state("a.b.c", 2).first().to_seq == 2
    assert model.job_history().count() == 4
