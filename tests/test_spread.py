"""What grows with the input is shuffled: no join sends it whole through the driver."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from headwater import storage
from headwater.operators import attributes as at
from headwater.operators import graph as g
from headwater.operators import iterate, reports
from headwater.operators.runs import job_runs
from headwater.plans.model import LineageModel
from headwater.plans.queries import LANDED_FILES, LANDED_ROWS, landed_files
from headwater.streaming.state import StateLog


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def plans(monkeypatch):
    """Plans of everything that is written."""
    seen = []
    for module, name in ((iterate, "write_counted"), (storage, "write_table")):
        original = getattr(module, name)

        def watched(df, path, original=original):
            seen.append(plan_of(df))
            return original(df, path)

        monkeypatch.setattr(module, name, watched)
    return seen


def joins(plans):
    text = "\n".join(plans)
    return text.count("SortMergeJoin"), text.count("BroadcastHashJoin")


@pytest.fixture(scope="module")
def graph(spark):
    """A chain, whose shortest paths are its dominator tree, and a ladder, whose tree takes rounds to come to rest."""
    edges = [(f"chain{i}", f"chain{i + 1}") for i in range(6)]
    for i in range(4):
        edges += [(f"a{i}", f"a{i + 1}"), (f"b{i}", f"b{i + 1}"), (f"a{i}", f"b{i + 1}")]
    edges += [("root", "a0"), ("root", "b0"), ("b4", "a2")]
    tables = sorted({x for e in edges for x in e})
    return g.table_graph(
        spark.createDataFrame([(a, b, 0.5) for a, b in edges], "source string, target string, weight double"),
        spark.createDataFrame([(t,) for t in tables], "tbl string"),
    )


def test_table_walks_do_not_broadcast(graph, plans):
    pairs = g.reachable(graph)
    plans += [plan_of(df) for df in (g.distances(graph, pairs), g.downstream_trace(graph, pairs), g.influence(graph))]
    plans.append(plan_of(g.layers(graph)))
    merged, sent = joins(plans)
    assert merged > 10 and sent == 0


def test_connectivity_loss_does_not_broadcast(graph, plans):
    plans.append(plan_of(g.connectivity_loss(graph, g.reachable(graph))))
    merged, sent = joins(plans)
    assert merged > 10 and sent == 0


def test_sources_whose_tree_rests_leave_the_rounds(graph):
    pairs, trees = g.reachable(graph), []
    with storage.scratch(graph.nodes.sparkSession, "test") as put:

        def counted(df, name):
            table = put(df, name)
            if name == "tree":
                trees.append(table.count())
            return table

        tree, _ = g.dominator_trees(graph, pairs, counted)
        assert tree.count() == tree.select("source", "node").distinct().count() == pairs.count()
    assert len(trees) > 1 and trees[0] == pairs.count()
    assert max(trees[1:]) <= pairs.count() - 21  # all pairs of the chain


def test_attribute_walks_do_not_broadcast(spark, plans):
    rows = [(f"t{i}", "c", f"t{i + 1}", "c", f"j{i}", i, 0, "IDENTITY", None, None) for i in range(6)]
    schema = (
        "input_table string, input_attribute string, output_table string, output_attribute string, job string, from_seq bigint, pos int, "
        "lineage_subtype string, expression string, lineage_description string"
    )
    current = spark.createDataFrame([(f"t{i}", "c") for i in range(7)], "tbl string, attr string")
    graph = at.attribute_graph(spark.createDataFrame(rows, schema), current)
    diff = spark.createDataFrame(
        [("t0", 1, 2, "c", "MODIFIED")], "tbl string, old_version bigint, new_version bigint, attr string, change_type string"
    )
    plans += [plan_of(df) for df in (at.downstream_attributes(graph), at.upstream_attributes(graph), reports.table_impact(graph, diff))]
    merged, sent = joins(plans)
    assert merged > 10 and sent == 0


def test_histories_do_not_broadcast(spark):
    empty = lambda schema: spark.createDataFrame([], schema)
    fields = "fields array<struct<name: string, data_type: string>>"
    logs = {
        "tables": empty(f"tbl string, namespace string, schema_name string, version bigint, seq bigint, ts timestamp, {fields}"),
        "closings": empty("tbl string, version bigint, seq bigint, ts timestamp"),
        "jobs": empty(
            "job string, version bigint, job_namespace string, sql string, dialect string, seq bigint, ts timestamp, "
            "tables array<struct<role: string, tbl: string, version: bigint>>"
        ),
        "links": empty("job string, run_id string"),
    }
    # Spark plans tables that it knows to be empty away.
    logs = {name: storage.materialize(df, name) for name, df in logs.items()}
    model = LineageModel(empty("seq bigint"), logs, empty("seq bigint"))
    starts = logs["tables"]
    events = spark.createDataFrame(
        [("r", "START", 1)], "run_id string, event_type string, seq bigint"
    ).withColumn("event_time", F.current_timestamp())
    asked = {
        "attribute_versions": model.attribute_versions(),
        "job_tables": model.job_tables(),
        "table_version_diff": reports.table_version_diff(reports.consecutive(starts, "tbl"), model._attributes(starts)),
        "job_runs": job_runs(events, logs["links"]),
    }
    for name, df in asked.items():
        assert "BroadcastHashJoin" not in plan_of(df) and "SortMergeJoin" in plan_of(df), name


def test_state_that_is_asked_for_is_not_broadcast(spark, tmp_path):
    log = StateLog(spark, str(tmp_path / "s"), ["k"], "k string, v bigint")
    log.write(0, spark.createDataFrame([("a", 1), ("b", 2)], "k string, v bigint"))
    found = log.read(0, spark.createDataFrame([("a",)], "k string"))
    assert "BroadcastHashJoin" not in plan_of(found)
    assert [tuple(r) for r in found.collect()] == [("a", 1)]


def test_landed_ranges_have_more_files_when_they_are_large(spark):
    step = 3 * LANDED_FILES * LANDED_ROWS
    large = spark.range(3 * step).withColumnRenamed("id", "seq")
    assert landed_files(large, step, 3) == 3 * LANDED_FILES
    small = spark.range(300).withColumnRenamed("id", "seq")
    assert landed_files(small, 100, 3) == LANDED_FILES
    # One range without rows, or with few: every range has files that all hold rows.
    assert landed_files(large.where(F.col("seq") < 2 * step), step, 3) == LANDED_FILES
    assert landed_files(large.where(F.col("seq") < 2 * step + 9), step, 3) == LANDED_FILES


def _losses(graph):
    found = g.connectivity_loss(graph, g.reachable(graph)).join(graph.nodes, "id")
    return {r["tbl"]: r["lost"] for r in found.collect()}


def _brute_force(edges):
    ahead = {}
    for a, b in edges:
        ahead.setdefault(a, set()).add(b)

    def reach(start, without=None):
        seen, todo = set(), [start]
        while todo:
            at = todo.pop()
            for b in ahead.get(at, ()) if at != without else ():
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        return seen - {start}

    tables = {x for e in edges for x in e}
    return {v: sum(len(reach(s) - reach(s, v)) for s in tables) for v in tables}


@pytest.mark.parametrize("seed", range(3))
def test_loss_is_the_same_in_rows_and_in_rounds(spark, monkeypatch, seed):
    """Random graphs with circles: all sources in rows, and only those that reach few tables."""
    rng = random.Random(seed)
    edges = {(f"t{rng.randrange(14)}", f"t{rng.randrange(14)}") for _ in range(18 + 4 * seed)} | {("t0", "t0")}
    tables = sorted({x for e in edges for x in e})
    graph = g.table_graph(
        spark.createDataFrame([(a, b, 0.5) for a, b in edges], "source string, target string, weight double"),
        spark.createDataFrame([(t,) for t in tables], "tbl string"),
    )
    expected = _brute_force(edges)
    assert _losses(graph) == expected
    if seed == 0:
        monkeypatch.setattr(g, "ROW_TABLES", 5, raising=False)
        assert _losses(graph) == expected


def test_sources_that_reach_few_tables_need_no_rounds(graph, monkeypatch):
    edges = [(f"chain{i}", f"chain{i + 1}") for i in range(6)] + [("root", "a0"), ("root", "b0"), ("b4", "a2")]
    for i in range(4):
        edges += [(f"a{i}", f"a{i + 1}"), (f"b{i}", f"b{i + 1}"), (f"a{i}", f"b{i + 1}")]

    def rounds(*_):
        raise AssertionError("the trees of small sources are found in rounds")

    monkeypatch.setattr(g, "dominator_trees", rounds)
    assert _losses(graph) == _brute_force(edges)
