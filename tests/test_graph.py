"""Graph operators against direct definitions, on many small random graphs at once.

Each case is a component of one big graph (names carry the case number), so one Spark run
checks all of them.
"""

from __future__ import annotations

import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from headwater.operators import attributes as at
from headwater.operators import graph as g
from headwater.operators import iterate
from headwater.plans.critical import highlighted
from headwater.storage import scratch

CASES = 40


def random_table_graph(rng: random.Random, case: int):
    names = [f"g{case}.t{i}" for i in range(rng.randint(2, 7))]
    edges = {}
    for _ in range(rng.randint(1, 11)):
        edges[rng.choice(names), rng.choice(names)] = rng.choice([0.25, 0.5, 1.0])
    current = [n for n in names if rng.random() < 0.9]
    return current, edges


@pytest.fixture(scope="module")
def cases():
    rng = random.Random(11)
    return [random_table_graph(rng, c) for c in range(CASES)]


@pytest.fixture(scope="module")
def graph(spark, cases):
    edges = [(s, t, w) for _, es in cases for (s, t), w in es.items()]
    current = [(n,) for names, _ in cases for n in names]
    return g.table_graph(
        spark.createDataFrame(edges, "source string, target string, weight double"),
        spark.createDataFrame(current, "tbl string"),
    )


@pytest.fixture(scope="module")
def pairs(graph):
    return g.reachable(graph)


def closure(edges, start):
    """Distance of every table that can be reached, the start itself only through a cycle."""
    dist, level, depth = {}, {start}, 0
    while level:
        depth += 1
        level = {t for s, t in edges if s in level and t not in dist}
        dist.update(dict.fromkeys(level, depth))
    return dist


def test_distances_and_trace(graph, pairs, cases):
    want, traced = {}, set()
    for current, edges in cases:
        for s in current:
            dist = closure(edges, s)
            want |= {(s, t): d for t, d in dist.items() if t != s}
            traced |= {(s, a, b) for a, b in edges if a == s or a in dist}
    got = {(r.source_table, r.target_table): r.depth for r in g.distances(graph, pairs).collect()}
    assert got == want
    assert {tuple(r[c] for c in ("start", "edge_source", "edge_target")) for r in g.downstream_trace(graph, pairs).collect()} == traced
    assert g.reachable_pairs(pairs).first().pairs == len(want)


def test_influence(graph, cases):
    want = {}
    for current, edges in cases:
        for s in current:
            best, frontier = {}, {s: 1.0}
            while frontier:
                reached = defaultdict(float)
                for (a, b), w in edges.items():
                    if a in frontier:
                        reached[b] = max(reached[b], frontier[a] * w)
                frontier = {b: w for b, w in reached.items() if w > best.get(b, 0.0)}
                best |= frontier
            want[s] = sum(best.values())
    got = {r.tbl: r.influence for r in graph.name(g.influence(graph), tbl="source").collect()}
    assert got == pytest.approx(want)


def test_connectivity_loss_equals_removing_each_table(graph, pairs, cases):
    want = {}
    for current, edges in cases:
        count = lambda es: sum(len(set(closure(es, s)) - {s}) for s in current)  # noqa: B023, E731
        for u in current:
            want[u] = count(edges) - count([e for e in edges if e[0] != u])
    got = {r.tbl: r.lost for r in graph.name(g.connectivity_loss(graph, pairs), tbl="id").collect()}
    assert got == want


def lost_by_removal(edges, current):
    """Pairs lost by each table, from dominators that are found by reaching everything without it."""
    follow = defaultdict(set)
    for a, b in edges:
        follow[a].add(b)

    def reached(start, without=None):
        seen, frontier = set(), {start} - {without}
        while frontier:
            frontier = set().union(*(follow[n] for n in frontier)) - seen - {without}
            seen |= frontier
        return seen - {start}

    every = {s: reached(s) for s in current}
    return {u: len(every[u]) + sum(len(r - {u}) - len(reached(s, u)) for s, r in every.items() if s != u and u in r) for u in current}


def test_connectivity_loss_of_hubs_and_deep_chains(spark):
    rng = random.Random(12)
    edges = {(f"chain.t{i}", f"chain.t{i + 1}"): 1.0 for i in range(45)}
    edges |= {("chain.t9", "chain.t12"): 1.0, ("chain.t30", "chain.t29"): 1.0, ("chain.t40", "chain.t3"): 1.0}
    edges |= {(f"hub.in{i}", "hub.middle"): 1.0 for i in range(15)} | {("hub.middle", f"hub.out{i}"): 1.0 for i in range(15)}
    edges |= {(f"hub.out{i}", "hub.end"): 1.0 for i in range(15)} | {("hub.in0", "hub.out3"): 1.0}
    for case in range(4):
        names = [f"dense{case}.t{i}" for i in range(14)]
        edges |= {(rng.choice(names), rng.choice(names)): 1.0 for _ in range(30)}
    current = sorted({x for e in edges for x in e})
    graph = g.table_graph(
        spark.createDataFrame([(a, b, w) for (a, b), w in edges.items()], "source string, target string, weight double"),
        spark.createDataFrame([(n,) for n in current], "tbl string"),
    )
    got = {r.tbl: r.lost for r in graph.name(g.connectivity_loss(graph, g.reachable(graph)), tbl="id").collect()}
    assert got == lost_by_removal(edges, current)


def test_no_loop_carries_an_array(spark, graph, pairs, attribute_graph, monkeypatch):
    seen = {}
    original = iterate.write_counted

    def watched(df, path):
        seen[path] = df.dtypes
        assert "array" not in df._jdf.queryExecution().executedPlan().toString().split("Scan", 1)[0]
        return original(df, path)

    monkeypatch.setattr(iterate, "write_counted", watched)
    g.reachable(graph).count()
    at.upstream_attributes(attribute_graph).count()
    at.impact_closure(attribute_graph, attribute_graph.nodes.select("id")).count()
    assert len(seen) > 6
    with scratch(spark, "test") as put:
        tree, lifts = g.dominator_trees(graph, pairs, put)
        seen |= {n: df.dtypes for n, df in enumerate([tree, *lifts])}
    assert not [t for types in seen.values() for _, t in types if "array" in t]


def test_layers(graph, cases):
    want = {}
    for current, edges in cases:
        roots = [n for n in current if all(t != n for _, t in edges)]
        inside = set(roots).union(*(closure(edges, r) for r in roots))
        looped = {n for n in inside if n in closure(edges, n)}
        behind = looped.union(*(closure(edges, n) for n in looped))

        def longest(n):
            before = [s for s, t in edges if t == n and s in inside]  # noqa: B023
            return 1 + max(map(longest, before)) if before else 0  # noqa: B023

        for n in current:
            want[n] = (None, True) if n in behind else (longest(n) if n in inside else 0, False)
    assert {r.tbl: (r.layer, r.cyclic) for r in g.layers(graph).collect()} == want


def walked_influence(edges, start):
    """The reference walk: strictly better products travel on, until they overflow to infinity."""
    best, queue = {}, [(start, 1.0)]
    while queue:
        at, weight = queue.pop(0)
        for (a, b), w in edges.items():
            if a == at and weight * w > best.get(b, 0.0):
                best[b] = weight * w
                queue.append((b, weight * w))
    return sum(best.values())


def loop(name, n, hot, rest=1.0, tail=True):
    """A cycle of ``n`` tables with one edge of weight ``hot``, a table leading in and one behind."""
    names = [f"{name}.t{i}" for i in range(n)]
    edges = {(names[i], names[(i + 1) % n]): rest for i in range(n)}
    edges[names[0], names[1 % n]] = hot
    if tail:
        edges |= {(f"{name}.in", names[0]): 0.5, (names[-1], f"{name}.out"): 0.5}
    return edges


LOOPS = [
    loop("grow2", 2, 2.0), loop("huge2", 2, 1e60), loop("even2", 2, 2.0, 0.5), loop("shrink2", 2, 2.0, 0.25),
    loop("grow40", 40, 2.0), loop("huge40", 40, 1e60), loop("even40", 40, 2.0**39, 0.5), loop("self", 1, 1.5), loop("selfone", 1, 1.0),
    {**loop("two", 3, 3.0, 0.5), ("two.t1", "two.side"): 4.0, ("two.side", "two.t0"): 0.25},  # one of two cycles grows
    {("far.a", "far.b"): 5.0, ("far.b", "far.c"): 7.0},  # above 1, but no cycle
]


def influence_of(spark, edges):
    names = {x for e in edges for x in e}
    graph = g.table_graph(
        spark.createDataFrame([(a, b, w) for (a, b), w in edges.items()], "source string, target string, weight double"),
        spark.createDataFrame([(n,) for n in names], "tbl string"),
    )
    return {r.tbl: r.influence for r in graph.name(g.influence(graph), tbl="source").collect()}


def test_influence_of_growing_even_and_shrinking_cycles(spark):
    edges = {e: w for case in LOOPS for e, w in case.items()}
    got = influence_of(spark, edges)
    want = {n: walked_influence(case, n) for case in LOOPS for e in case for n in e}
    assert got == pytest.approx(want)
    assert got["grow40.in"] == got["huge2.t0"] == float("inf") and got["grow40.out"] == 0.0 and got["even2.in"] < 10


def test_influence_of_three_thousand_tables(spark):
    cases = [loop(f"c{n}", 3, [2.0, 1e60, 0.5, 1.0][n % 4], 0.75, tail=False) for n in range(1000)]
    got = influence_of(spark, {e: w for case in cases for e, w in case.items()})
    few = {n: walked_influence(case, n) for case in cases[:4] for e in case for n in e}
    assert len(got) == 3000
    assert all(v == pytest.approx(few[f"c{int(n[1:].split('.')[0]) % 4}.{n.split('.')[1]}"]) for n, v in got.items())


@pytest.mark.parametrize("size, components", [(1, 30), (3, 40), (16, 4), (60, 1)])
def test_rounds_are_logarithmic_in_the_largest_component(spark, monkeypatch, size, components):
    arcs, want = [], set()
    for n in range(components):
        gains = [[-1.0, 0.5, 0.0][n % 3] / size] * size
        arcs += [(n * size + i, n * size + (i + 1) % size, gains[i]) for i in range(size)]
        want |= {n * size + i for i in range(size)} if gains[0] > 0 else set()
    written = []
    original = g.materialize
    monkeypatch.setattr(g, "materialize", lambda df, name: written.append(name) or original(df, name))
    got = {r.hot for r in g.endless_gains(spark.createDataFrame(arcs, "hot bigint, next bigint, gain double")).collect()}
    assert got == want
    assert written.count("walks") <= 2 * math.log2(size) + 5


def test_a_cycle_of_one_but_for_rounding_ends(spark):
    edges = {("a", "b"): 3.0, ("b", "a"): 1 / 3 * (1 + 1e-12), ("c", "a"): 1.0}
    assert influence_of(spark, edges) == pytest.approx({"a": 4.0, "b": 1 / 3 + 1, "c": 4.0})


def test_asked_starts_only(spark, graph, pairs, cases):
    asked = spark.createDataFrame([(n,) for names, _ in cases[::3] for n in names[:1]] * 2 + [("no such table",)], "tbl string")
    names = {r.tbl for r in asked.collect()}
    few = g.reachable(graph, asked)
    key = lambda rows: sorted((r.source_table, r.target_table, r.depth) for r in rows)
    every = key(g.distances(graph, pairs).collect())
    assert key(g.distances(graph, few).collect()) == [x for x in every if x[0] in names]
    whole = sorted(tuple(r) for r in g.downstream_trace(graph, pairs).select("start", "edge_source", "edge_target").collect())
    traced = g.downstream_trace(graph, few, asked).select("start", "edge_source", "edge_target").collect()
    assert sorted(map(tuple, traced)) == [x for x in whole if x[0] in names]
    first = spark.read.parquet(sorted(x for x in few.inputFiles() if "round-0/" in x)[0].rsplit("/", 1)[0])
    started = {r.tbl for r in graph.name(first.select("source").distinct(), tbl="source").collect()}
    assert started and started <= names


def test_degrees_and_highlight(spark):
    edges = spark.createDataFrame([("a", "a"), ("a", "b")], "source string, target string")
    rows = g.degrees(edges, spark.createDataFrame([("a",), ("b",), ("c",)], "tbl string")).orderBy("tbl").collect()
    assert [(r.in_count, r.out_count) for r in rows] == [(1, 2), (1, 0), (0, 0)]
    scores = spark.createDataFrame([(f"t{i}", float(i)) for i in range(1, 11)], "tbl string, score double")
    assert {r.score for r in highlighted(scores).collect()} == {9.0, 10.0}


# -- attribute level -----------------------------------------------------------------------

ROW = "seq bigint, pos int, job string, input_table string, input_attribute string, output_table string, output_attribute string"


def random_transformations(rng: random.Random, case: int):
    points = [(f"g{case}.t{rng.randint(0, 3)}", f"c{rng.randint(0, 2)}") for _ in range(rng.randint(3, 8))]
    rows = []
    for n in range(rng.randint(2, 14)):
        rows.append((n // 3, n % 3, f"j{rng.randint(0, 1)}", *rng.choice(points), *rng.choice(points)))
    current = sorted({p for p in points if rng.random() < 0.85})
    changes = [(*rng.choice(points), rng.choice(["ADDED", "MODIFIED"])) for _ in range(rng.randint(1, 4))]
    return rows, current, changes


@pytest.fixture(scope="module")
def attribute_cases():
    rng = random.Random(5)
    return [random_transformations(rng, c) for c in range(CASES)]


@pytest.fixture(scope="module")
def attribute_graph(spark, attribute_cases):
    rows = spark.createDataFrame([r for rows, _, _ in attribute_cases for r in rows], ROW)
    shaped = rows.withColumnRenamed("seq", "from_seq").select(
        "*",
        F.when(F.col("pos") == 0, "IDENTITY").alias("lineage_subtype"),
        F.when(F.col("pos") == 1, F.concat(F.lit("e"), "from_seq")).alias("expression"),
        F.lit("text").alias("lineage_description"),
    )
    current = spark.createDataFrame([p for _, c, _ in attribute_cases for p in c], "tbl string, attr string")
    return at.attribute_graph(shaped, current)


def fifo_impact(rows, changes):
    """The routes in the order a first-in-first-out walk takes them."""
    queue = [((t, a), (t, a), 0) for t, a, _ in changes]
    taken, paths = set(), []
    for source, here, depth in queue:
        for _, _, job, it, ia, ot, oa in sorted(rows):
            if (it, ia) == here and (here, (ot, oa), job) not in taken:
                taken.add((here, (ot, oa), job))
                paths.append((source, (ot, oa), depth + 1))
                queue.append((source, (ot, oa), depth + 1))
    return paths


def test_impact_order_and_attribution(spark, attribute_graph, attribute_cases):
    listed = [
        (case, t, a, kind, place)
        for case, (_, _, changes) in enumerate(attribute_cases)
        for place, (t, a, kind) in enumerate(changes)
    ]
    changes = spark.createDataFrame(listed, "report int, tbl string, attr string, change_type string, place int")
    got = defaultdict(list)
    for r in at.impact_paths(attribute_graph, changes).orderBy("report", "depth", "place", "route").collect():
        got[r.report].append(((r.tbl, r.attr), (r.affected_table, r.affected_attr), r.depth))
    for case, (rows, _, changes) in enumerate(attribute_cases):
        assert got[case] == fifo_impact(rows, changes), case


def test_downstream_roots(attribute_graph, attribute_cases):
    want = defaultdict(set)
    for rows, current, _ in attribute_cases:
        links = {((it, ia), (ot, oa)) for _, _, _, it, ia, ot, oa in rows}
        for root in current:
            own = {p for p in current if p[0] == root[0]}
            seen, frontier = set(), {root}
            while frontier:
                frontier = {b for a, b in links if a in frontier and b not in own and b not in seen}
                seen |= frontier
            for point in seen:
                want[root[0], *point].add(root[1])
    got = {(r.source_table, r.tbl, r.attr): r.parent_attributes for r in at.downstream_attributes(attribute_graph).collect()}
    assert got == {k: sorted(v) for k, v in want.items()}


def test_upstream_history(attribute_graph, attribute_cases):
    want = {}
    for rows, current, _ in attribute_cases:
        for start in current:
            queue, expanded = [(start, 0)], set()
            for here, depth in queue:
                if here in expanded:
                    continue
                expanded.add(here)
                feeding = [r for r in rows if (r[5], r[6]) == here]
                for seq, pos, job, it, ia, _, _ in sorted(feeding, key=lambda r: (r[3], r[2], r[4], r[0], r[1])):
                    note = "" if pos == 0 else (f"e{seq}" if pos == 1 else "text")
                    want.setdefault((*start, it, ia), (depth + 1, note))
                    queue.append(((it, ia), depth + 1))
    got = {
        (r.tbl, r.attr, r.source_table, r.source_attr): (r.depth, r.note)
        for r in at.upstream_attributes(attribute_graph).collect()
    }
    assert got == want
