"""Table-level graph: edges, reachability, influence, connectivity, layers."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from headwater.operators.iterate import grow
from headwater.storage import materialize, scratch, spread

#: The least relative gain of a product of weights that counts; smaller ones are rounding.
GAIN = 1e-9


def table_edges(transformations: DataFrame, current_attributes: DataFrame) -> DataFrame:
    """Weighted edges between tables.

    Each fed attribute of the target is worth 1, shared evenly by its source tables; the sum is
    divided by the number of the target's current attributes.
    """
    fed = (
        transformations.filter(F.col("input_table").isNotNull())
        .select(F.col("input_table").alias("source"), F.col("output_table").alias("target"), "output_attribute")
        .distinct()
    )
    shares = fed.groupBy("target", "output_attribute").agg((1.0 / F.count(F.lit(1))).alias("share"))
    sizes = current_attributes.groupBy(F.col("tbl").alias("target")).agg(F.count(F.lit(1)).alias("n"))
    return (
        fed.join(spread(shares), ["target", "output_attribute"])
        .groupBy("source", "target")
        .agg(F.sum("share").alias("fed"))
        .join(spread(sizes), "target", "left")
        .select("source", "target", (F.col("fed") / F.greatest(F.lit(1), F.coalesce("n", F.lit(0)))).alias("weight"))
    )


@dataclass
class TableGraph:
    """Edges over numbered tables: the loops shuffle 8-byte numbers instead of names."""

    nodes: DataFrame  # id, tbl, is_current
    edges: DataFrame  # src, dst, weight

    def name(self, df: DataFrame, **columns: str) -> DataFrame:
        """Replace number columns by table names: ``name(df, source="s")`` turns ``s`` into ``source``."""
        for new, old in columns.items():
            names = self.nodes.select(F.col("id").alias(old), F.col("tbl").alias(new))
            df = df.join(spread(names), old).drop(old)
        return df

    def current(self, starts: DataFrame | None = None) -> DataFrame:
        """Current tables; of ``starts(tbl)`` only, where given."""
        nodes = self.nodes.filter("is_current")
        return nodes if starts is None else nodes.join(spread(starts.select("tbl").distinct()), "tbl", "left_semi")


def table_graph(edges: DataFrame, current_tables: DataFrame) -> TableGraph:
    ends = edges.select(F.explode(F.array("source", "target")).alias("tbl")).distinct()
    current = current_tables.select("tbl").withColumn("is_current", F.lit(True))
    nodes = materialize(
        ends.join(spread(current), "tbl", "full_outer").select(
            F.monotonically_increasing_id().alias("id"),
            "tbl",
            F.coalesce("is_current", F.lit(False)).alias("is_current"),
        ),
        "nodes",
    )
    numbered = (
        edges.join(spread(nodes.select(F.col("id").alias("src"), F.col("tbl").alias("source"))), "source")
        .join(spread(nodes.select(F.col("id").alias("dst"), F.col("tbl").alias("target"))), "target")
        .select("src", "dst", "weight")
    )
    return TableGraph(nodes, materialize(numbered, "edges"))


def reachable(graph: TableGraph, starts: DataFrame | None = None) -> DataFrame:
    """(source, node, depth) for every table reachable from a current table, itself excluded.

    With ``starts(tbl)`` only those tables are walked from.
    """
    links = graph.edges.filter(F.col("src") != F.col("dst")).select("src", "dst")
    asked = graph.current(starts).select(F.col("id").alias("src"))
    seed = links.join(spread(asked), "src", "left_semi").select(
        F.col("src").alias("source"), F.col("dst").alias("node"), F.lit(1).alias("depth")
    )

    def step(newest: DataFrame, seen: DataFrame) -> DataFrame:
        return (
            newest.join(spread(links), F.col("node") == F.col("src"))
            .filter(F.col("dst") != F.col("source"))
            .groupBy("source", F.col("dst").alias("node"))
            .agg((F.max("depth") + 1).alias("depth"))  # all of the newest are at one depth
            .join(spread(seen.select("source", "node")), ["source", "node"], "left_anti")
        )

    return grow(seed, step, "reach")


def reachable_pairs(pairs: DataFrame) -> DataFrame:
    return pairs.agg(F.count(F.lit(1)).alias("pairs"))


def distances(graph: TableGraph, pairs: DataFrame) -> DataFrame:
    return graph.name(pairs.select("source", "node", "depth"), source_table="source", target_table="node")


def downstream_trace(graph: TableGraph, pairs: DataFrame, starts: DataFrame | None = None) -> DataFrame:
    """(start, edge_source, edge_target): the edges on or behind each current table that ``pairs`` is walked from."""
    from_start = graph.current(starts).select(F.col("id").alias("source"), F.col("id").alias("node"))
    at = pairs.select("source", "node").unionByName(from_start)
    hops = at.join(spread(graph.edges.select("src", "dst")), F.col("node") == F.col("src")).drop("node")
    return graph.name(hops, start="source", edge_source="src", edge_target="dst")


def _best_products(seed: DataFrame, edges: DataFrame, name: str) -> DataFrame:
    """``(source, node, w)``: the best product of weights on any walk that continues ``seed``'s rows.

    Only gains above ``GAIN`` travel on, so a cycle whose product is 1 but for rounding ends.
    """

    def step(newest: DataFrame, seen: DataFrame) -> DataFrame:
        best = seen.groupBy("source", "node").agg(F.max("w").alias("best"))
        return (
            newest.join(spread(edges), F.col("node") == F.col("src"))
            .groupBy("source", F.col("dst").alias("node"))
            .agg(F.max(F.col("w") * F.col("weight")).alias("w"))
            .join(spread(best), ["source", "node"], "left")
            .filter(F.col("w") > F.coalesce("best", F.lit(0.0)) * (1 + GAIN))
        )

    return grow(seed, step, name).groupBy("source", "node").agg(F.max("w").alias("w"))


def endless_gains(arcs: DataFrame) -> DataFrame:
    """``(hot)``: the nodes of ``arcs(hot, next, gain)`` from which a walk gains for ever.

    Each round joins the best walks so far with each other, so it knows those of twice as many arcs. A node that gains on
    a walk back to itself is endless, and so is what leads to it; both leave. Without such a circle the best walks are
    no longer than their component has nodes, so the rounds are about the logarithm of the largest component, however
    many there are. Rows are pairs of connected arcs above 1, not of tables.
    """
    walks = materialize(arcs.groupBy("hot", "next").agg(F.max("gain").alias("gain"), F.lit(True).alias("better")), "walks")
    found = []
    while not walks.isEmpty():
        circles = walks.filter((F.col("hot") == F.col("next")) & (F.col("gain") > GAIN)).select("hot")
        into = walks.join(spread(circles.withColumnRenamed("hot", "next")), "next", "left_semi").select("hot")
        endless = materialize(circles.unionByName(into).distinct(), "endless")
        found.append(endless)
        left = walks.join(spread(endless), "hot", "left_anti")
        left = left.join(spread(endless.withColumnRenamed("hot", "next")), "next", "left_anti")
        if left.filter("better").isEmpty():
            break
        ahead = left.select(F.col("hot").alias("next"), F.col("next").alias("end"), F.col("gain").alias("more"))
        longer = left.join(spread(ahead), "next").select("hot", F.col("end").alias("next"), (F.col("gain") + F.col("more")).alias("gain"))
        known = left.select("hot", "next", "gain", F.col("gain").alias("known"))
        best = longer.withColumn("known", F.lit(None).cast("double")).unionByName(known).groupBy("hot", "next")
        best = best.agg(F.max("gain").alias("gain"), F.max("known").alias("known"))
        better = F.coalesce(F.col("gain") > F.col("known") + GAIN, F.lit(True))
        walks = materialize(best.select("hot", "next", "gain", better.alias("better")), "walks")
    return reduce(DataFrame.union, found).distinct() if found else arcs.select("hot").filter("false")


def diverging(edges: DataFrame) -> DataFrame:
    """``(id)``: tables from which a walk leads into a cycle whose weights multiply to more than 1.

    Such a cycle has an edge above 1. From the heads of those edges the best products over the other edges, which
    cannot diverge, are walked; between the edges above 1 themselves they make a small graph of gains, in
    logarithms so that nothing overflows (:func:`endless_gains`). Everything upstream of what gains for ever diverges.
    """
    edges = edges.filter(F.col("weight") > 0)
    hot = edges.filter(F.col("weight") > 1).select(
        F.monotonically_increasing_id().alias("hot"), "src", "dst", F.log("weight").alias("log_weight")
    )
    hot = materialize(hot, "hot-edges")
    if hot.isEmpty():
        return hot.select(F.col("src").alias("id"))
    heads = hot.select(F.col("dst").alias("source"), F.col("dst").alias("node"), F.lit(1.0).alias("w")).distinct()
    cold = _best_products(heads, edges.filter(F.col("weight") <= 1), "cold")
    nexts = hot.select(F.col("hot").alias("next"), F.col("src").alias("node"))
    arcs = (
        hot.join(spread(cold.withColumnRenamed("source", "dst")), "dst")
        .filter(F.col("w") > 0)
        .join(spread(nexts), "node")
        .select("hot", "next", (F.col("log_weight") + F.log("w")).alias("gain"))
    )
    arcs = materialize(arcs, "hot-arcs")
    endless = endless_gains(arcs)
    seed = hot.join(spread(endless), "hot").select(F.col("src").alias("id")).distinct()

    def upstream(newest: DataFrame, seen: DataFrame) -> DataFrame:
        return (
            newest.join(spread(edges), F.col("id") == F.col("dst"))
            .select(F.col("src").alias("id"))
            .distinct()
            .join(spread(seen), "id", "left_anti")
        )

    return grow(seed, upstream, "diverging")


def influence(graph: TableGraph) -> DataFrame:
    """(source, influence): sum over reachable tables of the best product of weights on a path.

    A table on a cycle counts itself. A table that leads into a cycle whose weights multiply to more than 1 has
    infinite influence; gains of less than ``GAIN`` are taken for rounding.
    """
    endless = diverging(graph.edges)
    ends = spread(endless.withColumnRenamed("id", "src"))
    starts = graph.current().select(F.col("id").alias("src")).join(ends, "src", "left_anti")
    seed = (
        graph.edges.join(spread(starts), "src", "left_semi")
        .filter(F.col("weight") > 0)
        .select(F.col("src").alias("source"), F.col("dst").alias("node"), F.col("weight").alias("w"))
    )
    sums = _best_products(seed, graph.edges, "influence").groupBy("source").agg(F.sum("w").alias("influence"))
    sums = sums.unionByName(endless.select(F.col("id").alias("source"), F.lit(float("inf")).alias("influence")))
    return (
        graph.current()
        .select(F.col("id").alias("source"))
        .join(spread(sums), "source", "left")
        .select("source", F.coalesce("influence", F.lit(0.0)).alias("influence"))
    )


Put = Callable[[DataFrame, str], DataFrame]


def _lifts(tree: DataFrame, put: Put) -> list[DataFrame]:
    """Jumps of 1, 2, 4, ... steps up from each node of ``tree(source, node, parent)``: ``(source, node, up, hops)``.

    A jump that would leave the tree ends in its source after fewer steps. The last jumps all do, so their ``hops`` are
    the nodes' depths.
    """
    lifts = [tree.select("source", "node", F.col("parent").alias("up"), F.lit(1).cast("bigint").alias("hops"))]
    while not lifts[-1].filter(F.col("up") != F.col("source")).isEmpty():
        again = lifts[-1].select("source", F.col("node").alias("up"), F.col("up").alias("further"), F.col("hops").alias("more"))
        longer = lifts[-1].join(spread(again), ["source", "up"], "left")
        lifts.append(
            put(
                longer.select(
                    "source", "node", F.coalesce("further", "up").alias("up"), (F.col("hops") + F.coalesce("more", F.lit(0))).alias("hops")
                ),
                "lift",
            )
        )
    return lifts


def _common_ancestors(meets: DataFrame, lifts: list[DataFrame], put: Put) -> DataFrame:
    """``(source, node, parent)``: of each node of ``meets(source, node, at)`` the nearest common ancestor of all its ``at``.

    They are lifted to one depth, and then together as long as they stay apart, by jumps of falling length. Places that
    have become one are one row, so a hub's many predecessors soon are few, and a node whose places are one is done.
    """
    depths = lifts[-1].select("source", F.col("node").alias("at"), F.col("hops").alias("depth"))
    group = Window.partitionBy("source", "node")

    def up(rows: DataFrame, lift: DataFrame) -> DataFrame:
        jumps = lift.select("source", F.col("node").alias("at"), "up")
        return rows.join(spread(jumps), ["source", "at"], "left").withColumn("up", F.coalesce("up", "source"))

    rows = meets.join(spread(depths), ["source", "at"], "left").withColumn("depth", F.coalesce("depth", F.lit(0).cast("bigint")))
    rows = rows.withColumn("high", F.col("depth") - F.min("depth").over(group)).select("source", "node", "at", "high")
    for k, lift in enumerate(lifts):
        wanted = F.col("high").bitwiseAND(1 << k) != 0
        rows = up(rows, lift).select("source", "node", F.when(wanted, F.col("up")).otherwise(F.col("at")).alias("at"), "high")
    rows = rows.select("source", "node", "at").distinct()
    rows = put(rows.withColumn("apart", F.min("at").over(group) != F.max("at").over(group)), "level")
    one = rows.filter(~F.col("apart")).select("source", "node", F.col("at").alias("parent"))
    rows = rows.filter("apart").drop("apart")
    still = F.min("up").over(group) != F.max("up").over(group)
    for lift in reversed(lifts):
        moved = up(rows, lift).withColumn("still", still)
        rows = moved.select("source", "node", F.when(F.col("still"), F.col("up")).otherwise(F.col("at")).alias("at")).distinct()
    return one.unionByName(up(rows, lifts[0]).groupBy("source", "node").agg(F.min("up").alias("parent")))


def dominator_trees(graph: TableGraph, pairs: DataFrame, put: Put) -> tuple[DataFrame, list[DataFrame]]:
    """``(source, node, parent, turn)`` for all of ``pairs``, and the jumps in it: ``parent`` is the last table that every
    path from ``source`` to ``node`` goes through before it.

    Begins with the trees of shortest paths. Each round, a node with several predecessors moves below the nearest common
    ancestor of these. Ancestors only ever leave, those on every path never do, and when nothing moves the rest has
    gone. A source whose tree rests is done, the others go on, so rounds soon have few rows; none has more than pairs and
    jumps, however long the paths are. ``turn`` is the round after which a tree rested; of the jumps, those of
    that round and source are the tree's.
    """
    before = put(_edges_on_walks(graph, pairs), "before")
    first = before.groupBy("source", "node").agg(
        F.min(F.struct("depth", "at")).alias("first"), (F.count(F.lit(1)) > 1).alias("several")
    )
    tree = put(first.select("source", "node", F.col("first.at").alias("parent"), "several"), "tree")
    meets = before.join(spread(tree.filter("several")), ["source", "node"], "left_semi").select("source", "node", "at")
    meets, tree = put(meets, "meets"), tree.drop("several")
    rested: list[DataFrame] = []
    jumps: list[list[DataFrame]] = []
    while True:
        turn = F.lit(len(rested)).alias("turn")
        lifts = _lifts(tree, put)
        for k, lift in enumerate(lifts):
            jumps[k:] = [[*(jumps[k] if k < len(jumps) else []), lift.select("*", turn)], *jumps[k + 1 :]]
        moves = _common_ancestors(meets, lifts, put).withColumnRenamed("parent", "new")
        moves = put(tree.join(spread(moves), ["source", "node"]).filter("new <> parent").drop("parent"), "moves")
        restless = moves.select("source").distinct()
        rested.append(tree.join(spread(restless), "source", "left_anti").select("*", turn))
        if moves.isEmpty():
            return reduce(DataFrame.unionByName, rested), [reduce(DataFrame.unionByName, parts) for parts in jumps]
        tree = tree.join(spread(restless), "source", "left_semi").join(spread(moves), ["source", "node"], "left")
        tree = put(tree.select("source", "node", F.coalesce("new", "parent").alias("parent")), "tree")
        meets = put(meets.join(spread(restless), "source", "left_semi"), "meets")


#: A source's walks are held in one row if they have at most so many tables, edges, and tables on shortest paths.
ROW_TABLES, ROW_EDGES, ROW_STEPS = 4096, 32_768, 262_144
#: Edges in a task that works on such rows.
TASK_EDGES = 50_000


def _edges_on_walks(graph: TableGraph, pairs: DataFrame) -> DataFrame:
    """``(source, node, at, depth)``: the edges ``at -> node`` on walks from each source, and the depth of ``at``."""
    links = graph.edges.filter(F.col("src") != F.col("dst")).select("src", "dst")
    roots = pairs.select("source").distinct()
    depths = pairs.select("source", F.col("node").alias("src"), "depth").unionByName(
        roots.select("source", F.col("source").alias("src"), F.lit(0).alias("depth"))
    )
    before = depths.join(spread(links), "src").filter(F.col("dst") != F.col("source"))
    return before.select("source", F.col("dst").alias("node"), F.col("src").alias("at"), "depth")


_CHAIN, _CHAINS = "array<int>", "array<array<int>>"


def _dominators(places: Column) -> Column:
    """Of each table of a source, the places of those on every walk to it, itself included.

    ``places`` has, for the tables by their depth, the places of their predecessors; place 0 is the source, which has none.
    A pass goes over the tables in order and keeps what all predecessors share. The first knows only predecessors that
    stand before, one at least, so no set is longer than the table's shortest path; sets only ever shrink, and once a
    pass changes nothing they are the dominators.
    """
    nothing = F.array().cast(_CHAINS)

    def one_pass(old: Column) -> Column:
        def of_table(done: Column, befores: Column, place: Column) -> Column:
            held = lambda p: F.when(p < F.size(done), F.get(done, p)).otherwise(F.get(old, p))
            known = F.filter(befores, lambda p: (p < F.size(done)) | (p < F.size(old)))
            shared = F.aggregate(
                F.slice(known, 2, F.greatest(F.size(known) - 1, F.lit(0))),
                F.coalesce(held(F.get(known, F.lit(0))), F.array()).cast(_CHAIN),
                lambda kept, p: F.array_intersect(kept, held(p)).cast(_CHAIN),
            )
            return F.array_append(F.filter(shared, lambda p: p != place), place).cast(_CHAIN)

        return F.aggregate(places, nothing, lambda done, befores: F.array_append(done, of_table(done, befores, F.size(done))).cast(_CHAINS))

    length = lambda sets: F.aggregate(sets, F.lit(0).cast("bigint"), lambda n, s: n + F.size(s))
    state = lambda sets, size: F.struct(sets.alias("sets"), size.cast("bigint").alias("size"), F.lit(False).alias("rests"))

    def again(last: Column, _: Column) -> Column:
        def told(sets: Column) -> Column:
            size = length(sets)
            return F.struct(sets.alias("sets"), size.alias("size"), (size == last["size"]).alias("rests"))

        # A lambda over one element gives the pass a name, so it is computed once.
        return F.when(last["rests"], last).otherwise(F.get(F.transform(F.array(one_pass(last["sets"])), told), F.lit(0)))

    return F.aggregate(F.sequence(F.lit(0), F.size(places)), state(nothing, F.lit(-1)), again)["sets"]


def _lost_in_rows(before: DataFrame, tasks: int) -> DataFrame:
    """``(id, lost)``: how many tables lie below each in the dominator trees of the sources of ``before``, a source a row."""
    befores = (
        before.repartition(tasks, "source")  # both groupings find their rows in place
        .groupBy("source", "node")
        .agg((F.min("depth") + 1).alias("depth"), F.collect_list("at").alias("ats"))
        .groupBy("source")
        .agg(F.array_sort(F.collect_list(F.struct("depth", "node", "ats"))).alias("tables"))
    )
    ids = F.concat(F.array("source"), F.col("tables.node"))
    place = lambda t: (F.array_position(F.col("ids"), t) - 1).cast("int")
    numbered = befores.withColumn("ids", ids).select(
        "ids",
        F.concat(F.array(F.array().cast(_CHAIN)), F.transform("tables", lambda t: F.transform(t["ats"], place))).alias("places"),
    )
    above = F.transform(_dominators(F.col("places")), lambda set, place: F.filter(set, lambda p: p != place))
    rows = numbered.select("ids", F.explode(F.flatten(above)).alias("place"))
    return rows.groupBy(F.get("ids", F.col("place")).alias("id")).agg(F.count(F.lit(1)).alias("lost"))


def _lost_in_rounds(graph: TableGraph, pairs: DataFrame, put: Put) -> DataFrame:
    """As :func:`_lost_in_rows`, of the sources of ``pairs``, with no source in one task."""
    tree, lifts = dominator_trees(graph, pairs, put)
    # Nodes less than 1, 2, 4, ... steps below each, itself included.
    sizes = tree.select("turn", "source", "node")
    sizes = sizes.unionByName(sizes.select("turn", "source", F.col("source").alias("node")).distinct())
    sizes = put(sizes.withColumn("size", F.lit(1).cast("bigint")), "sizes")
    for k, lift in enumerate(lifts):
        whole = lift.filter(F.col("hops") == 1 << k).join(spread(sizes), ["turn", "source", "node"])
        below = whole.select("turn", "source", F.col("up").alias("node"), "size")
        sizes = sizes.unionByName(below).groupBy("turn", "source", "node").agg(F.sum("size").alias("size"))
        sizes = put(sizes, "sizes")
    return sizes.groupBy(F.col("node").alias("id")).agg(F.sum(F.col("size") - 1).alias("lost"))


def connectivity_loss(graph: TableGraph, pairs: DataFrame) -> DataFrame:
    """(id, lost, connectivity_loss): connected pairs lost when a table's outgoing edges are removed.

    A pair (s, t) is lost exactly when the table lies on every path from s to t, that is, when t is below it in the
    dominator tree of s. So a table's loss is the sum of the sizes of what is below it in all trees, and no closure is
    computed per removed table. Sources that reach few tables are a row each, all in one job; the trees of the others are
    found in rounds over all of them.
    """
    with scratch(graph.nodes.sparkSession, "dominators") as put:
        before = put(_edges_on_walks(graph, pairs), "before")
        edges = before.groupBy("source").agg(
            F.count(F.lit(1)).alias("edges"), F.count_distinct("node").alias("tables"), F.sum(F.col("depth") + 2).alias("steps")
        )
        large = (F.col("tables") >= ROW_TABLES) | (F.col("edges") > ROW_EDGES) | (F.col("steps") > ROW_STEPS)
        sizes = put(edges.select("source", "edges", large.alias("large")), "walks")
        held = sizes.agg(F.sum(F.when(~F.col("large"), F.col("edges"))).alias("edges"), F.count_if("large").alias("large")).first()
        rounds = sizes.filter("large").select("source")
        small = before.join(spread(rounds), "source", "left_anti") if held["large"] else before
        partitions = int(graph.nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        lost = _lost_in_rows(small, max(partitions, (held["edges"] or 0) // TASK_EDGES))
        if held["large"]:
            lost = lost.unionByName(_lost_in_rounds(graph, pairs.join(spread(rounds), "source", "left_semi"), put))
        counted = materialize(lost.groupBy("id").agg(F.sum("lost").alias("lost")), "lost")
    total = reachable_pairs(pairs).scalar()
    lost = F.coalesce("lost", F.lit(0))
    return (
        graph.current()
        .join(spread(counted), "id", "left")
        .select("id", lost.alias("lost"), F.when(total > 0, lost / total).otherwise(0.0).alias("connectivity_loss"))
    )


def degrees(edges: DataFrame, current_tables: DataFrame) -> DataFrame:
    def count(end: str, name: str) -> DataFrame:
        return edges.groupBy(F.col(end).alias("tbl")).agg(F.count(F.lit(1)).alias(name))

    return (
        current_tables.select("tbl")
        .join(spread(count("target", "in_count")), "tbl", "left")
        .join(spread(count("source", "out_count")), "tbl", "left")
        .na.fill(0, ["in_count", "out_count"])
    )


def layers(graph: TableGraph) -> DataFrame:
    """(tbl, layer, cyclic): longest path from a current table without incoming edges.

    Tables no such path leads to are in layer 0. Tables on a cycle such a path leads into, or
    behind one, have no longest path: they are flagged and have no layer.
    """
    links = graph.edges.select("src", "dst")
    incoming = links.select(F.col("dst").alias("id")).distinct()
    roots = materialize(graph.current().select("id").join(spread(incoming), "id", "left_anti"), "roots")

    def onward(newest: DataFrame, seen: DataFrame) -> DataFrame:
        return (
            newest.join(spread(links), F.col("id") == F.col("src"))
            .select(F.col("dst").alias("id"))
            .distinct()
            .join(spread(seen), "id", "left_anti")
        )

    inside = grow(roots, onward, "rooted")
    rooted = materialize(links.join(spread(inside.withColumnRenamed("id", "src")), "src", "left_semi"), "rooted-edges")
    needed = rooted.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("needed"))

    # A row is one batch of resolved predecessors; a table is placed by the row that completes it.
    def place(newest: DataFrame, seen: DataFrame) -> DataFrame:
        arrived = (
            newest.filter("placed")
            .join(spread(rooted), F.col("id") == F.col("src"))
            .groupBy(F.col("dst").alias("id"))
            .agg(F.count(F.lit(1)).alias("got"), (F.max("layer") + 1).alias("layer"))
        )
        before = seen.groupBy("id").agg(F.sum("got").alias("had"))
        return (
            arrived.join(spread(before), "id", "left")
            .join(spread(needed), "id")
            .withColumn("placed", F.col("got") + F.coalesce("had", F.lit(0)) == F.col("needed"))
        )

    seed = roots.select("id", F.lit(0).cast("bigint").alias("got"), F.lit(0).alias("layer"), F.lit(True).alias("placed"))
    placed = grow(seed, place, "layers").filter("placed").select("id", "layer")
    flagged = inside.withColumn("_rooted", F.lit(True))
    return (
        graph.current()
        .join(spread(placed), "id", "left")
        .join(spread(flagged), "id", "left")
        .withColumn("cyclic", F.col("_rooted").isNotNull() & F.col("layer").isNull())
        .select("tbl", F.when(~F.col("cyclic"), F.coalesce("layer", F.lit(0))).alias("layer"), "cyclic")
    )
