"""Attribute-level graph: downstream roots, upstream history, change impact."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from headwater.operators.iterate import grow
from headwater.storage import materialize, spread


@dataclass
class AttributeGraph:
    """Current transformations over numbered attributes.

    ``routes`` keeps one row per transformation: (src, dst, job, input_table, input_attribute,
    seq, pos, note). ``nodes`` has (id, tbl, attr, is_current).
    """

    nodes: DataFrame
    routes: DataFrame

    def current(self, starts: DataFrame | None = None) -> DataFrame:
        """Current attributes; those named by ``starts``, by table or by table and attribute, where given."""
        nodes = self.nodes.filter("is_current")
        if starts is None:
            return nodes
        keys = [c for c in ("tbl", "attr") if c in starts.columns]
        return nodes.join(spread(starts.select(*keys).distinct()), keys, "left_semi")

    def name(self, df: DataFrame, column: str, tbl: str, attr: str) -> DataFrame:
        names = self.nodes.select(F.col("id").alias(column), F.col("tbl").alias(tbl), F.col("attr").alias(attr))
        return df.join(spread(names), column).drop(column)


def attribute_graph(transformations: DataFrame, current_attributes: DataFrame) -> AttributeGraph:
    used = transformations.filter(F.col("input_table").isNotNull())
    point = lambda side: F.struct(
        F.col(f"{side}_table").alias("tbl"), F.col(f"{side}_attribute").alias("attr")
    )
    ends = used.select(F.explode(F.array(point("input"), point("output"))).alias("p")).select("p.*").distinct()
    current = current_attributes.select("tbl", "attr").withColumn("is_current", F.lit(True))
    nodes = materialize(
        ends.join(spread(current), ["tbl", "attr"], "full_outer").select(
            F.monotonically_increasing_id().alias("id"),
            "tbl",
            "attr",
            F.coalesce("is_current", F.lit(False)).alias("is_current"),
        ),
        "attributes",
    )
    end = lambda side, name: nodes.select(
        F.col("id").alias(name), F.col("tbl").alias(f"{side}_table"), F.col("attr").alias(f"{side}_attribute")
    )
    # What a reader is shown for the step: nothing for a plain copy.
    note = F.when(F.upper("lineage_subtype") == "IDENTITY", F.lit("")).otherwise(
        F.coalesce(F.nullif("expression", F.lit("")), F.col("lineage_description"), F.lit(""))
    )
    routes = (
        used.withColumn("note", note)
        .join(spread(end("input", "src")), ["input_table", "input_attribute"])
        .join(spread(end("output", "dst")), ["output_table", "output_attribute"])
        .select("src", "dst", "job", "input_table", "input_attribute", F.col("from_seq").alias("seq"), "pos", "note")
    )
    return AttributeGraph(nodes, materialize(routes, "routes"))


def downstream_attributes(graph: AttributeGraph, starts: DataFrame | None = None) -> DataFrame:
    """For every table, or those of ``starts(tbl)``: the attributes it feeds, each with the table's own at the root.

    The walk never enters a current attribute of the table it started from.
    """
    owner = graph.nodes.select(F.col("id").alias("dst"), F.col("tbl").alias("dst_tbl"), "is_current")
    links = materialize(graph.routes.select("src", "dst").distinct().join(spread(owner), "dst"), "links")
    outside = ~(F.col("is_current") & (F.col("dst_tbl") == F.col("root_tbl")))
    roots = graph.current(starts).select(F.col("id").alias("root"), F.col("tbl").alias("root_tbl"))
    seed = (
        roots.join(spread(links), F.col("root") == F.col("src"))
        .filter(outside)
        .select("root", "root_tbl", F.col("dst").alias("node"))
    )

    def step(newest: DataFrame, seen: DataFrame) -> DataFrame:
        return (
            newest.join(spread(links), F.col("node") == F.col("src"))
            .filter(outside)
            .select("root", "root_tbl", F.col("dst").alias("node"))
            .distinct()
            .join(spread(seen.select("root", "node")), ["root", "node"], "left_anti")
        )

    walked = grow(seed, step, "downstream")
    named = graph.name(graph.name(walked, "node", "tbl", "attr"), "root", "source_table", "root_attr")
    return named.groupBy("source_table", "tbl", "attr").agg(
        F.array_sort(F.collect_set("root_attr")).alias("parent_attributes")
    )


def _rank(start: str, order: Column) -> Column:
    """Places of the rows of a walk's newest round, in each start's own order: a number, however long the walk is."""
    return F.row_number().over(Window.partitionBy(start).orderBy(order))


def upstream_attributes(graph: AttributeGraph, starts: DataFrame | None = None) -> DataFrame:
    """For every current attribute, or those of ``starts(tbl, attr)``: where it came from, nearest first, with the step's text.

    Each ancestor is credited to the step a breadth-first walk finds first. The walk's order among what it finds at one
    depth is a rank: first that of the attribute it comes from, then the step. On a cycle an attribute is its own
    ancestor.
    """
    element = F.struct("input_table", "job", "input_attribute", "seq", "pos")
    steps = materialize(
        graph.routes.groupBy("dst", "src").agg(F.min(F.struct(element.alias("k"), F.col("note").alias("note"))).alias("s")),
        "steps-up",
    )
    asked = graph.current(starts).select(F.col("id").alias("dst"))
    seed = steps.join(spread(asked), "dst", "left_semi").select(
        F.col("dst").alias("start"),
        F.col("src").alias("node"),
        F.lit(1).alias("depth"),
        _rank("dst", F.col("s.k")).alias("rank"),
        F.col("s.note").alias("note"),
    )

    def step(newest: DataFrame, seen: DataFrame) -> DataFrame:
        found = F.struct("rank", "s.k", F.col("s.note").alias("note"))
        return (
            newest.drop("note")
            .filter(F.col("node") != F.col("start"))
            .join(spread(steps), F.col("node") == F.col("dst"))
            .groupBy("start", F.col("src").alias("node"))
            .agg(F.min(found).alias("f"), F.min(F.col("depth") + 1).alias("depth"))
            .join(spread(seen.select("start", "node")), ["start", "node"], "left_anti")
            .select("start", "node", "depth", _rank("start", F.struct("f.rank", "f.k")).alias("rank"), "f.note")
        )

    walked = grow(seed, step, "upstream").drop("rank")
    return graph.name(graph.name(walked, "start", "tbl", "attr"), "node", "source_table", "source_attr")


def impact_closure(graph: AttributeGraph, starts: DataFrame) -> DataFrame:
    """(start, node, depth, rank) reachable from each start attribute; the start has depth 0.

    ``rank`` is the order in which a first-in-first-out walk meets the nodes of one depth: by the rank of the node it
    comes from, then by transformation. The walk from several changes is the minimum over the walks from each, so the
    closure is computed once per distinct attribute and shared by all reports.
    """
    links = materialize(
        graph.routes.groupBy("src", "dst").agg(F.min(F.struct("seq", "pos")).alias("id")), "links"
    )
    seed = starts.select(
        F.col("id").alias("start"), F.col("id").alias("node"), F.lit(0).alias("depth"), F.lit(1).alias("rank")
    ).distinct()

    def step(newest: DataFrame, seen: DataFrame) -> DataFrame:
        return (
            newest.join(spread(links), F.col("node") == F.col("src"))
            .groupBy("start", F.col("dst").alias("node"))
            .agg(F.min(F.struct("rank", "id")).alias("order"), F.min(F.col("depth") + 1).alias("depth"))
            .join(spread(seen.select("start", "node")), ["start", "node"], "left_anti")
            .select("start", "node", "depth", _rank("start", F.col("order")).alias("rank"))
        )

    return grow(seed, step, "impact")


def impact_paths(graph: AttributeGraph, changes: DataFrame) -> DataFrame:
    """Routes each report's changed attributes affect.

    ``changes`` has (report, tbl, attr, place, change_type), ``place`` being the change's order
    in its report. Result: (report, tbl, attr, change_type, affected_table, affected_attr, depth,
    place, route). Every route is taken once per report and credited to the change that reaches
    its tail first; (depth, place, route) is the order of the walk.
    """
    # One row per changed attribute: its first place in the walk, its last change type.
    points = changes.groupBy("report", "tbl", "attr").agg(
        F.min("place").alias("place"), F.max_by("change_type", "place").alias("change_type")
    )
    located = points.join(spread(graph.nodes.select("id", "tbl", "attr")), ["tbl", "attr"])
    closure = impact_closure(graph, located.select("id").distinct())
    claimed = (
        located.join(spread(closure), F.col("id") == F.col("start"))
        .groupBy("report", "node")
        .agg(F.min(F.struct("depth", "place", "rank", F.struct("tbl", "attr", "change_type").alias("from"))).alias("c"))
        .select("report", "node", "c.*")
    )
    routes = graph.routes.groupBy("src", "dst", "job").agg(F.min(F.struct("seq", "pos")).alias("id"))
    paths = claimed.join(spread(routes), F.col("node") == F.col("src")).select(
        "report",
        "from.tbl",
        "from.attr",
        "from.change_type",
        "dst",
        (F.col("depth") + 1).alias("depth"),
        "place",
        F.struct("rank", "id").alias("route"),
    )
    return graph.name(paths, "dst", "affected_table", "affected_attr")
