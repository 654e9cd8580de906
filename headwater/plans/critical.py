"""Criticality of tables: influence, lost connectivity and usage in one score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from headwater.functions.quantile import nearest_rank
from headwater.operators import graph as g
from headwater.operators.runs import table_usage
from headwater.plans.model import LineageModel
from headwater.storage import materialize, spread, together

# Weights of influence, connectivity and usage; length of the short list.
ALPHA, BETA, GAMMA = 0.5, 0.3, 0.2
TOP = 10
HIGHLIGHT_QUANTILE = 0.9


def model_graph(model: LineageModel) -> g.TableGraph:
    edges = g.table_edges(model.current_transformations(), model.current_attributes())
    return g.table_graph(edges, model.current_tables())


def critical_tables(
    model: LineageModel, alpha: float = ALPHA, beta: float = BETA, gamma: float = GAMMA
) -> DataFrame:
    """(tbl, influence, connectivity_loss, usage, score) of every current table."""
    graph = model_graph(model)
    influence, loss = together(
        graph.nodes.sparkSession,
        lambda: g.influence(graph).withColumnRenamed("source", "id"),
        lambda: g.connectivity_loss(graph, g.reachable(graph)),
    )
    usage = table_usage(model.links, model.job_tables(), model.current_tables())
    names = ["influence", "connectivity_loss", "usage"]
    # Written once: the maxima and the scores both read it.
    parts = materialize(
        graph.current()
        .join(spread(influence), "id", "left")
        .join(spread(loss), "id", "left")
        .join(spread(usage), "tbl", "left")
        .select(
            "tbl",
            F.coalesce("influence", F.lit(0.0)).alias("influence"),
            F.coalesce("connectivity_loss", F.lit(0.0)).alias("connectivity_loss"),
            F.coalesce(F.col("usage"), F.lit(0)).cast("double").alias("usage"),
        ),
        "critical-parts",
    )
    score = sum((w * normalized(parts, n) for w, n in zip((alpha, beta, gamma), names)), F.lit(0.0))
    return parts.select("tbl", *names, score.alias("score"))


def normalized(df: DataFrame, name: str) -> Column:
    """The column divided by its maximum; 0 everywhere when the maximum is 0."""
    peak = df.agg(F.max(name)).scalar()
    return F.when(peak == 0, F.lit(0.0)).otherwise(F.col(name) / peak)


def top_critical(scores: DataFrame, limit: int = TOP) -> DataFrame:
    return scores.orderBy(F.desc("score"), "tbl").limit(limit)


def highlighted(scores: DataFrame, quantile: float = HIGHLIGHT_QUANTILE) -> DataFrame:
    """Tables whose score reaches the nearest-rank quantile."""
    scores = materialize(scores, "scores")
    threshold = nearest_rank(scores, "score", quantile)
    return scores.filter(F.col("score") >= (0.0 if threshold is None else threshold))
