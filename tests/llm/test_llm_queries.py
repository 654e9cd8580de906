"""Registered queries: DuckDB gives the same rows where SQL can say it; the pipeline's stages do what they say."""

from __future__ import annotations

import re
from collections import defaultdict

import pytest
from compare import connect, difference
from llm_tables import HARD, docs
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from headwater.llm.decontam import words_of
from headwater.llm.queries import ORACLE, QUERIES
from headwater.storage import materialize

SF = "/root/testdata/sf0.01"


def test_one_query_for_each_operator_and_the_pipeline():
    assert [int(q[2:].split("_")[0]) for q in QUERIES] == list(range(1, 14))
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries()) and set(ORACLE) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query(spark, name):
    assert difference(QUERIES[name](spark, SF), connect(SF), ORACLE[name]) is None


@pytest.fixture(scope="module")
def stages(spark):
    """Each stage's input and output over a whole small table."""
    out, df = {}, spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        before, df = df, materialize(stage(spark, df, SF), name)
        out[name] = before.toPandas(), df.toPandas()
    return out


def test_stages_keep_the_columns_of_documents(stages):
    for name, (before, after) in stages.items():
        if name != "packing":
            assert list(before.columns) == list(after.columns)
            assert set(after.doc_id) <= set(before.doc_id) and after.doc_id.is_unique


def test_quality_stage_keeps_good_documents(spark, stages):
    before, after = stages["quality"]
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas()
    kept = labels[labels.doc_id.isin(before.doc_id)].assign(kept=lambda x: x.doc_id.isin(after.doc_id))
    assert kept[kept.quality == 1].kept.mean() > 0.97
    assert kept[kept.quality == 0].kept.mean() < 0.25


def test_line_stage_leaves_each_common_line_once(stages):
    before, after = stages["lines"]
    sites = defaultdict(set)
    for t, s in zip(before.text, before.source):
        for x in t.split("\n"):
            sites[x].add(s)
    common = {x for x, s in sites.items() if len(s) >= 4 and x.strip()}
    left = [x for t in after.text for x in t.split("\n") if x in common]
    assert common and sorted(left) == sorted(common)
    own = lambda texts: sorted(x for t in texts for x in t.split("\n") if x not in common)
    assert [x for x in own(before.text) if x] == [x for x in own(after.text) if x]
    assert (after.text.str.len() == after.n_chars).all() and len(before) == len(after)


def test_copies_stage_leaves_one_of_each_group(stages):
    before, after = stages["near_copies"]

    def shingles(t):
        w = re.sub("[A-Z]+", lambda m: m[0].lower(), t).split()
        return frozenset(zip(*[w[i:] for i in range(5)])) or frozenset([tuple(w)])

    sets = {i: shingles(t) for i, t in zip(before.doc_id, before.text)}
    holders = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    near = {(a, b) for h in holders.values() for a in h for b in h if a < b}
    near = {(a, b) for a, b in near if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])}
    kept = set(after.doc_id)
    both = [p for p in near if p[0] in kept and p[1] in kept]
    assert len(near) > 20 and len(both) <= 0.1 * len(near)
    paired = {x for p in near for x in p}
    assert set(before.doc_id) - kept <= paired  # nothing else goes


def test_test_items_stage_drops_what_holds_an_item(spark, stages):
    before, after = stages["test_items"]
    items = [" ".join(words_of(r.text)) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    holds = {i for i, t in zip(before.doc_id, before.text) if any(f" {x} " in f" {' '.join(words_of(t))} " for x in items)}
    assert holds and holds == set(before.doc_id) - set(after.doc_id)


def test_packing_stage_places_every_document(stages):
    before, after = stages["packing"]
    assert (after.groupby("doc_id").length.sum() == after.groupby("doc_id").doc_tokens.first()).all()
    assert set(after.doc_id) == set(before.doc_id)
    assert after.groupby("sequence_id").length.sum().max() <= 2048


@pytest.mark.parametrize("rows", [HARD, []])
def test_stages_on_hard_tables(spark, tmp_path, rows):
    sf = str(tmp_path)
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{sf}/benchmark.parquet")
    df = docs(spark, rows)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = materialize(stage(spark, df, sf), name)
        assert out.columns == df.columns
        df = out
    assert df.where(F.col("doc_id").isNull()).count() == (1 if rows else 0)
    assert corpus_pipeline.STAGES[-1][1](spark, df, sf).count() == 0 if not rows else True
