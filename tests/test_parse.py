"""Event parsing: names, defaults, quarantine, lineage facets, SQL text."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from headwater.functions.names import canonical_name, mask_credentials
from headwater.functions.sqltext import is_readable_dialect, is_unsupported
from headwater.operators import parse
from headwater.sources.events import append_events, read_event_lines, read_events
from headwater.storage import materialize


def event(**changes):
    base = {
        "eventType": "COMPLETE", "eventTime": "2024-01-01T00:00:00Z", "run": {"runId": "r"}, "job": {"name": "j"},
        "inputs": [], "outputs": [{"name": "a.b.out"}],
    }
    return {k: v for k, v in {**base, **changes}.items() if v is not None}


def parsed_events(rows, **options):
    """Written once, as the model does it; every check then reads the typed rows."""
    return materialize(parse.parse_events(rows, **options), "parsed")


def test_dataset_names(spark):
    names = {
        "t": "t.public.t", "ns.t": "ns.public.t", "ns.s.t": "ns.s.t", "a.b.c.d": "a.b.d",
        None: "unknown.public.unknown_table", "": "unknown.public.unknown_table",
    }
    rows = spark.createDataFrame([(n,) for n in names], "n string").select("n", canonical_name(F.col("n")).alias("c"))
    assert {r.n: r.c for r in rows.collect()} == names


def test_envelope_and_quarantine(events):
    twice = {"schema": {"fields": [{"name": "x"}, {"name": "x"}]}}
    payloads = [
        event(run={"run_id": "", "runId": "b"}, eventTime="2024-01-01T03:00:00+03:00"),
        event(eventType="complete"),
        event(eventTime=None),
        event(run={}),
        event(eventTime="yesterday"),
        "[1]",
        "not json",
        None,
        event(run="text"),
        event(outputs=[{"name": "o", "facets": twice}]),
        event(eventType="START", outputs=[{"name": "o", "facets": twice}]),
        event(eventTime="10:00:00"),
    ]
    parsed = parsed_events(events(payloads))
    good = {r.seq: r for r in parse.envelopes(parsed).collect()}
    assert set(good) == {0, 1, 2, 10}
    assert good[0].run_id == "b" and str(good[0].event_time) == "2024-01-01 00:00:00"
    assert good[1].event_type == "OTHER"
    assert str(good[2].event_time) == "2024-01-01 00:00:02"  # arrival time
    assert {r.seq: r.reason for r in parse.quarantined(parsed).collect()} == {
        3: "missing run id", 4: "bad event time", 5: "malformed event", 6: "malformed event", 7: "malformed event",
        8: "malformed event", 9: "repeated column", 11: "bad event time",
    }
    assert {r.seq for r in parse.final_events(parsed).collect()} == {0, 2}


def test_job_and_sql_choice(events):
    payloads = [
        event(job={}),
        event(job={"namespace": "n", "name": "j", "facets": {"sqlQuery": {"sql": "select 1", "dialect": "Hive"}}}),
        event(
            facets={"sourceCode": {"sourceCode": "top", "language": "mysql"}},
            job={"name": "j", "facets": {"sql": {"query": "low", "dialect": "x"}}},
        ),
    ]
    parsed = parsed_events(events(payloads))
    jobs = {r.seq: (r.job_namespace, r.job, r.sql, r.dialect) for r in parse.job_specs(parsed).collect()}
    assert jobs == {0: ("", "unknown_job", None, None), 1: ("n", "j", "select 1", "Hive"), 2: ("", "j", "low", "x")}
    texts = {r.seq: (r.sql, r.dialect, r.supported) for r in parse.event_sql(parsed).collect()}
    assert texts == {1: ("select 1", "Hive", True), 2: ("top", "mysql", True)}


def test_lineage_facet(events):
    good = {"type": "d", "subtype": "x", "description": "t", "masking": True}
    facet = {
        "fields": {
            "b": {"inputFields": [{"name": "i.s.t", "field": "c", "transformations": ["x", {"type": "d", "masking": "yes"}, good]}]},
            "a": {"inputFields": [{"name": "i.s.t", "field": "c", "transformations": []}, {"name": "", "field": "c", "transformations": [good]}]},
        },
        "dataset": [{"name": "i.s.t", "field": "k", "transformations": [{}]}],
    }
    parsed = parsed_events(events([event(outputs=[{"name": "plain", "facets": {"columnLineage": facet}}])]))
    rows = parse.lineage_rows(parsed).orderBy("pos").collect()
    assert [(r.output_table, r.output_attribute, r.lineage_type, r.lineage_subtype, r.lineage_masking, r.lineage_scope) for r in rows] == [
        ("plain", "b", "D", None, None, "FIELD"),
        ("plain", "b", "D", "X", True, "FIELD"),
        ("plain", "__dataset__", None, None, None, "DATASET"),
    ]
    assert parsed.first().spec_count == 3
    canonical = parsed_events(events([event(outputs=[{"name": "plain", "facets": {"columnLineage": facet}}])]), canonicalize=True)
    assert {r.output_table for r in parse.lineage_rows(canonical).collect()} == {"plain.public.plain"}


SQL_CASES = {
    # text: (number of inputs, {(output, subtype, inputs)}, {join inputs}) or None when outside the subset
    "SELECT a.x, a.y AS z, sum(b.v) total FROM s.one a JOIN w.s.two AS b ON a.id = b.id AND b.k > 1 WHERE a.q = 'from here'": (
        2,
        {("x", "IDENTITY", ("w.s.one.x",)), ("z", "DERIVED", ("w.s.one.y",)), ("total", "AGGREGATION", ("w.s.two.v",))},
        ["w.s.one.id", "w.s.two.id", "w.s.two.k"],
    ),
    "select coalesce(a.x, f(b.y, ',')) as c, a.x + a.x as twice\nfrom one a, two b;": (
        2, {("c", "DERIVED", ("w.s.one.x", "w.s.two.y")), ("twice", "DERIVED", ("w.s.one.x",))}, [],
    ),
    "SELECT id, upper(name) AS n, count(*) AS k, 1 AS lit, x.* FROM one x GROUP BY id -- note": (
        1, {("id", "IDENTITY", ("w.s.one.id",)), ("n", "DERIVED", ("w.s.one.name",)), ("*", "IDENTITY", ("w.s.one.*",))}, [],
    ),
    "SELECT q.v AS v, w.s.two.c AS c FROM other q LEFT JOIN w.s.two USING (id)": (
        2, {("v", "DERIVED", ("other.v",)), ("c", "DERIVED", ("w.s.two.c",))}, [],
    ),
    "SELECT zz.v AS v, name FROM one a": (2, set(), []),
    "SELECT a.x AS x FROM one a JOIN two b ON coalesce(b.i, f(b.j, b.a)) = a.i": (
        2, {("x", "DERIVED", ("w.s.one.x",))}, ["w.s.two.i", "w.s.two.j", "w.s.two.a", "w.s.one.i"],
    ),
    "SELECT CASE WHEN a.x > 0 THEN a.y ELSE 0 END AS f, CAST(a.t AS date) AS d FROM one a": (
        1, {("f", "DERIVED", ("w.s.one.x", "w.s.one.y")), ("d", "DERIVED", ("w.s.one.t",))}, [],
    ),
    "INSERT INTO t SELECT a.x FROM one a": None,
    "SELECT a.x FROM (SELECT x FROM one) a": None,
    "WITH c AS (SELECT 1) SELECT c.x FROM c": None,
    "SELECT a.x FROM one a UNION SELECT b.x FROM two b": None,
    "SELECT": None,
    "SELECT extract(year FROM a.d) AS y, extract(month from d2) m FROM one a": (
        1, {("y", "DERIVED", ("w.s.one.d",)), ("m", "DERIVED", ("w.s.one.d2",))}, [],
    ),
    "SELECT a.x AS x FROM one a JOIN two b ON a.k = 'p, q b' AND a.m = b.m": (
        2, {("x", "DERIVED", ("w.s.one.x",))}, ["w.s.one.k", "w.s.one.m", "w.s.two.m"],
    ),
    "SELECT a.x AS x FROM one a JOIN two b ON a.k = 'x join z b' AND a.m = b.m": (
        2, {("x", "DERIVED", ("w.s.one.x",))}, ["w.s.one.k", "w.s.one.m", "w.s.two.m"],
    ),
    "SELECT a.x AS x FROM one a JOIN two b ON a.k = 'one where two' AND a.m = b.m": (
        2, {("x", "DERIVED", ("w.s.one.x",))}, ["w.s.one.k", "w.s.one.m", "w.s.two.m"],
    ),
    "SELECT a.x AS x FROM one a JOIN two y ON f(g(h(i(j(k(a.x)))), y.y)) = 1": (
        2, {("x", "DERIVED", ("w.s.one.x",))}, ["w.s.one.x", "w.s.two.y"],
    ),
    'SELECT a."c0", a."Odd Name" AS "Out, Name", "a"."c1" c FROM "one" "a"': (
        1, {("c0", "IDENTITY", ("w.s.one.c0",)), ("Out, Name", "DERIVED", ("w.s.one.Odd Name",)), ("c", "DERIVED", ("w.s.one.c1",))}, [],
    ),
    "SELECT a.`c0` AS x FROM w.s.`one` a": (1, {("x", "DERIVED", ("w.s.one.c0",))}, []),
    "SELECT sumIf(a.x, a.y > 0) AS s, count_if(a.z) AS c, max_by(a.x, a.t) AS m, quantileExact(a.q) AS q FROM one a": (
        1, {("s", "AGGREGATION", ("w.s.one.x", "w.s.one.y")), ("c", "AGGREGATION", ("w.s.one.z",)),
            ("m", "AGGREGATION", ("w.s.one.x", "w.s.one.t")), ("q", "AGGREGATION", ("w.s.one.q",))}, [],
    ),
    "SELECT a.x AS x, 'not -- a comment' AS s, concat(a.y, '/* nor this */') AS y FROM one a /* , */ -- two b": (
        1, {("x", "DERIVED", ("w.s.one.x",)), ("y", "DERIVED", ("w.s.one.y",))}, [],
    ),
    "SELECT sum(a.x) OVER (PARTITION BY a.p ORDER BY a.o ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS r, row_number() over (order by o) n FROM one a": (
        1, {("r", "AGGREGATION", ("w.s.one.x", "w.s.one.p", "w.s.one.o")), ("n", "DERIVED", ("w.s.one.o",))}, [],
    ),
    "SELECT trim(both ' ' from a.x) AS x, cast(a.y AS decimal(10, 2)), z::int, 'it''s, a' || w AS w FROM one a": (
        1, {("x", "DERIVED", ("w.s.one.x",)), ("y", "DERIVED", ("w.s.one.y",)), ("z", "DERIVED", ("w.s.one.z",)), ("w", "DERIVED", ("w.s.one.w",))}, [],
    ),
    "SELECT date '2024-01-01' + interval '1' day - d AS d FROM one": (1, {("d", "DERIVED", ("w.s.one.d",))}, []),
    "SELECT a.x AS x FROM one a CROSS JOIN two LEFT JOIN three t ON(t.i=a.i) WHERE a.j IN (1, 2) ORDER BY 1": (
        2, {("x", "DERIVED", ("w.s.one.x",))}, ["three.i", "w.s.one.i"],
    ),
    "SELECT a.x FROM one a, (SELECT y FROM two) b": None,
    "SELECT a.x FROM one a JOIN generate_series(1, 3) g ON true": None,
    "SELECT a.x[1] AS x FROM one a": None,
    "SELECT arrayMap(x -> x + 1, a.v) AS v FROM one a": None,
    "SELECT a.x FROM one a WHERE (a.y = 1": None,
    "SELECT a.x AS y FROM one a WHERE a.z = 'open": None,
    "SELECT sum(a.x) OVER w AS s FROM one a WINDOW w AS (ORDER BY a.y)": None,
    "SELECT a.x FROM one FINAL a": None,
}


def test_sql_text_lineage(events):
    payloads = [
        event(
            job={"name": "j", "facets": {"sql": {"query": text, "dialect": "Postgres"}}},
            inputs=[{"name": n} for n in ("w.s.one", "w.s.two")[: want[0] if want else 2]],
        )
        for text, want in SQL_CASES.items()
    ]
    parsed = parsed_events(events(payloads))
    rows = parse.lineage_rows(parsed).orderBy("seq", "pos").collect()
    flags = {r.seq: r.outside_subset for r in parse.event_sql(parsed).collect()}
    for seq, (text, want) in enumerate(SQL_CASES.items()):
        mine = [r for r in rows if r.seq == seq]
        assert flags[seq] == (want is None), text
        if want is None:
            assert mine == [], text
            continue
        assert all(r.output_table == "a.b.out" and r.source == "sql_parsing" for r in mine)
        specs: dict = {}
        for r in mine:
            if r.lineage_scope == "FIELD":
                specs.setdefault((r.spec_no, r.output_attribute, r.lineage_subtype), []).append(f"{r.input_table}.{r.input_attribute}")
        assert {(name, kind, tuple(ins)) for (_, name, kind), ins in specs.items()} == want[1], text
        joins = [f"{r.input_table}.{r.input_attribute}" for r in mine if r.lineage_scope == "DATASET"]
        assert joins == want[2], text


def sql_event(text, dialect, inputs=("w.s.one", "w.s.two")):
    job = {"name": "j", "facets": {"sql": {"query": text, "dialect": dialect}}}
    return event(job=job, inputs=[{"name": n} for n in inputs])


def test_dialects_quote_in_their_own_way(events):
    cases = {
        ("postgres", """SELECT a."q" AS x, 'a\\' AS s, a.y AS y FROM one a"""): {("x", "q"), ("y", "y")},
        ("postgresql", """SELECT "a"."q" AS x FROM "w"."s"."one" AS "a" """): {("x", "q")},
        ("sqlite", """SELECT a."q" AS x, a.`r` y FROM one a"""): {("x", "q"), ("y", "r")},
        ("snowflake", """SELECT a."Q" AS x, 'it\\'s, a.n' AS s FROM one a"""): {("x", "Q")},
        ("mysql", """SELECT a.`q` AS x, "a.n, b" AS s, concat(a.r, 'b\\', a.n') AS 'y' FROM `one` a # , two b"""): {("x", "q"), ("y", "r")},
        ("bigquery", """SELECT a.q AS x, "from a.n" AS s FROM `w.s.one` a"""): {("x", "q")},
        ("hive", """SELECT a.`q` x, "a.n" s FROM one a"""): {("x", "q")},
        ("clickhouse", """SELECT a."q" AS x, sumIf(a.r, a.s = 'b\\', a.n') AS y FROM `one` AS a"""): {("x", "q"), ("y", "r"), ("y", "s")},
    }
    parsed = parsed_events(events([sql_event(text, dialect) for dialect, text in cases]))
    assert not any(r.outside_subset for r in parse.event_sql(parsed).collect())
    rows = parse.lineage_rows(parsed).collect()
    for seq, ((dialect, _), want) in enumerate(cases.items()):
        mine = [r for r in rows if r.seq == seq]
        assert {(r.output_attribute, r.input_attribute) for r in mine} == want, dialect
        assert {r.input_table for r in mine} == {"w.s.one"}


def test_expressions_are_given_as_written(events):
    text = """SELECT f(a."x y", 'p (q', g('r''s')) AS "o" FROM one a JOIN two b ON h(a.i, ')') = b.i"""
    parsed = parsed_events(events([sql_event(text, "postgres")]))
    assert {r.expression for r in parse.lineage_rows(parsed).collect()} == {
        """f(a."x y", 'p (q', g('r''s')) AS "o\"""", "JOIN two b ON h(a.i, ')') = b.i",
    }


def test_first_facet_with_any_content_counts(events):
    text = "SELECT a.x AS x FROM one a"
    facets = [
        {"sql": {"_producer": "p"}, "sqlQuery": {"query": text, "dialect": "hive"}},
        {"sql": {}, "sqlQuery": {"query": text, "dialect": "hive"}},
        {"sql": {"sql": text, "dialect": "hive"}},
    ]
    parsed = parsed_events(events([event(job={"name": "j", "facets": f}) for f in facets]))
    assert [r.sql for r in parse.job_specs(parsed).orderBy("seq").collect()] == [None, text, text]
    assert [r.seq for r in parse.event_sql(parsed).orderBy("seq").collect()] == [1, 2]


def test_sql_expression_text(events):
    text = "SELECT a.x + b.y AS s FROM one a LEFT OUTER JOIN two b ON a.i = b.i INNER JOIN one c ON c.i = b.i WHERE a.x > 1"
    job = {"name": "j", "facets": {"sql": {"query": text, "dialect": "hive"}}}
    parsed = parsed_events(events([event(job=job, inputs=[{"name": "w.s.one"}, {"name": "w.s.two"}])]))
    assert [(r.spec_no, r.expression) for r in parse.lineage_rows(parsed).orderBy("pos").collect()] == [
        (0, "a.x + b.y AS s"), (0, "a.x + b.y AS s"), (1, "JOIN two b ON a.i = b.i"), (2, "JOIN two b ON a.i = b.i"),
        (3, "JOIN one c ON c.i = b.i"), (4, "JOIN one c ON c.i = b.i"),
    ]
    off = parsed_events(events([event(job=job)]), sql_fallback=False)
    assert parse.lineage_rows(off).count() == 0


def test_dialects(spark):
    rows = spark.createDataFrame([("PostgreSQL",), ("oracle",), (None,)], "d string")
    assert [r[0] for r in rows.select(is_readable_dialect(F.col("d"))).collect()] == [True, False, False]
    assert spark.range(1).select(is_unsupported(F.lit("select a.x from t a"))).first()[0] is False


@pytest.mark.parametrize(
    "dsn,masked",
    [
        ("postgresql://u:p@h/db", "postgresql://u:***@h/db"),
        ("http://token@h/", "http://***@h/"),
        ("spark://h:7077", "spark://h:7077"),
        ("no scheme u:p@h", "no scheme u:p@h"),
        ("x://u:a:b@h@y", "x://u:***@h@y"),
        ("http://t@h/x://a:b@c", "http://***@h/x://a:b@c"),
    ],
)
def test_mask_credentials(spark, dsn, masked):
    assert spark.range(1).select(mask_credentials(F.lit(dsn))).first()[0] == masked


def test_event_files(spark, events, tmp_path):
    payloads = [event(job={"name": f"j{n}"}) for n in range(7)]
    lines = tmp_path / "lines"
    lines.mkdir()
    for name, part in (("a.json", payloads[:3]), ("b.json", payloads[3:4]), ("c.json", payloads[4:])):
        (lines / name).write_text("\n".join(map(json.dumps, part)) + "\n")
    rows = read_event_lines(spark, str(lines)).orderBy("seq").collect()
    assert [r.seq for r in rows] == list(range(7))
    assert [json.loads(r.raw)["job"]["name"] for r in rows] == [f"j{n}" for n in range(7)]
    append_events(events(payloads), str(tmp_path / "log"))
    assert read_events(spark, str(tmp_path / "log")).count() == 7
