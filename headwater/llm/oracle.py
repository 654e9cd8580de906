"""DuckDB counterparts of the queries that SQL can express."""

from __future__ import annotations

from headwater.llm import linededup, secrets, urlfilter


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


OP3 = """
WITH p AS (
    SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest
    FROM pages
), f AS (SELECT payload_digest, min(page_id) AS first_id FROM p GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest,
    CASE WHEN payload_bytes >= 100 AND page_id IS DISTINCT FROM first_id THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN payload_bytes >= 100 AND page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to
FROM p JOIN f USING (payload_digest)
"""


def _spans(rank: int, kind: str, pattern: str, group: int, least: int) -> str:
    p = _text(pattern)
    return f"""
    SELECT row, source, lang, {rank} AS rank, '{kind}' AS kind, value, place + length(piece) AS start, place + length(piece) + length(hit) AS stop
    FROM (
        SELECT *, coalesce(sum(length(piece) + length(hit)) OVER (PARTITION BY row ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS place
        FROM (
            SELECT row, source, lang, n, string_split_regex(body, {p})[n] AS piece, regexp_extract_all(body, {p}, 0)[n] AS hit,
                regexp_extract_all(body, {p}, {group})[n] AS value
            FROM (SELECT *, unnest(range(1, len(regexp_extract_all(body, {p}, 0)) + 1)) AS n FROM d)
        )
    ) WHERE length(value) >= {least}"""


_KINDS = [*secrets.KINDS, secrets.GENERIC]
_JOIN = "string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank)"

OP5 = f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang, coalesce(text, '') AS body FROM documents),
base AS ({" UNION ALL ".join(_spans(n, *k) for n, k in enumerate(_KINDS[:-1]))}),
generic AS ({_spans(len(_KINDS) - 1, *_KINDS[-1])}),
extra AS (
    SELECT * FROM generic g WHERE regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Za-z]')
    AND NOT EXISTS (SELECT 1 FROM base b WHERE b.row = g.row AND b.start < g.stop AND g.start < b.stop)
),
spans AS (SELECT * FROM base UNION ALL SELECT * FROM extra),
spread AS (SELECT value, count(DISTINCT source) AS owners, count(DISTINCT source || '/' || lang) AS repositories FROM spans GROUP BY value),
kept AS (SELECT * FROM spans JOIN spread USING (value) WHERE rank < {len(_KINDS) - 1} OR owners <= {secrets.MAX_OWNERS}),
per AS (
    SELECT row, {_JOIN} AS spans, {_JOIN} FILTER (rank < {len(_KINDS) - 1}) AS base,
        count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
        count(*) FILTER (owners <= {secrets.MAX_OWNERS}) AS n_live, count(*) FILTER (owners > {secrets.MAX_OWNERS}) AS n_example,
        max(repositories) AS most_repositories
    FROM kept GROUP BY row
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
    sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live,
    coalesce(n_example, 0) AS n_example, coalesce(most_repositories, 0) AS most_repositories
FROM d LEFT JOIN per USING (row)
"""

OP9 = f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(source, '') AS source, string_split(coalesce(text, ''), chr(10)) AS cut FROM documents),
l AS (SELECT row, doc_id, source, unnest(cut) AS line, unnest(range(len(cut))) AS pos FROM d),
b AS (
    SELECT line, min((doc_id, pos)) AS first FROM l WHERE regexp_matches(line, '[^ \\t\\n\\x0b\\f\\r]')
    GROUP BY line HAVING count(DISTINCT source) >= {linededup.MIN_SITES}
),
m AS (SELECT l.*, b.line IS NOT NULL AND (l.doc_id, l.pos) <> b.first AS gone FROM l LEFT JOIN b ON l.line = b.line)
SELECT any_value(doc_id) AS doc_id, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS text,
    count(*)::INT AS n_lines, count(*) FILTER (gone)::INT AS n_removed
FROM m GROUP BY row
"""


def _op10() -> str:
    parts = """
    WITH u AS (SELECT page_id, CASE WHEN position('://' IN coalesce(url, '')) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
    h AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM u),
    a AS (
        SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
            regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path,
            '//' || translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') || substr(rest, length(raw) + 1) AS address
        FROM h
    )"""
    cases = []
    for rule, verdict in sorted(urlfilter.SITE_RULES, key=lambda r: -len(r[0])):
        host, path = rule.split("/", 1)
        fits = f"(host = {_text(host)} OR ends_with(host, {_text('.' + host)})) AND starts_with(path, {_text('/' + path)})"
        cases.append((fits, rule, verdict))
    blocked = " OR ".join(f"regexp_matches(address, {_text(p)})" for _, _, _, p, _ in urlfilter.method_rules())
    rule = " ".join(f"WHEN {fits} THEN {_text(r)}" for fits, r, _ in cases)
    verdict = " ".join(f"WHEN {fits} THEN {_text(v)}" for fits, _, v in cases)
    return f"""{parts}
    SELECT page_id, host, path, CASE {rule} END AS rule, CASE {verdict} WHEN {blocked} THEN 'block' ELSE 'allow' END AS verdict FROM a"""


OP13 = r"""
WITH d AS (
    SELECT row_number() OVER () AS row, coalesce(lang, 'und') AS lang,
        string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\n-\r]') AS cut
    FROM documents
), p AS (SELECT lang, unnest(cut) AS piece FROM d),
w AS (SELECT lang, row_number() OVER () AS piece, regexp_extract_all(piece, '[^ \t]+') AS word FROM p),
g AS (SELECT lang, piece, unnest(word) AS x, unnest(range(len(word))) AS i FROM w),
s AS (SELECT lang, x, lead(x) OVER q AS y, lead(x, 2) OVER q AS z FROM g WINDOW q AS (PARTITION BY piece ORDER BY i)),
f AS (
    SELECT lang, 1 AS k, x AS phrase, count(*) AS n FROM s GROUP BY ALL
    UNION ALL SELECT lang, 2 AS k, x || ' ' || y AS phrase, count(*) AS n FROM s WHERE y IS NOT NULL GROUP BY ALL
    UNION ALL SELECT lang, 3 AS k, x || ' ' || y || ' ' || z AS phrase, count(*) AS n FROM s WHERE z IS NOT NULL GROUP BY ALL
),
t AS (SELECT lang, sum(n)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT *, string_split(phrase, ' ') AS word FROM f WHERE k > 1 AND n >= 10),
covered AS (
    SELECT s.lang, s.phrase FROM c AS s JOIN (
        SELECT lang, n, unnest([array_to_string(word[1:2], ' '), array_to_string(word[2:3], ' ')]) AS phrase FROM c WHERE k = 3
    ) AS b ON b.lang = s.lang AND b.phrase = s.phrase WHERE s.k = 2 AND 100 * b.n >= 50 * s.n
),
cuts AS (
    SELECT c.lang, c.phrase, c.n AS a, cut, x.n AS l, y.n AS r,
        ((1000000::HUGEINT * c.n * c.n) // (x.n::HUGEINT * y.n))::BIGINT AS score
    FROM c CROSS JOIN (VALUES (1), (2)) AS place(cut)
    JOIN f AS x ON x.lang = c.lang AND x.k = cut AND x.phrase = array_to_string(c.word[1:cut], ' ')
    JOIN f AS y ON y.lang = c.lang AND y.k = c.k - cut AND y.phrase = array_to_string(c.word[cut + 1:c.k], ' ')
    WHERE cut < c.k
),
worst AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
ranked AS (
    SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank
    FROM worst ANTI JOIN covered USING (lang, phrase)
)
SELECT lang, rank, phrase, a, l, r, t.n, score FROM ranked JOIN t USING (lang) WHERE rank <= 2000
"""

ORACLE = {"op3_warc": OP3, "op5_secrets": OP5, "op9_lines": OP9, "op10_urls": _op10(), "op13_collocations": OP13}
