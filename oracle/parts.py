"""DuckDB building blocks: the model rules written as plain SQL over the given tables.

Each entry is a common table expression; an oracle names the ones it needs and gets them in
order. Nothing here shares code with the Spark side.
"""

from __future__ import annotations

import re

PARTS: dict[str, str] = {}

PARTS["ol_events"] = """
  WITH b AS (
    SELECT event_id AS seq, ts, user_id AS u, event_type AS et,
           CAST(regexp_extract(props, '[0-9]+', 0) AS INT) AS k,
           CAST(FLOOR(user_id / 5) AS BIGINT) AS i, CAST(FLOOR(user_id / 10) AS BIGINT) AS h, user_id % 5 AS l,
           ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS rn
    FROM events),
  d AS (
    SELECT *, CONCAT('run-', u, '-', CAST(FLOOR(rn / 3) AS BIGINT)) AS run_id,
      CASE WHEN rn % 3 = 0 THEN 'START' WHEN rn % 3 = 1 THEN 'RUNNING'
           WHEN et = 'error' THEN 'FAIL' WHEN et = 'purchase' THEN 'ABORT' ELSE 'COMPLETE' END AS event_type,
      CONCAT('etl.job_', u) AS job_name,
      CONCAT('wh.l', l, '.t', i) AS in1, CONCAT('wh.l', l, '.t', h) AS in2,
      CASE WHEN u % 50 = 49 THEN CONCAT('wh.l1.t', i) ELSE CONCAT('wh.l', l + 1, '.t', i) END AS out1
    FROM b)
  SELECT seq, ts, CONCAT(
    '{"eventType":"', event_type, '","eventTime":"', REPLACE(SUBSTR(CAST(ts AS STRING), 1, 19), ' ', 'T'), 'Z","run":{"runId":"', run_id,
    '"},"job":{"namespace":"etl","name":"', job_name, '","facets":{"sql":{"dialect":"postgres","query":"SELECT a.c0, a.c1 + b.c1 AS c1 FROM ', in1, ' a JOIN ', in2, ' b ON a.c0 = b.c0',
    CASE WHEN k >= 95 THEN ' WHERE a.c1 > 0' ELSE '' END, '"}}},"inputs":[{"name":"', in1, '"',
    CASE WHEN l = 0 THEN ',"facets":{"schema":{"fields":[{"name":"c0","type":"bigint"},{"name":"c1","type":"double"},{"name":"c2","type":"string"}]}}' ELSE '' END,
    '}', CASE WHEN in2 <> in1 THEN CONCAT(',{"name":"', in2, '"}') ELSE '' END,
    '],"outputs":[', CASE WHEN k = 0 THEN '' ELSE CONCAT('{"name":"', out1, '","facets":{"schema":{"fields":[{"name":"c0","type":"bigint"},{"name":"c1","type":"',
    CASE WHEN k >= 90 THEN 'decimal(10,2)' ELSE 'double' END, '"}', CASE WHEN k >= 10 THEN ',{"name":"c2","type":"string"}' ELSE '' END, ']}',
    CASE WHEN k % 10 = 9 THEN '' ELSE CONCAT(',"columnLineage":{"fields":{"c0":{"inputFields":[{"name":"', in1, '","field":"c0","transformations":[{"type":"direct","subtype":"identity"}]}]},"c1":{"inputFields":[{"name":"', in1, '","field":"c1","transformations":[{"type":"DIRECT","subtype":"TRANSFORMATION","description":"sum","masking":false}]},{"name":"', in2, '","field":"c1","transformations":[{"type":"DIRECT","subtype":"TRANSFORMATION","description":"sum","masking":false}]}]},"c2":{"inputFields":[{"name":"', in2, '","field":"c2","transformations":[{"type":"DIRECT","subtype":"AGGREGATION"}]}]}},"dataset":[{"name":"', in2, '","field":"c0","transformations":[{"type":"INDIRECT","subtype":"JOIN"}]}]}') END,
    '}}') END, ']}') AS raw
  FROM d"""

PARTS["ev"] = """
  SELECT seq, ts, raw, j, j->'run'->>'runId' AS run_id,
    CASE WHEN j->>'eventType' IN ('START','COMPLETE','FAIL','FAILED','ABORT','ABORTED','OTHER')
         THEN j->>'eventType' ELSE 'OTHER' END AS event_type,
    CAST(replace(j->>'eventTime', 'Z', '') AS TIMESTAMP) AS event_time,
    coalesce(j->'job'->>'namespace', '') AS job_namespace,
    coalesce(nullif(j->'job'->>'name', ''), 'unknown_job') AS job,
    j->'job'->'facets'->'sql'->>'query' AS sql, j->'job'->'facets'->'sql'->>'dialect' AS dialect,
    CAST(json_array_length(j, '$.inputs') AS BIGINT) AS n_inputs,
    CAST(json_array_length(j, '$.outputs') AS BIGINT) AS n_outputs
  FROM (SELECT seq, ts, raw, CAST(raw AS JSON) AS j FROM ol_events)"""

PARTS["upd"] = """
  SELECT * FROM ev WHERE event_type IN ('COMPLETE','FAIL','FAILED','ABORT','ABORTED') AND n_outputs > 0"""

PARTS["datasets"] = """
  WITH raw_ds AS (
    SELECT seq, ts, 'input' AS role, 0 AS side, unnest(range(n_inputs)) AS pos, j->'inputs' AS items FROM ev
    UNION ALL
    SELECT seq, ts, 'output', 1, unnest(range(n_outputs)), j->'outputs' FROM ev),
  named AS (
    SELECT seq, ts, role, side, pos, items->CAST(pos AS INT) AS ds,
           string_split(coalesce(nullif(items->CAST(pos AS INT)->>'name', ''), 'unknown.unknown_table'), '.') AS p
    FROM raw_ds)
  SELECT seq, ts, role, side, pos, p[1] AS namespace, CASE WHEN len(p) > 2 THEN p[2] ELSE 'public' END AS schema_name,
         p[len(p)] AS table_name,
         p[1] || '.' || CASE WHEN len(p) > 2 THEN p[2] ELSE 'public' END || '.' || p[len(p)] AS tbl,
         coalesce(CAST(ds->'facets'->'schema'->'fields' AS STRUCT(name VARCHAR, "type" VARCHAR)[]), []) AS fields
  FROM named"""

PARTS["table_obs"] = """
  SELECT d.*, CASE WHEN len(fields) > 0
                   THEN array_to_string(list_transform(fields, lambda f: f.name || ':' || f."type"), ',') END AS sig
  FROM datasets d WHERE seq IN (SELECT seq FROM upd)"""

PARTS["obs_versions"] = """
  WITH a AS (SELECT *, row_number() OVER (PARTITION BY tbl ORDER BY seq, side, pos) AS n FROM table_obs),
  b AS (SELECT *, last_value(coalesce(sig, CASE WHEN n = 1 THEN '' END) IGNORE NULLS) OVER (
          PARTITION BY tbl ORDER BY seq, side, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM a),
  c AS (SELECT *, (n = 1 OR (sig IS NOT NULL AND sig IS DISTINCT FROM prev)) AS changed FROM b)
  SELECT *, CAST(sum(CAST(changed AS INT)) OVER (PARTITION BY tbl ORDER BY seq, side, pos) AS BIGINT) AS version FROM c"""

PARTS["table_versions"] = """
  SELECT tbl, namespace, schema_name, table_name, version, seq AS from_seq,
         lead(seq) OVER w AS to_seq, ts AS valid_from, lead(ts) OVER w AS valid_to,
         coalesce(sig, '') AS fields, fields AS field_list
  FROM obs_versions WHERE changed WINDOW w AS (PARTITION BY tbl ORDER BY version)"""

PARTS["attribute_versions"] = """
  SELECT tbl, version, i - 1 AS ordinal, field_list[i].name AS attr, field_list[i]."type" AS data_type, from_seq, to_seq
  FROM (SELECT *, unnest(range(1, len(field_list) + 1)) AS i FROM table_versions)"""

PARTS["current_attributes"] = "SELECT tbl, version, ordinal, attr, data_type FROM attribute_versions WHERE to_seq IS NULL"

PARTS["event_tables"] = """
  SELECT seq, list_sort(list(DISTINCT {'role': role, 'tbl': tbl, 'version': version})) AS tables,
         bool_or(changed) AS tables_changed
  FROM obs_versions GROUP BY seq"""

PARTS["job_steps"] = """
  WITH a AS (SELECT u.seq, u.ts, u.run_id, u.event_type, u.event_time, u.job, u.job_namespace, u.sql, u.dialect,
                    t.tables, t.tables_changed FROM upd u JOIN event_tables t USING (seq)),
  b AS (SELECT *, lag({'s': sql, 'd': dialect, 't': tables}) OVER (PARTITION BY job ORDER BY seq)
                  IS DISTINCT FROM {'s': sql, 'd': dialect, 't': tables} AS changed FROM a)
  SELECT *, CAST(sum(CAST(changed AS INT)) OVER (PARTITION BY job ORDER BY seq) AS BIGINT) AS version FROM b"""

PARTS["job_versions"] = """
  SELECT job, version, job_namespace, sql, dialect, seq AS from_seq, lead(seq) OVER w AS to_seq,
         ts AS valid_from, lead(ts) OVER w AS valid_to, tables
  FROM job_steps WHERE changed WINDOW w AS (PARTITION BY job ORDER BY version)"""

PARTS["job_tables"] = """
  SELECT job, version, t.role AS role, t.tbl AS tbl, t.version AS tbl_version, from_seq, to_seq
  FROM (SELECT job, version, from_seq, to_seq, unnest(tables) AS t FROM job_versions)"""

PARTS["facet_specs"] = """
  WITH o AS (SELECT seq, oi, j->'outputs'->CAST(oi AS INT) AS o
             FROM (SELECT seq, j, unnest(range(n_outputs)) AS oi FROM upd)),
  f AS (SELECT seq, oi, 0 AS part, ki, o->>'name' AS output_table, keys[ki + 1] AS output_attribute,
               json_extract(o->'facets'->'columnLineage'->'fields', '$."' || keys[ki + 1] || '".inputFields') AS inputs,
               'FIELD' AS scope
        FROM (SELECT *, unnest(range(len(keys))) AS ki
              FROM (SELECT *, json_keys(o->'facets'->'columnLineage'->'fields') AS keys FROM o))
        UNION ALL
        SELECT seq, oi, 1, 0, o->>'name', '__dataset__', o->'facets'->'columnLineage'->'dataset', 'DATASET' FROM o),
  i AS (SELECT *, inputs->CAST(fi AS INT) AS inp
        FROM (SELECT *, unnest(range(CAST(json_array_length(inputs) AS BIGINT))) AS fi FROM f)),
  t AS (SELECT *, inp->'transformations'->CAST(ti AS INT) AS tr
        FROM (SELECT *, unnest(range(CAST(json_array_length(inp, '$.transformations') AS BIGINT))) AS ti FROM i))
  SELECT seq, row_number() OVER (PARTITION BY seq ORDER BY oi, part, ki, fi, ti) - 1 AS pos,
         row_number() OVER (PARTITION BY seq ORDER BY oi, part, ki, fi, ti) - 1 AS spec_no,
         output_table, output_attribute, inp->>'name' AS input_table, inp->>'field' AS input_attribute,
         upper(tr->>'type') AS lineage_type, upper(tr->>'subtype') AS lineage_subtype,
         tr->>'description' AS lineage_description,
         CASE WHEN json_type(tr, '$.masking') = 'BOOLEAN' THEN CAST(tr->>'masking' AS BOOLEAN) END AS lineage_masking,
         scope AS lineage_scope, 'openlineage' AS source, CAST(NULL AS VARCHAR) AS expression
  FROM t"""

PARTS["sql_specs"] = """
  WITH q AS (SELECT seq, job, sql, j->'outputs'->0->>'name' AS output_table,
                    regexp_extract(sql, '^SELECT (.*) FROM ', 1) AS projection,
                    regexp_extract(sql, ' FROM (\\S+) a JOIN (\\S+) b', 1) AS a,
                    regexp_extract(sql, ' FROM (\\S+) a JOIN (\\S+) b', 2) AS b,
                    regexp_extract(sql, ' (JOIN .* ON [a-z0-9.]+ = [a-z0-9.]+)', 1) AS joined
             FROM upd WHERE dialect = 'postgres' AND seq NOT IN (SELECT seq FROM facet_specs)),
  items AS (SELECT *, unnest(range(1, len(string_split(projection, ', ')) + 1)) AS spec_no,
                   unnest(string_split(projection, ', ')) AS item FROM q),
  cols AS (SELECT *, unnest(range(len(refs))) AS ri, unnest(refs) AS ref
           FROM (SELECT *, regexp_extract_all(item, '[ab]\\.c[0-9]') AS refs FROM items)),
  field_rows AS (
    SELECT seq, spec_no, min(ri) AS ri, output_table, regexp_extract(item, '([a-z0-9]+)$', 1) AS output_attribute,
           CASE WHEN ref[1] = 'a' THEN a ELSE b END AS input_table, ref[3:] AS input_attribute, 'SQL' AS lineage_type,
           CASE WHEN regexp_full_match(item, '[ab]\\.c[0-9]') THEN 'IDENTITY' ELSE 'DERIVED' END AS lineage_subtype,
           'FIELD' AS lineage_scope, item AS expression
    FROM cols GROUP BY ALL),
  join_rows AS (
    SELECT seq, 100 + ri AS spec_no, 0 AS ri, output_table, '__dataset__' AS output_attribute,
           CASE WHEN ref[1] = 'a' THEN a ELSE b END AS input_table, ref[3:] AS input_attribute,
           'INDIRECT' AS lineage_type, 'JOIN' AS lineage_subtype, 'DATASET' AS lineage_scope, joined AS expression
    FROM (SELECT *, unnest(range(len(refs))) AS ri, unnest(refs) AS ref
          FROM (SELECT *, regexp_extract_all(regexp_extract(joined, ' ON (.*)$', 1), '[ab]\\.c[0-9]') AS refs FROM q)))
  SELECT seq, row_number() OVER (PARTITION BY seq ORDER BY spec_no, ri) - 1 AS pos,
         dense_rank() OVER (PARTITION BY seq ORDER BY spec_no) - 1 AS spec_no,
         output_table, output_attribute, input_table, input_attribute, lineage_type, lineage_subtype,
         CAST(NULL AS VARCHAR) AS lineage_description, CAST(NULL AS BOOLEAN) AS lineage_masking, lineage_scope,
         'sql_parsing' AS source, expression
  FROM (SELECT * FROM field_rows UNION ALL SELECT * FROM join_rows)"""

PARTS["specs"] = "SELECT * FROM facet_specs UNION ALL SELECT * FROM sql_specs"

PARTS["resolved"] = """
  WITH placed AS (
    SELECT s.*, o.version AS output_version, i.version AS in_version
    FROM specs s
    JOIN table_versions o ON o.tbl = s.output_table AND o.from_seq <= s.seq AND (o.to_seq IS NULL OR s.seq < o.to_seq)
    LEFT JOIN table_versions i ON i.tbl = s.input_table AND i.from_seq <= s.seq AND (i.to_seq IS NULL OR s.seq < i.to_seq))
  SELECT a.seq, a.pos, x.version AS input_version, a.output_version, x.tbl AS input_table, x.attr AS input_attribute,
         a.output_table, a.output_attribute, a.lineage_type, a.lineage_subtype, a.lineage_description,
         a.lineage_masking, a.lineage_scope, a.source, a.expression
  FROM placed a
  JOIN attribute_versions y ON y.tbl = a.output_table AND y.version = a.output_version AND y.attr = a.output_attribute
  LEFT JOIN attribute_versions x ON x.tbl = a.input_table AND x.version = a.in_version AND x.attr = a.input_attribute"""

PARTS["set_steps"] = """
  WITH s AS (SELECT seq, string_agg(concat_ws('|', coalesce(input_table, '~'), coalesce(input_version, 0),
                      coalesce(input_attribute, '~'), output_table, output_version, output_attribute,
                      coalesce(lineage_type, '~'), coalesce(lineage_subtype, '~'), coalesce(lineage_description, '~'),
                      coalesce(CAST(lineage_masking AS VARCHAR), '~'), lineage_scope, source, coalesce(expression, '~')), ';'
                    ORDER BY input_table, input_version, input_attribute, output_table, output_version, output_attribute,
                      lineage_type, lineage_subtype, lineage_description, lineage_masking, expression) AS sig
             FROM resolved GROUP BY seq),
  e AS (SELECT j.seq, j.job, j.version AS job_version, coalesce(s.sig, '') AS sig
        FROM job_steps j JOIN (SELECT DISTINCT seq FROM specs) p USING (seq) LEFT JOIN s USING (seq)),
  c AS (SELECT *, coalesce(lag(sig) OVER (PARTITION BY job, job_version ORDER BY seq), '') <> sig AS changed FROM e)
  SELECT *, CAST(sum(CAST(changed AS INT)) OVER (PARTITION BY job, job_version ORDER BY seq) AS BIGINT) AS set_no FROM c"""

PARTS["transformation_versions"] = """
  WITH c AS (SELECT job, job_version, set_no, seq,
                    lead(seq) OVER (PARTITION BY job, job_version ORDER BY set_no) AS next_seq
             FROM set_steps WHERE changed)
  SELECT c.job, c.job_version, c.set_no, c.seq AS from_seq, r.pos, coalesce(c.next_seq, v.to_seq) AS to_seq,
         r.input_table, r.input_attribute, r.output_table, r.output_attribute, r.lineage_type, r.lineage_subtype,
         r.lineage_description, r.lineage_masking, r.source, r.expression, r.lineage_scope
  FROM c JOIN resolved r USING (seq) JOIN job_versions v ON v.job = c.job AND v.version = c.job_version"""

PARTS["cur"] = """
  SELECT t.*, v.sql AS job_sql FROM transformation_versions t
  JOIN job_versions v ON v.job = t.job AND v.version = t.job_version WHERE t.to_seq IS NULL"""

PARTS["nodes"] = "SELECT tbl FROM table_versions WHERE to_seq IS NULL"

PARTS["runs"] = """
  SELECT run_id, arg_max(event_type, {'t': event_time, 's': seq}) AS status,
         max(CASE WHEN event_type = 'START' THEN event_time END) AS started_at,
         min(CASE WHEN event_type IN ('COMPLETE','FAIL','FAILED','ABORT','ABORTED') THEN event_time END) AS finished_at,
         max(event_type) AS last_type, min(event_type) AS first_type
  FROM ev GROUP BY run_id"""

PARTS["job_runs"] = "SELECT j.job, r.* FROM (SELECT DISTINCT job, run_id FROM job_steps) j JOIN runs r USING (run_id)"

PARTS["usage_counts"] = """
  SELECT v.tbl, count(*) AS usage
  FROM job_tables b JOIN job_steps e ON e.job = b.job AND e.version = b.version
  JOIN table_versions v ON v.tbl = b.tbl AND v.version = b.tbl_version AND v.to_seq IS NULL
  WHERE b.role = 'input' AND b.to_seq IS NULL GROUP BY v.tbl"""

PARTS["edges"] = """
  WITH f AS (SELECT DISTINCT input_table AS source, output_table AS target, output_attribute AS a
             FROM cur WHERE input_table IS NOT NULL),
  n AS (SELECT target, a, count(DISTINCT source) AS n FROM f GROUP BY target, a),
  k AS (SELECT tbl AS target, count(*) AS k FROM current_attributes GROUP BY tbl)
  SELECT f.source, f.target, sum(1.0::DOUBLE / n.n) / greatest(1, coalesce(max(k.k), 0)) AS weight
  FROM f JOIN n USING (target, a) LEFT JOIN k USING (target) GROUP BY f.source, f.target"""

PARTS["reach"] = """
  SELECT source, node, depth FROM reach_raw WHERE source <> node"""

PARTS["reach_raw"] = """RECURSIVE
  (source, node, depth) USING KEY (source, node) AS (
    SELECT e.source, e.target, 1 FROM edges e WHERE e.source IN (SELECT tbl FROM nodes)
    UNION
    SELECT r.source, e.target, min(r.depth + 1) FROM reach_raw r JOIN edges e ON e.source = r.node
    LEFT JOIN recurring.reach_raw k ON k.source = r.source AND k.node = e.target
    WHERE k.node IS NULL GROUP BY r.source, e.target)"""

PARTS["best_weight"] = """RECURSIVE
  (source, node, w) USING KEY (source, node) AS (
    SELECT e.source, e.target, e.weight FROM edges e WHERE e.source IN (SELECT tbl FROM nodes)
    UNION
    SELECT r.source, e.target, max(r.w * e.weight) FROM best_weight r JOIN edges e ON e.source = r.node
    LEFT JOIN recurring.best_weight k ON k.source = r.source AND k.node = e.target
    WHERE r.w * e.weight > coalesce(k.w, 0) GROUP BY r.source, e.target)"""

PARTS["influence"] = """
  SELECT n.tbl, coalesce(sum(b.w), 0) AS influence FROM nodes n LEFT JOIN best_weight b ON b.source = n.tbl GROUP BY n.tbl"""

PARTS["without"] = """RECURSIVE
  (removed, source, node) AS (
    SELECT x.tbl, e.source, e.target FROM nodes x JOIN edges e ON e.source <> x.tbl AND e.source IN (SELECT tbl FROM nodes)
    UNION
    SELECT r.removed, r.source, e.target FROM without r JOIN edges e ON e.source = r.node AND e.source <> r.removed)"""

PARTS["loss"] = """
  SELECT n.tbl, (SELECT count(*) FROM reach) - count(w.node) AS lost, (SELECT count(*) FROM reach) AS total
  FROM nodes n LEFT JOIN without w ON w.removed = n.tbl AND w.source <> w.node GROUP BY n.tbl"""

PARTS["scores"] = """
  WITH p AS (SELECT n.tbl, i.influence, CASE WHEN l.total > 0 THEN l.lost / l.total ELSE 0 END AS connectivity_loss,
                    CAST(coalesce(u.usage, 0) AS DOUBLE) AS usage
             FROM nodes n JOIN influence i USING (tbl) JOIN loss l USING (tbl) LEFT JOIN usage_counts u USING (tbl)),
  m AS (SELECT max(influence) AS mi, max(connectivity_loss) AS mc, max(usage) AS mu FROM p)
  SELECT tbl, round(influence, 6) AS influence, round(connectivity_loss, 6) AS connectivity_loss, usage,
         round(0.5 * CASE WHEN mi = 0 THEN 0 ELSE influence / mi END
             + 0.3 * CASE WHEN mc = 0 THEN 0 ELSE connectivity_loss / mc END
             + 0.2 * CASE WHEN mu = 0 THEN 0 ELSE usage / mu END, 6) AS score
  FROM p, m"""

PARTS["routes"] = """
  SELECT input_table AS st, input_attribute AS sa, output_table AS tt, output_attribute AS ta, job, from_seq, pos,
         CASE WHEN upper(lineage_subtype) = 'IDENTITY' THEN ''
              ELSE coalesce(nullif(expression, ''), lineage_description, '') END AS note
  FROM cur WHERE input_table IS NOT NULL"""

PARTS["down"] = """RECURSIVE
  (source_table, root, tbl, attr) AS (
    SELECT c.tbl, c.attr, r.tt, r.ta FROM current_attributes c JOIN routes r ON r.st = c.tbl AND r.sa = c.attr
    WHERE NOT (r.tt = c.tbl AND r.ta IN (SELECT x.attr FROM current_attributes x WHERE x.tbl = c.tbl))
    UNION
    SELECT d.source_table, d.root, r.tt, r.ta FROM down d JOIN routes r ON r.st = d.tbl AND r.sa = d.attr
    WHERE NOT (r.tt = d.source_table AND r.ta IN (SELECT x.attr FROM current_attributes x WHERE x.tbl = d.source_table)))"""

PARTS["up"] = """RECURSIVE
  (tbl, attr, source_table, source_attr, depth, pick) USING KEY (tbl, attr, source_table, source_attr) AS (
    SELECT c.tbl, c.attr, r.st, r.sa, 1,
           min({'k': [{'t': r.st, 'j': r.job, 'a': r.sa, 's': r.from_seq, 'p': r.pos}], 'note': r.note})
    FROM current_attributes c JOIN routes r ON r.tt = c.tbl AND r.ta = c.attr GROUP BY c.tbl, c.attr, r.st, r.sa
    UNION
    SELECT u.tbl, u.attr, r.st, r.sa, min(u.depth + 1),
           min({'k': list_append(u.pick.k, {'t': r.st, 'j': r.job, 'a': r.sa, 's': r.from_seq, 'p': r.pos}), 'note': r.note})
    FROM up u JOIN routes r ON r.tt = u.source_table AND r.ta = u.source_attr
    LEFT JOIN recurring.up k ON k.tbl = u.tbl AND k.attr = u.attr AND k.source_table = r.st AND k.source_attr = r.sa
    WHERE k.tbl IS NULL AND NOT (u.source_table = u.tbl AND u.source_attr = u.attr)
    GROUP BY u.tbl, u.attr, r.st, r.sa)"""

PARTS["table_diff"] = """
  SELECT coalesce(o.tbl, n.tbl) AS tbl, v.version - 1 AS old_version, v.version AS new_version,
         coalesce(o.attr, n.attr) AS attr,
         CASE WHEN o.attr IS NULL THEN 'ADDED' WHEN n.attr IS NULL THEN 'REMOVED' ELSE 'MODIFIED' END AS change_type,
         o.data_type AS old_type, n.data_type AS new_type
  FROM table_versions v
  JOIN (SELECT DISTINCT tbl, attr FROM attribute_versions) a ON a.tbl = v.tbl
  LEFT JOIN attribute_versions o ON o.tbl = v.tbl AND o.version = v.version - 1 AND o.attr = a.attr
  LEFT JOIN attribute_versions n ON n.tbl = v.tbl AND n.version = v.version AND n.attr = a.attr
  WHERE v.version > 1 AND o.data_type IS DISTINCT FROM n.data_type"""

PARTS["job_points"] = """
  SELECT job, job_version, input_table, input_attribute, output_table, output_attribute,
         arg_max({'ty': lineage_type, 'su': lineage_subtype, 'de': lineage_description, 'ma': lineage_masking,
                  'sc': lineage_scope, 'so': source, 'ex': expression}, {'s': from_seq, 'p': pos}) AS payload
  FROM transformation_versions
  GROUP BY job, job_version, input_table, input_attribute, output_table, output_attribute"""

PARTS["job_diff"] = """
  WITH keys AS (
    SELECT DISTINCT v.job, v.version, p.input_table, p.input_attribute, p.output_table, p.output_attribute
    FROM job_versions v JOIN job_points p ON p.job = v.job AND p.job_version IN (v.version, v.version - 1)
    WHERE v.version > 1)
  SELECT k.job, k.version - 1 AS old_version, k.version AS new_version, k.input_table, k.input_attribute,
         k.output_table, k.output_attribute,
         CASE WHEN o.job IS NULL THEN 'ADDED' WHEN n.job IS NULL THEN 'REMOVED' ELSE 'MODIFIED' END AS change_type,
         CASE WHEN n.job IS NULL THEN o.payload.ex ELSE n.payload.ex END AS expression
  FROM keys k
  LEFT JOIN job_points o ON o.job = k.job AND o.job_version = k.version - 1 AND o.output_table = k.output_table
    AND o.output_attribute = k.output_attribute AND o.input_table IS NOT DISTINCT FROM k.input_table
    AND o.input_attribute IS NOT DISTINCT FROM k.input_attribute
  LEFT JOIN job_points n ON n.job = k.job AND n.job_version = k.version AND n.output_table = k.output_table
    AND n.output_attribute = k.output_attribute AND n.input_table IS NOT DISTINCT FROM k.input_table
    AND n.input_attribute IS NOT DISTINCT FROM k.input_attribute
  WHERE o.payload IS DISTINCT FROM n.payload"""

PARTS["logic_diff"] = """
  SELECT DISTINCT v.job, v.version - 1 AS old_version, v.version AS new_version, t.output_table, t.output_attribute,
         'LOGIC_CHANGED' AS change_type
  FROM job_versions v JOIN job_versions o ON o.job = v.job AND o.version = v.version - 1
  JOIN transformation_versions t ON t.job = v.job AND t.job_version = v.version
  WHERE v.sql IS DISTINCT FROM o.sql AND (v.job, v.version) NOT IN (SELECT job, new_version FROM job_diff)"""

# Change points of all reports, numbered in the order the walk starts from them.
PARTS["table_points"] = """
  SELECT tbl || '#' || new_version AS report, tbl, attr, change_type,
         row_number() OVER (PARTITION BY tbl, new_version ORDER BY attr) AS place
  FROM table_diff"""

PARTS["job_points_changed"] = """
  SELECT job || '#' || new_version AS report, output_table AS tbl, output_attribute AS attr, change_type,
         row_number() OVER (PARTITION BY job, new_version ORDER BY input_table NULLS FIRST, input_attribute NULLS FIRST,
                            output_table, output_attribute) AS place
  FROM (SELECT job, new_version, input_table, input_attribute, output_table, output_attribute, change_type FROM job_diff
        UNION ALL SELECT job, new_version, NULL, NULL, output_table, output_attribute, change_type FROM logic_diff)"""


def _walk(points: str, name: str) -> str:
    return f"""RECURSIVE
  (report, tbl, attr, depth, k) USING KEY (report, tbl, attr) AS (
    SELECT report, tbl, attr, 0, [{{'s': min(place), 'p': CAST(0 AS BIGINT)}}] FROM {points} GROUP BY report, tbl, attr
    UNION
    SELECT w.report, r.tt, r.ta, min(w.depth + 1), min(list_append(w.k, {{'s': r.from_seq, 'p': r.pos}}))
    FROM {name} w JOIN routes r ON r.st = w.tbl AND r.sa = w.attr
    LEFT JOIN recurring.{name} x ON x.report = w.report AND x.tbl = r.tt AND x.attr = r.ta
    WHERE x.report IS NULL GROUP BY w.report, r.tt, r.ta)"""


def _paths(points: str, walk: str) -> str:
    return f"""
  WITH u AS (SELECT st, sa, tt, ta, job, min({{'s': from_seq, 'p': pos}}) AS id FROM routes GROUP BY st, sa, tt, ta, job),
  src AS (SELECT report, tbl, attr, min(place) AS place, arg_max(change_type, place) AS change_type
          FROM {points} GROUP BY report, tbl, attr)
  SELECT w.report, s.tbl, s.attr, s.change_type, u.tt AS affected_table, u.ta AS affected_attr, w.depth + 1 AS depth,
         list_append(w.k, u.id) AS route
  FROM {walk} w JOIN u ON u.st = w.tbl AND u.sa = w.attr JOIN src s ON s.report = w.report AND s.place = w.k[1].s"""


PARTS["table_walk"] = _walk("table_points", "table_walk")
PARTS["table_paths"] = _paths("table_points", "table_walk")
PARTS["job_walk"] = _walk("job_points_changed", "job_walk")
PARTS["job_paths"] = _paths("job_points_changed", "job_walk")

PARTS["catalog"] = """
  WITH t AS (SELECT *, CAST(regexp_extract(table_name, '([0-9]+)$', 1) AS BIGINT) AS n
             FROM table_versions WHERE to_seq IS NULL AND schema_name IN ('l1', 'l2', 'l3')),
  c AS (SELECT t.namespace, t.schema_name, t.table_name, a.attr AS column_name, a.ordinal + 1 AS ordinal, t.n,
               a.data_type AS ty
        FROM t JOIN current_attributes a USING (tbl) WHERE n % 7 <> 3
        UNION ALL SELECT namespace, schema_name, 'new' || n, 'c0', 1, n, 'bigint' FROM t WHERE n % 11 = 5)
  SELECT *, CASE WHEN column_name = 'c1' AND n % 5 = 1 THEN 'numeric(12,3)'
                 WHEN column_name = 'c2' AND n % 5 = 2 THEN 'character varying(20)'
                 WHEN column_name = 'c2' AND n % 5 = 4 THEN 'timestamp with time zone(6)'
                 ELSE ty END AS data_type FROM c"""

PARTS["snapshot"] = """
  SELECT namespace, schema_name, table_name, namespace || '.' || schema_name || '.' || table_name AS tbl,
         string_agg(column_name || ':' || data_type, ',' ORDER BY ordinal) AS fields
  FROM catalog GROUP BY ALL"""

PARTS["diff"] = """
  SELECT s.tbl, CASE WHEN s.fields = v.fields THEN 'unchanged' ELSE 'changed' END AS status
  FROM snapshot s LEFT JOIN table_versions v ON v.tbl = s.tbl AND v.to_seq IS NULL
  UNION ALL
  SELECT tbl, 'removed' FROM table_versions WHERE to_seq IS NULL AND tbl NOT IN (SELECT tbl FROM snapshot)
    AND (namespace, schema_name) IN (SELECT namespace, schema_name FROM snapshot)"""


# The same model with syncs after the middle event: the versions so far, what the sources list, and all that follows.
PARTS["middle"] = "SELECT max(seq) // 2 AS mid FROM ol_events"


def _versions(observations: str) -> str:
    """Versions of tables with closings: ``observations`` has (tbl, namespace, schema_name, table_name, seq, ts, side, pos,
    sig), sig null for no schema and '#' for a closing."""
    return f"""
  WITH o AS (SELECT * FROM ({observations})),
  a AS (SELECT *, row_number() OVER w AS n, lag(sig = '#') OVER w AS was_closed FROM (SELECT tbl, namespace, schema_name, table_name, seq, ts, side, pos, coalesce(sig, '?') AS sig FROM o) WINDOW w AS (PARTITION BY tbl ORDER BY seq, side, pos)),
  b AS (SELECT *, last_value(CASE WHEN sig <> '?' THEN sig WHEN n = 1 OR was_closed THEN '' END IGNORE NULLS) OVER (
          PARTITION BY tbl ORDER BY seq, side, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM a),
  c AS (SELECT *, CASE sig WHEN '#' THEN FALSE WHEN '?' THEN n = 1 OR was_closed ELSE prev IS DISTINCT FROM sig END AS opens,
               sig = '#' AND n > 1 AND NOT was_closed AS closes FROM b),
  d AS (SELECT *, lead(seq) OVER w AS to_seq, lead(ts) OVER w AS valid_to FROM c WHERE opens OR closes
        WINDOW w AS (PARTITION BY tbl ORDER BY seq, side, pos))
  SELECT tbl, namespace, schema_name, table_name,
         CAST(row_number() OVER (PARTITION BY tbl ORDER BY seq, side, pos) AS BIGINT) AS version, seq AS from_seq, to_seq,
         ts AS valid_from, valid_to, CASE sig WHEN '?' THEN '' ELSE sig END AS fields
  FROM d WHERE opens"""


PARTS["first_half"] = _versions(
    "SELECT tbl, namespace, schema_name, table_name, seq, ts, side, pos, sig FROM table_obs CROSS JOIN middle WHERE seq <= mid"
)
PARTS["half_catalog"] = """
  WITH t AS (SELECT *, CAST(regexp_extract(table_name, '([0-9]+)$', 1) AS BIGINT) AS n
             FROM first_half WHERE to_seq IS NULL AND schema_name IN ('l1', 'l2', 'l3')),
  f AS (SELECT *, string_split(unnest(string_split(fields, ',')), ':') AS f, unnest(range(len(string_split(fields, ',')))) AS ordinal
        FROM (SELECT namespace, schema_name, table_name, n, replace(fields, '(10,2)', '(10|2)') AS fields FROM t WHERE n % 7 <> 3 AND fields <> '')),
  c AS (SELECT namespace, schema_name, table_name, n, f[1] AS column_name, ordinal, replace(f[2], '|', ',') AS ty FROM f
        UNION ALL SELECT namespace, schema_name, 'new' || n, n, 'c0', 0, 'bigint' FROM t WHERE n % 11 = 5)
  SELECT *, CASE WHEN column_name = 'c1' AND n % 5 = 1 THEN 'numeric(12,3)'
                 WHEN column_name = 'c2' AND n % 5 = 2 THEN 'character varying(20)'
                 WHEN column_name = 'c2' AND n % 5 = 4 THEN 'timestamp with time zone(6)'
                 ELSE ty END AS data_type FROM c"""
PARTS["half_snapshot"] = """
  SELECT namespace, schema_name, table_name, namespace || '.' || schema_name || '.' || table_name AS tbl,
         string_agg(column_name || ':' || data_type, ',' ORDER BY ordinal) AS fields,
         CAST(substr(schema_name, 2) AS BIGINT) AS source_id
  FROM half_catalog GROUP BY ALL"""
PARTS["half_diff"] = """
  SELECT s.source_id, s.tbl, CASE WHEN s.fields = v.fields THEN 'unchanged' ELSE 'changed' END AS status,
         s.namespace, s.schema_name, s.table_name, s.fields
  FROM half_snapshot s LEFT JOIN first_half v ON v.tbl = s.tbl AND v.to_seq IS NULL
  UNION ALL
  SELECT CAST(substr(schema_name, 2) AS BIGINT), tbl, 'removed', namespace, schema_name, table_name, '#' FROM first_half
  WHERE to_seq IS NULL AND tbl NOT IN (SELECT tbl FROM half_snapshot)
    AND (namespace, schema_name) IN (SELECT (namespace, schema_name) FROM half_snapshot)"""
PARTS["synced_versions"] = _versions("""
  SELECT tbl, namespace, schema_name, table_name, seq, ts, side, pos, sig FROM table_obs
  UNION ALL
  SELECT tbl, namespace, schema_name, table_name, mid, TIMESTAMP '2100-01-01' + to_minutes(CAST(source_id - 1 AS INT)),
         CASE WHEN status = 'removed' THEN 4 ELSE 3 END, 0, fields FROM half_diff CROSS JOIN middle""")


def compose(final: str) -> str:
    """``final`` with the parts it names, and theirs, in dependency order."""
    order: list[str] = []

    def visit(text: str, owner: str | None) -> None:
        for name in PARTS:
            if name != owner and name not in order and re.search(rf"\b(?:FROM|JOIN|,)\s*{name}\b", text):
                visit(PARTS[name], name)
                if name not in order:
                    order.append(name)

    visit(final, None)
    if not order:
        return final
    rendered = []
    for name in order:
        body = PARTS[name]
        if body.startswith("RECURSIVE"):
            rendered.append(name + body[len("RECURSIVE"):])
        else:
            rendered.append(f"{name} AS MATERIALIZED ({body})")
    own = re.match(r"\s*WITH (?:RECURSIVE )?", final)
    tail = ",\n" + final[own.end():] if own else "\n" + final
    return "WITH RECURSIVE " + ",\n".join(rendered) + tail
