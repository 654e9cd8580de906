"""DuckDB SQL for every registered query, with the same column names."""

from __future__ import annotations

from oracle.parts import compose

_SET = """input_table, input_attribute, output_table, output_attribute, lineage_type, lineage_subtype,
  lineage_description, lineage_masking, source, expression"""
_FACET = """seq, output_table, output_attribute, input_table, input_attribute, lineage_type, lineage_subtype,
  lineage_description, lineage_masking"""
_TEXT = "seq, output_table, output_attribute, input_table, input_attribute, lineage_subtype, expression"
_TABLE = "tbl, namespace, schema_name, table_name, version, from_seq, to_seq, valid_from, valid_to, fields"

_ASKED = """SELECT 'wh.l' || s_nationkey % 6 || '.t' || s_suppkey AS tbl, 'c' || s_suppkey % 3 AS attr FROM supplier"""

_REPORT_END = """
  SELECT {key}, CAST(split_part(report, '#', 2) AS BIGINT) - 1 AS old_version,
         CAST(split_part(report, '#', 2) AS BIGINT) AS new_version, affected_table,
         count(*) AS affected_attributes, min(distance) AS distance,
         string_agg(affected_attr || ':' || change_type, ',' ORDER BY affected_attr) AS attributes
  FROM a GROUP BY report, affected_table"""

_FINAL = {
    "ol_events_raw": "SELECT seq, ts, raw FROM ol_events",
    "event_envelope": "SELECT seq, run_id, event_type, event_time FROM ev",
    "job_specs": "SELECT seq, job_namespace, job, sql, dialect FROM ev",
    "final_events": "SELECT seq, event_type, n_inputs AS inputs, n_outputs AS outputs FROM upd",
    "quarantined_events": """
      WITH d AS (
        SELECT seq, CASE WHEN seq % 101 = 0 THEN '[' || raw || ']'
                         WHEN seq % 103 = 0 THEN replace(raw, '"runId"', '"id"')
                         WHEN seq % 107 = 0 THEN replace(raw, '"eventTime":"', '"eventTime":"at ')
                         WHEN seq % 109 = 0 THEN replace(raw, '"name":"c1","type"', '"name":"c0","type"')
                         WHEN seq % 113 = 0 THEN substring(raw, 2) ELSE raw END AS raw
        FROM ol_events),
      j AS (SELECT seq, raw, CASE WHEN json_valid(raw) THEN CAST(raw AS JSON) END AS j FROM d),
      r AS (
        SELECT seq, raw, CASE
          WHEN j IS NULL OR json_type(j) <> 'OBJECT' THEN 'malformed event'
          WHEN coalesce(nullif(j->'run'->>'run_id', ''), nullif(j->'run'->>'runId', '')) IS NULL THEN 'missing run id'
          WHEN try_cast(replace(j->>'eventTime', 'Z', '') AS TIMESTAMP) IS NULL THEN 'bad event time'
          WHEN j->>'eventType' IN ('COMPLETE','FAIL','FAILED','ABORT','ABORTED') AND json_array_length(j, '$.outputs') > 0
               AND len(list_filter(list_concat(
                 CAST(j->'inputs'->'$[*].facets.schema.fields' AS STRUCT(name VARCHAR, "type" VARCHAR)[][]),
                 CAST(j->'outputs'->'$[*].facets.schema.fields' AS STRUCT(name VARCHAR, "type" VARCHAR)[][])),
                 lambda f: len(list_distinct(list_transform(f, lambda c: c.name))) < len(f))) > 0 THEN 'repeated column'
          END AS reason FROM j)
      SELECT seq, reason, md5(raw) AS raw_md5 FROM r WHERE reason IS NOT NULL""",
    "dataset_observations": """
      SELECT seq, role, pos, tbl, namespace, schema_name, table_name, len(fields) AS n_fields FROM datasets""",
    "dataset_fields": """
      SELECT seq, role, pos, tbl, i - 1 AS ordinal, fields[i].name AS attr, fields[i]."type" AS data_type
      FROM (SELECT *, unnest(range(1, len(fields) + 1)) AS i FROM datasets)""",
    "field_lineage": f"SELECT pos, {_FACET} FROM facet_specs WHERE lineage_scope = 'FIELD'",
    "dataset_lineage": f"SELECT {_FACET} FROM facet_specs WHERE lineage_scope = 'DATASET'",
    "event_sql": "SELECT seq, sql, dialect, TRUE AS supported, FALSE AS outside_subset FROM ev WHERE sql IS NOT NULL",
    "sql_projection_lineage": f"SELECT pos, {_TEXT} FROM sql_specs WHERE lineage_scope = 'FIELD'",
    "sql_join_lineage": f"SELECT {_TEXT} FROM sql_specs WHERE lineage_scope = 'DATASET'",
    "table_versions": f"SELECT {_TABLE} FROM table_versions",
    "attribute_versions": "SELECT tbl, version, ordinal, attr, data_type, from_seq, to_seq FROM attribute_versions",
    "current_tables": """
      SELECT tbl, namespace, schema_name, table_name, version FROM table_versions WHERE to_seq IS NULL""",
    "current_attributes": "SELECT tbl, version, ordinal, attr, data_type FROM current_attributes",
    "job_versions": """
      SELECT job, version, job_namespace, sql, dialect, from_seq, to_seq,
             array_to_string(list_transform(tables, lambda t: t.role || ':' || t.tbl || ':' || t.version), ',') AS tables
      FROM job_versions""",
    "job_tables": "SELECT job, version, role, tbl, tbl_version, from_seq, to_seq FROM job_tables",
    "event_log_linked": """
      SELECT e.seq, e.run_id, e.event_type, e.event_time, e.raw, j.job AS job_name, j.version AS job_version
      FROM ev e LEFT JOIN job_steps j USING (seq)""",
    "ingest_results": """
      SELECT e.seq, coalesce(j.tables_changed OR j.changed OR coalesce(s.changed, FALSE), FALSE) AS model_updated,
             coalesce(j.changed, FALSE) AS job_changed,
             CASE WHEN e.event_type IN ('COMPLETE','FAIL','FAILED','ABORT','ABORTED') THEN e.n_inputs ELSE 0 END AS inputs,
             CASE WHEN e.event_type IN ('COMPLETE','FAIL','FAILED','ABORT','ABORTED') THEN e.n_outputs ELSE 0 END AS outputs,
             coalesce(p.n, 0) AS transformations
      FROM ev e LEFT JOIN job_steps j USING (seq) LEFT JOIN set_steps s USING (seq)
      LEFT JOIN (SELECT seq, count(DISTINCT spec_no) AS n FROM specs GROUP BY seq) p USING (seq)""",
    "resolved_transformations": f"SELECT seq, pos, input_version, output_version, {_SET} FROM resolved",
    "transformation_versions": f"SELECT job, job_version, set_no, from_seq, pos, to_seq, {_SET} FROM transformation_versions",
    "current_transformations": f"SELECT job, job_version, from_seq, pos, job_sql, {_SET} FROM cur",
    "table_history": """
      SELECT v.tbl, v.version, v.from_seq, v.to_seq, count(a.attr) AS attribute_count
      FROM table_versions v LEFT JOIN attribute_versions a ON a.tbl = v.tbl AND a.version = v.version
      GROUP BY v.tbl, v.version, v.from_seq, v.to_seq""",
    "job_history": """
      SELECT v.job, v.version, v.from_seq, v.to_seq, count(t.pos) AS transformation_count
      FROM job_versions v LEFT JOIN transformation_versions t ON t.job = v.job AND t.job_version = v.version
      GROUP BY v.job, v.version, v.from_seq, v.to_seq""",
    "model_as_of": """
      WITH m AS (SELECT max(ts) AS moment FROM ol_events WHERE seq = (SELECT max(seq) // 2 FROM ol_events)),
      t AS (SELECT * FROM table_versions, m WHERE valid_from <= moment AND (valid_to IS NULL OR moment < valid_to)),
      j AS (SELECT * FROM job_versions, m WHERE valid_from <= moment AND (valid_to IS NULL OR moment < valid_to))
      SELECT 'table' AS kind, tbl AS name, version FROM t
      UNION ALL
      SELECT 'attribute', concat_ws('|', a.tbl, a.attr, a.data_type), a.version
      FROM attribute_versions a JOIN t ON t.tbl = a.tbl AND t.version = a.version
      UNION ALL
      SELECT 'job', job, version FROM j
      UNION ALL
      SELECT 'job table', concat_ws('|', b.job, b.version, b.role, b.tbl), b.tbl_version
      FROM job_tables b JOIN j ON j.job = b.job AND j.version = b.version
      UNION ALL
      SELECT 'transformation', concat_ws('|', x.job, x.set_no, x.pos, x.input_table, x.output_attribute), x.job_version
      FROM transformation_versions x JOIN ol_events f ON f.seq = x.from_seq LEFT JOIN ol_events u ON u.seq = x.to_seq, m
      WHERE f.ts <= moment AND (x.to_seq IS NULL OR moment < u.ts)""",
    "version_state": f"""
      SELECT job, job_version, set_no, from_seq, pos, {_SET} FROM transformation_versions
      WHERE job_version = 1 AND job IN (SELECT job FROM job_versions WHERE version = 2)""",
    "job_runs": "SELECT job, run_id, status, started_at, finished_at, last_type, first_type FROM job_runs",
    "table_usage": "SELECT tbl, usage FROM usage_counts",
    "table_edges": "SELECT source, target, round(weight, 6) AS weight FROM edges",
    "graph_nodes": """
      SELECT v.tbl AS id, v.namespace, v.schema_name, v.table_name,
             coalesce(string_agg(a.attr || ':' || a.data_type, ',' ORDER BY a.attr), '') AS attributes
      FROM table_versions v LEFT JOIN current_attributes a USING (tbl) WHERE v.to_seq IS NULL
      GROUP BY v.tbl, v.namespace, v.schema_name, v.table_name""",
    "graph_edges": """
      SELECT input_table AS source_table, output_table AS target_table, job, job_sql, count(*) AS mappings
      FROM cur WHERE input_table IS NOT NULL GROUP BY ALL""",
    "graph_edge_attributes": """
      SELECT input_table AS source_table, output_table AS target_table, job, input_attribute, output_attribute,
             lineage_type, lineage_subtype, lineage_description, lineage_masking, lineage_scope, source, expression
      FROM cur WHERE input_table IS NOT NULL""",
    "graph_edge_runs": """
      SELECT e.source_table, e.target_table, e.job, r.run_id, r.status, r.started_at, r.finished_at
      FROM (SELECT DISTINCT input_table AS source_table, output_table AS target_table, job
            FROM cur WHERE input_table IS NOT NULL) e
      JOIN job_runs r USING (job)""",
    "table_degrees": """
      SELECT tbl, (SELECT count(*) FROM edges WHERE target = tbl) AS in_count,
             (SELECT count(*) FROM edges WHERE source = tbl) AS out_count FROM nodes""",
    "reachable_pairs": "SELECT count(*) AS pairs FROM reach",
    "table_distances": "SELECT source AS source_table, node AS target_table, depth FROM reach",
    "downstream_trace": """
      SELECT r.source AS start, e.source AS edge_source, e.target AS edge_target
      FROM (SELECT source, node FROM reach UNION SELECT tbl, tbl FROM nodes) r JOIN edges e ON e.source = r.node""",
    "distances_from": f"""
      SELECT source AS source_table, node AS target_table, depth FROM reach WHERE source IN (SELECT tbl FROM ({_ASKED}))""",
    "trace_from": f"""
      SELECT r.source AS start, e.source AS edge_source, e.target AS edge_target
      FROM (SELECT source, node FROM reach UNION SELECT tbl, tbl FROM nodes) r JOIN edges e ON e.source = r.node
      WHERE r.source IN (SELECT tbl FROM ({_ASKED}))""",
    "table_layers": """
      WITH RECURSIVE roots AS (SELECT tbl FROM nodes WHERE tbl NOT IN (SELECT target FROM edges)),
      inside AS (SELECT tbl FROM roots UNION SELECT node FROM reach WHERE source IN (SELECT tbl FROM roots)),
      looped AS (SELECT DISTINCT tbl FROM inside WHERE tbl IN (SELECT source FROM reach_raw WHERE source = node)),
      behind AS (SELECT tbl FROM looped UNION SELECT node FROM reach WHERE source IN (SELECT tbl FROM looped)),
      walk(tbl, layer) AS (
        SELECT tbl, 0 FROM roots
        UNION SELECT e.target, w.layer + 1 FROM walk w JOIN edges e ON e.source = w.tbl
        WHERE e.target NOT IN (SELECT tbl FROM behind))
      SELECT n.tbl, CASE WHEN b.tbl IS NULL THEN coalesce(max(w.layer), 0) END AS layer, b.tbl IS NOT NULL AS cyclic
      FROM nodes n LEFT JOIN walk w USING (tbl) LEFT JOIN behind b USING (tbl) GROUP BY n.tbl, b.tbl""",
    "table_influence": "SELECT tbl, round(influence, 6) AS influence FROM influence",
    "connectivity_loss": """
      SELECT tbl, lost, round(CASE WHEN total > 0 THEN lost / total ELSE 0 END, 6) AS connectivity_loss FROM loss""",
    "critical_tables": "SELECT tbl, influence, connectivity_loss, usage, score FROM scores",
    "critical_top10": """
      SELECT tbl, influence, connectivity_loss, usage, score FROM scores ORDER BY score DESC, tbl LIMIT 10""",
    "critical_highlight": """
      SELECT tbl, score FROM scores WHERE score >= (SELECT quantile_disc(score, 0.9) FROM scores)""",
    "downstream_attributes": """
      SELECT source_table, tbl, attr, string_agg(DISTINCT root, ',' ORDER BY root) AS parent_attributes
      FROM down GROUP BY source_table, tbl, attr""",
    "upstream_attributes": "SELECT tbl, attr, source_table, source_attr, depth, pick.note AS note FROM up",
    "downstream_from": f"""
      SELECT source_table, tbl, attr, string_agg(DISTINCT root, ',' ORDER BY root) AS parent_attributes
      FROM down WHERE source_table IN (SELECT tbl FROM ({_ASKED})) GROUP BY source_table, tbl, attr""",
    "upstream_from": f"""
      SELECT tbl, attr, source_table, source_attr, depth, pick.note AS note FROM up
      WHERE (tbl, attr) IN (SELECT (tbl, attr) FROM ({_ASKED}))""",
    "impact_paths": """
      SELECT CAST(split_part(report, '#', 2) AS BIGINT) - 1 AS old_version,
             CAST(split_part(report, '#', 2) AS BIGINT) AS new_version, tbl, attr, affected_table, affected_attr, depth
      FROM table_paths""",
    "table_version_diff": "SELECT tbl, old_version, new_version, attr, change_type, old_type, new_type FROM table_diff",
    "job_version_diff": """
      SELECT job, old_version, new_version, input_table, input_attribute, output_table, output_attribute, change_type,
             expression FROM job_diff""",
    "job_logic_changed": """
      SELECT job, old_version, new_version, output_table, output_attribute, change_type FROM logic_diff""",
    "impact_report_table": """
      WITH a AS (SELECT report, affected_table, affected_attr, min(depth) AS distance,
                        arg_max(change_type, {'d': depth, 'r': route}) AS change_type
                 FROM table_paths GROUP BY report, affected_table, affected_attr)"""
    + _REPORT_END.format(key="split_part(report, '#', 1) AS tbl"),
    "impact_report_job": """
      WITH every AS (SELECT report, affected_table, affected_attr, depth, route, change_type FROM job_paths
                     UNION ALL SELECT report, tbl, attr, 0, [{'s': place, 'p': 0}], change_type FROM job_points_changed),
      a AS (SELECT report, affected_table, affected_attr, min(depth) AS distance,
                   arg_max(change_type, {'d': depth, 'r': route}) AS change_type
            FROM every GROUP BY report, affected_table, affected_attr)"""
    + _REPORT_END.format(key="split_part(report, '#', 1) AS job"),
    "sync_type_normalize": """
      SELECT namespace, schema_name, table_name, column_name, ordinal, data_type FROM catalog""",
    "sync_columns_jsonl": """
      SELECT schema_name AS namespace, schema_name, table_name,
             schema_name || '.' || schema_name || '.' || table_name AS tbl,
             string_agg(column_name || ':' || CASE WHEN data_type LIKE 'numeric(%' THEN 'numeric'
                          WHEN data_type LIKE 'character varying%' THEN 'character varying'
                          WHEN data_type LIKE 'timestamp with%' THEN 'timestamp with time zone' ELSE data_type END,
                        ',' ORDER BY ordinal) AS fields
      FROM catalog GROUP BY schema_name, table_name""",
    "sync_diff": "SELECT tbl, status FROM diff",
    "sync_removed": """
      SELECT tbl, namespace, schema_name FROM table_versions
      WHERE to_seq IS NULL AND tbl IN (SELECT tbl FROM diff WHERE status = 'removed')""",
    "sync_table_versions": """
      WITH arrival AS (SELECT max(seq) + 1 AS s, TIMESTAMP '2100-01-01' AS t FROM ol_events)
      SELECT v.tbl, v.namespace, v.schema_name, v.table_name, v.version, v.from_seq,
             CASE WHEN v.to_seq IS NULL AND d.status IN ('changed', 'removed') THEN s ELSE v.to_seq END AS to_seq,
             v.valid_from,
             CASE WHEN v.to_seq IS NULL AND d.status IN ('changed', 'removed') THEN t ELSE v.valid_to END AS valid_to,
             v.fields
      FROM table_versions v CROSS JOIN arrival LEFT JOIN diff d USING (tbl)
      UNION ALL
      SELECT p.tbl, p.namespace, p.schema_name, p.table_name,
             1 + coalesce((SELECT max(version) FROM table_versions x WHERE x.tbl = p.tbl), 0), s, NULL, t, NULL, p.fields
      FROM snapshot p CROSS JOIN arrival JOIN diff d USING (tbl) WHERE d.status = 'changed'""",
    "sync_catalog_columns": """
      SELECT tbl, ordinal, attr, data_type FROM current_attributes
      UNION ALL
      SELECT 'warehouse.warehouse.' || table_name, ordinal_position - 1, column_name,
             CASE data_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'VARCHAR' THEN 'string'
               WHEN 'DOUBLE' THEN 'double' WHEN 'FLOAT[]' THEN 'array<float>' ELSE 'timestamp_ntz' END
      FROM information_schema.columns
      WHERE table_name IN ('region','nation','customer','supplier','part','orders','lineitem','events','documents',
                           'embeddings','pages','benchmark','labels','conversations')""",
    "sync_scope": """
      WITH s AS (SELECT s_suppkey AS source_id, s_nationkey AS nk,
        ['postgresql','greenplum','clickhouse','hadoop_spark','postgresql','oracle'][s_suppkey % 6 + 1] AS source_type,
        'db' || s_nationkey AS ns, 's' || s_suppkey % 10 AS sc FROM supplier)
      SELECT source_id, source_type,
        CASE source_type WHEN 'clickhouse' THEN ns WHEN 'oracle' THEN NULL ELSE sc END AS inspect_schema,
        CASE source_type WHEN 'hadoop_spark' THEN sc WHEN 'oracle' THEN NULL ELSE ns END AS result_namespace,
        CASE source_type WHEN 'clickhouse' THEN ns WHEN 'oracle' THEN NULL ELSE sc END AS result_schema,
        CASE WHEN source_type = 'oracle' THEN 'Unsupported source_type: oracle' END AS error FROM s""",
    "sync_sources_masked": """
      SELECT s_suppkey AS source_id, CASE s_suppkey % 4
        WHEN 0 THEN 'postgresql://user' || s_suppkey || ':***@host' || s_suppkey || ':5432/'
        WHEN 1 THEN 'http://***@host/' WHEN 2 THEN 'spark://host' || s_suppkey || ':7077'
        ELSE 'postgresql://u:***@h@x/' END AS dsn FROM supplier""",
    "sync_status": """
      WITH lists AS (
        SELECT source_id, count(*) FILTER (status <> 'removed') AS n,
          coalesce(string_agg('"' || tbl || '"', ',' ORDER BY tbl) FILTER (status = 'changed'), '') AS changed,
          coalesce(string_agg('"' || tbl || '"', ',' ORDER BY tbl) FILTER (status = 'unchanged'), '') AS unchanged,
          coalesce(string_agg('"' || tbl || '"', ',' ORDER BY tbl) FILTER (status = 'removed'), '') AS removed
        FROM half_diff GROUP BY source_id),
      r AS (
        SELECT s AS source_id, coalesce(n, 0) AS n, coalesce(changed, '') AS changed, coalesce(unchanged, '') AS unchanged,
          coalesce(removed, '') AS removed
        FROM (SELECT unnest([1, 2, 3]) AS s) LEFT JOIN lists ON lists.source_id = s)
      SELECT CAST(source_id AS BIGINT) AS source_id, TIMESTAMP '2100-01-01' + to_minutes(CASE source_id WHEN 3 THEN 3 ELSE CAST(source_id AS INT) - 1 END) AS last_run_at,
             TIMESTAMP '2100-01-01' + to_minutes(CAST(source_id AS INT) - 1) AS last_success_at,
             CASE source_id WHEN 3 THEN 'no route to host' END AS last_error,
             '{"actual_tables":' || n || ',"changed_tables":[' || changed || '],"unchanged_tables":[' || unchanged || '],"removed_tables":[' || removed || ']}' AS last_result
      FROM r
      UNION ALL
      SELECT 4, TIMESTAMP '2100-01-01 00:04:00', NULL, 'Unsupported source_type: oracle', NULL""",
    "sync_then_ingest": f"SELECT {_TABLE} FROM synced_versions",
    "stream_raw_lines": "SELECT seq, raw FROM ol_events",
    "stream_ingest_tables": f"SELECT {_TABLE} FROM table_versions",
    "stream_job_runs": "SELECT run_id, status, started_at, finished_at FROM runs",
}

ORACLE = {name: compose(sql) for name, sql in _FINAL.items()}
