"""Change-log tables derived from a folder of events and nations.

One list of common table expressions that Spark SQL and DuckDB both run unchanged.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

CTES = """
change_log AS (
  SELECT event_id + 1 AS seq,
         concat('inst:', CAST(user_id % 4 AS STRING)) AS scope,
         concat(CASE user_id % 3 WHEN 0 THEN 'draft_note' WHEN 1 THEN 'submission' ELSE 'grade' END, '_', CAST(user_id % 4 AS STRING)) AS entity,
         concat('row:', CAST(user_id AS STRING)) AS entity_id,
         CASE WHEN event_type = 'error' THEN 'delete' ELSE 'upsert' END AS op,
         CASE WHEN event_type <> 'error' THEN concat('{"cents":', CAST(CAST(round(value * 100) AS BIGINT) AS STRING), ',"kind":"', event_type, '","props":', props, '}') END AS snapshot,
         event_id + 1 AS row_version,
         CAST(1 + event_id % 3 AS INT) AS schema_version,
         ts AS written_at
  FROM events),
registry AS (
  SELECT DISTINCT entity, scope,
         CASE WHEN entity LIKE 'draft%' THEN 'owner_draft' WHEN entity LIKE 'sub%' THEN 'append_only' ELSE 'server_authoritative' END AS conflict_class,
         CAST(3 AS INT) AS schema_version
  FROM change_log),
command_registry AS (SELECT concat('submit_', entity) AS name, entity FROM registry),
inflight AS (SELECT seq FROM change_log WHERE seq % 997 = 500),
devices AS (
  SELECT n_nationkey AS device_id, concat('inst:', CAST(n_nationkey % 4 AS STRING)) AS scope,
         CAST((n_nationkey * 397) % (SELECT count(*) FROM events) AS BIGINT) AS cursor_seq
  FROM nation),
cursor_history AS (
  SELECT d.device_id, d.scope, CAST(t.step AS BIGINT) AS step,
         CASE WHEN d.device_id % 6 = 5 AND t.step = 4 THEN CAST(0 AS BIGINT)
              ELSE CAST(floor(d.cursor_seq * t.step / 5.0) AS BIGINT) END AS cursor_seq
  FROM devices d CROSS JOIN (VALUES (1), (2), (3), (4), (5)) AS t(step)),
rows_at AS (
  SELECT device_id, scope, entity, entity_id, row_version FROM (
    SELECT d.device_id, l.scope, l.entity, l.entity_id, l.op, l.row_version,
           row_number() OVER (PARTITION BY d.device_id, l.entity, l.entity_id ORDER BY l.seq DESC) AS rn
    FROM devices d JOIN change_log l ON l.scope = d.scope AND l.seq <= d.cursor_seq) x
  WHERE rn = 1 AND op = 'upsert'),
device_rows AS (
  SELECT device_id, scope, entity, entity_id,
         CASE WHEN CAST(substr(entity_id, 5) AS INT) % 17 = 0 THEN row_version + 1 ELSE row_version END AS row_version
  FROM rows_at WHERE CAST(substr(entity_id, 5) AS INT) % 13 <> 0),
claims AS (
  SELECT device_id, scope FROM devices
  UNION ALL
  SELECT device_id, concat('inst:', CAST((device_id + 1) % 4 AS STRING)) AS scope FROM devices WHERE device_id % 2 = 0),
scope_blocks AS (SELECT 'inst:3' AS scope, 'revoked' AS reason),
commands AS (
  SELECT event_id, concat('01910000-0000-7000-8000-', lpad(CAST(event_id AS STRING), 12, '0')) AS id,
         CASE WHEN event_id % 50 = 0 THEN 'unknown_op'
              ELSE concat('submit_', CASE user_id % 3 WHEN 0 THEN 'draft_note' WHEN 1 THEN 'submission' ELSE 'grade' END, '_', CAST(user_id % 4 AS STRING)) END AS name,
         concat('inst:', CAST(user_id % 4 AS STRING)) AS scope,
         concat('{"cents":', CAST(CAST(round(value * 100) AS BIGINT) AS STRING), ',"unit":"eur"}') AS payload,
         ts AS client_ts, CAST(1 + event_id % 3 AS INT) AS schema_version
  FROM events WHERE event_type = 'purchase'),
command_results AS (
  SELECT id AS command_id, md5(payload) AS payload_checksum,
         CASE WHEN event_id % 10 < 8 THEN 'applied' WHEN event_id % 10 = 8 THEN 'superseded' ELSE 'rejected' END AS status,
         CASE WHEN event_id % 10 = 9 THEN 'The term has ended.' END AS reason,
         CASE WHEN event_id % 10 < 8 THEN event_id + 1 END AS server_seq, scope
  FROM commands WHERE event_id % 3 = 0),
submissions AS (
  SELECT CAST(1 AS INT) AS attempt, id, scope, CASE WHEN event_id % 7 = 0 THEN '{"cents":-1}' ELSE payload END AS payload FROM commands
  UNION ALL
  SELECT CAST(2 AS INT) AS attempt, id, scope, concat('{ "unit": "eur", ', substr(replace(payload, ',"unit":"eur"', ''), 2)) AS payload FROM commands WHERE event_id % 5 = 0),
push_results AS (
  SELECT event_id * 2 AS position, id, CASE WHEN event_id % 10 < 8 THEN 'applied' WHEN event_id % 10 = 8 THEN 'superseded' ELSE 'rejected' END AS status,
         CASE WHEN event_id % 10 = 9 AND event_id % 3 <> 0 THEN 'This round is over.' END AS reason
  FROM commands WHERE event_id % 4 <> 0
  UNION ALL
  SELECT event_id * 2 + 1 AS position, id, 'rejected' AS status, 'A second answer.' AS reason FROM commands WHERE event_id % 9 = 0 AND event_id % 4 <> 0
  UNION ALL
  SELECT event_id * 2 + 1 AS position, concat('01910000-0000-7000-9000-', lpad(CAST(event_id AS STRING), 12, '0')) AS id, 'applied' AS status, CAST(NULL AS STRING) AS reason FROM commands WHERE event_id % 11 = 0)
"""


class Tables:
    """The derived tables as attributes: Tables(spark, folder).change_log and so on, each a lazy DataFrame."""

    def __init__(self, spark: SparkSession, folder: str):
        self._spark = spark
        self._ctes = re.sub(r"\bFROM (events|nation)\b", lambda m: f"FROM parquet.`{folder}/{m[1]}.parquet`", CTES)

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.sql(f"SELECT * FROM {name}")

    def sql(self, query: str) -> DataFrame:
        """A query over the derived tables."""
        return self._spark.sql(f"WITH {self._ctes} {query}")
