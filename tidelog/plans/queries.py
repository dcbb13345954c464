"""The engine's operators as queries over the derived change-log tables, each with SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.functions import documents, rules
from tidelog.operators import apply, commands, digest, invariants, log, metrics
from tidelog.sources.fixtures import CTES, Tables

SCOPE, CURSOR, LIMIT, RESUME = "inst:1", 100, 50, 200
BUDGET, TARGET, PROTOCOL = 2_048, 3, 3

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function of the derived tables under its name; sql follows the tables' expressions."""

    def register(f: Callable[[Tables], DataFrame]):
        name = f.__name__
        QUERIES[name] = lambda spark, folder: f(Tables(spark, folder))
        if sql is not None:
            SQL[name] = f"WITH RECURSIVE {CTES} {sql.replace(', RECURSIVE', ',', 1)}"
        return f

    return register


#: Half of the log is stored, the other half is the batch that is applied to it.
_HALF = "(SELECT CAST(floor(max(seq) / 2.0) AS BIGINT) FROM change_log)"
_CHANGE = "seq, scope, entity, entity_id, op, snapshot, row_version, schema_version"
_WM = "(SELECT least(max(seq), coalesce((SELECT min(seq) FROM inflight), max(seq) + 1) - 1) FROM change_log)"


def _latest(where: str, extra: str = "") -> str:
    return f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {extra}entity, entity_id ORDER BY seq DESC) AS rn FROM change_log WHERE {where}) WHERE rn = 1"


def _watermark(t: Tables):
    """A scalar subquery, so that planning runs no job."""
    return log.watermark(t.change_log, t.inflight).scalar()


# -- reading -----------------------------------------------------------------------------------


@query(f"SELECT {_CHANGE} FROM change_log WHERE scope = '{SCOPE}' AND seq > {CURSOR} AND seq <= {_WM} ORDER BY seq LIMIT 501")
def pull_scan(t):
    return log.pull_scan(t.change_log, SCOPE, CURSOR, _watermark(t))


@query(f"""SELECT {_CHANGE}, (SELECT count(*) > {LIMIT} FROM change_log WHERE scope = '{SCOPE}' AND seq > {CURSOR} AND seq <= {_WM}) AS has_more, max(seq) OVER () AS next_cursor
FROM (SELECT * FROM change_log WHERE scope = '{SCOPE}' AND seq > {CURSOR} AND seq <= {_WM} ORDER BY seq LIMIT {LIMIT})""")
def pull_page(t):
    return log.pull_page(t.change_log, SCOPE, CURSOR, _watermark(t), LIMIT)


@query(f"SELECT {_CHANGE} FROM ({_latest(f'''scope = '{SCOPE}' AND seq <= {_WM}''')}) WHERE op <> 'delete' ORDER BY seq LIMIT 501")
def bootstrap_fresh(t):
    return log.bootstrap(t.change_log, SCOPE, 0, _watermark(t))


@query(f"SELECT {_CHANGE} FROM ({_latest(f'''scope = '{SCOPE}' AND seq <= {_WM}''')}) WHERE seq > {RESUME} ORDER BY seq LIMIT 501")
def bootstrap_resume(t):
    return log.bootstrap(t.change_log, SCOPE, RESUME, _watermark(t))


@query(f"SELECT scope, entity, entity_id, row_version, seq FROM ({_latest('true')}) WHERE op = 'upsert'")
def live_rows(t):
    return log.live_rows(t.change_log)


@query("SELECT * FROM rows_at")
def rows_at_cursor(t):
    return log.rows_at(t.devices, t.change_log)


@query("""SELECT d.scope, min(cursor_seq) AS slowest, CAST(count(DISTINCT device_id) AS BIGINT) AS devices, max(h.head) AS head, max(h.head) - min(cursor_seq) AS lag
FROM devices d JOIN (SELECT scope, max(seq) AS head FROM change_log GROUP BY scope) h ON h.scope = d.scope GROUP BY d.scope""")
def scope_lag(t):
    return metrics.scope_lag(t.devices, t.change_log)


@query("""SELECT scope, coalesce(max(CASE WHEN seq < coalesce((SELECT min(i.seq) FROM inflight i JOIN change_log l ON l.seq = i.seq WHERE l.scope = c.scope), 9223372036854775807) THEN seq END), 0) AS visible_head
FROM change_log c GROUP BY scope""")
def visible_head(t):
    return log.visible_head(t.change_log, t.inflight)


_POLLS = "SELECT CAST(p AS BIGINT) AS poll, CAST(floor(m * p / 12.0) AS BIGINT) AS allocated, CAST(floor(m * p / 12.0) AS BIGINT) - 700 AS oldest_open FROM (SELECT max(seq) AS m FROM change_log) CROSS JOIN (VALUES (1),(2),(3),(4),(5),(6),(7),(8),(9),(10),(11),(12)) AS v(p)"


@query(f""", polls AS ({_POLLS}), found AS (SELECT poll, coalesce(min(i.seq) - 1, max(allocated)) AS established FROM polls LEFT JOIN inflight i ON i.seq <= allocated AND i.seq > oldest_open GROUP BY poll)
SELECT poll, established, (SELECT max(established) FROM found g WHERE g.poll <= f.poll) AS recorded FROM found f""")
def commit_watermark(t):
    return log.watermark_polls(t.sql(f"{_POLLS}"), t.inflight)


_CHANGE_TEXT = """concat('{"entity":"', entity, '","entity_id":"', entity_id, '","op":"', op, '","row_version":', row_version, ',"schema_version":', schema_version, ',"seq":', seq,
CASE WHEN snapshot IS NULL THEN '' ELSE ',"snapshot":' || CAST(json(snapshot) AS VARCHAR) END, '}')"""
_BYTES = f"strlen({_CHANGE_TEXT})"
_SIZED = f"sized AS (SELECT scope, seq, CAST(sum({_BYTES} + 1) OVER w + 1 AS BIGINT) AS size, CAST(row_number() OVER w AS BIGINT) AS rn, CAST({_BYTES} AS BIGINT) AS bytes FROM change_log WINDOW w AS (PARTITION BY scope ORDER BY seq))"


@query(f""", {_SIZED}, page AS (SELECT * FROM sized WHERE rn = 1 OR ceil(size / 3.0) <= {BUDGET})
SELECT scope, CAST(count(*) AS BIGINT) AS changes, max(seq) AS next_cursor, max(size) AS bytes, max(seq) < (SELECT max(seq) FROM change_log c WHERE c.scope = p.scope) AS has_more FROM page p GROUP BY scope""")
def byte_budget_page(t):
    return log.byte_budget_page(t.change_log, BUDGET)


@query(f""", RECURSIVE {_SIZED}, pages AS (
  SELECT scope, CAST(-1 AS BIGINT) AS page, CAST(0 AS BIGINT) AS first_seq, CAST(0 AS BIGINT) AS next_cursor, CAST(0 AS BIGINT) AS changes, CAST(0 AS BIGINT) AS bytes, CAST(0 AS BIGINT) AS done, CAST(0 AS BIGINT) AS seen FROM sized WHERE rn = 1
  UNION ALL
  SELECT p.scope, p.page + 1, min(s.seq), max(s.seq), CAST(count(*) AS BIGINT), CAST(max(s.size) - 1 - p.done + 1 AS BIGINT), CAST(max(s.size) - 1 AS BIGINT), CAST(max(s.rn) AS BIGINT)
  FROM pages p JOIN sized s ON s.scope = p.scope AND s.rn > p.seen AND (s.rn = p.seen + 1 OR ceil((s.size - p.done) / 3.0) <= {BUDGET}) GROUP BY p.scope, p.page, p.done)
SELECT scope, page, first_seq, next_cursor, changes, bytes FROM pages WHERE page >= 0""")
def catch_up_walk(t):
    return log.catch_up_walk(t.change_log, BUDGET)


# -- digests -----------------------------------------------------------------------------------

_H = "md5(concat(CAST(length(entity) AS VARCHAR), ':', entity, CAST(length(entity_id) AS VARCHAR), ':', entity_id, CAST(row_version AS VARCHAR)))"


def _hex(i: int) -> str:
    return f"sum(CAST(('0x' || substr(h, {8 * i + 1}, 8)) AS BIGINT))"


def _digest(rows: str, by: str) -> str:
    """The four limbs are carried as HUGEINTs."""
    sums = f"SELECT {by}, CAST(count(*) AS BIGINT) AS rows, " + ", ".join(f"CAST({_hex(i)} AS HUGEINT) AS s{i}" for i in range(4)) + f" FROM (SELECT *, {_H} AS h FROM ({rows})) GROUP BY {by}"
    m = "4294967296"
    c2, c1 = f"(s2 + s3 // {m})", f"(s1 + (s2 + s3 // {m}) // {m})"
    c0 = f"(s0 + {c1} // {m})"
    words = [f"{c0} % {m}", f"{c1} % {m}", f"{c2} % {m}", f"s3 % {m}"]
    text = " || ".join(f"lpad(lower(to_hex(CAST({w} AS BIGINT))), 8, '0')" for w in words)
    return f"SELECT {by}, rows, {text} AS digest FROM ({sums})"


@query(_digest(f"SELECT * FROM ({_latest('true')}) WHERE op = 'upsert'", "scope"))
def scope_digest(t):
    return digest.digest(log.live_rows(t.change_log), "scope")


@query()
def scope_digest_xxh3(t):
    rows = log.live_rows(t.change_log)
    return digest.digest(rows, "scope", row_hash=documents.row_hash("entity", "entity_id", "row_version"))


@query()
def batch_checksum(t):
    """The checksum of each page of 100 changes: XXH3 of the canonical array of its changes in order."""
    page = F.floor((F.col("rn") - 1) / 100).alias("page")
    item = log.change_text()
    numbered = log.running(t.change_log, "scope", "seq", rn=F.lit(1).cast("long"))
    rows = numbered.select("scope", page, F.struct("seq", item.alias("item")).alias("c")).groupBy("scope", "page").agg(F.array_sort(F.collect_list("c")).alias("c"))
    text = F.concat(F.lit("["), F.array_join("c.item", ","), F.lit("]"))
    return rows.select("scope", "page", F.size("c").alias("changes"), documents.xxh3(text).alias("checksum"))


_DEVICE = _digest("SELECT * FROM device_rows", "device_id, scope")
_SERVER = _digest("SELECT * FROM rows_at", "device_id, scope")
_PAIR = f", dd AS ({_DEVICE}), sd AS ({_SERVER})"
_ZERO = "'" + "0" * 32 + "'"


@query(f"""{_PAIR} SELECT d.device_id, d.scope, d.cursor_seq < (SELECT max(seq) FROM change_log c WHERE c.scope = d.scope) AS has_more, coalesce(dd.digest, {_ZERO}) <> coalesce(sd.digest, {_ZERO}) AS differs,
CASE WHEN NOT d.cursor_seq < (SELECT max(seq) FROM change_log c WHERE c.scope = d.scope) THEN coalesce(dd.digest, {_ZERO}) <> coalesce(sd.digest, {_ZERO}) END AS diverged
FROM devices d LEFT JOIN dd ON dd.device_id = d.device_id LEFT JOIN sd ON sd.device_id = d.device_id""")
def divergence(t):
    """Digests are compared on the last page only; before it a difference means nothing."""
    own = digest.digest(t.device_rows, "device_id").select("device_id", F.col("digest").alias("own"))
    server = digest.digest(log.rows_at(t.devices, t.change_log), "device_id").select("device_id", F.col("digest").alias("server"))
    rows = t.devices.join(log.scope_heads(t.change_log), "scope").join(own, "device_id", "left").join(server, "device_id", "left")
    zero, more = F.lit("0" * 32), F.col("cursor_seq") < F.col("head")
    differs = F.coalesce("own", zero) != F.coalesce("server", zero)
    return rows.select("device_id", "scope", more.alias("has_more"), differs.alias("differs"), F.when(~more, differs).alias("diverged"))


# -- applying ----------------------------------------------------------------------------------

_BATCHES = """SELECT scope, batch, position, CASE WHEN seq % 331 = 7 THEN seq - 60 WHEN seq % 887 = 3 THEN first_seq - 5 ELSE seq END AS seq, op,
CASE WHEN seq % 557 = 11 THEN NULL ELSE snapshot END AS snapshot, first_seq - 1 AS cursor, CASE WHEN batch % 9 = 4 THEN last_seq - 1 ELSE last_seq END AS next_cursor
FROM (SELECT *, min(seq) OVER (PARTITION BY scope, batch) AS first_seq, max(seq) OVER (PARTITION BY scope, batch) AS last_seq FROM
(SELECT *, CAST(floor((rn - 1) / 40.0) AS BIGINT) AS batch, CAST((rn - 1) % 40 AS BIGINT) AS position FROM (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY seq) AS rn FROM change_log)))"""


@query(f""", b AS ({_BATCHES}), k AS (SELECT *, CASE WHEN seq <= cursor THEN 'already_applied' WHEN seq <= lag(seq) OVER (PARTITION BY scope, batch ORDER BY position) THEN 'out_of_order'
WHEN (op = 'upsert') <> (snapshot IS NOT NULL) THEN 'inconsistent' END AS kind FROM b), f AS (SELECT scope, batch, min(position) AS position FROM k WHERE kind IS NOT NULL GROUP BY ALL)
SELECT a.scope, a.batch, f.position, coalesce(k.kind, CASE WHEN a.next_cursor < a.last THEN 'cursor_would_regress' END) AS violation
FROM (SELECT scope, batch, max(seq) AS last, max(next_cursor) AS next_cursor FROM b GROUP BY ALL) a LEFT JOIN f ON f.scope = a.scope AND f.batch = a.batch LEFT JOIN k ON k.scope = a.scope AND k.batch = a.batch AND k.position = f.position
WHERE k.kind IS NOT NULL OR a.next_cursor < a.last""")
def batch_order_violations(t):
    return apply.batch_order_violations(t.sql(f"{_BATCHES}"))


def _batch(t):
    return t.sql(f"SELECT * FROM change_log WHERE seq > {_HALF}")


def _stored(t):
    return log.live_rows(t.sql(f"SELECT * FROM change_log WHERE seq <= {_HALF}"))


_STORED = f"SELECT * FROM ({_latest(f'seq <= {_HALF}')}) WHERE op = 'upsert'"
_IN = f"seq > {_HALF}"
_STAGED = f"""SELECT b.*, CASE WHEN b.prev_op = 'upsert' THEN b.prev_version WHEN b.prev_op IS NULL THEN s.row_version END AS held
FROM (SELECT *, lag(op) OVER k AS prev_op, lag(row_version) OVER k AS prev_version FROM change_log WHERE {_IN} WINDOW k AS (PARTITION BY entity, entity_id ORDER BY seq)) b
LEFT JOIN ({_STORED}) s ON s.entity = b.entity AND s.entity_id = b.entity_id"""


@query(f"SELECT scope, seq, entity, entity_id, op, row_version, held AS held_version, CASE WHEN op = 'upsert' AND held IS NOT NULL THEN 'update' WHEN op = 'upsert' THEN 'add' WHEN held IS NOT NULL THEN 'remove' ELSE 'noop' END AS effect FROM ({_STAGED})")
def stage_changes(t):
    return apply.stage_changes(_batch(t), _stored(t))


_AFTER = f"SELECT * FROM ({_latest('true')}) WHERE op = 'upsert'"


@query(f"SELECT scope, entity, entity_id, row_version FROM ({_AFTER})")
def apply_batch_state(t):
    return apply.apply_batch(_batch(t), _stored(t))


@query(f"SELECT scope, digest FROM ({_digest(_AFTER, 'scope')})")
def advanced_digest(t):
    """The digest after a batch from that before it and the batch's changes: equal to the digest of the rows."""
    stored = _stored(t)
    return apply.advanced_digest(stored, apply.digest_change(apply.stage_changes(_batch(t), stored)))


@query("""SELECT scope, seq, entity, entity_id, stored, row_version AS incoming FROM (SELECT l.*, lag(l.op) OVER w AS prev_op, lag(row_version) OVER w AS stored
FROM change_log l WHERE entity IN (SELECT entity FROM registry WHERE conflict_class = 'append_only') WINDOW w AS (PARTITION BY entity, entity_id ORDER BY seq)) WHERE op = 'upsert' AND prev_op = 'upsert' AND stored <> row_version""")
def append_only_overwrites(t):
    return apply.append_only_overwrites(t.change_log, t.registry)


@query(f"""SELECT i.seq, i.entity, i.entity_id, i.offered AS incoming_version, s.row_version AS stored_version, CASE WHEN i.offered > s.row_version THEN 'incoming' WHEN i.offered < s.row_version THEN 'stored' ELSE 'tie' END AS winner
FROM (SELECT *, CASE WHEN seq % 5 = 0 THEN seq - {_HALF} WHEN seq % 5 = 1 THEN (SELECT max(row_version) FROM ({_STORED})) ELSE row_version END AS offered FROM change_log WHERE {_IN}) i JOIN ({_STORED}) s ON s.entity = i.entity AND s.entity_id = i.entity_id""")
def lww(t):
    top = _stored(t).agg(F.max("row_version").alias("top")).scalar()
    half = t.sql(f"SELECT {_HALF} AS half").scalar()
    offered = F.when(F.col("seq") % 5 == 0, F.col("seq") - half).when(F.col("seq") % 5 == 1, top).otherwise(F.col("row_version"))
    return apply.lww(_batch(t).withColumn("row_version", offered), _stored(t))


#: A batch for each scope: inst:1 skips back once, inst:2 writes over append-only rows, inst:3 has no change, inst:0 is sound.
_STEP_CHANGES = f"""SELECT scope, CAST(row_number() OVER (PARTITION BY scope ORDER BY seq) - 1 AS BIGINT) AS position, CASE WHEN scope = 'inst:1' AND seq % 50 = 1 THEN seq - 40 ELSE seq END AS seq,
entity, entity_id, op, snapshot, row_version FROM change_log WHERE {_IN} AND scope <> 'inst:3' AND (entity NOT LIKE 'sub%' OR scope = 'inst:2')"""
_STEP_HEADERS = "SELECT scope, max(seq) AS next_cursor FROM change_log GROUP BY scope"
_STEP_CURSORS = f"SELECT scope, {_HALF} AS cursor FROM change_log GROUP BY scope"


def _applied(t):
    return apply.apply_step(t.sql(_STEP_CHANGES), t.sql(_STEP_HEADERS), _stored(t), t.sql(_STEP_CURSORS), t.registry)


_ORDER = f"""SELECT scope, position, CASE WHEN seq <= {_HALF} THEN 'already_applied' WHEN seq <= lag(seq) OVER (PARTITION BY scope ORDER BY position) THEN 'out_of_order' WHEN (op = 'upsert') <> (snapshot IS NOT NULL) THEN 'inconsistent' END AS violation FROM c"""
_OVER = f"""SELECT c.scope, c.position, 'append_only_overwrite' AS violation FROM c JOIN (SELECT position, scope, lag(op) OVER k AS prev_op, lag(row_version) OVER k AS prev_version FROM c WINDOW k AS (PARTITION BY entity, entity_id ORDER BY seq)) p ON p.scope = c.scope AND p.position = c.position
LEFT JOIN ({_STORED}) s ON s.entity = c.entity AND s.entity_id = c.entity_id
WHERE c.op = 'upsert' AND c.entity LIKE 'sub%' AND (p.prev_op = 'upsert' AND p.prev_version <> c.row_version OR p.prev_op IS NULL AND s.row_version <> c.row_version)"""
_REFUSED = f""", c AS ({_STEP_CHANGES}), v AS (SELECT *, 0 AS rank FROM ({_ORDER}) WHERE violation IS NOT NULL UNION ALL SELECT *, 1 FROM ({_OVER})),
refused AS (SELECT scope, position, violation FROM (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY rank, position) AS rn FROM v) WHERE rn = 1)"""


@query(f"{_REFUSED} SELECT * FROM refused")
def refused_batches(t):
    """Batches that are refused whole, with the first rule that they break."""
    return _applied(t).refused


@query(f"{_REFUSED} SELECT scope, CASE WHEN scope IN (SELECT scope FROM refused) THEN cursor ELSE next_cursor END AS cursor FROM ({_STEP_CURSORS}) JOIN ({_STEP_HEADERS}) USING (scope)")
def advanced_cursors(t):
    """Cursors after a step: a refused scope keeps its own, an empty batch moves it all the same."""
    return _applied(t).cursors


@query(f"""{_REFUSED}, fit AS (SELECT * FROM c WHERE scope NOT IN (SELECT scope FROM refused)), last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity, entity_id ORDER BY seq DESC) AS rn FROM fit) WHERE rn = 1),
after AS (SELECT scope, entity, entity_id, row_version FROM last WHERE op = 'upsert' UNION ALL SELECT scope, entity, entity_id, row_version FROM ({_STORED}) s WHERE NOT EXISTS (SELECT 1 FROM last l WHERE l.entity = s.entity AND l.entity_id = s.entity_id))
SELECT a.*, d.digest FROM after a JOIN ({_digest('SELECT * FROM after', 'scope')}) d ON d.scope = a.scope""")
def applied_rows(t):
    """Live rows after a step, with the digest of their scope that the step's changes gave."""
    done = _applied(t)
    return done.rows.join(done.digests, "scope")


_STEPS = "SELECT r.entity, CAST(v AS INT) AS from_version FROM registry r CROSS JOIN (VALUES (1), (2)) AS s(v) WHERE NOT (r.conflict_class = 'append_only' AND v = 2)"
_ROWS = f"SELECT * FROM ({_latest('true')}) WHERE op = 'upsert'"


def _migration(t):
    rows = log.latest(t.change_log).where("op = 'upsert'").join(t.registry.select("entity", F.col("schema_version").alias("target")), "entity", "left")
    return rows, t.sql(f"{_STEPS}")


_PLAN = f"""plan AS (SELECT r.entity, r.schema_version, {TARGET} AS target, (SELECT min(v) FROM (VALUES (1), (2)) AS n(v) WHERE v >= r.schema_version AND v < {TARGET} AND NOT EXISTS (SELECT 1 FROM ({_STEPS}) s WHERE s.entity = r.entity AND s.from_version = v)) AS stuck_at
FROM (SELECT DISTINCT entity, schema_version FROM ({_ROWS})) r)"""
_STATUS = f"CASE WHEN schema_version = {TARGET} THEN 'identity' WHEN schema_version > {TARGET} THEN 'backward' WHEN stuck_at IS NOT NULL THEN 'no_path' ELSE 'ready' END"


@query(f", {_PLAN} SELECT entity, schema_version, CAST(target AS INT) AS target, CAST(stuck_at AS INT) AS stuck_at, {_STATUS} AS status FROM plan")
def migration_plan(t):
    return apply.migration_plan(*_migration(t))


def _step(v: int):
    """The step from version 2 fails on amounts that end in 7."""
    out = F.concat(F.expr("substring(snapshot, 1, length(snapshot) - 1)"), F.lit(f',"v{v + 1}":{v + 1}}}'))
    return out if v == 1 else F.when(~F.col("snapshot").rlike('"cents":[0-9]*7,'), out)


def _migrated(t):
    rows, steps = _migration(t)
    return apply.migrated(rows, steps, {v: _step(v) for v in (1, 2)})


_JOINED = f"""SELECT l.entity, l.entity_id, l.row_version, l.schema_version, l.snapshot, CASE WHEN {_STATUS.replace('schema_version', 'l.schema_version')} = 'ready' AND regexp_matches(l.snapshot, '"cents":[0-9]*7,') THEN 'failed' ELSE {_STATUS.replace('schema_version', 'l.schema_version')} END AS status FROM ({_ROWS}) l JOIN plan p ON p.entity = l.entity AND p.schema_version = l.schema_version"""


@query(f""", {_PLAN} SELECT entity, entity_id, row_version, status, CASE WHEN status = 'ready' AND schema_version = 1 THEN substr(snapshot, 1, length(snapshot) - 1) || ',"v2":2,"v3":3}}'
WHEN status = 'ready' THEN substr(snapshot, 1, length(snapshot) - 1) || ',"v3":3}}' ELSE snapshot END AS snapshot FROM ({_JOINED}) WHERE status NOT IN ('no_path', 'failed')""")
def migrate_rows(t):
    return _migrated(t).where("status not in ('no_path', 'failed')").select("entity", "entity_id", "row_version", "status", "snapshot")


@query(f", {_PLAN} SELECT entity, entity_id, row_version, schema_version, status, snapshot FROM ({_JOINED}) WHERE status IN ('no_path', 'failed')")
def quarantine(t):
    """Rows without a path and rows of which a step failed keep their bytes and their version."""
    return _migrated(t).where("status in ('no_path', 'failed')").select("entity", "entity_id", "row_version", "schema_version", "status", "snapshot")


@query(_digest(f"SELECT * FROM ({_latest('true')}) WHERE op = 'upsert'", "scope"))
def digest_with_quarantine(t):
    """The digest of the migrated and the quarantined rows together: quarantine takes no row out of it."""
    rows = _migrated(t)
    return digest.digest(rows.where("status not in ('no_path', 'failed')").unionByName(rows.where("status in ('no_path', 'failed')")), "scope")


def _observations(t):
    diverged = (F.col("device_id") + F.col("step") * (F.col("device_id") % 3 + 1)) % 3 == 0
    return t.cursor_history.select("device_id", "scope", "step", diverged.alias("diverged"), (F.col("step") % 2 == 0).alias("rebuilding"), ((F.col("device_id") + F.col("step")) % 7 != 0).alias("compared"))


_HEALTH = """, RECURSIVE o AS (SELECT device_id, scope, step, (device_id + step * (device_id % 3 + 1)) % 3 = 0 AS diverged, step % 2 = 0 AS rebuilding, (device_id + step) % 7 <> 0 AS compared FROM cursor_history),
h AS (SELECT device_id, scope, CAST(0 AS BIGINT) AS step, 'healthy' AS state, CAST(0 AS BIGINT) AS attempts FROM devices
UNION ALL SELECT o.device_id, o.scope, o.step,
  CASE WHEN h.state = 'unhealable' OR NOT o.compared THEN h.state WHEN o.diverged AND (h.state IN ('healthy', 'healed') OR o.rebuilding) THEN CASE WHEN h.attempts >= 2 THEN 'unhealable' ELSE 'tainted' END
    WHEN NOT o.diverged AND h.state = 'tainted' THEN 'healed' ELSE h.state END,
  h.attempts + CASE WHEN h.state <> 'unhealable' AND o.compared AND o.diverged AND (h.state IN ('healthy', 'healed') OR o.rebuilding) THEN 1 ELSE 0 END
FROM h JOIN o ON o.device_id = h.device_id AND o.scope = h.scope AND o.step = h.step + 1)"""


@query(f"{_HEALTH} SELECT * FROM h WHERE step > 0")
def scope_health(t):
    return apply.scope_health(_observations(t))


@query(f"{_HEALTH} SELECT device_id, scope, attempts FROM h WHERE step = 5 AND state = 'tainted'")
def scopes_to_rebuild(t):
    return apply.scopes_to_rebuild(apply.scope_health(_observations(t)))


@query("SELECT * FROM device_rows WHERE NOT (device_id % 4 = 1 AND entity IN (SELECT r.entity FROM registry r WHERE r.scope = device_rows.scope))")
def rebootstrap_clear(t):
    rebuilt = t.devices.where("device_id % 4 = 1")
    return apply.rebootstrap_clear(t.device_rows, rebuilt, t.registry).select("device_id", "scope", "entity", "entity_id", "row_version")


# -- access and versions -----------------------------------------------------------------------


@query("SELECT device_id, scope FROM claims WHERE scope NOT IN (SELECT scope FROM scope_blocks)")
def authorized_scopes(t):
    """Claims name whole scopes; a blocked scope is refused whatever is claimed."""
    return t.claims.join(t.scope_blocks.select("scope"), "scope", "left_anti").select("device_id", "scope")


@query(f"SELECT device_id, device_id % 5 + 1 AS version, CASE WHEN device_id % 5 + 1 > {PROTOCOL} THEN 'client_too_new' WHEN device_id % 5 + 1 < {PROTOCOL - 1} THEN 'client_too_old' ELSE 'accepted' END AS verdict FROM devices")
def version_negotiation(t):
    version = F.col("device_id") % 5 + 1
    return t.devices.select("device_id", version.alias("version"), rules.version_verdict(version, PROTOCOL).alias("verdict"))


# -- commands ----------------------------------------------------------------------------------


def _decided(t):
    return commands.decide(t.submissions, t.command_results)


#: A payload's keys are cents and, if it has one, unit.
_CANON = """concat('{{"cents":', json_extract({0}, '$.cents'), CASE WHEN json_exists({0}, '$.unit') THEN concat(',"unit":', json_extract({0}, '$.unit')) ELSE '' END, '}}')"""
_DECIDED = f"""SELECT s.*, r.status, r.reason, CASE WHEN r.payload_checksum IS NULL THEN 'fresh' WHEN r.payload_checksum = md5({_CANON.format('s.payload')}) THEN 'replay' ELSE 'mutated' END AS decision
FROM submissions s LEFT JOIN command_results r ON r.command_id = s.id"""


@query(f"SELECT attempt, id, decision FROM ({_DECIDED})")
def dedupe_decide(t):
    return _decided(t).select("attempt", "id", "decision")


@query(f"""SELECT CAST(count(*) FILTER (decision = 'fresh') AS BIGINT) AS fresh, CAST(count(*) FILTER (decision = 'replay') AS BIGINT) AS replays, CAST(count(*) FILTER (decision = 'mutated') AS BIGINT) AS mutated, CAST(count(*) AS BIGINT) AS total,
CASE WHEN count(*) > 0 THEN count(*) FILTER (decision = 'replay') / CAST(count(*) AS DOUBLE) ELSE 0.0 END AS hit_rate FROM ({_DECIDED})""")
def dedupe_stats(t):
    return commands.dedupe_stats(_decided(t))


@query(f"SELECT id AS command_id, scope, md5({_CANON.format('payload')}) AS payload_checksum FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY attempt) AS rn FROM submissions) WHERE rn = 1 AND id NOT IN (SELECT command_id FROM command_results)")
def record_first_wins(t):
    return commands.record_first_wins(t.submissions, t.command_results)


@query("""SELECT c.id, c.name, k.entity, CASE WHEN k.entity IS NULL THEN 'unknown_command' WHEN r.entity IS NULL THEN 'unknown_entity' WHEN r.conflict_class = 'server_authoritative' THEN 'server_authoritative' ELSE 'accepted' END AS verdict
FROM commands c LEFT JOIN command_registry k ON k.name = c.name LEFT JOIN registry r ON r.entity = k.entity""")
def command_admission(t):
    return commands.admission(t.commands, t.command_registry, t.registry)


_FIRST = "SELECT id, status, reason FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY position) AS rn FROM push_results) WHERE rn = 1"


@query(f"""SELECT d.attempt, d.id, d.decision, CASE d.decision WHEN 'replay' THEN d.status WHEN 'mutated' THEN 'rejected' ELSE coalesce(o.status, 'unresolved') END AS answer, d.decision = 'fresh' AND o.status IS NOT NULL AS recorded
FROM ({_DECIDED}) d LEFT JOIN ({_FIRST}) o ON o.id = d.id""")
def forward_outcomes(t):
    return commands.forward(_decided(t), commands.first_answers(t.push_results).withColumnRenamed("status", "outcome"))


@query(f"SELECT c.id, CASE WHEN o.status = 'rejected' THEN 'dead_lettered' ELSE coalesce(o.status, 'queued') END AS resolution, CASE WHEN o.status = 'rejected' THEN coalesce(o.reason, '{commands.NO_REASON}') END AS reason FROM commands c LEFT JOIN ({_FIRST}) o ON o.id = c.id")
def resolve_outbox(t):
    return commands.resolve_outbox(t.commands, t.push_results)


@query("SELECT CAST(count(*) AS BIGINT) AS results, CAST(count(*) - count(DISTINCT id) AS BIGINT) AS repeated, CAST(count(DISTINCT id) FILTER (id NOT IN (SELECT id FROM commands)) AS BIGINT) AS unknown FROM push_results")
def push_result_counts(t):
    unknown = t.push_results.select("id").distinct().join(t.commands.select("id"), "id", "left_anti").agg(F.count("*").alias("unknown"))
    all_ = t.push_results.agg(F.count("*").alias("results"), (F.count("*") - F.count_distinct("id")).alias("repeated"))
    return all_.join(unknown)


@query(f"SELECT c.id, k.entity, c.scope, c.payload FROM commands c JOIN ({_FIRST}) o ON o.id = c.id AND o.status = 'superseded' JOIN command_registry k ON k.name = c.name JOIN registry r ON r.entity = k.entity AND r.conflict_class = 'owner_draft'")
def recovered_drafts(t):
    return commands.recovered_drafts(t.commands, t.push_results, t.command_registry, t.registry)


@query("SELECT command_id, scope, reason FROM command_results WHERE status = 'rejected'")
def dead_letters(t):
    return t.command_results.where("status = 'rejected'").select("command_id", "scope", "reason")


@query("SELECT scope, CAST(count(*) AS BIGINT) AS results, CAST(count(*) FILTER (status = 'rejected') AS BIGINT) AS rejected, count(*) FILTER (status = 'rejected') / CAST(count(*) AS DOUBLE) AS reject_rate FROM command_results GROUP BY scope")
def reject_rates(t):
    return commands.reject_rates(t.command_results)


_COMMAND = """concat('{{"checksum":"', md5({0}), '","client_ts":', epoch_ms(client_ts), ',"id":"', id, '","name":"', c.name, '","payload":', {0}, ',"scope":"', c.scope, '"}}')"""
_OUTBOX = f"""SELECT c.*, CASE WHEN r.entity IS NULL OR c.schema_version = {TARGET} THEN payload WHEN r.conflict_class = 'append_only' OR c.schema_version <= 2 AND payload LIKE '%7,"unit"%' THEN NULL
WHEN c.schema_version = 1 THEN replace(payload, '}}', ',"v2":2,"v3":3}}') ELSE replace(payload, '}}', ',"v3":3}}') END AS migrated
FROM commands c LEFT JOIN command_registry k ON k.name = c.name LEFT JOIN registry r ON r.entity = k.entity WHERE c.id NOT IN (SELECT command_id FROM command_results)"""


def _payload_step(v: int):
    out = F.concat(F.expr("substring(snapshot, 1, length(snapshot) - 1)"), F.lit(f',"v{v + 1}":{v + 1}}}'))
    return out if v == 1 else F.when(~F.col("snapshot").rlike('"cents":-?[0-9]*7,'), out)


def _outbox(t):
    waiting = t.commands.join(t.command_results.select(F.col("command_id").alias("id")), "id", "left_anti")
    return commands.migrated_outbox(waiting, t.command_registry, t.registry, t.sql(_STEPS), {v: _payload_step(v) for v in (1, 2)})


@query(f""", q AS (SELECT scope, event_id, id, strlen({_COMMAND.format('migrated')}) AS bytes FROM ({_OUTBOX}) c WHERE migrated IS NOT NULL),
n AS (SELECT *, row_number() OVER w AS position, CAST(sum(bytes + 1) OVER w + 1 AS BIGINT) AS total FROM q WINDOW w AS (PARTITION BY scope ORDER BY event_id))
SELECT scope, id, CAST(position AS BIGINT) AS position, total FROM n WHERE position = 1 OR (position <= 256 AND total <= 1048576 AND ceil(total / 3.0) <= {BUDGET})""")
def build_push(t):
    """Commands are brought to their entity's version first; those without a way forward are held."""
    return commands.build_push(_outbox(t), BUDGET)


@query(f"SELECT id, schema_version, payload FROM ({_OUTBOX}) WHERE migrated IS NULL")
def held_commands(t):
    """Queued commands that can't be migrated: they stay queued, unchanged."""
    return _outbox(t).where("held").select("id", "schema_version", "payload")


@query(f"""SELECT scope, CAST(count(*) AS BIGINT) AS commands, CAST(sum(strlen({_COMMAND.format('payload')}) + 1) + 1 AS BIGINT) AS bytes, CASE WHEN count(*) > 256 THEN 'too_many' WHEN sum(strlen({_COMMAND.format('payload')}) + 1) + 1 > 1048576 THEN 'too_large' END AS violation
FROM commands c GROUP BY scope""")
def push_limit_check(t):
    return commands.push_limits(t.commands)


@query("SELECT device_id, CAST(count(DISTINCT scope) AS BIGINT) AS scopes, CASE WHEN count(DISTINCT scope) > 64 THEN 'too_many_scopes' END AS violation FROM (SELECT device_id, scope FROM claims UNION ALL SELECT 99, entity_id FROM change_log) GROUP BY device_id")
def pull_limit_check(t):
    return commands.request_limits(t.claims.unionByName(t.change_log.select(F.lit(99).alias("device_id"), F.col("entity_id").alias("scope"))), "device_id")


_OFFERS = "SELECT scope, CAST(event_id % 13 AS BIGINT) AS offered, CAST(1 + event_id % 4 AS BIGINT) AS severity, event_id FROM commands"


@query(f"SELECT event_id, CASE WHEN severity = 1 THEN 4096 ELSE CAST(greatest(floor(4096 / severity), 1500) AS BIGINT) END AS budget, CASE WHEN offered = 0 THEN 0 WHEN severity = 1 THEN offered ELSE CAST(greatest(floor(offered / severity), 1) AS BIGINT) END AS taken FROM ({_OFFERS})")
def load_shedding(t):
    """The page's budget and the commands looked at, by the load's severity."""
    offered, severity = F.col("offered"), F.col("severity")
    return t.sql(_OFFERS).select("event_id", commands.shed_budget(severity, 4096, 1500).alias("budget"), commands.accepted(offered, severity).alias("taken"))


@query(f"""SELECT CAST(count(*) AS BIGINT) AS pushes, CAST(count(*) FILTER (severity > 1) AS BIGINT) AS shed, CAST(sum(taken) AS BIGINT) AS taken, CAST(sum(offered - taken) AS BIGINT) AS deferred
FROM (SELECT *, CASE WHEN offered = 0 THEN 0 WHEN severity = 1 THEN offered ELSE CAST(greatest(floor(offered / severity), 1) AS BIGINT) END AS taken FROM ({_OFFERS}))""")
def backpressure_totals(t):
    return commands.backpressure(t.sql(_OFFERS))


# -- malformed rows ----------------------------------------------------------------------------

_BAD_CHANGES = """SELECT CASE WHEN seq % 97 = 1 THEN -seq ELSE seq END AS seq, CASE WHEN seq % 101 = 2 THEN 'a b' ELSE scope END AS scope, CASE WHEN seq % 103 = 3 THEN upper(entity) ELSE entity END AS entity,
CASE WHEN seq % 107 = 4 THEN '' ELSE entity_id END AS entity_id, CASE WHEN seq % 109 = 5 THEN 'patch' ELSE op END AS op, CASE WHEN seq % 113 = 6 THEN NULL ELSE snapshot END AS snapshot,
CASE WHEN seq % 127 = 7 THEN 0 ELSE row_version END AS row_version, CASE WHEN seq % 131 = 8 THEN 70000 ELSE schema_version END AS schema_version FROM change_log"""


@query(f"""SELECT * FROM (SELECT seq, CASE WHEN NOT regexp_full_match(scope, '[A-Za-z0-9:_-]{{1,128}}') THEN 'scope' WHEN NOT regexp_full_match(entity, '[a-z0-9_]{{1,64}}') THEN 'entity' WHEN NOT regexp_full_match(entity_id, '[!-~]{{1,64}}') THEN 'entity_id'
WHEN op NOT IN ('upsert', 'delete') THEN 'op' WHEN (op = 'upsert') <> (snapshot IS NOT NULL) THEN 'op_snapshot' WHEN row_version < 1 THEN 'row_version' WHEN schema_version NOT BETWEEN 1 AND 65535 THEN 'schema_version' WHEN seq < 1 THEN 'seq' END AS error FROM ({_BAD_CHANGES})) WHERE error IS NOT NULL""")
def corrupt_changes(t):
    return t.sql(f"{_BAD_CHANGES}").select("seq", rules.change_error().alias("error")).where("error is not null")


_BAD_RESULTS = """SELECT CASE WHEN server_seq % 7 = 1 THEN upper(command_id) || 'X' ELSE command_id END AS command_id, CASE WHEN server_seq % 11 = 2 THEN 'abc' ELSE payload_checksum END AS payload_checksum,
CASE WHEN server_seq % 13 = 3 THEN 'done' ELSE status END AS status, CASE WHEN scope = 'inst:2' THEN NULL ELSE reason END AS reason, CASE WHEN server_seq % 17 = 4 THEN 0 ELSE server_seq END AS server_seq FROM command_results"""


@query(f"""SELECT * FROM (SELECT command_id, CASE WHEN NOT regexp_full_match(command_id, '[0-9a-f]{{8}}-[0-9a-f]{{4}}-7[0-9a-f]{{3}}-[0-9a-f]{{4}}-[0-9a-f]{{12}}') THEN 'command_id' WHEN NOT regexp_full_match(payload_checksum, '[0-9a-f]{{32}}') THEN 'payload_checksum'
WHEN status NOT IN ('applied', 'superseded', 'rejected') THEN 'status' WHEN status = 'rejected' AND reason IS NULL THEN 'rejected_reason' WHEN length(reason) > 256 OR reason = '' THEN 'reason' WHEN server_seq < 1 THEN 'server_seq' END AS error FROM ({_BAD_RESULTS})) WHERE error IS NOT NULL""")
def corrupt_results(t):
    return t.sql(f"{_BAD_RESULTS}").select("command_id", rules.result_error().alias("error")).where("error is not null")


_BAD_COMMANDS = """SELECT CASE WHEN event_id % 11 = 1 THEN replace(id, '-7000-', '-4000-') ELSE id END AS id, CASE WHEN event_id % 13 = 2 THEN 'Submit It' ELSE name END AS name, CASE WHEN event_id % 17 = 3 THEN '' ELSE scope END AS scope,
CASE WHEN event_id % 19 = 4 THEN '' ELSE payload END AS payload, CASE WHEN event_id % 23 = 5 THEN 0 ELSE schema_version END AS schema_version FROM commands"""


@query(f"""SELECT * FROM (SELECT id, CASE WHEN NOT regexp_full_match(id, '[0-9a-f]{{8}}-[0-9a-f]{{4}}-7[0-9a-f]{{3}}-[0-9a-f]{{4}}-[0-9a-f]{{12}}') THEN 'id' WHEN NOT regexp_full_match(name, '[a-z0-9_]{{1,64}}') THEN 'name' WHEN NOT regexp_full_match(scope, '[A-Za-z0-9:_-]{{1,128}}') THEN 'scope'
WHEN octet_length(encode(payload)) NOT BETWEEN 2 AND 65536 THEN 'payload' WHEN schema_version NOT BETWEEN 1 AND 65535 THEN 'schema_version' END AS error FROM ({_BAD_COMMANDS})) WHERE error IS NOT NULL""")
def corrupt_commands(t):
    return t.sql(f"{_BAD_COMMANDS}").select("id", rules.command_error().alias("error")).where("error is not null")


def _documents(t):
    text = F.when(F.col("seq") % 50 == 1, F.regexp_replace("snapshot", '"cents":', '"cents":1.5,"c":')).when(F.col("seq") % 50 == 2, F.concat(F.lit("["), "snapshot", F.lit("]"))).when(F.col("seq") % 50 == 3, F.expr("substring(snapshot, 2)"))
    return t.change_log.where("snapshot is not null").select("seq", F.coalesce(text, "snapshot").alias("document"))


@query("""SELECT seq, CASE seq % 50 WHEN 1 THEN 'float' WHEN 2 THEN 'not an object' ELSE 'not json' END AS violation FROM change_log WHERE snapshot IS NOT NULL AND seq % 50 IN (1, 2, 3)""")
def document_violations(t):
    return _documents(t).withColumn("violation", documents.document_violation(F.col("document"), rules.MAX_SNAPSHOT)).where("violation is not null").select("seq", "violation")


@query()
def canonical_json(t):
    return _documents(t).select("seq", documents.canonical_json("document").alias("canonical"))


@query("""SELECT seq, CAST(json_extract(snapshot, '$.cents') AS BIGINT) AS cents, json_extract_string(snapshot, '$.kind') AS kind, CAST(json_extract(snapshot, '$.props.k') AS BIGINT) AS k,
concat('{"cents":', json_extract(snapshot, '$.cents'), ',"kind":', json_extract(snapshot, '$.kind'), ',"props":{"k":', json_extract(snapshot, '$.props.k'), '}}') AS written FROM change_log WHERE snapshot IS NOT NULL""")
def wire_roundtrip(t):
    """Snapshots read by their schema (a document that does not fit it fails the query) and written again in canonical form."""
    read = F.from_json("snapshot", "cents long, kind string, props struct<k: long>", {"mode": "FAILFAST"})
    rows = t.change_log.where("snapshot is not null").select("seq", read.alias("s"))
    return rows.select("seq", "s.cents", "s.kind", F.col("s.props.k").alias("k"), F.to_json("s").alias("written"))


@query()
def payload_checksums(t):
    """The recorded checksum of a command's payload: the first half of its BLAKE3."""
    return t.commands.select("id", documents.blake3("payload").alias("checksum"))


# -- invariants --------------------------------------------------------------------------------


#: Each device reports a second scope, and forgets its first from step 3 on if its number ends in 1.
_HISTORY = "SELECT * FROM cursor_history WHERE NOT (device_id % 10 = 1 AND step >= 3) UNION ALL SELECT device_id, concat(scope, ':b'), step, step * 10 FROM cursor_history"


@query(f""", r AS ({_HISTORY}) SELECT p.device_id, p.scope, p.step, r.cursor_seq, (SELECT max(x.cursor_seq) FROM r x WHERE x.device_id = p.device_id AND x.scope = p.scope AND x.step < p.step) AS highest
FROM (SELECT DISTINCT a.device_id, a.scope, b.step FROM r a JOIN r b ON b.device_id = a.device_id) p LEFT JOIN r ON r.device_id = p.device_id AND r.scope = p.scope AND r.step = p.step
WHERE (SELECT max(x.cursor_seq) FROM r x WHERE x.device_id = p.device_id AND x.scope = p.scope AND x.step < p.step) > coalesce(r.cursor_seq, -1)""")
def inv_cursor_monotonic(t):
    return invariants.cursor_monotonic(t.sql(_HISTORY))


_AHEAD = "CASE WHEN device_id % 8 = 3 THEN cursor_seq + 1000000000 ELSE cursor_seq END"


@query(f"SELECT device_id, d.scope, {_AHEAD} AS cursor_seq, head FROM devices d JOIN (SELECT scope, max(seq) AS head FROM change_log GROUP BY scope) h ON h.scope = d.scope WHERE {_AHEAD} > head")
def inv_cursor_bounds(t):
    return invariants.cursor_bounds(t.devices.withColumn("cursor_seq", F.expr(_AHEAD)), t.change_log)


@query("SELECT DISTINCT id FROM commands WHERE id NOT IN (SELECT command_id FROM command_results) AND id IN (SELECT id FROM push_results)")
def inv_no_loss(t):
    queued = t.commands.join(t.command_results.select(F.col("command_id").alias("id")), "id", "left_anti")
    return invariants.no_loss(queued, t.push_results)


_NEXT = "SELECT id, CASE WHEN length(payload) % 5 = 0 THEN 'rejected' ELSE s END AS status FROM (SELECT c.id, c.payload, c.event_id, r.status AS s FROM commands c JOIN command_results r ON r.command_id = c.id) WHERE event_id % 7 <> 2"


@query(f"SELECT r.command_id AS id, r.status, n.status AS now FROM command_results r LEFT JOIN ({_NEXT}) n ON n.id = r.command_id WHERE n.id IS NULL OR n.status <> r.status")
def inv_durability(t):
    return invariants.durability(t.command_results.select(F.col("command_id").alias("id"), "status"), t.sql(f"{_NEXT}"))


@query("SELECT id, CAST(count(*) AS BIGINT) AS verdicts, CAST(count(DISTINCT status) AS BIGINT) AS kinds FROM push_results GROUP BY id HAVING count(*) > 1")
def inv_idempotency(t):
    return invariants.idempotency(t.push_results)


@query("""SELECT d.device_id, d.entity, d.entity_id, d.row_version, r.row_version AS expected FROM device_rows d LEFT JOIN rows_at r ON r.device_id = d.device_id AND r.entity = d.entity AND r.entity_id = d.entity_id WHERE r.row_version IS DISTINCT FROM d.row_version""")
def inv_applied_state(t):
    return invariants.applied_state(t.device_rows, log.rows_at(t.devices, t.change_log))


@query("""SELECT r.device_id, r.entity, r.entity_id, r.row_version, d.row_version AS held FROM rows_at r LEFT JOIN device_rows d ON r.device_id = d.device_id AND r.entity = d.entity AND r.entity_id = d.entity_id WHERE d.row_version IS NULL OR d.row_version <> r.row_version""")
def inv_durable_effects(t):
    return invariants.durable_effects(t.device_rows, log.rows_at(t.devices, t.change_log)).select("device_id", "entity", "entity_id", "row_version", "held")


@query(f"""{_PAIR} SELECT coalesce(dd.device_id, sd.device_id) AS device_id, coalesce(dd.scope, sd.scope) AS scope, coalesce(dd.digest, {_ZERO}) AS device_digest, coalesce(sd.digest, {_ZERO}) AS server_digest
FROM dd FULL JOIN sd ON sd.device_id = dd.device_id WHERE coalesce(dd.digest, {_ZERO}) <> coalesce(sd.digest, {_ZERO})""")
def inv_convergence(t):
    return invariants.convergence(digest.digest(t.device_rows, "device_id", "scope"), digest.digest(log.rows_at(t.devices, t.change_log), "device_id", "scope"))


_SUPERSEDED = f"SELECT c.id, k.entity, c.event_id FROM commands c JOIN ({_FIRST}) o ON o.id = c.id AND o.status = 'superseded' JOIN command_registry k ON k.name = c.name"
_KEPT = f"SELECT id, entity FROM ({_SUPERSEDED}) WHERE event_id % 4 <> 2 AND (event_id % 5 = 3 OR entity LIKE 'draft%')"


@query(f"""SELECT s.id, s.entity, 'not_recovered' AS violation FROM ({_SUPERSEDED}) s WHERE entity LIKE 'draft%' AND id NOT IN (SELECT id FROM ({_KEPT}))
UNION ALL SELECT id, entity, 'wrong_class' FROM ({_KEPT}) WHERE entity NOT LIKE 'draft%'""")
def inv_policy(t):
    def of(sql: str):
        return t.sql(sql)

    return invariants.policy(of(_SUPERSEDED).select("id", "entity"), of(_KEPT), t.registry)


# -- counts ------------------------------------------------------------------------------------

_MENU = "(VALUES " + ", ".join(f"({i}, '{f}')" for i, f in enumerate(metrics.FAULTS)) + ") AS m(i, fault)"
_TRACE = f"SELECT fault, seq FROM change_log JOIN {_MENU} ON i = seq % 20 WHERE i % 6 <> 5"


@query(f"SELECT m.fault, CAST(count(x.seq) AS BIGINT) AS n FROM {_MENU} LEFT JOIN ({_TRACE}) x ON x.fault = m.fault GROUP BY m.fault")
def fault_coverage(t):
    return metrics.fault_coverage(t.sql(f"{_TRACE}"))


@query(f"SELECT invariant, seed, detail FROM (SELECT fault AS invariant, seq AS seed, concat('seed ', CAST(seq AS STRING)) AS detail, row_number() OVER (PARTITION BY fault ORDER BY seq) AS rn FROM ({_TRACE}) WHERE seq % 7 = 3) WHERE rn = 1")
def lowest_failing_seed(t):
    runs = t.sql(f"{_TRACE}").where("seq % 7 = 3")
    return metrics.lowest_failing_seed(runs.select(F.col("fault").alias("invariant"), F.col("seq").alias("seed"), F.concat(F.lit("seed "), F.col("seq").cast("string")).alias("detail")))


_FAULTED = "SELECT seq, CAST(3 + seq % 4 AS BIGINT) AS nth, seq % 7 = 1 AS malformed, seq % 11 = 2 AS severed, seq % 5 = 3 AS duplicated, seq % 3 = 1 AS reordered FROM change_log"


@query(f"""SELECT seq, CASE WHEN seq % nth = 0 THEN 'dropped' WHEN malformed THEN 'malformed' WHEN severed THEN 'severed' WHEN duplicated THEN 'duplicated' WHEN reordered THEN 'reordered' END AS response,
CASE WHEN malformed THEN 'storage-failed' WHEN severed THEN 'storage-committed-then-killed' WHEN duplicated THEN 'storage-lied-about-commit' END AS storage FROM ({_FAULTED})""")
def fault_decisions(t):
    """One fault at most for each response and each transaction, of those that were drawn."""
    malformed, severed, duplicated, reordered = map(F.col, ("malformed", "severed", "duplicated", "reordered"))
    response = metrics.response_fault(F.col("seq"), F.col("nth"), malformed, severed, duplicated, reordered)
    return t.sql(_FAULTED).select("seq", response.alias("response"), metrics.storage_fault(malformed, severed, duplicated).alias("storage"))


@query("SELECT device_id, CASE WHEN device_id % 3 = 0 THEN 9223372036854775807 WHEN device_id % 3 = 1 THEN cursor_seq - 500 ELSE cursor_seq + device_id END AS shown FROM devices")
def skewed_clocks(t):
    """What each device's clock shows; a skew beyond 64 bits stops at their end."""
    true = F.when(F.col("device_id") % 3 == 0, F.lit((1 << 63) - 10)).otherwise(F.col("cursor_seq"))
    skew = F.when(F.col("device_id") % 3 == 0, F.lit(1000)).when(F.col("device_id") % 3 == 1, F.lit(-500)).otherwise(F.col("device_id")).cast("long")
    return t.devices.select("device_id", rules.skewed_clock(true, skew).alias("shown"))


@query(f"SELECT scope, digest, CAST(('0x' || substr(digest, 25, 8)) AS BIGINT) AS low FROM ({_digest(_ROWS, 'scope')})")
def digest_from_hex(t):
    """A digest read from its text and written again, with the lowest of its limbs."""
    rows = scope_digest(t).select("scope", *digest.from_hex(F.col("digest")))
    return rows.select("scope", digest.normalised().alias("digest"), F.col("limb3").alias("low"))


@query(f"""{_PAIR}{_HEALTH.replace(', RECURSIVE', ',', 1)}, {_PLAN} SELECT 'row_quarantined' AS event, concat(entity, '/', entity_id) AS subject FROM ({_JOINED}) WHERE status IN ('no_path', 'failed')
UNION ALL SELECT 'command_held', id FROM ({_OUTBOX}) WHERE migrated IS NULL
UNION ALL SELECT 'upgrade_required', CAST(device_id AS STRING) FROM devices WHERE device_id % 5 + 1 NOT BETWEEN {PROTOCOL - 1} AND {PROTOCOL}
UNION ALL SELECT 'scope_diverged', concat(d.device_id, '/', d.scope) FROM devices d LEFT JOIN dd ON dd.device_id = d.device_id LEFT JOIN sd ON sd.device_id = d.device_id
  WHERE NOT d.cursor_seq < (SELECT max(seq) FROM change_log c WHERE c.scope = d.scope) AND coalesce(dd.digest, {_ZERO}) <> coalesce(sd.digest, {_ZERO})
UNION ALL SELECT 'scope_unhealable', concat(device_id, '/', scope, '/', attempts) FROM h WHERE step = 5 AND state = 'unhealable'""")
def telemetry(t):
    """One tagged table of what a person should see."""
    found = quarantine(t).select(F.lit("row_quarantined").alias("event"), F.concat_ws("/", "entity", "entity_id").alias("subject"))
    found = found.union(held_commands(t).select(F.lit("command_held"), "id"))
    found = found.union(version_negotiation(t).where("verdict <> 'accepted'").select(F.lit("upgrade_required"), F.col("device_id").cast("string")))
    found = found.union(divergence(t).where("diverged").select(F.lit("scope_diverged"), F.concat_ws("/", "device_id", "scope")))
    last = apply.scope_health(_observations(t)).groupBy("device_id", "scope").agg(F.max_by("state", "step").alias("state"), F.max_by("attempts", "step").alias("attempts"))
    return found.union(last.where("state = 'unhealable'").select(F.lit("scope_unhealable"), F.concat_ws("/", "device_id", "scope", "attempts")))
