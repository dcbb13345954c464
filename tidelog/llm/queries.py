"""The corpus operators as queries over the tables of a folder, and what SQL can say about them."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm import decontam, fingerprints, hilbert, jaccard, langid, mixing, pages, quality, repeats, secrets

#: One row in FOLDS is held out from learning.
FOLDS = 5
PREDICT_FROM = 0.3
#: Target weights of the sources; a source that isn't named comes last.
TARGET_WEIGHTS = {"src0": 5} | {f"src{i}": 1 for i in range(1, 20)}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLDS == 0, F.lit(False))


def language_model(docs: DataFrame) -> langid.Model:
    return langid.train(docs.where(~held_out()))


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compared(_table(spark, sf_dir, "documents"))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(_table(spark, sf_dir, "documents"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(_table(spark, sf_dir, "documents"), secrets.train(secrets.labelled_findings(spark)))
    return found.select("doc_id", "finding", "start", F.char_length("candidate").cast("long").alias("n_chars"), F.sha2("candidate", 256).alias("candidate_sha256"), "score", "is_secret")


def op4_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = _table(spark, sf_dir, "pages")
    return pages.main_text(table, pages.train(table))


def op5_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = hilbert.shard(_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    model = quality.train(docs.where(~held_out()), labels.where(~held_out()))
    scored = quality.score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= PREDICT_FROM).cast("int").alias("predicted"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = langid.identify(docs.select("doc_id", "text"), language_model(docs))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op8_repeated_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.remove_repeats(_table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["bytes"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contained_windows(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["words"])
    names = F.array_join(F.array_sort(F.transform("item_ids", lambda x: x.cast("string"))), ",")
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"), F.sha2(names, 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_table(spark, sf_dir, "documents").select("doc_id", "text", "source"), TARGET_WEIGHTS)
    return mixed.select("doc_id", "source", "mix_block", "mix_slot", "mix_phase", "mix_position")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_fingerprints, op2_jaccard_join, op3_secret_scan, op4_main_text, op5_hilbert_shards, op6_quality, op7_language_id, op8_repeated_windows, op9_decontamination, op10_mixing)
}

_SHINGLES = r"""
w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id)"""

#: CRC-32 of a byte's value, for SQL.
_CRC = [reduce(lambda c, _: c >> 1 ^ (0xEDB88320 if c & 1 else 0), range(8), i) for i in range(256)]


def _steps(column: str) -> str:
    """Steps of a category of at most hilbert.OWN_STEPS values, which is what the tables have."""
    return f"(SELECT {column}, 1 + (row_number() OVER (ORDER BY count(*) DESC, {column}) - 1) * {(1 << hilbert.BITS) - 1} // count(*) OVER () AS step FROM documents WHERE {column} IS NOT NULL GROUP BY {column})"


_SHARDED = f"""
WITH b AS (SELECT doc_id, lang, source, encode(coalesce(text, '')) AS b FROM documents),
s AS (SELECT doc_id, lang, source, octet_length(b) + 8 AS size, xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(regexp_extract_all(hex(b), '..'), lambda h: CAST('0x' || h AS BIGINT))),
  lambda c, x: xor(c >> 8, ({_CRC}::BIGINT[])[xor(c & 255, x) + 1]))) AS crc FROM b),
z AS (SELECT s.*, coalesce(l.step, 0) AS l, coalesce(o.step, 0) AS o, length(bin(size)) - 1 AS e FROM s LEFT JOIN {_steps('lang')} l ON l.lang = s.lang LEFT JOIN {_steps('source')} o ON o.source = s.source),
c AS (SELECT doc_id, size, crc, ({hilbert.curve()}::INT[])[(l * 32 + o) * 32 + least(31, greatest(0, 2 * e - 6 + CASE WHEN size * size >= CAST(2 AS BIGINT) << (2 * e) THEN 1 ELSE 0 END)) + 1] AS curve FROM z),
r AS (SELECT *, row_number() OVER (ORDER BY curve, crc, doc_id NULLS FIRST, size) - 1 AS rank, count(*) OVER () AS n FROM c)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(crc AS BIGINT) AS text_crc32, 'rows' AS law, CAST(rank * 24 // n AS INT) AS shard, CAST(rank - (rank * 24 // n * n + 23) // 24 AS BIGINT) AS slot, CAST(NULL AS INT) AS grown_shard, curve FROM r"""

SQL: dict[str, str] = {
    "op1_fingerprints": r"""
WITH d AS (SELECT row_number() OVER (ORDER BY doc_id DESC NULLS LAST, coalesce(text, '')) AS r, doc_id, coalesce(text, '') AS t FROM documents),
e AS (SELECT *, length(t) // 3 AS k, coalesce(lead(t) OVER (ORDER BY r), first_value(t) OVER (ORDER BY r)) AS after, coalesce(lead(r) OVER (ORDER BY r), 1) AS s FROM d),
t AS (SELECT r, 0 AS e, t AS text FROM e UNION ALL SELECT r, 1, left(t, length(t) - k) || left(after, k) FROM e),
p AS (SELECT r, e, p FROM (SELECT r, e, unnest(string_split(text, chr(10))) AS p FROM t) WHERE p <> ''),
x AS (SELECT r, e, i, sum(CAST('0x' || substr(h, CAST(8 * i + 1 AS INT), 8) AS BIGINT)) % 4294967296 AS x FROM (SELECT r, e, sha256(p) AS h FROM p) CROSS JOIN range(8) AS n(i) GROUP BY ALL),
c AS (SELECT r, e, md5(c) AS h FROM (SELECT r, e, unnest(regexp_split_to_array(p, '[.!?;:|]+[ \t\n\x0B\f\r]*')) AS c FROM p) WHERE c <> ''),
w AS (SELECT r, e, j, CAST('0x' || substr(h, CAST(8 * j + 1 AS INT), 8) AS BIGINT) AS w FROM c CROSS JOIN range(4) AS n(j)),
y AS (SELECT r, e, 32 * j + b AS i, sum(2 * ((w >> b) & 1) - 1) AS y FROM w CROSS JOIN range(32) AS n(b) GROUP BY ALL),
fx AS (SELECT t.r, t.e, string_agg(printf('%08x', CAST(coalesce(x, 0) AS BIGINT)), '' ORDER BY n.i) AS f FROM t CROSS JOIN range(8) AS n(i) LEFT JOIN x ON x.r = t.r AND x.e = t.e AND x.i = n.i GROUP BY t.r, t.e),
fy AS (SELECT t.r, t.e, string_agg(printf('%03x', CAST((coalesce(y, 0) % 4096 + 4096) % 4096 AS BIGINT)), '' ORDER BY n.i) AS f, list(CAST(coalesce(y, 0) AS DOUBLE) ORDER BY n.i) AS v FROM t CROSS JOIN range(128) AS n(i) LEFT JOIN y ON y.r = t.r AND y.e = t.e AND y.i = n.i GROUP BY t.r, t.e),
f AS (SELECT fx.r, fx.e, fx.f || fy.f AS f, v, list_dot_product(v, v) AS vv FROM fx JOIN fy ON fy.r = fx.r AND fy.e = fx.e)
SELECT e.doc_id, CAST(length(e.t) AS BIGINT) AS n_chars, sha256(t.text) AS edited_sha256, a.f AS fingerprint, b.f AS edited_fingerprint,
  CASE WHEN a.vv + b.vv = 0 THEN 1.0 ELSE greatest(0.0, 1 - (a.vv + b.vv - 2 * list_dot_product(a.v, b.v)) / (a.vv + b.vv)) END AS near_edited,
  CASE WHEN a.vv + z.vv = 0 THEN 1.0 ELSE greatest(0.0, 1 - (a.vv + z.vv - 2 * list_dot_product(a.v, z.v)) / (a.vv + z.vv)) END AS near_next
FROM e JOIN t ON t.r = e.r AND t.e = 1 JOIN f a ON a.r = e.r AND a.e = 0 JOIN f b ON b.r = e.r AND b.e = 1 JOIN f z ON z.r = e.s AND z.e = 0""",
    "op5_hilbert_shards": _SHARDED,
    "op2_jaccard_join": f"""
WITH RECURSIVE {_SHINGLES},
sig AS (SELECT doc_id, md5(string_agg(s, chr(10) ORDER BY s)) AS sig FROM s GROUP BY doc_id),
rep AS (SELECT sig, min(doc_id) AS rep FROM sig GROUP BY sig),
r AS (SELECT s.doc_id, s.s FROM s JOIN rep ON s.doc_id = rep.rep),
pair AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n_both FROM r a JOIN r b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM pair JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * n_both >= 75 * (x.n + y.n - n_both)),
walk AS (SELECT rep AS node, rep AS reached FROM rep UNION SELECT walk.node, link.b FROM walk JOIN link ON link.a = walk.reached),
root AS (SELECT node, min(reached) AS root FROM walk GROUP BY node)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(root.root, w.doc_id) AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN sig USING (doc_id) LEFT JOIN rep USING (sig) LEFT JOIN root ON root.node = rep.rep""",
    "op8_repeated_windows": """
WITH t AS (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS b FROM documents),
w AS (SELECT r, i, b[i:i + 199] AS g FROM (SELECT r, b, unnest(range(1, octet_length(b) - 198)) AS i FROM t)),
again AS (SELECT g FROM w GROUP BY g HAVING count(*) > 1),
s AS (SELECT w.r, w.i FROM w JOIN again USING (g)),
gaps AS (SELECT r, i, CASE WHEN i <= lag(i) OVER (PARTITION BY r ORDER BY i) + 200 THEN 0 ELSE 1 END AS fresh FROM s),
runs AS (SELECT r, i, sum(fresh) OVER (PARTITION BY r ORDER BY i) AS k FROM gaps),
span AS (SELECT r, k, min(i) AS a, max(i) + 200 AS z FROM runs GROUP BY r, k),
piece AS (SELECT r, k, a, z, coalesce(lag(z) OVER (PARTITION BY r ORDER BY k), 1) AS was FROM span),
kept AS (SELECT piece.r, sum(z - a) AS gone, count(*) AS spans, string_agg(lower(hex(b[was:a - 1])), '' ORDER BY k) || lower(hex(any_value(b)[max(z):])) AS h FROM piece JOIN t ON t.r = piece.r GROUP BY piece.r)
SELECT doc_id, CAST(octet_length(b) AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans,
  sha256(CASE WHEN h IS NULL THEN b ELSE unhex(h) END) AS kept_sha256
FROM t LEFT JOIN kept ON kept.r = t.r""",
    "op9_decontamination": r"""
WITH t AS (SELECT 'd' AS k, doc_id AS id, text FROM documents UNION ALL SELECT 'b', item_id, text FROM benchmark),
w AS (SELECT k, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM t),
size AS (SELECT DISTINCT least(len(w), 10) AS size FROM w WHERE k = 'b' AND len(w) > 0),
item AS (SELECT DISTINCT id AS item_id, least(len(w), 10) AS size, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS g
  FROM (SELECT id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM w WHERE k = 'b' AND len(w) > 0)),
gram AS (SELECT id, i, size, array_to_string(w[i:i + size - 1], ' ') AS g
  FROM (SELECT id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM w CROSS JOIN size WHERE k = 'd' AND len(w) >= size)),
hit AS (SELECT gram.id, gram.i, gram.size, item.item_id FROM gram JOIN item ON gram.g = item.g AND gram.size = item.size),
word AS (SELECT id, count(DISTINCT p) AS n_hit FROM (SELECT id, unnest(range(i, i + size)) AS p FROM hit) GROUP BY id),
ids AS (SELECT id, count(DISTINCT item_id) AS n_items, sha256(string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR))) AS sha FROM hit GROUP BY id)
SELECT w.id AS doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  coalesce(sha, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN word ON word.id = w.id LEFT JOIN ids ON ids.id = w.id WHERE w.k = 'd'""",
}
