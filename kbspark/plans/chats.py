"""Queries over conversations, confirmation and caches, on conversations, part, events and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from kbspark.operators import dialogue
from kbspark.operators import search
from kbspark.sources import io


def messages(spark, d):
    c = spark.read.parquet(f"{d}/conversations.parquet")
    items = F.when(F.col("turn") % 3 == 0, F.array(F.lit("known"))).otherwise(F.array().cast("array<string>"))
    return c.select(F.col("conv_id").cast("string").alias("session_id"), F.col("turn").cast("int").alias("turn"), F.timestamp_seconds(F.col("turn") * 60).alias("ts"), "role", "text", items.alias("item_names"))


def matches(spark, d):
    """Each part's brand asked against the parts of its kind: scores from keys, some equal, some close."""
    p = spark.read.parquet(f"{d}/part.parquet").select((F.col("p_partkey") % 100).cast("long").alias("query_id"), (F.col("p_partkey") % 3).cast("int").alias("pos"), F.col("p_name").alias("item_name"), (F.lit(0.55) + (F.col("p_partkey") * 7 % 20) / 100).alias("score"))
    best = p.groupBy("query_id", "pos", "item_name").agg(F.round(F.max("score"), 6).alias("score"))
    name = F.when(F.col("query_id") % 4 == 0, F.col("top")).otherwise("unknown")
    tops = best.groupBy("query_id", "pos").agg(F.max(F.struct("score", "item_name"))["item_name"].alias("top"))
    return best.join(tops, ["query_id", "pos"]).select("query_id", name.alias("extracted_name"), "pos", "item_name", "score")


def q_classify(spark, d):
    c = dialogue.classify_items(matches(spark, d))
    return c.select("query_id", F.array_join("confirmed", "|").alias("confirmed"), F.array_join("options", "|").alias("options"))


def q_route(spark, d):
    return dialogue.route(dialogue.classify_items(matches(spark, d))).groupBy("route").agg(F.count("*").alias("n"), F.sum(F.coalesce(F.length("answer"), F.lit(0))).alias("chars"))


def q_gap(spark, d):
    m = matches(spark, d)
    return dialogue.score_gap_filter(m, m.where("score >= 0.6").select("query_id", "item_name"), 0.1)


def q_recent(spark, d):
    return dialogue.recent_messages(messages(spark, d), 4).select("session_id", "place", "turn", "role", "text")


def q_history(spark, d):
    return dialogue.history_text(dialogue.recent_messages(messages(spark, d), 3))


def q_backfill(spark, d):
    m = messages(spark, d)
    confirmed = m.where("turn = 0").select("session_id", F.array(F.concat(F.lit("item"), "session_id")).alias("items")).where("session_id % 2 = 0")
    return dialogue.backfill_message_items(m, confirmed, 3).select("session_id", "turn", F.array_join("item_names", "|").alias("items"))


def q_clear(spark, d):
    m = messages(spark, d)
    ids = m.where("session_id % 7 = 3").select("session_id")
    left, _, counts = io.clear_history(m, m.select("session_id").distinct(), ids)
    return left.groupBy("session_id").agg(F.count("*").alias("n")).withColumn("deleted", F.lit(0).cast("long")).unionByName(counts.select("session_id", F.lit(0).cast("long").alias("n"), "deleted"))


def q_pack(spark, d):
    """Each session asks: its messages are the history, the documents of like id the context, its roles the triples."""
    m = messages(spark, d)
    docs = spark.read.parquet(f"{d}/documents.parquet")
    n = 100
    c = docs.select((F.col("doc_id") % n).cast("string").alias("query_id"), F.floor(F.col("doc_id") / n).cast("int").alias("rank"), F.col("text").alias("content"), F.lit("local").alias("source"), F.col("doc_id").cast("string").alias("chunk_id"), F.lit("").alias("url"), F.col("lang").alias("title"), (F.col("n_chars") / 1000).alias("score"))
    h = m.select(F.col("session_id").alias("query_id"), F.col("turn").alias("place"), "role", "text")
    t = m.select(F.col("session_id").alias("query_id"), F.col("turn").alias("place"), F.concat(F.lit("t"), "role", F.lit(" ")).alias("text"))
    q = m.select(F.col("session_id").alias("query_id")).distinct()
    out = dialogue.pack_context(q, c, h, t, 3000)
    return out.select("query_id", F.md5("context").alias("context"), F.md5("history").alias("history"), "graph", "left")


def q_new_files(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet")
    files = docs.select("doc_id", F.format_string("/in/%012d.md", "doc_id").alias("path"), F.col("text").cast("binary").alias("content"))
    ledger = files.where("doc_id % 3 = 0").select(F.sha2("content", 256).alias("sha256"), F.when(F.col("doc_id") % 2 == 0, "completed").otherwise("failed").alias("status"))
    return io.new_files(files.drop("doc_id"), ledger).select("path", "sha256")


def q_vector_stats(spark, d):
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    rows = e.select(F.when(F.col("vec_id") % 7 > 0, F.col("embedding")).alias("dense"), F.when(F.col("label") != 3, F.create_map(F.lit(1), F.lit(1.0))).alias("sparse"))
    return search.vector_stats(rows)


def q_ttl(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    return dialogue.ttl_cache(e.select(F.col("event_id").alias("request_id"), F.concat_ws("/", F.col("user_id").cast("string"), "event_type").alias("key"), "ts")).select("request_id", "key", "hit")


def _turns(spark, d):
    """Conversations whose first user turn offers two options and whose later turns reply."""
    m = messages(spark, d)
    options = F.when(F.col("turn") % 4 == 0, F.array(F.lit("alpha 1"), F.lit("beta 2")))
    reply = F.element_at(F.array(F.lit("2"), F.lit("ALPHA-1"), F.lit("hm"), F.lit("取消")), ((F.col("session_id").cast("int") + F.col("turn")) % 4 + 1).cast("int"))
    return m.select("session_id", "turn", "ts", F.when(F.col("turn") % 4 == 0, F.col("text")).otherwise(reply).alias("text"), options.alias("options"), F.lit(None).cast("string").alias("rewritten"))


def q_clarify(spark, d):
    return dialogue.clarify(_turns(spark, d))


QUERIES = {
    "classify_items": q_classify, "route": q_route, "score_gap_filter": q_gap, "recent_messages": q_recent, "history_text": q_history, "backfill_message_items": q_backfill, "clear_history": q_clear, "pack_context": q_pack,
    "new_files": q_new_files, "vector_stats": q_vector_stats, "ttl_cache": q_ttl, "clarify": q_clarify,
}

_M = "WITH m AS (SELECT CAST(conv_id AS VARCHAR) AS session_id, CAST(turn AS INTEGER) AS turn, role, text FROM conversations)"
_MATCH = """
WITH p AS (SELECT CAST(p_partkey % 100 AS BIGINT) AS query_id, CAST(p_partkey % 3 AS INTEGER) AS pos, p_name AS item_name, round(max(0.55::DOUBLE + (p_partkey * 7 % 20)::DOUBLE / 100), 6) AS score FROM part GROUP BY ALL),
t AS (SELECT query_id, pos, arg_max(item_name, {'s': score, 'n': item_name}) AS top FROM p GROUP BY ALL),
m AS (SELECT p.*, CASE WHEN query_id % 4 = 0 THEN top ELSE 'unknown' END AS extracted_name FROM p JOIN t USING (query_id, pos))"""
# The three-state machine turn by turn; every choice is of the same two options here.
CLARIFY = r"""
WITH RECURSIVE m AS (SELECT CAST(conv_id AS VARCHAR) AS session_id, CAST(turn AS INTEGER) AS turn, turn % 4 = 0 AS offers, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n,
  coalesce(CASE WHEN turn % 4 = 0 THEN text ELSE list_extract(['2', 'ALPHA-1', 'hm', '取消'], CAST((conv_id + turn) % 4 + 1 AS INTEGER)) END, '') AS text FROM conversations),
k AS (SELECT *, regexp_replace(lower(trim(text)), '[\s\-_]+', '', 'g') AS key, trim(text) IN ('取消', '算了', '不用了', '不问了') AS cancels FROM m),
c AS (SELECT *, contains(key, 'alpha1') OR contains('alpha1', key) AS a, contains(key, 'beta2') OR contains('beta2', key) AS b,
  CASE WHEN regexp_full_match(trim(text), '\d+|第\s*\d+\s*个?|选\s*\d+|\d+\s*号') THEN TRY_CAST(regexp_extract(text, '\d+') AS INTEGER) WHEN replace(text, ' ', '') IN ('第一个', '第一', '一') THEN 1 WHEN replace(text, ' ', '') IN ('第二个', '第二', '二') THEN 2 END AS num FROM k),
p AS (SELECT *, CASE WHEN num = 1 THEN 'alpha 1' WHEN num = 2 THEN 'beta 2' WHEN key = '' THEN NULL WHEN key = 'alpha1' THEN 'alpha 1' WHEN key = 'beta2' THEN 'beta 2' WHEN a AND NOT b THEN 'alpha 1' WHEN b AND NOT a THEN 'beta 2' END AS picked FROM c),
w AS (SELECT session_id, turn, n, CASE WHEN offers THEN 'ask' ELSE 'pass' END AS action, NULL::VARCHAR AS item, CASE WHEN NOT offers THEN text END AS query, CASE WHEN offers THEN text END AS asked FROM p WHERE n = 1
UNION ALL SELECT p.session_id, p.turn, p.n,
  CASE WHEN w.asked IS NULL THEN CASE WHEN offers THEN 'ask' ELSE 'pass' END WHEN cancels THEN 'cancel' WHEN picked IS NOT NULL THEN 'selected' ELSE 'unresolved' END,
  CASE WHEN w.asked IS NOT NULL AND NOT cancels THEN picked END,
  CASE WHEN w.asked IS NULL THEN CASE WHEN NOT offers THEN text END WHEN NOT cancels AND picked IS NOT NULL THEN coalesce(nullif(w.asked, ''), text) END,
  CASE WHEN w.asked IS NULL THEN CASE WHEN offers THEN text END WHEN cancels OR picked IS NOT NULL THEN NULL ELSE w.asked END
  FROM w JOIN p ON p.session_id = w.session_id AND p.n = w.n + 1)
SELECT session_id, turn, action, item, query FROM w"""
SQL = {
    "score_gap_filter": _MATCH + ", b AS (SELECT query_id, item_name, max(score) AS score FROM m GROUP BY ALL HAVING max(score) >= 0.6), c AS (SELECT *, max(score) OVER (PARTITION BY query_id) AS top FROM b) SELECT query_id, item_name, score FROM c WHERE top - score <= 0.1",
    "recent_messages": _M + ", r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY turn DESC) AS n FROM m QUALIFY n <= 4) SELECT session_id, CAST(row_number() OVER (PARTITION BY session_id ORDER BY turn) AS INTEGER) AS place, turn, role, text FROM r",
    "history_text": _M + ", r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY turn DESC) AS n FROM m QUALIFY n <= 3) SELECT session_id, string_agg(role || ': ' || coalesce(text, '') || chr(10), '' ORDER BY turn) AS history FROM r GROUP BY session_id",
    "backfill_message_items": _M + ", r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY turn DESC) AS n, max((turn = 0)::INT) OVER (PARTITION BY session_id) AS z FROM m) SELECT session_id, turn, CASE WHEN turn % 3 = 0 THEN 'known' WHEN n <= 3 AND z = 1 AND session_id::INT % 2 = 0 THEN 'item' || session_id ELSE '' END AS items FROM r",
    "clear_history": _M + " SELECT session_id, CASE WHEN session_id::INT % 7 = 3 THEN 0 ELSE count(*) END AS n, CASE WHEN session_id::INT % 7 = 3 THEN count(*) ELSE 0 END AS deleted FROM m GROUP BY session_id",
    "pack_context": _M + """, d AS (SELECT CAST(doc_id % 100 AS VARCHAR) AS query_id, doc_id // 100 AS rank, '[' || (doc_id // 100) || '] [source=local] [chunk_id=' || doc_id || '] [title=' || lang || '] [score=' || printf('%.4f', n_chars::DOUBLE / 1000) || ']' || chr(10) || trim(text) AS line FROM documents WHERE trim(text) <> ''),
d1 AS (SELECT *, sum(length(line) + 2) OVER (PARTITION BY query_id ORDER BY rank) - 2 > 3000 AS o FROM d), d2 AS (SELECT *, bool_or(o) OVER (PARTITION BY query_id ORDER BY rank) AS ov FROM d1),
a AS (SELECT query_id, string_agg(line, chr(10) || chr(10) ORDER BY rank) AS context, sum(length(line) + 2) AS spent FROM d2 WHERE NOT ov GROUP BY ALL),
q AS (SELECT DISTINCT m.session_id AS query_id, 3000 - coalesce(spent, 0) AS l1 FROM m LEFT JOIN a ON a.query_id = m.session_id),
h AS (SELECT session_id AS query_id, turn, CASE role WHEN 'user' THEN '用户' ELSE '助手' END || ': ' || text AS line FROM m WHERE role IN ('user', 'assistant') AND coalesce(text, '') <> ''),
h1 AS (SELECT h.*, l1, sum(length(line) + 1) OVER (PARTITION BY query_id ORDER BY turn) AS used FROM h JOIN q USING (query_id)),
h2 AS (SELECT query_id, string_agg(line, chr(10) ORDER BY turn) FILTER (WHERE used <= l1) AS history, coalesce(min(used) FILTER (WHERE used > l1), max(used)) AS spent FROM h1 GROUP BY ALL),
r AS (SELECT q.query_id, l1 - coalesce(spent, 0) AS l2, history FROM q LEFT JOIN h2 USING (query_id)),
t AS (SELECT session_id AS query_id, turn, 't' || role AS line FROM m), t1 AS (SELECT t.*, l2, sum(length(line) + 1) OVER (PARTITION BY query_id ORDER BY turn) - 1 AS used FROM t JOIN r USING (query_id)),
t2 AS (SELECT query_id, string_agg(line, chr(10) ORDER BY turn) FILTER (WHERE used <= l2) AS graph, sum(length(line) + 1) FILTER (WHERE used <= l2) AS spent FROM t1 GROUP BY ALL)
SELECT r.query_id, md5(coalesce(context, '')) AS context, md5(coalesce(history, '')) AS history, coalesce(graph, '') AS graph, CAST(l2 - coalesce(t2.spent, 0) AS BIGINT) AS left FROM r LEFT JOIN a USING (query_id) LEFT JOIN t2 USING (query_id)""",
    "new_files": "WITH f AS (SELECT doc_id, '/in/' || lpad(doc_id::VARCHAR, 12, '0') || '.md' AS path, sha256(text) AS sha256 FROM documents) SELECT min(path) AS path, sha256 FROM f WHERE sha256 NOT IN (SELECT sha256 FROM f WHERE doc_id % 6 = 0) GROUP BY sha256",
    "vector_stats": """WITH v AS (SELECT count(*) AS total, count(*) FILTER (WHERE vec_id % 7 > 0) AS dense, count(*) FILTER (WHERE label <> 3) AS sparse, count(*) FILTER (WHERE vec_id % 7 > 0 AND label <> 3) AS valid FROM embeddings)
SELECT *, valid AS inserted, round(dense::DOUBLE / total, 6) AS dense_ratio, round(sparse::DOUBLE / total, 6) AS sparse_ratio, round(valid::DOUBLE / total, 6) AS valid_ratio FROM v""",
    "ttl_cache": """WITH RECURSIVE e AS (SELECT event_id, user_id || '/' || event_type AS key, epoch_us(ts) AS s, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM events),
w AS (SELECT event_id, key, s, n, s AS written, false AS hit FROM e WHERE n = 1 UNION ALL SELECT e.event_id, e.key, e.s, e.n, CASE WHEN e.s - w.written < 86400000000 THEN w.written ELSE e.s END, e.s - w.written < 86400000000 FROM w JOIN e ON e.key = w.key AND e.n = w.n + 1)
SELECT event_id AS request_id, key, hit FROM w""",
    "clarify": CLARIFY,
}
