"""Queries over models and streams, on documents, conversations and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from kbspark.operators import models, search
from kbspark.plans import chats
from kbspark.plans.chats import _turns, messages
from kbspark.sources.shared import new_path
from kbspark.streaming import state


def _encoder():
    return lambda texts: ([[float(len(t)), 1.0] for t in texts], [{len(t) % 10: 1.0} for t in texts])


def q_encode(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")
    out = models.encode(docs, "text", _encoder)
    return out.select("doc_id", F.col("dense")[0].cast("double").alias("first"), F.map_keys("sparse")[0].alias("token"))


def _letters():
    """A stand-in encoder: how often each of eight letters stands in a text."""
    return lambda texts: ([[1.0 + t.count(c) for c in "aeinorst"] for t in texts], [{0: 1.0}] * len(texts))


def q_hyde(spark, d):
    """Every second question with a stand-in answer (itself, twice), searched in one language's documents."""
    docs = spark.read.parquet(f"{d}/documents.parquet")
    chunks = models.encode(docs.select(F.col("doc_id").alias("chunk_id"), F.col("lang").alias("item_name"), "text"), "text", _letters).select("chunk_id", "item_name", "dense")
    asked = spark.read.parquet(f"{d}/benchmark.parquet").select(F.col("item_id").alias("query_id"), F.element_at(F.array(*map(F.lit, ("en", "de", "fr", "es"))), (F.col("item_id") % 4 + 1).cast("int")).alias("item_name"), F.col("text").alias("query"))
    answers = asked.select("query_id", F.when(F.col("query_id") % 2 == 0, F.concat_ws(" ", "query", "query")).otherwise("").alias("document"))
    return search.hyde_topk(asked, answers, chunks, _letters).withColumn("score", F.round("score", 6))


def _writer():
    def model(prompt: str) -> str:
        if prompt.startswith("A"):
            raise ValueError("refused")
        return prompt[:5] + "!"

    return model


def q_generate(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")
    return models.generate(docs, "text", _writer, retries=2).select("doc_id", "response")


def _run(stream, spark, what, mode="append"):
    """Run a stream over all there is into a shared table; returns the table."""
    out = new_path(spark, what)
    path = f"{out}/rows"

    def put(batch, _):
        batch.write.mode("append").parquet(path)

    stream.writeStream.outputMode(mode).option("checkpointLocation", f"{out}/checkpoint").foreachBatch(put).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(path)


def _stream_of(spark, rows, what):
    """A finite table as a stream of files."""
    path = new_path(spark, what)
    rows.write.parquet(path)
    return spark.readStream.schema(rows.schema).parquet(path)


def q_ingest(spark, d):
    """Documents arrive as files, are chunked once for each content, and are marked done; documents without chunks show none."""
    docs = spark.read.parquet(f"{d}/documents.parquet").select(F.format_string("/in/%012d.md", "doc_id").alias("path"), F.col("text").cast("binary").alias("content"))
    out = new_path(spark, "ingest")
    state.ingest_stream(_stream_of(spark, docs, "arrivals"), f"{out}/chunks", f"{out}/ledger", f"{out}/checkpoint").awaitTermination()
    chunks = state.read_chunks(spark, f"{out}/chunks", f"{out}/ledger").select(F.col("doc_id").alias("sha256")).distinct().withColumn("chunked", F.lit(True))
    return state.read_ledger(spark, f"{out}/ledger").join(chunks, "sha256", "left").select("sha256", "path", "status", F.coalesce("chunked", F.lit(False)).alias("chunked"))


def q_clarify_stream(spark, d):
    return _run(state.clarify_stream(_stream_of(spark, _turns(spark, d), "turns")), spark, "clarify")


def q_ttl_stream(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").select(F.col("event_id").alias("request_id"), F.concat_ws("/", F.col("user_id").cast("string"), "event_type").alias("key"), "ts")
    return _run(state.ttl_cache_stream(_stream_of(spark, e, "requests")), spark, "ttl").select("request_id", "key", "hit")


def q_history_stream(spark, d):
    m = messages(spark, d).select("session_id", F.concat_ws("-", "session_id", F.col("turn").cast("string")).alias("message_id"), "turn", "ts")
    out = _run(state.history_stream(_stream_of(spark, m, "chat"), 4), spark, "history", "update")
    return out.select("session_id", F.array_join("history", "|").alias("history"))


QUERIES = {"encode": q_encode, "hyde_topk": q_hyde, "generate": q_generate, "ingest_stream": q_ingest, "clarify_stream": q_clarify_stream, "ttl_cache_stream": q_ttl_stream, "history_stream": q_history_stream}

SQL = {
    "ttl_cache_stream": chats.SQL["ttl_cache"],
    "clarify_stream": chats.CLARIFY,
    "encode": "SELECT doc_id, length(text)::DOUBLE AS first, CAST(length(text) % 10 AS INTEGER) AS token FROM documents",
    "generate": "SELECT doc_id, CASE WHEN starts_with(text, 'A') THEN '' ELSE substring(text, 1, 5) || '!' END AS response FROM documents",
    "ingest_stream": "WITH f AS (SELECT '/in/' || lpad(doc_id::VARCHAR, 12, '0') || '.md' AS path, sha256(text) AS sha256 FROM documents) SELECT f.sha256, min(path) AS path, 'completed' AS status, bool_or(d.text <> '') AS chunked FROM f JOIN documents d ON path = '/in/' || lpad(doc_id::VARCHAR, 12, '0') || '.md' GROUP BY f.sha256",
    "history_stream": "WITH r AS (SELECT CAST(conv_id AS VARCHAR) AS session_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations QUALIFY n <= 4) SELECT session_id, string_agg(session_id || '-' || turn, '|' ORDER BY turn) AS history FROM r GROUP BY session_id",
}
