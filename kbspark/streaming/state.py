"""Continuous forms: file import, clarification sessions, a TTL cache and chat history."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from kbspark.operators.chunking import chunk_documents
from kbspark.operators.dialogue import CLARIFIED, TTL_SECONDS, clarify_step, ttl_step
from kbspark.sources.io import new_files

LEDGER = "sha256 string, path string, status string, completed_at timestamp, batch string"


def _read(spark, path: str, schema) -> DataFrame | None:
    try:
        return spark.read.schema(schema).parquet(path) if schema else spark.read.parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        return None


def read_ledger(spark, path: str) -> DataFrame:
    """The import ledger; empty before the first import."""
    found = _read(spark, path, LEDGER)
    return spark.createDataFrame([], LEDGER) if found is None else found


def read_chunks(spark, sink: str, ledger: str) -> DataFrame:
    """The chunks of the batches that the ledger lists; what a failed batch has left is not among them."""
    done = read_ledger(spark, ledger).where("status = 'completed'").select("batch").distinct()
    return spark.read.parquet(sink).join(done, "batch", "left_semi").drop("batch")


def _commit(spark, rows: DataFrame, ledger: str, batch: str) -> None:
    """Put a batch's rows into the ledger in one step: written beside it (readers pass over names with _), then renamed."""
    put = spark._jvm.org.apache.hadoop.fs.Path
    beside, final = put(f"{ledger}/_{batch}"), put(f"{ledger}/batch={batch}")
    rows.write.mode("overwrite").parquet(beside.toString())
    files = final.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if not files.rename(beside, final):
        raise OSError(f"the ledger did not take batch {batch}")


def import_batch(files: DataFrame, sink: str, ledger: str, chunker: Callable[[DataFrame], DataFrame] = chunk_documents) -> None:
    """Chunk the files(path, content) whose content is new and take them up, each content's chunks exactly once.

    A batch is named by a digest of its new contents. Its chunks go to a folder of that name, replacing what an earlier
    try of the same batch has left, and count (see read_chunks) once the ledger, which is changed by one rename, lists the batch. A
    failure before that leaves the contents new; one after it leaves them done.
    """
    spark = files.sparkSession
    fresh = new_files(files, read_ledger(spark, ledger)).persist()
    try:
        # Order-free and mergeable: sums of pieces of each content's own digest.
        piece = lambda n: F.sum(F.conv(F.substring("sha256", n, 12), 16, 10).cast("decimal(38,0)")).cast("string")
        n, *sums = fresh.agg(F.count("*"), *map(piece, (1, 13, 25, 37, 49))).first()
        if not n:
            return
        batch = hashlib.sha256(":".join([str(n), *sums]).encode()).hexdigest()
        title = F.regexp_replace(F.regexp_extract("path", r"([^/]+)$", 1), r"\.[^.]+$", "")
        docs = fresh.select(F.col("sha256").alias("doc_id"), title.alias("file_title"), F.col("content").cast("string").alias("md_content"))
        chunker(docs).write.mode("overwrite").parquet(f"{sink}/batch={batch}")  # items are named later, from the chunks
        _commit(spark, fresh.select("sha256", "path", F.lit("completed").alias("status"), F.current_timestamp().alias("completed_at")), ledger, batch)
    finally:
        fresh.unpersist()


def ingest_stream(stream: DataFrame, sink: str, ledger: str, checkpoint: str, chunker: Callable[[DataFrame], DataFrame] = chunk_documents):
    """Start importing a stream of files(path, content); returns the streaming query."""
    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, _: import_batch(batch, sink, ledger, chunker)).trigger(availableNow=True).start()


def _ms(span: str | float) -> int:
    """A length of time ("24 hours", or seconds) in milliseconds."""
    return int(1000 * (pd.Timedelta(span).total_seconds() if isinstance(span, str) else span))


def _timed(rows: DataFrame, watermark: str | None):
    """(rows, kind of timer): with a watermark Spark drops later rows and wakes keys by event time."""
    return (rows.withWatermark("ts", watermark), GroupStateTimeout.EventTimeTimeout) if watermark else (rows, GroupStateTimeout.NoTimeout)


def _live_until(state: GroupState, end_ms: int) -> None:
    """Keep the state just written until the watermark passes end_ms; drop it if it has."""
    if end_ms > state.getCurrentWatermarkMs():
        state.setTimeoutTimestamp(end_ms)
    else:
        state.remove()


def _micros(ts: pd.Series) -> pd.Series:
    return ts.astype("datetime64[us]").astype("int64")


def clarify_stream(turns: DataFrame, timeout: str | None = None, watermark: str | None = None) -> DataFrame:
    """The streaming form of dialogue.clarify; with a timeout ("30 minutes") a pending choice is forgotten after so long without a turn.

    With a watermark the wait is event time from the session's last turn, and turns older than the watermark drop; without one
    it is the machine's time, for streams that go on: Spark wakes such a query again and again to look for what has run out.
    """
    wait = _ms(timeout) if timeout else 0
    turns, kind = _timed(turns, watermark)
    if wait and not watermark:
        kind = GroupStateTimeout.ProcessingTimeTimeout

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        pending, last = ((list(state.get[0]), state.get[1]) if len(state.get[0]) else None, state.get[2]) if state.exists else (None, 0)
        rows = []
        g = pd.concat(list(frames)).sort_values(["ts", "turn"], kind="stable")
        for t, us in zip(g.to_dict("records"), _micros(g["ts"]).tolist(), strict=True):
            if watermark and wait and pending and us >= last + 1000 * wait:
                pending = None  # run out before this turn, whether or not the watermark has passed yet
            pending, out = clarify_step(pending, t)
            last = max(last, us)
            rows.append((key[0], t["turn"], out["action"], out["item"], out["query"]))
        if pending:
            state.update((pending[0], pending[1], last))
            if wait and watermark:
                _live_until(state, last // 1000 + wait)
            elif wait:
                state.setTimeoutDuration(wait)
        elif state.exists:
            state.remove()
        yield pd.DataFrame(rows, columns=["session_id", "turn", "action", "item", "query"])

    return turns.groupBy("session_id").applyInPandasWithState(run, CLARIFIED, "options array<string>, query string, last bigint", "append", kind)


def ttl_cache_stream(requests: DataFrame, ttl: float = TTL_SECONDS, watermark: str | None = None) -> DataFrame:
    """The streaming form of dialogue.ttl_cache; a key's state is one time.

    With a watermark a key's state goes when its entry's life has passed (no request that still counts could hit it) and requests
    older than the watermark drop; without one it stays.
    """
    requests, kind = _timed(requests, watermark)

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        written = state.get[0] if state.exists else None
        g = pd.concat(list(frames)).sort_values(["ts", "request_id"], kind="stable")
        hits = []
        for s in _micros(g["ts"]) / 1e6:
            written, hit = ttl_step(written, s, ttl)
            hits.append(hit)
        state.update((written,))
        if watermark:
            _live_until(state, int(1000 * (written + ttl)))
        yield g.assign(hit=hits)[["request_id", "key", "ts", "hit"]]

    types = dict(requests.dtypes)
    out = f"request_id {types['request_id']}, key {types['key']}, ts {types['ts']}, hit boolean"
    return requests.groupBy("key").applyInPandasWithState(run, out, "written double", "append", kind)


def history_stream(turns: DataFrame, n: int = 10, watermark: str | None = None, life: str | None = None) -> DataFrame:
    """session_id, history (ids, old to new): the n newest messages after each batch of turns(session_id, message_id, turn, ts); a message id that comes again replaces the old one.

    With a watermark and a life ("30 days") a session is forgotten when the watermark is so long past its newest message, and turns older
    than the watermark drop.
    """
    turns, kind = _timed(turns, watermark)

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = {m: (t, k) for m, t, k in zip(*state.get, strict=True)} if state.exists else {}
        for f in frames:
            for m, t, k in zip(f["message_id"], _micros(f["ts"]), f["turn"], strict=True):
                held[m] = (int(t), int(k))
            held = dict(sorted(held.items(), key=lambda x: x[1])[-n:])  # a frame adds what it has, no more is held
        kept = list(held.items())
        state.update(([m for m, _ in kept], [t for _, (t, _) in kept], [k for _, (_, k) in kept]))
        if watermark and life and kept:
            _live_until(state, kept[-1][1][0] // 1000 + _ms(life))
        yield pd.DataFrame([(key[0], [m for m, _ in kept])], columns=["session_id", "history"])

    return turns.groupBy("session_id").applyInPandasWithState(run, "session_id string, history array<string>", "ids array<string>, times array<bigint>, turns array<int>", "update", kind)
