"""State of the streams: expiry, late rows, equality with the batch forms, and an import that is retried."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from kbspark.operators import dialogue
from kbspark.streaming import state

DAY0 = datetime(2024, 1, 1)


def feed(spark, tmp_path, batches, schema, run, mode="append"):
    """Run a stream over batches, one after the other in one checkpoint; returns (rows of each batch, keys left in the state)."""
    src, out = str(tmp_path / "in"), []
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        got = []
        stream = run(spark.readStream.schema(schema).parquet(src))
        q = stream.writeStream.outputMode(mode).option("checkpointLocation", str(tmp_path / "c")).foreachBatch(lambda b, _, got=got: got.extend(b.collect())).trigger(availableNow=True).start()
        q.awaitTermination()
        out.append(got)
    return out, spark.read.format("statestore").load(str(tmp_path / "c")).count()


def at(hours):
    return DAY0 + timedelta(hours=hours)


def test_ttl_state_goes_after_its_life_and_late_rows_drop(spark, tmp_path):
    schema = "request_id long, key string, ts timestamp"
    batches = [[(1, "a", at(0)), (2, "a", at(1)), (3, "b", at(2))], [(4, "c", at(40))], [(5, "a", at(3)), (6, "c", at(41)), (7, "a", at(42))]]
    out, left = feed(spark, tmp_path, batches, schema, lambda s: state.ttl_cache_stream(s, watermark="1 hour"))
    assert [sorted((r.request_id, r.hit) for r in rows) for rows in out] == [[(1, False), (2, True), (3, False)], [(4, False)], [(6, True), (7, False)]]  # 5 came late
    assert left == 2  # c and the new entry of a; b and the first of a are gone


def test_ttl_stream_equals_batch(spark, tmp_path):
    rows = [(n, "hot" if n % 2 else f"k{n % 7}", at(n * n % 977 / 3)) for n in range(300)]
    rows.sort(key=lambda r: r[2])
    schema = "request_id long, key string, ts timestamp"
    out, _ = feed(spark, tmp_path, [rows[:100], rows[100:220], rows[220:]], schema, lambda s: state.ttl_cache_stream(s, watermark="10 days"))
    want = {(r.request_id, r.hit) for r in dialogue.ttl_cache(spark.createDataFrame(rows, schema)).collect()}
    assert {(r.request_id, r.hit) for b in out for r in b} == want


def test_history_of_a_session_is_forgotten(spark, tmp_path):
    schema = "session_id string, message_id string, turn int, ts timestamp"
    batches = [[("s", "m1", 1, at(0)), ("s", "m2", 2, at(1)), ("s", "m3", 3, at(2))], [("t", "x", 1, at(100))], [("s", "m4", 4, at(101)), ("s", "old", 0, at(1))]]
    out, left = feed(spark, tmp_path, batches, schema, lambda s: state.history_stream(s, 2, "1 hour", "2 days"), "update")
    assert [{r.session_id: r.history for r in rows} for rows in out] == [{"s": ["m2", "m3"]}, {"t": ["x"]}, {"s": ["m4"]}]
    assert left == 2


def test_pending_choice_runs_out_in_event_time(spark, tmp_path):
    schema = "session_id string, turn int, ts timestamp, text string, options array<string>, rewritten string"
    ask = lambda s, n, h: (s, n, at(h), "which?", ["A x", "B y"], None)
    say = lambda s, n, h, text: (s, n, at(h), text, None, None)
    batches = [[ask("p", 1, 0), ask("q", 1, 0), say("q", 2, 5, "2")], [say("z", 1, 50, "hello")], [say("p", 2, 51, "1"), say("q", 3, 2, "late")]]
    out, left = feed(spark, tmp_path, batches, schema, lambda s: state.clarify_stream(s, "10 hours", "1 hour"))
    assert [sorted((r.session_id, r.turn, r.action) for r in rows) for rows in out] == [[("p", 1, "ask"), ("q", 1, "ask"), ("q", 2, "selected")], [("z", 1, "pass")], [("p", 2, "pass")]]
    assert left == 0


@pytest.mark.parametrize("broken", ["_commit", "after"])
def test_retried_import_has_each_chunk_once(spark, tmp_path, monkeypatch, broken):
    """The batch fails between its two writes, or after both; the next try, with more files, leaves each chunk once."""
    files = spark.createDataFrame([(f"/x/{n}.md", f"# t{n % 4}\nbody".encode()) for n in range(6)], "path string, content binary")
    sink, ledger, commit = str(tmp_path / "sink"), str(tmp_path / "ledger"), state._commit

    def fail(*a):
        if broken == "after":
            commit(*a)
        raise OSError("lost")

    monkeypatch.setattr(state, "_commit", fail)
    with pytest.raises(OSError):
        state.import_batch(files, sink, ledger)
    monkeypatch.setattr(state, "_commit", commit)
    assert state.read_ledger(spark, ledger).count() == (4 if broken == "after" else 0)
    state.import_batch(files, sink, ledger)
    state.import_batch(files.unionByName(spark.createDataFrame([("/x/new.md", b"# n\nmore")], files.schema)), sink, ledger)
    got = state.read_chunks(spark, sink, ledger)
    assert got.groupBy("doc_id").agg(F.count("*").alias("n")).where("n <> 1").count() == 0 and got.count() == 5
    assert sorted(r.path for r in state.read_ledger(spark, ledger).collect()) == ["/x/0.md", "/x/1.md", "/x/2.md", "/x/3.md", "/x/new.md"]


def test_what_a_failed_batch_left_is_not_read(spark, tmp_path):
    one = spark.createDataFrame([("/a.md", b"# a\nx")], "path string, content binary")
    state.import_batch(one, str(tmp_path / "sink"), str(tmp_path / "ledger"))
    spark.createDataFrame([("stray",)], "doc_id string").write.parquet(str(tmp_path / "sink" / "batch=stray"))
    assert state.read_chunks(spark, str(tmp_path / "sink"), str(tmp_path / "ledger")).where("doc_id = 'stray'").count() == 0
