import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from kbspark.operators import dialogue
from kbspark.sources import io
from kbspark.streaming import state


def test_ttl(spark):
    rows = [(n, "k", dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)) for n, h in enumerate((0, 23, 25, 47))]
    got = dialogue.ttl_cache(spark.createDataFrame(rows, "request_id int, key string, ts timestamp")).orderBy("request_id").collect()
    assert [r.hit for r in got] == [False, True, False, True]


def classified(spark, rows):
    r = dialogue.classify_items(spark.createDataFrame(rows, "query_id string, extracted_name string, pos int, item_name string, score double")).first()
    return r.confirmed, r.options


@pytest.mark.parametrize(
    "rows,want",
    [
        ([("a", "a", 0.8), ("a", "b", 0.9)], (["a"], [])),
        ([("x", "a", 0.8), ("x", "b", 0.65)], (["a"], [])),
        ([("x", "HAK 180", 0.8), ("x", "hak180", 0.9)], (["hak180", "HAK 180"], [])),
        ([("x", "a", 0.8), ("x", "b", 0.9), ("x", "c", 0.75), ("x", "d", 0.74)], ([], ["b", "a", "c"])),
        ([("x", "a", 0.61), ("x", "b", 0.65), ("x", "c", 0.3)], ([], ["b", "a"])),
    ],
)
def test_classify(spark, rows, want):
    assert classified(spark, [("q", n, 0, i, s) for n, i, s in rows]) == want


def test_clarify_batch_and_stream_agree(spark, tmp_path):
    rows = [("s", 0, "which?", ["A x", "B y"]), ("s", 1, "hm", None), ("s", 2, "2", None), ("s", 3, "next", None), ("t", 0, "q", ["A", "B"]), ("t", 1, "取消", None), ("t", 2, "more", None)]
    turns = spark.createDataFrame([(s, t, dt.datetime(2024, 1, 1, 0, t), x, o, None) for s, t, x, o in rows], "session_id string, turn int, ts timestamp, text string, options array<string>, rewritten string")
    want = {("s", 0): "ask", ("s", 1): "unresolved", ("s", 2): "selected", ("s", 3): "pass", ("t", 0): "ask", ("t", 1): "cancel", ("t", 2): "pass"}
    got = dialogue.clarify(turns).collect()
    assert {(r.session_id, r.turn): r.action for r in got} == want and [(r.item, r.query) for r in got if r.action == "selected"] == [("B y", "which?")]
    turns.write.parquet(str(tmp_path / "in"))
    stream = state.clarify_stream(spark.readStream.schema(turns.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("clarified").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r.session_id, r.turn): r.action for r in spark.table("clarified").collect()} == want


def test_clarify_against_a_plain_loop(spark):
    rng, texts = random.Random(4), ["2", "1", "hm", "取消", "", None, "b y", "第二个", "9"]
    rows = [(rng.choice(["s", "t", "u", None, ""]), n, rng.choice(texts), rng.choice([None, [], ["A x", "B y"], ["C"]]), rng.choice([None, "asked"])) for n in range(400)]
    start = dt.datetime(2024, 1, 1)
    turns = spark.createDataFrame([(s, n, start + dt.timedelta(minutes=n), x, o, r, "x") for s, n, x, o, r in rows], "session_id string, turn int, ts timestamp, text string, options array<string>, rewritten string, action string")
    want, held = [], {}
    for s, n, x, o, r in rows:
        held[s], out = dialogue.clarify_step(held.get(s), {"text": x, "options": o, "rewritten": r})
        want.append((str(s), n, out["action"], out["item"], out["query"]))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = [(str(r.session_id), r.turn, r.action, r.item, r.query) for r in dialogue.clarify(turns.orderBy(F.rand(1))).collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(got, key=lambda x: x[1]) == want
    assert {x[2] for x in want} == {"ask", "pass", "cancel", "selected", "unresolved"}
    assert dialogue.clarify(turns.where("false")).count() == 0


def test_history_overflow_is_charged(spark):
    q = spark.createDataFrame([("q",)], "query_id string")
    docs = spark.createDataFrame([("q", 1, "text", "local", "c", "", "t", 0.5)], "query_id string, rank int, content string, source string, chunk_id string, url string, title string, score double")
    history = spark.createDataFrame([("q", 1, "user", "hi"), ("q", 2, "system", "no"), ("q", 3, "assistant", "z" * 200)], "query_id string, place int, role string, text string")
    triples = spark.createDataFrame([("q", 1, "a -(r)-> b")], "query_id string, place int, text string")
    r = dialogue.pack_context(q, docs, history, triples, 150).first()
    assert r.context == "[1] [source=local] [chunk_id=c] [title=t] [score=0.5000]\ntext" and r.history == "用户: hi" and r.graph == "" and r.left < 0


def test_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    for name, text in (("One.MD", "# 1"), ("a/two.md", "# 2"), ("x.txt", "no")):
        (tmp_path / name).write_text(text)
    docs, rejected = io.read_markdown(spark, str(tmp_path))
    assert {(r.file_title, r.md_content) for r in docs.collect()} == {("One", "# 1"), ("two", "# 2")} and rejected.count() == 1
    chunks = spark.createDataFrame([("1", "a"), ("2", "b")], "chunk_id string, item_name string")
    for _ in range(2):
        io.replace_items(chunks, str(tmp_path / "s"))
    io.replace_items(chunks.where("item_name = 'a'").withColumn("chunk_id", F.lit("9")), str(tmp_path / "s"))
    assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "s")).collect()} == {("9", "a"), ("2", "b")}


def test_import_marks_last(spark, tmp_path):
    files = spark.createDataFrame([("/x/a.md", b"# t\nbody"), ("/x/b.md", b"# t\nbody")], "path string, content binary")
    sink, ledger = str(tmp_path / "sink"), str(tmp_path / "ledger")

    def broken(_):
        raise RuntimeError("model down")

    with pytest.raises(RuntimeError):
        state.import_batch(files, sink, ledger, broken)
    for _ in range(2):
        state.import_batch(files, sink, ledger)
    assert state.read_chunks(spark, sink, ledger).count() == 1 and state.read_ledger(spark, ledger).count() == 1
