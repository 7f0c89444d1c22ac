import base64
import json

import pyarrow.parquet as pq

from kbspark.operators import evaluation as ev
from kbspark.operators import fusion, models, search
from kbspark.sources import io


def test_read_images(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name in ("a.png", "in/b c.jpg", "d.PNG", "e.txt", "png"):
        (tmp_path / name).write_bytes(name.encode())
    got = {r.img_name.replace("%20", " "): base64.b64decode(r.payload) for r in io.read_images(spark, str(tmp_path)).collect()}
    assert got == {"a.png": b"a.png", "b c.jpg": b"in/b c.jpg"}


def test_read_gold(spark, tmp_path):
    rows = [
        {"id": "1", "question": "how?", "item_name": "x", "category": "c", "gold_chunk_ids": ["2", "2", " ", "1"]},
        {"id": "2", "question": " ", "item_name": "x", "gold_chunk_ids": ["1"]},
        {"id": "3", "question": "why?", "item_name": "x"},
        {"id": "4", "question": "who?", "item_name": None, "gold_chunk_ids": ["1"]},
    ]
    (tmp_path / "gold.json").write_text(json.dumps(rows))
    gold, rejected = io.read_gold(spark, str(tmp_path / "gold.json"))
    assert [(r.id, r.gold_chunk_ids) for r in gold.collect()] == [("1", ["2", "1"])]
    assert sorted(r.id for r in rejected.collect()) == ["2", "3", "4"]


def test_write_chunks(spark, tmp_path):
    chunks = spark.createDataFrame([("hot", n, "t") for n in range(90)] + [("one", 900, "t"), (None, 901, "t")], "item_name string, chunk_id long, text string")
    path = str(tmp_path / "store")
    io.write_chunks(chunks, path, bytes_per_file=200)
    io.write_chunks(spark.createDataFrame([("one", 902, "u")], chunks.schema), path)
    back = spark.read.parquet(path)
    assert sorted((r.item_name or "", r.chunk_id) for r in back.collect()) == sorted([("hot", n) for n in range(90)] + [("one", 900), ("one", 902), ("", 901)])
    assert sum(pq.ParquetFile(f).metadata.num_rows for f in (tmp_path / "store" / "item_name=hot").glob("*.parquet")) == 90
    io.write_chunks(chunks.where("item_name = 'one'"), path, mode="overwrite")
    assert spark.read.parquet(path).count() == 1


def test_chunks_with_vectors_go_out_and_come_back(spark, tmp_path):
    rows = [("a", n, f"text {n}", [0.5 * n, 1.0], {n: 0.25, 7: 1.0}) for n in range(20)] + [("b", 99, None, None, None)]
    chunks = spark.createDataFrame(rows, "item_name string, chunk_id long, content string, dense array<float>, sparse map<int,double>")
    io.write_chunks(models.encode(chunks.drop("dense", "sparse"), "content", lambda: lambda texts: ([[1.0, 2.0]] * len(texts), [{3: 0.5}] * len(texts))), str(tmp_path / "encoded"))
    assert spark.read.parquet(str(tmp_path / "encoded")).where("element_at(sparse, 3) = 0.5").count() >= 20
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    io.write_chunks(chunks, str(tmp_path / "store"), bytes_per_file=300)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    back = spark.read.parquet(str(tmp_path / "store")).select(*chunks.columns)
    assert sorted(map(repr, map(tuple, back.collect()))) == sorted(map(repr, map(tuple, chunks.collect())))
    assert len(list((tmp_path / "store" / "item_name=a").glob("*.parquet"))) > 1


def test_write_json(spark, tmp_path):
    for text in ("old", 'two\nlines "é"'):
        io.write_json(spark.createDataFrame([(1, text, None)], "id long, text string, gone string"), str(tmp_path / "out"))
    lines = [json.loads(line) for f in (tmp_path / "out").glob("*.json") for line in f.read_text(encoding="utf-8").splitlines()]
    assert lines == [{"id": 1, "text": 'two\nlines "é"'}]


def test_new_files_takes_each_content_once(spark):
    files = spark.createDataFrame([("b", "x"), ("a", "x"), ("c", "y"), ("d", "z")], "path string, content string")
    hashed = io.new_files(files, spark.createDataFrame([], "sha256 string, status string"))
    assert sorted(r.path for r in hashed.collect()) == ["a", "c", "d"]
    done = hashed.where("path in ('c', 'd')").selectExpr("sha256", "case path when 'c' then 'completed' else 'failed' end as status")
    assert sorted(r.path for r in io.new_files(files, done).collect()) == ["a", "d"]


def test_postings_go_there_and_back(spark):
    rows = spark.createDataFrame([(1, {"b": 0.5, "a": 1.0}), (2, {"a": 2.0}), (3, {}), (4, None)], "chunk_id long, sparse map<string,double>")
    postings = search.to_postings(rows)
    assert sorted(map(tuple, postings.collect())) == [(1, "a", 1.0), (1, "b", 0.5), (2, "a", 2.0)]
    assert {r.chunk_id: r.sparse for r in search.from_postings(postings).collect()} == {1: {"a": 1.0, "b": 0.5}, 2: {"a": 2.0}}


def test_split_valid_and_restrict_items(spark):
    rows = spark.createDataFrame([(1, "x", [1.0], {"a": 1.0}), (2, "x", None, {"a": 1.0}), (3, "y", [1.0], None), (4, None, [1.0], {"a": 1.0})], "chunk_id long, item_name string, dense array<double>, sparse map<string,double>")
    valid, rest = search.split_valid(rows)
    assert sorted(r.chunk_id for r in valid.collect()) == [1, 4] and sorted(r.chunk_id for r in rest.collect()) == [2, 3]
    asked = spark.createDataFrame([("q", "x"), ("q", "x"), ("r", "y"), ("s", None)], "query_id string, item_name string")
    assert sorted((r.query_id, r.chunk_id) for r in search.restrict_items(rows, asked).collect()) == [("q", 1), ("q", 2), ("r", 3)]


def test_build_errors(spark):
    results = spark.createDataFrame([(1, None), (2, "bad JSON"), (3, "")], "chunk_id long, error string")
    assert sorted(map(tuple, ev.build_errors(results).collect())) == [(2, "bad JSON"), (3, "")]


def test_build_stats_with_all_errors(spark):
    rows = [(n, n, 2 * n, None if n % 3 else f"bad {n}") for n in range(1, 301)]
    stats, errors = ev.build_stats(spark.createDataFrame(rows, "chunk_id long, entities long, relations long, error string"))
    assert stats.first().asDict() == {"total": 300, "processed": 200, "failed": 100, "entities": 45150, "relations": 90300}
    assert sorted(map(tuple, errors.collect())) == [(n, f"bad {n}") for n in range(3, 301, 3)]
    assert ev.build_stats(errors.where("false").selectExpr("chunk_id", "0L entities", "0L relations", "error"))[0].first().asDict() == dict.fromkeys(("total", "processed", "failed", "entities", "relations"), 0)


def test_ablation_modes(spark):
    lists = {"dense": [1, 2], "vector": [2, 1], "hyde": [2, 3], "graph": [4]}
    hits = spark.createDataFrame([("q", s, n, str(c), 0.0) for s, ids in lists.items() for n, c in enumerate(ids, 1)], "query_id string, source string, rank int, chunk_id string, score double")
    scores = spark.createDataFrame([("q", "1", 0.2), ("q", "3", 0.9), ("q", "4", 0.1)], "query_id string, chunk_id string, score double")
    runs = {}
    for r in fusion.ablation_runs(hits, scores).orderBy("rank").collect():
        runs.setdefault(r.mode, []).append(r.chunk_id)
    assert runs["A"] == ["1", "2"] and runs["B"] == ["2", "1"] and runs["C"][0] == "2" and set(runs["D"]) == {"1", "2", "3", "4"}
    assert runs["F"] == ["3", "1", "4", "2"]  # what the reranker did not score comes last
    assert runs["E"] == runs["G"] == runs["F"][: len(runs["E"])]
