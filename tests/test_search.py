from pyspark.sql import functions as F
import numpy as np
import pytest

from kbspark.operators import evaluation as ev
from kbspark.operators import fusion, graph, models, search


def test_rrf_order(spark):
    lists = {"vector": [1, 2, 3], "hyde": [2, 1, 4], "graph": [5, 1]}
    hits = spark.createDataFrame([("q", s, n, str(c), 0.0) for s, ids in lists.items() for n, c in enumerate(ids, 1)] + [("q", "hyde", 9, None, 0.0)], "query_id string, source string, rank int, chunk_id string, score double")
    assert [r.chunk_id for r in fusion.rrf(hits).orderBy("rank").collect()] == ["1", "2", "3", "4", "5"]
    assert [r.chunk_id for r in fusion.union_candidates(hits, ["graph", "hyde"]).orderBy("rank").collect()] == ["5", "1", "2", "4"]


@pytest.mark.parametrize("scores,keep", [([9, 8.9, 8.8, 8.7, 3], 4), ([9, 1, 0.9], 3), ([1.0] * 12, 10), ([5], 1)])
def test_cliff(spark, scores, keep):
    rows = spark.createDataFrame([("q", n, float(s)) for n, s in enumerate(scores, 1)], "query_id string, rank int, score double")
    assert fusion.cliff_cutoff(rows).count() == keep


def test_metrics(spark):
    runs = spark.createDataFrame([("m", f"q{q}", n, str(100 * q + n)) for q in (1, 2, 3) for n in range(1, 6)], "mode string, question_id string, rank int, chunk_id string")
    gold = spark.createDataFrame([("q1", ["101"]), ("q2", ["203"]), ("q3", ["303", "399"]), ("q4", ["1"])], "question_id string, gold_chunk_ids array<string>")
    r = ev.summarize(ev.question_scores(runs, gold)).first()
    assert (r.questions, r.recall_at_5, r.mrr) == (4, round(2.5 / 4, 6), round((1 + 1 / 3 + 1 / 3) / 4, 6))
    assert ev.check_prefix(runs, "m", "m").first()["ok"]


def test_blocked_search_equals_exact(spark):
    rng = np.random.default_rng(0)
    rows = [(k, k % 3, rng.standard_normal(8).tolist()) for k in range(300)]
    chunks = spark.createDataFrame(rows, "chunk_id long, item_name long, dense array<double>")
    queries = chunks.where("chunk_id % 20 = 0").withColumnRenamed("chunk_id", "query_id")
    both = [sorted(map(tuple, f(queries, chunks, 5, 6).collect())) for f in (search.dense_topk, search.dense_topk_blocked)]
    assert both[0] == both[1] and len(both[0]) == 75


def test_models_keep_rows(spark):
    df = spark.createDataFrame([(k, "bad" if k == 1 else "ok") for k in range(4)], "id int, text string").coalesce(1)

    def encoder():
        def run(texts):
            if "bad" in texts:
                raise ValueError
            return [[1.0]] * len(texts), [{1: 1.0}] * len(texts)

        return run

    got = {r.id: r.dense for r in models.encode(df, "text", encoder, batch=2).collect()}
    assert got == {0: None, 1: None, 2: [1.0], 3: [1.0]}
    tries = models.generate(df, "text", lambda: lambda p: 1 / 0 if p == "bad" else p.upper()).collect()
    assert [r.response for r in sorted(tries)] == ["OK", "", "OK", "OK"]


def test_graph_cleaning(spark):
    answer = '```json\n{"entities": [{"name": " pump ", "label": "Part"}, {"name": "valve with a very long name", "label": "Part"}, {"name": "x", "label": "Nope"}], "relations": [{"head": "pump", "tail": "valve with a very long name", "type": "LIKES"}, {"head": "pump", "tail": "x", "type": "AFFECTS"}]}\n```'
    raw = spark.createDataFrame([("c1", "i", 1, answer), ("c2", "i", 2, "sorry"), ("c3", "i", 3, "")], "chunk_id string, item_name string, chunk_no int, response string")
    parsed, rejected = graph.parse_answers(raw)
    entities = graph.clean_entities(parsed)
    assert {r.name for r in entities.collect()} == {"pump", "valve with a ve"} and rejected.count() == 2
    assert [(r.head, r.type, r.tail) for r in graph.clean_relations(parsed, entities).collect()] == [("pump", "RELATED_TO", "valve with a ve")]


def test_sequence_digest_knows_the_order_of_the_questions(spark):
    rows = [(m, q, r, f"c{(q * r) % 7}") for m in ("A", "B") for q in range(40) for r in (1, 2, 3)]
    runs = spark.createDataFrame(rows, "mode string, question_id long, rank int, chunk_id string")
    place = lambda f: spark.createDataFrame([(q, f(q)) for q in range(40)], "question_id long, pos long")
    digest = lambda runs, f=lambda q: q, bits=2: {r.mode: r.digest for r in ev.sequence_digest(runs, place(f), bits).collect()}
    one = digest(runs)
    assert one["A"] == one["B"] and one == digest(runs.repartition(7, "rank"))
    swapped = digest(runs, lambda q: {3: 30, 30: 3}.get(q, q))
    assert swapped["A"] == swapped["B"] != one["A"]
    other = digest(runs.withColumn("chunk_id", F.expr("CASE WHEN mode = 'B' AND question_id = 17 AND rank = 3 THEN 'x' ELSE chunk_id END")))
    assert other["A"] == one["A"] != other["B"]
    assert digest(runs.where("question_id <> 39 OR mode = 'A'"))["B"] != one["B"]
    assert digest(runs, bits=10)["A"] != digest(runs, lambda q: 39 - q, 10)["A"]
    assert digest(runs.where("false")) == {}
