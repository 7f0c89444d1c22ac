import json

from pyspark.sql import functions as F

from kbspark.operators import graph, search


def test_answers_are_parsed_once(spark):
    answer = F.concat(F.lit('{"entities": [{"name": "n'), F.col("id").cast("string"), F.lit('", "label": "Part"}], "relations": []}'))
    raw = spark.range(4).select(F.col("id").cast("string").alias("chunk_id"), F.lit("i").alias("item_name"), F.col("id").alias("chunk_no"), F.when(F.col("id") == 2, "sorry").otherwise(answer).alias("response"))
    parsed, rejected = graph.parse_answers(raw)
    assert parsed._jdf.queryExecution().optimizedPlan().toString().count("from_json") == 1
    assert [r.chunk_id for r in rejected.collect()] == ["2"] and sorted(r.chunk_id for r in parsed.collect()) == ["0", "1", "3"]


def test_a_name_of_many_queries_is_searched_once(spark, monkeypatch):
    records = spark.createDataFrame([(i, f"{i}{n}", [1.0, float(n)], {n: 1.0, 9: 0.5}) for i in "ab" for n in range(8)], "item_name string, entity string, dense array<double>, sparse map<int,double>")
    names = spark.createDataFrame([(q, f"n{q % 2}", [1.0, 3.0 * (q % 2)], {q % 2: 2.0}) for q in range(12)], "query_id long, name string, dense array<double>, sparse map<int,double>")
    items = spark.createDataFrame([(q, i) for q in range(12) for i in ("ab" if q >= 6 else "a")], "query_id long, item_name string")
    asked, blocked = [], search.dense_topk_blocked
    monkeypatch.setattr(search, "dense_topk_blocked", lambda q, c, *a: asked.append(q.count()) or blocked(q, c, *a))
    got = {}
    for r in graph.hybrid_candidates(names, records, items, k=3).collect():
        got.setdefault(r.query_id, []).append((r.item_name, r.entity, r.score))
    assert asked == [2 + 4]  # two names in item a, and in items a and b
    assert all(len(v) == 3 for v in got.values()) and len(got) == 12
    for q in range(12):  # by hand: the query's own items, k best of each side over all of them
        assert sorted(got[q]) == sorted(got[q - 2 if q % 6 >= 2 else q])
    assert {i for i, *_ in got[0]} == {"a"}


def test_answers_are_cleaned_in_one_narrow_pass(spark):
    e = lambda name, label="Part", text="": {"name": name, "label": label, "description": text}
    r = lambda head, tail, kind="HAS_PART": {"head": head, "tail": tail, "type": kind}
    full = {"entities": [e(" a "), e("a", text="late"), e("a", "Tool", " t "), e("b" * 20), e("c", "Gadget"), e(""), e("  ", "Tool"), {"name": "x"}, None, e("d", " Step ")], "relations": [r("a", "b" * 20), r("a", "c"), r(" a", "d", "ODD"), r("a", "d", None), {"head": "a"}, None, r("d", "a", " REQUIRES ")]}
    texts = [json.dumps(full), "```json\n" + json.dumps({"entities": [e("a"), e("b")], "relations": [r("a", "b")]}).replace("head", "\\u0068ead") + "\n``` ", json.dumps({"entities": [e("a")]}), json.dumps({"relations": [r("a", "b")]}), "{}", "{", "sorry {}", "", None, '```{"entities": []}```\t']
    raw = spark.createDataFrame([(str(n), "i", n, t) for n, t in enumerate(texts)], "chunk_id string, item_name string, chunk_no long, response string")
    parsed = graph.parse_answers(raw)[0]
    entities = graph.clean_entities(parsed)
    relations = graph.clean_relations(parsed, entities)
    answers = graph.clean_answers(parsed)
    rows = lambda df: sorted(map(repr, df.collect()))
    assert rows(graph.answered_entities(answers)) == rows(entities) and entities.count() == 7
    assert rows(graph.answered_relations(answers)) == rows(relations) and relations.count() == 5
    assert "Exchange" not in answers._jdf.queryExecution().executedPlan().toString()
    few = graph.with_relations(raw)
    assert rows(graph.answered_relations(graph.clean_answers(graph.parse_answers(few)[0]))) == rows(relations) and few.count() == 3
    nodes, links, *_ = graph.merge_graph(entities, relations)
    net = graph.nodes_and_relations(answers)
    assert rows(net.where("name is not null").select("item_name", "name")) == rows(nodes.select("item_name", "name"))
    assert rows(net.where("name is null").select("item_name", "head", "type", "tail")) == rows(links)
