"""Pruned sparse search against the plain join."""

import random

import pytest
from pyspark.sql import functions as F

from kbspark.operators import impact, search


def plain(q, c, k, by_item):
    keys = ["item_name", "token"] if by_item else ["token"]
    pairs = q.withColumnRenamed("weight", "_q").join(c.withColumnRenamed("weight", "_c"), keys)
    scored = pairs.groupBy("query_id", "chunk_id").agg(F.sum(F.col("_q") * F.col("_c")).alias("score"))
    return search.top_k(scored, k).select("query_id", "rank", "chunk_id", "score")


def rows(df):
    return sorted((r.query_id, r.rank, r.chunk_id, round(r.score, 9)) for r in df.collect())


def tables(spark, seed, weight, n_chunks=300, kind="int"):
    rng = random.Random(seed)
    words = [f"t{int(rng.paretovariate(0.7)) % 60}" for _ in range(4000)]
    c = {(n, rng.choice("ab"), w): weight(rng) for n in range(n_chunks) for w in rng.sample(words, rng.randrange(1, 12))}
    item = {n: rng.choice("ab") for n in range(n_chunks)}
    c = {(n, item[n], w): v for (n, _, w), v in c.items()}
    q = {(n, i, w): weight(rng) for n in range(25) for i in rng.choice(["a", "b", "ab"]) for w in rng.sample(words, rng.randrange(1, 8))}
    return spark.createDataFrame([(*k, v) for k, v in q.items()], f"query_id long, item_name string, token string, weight {kind}"), spark.createDataFrame([(*k, v) for k, v in c.items()], f"chunk_id long, item_name string, token string, weight {kind}")


@pytest.mark.parametrize(("name", "weight", "kind"), [("counts", lambda r: int(r.paretovariate(1)) % 500 + 1, "int"), ("ones", lambda r: 1, "int"), ("signed", lambda r: r.choice([-2, -1, 0, 1, 3]), "int"), ("real", lambda r: r.random() ** 4, "double")])
def test_equals_plain_join(spark, name, weight, kind):
    q, c = tables(spark, name, weight, kind=kind)
    for by_item in (True, False) if name == "counts" else (True,):
        if not by_item:
            q, c = q.drop("item_name").dropDuplicates(["query_id", "token"]), c.drop("item_name")
        assert rows(search.sparse_topk(q, c, 5, by_item)) == rows(plain(q, c, 5, by_item))


def test_common_tokens_of_small_weight_are_not_met(spark, monkeypatch):
    """Every chunk has the same common tokens; few have more: what is scored in full stays near these few."""
    c = spark.range(3000).selectExpr("id AS chunk_id", "explode(array('the', 'and', concat('r', id % 500))) AS token", "1 AS weight").withColumn("weight", F.expr("CASE WHEN token LIKE 'r%' THEN 5 ELSE 1 END"))
    q = spark.range(40).selectExpr("id AS query_id", "explode(array('the', 'and', concat('r', id), concat('r', id + 1))) AS token", "1 AS weight")
    monkeypatch.setattr(impact, "FIRST", 4)
    met, scores = [], impact._scores
    monkeypatch.setattr(impact, "_scores", lambda wanted, *a: met.append(wanted.select("query_id", "chunk_id").distinct().count()) or scores(wanted, *a))
    assert rows(search.sparse_topk(q, c, 5, False)) == rows(plain(q, c, 5, False))
    assert sum(met) < 40 * 3000 / 10


def test_shuffled_way_odd_rows_and_empty_tables(spark, monkeypatch):
    q, c = tables(spark, 7, lambda r: r.randrange(1, 9))
    want = rows(plain(q, c, 3, True))
    odd = spark.createDataFrame([(None, "a", "t1", 3), (1, None, "t1", 3), (2, "a", None, 3), (3, "a", "t1", None)], "chunk_id long, item_name string, token string, weight int")
    monkeypatch.setattr(impact, "SENT_ROWS", 0)
    assert rows(search.sparse_topk(q, c.unionByName(odd), 3)) == want
    assert rows(search.sparse_topk(q, c.where("false"))) == rows(search.sparse_topk(q.where("false"), c)) == []


def test_one_index_serves_many_searches(spark):
    q, c = tables(spark, 9, lambda r: r.randrange(1, 9))
    index = impact.impact_index(c)
    for part in (q.where("query_id < 9"), q.where("query_id >= 9")):
        assert rows(impact.search(part, index, 4)) == rows(plain(part, c, 4, True))


def test_chunks_that_tie_behind_the_kth_are_not_scored(spark, monkeypatch):
    """All weights are one, and most chunks tie: what is scored in full stays near the k best, not near the ties."""
    c = spark.range(3000).selectExpr("id AS chunk_id", "explode(array('a', 'b', concat('r', id % 7))) AS token", "1 AS weight")
    q = spark.range(20).selectExpr("id AS query_id", "explode(array('a', 'b', 'c')) AS token", "1 AS weight")
    monkeypatch.setattr(impact, "FIRST", 4)
    met, scores = [], impact._scores
    monkeypatch.setattr(impact, "_scores", lambda wanted, *a: met.append(wanted.select("query_id", "chunk_id").distinct().count()) or scores(wanted, *a))
    assert rows(search.sparse_topk(q, c, 5, False)) == rows(plain(q, c, 5, False))
    assert sum(met) < 20 * 3000 / 50
