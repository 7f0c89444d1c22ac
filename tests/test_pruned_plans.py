import numpy as np
import pytest

from kbspark.operators import fusion, search
from kbspark.plans import retrieval


def test_dense_search_scores_few_pairs_and_keeps_exact_ties(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = [(k, k % 2, rng.standard_normal(8).tolist()) for k in range(200)] + [(k, 0, [1.0] * 8) for k in range(200, 260)] + [(300, 0, None), (301, 0, [0.0] * 8), (302, 0, [1.0, None]), (303, 1, [2.0] * 3)]
    chunks = spark.createDataFrame(rows, "chunk_id long, item_name long, dense array<double>")
    queries = chunks.where("chunk_id % 20 = 0 or chunk_id in (301, 302)").withColumnRenamed("chunk_id", "query_id")
    pairs = chunks.withColumnRenamed("dense", "_c").join(queries.withColumnRenamed("dense", "_q"), "item_name").select("query_id", "chunk_id", search.cosine("_q", "_c").alias("score"))
    want = sorted(map(tuple, search.top_k(pairs, 5).select("query_id", "rank", "chunk_id", "score").collect()))
    scored, top_k = [], search.top_k
    monkeypatch.setattr(search, "top_k", lambda s, *a: scored.append(s.count()) or top_k(s, *a))
    assert sorted(map(tuple, search.dense_topk(queries, chunks, 5).collect())) == want
    assert scored[0] <= 12 * queries.count() < pairs.count() / 4


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    words = ("alpha", "beta", "gamma", "delta")
    docs = [(n, " ".join(w for i, w in enumerate(words) for _ in range(1 + (n * (i + 3)) % 5)) + (" seldom" if n % 37 == 5 else "")) for n in range(300)]
    asked = [(1, "alpha beta"), (2, "gamma delta seldom"), (3, "beta beta alpha unknown"), (4, "seldom")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(asked, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def test_hybrid_search_and_ablation_do_not_meet_all_pairs(spark, tables, monkeypatch):
    p = retrieval.pairs(spark, tables)
    n = {1: 2, 2: 3, 3: 3, 4: 1}
    want = {}
    for r in p.collect():
        want.setdefault(r.query_id, []).append((-round((1 + r.shared / n[r.query_id]) / 2 * 0.4 + (0.5 + np.arctan(r.rare) / np.pi) * 0.6, 12), r.chunk_id))
    want = {q: [c for _, c in sorted(v)[:5]] for q, v in want.items()}
    met, hybrid, ablation = [], search.hybrid_topk, fusion.ablation_runs
    monkeypatch.setattr(search, "hybrid_topk", lambda a, b, *x, **y: met.append(a.count()) or hybrid(a, b, *x, **y))
    monkeypatch.setattr(fusion, "ablation_runs", lambda h, s, *x: met.append(s.count()) or ablation(h, s, *x))
    got = {}
    for r in sorted(retrieval.q_hybrid(spark, tables).collect(), key=lambda r: r["rank"]):
        got.setdefault(r.query_id, []).append(r.chunk_id)
    assert got == want
    retrieval.q_ablation(spark, tables).count()
    assert max(met) < p.count() / 4
