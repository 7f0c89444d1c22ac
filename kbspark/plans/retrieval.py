"""Queries over retrieval and its evaluation, on documents, benchmark and embeddings.

Stand-ins: documents are the chunks and benchmark rows the questions. Three retrievers work on shared
tokens: term frequency ('vector'), distinct overlap ('hyde') and rare tokens ('graph'). A question's gold
are the documents that hold all its tokens.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kbspark.operators import evaluation as ev
from kbspark.operators import fusion, impact, search
from kbspark.sources.io import check_gold
from kbspark.sources.shared import keep

K = 10
TOKEN = "[a-z]{3,}"
RARE = 20


def _tokens(df: DataFrame, key: str, name: str) -> DataFrame:
    rows = df.select(F.col(key).alias(name), F.explode(F.regexp_extract_all(F.lower("text"), F.lit(TOKEN), 0)).alias("token"))
    return rows.groupBy(name, "token").agg(F.count("*").alias("weight"))


def postings(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs, questions = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "benchmark"))
    return _tokens(questions, "item_id", "query_id"), _tokens(docs, "doc_id", "chunk_id")


def pairs(spark: SparkSession, d: str) -> DataFrame:
    """query_id, chunk_id, tf, shared, rare of every question and document with a common token."""
    q, c = postings(spark, d)
    rare = c.groupBy("token").agg((F.count("*") <= RARE).alias("rare"))
    q = q.withColumnRenamed("weight", "w").join(rare, "token")
    return q.join(c, "token").groupBy("query_id", "chunk_id").agg(F.sum(F.col("w") * F.col("weight")).alias("tf"), F.count("*").alias("shared"), F.count_if("rare").alias("rare"))


def kept_postings(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Questions' postings, and documents' postings of their tokens (with df, the token's number of documents), made once."""
    q, c = postings(spark, d)
    q = keep(q, "asked")
    tokens = q.select("token").distinct()
    c = keep(c.join(impact.sent(tokens, q.count()), "token", "left_semi"), "postings")
    df = c.groupBy("token").agg(F.count("*").alias("df"))
    return keep(q.join(df, "token", "left"), "asked-df"), c


def hits(spark: SparkSession, d: str, kept: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """query_id, source, rank, chunk_id, score: each retriever's K best, searched with a bound where tokens are common."""
    q, c = kept or kept_postings(spark, d)
    one = lambda t: t.withColumn("weight", F.lit(1))
    best = lambda q, c: impact.search(q, impact.impact_index(c, False, write=False), K)
    rare = q.where(F.col("df") <= RARE).select("query_id", "token")
    few = rare.join(c, "token").groupBy("query_id", "chunk_id").agg(F.count("*").alias("score"))  # RARE rows a token at most
    found = {"vector": best(q, c), "hyde": best(one(q), one(c)), "graph": search.top_k(few, K)}
    rows = [df.select("query_id", F.lit(source).alias("source"), "rank", "chunk_id", "score") for source, df in found.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


def gold(spark: SparkSession, d: str, kept: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Gold questions with at least one gold document; category = parity of the question's length."""
    q, c = kept or kept_postings(spark, d)
    # A document with all tokens of a question has its rarest one: only those documents are looked at.
    sizes = q.groupBy("query_id").agg(F.count("*").alias("size"), F.min_by("token", F.struct("df", "token")).alias("token"), F.count("df").alias("known"))
    near = keep(sizes.where("size = known").join(c.select("token", "chunk_id"), "token").select("query_id", "size", "chunk_id"), "near")
    shared = near.join(q.select("query_id", "token"), "query_id").join(c.select("token", "chunk_id"), ["token", "chunk_id"]).groupBy("query_id", "chunk_id", "size").agg(F.count("*").alias("shared"))
    ids = shared.where("shared = size").groupBy("query_id").agg(F.array_sort(F.collect_set(F.col("chunk_id").cast("string"))).alias("gold_chunk_ids"))
    questions = spark.read.parquet(f"{d}/benchmark.parquet").join(ids.withColumnRenamed("query_id", "item_id"), "item_id", "left")
    rows = questions.select(F.col("item_id").alias("question_id"), F.col("text").alias("question"), F.lit("item").alias("item_name"), F.when(F.length("text") % 2 == 0, "even").otherwise("odd").alias("category"), "gold_chunk_ids")
    return check_gold(rows)[0].select("question_id", "category", "gold_chunk_ids")


def modes(spark: SparkSession, d: str, kept: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """mode, question_id, rank, chunk_id: the retrievers, their fusion, and the fusion cut at a cliff."""
    h = keep(hits(spark, d, kept), "hits")
    fused = fusion.rrf(h)
    runs = h.where("rank <= 5").select(F.col("source").alias("mode"), "query_id", "rank", "chunk_id")
    runs = runs.unionByName(fused.where("rank <= 5").select(F.lit("rrf").alias("mode"), "query_id", "rank", "chunk_id"))
    cut = fusion.cliff_cutoff(fused, gap_abs=0.005, gap_ratio=0.3)
    runs = runs.unionByName(cut.where("rank <= 5").select(F.lit("cut").alias("mode"), "query_id", "rank", "chunk_id"))
    return runs.select("mode", F.col("query_id").alias("question_id"), "rank", F.col("chunk_id").cast("string").alias("chunk_id"))


def flagship(spark, d):
    """Recall and MRR of every mode: retrieval, fusion, cut and evaluation end to end."""
    return ev.summarize(_scores(spark, d))


def _scores(spark, d) -> DataFrame:
    """Each question's measures in each mode, from one retrieval (kept while the query runs)."""
    kept = kept_postings(spark, d)
    return ev.question_scores(modes(spark, d, kept), gold(spark, d, kept))


def _emb(spark, d):
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    chunks = e.select(F.col("vec_id").alias("chunk_id"), F.col("label").alias("item_name"), F.col("embedding").alias("dense"))
    return chunks.where("chunk_id % 20 = 0").withColumnRenamed("chunk_id", "query_id"), chunks


def q_dense(spark, d):
    return search.dense_topk(*_emb(spark, d), k=5, digits=6)


def q_dense_blocked(spark, d):
    return search.dense_topk_blocked(*_emb(spark, d), k=5, digits=6)


def q_sparse(spark, d):
    return search.sparse_topk(*postings(spark, d), k=5, by_item=False)


def counted(wanted: DataFrame, kept: tuple[DataFrame, DataFrame]) -> DataFrame:
    """query_id, chunk_id, tf, shared, rare of the wanted(query_id, chunk_id) that share a token."""
    q, c = kept
    met = wanted.join(q.withColumnRenamed("weight", "w"), "query_id").join(c, ["token", "chunk_id"])
    return met.groupBy("query_id", "chunk_id").agg(F.sum(F.col("w") * F.col("weight")).alias("tf"), F.count("*").alias("shared"), F.count_if(F.col("df") <= RARE).alias("rare"))


def q_hybrid(spark, d):
    """Dense scores of the questions' gold-like neighbours are stood in by overlap shares in [0, 1].

    A document without a rare token of the question is among the best only if its overlap is, so the best by overlap and all with a rare token do.
    """
    kept = q, c = kept_postings(spark, d)
    one = lambda t: t.withColumn("weight", F.lit(1))
    most = impact.search(one(q), impact.impact_index(one(c), False, write=False), 5)
    rare = q.where(F.col("df") <= RARE).select("query_id", "token").join(c, "token")
    p = keep(counted(most.select("query_id", "chunk_id").unionByName(rare.select("query_id", "chunk_id")).distinct(), kept), "pairs")
    size = q.groupBy("query_id").agg(F.count("*").alias("n"))
    share = p.join(size, "query_id").select("query_id", "chunk_id", (F.col("shared") / F.col("n")).alias("score"))
    out = search.hybrid_topk(share, p.select("query_id", "chunk_id", F.col("rare").alias("score")), (0.4, 0.6), k=5)
    return out.withColumn("score", F.round("score", 6))


def q_rrf(spark, d):
    return fusion.rrf(hits(spark, d)).withColumn("score", F.round("score", 9))


SWEEP = [("even", {"vector": 1.0, "hyde": 1.0, "graph": 1.0}), ("text", {"vector": 1.0, "hyde": 0.9}), ("graph", {"graph": 1.0, "hyde": 0.2})]


def q_sweep(spark, d):
    return fusion.rrf_sweep(hits(spark, d), SWEEP).withColumn("score", F.round("score", 9))


def q_cliff(spark, d):
    h = hits(spark, d).where("source = 'vector'").select("query_id", "rank", "chunk_id", F.col("score").cast("double").alias("score"))
    return fusion.cliff_cutoff(h, gap_abs=1000.0, gap_ratio=0.1)


def q_union(spark, d):
    return fusion.union_candidates(hits(spark, d), ["graph", "hyde", "vector"])


def q_backfill(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet").where("lang = 'en'").select(F.col("doc_id").alias("chunk_id"), "source", "n_chars")
    h = hits(spark, d).where("source = 'hyde'").select("query_id", "rank", "chunk_id")
    return fusion.backfill(h, docs).select("query_id", "rank", "chunk_id", "source", "n_chars")


def q_merge(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("query_id"), F.col("doc_id").alias("chunk_id"), F.col("source").alias("title"), F.col("text").alias("content"))
    pages = spark.read.parquet(f"{d}/pages.parquet").select(F.col("page_id").alias("query_id"), "url", F.lit("page").alias("title"), F.when(F.col("page_id") % 2 == 0, F.lit(" ")).otherwise(F.col("html")).alias("content"), F.when(F.col("page_id") % 3 != 0, F.col("url")).alias("snippet"))
    return fusion.merge_sources(docs, pages).select("query_id", "source", "chunk_id", "url", F.length("content").cast("long").alias("n"))


def _overlap():
    def model(pairs):
        return [len(set(q.lower().split()) & set(c.lower().split())) / (1 + len(set(q.lower().split()))) for q, c in pairs]

    return model


def q_rerank(spark, d):
    """Fused candidates scored by a stand-in model (word overlap of question and document)."""
    texts = spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"))
    asked = spark.read.parquet(f"{d}/benchmark.parquet").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    c = fusion.rrf(hits(spark, d)).select("query_id", "chunk_id").join(texts, "chunk_id").join(asked, "query_id").withColumns({"source": F.lit("local"), "url": F.lit("")})
    return fusion.cliff_cutoff(fusion.rerank(c, _overlap)).select("query_id", "rank", "chunk_id", F.round("score", 6).alias("score"))


def q_scores(spark, d):
    return _scores(spark, d).select("mode", "question_id", *[F.round(c, 6).alias(c) for c in ("recall_at_1", "recall_at_3", "recall_at_5", "rr")])


def q_category(spark, d):
    return ev.summarize(_scores(spark, d), ("mode", "category"))


def q_compare(spark, d):
    return ev.compare_modes(modes(spark, d))


def q_digest(spark, d):
    """Questions in the order of their ids."""
    return ev.sequence_digest(modes(spark, d), spark.read.parquet(f"{d}/benchmark.parquet").select(F.col("item_id").alias("question_id"), F.col("item_id").alias("pos")))


def q_pool(spark, d):
    kept = kept_postings(spark, d)
    stages = hits(spark, d, kept).where("rank <= 5").select(F.col("query_id").alias("question_id"), F.col("source").alias("stage"), "chunk_id")
    return ev.pool_diagnostics(stages, gold(spark, d, kept), "vector", ["hyde", "graph"])


def q_prefix(spark, d):
    m = modes(spark, d)
    one = lambda kind, df: df.select(F.lit(kind).alias("kind"), "ok", "failed")
    return one("cut is a prefix of rrf", ev.check_prefix(m, "rrf", "cut")).unionByName(one("vector equals hyde", ev.check_equal(m, "vector", "hyde")))


def q_ablation(spark, d):
    """Modes A to G: A ranks by the cosine of the token vectors (squared, which keeps the order), B by their product."""
    kept = q, c = kept_postings(spark, d)
    h = keep(hits(spark, d, kept), "hits")
    qn, cn = (t.groupBy(k).agg(F.sum(F.col("weight") * F.col("weight")).cast("double").alias(n)) for t, k, n in ((q, "query_id", "qn"), (postings(spark, d)[1], "chunk_id", "cn")))
    cn = keep(cn, "norms")
    scaled = keep(c.join(cn, "chunk_id").withColumn("weight", F.col("weight") / F.sqrt("cn")), "scaled")
    near = impact.candidates(q, impact.impact_index(scaled, False, write=False), K).select("query_id", "chunk_id").distinct()
    cosine = counted(near, kept).join(qn, "query_id").join(cn, "chunk_id").select("query_id", "chunk_id", (F.col("tf").cast("double") * F.col("tf") / (F.col("qn") * F.col("cn"))).alias("score"))
    dense = search.top_k(cosine, K).select("query_id", F.lit("dense").alias("source"), "rank", "chunk_id", "score")
    p = counted(h.select("query_id", "chunk_id").distinct(), kept).select("query_id", "chunk_id", (F.col("tf") + F.col("rare")).cast("double").alias("score"))
    return fusion.ablation_runs(h.unionByName(dense), p)


def q_confirm(spark, d):
    kept = kept_postings(spark, d)
    g = gold(spark, d, kept).select(F.col("question_id").alias("query_id"), F.explode("gold_chunk_ids").alias("chunk_id"))
    top = hits(spark, d, kept).where("source = 'hyde' and rank = 1").withColumn("chunk_id", F.col("chunk_id").cast("string"))
    seen = top.join(g.withColumn("confirmed", F.lit(True)), ["query_id", "chunk_id"], "left")
    return ev.confirm_rate(seen.select(F.coalesce("confirmed", F.lit(False)).alias("confirmed")))


QUERIES = {
    "retrieval_flagship": flagship, "dense_topk": q_dense, "dense_topk_blocked": q_dense_blocked, "sparse_topk": q_sparse, "hybrid_topk": q_hybrid, "rrf": q_rrf, "rrf_sweep": q_sweep, "cliff_cutoff": q_cliff,
    "union_candidates": q_union, "backfill": q_backfill, "merge_sources": q_merge, "rerank": q_rerank, "recall_mrr": q_scores, "summary_by_category": q_category, "compare_modes": q_compare,
    "sequence_digest": q_digest, "pool_diagnostics": q_pool, "prefix_checks": q_prefix, "ablation_runs": q_ablation, "confirm_rate": q_confirm,
}

_PAIRS = """
WITH dt AS (SELECT doc_id AS chunk_id, unnest(regexp_extract_all(lower(text), '[a-z]{3,}')) AS token FROM documents),
cp AS (SELECT chunk_id, token, count(*) AS w FROM dt GROUP BY ALL),
qt AS (SELECT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[a-z]{3,}')) AS token FROM benchmark),
qp AS (SELECT query_id, token, count(*) AS w FROM qt GROUP BY ALL),
df AS (SELECT token, count(*) <= 20 AS rare FROM cp GROUP BY token),
pairs AS (SELECT query_id, chunk_id, CAST(sum(qp.w * cp.w) AS BIGINT) AS tf, count(*) AS shared, count(*) FILTER (WHERE df.rare) AS rare
          FROM qp JOIN df USING (token) JOIN cp USING (token) GROUP BY query_id, chunk_id)"""
_HITS = _PAIRS + """,
scored AS (SELECT query_id, 'vector' AS source, chunk_id, tf AS score FROM pairs WHERE tf > 0 UNION ALL SELECT query_id, 'hyde', chunk_id, shared FROM pairs UNION ALL SELECT query_id, 'graph', chunk_id, rare FROM pairs WHERE rare > 0),
hits AS (SELECT query_id, source, CAST(row_number() OVER (PARTITION BY query_id, source ORDER BY score DESC, chunk_id) AS INTEGER) AS rank, chunk_id, score FROM scored QUALIFY rank <= 10),
parts AS (SELECT query_id, chunk_id, sum(1.0::DOUBLE / (60 + rank)) FILTER (WHERE source = 'vector') AS a, sum(0.9::DOUBLE / (60 + rank)) FILTER (WHERE source = 'hyde') AS b, sum(0.4::DOUBLE / (60 + rank)) FILTER (WHERE source = 'graph') AS c,
          min(CASE source WHEN 'vector' THEN 1000 WHEN 'hyde' THEN 2000 ELSE 3000 END + rank) AS seen FROM hits GROUP BY ALL),
rrf AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, seen, chunk_id) AS INTEGER) AS rank, chunk_id, score
        FROM (SELECT *, 0.0::DOUBLE + coalesce(a, 0) + coalesce(b, 0) + coalesce(c, 0) AS score FROM parts) QUALIFY rank <= 10)"""
_CUT = """,
gaps AS (SELECT *, score - lead(score) OVER (PARTITION BY query_id ORDER BY rank) AS gap FROM rrf),
cutat AS (SELECT query_id, min(rank) AS cutoff FROM gaps WHERE rank >= 3 AND (gap >= 0.005 OR gap / (abs(score) + 1e-6) >= 0.3) GROUP BY query_id),
cut AS (SELECT rrf.* FROM rrf LEFT JOIN cutat USING (query_id) WHERE cutoff IS NULL OR rank <= cutoff),
runs AS (SELECT source AS mode, query_id AS question_id, rank, chunk_id FROM hits WHERE rank <= 5 UNION ALL SELECT 'rrf', query_id, rank, chunk_id FROM rrf WHERE rank <= 5 UNION ALL SELECT 'cut', query_id, rank, chunk_id FROM cut WHERE rank <= 5)"""
_GOLD = """,
gold AS (SELECT p.query_id AS question_id, p.chunk_id FROM pairs p JOIN (SELECT query_id, count(*) AS size FROM qp GROUP BY ALL) s USING (query_id) WHERE shared = size),
asked AS (SELECT DISTINCT question_id, CASE WHEN length(text) % 2 = 0 THEN 'even' ELSE 'odd' END AS category, count(*) OVER (PARTITION BY question_id) AS size FROM gold JOIN benchmark ON item_id = question_id),
found AS (SELECT mode, question_id, count(*) FILTER (WHERE rank <= 1) AS h1, count(*) FILTER (WHERE rank <= 3) AS h3, count(*) FILTER (WHERE rank <= 5) AS h5, min(rank) FILTER (WHERE rank <= 5) AS first FROM runs JOIN gold USING (question_id, chunk_id) GROUP BY ALL),
scores AS (SELECT m.mode, a.question_id, a.category, coalesce(h1, 0)::DOUBLE / size AS recall_at_1, coalesce(h3, 0)::DOUBLE / size AS recall_at_3, coalesce(h5, 0)::DOUBLE / size AS recall_at_5, coalesce(1.0::DOUBLE / first, 0.0::DOUBLE) AS rr
           FROM asked a CROSS JOIN (SELECT DISTINCT mode FROM runs) m LEFT JOIN found f ON f.mode = m.mode AND f.question_id = a.question_id)"""
_MEANS = "count(*) AS questions, round(avg(recall_at_1), 6) AS recall_at_1, round(avg(recall_at_3), 6) AS recall_at_3, round(avg(recall_at_5), 6) AS recall_at_5, round(avg(rr), 6) AS mrr"
_DENSE = """
WITH c AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS chunk_id, round(list_dot_product(q.v, c.v) / (sqrt(list_dot_product(q.v, q.v)) * sqrt(list_dot_product(c.v, c.v))), 6) AS score FROM c q JOIN c ON q.label = c.label WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank, chunk_id, score FROM s QUALIFY rank <= 5"""


def _sweep_sql() -> str:
    values = ", ".join(f"('{name}', '{s}', {w}::DOUBLE, {n})" for name, ws in SWEEP for n, (s, w) in enumerate(ws.items(), 1))
    return _HITS + f""", settings(setting, source, weight, place) AS (VALUES {values}),
f AS (SELECT setting, query_id, chunk_id, sum(weight / (60 + rank)) AS score, min(place * 1000 + rank) AS seen FROM hits JOIN settings USING (source) GROUP BY ALL)
SELECT setting, query_id, CAST(row_number() OVER (PARTITION BY setting, query_id ORDER BY round(score, 12) DESC, seen, chunk_id) AS INTEGER) AS rank, chunk_id, round(score, 9) AS score FROM f QUALIFY rank <= 10"""


_RANKED = """,
qn AS (SELECT query_id, sum(w * w)::DOUBLE AS qn FROM qp GROUP BY 1), cn AS (SELECT chunk_id, sum(w * w)::DOUBLE AS cn FROM cp GROUP BY 1),
dense AS (SELECT query_id, chunk_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY tf::DOUBLE * tf / (qn * cn) DESC, chunk_id) AS INTEGER) AS rank FROM pairs JOIN qn USING (query_id) JOIN cn USING (chunk_id) WHERE tf > 0),
ranked AS (SELECT r.query_id, r.chunk_id, CAST(row_number() OVER (PARTITION BY r.query_id ORDER BY tf + rare DESC, r.chunk_id) AS INTEGER) AS rank, (tf + rare)::DOUBLE AS score FROM rrf r JOIN pairs p USING (query_id, chunk_id)),
two AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY 0.0::DOUBLE + coalesce(a, 0) + coalesce(b, 0) DESC, seen, chunk_id) AS INTEGER) AS rank, chunk_id FROM parts WHERE a IS NOT NULL OR b IS NOT NULL QUALIFY rank <= 10),
g2 AS (SELECT *, score - lead(score) OVER (PARTITION BY query_id ORDER BY rank) AS gap FROM ranked),
at2 AS (SELECT query_id, min(rank) AS cutoff FROM g2 WHERE rank >= 3 AND (gap >= 0.5 OR gap / (abs(score) + 1e-6) >= 0.25) GROUP BY query_id),
cut2 AS (SELECT ranked.* FROM ranked LEFT JOIN at2 USING (query_id) WHERE cutoff IS NULL OR rank <= cutoff)
SELECT 'A' AS mode, query_id, rank, chunk_id FROM dense WHERE rank <= 5 UNION ALL SELECT 'B', query_id, rank, chunk_id FROM hits WHERE source = 'vector' AND rank <= 5
UNION ALL SELECT 'C', query_id, rank, chunk_id FROM two WHERE rank <= 5 UNION ALL SELECT 'D', query_id, rank, chunk_id FROM rrf WHERE rank <= 5
UNION ALL SELECT 'E', query_id, rank, chunk_id FROM cut2 WHERE rank <= 5 UNION ALL SELECT 'F', query_id, rank, chunk_id FROM ranked WHERE rank <= 5 UNION ALL SELECT 'G', query_id, rank, chunk_id FROM cut2 WHERE rank <= 5"""

SQL = {
    "retrieval_flagship": _HITS + _CUT + _GOLD + f" SELECT mode, {_MEANS} FROM scores GROUP BY mode",
    "dense_topk": _DENSE,
    "dense_topk_blocked": _DENSE,
    "sparse_topk": _HITS + " SELECT query_id, rank, chunk_id, score FROM hits WHERE source = 'vector' AND rank <= 5",
    "hybrid_topk": _PAIRS + """, n AS (SELECT query_id, count(*) AS n FROM qp GROUP BY ALL),
s AS (SELECT query_id, chunk_id, (1.0::DOUBLE + shared::DOUBLE / n) / 2 * 0.4 + (0.5::DOUBLE + atan(rare::DOUBLE) / pi()) * 0.6 AS score FROM pairs JOIN n USING (query_id))
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, chunk_id) AS INTEGER) AS rank, chunk_id, round(score, 6) AS score FROM s QUALIFY rank <= 5""",
    "rrf": _HITS + " SELECT query_id, rank, chunk_id, round(score, 9) AS score FROM rrf",
    "rrf_sweep": _sweep_sql(),
    "cliff_cutoff": _HITS + """, v AS (SELECT query_id, rank, chunk_id, score::DOUBLE AS score FROM hits WHERE source = 'vector'),
g AS (SELECT *, score - lead(score) OVER (PARTITION BY query_id ORDER BY rank) AS gap FROM v), a AS (SELECT query_id, min(rank) AS cutoff FROM g WHERE rank >= 3 AND (gap >= 1000 OR gap / (abs(score) + 1e-6) >= 0.1) GROUP BY query_id)
SELECT v.* FROM v LEFT JOIN a USING (query_id) WHERE cutoff IS NULL OR rank <= cutoff""",
    "union_candidates": _HITS + """ SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY seen, chunk_id) AS INTEGER) AS rank, chunk_id
FROM (SELECT query_id, chunk_id, min(CASE source WHEN 'graph' THEN 1000 WHEN 'hyde' THEN 2000 ELSE 3000 END + rank) AS seen FROM hits GROUP BY ALL)""",
    "backfill": _HITS + """ SELECT h.query_id, CAST(row_number() OVER (PARTITION BY h.query_id ORDER BY h.rank) AS INTEGER) AS rank, h.chunk_id, d.source, d.n_chars FROM hits h JOIN documents d ON d.doc_id = h.chunk_id WHERE h.source = 'hyde' AND d.lang = 'en'""",
    "merge_sources": """SELECT doc_id AS query_id, 'local' AS source, CAST(doc_id AS VARCHAR) AS chunk_id, CAST(NULL AS VARCHAR) AS url, length(trim(text)) AS n FROM documents WHERE trim(text) <> ''
UNION ALL SELECT page_id, 'web', NULL, url, length(CASE WHEN page_id % 2 = 1 THEN trim(html) ELSE url END) FROM pages WHERE page_id % 2 = 1 OR page_id % 3 <> 0""",
    "recall_mrr": _HITS + _CUT + _GOLD + " SELECT mode, question_id, round(recall_at_1, 6) AS recall_at_1, round(recall_at_3, 6) AS recall_at_3, round(recall_at_5, 6) AS recall_at_5, round(rr, 6) AS rr FROM scores",
    "summary_by_category": _HITS + _CUT + _GOLD + f" SELECT mode, category, {_MEANS} FROM scores GROUP BY mode, category",
    "compare_modes": _HITS + _CUT + """, l AS (SELECT mode, question_id, list(chunk_id ORDER BY rank) AS ids FROM runs GROUP BY ALL), m AS (SELECT DISTINCT mode FROM runs), q AS (SELECT DISTINCT question_id FROM runs)
SELECT a.mode AS mode_a, b.mode AS mode_b, count(*) FILTER (WHERE x.ids IS DISTINCT FROM y.ids) AS different, count(*) FILTER (WHERE x.ids IS DISTINCT FROM y.ids) = 0 AS identical
FROM m a JOIN m b ON a.mode < b.mode CROSS JOIN q LEFT JOIN l x ON x.mode = a.mode AND x.question_id = q.question_id LEFT JOIN l y ON y.mode = b.mode AND y.question_id = q.question_id GROUP BY a.mode, b.mode""",
    "sequence_digest": _HITS + _CUT + """, k AS (SELECT mode, question_id, string_agg(CAST(chunk_id AS VARCHAR), '","' ORDER BY rank) AS ids FROM runs GROUP BY mode, question_id),
l AS (SELECT mode, question_id, sha256('["' || question_id || '",["' || ids || '"]]') AS x FROM k)
SELECT mode, sha256(string_agg(question_id || ':' || x, ',' ORDER BY question_id)) AS digest FROM l GROUP BY mode""",
    "pool_diagnostics": _HITS + _CUT + _GOLD + """, f AS (SELECT g.question_id, g.chunk_id, coalesce(bool_or(source = 'vector'), false) AS v, coalesce(bool_or(source = 'hyde'), false) AS h, coalesce(bool_or(source = 'graph'), false) AS k
  FROM gold g LEFT JOIN hits ON query_id = g.question_id AND hits.chunk_id = g.chunk_id AND rank <= 5 GROUP BY ALL),
p AS (SELECT question_id, avg(v::INT) AS r0, avg((v OR h)::INT) AS r1, avg((v OR h OR k)::INT) AS r2, bool_or(v) AS n0, bool_or(h AND NOT v) AS n1, bool_or(k AND NOT v AND NOT h) AS n2 FROM f GROUP BY question_id)
SELECT 'vector' AS added, round(avg(r0), 6) AS recall, count(*) FILTER (WHERE n0) AS questions_with_new_gold FROM p UNION ALL SELECT 'hyde', round(avg(r1), 6), count(*) FILTER (WHERE n1) FROM p UNION ALL SELECT 'graph', round(avg(r2), 6), count(*) FILTER (WHERE n2) FROM p""",
    "prefix_checks": _HITS + _CUT + """, l AS (SELECT mode, question_id, list(chunk_id ORDER BY rank) AS ids FROM runs GROUP BY ALL),
p AS (SELECT question_id, max(ids) FILTER (WHERE mode = 'rrf') AS x, max(ids) FILTER (WHERE mode = 'cut') AS y FROM l GROUP BY ALL HAVING count(*) FILTER (WHERE mode IN ('rrf', 'cut')) > 0),
e AS (SELECT question_id, max(ids) FILTER (WHERE mode = 'vector') AS x, max(ids) FILTER (WHERE mode = 'hyde') AS y FROM l GROUP BY ALL HAVING count(*) FILTER (WHERE mode IN ('vector', 'hyde')) > 0)
SELECT 'cut is a prefix of rrf' AS kind, coalesce(bool_and(y IS NULL OR x[1:len(y)] = y), true) AS ok, count(*) FILTER (WHERE NOT (y IS NULL OR x[1:len(y)] = y)) AS failed FROM p
UNION ALL SELECT 'vector equals hyde', coalesce(bool_and(x IS NOT DISTINCT FROM y), true), count(*) FILTER (WHERE x IS DISTINCT FROM y) FROM e""",
    "ablation_runs": _HITS + _RANKED,
    "confirm_rate": _HITS + _CUT + _GOLD + " SELECT coalesce(round(avg((g.chunk_id IS NOT NULL)::INT::DOUBLE), 6), 0.0) AS confirm_rate, count(*) AS questions FROM hits h LEFT JOIN gold g ON g.question_id = h.query_id AND g.chunk_id = h.chunk_id WHERE source = 'hyde' AND rank = 1",
}
