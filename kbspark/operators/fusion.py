"""Ranked lists: reciprocal rank fusion, reranking, cut-off, back-fill, retrieval modes.

Hits: query_id, source, rank, chunk_id, score.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kbspark.operators.models import score_pairs

WEIGHTS = {"vector": 1.0, "hyde": 0.9, "graph": 0.4}  #: sources in their order, with their weights


def backfill(hits: DataFrame, chunks: DataFrame, by: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """Chunk columns onto ranked ids; ids without a chunk drop out and ranks close up."""
    w = Window.partitionBy(*by).orderBy("rank")
    return hits.join(chunks.dropDuplicates(["chunk_id"]), "chunk_id").withColumn("rank", F.row_number().over(w))


def rrf(hits: DataFrame, weights: dict[str, float] | None = None, k: int = 60, top_k: int = 10, by: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """Sum of weight / (k + rank) over the sources; ties go to the chunk seen first, sources in their order. Rows without an id keep their rank but fuse nothing."""
    weights = weights or WEIGHTS
    order = F.array_position(F.array(*map(F.lit, weights)), F.col("source"))
    rows = hits.where(F.col("source").isin(*weights) & F.col("chunk_id").isNotNull())
    parts = [F.sum(F.when(F.col("source") == s, F.lit(float(w)) / (k + F.col("rank")))).alias(f"_{n}") for n, (s, w) in enumerate(weights.items())]
    fused = rows.groupBy(*by, "chunk_id").agg(*parts, F.min(F.struct(order.alias("source"), F.col("rank").alias("rank"))).alias("_seen"))
    score = F.lit(0.0)
    for n in range(len(weights)):  # added in a fixed order, so that equal inputs give equal sums
        score = score + F.coalesce(f"_{n}", F.lit(0.0))
    w = Window.partitionBy(*by).orderBy(F.desc("score"), "_seen", "chunk_id")
    return fused.withColumn("score", score).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_k).select(*by, "rank", "chunk_id", "score")


def rrf_sweep(hits: DataFrame, settings: list[tuple[str, dict[str, float]]], k: int = 60, top_k: int = 10) -> DataFrame:
    """rrf for each named setting of weights over the same hits (settings are a short list of parameters)."""
    rows = [(name, s, float(w), n) for name, weights in settings for n, (s, w) in enumerate(weights.items(), 1)]
    table = hits.sparkSession.createDataFrame(rows, "setting string, source string, weight double, place int")
    scored = hits.where("chunk_id is not null").join(F.broadcast(table), "source").withColumn("_part", F.col("weight") / (k + F.col("rank")))
    fused = scored.groupBy("setting", "query_id", "chunk_id").agg(F.array_sort(F.collect_list(F.struct("place", "rank", "_part"))).alias("_parts"))
    score = F.aggregate("_parts", F.lit(0.0), lambda s, x: s + x["_part"])
    w = Window.partitionBy("setting", "query_id").orderBy(F.desc("score"), F.col("_first.place"), F.col("_first.rank"), "chunk_id")
    return fused.withColumn("score", score).withColumn("_first", F.element_at("_parts", 1)).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_k).select("setting", "query_id", "rank", "chunk_id", "score")


def merge_sources(local: DataFrame, web: DataFrame) -> DataFrame:
    """Candidates of local(query_id, chunk_id, title, content) and web(query_id, url, title, content, snippet), tagged; empty content is left out."""
    text = lambda c: F.nullif(F.trim(c), F.lit(""))
    a = local.select("query_id", F.lit("local").alias("source"), F.col("chunk_id").cast("string").alias("chunk_id"), F.lit(None).cast("string").alias("url"), "title", text("content").alias("content"))
    b = web.select("query_id", F.lit("web").alias("source"), F.lit(None).cast("string").alias("chunk_id"), "url", "title", F.coalesce(text("content"), text("snippet")).alias("content"))
    return a.unionByName(b).where("content is not null")


def rerank(candidates: DataFrame, scorer) -> DataFrame:
    """Candidates (query_id, query, content, ...) ranked by a model's score of (query, content)."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "source", "chunk_id", "url")
    return score_pairs(candidates, scorer).withColumn("rank", F.row_number().over(w))


def cliff_cutoff(ranked: DataFrame, min_k: int = 3, max_k: int = 10, gap_abs: float = 0.5, gap_ratio: float = 0.25, by: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """Ranked rows up to the first gap to the next score, looked for from rank min_k, that is wide in absolute or relative terms; at most max_k."""
    w = Window.partitionBy(*by).orderBy("rank")
    rows = ranked.where(F.col("rank") <= max_k).withColumn("_next", F.lead("score").over(w))
    gap = F.col("score") - F.col("_next")
    wide = (F.col("rank") >= min_k) & ((gap >= gap_abs) | (gap / (F.abs("score") + 1e-6) >= gap_ratio))
    rows = rows.withColumn("_cut", F.min(F.when(wide, F.col("rank"))).over(Window.partitionBy(*by)))
    return rows.where(F.col("_cut").isNull() | (F.col("rank") <= F.col("_cut"))).drop("_next", "_cut")


def union_candidates(hits: DataFrame, sources: list[str]) -> DataFrame:
    """query_id, rank, chunk_id: each chunk once, in order of the listed sources and ranks."""
    place = F.array_position(F.array(*map(F.lit, sources)), F.col("source"))
    first = hits.where(F.col("source").isin(*sources) & F.col("chunk_id").isNotNull()).groupBy("query_id", "chunk_id").agg(F.min(F.struct(place.alias("p"), F.col("rank").alias("r"))).alias("_at"))
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("_at", "chunk_id"))).select("query_id", "rank", "chunk_id")


def ablation_runs(hits: DataFrame, scores: DataFrame, k: int = 5) -> DataFrame:
    """mode, query_id, rank, chunk_id of modes A to G from one retrieval.

    hits has the sources 'dense', 'vector' (hybrid), 'hyde', 'graph'; scores(query_id, chunk_id, score) are the reranker's;
    candidates that it did not score come last.
    """
    mode = lambda name, df: df.where(F.col("rank") <= k).select(F.lit(name).alias("mode"), "query_id", "rank", "chunk_id")
    two = rrf(hits.where("source in ('vector', 'hyde')"))
    full = rrf(hits)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    ranked = full.drop("score", "rank").join(scores, ["query_id", "chunk_id"], "left").withColumn("rank", F.row_number().over(w))
    cut = cliff_cutoff(ranked)
    out = mode("A", hits.where("source = 'dense'")).unionByName(mode("B", hits.where("source = 'vector'"))).unionByName(mode("C", two)).unionByName(mode("D", full))
    return out.unionByName(mode("E", cut)).unionByName(mode("F", ranked)).unionByName(mode("G", cut))
