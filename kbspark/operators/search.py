"""Dense, sparse and hybrid retrieval for many queries at once.

Chunks carry item_name; a query searches the items it lists. Hits: query_id, rank, chunk_id, score.
Ties in score go to the smaller chunk_id.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kbspark.operators import impact
from kbspark.sources.shared import keep

GROUP_ROWS = 4096  #: chunks of one item in one block of the blocked search
STRIPE = 256  #: queries of a block whose scores are in memory at once


def split_valid(chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, rest): chunks with both vectors."""
    fine = F.col("dense").isNotNull() & F.col("sparse").isNotNull()
    return chunks.where(fine), chunks.where(~fine)


def vector_stats(chunks: DataFrame, inserted: int | None = None) -> DataFrame:
    """One row: how many chunks have which vectors, and the shares."""
    dense, sparse = F.col("dense").isNotNull(), F.col("sparse").isNotNull()
    out = chunks.agg(F.count("*").alias("total"), F.count_if(dense).alias("dense"), F.count_if(sparse).alias("sparse"), F.count_if(dense & sparse).alias("valid"))
    share = lambda c: F.when(F.col("total") > 0, F.round(F.col(c) / F.col("total"), 6)).otherwise(0.0).alias(f"{c}_ratio")
    return out.select("*", F.coalesce(F.lit(inserted).cast("long"), F.col("valid")).alias("inserted"), *map(share, ("dense", "sparse", "valid")))


def to_postings(rows: DataFrame, key: str = "chunk_id") -> DataFrame:
    """key, token, weight from a sparse map column."""
    keep = [c for c in rows.columns if c not in ("sparse", "dense")]
    return rows.select(*keep, F.explode("sparse").alias("token", "weight"))


def from_postings(postings: DataFrame, key: str = "chunk_id") -> DataFrame:
    return postings.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("token", "weight")))).alias("sparse"))


def restrict_items(chunks: DataFrame, query_items: DataFrame) -> DataFrame:
    """chunks beside each query(query_id, item_name) that may see them."""
    return chunks.join(query_items.select("query_id", "item_name").distinct(), "item_name")


def top_k(scored: DataFrame, k: int, by: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """The k best rows of each query, ranked from 1."""
    w = Window.partitionBy(*by).orderBy(F.desc("score"), "chunk_id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a, b) -> Column:
    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(n > 0, dot(a, b) / n).otherwise(0.0)


def dense_topk(queries: DataFrame, chunks: DataFrame, k: int = 5, digits: int | None = None) -> DataFrame:
    """Exact cosine search of queries(query_id, item_name, dense) over chunks(chunk_id, item_name, dense).

    Block products find each query's k best and all that come within their rounding error; `cosine` then scores and ranks these. Of equal
    vectors in one item the k smallest chunk_ids are looked at, since they score the same.
    """
    same = Window.partitionBy("item_name", "dense").orderBy("chunk_id")
    first = chunks.select("chunk_id", "item_name", "dense").withColumn("_n", F.row_number().over(same)).where(F.col("_n") <= k).drop("_n")
    first, asked = keep(first, "chunks"), keep(queries.select("query_id", "item_name", "dense"), "asked")
    whole = lambda t: t.withColumn("dense", F.when(~F.exists("dense", F.isnull), F.col("dense")))
    near = _near(whole(asked), whole(first), k, digits, True).select("query_id", "item_name", "chunk_id").distinct()
    pairs = near.join(first.withColumnRenamed("dense", "_c"), ["item_name", "chunk_id"]).join(asked.withColumnRenamed("dense", "_q"), ["item_name", "query_id"])
    score = cosine("_q", "_c")
    return top_k(pairs.select("query_id", "chunk_id", (F.round(score, digits) if digits else score).alias("score")), k).select("query_id", "rank", "chunk_id", "score")


def dense_topk_blocked(queries: DataFrame, chunks: DataFrame, k: int = 5, digits: int | None = None) -> DataFrame:
    """The same by block products alone: an item's chunks lie in salted blocks of bounded size, its queries go to each block, and each block keeps k."""
    return top_k(_near(queries, chunks, k, digits, False), k).select("query_id", "rank", "chunk_id", "score")


def _near(queries: DataFrame, chunks: DataFrame, k: int, digits: int | None, ties: bool) -> DataFrame:
    """query_id, item_name, chunk_id, score: each block's k best of each query; with `ties` also those that score as the k-th but for rounding."""
    kinds = dict(chunks.dtypes)["chunk_id"], dict(queries.dtypes)["query_id"]
    number = kinds[0] in ("tinyint", "smallint", "int", "bigint")
    sizes = chunks.groupBy("item_name").agg(F.ceil(F.count("*") / GROUP_ROWS).cast("int").alias("_n"))
    asked = queries.groupBy("item_name").agg(F.ceil(F.count("*") / GROUP_ROWS).cast("int").alias("_m"))
    dealt = sizes.join(asked, "item_name")
    c = chunks.select(F.col("chunk_id").cast("string").alias("id"), "item_name", "dense").join(dealt, "item_name").select("id", "item_name", "dense", F.pmod(F.xxhash64("id"), F.col("_n")).cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("_m") - 1)).alias("j"), F.lit(False).alias("asks"))
    q = queries.select(F.col("query_id").cast("string").alias("id"), "item_name", "dense").join(dealt, "item_name").select("id", "item_name", "dense", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("i"), F.pmod(F.xxhash64("id"), F.col("_m")).cast("int").alias("j"), F.lit(True).alias("asks"))
    margin = (1.01 * 10.0**-digits if digits else 0.0) + 1e-9

    def block(key, g):
        import pandas as pd

        x, y = g[~g["asks"]], g[g["asks"]]
        out = pd.DataFrame({"query_id": [], "item_name": [], "chunk_id": [], "score": []}).astype({"query_id": str, "chunk_id": str, "score": float})
        if not len(x) or not len(y):
            return out

        def unit(vectors, width):  # vectors that are null or of another width score 0
            m = np.stack([v if v is not None and len(v) == width else np.zeros(width) for v in vectors]).astype(float)
            norm = np.sqrt((m * m).sum(axis=1))[:, None]
            return np.divide(m, norm, out=np.zeros_like(m), where=norm != 0)

        y = y.assign(width=[0 if v is None else len(v) for v in y["dense"]]).sort_values("width")
        ids, rows, made = (x["id"].map(int) if number else x["id"]).to_numpy(), [], (-1, None)  # ties go by the ids' own order
        for at in (n for _, w in y.reset_index(drop=True).groupby("width") for n in range(w.index[0], w.index[-1] + 1, STRIPE)):
            width = y["width"].iloc[at]
            part = y.iloc[at : at + STRIPE]
            part = part[part["width"] == width]
            if made[0] != width:
                made = width, unit(x["dense"], width).T
            own = unit(part["dense"], width)
            s = own @ made[1]
            s[np.isnan(s)] = np.inf  # Spark's order has them first
            if digits and not ties:
                s = np.round(s, digits)
            # The k-th best by partition; what reaches it is few, or equal to it.
            least = np.partition(s, -k, axis=1)[:, -k] if s.shape[1] > k else np.full(len(s), -np.inf)
            for query, u, line, low in zip(part["id"], own, s, least, strict=True):
                found = np.flatnonzero(line >= (low - margin if ties else low))
                cut = sorted(zip(-line[found], ids[found], strict=True))
                rows += [(query, key[0], str(i), -v) for v, i in (cut if ties and u.any() else cut[:k])]
        return pd.DataFrame(rows, columns=out.columns)

    found = c.unionByName(q).groupBy("item_name", "i", "j").applyInPandas(block, f"query_id string, item_name {dict(chunks.dtypes)['item_name']}, chunk_id string, score double")
    return found.select(F.col("query_id").cast(kinds[1]).alias("query_id"), "item_name", F.col("chunk_id").cast(kinds[0]).alias("chunk_id"), "score")


def sparse_topk(query_postings: DataFrame, chunk_postings: DataFrame, k: int = 5, by_item: bool = True) -> DataFrame:
    """Exact inner products over shared tokens of (query_id[, item_name], token, weight) and (chunk_id[, item_name], token, weight).

    Pruned by impact levels (see impact.py), over the postings of the questions' tokens. For many batches of questions
    over the same chunks, make one impact_index and search it.
    """
    keys = ["item_name", "token"] if by_item else ["token"]
    asked = keep(query_postings, "asked")
    mine = chunk_postings.join(impact.sent(asked.select(*keys).distinct(), asked.count()), keys, "left_semi")
    return impact.search(asked, impact.impact_index(keep(mine, "postings"), by_item, write=False), k)


def scale_cosine(s) -> Column:
    return (F.lit(1.0) + F.col(s)) / 2


def scale_product(s) -> Column:
    return F.lit(0.5) + F.atan(F.col(s)) / F.lit(float(np.pi))


def hybrid_topk(dense: DataFrame, sparse: DataFrame, weights: tuple[float, float] = (0.5, 0.5), norm: bool = True, k: int = 5) -> DataFrame:
    """Weighted sum of both sides' scores, each scaled to [0, 1] if `norm`; a side without the chunk adds 0."""
    d = dense.select("query_id", "chunk_id", (scale_cosine("score") if norm else F.col("score").cast("double")).alias("_d"))
    s = sparse.select("query_id", "chunk_id", (scale_product("score") if norm else F.col("score").cast("double")).alias("_s"))
    both = d.join(s, ["query_id", "chunk_id"], "full_outer")
    score = F.coalesce("_d", F.lit(0.0)) * weights[0] + F.coalesce("_s", F.lit(0.0)) * weights[1]
    return top_k(both.select("query_id", "chunk_id", score.alias("score")), k).select("query_id", "rank", "chunk_id", "score")


def hyde_topk(queries: DataFrame, hypothetical: DataFrame, chunks: DataFrame, encoder, k: int = 5) -> DataFrame:
    """Dense search by the vector of query and hypothetical answer; queries without an answer give no rows."""
    from kbspark.functions.text import embedding_text
    from kbspark.operators.models import encode

    texts = queries.select("query_id", "item_name", "query").join(hypothetical.where("trim(document) <> ''").select("query_id", "document"), "query_id")
    vectors = encode(texts.withColumn("text", embedding_text("query", "document")), "text", encoder)
    return dense_topk(vectors.where("dense is not null").select("query_id", "item_name", "dense"), chunks, k)
