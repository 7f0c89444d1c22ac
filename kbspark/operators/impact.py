"""Exact top-k inner products over postings in impact levels, without joining questions and chunks on all shared tokens.

A token's postings are grouped by impact level (quarter octaves of the absolute weight); a directory has each level's
number of postings and largest weight. Reading a token's levels from the top lowers what a chunk that has not been seen
can still score. For each question the levels of all its tokens are put in one order, by how much a level lowers that
bound for each posting read. A first few levels give some chunks, whose full scores give a threshold that the k-th score reaches at
least; then levels are read until no unseen chunk can reach it, seen chunks whose own bound stays below it go. Of the rest, those with
the largest bounds are scored in full for a second, closer threshold, and only what still can be among the k best is scored in full.
Where all weights are whole numbers, sums are exact, and a chunk that at best ties with the k-th and comes after it goes too. Common tokens with small weights are thus never read unless they can matter, and however
long a token's list is, its rows are met by (token, level), never by token alone.

Bounds take absolute weights, so any weights are right. Where fewer than k chunks are found, or the k-th score is not
positive, every level is read. Chunks that share a token rank even with score 0. Rows with a null in a key, id or weight take no part.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kbspark.sources.shared import keep

SENT_ROWS = 200_000  #: rows of a few keys and numbers that are sent to the executors (all pass through the driver); more are joined by a shuffle
FIRST = 32  #: postings for each of the k chunks sought that are read before there is a threshold
SLACK = 1e-9  #: for sums of doubles in another order


class Index(NamedTuple):
    postings: DataFrame  #: keys, chunk_id, weight, level
    levels: DataFrame  #: keys, level, n, top
    keys: list[str]


def sent(df: DataFrame, most: int | None = None) -> DataFrame:
    """df to be sent to the executors if its rows (counted, or `most` where a bound is known) are few enough."""
    return F.broadcast(df) if (df.count() if most is None else most) <= SENT_ROWS else df


def impact_index(chunk_postings: DataFrame, by_item: bool = True, write: bool = True) -> Index:
    """The index of (chunk_id[, item_name], token, weight); written to the shared folder, it serves any number of searches.

    With write=False it is worked out anew in each search (for one search over postings that are a table already).
    """
    keys = ["item_name", "token"] if by_item else ["token"]
    size = F.abs(F.col("weight").cast("double"))
    level = F.when(size > 0, F.floor(4 * F.log2(size))).otherwise(-(1 << 20)).cast("int")
    put = keep if write else lambda df, _: df
    postings = put(chunk_postings.select(*keys, "chunk_id", "weight", level.alias("level")).dropna(), "postings")
    levels = postings.groupBy(*keys, "level").agg(F.count("*").alias("n"), F.max(F.abs(F.col("weight").cast("double"))).alias("top"))
    return Index(postings, put(levels, "levels"), keys)


def _scores(wanted: DataFrame, index: Index) -> DataFrame:
    """Full scores of pairs, given as wanted(query_id, chunk_id, keys, _q): a row for each token of the question."""
    met = index.postings.join(wanted, [*index.keys, "chunk_id"])
    return met.groupBy("query_id", "chunk_id").agg(F.sum(F.col("_q") * F.col("weight")).alias("score"))


def _best(scored: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def search(query_postings: DataFrame, index: Index, k: int = 5) -> DataFrame:
    """query_id, rank, chunk_id, score: the k chunks of the largest inner product for each question; ties to the smaller chunk_id.

    query_postings is read several times: give a table.
    """
    return _best(_scores(sent(candidates(query_postings, index, k)), index), k).select("query_id", "rank", "chunk_id", "score")


def candidates(query_postings: DataFrame, index: Index, k: int = 5) -> DataFrame:
    """query_id, chunk_id, keys, _q: every chunk that may be among the k best (of weights that are no whole numbers: or equal to the k-th but for rounding), with all terms of its question."""
    whole_numbers = all(isinstance(df.schema["weight"].dataType, T.IntegralType) for df in (query_postings, index.postings))
    keys, group = index.keys, ["query_id", *index.keys[:-1]]  # a chunk has one item, so bounds are kept for each item of a question
    terms = query_postings.select("query_id", *keys, F.col("weight").alias("_q")).dropna()
    n_terms = terms.count()
    mine, whole = Window.partitionBy("query_id", *keys).orderBy(F.desc("level")), Window.partitionBy(*group)
    ordered = whole.orderBy(F.desc("gain"), "token", F.desc("level")).rowsBetween(Window.unboundedPreceding, -1)
    bound = F.abs(F.col("_q").cast("double")) * F.col("top")
    steps = index.levels.join(sent(terms, n_terms), keys).withColumn("bound", bound)
    steps = steps.withColumn("lowers", F.col("bound") - F.coalesce(F.lead("bound").over(mine), F.lit(0.0)))
    # A level comes after those above it, so its gain counts as theirs at most.
    steps = steps.withColumn("gain", F.min(F.col("lowers") / F.col("n")).over(mine))
    before = lambda c: F.coalesce(F.sum(c).over(ordered), F.lit(0).cast("double"))
    steps = steps.withColumn("left", F.sum("lowers").over(whole) - before("lowers")).withColumn("read", before("n"))
    steps = keep(steps.select("query_id", *keys, "_q", "level", "bound", "left", "read"), "steps")

    first = steps.where(F.col("read") < FIRST * k).select("query_id", *keys, "_q", "level")
    met = index.postings.join(sent(first), [*keys, "level"]).groupBy("query_id", "chunk_id").agg(F.sum(F.col("_q") * F.col("weight")).alias("score"))
    seeds = _scores(sent(_best(met, 2 * k).select("query_id", "chunk_id").join(sent(terms, n_terms), "query_id"), 2 * k * n_terms), index)
    least = _best(seeds, k).where(F.col("rank") == k).select("query_id", F.col("score").cast("double").alias("least"))
    least = least.withColumn("least", F.when(F.col("least") > 0, F.col("least") * (1 - SLACK)))

    needed = F.col("least").isNull() | (F.col("left") * (1 + SLACK) >= F.col("least"))
    chosen = steps.join(sent(least, n_terms), "query_id", "left").withColumn("needed", needed)
    chosen = chosen.withColumn("unread", F.coalesce(F.max(F.when(~F.col("needed"), F.col("bound"))).over(Window.partitionBy("query_id", *keys)), F.lit(0.0)))
    rest = chosen.groupBy(*group, "token").agg(F.max("unread").alias("unread")).groupBy(*group).agg(F.sum("unread").alias("rest"))
    chosen = keep(chosen.where("needed").join(rest, group).select("query_id", *keys, "_q", "level", "unread", "rest", "least"), "chosen")
    # A chunk's bound: what it was seen to score, and the unread rest of the tokens in which it was not seen.
    over = F.sum((F.col("_q") * F.col("weight")).cast("double") - F.col("unread")) + F.first("rest")
    seen = index.postings.join(sent(chosen), [*keys, "level"]).groupBy("query_id", "chunk_id").agg(over.alias("most"), F.first("least").alias("least"))
    able = keep(seen.where(F.col("least").isNull() | (F.col("most") * (1 + SLACK) + SLACK >= F.col("least"))).select("query_id", "chunk_id", "most"), "able")
    likely = _best(able.withColumnRenamed("most", "score"), 2 * k).select("query_id", "chunk_id")
    close = _best(_scores(sent(likely.join(sent(terms, n_terms), "query_id"), 2 * k * n_terms), index), k).where(F.col("rank") == k)
    close = close.select("query_id", F.col("score").cast("double").alias("kth"), F.col("chunk_id").alias("at"))
    if whole_numbers:
        may = (F.col("most") > F.col("kth")) | ((F.col("most") == F.col("kth")) & (F.col("chunk_id") <= F.col("at")))
    else:
        may = F.col("most") + SLACK * F.abs("most") + SLACK >= F.col("kth") - SLACK * F.abs("kth")
    able = able.join(sent(close, n_terms), "query_id", "left").where(F.col("kth").isNull() | may).select("query_id", "chunk_id")
    return keep(able.join(sent(terms, n_terms), "query_id"), "wanted")
