"""Retrieval quality: recall, reciprocal rank, summaries, mode comparison, pool diagnostics.

runs: mode, question_id, rank, chunk_id. gold: question_id, gold_chunk_ids (array of strings) [, category].
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _gold_ids(gold: DataFrame) -> DataFrame:
    return gold.select("question_id", F.explode(F.array_distinct("gold_chunk_ids")).alias("chunk_id"))


def _questions(runs: DataFrame, gold: DataFrame, modes: DataFrame | None) -> DataFrame:
    """Each mode beside each gold question (modes are the few names of retrieval settings)."""
    modes = runs.select("mode").distinct() if modes is None else modes
    named = modes.agg(F.collect_set("mode").alias("_modes"))
    return gold.withColumn("_k", F.lit(1)).join(F.broadcast(named.withColumn("_k", F.lit(1))), "_k").select(F.explode("_modes").alias("mode"), *gold.columns)


def question_scores(runs: DataFrame, gold: DataFrame, ks: tuple[int, ...] = (1, 3, 5), rr_at: int = 5) -> DataFrame:
    """mode, gold columns, recall_at_k, rr of every gold question in every mode; unanswered questions score 0."""
    hits = runs.join(_gold_ids(gold), ["question_id", "chunk_id"])
    found = hits.groupBy("mode", "question_id").agg(
        *[F.countDistinct(F.when(F.col("rank") <= k, F.col("chunk_id"))).alias(f"_{k}") for k in ks], F.min(F.when(F.col("rank") <= rr_at, F.col("rank"))).alias("_first")
    )
    size = F.size(F.array_distinct("gold_chunk_ids"))
    rows = _questions(runs, gold, None).join(found, ["mode", "question_id"], "left")
    recall = [F.when((size > 0) & (k > 0), F.coalesce(F.col(f"_{k}"), F.lit(0)) / size).otherwise(0.0).alias(f"recall_at_{k}") for k in ks]
    return rows.select("mode", *[c for c in gold.columns if c != "gold_chunk_ids"], *recall, F.coalesce(F.lit(1.0) / F.col("_first"), F.lit(0.0)).alias("rr"))


def recall_at_k(runs: DataFrame, gold: DataFrame, ks: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    return question_scores(runs, gold, ks).drop("rr")


def reciprocal_rank(runs: DataFrame, gold: DataFrame, k: int = 5) -> DataFrame:
    return question_scores(runs, gold, (), k)


def summarize(scores: DataFrame, by: tuple[str, ...] = ("mode",), digits: int = 6) -> DataFrame:
    """Number of questions and mean of each measure by the given columns."""
    measures = [c for c in scores.columns if c.startswith("recall_at_") or c == "rr"]
    return scores.groupBy(*by).agg(F.count("*").alias("questions"), *[F.round(F.avg(c), digits).alias("mrr" if c == "rr" else c) for c in measures])


def ordered_ids(runs: DataFrame, by: tuple[str, ...] = ("mode", "question_id")) -> DataFrame:
    ids = F.transform(F.array_sort(F.collect_list(F.struct("rank", "chunk_id"))), lambda x: x["chunk_id"].cast("string"))
    return runs.groupBy(*by).agg(ids.alias("ids"))


def compare_modes(runs: DataFrame) -> DataFrame:
    """mode_a, mode_b, different, identical: in how many questions two modes' ordered lists differ."""
    lists = ordered_ids(runs)
    by_question = lists.groupBy("question_id").agg(F.map_from_entries(F.collect_list(F.struct("mode", "ids"))).alias("m"))
    modes = runs.agg(F.array_sort(F.collect_set("mode")).alias("_modes"))  # the few names of retrieval settings
    rows = by_question.withColumn("_k", F.lit(1)).join(F.broadcast(modes.withColumn("_k", F.lit(1))), "_k").select("m", "_modes", F.explode("_modes").alias("mode_a")).select("m", "mode_a", F.explode("_modes").alias("mode_b")).where("mode_a < mode_b")
    empty = F.array().cast("array<string>")
    differs = F.coalesce(F.col("m")[F.col("mode_a")], empty) != F.coalesce(F.col("m")[F.col("mode_b")], empty)
    return rows.groupBy("mode_a", "mode_b").agg(F.count_if(differs).alias("different")).withColumn("identical", F.col("different") == 0)


def sequence_digest(runs: DataFrame, questions: DataFrame, bits: int = 10) -> DataFrame:
    """mode, digest: equal for equal lists of all questions in the same order; questions(question_id, pos) gives the order.

    A tree over the positions: a leaf is the SHA-256 of the compact JSON [question_id, [ids]]; a node is that of its
    children's places and hashes in order, at most 2^bits of them, up to one node for each mode. A question without rows
    in a mode is a missing leaf. No group ever holds more than a node's children, and an exchange of two questions changes the hashes above them.
    """
    text = F.concat(F.lit('["'), F.col("question_id").cast("string"), F.lit('",'), F.to_json("ids"), F.lit("]"))
    nodes = ordered_ids(runs).join(questions.select("question_id", F.col("pos").cast("long").alias("pos")), "question_id").select("mode", "pos", F.sha2(text, 256).alias("x"))
    most = questions.agg(F.max("pos")).first()[0] or 0
    while True:
        child = F.struct(F.col("pos").bitwiseAND(F.lit((1 << bits) - 1)).alias("pos"), "x")
        line = F.array_join(F.transform(F.array_sort(F.collect_list(child)), lambda c: F.concat_ws(":", c["pos"].cast("string"), c["x"])), ",")
        nodes = nodes.groupBy("mode", F.shiftright("pos", bits).alias("pos")).agg(F.sha2(line, 256).alias("x"))
        most >>= bits
        if not most:
            return nodes.select("mode", F.col("x").alias("digest"))


def pool_diagnostics(stage_hits: DataFrame, gold: DataFrame, base: str, more: list[str]) -> DataFrame:
    """added, recall, questions_with_new_gold: unordered recall as sources join the pool one after another."""
    stages = [base, *more]
    pools = stage_hits.groupBy("question_id").agg(*[F.collect_set(F.when(F.col("stage") == s, F.col("chunk_id").cast("string"))).alias(f"_{n}") for n, s in enumerate(stages)])
    rows = gold.select("question_id", F.array_distinct("gold_chunk_ids").alias("g")).join(pools, "question_id", "left")
    empty = F.array().cast("array<string>")
    pool, parts = empty, []
    for n, s in enumerate(stages):
        own = F.coalesce(F.col(f"_{n}"), empty)
        new = F.size(F.array_except(F.array_intersect("g", own), pool)) > 0
        pool = F.array_union(pool, own)
        parts.append(F.struct(F.lit(n).alias("n"), F.lit(s).alias("added"), (F.size(F.array_intersect("g", pool)) / F.size("g")).alias("recall"), new.alias("new")))
    flat = rows.select(F.inline(F.array(*parts)))
    return flat.groupBy("n", "added").agg(F.round(F.avg("recall"), 6).alias("recall"), F.count_if("new").alias("questions_with_new_gold")).select("added", "recall", "questions_with_new_gold")


def check_equal(lists: DataFrame, a: str, b: str) -> DataFrame:
    """ok, failed: whether two modes' lists agree in every question."""
    return _check(lists, a, b, lambda x, y: x == y)


def check_prefix(lists: DataFrame, a: str, b: str) -> DataFrame:
    """ok, failed: whether mode b's list is a prefix of mode a's in every question."""
    return _check(lists, a, b, lambda x, y: F.when(F.size(y) == 0, True).otherwise(F.slice(x, 1, F.size(y)) == y))


def _check(runs: DataFrame, a: str, b: str, test) -> DataFrame:
    lists = ordered_ids(runs.where(F.col("mode").isin(a, b)))
    empty = F.array().cast("array<string>")
    rows = lists.groupBy("question_id").agg(F.max(F.when(F.col("mode") == a, F.col("ids"))).alias("x"), F.max(F.when(F.col("mode") == b, F.col("ids"))).alias("y"))
    ok = test(F.coalesce("x", empty), F.coalesce("y", empty))
    return rows.agg(F.coalesce(F.bool_and(ok), F.lit(True)).alias("ok"), F.count_if(~ok).alias("failed"))


def build_stats(results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(stats, errors) of results(chunk_id, entities, relations, error): one row of total, processed, failed and sums, and the build_errors of all that failed."""
    bad = F.col("error").isNotNull()
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("entities", "relations")]
    return results.agg(F.count("*").alias("total"), F.count_if(~bad).alias("processed"), F.count_if(bad).alias("failed"), *sums), build_errors(results)


def build_errors(results: DataFrame) -> DataFrame:
    """chunk_id, error of what failed (a table, since it grows with the build)."""
    return results.where("error is not null").select("chunk_id", "error")


def confirm_rate(runs: DataFrame) -> DataFrame:
    """Share of rows(confirmed boolean) whose item was confirmed; 0 without rows."""
    return runs.agg(F.coalesce(F.round(F.avg(F.col("confirmed").cast("double")), 6), F.lit(0.0)).alias("confirm_rate"), F.count("*").alias("questions"))
