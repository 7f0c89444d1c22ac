"""Mixing sources to target weights: how many copies of each document a mix takes.

Entropy balancing: of all document rates that give every source its target number of words (and no rate above `most`),
those nearest to 1 in relative entropy are exp(lambda * size) up to the bound, with one multiplier for each source. The
multipliers solve the convex dual. Documents of one source and size share a rate, so the dual is evaluated on cells (source,
size, number of documents) that are summed before they are shuffled; Newton steps on the logarithm of the words taken run for all
sources at once, inside a bracket that halves where a step leaves it. Sums are decimals, so their order cannot change a result.

Rates become copies in three exact steps: the running sum of a source's expected copies from long to short documents
is rounded (so near sizes make up for each other), what is left to the target is made up by whole documents from the
longest that fits downwards, and a cell's copies are dealt to its documents in the order of a hash of doc_id. All of it is built-in
expressions. A cell that holds most of the rows is dealt in parts by hash; a source's cells are as many as it has
distinct sizes, however many rows it has.

Cases: null text has size 0; a null source is a source of its own, after all others; texts without words and sources
without words take nothing; equal rows share a cell and may get different copies; a null doc_id counts as an id
without digits; a text of any length is one word count; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kbspark.llm.common import Steps, cut, table, total

UNIT = 1_000_000_000  #: rates are kept as whole billionths
PART_ROWS = 1 << 20  #: documents that are ordered together
SMALL = 100_000  #: sources (a few numbers each) that are sent to the executors instead of shuffled


def word_count(text: str = "text") -> F.Column:
    """The number of `[^\\x20\\x09-\\x0D]+` in a text, without an array of them."""
    blank = r"\x20\x09-\x0D"
    return F.coalesce(F.length(F.regexp_replace(F.rtrim(F.col(text), F.lit(" \t\n\x0b\f\r")), f"[{blank}]*+[^{blank}]++", "x")), F.lit(0)).cast("long")


def ranked(sources: DataFrame, steps: Steps) -> DataFrame:
    """sources with rank, from 0 in the order of key: sorted by ranges, each range numbered by itself after those before it."""
    sorted_ = steps.cut(sources.repartitionByRange("key").withColumn("p", F.spark_partition_id()), "sources")
    before = Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    offsets = sorted_.groupBy("p").agg(F.count("*").alias("n")).select("p", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = F.row_number().over(Window.partitionBy("p").orderBy("key"))
    return sorted_.join(F.broadcast(offsets), "p").withColumn("rank", F.col("offset") + inside - 1).drop("p", "offset")


def targets(sources: DataFrame, most: int) -> DataFrame:
    """sources(source_size, weight) with target: shares of all words by weight, none above most times its own words.

    The words by a unit of weight rise until no source is above its bound.
    """
    above = lambda level: F.lit(level) * F.col("weight") > most * F.col("source_size")
    level, stopped = 0.0, -1
    words, weights = sources.agg(F.sum("source_size"), F.sum("weight")).first()
    if words:
        level = words / weights
        while True:
            n, full, rest = sources.agg(F.count_if(above(level)), F.coalesce(F.sum(F.when(above(level), most * F.col("source_size"))), F.lit(0)), F.sum(F.when(~above(level), F.col("weight")))).first()
            if n == stopped:
                break
            level, stopped = (words - full) / rest, n
    return sources.withColumn("target", F.when(above(level), (most * F.col("source_size")).cast("double")).otherwise(F.lit(level) * F.col("weight")))


def multipliers(cells: DataFrame, sources: DataFrame, most: int, steps: Steps, rounds: int = 200) -> DataFrame:
    """key, lam for the sources(key, source_size, target) by Newton steps on the dual over cells(key, size, n)."""
    words = cells.where("size > 0").groupBy("key").agg(F.min("size").alias("least"))
    top = F.lit(math.log(most)) / F.col("least")
    full = F.col("target") >= most * F.col("source_size")
    lowest = F.least(F.lit(0.0), F.log(F.col("target") / F.col("source_size")) / F.col("least"))
    state = sources.join(words, "key").select("key", "target", lowest.alias("lo"), top.alias("hi"), F.when(full, top).otherwise(0.0).alias("lam"), full.alias("done"))
    state = steps.cut(state, "multipliers")
    small = state.count() <= SMALL
    for _ in range(rounds):
        if not state.where("not done").count():
            break
        old, tilt = state, F.exp(F.col("lam") * F.col("size"))
        each = cells.where("size > 0").join(F.broadcast(state) if small else state, "key").where("not done")
        exact = lambda x: F.sum(x.cast("decimal(38,10)")).cast("double")
        n_words = F.col("n") * F.col("size")
        each = each.groupBy("key", "target", "lo", "hi", "lam").agg(exact(n_words * F.least(F.lit(float(most)), tilt)).alias("taken"), exact(F.when(tilt < most, n_words * F.col("size") * tilt).otherwise(0.0)).alias("slope"))
        lo, hi = F.when(F.col("taken") < F.col("target"), F.col("lam")).otherwise(F.col("lo")), F.when(F.col("taken") > F.col("target"), F.col("lam")).otherwise(F.col("hi"))
        newton = F.when((F.col("taken") > 0) & (F.col("slope") > 0), F.col("lam") - F.log(F.col("taken") / F.col("target")) * F.col("taken") / F.col("slope"))
        near = (F.abs(F.col("taken") - F.col("target")) <= 1e-12 * F.col("target")) | (hi - lo <= 1e-15 * F.abs("lam"))
        step = F.when(near, F.col("lam")).when((newton > lo) & (newton < hi), newton).otherwise((lo + hi) / 2)
        state = steps.cut(each.select("key", "target", lo.alias("lo"), hi.alias("hi"), step.alias("lam"), near.alias("done")).unionByName(state.where("done")), "multipliers")
        steps.drop(old)
    return state.select("key", "lam")


def made_up(cells: DataFrame, sources: DataFrame, most: int, steps: Steps) -> DataFrame:
    """cells(key, size, n, copies) with the copies changed until no whole document brings a source nearer to its target."""
    gap = cells.groupBy("key").agg(F.sum(F.col("size") * F.col("copies")).alias("taken")).join(sources, "key")
    state = steps.cut(gap.select("key", (F.floor(F.col("target") + 0.5) - F.col("taken")).alias("gap"), F.lit((1 << 62)).alias("last")), "gaps")
    small, changes = state.count() <= SMALL, []
    while True:
        room = F.when(F.col("gap") > 0, most * F.col("n") - F.col("copies")).otherwise(F.col("copies"))
        fits = cells.join(F.broadcast(state) if small else state, "key").withColumn("room", room).where("size > 0 and size <= abs(gap) and size < last and room > 0")
        found = fits.groupBy("key", "gap").agg(F.max(F.struct("size", "room")).alias("x"))
        k = F.least(F.col("x.room"), F.expr("abs(gap) div x.size")) * F.signum("gap").cast("long")
        state = steps.cut(found.select("key", (F.col("gap") - k * F.col("x.size")).alias("gap"), F.col("x.size").alias("last"), k.alias("k")), "gaps")
        if not state.count():
            break
        changes.append(state.select("key", F.col("last").alias("size"), "k"))
    for change in changes:  # a cell is changed once at most, as sizes fall
        cells = cells.join(F.broadcast(change) if small else change, ["key", "size"], "left").withColumn("copies", F.col("copies") + F.coalesce("k", F.lit(0))).drop("k")
    return cells


def mix(docs: DataFrame, steps: Steps, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, part_rows: int = PART_ROWS) -> DataFrame:
    """docs(doc_id, text, source) as doc_id, source, size, source_size, target, copies, taken; one row for each.

    Sources in the order of their names weigh `weights` over and over; no document is taken more than `most` times.
    """
    key = F.coalesce(F.concat(F.lit("="), "source"), F.lit("~"))  # null after all names
    sizes = steps.cut(docs.select("doc_id", key.alias("key"), word_count().alias("size")), "sizes")
    parts = 1 << max(0, math.ceil(math.log2(max(1, sizes.count() / part_rows))))
    in_part = sizes.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(parts)))
    cell_parts = steps.cut(in_part.groupBy("key", "size", "part").agg(F.count("*").alias("n")), "cell-parts")
    cells = steps.cut(cell_parts.groupBy("key", "size").agg(F.sum("n").alias("n")), "cells")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    sources = ranked(cells.groupBy("key").agg(F.sum(F.col("n") * F.col("size")).alias("source_size")), steps)
    sources = steps.cut(targets(steps.cut(sources.withColumn("weight", weight), "weights"), most), "targets")
    lam = multipliers(cells, sources, most, steps)

    # Expected copies from long to short, in whole billionths; the rounded running sum gives each cell's copies.
    rate = F.round(F.least(F.lit(float(most)), F.exp(F.coalesce("lam", F.lit(0.0)) * F.col("size"))) * UNIT).cast("decimal(38,0)")
    down = Window.partitionBy("key").orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = cells.join(lam, "key", "left").withColumn("own", (F.col("n") * rate).cast("decimal(38,0)")).withColumn("sum", F.sum("own").over(down))
    rounded = run.select("key", "size", "n", F.expr(f"(sum + {UNIT // 2}) div {UNIT} - (sum - own + {UNIT // 2}) div {UNIT}").alias("copies"))
    final = made_up(steps.cut(rounded, "rounded"), sources, most, steps).select("key", "size", F.col("n").alias("of"), "copies")

    # The parts of a cell share its copies by the same rule, and so do the documents of a part in the order of a hash.
    along = Window.partitionBy("key", "size").orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    dealt = cell_parts.join(final, ["key", "size"]).withColumn("upto", F.sum("n").over(along).cast("decimal(38,0)"))
    dealt = dealt.select("key", "size", "part", "n", F.expr("(copies * upto) div of - (copies * (upto - n)) div of").alias("copies"))
    dealt = steps.cut(dealt.join(sources.select("key", "source_size", "target"), "key"), "dealt")
    place = F.row_number().over(Window.partitionBy("key", "size", "part").orderBy(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), "doc_id"))
    one = in_part.withColumn("place", place).join(dealt, ["key", "size", "part"])
    one = one.withColumn("copies", F.expr("copies div n") + F.when(F.col("place") <= F.col("copies") % F.col("n"), 1).otherwise(0))
    source = F.when(F.col("key").startswith("="), F.expr("substring(key, 2)"))
    return one.select("doc_id", source.alias("source"), "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def op11_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract op11: every document with its source's words and target and the words that the mix takes of it."""
    steps = Steps(spark)
    out = cut(mix(table(spark, sf_dir, "documents"), steps).select("doc_id", "size", "source_size", "target", "taken"), "mix")
    steps.done()
    return out


#: The same multipliers by halving, the same rounding.
SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce('=' || source, '~') AS key, CAST(len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS BIGINT) AS size FROM documents),
c AS (SELECT key, size, count(*) AS n FROM d GROUP BY ALL),
w AS (SELECT key, CAST(sum(n * size) AS BIGINT) AS source_size, 1 + (row_number() OVER (ORDER BY key) - 1) % 3 AS weight FROM c GROUP BY key),
lv AS (SELECT 0 AS i, CAST(sum(source_size) AS DOUBLE) / CAST(sum(weight) AS DOUBLE) AS level, -1 AS full_n FROM w
 UNION ALL SELECT i, level, full_n FROM (SELECT lv.i + 1 AS i, CAST(sum(source_size) - coalesce(sum(3 * source_size) FILTER (level * weight > 3 * source_size), 0) AS DOUBLE) / CAST(sum(weight) FILTER (level * weight <= 3 * source_size) AS DOUBLE) AS level,
  count(*) FILTER (level * weight > 3 * source_size) AS full_n, max(lv.full_n) AS was FROM lv, w GROUP BY lv.i) WHERE full_n <> was),
t AS (SELECT key, source_size, CASE WHEN level * weight > 3 * source_size THEN CAST(3 * source_size AS DOUBLE) ELSE level * weight END AS target FROM w, (SELECT arg_max(level, i) AS level FROM lv)),
p AS (SELECT key, min(size) AS least FROM c WHERE size > 0 GROUP BY key),
b AS (SELECT key, 0 AS i, least(0, ln(target / source_size) / least) AS lo, ln(3) / least AS hi, target FROM t JOIN p USING (key)
 UNION ALL SELECT b.key, b.i + 1, CASE WHEN sum(n * size * least(3, exp((lo + hi) / 2 * size))) < b.target THEN (lo + hi) / 2 ELSE lo END, CASE WHEN sum(n * size * least(3, exp((lo + hi) / 2 * size))) < b.target THEN hi ELSE (lo + hi) / 2 END, b.target
  FROM b JOIN c ON c.key = b.key AND c.size > 0 WHERE b.i < 120 GROUP BY b.key, b.i, lo, hi, b.target),
o AS (SELECT c.key, size, n, n * CAST(round(least(3, exp(coalesce(hi, 0) * size)) * 1000000000) AS HUGEINT) AS own FROM c LEFT JOIN (SELECT key, hi FROM b WHERE i = 120) USING (key)),
s AS (SELECT *, sum(own) OVER (PARTITION BY key ORDER BY size DESC) AS s FROM o),
r AS (SELECT key, size, n, CAST((s + 500000000) // 1000000000 - (s - own + 500000000) // 1000000000 AS BIGINT) AS copies FROM s),
g AS (SELECT key, 0 AS i, CAST(floor(max(target) + 0.5) - sum(size * copies) AS BIGINT) AS gap, CAST(4611686018427387904 AS BIGINT) AS last, CAST(0 AS BIGINT) AS k FROM r JOIN t USING (key) GROUP BY key
 UNION ALL SELECT key, i, gap - k * last, last, k FROM (SELECT key, i + 1 AS i, gap, x.size AS last, CAST(least(x.room, abs(gap) // x.size) * sign(gap) AS BIGINT) AS k FROM (
  SELECT g.key, g.i, g.gap, max({'size': r.size, 'room': CASE WHEN gap > 0 THEN 3 * n - copies ELSE copies END}) AS x FROM g JOIN r ON r.key = g.key AND r.size > 0 AND r.size <= abs(gap) AND r.size < last
  WHERE CASE WHEN gap > 0 THEN 3 * n - copies ELSE copies END > 0 GROUP BY g.key, g.i, g.gap))),
f AS (SELECT r.key, r.size, n, copies + coalesce(k, 0) AS copies FROM r LEFT JOIN g ON g.key = r.key AND g.last = r.size),
n AS (SELECT *, row_number() OVER (PARTITION BY key, size ORDER BY md5(coalesce(CAST(doc_id AS VARCHAR), '')), doc_id) AS place FROM d)
SELECT doc_id, n.size, source_size, target, n.size * (copies // f.n + CASE WHEN place <= copies % f.n THEN 1 ELSE 0 END) AS taken FROM n JOIN f ON f.key = n.key AND f.size = n.size JOIN t ON t.key = n.key"""
