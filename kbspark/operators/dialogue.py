"""Conversations: item confirmation, routing, history, prompt packing, clarification, cached answers.

matches: query_id, extracted_name, pos (of the name), item_name, score.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampNTZType, TimestampType

from kbspark.functions.text import NUMBERED, ORDINALS, canonical_key
from kbspark.sources.shared import keep

HIGH, MID = 0.7, 0.6
# What is said when a choice is open, cancelled or unclear, and when no item is known.
ASK_HEAD, ASK_TAIL = "我找到了多个可能的产品，请选择您具体指的是哪一个：\n\n", "\n\n请回复产品名称或序号，例如“1”或“2”。"
UNCLEAR = "我还无法确定您具体选择的是哪一个产品。\n\n"
CANCELLED = "已取消本次产品选择。您可以重新提出问题。"
REFUSED = "抱歉，我无法识别您询问的具体产品名称，请提供更准确的产品名称或型号。"
CANCEL_WORDS = ("取消", "算了", "不用了", "不问了")
ROLES = {"user": "用户", "assistant": "助手"}
TTL_SECONDS = 24 * 60 * 60


def classify_items(matches: DataFrame, high: float = HIGH, mid: float = MID, limit: int = 3) -> DataFrame:
    """query_id, confirmed, options (arrays) from the matches of each extracted name, in order of the names."""
    order = Window.partitionBy("query_id", "pos").orderBy(F.desc("score"), "item_name")
    rows = matches.withColumn("_n", F.row_number().over(order)).where((F.col("score") >= mid))
    name = Window.partitionBy("query_id", "pos")
    strong = F.col("score") >= high
    rows = rows.withColumn("_strong", F.count_if(strong).over(name)).withColumn("_exact", F.max(strong & (F.col("item_name") == F.col("extracted_name"))).over(name))
    top = strong & (F.col("_n") <= limit)
    rows = rows.withColumn("_keys", F.size(F.collect_set(F.when(top, canonical_key("item_name"))).over(name)))
    # per name: what it confirms, what it offers, and whether the offer is of middling scores
    sure = (
        F.when(F.col("_exact"), F.col("item_name") == F.col("extracted_name")).when(F.col("_strong") == 1, strong).when(F.col("_keys") == 1, top).otherwise(False)
    )
    offer = F.when(F.col("_exact") | (F.col("_strong") == 1), False).when(F.col("_strong") > 1, top & (F.col("_keys") > 1)).otherwise(True)
    listed = lambda test: F.transform(F.array_sort(F.collect_list(F.when(test, F.struct("_n", "item_name")))), lambda x: x["item_name"])
    names = rows.groupBy("query_id", "pos").agg(listed(sure & strong).alias("sure"), listed(offer).alias("offer"), F.max("_strong").alias("strong"))
    lists = names.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("pos", "sure", "offer", "strong"))).alias("names"))

    def step(s, n):
        confirmed = F.array_distinct(F.concat(s["confirmed"], n["sure"]))
        fresh = F.filter(F.array_distinct(n["offer"]), lambda x: ~F.array_contains(s["options"], x) & ~F.array_contains(confirmed, x))
        # middling names are sifted before the cut at `limit`, strong ones were cut before
        return F.struct(confirmed.alias("confirmed"), F.concat(s["options"], F.slice(fresh, 1, limit)).alias("options"))

    none = F.array().cast("array<string>")
    out = lists.select("query_id", F.aggregate("names", F.struct(none.alias("confirmed"), none.alias("options")), step).alias("r"))
    return out.select("query_id", "r.confirmed", F.slice("r.options", 1, limit).alias("options"))


def score_gap_filter(matches: DataFrame, confirmed: DataFrame, gap: float = 0.15) -> DataFrame:
    """query_id, item_name, score of confirmed(query_id, item_name) items whose best score is within `gap` of the query's best."""
    best = matches.join(confirmed.select("query_id", "item_name").distinct(), ["query_id", "item_name"]).groupBy("query_id", "item_name").agg(F.max("score").alias("score"))
    top = F.max("score").over(Window.partitionBy("query_id"))
    return best.withColumn("_top", top).where(F.col("_top") - F.col("score") <= gap).drop("_top")


def option_prompt(options) -> Column:
    lines = F.transform(options, lambda o, i: F.concat((i + 1).cast("string"), F.lit(". "), o))
    return F.concat(F.lit(ASK_HEAD), F.array_join(lines, "\n"), F.lit(ASK_TAIL))


def route(classified: DataFrame) -> DataFrame:
    """classified with route (search, ask, refuse) and answer (null when the search goes on)."""
    kind = F.when(F.size("confirmed") > 0, "search").when(F.size("options") > 0, "ask").otherwise("refuse")
    return classified.withColumn("route", kind).withColumn("answer", F.when(F.col("route") == "ask", option_prompt(F.col("options"))).when(F.col("route") == "refuse", F.lit(REFUSED)))


def recent_messages(messages: DataFrame, n: int = 10) -> DataFrame:
    """The n newest messages of each session, numbered old to new (place)."""
    newest = Window.partitionBy("session_id").orderBy(F.desc("ts"), F.desc("turn"))
    rows = messages.withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= n).drop("_n")
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("session_id").orderBy("ts", "turn")))


def history_text(recent: DataFrame) -> DataFrame:
    """session_id, history: 'role: text' lines, old to new."""
    line = F.struct("place", F.concat(F.col("role"), F.lit(": "), F.coalesce("text", F.lit("")), F.lit("\n")).alias("t"))
    return recent.groupBy("session_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["t"]), "").alias("history"))


def backfill_message_items(messages: DataFrame, confirmed: DataFrame, n: int = 10) -> DataFrame:
    """messages whose empty item_names, among the session's n newest, take confirmed(session_id, items)."""
    newest = Window.partitionBy("session_id").orderBy(F.desc("ts"), F.desc("turn"))
    rows = messages.withColumn("_n", F.row_number().over(newest)).join(confirmed.select("session_id", F.col("items").alias("_items")), "session_id", "left")
    empty = F.col("item_names").isNull() | (F.size("item_names") == 0)
    return rows.withColumn("item_names", F.when(empty & (F.col("_n") <= n) & F.col("_items").isNotNull(), F.col("_items")).otherwise(F.col("item_names"))).drop("_n", "_items")


def _fit(rows: DataFrame, cost: Column, budget: str | int, charge_last: bool) -> DataFrame:
    """query_id, text, left: lines joined until the first that overflows the budget; `charge_last` charges that one too."""
    w = Window.partitionBy("query_id").orderBy("place")
    limit = F.col(budget) if isinstance(budget, str) else F.lit(budget)
    used = F.sum("_cost").over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("_cost", cost).withColumn("_used", used)
    over = (F.col("_used") > limit) if charge_last else (F.col("_used") - F.col("_cost") + F.length("line") > limit)
    rows = rows.withColumn("_over", F.max(over.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("_first", (F.col("_over") == 1) & (F.coalesce(F.lag("_over").over(w), F.lit(0)) == 0))
    charged = F.when((F.col("_over") == 0) | (F.col("_first") if charge_last else F.lit(False)), F.col("_cost"))
    return rows.groupBy("query_id").agg(F.array_sort(F.collect_list(F.when(F.col("_over") == 0, F.struct("place", "line")))).alias("_lines"), F.coalesce(F.sum(charged), F.lit(0)).alias("_spent"))


def pack_context(queries: DataFrame, docs: DataFrame, history: DataFrame, triples: DataFrame, budget: int = 12_000) -> DataFrame:
    """query_id, context, history, graph, left: documents, then history, then triples under one budget.

    docs: query_id, rank, content, source, chunk_id, url, title, score. history: query_id, place, role, text.
    triples: query_id, place, text. Each list ends at its first overflow; an overflowing history line is still charged.
    """
    tag = lambda c, t: F.when(F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) != "", F.format_string(t, F.trim(F.col(c).cast("string"))))
    score = F.when(F.col("score").isNotNull(), F.format_string("[score=%.4f]", F.col("score").cast("double")))
    head = F.concat_ws(" ", F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("]")), tag("source", "[source=%s]"), tag("chunk_id", "[chunk_id=%s]"), tag("url", "[url=%s]"), tag("title", "[title=%s]"), score)
    d = docs.where("trim(coalesce(content, '')) <> ''").select("query_id", F.col("rank").alias("place"), F.concat(head, F.lit("\n"), F.trim("content")).alias("line"))
    joined = lambda sep: F.array_join(F.transform("_lines", lambda x: x["line"]), sep)
    a = _fit(d, F.length("line") + 2, budget, False).select("query_id", joined("\n\n").alias("context"), F.col("_spent").alias("_a"))
    left = queries.select("query_id").join(a, "query_id", "left").withColumn("_left", F.lit(budget) - F.coalesce("_a", F.lit(0)))
    label = F.element_at(F.create_map(*[F.lit(x) for kv in ROLES.items() for x in kv]), F.col("role"))
    h = history.where(F.col("role").isin(*ROLES) & (F.coalesce("text", F.lit("")) != "")).select("query_id", "place", F.concat(label, F.lit(": "), F.col("text")).alias("line"))
    b = _fit(h.join(left.select("query_id", "_left"), "query_id"), F.length("line") + 1, "_left", True).select("query_id", joined("\n").alias("history"), F.col("_spent").alias("_b"))
    left = left.join(b, "query_id", "left").withColumn("_left2", F.col("_left") - F.coalesce("_b", F.lit(0)))
    t = triples.where("trim(coalesce(text, '')) <> ''").select("query_id", "place", F.trim("text").alias("line"))
    c = _fit(t.join(left.select("query_id", "_left2"), "query_id"), F.length("line") + 1, "_left2", False).select("query_id", joined("\n").alias("graph"), F.col("_spent").alias("_c"))
    out = left.join(c, "query_id", "left")
    return out.select("query_id", *[F.coalesce(x, F.lit("")).alias(x) for x in ("context", "history", "graph")], (F.col("_left2") - F.coalesce("_c", F.lit(0))).cast("long").alias("left"))


# ---- state machines: one step function for batch and stream ----


def choose(reply: str, options: list[str]) -> str | None:
    """The option a reply means (the row-local form of parse_selection)."""
    key = lambda s: re.sub(r"[\s\-_]+", "", s.strip().lower())
    for p in NUMBERED:
        if (m := re.match(p, reply.strip())) and 1 <= int(m[1][:9]) <= len(options):
            return options[int(m[1][:9]) - 1]
    n = ORDINALS.get(re.sub(r"\s+", "", reply))
    if n and n <= len(options):
        return options[n - 1]
    said = key(reply)
    if not said:
        return None
    same = [o for o in options if key(o) == said]
    part = [o for o in options if said in key(o) or key(o) in said]
    return same[0] if same else part[0] if len(part) == 1 else None


def clarify_step(pending: tuple[list[str], str] | None, turn: dict) -> tuple[tuple[list[str], str] | None, dict]:
    """One turn of a session: (new pending choice, outcome). A turn holds text, options (offered by the search) and rewritten."""
    text = turn.get("text") or ""
    if pending is None:
        options = [o for o in (turn.get("options") if turn.get("options") is not None else ())]
        if options:
            return (options, turn.get("rewritten") or text), {"action": "ask", "item": None, "query": None}
        return None, {"action": "pass", "item": None, "query": text}
    options, query = pending
    if text.strip() in CANCEL_WORDS:
        return None, {"action": "cancel", "item": None, "query": None}
    item = choose(text, options)
    if item:
        return None, {"action": "selected", "item": item, "query": query or text}
    return pending, {"action": "unresolved", "item": None, "query": None}


CLARIFIED = "session_id string, turn int, action string, item string, query string"


def clarify(turns: DataFrame) -> DataFrame:
    """CLARIFIED outcomes of turns(session_id, turn, ts, text, options, rewritten), each session's turns in order.

    Turns are dealt by session and sorted by Spark, which spills, and are read as they come: a task holds one batch and one pending
    choice, however long a session is. Turns without a session are one session; an empty or null text resolves nothing.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        session, pending = object(), None
        for g in frames:
            rows = []
            for t in g.to_dict("records"):
                if t["session_id"] != session:
                    session, pending = t["session_id"], None
                pending, out = clarify_step(pending, t)
                rows.append((session, t["turn"], out["action"], out["item"], out["query"]))
            yield pd.DataFrame(rows, columns=["session_id", "turn", "action", "item", "query"])

    told = turns.select(F.col("session_id").cast("string").alias("session_id"), "turn", "ts", "text", "options", "rewritten")
    return told.repartition("session_id").sortWithinPartitions("session_id", "ts", "turn").mapInPandas(run, CLARIFIED)


def ttl_step(written: float | None, ts: float, ttl: float) -> tuple[float, bool]:
    """(time of the entry's write, hit) for a request at ts; a hit does not extend the entry's life."""
    return (written, True) if written is not None and ts - written < ttl else (ts, False)


CELLS = 64  #: cells of time in one life of an entry


def _first_from(points: DataFrame, offsets: dict[str, int], width: int) -> DataFrame:
    """points(entry, us) with, for each named offset, the entry's first point at us + offset or later (null if none).

    Time is cut into cells of `width`. Points and the moments that are asked for meet in their cell; where the
    cell has no later point, the first point of the entry's next cell with points is the one. So no window holds more than a cell.
    """
    asked = F.explode(F.array(F.struct(F.lit(None).cast("string").alias("name"), F.col("us").alias("at")), *(F.struct(F.lit(n).alias("name"), (F.col("us") + o).alias("at")) for n, o in offsets.items())))
    both = points.select("entry", "us", asked.alias("x")).select("entry", "us", "x.*").withColumn("cell", F.floor(F.col("at") / width))
    point = F.when(F.col("name").isNull(), F.col("us"))
    back = Window.partitionBy("entry", "cell").orderBy(F.desc("at"), F.col("name").isNotNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = both.withColumn("here", F.min(point).over(back)).where("name is not null")
    # Cells, not points: as many as the entry's time has.
    later = Window.partitionBy("entry").orderBy(F.desc("cell")).rowsBetween(Window.unboundedPreceding, -1)
    cells = both.groupBy("entry", "cell").agg(F.min(point).alias("first")).select("entry", "cell", F.min("first").over(later).alias("after"))
    found = met.join(cells, ["entry", "cell"]).withColumn("first", F.coalesce("here", "after"))
    return found.groupBy("entry", "us").agg(*(F.max(F.when(F.col("name") == n, F.col("first"))).alias(n) for n in offsets))


def ttl_cache(requests: DataFrame, ttl: float = TTL_SECONDS) -> DataFrame:
    """request_id, key, ts, hit of requests(request_id, key, ts): whether a request finds its key's entry, written at most ttl seconds before.

    A request with none of its key in the life before it surely writes the entry, and so does the first request past the life of each written
    one; all others hit. Every moment of a key is linked to the first one past its life, and the links from the sure writes are followed by
    doubling, so a key with most of all requests is worked on by as many tasks as any. Of requests of one moment the smallest request_id writes. A null key is a key; a request without
    a time never hits and writes nothing.
    """
    life = round(ttl * 1_000_000)
    timed = isinstance(requests.schema["ts"].dataType, TimestampType | TimestampNTZType)
    us = F.unix_micros(F.col("ts").cast("timestamp")) if timed else F.col("ts").cast("long")
    rows = requests.select("request_id", "key", "ts", F.struct("key").alias("entry"), us.alias("us"))
    never = rows.where("us is null" if life > 0 else "true").select("request_id", "key", "ts", F.lit(False).alias("hit"))
    if life <= 0:
        return never
    rows = rows.where("us is not null")
    points = rows.select("entry", "us").distinct()
    moments = keep(_first_from(points, {"next": life, "near": 1 - life}, max(1, life // CELLS)), "links")
    links = moments.where("next is not null").select("entry", "us", "next")
    reached = moments.where("near = us").select("entry", "us")
    while True:
        found = reached.join(links, ["entry", "us"]).select("entry", F.col("next").alias("us"))
        both = keep(reached.unionByName(found).distinct(), "written")
        if both.count() == reached.count():
            break
        reached = both
        on = links.select("entry", F.col("us").alias("next"), F.col("next").alias("far"))
        links = keep(links.join(on, ["entry", "next"]).select("entry", "us", F.col("far").alias("next")), "links")
    place = F.row_number().over(Window.partitionBy("entry", "us").orderBy("request_id"))
    told = rows.withColumn("place", place).join(reached.withColumn("writes", F.lit(True)), ["entry", "us"], "left")
    return told.select("request_id", "key", "ts", (F.col("writes").isNull() | (F.col("place") > 1)).alias("hit")).unionByName(never)
