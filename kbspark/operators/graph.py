"""A typed entity graph as plain tables, and search over it.

entities: item_name, name, labels, description, chunk_id. relations: item_name, head, type, tail.
mentions: item_name, name, chunk_id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kbspark.sources.shared import keep

from kbspark.functions.text import once, parse_model_json

# The kinds of entities and relations, and the form of a model's answer.
LABELS = ("Device", "Part", "Operation", "Step", "Warning", "Condition", "Tool")
RELATIONS = ("HAS_OPERATION", "HAS_PART", "HAS_STEP", "USES_TOOL", "HAS_WARNING", "NEXT_STEP", "AFFECTS", "REQUIRES", "MENTIONED_IN", "RELATED_TO")
OTHER_RELATION, MENTION = "RELATED_TO", "MENTIONED_IN"
ANSWER = "entities array<struct<name: string, label: string, description: string>>, relations array<struct<head: string, tail: string, type: string>>"
NAME_CUT = 15
SEED, NEIGHBOUR = 2.0, 1.0


def _name(c):
    return F.substring(F.trim(c), 1, NAME_CUT)


def validate_graph_chunks(chunks: DataFrame) -> DataFrame:
    """chunks(chunk_id, item_name, doc_item, content) with trimmed text, an item and an id; blank ones drop out."""
    text = lambda c: F.nullif(F.trim(c), F.lit(""))
    out = chunks.withColumn("content", text("content")).withColumn("item_name", F.coalesce(text("item_name"), text("doc_item")))
    out = out.where("content is not null and item_name is not null")
    temp = F.concat(F.lit("tmp-"), F.substring(F.sha2(F.concat_ws("\n", "item_name", "content"), 256), 1, 16))
    return out.withColumn("chunk_id", F.coalesce(text("chunk_id"), temp)).select("chunk_id", "item_name", "content")


def parse_answers(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(parsed, rejected) of raw(chunk_id, item_name, chunk_no, response): JSON answers, and those that are none."""
    # Exploded, since a test of a plain column would be pushed below and make and parse each answer anew in every part of its expression.
    rows = raw.select("*", F.explode(F.array(parse_model_json("response", ANSWER))).alias("answer"))
    return rows.where("answer is not null"), rows.where("answer is null").drop("answer")


def with_relations(raw: DataFrame) -> DataFrame:
    """The rows of raw whose answer may hold a relation: without the key "head", plain or escaped, it has none that lasts. Spares parsing the rest."""
    rows = raw.select(*[c for c in raw.columns if c != "response"], F.explode(F.array("response")).alias("response"))  # exploded, see parse_answers
    return rows.where(F.contains("response", F.lit("head")) | F.contains("response", F.lit("\\")))


def clean_entities(parsed: DataFrame) -> DataFrame:
    """chunk_id, item_name, chunk_no, name, label, description: known labels only, the first of a (name, label) in a chunk."""
    rows = parsed.select("chunk_id", "item_name", "chunk_no", F.posexplode("answer.entities").alias("n", "e"))
    rows = rows.select("chunk_id", "item_name", "chunk_no", "n", _name("e.name").alias("name"), F.trim("e.label").alias("label"), F.nullif(F.trim("e.description"), F.lit("")).alias("description"))
    rows = rows.where((F.coalesce("name", F.lit("")) != "") & F.col("label").isin(*LABELS))
    return rows.groupBy("chunk_id", "item_name", "chunk_no", "name", "label").agg(F.min_by(F.struct("description"), "n")["description"].alias("description"))


def clean_relations(parsed: DataFrame, entities: DataFrame) -> DataFrame:
    """chunk_id, item_name, head, type, tail whose ends are cleaned entities of the chunk; unknown types become OTHER_RELATION."""
    rows = parsed.select("chunk_id", "item_name", F.explode("answer.relations").alias("r"))
    kind = F.trim("r.type")
    rows = rows.select("chunk_id", "item_name", _name("r.head").alias("head"), F.when(kind.isin(*RELATIONS), kind).otherwise(OTHER_RELATION).alias("type"), _name("r.tail").alias("tail"))
    names = entities.select("chunk_id", "item_name", "name").distinct()
    for end in ("head", "tail"):
        rows = rows.join(names.withColumnRenamed("name", end), ["chunk_id", "item_name", end], "left_semi")
    return rows.select("chunk_id", "item_name", "head", "type", "tail")


def clean_answers(parsed: DataFrame) -> DataFrame:
    """chunk_id, item_name, chunk_no, entities, relations: clean_entities and clean_relations inside each answer, without a shuffle.

    For one answer a chunk; where a chunk has several answers, take these two. An answer's own entities are compared with each other.
    """
    key = lambda e: F.concat(e["name"], F.lit("\n"), e["label"])  # noqa: E731  (labels have no line feed)
    first = lambda es: F.when(F.size(es) < 2, es).otherwise(once(F.transform(es, key), lambda keys: F.filter(es, lambda e, n: F.array_position(keys, key(e)) == n + 1)))
    tidy = F.transform("answer.entities", lambda e: F.struct(_name(e["name"]).alias("name"), F.trim(e["label"]).alias("label"), F.nullif(F.trim(e["description"]), F.lit("")).alias("description")))
    entities = once(F.filter(tidy, lambda e: (e["name"] != "") & e["label"].isin(*LABELS)), first)
    kind = lambda c: once(F.trim(c), lambda t: F.when(t.isin(*RELATIONS), t).otherwise(OTHER_RELATION))
    links = F.transform("answer.relations", lambda r: F.struct(_name(r["head"]).alias("head"), kind(r["type"]).alias("type"), _name(r["tail"]).alias("tail")))
    known = lambda names: F.filter(links, lambda r: F.array_contains(names, r["head"]) & F.array_contains(names, r["tail"]))
    both = once(entities, lambda es: F.struct(es.alias("entities"), F.when(F.size("answer.relations") > 0, once(F.transform(es, lambda e: e["name"]), known)).alias("relations")))
    # Exploded for the same reason as an answer.
    return parsed.select("chunk_id", "item_name", "chunk_no", F.explode(F.array(both)).alias("clean")).select("chunk_id", "item_name", "chunk_no", "clean.entities", "clean.relations")


def answered_entities(answers: DataFrame) -> DataFrame:
    """The rows of clean_entities, from clean_answers."""
    return answers.select("chunk_id", "item_name", "chunk_no", F.inline("entities"))


def answered_relations(answers: DataFrame) -> DataFrame:
    """The rows of clean_relations, from clean_answers."""
    return answers.select("chunk_id", "item_name", F.inline("relations"))


def nodes_and_relations(answers: DataFrame) -> DataFrame:
    """item_name, name, head, type, tail, each once, from clean_answers in one pass: nodes have a name, relations the rest."""
    no = F.lit(None).cast("string")
    row = lambda name, head, kind, tail: F.struct(name.alias("name"), head.alias("head"), kind.alias("type"), tail.alias("tail"))
    nodes = F.transform("entities", lambda e: row(e["name"], no, no, no))
    links = F.transform("relations", lambda r: row(no, r["head"], r["type"], r["tail"]))
    return answers.select("item_name", F.inline(F.concat(nodes, F.coalesce(links, F.slice(nodes, 1, 0))))).distinct()


def merge_graph(entities: DataFrame, relations: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(entities, relations, mentions, chunk nodes), each once; by chunk order the first chunk and the last description stay."""
    at = F.struct("chunk_no", "chunk_id", "label")
    nodes = entities.groupBy("item_name", "name").agg(
        F.array_sort(F.collect_set("label")).alias("labels"), F.max_by("description", F.when(F.col("description").isNotNull(), at)).alias("description"), F.min_by("chunk_id", at).alias("chunk_id")
    )
    mentions = entities.select("item_name", "name", "chunk_id").distinct()
    return nodes, relations.select("item_name", "head", "type", "tail").distinct(), mentions, entities.select("item_name", "chunk_id").distinct()


def entity_records(entities: DataFrame, chunks: DataFrame, vectors: DataFrame | None = None, context: int = 200) -> DataFrame:
    """entity_name, chunk_id, context, item_name [, vectors] of the distinct names of each chunk."""
    names = entities.select("chunk_id", "item_name", F.col("name").alias("entity_name")).repartition("chunk_id").distinct()  # dealt once for both
    out = names.join(chunks.select("chunk_id", F.substring("content", 1, context).alias("context")), "chunk_id")
    return out if vectors is None else out.join(vectors, "entity_name")


def hybrid_candidates(names: DataFrame, records: DataFrame, query_items: DataFrame, k: int = 5, weights: tuple[float, float] = (0.4, 0.6), digits: int | None = None) -> DataFrame:
    """query_id, name, item_name, entity, score: the k entities nearest to each of names(query_id, name, dense, sparse) by both vectors.

    Searched among records(item_name, entity, dense, sparse) of the items in query_items(query_id, item_name): k by cosine in blocks, k by
    inner product over postings, then k of the weighted sums of their scaled scores. Records of one entity in one item count once.
    Vectors belong to names: a name is searched once for all queries of the same items.
    """
    from kbspark.operators import search

    one = records.groupBy("item_name", "entity").agg(F.first("dense", True).alias("dense"), F.first("sparse", True).alias("sparse"))
    stored = keep(one.withColumn("chunk_id", F.to_json(F.struct("item_name", "entity"))), "records")
    items = query_items.where("item_name is not null").groupBy("query_id").agg(F.array_sort(F.collect_set("item_name")).alias("items"))
    asked = names.join(items, "query_id").withColumn("id", F.to_json(F.struct("name", "items")))
    by = asked.groupBy("id", "items").agg(F.first("dense", True).alias("dense"), F.first("sparse", True).alias("sparse"))
    by = keep(by.select(F.col("id").alias("query_id"), F.explode("items").alias("item_name"), "dense", "sparse"), "names")
    dense = search.dense_topk_blocked(by.where("dense is not null"), stored.where("dense is not null"), k, digits)
    terms, postings = (search.to_postings(t.where("sparse is not null").select(key, "item_name", "sparse")) for t, key in ((by, "query_id"), (stored, "chunk_id")))
    best = search.hybrid_topk(dense, search.sparse_topk(terms, postings, k), weights, True, k).withColumnRenamed("query_id", "id")
    best = best.join(stored.select("chunk_id", "item_name", "entity"), "chunk_id").select("id", "item_name", "entity", "score")
    return asked.select("id", "query_id", "name").distinct().join(best, "id").select("query_id", "name", "item_name", "entity", "score")


def align_entities(names: DataFrame, scored: DataFrame, min_score: float = 0.5, k: int = 5) -> tuple[DataFrame, DataFrame]:
    """(aligned, misses) of names(query_id, name, pos), with hybrid_candidates as scored: the best entity of each item among a name's k best of scored(query_id, name, item_name, entity, score)."""
    top = Window.partitionBy("query_id", "name").orderBy(F.desc("score"), "item_name", "entity")
    best = Window.partitionBy("query_id", "name", "item_name").orderBy(F.desc("score"), "entity")
    near = scored.withColumn("_k", F.row_number().over(top)).where(F.col("_k") <= k).withColumn("_b", F.row_number().over(best)).where("_b = 1").drop("_k", "_b")
    aligned = names.join(near.where(F.col("score") >= min_score), ["query_id", "name"])
    seen = near.groupBy("query_id", "name").agg(F.max("score").alias("best"))
    misses = names.join(aligned.select("query_id", "name").distinct(), ["query_id", "name"], "left_anti").join(seen, ["query_id", "name"], "left")
    return aligned, misses.withColumn("reason", F.when(F.col("best").isNull(), "no candidate").otherwise("score too low"))


def item_entity_pairs(aligned: DataFrame) -> DataFrame:
    """query_id, place, item_name, entity: distinct pairs in order of the names' positions."""
    first = aligned.groupBy("query_id", "item_name", "entity").agg(F.min(F.struct("pos", F.col("score") * -1)).alias("_at"))
    return first.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("_at", "item_name", "entity"))).select("query_id", "place", "item_name", "entity")


def _grams(column: str):
    """The distinct runs of three characters of a text in lower case."""
    low = F.lower(column)
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(low) - 2)), lambda n: F.substr(low, n, F.lit(3))))


def _containing(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """pairs(item_name, entity, ...) with the names of the item's nodes that contain the entity, in any case.

    Names are indexed by their runs of three characters; an entity looks up the rarest of its own in the item and
    is then compared with those names only. Entities of under three characters meet all names of their item.
    """
    index = nodes.select("item_name", "name", F.explode(_grams("name")).alias("gram"))
    sizes = index.groupBy("item_name", "gram").agg(F.count("*").alias("n"))
    asked = pairs.where(F.length("entity") >= 3).select("item_name", "entity").distinct()
    asked = asked.select("item_name", "entity", F.explode(_grams("entity")).alias("gram")).join(sizes, ["item_name", "gram"], "left")
    rarest = asked.groupBy("item_name", "entity").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("x")).where("x.n > 0").select("item_name", "entity", "x.gram")
    found = rarest.join(index, ["item_name", "gram"]).select("item_name", "entity", "name")
    found = found.unionByName(pairs.where(F.length("entity") < 3).select("item_name", "entity").distinct().join(nodes, "item_name"))
    return pairs.join(found.where(F.contains(F.lower("name"), F.lower("entity"))), ["item_name", "entity"])


def seed_nodes(pairs: DataFrame, entities: DataFrame, fuzzy: int = 3, limit: int = 30) -> DataFrame:
    """query_id, item_name, name: nodes of the pairs by exact name, else up to `fuzzy` names that contain it; at most `limit` a query."""
    pairs = pairs.groupBy("query_id", "item_name", "entity").agg(F.min("place").alias("place"))
    nodes = entities.select("item_name", "name").distinct()
    exact = pairs.join(nodes.withColumn("entity", F.col("name")), ["item_name", "entity"]).withColumn("_n", F.lit(1))
    rest = pairs.join(nodes.withColumnRenamed("name", "entity"), ["item_name", "entity"], "left_anti")
    near = _containing(rest, nodes)
    near = near.withColumn("_n", F.row_number().over(Window.partitionBy("query_id", "item_name", "entity").orderBy("name"))).where(F.col("_n") <= fuzzy)
    both = exact.select("query_id", "place", "_n", "item_name", "name").unionByName(near.select("query_id", "place", "_n", "item_name", "name"))
    both = both.groupBy("query_id", "item_name", "name").agg(F.min(F.struct("place", "_n")).alias("_at"))
    w = Window.partitionBy("query_id").orderBy("_at", "item_name", "name")
    return both.withColumn("place", F.row_number().over(w)).where(F.col("place") <= limit).select("query_id", "place", "item_name", "name")


def one_hop(seeds: DataFrame, relations: DataFrame, per_seed: int = 50, limit: int = 50) -> DataFrame:
    """query_id, place, item_name, head, rel, tail: relations at the seeds in both directions, each once; limits by (rel, head, tail).

    A node's relations are cut to `per_seed` before they meet the seeds, so hub nodes cost no more than others.
    """
    edges = relations.where(F.col("type") != MENTION).select("item_name", "head", F.col("type").alias("rel"), "tail").distinct()
    ends = edges.withColumn("name", F.col("head")).unionByName(edges.where("head <> tail").withColumn("name", F.col("tail")))
    near = ends.join(seeds.select("item_name", "name").distinct(), ["item_name", "name"], "left_semi")
    near = near.withColumn("_n", F.row_number().over(Window.partitionBy("item_name", "name").orderBy("rel", "head", "tail"))).where(F.col("_n") <= per_seed)
    hops = seeds.join(near, ["item_name", "name"]).groupBy("query_id", "item_name", "head", "rel", "tail").agg(F.min(F.struct("place", "_n")).alias("_at"))
    w = Window.partitionBy("query_id").orderBy("_at", "item_name", "rel", "head", "tail")
    return hops.withColumn("place", F.row_number().over(w)).where(F.col("place") <= limit).select("query_id", "place", "item_name", "head", "rel", "tail")


def node_weights(seeds: DataFrame, hops: DataFrame) -> DataFrame:
    """query_id, item_name, name, weight: seeds weigh SEED, their neighbours NEIGHBOUR; a seed stays a seed."""
    ends = hops.select("query_id", "item_name", F.explode(F.array("head", "tail")).alias("name")).withColumn("weight", F.lit(NEIGHBOUR))
    every = seeds.select("query_id", "item_name", "name").withColumn("weight", F.lit(SEED)).unionByName(ends)
    return every.groupBy("query_id", "item_name", "name").agg(F.max("weight").alias("weight"))


def graph_chunk_scores(weights: DataFrame, mentions: DataFrame, limit: int = 50) -> DataFrame:
    """query_id, rank, chunk_id, item_name, score, cnt: chunks by the weights of the nodes they mention."""
    hits = weights.join(mentions, ["item_name", "name"]).groupBy("query_id", "item_name", "chunk_id").agg(F.sum("weight").alias("score"), F.count("*").alias("cnt"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("cnt"), F.desc("chunk_id"), "item_name")
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit).select("query_id", "rank", "chunk_id", "item_name", "score", "cnt")


def triple_text(hops: DataFrame) -> DataFrame:
    """hops with text: '[item] head -(rel)-> tail', without the item where it is empty; incomplete triples drop out."""
    t = {c: F.coalesce(F.trim(c), F.lit("")) for c in ("item_name", "head", "rel", "tail")}
    arrow = F.concat(t["head"], F.lit(" -("), t["rel"], F.lit(")-> "), t["tail"])
    whole = (t["head"] != "") & (t["rel"] != "") & (t["tail"] != "")
    return hops.where(whole).withColumn("text", F.when(t["item_name"] == "", arrow).otherwise(F.concat(F.lit("["), t["item_name"], F.lit("] "), arrow)))


def graph_search(pairs: DataFrame, entities: DataFrame, relations: DataFrame, mentions: DataFrame, chunks: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(chunks by score, triples) for pairs(query_id, place, item_name, entity)."""
    from kbspark.operators.fusion import backfill

    seeds = seed_nodes(pairs, entities)
    hops = one_hop(seeds, relations)
    scored = graph_chunk_scores(node_weights(seeds, hops), mentions)
    return (scored if chunks is None else backfill(scored, chunks)), triple_text(hops)
