"""MinHash near-duplicates: universal hash minima, banding, signature and exact verification, star components.

One pass over the texts gives each document its set size, a 128-bit digest of its set, HASHES minima cut
to one byte each (the signature) and BANDS keys of ROWS full minima each. At the threshold 0.75 a pair
misses all bands with a chance of (1 - 0.75 ** 5) ** 51, about one in a million.

Equal sets fall into one class by the digest, and only the smallest id of a class goes on. Links are then
found without ever listing the pairs of a bucket:

1. Each class is compared with one leader, the smallest id among all its buckets, on the full sets. A
   leader's members are dealt to parts of bounded size, and its text travels once to each part. Components
   of these links settle nearly all copies.
2. Buckets whose members are still in different components are contested. Their members are compared by
   signature, in blocks of bounded bytes, those outside the bucket's largest component with all others;
   who may reach the threshold with somebody of another component is flagged, in the first bucket that the
   pair shares by the full keys. A pair is never a row.
3. The flagged members meet again in such blocks with their full sets. Pairs that the set sizes and the
   signatures leave open are verified where they lie; a block joins proven links as it goes and puts out a
   link only where it merges two of its components, so its rows are fewer than its members.

Components are found by alternating large-star and small-star steps on the link table; every step is
written to the shared folder, so a lost executor costs a step at most.

Cases: null, empty and blank texts have the empty set and link with nothing; a text under five words is
one shingle, its whole word sequence; rows of one doc_id are one document, which links where any of its
texts does (repeated rows change nothing); ties cannot occur, ids order everything; very long texts count
by their bytes in a block; an empty table gives no rows; other columns are ignored; a row without a
doc_id links with nothing but its exact copies.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kbspark.llm.common import Steps, cut, map_arrow, map_groups, slices, texts, tidy, within
from kbspark.llm.shingles import shingle_set

BANDS, ROWS = 51, 5
HASHES = BANDS * ROWS
SLACK = 0.15  #: a signature may fall this far below the threshold (five and a half standard deviations)
BLOCK_BYTES = 8 << 20  #: what one side of a block of a contested bucket may weigh
PART = 200  #: members of a leader in one part

_rng = np.random.default_rng(20240229)
MULTIPLY = _rng.integers(1, 1 << 31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
ADD = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint32)
BAND_MIX = _rng.integers(1, 1 << 63, (BANDS, ROWS + 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)

SKETCH = "doc_id long, n_shingles long, h1 long, h2 long, sig binary, keys array<long>"


def minima(shingles: np.ndarray) -> np.ndarray:
    """The smallest value of each hash function over the set, in blocks that fit the cache."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    low = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 512):
        h = np.multiply.outer(x[at : at + 512], MULTIPLY)
        h += ADD
        np.minimum(low, h.min(axis=0), out=low)
    return low


def sketch(docs: DataFrame) -> DataFrame:
    """SKETCH of every document of docs(doc_id, text); keys are null for empty sets."""

    def run(b: pa.RecordBatch) -> dict:
        out: dict[str, list] = {k: [] for k in ("n_shingles", "h1", "h2", "sig", "keys")}
        for t in texts(b):
            s = shingle_set(t)
            out["n_shingles"].append(len(s))
            if not len(s):
                for k in ("h1", "h2", "sig", "keys"):
                    out[k].append(None)
                continue
            mixed = (s ^ (s >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            out["h1"].append(int(s.sum(dtype=np.uint64).view(np.int64)))
            out["h2"].append(int((mixed ^ (mixed >> np.uint64(32))).sum(dtype=np.uint64).view(np.int64)))
            low = minima(s).astype(np.uint64)
            out["sig"].append((low & np.uint64(255)).astype(np.uint8).tobytes())
            key = (low.reshape(BANDS, ROWS) * BAND_MIX[:, :ROWS]).sum(axis=1, dtype=np.uint64) + BAND_MIX[:, ROWS]
            out["keys"].append((key ^ (key >> np.uint64(31))).view(np.int64))
        return {"doc_id": b.column("doc_id"), **out}

    return map_arrow(docs.select("doc_id", "text"), run, SKETCH)


def links_of(pairs: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """The (a, b) of pairs with 100 * intersection >= percent * union on the full sets.

    The pairs of one `a` are dealt to parts; each part reads the text of `a` once, then one text after the other.
    """
    sizes = pairs.groupBy("a").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"))
    needed = pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct()
    own = within(docs.select("doc_id", "text").where("text is not null"), needed).dropDuplicates(["doc_id", "text"])
    heads = sizes.select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(None).cast("long").alias("b"))
    members = pairs.join(sizes, "a").select("a", F.pmod(F.xxhash64("b"), "parts").cast("int").alias("part"), "b")
    rows = heads.unionByName(members).join(own.toDF("doc_id", "text"), F.coalesce("b", "a") == F.col("doc_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, first = None, []
        for batch in slices(batches):
            out_a, out_b = [], []
            for a, part, b, t in zip(*(batch.column(c).to_pylist() for c in ("a", "part", "b", "text")), strict=True):
                s = shingle_set(t)
                if b is None:  # the texts of `a` come first
                    first = [*first, s] if (a, part) == held else [s]
                    held = a, part
                elif any(100 * (n := len(np.intersect1d(x, s, assume_unique=True))) >= percent * (len(x) + len(s) - n) and n for x in first):
                    out_a.append(a)
                    out_b.append(b)
            yield pa.RecordBatch.from_pydict({"a": pa.array(out_a, pa.int64()), "b": pa.array(out_b, pa.int64())})

    dealt = rows.select("a", "part", "b", "text").repartition("a", "part").sortWithinPartitions("a", "part", "b")
    return dealt.mapInArrow(run, "a long, b long")


def components(links: DataFrame, steps: Steps) -> DataFrame:
    """node, component (smallest node reachable) of links(a, b), by large-star and small-star until nothing changes."""
    edges = steps.cut(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    mark = None
    while True:
        now = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if now["n"] == 0 or (now["n"], now["x"]) == mark:
            break
        mark = (now["n"], now["x"])
        # large star: every larger neighbour of a node moves to the smallest of the node and its neighbours
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: every smaller neighbour, and the node, move to the smallest
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        before, edges = edges, steps.cut(moved.where("u <> v").distinct(), "small-star")
        steps.drop(before)
    own = edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
    return own.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def first_band(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The first band whose keys are equal (BANDS if none): where a pair that shares several buckets is named once."""
    same = a == b
    return np.where(same.any(axis=1), same.argmax(axis=1), BANDS)


def contested(members: DataFrame, comps: DataFrame) -> DataFrame:
    """key, band, id, component of the members(key, band, id) of buckets that hold several components."""
    placed = members.join(comps.select(F.col("node").alias("id"), "component"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    several = placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("key")
    return placed.join(several, "key", "left_semi")


def marks(rows: DataFrame, sketches: DataFrame) -> DataFrame:
    """id, sig, bands (32 bits of each band key, to find the first bucket of a pair) of the documents in rows(id)."""
    ids = rows.select(F.col("id").alias("doc_id")).distinct()
    folds = F.transform("keys", lambda k: F.substring(F.lpad(F.hex(k), 16, "0"), 9, 8))
    return within(sketches, ids).select(F.col("doc_id").alias("id"), "sig", F.unhex(F.array_join(folds, "")).alias("bands"))


def dealt(rows: DataFrame, fields: list[str]) -> DataFrame:
    """The rows(key, id, component, bytes, and fields) of each key in blocks (key, i, j).

    A block sets some members of the bucket (role 0) against some of those outside its largest component (role 1;
    2 for a row that is both); over all blocks each of these meets each member, about BLOCK_BYTES on a side.
    """
    sizes = rows.groupBy("key", "component").agg(F.count("*").alias("c"), F.sum("bytes").alias("w"))
    main = sizes.groupBy("key").agg(F.max(F.struct("c", "component", "w")).alias("x"), F.sum("w").alias("all"))
    blocks = lambda w: F.ceil(w / F.lit(BLOCK_BYTES)).cast("int")
    main = main.select("key", F.col("x.component").alias("main"), blocks(F.col("all")).alias("ni"), F.greatest(F.lit(1), blocks(F.col("all") - F.col("x.w"))).alias("nj"))
    h, outside = F.xxhash64("id"), F.col("component") != F.col("main")
    rows = rows.join(main, "key").withColumn("own_i", F.pmod(h, "ni").cast("int")).withColumn("own_j", F.pmod(h, "nj").cast("int"))
    whole = rows.withColumn("i", F.col("own_i")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("nj") - 1))).withColumn("role", F.when(outside & (F.col("j") == F.col("own_j")), 2).otherwise(0))
    again = rows.where(outside & (F.col("ni") > 1)).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("ni") - 1))).withColumn("j", F.col("own_j")).withColumn("role", F.lit(1)).where("i <> own_i")
    columns = ["key", "i", "j", "role", "id", "component", *fields]
    return whole.select(*columns).unionByName(again.select(*columns))


class Side:
    """One side of a block: ids, components, bands, signatures and band keys as arrays."""

    def __init__(self, rows: list[tuple]):
        self.rows = rows
        self.ids, self.comps, self.band = np.array([r[4] for r in rows]), np.array([r[5] for r in rows]), [r[6] for r in rows]
        self.sig = np.frombuffer(b"".join(r[7] for r in rows), np.uint8).reshape(-1, HASHES)
        self.keys = np.frombuffer(b"".join(r[8] for r in rows), ">u4").reshape(-1, BANDS)


def sides(block: list[tuple]) -> tuple[Side, Side] | None:
    """Those outside the largest component, and all members, of a block; None where one of them is empty."""
    out, rest = [r for r in block if r[3]], [r for r in block if r[3] != 1]
    return (Side(out), Side(rest)) if out and rest else None


def open_pairs(x: Side, y: Side, threshold: float) -> Iterator[tuple[int, np.ndarray]]:
    """For each place in x the places in y of another component that may reach the threshold and share no earlier bucket."""
    columns = np.ascontiguousarray(y.sig.T)
    least = int((threshold - SLACK) * 255 + 1) * HASHES // 256  # equal bytes that a pair must have
    for n in range(len(x.ids)):
        equal = (columns == x.sig[n][:, None]).view(np.uint8).sum(axis=0, dtype=np.uint8)
        at = np.flatnonzero((equal >= least) & (y.comps != x.comps[n]))
        if len(at):
            yield n, at[first_band(x.keys[n], y.keys[at]) == x.band[n]]


def flagged(rows: DataFrame, signed: DataFrame, threshold: float) -> DataFrame:
    """key, id of the contested rows(key, band, id, component) that take part in an open pair of that bucket."""
    rows = rows.join(signed, "id").withColumn("bytes", F.lit(HASHES + 4 * BANDS))

    def run(block: list[tuple]) -> list[tuple]:
        found: set[int] = set()
        if both := sides(block):
            x, y = both
            for n, at in open_pairs(x, y, threshold):
                if len(at):
                    found.add(int(x.ids[n]))
                    found.update(y.ids[at].tolist())
        return [(block[0][0], k) for k in sorted(found)]

    return map_groups(dealt(rows, ["band", "sig", "bands"]), ["key", "i", "j"], run, "key long, id long").distinct()


def join_components(x: Side, y: Side, percent: int) -> list[tuple[int, int]]:
    """The links between x and y, verified on the full sets (last field of the rows), that merge components."""
    sx, sy = ([np.frombuffer(r[9], np.uint64) for r in side.rows] for side in (x, y))
    size_y, found = np.array([len(s) for s in sy]), []
    for n, at in open_pairs(x, y, percent / 100):
        s = sx[n]
        while len(at := at[y.comps[at] != x.comps[n]]):  # components joined meanwhile need no more links
            part, at = at[:64], at[64:]
            every = np.concatenate([sy[k] for k in part.tolist()])
            hit = s[np.minimum(np.searchsorted(s, every), len(s) - 1)] == every
            common = np.add.reduceat(hit, np.concatenate([[0], np.cumsum(size_y[part])[:-1]]), dtype=np.int64)
            for k in part[100 * common >= percent * (len(s) + size_y[part] - common)].tolist():
                if (old := int(y.comps[k])) != (new := int(x.comps[n])):
                    u, v = int(x.ids[n]), int(y.ids[k])
                    found.append((min(u, v), max(u, v)))
                    y.comps[y.comps == old] = new
                    x.comps[x.comps == old] = new
    return found


def block_links(rows: DataFrame, signed: DataFrame, docs: DataFrame, percent: int, cut=cut) -> DataFrame:
    """(a, b) that join the components of the flagged rows(key, band, id, component)."""
    ids = rows.select(F.col("id").alias("doc_id")).distinct()
    own = within(docs.select("doc_id", "text").where("text is not null"), ids).dropDuplicates(["doc_id", "text"])
    sets = cut(map_arrow(own, lambda b: {"id": b.column("doc_id"), "shingles": [shingle_set(t).tobytes() for t in texts(b)]}, "id long, shingles binary"), "flagged-sets")
    # a document of several texts has several sets and signatures, which all meet; a link of any is its link
    rows = rows.join(signed, "id").join(sets, "id").withColumn("bytes", F.octet_length("shingles") + HASHES + 4 * BANDS)
    found = map_groups(dealt(rows, ["band", "sig", "bands", "shingles"]), ["key", "i", "j"], lambda block: join_components(*both, percent) if (both := sides(block)) else [], "a long, b long")
    return found.distinct()


def near_duplicates(docs: DataFrame, percent: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs(doc_id, text), as a table of its own."""
    steps = Steps(docs.sparkSession)
    sketches = steps.cut(sketch(docs), "sketches")
    small = sketches.select("doc_id", "n_shingles", "h1", "h2")
    digest = ["n_shingles", "h1", "h2"]
    classes = small.where("n_shingles > 0").groupBy(*digest).agg(F.min("doc_id").alias("rep"))
    member = steps.cut(small.join(classes, digest, "left").select("doc_id", "n_shingles", F.coalesce("rep", "doc_id").alias("rep")), "members")
    # a representative may also hold another set, under an id of an equal one: a document of several texts
    reps = sketches.where("n_shingles > 0").join(classes.select(F.col("rep").alias("doc_id"), *digest), ["doc_id", *digest], "left_semi").dropDuplicates(["doc_id", *digest])
    reps = steps.cut(reps.select("doc_id", "sig", "keys"), "representatives")
    steps.drop(sketches)

    rows = reps.select(F.col("doc_id").alias("id"), F.posexplode("keys").alias("band", "key"))
    shared = rows.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("lead")).where("n > 1").select("key", "lead")
    members = steps.cut(rows.join(shared, "key"), "bucket-members")

    own = docs.select("doc_id", "text")
    several = member.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).where("doc_id is not null and a <> b")
    same = member.join(several.select("doc_id", "a"), "doc_id").select("a", F.col("rep").alias("b")).where("a <> b").distinct()
    first = steps.cut(members.groupBy("id").agg(F.min("lead").alias("lead")).where("lead < id").select(F.col("lead").alias("a"), F.col("id").alias("b")), "first")
    comps = steps.cut(components(steps.cut(links_of(first, own, percent).unionByName(same), "links"), steps), "components")
    tidy(docs.sparkSession)

    rows = steps.cut(contested(members.select("key", "band", "id"), comps), "contested")
    signed = steps.cut(marks(rows, reps), "marks")
    open_rows = steps.cut(rows.join(flagged(rows, signed, percent / 100), ["key", "id"], "left_semi"), "flagged")
    late = steps.cut(block_links(open_rows, signed, own, percent, steps.cut), "late-links")
    if not late.isEmpty():
        known = comps.select(F.col("node").alias("a"), F.col("component").alias("b")).where("a <> b")
        comps = steps.cut(components(known.unionByName(late), steps), "components")
    final = member.join(comps.select(F.col("node").alias("rep"), "component"), "rep", "left").select("doc_id", "n_shingles", F.coalesce("component", "rep").alias("component_id"))
    final = cut(final.withColumn("kept", F.col("doc_id") == F.col("component_id")), "near-duplicates")
    steps.done()
    return final


def op4_minhash(spark, sf_dir: str) -> DataFrame:
    """Contract op4 over whole documents."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
