"""Benchmark decontamination by greedy string tiling.

Tokens are words in lower case without outer punctuation. Runs of MATCH tokens that a document shares
with a benchmark item are the seeds. A pair of document and item whose seeds could cover enough of the
item is tiled by running Karp-Rabin: the search length falls from the longest run of unmarked tokens that
both still share (found by bisection over rolling hashes); all matches of that length are marked, earliest
first, then the next length follows, down to MATCH tokens. Tokens outside all seeds are marked from the
start, so the work follows what is shared, not the lengths of the texts. The share of the item's tokens
under tiles is its coverage, whatever order the passages come in; a document is contaminated by items
covered to at least `coverage`.

The benchmark's seeds go to the executors while its text has at most BROADCAST_BYTES, which is measured;
beyond that the seeds of both sides meet in a shuffled join. Both ways give the same rows. In the join an
item is indexed by its rarest seeds only: a document that covers it must hold one of these, so phrases
that stand in very many items bring no pairs.

Items shorter than MATCH tokens count for texts that consist of the same tokens. Cases: null and empty texts
and items, and items without an id, match nothing; rows without a doc_id are documents like others; repeated
rows give repeated results on the document side, and equal item_ids are read as one item each by their text;
ties between tiles go to the earlier place in the document, then in the item; very long and repetitive texts
take near-linear time; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import uuid
from collections import defaultdict
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kbspark.llm.common import hold, map_arrow, text_bytes, texts
from kbspark.llm.shingles import shingle_hashes

MATCH = 5
COVERAGE = 0.6
BROADCAST_BYTES = 32 << 20
KEPT_WORDS = 200_000
BASE = np.uint64(0x9E3779B97F4A7C15)
OUTER = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum()) + "«»„“”‘’…¿¡–—"
FOUND = "doc_id long, item_id long, item_tokens long, covered long, n_tiles long, coverage double"


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > KEPT_WORDS:
            self.clear()
        v = self[word] = xxhash.xxh64_intdigest((word.strip(OUTER) or word).encode("utf-8", "surrogatepass"))
        return v


_hashes = _Hashes()


def _signed(n: int) -> int:
    return n - (1 << 64) if n >> 63 else n


def tokens(text: str) -> np.ndarray:
    found = text.lower().split()
    return np.fromiter(map(_hashes.__getitem__, found), np.uint64, len(found))


class Runs:
    """Rolling hashes of a token sequence: any run's hash from two prefix sums."""

    def __init__(self, h: np.ndarray, free: np.ndarray):
        self.free, n = free, len(h)
        powers = np.full(n + 1, BASE, np.uint64)
        powers[0] = 1
        powers = np.multiply.accumulate(powers)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((h ^ (h >> np.uint64(31))) * powers[:n], dtype=np.uint64)])
        self.shift = powers[::-1]

    def of(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and hashes of the runs of `size` unmarked tokens."""
        marked = np.concatenate([[0], np.cumsum(~self.free)])
        at = np.flatnonzero(marked[size:] == marked[:-size]) if size < len(marked) else np.zeros(0, int)
        return at, (self.sums[at + size] - self.sums[at]) * self.shift[at]


def tile(item: np.ndarray, doc: np.ndarray, match: int = MATCH) -> list[tuple[int, int, int]]:
    """(item place, document place, length) of the tiles, longest first."""
    match = min(match, len(item))
    if not match or len(doc) < match:
        return []
    free = []
    for own, other in ((item, doc), (doc, item)):  # only tokens under seeds can come under tiles
        h = shingle_hashes(own, match)
        delta = np.zeros(len(own) + 1, int)
        hit = np.flatnonzero(np.isin(h, shingle_hashes(other, match)))
        np.add.at(delta, hit, 1)
        np.add.at(delta, hit + match, -1)
        free.append(np.cumsum(delta[:-1]) > 0)
    inner = np.flatnonzero(free[1] | np.concatenate([free[1][1:], [False]]))  # each run of the document with one marked token at its end
    seen, free_d = doc[inner], free[1][inner]
    n = max(len(item), len(seen))
    runs_i, runs_d = (Runs(np.concatenate([h, np.zeros(n - len(h), np.uint64)]), np.concatenate([f, np.zeros(n - len(h), bool)])) for h, f in ((item, free[0]), (seen, free_d)))
    tiles, longest = [], min(int(free[0].sum()), int(free_d.sum()))
    while True:
        low, high = match - 1, longest  # both share a run of `low` tokens, none of more than `high`
        while low < high:
            size = (low + high + 1) // 2
            low, high = (size, high) if np.isin(runs_d.of(size)[1], runs_i.of(size)[1]).any() else (low, size - 1)
        if low < match:
            return tiles
        longest = low
        at, h = runs_i.of(longest)
        places: dict[int, list[int]] = defaultdict(list)
        for p, x in zip(at[::-1].tolist(), h[::-1].tolist(), strict=True):
            places[x].append(p)  # the earliest last
        at, h = runs_d.of(longest)
        some = np.isin(h, list(places))
        end = 0
        for t, x in zip(at[some].tolist(), h[some].tolist(), strict=True):
            stack = places[x]
            while t >= end and stack:
                p = stack.pop()
                if runs_i.free[p : p + longest].all():
                    if (item[p : p + longest] == seen[t : t + longest]).all():
                        runs_i.free[p : p + longest] = runs_d.free[t : t + longest] = False
                        tiles.append((p, int(inner[t]), longest))
                        end = t + longest
        longest -= 1


class Index:
    """A benchmark's items and seeds."""

    def __init__(self, items: list[tuple[int, str]], match: int):
        self.match = match
        self.items = [(k, h) for k, t in items if len(h := tokens(t))]
        seeds, of, at = [], [], []
        for n, (_, h) in enumerate(self.items):
            s = shingle_hashes(h, match)
            seeds.append(s)
            of += [n] * len(s)
            at += range(len(s))
        all_seeds = np.concatenate(seeds) if seeds else np.zeros(0, np.uint64)
        order = np.argsort(all_seeds, kind="stable")
        self.seeds, self.of, self.at = all_seeds[order], np.array(of, int)[order], np.array(at, int)[order]
        self.maybe = np.zeros(1 << 22, bool)
        self.maybe[(self.seeds & np.uint64((1 << 22) - 1)).astype(int)] = True

    def search(self, doc: np.ndarray, coverage: float) -> list[tuple[int, int, int, int]]:
        """(item_id, its tokens, covered tokens, tiles) of the items that the document covers."""
        h = shingle_hashes(doc, self.match)  # one hash of the whole for shorter texts and items
        h = np.unique(h[self.maybe[(h & np.uint64((1 << 22) - 1)).astype(np.int64)]])
        if not len(h) or not len(self.seeds):
            return []
        lo, hi = np.searchsorted(self.seeds, h, "left"), np.searchsorted(self.seeds, h, "right")
        covered: dict[int, set[int]] = defaultdict(set)
        for a, b in zip(lo.tolist(), hi.tolist(), strict=True):
            for k in range(a, b):
                covered[int(self.of[k])].update(range(int(self.at[k]), int(self.at[k]) + self.match))
        out = []
        for n, places in covered.items():
            key, item = self.items[n]
            if len(places) < coverage * len(item):  # tiles are made of seeds, so they cannot cover more
                continue
            tiles = tile(item, doc, self.match)
            total = sum(x[2] for x in tiles)
            if total >= coverage * len(item):
                out.append((key, len(item), total, len(tiles)))
        return sorted(out)


def _result(doc_ids: list, found: list[list[tuple[int, int, int, int]]]) -> dict:
    rows = [(d, *f) for d, fs in zip(doc_ids, found, strict=True) for f in fs]
    cols = list(zip(*rows, strict=True)) or [[]] * 5
    return dict(zip(("doc_id", "item_id", "item_tokens", "covered", "n_tiles"), map(list, cols), strict=True)) | {"coverage": [r[3] / r[2] for r in rows]}


@lru_cache(maxsize=2)
def _index(key: str, send, match: int) -> Index:
    return Index(send.value, match)


def forget() -> None:
    """Drop what a worker remembers for this operator."""
    _index.cache_clear()
    _hashes.clear()


def contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, match: int = MATCH, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """A row (FOUND) for each document and benchmark item that it covers."""
    items = benchmark.where("item_id is not null and text is not null").select("item_id", "text").distinct()
    if text_bytes(items) > broadcast_bytes:
        return _joined(docs, items, coverage, match)
    send, key = docs.sparkSession.sparkContext.broadcast(sorted((r["item_id"], r["text"]) for r in items.collect())), uuid.uuid4().hex

    def run(b: pa.RecordBatch) -> dict:
        hold("decontamination", forget)
        index = _index(key, send, match)
        return _result(b.column("doc_id").to_pylist(), [index.search(tokens(t), coverage) for t in texts(b)])

    return map_arrow(docs.select("doc_id", "text"), run, FOUND)


def _joined(docs: DataFrame, items: DataFrame, coverage: float, match: int) -> DataFrame:
    """The same for a benchmark of any size. A pair travels as the hash of its text and its item until its seeds may cover enough."""

    def item_seeds(b: pa.RecordBatch) -> dict:
        out: dict[str, list] = {k: [] for k in ("item_id", "item", "least", "seed")}
        for k, t in zip(b.column("item_id").to_pylist(), texts(b), strict=True):
            h = tokens(t)
            seeds = np.unique(shingle_hashes(h, match)).view(np.int64).tolist()
            least = max(1, math.ceil(coverage * len(h) / match - 1e-9))  # a seed covers at most `match` tokens, repeated ones more
            least = least if len(seeds) == len(h) - match + 1 else 1
            out["item_id"] += [k] * len(seeds)
            out["item"] += [_signed(xxhash.xxh64_intdigest(t.encode("utf-8", "surrogatepass")))] * len(seeds)
            out["least"] += [least] * len(seeds)
            out["seed"] += seeds
        return out

    seeds = map_arrow(items, item_seeds, "item_id long, item long, least int, seed long")
    common = seeds.groupBy("seed").agg(F.count("*").alias("n"))
    rarest = Window.partitionBy("item_id", "item").orderBy("n", "seed")
    count = Window.partitionBy("item_id", "item")
    index = seeds.join(common, "seed").withColumn("k", F.row_number().over(rarest)).withColumn("all", F.count("*").over(count))
    index = index.where(F.col("k") <= F.col("all") - F.col("least") + 1).select("item_id", "item", "least", "seed")  # the others are `least` - 1

    def doc_seeds(b: pa.RecordBatch) -> dict:
        keys, found = [], []
        for k, t in zip(b.column("copy").to_pylist(), texts(b), strict=True):
            s = np.unique(shingle_hashes(tokens(t), match)).view(np.int64).tolist()
            keys += [k] * len(s)
            found += s
        return {"copy": keys, "seed": found}

    whole = docs.where("text is not null").select("doc_id", F.xxhash64("text").alias("copy"), "text")
    once = whole.groupBy("copy").agg(F.first("text").alias("text"))
    hits = map_arrow(once, doc_seeds, "copy long, seed long", rows=128).join(index, "seed")
    # a pair lacks at most the `least` - 1 seeds that are not in the index
    pairs = hits.groupBy("copy", "item_id", "item", "least").agg(F.count("*").alias("n")).where("n >= 1").select("copy", "item_id", "item")
    texts_of = items.select("item_id", F.col("text").alias("item_text"))
    both = pairs.select("copy", "item_id").distinct().join(texts_of, "item_id").join(whole, "copy")

    def run(b: pa.RecordBatch) -> dict:
        found = [Index([(k, i)], match).search(tokens(t), coverage) for k, i, t in zip(b.column("item_id").to_pylist(), texts(b, "item_text"), texts(b), strict=True)]
        return _result(b.column("doc_id").to_pylist(), found)

    return map_arrow(both.select("doc_id", "item_id", "item_text", "text"), run, FOUND, rows=128)


def clean(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """docs without the contaminated ones, each row judged by its own text."""
    keyed = docs.select(F.xxhash64("text").alias("doc_id"), "text")
    gone = contaminated(keyed, benchmark, coverage).select(F.col("doc_id").alias("copy")).distinct()
    whole = docs.select(F.struct(*docs.columns).alias("doc"), F.xxhash64("text").alias("copy"))
    return whole.join(gone, "copy", "left_anti").select("doc.*")


def op3_decontamination(spark, sf_dir: str) -> DataFrame:
    """Every contaminated document with the items it covers."""
    docs, benchmark = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return contaminated(docs, benchmark)
