"""Approximate nearest neighbours: low-dimensional stable projections, a kd-tree, and a chi-square stop.

Vectors are scaled to length 1, so the largest cosine is the smallest distance. M Gaussian projections
(2-stable: a projected squared distance over the true one follows a chi-square law with M degrees of
freedom) are indexed by a kd-tree. A query takes projected neighbours in order of their distance, leaf by
leaf, and verifies them on the original vectors. With d the distance of the last neighbour needed so far and r
the projected distance all unseen rows exceed, the search ends once chi2_M(r^2 / d^2) >= CONFIDENCE: an unseen
row nearer than d would then have stayed hidden with a chance below 1 - CONFIDENCE. Every row is indexed.

The tree's upper levels are fitted on at most SAMPLE projected rows and cut down to cells of about CELL_ROWS
rows; Spark deals all rows into the cells, whose boxes span every row that lies in them. A query is first
sent to its HOME nearest cells, then, with the distance found there, to every further cell that the stopping
test does not rule out; inside a cell the lower levels of the tree are built and searched. A cell of many rows
or queries is cut into blocks of bounded size. Rows of equal vectors, and queries of equal vectors, are searched
once: of equal vectors only the k + 1 smallest ids can be among a query's k best, as ties go to the smaller id.

Cases: vectors that are null, of length zero, or hold null or non-finite components take no part, nor do rows
without an id; vectors of another length than a query's are no candidates of it; ties go to the smaller id; with fewer candidates
than k all are returned; rows equal in id and vector are one candidate, those of one id and other vectors are
separate ones (a query skips every row of its own id), and a query id with several vectors has the k best of
all of them; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kbspark.llm.common import Steps, map_arrow

M = 8
LEAF = 256
CONFIDENCE = 0.99
SAMPLE, CELL_ROWS, HOME = 100_000, 8_192, 2
BLOCK_ROWS, BLOCK_QUERIES = 20_000, 1_000
SALT = 16  #: parts into which the queries of one vector are dealt


def chi_square(x: float, m: int = M) -> float:
    """The distribution function for an even number of degrees of freedom."""
    term = total = 1.0
    for n in range(1, m // 2):
        term *= x / 2 / n
        total += term
    return 1 - math.exp(-x / 2) * total


def _threshold(confidence: float) -> float:
    """The x with chi_square(x) = confidence."""
    lo, hi = 0.0, 200.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi_square(mid) < confidence else (lo, mid)
    return hi


class Tree:
    """A kd-tree: median cuts of the widest side, with the box of each node."""

    def __init__(self, points: np.ndarray):
        self.points, self.order = points, np.arange(len(points))
        self.low: list[np.ndarray] = []
        self.high: list[np.ndarray] = []
        self.span: list[tuple[int, int]] = []
        self.child: list[tuple[int, int] | None] = []
        self._grow(0, len(points))

    def _grow(self, a: int, b: int) -> int:
        n, p = len(self.span), self.points[self.order[a:b]]
        self.low.append(p.min(axis=0))
        self.high.append(p.max(axis=0))
        self.span.append((a, b))
        self.child.append(None)
        if b - a > LEAF and (side := int(np.argmax(self.high[n] - self.low[n]))) >= 0 and self.high[n][side] > self.low[n][side]:
            mid = (b - a) // 2
            self.order[a:b] = self.order[a:b][np.argpartition(p[:, side], mid)]
            self.child[n] = (self._grow(a, a + mid), self._grow(a + mid, b))
        return n

    def leaves(self, q: np.ndarray):
        """(squared distance that all later rows reach, first and last place in the order), nearest boxes first."""
        gap = lambda n: float((np.maximum(0, np.maximum(self.low[n] - q, q - self.high[n])) ** 2).sum())
        heap = [(gap(0), 0)]
        while heap:
            r, n = heapq.heappop(heap)
            if self.child[n]:
                for c in self.child[n]:
                    heapq.heappush(heap, (gap(c), c))
            else:
                yield r, *self.span[n]


def projection(dim: int, m: int = M) -> np.ndarray:
    return np.random.default_rng(20140814 + dim).standard_normal((dim, m))


def unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.sqrt((vectors * vectors).sum(axis=1))[:, None]


def matrix(column) -> np.ndarray:
    """A column of arrays of one length as doubles."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


class Cells:
    """The tree's upper levels: for each vector length, median cuts of a sample of projected rows down to `leaf` rows."""

    def __init__(self, sample: dict[int, np.ndarray], leaf: int):
        self.cuts: list[tuple[int, float, int, int] | None] = []  # side, value, nodes below and above; None: a cell
        self.root = {dim: self._grow(points, max(1, leaf)) for dim, points in sample.items()}

    def _grow(self, p: np.ndarray, leaf: int) -> int:
        n = len(self.cuts)
        self.cuts.append(None)
        if len(p) > leaf:
            side = int(np.argmax(p.max(axis=0) - p.min(axis=0)))
            at = float(np.median(p[:, side]))
            low = p[:, side] < at
            if low.any():
                self.cuts[n] = (side, at, self._grow(p[low], leaf), self._grow(p[~low], leaf))
        return n

    def of(self, dim: int, p: np.ndarray) -> np.ndarray:
        """The cell of each projected row; lengths that the sample lacks are one cell, -1."""
        out = np.full(len(p), -1)
        todo = [(self.root[dim], np.arange(len(p)))] if dim in self.root else []
        while todo:
            n, rows = todo.pop()
            if cut := self.cuts[n]:
                low = p[rows, cut[0]] < cut[1]
                todo += [(cut[2], rows[low]), (cut[3], rows[~low])]
            else:
                out[rows] = n
        return out


def project(df: DataFrame, cells: Cells | None = None) -> DataFrame:
    """df with p, the projection of the unit vector v, and cell."""
    names = df.columns

    def run(b: pa.RecordBatch) -> dict:
        v, dims = b.column("v"), b.column("dim").to_numpy(zero_copy_only=False)
        p, cell = np.zeros((b.num_rows, M)), np.full(b.num_rows, -1)
        for dim in np.unique(dims).tolist():
            at = np.flatnonzero(dims == dim)
            p[at] = unit(matrix(v.take(pa.array(at)))) @ projection(dim)
            if cells:
                cell[at] = cells.of(dim, p[at])
        return {**{c: b.column(c) for c in names}, "p": pa.array(list(p)), "cell": cell.astype(np.int32)}

    schema = ", ".join(f"{n} {t}" for n, t in df.dtypes)
    return map_arrow(df, run, schema + ", p array<double>, cell int", 4096)


def search_block(ids: np.ndarray, vectors: np.ndarray, queries: np.ndarray, own: list[int | None], best: np.ndarray, need: int, confidence: float) -> list[tuple[int, int, float]]:
    """(number of the query, id, cosine): of rows at least as near as best, each query's `need` best found in the block.

    best is the cosine of the last neighbour needed that other blocks have found, -inf if they found too few."""
    length = np.sqrt((vectors * vectors).sum(axis=1))
    rows_unit = vectors / length[:, None]
    a = projection(vectors.shape[1])
    tree, stop = Tree(rows_unit @ a), _threshold(confidence)
    rows_unit, named = rows_unit[tree.order], ids[tree.order]  # a leaf's rows lie together
    out = []
    for at, q in enumerate(queries):
        qn = math.sqrt(float((q * q).sum()))
        qu = q / qn
        pool_s, pool_at, kth = np.zeros(0), np.zeros(0, np.int64), float(best[at])
        for r, x, y in tree.leaves(qu @ a):
            if r >= stop * max(1e-12, 2 - 2 * kth):
                break
            s = rows_unit[x:y] @ qu
            near = np.flatnonzero(s >= kth - 1e-9)  # what may be among the best, with room for rounding
            if own[at] is not None:
                near = near[named[x + near] != own[at]]
            if len(near):
                pool_s, pool_at = np.concatenate([pool_s, s[near]]), np.concatenate([pool_at, x + near])
                if len(pool_s) >= need:
                    kth = max(kth, float(np.partition(pool_s, -need)[-need]))
                    keep = pool_s >= kth - 1e-9
                    pool_s, pool_at = pool_s[keep], pool_at[keep]
        rows = tree.order[pool_at]
        exact, found = (vectors[rows] * q).sum(axis=1) / (length[rows] * qn), ids[rows]
        out += [(at, int(found[n]), float(exact[n])) for n in np.lexsort((found, -exact))[:need]]
    return out


def usable(df: DataFrame, column: str) -> DataFrame:
    """Rows whose vector is whole: not null, finite, of a length above zero; floats and doubles as they are, else as doubles."""
    v = F.col(column)
    if df.schema[column].dataType.elementType.typeName() not in ("float", "double"):
        df = df.withColumn(column, F.transform(v, lambda x: x.cast("double")))
    return df.where(v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0))


def keyed(df: DataFrame) -> DataFrame:
    """df with the vector's length and a hash of 128 bits."""
    return df.withColumn("dim", F.size("v")).withColumn("h1", F.xxhash64("v")).withColumn("h2", F.xxhash64(F.lit(20140814), "v"))


def targets(asks: DataFrame, boxes: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]], first: bool, confidence: float) -> DataFrame:
    """asks with a row for each cell to search: the HOME nearest ones first, later all others that the stop leaves.

    boxes: of each vector length the cells, and the lows and highs of their rows."""
    stop, kept = _threshold(confidence), [c for c in asks.columns if c != "cell"]

    def run(b: pa.RecordBatch) -> dict:
        row, cell = [], []
        p, dims, kth = matrix(b.column("p")), b.column("dim").to_pylist(), b.column("kth").to_pylist()
        for at, dim in enumerate(dims):
            if dim not in boxes:
                continue
            names, low, high = boxes[dim]
            gap = (np.maximum(0, np.maximum(low - p[at], p[at] - high)) ** 2).sum(axis=1)
            order = np.argsort(gap, kind="stable")
            order = order[:HOME] if first else order[HOME:]
            if not first:
                order = order[gap[order] < stop * max(1e-12, 2 - 2 * kth[at])]
            row += [at] * len(order)
            cell += names[order].tolist()
        taken = b.take(pa.array(row, pa.int64()))
        return {**{c: taken.column(c) for c in kept}, "cell": pa.array(cell, pa.int32())}

    return map_arrow(asks, run, ", ".join(f"{n} {t}" for n, t in asks.dtypes), 256)


def search_cells(rows: DataFrame, asks: DataFrame, cells: DataFrame, need: int, confidence: float) -> DataFrame:
    """h1, h2, own, dim, vec_id, score: what the given queries find in the cells they were sent to."""
    busy = asks.groupBy("dim", "cell").agg(F.count("*").alias("n"))
    at = F.broadcast(cells.join(busy, ["dim", "cell"]).select("dim", "cell", "parts", F.ceil(F.col("n") / BLOCK_QUERIES).cast("int").alias("deals")))  # at most SAMPLE rows and one for each vector length
    spread = lambda name, n: F.explode(F.sequence(F.lit(0), F.col(n) - 1)).alias(name)
    hashed = lambda n, *c: F.pmod(F.xxhash64(*c), F.col(n)).cast("int")
    c = rows.join(at, ["dim", "cell"]).select("dim", "cell", hashed("parts", "vec_id", "h1").alias("i"), spread("j", "deals"), "v", "vec_id", F.lit(None).cast("long").alias("h1"), F.lit(None).cast("long").alias("h2"), F.lit(None).cast("string").alias("own"), F.lit(None).cast("double").alias("kth"))
    q = asks.join(at, ["dim", "cell"]).select("dim", "cell", spread("i", "parts"), hashed("deals", "h1", "h2", "own").alias("j"), "v", F.lit(None).cast("long").alias("vec_id"), "h1", "h2", "own", "kth")
    schema = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("own", pa.string()), ("dim", pa.int32()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def run(g: pa.Table) -> pa.Table:
        asks = g.column("vec_id").is_null()
        x, y = g.filter(pc.invert(asks)), g.filter(asks)
        found = []
        if len(x) and len(y):
            own = [int(o) if o else None for o in y.column("own").to_pylist()]
            found = search_block(x.column("vec_id").to_numpy(), matrix(x.column("v")), matrix(y.column("v")), own, y.column("kth").to_numpy(), need, confidence)
        taken = y.take(pa.array([f[0] for f in found], pa.int64()))
        return pa.table([*(taken.column(n) for n in ("h1", "h2", "own", "dim")), pa.array([f[1] for f in found], pa.int64()), pa.array([f[2] for f in found], pa.float64())], schema=schema)

    return c.unionByName(q).groupBy("dim", "cell", "i", "j").applyInArrow(run, "h1 long, h2 long, own string, dim int, vec_id long, score double")


def nearest(queries: DataFrame, rows: DataFrame, k: int = 5, confidence: float = CONFIDENCE, cell_rows: int = CELL_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score from queries(query_id, v) and rows(vec_id, v)."""
    steps, need, key = Steps(rows.sparkSession), k + 1, ["h1", "h2", "own", "dim"]
    rows = keyed(usable(rows.where("vec_id is not null").select("vec_id", "v"), "v"))
    queries = keyed(usable(queries.where("query_id is not null").select("query_id", "v"), "v"))

    same = Window.partitionBy("h1", "h2", "dim").orderBy("vec_id")
    one = steps.cut(rows.withColumn("_n", F.dense_rank().over(same)).where(F.col("_n") <= need).drop("_n").dropDuplicates(["h1", "h2", "dim", "vec_id"]), "ann-rows")
    n = one.count()
    rate = min(1.0, 1.1 * SAMPLE / max(1, n))
    picked = one.where(F.pmod(F.xxhash64("h2", "vec_id"), F.lit(1 << 20)) < int(rate * (1 << 20)) + 1)
    sample: dict[int, list] = {}
    for r in project(picked).orderBy("h1", "h2", "vec_id").limit(SAMPLE).select("dim", "p").collect():
        sample.setdefault(r["dim"], []).append(r["p"])
    taken = sum(map(len, sample.values()))
    dealt = steps.cut(project(one, Cells({d: np.array(p) for d, p in sample.items()}, taken * cell_rows // max(1, n))), "ann-cells")
    steps.drop(one)

    sides = [f(F.col("p")[s]).alias(f"{f.__name__}{s}") for f in (F.min, F.max) for s in range(M)]
    cells = steps.cut(dealt.groupBy("dim", "cell").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("parts"), *sides), "ann-boxes")
    boxes: dict[int, list] = {}
    for r in cells.orderBy("dim", "cell").collect():
        boxes.setdefault(r["dim"], []).append((r["cell"], [r[f"min{s}"] for s in range(M)], [r[f"max{s}"] for s in range(M)]))
    spans = {d: tuple(np.array(x) for x in zip(*b, strict=True)) for d, b in boxes.items()}

    often = rows.groupBy(F.col("vec_id").alias("query_id")).count().where("count > 1").select("query_id", F.lit(True).alias("_often"))
    asked = steps.cut(queries.join(often, "query_id", "left").withColumn("own", F.when(F.col("_often"), F.col("query_id").cast("string")).otherwise("")).drop("_often"), "ann-queries")
    asks = steps.cut(project(asked.dropDuplicates(key).drop("query_id").withColumn("kth", F.lit(float("-inf")))), "ann-asks")
    found = steps.cut(search_cells(dealt, steps.cut(targets(asks, spans, True, confidence), "ann-targets"), cells, need, confidence), "ann-found")
    if any(len(c) > HOME for c, _, _ in spans.values()):
        last = found.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("score"), "vec_id"))).where(F.col("_n") == need).select(*key, F.col("score").alias("_kth"))
        asks = asks.join(last, key, "left").withColumn("kth", F.coalesce("_kth", "kth")).drop("_kth")
        more = steps.cut(targets(asks, spans, False, confidence), "ann-targets")
        found = found.unionByName(steps.cut(search_cells(dealt, more, cells, need, confidence), "ann-found"))

    best = found.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("score"), "vec_id"))).where(F.col("_n") <= need).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    pairs = asked.select("query_id", *key, F.pmod(F.xxhash64("query_id"), F.lit(SALT)).cast("int").alias("_salt")).join(best, [*key, "_salt"]).where("query_id <> vec_id")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    result = Steps(steps.spark).cut(pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"), "ann-nearest")
    steps.done()
    return result


def op2_ann(spark, sf_dir: str) -> DataFrame:
    """Contract op2 over the whole table."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.col("embedding").alias("v"))
    return nearest(rows.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id"), rows)
