"""How filters interact: which filter removes what in each order of applying them.

Words are counted in a sparse document-term matrix. Each task cuts its documents into CSR shards of bounded text bytes,
each with the list of its own distinct words; the words of all shards meet once in a global dictionary (a shard ships
each of its words once, however often it occurs), and the dictionary's ids come back to replace the shard's column
numbers. Row sums of a shard are the documents' words, its row lengths their distinct words. A document then is a set
of failed filters; documents with equal sets are counted together, and all orders are read off those counts.

Cases: null text is the empty text (no words: it fails a minimum, but no share), a null source is the part ''; a text of
any length is one row of one shard; an empty table gives no rows. Equal rows count each. A text fails "identical to a
smaller doc_id's" by comparison with the smallest doc_id among rows of its text, so rows that share this id all pass;
a null doc_id is neither smaller nor greater. Several labels of one document count as one that has all their marks.
Other columns are ignored.
"""

from __future__ import annotations

import math
from array import array
from collections import Counter
from collections.abc import Iterator
from itertools import permutations
from zlib import crc32

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, StructField, StructType

from kbspark.llm.common import Steps, slices, table, total

SHARD_BYTES = 8 << 20  #: of text; a longer text is a shard by itself
BUCKET_WORDS = 1 << 20  #: words of all shards that are numbered together


def _pack(values, kind: str | None = None) -> bytes:
    """Numbers below 2^32 in the narrowest width, compressed."""
    a = np.asarray(values, np.int64)
    kind = kind or ("<u1" if (most := int(a.max(initial=0))) < 1 << 8 else "<u2" if most < 1 << 16 else "<u4")
    return kind.encode() + zstandard.compress(a.astype(kind).tobytes(), 1)


def unpack(blob: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(blob[3:]), blob[:3].decode())


def local_shards(docs: DataFrame, text: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """CSR shards of docs with column numbers of their own: shard, n_columns, words, indptr, indices, counts and row, the
    list of its documents' other columns (one struct each, so that no name can clash).

    A shard's words are numbered by their checksum, so the words of any checksum range are a slice of `words`.
    """
    docs = docs.select(F.struct(*(c for c in docs.columns if c != text)).alias("row"), F.col(text).cast("binary").alias("text"))
    schema = StructType([*StructType.fromDDL("shard long, n_columns long, words binary, indptr binary, indices binary, counts binary").fields, StructField("row", ArrayType(docs.schema["row"].dataType))])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId() << 33
        column: dict[bytes, int] = {}
        indptr, indices, counts, rows, held = [0], array("I"), array("I"), [], 0

        def close() -> pa.RecordBatch:
            words = list(column)
            order = np.argsort(np.fromiter(map(crc32, words), np.uint32, len(words)), kind="stable")
            number = np.empty(len(words), np.int64)
            number[order] = np.arange(len(words))
            blobs = [zstandard.compress(b" ".join([words[n] for n in order.tolist()]), 1), _pack(indptr), _pack(number[np.frombuffer(indices, np.uint32)]), _pack(np.frombuffer(counts, np.uint32))]
            beside = pa.concat_arrays(rows)
            own = [pa.array([shard], pa.int64()), pa.array([len(words)], pa.int64()), *(pa.array([x], pa.binary()) for x in blobs), pa.ListArray.from_arrays(pa.array([0, len(beside)], pa.int32()), beside)]
            return pa.RecordBatch.from_arrays([a.cast(f.type) for a, f in zip(own, arrow, strict=True)], schema=arrow)

        for b in slices(batches, 64):
            since, row = 0, b.column("row")
            for n, t in enumerate(b.column("text").to_pylist(), 1):
                found = Counter((t or b"").split())  # bytes split at \x20 and \x09 to \x0d only
                indices.extend([column.setdefault(w, len(column)) for w in found])
                counts.extend(found.values())
                indptr.append(len(indices))
                held += len(t or b"")
                if held >= shard_bytes:
                    rows.append(row.slice(since, n - since))
                    yield close()
                    column, indptr, indices, counts, rows, held, shard, since = {}, [0], array("I"), array("I"), [], 0, shard + 1, n
            if since < b.num_rows:
                rows.append(row.slice(since))
        if rows:
            yield close()

    return docs.mapInArrow(run, schema)


def _numbered(local: DataFrame, bits: int, dictionary: bool) -> DataFrame:
    """The words of local shards under global ids: (shard, bucket, ids) or, as a dictionary, (word, id).

    A bucket is a range of checksums. Each shard sends its slice of it once; the bucket's words are numbered as they
    come in order of their shards, so both forms agree. An id is the bucket (upper 32 bits) and the number in it.
    """

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1):
            shard, words = b.column("shard")[0].as_py(), zstandard.decompress(b.column("words")[0].as_py()).split(b" ")
            bucket = np.fromiter(map(crc32, words), np.uint32, len(words)).astype(np.int64) >> (32 - bits)
            first = np.flatnonzero(np.diff(bucket, prepend=-1))
            blobs = [zstandard.compress(b" ".join(words[i:j]), 1) for i, j in zip(first.tolist(), [*first[1:].tolist(), len(words)], strict=True)]
            yield pa.RecordBatch.from_pydict({"bucket": pa.array(bucket[first]), "shard": pa.array(np.full(len(first), shard)), "words": pa.array(blobs, pa.binary())})

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, known = None, {}
        for b in slices(batches, 64):
            ids, new = [], []
            for bucket, blob in zip(b.column("bucket").to_pylist(), b.column("words").to_pylist(), strict=True):
                if bucket != held:
                    held, known = bucket, {}
                words, before = zstandard.decompress(blob).split(b" "), len(known)
                ids.append(_pack([known.setdefault(w, len(known)) for w in words]))
                if dictionary:
                    new += [(w, (bucket << 32) | k) for w in words if (k := known[w]) >= before]
            if dictionary:
                yield pa.RecordBatch.from_pydict({"word": pa.array([w for w, _ in new], pa.binary()), "id": pa.array([k for _, k in new], pa.int64())})
            else:
                yield pa.RecordBatch.from_pydict({"shard": b.column("shard"), "bucket": b.column("bucket"), "ids": pa.array(ids, pa.binary())})

    slices_of = local.where("n_columns > 0").select("shard", "words").mapInArrow(deal, "bucket long, shard long, words binary")
    return slices_of.repartition("bucket").sortWithinPartitions("bucket", "shard").mapInArrow(number, "word binary, id long" if dictionary else "shard long, bucket long, ids binary")


def document_term_matrix(docs: DataFrame, steps: Steps, text: str = "text", shard_bytes: int = SHARD_BYTES, bucket_words: int = BUCKET_WORDS) -> tuple[DataFrame, DataFrame]:
    """(shards, dictionary): CSR shards (shard, indptr, indices, counts, row) whose indices are the ids of dictionary(word, id),
    with docs' other columns in row. A row's columns stand in the order in which its document brings them.

    A task numbers at most about bucket_words words at once, however many there are: their number sets the buckets.
    """
    local = steps.cut(local_shards(docs, text, shard_bytes), "local-shards")
    bits = max(0, math.ceil(math.log2(max(1, total(local, F.sum("n_columns")) / bucket_words))))
    ids = _numbered(local, bits, False).groupBy("shard").agg(F.array_sort(F.collect_list(F.struct("bucket", "ids"))).alias("ids"))
    both = local.select("shard", "indptr", "indices", "counts", "row").join(ids, "shard", "left")  # a shard of empty texts has no ids

    def globalise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1):
            to = [(x["bucket"] << 32) + unpack(x["ids"]).astype(np.int64) for x in b.column("ids")[0].as_py() or ()]
            indices = np.concatenate([np.empty(0, np.int64), *to])[unpack(b.column("indices")[0].as_py())]
            blobs = {"indices": indices.astype("<i8"), **{c: unpack(b.column(c)[0].as_py()).astype("<i8") for c in ("indptr", "counts")}}
            yield pa.RecordBatch.from_pydict({"shard": b.column("shard"), **{c: pa.array([blobs[c].tobytes()], pa.binary()) for c in ("indptr", "indices", "counts")}, "row": b.column("row")})

    return both.mapInArrow(globalise, both.drop("ids").schema), _numbered(local, bits, True)


def row_statistics(shards: DataFrame) -> DataFrame:
    """A row for each document of the shards: row (its other columns), n_words (row sum) and n_distinct (row length)."""
    schema = StructType([StructField("row", shards.schema["row"].dataType.elementType), *StructType.fromDDL("n_words long, n_distinct long").fields])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1):
            indptr, counts = np.frombuffer(b.column("indptr")[0].as_py(), "<i8"), np.frombuffer(b.column("counts")[0].as_py(), "<i8")
            indices = np.frombuffer(b.column("indices")[0].as_py(), "<i8")
            total = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
            cells = np.concatenate([[0], np.cumsum(indices >= 0)])
            own = [b.column("row").flatten(), pa.array(total[indptr[1:]] - total[indptr[:-1]]), pa.array(cells[indptr[1:]] - cells[indptr[:-1]])]
            yield pa.RecordBatch.from_arrays([a.cast(f.type) for a, f in zip(own, arrow, strict=True)], schema=arrow)

    return shards.mapInArrow(run, schema)


def without_later_copies(rows: DataFrame, key: str, by: list[str]) -> DataFrame:
    """rows(doc_id, key, *by) counted: key's groups by `by`, with n (rows) and later (rows of a greater doc_id than the key's smallest).

    Rows of one key are first counted by doc_id and then by group, so a key that a third of all rows share is summed
    where it lies and never meets as rows.
    """
    each = rows.groupBy(key, *by, "doc_id").agg(F.count("*").alias("k"))
    known = F.col("doc_id").isNotNull()
    groups = each.groupBy(key, *by).agg(F.sum("k").alias("n"), F.coalesce(F.sum(F.when(~known, F.col("k"))), F.lit(0)).alias("n_null"), F.min(F.when(known, F.struct("doc_id", "k"))).alias("least"))
    smallest = groups.groupBy(key).agg(F.min("least.doc_id").alias("smallest"))
    first = F.when(F.col("least.doc_id") == F.col("smallest"), F.col("least.k")).otherwise(0)
    return groups.join(smallest, key).select(key, *by, "n", (F.col("n") - F.col("n_null") - first).alias("later"))


def audit(counts: DataFrame, filters: str) -> DataFrame:
    """counts(part, fails, n, good, toxic), fails being the letters of the failed filters, as one row for each part, order
    of the filters and step."""
    counts = counts.groupBy("part", "fails").agg(*(F.sum(c).alias(c) for c in ("n", "good", "toxic")))
    orders = ",".join(map("".join, permutations(filters)))
    n_orders = orders.count(",") + 1
    steps = counts.withColumn("filter_order", F.explode(F.split(F.lit(orders), ","))).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(filters)))))
    steps = steps.withColumn("letter", F.expr("substring(filter_order, step, 1)")).withColumn("before", F.expr("substring(filter_order, 1, step - 1)"))
    fails, earlier = F.expr("contains(fails, letter)"), F.expr("length(translate(before, fails, '')) < step - 1")
    # Of the orders, every failed filter comes first in equally many: it removes the document in these.
    share = F.when(fails, F.col("n") * n_orders / F.length("fails")).otherwise(0)
    count = lambda when, what, name: F.sum(F.when(when, F.col(what)).otherwise(0)).alias(name)
    return steps.groupBy("part", "filter_order", "step").agg(
        count(~fails & ~earlier, "n", "kept"), count(fails & ~earlier, "n", "removed"), count(fails & earlier, "n", "redundant"), count(F.col("fails") == F.col("letter"), "n", "unique_fails"),
        count(fails & ~earlier, "good", "good_lost"), count(fails & ~earlier, "toxic", "toxic_lost"), F.sum(share).cast("long").alias("shapley"),
    )


def failures(docs: DataFrame, labels: DataFrame, steps: Steps) -> DataFrame:
    """counts for audit() of filters A to E on docs(doc_id, text, source)."""
    text = F.coalesce("text", F.lit(""))
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    flagged = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("digest"), (100 * capitals > 2 * F.length(text)).alias("c"), text.rlike("[#$%&*|]").alias("d"), text.alias("text"))
    shards, _ = document_term_matrix(flagged, steps)
    rows = row_statistics(shards)
    letters = F.concat(*(F.when(test, letter).otherwise("") for letter, test in (("A", F.col("n_words") < 200), ("B", 100 * F.col("n_distinct") < 50 * F.col("n_words")), ("C", F.col("c")), ("D", F.col("d")))))
    marks = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    marked = rows.select("row.*", "n_words", "n_distinct").select("doc_id", "part", "digest", letters.alias("fails")).join(marks, "doc_id", "left").fillna(False, ["good", "toxic"])
    counted = without_later_copies(marked, "digest", ["part", "fails", "good", "toxic"])
    both = F.explode(F.array(F.struct("fails", (F.col("n") - F.col("later")).alias("n")), F.struct(F.concat("fails", F.lit("E")).alias("fails"), F.col("later").alias("n"))))
    each = counted.select("part", "good", "toxic", both.alias("x")).select("part", "x.fails", "x.n", *(F.when(F.col(c), F.col("x.n")).otherwise(0).alias(c) for c in ("good", "toxic")))
    return each.groupBy("part", "fails").agg(*(F.sum(c).alias(c) for c in ("n", "good", "toxic")))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract op12: five filters over all documents, in all orders, for each source."""
    steps = Steps(spark)
    counts = failures(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), steps)
    result = Steps(spark).cut(counts, "filter-counts")
    steps.done()
    return audit(result, "ABCDE")


SQL = r"""
WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
m AS (SELECT doc_id, bool_or(quality IS NOT DISTINCT FROM 1) AS good, bool_or(toxic IS NOT DISTINCT FROM 1) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
 CASE WHEN len(w) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END || CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]+', '', 'g')) > 2 * length(text) THEN 'C' ELSE '' END
 || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY text) THEN 'E' ELSE '' END AS fails
 FROM t LEFT JOIN m USING (doc_id)),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM l a, l b, l c, l d, l e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT filter_order, step, filter_order[step:step] AS letter, filter_order[1:step - 1] AS before FROM o, (SELECT unnest(range(1, 6)) AS step)),
x AS (SELECT part, filter_order, step, letter, good, toxic, contains(fails, letter) AS fails, fails = letter AS alone, length(translate(before, fails, '')) < step - 1 AS earlier FROM f, s),
r AS (SELECT part, filter_order, CAST(step AS INT) AS step, letter, count_if(NOT fails AND NOT earlier) AS kept, count_if(fails AND NOT earlier) AS removed, count_if(fails AND earlier) AS redundant, count_if(alone) AS unique_fails,
 count_if(fails AND NOT earlier AND good) AS good_lost, count_if(fails AND NOT earlier AND toxic) AS toxic_lost FROM x GROUP BY ALL)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
 CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley FROM r"""
