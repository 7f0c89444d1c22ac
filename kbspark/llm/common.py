"""Helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see: spark.checkpoint.dir; an own one where that is unset and all runs in one process (tests)."""
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not d:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        d = tempfile.mkdtemp(prefix="spark-checkpoint-")
        spark.sparkContext.setCheckpointDir(d)
    return d.rstrip("/")


def new_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/kbspark-{what}-{uuid.uuid4().hex}"


def cut(df: DataFrame, what: str) -> DataFrame:
    """Write a table to the shared folder and read it back, so that later steps never recompute it."""
    path = new_path(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Steps:
    """The tables that one job keeps in the shared folder between its steps; done() deletes them.

    A step's table is written in whole before the next reads it, so a lost executor costs a step at most. Only
    what nobody reads any more may be dropped: a job drops its steps once its result is a table of its own.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def cut(self, df: DataFrame, what: str) -> DataFrame:
        path = new_path(self.spark, what)
        df.write.parquet(path)
        table = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(table)] = (table, path)
        return table

    def drop(self, *tables: DataFrame) -> None:
        """Delete the given tables now."""
        for t in tables:
            path = self.paths.pop(id(t))[1]
            at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)

    def tables(self) -> list[DataFrame]:
        return [t for t, _ in self.paths.values()]

    def done(self) -> None:
        self.drop(*self.tables())
        tidy(self.spark)


def tidy(spark: SparkSession) -> None:
    """Let Spark drop what no DataFrame refers to any more: its cleaner removes shuffle files, broadcasts and their
    records on the driver only once the driver's JVM has collected them, which a large heap may put off for long."""
    gc.collect()
    spark._jvm.System.gc()


def within(docs: DataFrame, ids: DataFrame, key: str = "doc_id", most: int = 2_000_000) -> DataFrame:
    """The rows of docs whose key stands in ids (a table of its own, distinct): sent to the executors if there are
    at most `most` ids (16 MB of numbers), else by a shuffled join; the rows are the same."""
    return docs.join(F.broadcast(ids) if ids.count() <= most else ids, key, "left_semi")


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most `rows`, so that long texts are not all Python objects at once."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


_holder: dict = {"name": None, "forget": None}


def hold(name: str, forget: Callable[[], None]) -> None:
    """Called in a worker by an operator that remembers things there from one task to the next: what another operator
    left in this worker goes, so that a worker that serves many stages holds one operator's memory at a time."""
    if _holder["name"] != name:
        if _holder["forget"]:
            _holder["forget"]()
        _holder.update(name=name, forget=forget)


def give_back() -> None:
    """Return what a task has freed to the system: workers outlive their tasks, and allocators keep freed pages."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc only
        trim(0)


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], dict], schema, rows: int = 512) -> DataFrame:
    """mapInArrow with a function from a small batch to columns; the schema is a Spark DDL string or type."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema) if isinstance(schema, str) else schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, rows):
            out = fn(b)
            if out is not None:
                yield pa.RecordBatch.from_arrays([out[f.name].cast(f.type) if isinstance(out[f.name], pa.Array) else pa.array(out[f.name], f.type) for f in arrow], schema=arrow)
        b = out = None
        give_back()

    return df.mapInArrow(run, schema)


def map_groups(df: DataFrame, keys: list[str], fn: Callable[[list[tuple]], list[tuple]], schema: str) -> DataFrame:
    """fn over the rows of each group, one group in memory at a time: rows are dealt and sorted by the keys.

    For many small groups this costs far less than a pandas frame for each.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow, names = to_arrow_schema(StructType.fromDDL(schema)), df.columns
    at = [names.index(k) for k in keys]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], f.type) for n, f in enumerate(arrow)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, group, out = None, [], []
        for b in batches:
            for row in zip(*(b.column(n).to_pylist() for n in names), strict=True):
                key = tuple(row[n] for n in at)
                if key != held:
                    if group:
                        out += fn(group)
                    held, group = key, []
                group.append(row)
                if len(out) >= 20_000:
                    yield batch(out)
                    out = []
        if group:
            out += fn(group)
        if out:
            yield batch(out)
        b = row = group = out = None
        give_back()

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The column as strings; null becomes the empty text."""
    return [t or "" for t in batch.column(column).to_pylist()]


def total(df: DataFrame, expr) -> int:
    """One number from the whole table (an aggregate, so one row reaches the driver)."""
    v = df.agg(expr.alias("v")).first()["v"]
    return int(v or 0)


def text_bytes(df: DataFrame, column: str = "text") -> int:
    return total(df, F.sum(F.octet_length(column)))
