"""Reading corpora, images and gold questions; writing chunks, items and snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

GOLD = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("question", T.StringType()), T.StructField("item_name", T.StringType()), T.StructField("category", T.StringType()),
    T.StructField("gold_titles", T.ArrayType(T.StringType())), T.StructField("gold_chunk_ids", T.ArrayType(T.StringType())), T.StructField("gold_answer", T.StringType()),
])
IMAGE_ENDINGS = ("jpg", "jpeg", "png", "gif", "bmp", "webp")


def read_markdown(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(docs, rejected): whole .md files under a folder, titled by their stem; other endings are rejected."""
    files = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("md_content"))
    name = F.regexp_extract(F.url_decode("path"), r"([^/]+)$", 1)
    files = files.withColumn("suffix", F.lower(F.regexp_extract(name, r"(\.[^.]+)$", 1))).withColumn("file_title", F.regexp_replace(name, r"\.[^.]+$", ""))
    good = F.col("suffix") == ".md"
    docs = files.where(good).select(F.sha2("path", 256).alias("doc_id"), "path", "file_title", "md_content")
    return docs, files.where(~good).select("path", "suffix", F.lit("not a Markdown file").alias("reason"))


def read_images(spark: SparkSession, path: str, endings: tuple[str, ...] = IMAGE_ENDINGS) -> DataFrame:
    """path, img_name, payload (base64) of image files; endings are matched as written."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    return files.where(F.regexp_extract(name, r"\.([^.]+)$", 1).isin(*endings)).select("path", name.alias("img_name"), F.base64("content").alias("payload"))


def check_gold(gold: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(gold, rejected): rows with a question, an item and gold ids; ids as distinct strings in order."""
    there = lambda c: F.coalesce(F.trim(c), F.lit("")) != ""
    ids = F.array_distinct(F.filter("gold_chunk_ids", lambda x: F.coalesce(F.trim(x), F.lit("")) != ""))
    gold = gold.withColumn("gold_chunk_ids", F.coalesce(ids, F.array().cast("array<string>")))
    fine = there(F.col("question")) & there(F.col("item_name")) & (F.size("gold_chunk_ids") > 0)
    return gold.where(fine), gold.where(~fine)


def read_gold(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """A JSON list of gold questions, checked."""
    return check_gold(spark.read.schema(GOLD).json(path, multiLine=True))


def _row_bytes(rows: DataFrame):
    """About how many bytes a row has: its strings and binaries, and eight for every other value it holds."""
    total = F.lit(0).cast("long")
    for f in rows.schema:
        kind, c = f.dataType, F.col(f"`{f.name}`")
        size = F.octet_length(c) if isinstance(kind, T.StringType | T.BinaryType) else 8 * F.size(c) if isinstance(kind, T.ArrayType) else 16 * F.size(c) if isinstance(kind, T.MapType) else F.lit(8)
        total = total + F.greatest(F.coalesce(size, F.lit(0)), F.lit(0))
    return total


def _hashed(kind: T.DataType) -> bool:
    """Whether Spark hashes values of the type (maps and variants have no hash)."""
    return not any(x in kind.simpleString() for x in ("map<", "variant"))


def write_chunks(chunks: DataFrame, path: str, mode: str = "append", bytes_per_file: int = 128 << 20) -> None:
    """Add chunks to the store, or start it anew (mode 'overwrite'); one folder for each item.

    An item's rows are dealt to as many tasks as it has files of about bytes_per_file; a small item is one file. They are dealt by
    a hash of what can be hashed of a row (chunks carry sparse vectors, which are maps); rows equal in all that go to one file.
    """
    files = chunks.groupBy(F.col("item_name").alias("_item")).agg(F.greatest(F.lit(1), F.ceil(F.sum(_row_bytes(chunks)) / bytes_per_file)).alias("_files"))
    by = [F.col(f"`{f.name}`") for f in chunks.schema if _hashed(f.dataType)]
    dealt = chunks.join(files, F.col("item_name").eqNullSafe(F.col("_item"))).withColumn("_salt", F.pmod(F.xxhash64(*by), F.col("_files")))
    dealt.repartition("item_name", "_salt").select(*chunks.columns).write.mode(mode).partitionBy("item_name").parquet(path)


def replace_items(rows: DataFrame, path: str, key: str = "item_name") -> None:
    """Replace all stored rows of the items that occur in `rows`; a second run changes nothing."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def new_files(files: DataFrame, ledger: DataFrame) -> DataFrame:
    """Files(path, content) whose content no completed import has, each content once (first path)."""
    hashed = files.withColumn("sha256", F.sha2("content", 256))
    done = ledger.where("status = 'completed'").select("sha256").distinct()
    fresh = hashed.join(done, "sha256", "left_anti")
    first = fresh.groupBy("sha256").agg(F.min("path").alias("path"))
    return fresh.join(first, ["sha256", "path"], "left_semi").dropDuplicates(["sha256"])


def clear_history(messages: DataFrame, state: DataFrame, session_ids: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(messages, state, counts) with the sessions' rows gone, and how many messages went from each session."""
    gone = session_ids.select("session_id").distinct()
    counts = messages.join(gone, "session_id", "left_semi").groupBy("session_id").agg(F.count("*").alias("deleted"))
    return messages.join(gone, "session_id", "left_anti"), state.join(gone, "session_id", "left_anti"), counts
