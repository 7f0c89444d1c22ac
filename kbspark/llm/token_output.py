"""Token-ID output: every document's ids in ascending doc_id order, in files of packed segments.

Documents are put in doc_id order by a range partitioning, encoded where they lie, and cut into
segments of about `segment_ids` ids (patched frame of reference, see pfor.py). The segments are the
rows of a Parquet table, so that Spark's commit protocol and any Hadoop file system apply; each row's
`payload` is a self-contained file image with its document index and block starts.

Words (the vocabulary's own pre-tokens) are encoded by the tokenizers library once for each worker and
kept; a text with characters at or above U+0250 or with the string of a special token is encoded whole.

Cases: null text is the empty text (only the end id); empty table gives no rows; repeated rows and ids
each keep their own place (ties in doc_id lie side by side in no fixed order); other columns are ignored;
a document of any length lies in one segment; rows with a null doc_id come first.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kbspark.llm import pfor
from kbspark.llm.charset import BYTE_SPLIT, LATER, byte_alphabet
from kbspark.llm.common import new_path, slices

NO_ID = -(1 << 63)  #: stands for a null doc_id in a file
KEPT_WORDS = 800_000  #: words a worker remembers before it starts anew


class _Words(dict):
    """Pre-token to its ids as bytes. A pre-token stands for itself, so the library's merges run on it directly."""

    def __init__(self, tokenizer, kind: str):
        super().__init__()
        self.merge, self.kind = tokenizer.model.tokenize, kind
        self.alphabet = {b: ord(c) for b, c in byte_alphabet().items()}

    def __missing__(self, word: str) -> bytes:
        if len(self) > KEPT_WORDS:
            self.clear()
        found = self.merge(word.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.alphabet))
        ids = self[word] = array(self.kind, [x.id for x in found]).tobytes()
        return ids


class ByteEncoder:
    """Exact ids of the byte-level vocabulary, as little-endian unsigned 16-bit (or 32-bit) strings."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_padding()
        self.tok.no_truncation()
        self.kind = "<u2" if self.tok.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4"
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.known = _Words(self.tok, "H" if self.kind == "<u2" else "I")

    def _whole(self, text: str) -> bool:
        """Whether a text has characters or special strings that the split by words does not cover."""
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            if LATER.search(text):
                return True
        return any(s in text for s in self.special)

    def encode(self, text: str) -> np.ndarray:
        if self._whole(text):
            return np.array(self.tok.encode(text, add_special_tokens=False).ids, self.kind)
        return np.frombuffer(b"".join(map(self.known.__getitem__, BYTE_SPLIT.findall(text))), self.kind)

    def encode_many(self, texts: list[str]) -> list[np.ndarray]:
        return [self.encode(t) for t in texts]


@lru_cache(maxsize=2)
def byte_encoder(path: str) -> ByteEncoder:
    return ByteEncoder(path)


SEGMENTS = "part int, seg int, n_docs long, n_ids long, payload binary"


def write_token_files(docs: DataFrame, path: str, vocabulary: str, end_id: int = 0, segment_ids: int = 1 << 20, partitions: int | None = None) -> None:
    """Write the ids of docs(doc_id, text) to `path` in ascending doc_id order."""
    spark = docs.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, part, seg = byte_encoder(vocabulary), TaskContext.get().partitionId(), 0
        ids: list[np.ndarray] = []
        keys: list[int] = []
        lengths: list[int] = []
        held = 0
        end = np.array([end_id], enc.kind)

        def segment() -> pa.RecordBatch:
            data = pfor.encode(np.array(keys, np.int64), np.array(lengths, np.uint32), np.concatenate(ids).astype(np.uint32))
            return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "seg": pa.array([seg], pa.int32()), "n_docs": pa.array([len(keys)], pa.int64()), "n_ids": pa.array([held], pa.int64()), "payload": pa.array([data], pa.binary())})

        for b in slices(batches, 256):
            found = enc.encode_many([t or "" for t in b.column("text").to_pylist()])
            for k, x in zip(b.column("doc_id").to_pylist(), found, strict=True):
                keys.append(NO_ID if k is None else k)
                lengths.append(len(x) + 1)
                ids += [x, end]
                held += len(x) + 1
                if held >= segment_ids:
                    yield segment()
                    ids, keys, lengths, held, seg = [], [], [], 0, seg + 1
        if keys:
            yield segment()

    ordered = docs.select("doc_id", "text").repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id")
    ordered.mapInArrow(run, SEGMENTS).write.parquet(path)


def read_token_files(spark, path: str) -> DataFrame:
    """From the files: doc_id, start (ids of all documents before it), n_tokens, ids (binary, unsigned 32-bit)."""
    table = spark.read.schema(SEGMENTS).parquet(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1):
            keys, lengths, ids = pfor.decode(b.column("payload")[0].as_py())
            ends = np.cumsum(lengths, dtype=np.int64)
            starts = ends - lengths
            raw = ids.astype("<u4").tobytes()
            yield pa.RecordBatch.from_pydict({
                "part": pa.array(np.full(len(keys), b.column("part")[0].as_py(), np.int32)), "seg": pa.array(np.full(len(keys), b.column("seg")[0].as_py(), np.int32)),
                "doc_id": pa.array(keys, mask=keys == NO_ID), "within": pa.array(starts), "n_tokens": pa.array(lengths.astype(np.int64)),
                "ids_crc32": pa.array([zlib.crc32(memoryview(raw)[4 * s : 4 * e]) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)], pa.int64()),
            })

    docs = table.select("part", "seg", "payload").mapInArrow(run, "part int, seg int, doc_id long, within long, n_tokens long, ids_crc32 long")
    # The offsets: a running sum of the segments of a file, and one over the files' totals.
    sums = table.groupBy("part").agg(F.sum("n_ids").alias("n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    before = sums.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("file_start"))
    inside = Window.partitionBy("part").orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)
    starts = table.select("part", "seg", "n_ids").withColumn("seg_start", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)))
    starts = starts.join(before, "part").select("part", "seg", (F.col("seg_start") + F.col("file_start")).alias("base"))
    return docs.join(starts, ["part", "seg"]).select("doc_id", (F.col("base") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")


def op9_token_output(spark, sf_dir: str) -> DataFrame:
    """Contract op9: every document of the files, with its place, length and checksum."""
    import public_tokenizers

    path = new_path(spark, "token-files")
    write_token_files(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return read_token_files(spark, path)
