"""Line dedup with a log-template tree: recurring line templates across documents are dropped.

A text's lines are cut at sentence ends into records, so that a passage is found wherever it stands. A
record is a sequence of tokens (runs without ASCII blanks; digits are 0-9). The tree has a fixed depth: the token count, then the LEAD leading tokens
(tokens with a digit stand for one variable field; records of mostly such fields are compared by their true
tokens). Within a leaf, a token is constant at its place if it stands there in at least `min_docs` different
texts, and a variable field otherwise. A record's template is its constant tokens, if these are at least
FIXED and a share of at least `similar` of all; else the record is its own template. Records of one template
thus agree in every constant token, in whole 64-bit hashes; the rule knows no order and no sizes.

A template's owner is its first document (smallest doc_id); exact copies of one text count as one document,
and documents that share at least half of the longer one's tokens with the owner are near copies, which are
the near-duplicate stage's work: neither drops anything to the owner nor counts. A template recurs if at
least `min_docs` documents are left, the owner included. Two are enough for a passage: a run of shared
records (with short ones in between) of at least RUN tokens. The owner keeps its records, so that nothing is
lost from the corpus; the other documents drop them.

Scale: leaves that hold one record of one text only are found first, by sums for each leaf; nearly all
records end there, as two hashes. All the rest are counts by hashed keys with partial sums before each
shuffle: no leaf, template or hot line is ever in one group.

Records of fewer than `min_tokens` tokens stay, but inside a dropped passage. Cases: null text stays null;
blank lines stay; a document whose records all go gets the empty text; equal texts get equal results,
whatever their ids (null ids too); very long texts and lines are read whole; an empty table gives no rows;
other columns pass through, but n_lines and n_dropped replace columns of these names.
"""

from __future__ import annotations

import re
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kbspark.llm.common import Steps, map_arrow, texts, tidy
from kbspark.llm.shingles import BLANK, STEP, mix, run_hashes

LEAD = 3
SIMILAR = 0.8
FIXED = 6  #: constant tokens of a template with other variable fields than tokens with digits
MIN_DOCS = 3
MIN_TOKENS = 4
RUN = 20  #: tokens of a passage that two documents share
NEAR = 0.5  #: share of the longer text's tokens that makes a near copy

_CUT = re.compile(r"[.!?][ \t\n\r\f\v]+|\n+")
_TOKEN = re.compile(r"[^ \t\n\r\f\v]")
_FIELD = np.uint64(0x9E3779B97F4A7C15)  #: stands for a token with a digit


def _token_hashes(letters: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each token's bytes; the last bit tells whether it holds a digit."""
    if not len(sizes):
        return np.zeros(0, np.uint64)
    digit = np.bitwise_or.reduceat((letters >= 48) & (letters <= 57), np.cumsum(sizes) - sizes)
    return run_hashes(letters, sizes) & ~np.uint64(1) | digit


def _lists(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(values))


def records(many: list[str], min_tokens: int) -> dict[str, pa.Array]:
    """For each text n_tokens, and lists no, leaf, line, size, tokens of its records of at least min_tokens tokens.

    Records are counted through all that hold a token; tokens (32 bits, 0 for a field) are there for records that
    may have a template.
    """
    raw = [t.encode("utf-8", "surrogatepass") for t in many]
    data = np.frombuffer(b"".join(x + b"\n" for x in raw), np.uint8)
    text_at = np.cumsum([0, *(len(x) + 1 for x in raw)])
    word = ~BLANK[data]
    edges = np.flatnonzero(np.diff(word, prepend=False))
    first, past = edges[::2], edges[1::2]  # of each token, in bytes
    true = _token_hashes(data[word], past - first)
    lines = np.flatnonzero(data == 10)
    after = np.concatenate([first[1:], [len(data)]]) if len(first) else first
    last = (np.append(lines, len(data))[np.searchsorted(lines, past)] < after) | np.isin(data[past - 1], list(b".!?"))
    ends = np.flatnonzero(last) + 1
    starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
    sizes = ends - starts
    doc = np.searchsorted(text_at, first[starts], "right") - 1
    no = np.arange(len(ends)) - np.searchsorted(doc, np.arange(len(many)))[doc]
    kept = sizes >= min_tokens
    true = true[np.repeat(kept, sizes)]
    starts, sizes, doc, no = (x[kept] for x in (starts, sizes, doc, no))
    starts = np.cumsum(sizes) - sizes
    if len(sizes):
        field = (true & np.uint64(1)).astype(bool)
        numbers = np.add.reduceat(field, starts, dtype=np.int64) * 2 > sizes  # too few constant tokens for a template
        masked = np.where(field & ~np.repeat(numbers, sizes), _FIELD, true)
        place = (np.arange(len(true)) - np.repeat(starts, sizes)).astype(np.uint64)
        line = mix(np.add.reduceat(mix(masked + place * STEP), starts) + sizes.astype(np.uint64))
        leaf = sizes.astype(np.uint64)
        for k in range(LEAD):
            leaf = mix(leaf * STEP + masked[np.minimum(starts + k, len(true) - 1)])
        leaf = np.where(numbers, line, leaf)
        named = (sizes > FIXED) & ~numbers
        token = np.where(field, np.uint64(0), true >> np.uint64(32) | np.uint64(1)).astype(np.uint32).view(np.int32)[np.repeat(named, sizes)]
    else:
        line = leaf = np.zeros(0, np.uint64)
        named, token = np.zeros(0, bool), np.zeros(0, np.int32)
    counts = np.bincount(doc, minlength=len(many))
    total = np.zeros(len(many), np.int64)
    np.add.at(total, doc, sizes)
    every = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.where(named, sizes, 0))]), pa.int32()), pa.array(token))
    tokens = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), every)
    return {"n_tokens": pa.array(total), "no": _lists(no.astype(np.int32), counts), "leaf": _lists(leaf.view(np.int64), counts), "line": _lists(line.view(np.int64), counts), "size": _lists(sizes.astype(np.int32), counts), "tokens": tokens}


def parse_records(docs: DataFrame, min_tokens: int = MIN_TOKENS) -> DataFrame:
    """A row for each text of docs(doc_id, text): copy (its hash), n_tokens, and arrays no, leaf, line, size, tokens."""

    def run(b: pa.RecordBatch) -> dict:
        return {"doc_id": b.column("doc_id"), "copy": b.column("copy")} | records(texts(b), min_tokens)

    fields = "doc_id long, copy long, n_tokens long, no array<int>, leaf array<long>, line array<long>, size array<int>, tokens array<array<int>>"
    return map_arrow(docs.where("text is not null").select("doc_id", F.xxhash64("text").alias("copy"), "text"), run, fields, rows=256)


def templates(found: DataFrame, min_docs: int, similar: float) -> DataFrame:
    """leaf, line, template of the records found(leaf, line, copy, size, tokens) of leaves with several lines."""
    lines = found.groupBy("leaf", "line", "copy").agg(F.first("tokens").alias("tokens"))
    at = lines.select("leaf", "line", "copy", F.posexplode("tokens").alias("place", "token")).where("token <> 0")
    constant = at.groupBy("leaf", "place", "token").agg(F.count_distinct("copy").alias("n")).where(F.col("n") >= min_docs).select("leaf", "place", "token")
    once = found.groupBy("leaf", "line").agg(F.first("tokens").alias("tokens"))
    kept = once.select("leaf", "line", F.size("tokens").alias("size"), F.posexplode("tokens").alias("place", "token")).join(constant, ["leaf", "place", "token"])
    kept = kept.groupBy("leaf", "line").agg(F.count("*").alias("fixed"), F.max("size").alias("size"), F.bit_xor(F.xxhash64("place", "token")).alias("template"))
    return kept.where((F.col("fixed") >= FIXED) & (F.col("fixed") >= similar * F.col("size")) & (F.col("fixed") < F.col("size"))).select("leaf", "line", "template")


def recurring_records(docs: DataFrame, steps: Steps, min_docs: int = MIN_DOCS, min_tokens: int = MIN_TOKENS, similar: float = SIMILAR) -> DataFrame:
    """copy, gone (array of no, tokens, sure) of the texts that share records with an owner; sure if they recur."""
    rows = steps.cut(parse_records(docs, min_tokens), "records")
    pairs = rows.select("copy", F.explode(F.arrays_zip("leaf", "line")).alias("r")).select("copy", "r.leaf", "r.line")
    sums = pairs.groupBy("leaf").agg(F.min("line").alias("lo"), F.max("line").alias("hi"), F.min("copy").alias("a"), F.max("copy").alias("b"))
    live = steps.cut(sums.where("a <> b").select("leaf", (F.col("lo") != F.col("hi")).alias("several")), "live-leaves")
    live = F.broadcast(live) if live.count() <= 1_000_000 else live  # some 70 MB at most; beyond that a shuffled join
    every = rows.select("doc_id", "copy", F.explode(F.arrays_zip("no", "leaf", "line", "size", "tokens")).alias("r")).select("doc_id", "copy", "r.*")
    tokens = F.when(F.col("several") & (F.size("tokens") > 0), F.col("tokens"))
    found = steps.cut(every.join(live, "leaf").select("doc_id", "copy", "no", "leaf", "line", "size", tokens.alias("tokens")), "live-records")
    length = steps.cut(rows.groupBy("copy").agg(F.max("n_tokens").alias("n_tokens")), "lengths")
    steps.drop(rows)

    open_rows = found.where("tokens is not null")
    wide = open_rows.groupBy("leaf").agg(F.count_distinct("copy").alias("n")).where(F.col("n") >= min_docs).select("leaf")  # fewer texts make no constant
    named = steps.cut(templates(open_rows.join(wide, "leaf", "left_semi"), min_docs, similar), "templates")
    found = found.select("doc_id", "copy", "no", "leaf", "line", "size").join(named, ["leaf", "line"], "left").select("doc_id", "copy", "no", "leaf", F.coalesce("template", "line").alias("template"), "size")
    by_text = steps.cut(found.groupBy("leaf", "template", "copy").agg(F.min("doc_id").alias("doc"), F.max("size").alias("size")), "templates-of-texts")
    owners = by_text.groupBy("leaf", "template").agg(F.min(F.struct("doc", "copy")).alias("o"), F.count("*").alias("n")).where("n > 1").select("leaf", "template", F.col("o.copy").alias("owner"))
    shared = steps.cut(by_text.join(owners, ["leaf", "template"]).where("copy <> owner").select("leaf", "template", "copy", "owner", "size"), "shared")

    # near copies of an owner: pairs of texts, at most one for each shared template
    both = shared.groupBy("owner", "copy").agg(F.sum("size").alias("common"))
    both = both.join(length, "copy").join(length.select(F.col("copy").alias("owner"), F.col("n_tokens").alias("n_owner")), "owner")
    near = both.where(F.col("common") >= NEAR * F.greatest("n_tokens", "n_owner")).select("owner", "copy")
    other = steps.cut(shared.join(near, ["owner", "copy"], "left_anti").select("leaf", "template", "copy"), "unlike")
    sure = other.groupBy("leaf", "template").agg((F.count("*") + 1 >= min_docs).alias("sure"))
    gone = found.join(other.join(sure, ["leaf", "template"]), ["leaf", "template", "copy"]).select("copy", F.struct("no", "size", "sure").alias("x")).distinct()
    return gone.groupBy("copy").agg(F.sort_array(F.collect_list("x")).alias("gone"))


def chosen(size, gone: list[tuple[int, int, bool]], min_tokens: int) -> set[int]:
    """The records to drop: those that recur, and passages: runs of shared records with short ones in between.

    size: from a record's number to its number of tokens.
    """
    out = {n for n, _, sure in gone if sure}
    at = 0
    while at < len(gone):
        end, total = at, gone[at][1]
        while end + 1 < len(gone) and all(size(n) < min_tokens for n in range(gone[end][0] + 1, gone[end + 1][0])):
            end += 1
            total += gone[end][1]
        if total >= RUN:
            out.update(range(gone[at][0], gone[end][0] + 1))
        at = end + 1
    return out


def without(text: str, gone: list[tuple[int, int, bool]], min_tokens: int = MIN_TOKENS) -> tuple[str, int]:
    """The text without the chosen records, and how many went; of gaps that meet, the one with most line ends stays."""
    cuts = [(m.start() + (m[0][0] != "\n"), m.end()) for m in _CUT.finditer(text)]
    pieces = [text[a:b] for a, b in zip([0, *(e for _, e in cuts)], [*(s for s, _ in cuts), len(text)], strict=True)]
    gaps = [text[a:b] for a, b in cuts]
    records = [p for p in pieces if _TOKEN.search(p)]
    out = chosen(lambda n: len(records[n].encode("utf-8", "surrogatepass").split()), gone, min_tokens)
    kept, gap, no = [], "", 0
    for piece, after in zip(pieces, [*gaps, ""], strict=True):
        record = _TOKEN.search(piece) is not None
        if record and no in out:
            gap = max(gap, after, key=lambda g: g.count("\n")) if kept else ""
        else:
            kept += [gap, piece]
            gap = after
        no += record
    return "".join(kept), len(out)


def drop_lines(docs: DataFrame, min_docs: int = MIN_DOCS, min_tokens: int = MIN_TOKENS, similar: float = SIMILAR) -> DataFrame:
    """docs with the recurring records taken out of text, and n_lines (of the text before), n_dropped (records)."""
    steps = Steps(docs.sparkSession)
    gone = steps.cut(recurring_records(docs.select("doc_id", "text"), steps, min_docs, min_tokens, similar), "gone")
    steps.drop(*(t for t in steps.tables() if t is not gone))
    tidy(docs.sparkSession)

    @F.pandas_udf("text string, n_dropped long")
    def cut_out(text: pd.Series, no: pd.Series, size: pd.Series, sure: pd.Series) -> pd.DataFrame:
        found = [(t, 0) if t is None else without(t, list(zip(a, b, c, strict=True)), min_tokens) for t, a, b, c in zip(text, no, size, sure, strict=True)]
        return pd.DataFrame(found, columns=["text", "n_dropped"])

    names = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    whole = docs.select(F.struct(*names).alias("doc"), F.xxhash64("text").alias("copy")).join(gone, "copy", "left")
    left = cut_out(F.when(F.col("gone").isNotNull(), F.col("doc.text")), F.col("gone.no"), F.col("gone.size"), F.col("gone.sure"))
    new = whole.select("doc", "gone", left.alias("left"))
    text = F.when(F.col("gone").isNull(), F.col("doc.text")).otherwise(F.col("left.text"))
    n_lines = F.when(F.col("doc.text").isNull(), 0).otherwise(F.length("doc.text") - F.length(F.replace("doc.text", F.lit("\n"))) + 1).cast("long")
    return new.select(*(text.alias("text") if c == "text" else F.col("doc")[c].alias(c) for c in names), n_lines.alias("n_lines"), F.coalesce("left.n_dropped", F.lit(0)).alias("n_dropped"))


def op10_line_templates(spark, sf_dir: str) -> DataFrame:
    """Every document with the text that stays, how many lines it had and how many records went."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return drop_lines(docs)
