"""BPE encoding and decoding through a minimal acyclic transducer of the corpus' frequent words.

Words are counted over all documents. The most frequent, at most `lexicon_words` (a bound on the lexicon, not on
the data: other words are merged exactly) go into a minimal acyclic automaton with shared suffixes. Each
arc carries the number of words that sort before it, so a word's path sums to its index, and the index
leads to the word's ids in a table beside the arcs. The automaton is one flat byte string, sent to the executors as a broadcast of
bounded size and memory-mapped by each worker from a nameless file of its own (nothing else reads it). Words that it lacks are merged by the vocabulary's ranks.

A text with characters at or above U+0250, or with a special token's string, takes the library's own
normaliser and splitter first.

Cases: null text is the empty text (no ids, empty decoding); an empty table gives no rows and an empty
lexicon; repeated rows stay; very long texts are read whole, and a very long word is merged in n log n steps; words of one frequency go in together or not at all; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import mmap
import os
import tempfile
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kbspark.llm.charset import LATER, WORD_SPLIT, byte_alphabet
from kbspark.llm.common import cut, give_back, hold, map_arrow, slices, texts

LEXICON_WORDS = 60_000
KEPT_WORDS = 200_000


class Vocabulary:
    """The merges of a word-end BPE file, and its splitting of texts into words."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        self.ids: dict[str, int] = model["model"]["vocab"]
        self.rank = {tuple(m) if isinstance(m, list) else tuple(m.split(" ")): n for n, m in enumerate(model["model"]["merges"])}
        self.end = model["model"]["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in model["added_tokens"]}
        self.pieces = {i: p for p, i in self.ids.items()} | {i: p for p, i in self.special.items()}
        self.byte = byte_alphabet()
        self.plain = {c: self.byte[ord(c)] for c in map(chr, range(128))}
        self.tok = Tokenizer.from_file(path)

    def words(self, text: str) -> list[str] | None:
        """The pre-tokens in their plain characters; None where a special token's string occurs."""
        if "<|" in text and any(s in text for s in self.special):
            return None
        small = text.lower()
        if LATER.search(text) or LATER.search(small):  # some capitals below the limit have small letters beyond it
            text = self.tok.normalizer.normalize_str(text)
            alphabet = {c: b for b, c in self.byte.items()}
            return [bytes(alphabet[c] for c in w).decode("utf-8") for w, _ in self.tok.pre_tokenizer.pre_tokenize_str(text)]
        return WORD_SPLIT.findall(small)

    def merge(self, word: str) -> list[int]:
        """Exact merging: the pair of the lowest rank, leftmost first, again and again (a heap over linked parts)."""
        parts = [self.byte[b] for b in word.encode("utf-8")]
        parts[-1] += self.end
        rank, n = self.rank.get, len(parts)
        heap = [(r, k) for k, p in enumerate(zip(parts, parts[1:])) if (r := rank(p)) is not None]
        heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while heap:
            r, k = heappop(heap)
            right = after[k]
            if right >= n or parts[k] is None or rank((parts[k], parts[right])) != r:  # one of the two has been merged since
                continue
            parts[k] += parts[right]
            parts[right], after[k] = None, after[right]
            if after[k] < n:
                before[after[k]] = k
                if (r := rank((parts[k], parts[after[k]]))) is not None:
                    heappush(heap, (r, k))
            if before[k] >= 0 and (r := rank((parts[before[k]], parts[k]))) is not None:
                heappush(heap, (r, before[k]))
        return [self.ids[p] for p in parts if p in self.ids]


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def compile_lexicon(words: list[str], ids: list[list[int]]) -> bytes:
    """Sorted byte strings of the words to a minimal automaton, by adding them in order and sharing finished suffixes."""
    order = sorted(range(len(words)), key=lambda i: words[i].encode("utf-8"))
    register: dict[tuple, int] = {}
    nodes: list[tuple[bool, list[tuple[int, int]]]] = []  # finished: final, [(byte, node)]
    path: list[list] = [[False, []]]  # open: final, arcs; the arc to the next open node is not in yet
    last = b""

    def close(down_to: int) -> None:
        while len(path) > down_to + 1:
            final, arcs = path.pop()
            key = (final, tuple(arcs))
            if key not in register:
                register[key] = len(nodes)
                nodes.append((final, arcs))
            path[-1][1].append((last[len(path) - 1], register[key]))

    for i in order:
        w = words[i].encode("utf-8")
        same = len(os.path.commonprefix([w, last]))
        close(same)
        last = w
        path += [[False, []] for _ in w[same:]]
        path[-1][0] = True
    close(0)
    root = len(nodes)
    nodes.append(tuple(path[0]))
    below = np.zeros(len(nodes), np.int64)
    keys, target, before = [], [], []
    for n, (final, arcs) in enumerate(nodes):  # children stand before their parents
        count = int(final)
        for byte, to in arcs:
            keys.append(n * 256 + byte)
            target.append(to)
            before.append(count)
            count += int(below[to])
        below[n] = count
    sizes = [len(ids[i]) for i in order]
    return b"".join([
        np.array([len(keys), len(nodes), root, len(order), sum(sizes)], "<i8").tobytes(), np.array(keys, "<i8").tobytes(), np.array(target, "<i8").tobytes(), np.array(before, "<i8").tobytes(),
        np.concatenate([[0], np.cumsum(sizes)]).astype("<i8").tobytes(), np.array([x for i in order for x in ids[i]], "<i8").tobytes(), np.array([f for f, _ in nodes], np.uint8).tobytes(),
    ])


class Lexicon:
    """A compiled lexicon, mapped into memory; many words walk it at once."""

    def __init__(self, data: bytes):
        with tempfile.NamedTemporaryFile() as f:  # its name goes, the mapping stays
            f.write(data)
            f.flush()
            self.map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        arcs, nodes, self.root, self.n, total = np.frombuffer(self.map, "<i8", 5).tolist()
        at = 40
        parts = []
        for count in (arcs, arcs, arcs, self.n + 1, total):
            parts.append(np.frombuffer(self.map, "<i8", count, at))
            at += 8 * count
        self.keys, self.target, self.before, self.starts, self.ids = parts
        self.final = np.frombuffer(self.map, np.uint8, nodes, at)

    def find(self, words: list[str]) -> np.ndarray:
        """Each word's index, or -1."""
        raw = [w.encode("utf-8") for w in words]
        out = np.full(len(raw), -1, np.int64)
        if not self.n or not raw:
            return out
        size = np.array([len(r) for r in raw])
        live = np.flatnonzero(size <= 64)  # compiled words are shorter
        width = int(size[live].max(initial=0))
        chars = np.frombuffer(b"".join(raw[i].ljust(width, b"\0") for i in live.tolist()), np.uint8).reshape(len(live), width).astype(np.int64)
        state, index = np.full(len(live), self.root), np.zeros(len(live), np.int64)
        rows = np.arange(len(live))
        for k in range(width + 1):
            done = size[live[rows]] == k
            ended = rows[done]
            ok = ended[self.final[state[ended]] == 1]
            out[live[ok]] = index[ok]
            rows = rows[~done]
            if not len(rows):
                break
            want = state[rows] * 256 + chars[rows, k]
            at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
            hit = self.keys[at] == want
            rows, at = rows[hit], at[hit]
            index[rows] += self.before[at]
            state[rows] = self.target[at]
        return out

    def ids_of(self, index: int) -> list[int]:
        return self.ids[self.starts[index] : self.starts[index + 1]].tolist()


class WordEncoder:
    """Words to id strings (unsigned 32-bit) and decoded strings, kept while a worker lives."""

    def __init__(self, path: str, lexicon: bytes):
        self.v = vocabulary(path)
        self.lexicon = Lexicon(lexicon)
        self.raw: dict[str, bytes] = {}
        self.said: dict[str, str] = {}

    def _add(self, word: str, ids: list[int]) -> None:
        self.raw[word] = np.array(ids, "<u4").tobytes()
        self.said[word] = " ".join(map(self.v.pieces.__getitem__, ids))

    def learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self.raw]
        if len(self.raw) + len(new) > KEPT_WORDS:
            self.raw.clear()
            self.said.clear()
            new = list(words)
        for w, n in zip(new, self.lexicon.find(new).tolist(), strict=True):
            self._add(w, self.lexicon.ids_of(n) if n >= 0 else self.v.merge(w))

    def encode_many(self, many: list[str]) -> list[tuple[bytes, str]]:
        """Ids and decoded text of each text."""
        split = [self.v.words(t) for t in many]
        self.learn(set().union(*(w for w in split if w is not None)))
        out = []
        for t, ws in zip(many, split, strict=True):
            if ws is None:  # special tokens stand in the text
                ids = self.v.tok.encode(t, add_special_tokens=False).ids
                out.append((np.array(ids, "<u4").tobytes(), self.v.tok.decode(ids, skip_special_tokens=False)))
            else:
                said = self.said.__getitem__
                out.append((b"".join(map(self.raw.__getitem__, ws)), " ".join(filter(None, map(said, ws)))))
        return out


@lru_cache(maxsize=1)
def _encoder(path: str, key: str, broadcast) -> WordEncoder:
    return WordEncoder(path, broadcast.value)


def forget() -> None:
    """Drop what a worker remembers for this operator."""
    _encoder.cache_clear()
    vocabulary.cache_clear()


def word_counts(docs: DataFrame, path: str) -> DataFrame:
    """word, n: how often each pre-token occurs in all texts (counted in each task before the shuffle)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("bpe", forget)
        v, counts = vocabulary(path), Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"word": pa.array(counts.keys(), pa.string()), "n": pa.array(counts.values(), pa.int64())})

        for b in slices(batches):
            for t in texts(b):
                counts.update(v.words(t) or ())
            if len(counts) > KEPT_WORDS:
                yield out()
                counts.clear()
        if counts:
            yield out()
        b = counts = None
        give_back()

    return docs.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def build_lexicon(docs: DataFrame, path: str, lexicon_words: int = LEXICON_WORDS) -> bytes:
    """The compiled lexicon of the corpus' most frequent words of at most 64 bytes.

    The lowest frequency that keeps the lexicon within lexicon_words comes from the table of frequencies, so
    only the chosen words reach the driver.
    """
    counts = cut(word_counts(docs, path).where("n > 1 and octet_length(word) <= 64"), "word-counts")
    so_far = Window.orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, 0)  # a row for each frequency
    least = counts.groupBy("n").agg(F.count("*").alias("words")).withColumn("total", F.sum("words").over(so_far)).where(F.col("total") <= lexicon_words).agg(F.min("n")).first()[0]
    words = [r["word"] for r in counts.where(F.col("n") >= least).select("word").collect()] if least is not None else []
    v = vocabulary(path)
    return compile_lexicon(words, [v.merge(w) for w in words])


def encode(docs: DataFrame, path: str, lexicon_words: int = LEXICON_WORDS) -> DataFrame:
    """doc_id, ids (binary, unsigned 32-bit), decoded of every document, computed as the rows are read."""
    return _encoded(docs, path, lexicon_words, "doc_id long, ids binary, decoded string", lambda raw, said: (raw, said), ("ids", "decoded"))


def encode_digests(docs: DataFrame, path: str, lexicon_words: int = LEXICON_WORDS) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document."""
    return _encoded(
        docs, path, lexicon_words, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string",
        lambda raw, said: (len(raw) // 4, hashlib.sha256(raw).hexdigest(), hashlib.sha256(said.encode("utf-8")).hexdigest()), ("n_tokens", "ids_sha256", "decoded_sha256"),
    )


def _encoded(docs: DataFrame, path: str, lexicon_words: int, schema: str, digest, names: tuple[str, ...]) -> DataFrame:
    lexicon = docs.sparkSession.sparkContext.broadcast(data := build_lexicon(docs, path, lexicon_words))
    key = hashlib.sha256(data).hexdigest()

    def run(b: pa.RecordBatch) -> dict:
        hold("bpe", forget)
        found = [digest(*x) for x in _encoder(path, key, lexicon).encode_many(texts(b))]
        return {"doc_id": b.column("doc_id")} | {n: [x[k] for x in found] for k, n in enumerate(names)}

    return map_arrow(docs.select("doc_id", "text"), run, schema, rows=256)


def op6_bpe(spark, sf_dir: str) -> DataFrame:
    """Contract op6 over whole documents."""
    import public_tokenizers

    return encode_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
