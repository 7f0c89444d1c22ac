"""Token counts under a unigram vocabulary: a Viterbi pass that carries the best score and the piece count only.

White space runs become the word mark, and no piece holds a mark after its first character other than
pieces of marks alone, so the best path of a text is the best paths of its words one after another:
scores are whole numbers, so sums and ties are exact whatever stands before. Each distinct word is counted
once by a worker and kept.

Aho-Corasick lists the pieces that end at each character. Tie rules, as in the public unigram tokenizer:
a path to a place is replaced only by a strictly better one, and paths come in order of their last piece's
start, so among equal scores the longest last piece stays. A character that is no piece by itself may be
the unknown piece, at the lowest score less 10, and neighbouring unknown pieces count as one.

Scores: piece i of the vocabulary file has the score -i (its rank), a fixed rule.

Cases: null and blank texts count 0; the result has a row for each input row; empty tables give none.
"""

from __future__ import annotations

from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from kbspark.llm.common import map_arrow, texts

MARK = "▁"
UNKNOWN_PENALTY = 10.0
KEPT_WORDS = 400_000


def pieces(path: str) -> list[tuple[str, float]]:
    """Piece and score of each id; control, byte and mark-only pieces keep their ids but match nothing of a word."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(sp.id_to_piece(i), -float(i)) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)) and MARK not in sp.id_to_piece(i)[1:]]


class UnigramCounter:
    def __init__(self, vocabulary: list[tuple[str, float]]):
        import ahocorasick

        self.found = ahocorasick.Automaton()
        for piece, score in vocabulary:
            self.found.add_word(piece, (len(piece), score))
        self.found.make_automaton()
        self.single = {p for p, _ in vocabulary if len(p) == 1}
        self.unknown = min(s for _, s in vocabulary) - UNKNOWN_PENALTY
        self.known: dict[str, tuple[int, float]] = {}

    def word(self, marked: str) -> tuple[int, float]:
        """Pieces on the best path, and its score."""
        n = len(marked)
        ends: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
        for end, (size, score) in self.found.iter(marked):
            ends[end + 1].append((size, score))
        best: list[float | None] = [0.0] + [None] * n
        count = [0] * (n + 1)
        open_unknown = [False] * (n + 1)  # the last piece is unknown
        for end in range(1, n + 1):
            top = None
            options = ends[end]
            if len(options) > 1:
                options.sort(reverse=True)
            for size, score in options:
                start = best[end - size]
                if start is not None and (top is None or start + score > top):
                    top = start + score
                    count[end], open_unknown[end] = count[end - size] + 1, False
            if marked[end - 1] not in self.single and (start := best[end - 1]) is not None and (top is None or start + self.unknown > top):
                top = start + self.unknown
                count[end] = count[end - 1] + (not open_unknown[end - 1])
                open_unknown[end] = True
            best[end] = top
        return count[n], best[n]

    def count(self, text: str) -> tuple[int, float]:
        """Pieces and score of a text."""
        words = text.split()
        known = self.known
        if len(known) > KEPT_WORDS:
            known.clear()
        for w in set(words):
            if w not in known:
                known[w] = self.word(MARK + w)
        found = list(map(known.__getitem__, words))
        return sum(c for c, _ in found), sum(s for _, s in found)


@lru_cache(maxsize=2)
def counter(path: str) -> UnigramCounter:
    return UnigramCounter(pieces(path))


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_pieces, score of every document."""

    def run(b: pa.RecordBatch) -> dict:
        found = [counter(path).count(t) for t in texts(b)]
        return {"doc_id": b.column("doc_id"), "n_pieces": [c for c, _ in found], "score": [float(s) for _, s in found]}

    return map_arrow(docs.select("doc_id", "text"), run, "doc_id long, n_pieces long, score double")


def op8_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("piece_bpe_32k.model"))
