"""Toxicity: a support vector machine over a gap-weighted subsequence kernel, with Nystroem landmarks.

Kernel. A word (a token of a sentence in lower case) maps to all its ordered letter triples within
SPAN characters, each weighing DECAY ** (characters spanned); other characters only take up room, so
'i-d.i*o-t' still shares its triples with 'idiot'. K(w, l) is the product of two such maps,
each divided by the root of its squared weights. Runs of
single-character tokens ('i d i o t') are joined into one word; tokens of over WINDOW characters are
read through overlapping windows, so that no character goes unread.

Model. Labels stand for documents. A sentence takes its document's label, and under the
multiple-instance rule a sentence, like a document, is as toxic as its worst word. Training words come
from a bounded, hash-ordered sample of labelled training documents (MAX_TOXIC and MAX_CLEAN documents):
words and character 4-grams that stand in significantly more different contexts of toxic documents than
of clean ones name the witness words of the toxic sentences; words of clean sentences are negatives. LANDMARKS words span the Nystroem space
K_mm^(-1/2) k_m(w), in which an L2-SVM is trained, in one task over these bounded lists of words, so that
the driver holds words and the finished weights only. Because triples are explicit, the trained machine
folds into one weight for each triple, which scores a word exactly as the landmarks would.

The score is a logistic curve of the worst word's margin, fitted on the training documents' margins.

Cases: null and empty texts have margin 0 words: they take the lowest margin, score near 0; without
usable labels every document scores 0; repeated rows score alike; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kbspark.llm.common import hold, map_arrow, texts, tidy

SPAN, DECAY, WINDOW = 8, 0.7, 24
LETTERS = {c: n for n, c in enumerate("abcdefghijklmnopqrstuvwxyzàáâãäåæçèéêëìíîïðñòóôõöøùúûüýß", 1)}
BASE = 64  #: codes of a character: 0 none, 1.. the letters above, 60..63 the rest by their code point
MAX_TOXIC, MAX_CLEAN = 2000, 3000  #: labelled documents in the training sample, at most
MAX_POSITIVE, MAX_NEGATIVE = 3000, 20_000  #: training words, at most
LANDMARKS = 400
HARD_ROUNDS = 2
KEPT_WORDS = 200_000
SINGLES = re.compile(r"(?<!\S)\S(?:\s\S)+(?!\S)")
EMPTY = -9.0  #: margin of a text without words


def codes(words: list[str]) -> np.ndarray:
    """Words of at most WINDOW characters as rows of character codes; 0 is no letter."""
    out = np.zeros((len(words), WINDOW), np.int32)
    for n, w in enumerate(words):
        row = [LETTERS.get(c) or (60 + (ord(c) & 3) if c.isalpha() else 0) for c in w[:WINDOW]]
        out[n, : len(row)] = row
    return out


def triples(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Triple ids (a row for each word, a column for each choice of places; 0 where one is no letter) and the columns' weights."""
    width = max(3, int(np.max(np.nonzero((c != 0).any(axis=0))[0], initial=-1)) + 1)
    ids, weights = [], []
    for i in range(width - 2):
        for j in range(i + 1, min(i + SPAN - 1, width - 1)):
            ij = np.where((c[:, i] > 0) & (c[:, j] > 0), c[:, i] * BASE + c[:, j], 0)
            for k in range(j + 1, min(i + SPAN, width)):
                ids.append(np.where((ij > 0) & (c[:, k] > 0), ij * BASE + c[:, k], 0))
                weights.append(DECAY ** (k - i + 1))
    return np.stack(ids, axis=1), np.array(weights, np.float32)


def blocks(words: list[str], size: int = 2048):
    """Places, triple ids, weights and norm of the words, those of like length together."""
    order = sorted(range(len(words)), key=lambda n: len(words[n]))
    for at in range(0, len(words), size):
        of = order[at : at + size]
        ids, weights = triples(codes([words[n] for n in of]))
        norm = np.sqrt((ids > 0) @ (weights**2))
        yield np.array(of), ids, weights, np.where(norm > 0, norm, 1)


class Landmarks:
    """Landmark words as sparse maps: a row for each triple that any of them has, a column for each landmark."""

    def __init__(self, words: list[str]):
        found = list(blocks(words))
        self.triples = np.unique(np.concatenate([ids.ravel() for _, ids, _, _ in found]))
        self.triples = self.triples[self.triples > 0]
        self.maps = np.zeros((len(self.triples) + 1, len(words)), np.float32)
        for of, ids, weights, norm in found:
            at = self.place(ids)
            np.add.at(self.maps, (at, of[:, None]), weights[None, :] / norm[:, None])
        self.maps[-1] = 0

    def place(self, ids: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.triples, ids), len(self.triples) - 1)
        return np.where(self.triples[at] == ids, at, len(self.triples))

    def kernel(self, words: list[str]) -> np.ndarray:
        """K(w, l): a row for each word, a column for each landmark."""
        out = np.zeros((len(words), self.maps.shape[1]), np.float32)
        for of, ids, weights, norm in blocks(words, 1024):
            at = self.place(ids)
            for k in range(ids.shape[1]):
                rows = np.flatnonzero(at[:, k] < len(self.triples))
                out[of[rows]] += weights[k] * self.maps[at[rows, k]]
            out[of] /= norm[:, None]
        return out


def instances(text: str) -> set[str]:
    """The distinct words that the kernel compares, of all sentences of a text."""
    text = text.lower()
    words = set(text.split())
    if SINGLES.search(text):
        words.update(re.sub(r"\s", "", m) for m in SINGLES.findall(text))
    long = [w for w in words if len(w) > WINDOW]
    for w in long:
        words.discard(w)
        words.update(w[n : n + WINDOW] for n in range(0, len(w) - WINDOW // 2, WINDOW // 2))
    return words


@dataclass
class Model:
    weights: np.ndarray  #: of each triple, the landmarks folded together
    bias: float
    slope: float
    middle: float

    def margins(self, words: list[str]) -> np.ndarray:
        out = np.zeros(len(words))
        for of, ids, weights, norm in blocks(words):
            out[of] = (self.weights[ids] @ weights) / norm + self.bias
        return out

    def score(self, margin: float) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * (margin - self.middle), -30, 30))))


_kept: dict = {"model": None, "margins": {}}


def text_margins(model: Model, key: str, many: list[str]) -> list[float]:
    """The worst word's margin of each text; words are remembered while a worker serves this operator."""
    hold("toxicity", lambda: _kept.update(model=None, margins={}))
    if _kept["model"] != key:
        _kept.update(model=key, margins={})
    sets = [instances(t) for t in many]
    known: dict[str, float] = _kept["margins"]
    words = set().union(*sets)
    new = [w for w in words if w not in known]
    if len(known) + len(new) > KEPT_WORDS:
        known.clear()
        new = list(words)
    if new:
        known.update(zip(new, model.margins(new).tolist(), strict=True))
    return [max(map(known.__getitem__, s), default=EMPTY) for s in sets]


def _word_evidence(sample: DataFrame) -> DataFrame:
    """unit, pos, neg: how many different words stand before each word in toxic and in clean documents.

    Contexts are counted rather than documents, so that the words of one much-copied document count once.
    """

    def run(b: pa.RecordBatch) -> dict:
        units, before, flags = [], [], []
        for t, y in zip(texts(b), b.column("toxic").to_pylist(), strict=True):
            words = t.lower().split()
            rows = set(zip(words, ["", *words], strict=False)) | {(w, "") for w in instances(t).difference(words)}
            units += [w for w, _ in rows if len(w) <= WINDOW]
            before += [zlib.crc32(p.encode()) for w, p in rows if len(w) <= WINDOW]
            flags += [y] * (len(units) - len(flags))
        return {"unit": units, "ctx": before, "toxic": flags}

    seen = map_arrow(sample, run, "unit string, ctx long, toxic int", rows=256).distinct()
    return seen.groupBy("unit").agg(F.sum("toxic").alias("pos"), F.sum(1 - F.col("toxic")).alias("neg"))


def grams(word: str) -> set[str]:
    marked = "^" + word + "$"
    return {marked[n : n + 4] for n in range(max(1, len(marked) - 3))}


def _strong(evidence: DataFrame) -> DataFrame:
    """The units whose share of the toxic side passes a G-test; the bar grows with the number of units tried."""
    sums = evidence.agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"), F.count("*").alias("c")).first()
    n_pos, n_neg, tried = float(sums["p"] or 1), float(sums["n"] or 1), float(sums["c"] or 1)
    pos, neg = F.col("pos"), F.col("neg")
    rate = (pos + neg) / F.lit(n_pos + n_neg)
    gain = 2 * (pos * F.log(pos / (F.lit(n_pos) * rate)) + F.when(neg > 0, neg * F.log(neg / (F.lit(n_neg) * rate))).otherwise(0.0))
    return evidence.where((pos > 1) & (pos / n_pos > 20 * neg / n_neg)).withColumn("gain", gain).where(F.col("gain") > 2 * float(np.log(tried)) + 4)


def _svm(x: np.ndarray, y: np.ndarray, cost: np.ndarray, rounds: int = 30) -> np.ndarray:
    """Weights of an L2-SVM with squared hinge loss (last column of x: the constant), by Newton steps on the examples inside the margin."""
    w, inside = np.zeros(x.shape[1]), None
    for n in range(rounds):
        now = y * (x @ w.astype(np.float32)) < 1
        if inside is not None and (now == inside).all():
            break
        inside = now
        gram, pull = np.eye(x.shape[1]), np.zeros(x.shape[1])
        gram[-1, -1] = 1e-3
        for at in range(0, len(x), 2048):  # in slices, so that the driver holds one copy of x
            of = at + np.flatnonzero(inside[at : at + 2048])
            part = x[of].astype(np.float64)
            weighted = part * cost[of, None]
            gram += weighted.T @ part
            pull += weighted.T @ y[of]
        w = np.linalg.solve(gram, pull) if n == 0 else 0.5 * w + 0.5 * np.linalg.solve(gram, pull)
    return w


def train(docs: DataFrame, labels: DataFrame, max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN) -> Model | None:
    """Fit on docs(doc_id, text) and labels(doc_id, toxic), which hold training rows only; None without both classes."""
    marked = labels.where("toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    order = F.xxhash64("doc_id")
    chosen = marked.where("toxic = 1").orderBy(order, "doc_id").limit(max_toxic).unionByName(marked.where("toxic = 0").orderBy(order, "doc_id").limit(max_clean))
    # at most max_toxic + max_clean rows, small by the bound: of a doc_id with many rows one text counts, the one of the smallest hash
    one = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    sample = one.select("text", "toxic").repartition(docs.sparkSession.sparkContext.defaultParallelism).persist()
    try:
        sizes = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
        n_pos, n_neg = sizes.get(1, 0), sizes.get(0, 0)
        if not n_pos or not n_neg:
            return None
        evidence = _word_evidence(sample).persist()

        def to_grams(b: pa.RecordBatch) -> dict:
            rows = [(g, p, n) for w, p, n in zip(*(b.column(c).to_pylist() for c in ("unit", "pos", "neg")), strict=True) for g in grams(w)]
            return {"unit": [r[0] for r in rows], "pos": [r[1] for r in rows], "neg": [r[2] for r in rows]}

        parts = map_arrow(evidence, to_grams, "unit string, pos long, neg long", rows=4096).groupBy("unit").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).persist()
        told = {r["unit"] for r in _strong(parts).orderBy(F.desc("gain"), "unit").limit(MAX_POSITIVE).collect()}
        parts.unpersist()
        words = [r["unit"] for r in _strong(evidence).orderBy(F.desc("gain"), "unit").limit(MAX_POSITIVE).collect()]

        def with_told(b: pa.RecordBatch) -> dict:
            rows = [(w, p) for w, p in zip(b.column("unit").to_pylist(), b.column("pos").to_pylist(), strict=True) if not told.isdisjoint(grams(w))]
            return {"unit": [w for w, _ in rows], "pos": [p for _, p in rows]}

        toxic_words = map_arrow(evidence.where("pos > 0 and neg = 0").select("unit", "pos"), with_told, "unit string, pos long", rows=4096)
        held = [r["unit"] for r in toxic_words.orderBy(F.desc("pos"), "unit").limit(MAX_POSITIVE).collect()]
        positive = list(dict.fromkeys(words + held))[:MAX_POSITIVE]
        negative = [r["unit"] for r in evidence.where("neg > 0").orderBy(F.xxhash64("unit"), "unit").limit(MAX_NEGATIVE).select("unit").collect()]
        common = [r["unit"] for r in evidence.orderBy(F.desc("neg"), "unit").limit(MAX_NEGATIVE // 4).select("unit").collect()]
        if not positive:
            evidence.unpersist()
            return None
        held_words = set(positive)
        negative = [w for w in dict.fromkeys(common + negative) if w not in held_words]
        model = fit_in_task(docs.sparkSession, positive, negative)
        for _ in range(HARD_ROUNDS):  # clean words that the machine takes for toxic join the negatives
            now = docs.sparkSession.sparkContext.broadcast(model)

            def margins_of(b: pa.RecordBatch) -> dict:
                words = b.column("unit").to_pylist()
                return {"unit": words, "margin": now.value.margins(words)}

            hard = map_arrow(evidence.where("neg > 0 and pos <= neg").select("unit"), margins_of, "unit string, margin double", rows=4096)
            worst = [r["unit"] for r in hard.where("margin > -0.5").orderBy(F.desc("margin"), "unit").limit(MAX_NEGATIVE // 4).collect()]
            negative += [w for w in worst if w not in held_words]
            now.destroy()
            model = fit_in_task(docs.sparkSession, positive, list(dict.fromkeys(negative)), negative[-len(worst) // 2 :] if worst else [])
        evidence.unpersist()
        key = str(zlib.crc32(model.weights.tobytes()))
        send = docs.sparkSession.sparkContext.broadcast(model)

        def run(b: pa.RecordBatch) -> dict:
            return {"toxic": b.column("toxic"), "margin": text_margins(send.value, key, texts(b))}

        seen = map_arrow(sample, run, "toxic int, margin double", rows=256).toPandas()  # two numbers for each sample row
        model.slope, model.middle = _curve(seen["margin"].to_numpy(), seen["toxic"].to_numpy())
        return model
    finally:
        sample.unpersist()
        tidy(docs.sparkSession)


def fit_words(positive: list[str], negative: list[str], hard: list[str] = ()) -> Model:
    """The machine from labelled words."""
    half = LANDMARKS // 2
    spread = lambda words: [words[i] for i in np.unique(np.linspace(0, len(words) - 1, min(half, len(words))).astype(int))] if words else []
    marks = Landmarks(list(dict.fromkeys(spread(positive) + spread(negative) + spread(list(hard)))))
    values, vectors = np.linalg.eigh((marks.maps.T @ marks.maps).astype(np.float64))
    kept = values > 1e-6 * values[-1]
    whiten = vectors[:, kept] / np.sqrt(values[kept])
    words, whiten = positive + negative, whiten.astype(np.float32)
    x = np.ones((len(words), whiten.shape[1] + 1), np.float32)
    for at in range(0, len(words), 2048):
        x[at : at + 2048, :-1] = marks.kernel(words[at : at + 2048]) @ whiten
    y = np.concatenate([np.ones(len(positive)), -np.ones(len(negative))])
    cost = np.where(y > 0, 0.5 * len(y) / len(positive), 0.5 * len(y) / max(1, len(negative)))
    w = _svm(x, y, cost)
    weights = np.zeros(BASE**3, np.float32)
    weights[marks.triples] = (marks.maps[:-1] @ (whiten @ w[:-1])).astype(np.float32)
    return Model(weights, float(w[-1]), 4.0, 0.0)


def fit_in_task(spark, positive: list[str], negative: list[str], hard: list[str] = ()) -> Model:
    """fit_words on an executor: at most MAX_POSITIVE and some 1.75 times MAX_NEGATIVE words go there, the weights come back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _ in batches:
            m = fit_words(positive, negative, hard)
            yield pa.RecordBatch.from_pydict({"weights": pa.array([m.weights.tobytes()], pa.binary()), "bias": [m.bias], "slope": [m.slope], "middle": [m.middle]})

    row = spark.range(0, 1, 1, 1).mapInArrow(run, "weights binary, bias double, slope double, middle double").first()
    return Model(np.frombuffer(row["weights"], np.float32), row["bias"], row["slope"], row["middle"])


def _curve(margin: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Slope and middle of the logistic curve: the middle is the cut with the fewest training errors, half way in its gap."""
    values = np.unique(margin)
    cuts = np.concatenate([[values[0] - 1], (values[1:] + values[:-1]) / 2, [values[-1] + 1]])
    order = np.argsort(margin)
    pos = np.concatenate([[0], np.cumsum(label[order])])
    at = np.searchsorted(margin[order], cuts)
    errors = pos[at] + (len(label) - at) - (pos[-1] - pos[at])
    best = np.flatnonzero(errors == errors.min())
    widths = [np.diff(np.concatenate([[values[0] - 2], values, [values[-1] + 2]]))[b] for b in best]
    return 4.0, float(cuts[best[int(np.argmax(widths))]])


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, score, predicted, margin of every document."""
    if model is None:
        return docs.select("doc_id", F.lit(0.0).alias("score"), F.lit(0).alias("predicted"), F.lit(EMPTY).alias("margin"))
    key = str(zlib.crc32(model.weights.tobytes()))
    send = docs.sparkSession.sparkContext.broadcast(model)

    def run(b: pa.RecordBatch) -> dict:
        margins = text_margins(send.value, key, texts(b))
        scores = [send.value.score(m) for m in margins]
        return {"doc_id": b.column("doc_id"), "score": scores, "predicted": [int(s >= 0.5) for s in scores], "margin": margins}

    return map_arrow(docs.select("doc_id", "text"), run, "doc_id long, score double, predicted int, margin double")


def keep_clean(docs: DataFrame, model: Model | None) -> DataFrame:
    """The rows of docs whose text scores below 0.5; all columns pass through."""
    if model is None:
        return docs
    key = str(zlib.crc32(model.weights.tobytes()))
    send, names = docs.sparkSession.sparkContext.broadcast(model), docs.columns

    def run(b: pa.RecordBatch) -> dict:
        keep = pa.array([send.value.score(m) < 0.5 for m in text_margins(send.value, key, texts(b))])
        return {c: b.column(c).filter(keep) for c in names}

    return map_arrow(docs, run, docs.schema)


def held_out(doc_id="doc_id"):
    return F.crc32(F.col(doc_id).cast("string")) % 5 == 0


def op7_toxicity(spark, sf_dir: str) -> DataFrame:
    """Contract op7: learns from the rows that are not held out, scores all."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = train(docs, labels.where(~held_out()))
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted", "margin")
