"""Personal data: base patterns, and a skip-chain conditional random field that adds what they miss.

Base spans are leftmost non-overlapping pattern matches of each kind, checked (address parts, Luhn sum,
digit counts) and dropped without retry where the check fails.

The field's nodes are the tokens that hold a digit or '@' (all other tokens are outside any entity).
Potentials: a token's shape features; neighbouring nodes; and skip edges between nodes of the same
normal form (lower case, digits and letters only) anywhere in the document, each occurrence tied to one
hub variable of its form, so n repeats make n edges and any two are two steps apart. Base spans are
observed, and with them their form's hub, which unobserved occurrences then cannot outvote. Loopy message
passing (sum-product, until the messages of a document settle) spreads the labels; tokens whose best label
is an entity and that touch no base span are joined to added spans. Weights are fitted on a sample of at most SAMPLE documents, whose base spans give
the labels: shapes by logistic regression, both kinds of edges from label co-occurrence.

Cases: null and empty texts have no spans; repeated rows get equal results; ties between labels go to
the earlier kind; an empty table gives no rows; other columns are ignored; long digit strings and long
texts are read whole in linear time.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kbspark.llm.common import map_arrow, texts

KINDS = ("email", "ip", "card", "phone")
SAMPLE = 2000  #: documents that the weights are fitted on, at most
SETTLED, MOST_ROUNDS = 1e-4, 1000  #: messages that change by less are settled; a bound for those that never do
REPEATS = 20.0  #: prior count of agreeing repeats for each label
OBSERVED = 8.0  #: log odds of a base span's label

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A run of digits is tried from its start only: a later start would end at the same place.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_SIGN = re.compile(r"[0-9@]")
_REST = re.compile(r"\S*")
_FORM = re.compile(r"[\W_]+")


def luhn(digits: str) -> bool:
    total = 0
    for n, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if n % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Matches of local part, '@' and dotted domain, found from each '@': its local part reaches as far left as it can."""
    out, end = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            end = m.end()
        at = text.find("@", max(end, at + 1))
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end), by kind and then start."""
    out = [(0, s, e) for s, e in emails(text)]
    if "." in text:
        for m in _IP.finditer(text):
            if all(len(p) <= 3 and int(p or 0) <= 255 for p in (x.lstrip("0") for x in m[0].split("."))):
                out.append((1, *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := re.sub("[ -]", "", m[0])) <= 19 and luhn(d):
            out.append((2, *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum(map(str.isdecimal, m[0])) <= 15:
                out.append((3, *m.span()))
    return out


def candidates(text: str) -> list[tuple[int, int]]:
    """The tokens that hold a digit or '@'."""
    out, end = [], 0
    for m in _SIGN.finditer(text):
        if m.start() < end:
            continue
        start = m.start()
        while start > end and not text[start - 1].isspace():
            start -= 1
        end = _REST.match(text, m.start()).end()
        out.append((start, end))
    return out


def _digits(token: str) -> str:
    return "".join(c for c in token if "0" <= c <= "9")


def shape(token: str) -> list[int]:
    """Features of a token, as places of a 0/1 vector of FEATURES."""
    digits = sum(c.isdigit() for c in token)
    letters = sum(c.isalpha() for c in token)
    bucket = 0 if digits == 0 else 1 if digits < 3 else 2 if digits < 5 else 3 if digits < 8 else 4 if digits < 12 else 5 if digits < 16 else 6 if digits < 20 else 7
    out = [0, 1 + bucket]
    flags = ("@" in token, token.count(".") == 3, token.count(".") == 1, token.startswith("+"), "-" in token, "(" in token or ")" in token, letters > 0, letters > digits, "/" in token or ":" in token, token[-1:] in ".,;!?", digits >= 13 and luhn(_digits(token)), digits >= 13 and not luhn(_digits(token)))
    return out + [9 + n for n, f in enumerate(flags) if f]


FEATURES = 21


@dataclass
class Field:
    """Potentials: shape weights (features x labels), and log potentials of neighbours and of skip edges (labels x labels)."""

    shape: np.ndarray
    chain: np.ndarray
    skip: np.ndarray


@dataclass
class Graph:
    """Nodes and edges of one or more documents."""

    spans: list[tuple[int, int]]
    features: list[list[int]]
    observed: list[int]  # 0, or 1 + kind of a base span
    edges: list[tuple[int, int, int]]  # node, node, 0 neighbour or 1 skip (each repeat to the next; these teach)
    forms: list[list[int]]  # nodes of each normal form that repeats


def graph(text: str, base: list[tuple[int, int, int]]) -> Graph:
    spans = candidates(text)
    observed, k = [0] * len(spans), 0
    by_start = sorted((s, e, kind) for kind, s, e in base)
    for n, (s, e) in enumerate(spans):
        while k < len(by_start) and by_start[k][1] <= s:
            k += 1
        for bs, be, kind in by_start[k : k + 4]:
            if bs < e and be > s:
                observed[n] = 1 + kind
                break
    edges, last, forms = [], {}, {}
    for n, (s, e) in enumerate(spans):
        if n and s - spans[n - 1][1] <= 2:
            edges.append((n - 1, n, 0))
        form = _FORM.sub("", text[s:e].lower())
        if len(form) >= 3:
            if form in last and (not edges or edges[-1][:2] != (last[form], n)):
                edges.append((last[form], n, 1))
            last[form] = n
            forms.setdefault(form, []).append(n)
    return Graph(spans, [shape(text[s:e]) for s, e in spans], observed, edges, [f for f in forms.values() if len(f) > 1])


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def infer(graphs: list[Graph], field: Field) -> list[np.ndarray]:
    """The best label of each node (0 outside, 1 + kind), by loopy message passing over all graphs at once."""
    sizes = [len(g.spans) for g in graphs]
    total, labels = sum(sizes), 1 + len(KINDS)
    if not total:
        return [np.zeros(0, int) for _ in graphs]
    unary = np.zeros((total, labels))
    rows = np.repeat(np.arange(total), [len(f) for g in graphs for f in g.features])
    np.add.at(unary, rows, field.shape[[x for g in graphs for f in g.features for x in f]])
    seen = np.array([o for g in graphs for o in g.observed])
    unary[np.flatnonzero(seen), seen[seen > 0]] += OBSERVED
    base, ends, hubs = 0, [], []  # ends: node, node, 0 neighbour or 1 skip, graph, 1 if the first node alone speaks
    for at, (g, n) in enumerate(zip(graphs, sizes, strict=True)):
        ends += [(base + i, base + j, k, at, 0) for i, j, k in g.edges if k == 0]
        for form in g.forms:
            hub, potential = total + len(hubs), np.zeros(labels)
            for i in form:
                if g.observed[i]:
                    potential[g.observed[i]] += OBSERVED
            hubs.append(potential)
            ends += [(hub, base + i, 1, at, int(potential.any())) for i in form]
        base += n
    belief = unary = np.concatenate([unary, *(h[None] for h in hubs)])
    if ends:
        i, j, kind, owner, one_way = np.array(ends).T
        source, target, owner = np.concatenate([i, j]), np.concatenate([j, i]), np.concatenate([owner, owner])
        tables = np.stack([field.chain, field.skip])[np.concatenate([kind, kind])]
        back = np.concatenate([np.arange(len(i)) + len(i), np.arange(len(i))])
        message = np.zeros((len(source), labels))
        speaks = np.concatenate([np.ones(len(i), bool), one_way == 0])
        live = np.flatnonzero(speaks)
        for _ in range(MOST_ROUNDS):
            belief = unary.copy()
            np.add.at(belief, target, message)
            out = _log_sum((belief[source[live]] - message[back[live]])[:, :, None] + tables[live], 1)
            new = 0.5 * message[live] + 0.5 * (out - out.max(axis=1, keepdims=True))
            moved = np.zeros(len(graphs))
            np.maximum.at(moved, owner[live], np.abs(new - message[live]).max(axis=1))
            message[live] = new
            live = live[moved[owner[live]] > SETTLED]  # a settled document rests, whatever others do
            if not len(live):
                break
        belief = unary.copy()
        np.add.at(belief, target, message)
    best = belief[:total].argmax(axis=1)
    return np.split(best, np.cumsum(sizes)[:-1])


def added_spans(text: str, base: list[tuple[int, int, int]], g: Graph, label: np.ndarray) -> list[tuple[int, int, int]]:
    """Runs of neighbouring nodes with one label that touch no base span, without outer punctuation."""
    out, n = [], 0
    taken = sorted((s, e) for _, s, e in base)
    while n < len(label):
        if label[n] == 0 or g.observed[n]:
            n += 1
            continue
        end = n
        while end + 1 < len(label) and label[end + 1] == label[n] and not g.observed[end + 1] and g.spans[end + 1][0] - g.spans[end][1] <= 2:
            end += 1
        s, e = g.spans[n][0], g.spans[end][1]
        while s < e and not (text[s].isalnum() or text[s] in "+("):
            s += 1
        while e > s and not text[e - 1].isalnum():
            e -= 1
        if s < e and not any(a < e and b > s for a, b in taken):
            out.append((int(label[n]) - 1, s, e))
        n = end + 1
    return out


def find(many: list[str], field: Field) -> list[tuple[list, list]]:
    """Base spans and all spans of each text."""
    out, at, graphs = [], [], []
    for n, t in enumerate(many):
        base = base_spans(t) if _SIGN.search(t) else []
        out.append((base, base))
        # without a base span there is nothing to agree with, but shapes may still speak
        if g := graph(t, base) if _SIGN.search(t) else None:
            graphs.append(g)
            at.append(n)
    for n, g, label in zip(at, graphs, infer(graphs, field), strict=True):
        base = out[n][0]
        out[n] = (base, sorted(base + added_spans(many[n], base, g, label)))
    return out


def fit(many: list[str]) -> Field:
    """Weights from the base spans of sample texts."""
    graphs = [graph(t, base_spans(t)) for t in many]
    labels = 1 + len(KINDS)
    y = np.array([o for g in graphs for o in g.observed], int)
    w = np.zeros((FEATURES, labels))
    w[0, 0] = 3.0  # outside, unless shapes say otherwise
    if len(y):
        x = np.zeros((len(y), FEATURES))
        for n, f in enumerate(f for g in graphs for f in g.features):
            x[n, f] = 1
        patterns, inverse = np.unique(x, axis=0, return_inverse=True)
        count = np.zeros((len(patterns), labels))
        np.add.at(count, (inverse.ravel(), y), 1.0)
        for _ in range(400):
            p = np.exp(patterns @ w - _log_sum(patterns @ w, 1)[:, None])
            w += 2.0 * (patterns.T @ (count - p * count.sum(axis=1, keepdims=True)) / len(y) - 1e-3 * w)
    pairs = np.ones((2, labels, labels)) * 0.5
    pairs[1] += REPEATS * np.eye(labels)  # before any evidence, repeats are taken to agree
    for g in graphs:
        for i, j, k in g.edges:
            pairs[k, g.observed[i], g.observed[j]] += 1
            pairs[k, g.observed[j], g.observed[i]] += 1
    share = pairs / pairs.sum(axis=(1, 2), keepdims=True)
    side = share.sum(axis=2)
    lift = np.log(share / (side[:, :, None] * side[:, None, :]))
    return Field(w, np.clip(lift[0], -2, 2), np.clip(lift[1], -3, 3))


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)


def find_spans(docs: DataFrame, field: Field | None = None, sample: int = SAMPLE) -> DataFrame:
    """doc_id, counts of base spans, base (string), spans (string) of every row of docs(doc_id, text)."""
    if field is None:
        chosen = docs.where(F.regexp_like("text", F.lit("[0-9@]"))).select("doc_id", F.xxhash64("doc_id").alias("h")).orderBy("h", "doc_id").limit(sample)
        # the sample's row bound makes this small; only texts of bounded length teach
        rows = docs.join(F.broadcast(chosen.select("doc_id").distinct()), "doc_id").where(F.length("text") <= 20_000).select("text").limit(sample).collect()
        field = fit(sorted(r["text"] for r in rows))
    send = docs.sparkSession.sparkContext.broadcast(field)

    def run(b: pa.RecordBatch) -> dict:
        found = find(texts(b), send.value)
        count = lambda k: [sum(x[0] == k for x in base) for base, _ in found]
        return {"doc_id": b.column("doc_id"), **{f"n_{kind}": count(k) for k, kind in enumerate(KINDS)}, "base": [joined(base) for base, _ in found], "spans": [joined(every) for _, every in found]}

    return map_arrow(docs.select("doc_id", "text"), run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base string, spans string", rows=256)


def op1_pii(spark, sf_dir: str) -> DataFrame:
    """Contract op1 over whole documents."""
    found = find_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans")


