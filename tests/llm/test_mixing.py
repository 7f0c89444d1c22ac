"""Entropy balancing against a plain version by halving, and its bounds on odd documents."""

import math
import re
from collections import defaultdict
from hashlib import md5

import pytest

from kbspark.llm import mixing
from kbspark.llm.common import Steps

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(docs, weights=(1, 2, 3), most=3):
    """docs: (doc_id, text, source) -> sorted rows (doc_id, source, size, source_size, target, copies)."""
    rows = [(k, len(WORD.findall(t or "")), s) for k, t, s in docs]
    names = sorted({s for *_, s in rows if s is not None}) + [None] * any(s is None for *_, s in rows)
    words = {s: sum(n for _, n, x in rows if x == s) for s in names}
    weigh = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    full, level = set(), 0.0
    while True:
        level = (sum(words.values()) - sum(most * words[s] for s in full)) / max(1, sum(weigh[s] for s in names if s not in full))
        more = {s for s in names if level * weigh[s] > most * words[s]}
        if more == full:
            break
        full = more
    out = []
    for s in names:
        target = float(most * words[s]) if s in full else level * weigh[s]
        cells = defaultdict(list)
        for k, n, x in rows:
            if x == s:
                cells[n].append(k)
        lo, hi = -50.0, math.log(most)
        for _ in range(200 if words[s] else 0):
            lam = (lo + hi) / 2
            lo, hi = (lam, hi) if sum(len(c) * n * math.exp(min(lam * n, math.log(most))) for n, c in cells.items()) < target else (lo, lam)
        copies, upto, gone = {}, 0, 0
        for n in sorted(cells, reverse=True):
            upto += len(cells[n]) * round(math.exp(min(hi * n, math.log(most))) * 10**9)
            copies[n] = (upto + 5 * 10**8) // 10**9 - gone
            gone += copies[n]
        gap = math.floor(target + 0.5) - sum(n * c for n, c in copies.items())
        for n in sorted(cells, reverse=True):
            room = most * len(cells[n]) - copies[n] if gap > 0 else copies[n]
            if 0 < n <= abs(gap) and room > 0:
                k = min(room, abs(gap) // n) * (1 if gap > 0 else -1)
                copies[n], gap = copies[n] + k, gap - k * n
        for n, ids in cells.items():
            ids.sort(key=lambda k: (md5(("" if k is None else str(k)).encode()).hexdigest(), k or 0))
            out += [(k, s, n, words[s], target, copies[n] // len(ids) + (i < copies[n] % len(ids))) for i, k in enumerate(ids)]
    return sorted(out, key=repr)


def mixed(spark, docs, **kw):
    d = spark.createDataFrame(docs, "doc_id long, text string, source string")
    rows = mixing.mix(d, Steps(spark), **kw).collect()
    assert all(r.taken == r.copies * r["size"] and 0 <= r.copies <= 3 for r in rows)
    return sorted([(r.doc_id, r.source, r["size"], r.source_size, r.target, r.copies) for r in rows], key=repr)


DOCS = [(n, "w " * (1 + n * n % 37), f"s{n % 5}") for n in range(150)]


def close(a, b):
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        assert x[:4] == y[:4] and x[5] == y[5] and x[4] == pytest.approx(y[4], rel=1e-12)


def test_equals_plain_version(spark):
    close(mixed(spark, DOCS), brute(DOCS))


def test_small_sources_stop_at_three_times_their_words(spark):
    docs = [(n, "w " * (5 + n % 3), "a" if n % 30 else "b" if n % 60 else "c") for n in range(200)] + [(900, "x", None), (901, None, ""), (902, " \t", "empty"), (903, "é\x1cé \x0b y", "é"), (903, "z z", "é"), (None, "q q q", "é")]
    got = mixed(spark, docs)
    close(got, brute(docs))
    assert {r[5] for r in got if r[1] is None} == {3}


def test_odd_documents_and_empty_table(spark, odd, none):
    docs = [tuple(r) for r in odd.select("doc_id", "text", "source").collect()]
    close(mixed(spark, docs), brute(docs))
    clash = odd.withColumnRenamed("sig", "size").withColumnRenamed("keys", "key").withColumnRenamed("rank", "n")
    assert mixing.mix(clash, Steps(spark)).count() == odd.count()
    assert mixing.mix(none, Steps(spark)).count() == 0


def test_hot_cell_is_dealt_in_parts(spark):
    """Most rows share one source and one size; parts of it keep its copies in sum, whatever their number."""
    docs = [(n, "a b c d", "hot") for n in range(400)] + [(1000 + n, "w " * (n + 1), "other") for n in range(20)]
    got, want = mixed(spark, docs, part_rows=16), brute(docs)
    add = lambda rows, s: sum(r[2] * r[5] for r in rows if r[1] == s)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    for s in ("hot", "other"):
        assert add(got, s) == add(want, s)
    assert got == mixed(spark, docs, part_rows=16)


def test_shuffled_way_equals_sent_way(spark, monkeypatch):
    want = mixed(spark, DOCS)
    monkeypatch.setattr(mixing, "SMALL", 0)
    assert mixed(spark, DOCS) == want
