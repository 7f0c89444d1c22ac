"""The filter audit against a document-by-document run of every order, and the matrix against plain counting."""

import re
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest

from kbspark.llm import filter_audit as fa
from kbspark.llm.common import Steps

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(docs, labels):
    """docs: (doc_id, text, source); labels: (doc_id, quality, toxic)."""
    fails = []
    for k, t, s in docs:
        t = t or ""
        w = WORD.findall(t)
        smallest = min((d[0] for d in docs if (d[1] or "") == t and d[0] is not None), default=None)
        f = ("A" * (len(w) < 200) + "B" * (100 * len(set(w)) < 50 * len(w)) + "C" * (100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t)) + "D" * any(c in "#$%&*|" for c in t) + "E" * (k is not None and smallest is not None and k > smallest))
        mine = [x for x in labels if x[0] == k and k is not None]
        fails.append((s or "", f, any(x[1] == 1 for x in mine), any(x[2] == 1 for x in mine)))
    out, shapley = {}, Counter()
    for part in {f[0] for f in fails}:
        for order in map("".join, permutations("ABCDE")):
            left = [f for f in fails if f[0] == part]
            for step, letter in enumerate(order, 1):
                gone = [f for f in left if letter in f[1]]
                left_before, left = left, [f for f in left if letter not in f[1]]
                earlier = sum(letter in f[1] for f in fails if f[0] == part) - sum(letter in f[1] for f in left_before)
                out[part, order, step] = [len(left), len(gone), earlier, sum(f[0] == part and f[1] == letter for f in fails), sum(f[2] for f in gone), sum(f[3] for f in gone)]
                shapley[part, letter] += len(gone)
    return {(p, o, s, *v, shapley[p, o[s - 1]]) for (p, o, s), v in out.items()}


def audited(spark, docs, labels):
    steps = Steps(spark)
    d = spark.createDataFrame(docs, "doc_id long, text string, source string")
    x = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    return {tuple(r) for r in fa.audit(fa.failures(d, x, steps), "ABCDE").collect()}


LONG = " ".join(f"word{n}" for n in range(250))


def test_equals_brute_force_on_odd_documents(spark, odd):
    docs = [tuple(r) for r in odd.select("doc_id", "text", "source").collect()]
    docs += [(20, LONG, None), (21, LONG, ""), (22, LONG + " $", "s"), (23, LONG + " ABCDEFGHIJKLMNOPQRSTUVWXYZABCDEFGHIJKLMNOPQRSTUVWXYZ", "s"), (None, LONG, "s"), (None, "only here", "t"), (20, LONG, "s"), (24, "a b " * 150, "s"), (25, "a\x0bb\x1cc\x85d e", "t"), (26, None, None)]
    labels = [(1, 1, 0), (1, 0, 1), (20, 1, 0), (22, None, 1), (23, 1, 1), (26, 1, None), (None, 1, 1)]
    assert audited(spark, docs, labels) == brute(docs, labels)


def test_many_copies_of_one_text(spark):
    docs = [(n, LONG if n % 3 else f"own {n}", f"s{n % 2}") for n in range(120)] + [(1, LONG, "s0")]
    assert audited(spark, docs, [(n, n % 2, int(n % 5 == 0)) for n in range(0, 120, 4)]) == brute(docs, [(n, n % 2, int(n % 5 == 0)) for n in range(0, 120, 4)])


def test_empty_tables(spark):
    assert audited(spark, [], []) == set()
    assert len(audited(spark, [(1, None, None)], [])) == 600


@pytest.mark.parametrize(("shard_bytes", "bucket_words"), [(1, 1), (40, 7), (1 << 20, 1 << 20)])
def test_matrix_holds_every_count_under_one_dictionary(spark, odd, shard_bytes, bucket_words):
    steps = Steps(spark)
    shards, words = fa.document_term_matrix(odd, steps, shard_bytes=shard_bytes, bucket_words=bucket_words)
    known = {r["id"]: r["word"].decode() for r in words.collect()}
    assert len(known) == words.count() == len(set(known.values()))
    got = defaultdict(Counter)
    for r in shards.collect():
        indptr, indices, counts = (np.frombuffer(r[c], t) for c, t in (("indptr", "<i8"), ("indices", "<i8"), ("counts", "<i8")))
        for n, k in enumerate(x.doc_id for x in r["row"]):
            got[k] = Counter({known[i]: c for i, c in zip(indices[indptr[n] : indptr[n + 1]].tolist(), counts[indptr[n] : indptr[n + 1]].tolist(), strict=True)})
    want = {r.doc_id: Counter(WORD.findall(r.text or "")) for r in odd.collect()}
    assert got == want
    stats = {r.row.doc_id: (r.n_words, r.n_distinct) for r in fa.row_statistics(shards).collect()}
    assert stats == {k: (c.total(), len(c)) for k, c in want.items()}
    clash = odd.withColumnRenamed("sig", "shard").withColumnRenamed("keys", "row").withColumnRenamed("rank", "n_words")
    assert fa.row_statistics(fa.document_term_matrix(clash, steps)[0]).select("row.*").columns == [c for c in clash.columns if c != "text"]
