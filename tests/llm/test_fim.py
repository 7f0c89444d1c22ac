"""Fill-in-the-middle against a version by regular expressions, and the exact way back."""

import re
from hashlib import sha256

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from kbspark.llm import fim

UNIT = re.compile(r"[A-Za-z]+|[^A-Za-z]", re.S)


def brute(text, doc_id):
    text = text or ""
    units = UNIT.findall(text)
    h = sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return len(units), "plain", None, None, text
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < 20:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@given(st.text(st.sampled_from("abZ 1<>PSM\n\r\u0085éßλ日🎉́"), max_size=40), st.integers(-5, 10**12))
def test_equals_brute_force(text, doc_id):
    assert fim.transform(text, doc_id) == brute(text, doc_id)


@pytest.mark.parametrize("piece", [1, 2, 3, 7])
def test_cuts_at_every_unit_in_small_pieces(monkeypatch, piece):
    monkeypatch.setattr(fim, "PIECE", piece)
    for text in ("", "abc", "ab é日 cd🎉x", "日本語", "aé" * 5, "x" * 30):
        data, units = np.frombuffer(text.encode(), np.uint8), UNIT.findall(text)
        counts, index = fim.unit_counts(data), fim.Exceptions(np.frombuffer(text.encode(), np.uint8))
        assert counts.sum() == len(units)
        for k in range(len(units) + 1):
            chars = len("".join(units[:k]))
            at = fim.unit_offset(data, counts, k)
            assert (at, index.to_chars(at), index.to_bytes(chars)) == (len("".join(units[:k]).encode()), chars, at)
        assert len(index.at) == sum(len(c.encode()) > 1 for c in text)  # ASCII leaves no entry


def test_odd_documents(spark, odd):
    more = spark.createDataFrame([(10, "has <P> inside"), (11, "<S>"), (None, "no id here"), (12, "ends in <"), (12, "ends in <"), (13, "日本" * 40_000)], "doc_id long, text string")
    docs = odd.select("doc_id", "text").unionByName(more)
    got = fim.fill_in_middle(docs).select("*", fim.restore().alias("restored")).collect()
    want = [(r.doc_id, *brute(r.text, r.doc_id), r.text or "") for r in docs.collect()]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_clashing_columns_and_empty_table(odd, none):
    extra = odd.withColumnRenamed("sig", "output").withColumnRenamed("keys", "form").withColumnRenamed("rank", "n")
    assert fim.fill_in_middle(extra).columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    assert fim.fill_in_middle(extra).count() == odd.count()
    assert fim.fill_in_middle(none).count() == 0
