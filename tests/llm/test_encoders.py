import zlib

import numpy as np
import public_tokenizers
import pytest
from tests.llm.conftest import ODD
from tokenizers import Tokenizer
from tokenizers.models import Unigram

from kbspark.llm import bpe, pfor, token_counts, token_output

WORDS, BYTES, PIECES = (public_tokenizers.path(f) for f in ("word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"))
TEXTS = ["", "a", "don't we'll 'S 'tis", "x  y \n\n z\t\r\n", "½ ² ª º 12٣ İstanbul ΑΣΣ", "<|endoftext|> hi", "a\x1cb\x85c\xa0d", "日本語 🎉", "é café", "__ --''s !'s ''", " a b", "loweiß geht"]


@pytest.mark.parametrize("n", [0, 1, 127, 128, 129, 5000])
def test_pfor_round_trip(n):
    ids = np.random.default_rng(n).integers(0, 50_000, n).astype(np.uint32)
    ids[::37] = 2**32 - 1
    data = pfor.encode(np.array([7, 8]), np.array([n, 0]), ids)
    keys, lengths, back = pfor.decode(data)
    assert keys.tolist() == [7, 8] and lengths.tolist() == [n, 0] and (back == ids).all()
    if n:
        assert (np.concatenate([pfor.block(data, k) for k in range(-(-n // pfor.BLOCK))]) == ids).all()


def test_byte_encoder_is_the_library():
    tok = Tokenizer.from_file(BYTES)
    own = token_output.ByteEncoder(BYTES).encode_many(TEXTS)
    assert [x.tolist() for x in own] == [tok.encode(t, add_special_tokens=False).ids for t in TEXTS]


def test_word_encoder_is_the_library():
    tok, v = Tokenizer.from_file(WORDS), bpe.vocabulary(WORDS)
    words = sorted({w for t in TEXTS for w in v.words(t) or ()})[::2]
    lexicon = bpe.compile_lexicon(words, [v.merge(w) for w in words])
    assert sorted(bpe.Lexicon(lexicon).find(words).tolist()) == list(range(len(words)))
    assert bpe.Lexicon(lexicon).find(["zzqq", ""]).tolist() == [-1, -1]
    for t, (raw, said) in zip(TEXTS, bpe.WordEncoder(WORDS, lexicon).encode_many(TEXTS), strict=True):
        ids = tok.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(raw, "<u4").tolist() == ids and said == tok.decode(ids, skip_special_tokens=False)


def test_word_encoder_is_the_library_for_every_low_character_and_later_ones():
    """Every character below U+0250 alone and in words, random texts of these, and random texts of later ones."""
    low, rng = [chr(c) for c in range(0x250)], np.random.default_rng(6)
    later = [*"\u0250\u0307\u03a3\u03c2\u0130\u1e9e\u212a\u212b\u3042\u65e5\u0663\u2167\ufb01\u200d\u2003\u0345\U0001f600", *"aI '.9"]
    many = [f(c) for c in low for f in (lambda c: c, lambda c: f"a{c}b", lambda c: f"LA{c}A{c} {c}{c}", lambda c: f"{c}'s9{c}")]
    many += ["".join(rng.choice(low, rng.integers(1, 30))) for _ in range(5000)] + ["".join(rng.choice(low[:384] + later * 9, rng.integers(1, 20))) for _ in range(2000)]
    tok, v = Tokenizer.from_file(WORDS), bpe.vocabulary(WORDS)
    words = sorted({w for t in many for w in v.words(t) or ()})[::3]
    got = bpe.WordEncoder(WORDS, bpe.compile_lexicon(words, [v.merge(w) for w in words])).encode_many(many)
    wrong = [t for t, e, (raw, said) in zip(many, tok.encode_batch(many, add_special_tokens=False), got, strict=True) if np.frombuffer(raw, "<u4").tolist() != e.ids or said != tok.decode(e.ids, skip_special_tokens=False)]
    assert wrong == []


def test_bpe_over_odd_documents(spark, odd, none):
    tok = Tokenizer.from_file(WORDS)
    got = {r.doc_id: r for r in bpe.encode(odd, WORDS, 50).collect()}
    for k, t in ODD:
        ids = tok.encode(t or "", add_special_tokens=False).ids
        assert np.frombuffer(got[k].ids, "<u4").tolist() == ids and got[k].decoded == tok.decode(ids, skip_special_tokens=False)
    assert bpe.encode_digests(none, WORDS).count() == 0


def test_token_files(spark, odd, none, tmp_path):
    tok = Tokenizer.from_file(BYTES)
    token_output.write_token_files(odd, str(tmp_path / "a"), BYTES, segment_ids=1000)
    rows = {r.doc_id: r for r in token_output.read_token_files(spark, str(tmp_path / "a")).collect()}
    start = 0
    for k, t in sorted(ODD):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        assert (rows[k].start, rows[k].n_tokens, rows[k].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    token_output.write_token_files(none, str(tmp_path / "b"), BYTES)
    assert token_output.read_token_files(spark, str(tmp_path / "b")).count() == 0


def test_counts_are_the_unigram_tokenizer(spark, odd, none):
    vocabulary = [("<unk>", 0.0), *token_counts.pieces(PIECES)]
    unknown = min(s for _, s in vocabulary)
    tok = Tokenizer(Unigram([("<unk>", unknown), *vocabulary[1:]], unk_id=0))
    counter = token_counts.counter(PIECES)
    for t in [*TEXTS, *(t or "" for _, t in ODD[:4] + ODD[5:])]:
        text = "".join(token_counts.MARK + w for w in t.split())
        assert counter.count(t)[0] == (len(tok.encode(text, add_special_tokens=False).ids) if text else 0), t
    got = {r.doc_id: r.n_pieces for r in token_counts.token_counts(odd, PIECES).collect()}
    assert got[2] == got[3] == got[4] == 0 and got[1] == got[6] > 0
    assert token_counts.token_counts(none, PIECES).count() == 0


def test_null_ids_keep_their_place(spark, tmp_path):
    docs = spark.createDataFrame([(None, "a b"), (3, "c"), (3, "c")], "doc_id long, text string")
    token_output.write_token_files(docs, str(tmp_path / "c"), BYTES)
    rows = token_output.read_token_files(spark, str(tmp_path / "c")).collect()
    assert sorted((r.start, r.doc_id, r.n_tokens) for r in rows) == [(0, None, 3), (3, 3, 2), (5, 3, 2)]
