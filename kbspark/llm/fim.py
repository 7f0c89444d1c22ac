"""Fill-in-the-middle transformation: each document is cut twice and its pieces are put out with the middle last.

A text is a row of units: runs of ASCII letters, and every other character by itself. All searching is done on the
text's UTF-8 bytes. Cuts are found among the starts of units, as byte offsets; `Exceptions` holds the multibyte
characters' places and excess bytes only, so a cut in an ASCII text is the same number in bytes and code points, and
in any other text one binary search away from it. No array of all characters is ever made.

Cases: null text is the empty text, and an empty text is plain; a text that holds a marker is plain, whatever its
hash; a text of any length is one row, its work and memory linear in its bytes, taken in pieces of 1 MB; equal rows
give equal rows, and texts under one doc_id are cut by the same numbers; a null doc_id hashes like an id without digits;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kbspark.llm.common import map_arrow, table, texts

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PIECE = 1 << 20  #: bytes that are looked at together
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True


class Exceptions:
    """The multibyte characters of a text: where each starts (in bytes) and the excess bytes up to and with each."""

    def __init__(self, data: np.ndarray):
        at, extra = [], []
        for base in range(0, len(data), PIECE):
            piece = data[base : base + PIECE]
            lead = np.flatnonzero(piece >= 0xC0)
            if len(lead):
                at.append(lead + base)
                extra.append(1 + (piece[lead] >= 0xE0).astype(np.int64) + (piece[lead] >= 0xF0))
        self.at = np.concatenate(at) if at else np.empty(0, np.int64)
        self.excess = np.concatenate([[0], np.cumsum(np.concatenate(extra))]) if extra else np.zeros(1, np.int64)
        self.char_at = self.at - self.excess[:-1]  #: their places in code points

    def to_chars(self, byte: int) -> int:
        """The code points before a byte offset at which a character starts."""
        return byte - int(self.excess[np.searchsorted(self.at, byte)]) if len(self.at) else byte

    def to_bytes(self, char: int) -> int:
        """The bytes before the character of that number."""
        return char + int(self.excess[np.searchsorted(self.char_at, char)]) if len(self.at) else char


def _starts(data: np.ndarray, base: int) -> np.ndarray:
    """Which bytes of the piece at `base` start a unit."""
    piece = data[base : base + PIECE]
    letter = _LETTER[piece]
    after = np.empty(len(piece), bool)  # whether a letter stands before
    after[0] = base > 0 and _LETTER[data[base - 1]]
    after[1:] = letter[:-1]
    return np.where(letter, ~after, (piece & 0xC0) != 0x80)


def unit_counts(data: np.ndarray) -> np.ndarray:
    """The number of units that start in each piece."""
    return np.array([np.count_nonzero(_starts(data, base)) for base in range(0, len(data), PIECE)], np.int64)


def unit_offset(data: np.ndarray, counts: np.ndarray, k: int) -> int:
    """The byte offset after the first k units."""
    ends = np.cumsum(counts)
    if k == 0 or not len(ends) or k >= ends[-1]:
        return 0 if k == 0 else len(data)
    piece = int(np.searchsorted(ends, k, side="right"))
    return piece * PIECE + int(np.flatnonzero(_starts(data, piece * PIECE))[k - int(ends[piece] - counts[piece])])


def draws(doc_id: int | None) -> tuple[int, ...]:
    """h1 to h4 of a document."""
    h = sha256(b"1:" + (b"" if doc_id is None else str(doc_id).encode())).digest()
    return tuple(int.from_bytes(h[i : i + 4], "big") for i in (0, 4, 8, 12))


def transform(text: str, doc_id: int | None, plain_from: int = 90, spm_below: int = 20) -> tuple[int, str, int | None, int | None, str]:
    """(units, form, prefix and middle length in code points, output) of one text."""
    raw = text.encode("utf-8", "surrogatepass")
    data = np.frombuffer(raw, np.uint8)
    counts = unit_counts(data)
    n = int(counts.sum())
    h1, h2, h3, h4 = draws(doc_id)
    if not text or h3 % 100 >= plain_from or any(m in text for m in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, text
    one, two = sorted((h1 % (n + 1), h2 % (n + 1)))
    index = Exceptions(data)
    a, b = (index.to_chars(unit_offset(data, counts, k)) for k in (one, two))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < spm_below:
        return n, "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def fill_in_middle(docs: DataFrame, plain_from: int = 90, spm_below: int = 20) -> DataFrame:
    """docs(doc_id, text) as doc_id, n, form, prefix_chars, middle_chars, output; one row for each."""

    def run(batch: pa.RecordBatch) -> dict:
        ids = batch.column("doc_id").to_pylist()
        n, form, prefix, middle, output = zip(*(transform(t, k, plain_from, spm_below) for k, t in zip(ids, texts(batch), strict=True)), strict=True) if ids else ([],) * 5
        return {"doc_id": ids, "n": n, "form": form, "prefix_chars": prefix, "middle_chars": middle, "output": output}

    schema = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"
    return map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), run, schema, rows=64)


def restore(output: str = "output", form: str = "form") -> F.Column:
    """The text of an output; no cut text holds a marker and no marker can overlap another, so they split it."""
    p = F.split(F.col(output), f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    return F.when(F.col(form) == "psm", F.concat(p[1], p[3], p[2])).when(F.col(form) == "spm", F.concat(p[2], p[3], p[1])).otherwise(F.col(output))


def op13_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract op13: the form and cuts of every document, with digests of its output and of the text restored from it."""
    out = fill_in_middle(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restore(), 256).alias("restored_sha256"))


SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
h AS (SELECT doc_id, text, u, len(u) AS n, CAST('0x' || h[1:8] AS UBIGINT) AS h1, CAST('0x' || h[9:16] AS UBIGINT) AS h2, CAST('0x' || h[17:24] AS UBIGINT) AS h3, CAST('0x' || h[25:32] AS UBIGINT) AS h4 FROM t),
c AS (SELECT *, CAST(least(h1 % (n + 1), h2 % (n + 1)) AS BIGINT) AS a, CAST(greatest(h1 % (n + 1), h2 % (n + 1)) AS BIGINT) AS b,
 CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, array_to_string(u[1:a], '') AS pre, array_to_string(u[a + 1:b], '') AS mid, array_to_string(u[b + 1:], '') AS suf FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
 sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(text) AS restored_sha256 FROM p"""
