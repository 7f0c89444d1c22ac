"""Character classes of the public tokenizers' splitting patterns, for texts below U+0250.

The splitting patterns use Unicode classes. Python's own `re` is the fastest matcher here but lacks
them, so the classes are spelled out for U+0000 to U+024F. Texts with any later character take the
library's own normaliser and splitter.
"""

from __future__ import annotations

import re
import unicodedata

LIMIT = 0x250
#: White space below U+0250 by the Unicode property (Python's \s holds four control characters more).
SPACE = "\t\n\x0b\x0c\r \x85\xa0"


def _class(test) -> str:
    """A regex character class body of the characters below LIMIT that pass the test."""
    out, c = [], 0
    while c < LIMIT:
        if test(chr(c)):
            end = c
            while end + 1 < LIMIT and test(chr(end + 1)):
                end += 1
            out.append(f"\\u{c:04x}" if c == end else f"\\u{c:04x}-\\u{end:04x}")
            c = end
        c += 1
    return "".join(out)


LETTER = _class(lambda c: unicodedata.category(c)[0] == "L")
NUMBER = _class(lambda c: unicodedata.category(c)[0] == "N")
BLANK = _class(lambda c: c in SPACE)
LATER = re.compile(f"[^\\u0000-\\u{LIMIT - 1:04x}]")
#: Splits lower-cased text as the word-end vocabulary does.
WORD_SPLIT = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTER}]+|[{NUMBER}]|[^{BLANK}{LETTER}{NUMBER}]+")
#: Splits text as the byte-level vocabulary does.
BYTE_SPLIT = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTER}]+| ?[{NUMBER}]+| ?[^{BLANK}{LETTER}{NUMBER}]+|[{BLANK}]+(?![^{BLANK}])|[{BLANK}]+")


def byte_alphabet() -> dict[int, str]:
    """Byte to the printable character that stands for it in byte-level vocabularies."""
    kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {b: chr(b) for b in kept}
    for n, b in enumerate(x for x in range(256) if x not in out):
        out[b] = chr(256 + n)
    return out
