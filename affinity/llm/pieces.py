"""Splitting text into the pieces that a tokenizer's merges never cross.

`\\p{L}` and `\\p{N}` need the `regex` module, which is slow. Texts made only
of common characters (ASCII and the Latin blocks up to U+024F) give the same
pieces with the standard `re` module once the two classes are spelled out as
character ranges; all other texts take the exact pattern.
"""

from __future__ import annotations

import re
import unicodedata

import regex

LAST_COMMON = 0x24F
# U+0130 lower-cases to two characters; the control characters and U+00A0 are
# white space for some engines only.
COMMON = "\t\n\r\\x20-\\x7e¡-įı-ɏ"
_UNCOMMON = re.compile(f"[^{COMMON}]")


def is_common(text: str) -> bool:
    return _UNCOMMON.search(text) is None


def _ranges(kind: str) -> str:
    """The common characters of one Unicode general category, as ranges of a class."""
    out, run = [], None
    for code in range(LAST_COMMON + 2):
        inside = code <= LAST_COMMON and unicodedata.category(chr(code))[0] == kind
        if inside and run is None:
            run = code
        elif not inside and run is not None:
            out.append(f"\\u{run:04x}-\\u{code - 1:04x}")
            run = None
    return "".join(out)


class Splitter:
    """`findall` of a pattern that uses `\\p{L}`, `\\p{N}` and `\\s`."""

    def __init__(self, pattern: str):
        parts = re.split(r"(\\p\{[LN]\}|\\.|\[|\])", pattern)
        inside = False
        for i, part in enumerate(parts):
            if part in ("[", "]"):
                inside = part == "["
            elif part in ("\\p{L}", "\\p{N}"):
                ranges = _ranges(part[3])
                parts[i] = ranges if inside else f"[{ranges}]"   # inside a class the ranges stand alone
        plain = "".join(parts)
        self._fast = re.compile(plain)
        self._exact = regex.compile(pattern)

    def __call__(self, text: str) -> list[str]:
        return (self._fast if is_common(text) else self._exact).findall(text)
