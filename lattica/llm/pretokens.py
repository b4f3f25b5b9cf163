"""Pre-tokens of the byte-level pattern, cut by Python's own `re` where that provably cuts as the library does."""

from __future__ import annotations

import re

import regex

#: Below this code point (Latin, Greek, Cyrillic) every Unicode version that the libraries know agrees on the classes.
SAME_BELOW = 0x530


def _ranges(kind: str) -> str:
    """The code points below SAME_BELOW of a property, as the inside of a character class."""
    one, out, start = regex.compile(kind), "", None
    for c in range(SAME_BELOW + 1):
        if c < SAME_BELOW and one.match(chr(c)):
            start = c if start is None else start
        elif start is not None:
            out += f"\\u{start:04x}-\\u{c - 1:04x}"
            start = None
    return out


_L, _N, _S = (_ranges(p) for p in (r"\p{L}", r"\p{N}", r"\p{White_Space}"))
#: Fixed value in its order: the pre-tokenisation pattern of the public byte-level tokenizer, with its classes spelled out.
CUT = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
BEYOND = regex.compile(f"[^\\x00-\\u{SAME_BELOW - 1:04x}]")


def plain(text: str) -> bool:
    """Whether CUT cuts the text as the library does."""
    return BEYOND.search(text) is None
