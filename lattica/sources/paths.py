"""Paths as people write them."""

from __future__ import annotations

import os
import unicodedata

#: Quotation marks that word processors put for straight ones.
QUOTES = {"‘": "'", "’": "'", "“": '"', "”": '"'}


def cleaned(path: str) -> str:
    """The path in normal form, without quotation marks around it, with the home folder spelled out."""
    text = "".join(QUOTES.get(c, c) for c in unicodedata.normalize("NFKC", path)).strip()
    if len(text) > 1 and text[0] == text[-1] and text[0] in "'\"":
        text = text[1:-1]
    return os.path.expanduser(text)


def store_root(path: str) -> str:
    """The innermost enclosing folder whose name ends in .zarr, or the path itself."""
    at = cleaned(path).rstrip("/")
    while at and at != "/":
        if at.endswith(".zarr"):
            return at
        at = os.path.dirname(at)
    return cleaned(path)
