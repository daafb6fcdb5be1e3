"""Splits text into the pre-tokens of the byte-level BPE vocabularies.

``regex`` with the public pattern is right for every text. Nine texts in ten
hold only characters below U+0250; for these the same alternatives are spelled
out as explicit classes for the standard library's faster matcher.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import regex

TOP = 0x250


def _class(prop: str) -> str:
    return "".join(f"\\u{c:04x}" for c in range(TOP) if regex.match(prop, chr(c)))


def splitter(pattern: str, known: str) -> Callable[[str], list[str]]:
    """``pattern.findall``. The fast path is taken only if ``pattern`` is ``known``, the one it spells out."""
    slow = regex.compile(pattern).findall
    if pattern != known:
        return slow
    letter, number, space = _class(r"\p{L}"), _class(r"\p{N}"), _class(r"\s")
    fast = re.compile(
        f"'s|'t|'re|'ve|'m|'ll|'d| ?[{letter}]+| ?[{number}]+| ?[^{space}{letter}{number}]+|[{space}]+(?![^{space}])|[{space}]+"
    ).findall
    other = re.compile(f"[^\\x00-\\u{TOP - 1:04x}]").search
    return lambda text: slow(text) if other(text) else fast(text)


class Memo(dict):
    """A bounded cache: emptied when it holds ``limit`` keys, so memory doesn't grow with the corpus."""

    def __init__(self, make: Callable, limit: int, first: dict | None = None):
        super().__init__(first or {})
        self.make, self.limit, self.first = make, limit, first or {}

    def __missing__(self, key):
        if len(self) >= self.limit:
            self.clear()
            self.update(self.first)
        value = self[key] = self.make(key)
        return value
