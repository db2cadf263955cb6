"""Words and sentences of prose."""

from __future__ import annotations

import re
from collections.abc import Iterator

WORD = re.compile(r"[^\W_]+(?:['’-][^\W_]+)*")
#: Abbreviations that do not end a sentence (fixed values).
ABBREVIATIONS = frozenset("al approx cf dr e.g etc fig i.e inc mr mrs ms no prof st vs".split())
_END = re.compile(r"[.!?]+[\"'”’)\]]*(?=\s|$)|\n[ \t]*\n")


def sentences(text: str) -> Iterator[tuple[int, int]]:
    """Spans of the sentences of a text."""
    at = 0
    for m in _END.finditer(text):
        if m[0][0] == "." and m.end() < len(text):
            before = _before(text, at, m.start())
            if before.lower() in ABBREVIATIONS or re.fullmatch(r"[A-Z]", before):
                continue
        yield from _trimmed(text, at, m.end())
        at = m.end()
    yield from _trimmed(text, at, len(text))


def _before(text: str, a: int, b: int) -> str:
    """The letters, digits and full stops right before ``b``, or before a line's end there, looked for backwards."""
    b -= b > a and text[b - 1] == "\n"
    i = b
    while i > a and (text[i - 1].isalnum() or text[i - 1] in "_."):
        i -= 1
    return text[i:b]


def _trimmed(text: str, a: int, b: int) -> Iterator[tuple[int, int]]:
    part = text[a:b]
    if any(c.isalnum() for c in part):
        yield a + len(part) - len(part.lstrip()), a + len(part.rstrip())


def words(text: str) -> list[re.Match]:
    return list(WORD.finditer(text))


def like(old: str, new: str) -> str:
    """``new`` in the letter case of ``old``."""
    if len(old) > 1 and old.isupper():
        return new.upper()
    return new[:1].upper() + new[1:] if old[:1].isupper() else new


def quoted(text: str, a: int, b: int) -> bool:
    return text[a - 1 : a] in tuple("\"“'‘") and text[b : b + 1] in tuple("\"”'’")


def identifier_like(text: str, a: int, b: int) -> bool:
    """A neighbour makes the word part of a path, name or option."""
    before, after = text[a - 1 : a], text[b : b + 1]
    return before in tuple("_/\\@#$-.=") and before != "" or after in tuple("_/\\=(") and after != "" or (after in tuple(".:-") and after != "" and text[b + 1 : b + 2].isalnum())
