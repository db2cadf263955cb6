"""Prose of a document of any kind: segments of Markdown, comments of code."""

from __future__ import annotations

import re

from ..functions.sentences import sentences
from .markdown import Segment
from .registry import Context


def segments(c: Context) -> list[Segment]:
    """Prose segments; of code the prose of its comments."""
    if "segments" not in c.cache:
        if c.kind == "markdown":
            c.cache["segments"] = c.doc.segments()
        elif c.kind == "code":
            from .comments import blocks_of, prose_of

            c.cache["segments"] = [Segment("comment", a, t, i) for i, b in enumerate(blocks_of(c)) for a, t in prose_of(c, b)]
        elif c.kind == "gettext":
            c.cache["segments"] = catalog_segments(c)
        else:
            c.cache["segments"] = []
    return c.cache["segments"]


def catalog_segments(c: Context) -> list[Segment]:
    """Prose of a catalog: translations, or messages of a template or an English catalog; keys, copies and escaped texts are none."""
    from .catalogs import catalog_of, live

    source = c.path.endswith(".pot") or catalog_of(c).fields.get("Language", "").split("_")[0] == "en"
    out = []
    for i, e in enumerate(live(c)):
        key = re.fullmatch(r"[A-Za-z0-9]+(?:[._:][A-Za-z0-9_]+)+", e.id.value)
        for t in [e.id, e.plural] if source else e.strs.values():
            if t and t.value.strip() and not key and (source or t.value != e.id.value) and c.text[t.start + 1 : t.end - 1] == t.value:
                out.append(Segment("message", t.start + 1, t.value, i))
    return out


def sentences_of(c: Context, s: Segment) -> list[tuple[int, int]]:
    """Sentence spans of a segment, split once for all rules."""
    known = c.cache.setdefault("sentences", {})
    if s.start not in known:
        known[s.start] = list(sentences(s.text))
    return known[s.start]


def lower_text(c: Context) -> str:
    if "lower" not in c.cache:
        c.cache["lower"] = c.text.lower()
    return c.cache["lower"]


def lower_segment(c: Context, s: Segment) -> str:
    """A segment's text in lower case, made once for all rules."""
    known = c.cache.setdefault("lower-segments", {})
    if s.start not in known:
        known[s.start] = s.text.lower()
    return known[s.start]


def words_in(c: Context, s: Segment | None = None) -> frozenset[str]:
    """Runs of small letters in the text, or in a segment, in lower case: what a rule needs is looked up here before its patterns run."""
    known = c.cache.setdefault("words-in", {})
    key = -1 if s is None else s.start
    if key not in known:
        known[key] = frozenset(re.findall(r"[a-z]+", lower_text(c) if s is None else lower_segment(c, s)))
    return known[key]


def present(c: Context, phrases, case: bool = False) -> tuple[str, ...]:
    """Those of ``phrases`` that stand somewhere in the text, whatever the white space in them: a search for substrings before any pattern."""
    key = "flat" if case else "flat-lower"
    if key not in c.cache:
        flat = re.sub(r"\s+", " ", c.text)
        c.cache[key] = flat if case else flat.lower()
    return tuple(p for p in phrases if p in c.cache[key])


def sections(c: Context) -> list[list[Segment]]:
    out: dict[int, list[Segment]] = {}
    for s in segments(c):
        out.setdefault(s.section, []).append(s)
    return list(out.values())
