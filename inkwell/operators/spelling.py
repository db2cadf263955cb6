"""The words of a document that a speller has to know: prose only, without names, identifiers, noise, vocabulary and foreign phrases."""

from __future__ import annotations

import re
from collections.abc import Iterator

from ..functions.inflection import phrase_pattern
from ..functions.language import stretches
from ..sources.names import BY_NAME
from .registry import Context
from .settle import document_language, inside, regions_of
from .text import segments

WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
#: What is no word: template marks, quantities with units, enumerators, task boxes, numbered or hexadecimal ids, joined names.
NOISE = re.compile(
    r"\{\{[^}\n]*\}\}|\{%[^%\n]*%\}|\d[\w.,%°µ/-]*|(?<!\w)[([]?(?:[ivxlcdm]{1,6}|[a-z])[)\].](?=\s)|\[[ xX]\]|[A-Z]{2,}-?\d+\w*|#\w+|@[\w-]+|\b[0-9a-f]{7,40}\b(?=.*\d)|\w*_\w+|\w+::\w+|(?:\w+/)+[\w.]+|\w+(?:\.\w+)+(?:\(\))?|[\w-]*\d[\w-]*"
)
TITLE = r"(?:Mr|Mrs|Ms|Miss|Dr|Prof|Sir|Herr|Frau|Monsieur|Madame|Señor|Señora|Rev)\.?"
PERSON = re.compile(rf"\b{TITLE} (?P<titled>[^\W\d_a-z][\w'’-]*(?: [^\W\d_a-z][\w'’-]+)*)|\b(?P<given>[^\W\d_a-z][^\W\d_]+) (?P<family>[^\W\d_a-z][\w'’-]+)")
ATTRIBUTE = re.compile(r"(?i)\b(?:id|name|class|for|href|src|action|type|data-[\w-]+)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)")
LINKED = re.compile(r"(?:https?://|\]\()([^\s)>]+)")
LAUGHTER = re.compile(r"(?i)(?:(?:ha|he|hi|lo|ho){2,}|[mdclxvi]+)$")


def identifiers(c: Context) -> frozenset[str]:
    """Words that the file uses as names: in code, addresses, link targets, attributes."""
    parts = [m[1] for m in LINKED.finditer(c.text)] + [m[1] for m in ATTRIBUTE.finditer(c.text)]
    if c.kind == "markdown":
        parts += re.findall(r"`([^`\n]+)`", c.text) + [c.text[b.body : b.body_end] for b in c.doc.code]
    elif c.kind == "code":
        parts.append(c.text if len(c.text) < 1 << 20 else "")
    return frozenset(w for p in parts for x in re.findall(r"[A-Za-z][A-Za-z0-9]+", p) for w in (x.lower(), *(y.lower() for y in re.findall(r"[A-Z]?[a-z]+", x))) if len(w) > 1)


def persons(text: str) -> list[tuple[int, int]]:
    """Spans of names: a title with the capitalised words after it, or a known given name with the one behind it."""
    return [m.span() for m in PERSON.finditer(text) if m["titled"] or m["given"] in BY_NAME]


def spell_words(c: Context, vocabulary: tuple[str, ...] = (), detect: bool = False) -> Iterator[tuple[int, int, str, str]]:
    """(start, end, word, language) of the words to look up.

    Skipped are words glued to inline code, words with inner capitals, acronyms, laughter and Roman numbers, what ``NOISE``
    matches, names of persons, the file's identifiers, terms of the ``vocabulary`` in any form, and phrases in another language.
    """
    language = document_language(c, c.config.get("language"), None, detect)
    marks = regions_of(c.text) if c.kind == "markdown" and "lang" in c.text else []
    pattern = phrase_pattern(vocabulary, language)
    # a code file's own identifiers are those of its code, not of its comments
    names = identifiers(c) if c.kind == "markdown" else frozenset()
    for s in segments(c):
        away = [(a, b) for p in (NOISE, pattern) if p for a, b in (m.span() for m in p.finditer(s.text))] + persons(s.text) + [(a, b) for a, b, _ in stretches(s.text, language)]
        cut, end = [], -1
        for a, b in sorted(away):  # merged, so that a place is looked up by one search
            if a <= end:
                cut[-1] = (cut[-1][0], max(end, b))
            else:
                cut.append((a, b))
            end = cut[-1][1]
        for m in WORD.finditer(s.text):
            a, b, word = s.start + m.start(), s.start + m.end(), m[0]
            plain = word.replace("’", "'")
            if inside(m.start(), cut) or len(word) < 2 or plain[1:] != plain[1:].lower() or LAUGHTER.match(word):
                continue
            if c.kind == "markdown" and "`" in (c.text[a - 1 : a], c.text[b : b + 1]):
                continue
            if plain.lower() in names or plain.lower().removesuffix("'s") in names:
                continue
            own = next((lang for x, y, lang in marks if x <= a < y), language)
            yield a, b, word, own
