"""What becomes of a document's findings before they leave its map: directives, duplicates, marked regions, foreign stretches.

All of it looks at one document, which is one row of the map: no finding is shuffled for it.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable
from dataclasses import dataclass

from ..functions.language import language_of, stretches
from .registry import RULES, Context, Finding, run
from .text import segments

#: A directive opens a comment; its rules are separated by blanks or commas, a reason may follow ``--``.
DIRECTIVE = re.compile(r"\s*lint-(disable-next-line|disable-line|disable-file|disable|enable|lang)\b([^\n]*)")
COMMENT = re.compile(r"<!--(.*?)-->", re.S)
EVERY = "*"


@dataclass(frozen=True)
class Off:
    """Where rules are off: both ends count; ``kept`` are patterns that are on again inside."""

    start: int
    end: int
    rules: tuple[str, ...]
    kept: tuple[str, ...] = ()

    def covers(self, rule: str) -> bool:
        return any(matches(p, rule) for p in self.rules) and not any(matches(p, rule) for p in self.kept)


def matches(pattern: str, rule: str) -> bool:
    """A rule's id, a glob, or a family's name."""
    return pattern in (EVERY, rule) or rule.startswith(pattern.rstrip("*/") + "/") or ("*" in pattern and re.fullmatch(".*".join(map(re.escape, pattern.split("*"))), rule) is not None)


def comments(c: Context) -> list[tuple[int, int, str]]:
    """(start, end, content) of comments that may be directives."""
    if c.kind == "code":
        from .comments import blocks_of

        found = []
        for b in blocks_of(c):
            at = b.start
            for line in c.text[b.start : b.end].split("\n"):
                body = re.sub(r"^\s*(?://[/!]?|#|--|;|/\*+|\*(?!/))\s*", "", line)
                found.append((at, at + len(line), re.sub(r"\s*\*/\s*$", "", body)))
                at += len(line) + 1
        return found
    return [(m.start(), m.end(), m[1]) for m in COMMENT.finditer(c.text) if c.kind != "markdown" or not c.doc.in_code(m.start())]


def directives(c: Context) -> tuple[list[Off], list[tuple[int, int]]]:
    """Where rules are off, and the ranges of the directives themselves."""
    off: list[Off] = []
    where: list[tuple[int, int]] = []
    running: list[Off] = []
    if "lint-" not in c.text:
        return off, where
    size = len(c.text)
    for start, end, body in comments(c):
        m = DIRECTIVE.match(body)
        if m is None:
            continue
        where.append((start, end))
        rules = tuple(x for x in re.split(r"[,\s]+", re.split(r"(?:^|\s)--(?:\s|$)", m[2])[0].strip()) if x)
        named = rules or (EVERY,)
        line = c.text.rfind("\n", 0, start) + 1
        stop = c.text.find("\n", end)
        stop = size if stop < 0 else stop
        if m[1] == "disable":
            running.append(Off(end, size, named))
        elif m[1] == "enable":
            off += [Off(o.start, start, o.rules, o.kept) for o in running]
            left = [Off(start, size, tuple(r for r in o.rules if r not in rules), (*o.kept, *rules)) for o in running] if rules else []
            running = [o for o in left if o.rules]
        elif m[1] == "disable-file":
            off.append(Off(0, size, named))
        elif m[1] == "disable-line":
            off.append(Off(line, stop, named))
        elif m[1] == "disable-next-line":
            first = min(stop + 1, size)
            last = c.text.find("\n", first)
            off.append(Off(first, size if last < 0 else last, named))
    return off + running, where


def inside(at: int, ranges: list[tuple[int, int]]) -> bool:
    """Whether a place lies in one of some sorted ranges that do not overlap."""
    i = bisect_right(ranges, (at, 1 << 62)) - 1
    return i >= 0 and ranges[i][0] <= at < ranges[i][1]


#: Rules of prose that do not depend on the language (fixed values).
NEUTRAL = frozenset(("prose/terminology", "prose/entity-name", "prose/smart-quotes", "prose/sentence-spacing"))


def by_language(rule: str) -> bool:
    """Rules that only make sense in the language they are written for."""
    return (rule == "spelling" or rule.split("/")[0] in ("grammar", "prose", "slop")) and rule not in NEUTRAL


def front_language(text: str) -> str | None:
    """Declared language of the front matter, its primary part."""
    m = re.match(r"---\n(.*?)\n---", text, re.S)
    found = m and re.search(r"^lang(?:uage)?\s*[:=]\s*[\"']?([A-Za-z]{2,3})", m[1], re.M)
    return found[1].lower() if found else None


def document_language(c: Context, configured: str | None, known: Callable[[str], bool] | None = None, detect: bool = True) -> str:
    """Front matter, else a configured language other than English, else detection, else English."""
    told = front_language(c.text) if c.kind == "markdown" else None
    if told:
        return told
    if configured and configured != "en":
        return configured
    return (language_of([s.text for s in segments(c)], known) if detect else None) or configured or "en"


def regions_of(text: str) -> list[tuple[int, int, str]]:
    """Marked languages: the innermost mark holds; equal neighbours are one region."""
    from .tables import marked_regions

    return marked_regions(text)


def checked(names: list[str], c: Context, known: Callable[[str], bool] | None = None, detect: bool = False) -> list[tuple[str, Finding]]:
    """Findings of one document by the rules of its language, of its marked regions by the rules of theirs, settled."""
    language = document_language(c, c.config.get("language"), known, detect)
    c.config = {**c.config, "language": language}
    found = list(run(names, c))
    marks = regions_of(c.text) if c.kind == "markdown" and ("lang" in c.text) else []
    foreign = [(a, b, lang) for a, b, lang in marks if lang != language]
    if foreign:
        away = sorted((a, b) for a, b, _ in foreign)
        found = [(n, f) for n, f in found if not by_language(n) or not inside(f.start, away)]
        for lang in sorted({x for _, _, x in foreign}):
            own = sorted((a, b) for a, b, x in foreign if x == lang)
            other = Context(c.text, c.path, c.kind, c.code_lang, {**c.config, "language": lang}, c._doc, {k: v for k, v in c.cache.items() if k in ("segments", "sentences", "lower")})
            found += [(n, f) for n, f in run([n for n in names if by_language(n)], other) if inside(f.start, own)]
    if language == "en" and any(by_language(n) and RULES[n].id.count("/") < 2 for n, _ in found):
        marked = sorted((a, b) for a, b, _ in marks)
        apart = sorted((s.start + a, s.start + b) for s in segments(c) for a, b, _ in stretches(s.text, "en"))
        found = [(n, f) for n, f in found if not by_language(n) or inside(f.start, marked) or not inside(f.start, apart)]
    return settled(c, found)


def settled(c: Context, found: list[tuple[str, Finding]]) -> list[tuple[str, Finding]]:
    """Without what directives switch off, findings in directives (but of structure), spelling where a term is known, and repetitions."""
    off, where = directives(c)
    terms = {(f.start, f.end) for n, f in found if n == "prose/terminology"}
    seen, out = set(), []
    for name, f in found:
        key = (name, f.start, f.end)
        if key in seen or (name == "spelling" and key[1:] in terms) or (not name.startswith("md/") and inside(f.start, where)):
            continue
        if any(o.start <= f.start <= o.end and o.covers(name) for o in off):
            continue
        seen.add(key)
        out.append((name, f))
    return out
