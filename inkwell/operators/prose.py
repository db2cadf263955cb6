"""Prose rules (``prose/...``) on segments."""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache

from ..functions.sentences import identifier_like, like, quoted, words
from ..functions.words import grade, syllables
from ..sources import lexicons
from .registry import INFO, OFF, WARNING, Context, Finding, rule
from .text import lower_text, present, sections, segments, sentences_of

BOTH = ("markdown", "code", "gettext")


@lru_cache(maxsize=64)
def phrase_pattern(phrases: tuple[str, ...], case: bool = False) -> re.Pattern:
    """Whole phrases, the longest first; any white space between their words."""
    parts = [r"\s+".join(re.escape(w) for w in p.split()) for p in sorted(set(phrases), key=lambda p: (-len(p), p))]
    return re.compile(rf"(?<![\w-])(?:{'|'.join(parts)})(?![\w-])", 0 if case else re.I)


def norm(text: str) -> str:
    return re.sub(r"\s+", " ", text).lower()


@rule("prose/inclusive", WARNING, BOTH)
def inclusive(c: Context):
    table = {f: n for f, n, _ in c.option("inclusive", lexicons.INCLUSIVE)}
    some = present(c, table)
    find = phrase_pattern(some)
    for s in segments(c) if some else ():
        for m in find.finditer(s.text):
            if not identifier_like(s.text, m.start(), m.end()):
                new = like(m[0], table[norm(m[0])])
                yield Finding(s.start + m.start(), s.start + m.end(), f"{m[0]!r} excludes people", suggestions=(new,))


@rule("prose/simplify", INFO, BOTH, fixes=True)
def simplify(c: Context):
    table = {f: (n, x) for f, n, x in c.option("simplify", lexicons.SIMPLIFY)}
    some = present(c, table)
    find = phrase_pattern(some)
    for s in segments(c) if some else ():
        if s.kind != "quote":
            for m in find.finditer(s.text):
                if not identifier_like(s.text, m.start(), m.end()):
                    new, fix = table[norm(m[0])]
                    yield Finding(s.start + m.start(), s.start + m.end(), f"{m[0]!r} can be simpler", like(m[0], new) if fix else None, (like(m[0], new),))


@rule("prose/terminology", WARNING, BOTH, fixes=True)
def terminology(c: Context):
    table = {w: n for n, wrong in c.option("terminology", lexicons.TERMINOLOGY).items() for w in wrong}
    some = present(c, table, True)
    find = phrase_pattern(some, True)
    for s in segments(c) if some else ():
        for m in find.finditer(s.text):
            if not identifier_like(s.text, m.start(), m.end()):
                new = table[re.sub(r"\s+", " ", m[0])]
                yield Finding(s.start + m.start(), s.start + m.end(), f"{m[0]!r} is written {new!r}", new, (new,))


@rule("prose/entity-name", WARNING, BOTH, fixes=True)
def entity_name(c: Context):
    names = {norm(n): n for n in c.option("entities", ())}
    if names:
        find = phrase_pattern(tuple(names.values()))
        for s in segments(c):
            for m in find.finditer(s.text):
                want = names[norm(m[0])]
                if re.sub(r"\s+", " ", m[0]) != want and not m[0].isupper() and not identifier_like(s.text, m.start(), m.end()):
                    yield Finding(s.start + m.start(), s.start + m.end(), f"the name is written {want!r}", None if s.kind == "heading" else want, (want,))


@rule("prose/ambiguous-person", WARNING, BOTH)
def ambiguous_person(c: Context):
    people = [tuple(p.split()) for p in c.option("people", ())]
    shared = {part: {p for p in people if part in p} for p in people for part in p}
    shared = {part: who for part, who in shared.items() if len(who) > 1}
    if not shared:
        return
    for own in sections(c):
        earlier: set = set()
        for s in own:
            found = words(s.text)
            for i, w in enumerate(found):
                who = shared.get(re.sub(r"['’]s$", "", w[0]))
                full = [p for p in people if p[0] == w[0] and tuple(x[0] for x in found[i : i + len(p)]) == p]
                earlier.update(full)
                if who:
                    near = {x[0] for x in found[max(0, i - 2) : i + 3] if x is not w}
                    named = {p for p in who if near & set(p)}
                    before = who & earlier
                    if not named and len(before) != 1:
                        yield Finding(s.start + w.start(), s.start + w.start() + len(re.sub(r"['’]s$", "", w[0])), f"{w[0]} can be any of {len(who)} people")


IRREGULAR = "begun born bought broken brought built caught chosen done drawn driven eaten found forgotten given gone grown held hidden kept known laid led left lost made meant met paid put read run said seen sent set shown shut sold sought spent split spoken stolen sung taken taught thrown told torn understood woken won worn written".split()
NOT_PARTICIPLES = "bed embed feed hundred indeed interested need red seed shed sacred speed tired used".split()
PASSIVE = re.compile(rf"\b(?:am|are|is|was|were|be|been|being)\s+(?:not\s+)?(?:\w+ly\s+)?((?:\w{{2,}}ed)|{'|'.join(IRREGULAR)})\b", re.I)


@rule("prose/passive", OFF, BOTH)
def passive(c: Context):
    for s in segments(c):
        for m in PASSIVE.finditer(s.text):
            if m[1].lower() not in NOT_PARTICIPLES and not quoted(s.text, m.start(), m.end()):
                yield Finding(s.start + m.start(), s.start + m.end(), "passive voice")


@rule("prose/weasel", INFO, BOTH)
def weasel(c: Context):
    some = present(c, c.option("weasel", lexicons.WEASEL))
    find = phrase_pattern(some)
    for s in segments(c) if some else ():
        for m in find.finditer(s.text):
            rest = s.text[m.end() : m.end() + 40].lstrip().lower()
            if norm(m[0]) == "rather" and rest.startswith("than") or norm(m[0]) == "quite" and re.match(r"an? (?:few|bit)", rest) or norm(m[0]) == "few" and re.search(r"quite\s+a\s+$", s.text[max(0, m.start() - 40) : m.start()], re.I):
                continue
            if not quoted(s.text, m.start(), m.end()):
                yield Finding(s.start + m.start(), s.start + m.end(), f"{m[0]!r} says little")


def opening(c: Context, pattern: re.Pattern, message: str):
    for s in segments(c):
        for a, b in sentences_of(c, s):
            if m := pattern.match(s.text[a:b]):
                yield Finding(s.start + a, s.start + a + m.end(1), message)


@rule("prose/there-is", INFO, BOTH)
def there_is(c: Context):
    yield from opening(c, re.compile(r"(There(?:\s+(?:is|are|was|were)\b|['’]s\b))"), "sentence starts with 'there is'")


@rule("prose/so-start", INFO, BOTH)
def so_start(c: Context):
    yield from opening(c, re.compile(r"(So)(?:,|\s+(?!(?:far|long|many|much|that|called|few|little|too|do|does|did)\b)\w)"), "sentence starts with 'so'")


@rule("prose/sentence-length", OFF, BOTH)
def sentence_length(c: Context):
    most = c.option("max_sentence_words", 30)
    for s in segments(c):
        for a, b in sentences_of(c, s):
            if (n := len(words(s.text[a:b]))) > most:
                yield Finding(s.start + a, s.start + b, f"sentence has {n} words")


@rule("prose/readability", OFF)
def readability(c: Context):
    for own in sections(c):
        body = [s for s in own if s.kind in ("paragraph", "item", "quote")]
        found = [w[0] for s in body for w in words(s.text)]
        if len(found) >= 100:
            g = grade(len(found), sum(len(sentences_of(c, s)) for s in body), sum(map(syllables, found)))
            if g > c.option("max_grade", 12.0):
                yield Finding(body[0].start, body[0].start + len(body[0].text), f"section reads at grade {g:.1f}")


@rule("prose/consistency", INFO, BOTH)
def consistency(c: Context):
    groups = c.option("variants", lexicons.VARIANTS)
    group_of = {w: i for i, group in enumerate(groups) for w in group}
    if not any(w in lower_text(c) for w in group_of):
        return
    every = [(norm(m[0]), s.start + m.start(), s.start + m.end(), m[0]) for s in segments(c) for m in phrase_pattern(tuple(group_of)).finditer(s.text)]
    for i in {group_of[h[0]] for h in every}:
        hits = [h for h in every if group_of[h[0]] == i]
        count = Counter(h[0] for h in hits)
        if len(count) > 1:
            first = {w: min(h[1] for h in hits if h[0] == w) for w in count}
            want = min(count, key=lambda w: (-count[w], first[w]))
            for w, a, b, old in hits:
                if w != want:
                    yield Finding(a, b, f"elsewhere {want!r} is used", suggestions=(like(old, want),))


#: Acronyms that need no definition (fixed values).
KNOWN_ACRONYMS = frozenset("AI API ASCII CLI CPU CSS CSV DNS EU FAQ FTP GB GPU GUI HTML HTTP HTTPS ID IDE IP ISO JSON KB MB OK OS PC PDF PNG RAM REST SDK SQL SSH SSL TCP TLS UI UK URL US USA USB UTC UTF UX VM XML YAML".split())


@rule("prose/acronym-defined", OFF, BOTH)
def acronym_defined(c: Context):
    seen = set()
    for s in segments(c):
        for m in re.finditer(r"(?<![\w-])[A-Z]{2,5}(?![\w-])", s.text):
            name, before, after = m[0], s.text[: m.start()], s.text[m.end() :]
            if before.endswith("(") and after.startswith(")"):
                seen.add(name)
            elif name not in seen:
                seen.add(name)
                caps = re.search(r"\b[A-Z]{2,}\s+$", before) or re.match(r"\s+[A-Z]{2,}\b", after)
                if not (name in KNOWN_ACRONYMS or re.fullmatch(r"[IVXLCDM]+", name) or identifier_like(s.text, m.start(), m.end()) or caps or re.match(r"\s*\(", after)):
                    yield Finding(s.start + m.start(), s.start + m.end(), f"{name} is not defined")


@rule("prose/smart-quotes", OFF, BOTH, fixes=True)
def smart_quotes(c: Context):
    for straight, curly in (('"', "“”"), ("'", "‘’")):
        hits = [(m[0] == straight, s.start + m.start()) for s in segments(c) for m in re.finditer(f"[{straight}{curly}]", s.text)]
        plain = sum(h[0] for h in hits)
        if hits and 0 < plain < len(hits):
            keep = plain > len(hits) - plain or (2 * plain == len(hits) and hits[0][0])
            for is_straight, a in hits:
                if is_straight != keep:
                    yield Finding(a, a + 1, "straight and curly quotes are mixed", straight if keep else None)


@rule("prose/sentence-spacing", OFF, BOTH, fixes=True)
def sentence_spacing(c: Context):
    for s in segments(c):
        for m in re.finditer(r"[.!?][\"'”’)]?( {2,})(?=[A-ZÀ-Þ])", s.text):
            if c.text[s.start + m.start(1) : s.start + m.end(1)].strip() == "":
                yield Finding(s.start + m.start(1), s.start + m.end(1), "several spaces between sentences", " ")
