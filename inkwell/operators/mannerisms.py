"""Formulaic writing (``slop/...``): phrases, density, dashes, contrasts, hedges, triads, sentence patterns."""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache

from ..functions.sentences import quoted, words
from ..sources import lexicons
from .prose import norm
from .registry import INFO, OFF, WARNING, Context, Finding, rule
from .text import lower_text, sections, segments, sentences_of

BOTH = ("markdown", "code", "gettext")


def needle(pattern: str) -> str:
    """The longest plain word that every match of a pattern has, or nothing."""
    while (bare := re.sub(r"\((?:\?:)?[^()]*\)[?*]?|\[[^\]]*\][?*+]?", " ", pattern)) != pattern:
        pattern = bare
    # what a mark makes optional, and classes of characters, are no part of it
    return max(re.findall(r"[a-z]{3,}", re.sub(r"\\.[+*?]?|.[?*]", " ", pattern)), key=len, default="")


@lru_cache(maxsize=2)
def built_in(kind: str) -> tuple:
    """The patterns of the built-in catalogue: looked up by name, since a long catalogue is slow to hash."""
    return compiled.__wrapped__(tuple(lexicons.PHRASES), kind)


@lru_cache(maxsize=8)
def compiled(entries: tuple, kind: str) -> tuple:
    out = []
    for number, (name, forms, own, not_after, instead) in enumerate(entries):
        if (own == "word") == (kind == "word"):
            parts = forms if own == "pattern" else [r"\s+".join(map(re.escape, f.split())) for f in forms]
            # a text without any needle of an entry cannot match it
            needles = tuple(needle(f) if own == "pattern" else f.split()[-1] for f in forms)
            out.append((needles, number, name, re.compile(rf"(?<!\w)(?<!\w[-'’])(?:{'|'.join(parts)})(?![\w-])", re.I), re.compile(rf"\s+(?:{not_after})\b", re.I) if not_after else None, instead))
    return tuple(out)


def hits(c: Context, kind: str):
    """(segment, start, end, entry, instead): leftmost, then longest, then first in the catalogue; no overlaps."""
    key = f"slop-{kind}"
    if key not in c.cache:
        c.cache[key] = []
        own = c.option("phrases", None)
        lower = lower_text(c)
        usable = [e[1:] for e in (built_in(kind) if own is None else compiled(tuple(own), kind)) if any(n in lower for n in e[0])]
        for s in segments(c):
            found = [(m.start(), -m.end(), number, name, instead) for number, name, pattern, not_after, instead in usable for m in pattern.finditer(s.text) if not (not_after and not_after.match(s.text, m.end()))]
            at = 0
            for a, b, _, name, instead in sorted(found):
                if a >= at:
                    at = -b
                    c.cache[key].append((s, a, -b, name, instead))
    return c.cache[key]


def catalogue(c: Context, kind: str):
    for s, a, b, name, instead in hits(c, kind):
        yield Finding(s.start + a, s.start + b, f"formulaic: {name}", suggestions=tuple(instead), severity=INFO if s.kind == "quote" or quoted(s.text, a, b) else None)


@rule("slop/phrase", WARNING, BOTH)
def phrase(c: Context):
    yield from catalogue(c, "phrase")


@rule("slop/word", INFO, BOTH)
def word(c: Context):
    yield from catalogue(c, "word")


@rule("slop/density", WARNING)
def density(c: Context):
    by_segment: dict[int, list] = {}
    for h in hits(c, "phrase") + hits(c, "word"):
        by_segment.setdefault(h[0].start, []).append(h)
    for own in sections(c):
        n = sum(len(words(s.text)) for s in own)
        found = [h for s in own for h in by_segment.get(s.start, ())]
        if n >= c.option("density_min_words", 100) and len(found) * 100 / n > c.option("density_per_100", 1.5):
            top = Counter(h[3] for h in found)
            named = ", ".join(f"{k} ({v})" for k, v in sorted(top.items(), key=lambda x: (-x[1], x[0]))[:5])
            yield Finding(own[0].start, own[0].start + len(own[0].text), f"{len(found)} formulaic hits in {n} words: {named}")


DASH = re.compile(r"(?<!—)—(?!—)|(?<= )–(?= )|(?<= )--(?= )")


@rule("slop/em-dash", WARNING)
def em_dash(c: Context):
    for own in sections(c):
        body = [s for s in own if s.kind != "cell"]
        found = [(s.start + m.start(), s.start + m.end()) for s in body for m in DASH.finditer(s.text)]
        n = sum(len(words(s.text)) for s in body)
        if len(found) >= 3 and len(found) * 100 > c.option("em_dash_per_100", 2.0) * n:
            for a, b in found:
                yield Finding(a, b, f"{len(found)} dashes in {n} words")


CONTRAST = (
    r"not (?:just|only|merely|simply) [^.!?;:\n]{2,80}?[,;]? but (?:also )?", r"(?:is|are|was|were)(?: not|n['’]t) (?:just|merely|simply|only) [^.!?\n]{2,80}?[;,—] (?:it|they)(?:['’](?:s|re)| is| are) ",
    r"(?:isn['’]t|aren['’]t) about [^.!?\n]{2,80}?[.;,—]\s+(?:it['’]s|it is|they['’]re) about ", r"more than just (?:an? |the )?\w+[,;] ",
)
CONTRASTS = re.compile("|".join(CONTRAST), re.I)


@rule("slop/not-just-but", WARNING, BOTH)
def not_just_but(c: Context):
    for s in segments(c):
        for m in CONTRASTS.finditer(s.text):
            yield Finding(s.start + m.start(), s.start + m.start() + len(m[0].rstrip()), "contrast formula")


MODALS = "can could may might should would".split()
ADVERBS = "arguably conceivably likely maybe perhaps possibly potentially presumably probably seemingly".split()
HEDGES = frozenset([*MODALS[1:], *ADVERBS, "appear", "appears", "generally", "often", "seem", "seems", "somewhat", "sometimes", "suggest", "suggests", "tend", "tends", "typically", "usually"])
DOUBLE = re.compile(rf"\b(?:(?:{'|'.join(MODALS)})\s+(?:{'|'.join(ADVERBS)})|(?:{'|'.join(ADVERBS)})\s+(?:{'|'.join(MODALS[1:])}))\b", re.I)


HEDGE = re.compile(rf"\b(?:{'|'.join(sorted(HEDGES | set(MODALS)))})\b", re.I)


@rule("slop/hedging", WARNING, BOTH)
def hedging(c: Context):
    for s in segments(c):
        if len(HEDGE.findall(s.text)) < 2:
            continue
        for a, b in sentences_of(c, s):
            part = s.text[a:b]
            if m := DOUBLE.search(part):
                yield Finding(s.start + a + m.start(), s.start + a + m.end(), "doubled hedge")
                continue
            own = words(part) if len(HEDGE.findall(part)) > 2 else []
            for i in range(len(own)):
                near = [w for w in own[i : i + 12] if w[0].lower() in HEDGES]
                if own[i][0].lower() in HEDGES and len({w[0].lower() for w in near}) >= 3:
                    yield Finding(s.start + a + near[0].start(), s.start + a + near[-1].end(), "several hedges in one sentence")
                    break


TRIAD = re.compile(r"\b([^\W\d_]+), ([^\W\d_]+),? and ([^\W\d_]+)\b")
ADJECTIVE = re.compile(r"(?:able|al|ant|ary|ed|ent|ful|ible|ic|ing|ish|ive|less|ous|y|fast|clean|clear|simple|strong|safe|smart|bold|modern)$", re.I)


@rule("slop/rule-of-three", INFO)
def rule_of_three(c: Context):
    for own in sections(c):
        found = [(s.start + m.start(), s.start + m.end()) for s in own for m in TRIAD.finditer(s.text) if sum(bool(ADJECTIVE.search(m[i])) for i in (1, 2, 3)) >= 2]
        if len(found) >= 2:
            for a, b in found:
                yield Finding(a, b, "another group of three")


CHAIN = re.compile(r"\bno ([\w-]+(?: [\w-]+)?)(?:[,.] (?:and )?no ([\w-]+(?: [\w-]+)?))+(?=[\s.,;!?]|$)|\bdid(?:n['’]t| not) \w+[^.,;]{0,30}, (?:and )?did(?:n['’]t| not) \w+", re.I)


@rule("slop/negation-chain", WARNING, BOTH)
def negation_chain(c: Context):
    for s in segments(c):
        for m in CHAIN.finditer(s.text):
            yield Finding(s.start + m.start(), s.start + m.end(), "chain of negations", severity=INFO if s.kind in ("item", "cell") else None)


DONT = re.compile(r"\bDon['’]t (?:just )?(\w+)\b([^.!?\n]{0,60})[.;,—!]\s*(?:Instead, )?(\w+)\b", re.I)


@rule("slop/dont-verb-it", WARNING, BOTH)
def dont_verb_it(c: Context):
    for s in segments(c):
        for m in DONT.finditer(s.text):
            if m[1].lower() == m[3].lower():
                yield Finding(s.start + m.start(), s.start + m.end(), "don't-do-it formula")


def runs(c: Context, s):
    """Sentences of a segment with their words."""
    known = c.cache.setdefault("runs", {})
    if s.start not in known:
        known[s.start] = [(a, b, [w[0].lower() for w in words(s.text[a:b])]) for a, b in sentences_of(c, s)]
    return known[s.start]


@rule("slop/echo-sentences", INFO)
def echo(c: Context):
    for s in segments(c):
        own = runs(c, s)
        for (_, _, x), (a, b, y) in zip(own, own[1:]):
            k = 0
            while k < min(len(x), len(y)) and x[-1 - k] == y[-1 - k]:
                k += 1
            if k >= 4 and 2 * k >= min(len(x), len(y)):
                yield Finding(s.start + a, s.start + b, "sentence ends like the one before")


@rule("slop/stacked-questions", INFO)
def stacked_questions(c: Context):
    for s in segments(c):
        if not re.search(r"\?[.:?]|\?\s*[=&|]", s.text):
            asked, own = [], sentences_of(c, s)
            for a, b in [*own, (0, 0)]:
                if b and s.text[a:b].rstrip("\"'”’)").endswith("?"):
                    asked.append((a, b))
                else:
                    if len(asked) >= 2:
                        yield Finding(s.start + asked[0][0], s.start + asked[-1][1], f"{len(asked)} questions in a row")
                    asked = []


SAME_START = frozenset("a an and but he i if in it on or she that the there these they this those to we when you your".split())


@rule("slop/anaphora", INFO)
def anaphora(c: Context):
    for s in segments(c):
        own, run = [x for x in runs(c, s) if x[2]], []
        for x in [*own, (0, 0, [""])]:
            if run and x[2][0] == run[-1][2][0] and x[2][0] not in SAME_START:
                run.append(x)
            else:
                if len(run) >= 3:
                    yield Finding(s.start + run[0][0], s.start + run[-1][1], f"{len(run)} sentences start with {run[0][2][0]!r}")
                run = [x] if x[2][0] not in SAME_START else []


@rule("slop/stranded-auxiliary", INFO)
def stranded(c: Context):
    for s in segments(c):
        for a, b in sentences_of(c, s):
            m = re.search(r"(?:,|;| but| and) (?:it|they|we|he|she|this|that|most|others|some)(?: \w+)? (does|do|did|is|are|was|were|can|could|will|would|should|has|have)(?:n['’]t| not)?[.!]$", s.text[a:b], re.I)
            if m and not re.match(r"(?:if|when|while|although|unless|because)\b", s.text[a:b], re.I):
                yield Finding(s.start + a + m.start(1), s.start + a + m.end(1), "clause ends on an auxiliary")


@rule("slop/colon-triple", OFF)
def colon_triple(c: Context):
    for s in segments(c):
        for m in re.finditer(r": ([^,.:;\n]{2,40}), ([^,.:;\n]{2,40}),? (?:and )?([^,.:;\n]{2,40})(?=[.!?]|$)", s.text):
            yield Finding(s.start + m.start(), s.start + m.end(), "colon and three items")


@rule("slop/not-but", OFF)
def not_but(c: Context):
    for s in segments(c):
        for m in re.finditer(r"\bnot (?!(?:just|only|merely|simply)\b)(?:\w+ ){1,5}?but (?:\w+)", s.text, re.I):
            yield Finding(s.start + m.start(), s.start + m.end(), "not X but Y")


#: Promotional claims by language: superlatives, absolute words that make a claim of them, and fixed claims (fixed values).
CLAIMS = {
    "de": (r"(?:einzigartig\w*|revolutionär\w*|bahnbrechend\w*|unvergleichlich\w*)", r"(?:alle[nsr]?|jede[nrs]?|immer|perfekt\w*|garantiert)", r"auf das nächste Level|Ihr Partner für"),
    "fr": (r"(?:unique|révolutionnaire|incomparable|incontournable)s?", r"(?:tous|toutes|toujours|parfait\w*|garanti\w*)", r"à portée de main|passez au niveau supérieur"),
    "es": (r"(?:únic[oa]|revolucionari[oa]|incomparable|inigualable)s?", r"(?:tod[oa]s|siempre|perfect[oa]s?|garantizad[oa]s?)", r"lleva \w+ al siguiente nivel|no busques más"),
    "pt": (r"(?:únic[oa]|revolucionári[oa]|incomparável|inigualável)", r"(?:tod[oa]s|sempre|perfeit[oa]s?|garantid[oa]s?)", r"ao próximo nível|não procure mais"),
    "sv": (r"(?:unik\w*|revolutionerande|banbrytande|oslagbar\w*)", r"(?:alla|alltid|perfekt\w*|garanterat)", r"till nästa nivå|leta inte längre"),
    "fi": (r"(?:ainutlaatui\w*|vallankumouksellis\w*|mullistava\w*|vertaansa vailla)", r"(?:kaikki\w*|aina|täydelli\w*|taatusti)", r"seuraavalle tasolle|älä etsi enempää"),
}


def claims(language: str):
    top, absolute, fixed = CLAIMS[language]
    both = re.compile(rf"\b{top}\b(?:(?!\n[ \t]*\n)[^.!?]){{1,80}}?\b{absolute}\b|\b{absolute}\b(?:(?!\n[ \t]*\n)[^.!?]){{1,80}}?\b{top}(?!\w)|\b(?:{fixed})\b", re.I)

    @rule(f"slop/phrase/{language}", WARNING, BOTH)
    def check(c: Context):
        if c.option("language", "en") == language:
            for s in segments(c):
                for m in both.finditer(s.text):
                    yield Finding(s.start + m.start(), s.start + m.end(), "promotional claim")


for _language in CLAIMS:
    claims(_language)
