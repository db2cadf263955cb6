"""User rules (``style/...``): existence, substitution, repetition, occurrence, capitalization.

A rule is a dictionary: name, kind, tokens, swap, regex, ignore_case, max, case, exceptions, scope, message.
"""

from __future__ import annotations

import re

from ..functions.words import recased
from .registry import WARNING, Context, Finding, rule
from .text import segments

BOTH = ("markdown", "code", "gettext")
KEYS = frozenset("name kind tokens swap regex ignore_case max case exceptions scope message level".split())


def checked(own: dict) -> dict:
    if unknown := set(own) - KEYS:
        raise ValueError(f"unknown keys in a style rule: {sorted(unknown)}")
    if own.get("kind") not in ("existence", "substitution", "repetition", "occurrence", "capitalization"):
        raise ValueError(f"unknown kind of style rule: {own.get('kind')!r}")
    return own


def pattern(own: dict, tokens) -> re.Pattern:
    regex = own.get("regex", False)
    flags = re.I if own.get("ignore_case", not regex) else 0
    return re.compile("|".join(f"(?:{t})" if regex else rf"(?<!\w){re.escape(t)}(?!\w)" for t in sorted(tokens, key=len, reverse=True)), flags)


def scoped(c: Context, own: dict):
    scope = own.get("scope", "all")
    return [s for s in segments(c) if scope == "all" or (scope == "comments") == (s.kind == "comment")]


def of_kind(c: Context, kind: str):
    return [checked(r) for r in c.option("style_rules", ()) if r.get("kind") == kind]


@rule("style/existence", WARNING, BOTH)
def existence(c: Context):
    for own in of_kind(c, "existence"):
        for s in scoped(c, own):
            for m in pattern(own, own["tokens"]).finditer(s.text):
                yield Finding(s.start + m.start(), s.start + m.end(), own.get("message", "avoid {}").replace("{}", m[0], 1))


@rule("style/substitution", WARNING, BOTH, fixes=True)
def substitution(c: Context):
    for own in of_kind(c, "substitution"):
        for s in scoped(c, own):
            for bad, good in own["swap"].items():
                for m in pattern(own, [bad]).finditer(s.text):
                    if m[0] != good:
                        yield Finding(s.start + m.start(), s.start + m.end(), own.get("message", "use {} instead of {}").replace("{}", good, 1).replace("{}", m[0], 1), good, (good,))


@rule("style/repetition", WARNING, BOTH, fixes=True)
def repetition(c: Context):
    for own in of_kind(c, "repetition") or [{}]:
        for s in scoped(c, own):
            for m in re.finditer(r"(?<![\w-])([^\W_]+)([ \t\n]+)(\1)(?![\w-])", s.text, re.I):
                yield Finding(s.start + m.start(), s.start + m.end(), f"{m[1]!r} is repeated", m[1])


@rule("style/occurrence", WARNING, BOTH)
def occurrence(c: Context):
    for own in of_kind(c, "occurrence"):
        for s in scoped(c, own):
            found = list(pattern(own, own["tokens"]).finditer(s.text))
            if len(found) > own["max"]:
                m = found[own["max"]]
                yield Finding(s.start + m.start(), s.start + m.end(), own.get("message", f"more than {own['max']} of {{}}").replace("{}", m[0], 1))


@rule("style/capitalization", WARNING)
def capitalization(c: Context):
    for own in of_kind(c, "capitalization"):
        for h in c.doc.headings:
            want = recased(h.text, own.get("case", "sentence"), frozenset(own.get("exceptions", ())))
            if want != h.text:
                yield Finding(h.start, h.end, f"heading should be {want!r}", suggestions=(want,))
