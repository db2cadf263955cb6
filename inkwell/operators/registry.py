"""Rules, their default severities, and what a rule sees and reports."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from .markdown import Document

OFF, INFO, WARNING, ERROR = None, 0, 1, 2
LABELS = {0: "info", 1: "warning", 2: "error"}


@dataclass
class Finding:
    start: int
    end: int
    message: str
    fix: str | None = None
    suggestions: tuple[str, ...] = ()
    severity: int | None = None  # only where it differs from the rule's
    fix_start: int | None = None
    fix_end: int | None = None


@dataclass
class Context:
    """One document: its text, kind and structure; ``config`` holds the options of the rules."""

    text: str
    path: str = ""
    kind: str = "markdown"
    code_lang: str = ""
    config: dict = field(default_factory=dict)
    _doc: Document | None = None
    cache: dict = field(default_factory=dict)

    @property
    def doc(self) -> Document:
        if self._doc is None:
            self._doc = Document(self.text if self.kind == "markdown" else "")
        return self._doc

    def option(self, name: str, default):
        return self.config.get(name, default)


Check = Callable[[Context], Iterator[Finding]]


@dataclass(frozen=True)
class Rule:
    id: str
    severity: int | None
    check: Check
    kinds: tuple[str, ...]
    fixes: bool

    @property
    def family(self) -> str:
        return self.id.split("/")[0]


RULES: dict[str, Rule] = {}


def rule(name: str, severity: int | None, kinds: tuple[str, ...] = ("markdown",), fixes: bool = False):
    def register(check: Check) -> Check:
        RULES[name] = Rule(name, severity, check, kinds, fixes)
        return check

    return register


def run(names: list[str], context: Context) -> Iterator[tuple[str, Finding]]:
    for name in names:
        found = RULES[name]
        if context.kind in found.kinds:
            for finding in found.check(context):
                yield name, finding
