"""A parser of D2 diagrams and a checker of Mermaid diagrams: what is not well formed, with its place, and what the statements say."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

#: Names that D2 knows (fixed values).
D2_SHAPES = frozenset("c4-person callout circle class cloud code cylinder diamond document hexagon hierarchy image oval package page parallelogram person queue rectangle sequence_diagram sql_table square step stored_data text".split())
D2_STYLES = frozenset("animated bold border-radius double-border fill fill-pattern filled font font-color font-size italic multiple opacity root shadow stroke stroke-dash stroke-width text-transform underline 3d".split())
D2_ARROWS = frozenset("arrow box circle cf-many cf-many-required cf-one cf-one-required cross diamond none triangle unfilled-triangle".split())
D2_DIRECTIONS = frozenset("down left right up".split())
D2_FLAGS = frozenset("3d animated bold double-border filled italic multiple shadow underline".split())
#: Numbers that a style or layout keyword takes: least and most (fixed values).
D2_RANGES = {"opacity": (0, 1), "stroke-width": (0, 15), "stroke-dash": (0, 10), "border-radius": (0, None), "font-size": (8, 100), "width": (1, None), "height": (1, None), "grid-rows": (1, None), "grid-columns": (1, None), "grid-gap": (0, None), "horizontal-gap": (0, None), "vertical-gap": (0, None)}
D2_CHOICES = {"text-transform": "capitalize lowercase none title uppercase".split(), "fill-pattern": "dots grain lines none paper".split(), "font": ["mono"]}
D2_NEAR = frozenset(f"{a}-{b}" for a in ("top", "bottom") for b in ("left", "center", "right")) | {"center-left", "center-right"}
D2_BOARDS = frozenset(("layers", "scenarios", "steps"))
CONNECTOR = re.compile(r"<?-+>|<-+|--+")


@dataclass
class Key:
    """A path of names with the place of each."""

    parts: list[tuple[str, int, int, bool]] = field(default_factory=list)  # name, start, end, quoted

    @property
    def names(self) -> list[str]:
        return [p[0] if p[3] else p[0].lower() for p in self.parts]


@dataclass
class Statement:
    key: Key | None
    edges: list[Key]
    start: int
    end: int
    value: str | None = None
    value_at: tuple[int, int] = (0, 0)
    block: bool = False
    body: list[Statement] | None = None


class Fault(Exception):
    def __init__(self, at: int, message: str):
        super().__init__(message)
        self.at, self.message = at, message


class D2:
    """Statements of a diagram; the first fault ends the parse and is kept."""

    def __init__(self, text: str):
        self.text, self.at = text, 0
        self.fault: Fault | None = None
        self.statements: list[Statement] = []
        try:
            self.statements = self._map(None)
        except Fault as e:
            self.fault = e

    def _space(self, lines: bool = True) -> None:
        """Past blanks, separators and comments."""
        while self.at < len(self.text):
            c = self.text[self.at]
            if c in " \t\r" or (lines and c in "\n;"):
                self.at += 1
            elif c == "\\" and self.text[self.at + 1 : self.at + 2] == "\n":
                self.at += 2
            elif c == "#" and lines:
                end = self.text.find("\n", self.at)
                self.at = len(self.text) if end < 0 else end
            elif lines and self.text.startswith('"""', self.at):
                end = self.text.find('"""', self.at + 3)
                if end < 0:
                    raise Fault(self.at, "block comment is not closed")
                self.at = end + 3
            else:
                return

    def _map(self, opened: int | None) -> list[Statement]:
        out = []
        while True:
            self._space()
            if self.at >= len(self.text):
                if opened is not None:
                    raise Fault(opened, "brace is not closed")
                return out
            if self.text[self.at] == "}":
                if opened is None:
                    raise Fault(self.at, "brace closes nothing")
                self.at += 1
                return out
            if self.text[self.at] in "])|" or self.text[self.at] == ":":
                raise Fault(self.at, f"unexpected {self.text[self.at]}")
            out.append(self._statement())

    def _quoted(self) -> str:
        mark, start = self.text[self.at], self.at
        i = start + 1
        while i < len(self.text) and self.text[i] != mark:
            if self.text[i] == "\n":
                break
            i += 2 if self.text[i] == "\\" and mark == '"' else 1
        if i >= len(self.text) or self.text[i] != mark:
            raise Fault(start, "quote is not closed")
        self.at = i + 1
        return self.text[start + 1 : i]

    def _name(self) -> tuple[str, int, int, bool] | None:
        """One part of a key."""
        start = self.at
        if self.text[start : start + 1] in ("'", '"'):
            return self._quoted(), start, self.at, True
        while self.at < len(self.text):
            c = self.text[self.at]
            if c == "\\" and self.at + 1 < len(self.text):
                self.at += 2
            elif c in "\n;{}[]():.|" or c == "#" and self.text[self.at - 1 : self.at] in (" ", "\t", "") or CONNECTOR.match(self.text, self.at) and self._connects():
                break
            else:
                self.at += 1
        raw = self.text[start : self.at]
        own = raw.strip()
        return (own, start + len(raw) - len(raw.lstrip()), start + len(raw.rstrip()), False) if own else None

    def _connects(self) -> bool:
        """A run of dashes joins two keys: it has a point, or is two dashes long and not inside a word."""
        m = CONNECTOR.match(self.text, self.at)
        inside = re.match(r"\w", self.text[self.at - 1 : self.at]) and re.match(r"\w", self.text[m.end() : m.end() + 1])
        return ">" in m[0] or "<" in m[0] or not inside

    def _key(self) -> Key | None:
        key = Key()
        while True:
            self._space(False)
            part = self._name()
            if part is None:
                if key.parts:
                    raise Fault(self.at, "a name is missing after the point")
                return None
            key.parts.append(part)
            self._space(False)
            if self.text[self.at : self.at + 1] != ".":
                return key
            self.at += 1

    def _statement(self) -> Statement:
        start = self.at
        if self.text.startswith("...", self.at):  # spread of an import or a variable
            self.at += 3
            self._scalar(start)
            return Statement(None, [], start, self.at)
        if self.text[self.at] in "&!":
            self.at += 1 + (self.text.startswith("!&", self.at))
        first = None
        if self.text[self.at : self.at + 1] == "(":
            edges = self._group()
        else:
            first, edges = self._key(), []
            if CONNECTOR.match(self.text, self.at):
                edges, first = self._chain(first), None
            elif first is not None and self.text[self.at : self.at + 1] == "(":
                edges = self._group()
        if first is None and not edges:
            raise Fault(self.at, "a key is missing")
        self._space(False)
        s = Statement(first, edges, start, self.at)
        if self.text[self.at : self.at + 1] == ":":
            self.at += 1
            self._space(False)
            self._value(s)
        elif self.text[self.at : self.at + 1] == "{":
            opened = self.at
            self.at += 1
            s.body = self._map(opened)
        self._space(False)
        if self.at < len(self.text) and self.text[self.at] not in "\n;}#":
            raise Fault(self.at, f"unexpected {self.text[self.at]}")
        return s

    def _group(self) -> list[Key]:
        """``(a -> b)[0]`` and a path into it."""
        opened = self.at
        self.at += 1
        edges = self._chain(self._key())
        self._space(False)
        if self.text[self.at : self.at + 1] != ")":
            raise Fault(opened, "parenthesis is not closed")
        self.at += 1
        if m := re.compile(r"\[(?:\d+|\*)\]").match(self.text, self.at):
            self.at = m.end()
        elif self.text[self.at : self.at + 1] == "[":
            raise Fault(self.at, "an edge's index is a number or *")
        if self.text[self.at : self.at + 1] == ".":
            self.at += 1
            edges.append(self._key() or Key())
        return edges

    def _chain(self, first: Key | None) -> list[Key]:
        out = [first]
        while m := CONNECTOR.match(self.text, self.at):
            if out[-1] is None:
                raise Fault(m.start(), "an edge has no source")
            self.at = m.end()
            if self.text[self.at : self.at + 1] == "\\":
                self._space(False)
            target = self._key()
            if target is None:
                raise Fault(m.start(), "an edge has no target")
            out.append(target)
        return [k for k in out if k]

    def _value(self, s: Statement) -> None:
        c = self.text[self.at : self.at + 1]
        if c == "{":
            opened = self.at
            self.at += 1
            s.body = self._map(opened)
            return
        s.value, s.value_at, s.block = self._scalar(self.at)
        self._space(False)
        if self.text[self.at : self.at + 1] == "{":
            opened = self.at
            self.at += 1
            s.body = self._map(opened)

    def _scalar(self, start: int) -> tuple[str | None, tuple[int, int], bool]:
        self.at = max(self.at, start)
        c = self.text[self.at : self.at + 1]
        start = self.at
        if c in ("'", '"'):
            value = self._quoted()
            return value, (start, self.at), False
        if c == "|":
            return self._block(), (start, self.at), True
        if c == "[":
            depth = 0
            while self.at < len(self.text):
                x = self.text[self.at]
                if x in "'\"":
                    self._quoted()
                    continue
                depth += (x == "[") - (x == "]")
                self.at += 1
                if not depth:
                    return self.text[start : self.at], (start, self.at), False
            raise Fault(start, "bracket is not closed")
        while self.at < len(self.text) and self.text[self.at] not in "\n;{}":
            x = self.text[self.at]
            if self.text.startswith("${", self.at):
                end = self.text.find("}", self.at)
                if end < 0 or "\n" in self.text[self.at : end]:
                    raise Fault(self.at, "variable is not closed")
                self.at = end + 1
            elif x == "#" and self.text[self.at - 1] in " \t":
                break
            else:
                self.at += 2 if x == "\\" else 1
        raw = self.text[start : self.at]
        own = raw.strip()
        return own or None, (start, start + len(raw.rstrip())), False

    def _block(self) -> str:
        """A block string: ``|lang ... |``, with more marks where the text has bars."""
        m = re.compile(r"\|([^\w\s|]*|\|*)").match(self.text, self.at)
        close = m[1][::-1].translate(str.maketrans("([{<", ")]}>")) + "|"
        end = self.text.find(close, m.end())
        if end < 0:
            raise Fault(self.at, "block string is not closed")
        own = self.text[m.end() : end]
        self.at = end + len(close)
        return own


def d2_faults(text: str) -> list[tuple[int, int | None, str, tuple[str, ...], frozenset | None, bool]]:
    """(start, end, message, near, known, strict) of a diagram's faults; an end of None is the whole line, ``known`` are the right names."""
    tree = D2(text)
    if tree.fault:
        return [(min(tree.fault.at, max(0, len(text) - 1)), None, f"invalid diagram: {tree.fault.message}", (), None, True)]
    out: list = []
    classes: set[str] = set()

    def gather(statements: list[Statement]) -> None:
        for s in statements:
            if s.key and s.key.names == ["classes"] and s.body:
                classes.update(p.key.parts[0][0] for p in s.body if p.key and p.key.parts)
            if s.key and len(s.key.parts) > 1 and s.key.names[0] == "classes":
                classes.add(s.key.parts[1][0])
            if s.body:
                gather(s.body)

    def wrong(at: tuple[int, int], message: str, known=None, strict: bool = True) -> None:
        out.append((*at, message, (), known, strict))

    def styled(name: str, s: Statement) -> None:
        value = (s.value or "").strip()
        if not value or "${" in value or value == "null":
            return
        if name in D2_FLAGS and value.lower() not in ("true", "false"):
            wrong(s.value_at, f"{name} is true or false")
        elif name in D2_RANGES:
            least, most = D2_RANGES[name]
            try:
                number = float(value)
                good = number >= least and (most is None or number <= most) and (name == "opacity" or number == int(number))
            except ValueError:
                good = False
            if not good:
                wrong(s.value_at, f"{name} is between {least} and {most}" if most is not None else f"{name} is a number of {least} or more")
        elif name in D2_CHOICES and value not in D2_CHOICES[name]:
            wrong(s.value_at, f"unknown {name} {value!r}", frozenset(D2_CHOICES[name]))

    def walk(statements: list[Statement], inside: str) -> None:
        for s in statements:
            key = s.key or (s.edges[-1] if s.edges and len(s.edges) > 2 else None)
            names = [n for n in (key.names if key else [])]
            if inside == "vars":
                continue
            if inside == "style" and names and not names[0].startswith(("&", "*")):
                if names[0] not in D2_STYLES:
                    wrong(key.parts[0][1:3], f"unknown style {key.parts[0][0]!r}", D2_STYLES)
                else:
                    styled(names[0], s)
                continue
            if "style" in names[:-1]:
                at = names.index("style") + 1
                if names[at] not in D2_STYLES and names[at] != "*":
                    wrong(key.parts[at][1:3], f"unknown style {key.parts[at][0]!r}", D2_STYLES)
                else:
                    styled(names[at], s)
            elif names and names[-1] == "style" and s.value is not None and s.body is None:
                wrong(s.value_at, "style takes a map")
            last = names[-1] if names else ""
            value = (s.value or "").strip()
            plain = value and "${" not in value and value != "null" and not (key and key.parts[-1][3])
            if last == "shape" and plain and value.lower() not in D2_SHAPES | D2_ARROWS:
                wrong(s.value_at, f"unknown shape {value!r}", D2_SHAPES | D2_ARROWS)
            elif last == "direction" and plain and value not in D2_DIRECTIONS:
                wrong(s.value_at, f"unknown direction {value!r}", D2_DIRECTIONS)
            elif last == "class" and plain and not value.startswith("[") and classes and value not in classes:
                wrong(s.value_at, f"unknown class {value!r}", frozenset(classes), False)
            elif last == "class" and plain and not value.startswith("[") and not classes:
                wrong(s.value_at, f"unknown class {value!r}", frozenset(), False)
            elif last in ("width", "height", "grid-rows", "grid-columns", "grid-gap", "horizontal-gap", "vertical-gap") and plain and s.body is None and re.match(r"-?[\d.]+$|[a-z]+$", value):
                styled(last, s)
            elif last in D2_BOARDS and len(names) == 1 and plain and s.body is None and not value.startswith("@"):
                wrong(s.value_at, f"{last} takes a map")
            if s.body is not None:
                inner = "style" if last == "style" else "vars" if last == "vars" or inside == "vars" else ""
                walk(s.body, inner)

    gather(tree.statements)
    walk(tree.statements, "")
    return out


#: Marks that begin and end a block inside a Mermaid diagram, by its kind (fixed values).
MERMAID_BLOCKS = {
    "sequenceDiagram": ("loop alt opt par critical break rect box", "end"), "graph": ("subgraph", "end"), "flowchart": ("subgraph", "end"),
}
#: What each line of a kind may look like; what matches none is reported.
MERMAID_LINES = {
    "sequenceDiagram": r"(?:participant|actor|create|destroy|activate|deactivate|autonumber|note|title|link|links|loop|alt|else|opt|par|and|critical|option|break|rect|box|end|accTitle|accDescr)\b.*|[^-<>:]+?\s*(?:<<)?-{1,2}(?:>>|>|x|\)|\|)[-+]?\s*[^:]+:.*",
    "pie": r'(?:showData|title\b.*|accTitle.*|accDescr.*|"[^"]*"\s*:\s*\d+(?:\.\d+)?)',
    "gantt": r"(?:title|dateFormat|axisFormat|tickInterval|todayMarker|excludes|includes|section|weekday|inclusiveEndDates|topAxis|click|accTitle|accDescr)\b.*|[^:]+:.+",
    "journey": r"(?:title|section|accTitle|accDescr)\b.*|[^:]+:\s*\d+\s*(?::.*)?",
    "stateDiagram": r"(?:state|note|direction|hide|end|classDef|class|title|accTitle|accDescr)\b.*|\[\*\].*|.*-->.*|[\w.-]+(?:\s*:.*)?|[{}]|--|.*:::.*",
    "erDiagram": r"(?:title|accTitle|accDescr|direction|style|classDef|class)\b.*|.*(?:\|\||\|o|o\||\}o|\}\||o\{|\|\{|one|many|zero|only|to).*:.*|[\w-]+(?:\[.*\])?\s*\{?|\}|[\w()\[\]*,-]+\s+[\w-]+.*",
}


def mermaid_faults(body: str, kind: str, first: int) -> list[tuple[int, int, str]]:
    """(start, end, message) of lines after the header, which begins at ``first``, that the diagram's kind does not know, and of blocks left open."""
    out: list[tuple[int, int, str]] = []
    family = re.sub(r"-v\d$", "", kind)
    opens, close = MERMAID_BLOCKS.get(family, ("", ""))
    known = re.compile(MERMAID_LINES[family], re.I) if family in MERMAID_LINES else None
    stack: list[tuple[int, int]] = []
    at = body.find("\n", first)
    at = len(body) if at < 0 else at + 1
    multi = False
    for line in body[at:].split("\n"):
        own = line.strip().rstrip(";")
        start, end = at + len(line) - len(line.lstrip()), at + len(line.rstrip())
        at += len(line) + 1
        if multi:
            multi = not re.search(r"\}|end note", own)
            continue
        if not own or own.startswith("%%"):
            continue
        if re.match(r"accDescr\s*\{[^}]*$", own) or (family == "stateDiagram" and re.match(r"note\b[^:]*$", own)):
            multi = True
            continue
        word = re.match(r"\w*", own)[0]
        if opens and word in opens.split():
            stack.append((start, end))
        elif close and own == close:
            if not stack:
                out.append((start, end, "end closes nothing"))
            else:
                stack.pop()
        elif known and not known.fullmatch(own):
            out.append((start, end, f"not a line of a {kind}"))
    out += [(a, b, "block is not closed by end") for a, b in stack]
    return sorted(out)
