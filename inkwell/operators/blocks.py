"""Embedded code: JSON, TOML, YAML, DOT, Mermaid and D2 blocks (``codeblock/...``, ``diagram/...``) and placeholders."""

from __future__ import annotations

import json
import re

from ..functions.diagrams import d2_faults, mermaid_faults
from ..functions.words import near_misses
from .markdown import Code
from .registry import ERROR, WARNING, Context, Finding, rule

try:
    import tomllib
except ImportError:  # before Python 3.11
    tomllib = None
try:
    import yaml
except ImportError:
    yaml = None

SKIP = re.compile(r"\b(?:skip-lint|no-lint|ignore)\b")


def bodies(c: Context, *langs: str):
    """(block, body) of the fenced blocks in some languages that are not exempt."""
    for b in c.doc.code:
        if b.fenced and b.lang.lower() in langs and not SKIP.search(b.info) and not c.doc.lines[b.first].depth:
            yield b, c.text[b.body : b.body_end]


def line_at(c: Context, at: int, b: Code) -> tuple[int, int]:
    """The line of an error, without the white space around it."""
    at = min(max(at, b.body), max(b.body, b.body_end - 1))
    start = c.text.rfind("\n", 0, at) + 1
    end = c.text.find("\n", at)
    end = len(c.text) if end < 0 else end
    own = c.text[start:end]
    return start + len(own) - len(own.lstrip()), start + len(own.rstrip())


def without_comments(text: str) -> str:
    """JSON with comments and trailing commas blanked, at the same length."""
    blank = lambda m: m[0] if m[0][0] == '"' else re.sub(r"[^\n]", " ", m[0])
    text = re.sub(r'"(?:\\.|[^"\\\n])*"|//[^\n]*|/\*[\s\S]*?\*/', blank, text)
    return re.sub(r'"(?:\\.|[^"\\\n])*"|,(?=\s*[}\]])', blank, text)


@rule("codeblock/json", ERROR)
def json_block(c: Context):
    for b, body in bodies(c, "json", "jsonc", "json5"):
        if b.lang.lower() == "json5" or not body.strip() or re.search(r"\.\.\.|…", body):
            continue
        try:
            json.loads(without_comments(body) if b.lang.lower() == "jsonc" else body, parse_constant=lambda x: (_ for _ in ()).throw(json.JSONDecodeError(f"invalid {x}", body, body.index(x))))
        except json.JSONDecodeError as e:
            a, z = line_at(c, b.body + e.pos, b)
            yield Finding(a, z, f"invalid JSON: {e.msg}")


@rule("codeblock/toml", ERROR)
def toml_block(c: Context):
    for b, body in bodies(c, "toml"):
        try:
            if tomllib:
                tomllib.loads(body)
        except tomllib.TOMLDecodeError as e:
            m = re.search(r"\(at line (\d+), column (\d+)\)", str(e))
            line = int(m[1]) - 1 if m else body.rstrip().count("\n")
            at = b.body + sum(len(x) + 1 for x in body.split("\n")[:line])
            a, z = line_at(c, at, b)
            yield Finding(a, z, f"invalid TOML: {str(e).split(' (at')[0]}")


def yaml_errors(body: str):
    """Line numbers of errors found without a YAML library: tabs, unclosed flow collections and quotes, bad indents."""
    depth, opened = 0, 0
    for i, line in enumerate(body.split("\n")):
        clean = re.sub(r'"(?:\\.|[^"\\])*"|\'(?:\'\'|[^\'])*\'|(?:^|\s)#.*$', "", line)
        if re.match(r"[ ]*\t+[ ]*\S", line):
            return i, "tab in the indentation"
        if depth == 0 and re.match(r"\s*[\w-]+:\s+[^\s\"'\[{|>&*!#][^#]*:\s", clean + " ") and not re.search(r"https?:", clean):
            return i, "mapping value in a plain value"
        for ch in clean if re.search(r"(?::|-)\s*[\[{]|^\s*[\[{]|[\]}]", clean) or depth else "":
            if ch in "[{":
                depth += 1
                opened = i
            elif ch in "]}":
                depth -= 1
                if depth < 0:
                    return i, "unmatched bracket"
    return (opened, "bracket is not closed") if depth else None


@rule("codeblock/yaml", ERROR)
def yaml_block(c: Context):
    for b, body in bodies(c, "yaml", "yml"):
        line = None
        if yaml is not None:
            try:
                list(yaml.parse(re.sub(r"(?m)^\s*\.\.\.\s*$", lambda m: " " * len(m[0]), body)))
            except yaml.YAMLError as e:
                line, why = (e.problem_mark.line if getattr(e, "problem_mark", None) else 0), str(getattr(e, "problem", e))
        elif found := yaml_errors(body):
            line, why = found
        if line is not None:
            a, z = line_at(c, b.body + sum(len(x) + 1 for x in body.split("\n")[:line]), b)
            yield Finding(a, z, f"invalid YAML: {why}")


def balanced(text: str, pairs: str = "{}[]"):
    """(offset, message) of the first bracket that does not match; strings and comments do not count."""
    clean = re.sub(r'"(?:\\.|[^"\\])*"|//[^\n]*|/\*[\s\S]*?\*/|(?m:^\s*#[^\n]*)', lambda m: re.sub(r"[^\n]", " ", m[0]), text)
    stack = []
    for i, ch in enumerate(clean):
        k = pairs.find(ch)
        if k >= 0 and k % 2 == 0:
            stack.append((i, pairs[k + 1]))
        elif k >= 0:
            if not stack or stack[-1][1] != ch:
                return i, f"unmatched {ch}"
            stack.pop()
    return (stack[-1][0], f"{text[stack[-1][0]]} is not closed") if stack else None


@rule("codeblock/dot", WARNING)
def dot_block(c: Context):
    for b, body in bodies(c, "dot", "graphviz"):
        if not body.strip():
            continue
        head = re.match(r"(?:\s|//[^\n]*\n|/\*[\s\S]*?\*/|#[^\n]*\n)*(?:strict\s+)?(digraph|graph)\b[^{]*\{", body, re.I)
        clean = re.sub(r'"(?:\\.|[^"\\])*"|//[^\n]*|/\*[\s\S]*?\*/|<[^<>\-]+>', lambda m: re.sub(r"[^\n]", " ", m[0]), body)
        if not head:
            at, why = len(body) - len(body.lstrip()), "no graph or digraph"
        elif found := balanced(body):
            at, why = found
        elif m := re.search("--" if head[1].lower() == "digraph" else "->", clean):
            at, why = m.start(), f"edge {m[0]} in a {head[1].lower()}"
        else:
            continue
        a, z = line_at(c, b.body + at, b)
        yield Finding(a, z, f"invalid DOT: {why}")


@rule("codeblock/empty", WARNING)
def empty_block(c: Context):
    for b in c.doc.code:
        if b.fenced and not c.text[b.body : b.body_end].strip() and not SKIP.search(b.info):
            yield Finding(b.start, b.end, "empty code block")


#: First words of Mermaid diagrams (fixed values).
MERMAID = frozenset(
    """architecture-beta block-beta c4component c4container c4context c4deployment c4dynamic classdiagram classdiagram-v2 erdiagram flowchart gantt gitgraph graph
    info journey kanban mindmap packet-beta pie quadrantchart requirementdiagram sankey-beta sequencediagram statediagram statediagram-v2 timeline xychart-beta zenuml""".split()
)
_SPELLED = {"classdiagram": "classDiagram", "classdiagram-v2": "classDiagram-v2", "erdiagram": "erDiagram", "gitgraph": "gitGraph", "quadrantchart": "quadrantChart", "requirementdiagram": "requirementDiagram", "sequencediagram": "sequenceDiagram", "statediagram": "stateDiagram", "statediagram-v2": "stateDiagram-v2"}


@rule("diagram/mermaid", ERROR)
def mermaid_block(c: Context):
    for b, body in bodies(c, "mermaid"):
        at, front = 0, False
        for line in body.split("\n"):
            own = line.strip()
            if own == "---":
                front = not front
            elif own and not front and not own.startswith("%%"):
                break
            at += len(line) + 1
        else:
            continue
        word = re.match(r"[\w-]+", own)
        name = word[0] if word else own
        start = b.body + at + len(line) - len(line.lstrip())
        if name.lower() not in MERMAID or name != _SPELLED.get(name.lower(), name if name.startswith("C4") else name.lower()):
            near = [_SPELLED.get(n, n) for n in ([name.lower()] if name.lower() in MERMAID else near_misses(name.lower(), MERMAID))]
            yield Finding(start, start + len(name), f"unknown diagram {name!r}", suggestions=tuple(near))
        elif name.lower() in ("graph", "flowchart"):
            clean = re.sub(r"%%[^\n]*|-->|---|-\.->|==>|--[xo]|<--", lambda m: " " * len(m[0]), body)
            clean = re.sub(r">([^\]\n]*)\]", lambda m: " " * len(m[0]), clean)
            if found := balanced(clean, "{}[]()"):
                a, z = line_at(c, b.body + found[0], b)
                yield Finding(a, z, f"invalid diagram: {found[1]}")
                continue
        for x, y, message in mermaid_faults(body, _SPELLED.get(name.lower(), name.lower()), at) if name.lower() in MERMAID else ():
            yield Finding(b.body + x, b.body + y, f"invalid diagram: {message}")


@rule("diagram/d2", ERROR)
def d2_block(c: Context):
    for b, body in bodies(c, "d2"):
        for start, end, message, _, known, strict in d2_faults(body):
            a, z = line_at(c, b.body + start, b) if end is None else (b.body + start, b.body + end)
            name = body[start:end] if end is not None else ""
            yield Finding(a, z, message, suggestions=tuple(near_misses(name, known)) if known else (), severity=None if strict else WARNING)


@rule("config/placeholder", WARNING, ("toml",))
def placeholder(c: Context):
    for m in re.finditer(r"(?m)^\s*(description|relationship|role)\s*=\s*[\"'](\s*|TODO[^\"']*|TBD|FIXME[^\"']*|\.\.\.|…)[\"']", c.text):
        yield Finding(m.start(2) - 1, m.end(2) + 1, f"{m[1]} is a placeholder")
