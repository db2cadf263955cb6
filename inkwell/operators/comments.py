"""Comments of source code: lexer by language, blocks, their prose, and the comment rules (``slop/comment-...``)."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import lru_cache

from .registry import INFO, WARNING, Context, Finding, rule

#: Comment syntax by language: line marks, block comments, nesting, raw backtick literals, triple quotes (fixed values).
SYNTAX = {
    **dict.fromkeys(("rust",), (("//",), True, True, False, False)),
    **dict.fromkeys(("go", "javascript", "typescript"), (("//",), True, False, True, False)),
    **dict.fromkeys(("python", "elixir", "toml"), (("#",), False, False, False, True)),
    **dict.fromkeys(("shell", "ruby"), (("#",), False, False, True, False)),
    "nix": (("#",), True, False, False, False),
    "zig": (("//",), False, False, False, False),
    **dict.fromkeys(("c", "cpp"), (("//",), True, False, False, False)),
    **dict.fromkeys(("java", "csharp"), (("//",), True, False, False, True)),
    "php": (("//", "#"), True, False, True, False),
    "yaml": (("#",), False, False, False, False),
}


@dataclass
class Block:
    """Comment lines that belong together; ``lines`` are (start, content) without marks."""

    start: int
    end: int
    kind: str  # line block doc docstring
    lines: list[tuple[int, str]] = field(default_factory=list)
    trailing: bool = False
    code: str = ""  # the code line after it

    @property
    def text(self) -> str:
        return "\n".join(t for _, t in self.lines)


@lru_cache(maxsize=32)
def lexer(lang: str) -> re.Pattern:
    marks, block, _, raw, triple = SYNTAX[lang]
    parts = []
    if triple:
        parts.append(r'(?P<triple>"""[\s\S]*?(?:"""|\Z)' + (r"|'''[\s\S]*?(?:'''|\Z)" if lang in ("python", "toml", "elixir") else "") + ")")
    if lang == "rust":
        parts.append(r'(?P<rawstring>\br(#*)"[\s\S]*?"\2)')
    parts.append(r'(?P<string>"(?:\\.|[^"\\\n])*"?' + ("" if lang == "rust" else r"|'(?:\\.|[^'\\\n])*'?") + (r"|'(?:\\.|[^'\\\n])'" if lang == "rust" else "") + (r"|`(?:\\.|[^`\\])*`?" if raw else "") + (r"|''[\s\S]*?''" if lang == "nix" else "") + ")")
    if block:
        parts.append(r"(?P<block>/\*)")
    line = "|".join(map(re.escape, marks))
    before = r"(?<![^\s;])" if marks == ("#",) and lang in ("shell", "yaml", "ruby") else ""
    parts.append(rf"(?P<line>{before}(?:{line})[^\n]*)")
    return re.compile("|".join(parts))


def lexed(text: str, lang: str):
    """(kind, start, end) of every comment of a source text."""
    nested, at = SYNTAX[lang][2], 0
    if text.startswith("#!"):
        at = max(text.find("\n"), 0)
    find = lexer(lang)
    while m := find.search(text, at):
        at = m.end()
        if m.lastgroup == "block":
            depth, at = 1, m.end()
            while depth and at < len(text):
                inner = re.compile(r"\*/|/\*" if nested else r"\*/").search(text, at)
                if not inner:
                    at = len(text)
                    break
                depth += 1 if inner[0] == "/*" else -1
                at = inner.end()
            doc = text.startswith(("/**", "/*!"), m.start()) and at - m.start() > 4
            yield ("doc" if doc else "block"), m.start(), at
        elif m["line"] is not None:
            doc = m[0].startswith(("///", "//!")) and not m[0].startswith("////")
            yield ("doc" if doc else "line"), m.start(), m.end()
        elif m.groupdict().get("triple") and lang == "python":
            head = text[: m.start()].rstrip()
            own_line = not text[text.rfind("\n", 0, m.start()) + 1 : m.start()].strip(" \t")
            if own_line and (not head or head.endswith(":") or all(x.lstrip().startswith("#") for x in head.split("\n") if x.strip())):
                yield "docstring", m.start(), m.end()


def blocks_of(c: Context) -> list[Block]:
    if "comments" in c.cache:
        return c.cache["comments"]
    text, out = c.text, []
    for kind, a, b in lexed(text, c.code_lang) if c.code_lang in SYNTAX else ():
        head = text[text.rfind("\n", 0, a) + 1 : a]
        trailing = bool(head.strip())
        if kind == "line" or (kind == "doc" and text[a + 1] == "/"):
            mark = re.match(r"(?://[/!]?|#+)", text[a:b]) or re.match("#", text[a:b])
            at = a + mark.end() + (text[a + mark.end() : a + mark.end() + 1] == " ")
            last = out[-1] if out else None
            if last and last.kind == kind and not last.trailing and not trailing and text[last.end : a].strip(" \t") == "\n" and len(head) == len(text[text.rfind("\n", 0, last.start) + 1 : last.start]):
                last.end = b
                last.lines.append((at, text[at:b]))
            else:
                out.append(Block(a, b, kind, [(at, text[at:b])], trailing))
        else:
            width = 3 if kind in ("doc", "docstring") else 2
            stop = b - width if kind == "docstring" and text[a : a + 3] == text[b - 3 : b] and b - a >= 6 else b - 2 if text.endswith("*/", a, b) else b
            block, at = Block(a, b, kind, [], trailing), a + width
            for part in text[a + width : max(stop, a + width)].split("\n"):
                lead = re.match(r"[ \t]*(?:\*(?!/) ?)?" if kind != "docstring" else r"[ \t]*", part)[0] if at > a + width else part[: len(part) - len(part.lstrip(" "))]
                block.lines.append((at + len(lead), part[len(lead) :]))
                at += len(part) + 1
            out.append(block)
    for block in out:
        rest = text[block.end :].lstrip("\n \t")
        block.code = rest.split("\n", 1)[0].strip()
    c.cache["comments"] = out
    return out


DIRECTIVE = re.compile(r"^\s*(?:[@\\]\w+|eslint|noqa|type:\s*ignore|pylint|clang-format|prettier|nolint|go:|rustfmt|TODO|FIXME|XXX|HACK)\b|^\s*(?:-\*-|vim:)", re.I)
CODE_LIKE = re.compile(r"[;{}]\s*$|^\s*(?:if|for|while|return|let|var|const|import|def|fn|class)\b.*[({=:]\s*\S*$|\w\(\w*\)\s*$|^\s*[\w.]+\s*(?:[-+*/]?=|=>)\s*\S+$")


def prose_of(c: Context, block: Block) -> list[tuple[int, str]]:
    """(start, text) runs of prose of a comment; code, directives, fences and addresses are blanked."""
    out, fenced = [], False
    for at, line in block.lines:
        if line.strip().startswith(("```", "~~~")):
            fenced = not fenced
            continue
        if fenced or line.startswith("    ") or DIRECTIVE.search(line) or CODE_LIKE.search(line) or not line.strip():
            continue
        clean = re.sub(r"`[^`]*`|https?://\S+|(?<!\w)@\w+|\b\w+(?:::|\.|_)\w[\w:._]*", lambda m: " " * len(m[0]), line)
        last = out[-1] if out else None
        if last and c.text[last[0] + len(last[1]) : at].strip(" \t/*#!") == "\n":
            gap = c.text[last[0] + len(last[1]) : at]
            out[-1] = (last[0], last[1] + re.sub(r"[^\n]", " ", gap) + clean)
        else:
            out.append((at, clean))
    return out


LICENSE = re.compile(r"copyright|license|SPDX|all rights reserved|generated", re.I)
WHY = re.compile(r"\b(?:because|since|so that|otherwise|workaround|works around|why|safety|invariant|must|unless|see)\b", re.I)


def exempt(block: Block) -> bool:
    return bool(LICENSE.search(block.text) or DIRECTIVE.search(block.text))


@rule("slop/comment-plan", WARNING, ("code",))
def comment_plan(c: Context):
    for b in blocks_of(c):
        for at, line in b.lines:
            if m := re.search(r"\b(?:(?:step|phase|stage|part|task|milestone) \d+(?:\.\d+)*\b(?: of (?:the )?(?:plan|spec))?|(?:as )?(?:per|from|in) the (?:plan|spec|design doc|requirements))", line, re.I):
                if not exempt(b):
                    yield Finding(at + m.start(), at + m.end(), "comment refers to a plan")


HISTORY = re.compile(r"\b(?:used to|previously|formerly|no longer|was (?:moved|renamed|replaced|removed)|(?:moved|renamed|refactored|extracted) from|(?:old|original) (?:version|implementation|behaviou?r)|we now|now (?:uses|returns|handles)|has been (?:moved|renamed|replaced|removed|refactored))\b", re.I)


@rule("slop/comment-history", WARNING, ("code",))
def comment_history(c: Context):
    for b in blocks_of(c):
        if not exempt(b):
            for at, line in b.lines:
                if m := HISTORY.search(line):
                    yield Finding(at + m.start(), at + m.end(), "comment tells what the code was")
                    break


DECLARATION = re.compile(r"^(?:(?:pub(?:\([^)]*\))?|public|private|protected|static|final|abstract|async|export|default|const|unsafe|override|internal)\s+)*(?:fn|func|function|def|class|struct|enum|trait|interface|type|impl|mod|module|package|let|var|val)\b")
PREAMBLE = re.compile(r"^(?:This|The following|Here,? we|Below)\s+(?:(?:function|method|class|module|struct|block|code|helper|section)\s+)?(?:is|are|does|will|handles|provides|implements|defines|contains|creates|returns|we|function|method|class)\b")
JUSTIFY = re.compile(r"^(?:Note that|Importantly|It is important|We need to|We have to|We want to|Let's|First,|Next,|Finally,|Now,|Now we)\b")
OBVIOUS = re.compile(r"^(?:Increment|Decrement|Initialize|Initialise|Loop (?:over|through)|Iterate (?:over|through)|Return|Set|Get|Create|Check if|Call|Import|Define|Declare|Add)\s(?:the|a|an|all|each|our|i|new)\b")


@rule("slop/comment-narrative", WARNING, ("code",))
def comment_narrative(c: Context):
    long = c.option("comment_lines", 12)
    for b in blocks_of(c):
        if exempt(b) or not b.text.strip():
            continue
        at, first = next((x for x in b.lines if x[1].strip()), (b.start, ""))
        why = None
        if PREAMBLE.match(first) and DECLARATION.match(b.code):
            why = "doc comment announces its item" if b.kind in ("doc", "docstring") else "comment announces the declaration"
        elif PREAMBLE.match(first) and b.kind == "docstring":
            why = "doc comment announces its item"
        elif JUSTIFY.match(first):
            why = "comment narrates"
        elif b.kind == "line" and len(b.lines) == 1 and OBVIOUS.match(first) and not WHY.search(first):
            why = "comment repeats the code"
        elif b.kind in ("line", "block") and len(b.lines) > long and not WHY.search(b.text):
            why = f"comment of {len(b.lines)} lines"
        if why:
            yield Finding(at, at + len(first.rstrip()), why)


BANNER = re.compile(r"^\s*(?:([-=*#~_─═/+])\1{3,}.*|.*([-=*#~_─═/+])\2{4,})\s*$")


@rule("slop/comment-banner", INFO, ("code",))
def comment_banner(c: Context):
    for b in blocks_of(c):
        for at, line in b.lines:
            if BANNER.match(line) and not LICENSE.search(b.text):
                own = line.strip()
                start = at + line.index(own)
                yield Finding(start, start + len(own), "decorative comment")
                break
