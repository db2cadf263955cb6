"""Markdown to structure in one pass over a text: lines with flags, blocks, and inline elements.

Covered: ATX and setext headings, fenced and indented code, block quotes, lists, pipe tables, thematic breaks, YAML
front matter, HTML blocks and comments, reference and footnote definitions, inline and reference links, images,
autolinks and bare addresses, code spans, emphasis. Offsets count characters.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass, field


@dataclass
class Line:
    start: int
    text: str
    depth: int = 0  # block quote depth
    body: int = 0  # where the text after the quote marks starts
    code: bool = False
    front: bool = False
    html: bool = False
    table: bool = False

    @property
    def end(self) -> int:
        return self.start + len(self.text)

    @property
    def inner(self) -> str:
        return self.text[self.body :]

    @property
    def blank(self) -> bool:
        return not self.inner.strip()


@dataclass
class Heading:
    level: int
    text: str
    start: int
    end: int
    line: int
    setext: bool = False
    given_anchor: str | None = None
    anchor: str = ""


@dataclass
class Code:
    start: int
    end: int
    first: int  # lines
    last: int
    fenced: bool
    info: str = ""
    body: int = 0
    body_end: int = 0
    fence: str = ""
    closed: bool = True

    @property
    def lang(self) -> str:
        word = self.info.strip().split()[0] if self.info.strip() else ""
        return word.strip("{}").lstrip(".").split(",")[0]


@dataclass
class Item:
    start: int  # of the marker
    line: int
    marker: str
    column: int
    content: int  # column of the content
    depth: int
    number: int | None
    list_id: int = 0


@dataclass
class Table:
    lines: list[int] = field(default_factory=list)


@dataclass
class Link:
    kind: str  # inline reference autolink bare html
    image: bool
    dest: str
    text: str
    start: int
    end: int
    text_start: int = 0
    label: str = ""
    dest_start: int = 0


@dataclass
class Segment:
    kind: str
    start: int
    text: str
    section: int


FENCE = re.compile(r"( {0,3})(`{3,}|~{3,})([^\n]*)$")
ATX = re.compile(r" {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
ITEM = re.compile(r"([ \t]*)([-*+]|\d{1,9}[.)])([ \t]+|$)")
RULE = re.compile(r" {0,3}([-*_])[ \t]*(?:\1[ \t]*){2,}$")
DELIMITER = re.compile(r" {0,3}\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$")
REF_DEF = re.compile(r" {0,3}\[([^\]^][^\]]*)\]:[ \t]*(\S+)")
NOTE_DEF = re.compile(r" {0,3}\[\^([^\]\s]+)\]:")
HTML_BLOCK = re.compile(r" {0,3}<(?:/?[A-Za-z][\w-]*(?:[\s/>]|$)|!--|!|\?)")
CODE_SPAN = re.compile(r"(?<![`\\])(`+)(?!`)((?:(?!\n[ \t]*\n)[\s\S])+?)(?<!`)\1(?!`)")
AUTOLINK = re.compile(r"<((?:https?|ftp|mailto):[^<>\s]*|[\w.+-]+@[\w-]+(?:\.[\w-]+)+)>")
TAG = re.compile(r"</?([A-Za-z][\w-]*)((?:\s[^<>]*)?)/?>")
COMMENT = re.compile(r"<!--[\s\S]*?-->")
INLINE = re.compile(r"(!?)\[((?:[^\[\]\\]|\\.|!?\[(?:[^\[\]\\]|\\.)*\](?:\([^()\s]*\))?)*)\]\(\s*(<[^<>\n]*>|(?:[^\s()\\]|\\.|\([^\s()]*\))*)(?:\s+(?:\"[^\"]*\"|'[^']*'|\([^()]*\)))?\s*\)")
REFERENCE = re.compile(r"(!?)\[((?:[^\[\]\\]|\\.)+)\]\[([^\[\]]*)\]")
SHORTCUT = re.compile(r"(!?)\[((?:[^\[\]\\^]|\\.)(?:[^\[\]\\]|\\.)*)\](?![\[(:])")
NOTE_REF = re.compile(r"\[\^([^\]\s]+)\](?!:)")
BARE = re.compile(r"(?<![\w/@.\[(<\"'=])(?:https?://|www\.)[^\s<>\x01\"'`|]*[^\s<>\x01\"'`|.,;:!?)\]*_]", re.I)
STRONG = re.compile(r"(?<![\\*_\w])(\*\*|__)(?=[^\s*_])((?:(?!\n\s*\n)[\s\S])*?[^\s\\])\1(?![\w*_])|(\*\*)(?=[^\s*])([^*\n]*?[^\s*\\])\*\*")
EMPHASIS = re.compile(r"(?<![\\*\w])(\*)(?=[^\s*])((?:(?!\n\s*\n)[^*])*?[^\s*\\])\*(?!\*)|(?<![\\_\w])(_)(?=[^\s_])((?:(?!\n\s*\n)[^_])*?[^\s_\\])_(?![\w_])")


def slug(text: str) -> str:
    """Anchor of a heading: lower case, letters, digits, hyphens and underscores; spaces become hyphens."""
    return "".join("-" if c == " " else c for c in text.strip().lower() if c.isalnum() or c in "-_ ")


def label_of(text: str) -> str:
    return re.sub(r"\s+", " ", text.strip()).lower()


def plain(text: str) -> str:
    """Inline text without its marks."""
    text = re.sub(r"!?\[([^\[\]]*)\](?:\([^()]*\)|\[[^\]]*\])?", r"\1", text)
    text = re.sub(r"`+([^`]*)`+", r"\1", text)
    text = re.sub(r"<[^<>]+>", "", text)
    return re.sub(r"(\*\*|__|\*|(?<!\w)_|_(?!\w)|~~)", "", text).strip()


def blanked(text: str) -> str:
    return re.sub(r"[^\n]", " ", text)


class Document:
    """The structure of a Markdown text."""

    def __init__(self, text: str):
        self.text = text
        self.lines: list[Line] = []
        at = 0
        for raw in text.split("\n"):
            m = re.match(r"(?: {0,3}>[ \t]?)*", raw)
            self.lines.append(Line(at, raw, raw[: m.end()].count(">"), m.end()))
            at += len(raw) + 1
        self.headings: list[Heading] = []
        self.code: list[Code] = []
        self.items: list[Item] = []
        self.lists: list[list[Item]] = []
        self.tables: list[Table] = []
        self.rules: list[int] = []
        self.ref_defs: list[tuple[str, str, int, int]] = []
        self.note_defs: list[tuple[str, int, int]] = []
        self.html_blocks: list[tuple[int, int]] = []
        self.front: str | None = None
        self._code_ranges: list[tuple[int, int]] | None = None
        self.comments = [(m.start(), m.end()) for m in COMMENT.finditer(text)]
        self._number: dict[int, int] = {}
        self._repeats: dict[str, int] = {}
        self._blocks()
        self.item_lines = {i.line for i in self.items}
        self.heading_lines = {h.line for h in self.headings}
        self._inline()
        self._segments: list[Segment] | None = None

    def line_of(self, at: int) -> int:
        lo, hi = 0, len(self.lines) - 1
        while lo < hi:
            mid = (lo + hi + 1) // 2
            if self.lines[mid].start <= at:
                lo = mid
            else:
                hi = mid - 1
        return lo

    # blocks

    def _blocks(self) -> None:
        lines, i, n = self.lines, 0, len(self.lines)
        if n and lines[0].text.rstrip() == "---":
            for j in range(1, n):
                if lines[j].text.rstrip() in ("---", "..."):
                    for x in lines[: j + 1]:
                        x.front = True
                    self.front = "\n".join(x.text for x in lines[1:j])
                    i = j + 1
                    break
        commented = bytearray(len(self.text) + 1)
        for a, b in self.comments:
            commented[a:b] = b"\1" * (b - a)
        anchors: set[str] = set()
        self._anchors = anchors
        stack: list[list[Item]] = []  # open lists, outermost first
        paragraph = False
        while i < n:
            line = lines[i]
            inner = line.inner
            fence = FENCE.match(inner) or (FENCE.match(inner.lstrip()) if stack else None)
            if fence and not (fence[2][0] == "`" and "`" in fence[3]):
                i = self._fence(i, fence, line)
                paragraph = False
                continue
            if line.blank:
                paragraph = False
                i += 1
                continue
            indent = len(inner) - len(inner.lstrip(" \t")) + 3 * (len(inner) - len(inner.lstrip(" \t")) and inner[: len(inner) - len(inner.lstrip(" \t"))].count("\t"))
            if commented[line.start]:
                line.html = True
                i += 1
                continue
            if indent >= 4 and not paragraph and not stack:
                j = i
                while j + 1 < n and (lines[j + 1].inner.startswith(("    ", "\t")) or (lines[j + 1].blank and any(x.inner.startswith(("    ", "\t")) for x in lines[j + 2 : j + 3]))):
                    j += 1
                for x in lines[i : j + 1]:
                    x.code = True
                self.code.append(Code(line.start, lines[j].end, i, j, False, "", line.start, lines[j].end))
                i = j + 1
                continue
            if m := ATX.match(inner):
                self._heading(i, len(m[1]), m[2] or "", False)
                stack, paragraph = [], False
                i += 1
                continue
            if RULE.match(inner) and not (paragraph and set(inner.strip()) <= {"-"}):
                self.rules.append(i)
                stack, paragraph = [], False
                i += 1
                continue
            if paragraph and re.fullmatch(r" {0,3}(=+|-+)[ \t]*", inner) and not stack:
                self._heading(i - 1, 1 if "=" in inner else 2, lines[i - 1].inner.strip(), True)
                self.headings[-1].end = line.end
                paragraph = False
                i += 1
                continue
            if m := NOTE_DEF.match(inner):
                self.note_defs.append((m[1].lower(), line.start + line.body + m.start(1) - 2, line.start + line.body + m.end()))
            elif not paragraph and (m := REF_DEF.match(inner)):
                self.ref_defs.append((label_of(m[1]), m[2], line.start + line.body + m.start(1) - 1, line.end))
                i += 1
                continue
            if "|" in inner and i + 1 < n and DELIMITER.match(lines[i + 1].inner) and "|" in lines[i + 1].inner + inner and not paragraph:
                j = i + 1
                while j + 1 < n and not lines[j + 1].blank and not ITEM.match(lines[j + 1].inner) and lines[j + 1].depth == line.depth:
                    j += 1
                for x in lines[i : j + 1]:
                    x.table = True
                self.tables.append(Table(list(range(i, j + 1))))
                i = j + 1
                stack = []
                continue
            m = ITEM.match(inner)
            if m and not (paragraph and not stack and m[2][0].isdigit() and m[2] not in ("1.", "1)")):
                stack = self._item(i, m, stack)
                paragraph = True
                i += 1
                continue
            if not paragraph and HTML_BLOCK.match(inner):
                j = i
                while j + 1 < n and not lines[j + 1].blank:
                    j += 1
                if not AUTOLINK.match(inner.strip()):
                    for x in lines[i : j + 1]:
                        x.html = True
                    self.html_blocks.append((line.start, lines[j].end))
                    i = j + 1
                    continue
            if stack and not paragraph and indent < stack[0][0].content:
                stack = []
            paragraph = True
            i += 1

    def _fence(self, i: int, fence: re.Match, line: Line) -> int:
        lines, n, mark = self.lines, len(self.lines), fence[2]
        close = re.compile(rf"[ \t]*{re.escape(mark[0])}{{{len(mark)},}}[ \t]*$")
        j = i + 1
        while j < n and not close.match(lines[j].inner):
            if lines[j].depth < line.depth:
                break
            j += 1
        closed = j < n and bool(close.match(lines[j].inner)) and lines[j].depth >= line.depth
        last = j if closed else min(j, n) - 1
        for x in lines[i : last + 1]:
            x.code = True
        body = lines[i + 1].start if i + 1 < n else line.end
        end = (lines[last].start if closed else lines[last].end) if last > i else body
        self.code.append(Code(line.start + line.body + len(line.inner) - len(line.inner.lstrip()), lines[last].end, i, last, True, fence[3].strip(), body, max(body, end), mark, closed))
        return last + 1

    def _heading(self, i: int, level: int, raw: str, setext: bool) -> None:
        line = self.lines[i]
        given_anchor = None
        if m := re.search(r"\s*\{#([\w:.-]+)[^}]*\}\s*$", raw):
            given_anchor, raw = m[1], raw[: m.start()]
        text = plain(raw)
        anchor = given_anchor or slug(text)
        base = anchor
        if given_anchor is None:
            k = self._repeats.get(base, 0)
            while anchor in self._anchors:
                k += 1
                anchor = f"{base}-{k}"
            self._repeats[base] = k
            self._anchors.add(anchor)
        self.headings.append(Heading(level, text, line.start + line.body, line.end, i, setext, given_anchor, anchor))

    def _item(self, i: int, m: re.Match, stack: list[list[Item]]) -> list[list[Item]]:
        line = self.lines[i]
        column = len(m[1].expandtabs(4))
        space = len(m[3]) if m[3].strip("\t") or not m[3] else 1
        item = Item(line.start + line.body + m.start(2), i, m[2], column, column + len(m[2]) + (space if 0 < space < 5 else 1), 0, int(m[2][:-1]) if m[2][0].isdigit() else None)
        while stack and column < stack[-1][-1].column and len(stack) > 1 and column < stack[-1][0].column:
            stack = stack[:-1]
        kind = item.marker[-1]
        if stack and column >= stack[-1][-1].content:
            stack = [*stack, []]
        elif stack and stack[-1][-1].marker[-1] != kind:
            stack = [*stack[:-1], []]
        elif not stack:
            stack = [[]]
        if not stack[-1]:
            self._number[id(stack[-1])] = len(self.lists)
            self.lists.append(stack[-1])
        item.depth, item.list_id = len(stack) - 1, self._number[id(stack[-1])]
        stack[-1].append(item)
        self.items.append(item)
        return stack

    # inline

    def in_code(self, at: int) -> bool:
        if self._code_ranges is None:  # merged once, so that a place is looked up by one search
            merged: list[tuple[int, int]] = []
            for a, b in sorted([(c.start, c.end) for c in self.code] + [(a, b) for a, b, _ in self.spans]):
                if merged and a <= merged[-1][1]:
                    merged[-1] = (merged[-1][0], max(merged[-1][1], b))
                else:
                    merged.append((a, b))
            self._code_ranges = merged
        i = bisect_right(self._code_ranges, (at, 1 << 62)) - 1
        return i >= 0 and self._code_ranges[i][0] <= at < self._code_ranges[i][1]

    def _mask(self, text: str, spans) -> str:
        out, at = [], 0
        for a, b in sorted(spans):
            if a >= at:
                out += [text[at:a], re.sub(r"[^\n]", "\x01", text[a:b])]
                at = b
        return "".join([*out, text[at:]])

    def _inline(self) -> None:
        text = self.text
        blocks = [(c.start, c.end) for c in self.code] + list(self.comments)
        if self.front is not None:
            last = max(i for i, x in enumerate(self.lines) if x.front)
            blocks.append((0, self.lines[last].end))
        text = self._mask(text, blocks)
        self.spans: list[tuple[int, int, int]] = [(m.start(), m.end(), len(m[1])) for m in CODE_SPAN.finditer(text)]
        self.prose = text = self._mask(text, [(a, b) for a, b, _ in self.spans])
        self.links: list[Link] = []
        labels = {d[0] for d in self.ref_defs}
        taken: list[tuple[int, int]] = []
        cover, covered = bytearray(len(text) + 1), 0
        starts = {i.start for i in self.items}

        def free(a: int, b: int) -> bool:
            nonlocal covered
            for x, y in taken[covered:]:
                cover[x:y] = b"\1" * (y - x)
            covered = len(taken)
            return not any(cover[a:b])

        for m in AUTOLINK.finditer(text):
            self.links.append(Link("autolink", False, m[1], m[1], m.start(), m.end(), m.start(1), "", m.start(1)))
            taken.append((m.start(), m.end()))
        self.tags = [(m[1].lower(), m[2], m.start(), m.end()) for m in TAG.finditer(text) if free(m.start(), m.end())]
        queue = [(0, text)]
        while queue:  # images inside link texts come after their links
            base, part = queue.pop()
            for m in INLINE.finditer(part):
                a, b = base + m.start(), base + m.end()
                if a and text[a - 1] == "\\":
                    continue
                dest = m[3][1:-1] if m[3].startswith("<") else m[3]
                self.links.append(Link("inline", bool(m[1]), dest, self.text[base + m.start(2) : base + m.end(2)], a, b, base + m.start(2), "", base + m.start(3)))
                taken.append((a, b))
                if "](" in m[2]:
                    queue.append((base + m.start(2), m[2]))
        self.undefined: list[Link] = []
        where = {}
        for d in self.ref_defs:
            where.setdefault(d[0], d[1])
        for m in REFERENCE.finditer(text):
            if free(m.start(), m.end()) and not text[m.start(2)] == "^":
                label = label_of(m[3] or m[2])
                link = Link("reference", bool(m[1]), where.get(label, ""), m[2], m.start(), m.end(), m.start(2), label)
                (self.links if label in labels else self.undefined).append(link)
                taken.append((m.start(), m.end()))
        for m in SHORTCUT.finditer(text):
            label = label_of(m[2])
            if label in labels and free(m.start(), m.end()):
                self.links.append(Link("reference", bool(m[1]), where[label], m[2], m.start(), m.end(), m.start(2), label))
                taken.append((m.start(), m.end()))
        tag_spans = [(a, b) for _, _, a, b in self.tags]
        for name, attrs, a, _ in self.tags:
            for m in re.finditer(r"\b(href|src)\s*=\s*(?:\"([^\"]*)\"|'([^']*)')", attrs):
                g = 2 if m[2] is not None else 3
                at = a + 1 + len(name) + m.start(g)
                self.links.append(Link("html", name == "img", m[g], "", at, at + len(m[g]), at, "", at))
        held = bytearray(len(text) + 1)
        for a, b in [*tag_spans, *((a, b) for _, _, a, b in self.ref_defs)]:
            held[a:b] = b"\1" * (b - a)
        for m in BARE.finditer(text):
            if free(m.start(), m.end()) and not held[m.start()]:
                self.links.append(Link("bare", False, m[0] if "://" in m[0] else "https://" + m[0], m[0], m.start(), m.end(), m.start(), "", m.start()))
        self.links.sort(key=lambda x: x.start)
        self.note_refs = [(m[1].lower(), m.start(), m.end()) for m in NOTE_REF.finditer(text)]
        masked = self._mask(text, taken)
        self.strong = [(m[1] or m[3], m.start(), m.end()) for m in STRONG.finditer(masked)]
        rest = re.sub(r"\*\*|__", "\x01\x01", masked)
        self.emphasis = [(m[1] or m[3], m.start(), m.end()) for m in EMPHASIS.finditer(rest) if m.start() not in starts]

    # prose

    def segments(self) -> list[Segment]:
        """Runs of prose with everything that is not prose blanked, in text order."""
        if self._segments is not None:
            return self._segments
        hide = [(a, b) for a, b, _ in self.spans] + [(a, b) for _, _, a, b in self.tags] + list(self.comments)
        for x in self.links:
            if x.kind in ("bare", "autolink", "html"):
                hide.append((x.start, x.end))
            else:
                hide += [(x.start, x.text_start), (x.text_start + len(x.text), x.end)]
        hide += [(a, b) for _, _, a, b in self.ref_defs] + [(a, b) for _, a, b in self.note_refs]
        clean = list(self.text)
        for a, b in hide:
            for k in range(a, min(b, len(clean))):
                if clean[k] != "\n":
                    clean[k] = " "
        for _, a, b in self.strong:
            clean[a : a + 2] = clean[b - 2 : b] = "  "
        for _, a, b in self.emphasis:
            clean[a] = clean[b - 1] = " "
        prose = "".join(clean)
        out: list[Segment] = []
        section, heads, marks = 0, {h.line: h for h in self.headings}, {i.line: i for i in self.items}
        i, n = 0, len(self.lines)
        while i < n:
            line = self.lines[i]
            if i in heads:
                h = heads[i]
                section += 1
                at = line.start + line.body + (0 if h.setext else len(re.match(r"\s*#+\s*", line.inner)[0]))
                end = line.end - len(line.text) + len(re.sub(r"(\s+#+)?\s*$", "", line.text)) if not h.setext else line.end
                out.append(Segment("heading", at, prose[at : max(at, end)], section))
                i += 2 if h.setext else 1
            elif line.blank or line.code or line.front or line.html or i in self.rules:
                i += 1
            elif line.table:
                if not DELIMITER.match(line.inner):
                    at = line.start
                    for cell in re.split(r"(?<!\\)\|", prose[line.start : line.end]):
                        if cell.strip():
                            out.append(Segment("cell", at, cell, section))
                        at += len(cell) + 1
                i += 1
            else:
                j = i
                while j + 1 < n and not (self.lines[j + 1].blank or self.lines[j + 1].code or self.lines[j + 1].table or self.lines[j + 1].html or j + 1 in heads or j + 1 in marks or j + 1 in self.rules):
                    j += 1
                at = marks[i].start + len(marks[i].marker) if i in marks else line.start + line.body
                body = prose[at : self.lines[j].end]
                if line.depth:
                    body = re.sub(r"(?m)^ {0,3}>", lambda m: " " * len(m[0]), body)
                kind = "item" if i in marks else "quote" if line.depth else "paragraph"
                if body.strip():
                    out.append(Segment(kind, at, body, section))
                i = j + 1
        self._segments = out
        return out
