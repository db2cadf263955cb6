"""Document structure rules (``md/...``) on parsed Markdown."""

from __future__ import annotations

import re

from ..functions.words import near_misses, recased
from .languages import CODE_LANGUAGES
from .markdown import ATX, DELIMITER, TAG, label_of
from .registry import ERROR, INFO, OFF, WARNING, Context, Finding, rule

Found = Finding


def line_blank(doc, i: int) -> bool:
    return not 0 <= i < len(doc.lines) or doc.lines[i].blank or doc.lines[i].front


def around(doc, first: int, last: int, what: str, after: bool = True):
    """Findings where a block touches text before or after; the fix is a blank line."""
    top, end = doc.lines[first], doc.lines[last]
    if first and not line_blank(doc, first - 1) and doc.lines[first - 1].depth >= top.depth:
        yield Found(top.start, top.end, f"{what} needs a blank line before it", "\n", fix_start=top.start, fix_end=top.start)
    if after and last + 1 < len(doc.lines) and not line_blank(doc, last + 1) and doc.lines[last + 1].depth >= end.depth:
        yield Found(end.start, end.end, f"{what} needs a blank line after it", "\n", fix_start=doc.lines[last + 1].start, fix_end=doc.lines[last + 1].start)


def prose_lines(doc):
    return ((i, x) for i, x in enumerate(doc.lines) if not (x.code or x.front))


@rule("md/heading-increment", WARNING)
def heading_increment(c: Context):
    level = None
    for h in c.doc.headings:
        if level is not None and h.level > level + 1:
            yield Found(h.start, h.end, f"heading level {h.level} follows level {level}")
        level = h.level


@rule("md/heading-style", WARNING)
def heading_style(c: Context):
    want = c.option("heading_style", "consistent")
    heads = c.doc.headings
    if heads:
        setext = heads[0].setext if want == "consistent" else want == "setext"
        for h in heads:
            if h.setext != setext and (h.level < 3 or h.setext):
                yield Found(h.start, h.end, "heading style differs from the first heading")


@rule("md/list-marker", WARNING, fixes=True)
def list_marker(c: Context):
    want = c.option("list_marker", None)
    for item in c.doc.items:
        if item.number is None:
            want = want or item.marker
            if item.marker != want:
                yield Found(item.start, item.start + 1, f"list marker should be {want}", want)


@rule("md/list-indent", WARNING)
def list_indent(c: Context):
    step = None
    parents, last = {}, {}
    for i in c.doc.items:
        parents[i.start] = last.get(i.depth - 1)
        last[i.depth] = i
    for items in c.doc.lists:
        first = items[0]
        right = {i.column + len(i.marker) for i in items}
        for item in items[1:]:
            if item.column != first.column and not (first.number is not None and len(right) == 1):
                yield Found(item.start, item.start + len(item.marker), "list items are not aligned")
        if first.depth == 0 and first.column:
            yield Found(first.start, first.start + len(first.marker), "top-level list is indented")
        elif first.depth and first.number is None:
            parent = parents[first.start]
            if parent.number is None:
                own = first.column - parent.column
                step = step or own
                if own != step:
                    yield Found(first.start, first.start + len(first.marker), f"nested list is indented by {own}, elsewhere by {step}")


@rule("md/no-trailing-spaces", WARNING, fixes=True)
def trailing_spaces(c: Context):
    for i, x in prose_lines(c.doc):
        tail = re.search(r"[ \t]+$", x.text)
        if tail and x.text.strip(" \t>"):
            if tail[0] == "  " and not line_blank(c.doc, i + 1):
                continue
            keep = "  " if set(tail[0]) == {" "} and len(tail[0]) > 2 and not line_blank(c.doc, i + 1) else ""
            yield Found(x.start + tail.start(), x.end, "trailing spaces", keep)
        elif tail:
            yield Found(x.start + tail.start(), x.end, "spaces on a blank line", "")


@rule("md/no-hard-tabs", WARNING)
def hard_tabs(c: Context):
    for _, x in prose_lines(c.doc):
        if m := re.search(r"\t+", x.text):
            yield Found(x.start + m.start(), x.start + m.end(), "hard tab")


@rule("md/no-multiple-blanks", WARNING, fixes=True)
def multiple_blanks(c: Context):
    lines, i = c.doc.lines, 0
    while i < len(lines):
        j = i
        while j < len(lines) and not lines[j].text.strip() and not lines[j].code:
            j += 1
        if j - i >= 2 and j < len(lines):
            yield Found(lines[i + 1].start, lines[j - 1].end, "several blank lines", "", fix_end=lines[j].start)
        i = max(j, i + 1)


@rule("md/line-length", OFF)
def line_length(c: Context):
    most = c.option("line_length", 120)
    for _, x in prose_lines(c.doc):
        if len(x.text) > most and not x.table and re.search(r"[ \t]", x.text[most:]) and not re.match(r" {0,3}\[[^\]]+\]:", x.text):
            yield Found(x.start + most, x.end, f"line is longer than {most} characters")


@rule("md/blanks-around-headings", WARNING, fixes=True)
def blanks_headings(c: Context):
    for h in c.doc.headings:
        yield from around(c.doc, h.line, h.line + h.setext, "heading")


@rule("md/heading-start-left", WARNING, fixes=True)
def heading_start_left(c: Context):
    for h in c.doc.headings:
        x = c.doc.lines[h.line]
        lead = len(x.inner) - len(x.inner.lstrip(" "))
        if lead and h.line not in c.doc.item_lines:
            at = x.start + x.body
            yield Found(at, at + lead, "heading is indented", None if h.setext else "")


@rule("md/no-duplicate-heading", WARNING)
def duplicate_heading(c: Context):
    seen, stack = set(), []
    for h in c.doc.headings:
        stack = [p for p in stack if p.level < h.level]
        key = (stack[-1].start if stack else -1, re.sub(r"\s+", " ", h.text))
        if key in seen:
            yield Found(h.start, h.end, f"heading repeats {h.text!r}")
        seen.add(key)
        stack.append(h)


def has_title(doc) -> bool:
    return doc.front is not None and bool(re.search(r"(?m)^title\s*[:=]", doc.front))


@rule("md/single-h1", WARNING)
def single_h1(c: Context):
    for i, h in enumerate(h for h in c.doc.headings if h.level == 1):
        if i or has_title(c.doc):
            yield Found(h.start, h.end, "more than one top-level heading")


@rule("md/no-trailing-punctuation", WARNING)
def trailing_punctuation(c: Context):
    for h in c.doc.headings:
        if h.text and h.text[-1] in ".,;:!\u3002\uff0c\uff1b\uff1a\uff01":
            yield Found(h.start, h.end, f"heading ends in {h.text[-1]}")


@rule("md/ol-prefix", WARNING)
def ol_prefix(c: Context):
    for items in c.doc.lists:
        if len(items) > 1 and items[0].number is not None:
            a = items[0].number
            same = items[1].number == a and a <= 1
            for k, item in enumerate(items):
                want = a if same else a + k
                if item.number != want:
                    yield Found(item.start, item.start + len(item.marker), f"number should be {want}")


@rule("md/blanks-around-fences", WARNING, fixes=True)
def blanks_fences(c: Context):
    for b in c.doc.code:
        if b.fenced:
            yield from around(c.doc, b.first, b.last, "code block", b.closed)


@rule("md/blanks-around-lists", WARNING, fixes=True)
def blanks_lists(c: Context):
    doc = c.doc
    tops = [i for i in doc.items if i.depth == 0]
    list_at = {i.line: i.list_id for i in doc.items}
    for k, item in enumerate(tops):
        before = item.line - 1
        new = k == 0 or item.list_id != tops[k - 1].list_id
        if new and item.line and not line_blank(doc, before) and before not in doc.item_lines and doc.lines[before].depth >= doc.lines[item.line].depth and not doc.lines[before].inner.startswith(" "):
            x = doc.lines[item.line]
            yield Found(x.start, x.end, "list needs a blank line before it", "\n", fix_start=x.start, fix_end=x.start)
        if k + 1 == len(tops) or tops[k + 1].list_id != item.list_id:
            last = item.line
            while last + 1 < len(doc.lines) and not line_blank(doc, last + 1) and (doc.lines[last + 1].inner.startswith((" ", "\t")) or list_at.get(last + 1, -1) >= item.list_id):
                last += 1
            if last + 1 < len(doc.lines) and not line_blank(doc, last + 1) and (last + 1 in doc.heading_lines or doc.lines[last + 1].code or doc.lines[last + 1].table or last + 1 in doc.rules):
                x = doc.lines[last]
                yield Found(x.start, x.end, "list needs a blank line after it", "\n", fix_start=doc.lines[last + 1].start, fix_end=doc.lines[last + 1].start)


@rule("md/no-bare-urls", WARNING, fixes=True)
def bare_urls(c: Context):
    for x in c.doc.links:
        if x.kind == "bare" and x.text.lower().startswith("http"):
            yield Found(x.start, x.end, "bare address", f"<{x.text}>")


@rule("md/no-emphasis-as-heading", WARNING)
def emphasis_heading(c: Context):
    for i, x in prose_lines(c.doc):
        m = re.fullmatch(r"(\*\*|__|\*|_)([^*_]+)\1", x.text.strip())
        if m and not x.depth and not x.table and line_blank(c.doc, i - 1) and line_blank(c.doc, i + 1) and m[2].strip()[-1] not in ".,;:!?" and i not in c.doc.item_lines:
            at = x.start + x.text.index(x.text.strip())
            yield Found(at, at + len(x.text.strip()), "emphasis instead of a heading")


@rule("md/no-space-in-code", WARNING, fixes=True)
def space_in_code(c: Context):
    for a, b, n in c.doc.spans:
        body = c.text[a + n : b - n]
        if body.strip() and body != body.strip() and not (len(body) > 2 and body[0] == body[-1] == " " and ("`" in (body[1], body[-2])) and body[1:-1] == body[1:-1].strip()):
            yield Found(a, b, "spaces inside a code span", c.text[a : a + n] + body.strip() + c.text[b - n : b])


@rule("md/fenced-code-language", WARNING)
def fence_language(c: Context):
    for b in c.doc.code:
        if b.fenced and not b.lang:
            yield Found(b.start, b.start + len(b.fence), "code block without a language")


@rule("md/first-line-heading", OFF)
def first_line(c: Context):
    if has_title(c.doc):
        return
    for i, x in enumerate(c.doc.lines):
        if not (x.blank or x.front or any(a <= x.start < b for a, b in c.doc.comments)):
            if not any(h.line == i and h.level == 1 for h in c.doc.headings) and not x.text.lstrip().lower().startswith("<h1"):
                yield Found(x.start, x.end, "first line is not a top-level heading")
            return


@rule("md/no-empty-links", ERROR)
def empty_links(c: Context):
    for x in c.doc.links:
        if x.kind in ("inline", "reference") and not x.image and x.dest in ("", "#"):
            yield Found(x.start, x.end, "link without a destination")


@rule("md/code-language-known", WARNING)
def known_language(c: Context):
    known = CODE_LANGUAGES | set(c.option("code_languages", ()))
    for b in c.doc.code:
        if b.fenced and b.lang and b.lang.lower() not in known:
            at = b.start + len(b.fence) + c.text[b.start + len(b.fence) :].index(b.lang)
            yield Found(at, at + len(b.lang), f"unknown code language {b.lang!r}", suggestions=tuple(near_misses(b.lang.lower(), known)))


@rule("md/code-block-style", WARNING)
def code_style(c: Context):
    for b in c.doc.code:
        if not b.fenced:
            yield Found(b.start, b.end, "indented code block")


@rule("md/single-trailing-newline", WARNING, fixes=True)
def trailing_newline(c: Context):
    tail = re.search(r"\s*$", c.text)
    if tail.start() and tail[0] != "\n":
        yield Found(tail.start(), len(c.text), "file should end in one newline", "\n")


@rule("md/heading-case", OFF)
def heading_case(c: Context):
    style = c.option("heading_case", "sentence")
    accepted = set(c.option("accepted", ()))
    for h in c.doc.headings:
        want = recased(h.text, style, accepted)
        if want != h.text:
            yield Found(h.start, h.end, f"heading should be {want!r}", suggestions=(want,))


@rule("md/image-alt", WARNING)
def image_alt(c: Context):
    for x in c.doc.links:
        if x.image and x.kind != "html" and not x.text.strip():
            yield Found(x.start, x.end, "image without a description")
    for name, attrs, a, b in c.doc.tags:
        if name == "img" and not re.search(r"\balt\s*=", attrs):
            yield Found(a, b, "image without a description")


@rule("md/no-reversed-links", ERROR, fixes=True)
def reversed_links(c: Context):
    labels = {d[0] for d in c.doc.ref_defs}
    for m in re.finditer(r"\(([^()\n]+)\)\[([^\[\]\n^]+)\](?!\()", c.doc.prose):
        if label_of(m[2]) not in labels and "\x01" not in m[0]:
            yield Found(m.start(), m.end(), "link brackets are reversed", f"[{m[1]}]({m[2]})")


@rule("md/commands-show-output", INFO)
def commands_output(c: Context):
    for b in c.doc.code:
        body = [x for x in c.text[b.body : b.body_end].split("\n") if x.strip()]
        if b.fenced and body and all(x.lstrip().startswith("$ ") for x in body):
            yield Found(b.start, b.end, "every line starts with $ and none shows output")


@rule("md/no-missing-space-atx", WARNING, fixes=True)
def missing_space_atx(c: Context):
    for _, x in prose_lines(c.doc):
        m = re.match(r"(#{1,6})(?=[^#\s])", x.inner)
        if m and not x.html and not re.match(r"#\d|#\ufe0f?\u20e3", x.inner):
            at = x.start + x.body
            yield Found(at, at + len(m[1]), "no space after the heading marks", m[1] + " ")


@rule("md/no-multiple-space-atx", WARNING, fixes=True)
def multiple_space_atx(c: Context):
    for h in c.doc.headings:
        x = c.doc.lines[h.line]
        at = x.start + x.body
        if not h.setext:
            if m := re.match(r" {0,3}#{1,6}([ \t]{2,})\S", x.inner):
                yield Found(at + m.start(1), at + m.end(1), "several spaces after the heading marks", " ")
            if m := re.search(r"\S([ \t]{2,})#+[ \t]*$", x.inner):
                yield Found(at + m.start(1), at + m.end(1), "several spaces before the closing marks", " ")


@rule("md/no-missing-space-closed-atx", WARNING, fixes=True)
def missing_space_closed(c: Context):
    for _, x in prose_lines(c.doc):
        m = re.match(r" {0,3}(#{1,6})([ \t]*)(\S.*?)([ \t]*)(#+)[ \t]*$", x.inner)
        if not m or m[3].endswith("\\"):
            continue
        at = x.start + x.body
        sharp = bool(re.search(r"(?:^|\s)[A-Za-z]$", m[3])) and len(m[5]) == 1
        if not m[4] and not sharp and len(m[5]) == len(m[1]):
            yield Found(at + m.start(5), at + m.end(5), "no space before the closing marks", " " + m[5])
        elif m[4] and not m[2]:
            yield Found(at + m.start(1), at + m.end(1), "no space after the heading marks", m[1] + " ")


@rule("md/no-multiple-space-blockquote", WARNING, fixes=True)
def multiple_space_quote(c: Context):
    for i, x in prose_lines(c.doc):
        m = re.match(r" {0,3}(?:> ?)*>( {2,4})\S", x.text)
        if m and not any(a.line <= i and a.depth >= 0 and c.doc.lines[a.line].depth for a in c.doc.items):
            yield Found(x.start + m.start(1), x.start + m.end(1), "several spaces after the quote mark", " ")


@rule("md/no-blanks-blockquote", WARNING)
def blanks_quote(c: Context):
    lines, i = c.doc.lines, 1
    while i < len(lines):
        j = i
        while j < len(lines) and not lines[j].depth and not lines[j].text.strip():
            j += 1
        if j > i and j < len(lines) and lines[i - 1].depth and lines[j].depth:
            yield Found(lines[i].start, lines[j - 1].end, "blank line splits a block quote")
        i = max(j, i + 1)


@rule("md/list-marker-space", WARNING, fixes=True)
def marker_space(c: Context):
    for items in c.doc.lists:
        aligned = items[0].number is not None and len({i.content for i in items}) == 1 and len({len(i.marker) for i in items}) > 1
        for i in items:
            x = c.doc.lines[i.line]
            m = re.match(r"[ \t]+", c.text[i.start + len(i.marker) : x.end])
            if m and m[0] != " " and len(m[0]) < 5 and not aligned and m.end() < x.end - i.start - len(i.marker):
                yield Found(i.start + len(i.marker), i.start + len(i.marker) + m.end(), "one space after a list marker", " ")


@rule("md/hr-style", WARNING, fixes=True)
def hr_style(c: Context):
    want = c.option("hr_style", None)
    for i in c.doc.rules:
        x = c.doc.lines[i]
        own = x.inner.strip()
        want = want or own
        if own != want:
            at = x.start + x.text.index(own)
            yield Found(at, at + len(own), f"rule should be {want}", want)


@rule("md/no-space-in-emphasis", WARNING, fixes=True)
def space_in_emphasis(c: Context):
    first = {}
    for t in c.doc.items:
        first.setdefault(t.line, t.start)
    rules = set(c.doc.rules)
    for i, x in prose_lines(c.doc):
        if x.html or i in rules:
            continue
        line = c.doc.prose[x.start : x.end]
        skip = first[i] - x.start + 1 if i in first else 0
        for m in re.finditer(r"(?<![\w*_\\])(\*{1,3}|_{1,3})(?![*_])(\s*)([^*_\n]*?[^\W_][^*_\n]*?)(\s*)\1(?![\w*_])", line[skip:]):
            if m[2] or m[4]:
                at = x.start + skip
                yield Found(at + m.start(), at + m.end(), "spaces inside emphasis", m[1] + m[3].strip() + m[1])


@rule("md/no-space-in-links", WARNING, fixes=True)
def space_in_links(c: Context):
    for x in c.doc.links:
        if x.kind in ("inline", "reference") and x.text.strip() and x.text != x.text.strip():
            yield Found(x.text_start, x.text_start + len(x.text), "spaces inside the link text", x.text.strip())


@rule("md/code-fence-style", WARNING, fixes=True)
def fence_style(c: Context):
    want = {"backtick": "`", "tilde": "~"}.get(c.option("code_fence_style", ""), None)
    for b in c.doc.code:
        if b.fenced:
            want = want or b.fence[0]
            if b.fence[0] != want:
                yield Found(b.start, b.start + len(b.fence), "code fence differs from the first", None)


def styled(spans, want, width: int, c: Context):
    for mark, a, b in spans:
        want = want or mark[0]
        if mark[0] != want:
            inside = (a and c.text[a - 1].isalnum()) or (b < len(c.text) and c.text[b].isalnum())
            yield Found(a, b, f"emphasis should use {want}", None if inside and want == "_" else want * width + c.text[a + width : b - width] + want * width)


@rule("md/emphasis-style", WARNING, fixes=True)
def emphasis_style(c: Context):
    yield from styled(c.doc.emphasis, {"asterisk": "*", "underscore": "_"}.get(c.option("emphasis_style", "")), 1, c)


@rule("md/strong-style", WARNING, fixes=True)
def strong_style(c: Context):
    yield from styled(c.doc.strong, {"asterisk": "*", "underscore": "_"}.get(c.option("strong_style", "")), 2, c)


def cells(row: str) -> int:
    own = re.sub(r"\\\|", "", row.strip())
    return own.count("|") + 1 - own.startswith("|") - (own.endswith("|") and len(own) > 1)


@rule("md/table-pipe-style", WARNING)
def pipe_style(c: Context):
    want = None
    for t in c.doc.tables:
        for i in t.lines:
            x = c.doc.lines[i]
            own = (x.inner.strip().startswith("|"), x.inner.strip().endswith("|"))
            want = want or own
            if own != want:
                yield Found(x.start + x.body, x.end, "outer pipes differ from the first row")


@rule("md/table-column-count", ERROR)
def column_count(c: Context):
    for t in c.doc.tables:
        want = cells(c.doc.lines[t.lines[0]].inner)
        for i in t.lines[1:]:
            x = c.doc.lines[i]
            if (own := cells(x.inner)) != want:
                yield Found(x.start + x.body, x.end, f"row has {own} cells, the header {want}")


@rule("md/blanks-around-tables", WARNING, fixes=True)
def blanks_tables(c: Context):
    for t in c.doc.tables:
        yield from around(c.doc, t.lines[0], t.lines[-1], "table")


#: Link texts that say nothing about their target (fixed values).
VAGUE = ("click here", "here", "link", "more", "read more", "this", "this link")


@rule("md/descriptive-link-text", WARNING)
def link_text(c: Context):
    vague = set(c.option("vague_link_text", VAGUE))
    for x in c.doc.links:
        if x.kind in ("inline", "reference") and not x.image and label_of(x.text).rstrip(".:!\u2026 ") in vague:
            yield Found(x.start, x.end, f"link text {x.text!r} does not describe its target")


@rule("md/no-duplicate-definition", ERROR)
def duplicate_definition(c: Context):
    seen = set()
    for label, _, a, b in c.doc.ref_defs:
        if label != "//":
            if label in seen:
                yield Found(a, b, f"[{label}] is defined again")
            seen.add(label)


@rule("md/no-empty-section", WARNING)
def empty_section(c: Context):
    heads = c.doc.headings
    for h, after in zip(heads, heads[1:]):
        if after.level <= h.level and not c.text[h.end : c.doc.lines[after.line].start].strip():
            yield Found(h.start, h.end, "section is empty")


ALERTS = ("CAUTION", "IMPORTANT", "NOTE", "TIP", "WARNING")


@rule("md/alert-syntax", ERROR, fixes=True)
def alert_syntax(c: Context):
    lines = c.doc.lines
    for i, x in prose_lines(c.doc):
        m = re.match(r"\[!([A-Za-z]+)\](.*)$", x.inner)
        if m and x.depth == 1 and (i == 0 or not lines[i - 1].depth):
            at = x.start + x.body
            if m[1].upper() not in ALERTS:
                near = near_misses(m[1].upper(), set(ALERTS))
                yield Found(at + m.start(1), at + m.end(1), f"unknown alert {m[1]}", near[0] if near else None, tuple(near))
            elif m[2].strip():
                yield Found(at, x.end, "text on the line of the alert mark", f"[!{m[1]}]\n> {m[2].strip()}")


@rule("md/no-heading-like-paragraph", WARNING)
def heading_like(c: Context):
    for _, x in prose_lines(c.doc):
        if m := re.match(r" {0,3}(#{7,})(?=\s|$)", x.inner):
            yield Found(x.start + x.body + m.start(1), x.end, "more than six heading marks")


@rule("md/max-heading-length", OFF)
def heading_length(c: Context):
    most = c.option("max_heading_length", 60)
    for h in c.doc.headings:
        if len(h.text) > most:
            yield Found(h.start, h.end, f"heading is longer than {most} characters")


#: Tags that are allowed by default (fixed values).
ALLOWED_TAGS = ("a", "br", "details", "div", "img", "kbd", "p", "picture", "source", "sub", "summary", "sup")


@rule("md/no-inline-html", OFF)
def inline_html(c: Context):
    allowed = set(c.option("allowed_html", ALLOWED_TAGS))
    for name, _, a, b in c.doc.tags:
        if name not in allowed and c.text[a + 1] != "/":
            yield Found(a, b, f"inline HTML <{name}>")


@rule("md/front-matter-required", OFF)
def front_required(c: Context):
    have = set(re.findall(r"(?m)^([\w-]+)\s*[:=]", c.doc.front or ""))
    for key in c.option("front_matter_required", ("title",)):
        if key not in have:
            yield Found(0, len(c.doc.lines[0].text), f"front matter lacks {key}")


@rule("md/task-list-style", INFO, fixes=True)
def task_style(c: Context):
    for i in c.doc.items:
        if m := re.match(r"\s+(\[X\]|\[\])(?=\s)", c.text[i.start + len(i.marker) : c.doc.lines[i.line].end]):
            at = i.start + len(i.marker) + m.start(1)
            yield Found(at, at + len(m[1]), "task box should be [x] or [ ]", "[x]" if "X" in m[1] else "[ ]")


@rule("links/undefined-ref", ERROR)
def undefined_ref(c: Context):
    for x in c.doc.undefined:
        yield Found(x.start, x.end, f"[{x.label}] is not defined")


@rule("links/unused-ref", WARNING)
def unused_ref(c: Context):
    used = {x.label for x in c.doc.links if x.kind == "reference"}
    for label, _, a, b in c.doc.ref_defs:
        if label not in used and label != "//":
            yield Found(a, b, f"[{label}] is never used")


@rule("links/undefined-footnote", ERROR)
def undefined_note(c: Context):
    known = {x[0] for x in c.doc.note_defs}
    for name, a, b in c.doc.note_refs:
        if name not in known:
            yield Found(a, b, f"footnote {name} is not defined")


@rule("links/unused-footnote", WARNING)
def unused_note(c: Context):
    used = {x[0] for x in c.doc.note_refs}
    for name, a, b in c.doc.note_defs:
        if name not in used:
            yield Found(a, b, f"footnote {name} is never used")


@rule("links/duplicate-anchor", WARNING)
def duplicate_anchor(c: Context):
    html = {m[1] for _, attrs, _, _ in c.doc.tags if (m := re.search(r"\b(?:id|name)\s*=\s*[\"']([^\"']+)", attrs))}
    made = {h.anchor for h in c.doc.headings if h.given_anchor is None}
    given: set[str] = set()
    for h in c.doc.headings:
        if h.given_anchor:
            if h.given_anchor in made or h.given_anchor in given or h.given_anchor in html:
                yield Found(h.start, h.end, f"anchor {h.given_anchor} exists already")
            given.add(h.given_anchor)


@rule("links/insecure", INFO)
def insecure(c: Context):
    skip = tuple(c.option("insecure_allowed", ("http://localhost", "http://127.0.0.1")))
    for x in c.doc.links:
        if x.dest.lower().startswith("http://") and not x.dest.lower().startswith(skip) and x.kind != "reference":
            yield Found(x.start, x.end, "address without TLS")
    for _, dest, a, b in c.doc.ref_defs:
        if dest.lower().startswith("http://") and not dest.lower().startswith(skip):
            yield Found(a, b, "address without TLS")


@rule("links/absolute-image-path", ERROR)
def absolute_image(c: Context):
    for x in c.doc.links:
        if x.image and re.match(r"(?i)/(?!/)|~/|file:|[a-z]:[\\/]|\\\\", x.dest):
            yield Found(x.start, x.end, "image path is absolute")


TOC_REGION = re.compile(r"<!--\s*toc\s*-->([\s\S]*?)<!--\s*(?:tocstop|/toc|endtoc)\s*-->", re.I)


@rule("docs/toc-sync", WARNING, fixes=True)
def toc_sync(c: Context):
    """A table of contents must list the headings after it, once each and in their order."""
    for region in TOC_REGION.finditer(c.text):
        a, b = region.span(1)
        entries = [x for x in c.doc.links if a <= x.start < b and x.dest.startswith("#")]
        after = [h for h in c.doc.headings if h.start >= region.end()]
        level = {h.anchor.lower(): h.level for h in after}
        hit = [level[x.dest[1:].lower()] for x in entries if x.dest[1:].lower() in level]
        low, high = (min(hit), max(hit)) if hit else (2, 3)
        want = [h for h in after if low <= h.level <= high]
        order = {h.anchor.lower(): i for i, h in enumerate(want)}
        fixed = "\n" + "".join(f"{'  ' * (h.level - low)}- [{h.text}](#{h.anchor})\n" for h in want)
        seen: set[str] = set()
        last = -1
        for x in entries:
            key = x.dest[1:].lower()
            if key not in order:
                yield Found(x.start, x.end, "entry has no heading", fixed, fix_start=a, fix_end=b)
            elif key in seen:
                yield Found(x.start, x.end, "entry stands twice", fixed, fix_start=a, fix_end=b)
            else:
                if order[key] < last:
                    yield Found(x.start, x.end, "entry is out of order", fixed, fix_start=a, fix_end=b)
                last = max(last, order[key])
                seen.add(key)
        for h in want:
            if h.anchor.lower() not in seen:
                yield Found(region.start(), region.start() + len(c.text[region.start() :].split("\n", 1)[0]), f"{h.text!r} is not listed", fixed, fix_start=a, fix_end=b)


@rule("md/front-matter-lang", INFO, fixes=True)
def front_matter_lang(c: Context):
    """Prose of another language than English without a declaration in the front matter."""
    from ..sources.lexicons import FUNCTION_WORDS
    from .text import lower_segment, segments

    if c.doc.front is not None and re.search(r"(?m)^lang(?:uage)?\s*[:=]", c.doc.front):
        return
    words = [w for s in segments(c) for w in re.findall(r"[^\W\d_]+", lower_segment(c, s))]
    hits = {lang: sum(map(frozenset(FUNCTION_WORDS[lang]).__contains__, words)) for lang in ("en", "fi", "sv")}
    best = max(("fi", "sv"), key=lambda k: hits[k])
    if len(words) >= 8 and hits[best] >= 4 and hits[best] >= 2 * max(v for k, v in hits.items() if k != best):
        line = c.text.split("\n", 1)[0]
        new = f"---\nlang: {best}\n---\n\n" if c.doc.front is None else f"---\nlang: {best}"
        yield Found(0, len(line), f"text is in {best}, not declared", new, fix_start=0, fix_end=0 if c.doc.front is None else 3)
