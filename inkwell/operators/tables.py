"""Structure of documents as child tables: headings, links, code blocks, list items, segments, sentences, comments, catalog entries."""

from __future__ import annotations

import posixpath
import re
from collections.abc import Callable, Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lint import Positions, ship
from .registry import Context

TYPES = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}


def child(documents: DataFrame, ddl: str, rows: Callable[[Context, Positions], Iterator[tuple]]) -> DataFrame:
    """A table of ``doc_id`` and the columns of ``ddl``, some rows a document, in one map without a shuffle."""
    columns = [c.strip().rsplit(" ", 1) for c in ddl.split(",")]
    schema = pa.schema([("doc_id", pa.int64()), *((n, TYPES[t]) for n, t in columns)])
    ship(documents.sparkSession)

    def made(batches):
        for batch in batches:
            out: list[tuple] = []
            for doc_id, path, kind, lang, text, language in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                if text is not None:
                    c = Context(text, path or "", kind or "markdown", lang or "", {} if language is None else {"language": language})
                    out += [(doc_id, *r) for r in rows(c, Positions(text))]
            cols = list(zip(*out, strict=True)) or [()] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(cols, schema, strict=True)], schema=schema)

    language = documents["language"] if "language" in documents.columns else F.lit(None).cast("string")
    return documents.select(F.col("doc_id").cast("long"), "path", "kind", "code_lang", "text", language.alias("language")).mapInArrow(made, f"doc_id long, {ddl}")


def headings(documents: DataFrame) -> DataFrame:
    def rows(c, at):
        for i, h in enumerate(c.doc.headings):
            yield i + 1, h.level, h.text, h.anchor, h.setext, h.given_anchor is not None, at.byte(h.start), at.byte(h.end)

    return child(documents, "h_id int, level int, text string, anchor string, setext boolean, has_given_anchor boolean, b_start long, b_end long", rows)


def normalized(base: str, dest: str) -> str:
    """Path of a destination seen from a document; absolute ones start at the root."""
    clean = dest.split("#")[0].split("?")[0]
    clean = unquote(clean)
    joined = clean.lstrip("/") if clean.startswith("/") else posixpath.join(posixpath.dirname(base), clean)
    return posixpath.normpath(joined) if clean else base


LINK = "l_id int, kind string, is_image boolean, dest string, text string, target string, fragment string, b_start long, b_end long, line int"


def link_rows(c: Context, at: Positions) -> Iterator[tuple]:
    for i, x in enumerate(c.doc.links):
        local = not re.match(r"[A-Za-z][A-Za-z0-9+.-]*:|//|\{\{|\{%|<%", x.dest) and x.dest != ""
        fragment = unquote(x.dest.split("#", 1)[1]).lower().removeprefix("user-content-") if "#" in x.dest else None
        target = re.sub(r":\d+(?::\d+)?$", "", normalized(c.path, x.dest)) if local else None
        yield i + 1, x.kind, x.image, x.dest, x.text, target, fragment, at.byte(x.start), at.byte(x.end), at.line(x.start)[0]


def links(documents: DataFrame) -> DataFrame:
    """Links with the path and the fragment they point at; ``target`` is null for addresses."""
    return child(documents, LINK, link_rows)


def anchor_rows(c: Context, at: Positions) -> Iterator[tuple]:
    for h in c.doc.headings:
        yield (h.anchor.lower(),)
    for _, attrs, _, _ in c.doc.tags:
        for m in re.finditer(r"\b(?:id|name)\s*=\s*[\"']([^\"']+)", attrs):
            yield (m[1].lower(),)


def anchors(documents: DataFrame) -> DataFrame:
    """(doc_id, anchor): of headings and HTML ids, in lower case."""
    return child(documents, "anchor string", anchor_rows).distinct()


def code_blocks(documents: DataFrame) -> DataFrame:
    def rows(c, at):
        for i, b in enumerate(c.doc.code):
            yield i + 1, b.fenced, b.lang, c.text[b.body : b.body_end], at.byte(b.start), at.byte(b.end)

    return child(documents, "c_id int, fenced boolean, lang string, body string, b_start long, b_end long", rows)


def list_items(documents: DataFrame) -> DataFrame:
    def rows(c, at):
        for x in c.doc.items:
            yield x.list_id + 1, x.depth, x.marker, x.number, at.byte(x.start), at.line(x.start)[0]

    return child(documents, "list_id int, depth int, marker string, number int, b_start long, line int", rows)


def segments(documents: DataFrame) -> DataFrame:
    """Prose segments with their section; text has the length of its source, what is not prose is blank."""
    from .text import segments as own

    def rows(c, at):
        for i, s in enumerate(own(c)):
            yield i + 1, s.kind, at.byte(s.start), at.byte(s.start + len(s.text)), s.section, s.text

    return child(documents, "seg_id int, kind string, b_start long, b_end long, section_id int, text string", rows)


def sentences(documents: DataFrame) -> DataFrame:
    from .text import segments as own
    from .text import sentences_of

    def rows(c, at):
        for i, s in enumerate(own(c)):
            for j, (a, b) in enumerate(sentences_of(c, s)):
                yield i + 1, j + 1, at.byte(s.start + a), at.byte(s.start + b), s.text[a:b]

    return child(documents, "seg_id int, s_id int, b_start long, b_end long, text string", rows)


def tokens(documents: DataFrame) -> DataFrame:
    """Words, numbers, spaces, line ends and marks of the prose, in order."""
    from .text import segments as own

    kinds = re.compile(r"(?P<unlintable>(?:https?://|www\.)\S+)|(?P<number>\d+(?:[.,]\d+)*(?:st|nd|rd|th)?)|(?P<word>[^\W\d_]+(?:['’._@][^\W\d_]+)*)|(?P<newline>\n)|(?P<space>[ \t]+)|(?P<punct>[\s\S])")

    def rows(c, at):
        for i, s in enumerate(own(c)):
            for j, m in enumerate(kinds.finditer(s.text)):
                yield i + 1, j + 1, m.lastgroup, m[0], m[0].lower(), at.byte(s.start + m.start()), at.byte(s.start + m.end())

    return child(documents, "seg_id int, tok_id int, kind string, text string, lower string, b_start long, b_end long", rows)


def comments(documents: DataFrame) -> DataFrame:
    from .comments import blocks_of

    def rows(c, at):
        for i, b in enumerate(blocks_of(c) if c.kind == "code" else ()):
            yield i + 1, b.kind, b.trailing, b.text, b.code, at.byte(b.start), at.byte(b.end)

    return child(documents, "c_id int, kind string, trailing boolean, text string, next_code string, b_start long, b_end long", rows)


def po_entries(documents: DataFrame) -> DataFrame:
    from .catalogs import catalog_of

    def rows(c, at):
        for i, e in enumerate(catalog_of(c).entries if c.kind == "gettext" else ()):
            texts = [e.strs[k].value for k in sorted(e.strs)]
            yield i + 1, e.ctxt.value if e.ctxt else None, e.id.value if e.id else None, e.plural.value if e.plural else None, texts, sorted(e.flags), e.obsolete, at.byte(e.start), at.byte(e.end)

    return child(documents, "e_id int, msgctxt string, msgid string, msgid_plural string, msgstr array<string>, flags array<string>, obsolete boolean, b_start long, b_end long", rows)


INCLUDES = re.compile(r"\{\{#include\s+([^}\s]+?)\s*\}\}|--8<--\s*[\"']([^\"']+)[\"']|\{%-?\s*include(?:-markdown)?\s+[\"']([^\"']+)[\"']|^\.\. (?:include|literalinclude):: (\S+)|<!--\s*include:?\s+(\S+?)\s*-->", re.M)


INCLUDE = "file string, candidates array<string>, b_start long, b_end long, line int"


def include_rows(c: Context, at: Positions) -> Iterator[tuple]:
    for m in INCLUDES.finditer(c.text):
        if not c.doc.in_code(m.start()) or m[2]:
            path = re.sub(r":[\w:]*$", "", next(g for g in m.groups() if g))
            yield path, [normalized(c.path, path), posixpath.normpath(path.lstrip("/")), posixpath.normpath("_includes/" + path)], at.byte(m.start()), at.byte(m.end()), at.line(m.start())[0]


def includes(documents: DataFrame) -> DataFrame:
    """Files that documents include, with the candidates where they may be: beside the document, at the root, in ``_includes``."""
    return child(documents, INCLUDE, include_rows)


LANG_MARK = re.compile(r"<!--\s*lang:?\s+([a-zA-Z-]+)\s*-->|<(p|div|span|section|blockquote|q|em|i)\b[^<>]*\blang\s*=\s*[\"']([a-zA-Z-]+)[\"'][^<>]*>")


def marked_regions(text: str) -> list[tuple[int, int, str]]:
    """(start, end, language) of marked languages in characters; inner marks win, equal neighbours are one region."""
    spans: list[tuple[int, int, str]] = []
    open_: tuple[int, str] | None = None
    for m in LANG_MARK.finditer(text):
        if m[1]:
            if open_:
                spans.append((open_[0], m.start(), open_[1]))
            open_ = None if m[1].lower() == "end" else (m.end(), m[1].lower().split("-")[0])
        else:
            depth, end = 1, len(text)
            for t in re.compile(rf"<(/?){m[2]}\b[^<>]*>").finditer(text, m.end()):
                depth += -1 if t[1] else 1
                if not depth:
                    end = t.start()
                    break
            spans.append((m.end(), end, m[3].lower().split("-")[0]))
    if open_:
        spans.append((open_[0], len(text), open_[1]))
    # the innermost mark over every stretch between two ends, by one walk with the open marks
    events = sorted([(a, 1, -b, i) for i, (a, b, _) in enumerate(spans)] + [(b, 0, a, i) for i, (a, b, _) in enumerate(spans)])
    flat: list[list] = []
    active: set[int] = set()
    at = 0
    for place, opens, _, i in events:
        if active and place > at:
            lang = spans[min(active, key=lambda k: (spans[k][1] - spans[k][0], k))][2]
            if flat and flat[-1][1] == at and flat[-1][2] == lang:
                flat[-1][1] = place
            else:
                flat.append([at, place, lang])
        (active.add if opens else active.discard)(i)
        at = place
    return [tuple(x) for x in flat]


def regions(documents: DataFrame) -> DataFrame:
    """(doc_id, b_start, b_end, lang): marked languages."""

    def rows(c, at):
        for a, b, lang in marked_regions(c.text):
            yield at.byte(a), at.byte(b), lang

    return child(documents, "b_start long, b_end long, lang string", rows)


WORD = "word string, lang string, b_start long, b_end long, line int, col int"


def spell_words(documents: DataFrame, vocabulary: tuple[str, ...] = (), detect: bool = False) -> DataFrame:
    """Words of the prose that a speller has to know, with the language they are in; a column ``language`` is minded."""
    from .spelling import spell_words as own

    def rows(c, at):
        for a, b, word, lang in own(c, vocabulary, detect):
            line, col = at.line(a)
            yield word, lang, at.byte(a), at.byte(b), line, col

    return child(documents, WORD, rows)


def line_flags(documents: DataFrame) -> DataFrame:
    """Every line with its block quote depth, and whether it is code, front matter, HTML or a table."""

    def rows(c, at):
        for i, x in enumerate(c.doc.lines):
            yield i + 1, at.byte(x.start), at.byte(x.end), x.depth, x.code, x.front, x.html, x.table, x.blank

    return child(documents, "line int, b_start long, b_end long, depth int, code boolean, front boolean, html boolean, is_table boolean, blank boolean", rows)


#: What a speller of any language skips whole: addresses, mail, key chords, names with inner marks, paths.
NATIVE_SKIP = re.compile(r"\S*://\S+|www\.\S+|\S+@\S+\.\S+|(?<!\S)(?:\w{1,6}\+)+\w{1,6}(?!\S)|\w+(?:_+\w+)+|\w+(?:::\w+)+|(?<!\w)/(?:[\w.-]+/?)+|\w+(?:/\w+)*/\w*[._\d]\w*")
NATIVE_WORD = re.compile(r"[^\W_]+(?:[-'’:./][^\W_]+)*")


def native_tokens(documents: DataFrame) -> DataFrame:
    """Words as a speller of any language takes them: joined by hyphens, apostrophes, colons (``EU:n``) and points; identifiers and numbers are none, ``and/or`` is two."""
    from .text import segments as own

    def rows(c, at):
        for i, s in enumerate(own(c)):
            text = NATIVE_SKIP.sub(lambda m: " " * len(m[0]), s.text)
            for m in NATIVE_WORD.finditer(text):
                for part in re.finditer(r"[^/]+", m[0]):
                    if any(x.isalpha() for x in part[0]):
                        a = s.start + m.start() + part.start()
                        yield i + 1, part[0], at.byte(a), at.byte(a + len(part[0]))

    return child(documents, "seg_id int, word string, b_start long, b_end long", rows)
