"""Gettext catalogs: parser, plural expressions, placeholders, and the rules ``gettext/...``."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

from .registry import ERROR, INFO, OFF, WARNING, Context, Finding, rule

KIND = ("gettext",)
ESCAPES = {"n": "\n", "t": "\t", "r": "\r", '"': '"', "\\": "\\", "a": "\a", "b": "\b", "f": "\f", "v": "\v"}


@dataclass
class Text:
    """A string of an entry: its value and where its pieces stand."""

    value: str
    start: int
    end: int


@dataclass
class Entry:
    start: int
    end: int = 0
    ctxt: Text | None = None
    id: Text | None = None
    plural: Text | None = None
    strs: dict[int, Text] = field(default_factory=dict)
    flags: set[str] = field(default_factory=set)
    comments: list[str] = field(default_factory=list)
    obsolete: bool = False

    @property
    def translated(self) -> bool:
        return any(t.value for t in self.strs.values())

    @property
    def fuzzy(self) -> bool:
        return "fuzzy" in self.flags


@dataclass
class Catalog:
    entries: list[Entry] = field(default_factory=list)
    errors: list[tuple[int, int, str]] = field(default_factory=list)
    header: Entry | None = None
    fields: dict[str, str] = field(default_factory=dict)


def unescaped(body: str) -> tuple[str, int | None]:
    """Value of a quoted piece and the offset of its first bad escape."""
    out, i, bad = [], 0, None
    while i < len(body):
        if body[i] != "\\":
            out.append(body[i])
            i += 1
            continue
        m = re.compile(r"\\(?:([0-7]{1,3})|x([0-9A-Fa-f]{1,2})|(.))?").match(body, i)
        if m[1]:
            out.append(chr(int(m[1], 8)))
        elif m[2]:
            out.append(chr(int(m[2], 16)))
        elif m[3] in ESCAPES:
            out.append(ESCAPES[m[3]])
        else:
            bad = i if bad is None else bad
        i = m.end()
    return "".join(out), bad


def parse(text: str) -> Catalog:
    catalog, at = Catalog(), 0
    entry: Entry | None = None
    current: Text | None = None

    def close(end: int) -> None:
        nonlocal entry, current
        if entry is not None and (entry.id or entry.strs or entry.ctxt):
            entry.end = end
            if entry.id is None:
                catalog.errors.append((entry.start, end, "entry without msgid"))
            elif not entry.strs:
                catalog.errors.append((entry.start, end, "entry without msgstr"))
            elif sorted(entry.strs) != list(range(len(entry.strs))):
                catalog.errors.append((entry.start, end, "gap in the plural indexes"))
            catalog.entries.append(entry)
        entry = current = None

    last = 0
    for raw in text.split("\n"):
        start, line = at, raw.rstrip("\r")
        at += len(raw) + 1
        own = line.strip()
        obsolete = own.startswith("#~") and not own.startswith("#~|")
        if obsolete:
            shift = line.index("#~") + 2
            own = line[shift:].strip()
        lead = line.find(own) if own else 0
        if not own:
            if not obsolete:
                close(last)
            continue
        if own.startswith("#"):
            if entry is not None and entry.strs:
                close(last)
            elif entry is not None and entry.id and not own.startswith("#|"):
                catalog.errors.append((start + lead, start + lead + len(own), "comment inside an entry"))
            entry = entry or Entry(start)
            if own.startswith("#,"):
                entry.flags |= {x.strip() for x in own[2:].split(",")}
            elif not own.startswith(("#:", "#|")):
                entry.comments.append(own[1:].lstrip(". "))
            last = start + len(line)
            continue
        m = re.match(r"(msgctxt|msgid_plural|msgid|msgstr(?:\[(\d+)\])?)\s*(?=\")", own)
        body = own[m.end() :] if m else own
        where = start + lead + (m.end() if m else 0)
        piece = re.fullmatch(r'"((?:\\.|[^"\\])*)"', body)
        if not m and not own.startswith('"'):
            catalog.errors.append((start + lead, start + lead + len(own), "unexpected text"))
            continue
        if not piece:
            catalog.errors.append((where, start + lead + len(own), "string is not terminated" if not re.match(r'"(?:\\.|[^"\\])*"', body) else "text after a string"))
            value = re.match(r'"?((?:\\.|[^"\\])*)', body)[1]
        else:
            value = piece[1]
        plain, bad = unescaped(value)
        if bad is not None:
            catalog.errors.append((where + 1 + bad, where + 3 + bad, "unknown escape"))
        if not m:
            if current is None:
                catalog.errors.append((start + lead, start + lead + len(own), "string without a keyword"))
            else:
                current.value += plain
                current.end = start + lead + len(own)
            last = start + len(line)
            continue
        word = m[1].split("[")[0]
        if word in ("msgctxt", "msgid") and entry is not None and entry.strs:
            close(last)
        entry = entry or Entry(start)
        entry.obsolete |= obsolete
        current = Text(plain, where, start + lead + len(own))
        if word == "msgctxt":
            entry.ctxt = current
        elif word == "msgid":
            if entry.id is not None:
                catalog.errors.append((start + lead, start + lead + len(own), "second msgid"))
            entry.id = current
        elif word == "msgid_plural":
            entry.plural = current
            if entry.id is None:
                catalog.errors.append((start + lead, start + lead + len(own), "msgid_plural before msgid"))
        else:
            entry.strs[int(m[2] or 0)] = current
        last = start + len(line)
    close(last)
    live = [e for e in catalog.entries if not e.obsolete]
    if live and live[0].id and live[0].id.value == "" and live[0].ctxt is None:
        catalog.header = live[0]
        head = live[0].strs.get(0)
        for x in (head.value if head else "").split("\n"):
            if ":" in x:
                k, v = x.split(":", 1)
                catalog.fields[k.strip()] = v.strip()
    return catalog


# plural expressions

_TOKEN = re.compile(r"\s*(\d+|n|&&|\|\||[<>=!]=|[-+*/%<>!?:()])")


def plural_function(text: str):
    """(number of forms, function of n) of a Plural-Forms field, or None when it does not parse."""
    m = re.match(r"\s*nplurals\s*=\s*(\d+)\s*;\s*plural\s*=\s*([^;]+);?\s*$", text)
    if not m:
        return None
    tokens, at = [], 0
    while at < len(m[2].rstrip()):
        t = _TOKEN.match(m[2], at)
        if not t:
            return None
        tokens.append(t[1])
        at = t.end()
    place = 0
    levels = (("||",), ("&&",), ("==", "!="), ("<", ">", "<=", ">="), ("+", "-"), ("*", "/", "%"))

    def peek():
        return tokens[place] if place < len(tokens) else ""

    def take(want=None):
        nonlocal place
        if place >= len(tokens) or want is not None and tokens[place] != want:
            raise ValueError
        place += 1
        return tokens[place - 1]

    def ternary():
        test = binary(0)
        if peek() != "?":
            return test
        take()
        yes = ternary()
        take(":")
        no = ternary()
        return lambda n: yes(n) if test(n) else no(n)

    def binary(level):
        if level == len(levels):
            return unary()
        left = binary(level + 1)
        while peek() in levels[level]:
            left = joined(take(), left, binary(level + 1))
        return left

    def joined(op, a, b):
        return {
            "||": lambda n: int(bool(a(n) or b(n))), "&&": lambda n: int(bool(a(n) and b(n))), "==": lambda n: int(a(n) == b(n)), "!=": lambda n: int(a(n) != b(n)), "<": lambda n: int(a(n) < b(n)), ">": lambda n: int(a(n) > b(n)),
            "<=": lambda n: int(a(n) <= b(n)), ">=": lambda n: int(a(n) >= b(n)), "+": lambda n: a(n) + b(n), "-": lambda n: a(n) - b(n), "*": lambda n: a(n) * b(n), "/": lambda n: a(n) // b(n), "%": lambda n: a(n) % b(n),
        }[op]

    def unary():
        if peek() == "!":
            take()
            own = unary()
            return lambda n: int(not own(n))
        if peek() == "(":
            take()
            own = ternary()
            take(")")
            return own
        t = take()
        if t == "n":
            return lambda n: n
        if not t.isdigit():
            raise ValueError
        return lambda n, v=int(t): v

    try:
        out = ternary()
        return (int(m[1]), out) if place == len(tokens) else None
    except ValueError:
        return None


def plural_fault(text: str) -> str | None:
    found = plural_function(text)
    if found is None:
        return "Plural-Forms does not parse"
    for n in range(1001):
        try:
            form = found[1](n)
        except ZeroDivisionError:
            return f"Plural-Forms divides by zero for n = {n}"
        if not 0 <= form < found[0]:
            return f"Plural-Forms gives form {form} of {found[0]} for n = {n}"
    return None


# placeholders

STYLES = {
    "c": re.compile(r"%(?:(\d+)\$)?[-+ #0]*(?:\d+|\*)?(?:\.(?:\d+|\*))?(?:hh|h|ll|l|q|j|z|t|L)?([diouxXeEfFgGaAcspn])|%%"),
    "python": re.compile(r"%\((\w+)\)[-+ #0]*\d*(?:\.\d+)?([diouxXeEfFgGcrsa])|%%"),
    "brace": re.compile(r"\{(\w*)(?:[!:][^{}]*)?\}|\{\{|\}\}"),
    "ruby": re.compile(r"%\{(\w+)\}|%<(\w+)>"),
    "qt": re.compile(r"%L?(\d{1,2}|n)(?!\w)"),
}
CLASSES = {**dict.fromkeys("di", "d"), **dict.fromkeys("ouxX", "u"), **dict.fromkeys("eEfFgGaA", "f")}
FLAGS = {"c-format": "c", "php-format": "c", "python-format": "c python", "python-brace-format": "brace", "perl-brace-format": "brace", "ruby-format": "c ruby", "qt-format": "qt", "icu-format": "brace"}


def styles_of(entry: Entry) -> set[str]:
    flagged = {s for f in entry.flags for s in FLAGS.get(f, "").split()}
    if flagged:
        return flagged
    source = entry.id.value + (entry.plural.value if entry.plural else "")
    found = {s for s in ("python", "brace", "ruby") if any(m[0] not in ("%%", "{{", "}}") for m in STYLES[s].finditer(source))}
    if not found and re.search(r"%(?:\d+\$)?[-+0]*\d*(?:\.\d+)?l{0,2}[diusfxc](?![a-z])", source):
        found = {"c"}
    return {s for s in found if not any(s in FLAGS.get(f[3:], "").split() for f in entry.flags if f.startswith("no-"))}


def placeholders(text: str, styles: set[str]) -> Counter:
    out: Counter = Counter()
    for style in sorted(styles):
        count = 0
        for m in STYLES[style].finditer(text):
            if m[0] in ("%%", "{{", "}}"):
                continue
            if style == "c":
                count += 1
                out[f"%{m[1] or count}${CLASSES.get(m[2], m[2])}"] += 1
            elif style == "brace":
                name = m[1]
                if not name:
                    name, count = str(count), count + 1
                out["{" + name + "}"] += 1
            else:
                out[m[0] if style != "python" else f"%({m[1]}){CLASSES.get(m[2], m[2])}"] += 1
    return out


COUNTERS = re.compile(r"(?:count|n|num|number|quantity|amount|total|cnt)")


def is_count(name: str, entry: Entry, source: Counter) -> bool:
    inner = re.sub(r"^%\(|\)\w$|[%{}<>]", "", name)
    only = [k for k in source if re.fullmatch(r"%\d+\$[du]", k)]
    return bool(COUNTERS.fullmatch(inner)) or only == [name]


def live(c: Context) -> list[Entry]:
    catalog = catalog_of(c)
    return [e for e in catalog.entries if not e.obsolete and e is not catalog.header and e.id is not None]


def catalog_of(c: Context) -> Catalog:
    if "catalog" not in c.cache:
        c.cache["catalog"] = parse(c.text)
    return c.cache["catalog"]


def pairs(c: Context):
    """(entry, source text, translation) of every translated string that is not fuzzy."""
    for e in live(c):
        if not e.fuzzy:
            for i, t in e.strs.items():
                if t.value:
                    yield e, (e.plural.value if i and e.plural else e.id.value), t


@rule("gettext/syntax", ERROR, KIND)
def syntax(c: Context):
    for a, b, why in catalog_of(c).errors:
        yield Finding(a, b, why)


@rule("gettext/duplicate", ERROR, KIND)
def duplicate(c: Context):
    seen = set()
    for e in catalog_of(c).entries:
        if e.id and not e.obsolete:
            key = (e.ctxt.value if e.ctxt else None, e.id.value)
            if key in seen:
                yield Finding(e.id.start, e.id.end, "message is defined again")
            seen.add(key)


@rule("gettext/header", ERROR, KIND)
def header(c: Context):
    catalog = catalog_of(c)
    if not catalog.entries:
        return
    head = catalog.header
    if head is None:
        first = catalog.entries[0]
        yield Finding(first.start, first.start + len(c.text[first.start :].split("\n", 1)[0]), "catalog has no header")
        return
    where = head.strs[0] if 0 in head.strs else head.id
    template = c.path.endswith(".pot")
    for name in ("Content-Type", "Language", "Plural-Forms") if not template else ("Content-Type",):
        if not catalog.fields.get(name) and (name != "Plural-Forms" or any(e.plural for e in live(c))):
            yield Finding(where.start, where.end, f"header lacks {name}")
    charset = re.search(r"charset=(\S+)", catalog.fields.get("Content-Type", ""))
    if charset and charset[1].upper() not in ("UTF-8", "UTF8", "US-ASCII", "ASCII", "CHARSET"):
        yield Finding(where.start, where.end, f"charset is {charset[1]}", severity=WARNING)
    if catalog.fields.get("Plural-Forms") and not template and (why := plural_fault(catalog.fields["Plural-Forms"])):
        yield Finding(where.start, where.end, why)
    named = re.search(r"(?:^|/)([a-z]{2,3})(?:[_-][A-Za-z]+)?(?:/LC_MESSAGES/[^/]*)?(?:\.po)?$", c.path)
    language = catalog.fields.get("Language", "")
    if language and named and not template and re.split("[_-]", language)[0] != named[1]:
        yield Finding(where.start, where.end, f"Language is {language}, the path says {named[1]}", severity=WARNING)


@rule("gettext/plural-count", ERROR, KIND)
def plural_count(c: Context):
    found = plural_function(catalog_of(c).fields.get("Plural-Forms", ""))
    for e in live(c):
        if found and e.plural and e.translated and len(e.strs) != found[0]:
            yield Finding(e.strs[min(e.strs)].start, e.strs[max(e.strs)].end, f"{len(e.strs)} plural forms, the header says {found[0]}")


@rule("gettext/placeholders", ERROR, KIND)
def placeholder_rule(c: Context):
    for e, source, t in pairs(c):
        styles = styles_of(e)
        want, have = placeholders(source, styles), placeholders(t.value, styles)
        missing = [k for k in want if k not in have and not (e.plural and is_count(k, e, want))]
        foreign = [k for k in have if k not in want and k not in placeholders(e.id.value + " " + (e.plural.value if e.plural else ""), styles)]
        if missing or foreign:
            yield Finding(t.start, t.end, "; ".join([*(f"{k} is missing" for k in missing), *(f"{k} is not in the source" for k in foreign)]))


@rule("gettext/plural-placeholder", OFF, KIND)
def plural_placeholder(c: Context):
    for e, source, t in pairs(c):
        styles = styles_of(e)
        want, have = placeholders(source, styles), placeholders(t.value, styles)
        missing = [k for k in want if k not in have]
        if e.plural and missing and all(is_count(k, e, want) for k in missing):
            yield Finding(t.start, t.end, f"{missing[0]} is missing in a plural form")


@rule("gettext/markup", WARNING, KIND)
def markup(c: Context):
    for e, source, t in pairs(c):
        tags = lambda x: sorted(re.findall(r"</?[A-Za-z][\w-]*", x))
        other = lambda x: (len(re.findall(r"\]\([^)]*\)", x)), x.count("`") // 2)
        if tags(source) != tags(t.value) or other(source) != other(t.value):
            yield Finding(t.start, t.end, "markup differs from the source")


@rule("gettext/whitespace", WARNING, KIND)
def whitespace(c: Context):
    ends = lambda x: (x.startswith((" ", "\t")), x.startswith("\n"), x.endswith((" ", "\t")), x.endswith("\n"))
    for e, source, t in pairs(c):
        if ends(source) != ends(t.value):
            yield Finding(t.start, t.end, "white space at the ends differs from the source")


FULL_WIDTH = str.maketrans("。：！？；", ".:!?;")


def final(text: str, language: str) -> str:
    own = text.strip().translate(FULL_WIDTH)
    if own.endswith(("...", "…")):
        return "…"
    last = own[-1:] if own[-1:] in tuple(".:!?;") else ""
    return "?" if last == ";" and language.startswith("el") else last


@rule("gettext/punctuation", INFO, KIND)
def punctuation(c: Context):
    language = catalog_of(c).fields.get("Language", "")
    for e, source, t in pairs(c):
        if final(source, "en") != final(t.value, language):
            yield Finding(t.start, t.end, "final punctuation differs from the source")


@rule("gettext/accelerator", WARNING, KIND)
def accelerator(c: Context):
    for mark in "&_":
        find = re.compile(rf"{mark}(?={mark}|\w)(?:{mark})?" if mark == "&" else r"(?<!\w)_(?=[^\W_])|(?<=[^\W_])_(?=[^\W_])")
        count = lambda x: sum(m[0] == mark for m in find.finditer(re.sub(r"&\w+;", "", x)))
        if sum(count(e.id.value) == 1 for e in live(c)) >= 3:
            for e, source, t in pairs(c):
                if count(source) == 1 and count(t.value) != 1:
                    yield Finding(t.start, t.end, f"accelerator {mark} differs from the source")


@rule("gettext/untranslated", INFO, KIND)
def untranslated(c: Context):
    if c.path.endswith(".pot") or catalog_of(c).fields.get("Language", "").split("_")[0] == "en":
        return
    for e in live(c):
        for t in e.strs.values():
            if not t.value:
                yield Finding(e.id.start, e.id.end, "message is not translated")
                break


@rule("gettext/fuzzy", WARNING, KIND)
def fuzzy(c: Context):
    for e in live(c):
        if e.fuzzy:
            yield Finding(e.id.start, e.id.end, "translation is fuzzy")


@rule("gettext/obsolete", INFO, KIND)
def obsolete(c: Context):
    for e in catalog_of(c).entries:
        if e.obsolete and e.id:
            yield Finding(e.id.start, e.id.end, "entry is obsolete")


@rule("gettext/same-as-source", INFO, KIND)
def same_as_source(c: Context):
    for e, source, t in pairs(c):
        own = source.split()
        if t.value == source and len(own) >= 3 and sum(x.isalpha() for x in source) >= 15 and not all(w[0].isupper() for w in own if w[0].isalpha()) and "://" not in source:
            yield Finding(t.start, t.end, "translation equals the source")
