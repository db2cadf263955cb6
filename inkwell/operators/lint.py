"""The file-local rules as one map over documents: no shuffle, whole texts, one parse for all rules.

Findings have byte offsets and 1-based line and column. Rules that are off are not run at all.
"""

from __future__ import annotations

from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import ship

FINDING = (
    "doc_id long, path string, rule string, severity int, b_start long, b_end long, line int, col int, end_line int, end_col int, "
    "text string, message string, suggestions array<string>, fix struct<s:long,e:long,replacement:string>"
)
ARROW = pa.schema([
    ("doc_id", pa.int64()), ("path", pa.string()), ("rule", pa.string()), ("severity", pa.int32()), ("b_start", pa.int64()), ("b_end", pa.int64()), ("line", pa.int32()), ("col", pa.int32()), ("end_line", pa.int32()), ("end_col", pa.int32()),
    ("text", pa.string()), ("message", pa.string()), ("suggestions", pa.list_(pa.string())), ("fix", pa.struct([("s", pa.int64()), ("e", pa.int64()), ("replacement", pa.string())])),
])
#: Longest text that a finding shows.
SNIPPET = 200


class Positions:
    """Bytes, lines and columns of character offsets in a text."""

    def __init__(self, text: str):
        self.text = text
        self.starts = [0]
        at = text.find("\n")
        while at >= 0:
            self.starts.append(at + 1)
            at = text.find("\n", at + 1)
        self.ascii = text.isascii()
        self.bytes = [0]
        if not self.ascii:
            for a, b in zip(self.starts, self.starts[1:]):
                self.bytes.append(self.bytes[-1] + len(text[a:b].encode()))

    def byte(self, at: int) -> int:
        if self.ascii:
            return at
        i = bisect_right(self.starts, at) - 1
        return self.bytes[i] + len(self.text[self.starts[i] : at].encode())

    def line(self, at: int) -> tuple[int, int]:
        i = bisect_right(self.starts, at)
        return i, at - self.starts[i - 1] + 1


def snippet(text: str) -> str:
    return text if len(text) <= SNIPPET else text[:SNIPPET] + "…"


def row(doc_id, path, text: str, where: Positions, name: str, severity: int, f) -> dict:
    line, col = where.line(f.start)
    end_line, end_col = where.line(f.end)
    fix = None
    if f.fix is not None:
        a, b = f.start if f.fix_start is None else f.fix_start, f.end if f.fix_end is None else f.fix_end
        fix = {"s": where.byte(a), "e": where.byte(b), "replacement": f.fix}
    return {
        "doc_id": doc_id, "path": path, "rule": name, "severity": severity if f.severity is None else min(severity, f.severity), "b_start": where.byte(f.start), "b_end": where.byte(f.end),
        "line": line, "col": col, "end_line": end_line, "end_col": end_col, "text": snippet(text[f.start : f.end]), "message": f.message, "suggestions": list(f.suggestions), "fix": fix,
    }


LEVELS = {"off": None, "info": 0, "warn": 1, "warning": 1, "error": 2}


def resolved_levels(defaults: dict[str, int | None], levels: dict[str, str]) -> dict[str, int]:
    """Severity of every rule that is on under ``levels`` (pattern -> level): the rule's id, else the longest glob that matches, else its default.

    A glob cannot switch on a rule that is off by default.
    """
    from .settle import matches

    out = {}
    for name, default in defaults.items():
        globs = sorted((p for p in levels if "*" in p and matches(p, name)), key=len)
        level = LEVELS[levels[name]] if name in levels else LEVELS[levels[globs[-1]]] if globs and default is not None else default
        if level is not None:
            out[name] = level
    return out


def lint(documents: DataFrame, rules: list[str] | None = None, config: dict | None = None, levels: dict[str, int] | None = None, settle: bool = False) -> DataFrame:
    """Findings of ``documents(doc_id, path, kind, code_lang, text)``; without ``rules`` all that are on by default.

    Where there is a column ``language``, it chooses the grammar of each document; a column ``levels`` (pattern -> level) its rules.
    With ``settle``, directives, marked regions and foreign stretches are minded and nothing is reported twice (``settle.py``);
    the option ``detect_language`` then finds the language of documents that do not look English.
    """
    from . import all_rules

    known = all_rules()
    names = [n for n, r in known.items() if r.severity is not None] if rules is None else list(rules)
    level = {n: (levels or {}).get(n, known[n].severity if known[n].severity is not None else 1) for n in names}
    ship(documents.sparkSession)
    options = dict(config or {})

    def made(batches):
        from inkwell.operators import all_rules
        from inkwell.operators.registry import Context, run
        from inkwell.operators.settle import checked

        defaults = {n: r.severity for n, r in all_rules().items()}
        by_levels: dict[tuple, dict[str, int]] = {}
        for batch in batches:
            out = []
            for doc_id, path, kind, lang, text, language, own_levels in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True):
                if text is None:
                    continue
                now = level
                if own_levels:
                    key = tuple(sorted(own_levels))
                    if key not in by_levels:
                        by_levels[key] = resolved_levels(defaults if rules is None else {n: defaults[n] for n in names}, dict(key))
                    now = by_levels[key]
                own = options if language is None else {**options, "language": language}
                context, where = Context(text, path or "", kind or "markdown", lang or "", own), None
                for name, f in checked(list(now), context, detect=options.get("detect_language", False)) if settle else run(list(now), context):
                    where = where or Positions(text)
                    out.append(row(doc_id, path, text, where, name, now[name], f))
            yield pa.RecordBatch.from_pylist(out, schema=ARROW)

    optional = [documents[c].alias(c) if c in documents.columns else F.lit(None).cast(t).alias(c) for c, t in (("language", "string"), ("levels", "map<string,string>"))]
    chosen = documents.select(documents["doc_id"].cast("long"), "path", "kind", "code_lang", "text", *optional)
    return spread(chosen, len(names) > 8).mapInArrow(made, FINDING)


def spread(texts: DataFrame, costly: bool) -> DataFrame:
    """Dealt out over the cluster where one large split would keep one core busy: rules cost far more than moving the texts."""
    cores = texts.sparkSession.sparkContext.defaultParallelism
    return texts.repartition(4 * cores) if costly and texts.rdd.getNumPartitions() < 2 * cores else texts
