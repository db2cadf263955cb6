"""All that the plan over a corpus needs of a document, from one parse: findings, links, anchors, includes, words, directives.

The map gives rows of one table whose column ``fact`` says what a row is; readers take the rows and columns of their kind. The words of a
document are one row with an array, which readers explode.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tables
from .lint import ARROW, FINDING, Positions, resolved_levels, row, ship, spread
from .registry import Context

EXTRA = "dest string, target string, fragment string, is_image boolean, names array<string>, kept array<string>, words array<struct<word:string,lang:string,b_start:long,b_end:long,line:int,col:int>>"
FACT = f"fact string, {FINDING}, {EXTRA}"
FACT_ARROW = pa.schema([
    ("fact", pa.string()), *ARROW, ("dest", pa.string()), ("target", pa.string()), ("fragment", pa.string()), ("is_image", pa.bool_()), ("names", pa.list_(pa.string())), ("kept", pa.list_(pa.string())),
    ("words", pa.list_(pa.struct([("word", pa.string()), ("lang", pa.string()), ("b_start", pa.int64()), ("b_end", pa.int64()), ("line", pa.int32()), ("col", pa.int32())]))),
])


def facts_of(c: Context, at: Positions, vocabulary: tuple[str, ...], detect: bool, words: bool) -> Iterator[dict]:
    """Rows of one document besides its findings."""
    from .settle import directives
    from .spelling import spell_words

    if c.kind == "markdown":
        for _, _, image, dest, _, target, fragment, a, b, line in tables.link_rows(c, at):
            yield {"fact": "link", "is_image": image, "dest": dest, "target": target, "fragment": fragment, "b_start": a, "b_end": b, "line": line}
        for (anchor,) in set(tables.anchor_rows(c, at)):
            yield {"fact": "anchor", "text": anchor}
        for file, candidates, a, b, line in tables.include_rows(c, at):
            yield {"fact": "include", "text": file, "names": candidates, "b_start": a, "b_end": b, "line": line}
    for o in directives(c)[0]:
        yield {"fact": "off", "b_start": at.byte(o.start), "b_end": at.byte(o.end), "names": list(o.rules), "kept": list(o.kept)}
    if words:  # one row for all of them: a row each would cost more than to find them
        own = []
        for a, b, word, lang in spell_words(c, vocabulary, detect):
            line, col = at.line(a)
            own.append((word, lang, at.byte(a), at.byte(b), line, col))
        yield {"fact": "words", "words": own}


def facts(documents: DataFrame, options: dict, vocabulary: tuple[str, ...] = (), words: bool = True) -> DataFrame:
    """Facts of ``documents(doc_id, path, kind, code_lang, text, language, levels)``; where a column ``known`` is true the rules are not run."""
    ship(documents.sparkSession)
    detect = bool(options.get("detect_language", False))

    def made(batches):
        from inkwell.operators import all_rules
        from inkwell.operators.settle import checked

        defaults = {n: r.severity for n, r in all_rules().items()}
        by_levels: dict[tuple, dict[str, int]] = {}
        for batch in batches:
            out: list[dict] = []
            for doc_id, path, kind, lang, text, language, levels, known in zip(*(batch.column(i).to_pylist() for i in range(8)), strict=True):
                if text is None:
                    continue
                key = tuple(sorted(levels or ()))
                if key not in by_levels:
                    by_levels[key] = resolved_levels(defaults, dict(key))
                now = by_levels[key]
                c, at = Context(text, path or "", kind or "markdown", lang or "", options if language is None else {**options, "language": language}), Positions(text)
                if not known:
                    out += [{"fact": "finding", **row(doc_id, path, text, at, name, now[name], f)} for name, f in checked(list(now), c, detect=detect)]
                out += [{**x, "doc_id": doc_id, "path": path} for x in facts_of(c, at, vocabulary, detect, words)]
            yield pa.RecordBatch.from_pylist(out, schema=FACT_ARROW)

    known = documents["known"] if "known" in documents.columns else F.lit(False)
    chosen = documents.select(documents["doc_id"].cast("long"), "path", "kind", "code_lang", "text", "language", "levels", known.alias("known"))
    return spread(chosen, True).mapInArrow(made, FACT)
