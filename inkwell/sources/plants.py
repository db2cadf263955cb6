"""Derived corpora: a marked example for each part, so that every rule meets texts it must and must not report.

An example is a text with the places of its findings between ``⟦`` and ``⟧``. Document ``p_partkey`` of a rule's
corpus holds the rule's example number ``p_partkey % examples``; what must be found follows from the marks alone.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def unmarked(example: str) -> tuple[str, list[tuple[int, int]]]:
    """The text without marks, and the marked spans in it."""
    text, spans, open_ = [], [], []
    size = 0
    for part in re.split("([⟦⟧])", example):
        if part == "⟦":
            open_.append(size)
        elif part == "⟧":
            spans.append((open_.pop(), size))
        else:
            text.append(part)
            size += len(part)
    return "".join(text), sorted(spans)


def corpus(spark: SparkSession, sf_dir: str, examples: list[str], kind: str = "markdown", code_lang: str = "", path: str = "docs/page.md") -> DataFrame:
    """documents(doc_id, path, kind, code_lang, text) of a rule: one for each part."""
    rows = [(i, unmarked(e)[0]) for i, e in enumerate(examples)]
    plants = spark.createDataFrame(rows, "plant int, text string")
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("doc_id"), (F.col("p_partkey") % len(rows)).cast("int").alias("plant"))
    # one split of small rows becomes many texts: the ids are dealt out over the cluster before the texts are added
    parts = parts.repartition(4 * spark.sparkContext.defaultParallelism)
    # the examples of a rule are a handful, fixed in the code
    joined = parts.join(F.broadcast(plants), "plant")
    return joined.select("doc_id", F.lit(path).alias("path"), F.lit(kind).alias("kind"), F.lit(code_lang).alias("code_lang"), "text")


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def expected_sql(examples: list[str]) -> str:
    """SQL for the rows (doc_id, line, col, text) that the marks ask for."""
    rows = []
    for i, e in enumerate(examples):
        text, spans = unmarked(e)
        for a, b in spans:
            found = text[a:b] if b - a <= 200 else text[a : a + 200] + "…"
            rows.append(f"({i}, {text.count(chr(10), 0, a) + 1}, {a - (text.rfind(chr(10), 0, a) + 1) + 1}, {quoted(found)})")
    return f"SELECT p.p_partkey AS doc_id, e.line::INTEGER AS line, e.col::INTEGER AS col, e.text FROM part p JOIN (VALUES {', '.join(rows)}) AS e(plant, line, col, text) ON p.p_partkey % {len(examples)} = e.plant"
