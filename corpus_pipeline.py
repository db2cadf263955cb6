"""A corpus from documents to a training mix: five stages, each written and read again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from inkwell.llm import decontaminate, lines, mixing, near, quality
from inkwell.llm.frames import table, written


def hidden(docs: DataFrame, *columns: str) -> DataFrame:
    """The named columns and, in one column, all others: whatever their names, they meet no operator."""
    rest = F.struct(F.lit(0).alias("__"), *[docs[c] for c in docs.columns if c not in columns])
    return docs.select(*[docs[c] for c in columns], rest.alias("__rest"))


def shown(out: DataFrame, docs: DataFrame, columns: tuple[str, ...], **new: Column) -> DataFrame:
    """The columns of ``docs`` again, some of them new."""
    return out.select(*[new.get(c, F.col(c if c in columns else f"__rest.`{c}`")).alias(c) for c in docs.columns])


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects (score under 0.3) go."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return shown(quality.with_score(hidden(docs, "text"), model).where("score >= 0.3"), docs, ("text",))


def cut_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated cross-site lines are cut out; a document that had text and has none left goes."""
    used = ("doc_id", "text", "source")
    out = lines.with_lines(hidden(docs, *used))
    blank = (F.size("lines_removed") > 0) & (F.trim("kept_text") == "")
    kept = out.where(~F.coalesce(blank, F.lit(False)))
    return shown(kept, docs, used, text=F.col("kept_text"), n_chars=F.length(F.coalesce("kept_text", F.lit(""))).cast("long"))


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the document with the smallest id stays, once.

    Of rows with one id the one with the smallest hash of its text, then of the row, stays; rows without an id all stay.
    """
    classes = near.classes(docs.select("doc_id", "text"))
    gone = written(classes.where("component_id <> doc_id").select("doc_id").distinct(), "near-gone", True)
    kept = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    # ids that occur more than once are few; only their rows are dealt by id
    several = written(docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id"), "near-several", True)
    again = kept.join(several, "doc_id", "left_semi").select(*docs.columns)
    order = F.struct(F.xxhash64("text"), F.xxhash64(*[F.col(f"`{f.name}`") for f in docs.schema if not isinstance(f.dataType, MapType)]))
    one = again.groupBy(F.col("doc_id").alias("__id")).agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in docs.columns]), order).alias("__row"))
    return kept.join(several, "doc_id", "left_anti").select(*docs.columns).unionByName(one.select("__row.*"))


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap a benchmark item go."""
    out = decontaminate.with_overlaps(hidden(docs, "text"), table(spark, sf_dir, "benchmark"))
    return shown(out.where(F.size("overlaps") == 0), docs, ("text",))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents replicated to the target weights of their sources, in global random order."""
    return mixing.mixed(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", keep_quality),
    ("lines", cut_lines),
    ("near", keep_one),
    ("decontaminate", drop_benchmark),
    ("mix", mix_sources),
]

#: The first stage fits a model, which SQL cannot express; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
