"""Functions of the library for Spark SQL: ``register(spark)`` adds them to a session."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..operators.markdown import slug
from .words import grade, syllables


@F.pandas_udf("string")
def slugify(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else slug(t))


@F.pandas_udf("int")
def count_syllables(word: pd.Series) -> pd.Series:
    return word.map(lambda w: None if w is None else syllables(w))


@F.pandas_udf("double")
def flesch_kincaid(text: pd.Series) -> pd.Series:
    from .sentences import sentences, words

    def of(t):
        own = [] if t is None else [w[0] for w in words(t)]
        return grade(len(own), sum(1 for _ in sentences(t)), sum(map(syllables, own))) if own else None

    return text.map(of)


@F.udtf(returnType="s_id int, start int, stop int, sentence string")
class Sentences:
    """Rows of the sentences of a text."""

    def eval(self, text: str):
        from inkwell.functions.sentences import sentences

        for i, (a, b) in enumerate(sentences(text or "")):
            yield i + 1, a, b, text[a:b]


@F.udtf(returnType="kind string, start int, section int, text string")
class Segments:
    """Rows of the prose segments of a Markdown text."""

    def eval(self, text: str):
        from inkwell.operators.markdown import Document

        for s in Document(text or "").segments():
            yield s.kind, s.start, s.section, s.text


def register(spark: SparkSession) -> None:
    from ..operators.lint import ship

    ship(spark)
    for name, f in (("slugify", slugify), ("syllables", count_syllables), ("flesch_kincaid", flesch_kincaid)):
        spark.udf.register(name, f)
    spark.udtf.register("sentences_of", Sentences)
    spark.udtf.register("md_segments", Segments)
