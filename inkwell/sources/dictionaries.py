"""Dictionaries and vocabularies as tables: word lists, affix dictionaries, word lists with class bits, project vocabularies."""

from __future__ import annotations

import re
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """(word) of files with one accepted word or phrase a line; ``#`` starts a comment."""
    line = F.trim(F.regexp_replace("value", r"(?:^|\s)#.*$", ""))
    return spark.read.text(path).select(line.alias("word")).where("word <> ''").distinct()


def read_words(spark: SparkSession, path: str, lang: str) -> DataFrame:
    """(lang, word) of a plain word list."""
    return spark.read.text(path).select(F.lit(lang).alias("lang"), F.lower(F.trim("value")).alias("word")).where("word <> ''").distinct()


def read_classes(spark: SparkSession, path: str) -> DataFrame:
    """(word, class_bits) of a list with a word and its classes, tab-separated, a line."""
    parts = F.split("value", "\t")
    own = spark.read.text(path).where(F.contains("value", F.lit("\t"))).select(F.lower(F.trim(parts[0])).alias("word"), F.trim(parts[1]).cast("long").alias("class_bits"))
    return own.where("word <> '' AND class_bits IS NOT NULL").groupBy("word").agg(F.bit_or("class_bits").alias("class_bits"))


def of_classes(lexicon: DataFrame, wanted: int, without: int = 0) -> DataFrame:
    """Words with all bits of ``wanted`` and none of ``without``."""
    bits = F.col("class_bits")
    return lexicon.where((bits.bitwiseAND(F.lit(wanted)) == wanted) & (bits.bitwiseAND(F.lit(without)) == 0)).select("word")


class Affixes:
    """The affix rules of a dictionary: what a flag cuts off and adds, where a word meets its condition."""

    def __init__(self, text: str):
        self.rules: dict[str, list[tuple[str, str, str, re.Pattern, bool]]] = defaultdict(list)
        self.kind, self.no_suggest, self.forbidden, self.only_affixed = "char", "", "", ""
        crossing: dict[str, bool] = {}
        for line in text.splitlines():
            part = line.split("#")[0].split() if not line.startswith(("SFX", "PFX")) else line.split()
            if len(part) < 2:
                continue
            if part[0] == "FLAG":
                self.kind = part[1]
            elif part[0] in ("FORBIDDENWORD", "NEEDAFFIX"):
                setattr(self, "forbidden" if part[0] == "FORBIDDENWORD" else "only_affixed", part[1])
            elif part[0] in ("SFX", "PFX"):
                kind, flag = part[:2]
                if len(part) == 4 and part[3].isdigit() and flag not in crossing:
                    crossing[flag] = part[2] == "Y"
                elif len(part) >= 4:
                    cut, add = ("" if x == "0" else x for x in (part[2], part[3].split("/")[0]))
                    condition = part[4] if len(part) > 4 else "."
                    self.rules[flag].append((kind, cut, add, re.compile(f"{condition}$" if kind == "SFX" else f"^{condition}"), crossing.get(flag, False)))

    def flags(self, own: str) -> list[str]:
        if self.kind == "long":
            return [own[i : i + 2] for i in range(0, len(own), 2)]
        return own.split(",") if self.kind == "num" else list(own)

    def _applied(self, word: str, rule) -> str | None:
        kind, cut, add, condition, _ = rule
        if not condition.search(word):
            return None
        if kind == "SFX":
            return word[: len(word) - len(cut)] + add if word.endswith(cut) else None
        return add + word[len(cut) :] if word.startswith(cut) else None

    def forms(self, entry: str) -> set[str]:
        """All forms of a line ``word/FLAGS`` of the dictionary."""
        word, _, own = entry.strip().split("\t")[0].partition("/")
        flags = self.flags(own.split(" ")[0].strip())
        if not word or self.forbidden in flags and self.forbidden:
            return set()
        rules = [r for f in flags for r in self.rules.get(f, ())]
        ended = [(x, r[4]) for r in rules if r[0] == "SFX" and (x := self._applied(word, r)) is not None]
        begun = [x for r in rules if r[0] == "PFX" and (x := self._applied(word, r)) is not None]
        both = [x for w, cross in ended if cross for r in rules if r[0] == "PFX" and r[4] and (x := self._applied(w, r)) is not None]
        bare = set() if self.only_affixed and self.only_affixed in flags else {word}
        return bare | {w for w, _ in ended} | set(begun) | set(both)


def read_affix_dictionary(spark: SparkSession, dic: str, aff: str, lang: str) -> DataFrame:
    """(lang, word) of a dictionary with affix rules (``.dic`` and ``.aff``), its forms written out."""
    from ..operators.lint import ship

    ship(spark)
    # the rules of one dictionary: some thousand lines at most
    rules = "\n".join(r["value"] for r in spark.read.text(aff).collect())

    def made(batches):
        affixes = Affixes(rules)
        for batch in batches:
            words = sorted({w.lower() for line in batch.column(0).to_pylist() for w in affixes.forms(line)})
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(words), pa.string()), pa.array(words, pa.string())], names=["lang", "word"])

    lines = spark.read.text(dic).where(~F.col("value").rlike(r"^\s*(?:\d+\s*)?$") & ~F.col("value").startswith("#"))
    return lines.mapInArrow(made, "lang string, word string").distinct()
