"""Line dedup by distinct-site spread (DataFrame operations only).

A line's spread is the number of distinct sites (``source``) it stands on. Every line hash gets a HyperLogLog sketch
of its sites; sketches merge by partial aggregation. A line whose estimate is well over ``min_sites`` is boilerplate,
one well under is not; lines near the threshold get an exact distinct count. Of a boilerplate line the first
occurrence (smallest doc_id, then position, then text hash) stays and all others go, so that no content is lost from
the corpus. Texts are cut into lines once; what follows works on a table of hashes and places.

Lines are separated by ``\\n``; a line is compared with blanks at its ends cut. Lines under ``min_chars`` characters
are never removed. A line's identity is a pair of 64-bit hashes with different seeds.

Defined results: a null or empty text has no lines and comes back as it is; a null source is a site of its own;
repeated lines in a document count once for spread and are removed like others. A row is known by its id and a hash
of its text: rows of one id with different texts are judged each by its own lines, rows that are the same in both get
the same result. A null id is smaller than any other. Columns of the input are kept, but for those with the names of
the two new ones, which are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import written


@dataclass(frozen=True)
class Settings:
    """``log_k``: each sketch has 2**log_k registers; ``margin``: relative errors around the threshold counted exactly."""

    min_sites: int = 5
    min_chars: int = 12
    log_k: int = 9
    margin: float = 5.0


def split_lines(text: Column) -> Column:
    return F.when(F.length(text) > 0, F.split(text, "\n", -1)).otherwise(F.array().cast("array<string>"))


def occurrences(documents: DataFrame, settings: Settings) -> DataFrame:
    """(h1, h2, doc, mark, site, pos) of every line that is long enough; ``mark`` is the hash of the text."""
    site = F.when(documents["source"].isNull(), F.lit(0)).otherwise(F.xxhash64(documents["source"]))
    lines = documents.select(documents["doc_id"].alias("doc"), F.xxhash64(documents["text"]).alias("mark"), site.alias("site"), F.posexplode(split_lines(documents["text"])).alias("pos", "raw"))
    lines = lines.select("doc", "mark", "site", "pos", F.trim("raw").alias("line")).where(F.length("line") >= settings.min_chars)
    return lines.select(F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(977), "line").alias("h2"), "doc", "mark", "site", "pos")


def boilerplate(found: DataFrame, settings: Settings) -> DataFrame:
    """(h1, h2, first) of the lines on at least ``min_sites`` sites; ``first`` is the place that stays."""
    spread = found.groupBy("h1", "h2").agg(F.hll_sketch_agg("site", F.lit(settings.log_k)).alias("sketch"), F.count(F.lit(1)).alias("lines"), F.min(F.struct("doc", "pos", "mark")).alias("first"))
    spread = spread.where(F.col("lines") >= settings.min_sites)
    sized = spread.select("h1", "h2", "first", F.hll_sketch_estimate("sketch").alias("sites"))
    error = settings.margin * 1.04 / (2 ** (settings.log_k / 2))
    near = (F.col("sites") >= F.lit(settings.min_sites * (1 - error) - 1)) & (F.col("sites") <= F.lit(settings.min_sites * (1 + error) + 1))
    sized = written(sized.where(F.col("sites") >= F.lit(settings.min_sites * (1 - error) - 1)).withColumn("near", near), "line-spread", True)
    checked = found.join(sized.where("near").select("h1", "h2"), ["h1", "h2"], "left_semi")
    exact = checked.select("h1", "h2", "site").distinct().groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("exact"))
    kept = sized.join(exact, ["h1", "h2"], "left").where(F.coalesce("exact", "sites") >= settings.min_sites)
    return kept.select("h1", "h2", "first")


def without(text: Column, removed: Column) -> Column:
    """The lines of ``text`` but those at the ascending positions ``removed``: the stretches between them, in time in proportion to the lines."""

    def joined(s: Column) -> Column:
        lines, gone = s["lines"], s["gone"]
        start = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get(gone, i - 1) + 1)
        end = lambda i: F.coalesce(F.get(gone, i), F.size(lines))
        kept = F.transform(F.sequence(F.lit(0), F.size(gone)), lambda i: F.slice(lines, start(i) + 1, end(i) - start(i)))
        return F.array_join(F.flatten(kept), "\n")

    # bound once by the array of one struct, and not evaluated anew for each stretch
    return F.transform(F.array(F.struct(F.split(text, "\n", -1).alias("lines"), removed.alias("gone"))), joined)[0]


def with_lines(documents: DataFrame, settings: Settings = Settings(), names: tuple[str, str] = ("lines_removed", "kept_text")) -> DataFrame:
    """``documents`` plus, under ``names``, the removed positions (ascending) and the text that is left."""
    found = written(occurrences(documents, settings), "line-places")
    common = written(boilerplate(found, settings), "line-boilerplate", True)
    first = F.col("first")
    stays = F.col("doc").eqNullSafe(first["doc"]) & (F.col("pos") == first["pos"]) & (F.col("mark") == first["mark"])
    gone = found.join(common, ["h1", "h2"]).where(~stays).groupBy("doc", "mark").agg(F.sort_array(F.collect_set("pos")).alias("gone"))
    own = [c for c in documents.columns if c not in names and c != "text"]
    row = documents.select(F.struct(F.lit(1).alias("__"), *[documents[c] for c in own]).alias("row"), documents["text"].alias("body"), documents["doc_id"].alias("__doc"), F.xxhash64(documents["text"]).alias("__mark"))
    joined = row.join(gone, F.col("__doc").eqNullSafe(F.col("doc")) & (F.col("__mark") == F.col("mark")), "left").select("row", "body", F.coalesce("gone", F.array().cast("array<int>")).alias("gone"))
    kept = F.when(F.size("gone") == 0, F.col("body")).otherwise(without(F.col("body"), F.col("gone")))
    column = {"text": F.col("body")}
    return joined.select(*[column.get(c, F.col(f"row.`{c}`")).alias(c) for c in documents.columns if c not in names], F.col("gone").alias(names[0]), kept.alias(names[1]))
