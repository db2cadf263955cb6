"""Mixing sources to target weights by Poisson replication.

Every source has a target weight; its documents are repeated at a mean rate of ``weight * size / documents of the
source``. A document's count is the inverse of the Poisson distribution function at a uniform number made from a
hash of its id and the seed, so a rerun after a lost executor gives the same copies. Copies are numbered from 0 and
the result is ordered by a hash of id, copy and seed: a global shuffle.

Defined results: a null source is a source of its own, the key None of ``weights``; a row with a null id draws by a hash of
its text instead; repeated rows are counted and replicated alike; a source without a target weight has weight 0, and its
documents go; an empty table gives an empty table. Without ``weights`` a source weighs its number of documents to the
power ``flatten``. Input columns with the names of the three new ones are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Settings:
    """``size``: documents wanted as a multiple of those given; ``flatten`` below 1 lifts small sources."""

    weights: dict[str | None, float] = field(default_factory=dict)
    flatten: float = 0.7
    size: float = 1.0
    seed: int = 17


def uniform(seed: int, *parts: Column) -> Column:
    """A number in [0, 1) from 52 bits of md5 over the seed and the parts."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def rates(documents: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Per source: documents, weight and mean repetition rate. One row a source."""
    count = documents.groupBy(documents["source"].alias("source_key")).agg(F.count(F.lit(1)).alias("source_docs"))
    if settings.weights:
        named = [F.lit(x) for k, w in settings.weights.items() if k is not None for x in (k, float(w))]
        given = F.create_map(*named)[F.col("source_key")] if named else F.lit(None)
        weight = F.when(F.col("source_key").isNull(), F.lit(float(settings.weights.get(None, 0.0)))).otherwise(F.coalesce(given.cast("double"), F.lit(0.0)))
    else:
        weight = F.pow(F.col("source_docs").cast("double"), F.lit(settings.flatten))
    count = count.withColumn("weight", weight)
    every = count.agg(F.sum("weight").alias("all_weight"), F.sum("source_docs").alias("all_docs"))
    rate = F.when(F.col("all_weight") > 0, F.col("weight") / F.col("all_weight") * F.col("all_docs") * settings.size / F.col("source_docs")).otherwise(0.0)
    # one row of totals: a join without keys against a single row by construction
    return count.crossJoin(F.broadcast(every)).select("source_key", "source_docs", "weight", rate.alias("rate"))


def identity(doc_id: Column, text: Column) -> Column:
    """What a row's draws depend on: its id, or for a null id its text."""
    return F.coalesce(doc_id.cast("string"), F.concat(F.lit("null:"), F.md5(F.coalesce(text, F.lit("")).cast("binary"))))


#: Rates above this are drawn as sums of smaller ones, each with its own uniform number: exp(-rate) stays far from 0.
PART = 400.0
#: Tables of rates up to so many rows are broadcast.
BROADCAST_SOURCES = 50_000


def poisson(rate: Column, u: Column) -> Column:
    """Smallest k whose distribution function exceeds u, for rates up to ``PART``."""
    most = F.ceil(rate + 12 * F.sqrt(rate) + 30).cast("int")
    start = F.struct(F.exp(-rate).alias("term"), F.exp(-rate).alias("cdf"), F.lit(0).alias("k"))

    def step(s: Column, j: Column) -> Column:
        term = s["term"] * rate / j
        return F.when(u < s["cdf"], s).otherwise(F.struct(term.alias("term"), (s["cdf"] + term).alias("cdf"), j.alias("k")))

    return F.when(rate <= 0, 0).otherwise(F.aggregate(F.sequence(F.lit(1), most), start, step)["k"])


def copies(rate: Column, seed: int, doc_id: Column) -> Column:
    """Poisson count of a document at any rate."""
    parts = F.greatest(F.ceil(rate / PART).cast("int"), F.lit(1))
    return F.aggregate(F.sequence(F.lit(1), parts), F.lit(0), lambda total, part: total + poisson(rate / parts, uniform(seed, doc_id, part)))


def replicated(documents: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """A row for each copy: ``row`` (the document), ``id`` (its identity), ``rate``, ``copies`` and ``copy`` (0 to copies - 1)."""
    row = F.struct(*[documents[c] for c in documents.columns])
    own = documents.select(row.alias("row"), identity(documents["doc_id"], documents["text"]).alias("id"), documents["source"].alias("own_source"))
    rate = rates(documents, settings).select("source_key", "rate")
    few = rate.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    joined = own.join(F.broadcast(rate) if few else rate, F.col("own_source").eqNullSafe(F.col("source_key")))
    counted = joined.withColumn("copies", copies(F.col("rate"), settings.seed, F.col("id"))).where("copies > 0")
    return counted.select("row", "id", "rate", "copies", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"))


def mixed(documents: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The replicated documents in global random order, with ``mix_copies``, ``mix_copy`` and ``mix_key`` (replacing columns of these names)."""
    out = replicated(documents.drop("mix_copies", "mix_copy", "mix_key"), settings)
    key = uniform(settings.seed + 1, F.col("id"), F.col("copy"))
    return out.select("row.*", F.col("copies").alias("mix_copies"), F.col("copy").alias("mix_copy"), key.alias("mix_key")).orderBy("mix_key")
