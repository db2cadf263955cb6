"""Whole runs: discovery, overrides, rechecking, vocabulary suggestions, and a watched folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.files import Config, discover, with_overrides
from ..sources.shared import shared_dir
from ..streaming.watch import State, to_recheck, watch
from .engine import query, table

LETTER = "A-Za-zÀ-ÖØ-öø-ÿ"


@query("discover", "SELECT CASE p_partkey % 4 WHEN 0 THEN 'docs/p' || p_partkey || '.md' WHEN 2 THEN 'build/keep/p' || p_partkey || '.rs' END AS path, CASE p_partkey % 4 WHEN 0 THEN 'markdown' ELSE 'code' END AS kind FROM part WHERE p_partkey % 4 IN (0, 2)")
def discover_query(spark, sf_dir):
    """Files of known kinds that no ignore pattern takes away; a later pattern can take a path back."""
    path = F.expr("CASE p_partkey % 4 WHEN 0 THEN 'docs/p' || p_partkey || '.md' WHEN 1 THEN 'build/out/p' || p_partkey || '.md' WHEN 2 THEN 'build/keep/p' || p_partkey || '.rs' ELSE 'a/tmp.p' || p_partkey || '.bin' END")
    files = table(spark, sf_dir, "part").select(path.alias("path"), F.col("p_name").alias("text"))
    return discover(files, ["# comment", "/build/*", "!/build/keep/"]).select("path", "kind")


@query("path_overrides", "SELECT p_partkey AS doc_id, CASE WHEN p_partkey % 3 = 0 THEN 'sv' ELSE 'en' END AS language, CASE WHEN p_partkey % 6 = 0 THEN 'off' WHEN p_partkey % 3 = 0 THEN 'error' ELSE 'warn' END AS level FROM part")
def path_overrides(spark, sf_dir):
    config = Config.of({"rules": {"md/*": "warn"}, "overrides": [{"paths": ["sv/**"], "language": "sv", "rules": {"md/*": "error"}}, {"paths": ["sv/even/*.md"], "rules": {"md/*": "off"}}]})
    path = F.expr("CASE WHEN p_partkey % 6 = 0 THEN 'sv/even/' WHEN p_partkey % 3 = 0 THEN 'sv/' ELSE 'en/' END || p_partkey || '.md'")
    d = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), path.alias("path"))
    return with_overrides(d, config).select("doc_id", "language", F.element_at("levels", "md/*").alias("level"))


@query("recheck_planner", "SELECT DISTINCT 'p' || k AS path FROM (SELECT unnest([p_partkey - 1, p_partkey, p_partkey + 1]) AS k FROM part WHERE p_partkey % 100 = 50) WHERE k <= (SELECT max(p_partkey) + 1 FROM part)")
def recheck_planner(spark, sf_dir):
    """What to check again when pages change: themselves, their targets, and the pages that point at them."""
    p = table(spark, sf_dir, "part")
    links = p.select(F.concat(F.lit("p"), "p_partkey").alias("path"), F.concat(F.lit("p"), F.col("p_partkey") + 1).alias("target"))
    return to_recheck(p.where("p_partkey % 100 = 50").select(F.concat(F.lit("p"), "p_partkey").alias("path")), links)


@query("watch_folder")
def watch_folder(spark, sf_dir):
    """Findings of a watched folder after two arrivals: all documents, then a new version of each, which ends even ones with a line end and odd ones with two."""
    from .engine import as_documents

    root = f"{shared_dir(spark)}/watch-{uuid.uuid4().hex}"
    state = State(spark, f"{root}/state", ["md/single-trailing-newline"])
    documents = as_documents(spark, sf_dir)
    for version, arrived in enumerate((documents, documents.withColumn("text", F.expr("text || repeat(chr(10), 1 + doc_id % 2)")))):
        arrived.withColumn("version", F.lit(version).cast("long")).write.mode("append").parquet(f"{root}/in")
        watch(spark, f"{root}/in", state, f"{root}/checkpoint", once=True).awaitTermination()
    return state.now["findings"].select("doc_id", "path", "rule", "line")


@query("vocabulary_suggestions", """WITH w AS (SELECT doc_id, unnest(regexp_extract_all(text, '[a-z],? [A-Z][a-z]{2,} [A-Z][a-z]{2,}')) AS hit FROM documents),
r AS (SELECT doc_id, regexp_extract(hit, '([A-Z][a-z]{2,} [A-Z][a-z]{2,})$', 1) AS phrase FROM w)
SELECT phrase, count(*)::BIGINT AS uses, count(DISTINCT doc_id)::BIGINT AS documents, min(doc_id)::BIGINT AS first_document FROM r GROUP BY phrase""")
def vocabulary_suggestions(spark, sf_dir):
    """Capitalised pairs inside sentences, as candidates for the vocabulary, with their uses."""
    hit = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit("([a-z],? [A-Z][a-z]{2,} [A-Z][a-z]{2,})"), F.lit(1))).alias("hit"))
    phrase = hit.select("doc_id", F.regexp_extract("hit", "([A-Z][a-z]{2,} [A-Z][a-z]{2,})$", 1).alias("phrase"))
    each = phrase.groupBy("phrase", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    return each.groupBy("phrase").agg(F.sum("n").cast("long").alias("uses"), F.count(F.lit(1)).cast("long").alias("documents"), F.min("doc_id").alias("first_document"))


def segments_without(segments: DataFrame, regions: DataFrame) -> DataFrame:
    """(doc_id, b_start, b_end): what is left of segments outside the regions; gaps between the running ends of a segment's regions."""
    from pyspark.sql import Window

    cut = segments.alias("g").join(regions.alias("r"), (F.col("g.doc_id") == F.col("r.doc_id")) & (F.col("r.b_start") < F.col("g.b_end")) & (F.col("r.b_end") > F.col("g.b_start")), "left")
    own = cut.select(F.col("g.doc_id").alias("doc_id"), F.col("g.b_start").alias("s"), F.col("g.b_end").alias("e"), F.col("r.b_start").alias("rs"), F.col("r.b_end").alias("re"))
    by = Window.partitionBy("doc_id", "s", "e").orderBy("rs", "re")
    before = F.coalesce(F.max("re").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.col("s"))
    gaps = own.where("rs IS NOT NULL").select("doc_id", before.alias("b_start"), F.col("rs").alias("b_end"))
    tails = own.groupBy("doc_id", "s", "e").agg(F.max("re").alias("re")).select("doc_id", F.coalesce("re", "s").alias("b_start"), F.col("e").alias("b_end"))
    return gaps.union(tails).where("b_start < b_end")


@query("interval_subtraction", """WITH g AS (SELECT p_partkey AS doc_id, unnest([[0, 10], [20, 30], [50, 60]]) AS x FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT p_partkey, unnest([[0, 100]]) FROM part WHERE p_partkey % 2 = 1)
SELECT doc_id, x[1]::BIGINT AS b_start, x[2]::BIGINT AS b_end FROM g""")
def interval_subtraction(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"))
    segments = p.select("doc_id", F.lit(0).cast("long").alias("b_start"), F.when(F.col("doc_id") % 2 == 0, 60).otherwise(100).cast("long").alias("b_end"))
    regions = p.where("doc_id % 2 = 0").select("doc_id", F.explode(F.expr("array(named_struct('a', 10L, 'b', 20L), named_struct('a', 30L, 'b', 45L), named_struct('a', 40L, 'b', 50L))")).alias("x")).select("doc_id", F.col("x.a").alias("b_start"), F.col("x.b").alias("b_end"))
    return segments_without(segments, regions)


@query("section_of_position", """WITH h AS (SELECT l_orderkey AS doc_id, l_linenumber * 10 AS at, l_partkey AS heading FROM lineitem), p AS (SELECT DISTINCT l_orderkey AS doc_id, unnest([5, 25, 45]) AS at FROM lineitem)
SELECT p.doc_id, p.at::BIGINT AS place, (SELECT max(h.heading) FROM h WHERE h.doc_id = p.doc_id AND h.at = (SELECT max(k.at) FROM h k WHERE k.doc_id = p.doc_id AND k.at <= p.at))::BIGINT AS heading FROM p""")
def section_of_position(spark, sf_dir):
    """The heading that owns a position: an as-of join by one window over the union of both."""
    from pyspark.sql import Window

    line = table(spark, sf_dir, "lineitem")
    heads = line.select(F.col("l_orderkey").alias("doc_id"), (F.col("l_linenumber") * 10).cast("long").alias("place"), F.col("l_partkey").alias("heading"), F.lit(0).alias("asked"))
    asked = line.select(F.col("l_orderkey").alias("doc_id")).distinct().select("doc_id", F.explode(F.array(*[F.lit(x).cast("long") for x in (5, 25, 45)])).alias("place"), F.lit(None).cast("long").alias("heading"), F.lit(1).alias("asked"))
    last = F.last("heading", ignorenulls=True).over(Window.partitionBy("doc_id").orderBy("place", "asked", "heading"))
    return heads.union(asked).withColumn("heading", last).where("asked = 1").select("doc_id", "place", "heading")


@query("placeholders_missing", "SELECT n_nationkey::BIGINT AS doc_id, '%s' AS missing FROM nation WHERE n_nationkey % 4 = 0")
def placeholders_missing(spark, sf_dir):
    """Placeholders of a source that its translation lacks, as a difference of arrays."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("doc_id"), F.concat(F.lit("Go to %s, {place}"), "n_name").alias("source"), F.concat(F.when(F.col("n_nationkey") % 4 == 0, "Nach {place} ").otherwise("Nach %s, {place} "), "n_name").alias("target"))
    found = lambda c: F.regexp_extract_all(c, F.lit(r"(%[sd]|\{\w+\})"), F.lit(1))
    return n.select("doc_id", F.explode(F.array_except(found("source"), found("target"))).alias("missing"))




@query("sql_functions", "SELECT p_partkey AS doc_id, 'part-' || p_partkey AS slug, 3 AS syllables, 2::BIGINT AS sentences FROM part")
def sql_functions(spark, sf_dir):
    """The registered functions and table functions, from SQL."""
    from ..functions.register import register

    register(spark)
    table(spark, sf_dir, "part").createOrReplaceTempView("inkwell_part")
    return spark.sql("SELECT p_partkey AS doc_id, slugify('Part ' || p_partkey) AS slug, syllables('banana') AS syllables, count(*) AS sentences FROM inkwell_part, LATERAL sentences_of('See e.g. the boat. It sank!') GROUP BY ALL")
