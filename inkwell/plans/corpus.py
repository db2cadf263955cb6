"""One plan over a corpus: file-local rules, links between files, addresses, spelling, suppression, severities and stored results.

What looks at one document is one map and is settled there. What looks at others is joined on paths, words or addresses; such
findings are suppressed and given their severity by joins on the document's id, and meet the others at the end.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.inflection import COMPOUNDING, TOLERATED
from ..operators import all_rules, tables
from ..operators.facts import facts
from ..operators.lint import FINDING, LEVELS, lint
from ..sources.files import Config, with_overrides
from ..sources.shared import written
from . import links as between
from .engine import as_documents, query, table, unsuppressed
from .native import deletion_keys
from .spelling import bases

#: Default severities of the rules that look at other documents, and of spelling.
CROSS = {"links/missing-file": 2, "links/missing-anchor": 2, "docs/orphan-page": 1, "docs/include-missing": 2, "links/http-error": 2, "links/http-unreachable": 0, "links/http-redirect": 0, "links/image-url": 1, "spelling": 1}
MESSAGES = {
    "links/missing-file": "no such file: {}", "links/missing-anchor": "no such anchor: {}", "docs/orphan-page": "no page links here{}", "docs/include-missing": "included file is missing: {}",
    "links/http-error": "the address answers with an error: {}", "links/http-unreachable": "the address was not reached: {}", "links/http-redirect": "the address has moved: {}", "links/image-url": "no image at {}", "spelling": "unknown word: {}",
}


@dataclass(frozen=True)
class Inputs:
    """Tables beside the documents; what is None takes no part.

    ``dictionary(lang, word)`` and ``accepted(word)`` for spelling, ``status(url, tag, code, detail)`` of addresses, ``paths(path)`` of files that
    are no documents, ``stored(key, path, last_used, findings)`` results of earlier runs, ``listed(path)`` pages of a navigation.
    """

    dictionary: DataFrame | None = None
    accepted: DataFrame | None = None
    status: DataFrame | None = None
    paths: DataFrame | None = None
    stored: DataFrame | None = None
    listed: DataFrame | None = None


def severity_under(rule: Column, default: Column, levels: Column) -> Column:
    """Severity of a rule under a map pattern -> level: the rule's id, else the longest glob that matches, else the default; null is off."""
    as_number = F.create_map(*[F.lit(x) for name, n in LEVELS.items() for x in (name, -1 if n is None else n)])
    hits = F.filter(F.map_keys(levels), lambda p: p.contains("*") & F.like(rule, F.replace(F.replace(p, F.lit("_"), F.lit("\\_")), F.lit("*"), F.lit("%"))))
    glob = F.array_max(F.transform(hits, lambda p: F.struct(F.length(p).alias("n"), p.alias("p"))))["p"]
    own = F.coalesce(F.try_element_at(levels, rule), F.when(default.isNotNull(), F.try_element_at(levels, glob)))
    level = F.coalesce(F.try_element_at(as_number, own), default)
    return F.when(level >= 0, level)


def known_words(words: DataFrame, dictionary: DataFrame) -> DataFrame:
    """The distinct ``words(lang, word)`` that the dictionary of their language has, derives or joins from two of its words."""
    low = F.lower(F.replace("word", F.lit("’"), F.lit("'")))
    ended = F.array(low)
    for lang, endings in TOLERATED.items():
        cut = [F.when(F.endswith(low, F.lit(e)) & (F.length(low) >= len(e) + 3), F.expr(f"substring(word, 1, length(word) - {len(e)})")) for e in endings]
        ended = F.when(F.col("lang") == lang, F.concat(F.array(low), F.transform(F.array_compact(F.array(*cut)), F.lower))).otherwise(ended)
    derived = F.when(F.col("lang") == "en", bases(F.col("word"))).otherwise(F.array_distinct(ended))
    known = dictionary.select("lang", F.lower("word").alias("base")).distinct()
    simple = words.select("lang", "word", F.explode(derived).alias("base")).join(known, ["lang", "base"], "left_semi").select("lang", "word").distinct()
    left = words.join(simple, ["lang", "word"], "left_anti").where("length(word) >= 6")
    joins = F.create_map(*[F.lit(x) for lang, marks in COMPOUNDING.items() for x in (lang, list(marks))])
    marks = F.coalesce(F.try_element_at(joins, F.col("lang")), F.array(F.lit("")))
    split = left.select("lang", "word", low.alias("w"), F.explode(marks).alias("mark")).select("lang", "word", "w", "mark", F.explode(F.expr("sequence(3, length(w) - 3)")).alias("at"))
    first, second = F.expr("substring(w, 1, at)"), F.expr("substring(w, at + 1)")
    split = split.where(F.endswith(first, F.col("mark")) & (F.length(first) - F.length("mark") >= 3)).select("lang", "word", F.expr("substring(w, 1, at - length(mark))").alias("a"), second.alias("b"))
    # English joins few words: the second part is short
    split = split.where((F.col("lang") != "en") | F.length("b").between(4, 8))
    half = lambda name: known.select("lang", F.col("base").alias(name))
    both = split.join(half("a"), ["lang", "a"], "left_semi").join(half("b"), ["lang", "b"], "left_semi")
    return simple.union(both.select("lang", "word").distinct())


def suggested_words(unknown: DataFrame, dictionary: DataFrame, most: int = 3) -> DataFrame:
    """(lang, word, suggestions): up to three words of the dictionary within two edits; words meet on a deletion of one letter."""
    a = unknown.select("lang", "word", F.explode(deletion_keys(F.lower("word"), 1)).alias("key"))
    b = dictionary.select("lang", F.lower("word").alias("known")).distinct().select("lang", "known", F.explode(deletion_keys(F.col("known"), 1)).alias("key"))
    near = a.join(b, ["lang", "key"]).select("lang", "word", "known").distinct().withColumn("edits", F.levenshtein(F.lower("word"), "known", 2)).where("edits >= 0")
    best = F.array_sort(F.collect_list(F.struct("edits", "known")))
    return near.groupBy("lang", "word").agg(F.transform(F.slice(best, 1, most), lambda x: x["known"]).alias("suggestions"))


def project_names(unknown: DataFrame, uses: DataFrame, dictionary: DataFrame, least: int = 3) -> DataFrame:
    """Unknown capitalised words of ``least`` uses or more in the corpus that are not one edit from a known word: names of the project."""
    often = uses.where(F.col("word").rlike(r"^\p{Lu}")).groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    some = often.join(unknown, ["lang", "word"], "left_semi").select("lang", "word")
    near = suggested_words(some, dictionary, 1).where(F.levenshtein(F.lower("word"), F.element_at("suggestions", 1), 1) >= 0)
    return some.join(near, ["lang", "word"], "left_anti")


def spelling_findings(words: DataFrame, dictionary: DataFrame, accepted: DataFrame | None = None) -> DataFrame:
    """Findings of ``spelling`` in ``words`` (``tables.spell_words``): every distinct word of a language is looked up once, languages without
    a dictionary are left alone."""
    distinct = words.select("lang", "word").distinct().join(dictionary.select("lang").distinct(), "lang", "left_semi")
    if accepted is not None:
        distinct = distinct.join(accepted.select(F.lower("word").alias("low")).distinct(), F.lower(F.regexp_replace("word", "['’]s$", "")) == F.col("low"), "left_anti")
    # distinct words: each step is used by several joins, and written for them
    distinct = written(distinct, "spell-distinct")
    unknown = written(distinct.join(known_words(distinct, dictionary), ["lang", "word"], "left_anti"), "spell-unknown")
    unknown = unknown.join(project_names(unknown, words, dictionary), ["lang", "word"], "left_anti")
    told = unknown.join(suggested_words(unknown, dictionary), ["lang", "word"], "left").select("lang", "word", F.coalesce("suggestions", F.array().cast("array<string>")).alias("suggestions"))
    return words.join(told, ["lang", "word"]).select("doc_id", F.lit("spelling").alias("rule"), "line", "col", "b_start", "b_end", F.col("word").alias("text"), "suggestions")


def cross_findings(documents: DataFrame, links: DataFrame, anchors: DataFrame, includes: DataFrame, inputs: Inputs, root: str = "docs/") -> DataFrame:
    """(doc_id, rule, line, b_start, b_end, text, suggestions) of the rules that look at other files and at addresses."""
    every = documents.select("path")
    paths = every if inputs.paths is None else every.union(inputs.paths.select("path")).distinct()
    none = F.array().cast("array<string>")
    own = lambda df: df.select("doc_id", "rule", "line", "b_start", "b_end", "text", none.alias("suggestions"))
    out = own(between.missing_files(links, paths)).union(own(between.missing_anchors(links, documents, anchors))).union(own(between.missing_includes(includes, paths)))
    lonely = between.orphan_pages(documents, links, root, listed=inputs.listed)
    out = out.union(lonely.select("doc_id", F.lit("docs/orphan-page"), F.lit(1), F.lit(0).cast("long"), F.lit(0).cast("long"), F.lit(""), none))
    if inputs.status is not None:
        met = between.address_findings(links, inputs.status)
        out = out.union(met.select("doc_id", "rule", "line", "b_start", "b_end", "text", F.array_compact(F.array("suggestion"))))
    return out


def digest(config: Config) -> str:
    """What a stored result depends on besides its document."""
    return json.dumps([config.language, sorted(config.rules.items()), sorted(config.options.items(), key=str), [(o.paths, o.language, sorted(o.rules.items())) for o in config.overrides], sorted(all_rules())], default=str)


def with_key(documents: DataFrame, config: Config) -> DataFrame:
    """``key`` of each document's stored findings: a digest of path, kind, text and configuration."""
    return documents.withColumn("key", F.sha2(F.concat_ws("\0", "path", "kind", "code_lang", F.coalesce("text", F.lit("")), F.lit(digest(config))), 256))


def with_stored(documents: DataFrame, config: Config, stored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``documents`` with ``known``, true where there is a stored result, and the findings of those results."""
    kept = stored.select("key", "findings").dropDuplicates(["key"])
    keyed = with_key(documents, config)
    hits = keyed.select("key", "doc_id", "path").join(kept, "key").select("doc_id", "path", F.explode("findings").alias("f")).select(*[F.col(c) if c in ("doc_id", "path") else F.col(f"f.{c}").alias(c) for c in columns()])
    marked = keyed.join(kept.select("key", F.lit(True).alias("known")), "key", "left").withColumn("known", F.coalesce("known", F.lit(False))).drop("key")
    return marked, hits


def local_findings(documents: DataFrame, config: Config, stored: DataFrame | None = None) -> DataFrame:
    """Findings of the file-local rules: of documents with a stored result that result, of others the rules'.

    The result is the same with and without the stored ones.
    """
    if stored is None:
        return lint(documents, config=config.options, settle=True)
    marked, hits = with_stored(documents, config, stored)
    return hits.unionByName(lint(marked.where("NOT known"), config=config.options, settle=True))


def columns() -> list[str]:
    return [c.strip().split(" ")[0] for c in FINDING.replace("struct<s:long,e:long,replacement:string>", "struct").split(", ")]


def stored_results(documents: DataFrame, local: DataFrame, config: Config, now: Column) -> DataFrame:
    """(key, path, last_used, findings) to keep for later runs: an entry for each document, also for those without findings."""
    lists = local.groupBy("doc_id").agg(F.collect_list(F.struct(*[c for c in columns() if c not in ("doc_id", "path")])).alias("findings"))
    empty = F.array().cast(lists.schema["findings"].dataType)
    return with_key(documents, config).select("key", "path", "doc_id").join(lists, "doc_id", "left").select("key", "path", now.alias("last_used"), F.coalesce("findings", empty).alias("findings"))


def merged_results(old: DataFrame, new: DataFrame, now: Column, days: int = 30, per_file: int = 4, least: int = 256) -> DataFrame:
    """Entries of two stores by key, the later use holding; old ones and all but ``per_file`` latest of a path go, unless there are ``least`` or fewer."""
    from pyspark.sql import Window

    both = old.unionByName(new).groupBy("key", "path").agg(F.max("last_used").alias("last_used"), F.max_by("findings", "last_used").alias("findings"))
    rank = F.row_number().over(Window.partitionBy("path").orderBy(F.desc("last_used"), "key"))
    keep = (F.col("rank") <= per_file) & (F.col("last_used") >= now - F.expr(f"INTERVAL {days} DAYS"))
    if both.limit(least + 1).count() <= least:
        return both
    return both.withColumn("rank", rank).where(keep).drop("rank")


def exact_first(spelled: DataFrame, findings: DataFrame) -> DataFrame:
    """``spelled`` without words that a terminology finding has on the same range: a term's fix is exact, spelling is vaguer."""
    terms = findings.where("rule = 'prose/terminology'").select("doc_id", "b_start", "b_end")
    return spelled.join(terms, ["doc_id", "b_start", "b_end"], "left_anti")


def outside(findings: DataFrame, ranges: DataFrame) -> DataFrame:
    """Findings that start in none of ``ranges(doc_id, s, e)``: a range anti join with the document as equality."""
    f, r = findings.alias("f"), ranges.alias("r")
    return f.join(r, (F.col("f.doc_id") == F.col("r.doc_id")) & (F.col("f.b_start") >= F.col("r.s")) & (F.col("f.b_start") < F.col("r.e")), "left_anti")


def check(documents: DataFrame, config: Config = Config(), inputs: Inputs = Inputs(), vocabulary: tuple[str, ...] = ()) -> DataFrame:
    """All findings of ``documents(doc_id, path, kind, code_lang, text)`` under a configuration, in the columns of ``FINDING``."""
    docs = with_overrides(documents.select("doc_id", "path", "kind", "code_lang", "text"), config)
    hits = None
    if inputs.stored is not None:
        docs, hits = with_stored(docs, config, inputs.stored)
    # one parse for all that is asked of a document, written for the joins below
    known = written(facts(docs, config.options, vocabulary, inputs.dictionary is not None), "facts")
    of = lambda kind, *names: known.where(F.col("fact") == kind).select("doc_id", *names)
    local = known.where("fact = 'finding'").select(*columns())
    local = local if hits is None else local.unionByName(hits)
    links = of("link", "is_image", "dest", "target", "fragment", "b_start", "b_end", "line")
    includes = of("include", F.col("text").alias("file"), F.col("names").alias("candidates"), "b_start", "b_end", "line")
    joined = cross_findings(docs, links, of("anchor", F.col("text").alias("anchor")), includes, inputs, config.options.get("docs_root", "docs/")).withColumn("col", F.lit(1))
    if inputs.dictionary is not None:
        words = of("words", F.explode("words").alias("w")).select("doc_id", "w.*")
        joined = joined.unionByName(exact_first(spelling_findings(words, inputs.dictionary, inputs.accepted), local))
    off = of("off", F.col("b_start").alias("s"), F.col("b_end").alias("e"), F.col("names").alias("rules"), "kept")
    joined = unsuppressed(joined, off).dropDuplicates(["doc_id", "rule", "b_start", "b_end"])
    default = F.create_map(*[F.lit(x) for kv in CROSS.items() for x in kv])
    message = F.create_map(*[F.lit(x) for kv in MESSAGES.items() for x in kv])
    levels = docs.select("doc_id", "path", "levels")
    rated = joined.join(levels, "doc_id").withColumn("severity", severity_under(F.col("rule"), F.try_element_at(default, F.col("rule")), F.col("levels"))).where("severity IS NOT NULL")
    made = {
        "message": F.replace(F.try_element_at(message, F.col("rule")), F.lit("{}"), F.col("text")), "end_line": F.col("line"), "end_col": F.col("col") + F.length("text"),
        "fix": F.lit(None).cast("struct<s:long,e:long,replacement:string>"),
    }
    return local.select(*columns()).unionByName(rated.select(*[(made[c] if c in made else F.col(c)).alias(c) for c in columns()]))


# queries


@query("terminology_over_spelling", "SELECT p_partkey AS doc_id, 'spelling' AS rule FROM part WHERE p_partkey % 2 = 1 UNION ALL SELECT p_partkey, 'prose/terminology' FROM part WHERE p_partkey % 2 = 0")
def terminology_over_spelling(spark, sf_dir):
    """A page for each part with one word that is both unknown and, on even ones, a wrong form of a term."""
    text = F.when(F.col("p_partkey") % 2 == 0, "see github\n").otherwise("see githob\n")
    documents = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.lit("a.md").alias("path"), F.lit("markdown").alias("kind"), F.lit("").alias("code_lang"), text.alias("text"))
    found = lint(documents, ["prose/terminology"], settle=True)
    spelled = spelling_findings(tables.spell_words(documents), spark.createDataFrame([("en", "see")], "lang string, word string"))
    return exact_first(spelled, found).select("doc_id", "rule").union(found.select("doc_id", "rule"))


@query("foreign_findings", "SELECT p_partkey AS doc_id, (p_partkey % 40)::BIGINT AS b_start FROM part WHERE NOT (p_partkey % 40 >= 10 AND p_partkey % 40 < 20 AND p_partkey % 2 = 0)")
def foreign_findings(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    findings = p.select(F.col("p_partkey").alias("doc_id"), (F.col("p_partkey") % 40).alias("b_start"))
    return outside(findings, p.where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("doc_id"), F.lit(10).alias("s"), F.lit(20).alias("e")))


@query("cache_lookup", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'hit' ELSE 'miss' END AS state FROM documents")
def cache_lookup(spark, sf_dir):
    """Documents whose stored result can be used: a third of them was stored, under this configuration."""
    config = Config()
    keyed = with_key(as_documents(spark, sf_dir), config).select("doc_id", "key")
    stored = keyed.where("doc_id % 3 = 0").select("key", F.lit(True).alias("stored"))
    return keyed.join(stored, "key", "left").select("doc_id", F.when(F.col("stored"), "hit").otherwise("miss").alias("state"))


@query("cache_merge", """WITH o AS (SELECT user_id, event_id, ts FROM events), now AS (SELECT max(ts) AS t FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, lpad(event_id::VARCHAR, 12, '0')) AS k FROM o)
SELECT user_id, event_id FROM r, now WHERE k <= 4 AND ts >= t - INTERVAL 30 DAYS""")
def cache_merge(spark, sf_dir):
    """A store of one entry an event merged with itself: the four latest of each file, none older than thirty days before the newest."""
    e = table(spark, sf_dir, "events")
    now = F.lit(e.agg(F.max("ts")).first()[0])
    store = e.select(F.lpad(F.col("event_id").cast("string"), 12, "0").alias("key"), F.col("user_id").cast("string").alias("path"), F.col("ts").alias("last_used"), F.array().cast("array<string>").alias("findings"))
    out = merged_results(store, store.limit(0), now, least=0)
    return out.select(F.col("path").cast("long").alias("user_id"), F.col("key").cast("long").alias("event_id"))


def corpus_dictionary(spark: SparkSession, sf_dir: str, least: int = 5) -> DataFrame:
    """(lang, word) of words in ``least`` places or more: a dictionary made of the corpus itself."""
    w = table(spark, sf_dir, "documents").select("lang", F.explode(F.regexp_extract_all("text", F.lit(r"([\p{L}]+(?:['’]\p{L}+)*)"), F.lit(1))).alias("word"))
    return w.groupBy("lang", F.lower("word").alias("word")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select("lang", "word")


@query("check_documents")
def check_documents(spark, sf_dir):
    """The whole plan over the whole table: rules, links, spelling by the corpus's own dictionary, each document in its language."""
    documents = as_documents(spark, sf_dir)
    config = Config.of({"options": {"detect_language": True}, "rules": {"md/*": "warn", "docs/orphan-page": "off"}})
    return check(documents, config, Inputs(dictionary=written(corpus_dictionary(spark, sf_dir), "dictionary", True))).select("doc_id", "path", "rule", "severity", "b_start", "b_end", "line", "text")
