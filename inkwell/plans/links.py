"""Links between documents: missing files and anchors, orphan pages, includes, addresses, references into the own repository."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import tables
from .engine import as_documents, query, table
from .native import deletion_keys

FOUND = ["doc_id", "rule", "line", "b_start", "b_end", "text"]


def missing_files(links: DataFrame, paths: DataFrame) -> DataFrame:
    """``links/missing-file``: local links whose target is neither a file nor a folder of ``paths(path)``."""
    every = paths.select(F.col("path").alias("target"))
    folders = every.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split("target", "/"))), lambda n: F.array_join(F.slice(F.split("target", "/"), 1, n), "/"))).alias("target")).distinct()
    local = links.where("target IS NOT NULL")
    return local.join(folders.union(every).distinct(), "target", "left_anti").select("doc_id", F.lit("links/missing-file").alias("rule"), "line", "b_start", "b_end", F.col("dest").alias("text"))


def suggestions(missing: DataFrame, paths: DataFrame, most: int = 2) -> DataFrame:
    """Up to three near paths of a missing one: same folder, by edit distance of the name without case; names meet on what is left with up to ``most`` letters deleted."""
    parts = lambda c: (F.regexp_extract(c, r"^(.*?)[^/]*$", 1), F.lower(F.substring_index(c, "/", -1)))
    want = missing.select("target").distinct().select("target", parts("target")[0].alias("folder"), parts("target")[1].alias("name"))
    have = paths.select("path", parts("path")[0].alias("folder"), parts("path")[1].alias("known"))
    met = want.withColumn("key", F.explode(deletion_keys(F.col("name"), most))).join(have.withColumn("key", F.explode(deletion_keys(F.col("known"), most))), ["folder", "key"])
    near = met.select("target", "path", F.levenshtein("name", "known", most).alias("edits")).where("edits >= 0").distinct()
    rank = F.row_number().over(Window.partitionBy("target").orderBy("edits", "path"))
    return near.withColumn("rank", rank).where("rank <= 3").select("target", F.col("path").alias("suggestion"), "rank")


def missing_anchors(links: DataFrame, documents: DataFrame, anchors: DataFrame) -> DataFrame:
    """``links/missing-anchor``: the document is there, its anchor is not; ``top`` always is."""
    pages = documents.where("kind = 'markdown'").select("path", F.col("doc_id").alias("to_id"))
    asked = links.where("fragment IS NOT NULL AND fragment NOT IN ('', 'top') AND target IS NOT NULL").join(pages, F.col("target") == F.col("path"))
    known = anchors.select(F.col("doc_id").alias("to_id"), F.col("anchor").alias("fragment"))
    return asked.join(known, ["to_id", "fragment"], "left_anti").select("doc_id", F.lit("links/missing-anchor").alias("rule"), "line", "b_start", "b_end", F.col("dest").alias("text"))


#: A page in the navigation of a site's configuration, and in a book's summary.
NAV_ENTRY, SUMMARY_ENTRY = r"(?m)^\s*-\s+(?:[^:\n]+:\s*)?[\"']?([\w./-]+\.(?:md|mdx|markdown))[\"']?\s*$", r"\]\(([^)\s#]+\.md)"


def navigation(files: DataFrame, root: str = "docs/") -> DataFrame:
    """(path) of the pages that a site's ``mkdocs.yml`` or a book's ``SUMMARY.md`` among ``files(path, text)`` lists, seen from where they lie."""
    name = F.lower(F.substring_index("path", "/", -1))
    folder = F.regexp_extract("path", r"^(.*?)[^/]*$", 1)
    own = F.regexp_extract("text", r"(?m)^docs_dir:\s*[\"']?([\w./-]+?)/?[\"']?\s*$", 1)
    nav = F.regexp_extract("text", r"(?ms)^nav:\s*$(.*?)(?=^[^\s-]|\z)", 1)
    site = files.where(name.isin("mkdocs.yml", "mkdocs.yaml")).select(F.concat(folder, F.when(own != "", F.concat(own, F.lit("/"))).otherwise(F.lit(root))).alias("base"), F.explode(F.regexp_extract_all(nav, F.lit(NAV_ENTRY), F.lit(1))).alias("page"))
    book = files.where(name == "summary.md").select(folder.alias("base"), F.explode(F.regexp_extract_all("text", F.lit(SUMMARY_ENTRY), F.lit(1))).alias("page"))
    return site.union(book).select(F.concat("base", F.regexp_replace("page", r"^\./", "")).alias("path")).distinct()


def orphan_pages(documents: DataFrame, links: DataFrame, root: str = "docs/", exempt: str = r"(^|/)(index|readme|_[^/]*)\.md$", listed: DataFrame | None = None) -> DataFrame:
    """``docs/orphan-page``: pages under the root that no other page links to and that are not in ``listed(path)``; links without an extension count."""
    if listed is not None:
        documents = documents.join(listed.select("path"), "path", "left_anti").unionByName(documents.join(listed.select("path"), "path", "left_semi").withColumn("kind", F.lit("listed")))
    key = lambda c: F.regexp_replace(c, r"\.(md|mdx|markdown|html)$", "")
    source = links.join(documents.select("doc_id", F.col("path").alias("own")), "doc_id").where("target IS NOT NULL").where(key("target") != key("own"))
    pages = documents.where((F.col("kind") == "markdown") & F.col("path").startswith(root) & ~F.lower("path").rlike(exempt))
    return pages.join(source.select(key("target").alias("key")).distinct(), key(pages["path"]) == F.col("key"), "left_anti").select("doc_id", "path")


def missing_includes(includes: DataFrame, paths: DataFrame) -> DataFrame:
    """``docs/include-missing``: none of an include's candidates is a file."""
    each = includes.select("doc_id", "b_start", F.explode("candidates").alias("path")).join(paths.select("path"), "path", "left_semi")
    return includes.join(each.select("doc_id", "b_start").distinct(), ["doc_id", "b_start"], "left_anti").select("doc_id", F.lit("docs/include-missing").alias("rule"), "line", "b_start", "b_end", F.col("file").alias("text"))


def address_findings(links: DataFrame, status: DataFrame) -> DataFrame:
    """Rules on addresses by ``status(url, tag, code, detail)``: tags ok, redirect, http_error, blocked, unreachable, not_image."""
    met = links.where("target IS NULL").withColumn("url", F.substring_index("dest", "#", 1)).join(status, "url")
    rule = (
        F.when(F.col("is_image") & F.col("tag").isin("http_error", "not_image", "unreachable"), "links/image-url").when(F.col("tag") == "http_error", "links/http-error")
        .when(F.col("tag").isin("blocked", "unreachable"), "links/http-unreachable").when(F.col("tag") == "redirect", "links/http-redirect")
    )
    fragment = F.when(F.contains("dest", F.lit("#")), F.concat(F.lit("#"), F.substring_index("dest", "#", -1))).otherwise("")
    return met.select("doc_id", rule.alias("rule"), "line", "b_start", "b_end", F.col("dest").alias("text"), F.when(F.col("tag") == "redirect", F.concat("detail", fragment)).alias("suggestion")).where("rule IS NOT NULL")


REPO = r"^https?://(?:www\.)?github\.com/([\w.-]+/[\w.-]+?)(?:\.git)?/(blob|tree|raw|commit|compare|issues|pull|discussions|releases/tag)/([^?#]+)"


def same_repo(links: DataFrame, documents: DataFrame, repo: str, branch: str, paths: DataFrame, refs: DataFrame, items: DataFrame) -> DataFrame:
    """``links/same-repo-url`` (a file of the default branch: a relative path would do) and ``links/same-repo-ref`` (what is not there)."""
    own = links.withColumn("repo", F.lower(F.regexp_extract("dest", REPO, 1))).withColumn("what", F.regexp_extract("dest", REPO, 2)).withColumn("rest", F.rtrim(F.regexp_extract("dest", REPO, 3), F.lit("/"))).where(F.col("repo") == repo.lower())
    own = own.withColumn("ref", F.when(F.col("what").isin("blob", "tree", "raw"), F.substring_index("rest", "/", 1)).otherwise(F.col("rest"))).withColumn("file", F.when(F.col("what").isin("blob", "tree", "raw"), F.expr("substring(rest, length(ref) + 2)")))
    known = paths.select(F.col("path").alias("file"), F.lit(True).alias("there"))
    files = own.where("file IS NOT NULL").join(known, "file", "left")
    url = files.where((F.col("ref") == branch) & F.col("there") & (F.col("what") == "blob")).select("doc_id", F.lit("links/same-repo-url").alias("rule"), "line", F.col("dest").alias("text"))
    gone = files.where((F.col("ref") == branch) & F.col("there").isNull()).select("doc_id", F.lit("links/same-repo-ref").alias("rule"), "line", F.col("dest").alias("text"))
    other = own.where((F.col("file").isNotNull() & (F.col("ref") != branch)) | F.col("what").isin("commit", "releases/tag")).join(refs.select("ref"), "ref", "left_anti")
    number = own.where(F.col("what").isin("issues", "pull", "discussions") & F.col("rest").rlike(r"^\d+$")).withColumn("number", F.col("rest").cast("long")).withColumn("kind_", F.when(F.col("what") == "issues", "issue").when(F.col("what") == "pull", "pull").otherwise("discussion"))
    unknown = number.join(items.select("number", F.col("kind").alias("kind_")), ["number", "kind_"], "left_anti")
    rest = other.select("doc_id", F.lit("links/same-repo-ref").alias("rule"), "line", F.col("dest").alias("text")).union(unknown.select("doc_id", F.lit("links/same-repo-ref").alias("rule"), "line", F.col("dest").alias("text")))
    return url.union(gone).union(rest)


# queries over a site of one page a part

PAGE = "'# Part ' || p_partkey || chr(10) || chr(10) || 'See [next](p' || (p_partkey + 1) || '.md#part-' || (CASE WHEN p_partkey % 5 = 0 THEN 0 ELSE p_partkey + 1 END) || ').' || chr(10) || CASE WHEN p_partkey % 7 = 0 THEN 'And [lost](gone/x' || p_partkey || '.md).' || chr(10) ELSE '' END || CASE WHEN p_partkey % 4 = 0 THEN '{{#include parts/i' || p_partkey || '.txt}}' || chr(10) ELSE '' END || CASE WHEN p_partkey % 6 = 0 THEN 'At [web](https://example.com/' || (p_partkey % 4) || '#s).' || chr(10) ELSE '' END || CASE WHEN p_partkey % 9 = 0 THEN 'In [repo](https://github.com/o/r/blob/main/docs/p' || (p_partkey % 2 * 1000000000) || '.md).' || chr(10) ELSE '' END || CASE WHEN p_partkey % 10 = 0 THEN 'Bug [b](https://github.com/o/r/issues/' || (p_partkey % 3) || ').' || chr(10) ELSE '' END"


def site(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.expr("'docs/p' || p_partkey || '.md'").alias("path"), F.lit("markdown").alias("kind"), F.lit("").alias("code_lang"), F.expr(PAGE).alias("text"))


@query("site_missing_file", "SELECT p_partkey AS doc_id, 'gone/x' || p_partkey || '.md' AS text FROM part WHERE p_partkey % 7 = 0 UNION ALL SELECT max(p_partkey), 'p' || (max(p_partkey) + 1) || '.md#part-' || (CASE WHEN max(p_partkey) % 5 = 0 THEN 0 ELSE max(p_partkey) + 1 END) FROM part")
def site_missing_file(spark, sf_dir):
    d = site(spark, sf_dir)
    return missing_files(tables.links(d), d.select("path")).select("doc_id", "text")


@query("site_missing_anchor", "SELECT p_partkey AS doc_id, 'p' || (p_partkey + 1) || '.md#part-0' AS text FROM part WHERE p_partkey % 5 = 0 AND p_partkey < (SELECT max(p_partkey) FROM part)")
def site_missing_anchor(spark, sf_dir):
    d = site(spark, sf_dir)
    return missing_anchors(tables.links(d), d, tables.anchors(d)).select("doc_id", "text")


@query("site_orphan_page", "SELECT min(p_partkey) AS doc_id FROM part")
def site_orphan_page(spark, sf_dir):
    d = site(spark, sf_dir)
    return orphan_pages(d, tables.links(d)).select("doc_id")


@query("docs_include_missing", "SELECT p_partkey AS doc_id, 'parts/i' || p_partkey || '.txt' AS text FROM part WHERE p_partkey % 4 = 0 AND p_partkey % 8 <> 0")
def docs_include_missing(spark, sf_dir):
    d = site(spark, sf_dir)
    files = d.where("doc_id % 8 = 0").select(F.expr("'docs/parts/i' || doc_id || '.txt'").alias("path"))
    return missing_includes(tables.includes(d), files).select("doc_id", "text")


@query("links_http", """SELECT p_partkey AS doc_id, ['links/http-error', 'links/http-unreachable', 'links/http-redirect'][(p_partkey % 4 + 1)::BIGINT] AS rule, CASE WHEN p_partkey % 4 = 2 THEN 'https://new.example.com/2#s' END AS suggestion FROM part WHERE p_partkey % 6 = 0 AND p_partkey % 4 < 3""")
def links_http(spark, sf_dir):
    status = spark.createDataFrame([("https://example.com/0", "http_error", 404, None), ("https://example.com/1", "blocked", 403, None), ("https://example.com/2", "redirect", 301, "https://new.example.com/2"), ("https://example.com/3", "ok", 200, None)], "url string, tag string, code int, detail string")
    return address_findings(tables.links(site(spark, sf_dir)), status).select("doc_id", "rule", "suggestion")


@query("links_same_repo", """SELECT p_partkey AS doc_id, CASE WHEN p_partkey % 2 = 0 THEN 'links/same-repo-url' ELSE 'links/same-repo-ref' END AS rule FROM part WHERE p_partkey % 9 = 0 UNION ALL SELECT p_partkey, 'links/same-repo-ref' FROM part WHERE p_partkey % 10 = 0 AND p_partkey % 3 <> 1""")
def links_same_repo(spark, sf_dir):
    d = site(spark, sf_dir)
    refs, items = spark.createDataFrame([("v1",)], "ref string"), spark.createDataFrame([(1, "issue"), (2, "pull")], "number long, kind string")
    return same_repo(tables.links(d), d, "o/r", "main", d.select("path"), refs, items).select("doc_id", "rule")


@query("site_suggestions", """WITH c AS (SELECT 'docs/p' || w.p_partkey || 'x.md' AS target, 'docs/p' || h.p_partkey || '.md' AS suggestion, levenshtein('p' || w.p_partkey || 'x.md', 'p' || h.p_partkey || '.md') AS edits FROM part w, part h)
SELECT target, suggestion, (row_number() OVER (PARTITION BY target ORDER BY edits, suggestion))::INTEGER AS rank FROM c WHERE edits <= 2 QUALIFY rank <= 3""")
def site_suggestions(spark, sf_dir):
    """Every page of the site misspelled, with the defaults of ``suggestions``."""
    d = site(spark, sf_dir)
    return suggestions(d.select(F.expr("'docs/p' || doc_id || 'x.md'").alias("target")), d.select("path"))


@query("headings_table", "SELECT p_partkey AS doc_id, 1 AS level, 'Part ' || p_partkey AS text, 'part-' || p_partkey AS anchor, 0::BIGINT AS b_start, length('# Part ' || p_partkey)::BIGINT AS b_end FROM part")
def headings_table(spark, sf_dir):
    return tables.headings(site(spark, sf_dir)).select("doc_id", "level", "text", "anchor", "b_start", "b_end")


@query("links_table", "SELECT p_partkey AS doc_id, count(*)::BIGINT AS n FROM (SELECT p_partkey, unnest([1, 7, 6, 9, 10]) AS k FROM part) WHERE p_partkey % k = 0 GROUP BY p_partkey")
def links_table(spark, sf_dir):
    return tables.links(site(spark, sf_dir)).groupBy("doc_id").agg(F.count(F.lit(1)).cast("long").alias("n"))


@query("segments_table", "SELECT p_partkey AS doc_id, 'heading' AS kind, 1 AS section_id, 'Part ' || p_partkey AS text FROM part")
def segments_table(spark, sf_dir):
    return tables.segments(site(spark, sf_dir)).where("kind = 'heading'").select("doc_id", "kind", "section_id", "text")


def built(spark: SparkSession, sf_dir: str, text) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.lit("a.md").alias("path"), F.lit("markdown").alias("kind"), F.lit("").alias("code_lang"), text.alias("text"))


@query("sentences_table", "SELECT p_partkey AS doc_id, CASE WHEN p_partkey % 3 = 0 THEN 2 ELSE 1 END::BIGINT AS n FROM part")
def sentences_table(spark, sf_dir):
    """Sentences of a built text: abbreviations and initials end none; ``sentences_of_documents`` takes the texts of the documents."""
    d = built(spark, sf_dir, F.when(F.col("p_partkey") % 3 == 0, "See e.g. the boat of J. Smith. It sank!\n").otherwise("Dr. Smith vs. the boat\n"))
    return tables.sentences(d).groupBy("doc_id").agg(F.count(F.lit(1)).cast("long").alias("n"))


@query("tokens_table", "SELECT p_partkey AS doc_id, unnest(['word', 'space', 'number', 'punct']) AS kind, unnest([2, 2, 1, 1])::BIGINT AS n FROM part")
def tokens_table(spark, sf_dir):
    """Tokens of a built text; ``tokens_of_documents`` takes the texts of the documents."""
    return tables.tokens(built(spark, sf_dir, F.lit("The 2nd boat!"))).groupBy("doc_id", "kind").agg(F.count(F.lit(1)).cast("long").alias("n"))


@query("sentences_of_documents")
def sentences_of_documents(spark, sf_dir):
    """Sentences of the whole texts of the table, with their places."""
    return tables.sentences(as_documents(spark, sf_dir))


@query("tokens_of_documents")
def tokens_of_documents(spark, sf_dir):
    """Tokens of the whole texts of the table: how many of each kind a document has, and how many bytes they take."""
    return tables.tokens(as_documents(spark, sf_dir)).groupBy("doc_id", "kind").agg(F.count(F.lit(1)).cast("long").alias("n"), F.sum(F.col("b_end") - F.col("b_start")).cast("long").alias("bytes"))


SOURCE = "'fn a() {} // end ' || p_partkey || chr(10) || '/// Doc of ' || p_partkey || chr(10) || 'fn b() { let s = \"// no\"; }' || chr(10) || '/* block /* nested */ ' || p_partkey || ' */' || chr(10)"


@query("comments_table", """SELECT p_partkey AS doc_id, unnest(['line', 'doc', 'block']) AS kind, unnest([true, false, false]) AS after_code, unnest(['end ' || p_partkey, 'Doc of ' || p_partkey, 'block /* nested */ ' || p_partkey]) AS text FROM part""")
def comments_table(spark, sf_dir):
    d = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.lit("a.rs").alias("path"), F.lit("code").alias("kind"), F.lit("rust").alias("code_lang"), F.expr(SOURCE).alias("text"))
    return tables.comments(d).select("doc_id", "kind", F.col("trailing").alias("after_code"), F.trim("text").alias("text"))


PO = "'msgid \"\"' || chr(10) || 'msgstr \"Language: de' || chr(92) || 'n\"' || chr(10) || chr(10) || '#, fuzzy' || chr(10) || 'msgid \"nation ' || n_nationkey || '\"' || chr(10) || 'msgstr \"' || n_name || '\"' || chr(10)"


@query("po_entries_table", "SELECT n_nationkey::BIGINT AS doc_id, 'nation ' || n_nationkey AS msgid, n_name AS msgstr, 'fuzzy' AS flags FROM nation")
def po_entries_table(spark, sf_dir):
    d = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("doc_id"), F.lit("de.po").alias("path"), F.lit("gettext").alias("kind"), F.lit("").alias("code_lang"), F.expr(PO).alias("text"))
    return tables.po_entries(d).where("msgid <> ''").select("doc_id", "msgid", F.array_join("msgstr", "|").alias("msgstr"), F.array_join("flags", ",").alias("flags"))


@query("code_blocks_table", "SELECT event_id AS doc_id, props AS body FROM events")
def code_blocks_table(spark, sf_dir):
    d = table(spark, sf_dir, "events").select(F.col("event_id").alias("doc_id"), F.lit("a.md").alias("path"), F.lit("markdown").alias("kind"), F.lit("").alias("code_lang"), F.expr("'text' || chr(10) || chr(10) || '```json' || chr(10) || props || chr(10) || '```' || chr(10)").alias("text"))
    return tables.code_blocks(d).where("lang = 'json'").select("doc_id", F.expr("substring(body, 1, length(body) - 1)").alias("body"))


@query("codeblock_json_events", "SELECT event_id AS doc_id FROM events WHERE event_id % 9 = 0")
def codeblock_json_events(spark, sf_dir):
    """Broken JSON among the events: the native verdict, without Python."""
    body = F.when(F.col("event_id") % 9 == 0, F.concat(F.lit("{"), "props")).otherwise(F.col("props"))
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("doc_id"), body.alias("body")).where("try_parse_json(body) IS NULL").select("doc_id")


REGION = "'Start.' || chr(10) || '<!-- lang: sv -->' || chr(10) || 'Hej ' || p_partkey || chr(10) || '<!-- lang: end -->' || chr(10) || '<p lang=\"de-AT\">Ja</p>' || chr(10)"


@query("language_regions", "SELECT p_partkey AS doc_id, unnest(['sv', 'de']) AS lang, unnest([6 + length('Hej ' || p_partkey) - 4, 2])::BIGINT AS bytes FROM part")
def language_regions(spark, sf_dir):
    d = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.lit("a.md").alias("path"), F.lit("markdown").alias("kind"), F.lit("").alias("code_lang"), F.expr(REGION).alias("text"))
    return tables.regions(d).select("doc_id", "lang", (F.col("b_end") - F.col("b_start")).alias("bytes"))
