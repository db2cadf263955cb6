"""Joins of the engine: severities, suppression, links between documents, fixes, reports, scores, cache and streams."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import all_rules
from ..operators.lint import lint
from ..operators.registry import LABELS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# rules and levels


def rules_frame(spark: SparkSession) -> DataFrame:
    """One row a rule: id, family, default severity, kinds, whether it fixes."""
    rows = [(r.id, r.family, r.severity, list(r.kinds), r.fixes) for r in all_rules().values()]
    return spark.createDataFrame(rows, "rule string, family string, severity int, kinds array<string>, fixes boolean")


def like_pattern(glob: Column) -> Column:
    return F.replace(F.replace(F.replace(glob, F.lit("\\"), F.lit("\\\\")), F.lit("_"), F.lit("\\_")), F.lit("*"), F.lit("%"))


def resolved(rules: DataFrame, levels: DataFrame) -> DataFrame:
    """(rule, severity) under ``levels(pattern, level)``: the exact id, else the longest matching glob, else the default.

    A glob cannot switch on a rule that is off by default.
    """
    own = levels.select("pattern", F.coalesce(F.expr("CASE level WHEN 'info' THEN 0 WHEN 'warn' THEN 1 WHEN 'warning' THEN 1 WHEN 'error' THEN 2 ELSE -1 END"), F.lit(-1)).alias("level"))
    hit = (F.col("pattern") == F.col("rule")) | (F.col("pattern").contains("*") & F.expr("rule LIKE replace(replace(pattern, '_', '\\\\_'), '*', '%')"))
    # both sides are the configuration: a row for each rule and each pattern
    met = rules.join(F.broadcast(own), hit, "left")
    best = met.groupBy("rule", "severity").agg(F.max_by(F.struct("pattern", "level"), F.struct(F.col("pattern") == F.col("rule"), F.length("pattern"))).alias("own"))
    level = F.when(F.col("own.pattern").isNull(), F.col("severity")).when((F.col("own.pattern") == F.col("rule")) | F.col("severity").isNotNull(), F.col("own.level")).otherwise(F.col("severity"))
    return best.select("rule", F.when(level >= 0, level).alias("severity"))


@query("severity_levels", """SELECT * FROM (VALUES ('grammar/AnA', 1), ('grammar/Didnt', NULL), ('md/no-hard-tabs', 2), ('md/no-multiple-blanks', 1), ('md/line-length', NULL), ('prose/passive', 0), ('prose/simplify', 0), ('md/no-bare-urls', NULL)) AS t(rule, severity)""")
def severity_levels(spark, sf_dir):
    levels = spark.createDataFrame([("grammar/D*", "off"), ("md/no-h*", "error"), ("md/no-hard-tabs", "error"), ("md/line*", "warn"), ("prose/passive", "info"), ("md/*", "warning"), ("md/no-bare-urls", "off")], "pattern string, level string")
    named = ["grammar/AnA", "grammar/Didnt", "md/no-hard-tabs", "md/no-multiple-blanks", "md/line-length", "prose/passive", "prose/simplify", "md/no-bare-urls"]
    return resolved(rules_frame(spark).where(F.col("rule").isin(named)), levels)


@query("rule_list")
def rule_list(spark, sf_dir):
    return rules_frame(spark).orderBy("rule")


# documents and findings


def as_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``documents`` table as Markdown files."""
    return table(spark, sf_dir, "documents").select("doc_id", F.format_string("docs/%s/%d.md", F.col("source"), F.col("doc_id")).alias("path"), F.lit("markdown").alias("kind"), F.lit("").alias("code_lang"), "text")


@query("lint_documents")
def lint_documents(spark, sf_dir):
    """All rules that are on by default over the whole table."""
    return lint(as_documents(spark, sf_dir), settle=True).select("doc_id", "path", "rule", "severity", "b_start", "b_end", "line", "col", "text", "message")


@query("lint_repetition", """WITH d AS (SELECT doc_id, text FROM documents)
SELECT doc_id, len(regexp_extract_all(text, '(?:^|[^A-Za-z0-9À-ÿ_-])the[ \\n]+the(?:[^A-Za-z0-9À-ÿ_-]|$)'))::BIGINT AS n FROM d WHERE len(regexp_extract_all(text, '(?:^|[^A-Za-z0-9À-ÿ_-])the[ \\n]+the(?:[^A-Za-z0-9À-ÿ_-]|$)')) > 0""")
def lint_repetition(spark, sf_dir):
    """Places of a doubled 'the' by the linguistic tokens of each text."""
    d = table(spark, sf_dir, "documents").where(F.contains("text", F.lit("the")))
    n = F.regexp_count("text", F.lit(r"(?:^|[^A-Za-z0-9À-ÿ_-])the[ \n]+the(?:[^A-Za-z0-9À-ÿ_-]|$)"))
    return d.select("doc_id", n.cast("long").alias("n")).where("n > 0")


def unsuppressed(findings: DataFrame, suppressions: DataFrame) -> DataFrame:
    """Findings outside ``suppressions(doc_id, s, e, rules, kept)``; ends are inclusive, a family name covers its rules, ``kept`` are on again.

    For findings of joins; those of the map are settled there.
    """
    f, s = findings.alias("f"), suppressions.alias("s")
    one = lambda p: (p == "*") | (F.col("f.rule") == p) | F.col("f.rule").startswith(F.concat(F.rtrim(p, F.lit("*/")), F.lit("/")))
    covers = F.exists("s.rules", one) & ~F.exists("s.kept", one)
    inside = (F.col("f.doc_id") == F.col("s.doc_id")) & (F.col("s.s") <= F.col("f.b_start")) & (F.col("f.b_start") <= F.col("s.e")) & covers
    return f.join(s, inside, "left_anti")


def suppressions(documents: DataFrame) -> DataFrame:
    """(doc_id, s, e, rules, kept) of all directives; only documents with one reach Python."""
    from ..operators import tables
    from ..operators.settle import directives

    def rows(c, at):
        for o in directives(c)[0]:
            yield at.byte(o.start), at.byte(o.end), list(o.rules), list(o.kept)

    return tables.child(documents.where(F.contains("text", F.lit("lint-"))), "s long, e long, rules array<string>, kept array<string>", rows)


SUPPRESSED = "CASE p_partkey % 4 WHEN 0 THEN '<!-- lint-disable-next-line md/no-hard-tabs -- ok -->' || chr(10) || 'a' || chr(9) || 'b' || chr(10) || 'c' || chr(9) || 'd' WHEN 1 THEN '<!-- lint-disable md -->' || chr(10) || 'a' || chr(9) || 'b' || chr(10) || '<!-- lint-enable -->' || chr(10) || 'c' || chr(9) || 'd' WHEN 2 THEN '<!-- lint-disable-file -->' || chr(10) || 'a' || chr(9) || 'b' ELSE 'a' || chr(9) || 'b' || chr(10) END"


@query("suppression", "SELECT p_partkey AS doc_id, CASE p_partkey % 4 WHEN 0 THEN 3 WHEN 1 THEN 4 ELSE 1 END::INTEGER AS line FROM part WHERE p_partkey % 4 <> 2")
def suppression(spark, sf_dir):
    documents = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.lit("a.md").alias("path"), F.lit("markdown").alias("kind"), F.lit("").alias("code_lang"), F.expr(SUPPRESSED).alias("text"))
    return lint(documents, ["md/no-hard-tabs"], settle=True).select("doc_id", "line")


# positions


@query("positions", """WITH l AS (SELECT doc_id, text, strpos(text, '.') AS p FROM documents WHERE strpos(text, '.') > 0)
SELECT doc_id, strlen(substr(text, 1, p - 1))::BIGINT AS b_start, (length(substr(text, 1, p - 1)) - length(replace(substr(text, 1, p - 1), chr(10), '')) + 1)::INTEGER AS line,
  (p - 1 - coalesce(length(substr(text, 1, p - 1)) - strpos(reverse(substr(text, 1, p - 1)), chr(10)) + 1, 0) * (strpos(substr(text, 1, p - 1), chr(10)) > 0)::INTEGER + 1)::INTEGER AS col FROM l""")
def positions(spark, sf_dir):
    """Byte, line and column of the first full stop of each text."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", F.instr("text", ".").alias("p")).where("p > 0")
    before = F.expr("substring(text, 1, p - 1)")
    return d.select("doc_id", F.octet_length(before).cast("long").alias("b_start"), (F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1).cast("int").alias("line"), (F.length(F.substring_index(before, "\n", -1)) + 1).cast("int").alias("col"))


# links between documents

GRAPH = "SELECT o_orderkey AS page, CASE WHEN o_orderkey % 7 = 0 OR o_custkey % 11 = 0 THEN o_orderkey + 1000000000 ELSE o_custkey END AS target, o_orderkey % 5 = 0 AS broken_anchor FROM orders"


def link_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Pages (one a customer and one an order) and their links: derived from orders, some dangling."""
    table(spark, sf_dir, "orders").createOrReplaceTempView("orders")
    orders = table(spark, sf_dir, "orders")
    links = spark.sql(GRAPH).select(F.concat(F.lit("orders/"), F.col("page"), F.lit(".md")).alias("path"), F.concat(F.lit("customers/"), F.col("target"), F.lit(".md")).alias("target"), F.when(F.col("broken_anchor"), F.lit("nowhere")).otherwise(F.lit("top-level")).alias("anchor"))
    pages = table(spark, sf_dir, "customer").select(F.concat(F.lit("customers/"), F.col("c_custkey"), F.lit(".md")).alias("path"), F.lit("top-level").alias("anchor"))
    return pages.union(orders.select(F.concat(F.lit("orders/"), F.col("o_orderkey"), F.lit(".md")), F.lit("order"))), links


@query("links_missing_file", "SELECT 'orders/' || o_orderkey || '.md' AS path, 'customers/' || (o_orderkey + 1000000000) || '.md' AS target FROM orders WHERE o_orderkey % 7 = 0 OR o_custkey % 11 = 0")
def links_missing_file(spark, sf_dir):
    """Links whose target is no page: an anti join on the path."""
    pages, links = link_graph(spark, sf_dir)
    return links.join(pages.select(F.col("path").alias("target")), "target", "left_anti").select("path", "target")


@query("links_missing_anchor", "SELECT 'orders/' || o_orderkey || '.md' AS path, 'customers/' || o_custkey || '.md' AS target, 'nowhere' AS anchor FROM orders WHERE o_orderkey % 7 <> 0 AND o_custkey % 11 <> 0 AND o_orderkey % 5 = 0")
def links_missing_anchor(spark, sf_dir):
    """Links to a page that is there, at an anchor that is not."""
    pages, links = link_graph(spark, sf_dir)
    there = links.join(pages.select(F.col("path").alias("target")), "target", "left_semi")
    return there.join(pages.select(F.col("path").alias("target"), "anchor"), ["target", "anchor"], "left_anti").select("path", "target", "anchor")


@query("docs_orphan_page", "SELECT 'customers/' || c_custkey || '.md' AS path FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 7 <> 0 AND o_custkey % 11 <> 0)")
def docs_orphan_page(spark, sf_dir):
    pages, links = link_graph(spark, sf_dir)
    return pages.where(F.col("path").startswith("customers/")).join(links.select(F.col("target").alias("path")), "path", "left_anti").select("path")


@query("docs_inbound_links", "SELECT 'customers/' || o_custkey || '.md' AS target, count(*)::BIGINT AS links, min(o_orderkey)::BIGINT AS first_order FROM orders WHERE o_orderkey % 7 <> 0 AND o_custkey % 11 <> 0 GROUP BY o_custkey")
def docs_inbound_links(spark, sf_dir):
    """Pages with the links that point at them."""
    pages, links = link_graph(spark, sf_dir)
    met = links.join(pages.select(F.col("path").alias("target")), "target", "left_semi")
    return met.groupBy("target").agg(F.count(F.lit(1)).cast("long").alias("links"), F.min(F.regexp_extract("path", r"(\d+)", 1).cast("long")).alias("first_order"))


URLS = "SELECT DISTINCT s_suppkey AS k, CASE s_suppkey % 5 WHEN 0 THEN 404 WHEN 1 THEN 403 WHEN 2 THEN 301 ELSE 200 END AS code FROM supplier"


@query("links_http_status", f"""WITH u AS ({URLS}), l AS (SELECT p_partkey, p_partkey % 10 + 1 AS k FROM part)
SELECT p_partkey AS doc_id, CASE WHEN code = 404 THEN 'links/http-error' WHEN code = 403 THEN 'links/http-unreachable' ELSE 'links/http-redirect' END AS rule, code::INTEGER AS code FROM l JOIN u USING (k) WHERE code <> 200""")
def links_http_status(spark, sf_dir):
    """Links joined with a table of probed addresses: errors, blocked or unreachable hosts, permanent redirects."""
    table(spark, sf_dir, "supplier").createOrReplaceTempView("supplier")
    status = spark.sql(URLS)
    links = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), (F.col("p_partkey") % 10 + 1).alias("k"))
    rule = F.when(F.col("code").isin(401, 403, 999), "links/http-unreachable").when(F.col("code").isin(301, 308), "links/http-redirect").when(F.col("code") >= 400, "links/http-error")
    return links.join(status, "k").select("doc_id", rule.alias("rule"), F.col("code").cast("int").alias("code")).where("rule IS NOT NULL")


@query("near_misses", """WITH n AS (SELECT n_name FROM nation), w AS (SELECT DISTINCT substr(n_name, 1, length(n_name) - 1) AS typed FROM nation WHERE length(n_name) > 3)
SELECT typed, n_name AS suggestion, rank::INTEGER AS rank FROM (SELECT typed, n_name, row_number() OVER (PARTITION BY typed ORDER BY levenshtein(lower(typed), lower(n_name)), n_name) AS rank FROM w, n WHERE levenshtein(lower(typed), lower(n_name)) <= 2) WHERE rank <= 3""")
def near_misses_query(spark, sf_dir):
    """Known names within two edits of what was typed, the best three."""
    n = table(spark, sf_dir, "nation").select("n_name")
    return near_misses(n.where(F.length("n_name") > 3).select(F.expr("substring(n_name, 1, length(n_name) - 1)").alias("typed")), n.select(F.col("n_name").alias("suggestion")))


def near_misses(typed: DataFrame, known: DataFrame, most: int = 3) -> DataFrame:
    """(typed, suggestion, rank): of ``known(suggestion)`` the best within two edits of each of ``typed``, without case; names meet on what
    is left with up to two letters deleted, at any number of names."""
    from .native import deletion_keys

    a = typed.distinct().select("typed", F.explode(deletion_keys(F.lower("typed"), 2)).alias("key"))
    b = known.distinct().select("suggestion", F.explode(deletion_keys(F.lower("suggestion"), 2)).alias("key"))
    near = a.join(b, "key").select("typed", "suggestion").distinct().withColumn("edits", F.levenshtein(F.lower("typed"), F.lower("suggestion"), 2)).where("edits >= 0")
    rank = F.row_number().over(Window.partitionBy("typed").orderBy("edits", "suggestion"))
    return near.withColumn("rank", rank).where(F.col("rank") <= most).select("typed", "suggestion", "rank")


# overlaps, fixes


def without_overlaps(findings: DataFrame) -> DataFrame:
    """Greedy sweep in each document: earliest start, then longest, then first rule; later overlapping findings go."""
    order = F.array_sort(F.collect_list(F.struct("b_start", (-F.col("b_end")).alias("minus_end"), "rule")))
    swept = F.aggregate(order, F.struct(F.lit(-1).cast("long").alias("at"), F.array().cast("array<struct<b_start:long,minus_end:long,rule:string>>").alias("kept")), lambda acc, x: F.when(x["b_start"] >= acc["at"], F.struct((-x["minus_end"]).alias("at"), F.concat(acc["kept"], F.array(x)).alias("kept"))).otherwise(acc))
    return findings.groupBy("doc_id").agg(swept["kept"].alias("kept")).select("doc_id", F.explode("kept").alias("x")).select("doc_id", F.col("x.b_start").alias("b_start"), (-F.col("x.minus_end")).alias("b_end"), F.col("x.rule").alias("rule"))


@query("overlap_removal", """WITH RECURSIVE f AS (SELECT l_orderkey AS doc_id, l_linenumber * 3 AS s, l_linenumber * 3 + l_partkey % 7 + 1 AS e, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber * 3, -(l_linenumber * 3 + l_partkey % 7 + 1)) AS k FROM lineitem),
g AS (SELECT doc_id, k, s, e, e AS at, true AS kept FROM f WHERE k = 1 UNION ALL SELECT f.doc_id, f.k, f.s, f.e, CASE WHEN f.s >= g.at THEN f.e ELSE g.at END, f.s >= g.at FROM g JOIN f ON f.doc_id = g.doc_id AND f.k = g.k + 1)
SELECT doc_id, s::BIGINT AS b_start, e::BIGINT AS b_end FROM g WHERE kept""")
def overlap_removal(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem")
    start = (F.col("l_linenumber") * 3).cast("long")
    findings = line.select(F.col("l_orderkey").alias("doc_id"), start.alias("b_start"), (start + F.col("l_partkey") % 7 + 1).alias("b_end"), F.lit("x").alias("rule"))
    return without_overlaps(findings).select("doc_id", "b_start", "b_end")


def applied(text: str, fixes: list[tuple[int, int, str]]) -> str:
    """The text with its fixes: in order, replacements before insertions at one place, overlapping ones skipped."""
    raw, out, at, inserted = text.encode(), [], 0, None
    for s, e, new in sorted(set(fixes), key=lambda f: (f[0], f[0] == f[1], f[1], f[2])):
        if s < at or e > len(raw) or s > e or (s == e and s == at and inserted is False and at):
            continue
        try:
            raw[at:s].decode(), raw[s:e].decode()
        except UnicodeDecodeError:
            continue
        out += [raw[at:s], new.encode()]
        at, inserted = e, s == e
    return b"".join([*out, raw[at:]]).decode()


def fixed(documents: DataFrame, findings: DataFrame) -> DataFrame:
    """(doc_id, text) of the documents with fixes applied; one row a document, its fixes as an array."""
    fixes = findings.where("fix IS NOT NULL").groupBy("doc_id").agg(F.collect_set("fix").alias("fixes"))

    @F.arrow_udf("string")
    def apply(text: pa.Array, own: pa.Array) -> pa.Array:
        return pa.array([applied(t, [(f["s"], f["e"], f["replacement"]) for f in o]) for t, o in zip(text.to_pylist(), own.to_pylist(), strict=True)], pa.string())

    return documents.join(fixes, "doc_id").select("doc_id", apply("text", "fixes").alias("text"))


MESSY = "'#Title' || chr(10) || chr(10) || '* one' || chr(10) || '- two' || chr(10) || chr(10) || p_name || ' ' || chr(10)"


@query("fixes", "SELECT p_partkey AS doc_id, '# Title' || chr(10) || chr(10) || '* one' || chr(10) || '* two' || chr(10) || chr(10) || p_name || chr(10) AS text FROM part")
def fixes_query(spark, sf_dir):
    documents = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.lit("a.md").alias("path"), F.lit("markdown").alias("kind"), F.lit("").alias("code_lang"), F.expr(MESSY).alias("text"))
    return fixed(documents, lint(documents, ["md/no-missing-space-atx", "md/list-marker", "md/no-trailing-spaces"]))


# reports


@query("report_rollup", """WITH f AS (SELECT l_returnflag AS family, l_linestatus AS rule, l_orderkey AS doc_id FROM lineitem)
SELECT coalesce(family, '(all)') AS family, coalesce(rule, '(all)') AS rule, count(*)::BIGINT AS findings, count(DISTINCT doc_id)::BIGINT AS documents FROM f GROUP BY ROLLUP (family, rule)""")
def report_rollup(spark, sf_dir):
    """Findings by family and rule with totals; documents are counted once a group before the totals are made."""
    f = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("family"), F.col("l_linestatus").alias("rule"), F.col("l_orderkey").alias("doc_id"))
    return f.rollup("family", "rule").agg(F.count(F.lit(1)).cast("long").alias("findings"), F.countDistinct("doc_id").cast("long").alias("documents")).select(F.coalesce("family", F.lit("(all)")).alias("family"), F.coalesce("rule", F.lit("(all)")).alias("rule"), "findings", "documents")


def annotation(severity: Column, path: Column, line: Column, col: Column, rule: Column, message: Column) -> Column:
    escaped = message
    for old, new in (("%", "%25"), ("\r", "%0D"), ("\n", "%0A")):
        escaped = F.replace(escaped, F.lit(old), F.lit(new))
    return F.concat(F.lit("::"), F.element_at(F.array(F.lit("notice"), F.lit("warning"), F.lit("error")), severity + 1), F.lit(" file="), path, F.lit(",line="), line, F.lit(",col="), col, F.lit(",title="), rule, F.lit("::"), escaped)


@query("sink_annotations", "SELECT '::' || ['notice', 'warning', 'error'][(p_size % 3 + 1)::BIGINT] || ' file=' || p_partkey || '.md,line=' || p_size || ',col=1,title=md/x::100%25' || '%0A' || p_name AS line FROM part")
def sink_annotations(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select(annotation(F.col("p_size") % 3, F.concat("p_partkey", F.lit(".md")), F.col("p_size").cast("string"), F.lit("1"), F.lit("md/x"), F.concat(F.lit("100%\n"), "p_name")).alias("line"))


@query("sink_json", "SELECT p_partkey AS doc_id, '{\"path\":\"' || p_partkey || '.md\",\"rule\":\"md/x\",\"line\":' || p_size || ',\"message\":\"' || p_name || '\"}' AS json FROM part")
def sink_json(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("doc_id"), F.to_json(F.struct(F.concat("p_partkey", F.lit(".md")).alias("path"), F.lit("md/x").alias("rule"), F.col("p_size").alias("line"), F.col("p_name").alias("message"))).alias("json"))


def sarif(findings: DataFrame) -> DataFrame:
    """One SARIF result a finding, as JSON; a run's file is the results written as one array by the caller."""
    level = F.element_at(F.array(F.lit("note"), F.lit("warning"), F.lit("error")), F.col("severity") + 1)
    region = F.struct(F.col("line").alias("startLine"), F.col("col").alias("startColumn"), F.col("end_line").alias("endLine"), F.col("end_col").alias("endColumn"))
    where = F.array(F.struct(F.struct(F.struct(F.col("path").alias("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation")))
    return findings.select("doc_id", F.to_json(F.struct(F.col("rule").alias("ruleId"), level.alias("level"), F.struct(F.col("message").alias("text")).alias("message"), where.alias("locations"))).alias("result"))


SARIF_SQL = """WITH d AS (SELECT doc_id, coalesce(source, 'null') AS source, text, regexp_replace(text, '\\s+$', '') AS body FROM documents WHERE text IS NOT NULL),
l AS (SELECT *, length(body) - length(replace(body, chr(10), '')) + 1 AS line, length(regexp_extract(body, '[^\\n]*$')) + 1 AS col, length(text) - length(replace(text, chr(10), '')) + 1 AS end_line, length(regexp_extract(text, '[^\\n]*$')) + 1 AS end_col
  FROM d WHERE body <> '' AND substr(text, length(body) + 1) <> chr(10))
SELECT doc_id, '{"ruleId":"md/single-trailing-newline","level":"warning","message":{"text":"file should end in one newline"},"locations":[{"physicalLocation":{"artifactLocation":{"uri":"docs/' || source || '/' || doc_id || '.md"},"region":{"startLine":' || line
  || ',"startColumn":' || col || ',"endLine":' || end_line || ',"endColumn":' || end_col || '}}}]}' AS result FROM l"""


@query("sink_sarif", SARIF_SQL)
def sink_sarif(spark, sf_dir):
    return sarif(lint(as_documents(spark, sf_dir), ["md/single-trailing-newline"]))


@query("exit_code", "SELECT CASE WHEN max(p_size % 3) >= 1 THEN 1 ELSE 0 END::INTEGER AS exit_code FROM part")
def exit_code(spark, sf_dir):
    """1 when a finding is at least a warning."""
    return table(spark, sf_dir, "part").agg(F.when(F.max(F.col("p_size") % 3) >= 1, 1).otherwise(0).cast("int").alias("exit_code"))


@query("density_top_words", """WITH w AS (SELECT source, lower(unnest(regexp_extract_all(text, '[A-Za-z]{4,}'))) AS word FROM documents), n AS (SELECT source, word, count(*) AS n FROM w GROUP BY ALL)
SELECT source, word, n::BIGINT AS n, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, word) AS rank FROM n) WHERE rank <= 5""")
def density_top_words(spark, sf_dir):
    """The five most frequent words of each source."""
    w = table(spark, sf_dir, "documents").select("source", F.explode(F.regexp_extract_all("text", F.lit("([A-Za-z]{4,})"), F.lit(1))).alias("word"))
    n = w.groupBy("source", F.lower("word").alias("word")).agg(F.count(F.lit(1)).cast("long").alias("n"))
    rank = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n"), "word"))
    return n.withColumn("rank", rank).where("rank <= 5").select("source", "word", "n", "rank")


# scores


def scored(labels: DataFrame, findings: DataFrame) -> DataFrame:
    """(tp, fp, fn, precision, recall, f1): a finding meets a label on the same line where spans overlap, one for each label."""
    lab, fin = labels.withColumn("lid", F.monotonically_increasing_id()), findings.withColumn("fid", F.monotonically_increasing_id())
    met = lab.alias("l").join(fin.alias("f"), (F.col("l.path") == F.col("f.path")) & (F.col("l.line") == F.col("f.line")) & (F.col("l.col") < F.col("f.end_col")) & (F.col("f.col") < F.col("l.end_col")), "inner")
    n = met.agg(F.countDistinct("lid").alias("tp"))
    every = n.crossJoin(lab.agg(F.count(F.lit(1)).alias("labels"))).crossJoin(fin.agg(F.count(F.lit(1)).alias("findings")))  # single rows
    p, r = F.col("tp") / F.col("findings"), F.col("tp") / F.col("labels")
    return every.select("tp", (F.col("findings") - F.col("tp")).alias("fp"), (F.col("labels") - F.col("tp")).alias("fn"), F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(2 * p * r / (p + r), 6).alias("f1"))


@query("score_labels", """WITH n AS (SELECT count(*) FILTER (p_partkey % 2 = 0) AS labels, count(*) FILTER (p_partkey % 3 = 0) AS findings, count(*) FILTER (p_partkey % 6 = 0) AS tp FROM part)
SELECT tp::BIGINT AS tp, (findings - tp)::BIGINT AS fp, (labels - tp)::BIGINT AS fn, round(tp::DOUBLE / findings, 6) AS precision, round(tp::DOUBLE / labels, 6) AS recall, round(2.0::DOUBLE * tp / (findings + labels), 6) AS f1 FROM n""")
def score_labels(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("path"), F.lit(1).alias("line"), F.lit(3).alias("col"), F.lit(8).alias("end_col"), "p_partkey")
    return scored(p.where("p_partkey % 2 = 0"), p.where("p_partkey % 3 = 0"))


# cache and kinds of files


@query("cache_prune", """SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k <= 4""")
def cache_prune(spark, sf_dir):
    """The four latest entries of each file."""
    k = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id")))
    return table(spark, sf_dir, "events").withColumn("k", k).where("k <= 4").select("user_id", "event_id")


EXTENSIONS = {"md": ("markdown", ""), "mdx": ("markdown", ""), "markdown": ("markdown", ""), "po": ("gettext", ""), "pot": ("gettext", ""), "rs": ("code", "rust"), "go": ("code", "go"), "py": ("code", "python"), "pyi": ("code", "python"), "js": ("code", "javascript"), "ts": ("code", "typescript"), "tsx": ("code", "typescript"), "sh": ("code", "shell"), "bash": ("code", "shell"), "rb": ("code", "ruby"), "nix": ("code", "nix"), "zig": ("code", "zig"), "c": ("code", "c"), "h": ("code", "c"), "cpp": ("code", "cpp"), "cc": ("code", "cpp"), "hpp": ("code", "cpp"), "java": ("code", "java"), "kt": ("code", "java"), "scala": ("code", "java"), "swift": ("code", "java"), "cs": ("code", "csharp"), "php": ("code", "php"), "ex": ("code", "elixir"), "exs": ("code", "elixir"), "toml": ("code", "toml"), "yaml": ("code", "yaml"), "yml": ("code", "yaml")}
BARE = {"makefile": "shell", "dockerfile": "shell", "justfile": "shell"}


def with_kind(files: DataFrame) -> DataFrame:
    """``kind`` and ``code_lang`` by the file's extension or name; files of unknown kind go."""
    pairs = F.create_map(*[x for e, (kind, lang) in EXTENSIONS.items() for x in (F.lit(e), F.struct(F.lit(kind).alias("kind"), F.lit(lang).alias("code_lang")))])
    name = F.lower(F.substring_index("path", "/", -1))
    bare = F.create_map(*[x for e, lang in BARE.items() for x in (F.lit(e), F.struct(F.lit("code").alias("kind"), F.lit(lang).alias("code_lang")))])
    found = F.coalesce(F.try_element_at(bare, name), F.try_element_at(pairs, F.when(F.contains(name, F.lit(".")), F.substring_index(name, ".", -1)).otherwise("")))
    return files.withColumn("__k", found).where("__k IS NOT NULL").select("*", "__k.kind", "__k.code_lang").drop("__k")


@query("file_kinds", "SELECT p_partkey AS doc_id, CASE p_partkey % 5 WHEN 0 THEN 'markdown' WHEN 3 THEN 'gettext' ELSE 'code' END AS kind, CASE p_partkey % 5 WHEN 1 THEN 'rust' WHEN 2 THEN 'shell' ELSE '' END AS code_lang FROM part WHERE p_partkey % 5 <> 4")
def file_kinds(spark, sf_dir):
    name = F.element_at(F.array(*map(F.lit, ("a.MD", "src/b.rs", "Dockerfile", "de.po", "c.bin"))), (F.col("p_partkey") % 5 + 1).cast("int"))
    return with_kind(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.concat(F.lit("x/"), name).alias("path"))).select("doc_id", "kind", "code_lang")


GENERATED = r"(?i)@generated|do not edit|auto-?generated|generated by|code generated|automatically generated"


def written_by_hand(files: DataFrame) -> DataFrame:
    """Files without NUL characters and without a mark of generated code in the first five lines (ten of Markdown)."""
    head = F.array_join(F.slice(F.split("text", "\n", -1), 1, F.when(F.col("kind") == "markdown", 10).otherwise(5)), "\n")
    marked = F.when(F.col("kind") == "markdown", head.rlike(r"(?is)<!--(?:(?!-->).)*generated(?:(?!-->).)*-->")).otherwise(head.rlike(GENERATED))
    return files.where(~F.contains("text", F.lit("\0")) & ~marked)


@query("generated_files", "SELECT p_partkey AS doc_id FROM part WHERE p_partkey % 4 NOT IN (1, 2)")
def generated_files(spark, sf_dir):
    text = F.when(F.col("p_partkey") % 4 == 1, F.concat(F.lit("// Code generated by x. DO NOT EDIT.\n"), "p_name")).when(F.col("p_partkey") % 4 == 2, F.concat(F.lit("<!-- this file is generated -->\n"), "p_name")).when(F.col("p_partkey") % 4 == 3, F.concat(F.lit("1\n2\n3\n4\n5\n6\n// @generated\n"), "p_name")).otherwise(F.col("p_name"))
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.when(F.col("p_partkey") % 4 == 2, "markdown").otherwise("code").alias("kind"), text.alias("text"))
    return written_by_hand(p).select("doc_id")
