"""Structure rules over a corpus of Markdown pages, and the same findings computed from the texts in SQL.

The pages are built from ``part`` by one expression that both engines evaluate; what must be found is not written down anywhere: the SQL
cuts the texts into lines and looks for it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.grammar import TWICE
from ..operators.lint import lint
from .engine import as_documents, query, table

#: A page for each part; every rule's fault is there or not by another remainder of the key.
PAGE = """CASE WHEN p_partkey % 5 = 0 THEN '## ' ELSE '# ' END || 'Guide to ' || p_name || CASE WHEN p_partkey % 7 = 0 THEN '.' WHEN p_partkey % 7 = 1 THEN '!' ELSE '' END || chr(10)
|| CASE WHEN p_partkey % 11 = 0 THEN '' ELSE chr(10) END
|| p_name || ' is ' || p_type || CASE p_partkey % 6 WHEN 0 THEN ' ' WHEN 1 THEN '  ' WHEN 2 THEN '   ' WHEN 3 THEN chr(9) ELSE '' END || chr(10)
|| 'and costs' || CASE WHEN p_partkey % 13 = 0 THEN chr(9) || chr(9) ELSE ' ' END || 'some money' || CASE WHEN p_partkey % 8 = 0 THEN ' at https://example.com/p' || p_partkey ELSE '' END || chr(10)
|| chr(10) || CASE p_partkey % 4 WHEN 0 THEN chr(10) WHEN 1 THEN chr(10) || chr(10) ELSE '' END
|| CASE p_partkey % 9 WHEN 0 THEN '####' WHEN 1 THEN '#' WHEN 2 THEN ' ##' ELSE '##' END || CASE p_partkey % 10 WHEN 0 THEN '' WHEN 1 THEN '   ' ELSE ' ' END || 'Brand ' || p_brand || CASE WHEN p_partkey % 14 = 0 THEN ':' ELSE '' END || chr(10)
|| CASE WHEN p_partkey % 3 = 0 THEN 'Right here.' || chr(10) ELSE '' END || chr(10)
|| '# Last ' || CASE WHEN p_partkey % 12 = 0 THEN p_name || ' ' || p_type || ' ' || p_name || ' ' || p_type || ' and much more of it' ELSE 'part' END || chr(10) || chr(10)
|| 'The end of ' || p_name || CASE p_partkey % 5 WHEN 0 THEN '' WHEN 1 THEN chr(10) || chr(10) WHEN 2 THEN chr(10) || ' ' ELSE chr(10) END"""
RULES = (
    "md/no-trailing-spaces", "md/no-hard-tabs", "md/no-multiple-blanks", "md/heading-increment", "md/single-h1", "md/no-trailing-punctuation", "md/no-missing-space-atx", "md/no-multiple-space-atx", "md/heading-start-left",
    "md/blanks-around-headings", "md/no-bare-urls", "md/max-heading-length", "md/single-trailing-newline",
)


def lines_sql(documents: str) -> str:
    """Lines and headings of ``documents(doc_id, text)``."""
    return f"""d AS ({documents}), l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n, len(string_split(text, chr(10))) AS total FROM d),
x AS (SELECT *, trim(line, ' ' || chr(9)) = '' AS blank, lag(line) OVER w AS before, lead(line) OVER w AS after FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY n)),
h AS (SELECT doc_id, n, line, before, after, length(regexp_extract(line, '^ {{0,3}}(#+)', 1)) AS level, regexp_extract(line, '^ {{0,3}}#{{1,6}}[ \\t]+(.*?)[ \\t]*$', 1) AS title FROM x WHERE regexp_matches(line, '^ {{0,3}}#{{1,6}}([ \\t]|$)'))"""


#: Per rule: what is found, as rows (doc_id, line, col).
FOUND = {
    "md/no-trailing-spaces": """SELECT doc_id, n, length(regexp_replace(line, '[ \\t]+$', '')) + 1 FROM x WHERE regexp_matches(line, '[ \\t]+$') AND (blank OR NOT (regexp_extract(line, '[ \\t]+$') = '  ' AND trim(coalesce(after, ''), ' ' || chr(9)) <> ''))""",
    "md/no-hard-tabs": "SELECT doc_id, n, strpos(line, chr(9)) FROM x WHERE strpos(line, chr(9)) > 0",
    "md/no-multiple-blanks": """SELECT doc_id, n, 1 FROM (SELECT *, lag(blank, 2) OVER w AS two, lag(blank) OVER w AS one, count(*) FILTER (NOT blank) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS rest FROM x WINDOW w AS (PARTITION BY doc_id ORDER BY n)) WHERE blank AND one AND NOT coalesce(two, false) AND rest > 0""",
    "md/heading-increment": "SELECT doc_id, n, indent + 1 FROM (SELECT doc_id, n, level, lag(level) OVER (PARTITION BY doc_id ORDER BY n) AS last, 0 AS indent FROM h) WHERE level > last + 1",
    "md/single-h1": "SELECT doc_id, n, 1 FROM (SELECT doc_id, n, row_number() OVER (PARTITION BY doc_id ORDER BY n) AS k FROM h WHERE level = 1) WHERE k > 1",
    "md/no-trailing-punctuation": "SELECT doc_id, n, 1 FROM h WHERE regexp_matches(title, '[.,;:!]$')",
    "md/no-missing-space-atx": "SELECT doc_id, n, 1 FROM x WHERE regexp_matches(line, '^#{1,6}[^#\\s0-9]')",
    "md/no-multiple-space-atx": "SELECT doc_id, n, length(regexp_extract(line, '^ {0,3}#{1,6}')) + 1 FROM h WHERE regexp_matches(line, '^ {0,3}#{1,6}[ \\t]{2,}\\S')",
    "md/heading-start-left": "SELECT doc_id, n, 1 FROM h WHERE line LIKE ' %'",
    "md/blanks-around-headings": "SELECT doc_id, n, 1 FROM h WHERE trim(coalesce(before, ''), ' ' || chr(9)) <> '' UNION ALL SELECT doc_id, n, 1 FROM h WHERE trim(coalesce(after, ''), ' ' || chr(9)) <> ''",
    "md/no-bare-urls": "SELECT doc_id, n, strpos(line, 'https://') FROM x WHERE strpos(line, 'https://') > 0",
    "md/max-heading-length": "SELECT doc_id, n, 1 FROM h WHERE length(title) > 60",
    "md/single-trailing-newline": """SELECT doc_id, (length(body) - length(replace(body, chr(10), '')) + 1), length(regexp_extract(body, '[^\\n]*$')) + 1 FROM (SELECT doc_id, text, regexp_replace(text, '\\s+$', '') AS body FROM d) WHERE body <> '' AND substr(text, length(body) + 1) <> chr(10)""",
}


def found_sql(documents: str, rules) -> str:
    parts = " UNION ALL ".join(f"SELECT doc_id, '{r}' AS rule, line, col FROM ({FOUND[r]}) AS t(doc_id, line, col)" for r in rules)
    return f"WITH {lines_sql(documents)} SELECT doc_id, rule, line::INTEGER AS line, col::INTEGER AS col FROM ({parts})"


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.lit("docs/page.md").alias("path"), F.lit("markdown").alias("kind"), F.lit("").alias("code_lang"), F.expr(PAGE).alias("text"))


@query("pages_line_rules", found_sql(f"SELECT p_partkey AS doc_id, {PAGE} AS text FROM part", RULES))
def pages_line_rules(spark, sf_dir):
    """Thirteen structure rules over a page for each part."""
    return lint(pages(spark, sf_dir), list(RULES)).select("doc_id", "rule", "line", "col")


DOCUMENT_RULES = ("md/no-trailing-spaces", "md/no-hard-tabs", "md/no-multiple-blanks", "md/single-trailing-newline")


@query("documents_line_rules", found_sql("SELECT doc_id, text FROM documents WHERE text IS NOT NULL", DOCUMENT_RULES))
def documents_line_rules(spark, sf_dir):
    """Rules on lines over the whole texts of the documents table."""
    return lint(as_documents(spark, sf_dir), list(DOCUMENT_RULES)).select("doc_id", "rule", "line", "col")


@query("pages_fixed", "SELECT p_partkey AS doc_id, 0::BIGINT AS left_over FROM part")
def pages_fixed(spark, sf_dir):
    """Fixable findings of each page after its fixes have been applied twice: there are none."""
    from .reports import corrected

    rules = ["md/no-trailing-spaces", "md/no-missing-space-atx", "md/no-multiple-space-atx", "md/heading-start-left", "md/single-trailing-newline", "md/no-multiple-blanks"]
    now = pages(spark, sf_dir)
    for _ in range(2):
        now = corrected(now, lint(now, rules))
    left = lint(now, rules).groupBy("doc_id").agg(F.count(F.lit(1)).alias("left_over"))
    return now.select("doc_id").join(left, "doc_id", "left").select("doc_id", F.coalesce("left_over", F.lit(0).cast("long")).alias("left_over"))


def _repeated_sql() -> str:
    """Words and what stands between them, in turn; of a run of equal words the first, third, fifth ... is reported where another follows."""
    twice = ", ".join(f"'{w}'" for w in sorted(TWICE))
    return f"""WITH t AS (SELECT doc_id, regexp_extract_all(text, '\\p{{L}}+|\\P{{L}}+') AS t FROM documents WHERE text IS NOT NULL),
x AS (SELECT doc_id, unnest(t) AS tok, generate_subscripts(t, 1) AS k FROM t),
p AS (SELECT *, sum(length(tok)) OVER w - length(tok) AS at, lag(tok) OVER w AS before, lead(tok) OVER w AS gap, lead(tok, 2) OVER w AS after, lead(tok, 3) OVER w AS rest FROM x WINDOW w AS (PARTITION BY doc_id ORDER BY k)),
m AS (SELECT *, regexp_matches(tok, '^\\p{{L}}') AND lower(tok) = lower(after) AND regexp_full_match(gap, '\\s+') AND NOT contains(gap, chr(10) || chr(10)) AND NOT regexp_matches(coalesce(before, ' '), '[\\d_-]$') AND NOT regexp_matches(coalesce(rest, ' '), '^[\\d_''’-]') AND lower(tok) NOT IN ({twice}) AS hit FROM p),
w AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS n FROM m WHERE regexp_matches(tok, '^\\p{{L}}')),
i AS (SELECT *, n - row_number() OVER (PARTITION BY doc_id, hit ORDER BY n) AS island FROM w),
f AS (SELECT *, row_number() OVER (PARTITION BY doc_id, island ORDER BY n) AS place FROM i WHERE hit)
SELECT f.doc_id, (length(b) - length(replace(b, chr(10), '')) + 1)::INTEGER AS line, (length(regexp_extract(b, '[^\\n]*$')) + 1)::INTEGER AS col, tok || gap || after AS text
FROM (SELECT f.*, substr(d.text, 1, f.at::BIGINT) AS b FROM f JOIN documents d ON d.doc_id = f.doc_id) AS f WHERE place % 2 = 1"""


@query("documents_repeated_words", _repeated_sql())
def documents_repeated_words(spark, sf_dir):
    """A grammar rule over the whole texts of the documents table."""
    return lint(as_documents(spark, sf_dir), ["grammar/RepeatedWords"]).select("doc_id", "line", "col", "text")
