"""What leaves a run: reports with source lines, SARIF files, corrected documents, the exit status, the vocabulary."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.lint import LEVELS, lint
from .engine import as_documents, fixed, query, table

NAMES = ("info", "warning", "error")


def level_name(severity: Column, names=NAMES) -> Column:
    return F.element_at(F.array(*map(F.lit, names)), severity + 1)


def reported(findings: DataFrame, documents: DataFrame, most: int = 3) -> DataFrame:
    """(doc_id, path, report): for each document with findings its report, in the order of places.

    A finding takes its severity, message and rule, its place, the source line with a mark under what was found, and up to ``most``
    suggestions. The lines of a text are cut once.
    """
    own = findings.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("line", "col", "rule", "severity", "message", "end_line", "end_col", "suggestions"))).alias("found"))
    met = documents.select("doc_id", "path", "text").join(own, "doc_id")

    def one(f: Column, lines: Column, path: Column) -> Column:
        line = F.rtrim(F.coalesce(F.get(lines, f["line"] - 1), F.lit("")), F.lit("\r"))
        width = F.greatest(F.lit(1), F.least(F.when(f["end_line"] == f["line"], f["end_col"]).otherwise(F.length(line) + 1) - f["col"], F.length(line) - f["col"] + 1))
        number = f["line"].cast("string")
        gap = F.repeat(F.lit(" "), F.length(number))
        before = F.regexp_replace(F.substr(line, F.lit(1), f["col"] - 1), r"[^\t]", " ")
        hints = F.slice(f["suggestions"], 1, most)
        parts = [
            F.concat(level_name(f["severity"]), F.lit(": "), f["message"], F.lit(" ["), f["rule"], F.lit("]")),
            F.concat(F.lit("  --> "), path, F.lit(":"), number, F.lit(":"), f["col"].cast("string")),
            F.concat(gap, F.lit(" |")), F.concat(number, F.lit(" | "), line), F.concat(gap, F.lit(" | "), before, F.repeat(F.lit("^"), width)),
            F.when(F.size(hints) > 0, F.concat(F.lit("  = did you mean "), F.array_join(F.transform(hints, lambda s: F.concat(F.lit('"'), s, F.lit('"'))), ", "), F.lit("?"))),
        ]
        return F.concat(F.array_join(F.array_compact(F.array(*parts)), "\n"), F.lit("\n"))

    bound = F.array(F.struct(F.split("text", "\n", -1).alias("lines"), F.col("found"), F.col("path")))
    report = F.transform(bound, lambda s: F.array_join(F.transform(s["found"], lambda f: one(f, s["lines"], s["path"])), "\n"))[0]
    return met.select("doc_id", "path", report.alias("report"))


def summary(findings: DataFrame) -> DataFrame:
    """One row: errors, warnings, infos, files, and the line that says so."""
    n = findings.agg(*[F.count_if(F.col("severity") == i).alias(f"{name}s") for i, name in enumerate(NAMES)], F.countDistinct("path").alias("files"))
    some = F.format_string("%d errors, %d warnings, %d infos in %d files", "errors", "warnings", "infos", "files")
    return n.withColumn("summary", F.when(F.col("files") == 0, "No problems found.").otherwise(some))


def sarif_files(findings: DataFrame, tool: str = "inkwell", version: str = "1", most: int = 5000) -> DataFrame:
    """(part, sarif): whole SARIF 2.1 documents of about ``most`` results each, the results of a path together in one.

    A corpus has more results than one document should hold; a viewer takes several documents of one run.
    """
    parts = F.greatest(F.lit(1), F.ceil(F.lit(findings.count()) / most).cast("int"))
    region = F.struct(
        F.col("line").alias("startLine"), F.col("col").alias("startColumn"), F.col("end_line").alias("endLine"), F.col("end_col").alias("endColumn"), F.col("b_start").alias("byteOffset"), (F.col("b_end") - F.col("b_start")).alias("byteLength"),
        F.struct("text").alias("snippet"),
    )
    where = F.array(F.struct(F.struct(F.struct(F.replace("path", F.lit("\\"), F.lit("/")).alias("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation")))
    result = F.struct(F.col("rule").alias("ruleId"), level_name(F.col("severity"), ("note", "warning", "error")).alias("level"), F.struct(F.col("message").alias("text")).alias("message"), where.alias("locations"))
    ordered = F.array_sort(F.collect_list(F.struct("path", "b_start", "b_end", "rule", result.alias("result"))))
    by = findings.withColumn("part", F.pmod(F.xxhash64("path"), parts).cast("int")).groupBy("part").agg(ordered.alias("found"), F.array_sort(F.collect_set("rule")).alias("rules"))
    driver = F.struct(F.lit(tool).alias("name"), F.lit(version).alias("version"), F.transform("rules", lambda r: F.struct(r.alias("id"))).alias("rules"))
    run = F.struct(F.struct(driver.alias("driver")).alias("tool"), F.lit("unicodeCodePoints").alias("columnKind"), F.transform("found", lambda x: x["result"]).alias("results"))
    document = F.struct(F.lit("2.1.0").alias("version"), F.lit("https://json.schemastore.org/sarif-2.1.0.json").alias("$schema"), F.array(run).alias("runs"))
    return by.select("part", F.to_json(document).alias("sarif"))


def corrected(documents: DataFrame, findings: DataFrame) -> DataFrame:
    """``documents`` with the fixes applied to their texts; those without a fix as they are."""
    new = fixed(documents, findings).withColumnRenamed("text", "fixed_text")
    joined = documents.join(new, "doc_id", "left")
    return joined.select(*[F.coalesce("fixed_text", "text").alias("text") if c == "text" else F.col(c) for c in documents.columns])


def write_corrected(documents: DataFrame, path: str, rules: list[str] | None = None, config: dict | None = None) -> DataFrame:
    """Write the corrected documents as a new dataset, which appears whole or not at all, and return what is found in it now."""
    corrected(documents, lint(documents, rules, config, settle=True)).write.parquet(path)
    again = documents.sparkSession.read.parquet(path)
    return lint(again, rules, config, settle=True)


def exit_status(findings: Callable[[], DataFrame], fail_on: str = "warning") -> int:
    """1 when a finding is at least ``fail_on``, else 0; 2 when the run itself fails."""
    try:
        least = LEVELS[fail_on]
        return int(least is not None and not findings().where(F.col("severity") >= least).limit(1).isEmpty())
    except Exception:  # noqa: BLE001  whatever it was, the status says so
        return 2


def vocabulary_text(entries: DataFrame, form: str = "table") -> DataFrame:
    """(term, line): each of ``entries(term, kind, aliases)`` as a line of a table, of JSON or of TOML, to be written in the order of terms."""
    aliases = F.array_sort(F.coalesce("aliases", F.array().cast("array<string>")))
    quoted = lambda c: F.concat(F.lit('"'), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    if form == "json":
        line = F.to_json(F.struct("term", "kind", aliases.alias("aliases")))
    elif form == "toml":
        line = F.concat(F.lit("[[vocabulary]]\nterm = "), quoted(F.col("term")), F.lit("\nkind = "), quoted(F.col("kind")), F.when(F.size(aliases) > 0, F.concat(F.lit("\naliases = ["), F.array_join(F.transform(aliases, quoted), ", "), F.lit("]"))).otherwise(""), F.lit("\n"))
    elif form == "table":
        line = F.concat_ws("\t", "term", "kind", F.array_join(aliases, ", "))
    else:
        raise ValueError("form is table, json or toml")
    return entries.select("term", line.alias("line"))


# queries


@query("report_with_source", "SELECT p_partkey AS doc_id, 'warning: no hard tab [md/x]' || chr(10) || '  --> p' || p_partkey || '.md:2:5' || chr(10) || '  |' || chr(10) || '2 | one two' || chr(10) || '  |     ^^^' || chr(10) || '  = did you mean \"2\"?' || chr(10) AS report FROM part")
def report_with_source(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    documents = p.select(F.col("p_partkey").alias("doc_id"), F.concat(F.lit("p"), "p_partkey", F.lit(".md")).alias("path"), F.concat("p_name", F.lit("\none two\nend")).alias("text"))
    found = documents.select("doc_id", F.lit(2).alias("line"), F.lit(5).alias("col"), F.lit("md/x").alias("rule"), F.lit(1).alias("severity"), F.lit("no hard tab").alias("message"), F.lit(2).alias("end_line"), F.lit(8).alias("end_col"), F.array(F.lit("2")).alias("suggestions"))
    return reported(found, documents).select("doc_id", "report")


@query("report_summary", "SELECT count(*) FILTER (p_size % 3 = 2)::BIGINT AS errors, count(*) FILTER (p_size % 3 = 1)::BIGINT AS warnings, count(*) FILTER (p_size % 3 = 0)::BIGINT AS infos, count(DISTINCT p_brand)::BIGINT AS files FROM part")
def report_summary(spark, sf_dir):
    return summary(table(spark, sf_dir, "part").select((F.col("p_size") % 3).alias("severity"), F.col("p_brand").alias("path"))).select("errors", "warnings", "infos", "files")


@query("sarif_documents")
def sarif_documents(spark, sf_dir):
    """Whole SARIF documents of one rule's findings in the documents table."""
    return sarif_files(lint(as_documents(spark, sf_dir), ["md/single-trailing-newline"], settle=True))


@query("documents_corrected", "SELECT doc_id, CASE WHEN trim(text, ' ' || chr(10)) = '' OR (text LIKE '%' || chr(10) AND text NOT LIKE '%' || chr(10) || chr(10)) THEN text ELSE rtrim(text, chr(10)) || chr(10) END AS text FROM documents WHERE text IS NOT NULL")
def documents_corrected(spark, sf_dir):
    """The documents table with its missing line ends, whole texts."""
    documents = as_documents(spark, sf_dir).where("text IS NOT NULL")
    return corrected(documents, lint(documents, ["md/single-trailing-newline"])).select("doc_id", "text")


@query("vocabulary_lines", "SELECT p_name AS term, p_name || chr(9) || 'product' || chr(9) || CASE WHEN p_partkey % 2 = 0 THEN 'a, b' ELSE '' END AS line FROM part")
def vocabulary_lines(spark, sf_dir):
    own = F.when(F.col("p_partkey") % 2 == 0, F.array(F.lit("b"), F.lit("a")))
    return vocabulary_text(table(spark, sf_dir, "part").select(F.col("p_name").alias("term"), F.lit("product").alias("kind"), own.alias("aliases")))
