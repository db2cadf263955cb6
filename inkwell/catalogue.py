"""All registered queries of the document-analysis operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .operators import all_rules
from .operators.lint import lint
from .plans import corpus, engine, line_rules, links, native, reports, runs, spelling, vocabulary  # noqa: F401
from .sources import examples_code, examples_gettext, examples_grammar, examples_prose, examples_structure, plants

Query = Callable[[SparkSession, str], DataFrame]


def query_name(rule: str) -> str:
    return rule.replace("/", "_").replace("-", "_")


def rule_query(rule: str, examples: list[str], config: dict, kind: dict) -> Query:
    """The rule over a document for each part, built from the rule's examples."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = {"gettext": "locale/catalog.po", "code": "src/main.txt", "toml": "project.toml"}.get(kind.get("kind", ""), "docs/page.md")
        documents = plants.corpus(spark, sf_dir, examples, kind.get("kind", "markdown"), kind.get("code_lang", ""), path)
        return lint(documents, [rule], config).select("doc_id", "line", "col", "text")

    return run


def examples() -> dict[str, tuple[list[str], dict, dict]]:
    """Rule -> (examples, options, context) of every rule that works on one document."""
    out = {}
    for module in (examples_structure, examples_prose, examples_code, examples_gettext, examples_grammar):
        for rule, own in module.EXAMPLES.items():
            out[rule] = (own, {}, {}) if isinstance(own, list) else (*own, {}, {})[:3]
    return {rule: own for rule, own in out.items() if rule in all_rules()}


QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
for _rule, (_examples, _config, _kind) in examples().items():
    QUERIES[query_name(_rule)] = rule_query(_rule, _examples, _config, _kind)
    SQL[query_name(_rule)] = plants.expected_sql(_examples)
for _module in (native, engine):  # the other modules add to the queries of engine
    QUERIES |= _module.QUERIES
    SQL |= _module.SQL
FLAGSHIP = "lint_documents"
