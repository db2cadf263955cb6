"""Files to documents, configuration, and the watched folder."""

import json
import tomllib

import pytest

from inkwell.operators import tables
from inkwell.operators.lint import lint
from inkwell.operators.registry import Context
from inkwell.operators.settle import directives
from inkwell.plans.engine import fixed, scored, suppressions, unsuppressed, without_overlaps
from inkwell.plans import reports
from inkwell.plans.links import navigation, orphan_pages
from inkwell.sources.files import Config, discover, find_config, glob_regex, ignore_rules, not_ignored, read_files
from inkwell.streaming.watch import State, to_recheck, watch


def docs(spark, **texts):
    return spark.createDataFrame([(i, p.replace("__", "/") + ".md", "markdown", "", t) for i, (p, t) in enumerate(texts.items())], "doc_id long, path string, kind string, code_lang string, text string")


def test_read_and_discover(spark, tmp_path):
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs/a.md").write_text("# A\n")
    (tmp_path / "docs/b.bin").write_bytes(b"x")
    (tmp_path / "c.rs").write_text("// @generated\n")
    (tmp_path / "d.rs").write_text("fn a() {}\n")
    (tmp_path / "e.md").write_bytes(b"\xff\xfe")
    (tmp_path / "f.md").write_text("a\0b")
    (tmp_path / "Makefile").write_text("all:\n")
    files = read_files(spark, str(tmp_path))
    assert sorted(r["path"] for r in files.collect()) == ["Makefile", "c.rs", "d.rs", "docs/a.md", "docs/b.bin", "f.md"]
    assert sorted((r["path"], r["kind"], r["code_lang"]) for r in discover(files).collect()) == [("Makefile", "code", "shell"), ("d.rs", "code", "rust"), ("docs/a.md", "markdown", "")]
    assert [r["path"] for r in discover(files, ignore=["*.rs", "Makefile"]).collect()] == ["docs/a.md"]
    assert [r["path"] for r in discover(files, include=["*.rs"]).collect()] == ["d.rs"]


@pytest.mark.parametrize(("pattern", "path", "hit"), [("*.md", "a/b.md", True), ("/a", "a/b", True), ("/a", "c/a", False), ("a/**/c", "a/x/y/c", True), ("build/", "x/build/y", True), ("a?c", "abc", True), ("a?c", "a/c", False)])
def test_globs(pattern, path, hit):
    import re

    assert bool(re.search(glob_regex(pattern), path)) == hit


def test_config_is_strict():
    assert Config.read('fail_on = "error"\n[rules]\n"md/*" = "off"\n').rules == {"md/*": "off"}
    for bad in ('colour = "red"', 'fail_on = "never"', '[[overrides]]\npaths = ["a"]\nfoo = 1'):
        with pytest.raises(ValueError):
            Config.read(bad)


def test_suppressions():
    text = "<!-- lint-disable md/a, md/b -- why -->\nx\n<!-- lint-enable md/a -->\ny <!-- lint-disable-line -->\nz"
    off, where = directives(Context(text))
    assert sorted((o.start, o.end, o.rules, o.kept) for o in off) == [(39, 42, ("md/a", "md/b"), ()), (42, 98, ("md/b",), ("md/a",)), (68, 96, ("*",), ())]
    assert [text[a:b] for a, b in where] == ["<!-- lint-disable md/a, md/b -- why -->", "<!-- lint-enable md/a -->", "<!-- lint-disable-line -->"]
    assert directives(Context("// lint-disable-line x\nlet a = 1;\n", kind="code", code_lang="rust"))[0][0].covers("x")
    every = directives(Context("<!-- lint-disable -->\na\n<!-- lint-enable md/x -->\nb\n"))[0]
    assert not every[-1].covers("md/x") and every[-1].covers("md/y") and every[0].covers("md/x")


def test_suppression_ranges(spark):
    d = docs(spark, a="<!-- lint-disable md -->\na\tb\n", b="a\tb\n", c="é <!-- lint-disable-next-line md/no-hard-tabs -->\na\tb\nc\td\n")
    found = unsuppressed(lint(d, ["md/no-hard-tabs"]), suppressions(d)).collect()
    assert sorted((r["doc_id"], r["line"]) for r in found) == [(1, 1), (2, 3)]


def test_overlaps_and_scores(spark):
    rows = [(1, 0, 5, "a"), (1, 0, 9, "b"), (1, 8, 12, "c"), (1, 9, 12, "d"), (2, 3, 4, "e")]
    kept = without_overlaps(spark.createDataFrame(rows, "doc_id long, b_start long, b_end long, rule string")).collect()
    assert sorted((r["doc_id"], r["rule"]) for r in kept) == [(1, "b"), (1, "d"), (2, "e")]
    spans = "path string, line int, col int, end_col int"
    labels = spark.createDataFrame([("a", 1, 1, 4), ("a", 2, 1, 4)], spans)
    findings = spark.createDataFrame([("a", 1, 3, 6), ("a", 1, 2, 3), ("b", 1, 1, 2)], spans)
    assert tuple(scored(labels, findings).first())[:3] == (1, 2, 1)


def test_fixes_settle(spark):
    d = docs(spark, a="#Title\ntext  \t\n* a\n- b\n\n\n\nend", b="fine\n")
    rules = ["md/no-missing-space-atx", "md/list-marker", "md/no-trailing-spaces", "md/no-multiple-blanks", "md/single-trailing-newline"]
    out = {r["doc_id"]: r["text"] for r in fixed(d, lint(d, rules)).collect()}
    assert out == {0: "# Title\ntext\n* a\n* b\n\nend\n"}


def test_tables(spark):
    d = docs(spark, docs__a="# One two\n\n[b](b.md#X) ![i](/img/i.png) <https://e.com>\n\n{{#include c.txt:2}}\n", docs__b="## X\n\n<a id=\"Y\"></a>\n")
    links = {r["dest"]: (r["target"], r["fragment"]) for r in tables.links(d).collect()}
    assert links == {"b.md#X": ("docs/b.md", "x"), "/img/i.png": ("img/i.png", None), "https://e.com": (None, None)}
    assert {(r["doc_id"], r["anchor"]) for r in tables.anchors(d).collect()} == {(0, "one-two"), (1, "x"), (1, "y")}
    assert [(r["file"], r["candidates"]) for r in tables.includes(d).collect()] == [("c.txt", ["docs/c.txt", "c.txt", "_includes/c.txt"])]
    empty = d.where("doc_id > 9")
    for make in (tables.headings, tables.links, tables.segments, tables.tokens, tables.comments, tables.po_entries, tables.regions, tables.code_blocks, tables.list_items, tables.sentences):
        assert make(empty).count() == 0 and make(d).columns[0] == "doc_id"


def test_recheck(spark):
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("d", "a"), ("e", None)], "path string, target string")
    assert {r["path"] for r in to_recheck(spark.createDataFrame([("a",)], "path string"), links).collect()} == {"a", "b", "d"}


def test_watch(spark, tmp_path):
    state = State(spark, str(tmp_path / "state"), ["md/no-hard-tabs"])
    first = docs(spark, a="a\tb\n", b="c\td\n").selectExpr("*", "0L AS version")
    first.write.parquet(str(tmp_path / "in"))
    watch(spark, str(tmp_path / "in"), state, str(tmp_path / "cp"), once=True).awaitTermination()
    assert sorted(r["path"] for r in state.now["findings"].collect()) == ["a.md", "b.md"]
    docs(spark, a="a b\n").selectExpr("*", "1L AS version").write.mode("append").parquet(str(tmp_path / "in"))
    watch(spark, str(tmp_path / "in"), state, str(tmp_path / "cp"), once=True).awaitTermination()
    assert sorted(r["path"] for r in state.now["findings"].collect()) == ["b.md"]
    assert state.now["documents"].count() == 2
    state.batch(first.where("false"), 0)  # a batch that comes again
    assert state.now["documents"].count() == 2
    # a new driver goes on where the last one ended
    later = State(spark, str(tmp_path / "state"), ["md/no-hard-tabs"])
    assert later.done == 1 and sorted(r["path"] for r in later.now["findings"].collect()) == ["b.md"]
    docs(spark, a="x\ty\n").selectExpr("*", "2L AS version").write.mode("append").parquet(str(tmp_path / "in"))
    watch(spark, str(tmp_path / "in"), later, str(tmp_path / "cp"), once=True).awaitTermination()
    assert sorted(r["path"] for r in later.now["findings"].collect()) == ["a.md", "b.md"] and later.now["documents"].count() == 2
    later.reload(["md/single-trailing-newline"])
    assert later.now["findings"].count() == 0 and State(spark, str(tmp_path / "state")).now["documents"].count() == 2


def test_language_column(spark):
    d = docs(spark, a="Wir sehen das Hund.\n", b="Wir sehen das Hund.\n").selectExpr("*", "CASE WHEN doc_id = 0 THEN 'de' END AS language")
    assert [(r["doc_id"], r["rule"]) for r in lint(d, ["grammar/de/ArticleAgreement"]).collect()] == [(0, "grammar/de/ArticleAgreement")]


def test_catalog_prose(spark):
    text = 'msgid ""\nmsgstr "Language: en\\n"\n\nmsgid "It is a apple"\nmsgstr ""\n\nmsgid "key.name"\nmsgstr ""\n'
    d = spark.createDataFrame([(0, "en.po", "gettext", "", text)], "doc_id long, path string, kind string, code_lang string, text string")
    assert [(r["line"], r["col"], r["text"]) for r in lint(d, ["grammar/AnA"]).collect()] == [(4, 14, "a")]


def test_nested_ignore_files(spark):
    """The deepest folder with a pattern that matches decides, in it the strongest file, in that the last pattern."""
    texts = {
        ".gitignore": "*.log\n/build/\n# no\n\n!keep.log", "docs/.gitignore": "!*.log\nsecret.md", "docs/deep/.ignore": "secret.md", "docs/deep/.gitignore": "!secret.md", "a.log": "", "keep.log": "", "build/x.md": "", "lib/build/x.md": "",
        "docs/b.log": "", "docs/secret.md": "", "docs/deep/secret.md": "", "docs/deep/c.md": "", "docs/deeper/secret.md": "",
    }
    files = spark.createDataFrame(list(texts.items()), "path string, text string")
    left = {r["path"] for r in not_ignored(files, ignore_rules(files)).collect() if "ignore" not in r["path"]}
    assert left == {"keep.log", "lib/build/x.md", "docs/b.log", "docs/deep/c.md"}


def test_configuration_is_found_upward(spark, tmp_path):
    (tmp_path / "a/b").mkdir(parents=True)
    (tmp_path / "inkwell.toml").write_text('fail_on = "error"\n')
    (tmp_path / "a/b/x.md").write_text("x")
    where, config = find_config(spark, str(tmp_path / "a/b/x.md"))
    assert config.fail_on == "error" and where.endswith(tmp_path.name)
    (tmp_path / "a/inkwell.toml").write_text('language = "sv"\n')
    assert find_config(spark, str(tmp_path / "a/b"))[1].language == "sv" and find_config(spark, str(tmp_path / "a/b"), "none.toml") is None


def test_navigation(spark):
    yml = "site_name: x\nnav:\n  - Home: index.md\n  - Guide:\n    - guide/a.md\n    - 'B': \"guide/b.md\"\ntheme: y\n  - no.md\n"
    files = spark.createDataFrame([("mkdocs.yml", yml), ("book/SUMMARY.md", "- [One](./one.md)\n- [Two](x/two.md#a)\n"), ("sub/mkdocs.yml", "docs_dir: pages\nnav:\n- c.md\n")], "path string, text string")
    assert {r["path"] for r in navigation(files).collect()} == {"docs/index.md", "docs/guide/a.md", "docs/guide/b.md", "book/one.md", "book/x/two.md", "sub/pages/c.md"}
    d = docs(spark, docs__guide__a="x\n", docs__lost="y\n")
    assert [r["path"] for r in orphan_pages(d, tables.links(d), listed=navigation(files)).collect()] == ["docs/lost.md"]


def test_line_flags_and_native_words(spark):
    d = docs(spark, a="---\nt: 1\n---\n> > q\n\n```\nx\n```\n\n| a | b |\n|---|---|\n| 1 | 2 |\n")
    flags = {r["line"]: (r["depth"], r["code"], r["front"], r["is_table"], r["blank"]) for r in tables.line_flags(d).collect()}
    assert flags[2][2] and flags[4][0] == 2 and flags[7][1] and flags[10][3] and flags[5][4] and not flags[4][1]
    text = "Über EU:n t.ex and/or foo_bar a::b src/lib/x.py www.x.org me@x.org Ctrl+Q it's 12 re-do /usr/bin 3D.\n"
    words = [r["word"] for r in tables.native_tokens(docs(spark, a=text)).orderBy("b_start").collect()]
    assert words == ["Über", "EU:n", "t.ex", "and", "or", "it's", "re-do", "3D"]


def test_reports(spark, tmp_path):
    d = docs(spark, a="#Title\n\nx\ty\n", b="fine\n")
    found = lint(d, ["md/no-hard-tabs", "md/no-missing-space-atx"], settle=True)
    report = reports.reported(found, d).collect()
    assert len(report) == 1 and "a.md:3:2" in report[0]["report"] and "3 | x\ty" in report[0]["report"] and "  |  ^" in report[0]["report"]
    assert reports.summary(found).first()["summary"] == "0 errors, 2 warnings, 0 infos in 1 files" and reports.summary(found.where("false")).first()["summary"] == "No problems found."
    one = json.loads(reports.sarif_files(found).first()["sarif"])
    run = one["runs"][0]
    assert one["version"] == "2.1.0" and [r["id"] for r in run["tool"]["driver"]["rules"]] == ["md/no-hard-tabs", "md/no-missing-space-atx"] and [r["ruleId"] for r in run["results"]] == ["md/no-missing-space-atx", "md/no-hard-tabs"]
    assert run["results"][1]["locations"][0]["physicalLocation"]["region"]["snippet"]["text"] == "\t"
    left = reports.write_corrected(d, str(tmp_path / "out"), ["md/no-missing-space-atx"])
    assert left.count() == 0 and {r["text"] for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {"# Title\n\nx\ty\n", "fine\n"}
    assert [reports.exit_status(lambda: found, x) for x in ("info", "warning", "error", "off", "never")] == [1, 1, 0, 0, 2]
    entries = spark.createDataFrame([("A \"x\"", "product", ["c", "b"]), ("B", "person", None)], "term string, kind string, aliases array<string>")
    assert tomllib.loads("".join(r["line"] for r in reports.vocabulary_text(entries, "toml").collect()))["vocabulary"][0] == {"term": 'A "x"', "kind": "product", "aliases": ["b", "c"]}
    assert json.loads(reports.vocabulary_text(entries, "json").first()["line"])["aliases"] == ["b", "c"]
