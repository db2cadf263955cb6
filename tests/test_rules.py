"""Each rule on its marked examples, and invariants that hold for any text."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from inkwell import catalogue
from inkwell.operators import all_rules
from inkwell.operators.lint import Positions
from inkwell.operators.markdown import Document
from inkwell.operators.registry import Context, run
from inkwell.plans.engine import applied
from inkwell.sources.plants import corpus, unmarked

CASES = [(rule, e, config, kind) for rule, (examples, config, kind) in catalogue.examples().items() for e in examples]


@pytest.mark.parametrize(("rule", "example", "config", "kind"), CASES)
def test_example(rule, example, config, kind):
    text, spans = unmarked(example)
    assert sorted((f.start, f.end) for _, f in run([rule], Context(text, config=config, **kind))) == spans


def test_every_rule_has_examples():
    assert set(all_rules()) == set(catalogue.examples())


def test_examples_go_both_ways():
    for rule, (examples, _, _) in catalogue.examples().items():
        assert any("⟦" in e for e in examples) and any("⟦" not in e for e in examples), rule


PIECES = ["# A", "## B #", "- x", "1. y", "> q", "```sh", "```", "| a | b |", "| - | - |", "[a](b)", "![](c)", "*e*", "**s**", "`c`", "<b>", "[x]: u", "[^1]", "é ü 漢字", "\t", "    code", "---", "The the end.", "https://a.b/c", "", " ", "'", '"', "\\", "“q”", "msgid \"\"", "// x", "/* y", '"""']


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=14).map("\n".join), st.sampled_from([("markdown", ""), ("gettext", ""), ("code", "rust"), ("code", "python"), ("code", "nix"), ("code", "php")]))
def test_findings_lie_in_the_text(text, kind):
    where = Positions(text)
    for _, f in run(list(all_rules()), Context(text, kind=kind[0], code_lang=kind[1])):
        assert 0 <= f.start <= f.end <= len(text)
        assert text.encode()[where.byte(f.start) : where.byte(f.end)].decode() == text[f.start : f.end]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=14).map("\n".join))
def test_segments_are_blanked_in_place(text):
    for s in Document(text).segments():
        for a, b in zip(s.text, text[s.start : s.start + len(s.text)], strict=True):
            assert a == b or a == " "


def test_fixes():
    assert applied("abcdef", [(1, 2, "X"), (1, 3, "Y"), (4, 4, "+")]) == "aXcd+ef"
    assert applied("aéb", [(2, 3, "!")]) == "aéb"
    assert applied("ab", [(0, 9, "x")]) == "ab"
    assert applied("ab", [(1, 1, "x"), (1, 1, "x"), (1, 1, "y")]) == "axyb"


def test_documents_of_a_rule_are_dealt_out(spark, sf_dir, tmp_path):
    """The parts lie in one small split, the texts made of them do not."""
    spark.read.parquet(f"{sf_dir}/part.parquet").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    made = corpus(spark, str(tmp_path), ["Some ⟦text⟧.\n", "Other.\n"])
    assert made.rdd.getNumPartitions() >= 2 * spark.sparkContext.defaultParallelism
    assert made.count() == spark.read.parquet(f"{sf_dir}/part.parquet").count()
