"""Functions on words and sentences, the parsers, and the registered SQL functions."""

import re
import time

import pytest
from hypothesis import given
from hypothesis import strategies as st

from inkwell.functions.sentences import _before, like, sentences, words
from inkwell.functions.words import _syllables, edit_distance, near_misses, recased, syllables
from inkwell.operators.catalogs import parse, placeholders, plural_fault, plural_function
from inkwell.operators.comments import lexed
from inkwell.operators.markdown import Document, slug


@given(st.text("aB. \n_é1-", max_size=9), st.integers(0, 9))
def test_word_before_a_stop(text, start):
    start = min(start, len(text))
    assert _before(text, start, len(text)) == re.search(r"([\w.]*)$", text[start:])[1]


def test_sentences_in_proportion_to_the_text():
    text = "x" * 60_000 + " end. And more."
    began = time.process_time()
    assert len(list(sentences(text))) == 2 and time.process_time() - began < 1


def test_syllables_once_a_distinct_word():
    before = _syllables.cache_info().misses
    assert sum(syllables(w) for w in ["administrative", "boats"] * 500) == 3000 and _syllables.cache_info().misses <= before + 2
    assert syllables("administrative" * 9) == 9 * syllables("administrative")


def distance_by_force(a, b):
    d = [[max(i, j) if not min(i, j) else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


@given(st.text("abc", max_size=6), st.text("abc", max_size=6), st.integers(0, 6))
def test_edit_distance(a, b, most):
    true = distance_by_force(a, b)
    assert (edit_distance(a, b, most) <= most) == (true <= most)
    if true <= most:
        assert edit_distance(a, b, most) == true


def test_words():
    assert near_misses("pyhton", {"python", "perl", "pythons"}) == ["python", "pythons"]
    assert [syllables(w) for w in ("the", "house", "table", "banana", "jumped", "wanted", "boxes", "idea")] == [1, 1, 2, 3, 1, 2, 2, 2]
    assert recased("the big House of GitHub 2x", "title") == "The Big House of GitHub 2x"
    assert recased("The Big House", "sentence") == "The big house"
    assert [like(o, "use") for o in ("utilize", "Utilize", "UTILIZE")] == ["use", "Use", "USE"]
    assert [w[0] for w in words("don't re-do it_now 3rd")] == ["don't", "re-do", "it", "now", "3rd"]


def test_sentences():
    text = "See e.g. this. J. Smith came! Why?\n\nNew \"one.\" End"
    assert [text[a:b] for a, b in sentences(text)] == ["See e.g. this.", "J. Smith came!", "Why?", 'New "one."', "End"]
    assert list(sentences("")) == list(sentences(" \n ")) == list(sentences("...")) == []


@given(st.text(st.sampled_from("ab .!?\n\"e.g"), max_size=40))
def test_sentences_cover_words(text):
    spans = list(sentences(text))
    assert all(a < b for a, b in spans) and all(x[1] <= y[0] for x, y in zip(spans, spans[1:]))
    inside = "".join(text[a:b] for a, b in spans)
    assert [c for c in inside if c.isalnum()] == [c for c in text if c.isalnum()]


def test_slugs():
    assert slug("Hello, World & Co_1") == "hello-world--co_1"
    assert [h.anchor for h in Document("# A\n\n# A\n\n# A-1\n\n# B {#a}\n").headings] == ["a", "a-1", "a-1-1", "a"]


def test_markdown():
    d = Document("---\ntitle: x\n---\n# One\n\nTwo\n---\n\n- a\n  1. b\n\n```py x\n# no\n```\n\n> # Three\n\n[l][r] ![i](u \"t\") `a [b](c)` https://e.com/x.\n\n[r]: dest\n")
    assert [(h.level, h.text, h.setext) for h in d.headings] == [(1, "One", False), (2, "Two", True), (1, "Three", False)]
    assert [(i.depth, i.marker) for i in d.items] == [(0, "-"), (1, "1.")]
    assert [(c.lang, c.fenced) for c in d.code] == [("py", True)]
    assert [(x.kind, x.image, x.dest) for x in d.links] == [("reference", False, "dest"), ("inline", True, "u"), ("bare", False, "https://e.com/x")]


def test_comments():
    assert [k for k, _, _ in lexed('// a\nlet s = "// no"; /* b /* c */ d */ /// e\n', "rust")] == ["line", "block", "doc"]
    assert [k for k, _, _ in lexed("#!/bin/sh\n# a\necho '# no' \"# no\" ${x#y}\n", "shell")] == ["line"]
    assert [k for k, _, _ in lexed('"""Doc."""\nx = """no"""\ndef f():\n    """Doc."""  # c\n', "python")] == ["docstring", "docstring", "line"]


def test_plural_forms():
    n, f = plural_function("nplurals=3; plural=n%10==1 && n%100!=11 ? 0 : n%10>=2 && n%10<=4 && (n%100<10 || n%100>=20) ? 1 : 2;")
    assert n == 3 and [f(x) for x in (1, 2, 5, 11, 21, 22, 112)] == [0, 1, 2, 2, 0, 1, 2]
    assert plural_fault("nplurals=2; plural=n != 1;") is None
    for bad in ("nplurals=2; plural=n", "nplurals=2; plural=n//2", "nplurals=2; plural=1/n", "plural=n", "nplurals=1; plural=(n"):
        assert plural_fault(bad)


def test_catalogs():
    c = parse('#, c-format\nmsgctxt "x"\nmsgid "a\\n"\n"b"\nmsgstr "\\x41"\n\n#~ msgid "o"\n#~ msgstr "p"\n')
    assert [(e.ctxt and e.ctxt.value, e.id.value, e.strs[0].value, e.obsolete, sorted(e.flags)) for e in c.entries] == [("x", "a\nb", "A", False, ["c-format"]), (None, "o", "p", True, [])]
    assert c.errors == []
    assert placeholders("%s of %2$d %% {n}", {"c"}) == {"%1$s": 1, "%2$d": 1}
    assert placeholders("{} {x!r} {{no}}", {"brace"}) == {"{0}": 1, "{x}": 1}


@given(st.text(st.sampled_from('msgid str"\\#~,\n[0]a '), max_size=80))
def test_catalog_parser_takes_anything(text):
    c = parse(text)
    assert all(0 <= a <= b for a, b, _ in c.errors)


def test_sql_functions(spark):
    pytest.importorskip("pandas")
    from inkwell.functions.register import register

    register(spark)
    row = spark.sql("SELECT slugify('A b') AS s, syllables('banana') AS y, flesch_kincaid('A cat sat. A dog ran.') AS g").first()
    assert row["s"] == "a-b" and row["y"] == 3 and abs(row["g"] - (0.39 * 3 + 11.8 - 15.59)) < 1e-9
    assert [r["kind"] for r in spark.sql("SELECT kind FROM md_segments('# A\n\ntext')").collect()] == ["heading", "paragraph"]
