"""Diagrams that are well formed and diagrams that are not."""

import pytest
from hypothesis import given
from hypothesis import strategies as st

from inkwell.functions.diagrams import D2, d2_faults, mermaid_faults

GOOD = [
    "", "a", "a -> b", "a -> b -> c: label", "a <-> b", "a -- b", "x-y -> z_1", "a.b.c: text", "a: {\n  b: {\n    c\n  }\n}", "a: label {shape: circle}", '"quoted key": \'v\'', "# only a comment", "a # comment\nb", '"""\nblock\ncomment\n"""\na',
    "a: |md\n  # Title\n  text } with { braces\n|", "a: |`js x || y `|", "(a -> b)[0].style.opacity: 0.4", "(a -> b)[*]: {style.stroke: red}", "vars: {\n  x: 1\n}\na: ${x}", "...@other", "a: @imported", "*.style.fill: red", "a; b; c -> d",
    "classes: {\n  big: {width: 200}\n}\na.class: big", "direction: right", "a.style: {\n  opacity: 1\n  shadow: true\n}", "a: [1; 2; \"]\"]", "a.shape: ${s}", "layers: {\n  one: {a}\n}", "a\\.b: c", "a.style.text-transform: uppercase", "a.width: 100", "a: null",
    "users: {\n  shape: sql_table\n  id: int {constraint: primary_key}\n}", "a -> b: {\n  source-arrowhead: {\n    shape: diamond\n  }\n}", "grid-rows: 2", "a: café {near: top-center}", "a: x:y", "a: it's", "&shape: circle",
]
BAD = [
    ("a: {", "not closed"), ("a }", "nothing"), ("}", "nothing"), ("a -> ", "no target"), ("-> b", "no source"), ("a: 'x", "quote"), ('"x', "quote"), ("a: |md\nx", "block string"), ("a: [1; 2", "bracket"), ("(a -> b", "parenthesis"), ("(a -> b)[x]", "index"),
    ("a..b", "missing"), ("a: ${x", "variable"), (": x", "unexpected"), ('"""\nx', "comment"), ("a: {b: {c}", "not closed"), ("]", "unexpected"), ("a -> b -> ", "no target"),
]
WRONG = [
    ("a.shape: circl", "circl"), ("a: {shape: blob}", "blob"), ("a.style.filll: red", "filll"), ("a.style: {colour: red}", "colour"), ("direction: upp", "upp"), ("a.style.opacity: 3", "3"), ("a.style.opacity: x", "x"), ("a.style.shadow: yes", "yes"),
    ("a.style.stroke-width: 99", "99"), ("a.style.font-size: 2", "2"), ("a: {style.bold: 1}", "1"), ("a.class: ghost", "ghost"), ("a.style: red", "red"), ("a.width: -5", "-5"), ("(a -> b)[0].style.opacity: 7", "7"), ("a.style.fill-pattern: dotty", "dotty"), ("layers: x", "x"),
    ("a.style.border-radius: -1", "-1"), ("grid-rows: 0", "0"), ("a: {b: {style: {opacity: 2}}}", "2"),
]


@pytest.mark.parametrize("text", GOOD)
def test_good(text):
    assert d2_faults(text) == []


@pytest.mark.parametrize(("text", "message"), BAD)
def test_bad(text, message):
    (fault,) = d2_faults(text)
    assert message in fault[2] and fault[1] is None and 0 <= fault[0] <= len(text)


@pytest.mark.parametrize(("text", "place"), WRONG)
def test_wrong(text, place):
    (fault,) = d2_faults(text)
    assert text[fault[0] : fault[1]] == place


@given(st.text(st.sampled_from("ab.:{}[]()|-><'\"#\n ;$*&"), max_size=40))
def test_any_text_ends(text):
    tree = D2(text)
    assert tree.fault is None or 0 <= tree.fault.at <= len(text)
    assert all(0 <= f[0] <= len(text) for f in d2_faults(text))


def test_nested_statements():
    tree = D2("a: label {\n  b -> c: x\n}\n")
    (s,) = tree.statements
    assert s.key.names == ["a"] and s.value == "label" and [[k.names for k in e.edges] for e in s.body] == [[["b"], ["c"]]] and s.body[0].value == "x"


MERMAID = {
    "sequenceDiagram": (["participant A", "A->>B: hi", "A-->>B: yes", "loop every day", "B-)A: async", "end", "Note right of A: text", "A->>+B: x", "B-x A: lost"], ["A B", "end"]),
    "pie": (["title Pets", '"Dogs" : 386', '"Cats": 85.9'], ["Dogs : 1", '"x" : y']),
    "journey": (["title My day", "section Go", "Make tea: 5: Me", "Go: 1"], ["Make tea"]),
    "gantt": (["dateFormat YYYY-MM-DD", "section A", "Task :a1, 2020-01-01, 30d"], ["Task without"]),
    "flowchart": (["A --> B", "subgraph one", "B --> C", "end"], ["end"]),
    "stateDiagram-v2": (["[*] --> Still", "Still --> [*]", "state Moving {", "}", "Still : text", "note right of Still", "free text", "end note"], ["Still ??? Moving"]),
    "erDiagram": (["CUSTOMER ||--o{ ORDER : places", "ORDER {", "string id PK", "}"], ["?"]),
}


@pytest.mark.parametrize("kind", MERMAID)
def test_mermaid(kind):
    good, bad = MERMAID[kind]
    assert mermaid_faults("\n".join([kind, *good]), kind, 0) == []
    for line in bad:
        text = "\n".join([kind, *good, line])
        assert [text[a:b] for a, b, _ in mermaid_faults(text, kind, 0)] == [line]
    if kind == "flowchart":
        assert [m for _, _, m in mermaid_faults("flowchart TD\nsubgraph x\nA-->B", kind, 0)] == ["block is not closed by end"]
