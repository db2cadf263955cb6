"""Marked examples of comment, code block and diagram rules: (examples, options, context)."""

RUST = {"kind": "code", "code_lang": "rust"}
PYTHON = {"kind": "code", "code_lang": "python"}


def fenced(lang: str, *bodies: str) -> list[str]:
    return [f"```{lang}\n{b}\n```\n" for b in bodies]


EXAMPLES: dict = {
    "slop/comment-plan": (["// ⟦Step 2⟧: parse it\nfn a() {}\n", "// Parses it.\nfn a() {}\n", "/* done ⟦as per the spec⟧ */\n", "let s = \"// step 2\";\n"], {}, RUST),
    "slop/comment-history": (["// This ⟦used to⟧ be slow\nfn a() {}\n", "// Fast because of the cache.\nfn a() {}\n", "let a = 1; // ⟦renamed from⟧ b\n"], {}, RUST),
    "slop/comment-narrative": (["# ⟦This function handles the input.⟧\ndef a():\n    pass\n", "# Keeps the order stable.\ndef a():\n    pass\n", "x = 0\n# ⟦Increment the counter⟧\nx += 1\n", "# ⟦Now we read it⟧\nread()\n"], {}, PYTHON),
    "slop/comment-banner": (["# ⟦=========⟧\nx = 1\n", "# plain\nx = 1\n", "# ⟦---- Helpers ----⟧\nx = 2\n", "s = '# ======'\n"], {}, PYTHON),
    "codeblock/json": fenced("json", '{"a": 1}', '{\n⟦"a": 1 "b": 2⟧\n}', '{"a": ...}') + fenced("jsonc", '{"a": 1, // x\n}', '{\n⟦"a" 1⟧\n}'),
    "codeblock/toml": fenced("toml", "a = 1", "a = 1\n⟦b = = 2⟧"),
    "codeblock/yaml": fenced("yaml", "a: 1\nb: [1, 2]", "a: 1\n⟦b: x: 2⟧"),
    "codeblock/dot": fenced("dot", "digraph g { a -> b }", "digraph g {\n⟦a -- b⟧\n}", "graph g {\n⟦a -> b⟧\n}", 'digraph g { a [label="x -- y"] }'),
    "codeblock/empty": ["⟦```sh\n```⟧\n", "```sh\nls\n```\n", "```sh no-lint\n```\n"],
    "diagram/mermaid": fenced("mermaid", "graph TD\n  A[x] --> B{y}", "⟦grahp⟧ TD\n  A --> B", "graph TD\n  ⟦A[x --> B⟧", "%% note\nsequenceDiagram\n  A->>B: hi", "⟦sequencediagram⟧\n  A->>B: hi"),
    "diagram/d2": fenced("d2", "a -> b: x\na.shape: circle", "a.shape: ⟦circl⟧", "a.style.⟦filll⟧: red", "direction: ⟦upp⟧", "⟦a: {⟧", "a.style.opacity: ⟦3⟧"),
    "config/placeholder": (['name = "a"\ndescription = ⟦"TODO"⟧\n', 'description = "A boat."\n', "role = ⟦\'\'⟧\n"], {}, {"kind": "toml"}),
}
