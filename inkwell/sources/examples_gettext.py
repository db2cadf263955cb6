"""Marked examples of the catalog rules."""

PO = {"kind": "gettext"}


def po(*entries: str, language: str = "de", forms: str = "nplurals=2; plural=n != 1;") -> str:
    head = f'msgid ""\nmsgstr ""\n"Content-Type: text/plain; charset=UTF-8\\n"\n"Language: {language}\\n"\n"Plural-Forms: {forms}\\n"\n'
    return "\n".join([head, *(e + "\n" for e in entries)])


def entry(source: str, target: str, flags: str = "") -> str:
    return (f"#, {flags}\n" if flags else "") + f'msgid "{source}"\nmsgstr {target}'


def q(text: str) -> str:
    return f'"{text}"'


def bad(text: str) -> str:
    return f'⟦"{text}"⟧'


PLURAL = 'msgid "{0} file"\nmsgid_plural "{0} files"\n'
FILES = 'msgid "%d file in %s"\nmsgid_plural "%d files in %s"\n'
EXAMPLES: dict = {
    "gettext/syntax": ([po(entry("a", q("b"))), po('msgid "a"\nmsgstr ⟦"b⟧'), po('msgid "a"\n⟦stray⟧\nmsgstr "b"'), po('⟦msgid "a"⟧'), po('msgid "a⟦\\q⟧"\nmsgstr "b"')], {}, PO),
    "gettext/duplicate": ([po(entry("a", q("b")), 'msgid ⟦"a"⟧\nmsgstr "c"'), po(entry("a", q("b")), 'msgctxt "x"\nmsgid "a"\nmsgstr "c"')], {}, PO),
    "gettext/header": (['⟦msgid "a"⟧\nmsgstr "b"\n', po(entry("a", q("b"))), 'msgid ""\nmsgstr ⟦""\n"Content-Type: text/plain; charset=UTF-8\\n"\n"Language: de\\n"\n"Plural-Forms: nplurals=2; plural=n;\\n"⟧\n\nmsgid "a"\nmsgstr "b"\n'], {}, PO),
    "gettext/plural-count": ([po(PLURAL.format("one") + 'msgstr[0] "Datei"\nmsgstr[1] "Dateien"'), po(PLURAL.format("one") + 'msgstr[0] ⟦"Datei"⟧')], {}, PO),
    "gettext/placeholders": ([po(entry("Hello %s", q("Hallo %s"))), po(entry("Hello %s", bad("Hallo"))), po(entry("Hello {name}", bad("Hallo {nome}"))), po(entry("%(n)s items", q("%(n)s Dinge"))), po(entry("50% off", q("50 Prozent")))], {}, PO),
    "gettext/plural-placeholder": ([po(FILES + 'msgstr[0] ⟦"Datei in %2$s"⟧\nmsgstr[1] "%d Dateien in %s"'), po(FILES + 'msgstr[0] "%d Datei in %s"\nmsgstr[1] "%d Dateien in %s"')], {}, PO),
    "gettext/markup": ([po(entry("<b>x</b> y", q("<b>x</b> z"))), po(entry("<b>x</b> y", bad("<i>x</i> z"))), po(entry("use `x`", bad("nutze x")))], {}, PO),
    "gettext/whitespace": ([po(entry("a ", q("b "))), po(entry("a ", bad("b"))), po(entry("a\\n", bad("b")))], {}, PO),
    "gettext/punctuation": ([po(entry("Save.", q("Speichern."))), po(entry("Save.", bad("Speichern"))), po(entry("Wait...", q("Warte…"))), po(entry("Why?", bad("Warum!")))], {}, PO),
    "gettext/accelerator": ([po(entry("&File", q("&Datei")), entry("&Edit", q("&Bearbeiten")), entry("&View", bad("Ansicht"))), po(entry("&File", q("Datei")))], {}, PO),
    "gettext/untranslated": ([po('msgid ⟦"a"⟧\nmsgstr ""'), po(entry("a", q("b"))), po(entry("a", q("")), language="en")], {}, PO),
    "gettext/fuzzy": ([po('#, fuzzy\nmsgid ⟦"a"⟧\nmsgstr "b"'), po(entry("a", q("b"), "c-format"))], {}, PO),
    "gettext/obsolete": ([po('#~ msgid ⟦"a"⟧\n#~ msgstr "b"'), po(entry("a", q("b")))], {}, PO),
    "gettext/same-as-source": ([po(entry("this is the same text", bad("this is the same text"))), po(entry("Same", q("Same"))), po(entry("see https://example.com for it all", q("see https://example.com for it all")))], {}, PO),
}
