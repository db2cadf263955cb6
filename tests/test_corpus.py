"""The whole plan over a mixed corpus, its parts against brute force, and that stored results change nothing."""

import itertools

import pytest
from pyspark.sql import functions as F

from inkwell.functions import inflection, language
from inkwell.operators.lint import resolved_levels
from inkwell.operators.registry import Context
from inkwell.operators.settle import checked, document_language
from inkwell.operators.spelling import spell_words
from inkwell.plans import corpus
from inkwell.sources.dictionaries import Affixes, of_classes, read_affix_dictionary, read_classes, read_vocabulary
from inkwell.sources.files import Config

DOC = "doc_id long, path string, kind string, code_lang string, text string"
ENGLISH = "a the boat is in it lake see next page and we went home read at sail large this word here was on guide with note use anchor go to for colour open".split()
TEXTS = {
    "docs/index.md": "# Start\n\nSee [guide](guide.md) and [lost](gone.md).\n",
    "docs/guide.md": "# Guide\n\nGo to [start](index.md#start) or [bad](index.md#nowhere).\n\n<!-- lint-disable-next-line links -->\nSee [hidden](gone2.md).\n",
    "docs/alone.md": "# Alone\n\n{{#include parts/x.txt}}\n\nThe boatt is in the lake.  \nIt is a apple here.\n",
    "docs/sv.md": "---\nlang: sv\n---\n# Hej\n\nDet är en båt och den är i en sjö.\n",
    "docs/mixed.md": "# Mixed\n\nThe boat is in the lake.\n\n<!-- lang: fi -->\n\nSe on vene ja se on järvi, ja minä olen on.\n\n<!-- lang: end -->\n\nWe went to the the lake.\n",
    "docs/quiet.md": "<!-- lint-disable-file -->\n# Quiet\n\nThe boatt the the.\n",
    "docs/names.md": "# Names\n\nMr Quxley went home. Zorblat is large. See Zorblat and Zorblat. Use `frobn` and frobn. We use Kuburnetes's boat, 10kg, foo_bar.\n",
    "src/a.rs": "// The boatt is in the the lake.\nfn main() {}\n",
    "docs/empty.md": "", "docs/null.md": None,
}


@pytest.fixture(scope="module")
def documents(spark):
    rows = [(i, p, "code" if p.endswith(".rs") else "markdown", "rust" if p.endswith(".rs") else "", t) for i, (p, t) in enumerate(TEXTS.items())]
    return spark.createDataFrame(rows, DOC)


@pytest.fixture(scope="module")
def dictionary(spark):
    return spark.createDataFrame([("en", w) for w in ENGLISH], "lang string, word string")


def rows(found):
    return sorted((r["path"], r["rule"], r["text"]) for r in found.collect())


def test_check(spark, documents, dictionary):
    config = Config.of({"rules": {"md/*": "off", "slop/*": "off", "prose/*": "off", "style/*": "off"}, "overrides": [{"paths": ["src/**"], "rules": {"grammar/RepeatedWords": "error"}}]})
    accepted = spark.createDataFrame([("hidden",), ("alone",), ("lost",), ("bad",), ("start",), ("hej",), ("mixed",), ("names",), ("or",), ("apple",)], "word string")
    found = corpus.check(documents, config, corpus.Inputs(dictionary=dictionary, accepted=accepted), vocabulary=("Kuburnetes",))
    got = rows(found.where("rule <> 'docs/orphan-page'"))
    assert got == sorted([
        ("docs/index.md", "links/missing-file", "gone.md"), ("docs/guide.md", "links/missing-anchor", "index.md#nowhere"), ("docs/alone.md", "docs/include-missing", "parts/x.txt"),
        ("docs/alone.md", "spelling", "boatt"), ("docs/alone.md", "grammar/AnA", "a"), ("docs/mixed.md", "grammar/RepeatedWords", "the the"), ("src/a.rs", "grammar/RepeatedWords", "the the"), ("src/a.rs", "spelling", "boatt"),
    ])
    assert {r["path"] for r in found.where("rule = 'docs/orphan-page'").collect()} == {"docs/alone.md", "docs/sv.md", "docs/mixed.md", "docs/names.md", "docs/empty.md", "docs/null.md"}
    severity = {(r["path"], r["rule"]): r["severity"] for r in found.collect()}
    assert severity["src/a.rs", "grammar/RepeatedWords"] == 2 and severity["docs/mixed.md", "grammar/RepeatedWords"] == 1 and severity["docs/alone.md", "spelling"] == 1
    spelled = found.where("rule = 'spelling' AND path = 'src/a.rs'").first()
    assert (spelled["line"], spelled["col"], spelled["b_start"], spelled["b_end"], spelled["suggestions"]) == (1, 8, 7, 12, ["boat"])
    assert corpus.check(documents.where("false"), config).count() == 0
    # with stored results the same comes out
    plain = corpus.local_findings(corpus.with_overrides(documents, config), config)
    stored = corpus.stored_results(documents, plain, config, F.lit("2026-01-01").cast("timestamp")).where("path <> 'docs/alone.md'")
    inputs = corpus.Inputs(dictionary=dictionary, accepted=accepted, stored=stored, listed=spark.createDataFrame([("docs/sv.md",)], "path string"))
    again = corpus.check(documents, config, inputs, vocabulary=("Kuburnetes",))
    assert rows(again.where("rule <> 'docs/orphan-page'")) == got and again.where("rule = 'docs/orphan-page'").count() == 5


def test_stored_results_change_nothing(spark, documents):
    config = Config.of({})
    plain = corpus.local_findings(documents, config)
    stored = corpus.stored_results(documents, plain, config, F.lit("2026-01-01").cast("timestamp")).where("path <> 'docs/alone.md'")
    kept = [c for c in corpus.columns()]
    again = corpus.local_findings(documents, config, stored)
    assert sorted(map(str, plain.select(kept).collect())) == sorted(map(str, again.select(kept).collect()))
    edited = documents.withColumn("text", F.when(F.col("path") == "docs/guide.md", "# Guide\n\nthe the\n").otherwise(F.col("text")))
    assert sorted(map(str, corpus.local_findings(edited, config).select(kept).collect())) == sorted(map(str, corpus.local_findings(edited, config, stored).select(kept).collect()))
    # a finding that was stored is what comes out: the rules did not run
    marked = stored.withColumn("findings", F.transform("findings", lambda f: f.withField("message", F.lit("stored"))))
    messages = {r["path"]: r["message"] for r in corpus.local_findings(documents, config, marked).collect()}
    assert messages["docs/alone.md"] != "stored" and messages["src/a.rs"] == "stored"


def test_merged_results(spark):
    now = F.lit("2026-02-01").cast("timestamp")
    entry = "key string, path string, last_used timestamp, findings array<struct<rule:string>>"
    make = lambda rows: spark.createDataFrame(rows, "key string, path string, day string").select("key", "path", F.to_timestamp("day").alias("last_used"), F.array().cast("array<struct<rule:string>>").alias("findings"))
    old = make([(f"k{i}", "a", f"2026-01-{10 + i}") for i in range(6)] + [("old", "b", "2025-06-01"), ("x", "c", "2026-01-20")])
    new = make([("x", "c", "2026-01-31")])
    assert old.schema.simpleString() == spark.createDataFrame([], entry).schema.simpleString()
    got = {(r["key"], str(r["last_used"])[:10]) for r in corpus.merged_results(old, new, now, least=0).collect()}
    assert got == {("k2", "2026-01-12"), ("k3", "2026-01-13"), ("k4", "2026-01-14"), ("k5", "2026-01-15"), ("x", "2026-01-31")}
    assert corpus.merged_results(old, new, now).count() == 8


def test_levels_agree(spark):
    """The native severities and those of the map, for every pair of patterns."""
    defaults = {"a/x": 1, "a/y": None, "b/x": 0, "b_c/x": 2}
    patterns = ["a/x", "a/*", "*", "b*", "b_*", "a/y"]
    for p, q in itertools.permutations(patterns, 2):
        levels = {p: "error", q: "off"}
        own = spark.createDataFrame([(r, d) for r, d in defaults.items()], "rule string, severity int")
        column = F.create_map(*[F.lit(x) for kv in levels.items() for x in kv])
        got = {r["rule"]: r["s"] for r in own.select("rule", corpus.severity_under(F.col("rule"), F.col("severity"), column).alias("s")).collect()}
        if len(p) != len(q):  # of equally long globs either may hold
            assert {r: s for r, s in got.items() if s is not None} == resolved_levels(defaults, levels), levels


def known_by_force(word, lang, known):
    low = word.lower()
    endings = inflection.TOLERATED.get(lang, ())
    if low in known or any(low.endswith(e) and len(low) >= len(e) + 3 and low[: -len(e)] in known for e in endings):
        return True
    marks = inflection.COMPOUNDING.get(lang, ("",))
    return len(low) >= 6 and any(low[:at].endswith(m) and at - len(m) >= 3 and low[: at - len(m)] in known and low[at:] in known for m in marks for at in range(3, len(low) - 2))


def test_known_words_by_force(spark):
    known = {"de": {"haus", "boot", "fahrt", "groß"}, "sv": {"båt", "hus", "stor"}, "fi": {"talo", "auto", "vene"}}
    words = [(lang, a + m + b + e) for lang, own in known.items() for a in [*own, ""] for m in ("", "s", "n", "x") for b in [*own, "quux"] for e in ("", "en", "et", "ssa", "zz")]
    words = sorted({(lang, w) for lang, w in words if w})
    dictionary = spark.createDataFrame([(lang, w) for lang, own in known.items() for w in own], "lang string, word string")
    got = {tuple(r) for r in corpus.known_words(spark.createDataFrame(words, "lang string, word string"), dictionary).collect()}
    assert got == {(lang, w) for lang, w in words if known_by_force(w, lang, known[lang])}


def test_languages():
    fi = "Tämä on hyvin pitkä lause, joka on kirjoitettu suomeksi ja se on vain esimerkki siitä mitä voi olla."
    de = "Der Hund ist nicht in dem Haus, und die Katze ist auf der Straße mit dem Kind."
    assert language.hint(language.words_of(de)) == "de" and language.nordic(language.words_of(fi)) == "fi"
    assert language.nordic(["se", "on"]) is None and language.hint(["der", "die"]) is None
    assert document_language(Context((de + " ") * 9), "en") == "de" and document_language(Context((fi + " ") * 9), None) == "fi"
    assert document_language(Context("---\nlang: pt-BR\n---\nx"), "en") == "pt" and document_language(Context("short"), "sv") == "sv" and document_language(Context("short"), None) == "en"
    assert not language.looks_not_english(["the", "boat"] * 100) and language.looks_not_english(["ünter"] * 100) and language.looks_not_english(["qqq"] * 100, lambda w: False)
    spans = language.stretches("We saw it; der Hund ist nicht in dem Haus; and went home.", "en")
    assert [x for _, _, x in spans] == ["de"]


def test_foreign_findings_go():
    text = "We saw a boat. „Der Hund ist in dem dem Haus und die Katze ist nicht auf der Straße“ he said said.\n"
    assert [f.start for _, f in checked(["grammar/RepeatedWords"], Context(text))] == [text.index("said said")]


def test_inflected_terms():
    for lang, term, good, bad in (
        ("en", "Debian", ["Debian", "Debian's", "Debians"], ["Debianish"]), ("sv", "Volvo", ["Volvo", "Volvos", "Volvon", "volvorna"], ["Volvoman"]),
        ("fi", "Nokia", ["Nokia", "Nokian", "Nokiassa", "Nokiaan", "Nokialtakin"], ["Nokiablah"]), ("fi", "katu", ["katu", "kadun", "kadulla", "katuun"], ["kadx"]), ("fi", "Linux", ["Linux", "Linuxin", "Linuxissa", "Linuxiin"], ["Linuxy"]),
        ("fi", "EU", ["EU:n", "EU:ssa", "EU"], ["EUx"]), ("fi", "Virtanen", ["Virtanen", "Virtasen", "Virtasella"], ["Virtax"]), ("fi", "kauppa", ["kaupan", "kauppaan", "kaupassa"], []),
    ):
        pattern = inflection.phrase_pattern([term], lang)
        assert all(pattern.fullmatch(w) for w in good), (term, [w for w in good if not pattern.fullmatch(w)])
        assert not any(pattern.fullmatch(w) for w in bad), term
    assert inflection.phrase_pattern(["big boat", "big boat house"], "en").search("a big boat house's door")[0] == "big boat house's"


def test_spell_words():
    text = "# Intro\n\nThe boatt went 10kg (iv) a) [x] AB-12 foo_bar a::b src/lib/x.py. `code`s and glued`code`. Haha XIV iPhone USA. Anna Schmidt met Dr Quxley Zed. Use `frobn`: frobn, don't.\n\nIt said „Der Hund ist nicht in dem Haus und die Katze“ he was here.\n"
    assert [w for _, _, w, _ in spell_words(Context(text))] == ["Intro", "The", "boatt", "went", "and", "met", "Use", "don't", "It", "said", "he", "was", "here"]
    assert [(text[a:b], w) for a, b, w, _ in spell_words(Context(text))][2] == ("boatt", "boatt")


def test_dictionary_files(spark, tmp_path):
    (tmp_path / "v.txt").write_text("# names\nFoo bar  # why\n\nBaz\nBaz\n")
    assert sorted(r["word"] for r in read_vocabulary(spark, str(tmp_path / "v.txt")).collect()) == ["Baz", "Foo bar"]
    (tmp_path / "c.tsv").write_text("Boat\t5\nboat\t2\nlake\t4\nbroken\n")
    lexicon = read_classes(spark, str(tmp_path / "c.tsv"))
    assert {(r["word"], r["class_bits"]) for r in lexicon.collect()} == {("boat", 7), ("lake", 4)}
    assert [r["word"] for r in of_classes(lexicon, 4, 2).collect()] == ["lake"]
    aff = "SET UTF-8\nNEEDAFFIX !\nSFX S Y 2\nSFX S y ies [^aeiou]y\nSFX S 0 s [^y]\nPFX U Y 1\nPFX U 0 un .\nSFX D N 1\nSFX D 0 d e\n"
    assert Affixes(aff).forms("tie/SU") == {"tie", "ties", "untie", "unties"} and Affixes(aff).forms("fly/S") == {"fly", "flies"}
    assert Affixes(aff).forms("use/UD") == {"use", "used", "unuse"} and Affixes(aff).forms("lock/!S") == {"locks"}
    (tmp_path / "x.aff").write_text(aff)
    (tmp_path / "x.dic").write_text("2\ntie/SU\nFly/S\n")
    assert {r["word"] for r in read_affix_dictionary(spark, str(tmp_path / "x.dic"), str(tmp_path / "x.aff"), "en").collect()} == {"tie", "ties", "untie", "unties", "fly", "flies"}
