"""Marked examples of the prose, formulaic-writing and style rules. With options: (examples, options)."""

WORDS = "The small green boat went along the quiet river past the old stone mill and the tall dark trees. "
STYLE = {
    "style/existence": {"name": "a", "kind": "existence", "tokens": ["foo", "bar baz"]},
    "style/substitution": {"name": "b", "kind": "substitution", "swap": {"colour": "color"}},
    "style/occurrence": {"name": "c", "kind": "occurrence", "tokens": ["very"], "max": 1},
    "style/capitalization": {"name": "d", "kind": "capitalization", "case": "title"},
}
EXAMPLES: dict = {
    "prose/inclusive": ["Add it to the ⟦whitelist⟧ now.\n", "Add it to the allowlist now.\n", "See `whitelist` and whitelist.txt here.\n", "A ⟦Sanity check⟧ helps.\n"],
    "prose/simplify": ["We did it ⟦in order to⟧ win.\n", "We did it to win.\n", "> quoted in order to see\n", "⟦Prior to⟧ the start.\n"],
    "prose/terminology": ["Use ⟦Github⟧ and ⟦javascript⟧.\n", "Use GitHub and JavaScript.\n", "See github.com/x or `github`.\n"],
    "prose/entity-name": (["We use ⟦acme cloud⟧ here.\n", "We use Acme Cloud and ACME CLOUD.\n"], {"entities": ["Acme Cloud"]}),
    "prose/ambiguous-person": (["Yesterday ⟦Smith⟧ came.\n", "Anna Smith came. Then Smith left.\n", "Other text.\n"], {"people": ["Anna Smith", "Bert Smith"]}),
    "prose/passive": ["The file ⟦is written⟧ here.\n", "The job writes a file.\n", "It ⟦was not quickly finished⟧ then.\n", "He is interested.\n"],
    "prose/weasel": ["It is ⟦very⟧ big.\n", "It is big.\n", "Use this rather than that.\n", "There were quite a few boats.\n"],
    "prose/there-is": ["⟦There is⟧ a boat.\n", "A boat is there.\n", "⟦There's⟧ one. Not there is.\n"],
    "prose/so-start": ["⟦So⟧ we left.\n", "So far so good.\n", "It is so.\n"],
    "prose/sentence-length": ["⟦" + "word " * 30 + "end.⟧ Short.\n", "Short one.\n"],
    "prose/readability": ["⟦" + "Notwithstanding considerable organizational complexity, institutional representatives simultaneously demonstrated extraordinary administrative responsibility. " * 10 + "⟧\n".replace("⟧", "⟧"), WORDS * 6 + "\n"],
    "prose/consistency": ["Send an email. Your email is here. An ⟦e-mail⟧ too.\n", "Send an email. Your email is here.\n", "A ⟦grey⟧ cat, a gray dog, a gray sky.\n"],
    "prose/acronym-defined": ["The ⟦QRS⟧ is here. The QRS again.\n", "The queue routing system (QRS) is here. The QRS again.\n", "The API is here.\n"],
    "prose/smart-quotes": ['He said "yes" and "no" and ⟦“⟧maybe⟦”⟧.\n', 'He said "yes".\n'],
    "prose/sentence-spacing": ["One here.⟦  ⟧Two here.\n", "One here. Two here.\n"],
    "slop/phrase": ["⟦In conclusion⟧, it works.\n", "It works.\n", "It ⟦plays a crucial role in⟧ this.\n", "⟦When it comes to⟧ boats, yes.\n"],
    "slop/word": ["We ⟦leverage⟧ a ⟦robust⟧ tool.\n", "We use a tool.\n", "The robust regression is fine.\n"],
    "slop/density": ["⟦" + (WORDS * 5 + "We leverage a robust, seamless tool and delve deeper.") + "⟧\n", WORDS * 6 + "\n"],
    "slop/em-dash": ["The boat ⟦—⟧ a red one ⟦—⟧ sank ⟦—⟧ fast.\n", "The boat — a red one — sank.\n"],
    "slop/not-just-but": ["It is ⟦not just a boat, but⟧ a home.\n", "It is a boat and a home.\n"],
    "slop/hedging": ["It ⟦could possibly⟧ work.\n", "It could work.\n", "It ⟦seems that this often might⟧ work.\n"],
    "slop/rule-of-three": ["It is ⟦fast, clean, and simple⟧. We are ⟦bold, smart, and strong⟧.\n", "It is fast, clean, and simple.\n"],
    "slop/negation-chain": ["⟦No setup, no config⟧.\n", "No setup is needed.\n", "They ⟦did not ask, did not wait⟧.\n"],
    "slop/dont-verb-it": ["⟦Don't guess it. Guess⟧ later.\n", "Don't guess. Measure.\n"],
    "slop/echo-sentences": ["We saw the big red boat. ⟦They like the big red boat.⟧\n", "We saw a boat. They left.\n"],
    "slop/stacked-questions": ["⟦Why? What now?⟧ Wait.\n", "Why? Because.\n"],
    "slop/anaphora": ["⟦Every boat floats. Every car rolls. Every plane flies.⟧\n", "Every boat floats. Cars roll. Planes fly.\n", "The boat. The car. The plane.\n"],
    "slop/stranded-auxiliary": ["It should not matter, but it ⟦does⟧.\n", "It should not matter.\n"],
    "slop/colon-triple": ["We want three things⟦: red boats, blue cars, and green planes⟧.\n", "We want: boats.\n"],
    "slop/not-but": ["It is ⟦not a boat but a⟧ home.\n", "It is not just a boat but a home.\n"],
    "style/existence": (["A ⟦Foo⟧ and ⟦bar baz⟧.\n", "A food.\n"], {"style_rules": [STYLE["style/existence"]]}),
    "style/substitution": (["The ⟦colour⟧ is red.\n", "The color is red.\n"], {"style_rules": [STYLE["style/substitution"]]}),
    "style/repetition": ["This is ⟦the the⟧ end.\n", "This is the end.\n", "It is ⟦very\nVery⟧ good.\n"],
    "style/occurrence": (["A very old, ⟦very⟧ big boat.\n", "A very old boat.\n"], {"style_rules": [STYLE["style/occurrence"]]}),
    "style/capitalization": (["⟦# The big house⟧\n", "# The Big House\n"], {"style_rules": [STYLE["style/capitalization"]]}),
    "slop/phrase/de": (["Das ist ⟦einzigartig und löst alle⟧ Fragen.\n", "Das ist ein Boot für alle.\n"], {"language": "de"}),
    "slop/phrase/fr": (["Un outil ⟦unique pour tous⟧ les jours.\n", "Un outil pour tous.\n"], {"language": "fr"}),
    "slop/phrase/es": (["Algo ⟦único para todos⟧ los días.\n", "Algo para todos.\n"], {"language": "es"}),
    "slop/phrase/pt": (["Algo ⟦único para todos⟧ os dias.\n", "Algo para todos.\n"], {"language": "pt"}),
    "slop/phrase/sv": (["Det är ⟦unikt för alla⟧ dagar.\n", "Det är för alla.\n", "Vi går ⟦till nästa nivå⟧ nu.\n"], {"language": "sv"}),
    "slop/phrase/fi": (["Se on ⟦ainutlaatuinen ja aina⟧ hyvä.\n", "Se on aina hyvä.\n"], {"language": "fi"}),
}
