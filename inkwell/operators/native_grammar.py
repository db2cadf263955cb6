"""Grammar rules of German, French, Spanish, Portuguese, Swedish and Finnish, on a table of word forms.

Nouns with their gender, adjectives and verb forms come from ``functions/morphology.py``; callers add rows of their own (``morphology``
option). A rule says what neighbours must agree in; the table says what a form is and which form it should be. Rules run when the
document's language says so (``language`` option). The rules of fixed phrases are patterns whose group ``x`` is reported.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

from ..functions.morphology import PERSONS, Lexicon, lexicon, words
from ..functions.sentences import like
from .grammar import BOTH, I, masked
from .registry import INFO, Context, Finding, rule
from .text import segments

Spans = Iterator[tuple[int, int, str]]
ARTICLES = {
    "de": {"das": ("n", "s"), "eine": ("f", "s"), "einen": ("m", "s")},
    "fr": {"le": ("m", "s"), "la": ("f", "s"), "un": ("m", "s"), "une": ("f", "s"), "les": ("", "p"), "des": ("", "p")},
    "es": {"el": ("m", "s"), "la": ("f", "s"), "los": ("m", "p"), "las": ("f", "p"), "un": ("m", "s"), "una": ("f", "s"), "unos": ("m", "p"), "unas": ("f", "p")},
    "pt": {"o": ("m", "s"), "a": ("f", "s"), "os": ("m", "p"), "as": ("f", "p"), "um": ("m", "s"), "uma": ("f", "s"), "uns": ("m", "p"), "umas": ("f", "p")},
    "sv": {"en": ("u", "s"), "ett": ("n", "s")},
}
#: Articles that replace each other (fixed values).
SAME_KIND = {"de": ("der die das", "ein eine einen"), "fr": ("le la les", "un une des"), "es": ("el la los las", "un una unos unas"), "pt": ("o a os as", "um uma uns umas"), "sv": ("en ett",)}
GERMAN = {"der": ("m", "s"), "die": ("f", "s"), "das": ("n", "s"), "ein": ("m", "s"), "eine": ("f", "s")}
#: Subject pronouns by person (fixed values).
PRONOUNS = {
    "de": ("ich", "du", "er sie es", "wir", "ihr", "sie"), "fr": ("je", "tu", "il elle on", "nous", "vous", "ils elles"), "es": ("yo", "tú", "él ella usted", "nosotros nosotras", "vosotros vosotras", "ellos ellas ustedes"),
    "pt": ("eu", "tu", "ele ela você", "nós", "vós", "eles elas vocês"), "fi": ("minä mä", "sinä sä", "hän", "me", "te", "he"),
}
AUXILIARIES = {"de": "habe hast hat haben habt bin bist ist sind seid war hatte hatten waren", "fr": "ai as a avons avez ont", "es": "he has ha hemos habéis han había habían", "pt": "tinha tinham havia"}
#: What asks for the subjunctive (fixed values).
SUBJUNCTIVE = {
    "fr": r"(?:il faut|avant|pour|bien|afin|à moins|sans|jusqu'à ce|je veux|je souhaite) qu(?:e |['’])(?:il |elle |on )",
    "es": r"(?:para que|antes de que|ojalá(?: que)?|quiero que|espero que|dudo que|es posible que|sin que|a menos que) (?:él |ella |usted )?",
    "pt": r"(?:para que|antes que|espero que|quero que|talvez|embora|sem que|a menos que|é possível que) (?:ele |ela |você )?",
}
MODALS = {"pt": "posso podes pode podemos podem devo deves deve devemos devem quero queres quer queremos querem vou vais vai vamos vão consigo consegue preciso precisa"}
GOVERN_ELATIVE = "pidän pidät pitää pidämme pidätte pitävät tykkään tykkäät tykkää kerron kerrot kertoo puhun puhut puhuu"
GOVERN_ILLATIVE = "menen menet menee menemme menette menevät mennään tulen tulet tulee lähden lähtee muutan muuttaa"
#: language: rule: (pattern, replacement of group x).
NATIVE: dict[str, dict[str, list[tuple[str, str | Callable[[re.Match], str]]]]] = {
    "de": {
        "Homophones": [(r"\b(?P<x>seid) (?=(?:gestern|heute|Jahren|Montag|einem|einer|dem|der|\d))", "seit"), (r"\b(?:ihr) (?P<x>seit)\b", "seid"), (r", (?P<x>das) (?=(?:er|sie|es|wir|ich|ihr|du|man) \w+(?: \w+)? (?:ist|hat|sind|kommt|geht)\b)", "dass")],
    },
    "fr": {
        "PrepositionAccent": [(r"\b(?:va|vais|allons|pense|habite|arrive|grâce) (?P<x>a) (?=(?:la|l'|Paris|Lyon|cette|mon|ma)\b)", "à")],
        "PrepositionContraction": [(r"\b(?P<x>de le) (?=\w)", "du"), (r"\b(?P<x>de les) (?=\w)", "des"), (r"\b(?P<x>à le) (?=\w)", "au"), (r"\b(?P<x>à les) (?=\w)", "aux")],
    },
    "es": {
        "ExistentialHaber": [(r"\b(?P<x>habían|hubieron|habrán) (?=(?:muchos|muchas|varios|varias|dos|tres|unos|unas)\b)", lambda m: {"habían": "había", "hubieron": "hubo", "habrán": "habrá"}[m["x"].lower()])],
        "GrammaticalAccents": [(r"\b(?:no|ya|yo) (?P<x>se) (?=(?:qué|si|cómo|dónde|nada)\b)", "sé"), (r"(?:^|¿)(?P<x>Que|Como|Donde) (?=(?:es|está|hora|haces|estás)\b)", lambda m: {"Que": "Qué", "Como": "Cómo", "Donde": "Dónde"}[m["x"]]), (r"\b(?:para|a|de) (?P<x>mi)(?=[.,!?]|$)", "mí")],
    },
    "pt": {
        "ExistentialHaver": [(r"\b(?P<x>haviam|houveram|haverão) (?=(?:muitos|muitas|vários|várias|dois|três)\b)", lambda m: {"haviam": "havia", "houveram": "houve", "haverão": "haverá"}[m["x"].lower()])],
        "CopulaAccents": [(r"\b(?:ele|ela|isso|isto|aqui|não) (?P<x>e) (?=(?:um|uma|o|a|muito|bom|boa|importante)\b)", "é"), (r"\b(?:ele|ela|tudo) (?P<x>esta) (?=(?:bem|aqui|em|na|no)\b)", "está")],
        "MissingCrase": [(r"\b(?:vou|vai|fui|foi|devido|quanto|graças|igual) (?P<x>a) (?=(?:escola|cidade|praia|festa|noite|mesa)\b)", "à")],
    },
    "sv": {
        "Capitalization": [(r"(?<=\w )(?P<x>Måndag|Tisdag|Onsdag|Torsdag|Fredag|Lördag|Söndag|Januari|Februari|Svenska|Engelska)\b", lambda m: m["x"].lower())],
        "SentenceStart": [(r"(?:[.!?] )(?P<x>(?:det|den|jag|han|hon|vi|de))\b", lambda m: m["x"].capitalize())],
        "DomDem": [(r"\b(?P<x>dem) (?=(?:är|var|har|kan|ska|vill|kommer|går)\b)", "de"), (r"\b(?:till|för|med|av|från|ser|hjälper) (?P<x>de)(?=[.,!?]|$)", "dem")],
        "DeDem": [(r"\b(?:att|när|om|som) (?P<x>dem) (?=(?:är|var|har|kan|ska|vill)\b)", "de")],
    },
    "fi": {
        "CompoundJoined": [(r"\b(?P<x>(?:ennenkuin|niinkuin|elikkä|ikäänkuin|samantien))\b", lambda m: {"ennenkuin": "ennen kuin", "niinkuin": "niin kuin", "elikkä": "eli", "ikäänkuin": "ikään kuin", "samantien": "saman tien"}[m["x"].lower()])],
        "Capitalization": [(r"(?<=\w )(?P<x>(?:Maanantaina|Tiistaina|Perjantaina|Tammikuu|Suomen kieli|Englantia))\b", lambda m: m["x"][0].lower() + m["x"][1:])],
        "SentenceStart": [(r"(?:[.!?] )(?P<x>(?:minä|sinä|hän|me|te|he|se))\b", lambda m: m["x"].capitalize())],
        "Kuin": [(r"\b(?:parempi|isompi|pienempi|enemmän|vähemmän|yhtä \w+|nopeampi) (?P<x>kun)\b", "kuin"), (r"(?:^|, )(?P<x>[Kk]uin) (?=(?:minä|hän|se|me|tulin|menin|olin)\b)", lambda m: m["x"][0] + "un")],
        "Comma": [(r"\b\w+(?P<x> )(?=(?:että|koska|vaikka|jotta) )(?<!sekä )(?<!, )(?<!siksi )(?<!ja )", ", ")],
        "VaanVain": [(r"\bei (?:\w+ ){1,3}(?P<x>vain) (?=\w+(?:[.!]|$))", "vaan"), (r"\b(?:se on|olen|ole hyvä|oli) (?P<x>vaan) (?=\w)", "vain")],
        "Relative": [(r"\b(?:kaikki|se|jotain|mitään), (?P<x>joka) (?=\w)", "mikä")],
    },
}

def extra(c: Context) -> tuple:
    return tuple(map(tuple, c.option("morphology", ())))


def native(language: str, name: str, find: Callable[[Context, str, Lexicon], Spans]) -> None:
    def check(c: Context):
        if c.option("language", "en") == language:
            table = lexicon(language, extra(c))
            for s in segments(c):
                for a, b, fix in find(c, s.text.replace("\n", " "), table):
                    old = s.text[a:b]
                    if old != fix and not masked(s, a, b, c):
                        yield Finding(s.start + a, s.start + b, f"{old!r} should be {fix!r}", suggestions=(fix,))

    rule(f"grammar/{language}/{name}", INFO, BOTH)(check)


def by_patterns(entries):
    compiled = [(re.compile(p), new) for p, new in entries]

    def written(m: re.Match, new) -> str:
        fix = new(m) if callable(new) else new
        return fix if fix.lower() == m["x"].lower() else like(m["x"], fix)

    return lambda c, text, table: [(*m.span("x"), written(m, new)) for p, new in compiled for m in p.finditer(text)]


def one_of(text: str) -> str:
    return "|".join(sorted(text.split(), key=len, reverse=True))


def features(table: Lexicon, noun: str) -> set[tuple[str, str]]:
    """(gender, number) that a noun's form can have."""
    return {(f.gender, f.number) for f in table.of(noun, "noun")}


def article(language: str, old: str, wanted: tuple[str, str]) -> str | None:
    own = GERMAN | ARTICLES[language] if language == "de" else ARTICLES[language]
    kind = next(k.split() for k in SAME_KIND[language] if old in k.split())
    if "ein" in kind and wanted[0] == "n":
        return "ein"
    return next((a for a in kind if a in own and own[a][1] == wanted[1] and own[a][0] in ("", wanted[0])), None)


def article_rule(language: str):
    pattern = re.compile(rf"(?<![\w'’-])(?P<x>{'|'.join(ARTICLES[language])}) (?P<n>[^\W\d_]+)(?![\w'’-])", I)

    def find(c: Context, text: str, table: Lexicon) -> Spans:
        for m in pattern.finditer(text):
            gender, number = ARTICLES[language][m["x"].lower()]
            found = features(table, m["n"])
            # a form that is both numbers, or a word that may be a verb or an adjective, tells nothing
            if not found or any(g in ("", gender) or gender == "" for g, n in found if n == number) or table.of(m["n"], "verb") or table.of(m["n"], "adjective"):
                continue
            if language in ("de", "sv") and not any(n == "s" for _, n in found):
                continue
            wanted = sorted(x for x in found if x[1] == number) or sorted(found)
            if len(wanted) == 1 and (new := article(language, m["x"].lower(), wanted[0])):
                yield (*m.span("x"), like(m["x"], new))

    return find


def agrees(table: Lexicon, adjective: str, wanted: set[tuple[str, str]]) -> str | None:
    """The form an adjective should have beside a noun, or None where it fits or is none."""
    own = table.of(adjective, "adjective")
    if not own or any((f.gender, f.number) in wanted for f in own) or len(wanted) != 1:
        return None
    (gender, number), *_ = wanted
    return table.form(own[0].lemma, "adjective", gender=gender, number=number)


def adjective_rule(language: str):
    if language == "sv":
        patterns = [re.compile(r"\b(?:en|ett|någon|något|min|mitt) (?P<x>[^\W\d_]+) (?P<n>[^\W\d_]+)\b")]
    else:
        patterns = [re.compile(r"(?<![\w'’-])(?P<n>[^\W\d_]+) (?P<x>[^\W\d_]+)(?![\w'’-])")]
        if language == "fr":
            before = "petit petite petits petites grand grande grands grandes beau belle vieux vieille nouveau nouvelle joli jolie bon bonne gros grosse mauvais mauvaise"
            patterns.append(re.compile(rf"\b(?P<x>{one_of(before)}) (?P<n>[^\W\d_]+)\b"))

    def find(c: Context, text: str, table: Lexicon) -> Spans:
        done = set()
        for pattern in patterns:
            at = 0
            while m := pattern.search(text, at):
                at = m.start() + 1
                wanted = features(table, m["n"])
                new = agrees(table, m["x"].lower(), {x for x in wanted if x[1] == "s"} if language == "sv" else wanted)
                if new and m.span("x") not in done and not table.of(m["n"], "adjective"):
                    done.add(m.span("x"))
                    yield (*m.span("x"), like(m["x"], new))

    return find


def pronoun_rule(language: str):
    persons: dict[str, set] = {}
    for who, some in zip(PERSONS, PRONOUNS[language], strict=True):
        for p in some.split():
            persons.setdefault(p, set()).add(who)
    # at the start of a clause: elsewhere the pronoun may be an object
    start = r"(?:^|[.!?;:,] |\b(?:und|et|y|e|ja|nyt|aber|mais|pero|mas) )"
    pattern = re.compile(rf"{start}(?P<p>{one_of(' '.join(persons))}) (?P<x>[^\W\d_]+)\b", I)

    def find(c: Context, text: str, table: Lexicon) -> Spans:
        for m in pattern.finditer(text):
            wanted = persons[m["p"].lower()]
            own = table.of(m["x"], "verb", kind="present")
            if own and not any((f.person, f.number) in wanted for f in own) and not table.of(m["x"], "noun"):
                person, number = min(wanted)
                if new := table.form(own[0].lemma, "verb", kind="present", person=person, number=number):
                    yield (*m.span("x"), like(m["x"], new))

    return find


def noun_verb_rule(language: str):
    article_ = {"de": "der|die|das|ein|eine|mein|meine|dein|deine|unser|unsere", "fr": "le|la|les|un|une|des|mon|ma|mes|ce|cette|ces", "es": "el|la|los|las|un|una|unos|unas|mi|mis|este|esta|estos|estas", "pt": "o|a|os|as|um|uma|uns|umas|meu|minha|meus|minhas|este|esta"}[language]
    pattern = re.compile(rf"(?:^|[.!?;:,] |\b(?:und|et|y|e) )(?:{article_}) (?P<n>[^\W\d_]+) (?P<x>[^\W\d_]+)\b", I)

    def find(c: Context, text: str, table: Lexicon) -> Spans:
        for m in pattern.finditer(text):
            numbers = {n for _, n in features(table, m["n"])}
            own = table.of(m["x"], "verb", kind="present")
            if len(numbers) == 1 and own and not table.of(m["x"], "adjective") and not any(f.person == 3 and f.number in numbers for f in own) and any(f.person == 3 for f in own):
                if new := table.form(own[0].lemma, "verb", kind="present", person=3, number=min(numbers)):
                    yield (*m.span("x"), like(m["x"], new))

    return find


def participle_rule(language: str):
    """An infinitive behind an auxiliary: in German at the clause's end, elsewhere right after it."""
    gap = r"(?: [^\W\d_]+){0,4}? " if language == "de" else r" (?:(?:pas|jamais|déjà|bien|toujours|ya|nunca|siempre|já|sempre) )?"
    end = r"(?=[.!?,;]|$)" if language == "de" else r"\b"
    pattern = re.compile(rf"\b(?:{one_of(AUXILIARIES[language])}){gap}(?P<x>[^\W\d_]+){end}", I)

    def find(c: Context, text: str, table: Lexicon) -> Spans:
        for m in pattern.finditer(text):
            own = table.of(m["x"], "verb", kind="infinitive")
            # two infinitives ("hat gehen müssen"), "zu" with one, and a noun of the same form are right
            if own and not re.search(r"\b(?:zu|um) [^\W\d_]+$", m[0]) and not table.of(m["x"], "verb", kind="participle") and not (language == "de" and m["x"][0].isupper()):
                if new := table.form(own[0].lemma, "verb", kind="participle"):
                    yield (*m.span("x"), like(m["x"], new))

    return find


def subjunctive_rule(language: str):
    pattern = re.compile(rf"\b{SUBJUNCTIVE[language]}(?P<x>[^\W\d_]+)\b", I)

    def find(c: Context, text: str, table: Lexicon) -> Spans:
        for m in pattern.finditer(text):
            own = [f for f in table.of(m["x"], "verb", kind="present", person=3, number="s") if not table.of(m["x"], "verb", kind="subjunctive", lemma=f.lemma)]
            if own and (new := table.form(own[0].lemma, "verb", kind="subjunctive")):
                yield (*m.span("x"), like(m["x"], new))

    return find


def infinitive_rule(language: str, before: str):
    """A present form where an infinitive belongs."""
    pattern = re.compile(rf"\b(?:{before}) (?P<x>[^\W\d_]+)\b", I)

    def find(c: Context, text: str, table: Lexicon) -> Spans:
        for m in pattern.finditer(text):
            own = table.of(m["x"], "verb", kind="present")
            if own and not table.of(m["x"], "verb", kind="infinitive") and not table.of(m["x"], "noun") and not table.of(m["x"], "verb", kind="supine"):
                if new := table.form(own[0].lemma, "verb", kind="infinitive"):
                    yield (*m.span("x"), like(m["x"], new))

    return find


def att_infinitive(c: Context, text: str, table: Lexicon) -> Spans:
    """A present form behind the infinitive mark, with no subject that could make it a clause."""
    for m in re.finditer(r"\batt (?P<x>[^\W\d_]+)(?=[.,!?]|$| (?:en|ett|med|på|i|till|av|mycket|mer|det|den|boken)\b)", text):
        own = table.of(m["x"], "verb", kind="present")
        if own and not table.of(m["x"], "noun") and (new := table.form(own[0].lemma, "verb", kind="infinitive")):
            yield (*m.span("x"), new)


def present_tense(c: Context, text: str, table: Lexicon) -> Spans:
    """An infinitive behind a subject that no other verb comes before."""
    for m in re.finditer(r"(?<!låt )(?:^|[.!?,] |\b(?:nu|och|men|idag|sedan) )(?:jag|du|han|hon|vi|ni|de) (?P<x>[^\W\d_]+)\b(?! att)", text, I):
        own = table.of(m["x"], "verb", kind="infinitive")
        if own and not table.of(m["x"], "verb", kind="present") and (new := table.form(own[0].lemma, "verb", kind="present")):
            yield (*m.span("x"), new)


def supine(c: Context, text: str, table: Lexicon) -> Spans:
    """A participle where a supine belongs, behind "har" and "hade"."""
    for m in re.finditer(r"\b(?:har|hade) (?:(?:inte|aldrig|redan|alltid|också) )?(?P<x>[^\W\d_]+)\b", text, I):
        own = table.of(m["x"], "verb", kind="participle") or table.of(m["x"].removesuffix("e") + "t" if m["x"].endswith("te") else "", "verb", kind="supine")
        if own and not table.of(m["x"], "verb", kind="supine") and (new := table.form(own[0].lemma, "verb", kind="supine")):
            yield (*m.span("x"), new)


#: First parts of compounds that are no nouns of the table, and all parts' written-apart forms (fixed values).
FIRST_PARTS = {"sv": "sjuk hund skol bok bil mat barn fot hand tand sommar vinter kök", "fi": "auto kirja kesä koulu työ juna musiikki laiva kaupunki elokuva tanssi"}
LAST_PARTS = {"sv": "hus kapp hylla gård affär bok verkstad stuga boll duk läkare skola väska bord", "fi": "talli kauppa mökki matka paikka asema opettaja satama keskusta teatteri tunti"}
#: Word pairs that stand apart rightly.
APART = {"sv": ("sjuk bok", "sjuk barn"), "fi": ()}


def compound_rule(language: str):
    pattern = re.compile(rf"\b(?P<x>(?P<a>{one_of(FIRST_PARTS[language])}) (?P<b>{one_of(LAST_PARTS[language])}))\b", I)

    def find(c: Context, text: str, table: Lexicon) -> Spans:
        for m in pattern.finditer(text):
            if m["a"].lower() != m["b"].lower() and m["x"].lower() not in APART[language]:
                yield (*m.span("x"), m["x"].replace(" ", ""))
        for first, last in c.option("compounds", ()):
            for m in re.finditer(rf"\b{re.escape(first)} {re.escape(last)}\b", text, I):
                yield (*m.span(), m[0].replace(" ", ""))

    return find


def case_rule(verbs: str, found: str, wanted: str):
    """A noun of one case behind a verb that governs another."""
    pattern = re.compile(rf"\b(?:{one_of(verbs)}) (?:(?:kovasti|paljon|myös|nyt|taas|usein) )?(?P<x>[^\W\d_]+)\b", I)

    def find(c: Context, text: str, table: Lexicon) -> Spans:
        for m in pattern.finditer(text):
            own = table.of(m["x"], "noun", kind=found) or (table.of(m["x"].lower(), "noun", kind=found))
            if own and (new := table.form(own[0].lemma, "noun", kind=wanted)):
                yield (*m.span("x"), like(m["x"], new))

    return find


def subordinate_order(c: Context, text: str, table: Lexicon) -> Spans:
    """A finite verb before the last word of a short subordinate clause."""
    finite = words("de", "verb", extra(c), kind="present")
    for m in re.finditer(rf"\b(?:weil|dass|obwohl|wenn|damit|bevor|nachdem) (?:ich|du|er|sie|es|wir|ihr|man) (?P<x>(?P<v>{finite}) (?!gewesen|worden|haben|sein|werden)(?P<r>[a-zäöüß]+))(?=[.,!?;]|$)", text):
        if not re.search(rf"^(?:{finite})$", m["r"]):
            yield (*m.span("x"), f"{m['r']} {m['v']}")


def finnish_agreement(c: Context, text: str, table: Lexicon) -> Spans:
    """Pronoun and verb in person; spoken "me ollaan" and "me mennään" too."""
    yield from pronoun_rule("fi")(c, text, table)
    for m in re.finditer(r"\bme (?P<x>ollaan|mennään|tullaan|tehdään|syödään)\b", text, I):
        yield (*m.span("x"), {"ollaan": "olemme", "mennään": "menemme", "tullaan": "tulemme", "tehdään": "teemme", "syödään": "syömme"}[m["x"].lower()])


for _language, _rules in NATIVE.items():
    for _name, _entries in _rules.items():
        native(_language, _name, by_patterns(_entries))
for _language in ("de", "fr", "es", "pt", "sv"):
    native(_language, "ArticleAgreement" if _language != "sv" else "ArticleGender", article_rule(_language))
for _language in ("fr", "es", "pt", "sv"):
    native(_language, "AdjectiveAgreement" if _language != "sv" else "AdjectiveGender", adjective_rule(_language))
for _language in ("de", "fr", "es", "pt"):
    native(_language, "PronounVerbAgreement", pronoun_rule(_language))
    native(_language, "NounVerbAgreement", noun_verb_rule(_language))
for _language in ("de", "fr", "es"):
    native(_language, "AuxiliaryParticiple", participle_rule(_language))
native("fr", "FormalSubjunctive", subjunctive_rule("fr"))
native("es", "RequiredSubjunctive", subjunctive_rule("es"))
native("pt", "RequiredSubjunctive", subjunctive_rule("pt"))
native("pt", "ModalInfinitive", infinitive_rule("pt", one_of(MODALS["pt"])))
native("de", "SubordinateWordOrder", subordinate_order)
native("sv", "CompoundSplit", compound_rule("sv"))
native("sv", "PresentTense", present_tense)
native("sv", "Supine", supine)
native("sv", "AttInfinitive", att_infinitive)
native("fi", "CompoundSplit", compound_rule("fi"))
native("fi", "Agreement", finnish_agreement)
native("fi", "Elative", case_rule(GOVERN_ELATIVE, "nominative", "elative"))
native("fi", "Illative", case_rule(GOVERN_ILLATIVE, "inessive", "illative"))
