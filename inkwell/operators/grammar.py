"""Grammar rules (``grammar/...``) of English: word windows. Other languages are in ``native_grammar.py``.

Rules are patterns over neighbouring words of a segment; a pattern's group ``x`` is what is reported.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from ..functions.sentences import like, quoted
from .registry import INFO, WARNING, Context, Finding, rule
from .text import lower_text, segments, words_in

BOTH = ("markdown", "code", "gettext")
I = re.I  # noqa: E741
NEXT = r"[ \t]*\n?[ \t]*(?<=\s)"  # the gap between neighbouring words


def w(*words: str) -> str:
    return "(?:" + "|".join(sorted((x for part in words for x in part.split()), key=lambda x: (-len(x), x))) + ")"


DET = w("a an the my your his her its our their this that these those some any no every each")
SUBJECT = w("i you he she it we they")
BE = w("is are was were am be been")
MODAL = w("can could will would shall should may might must")
ADJ = w("able afraid alone angry available aware bad big busy free full glad good happy hungry important late lost new nice old ready right sad safe sick small sorry sure tired very welcome wrong young")
PLACE = w("above after again all are before below but could exist exists have had has in inside is isn't lies may might must no not on or seem seems should so was wasn't were will would")
NOUN = w("account address answer army baby bag bank boat body book boss box boy brother bus car cat chair child children city class club code company computer country daughter day desk dog door dream email family farm father file flag flat friend friends garden girl group hand hands hat head heart home hope horse hotel house idea job key kitchen lawyer leader letter life list lunch manager map mind mother mouth movie name neighbor neighbour notes office opinion parents party password phone place plan plane problem project report room school server shoes shop sister son song story street students table teacher team time town tree trip truck turn uncle users village visit voice wife window words work")
ING = w("being coming doing getting going leaving looking making playing reading running saying sitting staying taking talking telling trying using waiting walking watching working")

#: name: (pattern, replacement of group x, severity). Replacements keep the first letter's case.
English = tuple[str, str | Callable[[re.Match], str], int]
ENGLISH: dict[str, list[English]] = {}


def english(name: str, pattern: str, new, level: int = INFO) -> None:
    ENGLISH.setdefault(name, []).append((pattern, new, level))


english("Didnt", rf"\b{SUBJECT} (?P<x>dint|didnt)\b", "didn't", WARNING)
english("TheMy", r"\b(?P<x>(?:the|a|an) (?=(?:my|your|his|our|their)\b)(?:my|your|his|our|their))\b", lambda m: m["x"].split()[-1], WARNING)
english("CorrectNumberSuffix", r"\b(?P<x>\d+(?:st|nd|rd|th))\b", lambda m: ordinal(m["x"]), WARNING)
english("NumberSuffixCapitalization", r"\b\d+(?P<x>ST|ND|RD|TH)\b", lambda m: m["x"].lower(), WARNING)
english("ThenThan", rf"\b(?:more|less|fewer|better|worse|rather|other|\w{{3,}}(?<!aft)(?<!ev)(?<!nev)(?<!oth)er) (?P<x>then) (?={DET}|{SUBJECT}\b|me\b|him\b|us\b|them\b|\d|expected|usual|ever|before)", "than")
english("ThenThan", rf"(?:^|[,.] |\band |\buntil |\bsince |\bback |\bfrom )(?P<x>than) (?={SUBJECT} |the |on\b|,)", "then")
#: Verbs by their base form, and nouns by their singular (fixed values). Those of ``PLAIN`` are no nouns in any form.
PLAIN = "accept achieve act agree allow announce appear apply argue arrive ask become begin believe belong bring buy carry choose come compare compute confirm connect consider consist contain continue create decide define delete deliver depend describe deserve determine develop disagree discover eat enable encourage ensure exist expect explain extend fail find follow forget get give go grow happen hear hide hold improve include increase inform introduce keep know lead learn leave let lie listen live lose maintain make mean meet offer open pay perform prefer prepare prevent produce prove provide publish put raise reach read receive recognize recommend reduce refer refuse remain remember remove repeat replace represent require respond save say see seem sell send serve sing sit solve speak stay suggest take teach tell think throw try understand wear write".split()
VERBS = [*PLAIN, *"answer call care change do fix have help hope like look love move name need open plan play point run show start stop talk test turn use wait walk want work".split()]
NOUNS = "account address answer app article author book box boy bug button car cat change character city class client code color command comment company computer country customer daughter day developer device dog document door engineer error event example feature field file folder friend function game girl group home house idea image issue item job key language letter library line link list manager message method model module mother name network number object option order owner package page parent part person phone plan player problem process program project property question reader record report request result road room rule school script server service setting shop sister site son song story street student system table task teacher team test thing tool town tree user value version village visitor week window word worker writer year".split()


def plural(noun: str) -> str:
    if noun in ("child", "person"):
        return {"child": "children", "person": "people"}[noun]
    return noun + "es" if re.search(r"(?:s|x|z|ch|sh)$", noun) else noun[:-1] + "ies" if re.search(r"[^aeiou]y$", noun) else noun + "s"


def third_of(verb: str) -> str:
    return {"do": "does", "have": "has", "go": "goes", "be": "is"}.get(verb) or plural(verb)


_THIRD = {"are": "is", "were": "was", **{v: third_of(v) for v in VERBS}}
_BARE = {new: old for old, new in _THIRD.items()}
#: Words after which a bare verb is right: "does the user need", "we let it run", "that she come".
BARE_AFTER = re.compile(r"(?:\b(?:do|does|did|don['’]t|doesn['’]t|didn['’]t|can|can['’]t|could|will|won['’]t|would|shall|should|may|might|must|to|let|lets|make|makes|made|making|help|helps|helped|helping|see|saw|watch|hear|have|had|suggests?|suggested|recommends?|requires?|insists?|demands?|asks?|asked|that|if|lest|neither|nor|and|or|than|with|of|for)\s+(?:(?:that|not|all|both)\s+)?)$", re.I)


def agreeing(change, after: bool):
    """The right form, or the same where what stands before makes it right."""

    def new(m: re.Match) -> str:
        return m["x"] if after and BARE_AFTER.search(m.string[max(0, m.start() - 40) : m.start()]) else change(m["x"])

    return new


english("PronounVerbAgreement", rf"(?<!\w )\b(?:he|she|it) (?P<x>{w(' '.join(v for v in [*VERBS, 'are', 'were'] if v not in ('let', 'put')))})\b(?! (?:been|sure))", agreeing(lambda x: third(x), True), WARNING)
english("PronounVerbAgreement", rf"(?<!of )\b(?:we|they|you) (?P<x>{w(' '.join([third_of(v) for v in VERBS] + ['is', 'was']))})\b", lambda m: bare(m["x"]), WARNING)
english("SubjectVerbAgreement", rf"\b(?:the|these|those|our|their|your|my) (?:{w(' '.join(plural(n) for n in [*NOUNS, 'child']))}) (?P<x>{w(' '.join(['is', 'was', 'has', 'does', 'needs', *(third_of(v) for v in PLAIN)]))})\b", agreeing(lambda x: bare(x), True), WARNING)
english("SubjectVerbAgreement", rf"\b(?:the|this|that|each|every) (?:{w(' '.join([*(n for n in NOUNS if n not in ('parent', 'part')), 'child']))}) (?P<x>{w(' '.join(['are', 'were', 'have', 'do', 'need', *(v for v in PLAIN if v not in ('read', 'let', 'put', 'lead', 'open', 'act', 'live', 'lie'))]))})\b", agreeing(lambda x: third(x), True), WARNING)
english("YourYoure", rf"\b(?P<x>your) (?=not\b|gonna\b|(?:a|an|the) |(?:so |very |really )?{ADJ}(?:[.,!?]|$| to\b)|{ING} (?:to|it|the|a)\b)", "you're")
english("YourYoure", rf"\b(?P<x>you['’]re) (?=own\b|{NOUN}(?:[.,!?]|$| (?:is|are|was|were|will|has)\b))", "your")
english("ThereOwn", r"\b(?P<x>there|they['’]re) (?=own\b)", "their")
english("ThereToTheir", rf"(?<!is )(?<!are )(?<!was )(?<!were )(?<!be )(?<!over )(?<!out )\b(?P<x>there) (?={NOUN}\b)(?!\w+ (?:is|are)\b)", "their")
english("TheirToThere", rf"\b(?P<x>their) (?=(?:is|are|was|were|isn['’]t|aren['’]t|will be|must be|may be|has been|have been|seems? to be)\b)", "there")
english("TheirToTheyre", rf"\b(?P<x>their) (?=not\b|gonna\b|(?:a|an|the) |(?:so |very |really )?{ADJ}(?:[.,!?]|$| to\b)|{ING} (?:to|it|the|a)\b)", "they're")
english("TheyreToTheir", rf"\b(?P<x>they['’]re) (?={NOUN}\b)", "their")
english("LoseLoose", rf"\b(?:{MODAL}|to|not|didn['’]t|don['’]t|{SUBJECT}) (?P<x>loose) (?={DET}|it\b|them\b|money|weight|data|time|hope|track|control)", "lose")
english("LoseLoose", rf"\b(?:{BE}|too|very|a|come|came) (?P<x>lose)\b(?=[.,!?]| (?:screw|tooth|end|fit|thread|cable)|$)", "loose")
english("AffectEffect", rf"\b(?:{MODAL}|to|not|doesn['’]t|don['’]t|did|does) (?P<x>effect) (?={DET}|them\b|it\b|us\b|me\b)(?!\w+ (?:change|changes)\b)", "affect")
english("AffectEffect", r"\b(?:the|an|no|any|this|side|little|adverse) (?P<x>affects?)\b(?= (?:of|on)\b|[.,!?]|$)", lambda m: m["x"].replace("a", "e", 1))
english("WhoseWhos", rf"\b(?P<x>who['’]s) (?={NOUN} (?:is|was|are|were|has|did)\b|{NOUN}[?])", "whose")
english("WhoseWhos", rf"(?<!\w )\b(?P<x>whose) (?=going\b|been\b|not\b|there\b|{ING} )", "who's")
english("WeatherWhether", r"\b(?:know|knows|ask|asked|decide|decided|see|check|wonder|tell|sure) (?P<x>weather)\b", "whether")
english("WeatherWhether", r"\b(?P<x>weather) (?=or not\b)", "whether")
english("PrincipalPrinciple", r"\b(?P<x>principle) (?=(?:author|engineer|investigator|component|reason|office|architect|character)s?\b)", "principal")
english("PrincipalPrinciple", r"\b(?:in|the|a|basic|guiding|general|moral|same) (?P<x>principals?)\b(?= (?:of|that|behind)\b|[,.]? (?:we|it|this) )", lambda m: m["x"].replace("pal", "ple"))
english("ComplimentComplement", r"\b(?P<x>compliments?) (?=each other\b|one another\b|nicely\b)", lambda m: m["x"].replace("pli", "ple"))
english("ComplimentComplement", r"\b(?P<x>complimentary) (?=(?:colors?|colours?|angles?|skills?|goods|pairs?|events?)\b)", "complementary")
english("ItsContraction", rf"(?:^|[.!?] |, |\b(?:and|but|that|because|if|think|says?) )(?P<x>its) (?=(?:a|an|the|not|been|going|very|too|so|also|important|possible|easy|hard|clear|{ADJ[3:-1]})\b)(?!own)", "it's")
english("ItsPossessive", rf"\b(?:of|in|on|for|with|from|to|by|has|lost|into) (?P<x>it['’]s) (?=(?:own|{NOUN[3:-1]}|value|size|length|own|contents?|parent|type|default|state|performance)\b)", "its")
english("WitchWhich", r"(?:, |\b(?:in|of|on|for|from|to|by|with|know|ask|choose) )(?P<x>witch)\b", "which")
english("WitchWhich", r"\b(?:a|the|old|wicked|evil) (?P<x>which)(?=[.,!?]| (?:flew|cast|hunt|doctor))", "witch")
english("ExceptAccept", rf"\b(?:{MODAL}|to|not|don['’]t|didn['’]t|{SUBJECT}) (?P<x>except) (?={DET}|it\b|them\b|that\b)", "accept")
english("ExceptAccept", r"\b(?:all|everyone|everything|nothing|nobody|anyone|always) (?P<x>accept) (?=for\b|the\b|when\b|that\b|me\b|him\b|her\b)", "except")
english("WriteRight", r"\b(?:the|turn|all|that['’]s|was|is|your) (?P<x>write)\b(?= (?:answer|way|now|place|side|time|here|choice)\b|[.,!?]|$)", "right")
english("WriteRight", rf"\b(?:to|{MODAL}|please) (?P<x>right) (?=(?:a|an|the|it|down|code|tests?|to)\b)", "write")


def ordinal(text: str) -> str:
    n = int(text[:-2])
    return f"{n}{'th' if n % 100 in (11, 12, 13) else {1: 'st', 2: 'nd', 3: 'rd'}.get(n % 10, 'th')}"


def third(verb: str) -> str:
    return _THIRD.get(verb.lower(), verb + "s")


def bare(verb: str) -> str:
    return _BARE.get(verb.lower(), verb[:-1])


#: Words whose first letter does not tell their first sound (fixed values).
VOWEL_SOUND = re.compile(r"(?:hour|heir|honest|honou?r|[aeio]|u(?!n[iu](?!n|m)|s[aeiu]|t[aeio]|ri|biq|kr|ku|r[aeiou]n|topi)|(?:FBI|HTML|HTTP|LED|MP3|NFC|RFC|SQL|SSH|SVG|XML|F|H|L|M|N|R|S|X)(?![a-z]))", re.I)
CONSONANT_SOUND = re.compile(r"(?:eu|ewe|on[ce]\b|one[- ]|once|u(?:n[iu](?!n|m)|s[aeiu]|t[aeio]|biq|ku|kr|r[aeiou]n|topi)|ouija|UI\b|UR[LI]|US\b|U[A-Z]{1,3}\b)", re.I)


def starts_with_vowel(word: str) -> bool:
    if re.fullmatch(r"[A-Z]{2,}s?|[A-Z]\d*", word) and not CONSONANT_SOUND.match(word):
        return word[0] in "AEFHILMNORSX"
    if CONSONANT_SOUND.match(word):
        return False
    return bool(VOWEL_SOUND.match(word)) if not word[0].isdigit() else bool(re.match(r"(?:8|11|18)(?!\d{1,2}\b(?<!8\d))", word))


def masked(s, a: int, b: int, c: Context) -> bool:
    """Text between was blanked (code, links): the words are no neighbours."""
    return c.text[s.start + a : s.start + b] != s.text[a:b] and c.kind == "markdown"


def english_rule(name: str):
    compiled = [(re.compile(p, I if "A-Z" not in p and name not in ("NumberSuffixCapitalization",) else 0), new, level) for p, new, level in ENGLISH[name]]

    # what group x can be, where that is a list of words: a text without the longest run of letters of any of them needs no pattern
    parts = [re.search(r"\(\?P<x>(\(\?:)?([\w '|’?]+)\)", p) for p, _, _ in ENGLISH[name]]
    listed = {w.rstrip("?")[:-1] if "?" in w else w for m in parts if m for w in m[2].lower().split("|")} if all(parts) else set()
    # a word with an optional letter is found by its beginning only
    whole = all(re.fullmatch(r"[a-z]+(?:['’\s][a-z]+)*", w) for w in listed) and not any("?" in m[2] for m in parts if m)
    needed = frozenset(max(re.findall(r"[a-z]+", w), key=len) for w in listed) if whole else frozenset()

    def check(c: Context):
        if c.option("language", "en") != "en" or (needed and needed.isdisjoint(words_in(c))):
            return
        if listed and not needed and not any(w in lower_text(c) for w in listed):
            return
        for s in segments(c):
            if needed and needed.isdisjoint(words_in(c, s)):
                continue
            flat = s.text.replace("\n", " ")
            for pattern, new, level in compiled:
                for m in pattern.finditer(flat):
                    a, b = m.span("x")
                    fix = new(m) if callable(new) else new
                    fix = like(m["x"], fix) if not m["x"].isupper() else fix
                    if fix != m["x"] and not quoted(flat, a, b) and not masked(s, m.start(), m.end(), c):
                        yield Finding(s.start + a, s.start + b, f"{m['x']!r} should be {fix!r}", suggestions=(fix,))

    rule(f"grammar/{name}", max(level for _, _, level in ENGLISH[name]), BOTH)(check)


for _name in ENGLISH:
    english_rule(_name)


@rule("grammar/AnA", WARNING, BOTH)
def an_a(c: Context):
    if c.option("language", "en") == "en":
        for s in segments(c):
            for m in re.finditer(r"(?<![\w'’.-])(an?|An?|AN) +([A-Za-z0-9][\w-]*)", s.text):
                if not (m[2][0].isdigit() and not re.match(r"\d+(?:st|nd|rd|th)?\b", m[2])) and "_" not in m[2] and (m[1].lower() == "an") != starts_with_vowel(m[2]) and not masked(s, m.start(), m.end(), c) and m[1] != "AN" and len(m[2]) > 1:
                    fix = "a" if m[1].lower() == "an" else "an"
                    yield Finding(s.start + m.start(1), s.start + m.end(1), f"{m[1]!r} should be {like(m[1], fix)!r}", suggestions=(like(m[1], fix),))


#: Words that may stand twice (fixed values).
TWICE = frozenset("had that blah bye ha haha no so very win out".split())


@rule("grammar/RepeatedWords", WARNING, BOTH)
def repeated_words(c: Context):
    for s in segments(c):
        for m in re.finditer(r"(?<![\w-])([^\W\d_]+)(\s+)(\1)(?![\w'’-])", s.text, I):
            if m[1].lower() not in TWICE and "\n\n" not in m[2] and not masked(s, m.start(), m.end(), c):
                yield Finding(s.start + m.start(), s.start + m.end(), f"{m[1]!r} is repeated", suggestions=(m[1],))
