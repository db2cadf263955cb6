"""Which language a stretch of prose is in: function words, endings and letters of seven languages."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache

#: Frequent function words by language (fixed values).
FUNCTION_WORDS = {
    "en": "the of and to in that is he she was for with as on be by it from this are which not have has had but were they their there what when will would can if",
    "de": "der die das und ist nicht ein eine einen mit von zu den dem des auf für sich als auch wird sind war aber oder wenn nach bei noch nur durch wie über",
    "fr": "le la les des et est dans un une pour que qui pas sur au aux du ce cette sont avec nous vous ils elle être par plus mais ou où leur était",
    "es": "el la los las de que y en un una por con para del se es no lo como más pero sus le ya este sí porque esta entre cuando muy sin sobre",
    "pt": "o os as de que e do da em um uma para com não no na por mais dos se ao das como mas foi ele tem seu sua ou ser quando muito nos já está",
    "sv": "och att det som en på är av för med till den har de inte om ett han men var jag sig från vi så kan när år under också efter eller nu",
    "fi": "ja on ei se että hän oli mutta joka ovat myös kun niin kuin mitä tämä ne tai sen jos minä vain voi olla hänen mukaan sitä vielä ole",
}
#: Endings that tell Finnish and Swedish words of six letters or more (fixed values).
NORDIC_ENDINGS = {"fi": ("ssa", "ssä", "sta", "stä", "lla", "llä", "lta", "ltä", "ksi", "nen", "iin", "een", "tta", "ttä", "vat", "vät"), "sv": ("ningen", "ande", "ades", "heten", "else", "elsen", "arna", "erna", "igt", "lig", "isk", "iskt")}
DOUBLED = re.compile(r"aa|ii|uu|yy|ää|öö|ee|oo")
WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
#: Where one phrase ends and another begins: sentence marks, table pipes, brackets, quotes, dashes.
PHRASE_END = re.compile(r"[.!?;:,|()\[\]{}\"“”„«»\n]|(?<=\s)[–—-](?=\s)")


@lru_cache(maxsize=1)
def _languages_of() -> dict[str, tuple[str, ...]]:
    out: dict[str, list[str]] = {}
    for lang, words in FUNCTION_WORDS.items():
        for w in words.split():
            out.setdefault(w, []).append(lang)
    return {w: tuple(langs) for w, langs in out.items()}


def votes(words: list[str]) -> dict[str, int]:
    """Function words of each language among ``words`` (lower case)."""
    known, out = _languages_of(), dict.fromkeys(FUNCTION_WORDS, 0)
    for w in words:
        for lang in known.get(w, ()):
            out[lang] += 1
    return out


def english(words: list[str]) -> int:
    """Function words that are English only."""
    known = _languages_of()
    return sum(known.get(w) == ("en",) for w in words)


def hint(words: list[str], least: int = 6) -> str | None:
    """The language whose function words make up a quarter of ``least`` words or more, and twice as many as any other's."""
    if len(words) < least:
        return None
    ranked = sorted(votes(words).items(), key=lambda x: -x[1])
    (best, most), (_, second) = ranked[0], ranked[1]
    return best if most >= 2 and most * 4 >= len(words) and most >= 2 * second else None


_NORDIC = {lang: frozenset(FUNCTION_WORDS[lang].split()) - frozenset(FUNCTION_WORDS["en"].split()) for lang in ("fi", "sv")}


def nordic_scores(words: list[str]) -> dict[str, int]:
    """Points for Finnish and Swedish: two for a function word and for the letter å, one for an ending and for a doubled Finnish vowel."""
    out = {"fi": 0, "sv": 0}
    for w in words:
        for lang, some in _NORDIC.items():
            out[lang] += 2 * (w in some) + (len(w) >= 6 and w.endswith(NORDIC_ENDINGS[lang]))
        out["sv"] += 2 * ("å" in w)
        out["fi"] += DOUBLED.search(w) is not None
    return out


def nordic(words: list[str]) -> str | None:
    """Finnish or Swedish with four points or more, and twice the other's."""
    (best, most), (_, other) = sorted(nordic_scores(words).items(), key=lambda x: -x[1])
    return best if most >= 4 and most >= 2 * other else None


def looks_not_english(words: list[str], known: Callable[[str], bool] | None = None) -> bool:
    """Eighty words or more, under 8 of 100 English function words, and 5 of 100 beyond ASCII or, by the dictionary, under half known."""
    n = len(words)
    if n < 80 or english(words) * 100 >= 8 * n:
        return False
    return sum(not w.isascii() for w in words) * 20 >= n or (known is not None and sum(map(known, words)) * 2 < n)


def words_of(text: str) -> list[str]:
    return [w.lower() for w in WORD.findall(text)]


def language_of(texts: list[str], known: Callable[[str], bool] | None = None) -> str | None:
    """Language of prose that does not look English (``und`` if none of those known here), else None."""
    words = [w for t in texts for w in words_of(t)]
    if not looks_not_english(words, known):
        return None
    return hint(words) or nordic(words) or "und"


def phrases(text: str) -> Iterator[tuple[int, int]]:
    at = 0
    for m in PHRASE_END.finditer(text):
        if text[at : m.start()].strip():
            yield at, m.start()
        at = m.end()
    if text[at:].strip():
        yield at, len(text)


def stretches(text: str, language: str) -> list[tuple[int, int, str]]:
    """Phrases of ``text`` that are in another language: told by themselves, or by the whole text where that is decisive."""
    def told(words: list[str], least: int) -> str | None:
        return hint(words, least) or (nordic(words) if len(words) >= least else None)

    whole = told(words_of(text), 6)
    out = []
    for a, b in phrases(text):
        words = words_of(text[a:b])
        # a phrase that tells nothing goes with the whole, unless English words outweigh that language's
        own = told(words, 4) or (whole if whole and votes(words).get(whole, 0) >= english(words) else None)
        if own and own != language:
            out.append((a, b, own))
    return out
