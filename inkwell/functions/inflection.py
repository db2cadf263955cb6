"""Inflected forms of vocabulary terms: English possessives, Swedish genitives and articles, Finnish cases with consonant gradation."""

from __future__ import annotations

import re
from functools import lru_cache

#: Finnish case endings behind a stem; A stands for a or ä by vowel harmony (fixed values).
FINNISH_CASES = ("n", "A", "tA", "ssA", "stA", "llA", "ltA", "lle", "nA", "ksi", "ttA")
#: Possessive and clitic endings that may follow a case.
FINNISH_TAILS = r"(?:ni|si|nsa|nsä|mme|nne)?(?:kin|kaan|kään|ko|kö|han|hän|pa|pä)?"
#: Strong grades and their weak ones, longest first (fixed values).
GRADATION = (("kk", "k"), ("pp", "p"), ("tt", "t"), ("nk", "ng"), ("mp", "mm"), ("nt", "nn"), ("lt", "ll"), ("rt", "rr"), ("p", "v"), ("t", "d"), ("k", ""))
SWEDISH = ("s", "n", "en", "et", "ns", "ens", "ets", "ar", "or", "er", "na", "arna", "orna", "erna", "ars", "arnas", "r", "rna")
VOWELS = "aeiouyäöå"


def back(word: str) -> bool:
    """Whether Finnish endings take a and o: by the last of the vowels that decide."""
    told = [c for c in word.lower() if c in "aouäöy"]
    return not told or told[-1] in "aou"


def weak(stem: str) -> str | None:
    """The stem with its last consonants in the weak grade, where they have one before a final vowel."""
    if len(stem) < 4 or stem[-1] not in VOWELS:
        return None
    for strong, soft in GRADATION:
        if stem[:-1].endswith(strong) and stem[: -1 - len(strong)][-1:] not in ("s", "h") and (len(strong) > 1 or stem[: -1 - len(strong)][-1:] in VOWELS + "lr"):
            return stem[: -1 - len(strong)] + soft + stem[-1]
    return None


@lru_cache(maxsize=4096)
def forms(term: str, language: str) -> str:
    """A regular expression of the term and its inflected forms."""
    own = re.escape(term)
    if language == "en":
        plural = "(?:es)?" if re.search(r"(?:s|x|z|ch|sh)$", term) else "s?"
        return f"{own}(?:{plural}(?:['’]s|['’])?)"
    if language == "sv":
        return f"{own}(?::?(?:{'|'.join(sorted(SWEDISH, key=len, reverse=True))}))?"
    if language == "fi":
        a = "a" if back(term) else "ä"
        cases = [c.replace("A", a) for c in FINNISH_CASES]
        last = term[-1:].lower()
        if last in VOWELS:
            stems = {term, *filter(None, (weak(term),))}
            if last == "i":
                stems |= {s[:-1] + "e" for s in set(stems)}
            endings = [*cases, last + "n", "h" + last + "n", "seen", "jen", "iden", "t"]
        else:
            stems, endings = {term + "i", term + "e"}, [*cases, "in", "en", "t", "ien"]
            stems |= {term[:-2] + "kse"} if term.lower().endswith(("us", "ys", "os", "is")) else set()
            stems |= {term[:-3] + "se"} if term.lower().endswith("nen") else set()
        tail = "|".join(sorted(set(endings), key=len, reverse=True))
        # an acronym takes its ending behind a colon
        return f"(?:{own}|{own}:(?:{tail})|(?:{'|'.join(map(re.escape, sorted(stems, key=len, reverse=True)))})(?:{tail})?){FINNISH_TAILS}"
    return own + r"(?:['’]?s)?"


def phrase_pattern(terms, language: str) -> re.Pattern | None:
    """One pattern of all terms with their forms, the longest first; only the last word of a phrase is inflected."""
    own = sorted({t.strip() for t in terms if t.strip()}, key=lambda t: (-len(t), t))
    return re.compile(r"(?<![\w-])(?:" + "|".join(forms(t, language) for t in own) + r")(?![\w-])", re.I) if own else None


#: Endings that other languages' words may have on top of a dictionary word (fixed values).
TOLERATED = {
    "de": ("e", "en", "er", "em", "es", "s", "n", "st", "t", "te", "ten"), "fr": ("s", "e", "es", "x", "ment"), "es": ("s", "es", "mente"), "pt": ("s", "es", "mente"),
    "sv": SWEDISH + ("t", "a", "ade", "at", "are", "ast"), "fi": ("n", "a", "ä", "ta", "tä", "ssa", "ssä", "sta", "stä", "lla", "llä", "lta", "ltä", "lle", "na", "nä", "ksi", "t", "kin", "ko", "kö", "ni", "nsa", "nsä"),
}
#: Languages that join words to new ones, and what may stand between the parts.
COMPOUNDING = {"de": ("", "s", "n", "en"), "sv": ("", "s"), "fi": ("", "n")}
