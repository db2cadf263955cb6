"""Functions on words: edit distance, syllables, letter case."""

from __future__ import annotations

import re
from functools import lru_cache

#: Words that stay in lower case in titles (fixed values).
MINOR = frozenset("a an and as at but by for from if in into nor of off on onto or out over per so than the to up via with yet".split())


def edit_distance(a: str, b: str, most: int) -> int:
    """Edits between two words, neighbouring letters swapped counting as one; ``most + 1`` when there are more."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, last = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            cost = min(last[j] + 1, now[j - 1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                cost = min(cost, before[j - 2] + 1)
            now.append(cost)
        before, last = last, now
    return last[-1]


def near_misses(word: str, known, n: int = 3) -> list[str]:
    """The known words nearest to ``word``: one edit apart for words up to 3 letters, else two."""
    most = 1 if len(word) <= 3 else 2
    found = [(d, k) for k in known if (d := edit_distance(word, k, most)) <= most]
    return [k for _, k in sorted(found)[:n]]


def syllables(word: str) -> int:
    """English syllables by vowel groups, without a silent final e and unsounded endings."""
    return _syllables(word) if len(word) < 40 else _syllables.__wrapped__(word)


@lru_cache(maxsize=1 << 16)
def _syllables(word: str) -> int:
    """Counted once a distinct word, not once a place; only words of common length are held."""
    w = re.sub(r"[^a-z]", "", word.lower())
    if len(w) <= 3:
        return 1
    n = len(re.findall(r"[aeiouy]+", w))
    if re.search(r"[^aeiouy]e$", w) and not re.search(r"[^aeiouy]le$", w):
        n -= 1
    elif re.search(r"[^aeiouytd]ed$", w) or re.search(r"[^aeiouyszxc]es$", w) and not w.endswith(("ches", "shes")):
        n -= 1
    return max(1, n)


def grade(words: int, sentences: int, syllables_: int) -> float:
    """Flesch-Kincaid grade."""
    return 0.39 * words / max(1, sentences) + 11.8 * syllables_ / max(1, words) - 15.59


def recased(text: str, style: str, accepted=frozenset()) -> str:
    """A heading in sentence or title case; words with digits, inner capitals or in ``accepted`` stay."""
    parts = re.split(r"(\s+)", text)
    words = [i for i, p in enumerate(parts) if p.strip()]
    out, opening = list(parts), True
    for k, i in enumerate(words):
        word = parts[i]
        core = word.strip("\"'()[]:,.!?`")
        fixed = core in accepted or any(c.isdigit() for c in core) or core[1:] != core[1:].lower() or "`" in word
        if not fixed and core:
            at = word.index(core)
            if style == "title":
                big = k in (0, len(words) - 1) or opening or core.lower() not in MINOR
            else:
                big = k == 0 or opening
            out[i] = word[:at] + (core[0].upper() if big else core[0].lower()) + word[at + 1 :]
        opening = word.endswith((":", ".", "!", "?"))
    return "".join(out)
