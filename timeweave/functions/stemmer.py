"""English stems by the published Snowball algorithm (Porter's second).

Each step looks for the longest of its endings; what becomes of it depends on the two regions R1 and R2,
which begin after the first consonant that follows a vowel, and after the next one within R1. Stems are
made of words, not of texts: callers stem each distinct word of a task once (``Stems``).
"""

from __future__ import annotations

import re

# The published tables of the algorithm.
SPECIAL = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
#: Words that stay as the plural's loss leaves them.
FINISHED = ["inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"]
#: Beginnings whose end is where R1 begins.
EARLY_R1 = ["gener", "commun", "arsen"]
DOUBLES = ["bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt"]
BEFORE_LI = "cdeghkmnrt"
#: Step 2, in R1: endings and what takes their place; ``ogi`` after l only, ``li`` after some consonants.
DERIVED = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful",
    "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
}
#: Step 3, in R1; ``ative`` in R2.
SHORTENED = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
#: Step 4, in R2, dropped; ``ion`` after s or t only.
DROPPED = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion"]

_VOWEL = "aeiouy"
_REGION = re.compile(f"[{_VOWEL}][^{_VOWEL}]")
_EARLY = re.compile("|".join(EARLY_R1))
_SHORT = re.compile(f"(?:^|[^{_VOWEL}])[{_VOWEL}][^{_VOWEL}wxY]$|^[{_VOWEL}][^{_VOWEL}]$")


#: Endings with the longest first.
_PAST, _DERIVED, _SHORTENED, _DROPPED = (tuple(sorted(e, key=len, reverse=True)) for e in (("eed", "eedly", "ed", "edly", "ing", "ingly"), DERIVED, SHORTENED, DROPPED))


def _longest(word: str, endings: tuple) -> str | None:
    return next(e for e in endings if word.endswith(e)) if word.endswith(endings) else None


def _has_vowel(part: str) -> bool:
    return any(c in _VOWEL for c in part)


def _past(word: str, r1: int) -> str:
    """Step 1b: -eed, -ed and -ing with or without -ly."""
    end = _longest(word, _PAST)
    if end is None:
        return word
    left = word[: -len(end)]
    if end.startswith("eed"):
        return left + "ee" if len(left) >= r1 else word
    if not _has_vowel(left):
        return word
    if left.endswith(("at", "bl", "iz")):
        return left + "e"
    if left.endswith(tuple(DOUBLES)):
        return left[:-1]
    return left + "e" if len(left) <= r1 and _SHORT.search(left) else left


def _plural(word: str) -> str:
    """Step 1a."""
    if word.endswith("sses"):
        return word[:-2]
    if word.endswith(("ied", "ies")):
        return word[:-2] if len(word) > 4 else word[:-1]
    if word.endswith("s") and not word.endswith(("us", "ss")) and _has_vowel(word[:-2]):
        return word[:-1]
    return word


def _replaced(word: str, endings: dict, longest: tuple, r1: int, r2: int) -> str:
    """Steps 2 and 3."""
    end = _longest(word, longest)
    if end is None:
        return word
    left = word[: -len(end)]
    allowed = len(left) >= (r2 if end == "ative" else r1)
    if end == "ogi":
        allowed &= left.endswith("l")
    elif end == "li":
        allowed &= left[-1:] in tuple(BEFORE_LI)
    return left + endings[end] if allowed else word


def stem(word: str) -> str:
    """The stem of a word in lower case."""
    if len(word) <= 2:
        return word
    if word in SPECIAL:
        return SPECIAL[word]
    word = word.removeprefix("'")
    if "y" in word:  # a consonant, Y, at the beginning and after a vowel
        marked, before = [], ""
        for c in word:
            before = "Y" if c == "y" and (not marked or before in _VOWEL) else c
            marked.append(before)
        word = "".join(marked)
    early = _EARLY.match(word)
    first = early or _REGION.search(word)
    r1 = first.end() if first else len(word)
    second = _REGION.search(word, r1)
    r2 = second.end() if second else len(word)
    word = _plural(re.sub("'s'$|'s$|'$", "", word) if "'" in word else word)
    if word in FINISHED:
        return word
    word = _past(word, r1)
    if len(word) > 2 and word[-1] in "yY" and word[-2] not in _VOWEL:
        word = word[:-1] + "i"
    word = _replaced(_replaced(word, DERIVED, _DERIVED, r1, r2), SHORTENED, _SHORTENED, r1, r2)
    end = _longest(word, _DROPPED)
    if end and len(word) - len(end) >= r2 and (end != "ion" or word[: -len(end)].endswith(("s", "t"))):
        word = word[: -len(end)]
    left = word[:-1]
    if word.endswith("e") and (len(left) >= r2 or len(left) >= r1 and not _SHORT.search(left)):
        word = left
    elif word.endswith("ll") and len(left) >= r2:
        word = left
    return word.replace("Y", "y")


class Stems(dict):
    """Stems of the words met so far; it begins anew when it holds ``most``."""

    def __init__(self, most: int = 200_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: str) -> str:
        if len(self) >= self.most:
            self.clear()
        self[word] = found = stem(word)
        return found
