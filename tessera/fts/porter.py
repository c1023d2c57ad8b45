"""The Porter stemmer (M. F. Porter, 1980)."""

from __future__ import annotations

import re

_VOWEL = "aeiou"


def _consonant(w: str, i: int) -> bool:
    if w[i] in _VOWEL:
        return False
    return w[i] != "y" or i == 0 or not _consonant(w, i - 1)


def _measure(w: str) -> int:
    shape = re.sub(r"(.)\1*", r"\1", "".join("c" if _consonant(w, i) else "v" for i in range(len(w))))
    return shape.count("vc")


def _has_vowel(w: str) -> bool:
    return any(not _consonant(w, i) for i in range(len(w)))


def _double(w: str) -> bool:
    return len(w) > 1 and w[-1] == w[-2] and _consonant(w, len(w) - 1)


def _cvc(w: str) -> bool:
    n = len(w)
    return n > 2 and _consonant(w, n - 1) and not _consonant(w, n - 2) and _consonant(w, n - 3) and w[-1] not in "wxy"


#: Suffixes of steps 2, 3 and 4 with what replaces them.
_STEP2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "logi": "log", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous",
    "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
_STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()


def _replace(w: str, table: dict[str, str]) -> str:
    for suffix in sorted(table, key=len, reverse=True):
        if w.endswith(suffix):
            stem = w[: -len(suffix)]
            return stem + table[suffix] if _measure(stem) > 0 else w
    return w


def stem(w: str) -> str:
    """Stem of a lower-case term; terms with other letters than a to z and short ones stay."""
    if len(w) < 3 or not re.fullmatch("[a-z]+", w):
        return w
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    again = False
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    elif w.endswith("ed") and _has_vowel(w[:-2]):
        w, again = w[:-2], True
    elif w.endswith("ing") and _has_vowel(w[:-3]):
        w, again = w[:-3], True
    if again:
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif _double(w) and w[-1] not in "lsz":
            w = w[:-1]
        elif _measure(w) == 1 and _cvc(w):
            w += "e"
    if w.endswith("y") and _has_vowel(w[:-1]):
        w = w[:-1] + "i"
    w = _replace(_replace(w, _STEP2), _STEP3)
    for suffix in sorted(_STEP4, key=len, reverse=True):
        if w.endswith(suffix):
            s = w[: -len(suffix)]
            if _measure(s) > 1 and (suffix != "ion" or s.endswith(("s", "t"))):
                w = s
            break
    if w.endswith("e") and (_measure(w[:-1]) > 1 or (_measure(w[:-1]) == 1 and not _cvc(w[:-1]))):
        w = w[:-1]
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w
