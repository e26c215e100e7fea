"""Stemming and folding of tokens: the published Porter (1980) rules, and diacritics removed."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Suffix rules of the published algorithm, longest first within each step.
_STEP2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e",
    "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous",
    "aliti": "al", "iviti": "ive", "biliti": "ble",
}
_STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _shape(word: str) -> str:
    """c for a consonant, v for a vowel; y after a consonant is a vowel."""
    out = ""
    for i, ch in enumerate(word):
        out += "v" if ch in "aeiou" or (ch == "y" and i and out[-1] == "c") else "c"
    return out


def _measure(stem: str) -> int:
    return _shape(stem).replace("cv", "c v").count("vc")


def _cvc(stem: str) -> bool:
    return _shape(stem)[-3:] == "cvc" and stem[-1] not in "wxy"


def _suffix(word: str, rules) -> str | None:
    return max((s for s in rules if word.endswith(s)), key=len, default=None)


def stem(word: str) -> str:
    if len(word) < 3 or not word.isascii() or not word.isalpha():
        return word
    if word.endswith("sses"):
        word = word[:-2]
    elif word.endswith("ies"):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if word.endswith("eed"):
        if _measure(word[:-3]) > 0:
            word = word[:-1]
    else:
        cut = next((s for s in ("ed", "ing") if word.endswith(s) and "v" in _shape(word[: -len(s)])), None)
        if cut:
            word = word[: -len(cut)]
            if word.endswith(("at", "bl", "iz")):
                word += "e"
            elif len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c" and word[-1] not in "lsz":
                word = word[:-1]
            elif _measure(word) == 1 and _cvc(word):
                word += "e"
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    for rules in (_STEP2, _STEP3):
        found = _suffix(word, rules)
        if found and _measure(word[: -len(found)]) > 0:
            word = word[: -len(found)] + rules[found]
    found = _suffix(word, _STEP4)
    if found:
        rest = word[: -len(found)]
        if _measure(rest) > 1 and (found != "ion" or rest.endswith(("s", "t"))):
            word = rest
    if word.endswith("e"):
        rest = word[:-1]
        if _measure(rest) > 1 or (_measure(rest) == 1 and not _cvc(rest)):
            word = rest
    if word.endswith("ll") and _measure(word) > 1:
        word = word[:-1]
    return word


def fold(token: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", token) if not unicodedata.combining(c))


def analyse_tokens(tokens: list[str]) -> list[str]:
    """The stemming analyzer for query terms."""
    return [stem(fold(t)) for t in tokens]


@F.pandas_udf(T.ArrayType(T.StringType()))
def analysed(tokens: pd.Series) -> pd.Series:
    """The stemming analyzer for token arrays; stems are remembered within a batch."""
    known: dict[str, str] = {}

    def one(values):
        out = []
        for t in values:
            if t not in known:
                known[t] = stem(fold(t))
            out.append(known[t])
        return out

    return tokens.map(one, na_action="ignore")
