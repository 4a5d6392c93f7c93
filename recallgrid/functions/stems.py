"""Porter's stemmer of 1980 and the folding of diacritics, over distinct words at a time."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# The rules of the steps, longest suffix first where one ends in another; and the marks that are folded away.
STEP_2 = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"),
    ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
)
STEP_3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")
FOLDED_MARKS = frozenset(map(chr, (768, 769, 770, 771, 772, 774, 775, 776, 777, 778, 779, 780, 783, 785, 795, 803, 804, 805, 806, 807, 808, 813, 814, 816, 817)))
#: Words of fewer or more UTF-8 bytes are left as they are.
SHORTEST, LONGEST = 3, 64
#: Stems that a task remembers.
REMEMBERED = 1 << 16


def _shape(word: str) -> str:
    """v for vowels and c for consonants; y is a vowel after a consonant."""
    out = ""
    for ch in word:
        out += "v" if ch in "aeiou" or (ch == "y" and out[-1:] == "c") else "c"
    return out


def _measure(stem: str) -> int:
    """How often a vowel stands before a consonant."""
    return _shape(stem).count("vc")


def _has_vowel(stem: str) -> bool:
    return "v" in _shape(stem)


def _short_end(stem: str) -> bool:
    """Ends consonant, vowel, consonant, the last not w, x or y."""
    return _shape(stem)[-3:] == "cvc" and stem[-1] not in "wxy"


def _double_end(stem: str) -> bool:
    return len(stem) > 1 and stem[-1] == stem[-2] and _shape(stem)[-1] == "c"


def _replaced(word: str, rules, least: int) -> str:
    """By the rule with the longest suffix of the word, if what stands before it has more than ``least`` measures."""
    for suffix, to in sorted(rules, key=lambda r: -len(r[0])):
        if word.endswith(suffix):
            stem = word[: len(word) - len(suffix)]
            return stem + to if _measure(stem) > least else word
    return word


def porter(word: str) -> str:
    if not SHORTEST <= len(word.encode()) <= LONGEST:
        return word
    w = word
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    else:
        for suffix in ("ed", "ing"):
            if w.endswith(suffix):
                stem = w[: -len(suffix)]
                if _has_vowel(stem):
                    if stem.endswith(("at", "bl", "iz")):
                        stem += "e"
                    elif _double_end(stem) and stem[-1] not in "lsz":
                        stem = stem[:-1]
                    elif _measure(stem) == 1 and _short_end(stem):
                        stem += "e"
                    w = stem
                break
    if w.endswith("y") and _has_vowel(w[:-1]):
        w = w[:-1] + "i"
    w = _replaced(_replaced(w, STEP_2, 0), STEP_3, 0)
    for suffix in sorted(STEP_4, key=len, reverse=True):
        if w.endswith(suffix):
            stem = w[: -len(suffix)]
            if _measure(stem) > 1 and (suffix != "ion" or stem[-1:] in ("s", "t")):
                w = stem
            break
    if w.endswith("e") and (_measure(w[:-1]) > 1 or (_measure(w[:-1]) == 1 and not _short_end(w[:-1]))):
        w = w[:-1]
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w


def folded(text: str) -> str:
    """Without combining marks that are folded, and with Latin letters of one such mark as their letter."""
    if text.isascii():
        return text
    out = []
    for ch in text:
        if unicodedata.combining(ch):
            out.append("" if ch in FOLDED_MARKS else ch)
            continue
        parts = unicodedata.normalize("NFD", ch)
        plain = len(parts) == 2 and parts[1] in FOLDED_MARKS and parts[0].isascii() and parts[0].isalpha()
        out.append(parts[0] if plain else ch)
    return "".join(out)


def stemmed(words: Column) -> Column:
    """The stems of words (in lower case), diacritics folded. Meant for distinct words: a vocabulary, not a text."""

    @F.pandas_udf("string")
    def stem(values: pd.Series) -> pd.Series:
        return values.map(lambda w: porter(folded(w)), na_action="ignore")

    return stem(words)


@lru_cache(REMEMBERED)
def _stem(word: str) -> str:
    return porter(folded(word))


def all_stemmed(words: Column) -> Column:
    """The stems of arrays of words (in lower case, none null), as ``stemmed``. Each distinct word of a batch is stemmed once."""

    @F.arrow_udf("array<string>")
    def stem(lists: pa.Array) -> pa.Array:
        known = lists.flatten().dictionary_encode()
        made = pa.array([_stem(w) for w in known.dictionary.to_pylist()], pa.string()).take(known.indices)
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lists.value_lengths())]), pa.int32()), made)

    return stem(words)
