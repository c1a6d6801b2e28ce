"""Stems of English words by suffix steps whose conditions count a stem's vowel-consonant runs
(M. F. Porter, An algorithm for suffix stripping, 1980), as one function over Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ranklode.functions.text import col

# The suffixes of steps 2, 3 and 4, and what becomes of them.
SECOND = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous",
    "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
THIRD = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
FOURTH = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")
# End of fixed values.


def _shape(stem: str) -> str:
    """v and c for the stem's vowels and consonants; y is a vowel behind a consonant."""
    out = ""
    for x in stem:
        out += "v" if x in "aeiou" or (x == "y" and out.endswith("c")) else "c"
    return out


def _measure(stem: str) -> int:
    """How often a run of vowels is followed by one of consonants."""
    return len(re.findall("v+c+", _shape(stem)))


def _short_end(stem: str) -> bool:
    """Consonant, vowel, consonant, the last none of w, x and y."""
    return _shape(stem).endswith("cvc") and stem[-1] not in "wxy"


def _longest(word: str, suffixes) -> str | None:
    return max((s for s in suffixes if word.endswith(s)), key=len, default=None)


def _changed(word: str, table: dict[str, str]) -> str:
    end = _longest(word, table)
    return word[: -len(end)] + table[end] if end and _measure(word[: -len(end)]) > 0 else word


@lru_cache(maxsize=1 << 17)
def stem(word: str) -> str:
    """The stem of a lower-case word of a-z; others stay as they are, and so do one or two letters."""
    if len(word) < 3 or not (word.isascii() and word.isalpha() and word.islower()):
        return word
    end = _longest(word, ("sses", "ies", "ss", "s"))
    if end:
        word = word[: len(word) - {"sses": 2, "ies": 2, "ss": 0, "s": 1}[end]]
    if word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) > 0 else word
    else:
        end = _longest(word, ("ed", "ing"))
        if end and "v" in _shape(word[: -len(end)]):
            word = word[: -len(end)]
            if word.endswith(("at", "bl", "iz")):
                word += "e"
            elif len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c" and word[-1] not in "lsz":
                word = word[:-1]
            elif _measure(word) == 1 and _short_end(word):
                word += "e"
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    word = _changed(_changed(word, SECOND), THIRD)
    end = _longest(word, FOURTH)
    if end and _measure(word[: -len(end)]) > 1 and (end != "ion" or word[-4] in "st"):
        word = word[: -len(end)]
    if word.endswith("e"):
        m = _measure(word[:-1])
        if m > 1 or (m == 1 and not _short_end(word[:-1])):
            word = word[:-1]
    return word[:-1] if word.endswith("ll") and _measure(word) > 1 else word


def stems(words) -> Column:
    """The stems of an array of words; null words stay null."""

    @F.pandas_udf("array<string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for rows in batches:
            yield pd.Series([None if row is None else [w if w is None else stem(w) for w in row] for row in rows])

    return run(col(words))
