"""English words reduced to their stems, by the suffix rules of the second Porter algorithm."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

#: Words with a stem of their own, and words that are their stems, before and after the plural is dropped.
OWN = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
}
WHOLE = frozenset({"sky", "news", "howe", "atlas", "cosmos", "bias", "andes"})
WHOLE_SINGULAR = frozenset({"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"})
#: Suffixes and what replaces them where they begin in the first region, and then again.
SECOND = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al",
    "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "fulli": "ful", "lessli": "less",
}
THIRD = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
FOURTH = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "al", "er", "ic")
DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
VOWEL = re.compile("[aeiouy]")
REGION = re.compile("[aeiouy][^aeiouy]")
SHORT_END = re.compile(r"(?:^[aeiouy][^aeiouy]|[^aeiouy][aeiouy][^aeiouywxY])$")


def _longest(word: str, suffixes) -> str | None:
    """The longest of the suffixes that the word has."""
    return max((s for s in suffixes if word.endswith(s)), key=len, default=None)


def _after(word: str, start: int) -> int:
    """Where the region begins that follows the first consonant after a vowel, from `start` on."""
    m = REGION.search(word, start)
    return m.end() if m else len(word)


def _singular(w: str) -> str:
    if w.endswith("sses"):
        return w[:-2]
    if w.endswith(("ied", "ies")):
        return w[:-2] if len(w) > 4 else w[:-1]
    if w.endswith("s") and not w.endswith(("us", "ss")) and VOWEL.search(w[:-2]):
        return w[:-1]
    return w


def _participle(w: str, r1: int) -> str:
    found = _longest(w, ("eedly", "ingly", "edly", "eed", "ing", "ed"))
    if found in ("eed", "eedly"):
        return w[: -len(found)] + "ee" if len(w) - len(found) >= r1 else w
    if not found or not VOWEL.search(w[: -len(found)]):
        return w
    w = w[: -len(found)]
    if w.endswith(("at", "bl", "iz")):
        return w + "e"
    if w.endswith(DOUBLES):
        return w[:-1]
    return w + "e" if r1 >= len(w) and SHORT_END.search(w) else w


@lru_cache(maxsize=200_000)
def stem(word: str) -> str:
    """The stem of a lower-case English word; words of up to two letters are theirs."""
    if len(word) <= 2 or word in WHOLE:
        return word
    if word in OWN:
        return OWN[word]
    w = word.lstrip("'")
    w = re.sub(r"^y|(?<=[aeiouy])y", "Y", w)
    begun = next((len(p) for p in ("gener", "commun", "arsen") if w.startswith(p)), None)
    r1 = begun if begun is not None else _after(w, 0)
    r2 = _after(w, r1)
    w = _singular(re.sub(r"'s?'?$", "", w))
    if w in WHOLE_SINGULAR:
        return w
    w = _participle(w, r1)
    if len(w) > 2 and w[-1] in "yY" and not VOWEL.match(w[-2]):
        w = w[:-1] + "i"
    found = _longest(w, (*SECOND, "ogi", "li"))
    if found and len(w) - len(found) >= r1:
        base = w[: -len(found)]
        if found == "ogi":
            w = base + "og" if base.endswith("l") else w
        elif found == "li":
            w = base if base.endswith(tuple("cdeghkmnrt")) else w
        else:
            w = base + SECOND[found]
    found = _longest(w, (*THIRD, "ative"))
    if found and len(w) - len(found) >= r1:
        w = w[: -len(found)] + THIRD[found] if found != "ative" else w[:-5] if len(w) - 5 >= r2 else w
    found = _longest(w, (*FOURTH, "ion"))
    if found and len(w) - len(found) >= r2 and (found != "ion" or w[-4:-3] in ("s", "t")):
        w = w[: -len(found)]
    if w.endswith("e") and (len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not SHORT_END.search(w[:-1]))) or w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.lower()


@pandas_udf(T.ArrayType(T.StringType()))
def _stems(words: pd.Series) -> pd.Series:
    return words.map(lambda ws: [stem(w) for w in ws], na_action="ignore")


def english_words(text: Column) -> Column:
    """Lower-cased runs of ASCII letters and digits, each as its stem."""
    return _stems(F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), F.lit(1)))
