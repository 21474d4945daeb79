"""The Porter stemmer (1980), as a function and as a vectorised column function."""

from __future__ import annotations

from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_STEP2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble"}
_STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _shape(w: str) -> str:
    """The word's letters as v and c."""
    s = ""
    for i, c in enumerate(w):
        s += "v" if c in "aeiou" or (c == "y" and i and s[-1] == "c") else "c"
    return s


def _measure(w: str) -> int:
    return _shape(w).count("vc")


def _cvc(w: str) -> bool:
    return _shape(w)[-3:] == "cvc" and w[-1] not in "wxy"


def _longest(w: str, endings) -> str | None:
    return max((e for e in endings if w.endswith(e)), key=len, default=None)


@lru_cache(100_000)
def porter(w: str) -> str:
    if len(w) < 3 or not w.isascii() or not w.isalpha():
        return w
    if w.endswith(("sses", "ies")):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    again = False
    if w.endswith("eed"):
        if _measure(w[:-3]):
            w = w[:-1]
    else:
        for e in ("ed", "ing"):
            if w.endswith(e) and "v" in _shape(w[: -len(e)]):
                w, again = w[: -len(e)], True
                break
    if again:
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif len(w) > 1 and w[-1] == w[-2] and _shape(w)[-1] == "c" and w[-1] not in "lsz":
            w = w[:-1]
        elif _measure(w) == 1 and _cvc(w):
            w += "e"
    if w.endswith("y") and "v" in _shape(w[:-1]):
        w = w[:-1] + "i"
    for table in (_STEP2, _STEP3):
        e = _longest(w, table)
        if e and _measure(w[: -len(e)]):
            w = w[: -len(e)] + table[e]
    e = _longest(w, (*_STEP4, "ion"))
    if e and _measure(w[: -len(e)]) > 1 and (e != "ion" or w[: -len(e)].endswith(("s", "t"))):
        w = w[: -len(e)]
    if w.endswith("e") and (_measure(w[:-1]) > 1 or (_measure(w[:-1]) == 1 and not _cvc(w[:-1]))):
        w = w[:-1]
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w


def stems(tokens: str | Column) -> Column:
    """The stems of a list of words; each word of a batch is stemmed once."""

    @F.arrow_udf(T.ArrayType(T.StringType()))
    def run(lists: pa.Array) -> pa.Array:
        coded = lists.flatten().dictionary_encode()
        stemmed = pa.DictionaryArray.from_arrays(coded.indices, pa.array([porter(w) for w in coded.dictionary.to_pylist()], pa.string())).cast(pa.string())
        return type(lists).from_arrays(pc.subtract(lists.offsets, lists.offsets[0]), stemmed)

    return run(tokens)
