"""The English stemmer, and its application to a column of distinct words."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_VOWELS = frozenset("aeiouy")
_UNTOUCHED = frozenset({"sky", "news", "howe", "atlas", "cosmos", "bias", "andes"})
_FIXED = {
    "skis": "ski", "skies": "sky", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli",
    "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe",
}
_R1_PREFIXES = ("gener", "commun", "arsen", "past", "univers", "later", "emerg", "organ")
_DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
_KEEP_ING = frozenset({"inn", "out", "cann", "herr", "earr", "even"})
#: Suffixes of a step, longest first; the first that a word has decides.
_STEP_2 = (
    ("ization", "ize"), ("ational", "ate"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"), ("tional", "tion"),
    ("biliti", "ble"), ("lessli", "less"), ("entli", "ent"), ("ation", "ate"), ("alism", "al"), ("aliti", "al"),
    ("ousli", "ous"), ("iviti", "ive"), ("ogist", "og"), ("fulli", "ful"), ("enci", "ence"), ("anci", "ance"),
    ("abli", "able"), ("izer", "ize"), ("ator", "ate"), ("alli", "al"), ("bli", "ble"), ("ogi", "og"), ("li", ""),
)
_STEP_3 = (
    ("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ative", ""),
    ("ical", "ic"), ("ness", ""), ("ful", ""),
)
_STEP_4 = "ement ance ence able ible ment ant ent ism ate iti ous ive ize ion al er ic".split()


def _has_vowel(part: str) -> bool:
    return any(c in _VOWELS for c in part)


def _first_syllable_end(word: str, start: int) -> int:
    """The place after the first consonant that follows a vowel, from start on; -1 if there is none."""
    vowel = False
    for k in range(start, len(word)):
        if word[k] in _VOWELS:
            vowel = True
        elif vowel:
            return k + 1
    return -1


def _regions(word: str) -> tuple[int, int]:
    size = len(word)
    r1 = next((len(p) for p in _R1_PREFIXES if word.startswith(p)), -1)
    if r1 < 0:
        r1 = _first_syllable_end(word, 0)
    if r1 < 0:
        return size, size
    r2 = _first_syllable_end(word, r1)
    return r1, size if r2 < 0 else r2


def _short_end(word: str) -> bool:
    """Whether a word ends in a short syllable."""
    if word == "past":
        return True
    if len(word) > 2:
        a, b, c = word[-3:]
        return a not in _VOWELS and b in _VOWELS and c not in "aeiouwxY"
    return len(word) == 2 and word[0] in _VOWELS and word[1] not in _VOWELS


def _step_1b(word: str, r1: int) -> str:
    for suffix in ("eedly", "eed"):
        if word.endswith(suffix):
            stem = word[: -len(suffix)]
            if len(stem) >= r1 and not word.startswith(("proc", "exc", "succ")):
                return stem + "ee"
            return word
    suffix = next((s for s in ("ingly", "edly", "ing", "ed") if word.endswith(s)), None)
    if suffix is None:
        return word
    stem = word[: -len(suffix)]
    if suffix == "ing":
        if len(word) == 5 and stem[1] == "y" and stem[0] not in _VOWELS:
            return stem[0] + "ie"
        if stem in _KEEP_ING:
            return word
    if not _has_vowel(stem):
        return word
    if stem.endswith(("at", "bl", "iz")):
        return stem + "e"
    if stem.endswith(_DOUBLES) and not (len(stem) == 3 and stem[0] in "aeo"):
        return stem[:-1]
    return stem + "e" if r1 >= len(stem) and _short_end(stem) else stem


def stem(word: str) -> str:
    """The stem of a lower-cased word; short, excepted and non-ASCII words stay as they are."""
    if len(word.encode()) <= 2 or word in _UNTOUCHED or not word.isascii():
        return word
    word = word.removeprefix("'")
    if word in _FIXED:
        return _FIXED[word]
    if word.startswith("y"):
        word = "Y" + word[1:]
    # A y that follows a vowel is a consonant; it still counts as a vowel for the next letter.
    letters = [("Y" if c == "y" and k and word[k - 1] in _VOWELS else c) for k, c in enumerate(word)]
    word = "".join(letters)
    r1, r2 = _regions(word)

    for suffix in ("'s'", "'s", "'"):
        if word.endswith(suffix):
            word = word[: -len(suffix)]
            break

    if word.endswith("sses"):
        word = word[:-2]
    elif word.endswith(("ied", "ies")):
        word = word[:-3] + ("i" if len(word) > 4 else "ie")
    elif word.endswith("s") and not word.endswith(("us", "ss")) and len(word) > 2 and _has_vowel(word[:-2]):
        word = word[:-1]

    word = _step_1b(word, r1)

    if len(word) > 2 and word[-1] in "yY" and word[-2] not in _VOWELS:
        word = word[:-1] + "i"

    for suffix, other in _STEP_2:
        if word.endswith(suffix):
            left = word[: -len(suffix)]
            if len(left) >= r1 and (
                left.endswith("l") if suffix == "ogi" else left[-1:] in tuple("cdeghkmnrt") if suffix == "li" else True
            ):
                word = left + other
            break

    for suffix, other in _STEP_3:
        if word.endswith(suffix):
            left = word[: -len(suffix)]
            if len(left) >= (max(r1, r2) if suffix == "ative" else r1):
                word = left + other
            break

    for suffix in _STEP_4:
        if word.endswith(suffix):
            left = word[: -len(suffix)]
            if len(left) >= r2 and (suffix != "ion" or left.endswith(("s", "t"))):
                word = left
            break

    last = len(word) - 1
    if word.endswith("e"):
        if last >= r2 or last >= r1 and not _short_end(word[:-1]):
            word = word[:-1]
    elif word.endswith("ll") and last >= r2:
        word = word[:-1]
    return word.replace("Y", "y")


@F.arrow_udf(StringType())
def stem_column(words: pa.Array) -> pa.Array:
    """stem() of each word; meant for distinct words."""
    return pa.array([None if w is None else stem(w) for w in words.to_pylist()], pa.string())


def stemmed(vocabulary: DataFrame, word: str = "word") -> DataFrame:
    """(word, token) of a table of distinct words."""
    return vocabulary.select(F.col(word).alias("word"), stem_column(F.col(word)).alias("token"))
