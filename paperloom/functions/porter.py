"""The stemming algorithm of M. F. Porter (Program 14(3), 1980), from its published description.

with_stems() stems a table of distinct words by DataFrame functions, a column a step; stems() stems arrays of words in their rows, without a shuffle.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The suffixes of the published algorithm, in its order.
STEP2 = [
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"),
    ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
]
STEP3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]


def _shape(word: str) -> str:
    """v for each vowel, c for each consonant; y is a vowel after a consonant."""
    out = ""
    for k, letter in enumerate(word):
        vowel = letter in "aeiou" or letter == "y" and k > 0 and out[-1] == "c"
        out += "v" if vowel else "c"
    return out


def _measure(stem: str) -> int:
    return len(re.findall("v+c+", _shape(stem)))


def _short_end(stem: str) -> bool:
    """Ends consonant, vowel, consonant, the last not w, x or y."""
    return _shape(stem).endswith("cvc") and stem[-1] not in "wxy"


def _longest(word: str, suffixes) -> str | None:
    return max((s for s in suffixes if word.endswith(s)), key=len, default=None)


@lru_cache(maxsize=100_000)
def stem(word: str) -> str:
    """The stem of a word in small letters. Words of one or two letters are their own stems."""
    if len(word) < 3:
        return word
    if word.endswith("sses") or word.endswith("ies"):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if word.endswith("eed"):
        if _measure(word[:-3]) > 0:
            word = word[:-1]
    else:
        for suffix in ("ed", "ing"):
            if word.endswith(suffix) and "v" in _shape(word[: -len(suffix)]):
                word = word[: -len(suffix)]
                if word.endswith(("at", "bl", "iz")):
                    word += "e"
                elif len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c" and word[-1] not in "lsz":
                    word = word[:-1]
                elif _measure(word) == 1 and _short_end(word):
                    word += "e"
                break
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    for table in (dict(STEP2), dict(STEP3)):
        suffix = _longest(word, table)
        if suffix and _measure(word[: -len(suffix)]) > 0:
            word = word[: -len(suffix)] + table[suffix]
    suffix = _longest(word, STEP4)
    if suffix and _measure(rest := word[: -len(suffix)]) > 1 and (suffix != "ion" or rest.endswith(("s", "t"))):
        word = rest
    if word.endswith("e"):
        m = _measure(word[:-1])
        if m > 1 or m == 1 and not _short_end(word[:-1]):
            word = word[:-1]
    if word.endswith("ll") and _measure(word) > 1:
        word = word[:-1]
    return word


@F.arrow_udf(T.ArrayType(T.StringType()))
def stems(lists: pa.Array) -> pa.Array:
    """The stems of arrays of words; each distinct word of a batch is stemmed once."""
    coded = lists.flatten().dictionary_encode()
    found = pa.array([None if w is None else stem(w) for w in coded.dictionary.to_pylist()], pa.string()).take(coded.indices)
    ends = np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(), dtype=np.int64)
    offsets = pa.array(np.append(0, ends), pa.int32(), mask=np.append(lists.is_null().to_numpy(zero_copy_only=False), False) if lists.null_count else None)
    return pa.ListArray.from_arrays(offsets, found)


# ---------------------------------------------------------------- on columns

#: Runs of consonants and of vowels: y is a consonant at the start and after a vowel, so it begins a run of either kind, and is inside none.
CONSONANTS, VOWELS = "(?:[^aeiou][^aeiouy]*)", "(?:[aeiouy][aeiou]*)"
#: A word up to the end of its first vowels.
FIRST = f"(?:{CONSONANTS}{VOWELS}|[aeiou]+)"
#: What a stem has to be like: at least one vowel; m above 0, 1, and above 1 (m counts vowels followed by consonants); m 1 with a short end; ending in a consonant.
HAS_VOWEL = f"^(?:[aeiou]|{CONSONANTS}[aeiouy])"
ABOVE_0 = f"^{FIRST}{CONSONANTS}"
JUST_1 = f"{ABOVE_0}{VOWELS}?$"
ABOVE_1 = f"{ABOVE_0}{VOWELS}{CONSONANTS}"
SHORT = f"^{CONSONANTS}[aeiouy][^aeiouwxy]$"
ENDS_CONSONANT = f"^(?:{CONSONANTS}|{FIRST}{CONSONANTS}(?:{VOWELS}{CONSONANTS})*)$"


def _cut(word: Column, n: int) -> Column:
    """Without the last n letters."""
    return F.left(word, F.length(word) - n)


def _first_ending(word: Column, rules: list[tuple[str, str]], condition) -> Column:
    """The word with its longest ending of some replaced, if the rest meets the condition(rest, ending)."""
    out = F
    for ending, instead in sorted(rules, key=lambda r: -len(r[0])):
        rest = _cut(word, len(ending))
        out = out.when(word.endswith(ending), F.when(condition(rest, ending), F.concat(rest, F.lit(instead))).otherwise(word))
    return out.otherwise(word)


def with_stems(table: DataFrame, word: str = "word", stem: str = "stem") -> DataFrame:
    """table with the stems of words in small letters. Give it distinct words: each step looks at each row."""
    w = F.col(stem)
    steps = [
        F.when(w.endswith("sses") | w.endswith("ies"), _cut(w, 2)).when(w.endswith("s") & ~w.endswith("ss"), _cut(w, 1)).otherwise(w),
        # What ed or ing is taken from is marked, as it may need an e or lose a letter.
        F.when(w.endswith("eed"), F.when(_cut(w, 3).rlike(ABOVE_0), _cut(w, 1)).otherwise(w))
        .when(w.endswith("ed") & _cut(w, 2).rlike(HAS_VOWEL), F.concat(_cut(w, 2), F.lit("+")))
        .when(w.endswith("ing") & _cut(w, 3).rlike(HAS_VOWEL), F.concat(_cut(w, 3), F.lit("+")))
        .otherwise(w),
        F.when(~w.endswith("+"), w)
        .when(w.rlike(r"(?:at|bl|iz)\+$"), F.concat(_cut(w, 1), F.lit("e")))
        .when((F.length(w) > 2) & (F.substring(w, -2, 1) == F.substring(w, -3, 1)) & _cut(w, 1).rlike(ENDS_CONSONANT) & ~w.rlike(r"[lsz]\+$"), _cut(w, 2))
        .when(_cut(w, 1).rlike(SHORT), F.concat(_cut(w, 1), F.lit("e")))
        .otherwise(_cut(w, 1)),
        F.when(w.endswith("y") & _cut(w, 1).rlike(HAS_VOWEL), F.concat(_cut(w, 1), F.lit("i"))).otherwise(w),
        _first_ending(w, STEP2, lambda rest, _: rest.rlike(ABOVE_0)),
        _first_ending(w, STEP3, lambda rest, _: rest.rlike(ABOVE_0)),
        _first_ending(w, [(x, "") for x in STEP4], lambda rest, ending: rest.rlike(ABOVE_1) & (rest.rlike("[st]$") if ending == "ion" else F.lit(True))),
        F.when(w.endswith("e") & (_cut(w, 1).rlike(ABOVE_1) | (_cut(w, 1).rlike(JUST_1) & ~_cut(w, 1).rlike(SHORT))), _cut(w, 1)).otherwise(w),
        F.when(w.endswith("ll") & w.rlike(ABOVE_1), _cut(w, 1)).otherwise(w),
    ]
    out = table.withColumn(stem, F.col(word))
    for step in steps:
        out = out.withColumn(stem, F.when(F.length(word) < 3, F.col(word)).otherwise(step))
    return out


def stem_texts(texts: DataFrame, key: str, words: Column, stem: str = "stems") -> DataFrame:
    """(key, stems: an array in the order of words, null where words is null) of texts. A text's words stay in its row, so there is no shuffle."""
    return texts.select(F.col(key), stems(words).alias(stem))
