"""Patterns, sentences and words."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def java_pattern(spark: SparkSession, pattern: str, ignore_case: bool = True, fixed: bool = False) -> str:
    """The pattern as Spark's engine takes it. Case is ignored for all alphabets; a fixed pattern stands for itself."""
    if fixed:
        return spark._jvm.java.util.regex.Pattern.quote(pattern)
    out = f"(?iu){pattern}" if ignore_case else pattern
    try:
        spark._jvm.java.util.regex.Pattern.compile(out)
    except Exception as e:  # a Java exception
        raise ValueError(f"Check the pattern argument:\n{getattr(e, 'java_exception', e)}") from None
    return out


def squeeze(x: Column) -> Column:
    """Runs of white space as one space, and no space before a comma that stands between spaces."""
    return F.replace(F.regexp_replace(x, r"\s+", " "), F.lit(" , "), F.lit(", "))


def guard_initials(x: Column) -> Column:
    """Without the full stop after single capital letters, at which sentences would be cut."""
    return F.regexp_replace(x, r"\b([A-Z])\.", "$1")


# A sentence ends with ! or ?, or with a full stop if the next letter is no small one; closing marks belong to it.
SENTENCE_END = r"""(?<=[!?][)\]"'’”]{0,2})\s+|(?<=[.][)\]"'’”]{0,2})\s+(?=[^\p{L}]*(?!\p{Ll})\p{L}|[^\p{L}]*$)"""


def sentences(x: Column) -> Column:
    """The sentences of a text, as an array."""
    return F.filter(F.transform(F.split(x, SENTENCE_END), lambda s: F.trim(s)), lambda s: s != "")


#: A word: letters and digits of any alphabet, with single full stops or apostrophes inside, and commas before digits.
WORD = r"[\p{L}\p{N}_]+(?:[.'’][\p{L}\p{N}_]+|,\p{N}+)*"


def words(x: Column) -> Column:
    """The words of a text in small letters, as an array; a number like 0.4 is one word."""
    return F.regexp_extract_all(F.lower(x), F.lit(WORD), F.lit(0))


#: Characters that Java, Python and Arrow take alike: the same ones are letters and digits, with the same small letters. Latin letters and marks.
PLAIN = "\\x00-\u012f\u0131-\u024f\u2000-\u206f\u20ac"
#: WORD in small plain letters, as Python writes it, or the end of a line.
PLAIN_WORD = re.compile(r"\w++(?:[.'’]\w++|,[0-9²³¹¼½¾]++)*+|\n")


def plain_or_words(x: Column) -> tuple[Column, Column]:
    """A text of plain characters, and the words of any other text, one of which is null: for words_of_rows."""
    plain = F.rlike(x, F.lit(rf"\A[{PLAIN}]*+\z"))  # ten times as fast as to look for another character
    return F.when(plain, x), F.when(~plain, words(x))


def parts_of(texts: pa.Array, lists: pa.Array, most: int = 1 << 24) -> Iterator[tuple[pa.Array, pa.Array]]:
    """The batch in runs of rows of about so many bytes, as long texts would make its words too many for the memory of a task."""
    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy() + 8 * pc.fill_null(pc.list_value_length(lists), 0).to_numpy().astype(np.int64))
    for a, b in pairwise([0, *(np.flatnonzero(np.diff(size // most)) + 1).tolist(), len(texts)]):
        yield texts.slice(a, b - a), lists.slice(a, b - a)


def words_of_rows(texts: pa.Array, lists: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct words, rows, codes: which word) of a batch of plain_or_words, a row and code for each time a word occurs. In no order.

    No word has white space inside, so texts are split there, and words are looked for in each distinct piece once.
    """
    pieces = pc.ascii_split_whitespace(pc.utf8_lower(texts))
    coded = pieces.flatten().dictionary_encode()
    lines = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(coded.dictionary)], pa.int32()), coded.dictionary), "\n")
    found = pa.array(PLAIN_WORD.findall(lines[0].as_py() + "\n"), pa.string())
    is_end = pc.equal(found, "\n")
    size = np.diff(np.flatnonzero(is_end.to_numpy(zero_copy_only=False)), prepend=-1) - 1
    each = pa.concat_arrays([found.filter(pc.invert(is_end)), lists.flatten().cast(pa.string())]).dictionary_encode()
    codes, piece = each.indices.to_numpy(), coded.indices.to_numpy()
    times, first = size[piece], (np.cumsum(size) - size)[piece]
    at = np.repeat(first - np.cumsum(times) + times, times) + np.arange(times.sum())
    rows = [np.repeat(pc.list_parent_indices(pieces).to_numpy(), times), pc.list_parent_indices(lists).to_numpy()]
    return each.dictionary, np.concatenate(rows), np.concatenate([codes[at], codes[size.sum() :]])


def times_of(cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct numbers, ascending, and how often each occurs: np.unique, which is slow where it hashes."""
    cells = np.sort(cells)
    starts = np.flatnonzero(np.diff(cells, prepend=cells[:1] - 1))
    return cells[starts], np.diff(starts, append=len(cells))
