"""Token-sorted name similarity, bigrams, sentence overlap and article references."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from .text import WS, strip_accents


def sort_tokens(col: Column) -> Column:
    """Words of a normalised text in alphabetical order."""
    return F.array_join(F.sort_array(F.split(F.trim(col), " +")), " ")


def _common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence; one machine word per 64 characters of ``a``."""
    where: dict[str, int] = {}
    for i, char in enumerate(a):
        where[char] = where.get(char, 0) | (1 << i)
    full = (1 << len(a)) - 1
    free = full
    for char in b:
        hit = free & where.get(char, 0)
        free = ((free + hit) | (free - hit)) & full
    return len(a) - free.bit_count()


@F.pandas_udf(IntegerType())
def lcs_similarity(left: pd.Series, right: pd.Series) -> pd.Series:
    """Length of the longest common subsequence of each pair, by Arrow batch."""
    return pd.Series(
        [_common_subsequence(a, b) for a, b in zip(left, right)], dtype="int32"
    )


def token_sort_ratio(left: Column, right: Column) -> Column:
    """0 to 100 on token-sorted texts; two empty texts count as equal."""
    a, b = sort_tokens(left), sort_tokens(right)
    total = F.char_length(a) + F.char_length(b)
    return F.when(total == 0, F.lit(100.0)).otherwise(
        F.lit(200.0) * lcs_similarity(a, b) / total
    )


def reaches(lcs: Column, total: Column, threshold: int) -> Column:
    """Similarity at or above ``threshold`` in whole numbers, free of rounding at the edge."""
    return F.lit(200) * lcs >= F.lit(threshold) * total


def indel_edits(total: Column, threshold: int) -> Column:
    """By how many insertions and deletions two texts of ``total`` characters together may differ."""
    return F.floor(F.lit(100 - threshold) * total / F.lit(100)).cast("int")


def partitions(text: str, length: str, threshold: int) -> tuple[Column, Column]:
    """Keys at which two texts meet whose similarity reaches ``threshold``: those of the shorter one, those of the longer.

    If d insertions and deletions are allowed, the shorter text is cut into d + 1 pieces of nearly equal length. At least one
    lies whole in the longer text, and for one of these the changes on its left are no more than its number and those on its right
    no more than the pieces that follow; so it begins within a few places of its own. A key is the shorter length, d, the number of
    the piece and the piece. Lengths that no similar text can have never meet, and every threshold above 0 is allowed.
    """
    own, t = F.col(length), threshold
    most = F.floor(own * (200 - t) / F.lit(t)).cast("int")
    least = F.ceil(own * t / F.lit(200 - t)).cast("int")

    def cut(n: Column, d: Column, i: Column) -> Column:
        return F.floor(n * i / (d + 1)).cast("int")

    def key(n: Column, d: Column, i: Column, piece: Column) -> Column:
        return F.xxhash64(n, d, i, piece)

    def piece(at: Column, size: Column) -> Column:
        return F.substr(F.col(text), at + 1, size)

    edits = F.array_distinct(F.transform(F.sequence(own, most), lambda m: indel_edits(own + m, t)))
    short = F.flatten(
        F.transform(
            edits,
            lambda d: F.transform(
                F.sequence(F.lit(0), d), lambda i: key(own, d, i, piece(cut(own, d, i), cut(own, d, i + 1) - cut(own, d, i)))
            ),
        )
    )

    def places(n: Column, d: Column, i: Column) -> Column:
        """Where piece ``i`` of a text of length ``n`` can begin in this one."""
        at, size, more = cut(n, d, i), cut(n, d, i + 1) - cut(n, d, i), own - n
        first = F.greatest(at - i, at + more - (d - i), F.lit(0))
        last = F.least(at + i, at + more + (d - i), own - size)
        inside = F.when(first <= last, F.sequence(first, F.greatest(first, last))).otherwise(F.array().cast("array<int>"))
        return F.transform(inside, lambda p: key(n, d, i, piece(p, size)))

    long = F.flatten(
        F.transform(
            F.sequence(least, own),
            lambda n: F.flatten(
                F.transform(F.sequence(F.lit(0), indel_edits(own + n, t)), lambda i: places(n, indel_edits(own + n, t), i))
            ),
        )
    )
    return F.array_distinct(short), F.array_distinct(long)


def sentences(col: Column) -> Column:
    """F22, first half: split after ``.``, ``!`` or ``?`` followed by white space."""
    return F.split(col, rf"(?<=[.!?]){WS}+")


def word_set(col: Column) -> Column:
    """F22, second half: distinct lower-case words, accented letters included."""
    return F.array_distinct(F.regexp_extract_all(F.lower(col), F.lit(r"(?U)(\w+)"), F.lit(1)))


# Reference pattern and the spellings searched for each number.
ARTICLE_PATTERN = r"art(?:iculo)?s?\.?" + WS + r"*([0-9]+)"
ARTICLE_STEMS = ("rtículo ", "rticulo ", "RTÍCULO ", "RTICULO ", "rt. ", "rt ")


def article_numbers(col: Column) -> Column:
    """F23, first half: distinct numbers of ``article 16``-like references."""
    return F.array_distinct(
        F.regexp_extract_all(F.lower(strip_accents(col)), F.lit(ARTICLE_PATTERN), F.lit(1))
    )


def article_needles(numbers: Column) -> Column:
    """F23, second half: every searched spelling of every number."""
    stems = F.array(*[F.lit(s) for s in ARTICLE_STEMS])
    return F.flatten(F.transform(numbers, lambda n: F.transform(stems, lambda s: F.concat(s, n))))

