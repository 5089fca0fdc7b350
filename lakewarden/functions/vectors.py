"""Hashed term vectors and dense-vector helpers."""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import md5
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import WHITESPACE


# White space outside ASCII as bytes of UTF-8, and that within it which ``bytes.split`` doesn't know.
WIDE_SPACE = re.compile(b"|".join(re.escape(c.encode()) for c in WHITESPACE if ord(c) > 0x7F))
ODD_SPACE = bytes.maketrans(b"\x1c\x1d\x1e\x1f", b"    ")

# Words whose buckets a task remembers, and bytes of text that it takes at once.
KNOWN_WORDS = 300_000
BYTES_PER_STEP = 8_000_000

TERMS = "struct<buckets: array<int>, counts: array<bigint>, norm2: bigint>"


class _Buckets(dict):
    """MD5 of every word modulo ``dim``; looked up like a table."""

    def __init__(self, dim: int) -> None:
        super().__init__()
        self.dim = dim

    def __missing__(self, word: bytes) -> int:
        if len(self) >= KNOWN_WORDS:
            self.clear()
        found = self[word] = int.from_bytes(md5(word, usedforsecurity=False).digest(), "big") % self.dim
        return found


def _words(text: bytes) -> list[bytes]:
    """Words between white space."""
    return (text if text.isascii() else WIDE_SPACE.sub(b" ", text)).translate(ODD_SPACE).split()


def _count_terms(texts: pa.Array, known: _Buckets) -> pa.StructArray:
    """Sorted buckets of each text, how often each occurs, and the sum of the squares."""
    words = [_words(t) for t in texts.to_pylist()]
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    buckets = np.fromiter(map(known.__getitem__, chain.from_iterable(words)), np.int64, int(sizes.sum()))
    keys, counts = np.unique(np.repeat(np.arange(len(words)), sizes) * known.dim + buckets, return_counts=True)
    ends = np.searchsorted(keys, np.arange(len(words) + 1) * known.dim).astype(np.int32)
    squares = np.concatenate([[0], np.cumsum(counts * counts)])
    parts = [
        pa.ListArray.from_arrays(ends, pa.array((keys % known.dim).astype(np.int32))),
        pa.ListArray.from_arrays(ends, pa.array(counts.astype(np.int64))),
        pa.array(squares[ends[1:]] - squares[ends[:-1]], pa.int64()),
    ]
    return pa.StructArray.from_arrays(parts, ["buckets", "counts", "norm2"])


def with_terms(df: DataFrame, text: str, dim: int) -> DataFrame:
    """F19 before scaling: adds ``buckets``, ``counts`` and ``norm2`` (squared length).

    Everything happens inside the row, so no token is shuffled. Spark lowers the text; an Arrow function looks every word up
    in the digests that its task has made so far, since most words of a text have come before.
    """

    @F.arrow_udf(TERMS)
    def terms(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = _Buckets(dim)
        for batch in batches:
            places = np.cumsum(pa.compute.binary_length(batch).to_numpy(zero_copy_only=False)) // BYTES_PER_STEP
            bounds = [0, *(np.flatnonzero(np.diff(places)) + 1).tolist(), len(batch)]
            yield pa.concat_arrays([_count_terms(batch[a:b], known) for a, b in pairwise(bounds)])

    low = F.lower(F.coalesce(F.col(text), F.lit(""))).cast("binary")
    step = df.withColumn("_terms", terms(low))
    return step.withColumns({n: F.col(f"_terms.{n}") for n in ("buckets", "counts", "norm2")}).drop("_terms")


def term_weights(df: DataFrame, keys: list[str]) -> DataFrame:
    """F19 in long form: ``keys, bucket, weight`` with unit length per row of ``df``."""
    return df.select(
        *keys, "norm2", F.inline(F.arrays_zip("buckets", "counts"))
    ).select(
        *keys,
        F.col("buckets").alias("bucket"),
        (F.col("counts") / F.sqrt(F.col("norm2").cast("double"))).alias("weight"),
    )


def unit_vector(vec: Column) -> Column:
    """dense vector scaled to unit length; a zero vector stays as it is."""
    wide = F.transform(vec, lambda x: x.cast("double"))
    length = F.sqrt(F.aggregate(wide, F.lit(0.0), lambda acc, x: acc + x * x))
    return F.transform(
        F.arrays_zip(wide.alias("x"), F.array_repeat(length, F.size(wide)).alias("n")),
        lambda p: F.when(p["n"] > 0, p["x"] / p["n"]).otherwise(p["x"]),
    )
