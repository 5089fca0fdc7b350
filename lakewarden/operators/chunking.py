"""Documents to chunks. Input needs ``doc_id, source, text``."""

from __future__ import annotations

from collections import deque
from math import ceil

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from ..functions.text import WS, strip

# Separators from coarse to fine.
SEPARATORS = ("\n\n", "\n", ". ", " ", "")


def _numbered(docs: DataFrame, pieces: Column) -> DataFrame:
    """Chunks with a 0-based id per document, counted after blank ones are gone."""
    return docs.select("doc_id", "source", F.posexplode(pieces).alias("chunk_id", "text"))


def chunk_windows(docs: DataFrame, size: int = 800, overlap: int = 120) -> DataFrame:
    """Fixed windows, trimmed, blank ones dropped; no shuffle and linear in the text.

    The text is cut once into steps; a window is its own step plus the start of the next ones.
    """
    step = max(1, size - overlap)
    reach = ceil(size / step)
    tidy = F.regexp_replace("text", f"{WS}+\n", "\n")
    steps = docs.withColumn(
        "steps", F.regexp_extract_all(tidy, F.lit(f"(?s)(.{{1,{step}}})"), F.lit(1))
    )
    windows = F.transform(
        "steps",
        lambda s, i: strip(
            F.substring(F.array_join(F.slice(F.col("steps"), i + 1, F.lit(reach)), ""), 1, size)
        ),
    )
    return _numbered(steps, F.filter(windows, lambda w: w != ""))


def _merge(pieces: list[str], size: int, overlap: int) -> list[str]:
    """Join neighbours up to ``size``; the next chunk starts with at most ``overlap`` of the last."""
    out: list[str] = []
    held: deque[str] = deque()
    length = 0
    for piece in [*pieces, None]:
        grown = length + len(piece or "")
        if held and (piece is None or grown > size):
            out.append("".join(held).strip())
            while held and (length > overlap or length + len(piece or "") > size):
                length -= len(held.popleft())
        if piece is not None:
            held.append(piece)
            length += len(piece)
    return [c for c in out if c]


def split_recursive(
    text: str, size: int, overlap: int, separators: tuple[str, ...] = SEPARATORS
) -> list[str]:
    """Split at the coarsest separator that occurs; what is still too long goes one level down.

    A separator stays in front of the piece that follows it.
    """
    level = next(i for i, s in enumerate(separators) if s == "" or s in text)
    mark, finer = separators[level], separators[level + 1 :]
    if mark:
        first, *others = text.split(mark)
        pieces = [p for p in [first, *(mark + o for o in others)] if p]
    else:
        pieces = list(text)
    out: list[str] = []
    short: list[str] = []
    for piece in pieces:
        if len(piece) < size:
            short.append(piece)
            continue
        out += _merge(short, size, overlap)
        short = []
        out += split_recursive(piece, size, overlap, finer) if finer else [piece]
    return out + _merge(short, size, overlap)


def chunk_recursive(docs: DataFrame, size: int = 800, overlap: int = 120) -> DataFrame:
    """Separator-aware chunks by an Arrow function, one document at a time."""

    @F.pandas_udf(ArrayType(StringType()))
    def pieces(texts: pd.Series) -> pd.Series:
        return texts.map(
            lambda t: [c for c in split_recursive(t, size, overlap) if c.strip()] if t else []
        )

    return _numbered(docs, pieces("text"))
