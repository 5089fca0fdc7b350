"""Packing of token sequences by vector best-fit.

Every sequence has three capacities: tokens, documents, and attention cost (the sum of the squared lengths of what it holds).
Pieces come by falling length. A piece goes to an open sequence that has room for it under every constraint: with the rule
``norm`` to the one whose weighted residual is shortest afterwards, with ``dot`` to the one whose residual has the largest
weighted dot-product with the piece; if none has room, a new sequence opens. Weights are one over the squared capacity.

Pieces of one length are alike, and so are sequences with one residual, so the choice is made for groups of both: the driver
sees the number of pieces of each length, at most as many rows as a sequence has tokens, and the plan that it makes grows
with the lengths, not with the documents. With ``norm`` a sequence that took a piece is the best one for the next of that
length, so it takes as many as fit; with ``dot`` the other sequences of its group come first, so each takes one. Both give
the same as going piece by piece.

Tasks number the pieces of each length as they cut them; the sums of the tasks before them turn that into a rank in the
corpus, and the plan maps ranks to sequences and places. No length, however frequent, is sorted or gathered anywhere.

Defined results: a null text counts as empty and has only the closing id. Rows that repeat an id are packed each for itself.
Only texts that are longer than a sequence are cut; their first piece is the shorter one. Columns of ``keep`` that are named
like a new one, in any case, are left out. A text is held in memory as a whole.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lakewarden.llm.common import Scratch, by_bytes, kept_columns, lean

#: How byte-level pre-tokenizers part a text. Fixed value.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Ranks of one length in the plan's keys.
_RANKS = 1 << 44


def byte_signs() -> dict[str, int]:
    """The sign that stands for each byte in a byte-level vocabulary: printable ones of Latin-1 for themselves, the others in
    order from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(0x100 + i): b for i, b in enumerate(other)}


class Encoder:
    """Token ids of whole texts, as the tokenizers library gives them, as 32-bit little-endian bytes.

    A plain byte-level vocabulary whose ids follow its merges also goes to the faster tiktoken, which gives the same ids; texts
    that hold an added token, and all texts of other tokenizers, are the library's.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark gives a task one core
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.added = [t["content"] for t in told["added_tokens"]]
        self.fast = self._twin(told)

    @staticmethod
    def _twin(told: dict):
        before, model = told["pre_tokenizer"] or {}, told["model"]
        plain = (
            told["normalizer"] is None and told["post_processor"] is None and before.get("type") == "ByteLevel"
            and before.get("use_regex", True) and not before["add_prefix_space"] and model["type"] == "BPE"
            and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
        )
        if not plain:
            return None
        signs, vocabulary = byte_signs(), model["vocab"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        added = {t["content"] for t in told["added_tokens"]}
        ranked = {vocabulary.get(sign, 256) < 256 for sign in signs} == {True} and all(
            vocabulary.get(a + b) == 256 + i for i, (a, b) in enumerate(merges)
        )
        known = {t: i for t, i in vocabulary.items() if t not in added}
        if not ranked or len(known) != 256 + len(merges):
            return None
        import tiktoken

        ranks = {bytes(signs[c] for c in token): i for token, i in known.items()}
        return tiktoken.Encoding("byte-level", pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text."""
        for text in texts:
            if self.fast and not any(a in text for a in self.added):
                yield np.array(self.fast.encode_ordinary(text), "<u4").tobytes()
            else:
                yield np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """One encoder for all tasks that a Python worker runs."""
    return Encoder(path)


@dataclass(frozen=True)
class Limits:
    """What a sequence holds at most. Without a number of documents or a cost, those constraints never bind."""

    tokens: int = 2048
    documents: int | None = None
    attention: int | None = None

    @property
    def capacities(self) -> np.ndarray:
        return np.array([self.tokens, self.documents or self.tokens, self.attention or self.tokens**2], np.int64)

    @property
    def piece(self) -> int:
        """The longest piece that a sequence can hold."""
        return min(self.tokens, isqrt(int(self.capacities[2])))


@dataclass
class Plan:
    """Sorted by length and rank: pieces of ``length`` from rank ``first`` on fill the sequences from ``base`` on from the
    token ``start``, ``each`` pieces in every sequence."""

    length: np.ndarray
    first: np.ndarray
    base: np.ndarray
    start: np.ndarray
    each: np.ndarray
    sequences: int

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of pieces, given by their length and their rank within it."""
        at = np.searchsorted(self.length * _RANKS + self.first, length * _RANKS + rank, side="right") - 1
        more, within = np.divmod(rank - self.first[at], self.each[at])
        return self.base[at] + more, self.start[at] + within * length


def best_fit(counts: dict[int, int], limits: Limits = Limits(), rule: str = "norm") -> Plan:
    """The plan for ``counts`` pieces of each length."""
    if rule not in ("norm", "dot"):
        raise ValueError(f"no such rule: {rule}")
    full = limits.capacities
    weight = 1.0 / full.astype(float) ** 2
    residual = np.zeros((64, 3), np.int64)  # of the open groups; a group is a stretch of sequences
    base, number = np.zeros(64, np.int64), np.zeros(64, np.int64)
    groups = sequences = 0
    placed: list[tuple[int, int, int, int, int]] = []

    def opened(left: np.ndarray, at: int, n: int) -> None:
        nonlocal residual, base, number, groups
        if groups == len(base):
            residual, base, number = (np.concatenate([x, np.zeros_like(x)]) for x in (residual, base, number))
        residual[groups], base[groups], number[groups] = left, at, n
        groups += 1

    for length in sorted((k for k, n in counts.items() if n), reverse=True):
        piece = np.array([length, 1, length * length], np.int64)
        left, first = int(counts[length]), 0
        if (piece > full).any() or length < 1:
            raise ValueError(f"a piece of {length} tokens fits no sequence")
        while left:
            room = np.flatnonzero((residual[:groups] >= piece).all(axis=1))
            if not len(room):
                each = int((full // piece).min())
                for k, n in ((each, left // each), (left % each, 1)):
                    if k and n:
                        placed.append((length, first, sequences, 0, k))
                        opened(full - k * piece, sequences, n)
                        sequences, first = sequences + n, first + k * n
                break
            if rule == "norm":
                after = (residual[room] - piece).astype(float)
                g = int(room[np.argmin((after * after * weight).sum(axis=1))])
                each = min(left, int((residual[g] // piece).min()))
            else:
                g = int(room[np.argmax((residual[room] * (piece * weight)).sum(axis=1))])
                each = 1
            n = min(int(number[g]), left // each)
            placed.append((length, first, int(base[g]), int(full[0] - residual[g, 0]), each))
            rest = residual[g].copy()
            if n < number[g]:  # the others of the group stay as they are
                opened(rest, int(base[g]) + n, int(number[g]) - n)
            residual[g], number[g] = rest - each * piece, n
            left, first = left - each * n, first + each * n
        # groups without room for any piece are done
        open_ = (residual[:groups] > 0).all(axis=1)
        kept = int(open_.sum())
        residual[:kept], base[:kept], number[:kept] = residual[:groups][open_], base[:groups][open_], number[:groups][open_]
        groups = kept
    table = np.array(sorted(placed), np.int64).reshape(-1, 5)
    return Plan(*(table[:, i] for i in range(5)), sequences)


def pieces(
    docs: DataFrame, path: str, keep: list[str], text: str = "text", longest: int = 2048, end: int | None = 0, ids: bool = False
) -> DataFrame:
    """The columns ``keep`` of every piece with ``piece``, ``start``, ``length``, ``ids_crc32`` and, if asked for, ``ids``;
    and ``task`` and ``nth``, its number among the pieces of its length that the task cut."""
    new = ["piece", "start", "length", "ids_crc32", "task", "nth", *["ids"] * ids]
    names, kept, fields = kept_columns(docs, keep, new)
    kinds = [T.IntegerType(), T.LongType(), T.LongType(), T.LongType(), T.IntegerType(), T.LongType(), T.ArrayType(T.IntegerType())]
    schema = T.StructType(fields + [T.StructField(c, k) for c, k in zip(new, kinds, strict=False)])
    closing = b"" if end is None else np.array([end], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_encoder, task, seen = encoder(path), TaskContext.get().partitionId(), {}
        for batch in by_bytes(batches, len(names)):
            rows, out, tokens = [], [], []
            for row, own in enumerate(own_encoder.encode([t or "" for t in batch.column(len(names)).to_pylist()])):
                own += closing
                n = len(own) // 4
                cuts = [0, *range(n % longest or min(n, longest), n, longest), n] if n else []
                for piece, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    part = own[4 * a : 4 * b]
                    seen[b - a] = nth = seen.get(b - a, -1) + 1
                    rows.append(row)
                    out.append((piece, a, b - a, zlib.crc32(part), task, nth))
                    if ids:
                        tokens.append(np.frombuffer(part, "<i4"))
            types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            columns = list(zip(*out, strict=True)) if out else [()] * len(types)
            made = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
            if ids:
                bounds = np.cumsum([0, *map(len, tokens)])
                made.append(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(np.concatenate([np.zeros(0, "<i4"), *tokens]))))
            taken = pa.array(rows, pa.int32())
            yield pa.RecordBatch.from_arrays([*(batch.column(i).take(taken) for i in range(len(names))), *made], [*names, *new])

    return docs.select(*kept, docs[text].alias("__text")).mapInArrow(lean(run), schema)


def pack(
    docs: DataFrame, path: str, keep: list[str], text: str = "text", limits: Limits = Limits(), rule: str = "norm",
    end: int | None = 0, ids: bool = False,
) -> DataFrame:
    """The pieces of all documents with ``sequence_id``, numbers from 0 without a gap, and ``offset``, the place of the first
    token in the sequence. The id ``end`` closes every document; without one, a document without tokens has no piece."""
    scratch = Scratch(docs.sparkSession, "packing")
    new = ["sequence_id", "offset"]
    keep = [c for c in keep if c.lower() not in new]
    cut = scratch.keep(pieces(docs, path, keep, text, limits.piece, end, ids), "pieces")
    cells = scratch.keep(cut.groupBy("length", "task").agg(F.count("*").alias("n")), "cells", light=True)
    # one row for each length, at most limits.piece of them
    counts = {r["length"]: r["n"] for r in cells.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = best_fit(counts, limits, rule)
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("length", "task", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("__before"))
    ranked = cut.join(cells, ["length", "task"]).select(
        *[c for c in cut.columns if c not in ("task", "nth")], (F.col("__before") + F.col("nth")).alias("__rank")
    )
    fields = [f for f in ranked.schema if f.name != "__rank"]
    schema = T.StructType(fields + [T.StructField(c, T.LongType()) for c in new])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "__rank"))
            found = [pa.array(x) for x in plan.place(length, rank)]
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in fields), *found], [*(f.name for f in fields), *new])

    return ranked.mapInArrow(run, schema)


def sequences(packed: DataFrame) -> DataFrame:
    """``sequence_id``, ``ids`` and the ``ends`` of its pieces, from pieces with their ids; a sequence is bounded by its limits."""
    inside = F.array_sort(F.collect_list(F.struct("offset", "length", "ids")))
    whole = packed.groupBy("sequence_id").agg(inside.alias("x"))
    ends = F.transform("x", lambda p: p["offset"] + p["length"])
    return whole.select("sequence_id", F.flatten(F.transform("x", lambda p: p["ids"])).alias("ids"), ends.alias("ends"))
