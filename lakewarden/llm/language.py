"""Language identification with word-first backoff.

A word seen in training counts with its log frequency in each language. An unseen word falls back to its
character n-grams: the longest n for which one of them is known decides, else the next shorter n.

Defined results: a null text, an empty text and a text without a letter are ``und`` with score 0; so is every text if
nothing could be learned. A tie goes to the language that sorts first. A null id is not held out. Repeated rows
are scored each for themselves. Other columns of the input are not touched and may have any name.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakewarden.llm.common import Scratch, lean

LETTERS = re.compile(r"[^\W\d_]+")
UNKNOWN = "und"


@dataclass
class LanguageModel:
    """Log frequencies per language; at most ``max_entries`` words and n-grams, so it can be broadcast."""

    languages: list[str]
    known: dict[str, int]  # words as they are, n-grams behind their length: "3:abc"
    table: np.ndarray  # entries x languages
    longest: int
    weight: int  # words that count fully towards the score
    cache_rows: int = 40_000
    _cache: dict[str, np.ndarray] = field(default_factory=dict, repr=False)

    def __getstate__(self):
        return {**self.__dict__, "_cache": {}}

    def word(self, word: str) -> np.ndarray | None:
        """Log frequencies of one word, or None if not even a letter of it is known."""
        row = self.known.get(word)
        if row is not None:
            return self.table[row]
        framed = f"^{word}$"
        for n in range(self.longest, 0, -1):
            head = f"{n}:"
            rows = [
                r
                for i in range(len(framed) - n + 1)
                if (r := self.known.get(head + framed[i : i + n])) is not None
            ]
            if rows:
                return self.table[rows].mean(axis=0)
        return None

    def _cached(self, word: str) -> np.ndarray | None:
        if word not in self._cache:
            if len(self._cache) >= self.cache_rows:
                self._cache.clear()
            self._cache[word] = self.word(word)
        return self._cache[word]

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language and the share of belief in it. Signs like fractions and raised digits stand in words, but are no letters."""
        words = LETTERS.findall((text or "").lower())
        if not any(c.isalpha() for word in words for c in word):
            return UNKNOWN, 0.0
        return self.predict_words(words)

    def predict_words(self, words: list[str]) -> tuple[str, float]:
        """The same for the words of a text in lower case."""
        if not words or not self.languages:
            return UNKNOWN, 0.0
        known, extra, rows, n = self.known, np.zeros(len(self.languages)), [], 0
        for word in words:
            row = known.get(word)
            if row is not None:
                rows.append(row)
            elif (found := self._cached(word)) is not None:
                extra += found
                n += 1
        n += len(rows)
        if not n:
            return self.languages[0], 1.0 / len(self.languages)
        total = (self.table[rows].sum(axis=0, dtype=np.float64) + extra) / n * min(n, self.weight)
        belief = np.exp(total - total.max())
        best = int(total.argmax())
        return self.languages[best], float(belief[best] / belief.sum())


class Words(dict):
    """Reads words once for two ends: each gets the value that ``value`` has for it and its log frequencies, as ``LanguageModel.word``
    finds them. The last ones are remembered, about ``most``."""

    def __init__(self, model: LanguageModel, value: Callable[[str], int], most: int = 300_000):
        super().__init__()
        self.model, self.value, self.most, self.new = model, value, most, []
        self.grams: list[dict[str, int]] = [{} for _ in range(model.longest + 1)]
        for entry, row in model.known.items():
            if entry[1:2] == ":":
                self.grams[int(entry[0])][entry[2:]] = row
        self.values = np.zeros(1024, np.int64)
        self.table = np.zeros((1024, len(model.languages)), np.float32)
        self.found = np.zeros(1024, bool)

    def __missing__(self, word: str) -> int:
        self.new.append(word)
        at = self[word] = len(self)
        return at

    def rows(self, word: str) -> list[int]:
        """The entries whose mean a word gets."""
        row = self.model.known.get(word)
        if row is not None:
            return [row]
        framed = f"^{word}$"
        for n in range(self.model.longest, 0, -1):
            own = self.grams[n]
            rows = [r for i in range(len(framed) - n + 1) if (r := own.get(framed[i : i + n])) is not None]
            if rows:
                return rows
        return []

    def learn(self) -> None:
        """What ``read`` needs of the words it has not met before."""
        first, size = len(self) - len(self.new), len(self)
        while size > len(self.values):
            self.values, self.table, self.found = (np.concatenate([x, np.zeros_like(x)]) for x in (self.values, self.table, self.found))
        self.values[first:size] = [self.value(word) for word in self.new]
        self.found[first:size], self.table[first:size] = False, 0
        if self.model.known:
            rows = [self.rows(word) for word in self.new]
            sizes = np.array([len(r) for r in rows])
            own = first + np.flatnonzero(sizes)
            if len(own):
                sizes = sizes[sizes > 0]
                entries = np.fromiter(chain.from_iterable(rows), np.int64, sizes.sum())
                total = np.add.reduceat(self.model.table[entries], np.cumsum(sizes) - sizes, axis=0)
                self.found[own], self.table[own] = True, total / sizes[:, None]
        self.new = []

    def read(self, texts: list[list[str]]) -> list[tuple[np.ndarray, str]]:
        """For the words of each text their values and the language, that of ``LanguageModel.predict_words``."""
        if len(self) > self.most:
            self.clear()
        places = [np.fromiter(map(self.__getitem__, words), np.int64, len(words)) for words in texts]
        if self.new:
            self.learn()
        return [(self.values[at], self._language(at)) for at in places]

    def _language(self, at: np.ndarray) -> str:
        languages = self.model.languages
        if not len(at) or not languages:
            return UNKNOWN
        if not self.found[at].any():
            return languages[0]
        return languages[int(self.table[at].sum(axis=0, dtype=np.float64).argmax())]


def learn(
    docs: DataFrame,
    usable: Column,
    by: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    rows_per_language: int | None = 3000,
    max_entries: int = 300_000,
    longest: int = 4,
    weight: int = 40,
) -> LanguageModel:
    """Fit the model on about ``rows_per_language`` rows of each language among the usable ones, or on all of them (None).

    The bound on rows and ``max_entries`` are the documented limits: the counts are summed by Spark over the whole
    texts of the sampled rows, and only the most frequent entries of each language come to the driver.
    """
    rows = docs.where(usable & F.col(text).isNotNull() & F.col(lang).isNotNull()).select(
        F.col(text).alias("text"), F.col(lang).alias("lang"), F.xxhash64(by).alias("h")
    )
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return LanguageModel([], {}, np.zeros((0, 0), np.float32), longest, weight)
    languages = sorted(sizes)
    part = F.create_map(
        *[F.lit(x) for k in languages for x in (k, 1.0 if rows_per_language is None else min(1.0, rows_per_language / sizes[k]))]
    )
    sample = rows.where(
        F.pmod("h", F.lit(1 << 30)) < F.element_at(part, F.col("lang")) * (1 << 30)
    )

    def batch_of(label: str, counts: Counter) -> Iterator[pa.RecordBatch]:
        keys = list(counts)
        for part in range(0, len(keys), 50_000):
            own = keys[part : part + 50_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array([label] * len(own)), pa.array(own, pa.string()), pa.array([counts[k] for k in own], pa.int64())],
                names=["lang", "entry", "n"],
            )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: dict[str, Counter] = {}
            for value, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts.setdefault(label, Counter()).update(LETTERS.findall(value.lower()))
            for label, words in counts.items():
                yield from batch_of(label, words)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The words, each once for each language, with their n-grams."""
        for batch in batches:
            counts: dict[str, Counter] = {}
            for label, word, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                entries = counts.setdefault(label, Counter())
                entries[word] += n
                framed = f"^{word}$"
                for size in range(1, longest + 1):
                    head = f"{size}:"
                    for i in range(len(framed) - size + 1):
                        entries[head + framed[i : i + size]] += n
            for label, entries in counts.items():
                yield from batch_of(label, entries)

    scratch = Scratch(docs.sparkSession, "language")
    counted = scratch.keep(
        sample.select("text", "lang")
        .mapInArrow(lean(count), "lang string, entry string, n long")
        .groupBy("lang", "entry")
        .agg(F.sum("n").alias("n"))
        .mapInArrow(lean(split), "lang string, entry string, n long")
        .groupBy("lang", "entry")
        .agg(F.sum("n").alias("n"))
        .withColumn("kind", F.when(F.col("entry").rlike("^[0-9]:"), F.substring("entry", 1, 1)).otherwise("w")),
        "counts",
        light=True,
    )
    each = max(1, max_entries // (len(languages) * 2))
    parts = []
    for label in languages:  # a bounded number of rows of each language and kind, taken without a sort of all
        own = counted.where(F.col("lang") == label)
        parts += [own.where(F.col("kind") == "w").orderBy(F.desc("n"), "entry").limit(each)]
        parts += [own.where(F.col("kind") != "w").orderBy(F.desc("n"), "entry").limit(each)]
    totals: dict[tuple[str, str], int] = {
        (r["lang"], r["kind"]): r["n"]
        for r in counted.groupBy("lang", "kind").agg(F.sum("n").alias("n")).collect()
    }
    counts: dict[str, dict[int, int]] = {}
    for part in parts:
        for r in part.select("lang", "entry", "n").toPandas().itertuples(index=False):
            counts.setdefault(r.entry, {})[languages.index(r.lang)] = r.n
    scratch.drop(counted)
    known = {entry: i for i, entry in enumerate(counts)}
    values = np.full((len(known), len(languages)), 0.5)
    size = np.zeros(len(known), dtype="U1")
    for entry, own in counts.items():
        size[known[entry]] = entry[0] if entry[1:2] == ":" and entry[0].isdigit() else "w"
        for i, n in own.items():
            values[known[entry], i] += n
    for kind in set(size):
        for i, label in enumerate(languages):
            values[size == kind, i] /= totals.get((label, kind), 0) + 0.5 * (size == kind).sum()
    return LanguageModel(languages, known, np.log(values).astype(np.float32), longest, weight)


def identify(docs: DataFrame, model: LanguageModel, keep: list[str], text: str = "text") -> DataFrame:
    """The columns ``keep`` with ``lang_pred`` and ``score``; only the text is read for the prediction."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    keep = [c for c in keep if c not in ("lang_pred", "score")]
    rows = docs.select(*keep) if text in keep else docs.select(*keep, F.col(text).alias("__text"))
    at = keep.index(text) if text in keep else len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            found = [model.predict(x) for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(i) for i in range(len(keep))),
                    pa.array([x[0] for x in found], pa.string()),
                    pa.array([x[1] for x in found], pa.float64()),
                ],
                names=[*keep, "lang_pred", "score"],
            )

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[: len(keep)]]
    return rows.mapInArrow(lean(run), ", ".join([*fields, "lang_pred string", "score double"]))
