"""Toxicity by a convolutional text classifier trained in numpy.

Each word in lower case is hashed twice; its embedding is the sum of two table rows, so two words collide only if both
hashes do. Filters of several widths run over the embedded words, the largest value of each filter over the whole text is
kept, and a logistic layer weighs them. The score is moved per language, as predicted from the text, so that the
threshold that gave the best F1 on the calibration rows of that language lies at ``CUT``.

Texts are encoded once, as bucket numbers with the predicted language. Every usable labelled row is learned: the document
frequencies that the tables start with are counted over all of them, and each shard of them trains the network from the same
start; the rows of the tables are then averaged over the shards that moved them, all other parameters over all shards. Every
row is also scored by a network that has not learned it, and the cuts are taken from the counts of all of these scores, rounded
to one ``GRID``-th of the distance between the medians of both classes. Scoring reads whole texts.

Defined results: a null or empty text, or one without a letter, gets the score of a text without words, which is below
the cut. If a class has no labelled row, every score is 0. A null id or label takes no part in learning.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakewarden.llm.common import Scratch, by_bytes, lean
from lakewarden.llm.language import LanguageModel, Words

WORDS = re.compile(r"[^\W\d_]+")
CUT = 0.7
WIDTHS = (1, 2, 3)
ROOM = max(WIDTHS) - 1
#: Every row is scored by the network of the other folds.
FOLDS = 3
#: Rows and words of a shard, about; a task holds the bucket numbers of one.
SHARD_ROWS, SHARD_WORDS = 64_000, 32_000_000
#: Rows that a network sees at least, at up to ``EPOCHS`` passes over all of them.
VISITS, EPOCHS = 64_000, 8
#: Steps of the rounded scores per distance of the medians, and the distances that are told apart.
GRID, REACH = 4096, 16
#: Width of the rows in which parameters are averaged.
DIMS = 16


def buckets(word: str, bits: int) -> int:
    """Both bucket numbers of a word, 16 bits each."""
    data = word.encode()
    return (zlib.crc32(data) & (1 << bits) - 1) << 16 | zlib.crc32(data, 0x9E3779B9) >> (32 - bits)


def wide(narrow: np.ndarray) -> np.ndarray:
    """Both bucket numbers, 32 bits each, from their narrow form."""
    values = narrow.view(np.uint32).astype(np.int64)
    return (values >> 16) << 32 | values & 0xFFFF


def unpack(column: pa.Array) -> list[np.ndarray]:
    """The texts of a column of narrow bucket numbers."""
    if not len(column):
        return []
    sizes = pa.compute.list_value_length(column).to_numpy(zero_copy_only=False)
    return np.split(wide(column.flatten().to_numpy(zero_copy_only=False)), np.cumsum(sizes)[:-1])


class Narrow(Sequence):
    """Texts that are kept in narrow form and widened when they are asked for."""

    def __init__(self, texts: list[np.ndarray]):
        self.texts = texts

    def __len__(self) -> int:
        return len(self.texts)

    def __getitem__(self, i: int) -> np.ndarray:
        return wide(self.texts[i])


@dataclass
class ToxicityModel:
    bits: int
    tables: list[np.ndarray]  # two, 2**bits + 1 rows each; the last row is the gap between texts
    filters: list[np.ndarray]  # for each width: width x dims x filters
    bias: list[np.ndarray]
    weights: np.ndarray
    base: float
    slope: float = 1.0
    shift: dict[str, float] = field(default_factory=dict)  # per language, "" for all others
    empty: bool = False

    def features(self, rows: list[np.ndarray]) -> np.ndarray:
        """The largest value of each filter over each text, given as packed bucket numbers."""
        pooled, _, _ = forward(self, rows)
        return pooled

    def raw(self, rows: list[np.ndarray]) -> np.ndarray:
        return self.features(rows) @ self.weights + self.base

    def scores(self, raw: np.ndarray, languages: list[str]) -> np.ndarray:
        if self.empty:
            return np.zeros(len(raw))
        moved = raw * self.slope + np.array([self.shift.get(x, self.shift.get("", 0.0)) for x in languages])
        return 1.0 / (1.0 + np.exp(-np.clip(moved, -500, 500)))


def forward(model: ToxicityModel, rows: list[np.ndarray]):
    """Pooled values; for learning, where they come from and the packed words with gaps."""
    gap = 1 << model.bits
    hole = np.full(ROOM, gap << 32 | gap, dtype=np.int64)
    lengths = np.array([max(1, len(r)) for r in rows])
    parts = []
    for r in rows:
        parts += [r if len(r) else hole[:1], hole]
    packed = np.concatenate(parts)
    starts = np.concatenate([[0], np.cumsum(lengths + ROOM)[:-1]])
    x = model.tables[0].take(packed >> 32, axis=0) + model.tables[1].take(packed & 0xFFFFFFFF, axis=0)
    padded = np.concatenate([x, np.zeros((ROOM, x.shape[1]), np.float32)])
    pooled, hits = [], []
    for w, bias in zip(model.filters, model.bias, strict=True):
        y = padded[: len(x)] @ w[0]
        for j in range(1, len(w)):
            y += padded[j : j + len(x)] @ w[j]
        y[packed >> 32 == gap] = -np.inf  # a window starts at a word
        empty = np.array([not len(r) for r in rows])
        top = np.maximum.reduceat(y, starts, axis=0)
        top[empty] = -bias  # a text without words excites no filter
        pooled.append(np.maximum(top + bias, 0))
        hits.append(y)
    return np.concatenate(pooled, axis=1), hits, (packed, starts, lengths)


def frequencies(rows: Sequence[np.ndarray], labels: np.ndarray, bits: int) -> np.ndarray:
    """In how many texts each bucket of both tables occurs: table x class x bucket."""
    df = np.zeros((2, 2, (1 << bits) + 1))
    for r, label in zip(rows, labels, strict=True):
        for t, shift in enumerate((32, 0)):
            df[t, int(label), np.unique(r >> shift & 0xFFFFFFFF)] += 1
    return df


def start(
    df: np.ndarray, share: tuple[int, int], total: int, bits: int, dims: int, filters: int, rng: np.random.Generator
) -> ToxicityModel:
    """The network before its first step."""
    size = 1 << bits
    tables = []
    for own in df:
        # the first dimension starts as the standardised difference of the document frequencies of both classes
        p = np.maximum(own.sum(axis=0), 5) / total
        z = (own[1] / share[0] - own[0] / share[1]) / np.sqrt(p * (1 - np.minimum(p, 0.99)) * (1 / share[0] + 1 / share[1]))
        table = rng.normal(0, 0.02, (size + 1, dims)).astype(np.float32)
        table[:, 0] = np.clip(z, -4, 10) / 8
        table[size] = 0
        tables.append(table)
    ws = [rng.normal(0, 0.1, (w, dims, filters)).astype(np.float32) for w in WIDTHS]
    for w in ws:
        w[:, 0, :] += rng.uniform(0.3, 1.0, filters).astype(np.float32)
    return ToxicityModel(
        bits, tables, ws, [np.full(filters, -0.3, np.float32) for _ in WIDTHS],
        rng.uniform(0.0, 0.2, filters * len(WIDTHS)).astype(np.float32), -1.0,
    )


def dense(model: ToxicityModel) -> np.ndarray:
    """All parameters but the tables, as rows of ``DIMS``."""
    flat = np.concatenate([*(w.ravel() for w in model.filters), *model.bias, model.weights, [model.base]]).astype(np.float64)
    return np.concatenate([flat, np.zeros(-len(flat) % DIMS)]).reshape(-1, DIMS)


def put(model: ToxicityModel, at: np.ndarray, rows: np.ndarray) -> None:
    """Replace the rows ``at`` of the parameters: those of the first table, of the second, then ``dense``."""
    size = len(model.tables[0])
    for t in (0, 1):
        own = (at >= t * size) & (at < (t + 1) * size)
        model.tables[t][at[own] - t * size] = rows[own]
    flat = dense(model)
    own = at >= 2 * size
    flat[at[own] - 2 * size] = rows[own]
    flat, place = flat.ravel(), 0
    for part in (*model.filters, *model.bias, model.weights):
        part[...] = flat[place : place + part.size].reshape(part.shape)
        place += part.size
    model.base = float(flat[place])


def fit(
    rows: Sequence[np.ndarray],
    labels: np.ndarray,
    bits: int = 16,
    dims: int = 16,
    filters: int = 12,
    epochs: int = 8,
    batch: int = 32,
    rate: float = 0.02,
    seed: int = 7,
    seen: tuple[np.ndarray, np.ndarray] | None = None,
) -> ToxicityModel:
    """Train on texts given as packed bucket numbers; Adagrad, since each step touches few embeddings.

    ``seen`` are the document frequencies and the rows of both classes if the texts are one shard of several.
    """
    rng = np.random.default_rng(seed)
    size = 1 << bits
    df, classes = seen if seen else (frequencies(rows, labels, bits), np.array([len(labels) - labels.sum(), labels.sum()]))
    share = max(1, classes[1]), max(1, classes[0])
    total = int(classes.sum())
    model = start(df, share, total, bits, dims, filters, rng)
    sums: dict[str, np.ndarray] = {}

    def step(name: str, value: np.ndarray, grad: np.ndarray, at=...) -> None:
        total = sums.setdefault(name, np.full(value.shape, 1e-4, np.float32))
        np.add.at(total, at, grad * grad) if at is not ... else total.__iadd__(grad * grad)
        change = rate * grad / np.sqrt(total[at])
        np.subtract.at(value, at, change) if at is not ... else value.__isub__(change)

    weight = np.where(labels == 1, total / (2 * share[0]), total / (2 * share[1]))
    base = np.array([model.base], np.float32)
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), batch):
            own = order[at : at + batch]
            model.base = float(base[0])
            pooled, hits, (packed, starts, lengths) = forward(model, [rows[i] for i in own])
            out = 1 / (1 + np.exp(-np.clip(pooled @ model.weights + model.base, -30, 30)))
            slope = ((out - labels[own]) * weight[own] / len(own)).astype(np.float32)
            back = slope[:, None] * model.weights
            step("weights", model.weights, pooled.T @ slope + 1e-4 * model.weights)
            step("base", base, np.array([slope.sum()], np.float32))
            for k, width in enumerate(WIDTHS):
                part = slice(k * filters, (k + 1) * filters)
                live = back[:, part] * (pooled[:, part] > 0)
                source = np.stack([hits[k][s : s + n].argmax(axis=0) + s for s, n in zip(starts, lengths, strict=True)])
                grad_w = np.zeros_like(model.filters[k])
                for j in range(width):
                    place = np.minimum(source + j, len(packed) - 1)
                    words = packed[place]
                    x = model.tables[0][words >> 32] + model.tables[1][words & 0xFFFFFFFF]
                    grad_w[j] = np.einsum("nf,nfd->df", live, x)
                    toward = live[:, :, None] * model.filters[k][j].T[None]
                    keep = (live != 0) & (words >> 32 != size)
                    for t, shift in ((0, 32), (1, 0)):
                        step(f"table{t}", model.tables[t], toward[keep], words[keep] >> shift & 0xFFFFFFFF)
                step(f"filters{k}", model.filters[k], grad_w)
                step(f"bias{k}", model.bias[k], live.sum(axis=0))
    model.base = float(base[0])
    return model


def level(model: ToxicityModel, low: float, high: float) -> ToxicityModel:
    """Move the raw scores so that the medians of both classes lie at 0 and 1."""
    span = max(high - low, 1e-6)
    model.weights = model.weights / span
    model.base = (model.base - low) / span
    return model


def best_cut(raw: np.ndarray, hits: np.ndarray, rows: np.ndarray) -> float | None:
    """Middle of the gap below the cut with the best F1, for different scores, each with its ``rows`` and ``hits`` among them;
    None where a class is missing."""
    if not 0 < hits.sum() < rows.sum():
        return None
    order = np.argsort(-raw, kind="stable")
    raw = raw[order]
    f1 = 2 * np.cumsum(hits[order]) / (np.cumsum(rows[order]) + hits.sum())
    k = int(f1.argmax())
    below = raw[k + 1] if k + 1 < len(raw) else raw[k] - 1
    return float((raw[k] + below) / 2)


def calibrate(
    model: ToxicityModel, raw: np.ndarray, hits: np.ndarray, rows: np.ndarray, languages: np.ndarray, least: int = 20
) -> None:
    """Put the best cut of all rows, and of each language with enough rows of both classes, at ``CUT``; every score of a language
    has its ``rows`` and ``hits``."""
    every, place = np.unique(raw, return_inverse=True)
    cut = best_cut(every, np.bincount(place, hits), np.bincount(place, rows))
    spread = float(np.sqrt(np.average((raw - np.average(raw, weights=rows)) ** 2, weights=rows))) or 1.0
    model.slope = float(2.0 / spread)
    goal = float(np.log(CUT / (1 - CUT)))
    model.shift = {"": goal - model.slope * (cut if cut is not None else float(raw.max(initial=0)) + spread)}
    for language in sorted(set(languages.tolist())):
        own = languages == language
        if min(hits[own].sum(), (rows - hits)[own].sum()) >= least:
            model.shift[language] = goal - model.slope * best_cut(raw[own], hits[own], rows[own])


def nothing(bits: int) -> ToxicityModel:
    return ToxicityModel(bits, [np.zeros((1, 1), np.float32)] * 2, [], [], np.zeros(0), 0.0, empty=True)


def encode(docs: DataFrame, language: LanguageModel, keep: list[str], text: str = "text", bits: int = 16) -> DataFrame:
    """The columns ``keep`` with ``__packed``, the bucket numbers of all words of the text (null for a null text), and its predicted
    language, ``__language``."""
    rows = docs.select(*keep, F.col(text).alias("__text"))
    shared = docs.sparkSession.sparkContext.broadcast(language)
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema.fields[: len(keep)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Words(shared.value, lambda word: buckets(word, bits))
        for batch in by_bytes(batches, len(keep), 2_000_000):
            texts = batch.column(len(keep)).to_pylist()
            found = known.read([WORDS.findall(x.lower()) if x else [] for x in texts])
            values = np.concatenate([v for v, _ in found]).astype(np.uint32).view(np.int32)
            bounds = pa.array(np.cumsum([0, *(len(v) for v, _ in found)]), pa.int32())
            packed = pa.ListArray.from_arrays(bounds, pa.array(values), mask=pa.array([x is None for x in texts]))
            names = pa.array([x for _, x in found], pa.string())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(len(keep))), packed, names], [*keep, "__packed", "__language"]
            )

    return rows.mapInArrow(lean(run), f"{fields}__packed array<int>, __language string")


def learn(
    docs: DataFrame,
    labels: DataFrame,
    usable: Column,
    language: LanguageModel,
    by: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    bits: int = 16,
) -> ToxicityModel:
    """Fit on all usable labelled rows and calibrate on scores that each of them gets without having been learned."""
    return learn_encoded(encode(docs.where(usable), language, [by], text, bits), labels, F.lit(True), by, label, bits)


def learn_encoded(
    encoded: DataFrame, labels: DataFrame, usable: Column, by: str = "doc_id", label: str = "toxic", bits: int = 16
) -> ToxicityModel:
    """The same for documents that ``encode`` has read."""
    marked = labels.select(F.col(by).alias("__id"), F.col(label).cast("int").alias("label")).where(
        F.col("__id").isNotNull() & F.col("label").isin(0, 1)
    )
    known = encoded.where(usable & F.col("__packed").isNotNull()).select(F.col(by).alias("__id"), "__packed", "__language")
    # labels grow with the documents, so they are never broadcast
    scratch = Scratch(encoded.sparkSession, "toxicity")
    rows = known.join(marked.hint("merge"), "__id").select(
        F.crc32(F.col("__id").cast("string")).alias("order"),
        F.pmod(F.xxhash64("__id", F.lit("fold")), F.lit(FOLDS)).cast("int").alias("fold"),
        "label", F.col("__packed").alias("packed"), F.col("__language").alias("language"),
    )
    rows = scratch.keep(rows, "labelled")
    facts = rows.groupBy("fold", "label").agg(F.count("*").alias("n"), F.sum(F.size("packed")).alias("words")).collect()
    classes, n_words = np.zeros((FOLDS, 2), np.int64), sum(r["words"] for r in facts)
    for r in facts:
        classes[r["fold"], r["label"]] = r["n"]
    if not classes.sum(axis=0).all():
        return nothing(bits)
    shards = max(1, round(classes.sum() / SHARD_ROWS), round(n_words / SHARD_WORDS))
    # network k learns all folds but k, the last one all; a network whose rows lack a class isn't trained
    uses = [[f for f in range(FOLDS) if f != k] for k in range(FOLDS + 1)]
    live = [k for k, own in enumerate(uses) if classes[own].sum(axis=0).all()]
    counts = _frequencies(rows.coalesce(4 * shards), bits)
    models = _train(rows, shards, uses, live, counts, classes, bits)
    scored = scratch.keep(_raw(rows, models), "raw", light=True)
    medians = []
    for k in live:
        for value in (0, 1):
            own = F.col("fold").isin(uses[k]) & (F.col("label") == value)
            medians.append(F.percentile_approx(F.when(own, F.col("raw")[k]), 0.5, 1_000_000).alias(f"{k}-{value}"))
    found = scored.agg(*medians).first()
    middle = {k: (found[f"{k}-0"], found[f"{k}-1"]) for k in live}
    moved = F.lit(0.0)
    for k, (low, high) in middle.items():
        if k < FOLDS:
            moved = F.when(F.col("fold") == k, (F.col("raw")[k] - low) / max(high - low, 1e-6)).otherwise(moved)
    step = F.round(F.greatest(F.least(moved, F.lit(float(REACH))), F.lit(-float(REACH))) * GRID).cast("int")
    bins = scored.groupBy("language", step.alias("step")).agg(F.sum("label").alias("hits"), F.count("*").alias("n")).toArrow()
    scratch.drop(rows, scored)
    model = level(models[FOLDS], *middle[FOLDS])
    hits, n, steps = (bins[c].to_numpy().astype(np.float64) for c in ("hits", "n", "step"))
    calibrate(model, steps / GRID, hits, n, np.array(bins["language"].to_pylist(), dtype=object))
    return model


def _frequencies(rows: DataFrame, bits: int) -> np.ndarray:
    """Document frequencies of all rows: fold x table x class x bucket."""
    shape = (FOLDS, 2, 2, (1 << bits) + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for batch in by_words(batches):
            values, fold, label = unpack(batch.column("packed")), batch.column("fold").to_numpy(), batch.column("label").to_numpy()
            for f in range(FOLDS):
                own = np.flatnonzero(fold == f)
                total[f] += frequencies([values[i] for i in own], label[own], bits)
        flat = total.ravel()
        at = np.flatnonzero(flat)
        for i in range(0, len(at), 100_000):
            part = at[i : i + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(flat[part].astype(np.int64))], ["at", "n"])

    counted = rows.select("fold", "label", "packed").mapInArrow(lean(run), "at long, n long").groupBy("at").agg(F.sum("n").alias("n"))
    found, out = counted.toArrow(), np.zeros(shape)
    out.ravel()[found["at"].to_numpy()] = found["n"].to_numpy()
    return out


def by_words(batches: Iterator[pa.RecordBatch], most: int = 500_000) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose texts hold about ``most`` words; a longer text stands alone."""
    for batch in batches:
        ends = np.cumsum(pa.compute.list_value_length(batch.column("packed")).to_numpy(zero_copy_only=False))
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + most, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def _train(
    rows: DataFrame, shards: int, uses: list[list[int]], live: list[int], counts: np.ndarray, classes: np.ndarray, bits: int
) -> list[ToxicityModel | None]:
    """The networks: every shard trains from the same start, and what it moved is averaged."""
    shared = rows.sparkSession.sparkContext.broadcast(counts)
    epochs = [min(EPOCHS, max(1, round(VISITS / classes[own].sum()))) for own in uses]

    def begin(k: int, values: Sequence[np.ndarray], labels: np.ndarray, counts: np.ndarray, passes: int) -> ToxicityModel:
        return fit(values, labels, bits, DIMS, epochs=passes, seen=(counts[uses[k]].sum(axis=0), classes[uses[k]].sum(axis=0)))

    def shard(k: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            values, label, order = [], [], []
            for batch in batches:
                batch = batch.filter(pa.compute.is_in(batch.column("fold"), pa.array(uses[k], pa.int32())))
                values += [x.values.to_numpy() for x in batch.column("packed")]
                label.append(batch.column("label").to_numpy())
                order.append(batch.column("order").to_numpy())
            if not values:
                return
            labels, at = np.concatenate(label).astype(np.int64), np.argsort(np.concatenate(order), kind="stable")
            first = begin(k, [], np.zeros(0, np.int64), shared.value, 0)
            own = begin(k, Narrow([values[i] for i in at]), labels[at], shared.value, epochs[k])
            size = len(first.tables[0])
            for t in (0, 1):
                moved = np.flatnonzero((own.tables[t] != first.tables[t]).any(axis=1))
                for i in range(0, len(moved), 20_000):
                    part = moved[i : i + 20_000]
                    yield slots(part + t * size, own.tables[t][part])
            flat = dense(own)
            yield slots(np.arange(len(flat)) + 2 * size, flat)

        return run

    def slots(at: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
        columns = [pa.array(at.astype(np.int32)), *(pa.array(values[:, i].astype(np.float32)) for i in range(DIMS))]
        return pa.RecordBatch.from_arrays(columns, ["at", *names])

    names = [f"v{i}" for i in range(DIMS)]
    schema = ", ".join(["at int", *(f"{x} float" for x in names)])
    data = rows.select("order", "fold", "label", "packed").coalesce(shards)

    def network(k: int) -> ToxicityModel | None:
        if k not in live:
            return None
        found = data.mapInArrow(lean(shard(k)), schema).groupBy("at").agg(*[F.avg(x).alias(x) for x in names]).toArrow()
        model = begin(k, [], np.zeros(0, np.int64), counts, 0)
        put(model, found["at"].to_numpy(), np.stack([found[x].to_numpy() for x in names], axis=1))
        return model

    with ThreadPoolExecutor(len(uses)) as jobs:  # the networks are trained side by side
        return list(jobs.map(network, range(len(uses))))


def _raw(rows: DataFrame, models: list[ToxicityModel | None]) -> DataFrame:
    """``fold``, ``label``, ``language`` and ``raw``, the score of every network."""
    shared = rows.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = shared.value
        for batch in by_words(batches, 100_000):
            values = unpack(batch.column("packed"))
            raw = np.stack([m.raw(values) if m else np.zeros(len(values)) for m in models], axis=1).astype(np.float64)
            bounds = pa.array(np.arange(len(values) + 1) * len(models), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("fold", "label", "language")), pa.ListArray.from_arrays(bounds, pa.array(raw.ravel()))],
                ["fold", "label", "language", "raw"],
            )

    return rows.select("fold", "label", "language", "packed").mapInArrow(
        lean(run), "fold int, label int, language string, raw array<double>"
    )


def score(docs: DataFrame, model: ToxicityModel, language: LanguageModel, keep: list[str], text: str = "text") -> DataFrame:
    """The columns ``keep`` with ``score`` and ``predicted``; only the text is read."""
    keep = [c for c in keep if c not in ("score", "predicted")]
    return score_encoded(encode(docs, language, keep, text, model.bits), model, keep)


def score_encoded(encoded: DataFrame, model: ToxicityModel, keep: list[str]) -> DataFrame:
    """The same for documents that ``encode`` has read."""
    rows = encoded.select(*keep, F.coalesce("__packed", F.array().cast("array<int>")).alias("packed"), "__language")
    shared = encoded.sparkSession.sparkContext.broadcast(model)
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema.fields[: len(keep)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in by_words(batches, 100_000):
            raw = np.zeros(batch.num_rows) if model.empty else model.raw(unpack(batch.column("packed")))
            found = model.scores(raw, batch.column("__language").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(len(keep))), pa.array(found, pa.float64()), pa.array((found >= CUT).astype(np.int32))],
                [*keep, "score", "predicted"],
            )

    return rows.mapInArrow(lean(run), f"{fields}score double, predicted int")
