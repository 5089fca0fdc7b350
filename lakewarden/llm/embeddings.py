"""Near-duplicates among embeddings: cells of spherical k-means, cosine products in blocks within cells.

The centres are fitted on a bounded sample, all vectors are assigned. A vector belongs to its nearest cell and visits the
other cells that could hold one of its partners, those whose border is near. Blocks of a
cell's members are multiplied with blocks of its members and visitors in double precision; a pair with a cosine of at
least ``least`` is a link, and no other is. Of the links of a task only their number per vector and a spanning forest
leave it, so a group of near vectors is never expanded into pairs. A cell with very many rows is split into blocks of rows
that meet in different tasks.

The pair of two cells is counted once: in the cell with the smaller number, if both visit each other's cell.

Of two partners, which are at most ``sqrt(2 - 2 * least)`` apart, in two cells, the one that is nearer to the border between both
centres is within half of that distance of it, and visits the other's cell. ``slack`` is the part of the distance that
is searched: 0.5 loses no link at any dimension, less visits fewer cells.

Vectors of different lengths link with nothing of each other. Each length of the sample has centres of its own; vectors of a length
that the sample doesn't have are a cell of their own, split into blocks like any other.

Defined results: a null vector, a zero vector and one with a null or non-finite component link with nothing. Equal vectors
link. Rows that repeat both id and vector are one vector, rows that repeat only the id are different ones with a common component. A null id
has no links.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakewarden.llm.common import Scratch, lean, share
from lakewarden.llm.components import components


def unit(values: list[list[float] | None], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors of ``width`` dimensions in double precision, and which rows have one."""
    table = np.full((len(values), width), np.nan)
    for i, v in enumerate(values):
        if v is not None and len(v) == width:
            table[i] = [math.nan if x is None else x for x in v]
    top = np.abs(table).max(axis=1, initial=0)
    good = np.isfinite(top) & (top > 0)
    table[good] /= top[good, None]  # so that the squares neither overflow nor vanish
    table[good] /= np.linalg.norm(table[good], axis=1)[:, None]
    table[~good] = 0
    return table, good


def centres_of(sample: np.ndarray, cells: int, rounds: int = 6, seed: int = 3) -> np.ndarray:
    """Spherical k-means on the unit vectors of a sample."""
    rng = np.random.default_rng(seed)
    centres = sample[rng.choice(len(sample), min(cells, len(sample)), replace=False)].copy()
    for _ in range(rounds):
        nearest = np.concatenate([(sample[i : i + 4096] @ centres.T).argmax(axis=1) for i in range(0, len(sample), 4096)])
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, sample)
        norms = np.linalg.norm(sums, axis=1)
        live = norms > 1e-9
        centres[live] = sums[live] / norms[live, None]
    return centres


def _placed(table: np.ndarray, centres: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """The own cell of each unit vector, and which cells it belongs to or visits."""
    near = table @ centres.T
    home, every = near.argmax(axis=1), np.arange(len(table))
    # distance of two unit centres, and of a vector to the border between them
    apart = np.sqrt(np.maximum(2 - 2 * centres @ centres.T, 0))[home]
    meets = near[every, home][:, None] - near <= reach * apart
    meets[every, home] = True
    return home, meets


def _assigned(vectors: DataFrame, centres: dict[int, tuple[int, np.ndarray]], reach: float) -> DataFrame:
    """One row per vector and cell that it belongs to or visits: ``cell``, ``home`` and its packed unit vector. ``centres`` has the
    number of the first cell and the centres of each length; other lengths are the cell of their negative."""
    shared = vectors.sparkSession.sparkContext.broadcast(centres)
    kind = vectors.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = shared.value
        for batch in batches:
            for start in range(0, batch.num_rows, 2000):
                part = batch.slice(start, 2000)
                values = part.column("v").to_pylist()
                lengths = np.array([len(v) for v in values])
                for width in np.unique(lengths[lengths > 0]).tolist():
                    own = np.flatnonzero(lengths == width)
                    table, good = unit([values[i] for i in own], width)
                    rows, table = own[good], table[good]
                    first, points = centres.get(width, (-width, np.zeros((1, width))))
                    home, meets = _placed(table, points, reach)
                    who, cell = np.nonzero(meets)
                    lists = np.split((cell + first).astype(np.int32), np.cumsum(meets.sum(axis=1))[:-1])
                    packed = [v.tobytes() for v in table]
                    visits = [lists[i] if home[i] == c else None for i, c in zip(who, cell, strict=True)]
                    taken = pa.array(rows[who])
                    yield pa.RecordBatch.from_arrays(
                        [
                            part.column("row").take(taken), part.column("id").take(taken),
                            pa.array(home[who] + first, pa.int32()), pa.array(cell + first, pa.int32()),
                            pa.array(visits, pa.list_(pa.int32())), pa.array([packed[i] for i in who], pa.binary()),
                        ],
                        ["row", "id", "home", "cell", "visits", "v"],
                    )

    return vectors.mapInArrow(lean(run), f"row long, id {kind}, home int, cell int, visits array<int>, v binary")


class Forest:
    """Labels of rows, joined by the links of one block after the other."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def root(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return int(i)

    def join(self, hit: np.ndarray, left: np.ndarray, right: np.ndarray) -> None:
        """Spread the least label along the links of a block, then join the labels that met."""
        old = [np.array([self.root(i) for i in side]) for side in (left, right)]
        a, b, most = old[0].copy(), old[1].copy(), len(self.parent)
        while True:
            a_new = np.minimum(a, np.where(hit, b[None, :], most).min(axis=1, initial=most))
            b_new = np.minimum(b, np.where(hit, a_new[:, None], most).min(axis=0, initial=most))
            if (a_new == a).all() and (b_new == b).all():
                break
            a, b = a_new, b_new
        for before, after in set(zip(np.concatenate(old).tolist(), np.concatenate([a, b]).tolist(), strict=True)):
            x, y = self.root(before), self.root(after)
            if x != y:
                self.parent[max(x, y)] = min(x, y)


def _links(least: float, cells: int):
    """Links of a block of members with another block: their number per vector, and a spanning forest."""

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        cell, i, j = (k.as_py() for k in key)
        schema = pa.schema([("row", pa.int64()), ("id", left.schema.field("id").type), ("n", pa.int64()), ("root", left.schema.field("id").type)])
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        a, b = (
            np.frombuffer(b"".join(t.column("v").to_pylist()), np.float64).reshape(t.num_rows, -1) for t in (left, right)
        )
        rows = np.concatenate([left.column("row").to_numpy(), right.column("row").to_numpy()])
        names, first, at = np.unique(rows, return_index=True, return_inverse=True)
        at_a, at_b = at[: len(a)], at[len(a) :]
        home = right.column("home").to_numpy()
        # a pair that the smaller of both cells has too is counted there; a cell of a rare length has no visitors
        seen = np.zeros((len(a), cells + 1), bool)
        for k, own in enumerate(left.column("visits").to_pylist()):
            seen[k, np.maximum(own, -1)] = True
        number, forest = np.zeros(len(names), np.int64), Forest(len(names))
        for start in range(0, len(a), 512):
            part = slice(start, start + 512)
            hit = (a[part] @ b.T >= least) & (at_a[part, None] != at_b[None, :])
            hit &= ~(seen[part][:, np.maximum(home, -1)] & (home < cell)[None, :])
            if hit.any():
                np.add.at(number, at_a[part], hit.sum(axis=1))
                if i != j:  # a block with itself has each pair in both orders
                    np.add.at(number, at_b, hit.sum(axis=0))
                forest.join(hit, at_a[part], at_b)
        some = np.flatnonzero(number)
        ids = pa.chunked_array([*left.column("id").chunks, *right.column("id").chunks]).take(pa.array(first))
        roots = np.array([forest.root(k) for k in some], np.int64)
        return pa.table(
            [pa.array(names[some]), ids.take(pa.array(some)), pa.array(number[some]), ids.take(pa.array(roots))], schema=schema
        )

    return run


def near_duplicates(
    table: DataFrame,
    by: str = "vec_id",
    vector: str = "embedding",
    least: float = 0.95,
    slack: float = 0.5,
    sample_rows: int = 20_000,
    cell_rows: int = 1000,
    most_cells: int = 4096,
    block_rows: int = 2048,
) -> DataFrame:
    """For every vector ``by``, ``n_links``, ``component_id`` and ``kept``.

    The centres are fitted on about ``sample_rows`` vectors, one for ``cell_rows`` vectors of a length and at most
    ``most_cells``; a cell that grows beyond ``block_rows`` is worked on in more tasks.
    """
    scratch = Scratch(table.sparkSession, "embeddings")
    rows = table.select(F.col(by).alias("id"), F.col(vector).cast("array<double>").alias("v"))
    rows = rows.withColumn("row", F.xxhash64("id", "v"))
    total = rows.count()
    drawn = rows.where(share(F.col("row"), total, sample_rows) & F.col("v").isNotNull()).select("v").toArrow()
    lists = drawn.column("v").to_pylist()
    lengths, centres, cells = np.array([len(v) for v in lists]), {}, 0
    for width in np.unique(lengths[lengths > 0]).tolist():
        own = np.flatnonzero(lengths == width)
        sample, good = unit([lists[i] for i in own], width)
        if good.any():
            wanted = total * len(own) / len(lists) // cell_rows
            centres[width] = cells, centres_of(sample[good], int(max(1, min(wanted, most_cells, good.sum() // 4))))
            cells += len(centres[width][1])
    kind = rows.schema["id"].dataType.simpleString()
    reach = slack * math.sqrt(2 - 2 * least) + 1e-9
    known = rows.where("id IS NOT NULL AND v IS NOT NULL").dropDuplicates(["row"])
    placed = scratch.keep(_assigned(known, centres, reach), "placed")
    member = F.col("home") == F.col("cell")
    sizes = placed.groupBy("cell").agg(
        F.ceil(F.count(F.when(member, 1)) / block_rows).cast("int").alias("m"),
        F.ceil(F.count(F.when(~member, 1)) / block_rows).cast("int").alias("w"),
    )
    # one row per cell: at most ``most_cells`` of a length, and one of each length that the sample doesn't have
    dealt = placed.join(F.broadcast(sizes), "cell").withColumn(
        "block", F.when(member, F.pmod(F.hash("row"), F.greatest("m", F.lit(1)))).otherwise(F.col("m") + F.pmod(F.hash("row"), F.greatest("w", F.lit(1))))
    )
    blocks = F.col("m") + F.col("w") - 1
    left = dealt.where(member).select(
        "row", "id", "home", "visits", "v", "cell", F.col("block").alias("i"), F.explode(F.sequence(F.col("block"), blocks)).alias("j")
    )
    right = dealt.where("m > 0").select(
        "row", "id", "home", "visits", "v", "cell",
        F.explode(F.sequence(F.lit(0), F.least(F.col("block"), F.col("m") - 1))).alias("i"), F.col("block").alias("j"),
    ).toDF("row", "id", "home", "visits", "v", "cell", "i", "j")
    found = scratch.keep(
        left.groupBy("cell", "i", "j")
        .cogroup(right.groupBy("cell", "i", "j"))
        .applyInArrow(_links(least, cells), f"row long, id {kind}, n long, root {kind}"),
        "links",
    )
    roots = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")), scratch)
    numbers = found.groupBy("row").agg(F.sum("n").alias("n"))
    return (
        rows.select("id", "row")
        .join(numbers, "row", "left")
        .join(roots, F.col("id") == F.col("node"), "left")
        .select(
            F.col("id").alias(by),
            F.coalesce("n", F.lit(0)).cast("long").alias("n_links"),
            F.coalesce("root", "id").alias("component_id"),
            F.coalesce(F.coalesce("root", "id") == F.col("id"), F.lit(False)).alias("kept"),
        )
    )
