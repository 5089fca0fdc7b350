"""N-gram Jaccard join with parity sketches.

Each document is the set of its distinct word shingles. The 64-bit hashes of the shingles are XORed into a sketch of many
blocks, each shingle into one block. Two sets whose symmetric difference has d shingles differ in at most d blocks, so
the number of differing blocks bounds d from below, and so does the Hamming distance of a second sketch of single bits.
At a Jaccard similarity of t, d is at most (1 - t) / t times the smaller size. Sizes fall into bands; within a band every
document sends d + 1 of its blocks, those with the most shingles first, as keys. By the pigeonhole principle two
documents of the wanted similarity share a key. Only documents that share a key are compared, on their whole sets.

Documents with equal sets are one class from the start. In rounds every class is compared with one or two leaders of its keys,
and components are formed. Then the classes that share a key but not a component are compared with each other, every pair
once, as far as the sketches allow, so no link between two components is lost and no group is expanded into pairs.

Defined results: a null text counts as empty. A document without words has an empty set and links with nothing, also not
with another empty one. A text with fewer words than a shingle has one shingle, its whole sequence. Rows that repeat an id
are told apart by their texts, and each has the component of its own text. A null id takes part, but is never a component's id unless it is alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakewarden.llm.common import Scratch, by_bytes, lean
from lakewarden.llm.components import grouped, shared_keys
from lakewarden.llm.wordhash import mix, rows_of, sum_by_row, windows, words

#: Words of the sketch of single bits, 64 bits each.
LANES = 8
_BLOCK, _BIT, _CLASS, _KEY = (np.uint64(x) for x in (0x51ED27AB, 0xA24BAED4963EE407, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def bands(most: int = 2**40) -> np.ndarray:
    """The least size of each band: every band reaches to one and a half times its least size."""
    out = [1]
    while out[-1] < most:
        out.append(max(out[-1] + 1, -(-out[-1] * 3 // 2)))
    return np.array(out, np.int64)


BANDS = bands()


def shingles(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, one after the other, and their bounds."""
    hashes, bounds, _ = words(column, lower=True)
    grams, whole = windows(hashes, bounds, size)
    rows = rows_of(bounds)
    counts = np.diff(bounds)
    few = np.flatnonzero((counts > 0) & (counts < size))
    place = [bounds[few] + j for j in range(size)]
    alone = counts[few].astype(np.uint64)
    for j in range(size - 1):  # a shorter text is one shingle
        inside = j < counts[few]
        alone[inside] = mix(alone[inside] * np.uint64(31) + hashes[place[j][inside]])
    row = np.concatenate([rows[whole], few])
    gram = np.concatenate([grams[whole], alone])
    order = np.lexsort((gram, row))
    row, gram = row[order], gram[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (gram[1:] != gram[:-1])
    row, gram = row[new], gram[new]
    return gram, np.searchsorted(row, np.arange(len(column) + 1))


def keys_of(grams: np.ndarray, percent: int) -> np.ndarray:
    """The keys of one set: its fullest blocks for each band in which a similar set can lie."""
    n, rest = len(grams), 100 - percent
    own = int(np.searchsorted(BANDS, n, side="right")) - 1
    least = -(-percent * n // 100)
    out = []
    for band in range(int(np.searchsorted(BANDS, least, side="right")) - 1, own + 1):
        top = int(BANDS[band + 1]) - 1
        # shingles by which the set can differ from a similar one whose smaller size lies in the band
        differ = rest * n // percent if band == own else min(rest * top // percent, rest * (top + n) // (100 + percent))
        blocks = 2 * (rest * top // percent) + 8
        block = (mix(grams ^ _BLOCK) % np.uint64(blocks)).astype(np.int64)
        order = np.argsort(block, kind="stable")
        block = block[order]
        start = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
        parity = np.bitwise_xor.reduceat(mix(grams[order] ^ _KEY), start)
        count = np.diff(np.concatenate([start, [n]]))
        key = mix(parity ^ mix(block[start].astype(np.uint64) + np.uint64(band << 40)))
        if len(key) > differ + 1:
            key = key[np.lexsort((key, -count))[: differ + 1]]
        elif len(key) <= differ:  # too few blocks for the principle: such sets meet in a key of their own
            key = np.append(key, mix(np.array([band + 1], np.uint64) ^ _CLASS))
        out.append(key)
    return np.concatenate(out)


def bits_of(grams: np.ndarray) -> np.ndarray:
    """The sketch of single bits: each shingle turns one over."""
    at = (mix(grams ^ _BIT) % np.uint64(64 * LANES)).astype(np.int64)
    odd = np.bincount(at, minlength=64 * LANES).astype(np.uint8) & 1
    return np.packbits(odd).view(np.int64)


def _sketches(docs: DataFrame, size: int, percent: int) -> DataFrame:
    schema = f"id {docs.schema['id'].dataType.simpleString()}, tag long, n long, cls long, keys array<long>, bits array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text", 2_000_000):
            gram, at = shingles(batch.column("text"), size)
            n = np.diff(at)
            cls = mix(sum_by_row(mix(gram ^ _CLASS), at) + n.astype(np.uint64)).view(np.int64)
            sets = [gram[at[i] : at[i + 1]] for i in range(len(n))]
            keys = [keys_of(g, percent).view(np.int64) if len(g) else np.zeros(0, np.int64) for g in sets]
            bits = [bits_of(g) if len(g) else np.zeros(0, np.int64) for g in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("tag"), pa.array(n), pa.array(cls), pa.array(keys, pa.list_(pa.int64())), pa.array(bits, pa.list_(pa.int64()))],
                ["id", "tag", "n", "cls", "keys", "bits"],
            )

    return docs.mapInArrow(lean(run), schema)


def _sets(texts: DataFrame, size: int) -> DataFrame:
    """``cls`` with its whole set as sorted hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text", 2_000_000):
            gram, at = shingles(batch.column("text"), size)
            own = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(gram.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("cls"), own], ["cls", "grams"])

    return texts.select("cls", "text").mapInArrow(lean(run), "cls long, grams array<long>")


def _similar(same: Column, total: Column, percent: int) -> Column:
    """100 * intersection >= percent * union, for the intersection and the sum of both sizes."""
    return same * (100 + percent) >= total * percent


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a``, ``b`` of classes whose sets are similar enough."""
    one = sets.select(F.col("cls").alias("a"), F.col("grams").alias("ga"))
    two = sets.select(F.col("cls").alias("b"), F.col("grams").alias("gb"))
    both = pairs.join(one, "a").join(two, "b")
    same = F.size(F.array_intersect("ga", "gb")).cast("long")
    return both.where(_similar(same, F.size("ga").cast("long") + F.size("gb"), percent)).select("a", "b")


def groups(docs: DataFrame, by: str = "doc_id", text: str = "text", size: int = 4, percent: int = 85) -> DataFrame:
    """For every document ``by``, ``tag`` (the text's hash), ``n_shingles``, ``class_id`` (the set's hash), ``component_id``,
    the smallest id that links of similarity ``percent`` / 100 or more reach, and ``first_class``, the class of that id (the
    smallest one if the id repeats with several texts of the component)."""
    scratch = Scratch(docs.sparkSession, "jaccard")
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(by).alias("id"), F.xxhash64(body).alias("tag"), body.alias("text"))
    sketched = scratch.keep(_sketches(rows, size, percent), "sketches")
    # of the rows of a class one text stands for it: that of the smallest id; the tag tells rows of one id, or of none, apart
    place = F.struct(F.col("id").isNull().alias("none"), "id", "tag")
    classes = sketched.where("n > 0").groupBy("cls").agg(F.min(place).alias("own"), F.first("n").alias("n"))
    classes = classes.select("cls", F.col("own.id").alias("rep"), F.col("own.tag").alias("rep_tag"), "n")
    classes = scratch.keep(classes, "classes", light=True)
    # one text of each class sends its keys; a key counts if it comes from two
    owners = classes.select(F.col("cls").alias("c"), "rep", "rep_tag")
    owned = (F.col("cls") == F.col("c")) & F.col("id").eqNullSafe(F.col("rep")) & (F.col("tag") == F.col("rep_tag"))
    keyed = sketched.where("n > 0").join(owners, owned, "left_semi").select("cls", F.explode("keys").alias("key"))
    member = shared_keys(keyed.withColumnRenamed("cls", "node"), scratch)
    several = scratch.keep(member.select(F.col("node").alias("cls")).distinct().join(classes, "cls"), "several", light=True)
    # the classes that share keys grow with the corpus, so they are never broadcast
    same_text = rows["id"].eqNullSafe(several["rep"]) & (rows["tag"] == several["rep_tag"])
    texts = rows.join(several.hint("merge"), same_text).select("cls", "text")
    sets = _sets(texts, size).dropDuplicates(["cls"])  # rows that repeat id and text have the same set
    sets = scratch.keep(sets, "sets")
    facts = (
        sketched.join(several.select("cls"), "cls", "left_semi").dropDuplicates(["cls"])
        .select(F.col("cls").alias("node"), "bits", "n")
    )
    facts = scratch.keep(facts, "facts", light=True)

    def near(x: str, y: str) -> Column:
        n, m = F.col(f"{x}.n"), F.col(f"{y}.n")
        differing = F.zip_with(f"{x}.bits", f"{y}.bits", lambda p, q: F.bit_count(p.bitwiseXOR(q)))
        far = F.aggregate(differing, F.lit(0), lambda s, v: s + v)
        return (n * 100 >= m * percent) & (m * 100 >= n * percent) & (far * (100 + percent) <= (n + m) * (100 - percent))

    def verify(pairs: DataFrame) -> DataFrame:
        return _verify(pairs, sets, percent)

    found = grouped(member, facts, near, verify, scratch)
    rooted = classes.join(found.select(F.col("node").alias("cls"), "root"), "cls", "left").select(
        "cls", "rep", F.coalesce("root", "cls").alias("root")
    )
    order = F.struct(F.col("rep").isNull().alias("none"), "rep", "cls")
    least = rooted.groupBy("root").agg(F.min(order).alias("least"))
    least = least.select("root", F.col("least.rep").alias("component_id"), F.col("least.cls").alias("first_class"))
    final = rooted.join(least, "root").select("cls", "component_id", "first_class")
    result = (
        sketched.select("id", "tag", "n", "cls")
        .join(final, "cls", "left")
        .select(
            F.col("id").alias(by),
            "tag",
            F.col("n").alias("n_shingles"),
            F.when(F.col("n") > 0, F.col("cls")).alias("class_id"),
            F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"),
            "first_class",
        )
    )
    # sets and sketches are many times larger than the result and would lie there for as long as it is read
    result = Scratch(docs.sparkSession, "jaccard-groups").keep(result, "groups")
    scratch.drop_all()
    return result
