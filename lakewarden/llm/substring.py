"""Removal of long word sequences that an earlier document holds, by suffix automata of reference shards.

A window is ``size`` consecutive words of one document. Every word is removed that a window covers whose sequence also
starts in a document with a smaller id.

Sending every shard of the corpus to every document would cost the square of the corpus. So the shards are routed: each
window chooses the least hash of its ``gram``-word sequences as its anchor, and equal windows choose the same one. The
windows of a document that share an anchor form a segment; a shard is the segments of one anchor. Anchors of one document
only are dropped, equal segments are merged to their first document, and what is left are the shards whose segments
differ. In each of them a suffix automaton grows over the segments by ascending id, and every segment is streamed through
the automaton of the smaller ids first: where the matching statistic reaches ``size``, the window is covered. The
automaton compares the words themselves.

A shard with more than ``hot`` segments is split into its windows, dealt by their hash: equal windows stay together, and no
task gets an unbounded shard.

Defined results: a null text counts as empty. A document with fewer words than a window loses nothing. Rows that repeat an
id don't remove anything from each other. A null id neither removes nor loses anything.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakewarden.llm.common import Scratch, by_bytes, lean
from lakewarden.llm.wordhash import rows_of, stretches, windows, words


class Automaton:
    """Suffix automaton of several word sequences; words are any hashable values."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link = [-1]
        self.size = [0]

    def _state(self, size: int, moves: dict, link: int) -> int:
        self.next.append(moves)
        self.size.append(size)
        self.link.append(link)
        return len(self.size) - 1

    def _divided(self, before: int, word) -> int:
        """The state reached by ``word`` that holds nothing longer than ``before`` and the word."""
        to = self.next[before][word]
        if self.size[to] == self.size[before] + 1:
            return to
        copy = self._state(self.size[before] + 1, dict(self.next[to]), self.link[to])
        self.link[to] = copy
        while before >= 0 and self.next[before].get(word) == to:
            self.next[before][word] = copy
            before = self.link[before]
        return copy

    def add(self, sequence: list) -> None:
        last = 0
        for word in sequence:
            if word in self.next[last]:
                last = self._divided(last, word)
                continue
            new = self._state(self.size[last] + 1, {}, 0)
            before = last
            while before >= 0 and word not in self.next[before]:
                self.next[before][word] = new
                before = self.link[before]
            if before >= 0:
                self.link[new] = self._divided(before, word)
            last = new

    def statistics(self, sequence: list) -> list[int]:
        """For every word the length of the longest match that ends with it."""
        state = length = 0
        out = []
        for word in sequence:
            while state and word not in self.next[state]:
                state = self.link[state]
                length = self.size[state]
            to = self.next[state].get(word)
            if to is None:
                length = 0
            else:
                state, length = to, length + 1
            out.append(length)
        return out


def least_places(values: np.ndarray, width: int) -> np.ndarray:
    """For every place the place of the leftmost least value among the next ``width`` ones."""
    best, reach = np.arange(len(values)), 1
    while reach < width:
        step = min(reach, width - reach)
        right = best[np.minimum(np.arange(len(values)) + step, len(values) - 1)]
        best = np.where(values[right] < values[best], right, best)
        reach += step
    return best


def segments(column: pa.Array, size: int, gram: int) -> dict[str, np.ndarray]:
    """The segments of each text: row, anchor, hash of the words, first word and number of words."""
    hashes, bounds, _ = words(column)
    grams, _ = windows(hashes, bounds, gram)
    counts = np.diff(bounds)
    rows = rows_of(bounds)
    fits = np.repeat(bounds[1:], counts) - np.arange(len(hashes)) >= size
    place = least_places(grams, size - gram + 1)
    starts = np.flatnonzero(fits)
    anchor, row = place[starts], rows[starts]
    first = np.ones(len(starts), bool)
    first[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])
    head = np.flatnonzero(first)
    begin = starts[head]
    length = np.diff(np.append(head, len(starts))) + size - 1
    whole = stretches(hashes, begin, length)
    return {
        "row": row[head], "anchor": grams[anchor[head]].view(np.int64), "hash": whole.view(np.int64),
        "begin": begin - bounds[row[head]], "length": length, "counts": counts,
    }


def _listed(docs: DataFrame, size: int, gram: int) -> DataFrame:
    """The segments of every document that has any, in one row per document."""
    schema = f"id {docs.schema['id'].dataType.simpleString()}, tag long, h array<long>, g array<long>, p array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text"):
            found = segments(batch.column("text"), size, gram)
            at = pa.array(np.searchsorted(found["row"], np.arange(batch.num_rows + 1)), pa.int32())
            packed = found["begin"] << 20 | found["length"]
            lists = [pa.ListArray.from_arrays(at, pa.array(x)) for x in (found["anchor"], found["hash"], packed)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("tag"), *lists], ["id", "tag", "h", "g", "p"]
            )

    return docs.mapInArrow(lean(run), schema).where(F.size("h") > 0)


def _shards(asked: DataFrame, size: int, hot: int) -> DataFrame:
    """The words of the asked segments; of a hot shard, the windows one by one."""
    kind = asked.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text", 2_000_000):
            out: list[list] = [[] for _ in range(6)]
            for lo, text, wanted in zip(*(batch.column(c).to_pylist() for c in ("id", "text", "wanted")), strict=True):
                own = text.encode().split()
                for s in wanted:
                    begin, length = s["p"] >> 20, s["p"] & 0xFFFFF
                    single = s["c"] > hot
                    for at in range(length - size + 1) if single else (0,):
                        part = b" ".join(own[begin + at : begin + at + (size if single else length)])
                        salt = int.from_bytes(hashlib.blake2b(part, digest_size=4).digest(), "big") if single else -1
                        for column, value in zip(out, (s["h"], salt, lo, s["g"], at, part), strict=True):
                            column.append(value)
            kinds = (pa.int64(), pa.int64(), batch.schema.field("id").type, pa.int64(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, t) for x, t in zip(out, kinds, strict=True)], ["h", "salt", "lo", "g", "at", "words"]
            )

    return asked.mapInArrow(lean(run), f"h long, salt long, lo {kind}, g long, at int, words binary")


def _matched(shards: DataFrame, size: int) -> DataFrame:
    """For each segment the places of its covered windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, lo, automaton, waiting = None, None, None, []
        for batch in batches:
            out: list[list] = [[], [], []]
            for h, salt, own, g, at, part in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (h, salt) != shard:
                    shard, lo, automaton, waiting = (h, salt), own, Automaton(), []
                if own != lo:  # what came before is smaller now
                    for sequence in waiting:
                        automaton.add(sequence)
                    lo, waiting = own, []
                sequence = part.split(b" ")
                reached = automaton.statistics(sequence)
                covered = [at + end - size + 1 for end, length in enumerate(reached) if length >= size]
                waiting.append(sequence)
                if covered:
                    for column, value in zip(out, (h, g, covered), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.list_(pa.int32()))],
                ["h", "g", "covered"],
            )

    dealt = shards.repartition("h", "salt").sortWithinPartitions("h", "salt", "lo", "g", "at")
    return dealt.mapInArrow(lean(run), "h long, g long, covered array<int>")


def spans(docs: DataFrame, scratch: Scratch, size: int, gram: int, hot: int) -> DataFrame:
    """``id``, ``tag`` and ``spans``: the covered stretches of words, as first word and number of words."""
    listed = scratch.keep(_listed(docs.where("id IS NOT NULL"), size, gram), "segments")
    each = listed.select("id", "tag", F.explode(F.arrays_zip("h", "g", "p")).alias("s")).select("id", "tag", "s.*")
    repeated = (
        each.select("id", "h").groupBy("h").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select("h")
    )
    each = scratch.keep(each.join(repeated, "h"), "repeated")
    scratch.drop(listed)
    firsts = each.groupBy("h", "g").agg(F.min(F.struct("id", "tag", "p")).alias("f")).select("h", "g", "f.*")
    firsts = scratch.keep(firsts, "firsts", light=True)
    mixed = firsts.groupBy("h").agg(F.count("*").alias("c")).where("c > 1")
    wanted = (
        firsts.join(mixed, "h").groupBy("id", "tag").agg(F.collect_list(F.struct("h", "c", "g", "p")).alias("wanted"))
    )
    shards = _shards(docs.join(wanted.hint("merge"), ["id", "tag"]).dropDuplicates(["id", "tag"]).select("id", "text", "wanted"), size, hot)
    covered = _matched(shards, size).groupBy("h", "g").agg(F.flatten(F.collect_list("covered")).alias("covered"))
    known = firsts.select("h", "g", F.col("id").alias("first")).join(covered, ["h", "g"], "left")
    begin, length = F.shiftright("p", 20).cast("int"), F.col("p").bitwiseAND(F.lit(0xFFFFF)).cast("int")
    whole = F.array(F.struct(begin.alias("s"), length.alias("n")))
    parts = F.transform("covered", lambda at: F.struct((begin + at).alias("s"), F.lit(size).alias("n")))
    return (
        each.join(known, ["h", "g"])
        .select("id", "tag", F.when(F.col("id") > F.col("first"), whole).otherwise(parts).alias("spans"))
        .where(F.size("spans") > 0)
        .groupBy("id", "tag")
        .agg(F.flatten(F.collect_list("spans")).alias("spans"))
    )


def deduplicate(
    docs: DataFrame, by: str = "doc_id", text: str = "text", size: int = 50, gram: int = 20, hot: int = 1000,
    texts: bool = True,
) -> DataFrame:
    """For every document ``by``, ``n_words``, ``n_removed``, ``kept`` (the kept words joined by a space; null without
    ``texts``) and its digest ``kept_sha256``."""
    scratch = Scratch(docs.sparkSession, "substring")
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(by).alias("id"), F.xxhash64(body).alias("tag"), body.alias("text"))
    found = scratch.keep(spans(rows, scratch, size, gram, hot), "spans", light=True)
    joined = rows.join(found.hint("merge"), ["id", "tag"], "left").select("id", "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text"):
            n, removed, kept = [], [], []
            places = batch.column("spans").to_pylist()
            for value, covered in zip(batch.column("text").to_pylist(), places, strict=True):
                own = value.encode().split()
                n.append(len(own))
                if covered:
                    keep = np.ones(len(own), bool)
                    for s in covered:
                        keep[s["s"] : s["s"] + s["n"]] = False
                    own = [w for w, k in zip(own, keep.tolist(), strict=True) if k]
                removed.append(n[-1] - len(own))
                kept.append(b" ".join(own))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()),
                    pa.array([k.decode() if texts else None for k in kept], pa.string()),
                    pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()),
                ],
                [by, "n_words", "n_removed", "kept", "kept_sha256"],
            )

    kind = rows.schema["id"].dataType.simpleString()
    return joined.mapInArrow(lean(run), f"`{by}` {kind}, n_words long, n_removed long, kept string, kept_sha256 string")
