"""Fuzzy removal of repeated lines.

A line is normalised to its words: runs of ASCII letters and digits and of all other letters above ASCII, A-Z folded,
joined by a space. Equal normalised lines are one class. Two classes are linked if their edit similarity in bytes is
``similarity`` or more; of every connected group the occurrence with the smallest id, then the first line, stays, and all
others go.

Classes meet by blocks of a SimHash of 64 bits: over the words of the line or, if it is short or has few words, over its
``FEATURE``-byte windows. There are ``BLOCKS`` blocks of ``WIDTH`` bits, so lines whose SimHashes differ in fewer bits than there
are blocks share one. Five bits alone select little, and wider blocks lose near lines, so each block stands together with the
least hash, in an order of its own, of the line's windows of ``RUN`` words or ``WINDOW`` bytes. Lines that meet are compared if the
bits between the SimHashes of their words are within ``REACH``, which was measured by length, and linked by their edit distance.
Lines under ``EXACT`` bytes have too few windows and meet by segments instead: the shorter one is cut into one more segment
than edits are allowed, so one of them lies whole in the longer one, near its own place.

Only keys and class hashes are shuffled to find keys that several classes have, then lengths, SimHashes and sketches of those classes to find
pairs that can be near, and lines are fetched for the classes that have such a pair.

Defined results: lines with fewer than ``least_words`` words never go, and lines without a word never; with 1, exact repeats
go at any length, and near ones from the length in bytes at which ``similarity`` allows one edit (10 at 0.9). A null text counts as empty, with one empty line.
Rows that repeat an id are told apart by their texts; equal ones keep or lose the same lines. A row with a null id loses
nothing and makes no other one lose anything. Columns of ``keep`` that are named like a new one, in any case, are left out.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakewarden.llm import linepairs
from lakewarden.llm.common import Scratch, by_bytes, kept_columns, lean
from lakewarden.llm.components import components
from lakewarden.llm.wordhash import mix, raw, stretches, words_in

#: ASCII bytes that belong to no word.
BREAKS = bytes(b for b in range(128) if not chr(b).isalnum())
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
#: Lines under so many bytes meet by segments.
EXACT = 40
#: Lines from so many bytes and words on meet by words; those up to the second numbers by bytes, and some do both, so that
#: lines on different sides of a limit meet too.
BY_WORDS, BY_BYTES = (150, 8), (170, 12)
#: Bytes of the windows that the SimHash sums up where it isn't words, and the windows whose least hash stands beside a block.
FEATURE, WINDOW, RUN = 4, 8, 4
#: Blocks of a SimHash and bits of a block.
BLOCKS, WIDTH = 12, 5
#: The most bits in which SimHashes of the words of near lines differ, from a length in bytes on. The largest distance between
#: lines of edit similarity 0.9 in the given tables is 12 bits of 64 from 100 bytes on and 10 from 200 on, to which a half and more is added; unrelated lines
#: differ in 32. Fixed values, as measured.
REACH = [(100, 19), (200, 15)]
#: Bits of the sketch of byte pairs. One edit in bytes takes at most two pairs away and adds at most two, and each turns one bit over.
PAIR_BITS, PER_EDIT = 256, 4
#: Lines whose sketches are made at once.
SKETCHED = 10_000
#: Classes that a task remembers to send their keys once.
REMEMBERED = 500_000
#: The kind of rows that hold the lines of a document, beside the parcels.
LISTED = 0
_TURNS = np.random.default_rng(5).integers(0, 2**63, BLOCKS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SIGN = np.uint64(0x8CB92BA72F3D8DD7)
_PAIR_BIT = (mix(np.arange(1 << 16, dtype=np.uint64)) % np.uint64(PAIR_BITS)).astype(np.uint8)


def normalised(line: bytes) -> bytes:
    return b" ".join(WORD.findall(line.lower()))


def edits(length: int, similarity: float) -> int:
    """By how many bytes a line may differ from one that is not longer."""
    return int((1 - similarity) * length + 1e-9)


def segments(line: bytes, similarity: float) -> list[int]:
    """Keys of a short line: its own segments, and the parts of it that can be segments of a line that is not longer."""
    n, out = len(line), set()

    def cuts(length: int, most: int) -> list[tuple[int, int]]:
        ends = [length * i // (most + 1) for i in range(most + 2)]
        return list(zip(ends, ends[1:], strict=False))

    longest = n
    while longest < EXACT and longest - n <= edits(longest, similarity):
        most = edits(longest, similarity)
        out |= {(n, most, i, line[a:b]) for i, (a, b) in enumerate(cuts(n, most))} if most else set()
        longest += 1
    most = edits(n, similarity)
    for shorter in range(n - most, n) if most else ():
        for i, (a, b) in enumerate(cuts(shorter, most)):
            more = n - shorter
            first = max(a - i, a + more - (most - i), 0)
            last = min(a + i, a + more + (most - i), n - (b - a))
            out |= {(shorter, most, i, line[x : x + b - a]) for x in range(first, last + 1)}
    for i, (a, b) in enumerate(cuts(n, most)) if most else ():
        out |= {(n, most, i, line[x : x + b - a]) for x in range(max(a - min(i, most - i), 0), min(a + min(i, most - i), n - (b - a)) + 1)}
    return [int.from_bytes(hashlib.blake2b(b"%d %d %d " % k[:3] + k[3], digest_size=8).digest(), "little", signed=True) for k in out]


def _windows(part: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` bytes from each place on, four to sixteen; those near the end are cut off."""
    part = part.astype(np.uint64)
    eight = np.zeros(len(part), np.uint64)
    for j in range(min(size, 8)):
        eight[: len(part) - j] |= part[j:] << np.uint64(8 * j)
    out = mix(eight)
    if size > 8:  # the last eight bytes overlap the first ones
        out[: len(out) - size + 8] = mix(out[: len(out) - size + 8] ^ (eight[size - 8 :] * _SIGN))
    return out


def _slices(begin: np.ndarray, length: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    at = 0
    while at < len(begin):
        stop = max(at + 1, int(np.searchsorted(begin, begin[at] + most)))
        yield at, stop
        at = stop


def _places(begin: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each line's stretch starts when the stretches are put side by side, and where their elements come from."""
    start = np.cumsum(number) - number
    return start, np.repeat(begin - start, number) + np.arange(number.sum())


def simhash(features: np.ndarray, start: np.ndarray, number: np.ndarray) -> np.ndarray:
    """The SimHash of each line from the hashes of its features: for each bit what most of them have."""
    bits = np.unpackbits(mix(features ^ _SIGN).view(np.uint8).reshape(-1, 8), axis=1)
    ones = np.add.reduceat(bits, start, axis=0, dtype=np.int32)
    return np.packbits(2 * ones > number[:, None], axis=1).view(np.uint64)[:, 0]


def _keys(features: tuple, windows: tuple, out: np.ndarray) -> np.ndarray:
    """A key for each block of the SimHashes of some lines, with the least hash of their windows; the SimHashes."""
    marks, (hashes, start, _) = simhash(*features), windows
    for i, turn in enumerate(_TURNS):
        block = marks >> np.uint64(i * WIDTH) & np.uint64((1 << WIDTH) - 1)
        least = np.minimum.reduceat(hashes * turn, start)
        out[:, i] = mix(least ^ mix(block + np.uint64(i << WIDTH)))
    return marks


def keys_by_bytes(text: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Keys of lines that lie in ``text`` in order."""
    out = np.zeros((len(begin), BLOCKS), np.uint64)
    for at, stop in _slices(begin, length, 100_000):
        part = text[begin[at] : begin[stop - 1] + length[stop - 1]]
        parts = []
        for size in (FEATURE, WINDOW):
            number = length[at:stop] - size + 1
            start, place = _places(begin[at:stop] - begin[at], number)
            parts.append((_windows(part, size)[place], start, number))
        _keys(*parts, out[at:stop])
    return out.view(np.int64)


def keys_by_words(hashes: np.ndarray, first: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of lines given by the number of their first word and how many they have, and the SimHashes of their words."""
    out, marks = np.zeros((len(first), BLOCKS), np.uint64), np.zeros(len(first), np.uint64)
    for at, stop in _slices(first, words, 20_000):
        part = hashes[first[at] : first[stop - 1] + words[stop - 1]]
        runs = np.zeros(len(part), np.uint64)
        for j in range(RUN):
            runs[: len(part) - j] = mix(runs[: len(part) - j] ^ part[j:]) + np.uint64(j)
        parts = []
        for values, size in ((part, 1), (runs, RUN)):
            number = words[at:stop] - size + 1
            start, place = _places(first[at:stop] - first[at], number)
            parts.append((values[place], start, number))
        marks[at:stop] = _keys(*parts, out[at:stop])
    return out.view(np.int64), marks


def distance(one: bytes, other: bytes, most: int) -> int | None:
    """Edit distance in bytes if it is at most ``most``.

    Common ends are taken off. Then one column of the table of distances after the other is kept as two long integers, a bit
    for each step up and each step down between neighbouring rows.
    """
    if abs(len(one) - len(other)) > most:
        return None
    n, m = len(one), len(other)
    head = _common(one, other, 1)
    tail = min(_common(one, other, -1), min(n, m) - head)
    one, other = one[head : n - tail], other[head : m - tail]
    if len(one) > len(other):
        one, other = other, one
    n, m = len(one), len(other)
    if not n:
        return m if m <= most else None
    places: dict[int, int] = {}
    for i, byte in enumerate(one):
        places[byte] = places.get(byte, 0) | 1 << i
    full, top = (1 << n) - 1, 1 << (n - 1)
    up, down, found = full, 0, n
    for left, byte in enumerate(other, 1 - m):
        same = places.get(byte, 0)
        zero = ((same & up) + up ^ up) | same | down
        rise, fall = down | ~(zero | up) & full, up & zero
        found += bool(rise & top) - bool(fall & top)
        if found + left > most:  # each byte that is left lowers it by one at most
            return None
        rise = (rise << 1 | 1) & full
        fall = fall << 1 & full
        up, down = fall | ~(zero | rise) & full, rise & zero
    return found if found <= most else None


def _common(one: bytes, other: bytes, way: int) -> int:
    """Length of the common beginning, or end for -1."""
    a, b = (np.frombuffer(x, np.uint8)[::way] for x in (one, other))
    k = min(len(a), len(b))
    differing = a[:k] != b[:k]
    return int(differing.argmax()) if differing.any() else k


class _Lines:
    """All lines of some texts that have enough words: ``row``, ``number`` within the row, hash ``h``; ``text``, normalised, with
    the ``begin`` and ``length`` of each; and the hashes of all words, with the ``first`` one and the number of ``words`` of each."""

    def __init__(self, column: pa.Array, least_words: int):
        data, bounds = raw(column)
        feeds = np.flatnonzero(data == 10) + 1
        edges = np.union1d(bounds, feeds)
        self.hashes, at, starts, sizes = words_in(data, edges, lower=True, breaks=BREAKS)
        words = np.diff(at)
        chosen = np.flatnonzero(words >= max(1, least_words))
        self.first, self.words = at[:-1][chosen], words[chosen]
        self.h = stretches(self.hashes, self.first, self.words).view(np.int64)
        start = edges[:-1][chosen]
        self.row = np.searchsorted(bounds, start, side="right") - 1
        # line numbers within the text: line feeds before the line, less those before the text
        self.number = np.searchsorted(feeds, start, side="right") - np.searchsorted(feeds, bounds[self.row], side="right")
        # every word and a space
        off = np.concatenate([[0], np.cumsum(sizes + 1)])
        self.begin, self.length = off[at[:-1][chosen]], off[at[1:][chosen]] - off[at[:-1][chosen]] - 1
        self._source = data, starts, sizes, off

    def only(self, taken: np.ndarray) -> None:
        for name in ("row", "number", "h", "first", "words", "begin", "length"):
            setattr(self, name, getattr(self, name)[taken])

    @property
    def text(self) -> np.ndarray:
        data, starts, sizes, off = self._source
        source = np.repeat(starts - off[:-1], sizes + 1) + np.arange(off[-1])
        text = data[np.minimum(source, len(data) - 1)] if len(source) else np.zeros(0, np.uint8)
        text = np.where((text >= 65) & (text <= 90), text + 32, text).astype(np.uint8)
        text[off[1:] - 1] = 32
        return text


def pair_sketches(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A sketch of each line's pairs of neighbouring bytes, one row of 64-bit numbers a line: each pair turns one bit over."""
    out = np.zeros((len(bounds) - 1, PAIR_BITS // 64), np.int64)
    for at in range(0, len(out), SKETCHED):
        own = bounds[at : at + SKETCHED + 1]
        part = data[own[0] : own[-1]].astype(np.uint16)
        line = np.repeat(np.arange(len(own) - 1) * PAIR_BITS, np.diff(own))
        bit = line[:-1] + _PAIR_BIT[part[:-1] << 8 | part[1:]]
        odd = np.bincount(bit[line[1:] == line[:-1]], minlength=(len(own) - 1) * PAIR_BITS).astype(np.uint8) & 1
        out[at : at + SKETCHED] = np.packbits(odd).view(np.int64).reshape(len(own) - 1, -1)
    return out


def _read(docs: DataFrame, least_words: int, similarity: float) -> DataFrame:
    """For every document its lines with enough words, as an array of hash and number, and in rows of their own parcels of the keys and of
    the facts of lines: length, number of words, SimHash of the words and sketch of the byte pairs. A task sends those of a class once, as far as it remembers."""
    schema = f"id {docs.schema['id'].dataType.simpleString()}, tag long, lines array<struct<h: long, line: long>>, {linepairs.PARCEL}"
    names = ["id", "tag", "lines", "kind", "bucket", "data"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[int] = set()
        keyed, known = linepairs.Parcels(linepairs.KEYS), linepairs.Parcels(linepairs.FACTS)
        types: dict[str, pa.DataType] = {}

        def filled(batch: pa.RecordBatch) -> pa.RecordBatch:
            columns = [batch.column(c) if c in batch.schema.names else pa.nulls(batch.num_rows, types[c]) for c in names]
            return pa.RecordBatch.from_arrays(columns, names)

        for batch in by_bytes(batches, "text", 1_000_000):
            own = _Lines(batch.column("text"), least_words)
            lists = pa.array(np.searchsorted(own.row, np.arange(batch.num_rows + 1)), pa.int32())
            inner = pa.StructArray.from_arrays([pa.array(own.h), pa.array(own.number)], ["h", "line"])
            found = pa.ListArray.from_arrays(lists, inner)
            types = {"id": batch.column("id").type, "tag": pa.int64(), "lines": found.type, "bucket": pa.int32(), "data": pa.binary()}
            kind = pa.array(np.full(batch.num_rows, LISTED, np.int32))
            texts = [batch.column("id"), batch.column("tag"), found, kind]
            yield filled(pa.RecordBatch.from_arrays(texts, ["id", "tag", "lines", "kind"]).filter(pa.compute.greater(pa.compute.list_value_length(found), 0)))
            if len(sent) > REMEMBERED:
                sent.clear()
            own.only(np.array([not (x in sent or sent.add(x)) for x in own.h.tolist()], bool))
            sketches, marks, number, keys = _sketched(own, similarity)
            yield from map(filled, keyed.add(*linepairs.key_records(keys, np.repeat(own.h, number))))
            yield from map(filled, known.add(*linepairs.fact_records(own.h, own.length, own.words, marks, sketches)))
        yield from map(filled, [*keyed.rest(), *known.rest()])

    return docs.mapInArrow(lean(run), schema)


def _sketched(own: _Lines, similarity: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sketches of byte pairs and SimHashes of some lines; the number of keys of each and the keys."""
    text = own.text
    many = (own.length >= BY_WORDS[0]) & (own.words >= BY_WORDS[1])
    # a line that is a little shorter than EXACT can be near one that is not
    few = ((own.length <= BY_BYTES[0]) | (own.words <= BY_BYTES[1])) & (own.length >= int(EXACT * similarity))
    by_words, marked = keys_by_words(own.hashes, own.first[many], own.words[many])
    by_bytes_ = keys_by_bytes(text, own.begin[few], own.length[few])
    short = np.flatnonzero(own.length < EXACT)
    parts = [segments(text[own.begin[i] : own.begin[i] + own.length[i]].tobytes(), similarity) for i in short]
    number = BLOCKS * (many.astype(np.int64) + few)
    number[short] += np.array([len(x) for x in parts], np.int64)
    bounds = np.concatenate([[0], np.cumsum(number)])
    keys = np.zeros(bounds[-1], np.int64)
    blocks = np.arange(BLOCKS)
    keys[bounds[:-1][many][:, None] + blocks] = by_words
    keys[(bounds[:-1] + BLOCKS * many)[few][:, None] + blocks] = by_bytes_
    for i, x in zip(short, parts, strict=True):
        keys[bounds[i + 1] - len(x) : bounds[i + 1]] = x
    marks = np.zeros(len(many), np.uint64)
    marks[many] = marked
    start, place = _places(own.first[~many], own.words[~many])
    if len(place):
        marks[~many] = simhash(own.hashes[place], start, own.words[~many])
    start, place = _places(own.begin, own.length)
    sketches = pair_sketches(text[place], np.concatenate([start, [len(place)]]))
    return sketches, marks.view(np.int64), number, keys


def _texts(asked: DataFrame) -> DataFrame:
    """``node`` and the normalised text of the asked lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text"):
            nodes, lines = [], []
            for text, wanted in zip(batch.column("text").to_pylist(), batch.column("wanted").to_pylist(), strict=True):
                own = text.encode().split(b"\n")
                for w in wanted:
                    nodes.append(w["node"])
                    lines.append(normalised(own[w["line"]]))
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(lines, pa.binary())], ["node", "words"])

    return asked.mapInArrow(lean(run), "node long, words binary")


def removed(docs: DataFrame, scratch: Scratch, similarity: float, least_words: int) -> DataFrame:
    """``id``, ``tag`` and ``gone``, the numbers of the lines that go."""
    docs = docs.where("id IS NOT NULL")
    parts = [LISTED, linepairs.KEYS, linepairs.FACTS]
    listed, keys, facts = scratch.keep_parts(_read(docs, least_words, similarity), "lines", "kind", parts)
    each = listed.select("id", "tag", F.explode("lines").alias("x")).select("id", "tag", "x.h", "x.line")
    place = F.struct("id", "tag", "line")
    classes = scratch.keep(each.groupBy("h").agg(F.min(place).alias("first"), F.count("*").alias("c")), "classes")
    members = scratch.keep(linepairs.groups(keys.select("kind", "bucket", "data")), "members")
    scratch.drop(keys)
    near = {"similarity": similarity, "reach": REACH, "worded": BY_WORDS[1], "per_edit": PER_EDIT}
    rows = scratch.keep(linepairs.candidates(members, facts.select("kind", "bucket", "data"), **near), "candidates")
    scratch.drop(members, facts)
    wanted = (
        classes.select(F.col("h").alias("node"), "first").join(rows.select("node").distinct(), "node").groupBy("first.id", "first.tag")
        .agg(F.collect_list(F.struct("node", F.col("first.line").alias("line"))).alias("wanted"))
    )
    # what is asked for grows with the corpus, so it is never broadcast
    asked = docs.join(wanted.hint("merge"), ["id", "tag"]).dropDuplicates(["id", "tag"]).select("text", "wanted")
    texts = scratch.keep(_texts(asked), "texts")
    links = scratch.keep(linepairs.links(rows, texts, distance, **near), "links")
    scratch.drop(rows, texts)
    roots = components(links, scratch)
    # the first place of every class that occurs twice or belongs to a group
    rooted = classes.join(roots.select(F.col("node").alias("h"), "root"), "h", "left").where("c > 1 OR root IS NOT NULL")
    rooted = scratch.keep(rooted.select("h", "first", F.coalesce("root", "h").alias("root")), "rooted", light=True)
    scratch.drop(classes, links)
    kept = rooted.groupBy("root").agg(F.min("first").alias("kept"))
    kept = rooted.join(kept, "root").select("h", "kept")
    gone = (
        each.join(kept, "h")
        .where((F.col("id") != F.col("kept.id")) | (F.col("tag") != F.col("kept.tag")) | (F.col("line") != F.col("kept.line")))
        .groupBy("id", "tag")
        .agg(F.collect_set("line").alias("gone"))
    )
    gone = scratch.keep(gone, "gone", light=True)
    scratch.drop(listed, rooted)
    return gone


def deduplicate(
    docs: DataFrame, keep: list[str], by: str = "doc_id", text: str = "text", similarity: float = 0.9, least_words: int = 5,
    texts: bool = True,
) -> DataFrame:
    """The columns ``keep`` with ``n_lines``, ``n_removed``, ``kept`` (the text without the removed lines; null without
    ``texts``) and its digest ``kept_sha256``."""
    scratch = Scratch(docs.sparkSession, "lines")
    body = F.coalesce(F.col(text), F.lit(""))
    new = ["n_lines", "n_removed", "kept", "kept_sha256"]
    keep, columns, fields = kept_columns(docs, keep, new)
    rows = docs.select(F.col(by).alias("id"), F.xxhash64(body).alias("tag"), body.alias("text"))
    gone = removed(rows, scratch, similarity, least_words)
    whole = docs.select(*columns, F.col(by).alias("id"), F.xxhash64(body).alias("tag"), body.alias("text"))
    joined = whole.join(gone.hint("merge"), ["id", "tag"], "left").select(*[f"__{i}" for i in range(len(keep))], "text", "gone")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text"):
            n, less, kept = [], [], []
            for value, out in zip(batch.column("text").to_pylist(), batch.column("gone").to_pylist(), strict=True):
                if out:
                    lines, out = value.split("\n"), set(out)
                    n.append(len(lines))
                    value = "\n".join([x for i, x in enumerate(lines) if i not in out])
                else:
                    n.append(value.count("\n") + 1)
                less.append(len(out or ()))
                kept.append(value)
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(i) for i in range(len(keep))), pa.array(n, pa.int64()), pa.array(less, pa.int64()),
                    pa.array([k if texts else None for k in kept], pa.string()),
                    pa.array([hashlib.sha256(k.encode()).hexdigest() for k in kept], pa.string()),
                ],
                [*keep, *new],
            )

    kinds = [T.LongType(), T.LongType(), T.StringType(), T.StringType()]
    schema = T.StructType(fields + [T.StructField(c, k) for c, k in zip(new, kinds, strict=True)])
    return joined.mapInArrow(lean(run), schema)
