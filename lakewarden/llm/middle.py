"""Fill-in-the-middle transformation: texts cut at two places and put together in another order.

The places at which a text may be cut are a set of byte offsets of its UTF-8 form: the starts of its code points, words or
lines, and its end. The set is held as a compressed bitmap: offsets with the same upper bits share a container, which is an
array of places, a bitmap or a list of runs, whichever takes the least room, and the containers' cumulative cardinalities
stand beside them. The offset after ``k`` units is the member of rank ``k``: a search among the cardinalities gives the
container, and the container selects within itself. Cutting then takes slices of bytes, so no text is decoded.

A hash of the seed and the id decides everything, so a lost task gives the same rows again. Its first four numbers of 32 bits
are h1 to h4: the prefix ends after the smaller of h1 and h2 modulo one more than the number of units, the middle after the
larger; h3 % 100 >= ``rate`` leaves the text plain; h4 % 100 < ``spm`` puts the suffix first.

Defined results: a null text counts as empty. An empty text, and one that holds a sentinel of its own, stays plain; plain rows
have no prefix and no middle (null). A null id hashes as an empty one. Equal rows fare alike. Columns of ``keep`` that are
named like a new one, in any case, are left out. A text is held in memory as a whole.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakewarden.llm.common import by_bytes, kept_columns, lean
from lakewarden.llm.wordhash import raw

#: Marks of the three parts: fixed values of the training format.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: Offsets of one container, and bytes of its bitmap.
SPAN = 1 << 16
BITMAP = SPAN // 8
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


class ArrayContainer:
    """Few members: their places in order."""

    def __init__(self, places: np.ndarray):
        self.places = places.astype(np.uint16)

    def select(self, k: int) -> int:
        return int(self.places[k])


class BitmapContainer:
    """Many scattered members: a bit for each place, and the number of members before each word of 64 bits."""

    def __init__(self, inside: np.ndarray):
        bits = np.zeros(SPAN, bool)
        bits[: len(inside)] = inside
        self.words = np.packbits(bits, bitorder="little").view("<u8")
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])

    def select(self, k: int) -> int:
        word = int(np.searchsorted(self.before, k, side="right")) - 1
        left, bits = k - int(self.before[word]), int(self.words[word])
        for _ in range(left):  # the lowest members of the word go
            bits &= bits - 1
        return 64 * word + (bits & -bits).bit_length() - 1


class RunContainer:
    """Stretches of members: where each starts, and the number of members before it."""

    def __init__(self, starts: np.ndarray, lengths: np.ndarray):
        self.starts = starts.tolist()
        self.before = np.concatenate([[0], np.cumsum(lengths)]).tolist()

    def select(self, k: int) -> int:
        run = bisect_right(self.before, k) - 1
        return self.starts[run] + k - self.before[run]


def container(inside: np.ndarray, members: int) -> ArrayContainer | BitmapContainer | RunContainer:
    """The smallest container for the set places of ``inside``, which are ``members`` many."""
    if members == len(inside):
        return RunContainer(np.zeros(1, np.int64), np.array([members]))
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    edges = np.concatenate([np.zeros(int(inside[0]), np.int64), edges, np.full(int(inside[-1]), len(inside))])
    starts, ends = edges[::2], edges[1::2]
    if 2 + 4 * len(starts) < min(2 * members, BITMAP):
        return RunContainer(starts, ends - starts)
    return ArrayContainer(np.flatnonzero(inside)) if 2 * members < BITMAP else BitmapContainer(inside)


class Boundaries:
    """The places where a text may be cut, from one flag for each byte offset, its end included."""

    def __init__(self, inside: np.ndarray):
        self.keys: list[int] = []
        self.containers: list[ArrayContainer | BitmapContainer | RunContainer] = []
        self.before = [0]
        for key, at in enumerate(range(0, len(inside), SPAN)):
            part = inside[at : at + SPAN]
            members = int(np.count_nonzero(part))
            if members:
                self.keys.append(key)
                self.containers.append(container(part, members))
                self.before.append(self.before[-1] + members)

    def __len__(self) -> int:
        return self.before[-1]

    def select(self, k: int) -> int:
        """The member of rank ``k``, counted from 0."""
        i = bisect_right(self.before, k) - 1
        return SPAN * self.keys[i] + self.containers[i].select(k - self.before[i])


def code_points(data: np.ndarray) -> np.ndarray:
    """Flags at the first byte of each code point."""
    return (data & 0xC0) != 0x80


def word_starts(data: np.ndarray) -> np.ndarray:
    """Flags where a word follows white space; the space belongs to the unit before it."""
    inside = ~_SPACE[data]
    out = inside.copy()
    out[1:] &= ~inside[:-1]
    return out


def line_starts(data: np.ndarray) -> np.ndarray:
    """Flags after each line feed."""
    out = np.zeros(len(data), bool)
    out[1:] = data[:-1] == 10
    return out


UNITS = {"char": code_points, "word": word_starts, "line": line_starts}


def arrange(text: bytes, one: int, two: int, suffix_first: bool) -> bytes:
    """The three parts of a text that is cut before the bytes ``one`` and ``two``, with their marks."""
    prefix, middle, suffix = text[:one], text[one:two], text[two:]
    if suffix_first:
        return b"".join((SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle))
    return b"".join((PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle))


def restore(output: bytes, form: str) -> bytes:
    """The text from what ``arrange`` made of it."""
    if form == "plain":
        return output
    first, second = (SUFFIX, PREFIX) if form == "spm" else (PREFIX, SUFFIX)
    one, rest = output.removeprefix(first).split(second, 1)
    two, middle = rest.split(MIDDLE, 1)
    return two + middle + one if form == "spm" else one + middle + two


def transform(
    docs: DataFrame, keep: list[str], by: str = "doc_id", text: str = "text", unit: str = "char", rate: int = 90, spm: int = 20,
    seed: str = "1", outputs: bool = True,
) -> DataFrame:
    """The columns ``keep`` with ``n`` (units), ``form`` (plain, psm or spm), ``prefix_units``, ``middle_units``, ``output``
    (null without ``outputs``), and the digests ``output_sha256`` and ``restored_sha256``, the latter of the text rebuilt from
    the output. One pass over the rows, without a shuffle."""
    new = ["n", "form", "prefix_units", "middle_units", "output", "output_sha256", "restored_sha256"]
    names, kept, fields = kept_columns(docs, keep, new)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(docs[by].cast("string"), F.lit(""))), 256)
    numbers = [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long").alias(f"__h{i + 1}") for i in range(4)]
    rows = docs.select(*kept, docs[text].alias("__text"), *numbers)
    kinds = [T.LongType(), T.StringType(), T.LongType(), T.LongType(), T.StringType(), T.StringType(), T.StringType()]
    schema = T.StructType(fields + [T.StructField(c, k) for c, k in zip(new, kinds, strict=True)])
    starts, plain_from = UNITS[unit], rate

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "__text"):
            data, bounds = raw(batch.column("__text"))
            whole = data.tobytes()
            flags = starts(data)
            draws = zip(*(batch.column(f"__h{i}").to_pylist() for i in (1, 2, 3, 4)), strict=True)
            out: list[tuple] = []
            for a, b, (h1, h2, h3, h4) in zip(bounds[:-1].tolist(), bounds[1:].tolist(), draws, strict=True):
                own = whole[a:b]
                inside = np.ones(b - a + 1, bool)
                inside[1 : b - a] = flags[a + 1 : b]  # the start and the end always count
                n = len(places := Boundaries(inside)) - 1
                form, left, among, output = "plain", None, None, own
                if n and h3 % 100 < plain_from and not (PREFIX in own or SUFFIX in own or MIDDLE in own):
                    left, right = sorted((h1 % (n + 1), h2 % (n + 1)))
                    form, among = "spm" if h4 % 100 < spm else "psm", right - left
                    output = arrange(own, places.select(left), places.select(right), form == "spm")
                back = hashlib.sha256(restore(output, form)).hexdigest()
                out.append((n, form, left, among, output if outputs else None, hashlib.sha256(output).hexdigest(), back))
            columns = list(zip(*out, strict=True)) if out else [()] * len(new)
            types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.string(), pa.string()]
            made = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
            made[4] = made[4].cast(pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(f"__{i}") for i in range(len(names))), *made], [*names, *new])

    return rows.mapInArrow(lean(run), schema)
