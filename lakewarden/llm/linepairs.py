"""Near lines among those that share a key.

The rows of a key meet in one task, which tells the groups of nodes that several of them are. Keys with the same nodes make the same pairs and
are one group, known by a hash of its nodes. A group of more than ``LARGE`` nodes is dealt to cells, one for each two parts of
it, so no task holds all of its pairs. Pairs are made in arrays of a task and never become rows; what is shuffled are the records of groups, and
their texts only for nodes that have a pair left after sketches are compared.

Keys, facts and groups are many and small, so they travel in parcels: the records of one bucket of a hash that a task has made, as bytes.
Equal hashes of keys or groups that are not equal only make more pairs to compare.

A pair that shares several groups is compared in the first of them. Within a task every line is compared with its nearest ones
first, and lines that are known to be connected are not compared any more, so a group of many near copies costs about
one comparison a line. What is left is compared whole: no link between two components is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakewarden.llm.common import lean
from lakewarden.llm.wordhash import mix

#: Nodes of a group that meet in one cell, at most.
LARGE = 2000
#: Groups of a node, the least ones, by which a pair that shares several is told to be compared elsewhere.
SEEN = 6
#: Pairs whose sketches are compared at once, and rows of whole cells that are held at once.
AT_ONCE, HELD = 500_000, 4096
#: Times that each line is compared with its nearest ones before all pairs that are left are.
ROUNDS = 6
#: Bytes of a matrix of texts, and of the part of a table of distances that is kept; diagonals on each side that are tried first.
MATRIX, BAND, NARROW = 250_000, 64_000, 10
#: The most edits that a table of distances counts in single bytes.
MOST = 250
#: Buckets of parcels, and records that a task gathers before it sends them.
BUCKETS, GATHERED = 4096, 500_000
_BEFORE, _AFTER, _SAME = 1, 2, 3  # bytes that stand in no line
_P = ["p0", "p1", "p2", "p3"]
#: Records: a key, the rest of its hash beside its bucket; the facts of a node; a node of a cell; and one with its facts. ``cell`` holds the number of the
#: cell and, in its last two bits, the side: 2 for rows that pair with all others of the cell, 0 and 1 for those that pair with the other side.
KEY = np.dtype([("key", "<u4"), ("node", "<i8")])
FACT = np.dtype([("node", "<i8"), ("n", "<u4"), ("w", "u1"), ("s", "<i8"), *[(p, "<i8") for p in _P]])
MEMBER = np.dtype([("grp", "<i8"), ("cell", "<u4"), ("node", "<i8")])
HELD_FACT = np.dtype([("grp", "<i8"), ("cell", "<u4"), *FACT.descr])
PARCEL = "kind int, bucket int, data binary"
KEYS, FACTS, MEMBERS = 1, 2, 3
_ROW = {"grp": "long", "cell": "int", "node": "long", "n": "int", "w": "int", "s": "long", **dict.fromkeys(_P, "long")}


class Parcels:
    """Records that a task gathers and sends by bucket."""

    def __init__(self, kind: int):
        self.kind, self.parts, self.rows = kind, [], 0

    def add(self, bucket: np.ndarray, records: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.parts.append((bucket.astype(np.int32), records))
        self.rows += len(records)
        if self.rows >= GATHERED:
            yield from self.rest()

    def rest(self) -> Iterator[pa.RecordBatch]:
        if not self.rows:
            return
        bucket, records = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        self.parts, self.rows = [], 0
        order = np.argsort(bucket, kind="stable")
        bucket = bucket[order]
        start = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
        ends = np.concatenate([start, [len(bucket)]]) * records.dtype.itemsize
        data = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(records[order])])
        kind = pa.array(np.full(len(start), self.kind, np.int32))
        yield pa.RecordBatch.from_arrays([kind, pa.array(bucket[start]), data], ["kind", "bucket", "data"])


def bucket_of(hashes: np.ndarray) -> np.ndarray:
    return (hashes.view(np.uint64) >> np.uint64(40)) % np.uint64(BUCKETS)


def key_records(keys: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bucket and the record of each key."""
    out = np.empty(len(keys), KEY)
    out["key"], out["node"] = keys.view(np.uint64).astype(np.uint32), nodes
    return bucket_of(keys), out


def fact_records(nodes: np.ndarray, length: np.ndarray, words: np.ndarray, marks: np.ndarray, sketches: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bucket and the record of each node; words are counted as far as they matter."""
    out = np.empty(len(nodes), FACT)
    out["node"], out["n"], out["w"], out["s"] = nodes, length, np.minimum(words, 255), marks
    for i, name in enumerate(_P):
        out[name] = sketches[:, i]
    return bucket_of(nodes), out


def _opened(batches: Iterator[pa.RecordBatch], kinds: dict[int, np.dtype]) -> Iterator[list[np.ndarray]]:
    """The records of each bucket by kind; parcels come in the order of their buckets."""
    now, held = None, {k: [] for k in kinds}

    def joined() -> list[np.ndarray]:
        return [np.frombuffer(b"".join(held[k]), kinds[k]) for k in kinds]

    for batch in batches:
        for kind, bucket, data in zip(*(batch.column(c).to_pylist() for c in ("kind", "bucket", "data")), strict=True):
            if bucket != now:
                if now is not None:
                    yield joined()
                now, held = bucket, {k: [] for k in kinds}
            held[kind].append(data)
    if now is not None:
        yield joined()


def _dealt(parcels: DataFrame) -> DataFrame:
    return parcels.repartition("bucket").sortWithinPartitions("bucket")


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The members of the groups of a task: keys that several nodes have."""
    out = Parcels(MEMBERS)
    for (records,) in _opened(batches, {KEYS: KEY}):
        key, node = records["key"], records["node"]
        order = np.lexsort((node, key))
        key, node = key[order], node[order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1])
        key, node = key[new], node[new]
        start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(np.concatenate([start, [len(key)]]))
        node, size = node[np.repeat(size > 1, size)], size[size > 1]
        if not len(size):
            continue
        sums = np.add.reduceat(mix(node.view(np.uint64)), np.cumsum(size) - size)
        group = mix(sums ^ mix(size.astype(np.uint64))).view(np.int64)
        once = np.zeros(len(size), bool)
        once[np.unique(group, return_index=True)[1]] = True
        node, group, size = node[np.repeat(once, size)], group[once], size[once]
        large = np.repeat(size > LARGE, size)
        yield from _members(out, np.repeat(group, size)[~large], np.uint32(2), node[~large])
        end = np.cumsum(size)
        for i in np.flatnonzero(size > LARGE):
            own = node[end[i] - size[i] : end[i]]
            parts = -(-2 * len(own) // LARGE)
            part = (mix(own.view(np.uint64) ^ group[i : i + 1].view(np.uint64)) % np.uint64(parts)).astype(np.uint32)
            for other in range(parts):
                cell = np.minimum(part, other) * parts + np.maximum(part, other)
                side = np.where(part == other, 2, part > other)
                yield from _members(out, np.full(len(own), group[i]), (cell * 4 + side).astype(np.uint32), own)
    yield from out.rest()


def _members(out: Parcels, group: np.ndarray, cell: np.ndarray, node: np.ndarray) -> Iterator[pa.RecordBatch]:
    records = np.empty(len(node), MEMBER)
    records["grp"], records["cell"], records["node"] = group, cell, node
    return out.add(bucket_of(node), records)


def groups(keys: DataFrame) -> DataFrame:
    """Parcels of the members of groups, by node, from parcels of keys."""
    return _dealt(keys).mapInArrow(lean(_groups), PARCEL)


def _with_facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out = Parcels(MEMBERS)
    for facts, members in _opened(batches, {FACTS: FACT, MEMBERS: MEMBER}):
        if not len(members):
            continue
        node, first = np.unique(facts["node"], return_index=True)
        members = members[np.lexsort((members["cell"], members["grp"], members["node"]))]
        members = members[np.concatenate([[True], members[1:] != members[:-1]])]
        records = np.empty(len(members), HELD_FACT)
        own = facts[first[np.searchsorted(node, members["node"])]]
        for name in FACT.names:
            records[name] = own[name]
        records["grp"], records["cell"] = members["grp"], members["cell"]
        yield from out.add(bucket_of(mix(members["grp"].view(np.uint64) ^ mix((members["cell"] >> 2).astype(np.uint64)))), records)
    yield from out.rest()


def candidates(members: DataFrame, facts: DataFrame, **near) -> DataFrame:
    """Of the members of groups those whose node can be near to another one in its cell, with the facts of the node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (records,) in _opened(batches, {MEMBERS: HELD_FACT}):
            records = records[np.lexsort((records["n"], records["cell"] >> 2, records["grp"]))]
            edge = np.flatnonzero((records["grp"][1:] != records["grp"][:-1]) | (records["cell"][1:] >> 2 != records["cell"][:-1] >> 2)) + 1
            at = 0
            while at < len(records):  # some whole cells
                stop = edge[np.searchsorted(edge, at + HELD) :][:1]
                stop = int(stop[0]) if len(stop) else len(records)
                own = records[at:stop]
                x, y, _ = near_pairs({name: np.ascontiguousarray(own[name]) for name in HELD_FACT.names}, **near)
                at = stop
                if len(x):
                    own = own[np.union1d(x, y)]
                    yield pa.RecordBatch.from_arrays([pa.array(own[c].astype(f"i{8 if k == 'long' else 4}")) for c, k in _ROW.items()], list(_ROW))

    rows = _dealt(_dealt(members.union(facts)).mapInArrow(lean(_with_facts), PARCEL))
    return rows.mapInArrow(lean(run), ", ".join(f"{c} {k}" for c, k in _ROW.items()))


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole cells, whose rows come one after the other."""
    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows < HELD:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        group, place = (table.column(c).to_numpy() for c in ("grp", "place"))
        edge = np.flatnonzero((group[1:] != group[:-1]) | (place[1:] != place[:-1]))
        if len(edge):
            yield table.slice(0, int(edge[-1]) + 1)
            table = table.slice(int(edge[-1]) + 1)
        held, rows = table.to_batches(), table.num_rows
    if rows:
        yield pa.Table.from_batches(held).combine_chunks()


def most_edits(length: np.ndarray, similarity: float) -> np.ndarray:
    return np.floor((1 - similarity) * length + 1e-9).astype(np.int64)


def near_pairs(rows: dict, similarity: float, reach: list[tuple[int, int]], worded: int, per_edit: int) -> tuple:
    """The two rows of each pair of a cell that can be near, and the distance of their sketches; with the ``least`` groups of each row, only
    pairs that are compared in this cell.

    Lines can be near by their lengths, those with ``worded`` words by their SimHashes, and all by the sketches of their byte pairs.
    """
    order = np.lexsort((rows["n"], rows["cell"] >> 2, rows["grp"]))
    group, cell, n, w, s, *p = (rows[c][order] for c in ["grp", "cell", "n", "w", "s", *_P])
    cell, side = cell >> 2, cell & 3
    least = np.ascontiguousarray(rows["least"][order].T) if "least" in rows else ()
    s, *p = (x.view(np.uint64) for x in (s, *p))
    n = n.astype(np.int64)
    own = np.concatenate([[0], np.cumsum((group[1:] != group[:-1]) | (cell[1:] != cell[:-1]))])
    # of a line the partners that are not shorter lie behind it
    far = int(n.max()) + 1
    last = np.searchsorted(own * far + n - most_edits(n, similarity), own * far + n, side="right")
    number = last - np.arange(len(n)) - 1
    total = np.concatenate([[0], np.cumsum(number)])
    found = []
    at = 0
    while at < len(n):
        stop = max(at + 1, int(np.searchsorted(total, total[at] + AT_ONCE, side="right")) - 1)
        x = np.repeat(np.arange(at, stop), number[at:stop])
        y = x + 1 + np.arange(len(x)) - np.repeat(total[at:stop] - total[at], number[at:stop])
        at = stop
        ok = (side[x] != side[y]) | (side[x] == 2)
        bits = np.bitwise_count(s[x] ^ s[y])
        limit = np.full(len(x), 64)
        for length, most in reach:
            limit[n[y] >= length] = most
        ok &= (np.minimum(w[x], w[y]) < worded) | (bits <= limit)
        x, y = x[ok], y[ok]
        differ = np.zeros(len(x), np.int64)
        for lane in p:
            differ += np.bitwise_count(lane[x] ^ lane[y])
        ok = differ <= per_edit * most_edits(n[y], similarity)
        x, y, differ = x[ok], y[ok], differ[ok]
        elsewhere = np.zeros(len(x), bool)
        for one in least:
            earlier = np.where(one[x] < group[x], one[x], np.int64(-1))
            for other in least:
                elsewhere |= (earlier == other[y]) & (other[y] < group[x])
        found.append((order[x[~elsewhere]], order[y[~elsewhere]], differ[~elsewhere]))
    return tuple(np.concatenate(parts) for parts in zip(*found, strict=True))


def _matrix(data: np.ndarray, begin: np.ndarray, length: np.ndarray, width: int, step: int, after: int) -> np.ndarray:
    """The bytes of some stretches from ``begin`` on, forwards or backwards, one row each."""
    place = np.arange(width)
    at = np.clip(begin[:, None] + step * place, 0, len(data) - 1)
    return np.where(place < length[:, None], data[at], np.uint8(after))


def within(data: np.ndarray, begin: np.ndarray, length: np.ndarray, x: np.ndarray, y: np.ndarray, most: np.ndarray, slow) -> np.ndarray:
    """Whether the edit distance of the stretches ``x`` and ``y`` of each pair is at most ``most``.

    Common ends are taken off. If what is left is longer than that, a band of the table of distances is made for many pairs at once; ``slow``
    is asked where a byte doesn't hold the number of edits.
    """
    out = np.zeros(len(x), bool)
    swap = length[x] < length[y]
    x, y = np.where(swap, y, x), np.where(swap, x, y)
    todo = np.flatnonzero(length[x] - length[y] <= most)
    for i in todo[most[todo] > MOST]:
        one, other = (data[begin[k] : begin[k] + length[k]].tobytes() for k in (x[i], y[i]))
        out[i] = slow(one, other, int(most[i])) is not None
    todo = todo[most[todo] <= MOST]
    todo = todo[np.argsort(length[x[todo]], kind="stable")]
    left = []
    at = 0
    while at < len(todo):
        stop = min(len(todo), at + max(1, MATRIX // int(length[x[todo[at]]] + 1)))
        stop = max(at + 1, min(stop, at + max(1, MATRIX // int(length[x[todo[stop - 1]]] + 1))))
        own = todo[at:stop]
        at = stop
        a, b, n, m = begin[x[own]], begin[y[own]], length[x[own]], length[y[own]]
        width = int(n.max()) + 1
        head = (_matrix(data, a, n, width, 1, _BEFORE) != _matrix(data, b, m, width, 1, _AFTER)).argmax(1)
        ends = _matrix(data, a + n - 1, n, width, -1, _BEFORE) != _matrix(data, b + m - 1, m, width, -1, _AFTER)
        tail = np.minimum(ends.argmax(1), m - head)
        n, m = n - head - tail, m - head - tail
        out[own] = n <= most[own]  # no more edits than bytes
        rest = (n > most[own]) & (m > 0)
        left.append(np.stack([own, a + head, n, b + head, m])[:, rest])
    if not left:
        return out
    own, a, n, b, m = np.concatenate(left, axis=1)
    order = np.argsort(n, kind="stable")
    own, a, n, b, m = (v[order] for v in (own, a, n, b, m))
    # most near lines are found near the diagonal; what is not within a few of its neighbours is looked for in all that count
    for narrow in (True, False):
        rest = np.flatnonzero(~out[own] & ((n - m <= NARROW) & (most[own] > 2 * NARROW) | (not narrow)))
        at = 0
        while at < len(rest):
            stop = at + 1
            for _ in range(2):  # as many as fit with the edits of the last one
                k = NARROW if narrow else int(most[own[rest[at:stop]]].max())
                stop = min(len(rest), at + max(1, BAND // (k + 1)))
            part = rest[at:stop]
            k = NARROW if narrow else max(1, int(most[own[part]].max()))
            out[own[part]] = _banded(data, a[part], n[part], b[part], m[part], most[own[part]], k)
            at = stop
    return out


def _banded(data: np.ndarray, a: np.ndarray, n: np.ndarray, b: np.ndarray, m: np.ndarray, most: np.ndarray, k: int) -> np.ndarray:
    """Whether ``most`` edits or fewer turn stretches into each other by a way that leaves no more than ``k`` bytes of one behind the other: the edit
    distance, if ``k`` is not below ``most``. ``n`` is not below ``m`` and at most ``k`` above.

    Cell (i, j) of the table holds the distance of the first i and j bytes. Of all pairs the diagonals i - j from -k to k are kept for two
    values of i + j, one in ``even`` and one in ``odd``, which has a border at both ends. Shorter pairs get equal bytes at their ends, which changes
    no distance, so all tables end in the row of the longest.
    """
    width = int(n.max())
    place = np.arange(-k - 1, width + k + 2)[:, None]
    filled = np.where((place >= 0) & (place < width), np.uint8(_SAME), np.uint8(_BEFORE))
    one = np.where((place >= 0) & (place < n), data[np.clip(a + place, 0, len(data) - 1)], filled)
    place = np.arange(width + k, -k - 3, -1)[:, None]
    filled = np.where((place >= 0) & (place < m + (width - n)), np.uint8(_SAME), np.uint8(_AFTER))
    other = np.where((place >= 0) & (place < m), data[np.clip(b + place, 0, len(data) - 1)], filled)
    over, shift, pairs = np.uint8(int(most.max()) + 1), n - m, np.arange(len(n))
    even, odd = np.full((k + 1, len(n)), over), np.full((k + 2, len(n)), over)
    if k % 2:
        odd[1 + k // 2] = 0
    else:
        even[k // 2] = 0
    out = np.zeros(len(n), bool)
    for t in range(1, 2 * width + 1):
        if (t - k) % 2 == 0:
            i, j = k + (t - k) // 2, k + 1 + width - (t + k) // 2
            new = even + (one[i : i + k + 1] != other[j : j + k + 1])
            step = np.minimum(odd[:-1], odd[1:])
        else:
            i, j = k + (t - k + 1) // 2, k + 1 + width - (t + k - 1) // 2
            new = odd[1:-1] + (one[i : i + k] != other[j : j + k])
            step = np.minimum(even[:-1], even[1:])
        step += np.uint8(1)
        np.minimum(new, step, out=new)
        np.minimum(new, over, out=new)
        if len(new) > k:
            even = new
        else:
            odd[1:-1] = new
        if t >= 2 * width - k:
            ended = np.flatnonzero(shift == 2 * width - t)
            out[pairs[ended]] = new[(shift[ended] + k) // 2, ended] <= most[ended]
        elif t % 32 == 0:
            open_ = np.minimum(even.min(0), odd.min(0)) <= most
            if 4 * int(open_.sum()) < 3 * len(open_):
                one, other, even, odd = (np.ascontiguousarray(v[:, open_]) for v in (one, other, even, odd))
                shift, pairs, most = shift[open_], pairs[open_], most[open_]
                if not len(pairs):
                    break
    return out


def linked(rows: int, x: np.ndarray, y: np.ndarray, far: np.ndarray, compare) -> tuple[np.ndarray, np.ndarray]:
    """Pairs for which ``compare`` holds, as many as it takes to connect all that such pairs connect; pairs of a small ``far`` come first."""
    order = np.argsort(far, kind="stable")
    x, y = x[order], y[order]
    parent = list(range(rows))

    def find(v: int) -> int:
        while parent[v] != v:
            parent[v] = parent[parent[v]]
            v = parent[v]
        return v

    links = []
    for turn in range(ROUNDS + 1):
        if not len(x):
            break
        chosen = np.arange(len(x))
        if turn < ROUNDS:
            chosen = np.union1d(*(np.unique(v, return_index=True)[1] for v in (x, y)))
        good = chosen[compare(x[chosen], y[chosen])]
        for v, w in zip(x[good].tolist(), y[good].tolist(), strict=True):
            v, w = find(v), find(w)
            if v != w:
                parent[max(v, w)] = min(v, w)
        links.append((x[good], y[good]))
        left = np.ones(len(x), bool)
        left[chosen] = False
        label = np.array([find(v) for v in range(rows)])
        left &= label[x] != label[y]
        x, y = x[left], y[left]
    if not links:
        return x, y
    return tuple(np.concatenate(v) for v in zip(*links, strict=True))


def links(rows: DataFrame, texts: DataFrame, slow, **near) -> DataFrame:
    """``a`` and ``b`` of near lines that connect all that near lines of the ``candidates`` connect; ``texts`` has the ``words`` of nodes."""
    least = rows.groupBy("node").agg(F.slice(F.array_sort(F.collect_set("grp")), 1, SEEN).alias("least"))
    whole = rows.join(least.join(texts.hint("merge"), "node").hint("merge"), "node").withColumn("place", F.shiftright("cell", 2))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _cells(batches):
            facts = {c: table.column(c).to_numpy() for c in _ROW}
            lists = table.column("least").combine_chunks()
            count = lists.value_lengths().to_numpy()
            row = np.repeat(np.arange(len(count)), count)
            facts["least"] = np.full((len(count), SEEN), np.iinfo(np.int64).max)
            facts["least"][row, np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)] = lists.flatten().to_numpy()
            x, y, far = near_pairs(facts, **near)
            words = table.column("words").combine_chunks().cast(pa.large_binary())
            _, offsets, data = words.buffers()
            bounds = np.frombuffer(offsets, np.int64)[words.offset : words.offset + len(words) + 1]
            data = np.frombuffer(data, np.uint8)
            begin, length, node = bounds[:-1], np.diff(bounds), facts["node"]

            def compare(one: np.ndarray, other: np.ndarray) -> np.ndarray:
                most = most_edits(np.maximum(length[one], length[other]), near["similarity"])  # noqa: B023
                return within(data, begin, length, one, other, most, slow)  # noqa: B023

            a, b = linked(len(node), x, y, far, compare)
            yield pa.RecordBatch.from_arrays([pa.array(node[a]), pa.array(node[b])], ["a", "b"])

    # rows of cells lie in order, so that a task holds a few cells only
    return whole.repartition("grp", "place").sortWithinPartitions("grp", "place").mapInArrow(lean(run), "a long, b long")
