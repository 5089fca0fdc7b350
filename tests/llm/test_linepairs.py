import random

import numpy as np
import pyarrow as pa
import pytest

from lakewarden.llm import linepairs, lines


def plain(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(row[-1] + 1, old[j] + 1, old[j - 1] + (x != y)))
    return row[-1]


def changed(rng, a, edits, letters):
    b = bytearray(a)
    for _ in range(edits):
        kind, at = rng.randrange(3), rng.randrange(len(b) + 1)
        b[at : at + (kind > 0)] = b"" if kind == 2 else bytes([rng.choice(letters)])
    return bytes(b) or b"a"


def stretches(texts):
    length = np.array([len(t) for t in texts])
    return np.frombuffer(b"".join(texts), np.uint8), np.cumsum(length) - length, length


@pytest.mark.parametrize("similarity", [0.9, 0.7])
def test_distances_of_many_pairs_equal_the_plain_program(similarity, monkeypatch):
    """Near and far pairs of all lengths, also those with more edits than the band that is tried first, or than a byte counts."""
    monkeypatch.setattr(linepairs, "MOST", 40)
    rng = random.Random(2)
    texts, want = [], []
    for i in range(900):
        n = rng.choice([1, 2, 9, 10, 11, 40, 90, 150, 200])
        a = bytes(rng.choice(b"abcd ") for _ in range(n))
        b = changed(rng, a, rng.randint(0, max(1, int(1.5 * (1 - similarity) * n))), b"abcd ") if i % 9 else b"".join([a[n // 5 :], a[: n // 5]])
        texts += [a, b]
        want.append(plain(a, b) <= lines.edits(max(len(a), len(b)), similarity))
    data, begin, length = stretches(texts)
    x = np.arange(0, len(texts), 2)
    most = linepairs.most_edits(np.maximum(length[x], length[x + 1]), similarity)
    got = linepairs.within(data, begin, length, x, x + 1, most, lines.distance)
    assert got.tolist() == want and any(want) and not all(want)


def test_each_pair_of_a_large_group_meets_once(monkeypatch):
    """A group of more nodes than a cell takes is dealt so that every two meet in one cell; keys with the same nodes are one group."""
    monkeypatch.setattr(linepairs, "LARGE", 10)
    sets = {1: range(100, 104), 5: range(100, 104), 9: range(200, 237), 12: [7], 13: [8, 8]}
    keys = np.array([k << 40 | k for k, nodes in sets.items() for _ in nodes], np.int64)
    nodes = np.array([n for own in sets.values() for n in own], np.int64)
    parcels = linepairs.Parcels(linepairs.KEYS)
    sent = [*parcels.add(*linepairs.key_records(keys, nodes)), *parcels.rest()]
    met, largest = [], 0
    members = [r for b in linepairs._groups(iter(sent)) for d in b.column("data").to_pylist() for r in np.frombuffer(d, linepairs.MEMBER).tolist()]
    cells = {}
    for group, cell, node in set(members):  # those of equal groups are dropped where they meet their facts
        cells.setdefault((group, cell >> 2), []).append((node, cell & 3))
    for rows in cells.values():
        largest = max(largest, len(rows))
        met += [(a, b) for a, s in rows for b, t in rows if a < b and (s == 2 or s != t)]
    want = [(a, b) for own in (range(100, 104), range(200, 237)) for a in own for b in own if a < b]
    assert sorted(met) == want and largest < 30


def test_a_group_of_near_copies_takes_few_comparisons():
    """400 near copies of one line make 79 800 pairs, of which about one for each line is compared; another line stays alone."""
    rng = random.Random(6)
    base = bytes(rng.choice(b"abcdefgh ") for _ in range(200))
    texts = [changed(rng, base, 2, b"abcdefgh ") for _ in range(400)] + [bytes(rng.choice(b"abcdefgh ") for _ in range(200))]
    data, begin, length = stretches(texts)
    x, y = np.triu_indices(len(texts), 1)
    compared = []

    def compare(a, b):
        compared.append(len(a))
        return linepairs.within(data, begin, length, a, b, linepairs.most_edits(np.maximum(length[a], length[b]), 0.9), lines.distance)

    a, b = linepairs.linked(len(texts), x, y, rng.choices(range(9), k=len(x)), compare)
    assert set(a.tolist()) | set(b.tolist()) == set(range(400))
    assert sum(compared) < 8 * len(texts)


def test_rows_of_cells_are_cut_between_cells(monkeypatch):
    monkeypatch.setattr(linepairs, "HELD", 5)
    group = np.repeat([1, 1, 2, 3, 9], [2, 3, 1, 7, 2])
    place = np.repeat([0, 4, 0, 0, 1], [2, 3, 1, 7, 2])
    table = pa.table({"grp": group, "place": place})
    got = [t.to_pydict() for t in linepairs._cells(iter(table.to_batches(3)))]
    assert sum((t["grp"] for t in got), []) == group.tolist() and len(got) > 1
    ends = [(t["grp"][-1], t["place"][-1]) for t in got]
    assert all(end != (t["grp"][0], t["place"][0]) for end, t in zip(ends, got[1:], strict=False))
