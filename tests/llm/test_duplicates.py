"""Substring, line, n-gram and embedding duplicates against brute force."""

import hashlib
import math
import random
import re

import numpy as np
import pytest

from llm_texts import prose
from lakewarden.llm import components as components_module
from lakewarden.llm import embeddings, jaccard, lines, substring
from lakewarden.llm.common import Scratch
from lakewarden.llm.components import components


def roots(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("block", [components_module.BLOCK, 7])
def test_components_of_paths_and_stars(spark, monkeypatch, block):
    monkeypatch.setattr(components_module, "BLOCK", block)
    links = [(i, i + 1) for i in range(100, 140)] + [(7, i) for i in range(8, 30)] + [(3, 3), (50, 40), (40, 50)]
    df = spark.createDataFrame(links, "a long, b long")
    got = {r.node: r.root for r in components(df, Scratch(spark, "t")).collect()}
    want = roots({x for p in links for x in p}, links)
    assert got == {n: r for n, r in want.items() if n != 3}
    assert components(df.limit(0), Scratch(spark, "t")).collect() == []


# substring


def windows_removed(rows, size):
    first = {}
    for i, text in rows:
        w = (text or "").encode().split()
        for k in range(len(w) - size + 1):
            key = tuple(w[k : k + size])
            if i is not None:
                first[key] = min(first.get(key, i), i)
    out = []
    for i, text in rows:
        w = (text or "").encode().split()
        keep = [True] * len(w)
        for k in range(len(w) - size + 1):
            if i is not None and first[tuple(w[k : k + size])] < i:
                keep[k : k + size] = [False] * size
        kept = b" ".join(x for x, y in zip(w, keep, strict=True) if y)
        out.append((i, len(w), len(w) - sum(keep), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def passages(seed=0, n=60):
    """Documents that share passages whole, in part, with changed words and at their ends."""
    rng = random.Random(seed)
    shared = [prose(900 + i, rng.randint(45, 160)).split() for i in range(6)]
    rows = []
    for i in range(n):
        words = prose(i, rng.randint(0, 60)).split()
        for _ in range(rng.randint(0, 3)):
            part = list(rng.choice(shared))
            cut = rng.randint(0, max(0, len(part) - 40))
            part = part[cut : cut + rng.randint(30, 160)]
            if rng.random() < 0.4 and part:
                part[rng.randrange(len(part))] = "changed"
            words += part + prose(1000 + i, rng.randint(0, 5)).split()
        rows.append((rng.randint(0, 40) * 3 + i, " ".join(words)))
    return rows


@pytest.mark.parametrize("hot", [0, 3, 1000])
def test_substrings_equal_brute_force(make, hot):
    rows = passages() + [(500, "la " * 120), (501, "la " * 70), (502, ""), (503, None)]
    got = substring.deduplicate(make(rows), hot=hot).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got), key=str) == windows_removed(rows, 50)
    assert all(hashlib.sha256(r.kept.encode()).hexdigest() == r.kept_sha256 for r in got)


def test_substrings_of_odd_documents(make, odd):
    rows = [r[:2] for r in odd]
    got = substring.deduplicate(make(odd), texts=False).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got), key=str) == windows_removed(rows, 50)
    assert substring.deduplicate(make([])).collect() == []


def test_automaton_gives_the_longest_match():
    rng = random.Random(1)
    for _ in range(50):
        known = [[rng.choice("abc") for _ in range(rng.randint(0, 12))] for _ in range(3)]
        asked = [rng.choice("abcd") for _ in range(15)]
        automaton = substring.Automaton()
        for k in known:
            automaton.add(k)
        text = ["|".join(k) for k in known]
        for end, length in enumerate(automaton.statistics(asked)):
            fits = [n for n in range(end + 2) if n == 0 or any(_within(asked[end - n + 1 : end + 1], k) for k in known)]
            assert length == max(fits), (text, asked, end)


def _within(part, whole):
    return any(whole[i : i + len(part)] == part for i in range(len(whole) - len(part) + 1))


# lines


def slow_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(row[-1] + 1, old[j] + 1, old[j - 1] + (x != y)))
    return row[-1]


def test_distance_equals_the_plain_program():
    rng = random.Random(3)
    for _ in range(400):
        a = bytes(rng.choice(b"abc") for _ in range(rng.randint(0, 25)))
        b = bytearray(a)
        for _ in range(rng.randint(0, 6)):
            if b and rng.random() < 0.5:
                del b[rng.randrange(len(b))]
            else:
                b.insert(rng.randint(0, len(b)), rng.choice(b"abc"))
        if rng.random() < 0.3:
            a, b = a * 5 + b"x" * 70 + a, bytes(b) * 5 + b"x" * 70 + bytes(b)
        want, most = slow_distance(a, bytes(b)), rng.randint(0, 6)
        assert lines.distance(a, bytes(b), most) == (want if want <= most else None)


def lines_removed(rows, similarity=0.9, least=5):
    """The places that go and the links, by the edit distance of all pairs of lines."""
    place, nodes = {}, set()
    for i, text in rows:
        for k, line in enumerate((text or "").encode().split(b"\n")):
            norm = lines.normalised(line)
            if i is not None and len(norm.split()) >= least:
                nodes.add(norm)
                place.setdefault(norm, []).append((i, k))
    names = sorted(nodes)
    links = []
    for x, a in enumerate(names):
        for b in names[:x]:
            most = int((1 - similarity) * max(len(a), len(b)) + 1e-9)
            if abs(len(a) - len(b)) <= most and lines.distance(a, b, most) is not None:
                links.append((a, b))
    root = roots(names, links)
    groups = {}
    for n in names:
        groups.setdefault(root[n], []).extend(place[n])
    gone = {p for g in groups.values() for p in set(g) - {min(g)}}
    return gone, links


def test_lines_equal_brute_force(make):
    rng = random.Random(4)
    base = [prose(i, rng.randint(5, 120)) for i in range(25)]
    rows = []
    for i in range(60):
        own = []
        for _ in range(rng.randint(0, 5)):
            words = rng.choice(base).split()
            if rng.random() < 0.6:
                words[rng.randrange(len(words))] = "other"
            own.append(rng.choice(["", "  ", "- "]) + " ".join(words).replace("a", "A") + rng.choice(["", ".", " !"]))
        own.append(rng.choice(["short line", "", prose(500 + i, 8)]))
        rows.append((i, "\n".join(own)))
    gone, links = lines_removed(rows)
    assert links and gone
    got = lines.deduplicate(make(rows), ["doc_id", "kept", "n"]).collect()
    assert len(got) == len(rows)
    for r in got:
        own = rows[r.doc_id][1].split("\n")
        kept = "\n".join(x for k, x in enumerate(own) if (r.doc_id, k) not in gone)
        assert (r.n_lines, r.n_removed, r.kept) == (len(own), sum((r.doc_id, k) in gone for k in range(len(own))), kept)


def test_lines_equal_plain_edit_similarity(make):
    """One changed letter, replaced word or dropped word in lines of all lengths, without any filter before the distance."""
    rng = random.Random(8)
    rows = []
    for i in range(240):
        words_ = prose(3000 + i, rng.choice([5, 6, 7, 8, 9, 12, 20, 40, 80])).split()
        k = rng.randrange(len(words_))
        new = {0: words_[k][:-1] + "z", 1: "q" * len(words_[k]), 2: ""}[i % 3]
        changed = " ".join(w for w in [*words_[:k], new, *words_[k + 1 :]] if w)
        rows += [(2 * i, " ".join(words_)), (2 * i + 1, changed)]
    gone = set()
    for (_, a), (j, b) in zip(rows[::2], rows[1::2], strict=True):
        a, b = a.encode(), b.encode()
        if len(b.split()) >= 5 and slow_distance(a, b) <= int(0.1 * max(len(a), len(b)) + 1e-9):
            gone.add(j)
    got = {r.doc_id for r in lines.deduplicate(make(rows), ["doc_id"]).collect() if r.n_removed}
    assert len(gone) > 100 and got <= gone
    assert len(got) >= 0.99 * len(gone)


def test_segments_of_short_lines_meet():
    rng = random.Random(9)
    for _ in range(3000):
        a = bytes(rng.choice(b"abcd ") for _ in range(rng.randint(9, 39)))
        b = bytearray(a)
        for _ in range(rng.randint(0, 3)):
            kind, at = rng.randrange(3), rng.randrange(len(b))
            b[at : at + (kind > 0)] = b"" if kind == 2 else bytes([rng.choice(b"abcd ")])
        most = lines.edits(max(len(a), len(b)), 0.9)
        if most and max(len(a), len(b)) < lines.EXACT and slow_distance(a, bytes(b)) <= most:
            assert set(lines.segments(a, 0.9)) & set(lines.segments(bytes(b), 0.9)), (a, bytes(b))


def test_lines_of_odd_documents(make, odd):
    got = lines.deduplicate(make(odd), ["doc_id", "h"]).collect()
    assert len(got) == len(odd)
    by = {r.doc_id: r for r in got}
    assert by[1].kept == "" and by[3].kept == " \t\n " and by[7].n_removed == 0 and by[None].n_removed == 0
    # of the long line the first document keeps it, equal rows fare alike
    assert by[5].n_removed == 0 and [r.n_removed for r in got if r.doc_id == 6] == [1, 1]
    assert lines.deduplicate(make([]), ["doc_id"]).collect() == []


# n-grams


def word_sets(rows, size=4):
    out = {}
    for i, text in rows:
        folded = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", folded) if x]
        out[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()
    return out


def near_copies(seed=0):
    """Copies with changed words on both sides of the limit, chains of them, and texts that share half of their words."""
    rng = random.Random(seed)
    rows, at = [], 0
    for group in range(40):
        words = prose(group, rng.choice([1, 2, 3, 4, 5, 7, 9, 12, 20, 60, 200, 700])).split()
        for _ in range(rng.randint(1, 8)):
            for _ in range(rng.randint(0, max(1, len(words) // 40))):
                words[rng.randrange(len(words))] = rng.choice(["new", "Other", "x"]) + str(rng.randrange(10**6))
            if rng.random() < 0.3:
                words = words + prose(at + 5000, max(1, len(words) // 15)).split()
            rows.append((at * 7 % 1009, rng.choice([" ", "  ", "\n"]).join(words)))
            at += 1
    half = prose(77, 60)
    rows += [(2000 + i, half + " " + prose(3000 + i, rng.randint(20, 60))) for i in range(40)]
    return rows


def test_jaccard_groups_equal_brute_force(make):
    rows = near_copies() + [(3000, ""), (3001, ""), (3002, None)]
    sets = word_sets(rows)
    names = sorted(sets)
    links = []
    for x, a in enumerate(names):
        for b in names[:x]:
            same = len(sets[a] & sets[b])
            if same and 100 * same >= 85 * len(sets[a] | sets[b]):
                links.append((a, b))
    want = roots(names, links)
    got = jaccard.groups(make(rows)).collect()
    assert len(links) > 50
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == {n: (len(sets[n]), want[n]) for n in names}


def test_jaccard_keys_meet_for_every_allowed_difference():
    rng = np.random.default_rng(6)
    for _ in range(300):
        n = int(rng.integers(1, 400))
        one = rng.integers(0, 2**63, n, dtype=np.uint64)
        off = int(rng.integers(0, n * 3 // 17 + 1))
        add = int(rng.integers(0, off + 1))
        other = np.concatenate([one[: n - (off - add)], rng.integers(0, 2**63, add, dtype=np.uint64)])
        same = n - (off - add)
        if len(other) and 100 * same >= 85 * (n + len(other) - same):
            assert np.intersect1d(jaccard.keys_of(np.sort(one), 85), jaccard.keys_of(np.sort(other), 85)).size


def test_jaccard_of_odd_documents(make, odd):
    got = jaccard.groups(make(odd)).collect()
    assert len(got) == len(odd)
    by = {r.doc_id: r for r in got}
    assert [by[i].component_id for i in (1, 2, 3, 4, 5, 6, 7, 8)] == [1, 2, 3, 4, 5, 5, 7, 8]
    assert by[None].component_id is None and by[1].n_shingles == 0 and by[4].n_shingles == 1
    assert jaccard.groups(make([])).collect() == []


def test_jaccard_of_repeated_ids_with_other_texts(make):
    one, two, three = prose(1, 60), prose(2, 60), prose(3, 60)
    near = [x + " end" for x in (one, two, three)]
    rows = [(None, one), (None, two), (None, three), (5, near[0]), (5, near[1]), (6, near[1] + " z"), (7, prose(4, 60)), (7, near[2])]
    for given in (rows, rows[::-1]):
        got = jaccard.groups(make(given)).collect()
        groups = {}
        for r in got:
            groups.setdefault(r.first_class, []).append((r.doc_id, r.component_id))
        want = [[(5, 5), (None, 5)], [(5, 5), (6, 5), (None, 5)], [(7, 7)], [(7, 7), (None, 7)]]
        assert sorted((sorted(g, key=str) for g in groups.values()), key=str) == sorted(want, key=str)


# embeddings


def vectors(seed=0, dims=24):
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(40):
        centre = rng.normal(size=dims)
        for _ in range(int(rng.integers(1, 9))):
            out.append((centre + rng.normal(scale=rng.choice([0.02, 0.15, 0.25]), size=dims)).tolist())
    return out


def links_of(table):
    v = np.array([[math.nan if x is None else x for x in (r or [0.0] * 24)] for r in table])
    norm = np.linalg.norm(v, axis=1)
    good = np.isfinite(norm) & (norm > 0)
    v[good] /= norm[good, None]
    v[~good] = 0
    hit = v @ v.T >= 0.95
    np.fill_diagonal(hit, False)
    return hit


@pytest.mark.parametrize("options", [{"slack": 1.0}, {"slack": 1.0, "block_rows": 7, "cell_rows": 20}, {"slack": 1.0, "cell_rows": 10}])
def test_embeddings_equal_brute_force(spark, options):
    table = vectors() + [None, [0.0] * 24, [math.nan] * 24, [math.inf] + [1.0] * 23, [None] + [1.0] * 23]
    hit = links_of(table)
    want = roots(range(len(table)), np.argwhere(hit).tolist())
    df = spark.createDataFrame(list(enumerate(table)), "vec_id long, embedding array<double>")
    df = df.selectExpr("*", "1 AS label", "2 AS row", "3 AS id", "4 AS cell")
    got = {r.vec_id: r for r in embeddings.near_duplicates(df, **options).collect()}
    assert hit.sum() > 100
    for i in range(len(table)):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (hit[i].sum(), want[i], want[i] == i)


@pytest.mark.parametrize("options", [{}, {"block_rows": 7, "cell_rows": 20}, {"sample_rows": 60, "cell_rows": 20}])
def test_embeddings_of_several_lengths(spark, options):
    """Every length is compared with itself, also one that the sample doesn't have."""
    parts = {24: vectors(1, 24), 8: vectors(2, 8), 100: vectors(3, 100), 3: [[1.0, 2.0, 3.0], [1.0, 2.0, 3.01]], 1: [[2.0], [5.0], [-1.0]]}
    table, hits, want = [], {}, {}
    for width, own in parts.items():
        v = np.array(own) / np.linalg.norm(own, axis=1)[:, None]
        hit = v @ v.T >= 0.95
        np.fill_diagonal(hit, False)
        first = len(table)
        table += own
        local = roots(range(len(own)), np.argwhere(hit).tolist())
        for i in range(len(own)):
            hits[first + i], want[first + i] = int(hit[i].sum()), first + local[i]
    df = spark.createDataFrame(list(enumerate(table)), "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.near_duplicates(df, **options).collect()}
    assert got == {i: (hits[i], want[i]) for i in range(len(table))}


def test_embeddings_recall_of_the_default_search(spark):
    rng = np.random.default_rng(9)
    base = rng.normal(size=(1500, 64))
    base /= np.linalg.norm(base, axis=1)[:, None]
    noise = rng.normal(size=base.shape)
    noise -= (noise * base).sum(axis=1)[:, None] * base
    noise /= np.linalg.norm(noise, axis=1)[:, None]
    near = 0.951 * base + math.sqrt(1 - 0.951**2) * noise  # as far apart as links can be
    table = np.concatenate([base, near])
    df = spark.createDataFrame(list(enumerate(table.tolist())), "vec_id long, embedding array<double>")
    got = sum(r.n_links for r in embeddings.near_duplicates(df, cell_rows=60).collect())
    assert got >= 0.99 * 2 * len(base)


def test_embeddings_of_repeated_and_empty_rows(spark):
    one, other = [1.0, 0.0], [0.0, 1.0]
    rows = [(1, one), (1, one), (2, one), (2, other), (None, one), (3, [1.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {(r.vec_id, r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicates(df).collect()}
    assert got == {(1, 1, 1, True), (2, 1, 1, False), (2, 0, 1, False), (None, 0, None, False), (3, 0, 3, True)}
    assert embeddings.near_duplicates(df.limit(0)).collect() == []


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_keys_of_the_same_nodes_are_one(spark):
    """Of keys with equal sets of nodes the least stays; keys of one node go, repeats are dropped."""
    sets = {1: [7, 8], 2: [7, 8], 3: [7, 8, 9], 4: [9], 5: [8, 9], 6: [9, 7, 8, 8], 7: [10, 11]}
    keyed = spark.createDataFrame([(k, n) for k, nodes in sets.items() for n in nodes], "key long, node long")
    got = components_module.shared_keys(keyed, Scratch(spark, "test-keys"))
    assert _rows(got.select("key", "node")) == [(1, 7), (1, 8), (3, 7), (3, 8), (3, 9), (5, 8), (5, 9), (7, 10), (7, 11)]


@pytest.mark.parametrize("few", [0, 1, 8])
def test_groups_of_large_and_small_keys_equal_brute_force(spark, monkeypatch, few):
    """Numbers that share a key are linked if they are at most 2 apart; small keys wait until large ones have had their rounds."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(components_module, "FEW", few)
    turns = []
    picker = random.Random(11)
    member = {(0, 1000 + 3 * i) for i in range(60)} | {(1, i) for i in range(0, 90, 2)} | {(2, i) for i in range(90, 120)}
    member |= {(10 + i, n) for i in range(80) for n in picker.sample(range(0, 130), 3)}
    facts = spark.createDataFrame([(n,) for n in sorted({n for _, n in member})], "node long")

    def verify(pairs):
        turns.append(1)
        return pairs.where(F.abs(F.col("a") - F.col("b")) <= 2)

    got = components_module.grouped(
        spark.createDataFrame(sorted(member), "key long, node long"), facts, lambda x, y: F.lit(True), verify, Scratch(spark, "test-groups")
    )
    links = [(x, y) for k, x in member for other, y in member if k == other and x < y <= x + 2]
    want = roots({n for _, n in member}, links)
    found = dict(got.select("node", "root").collect())
    assert {n: found.get(n, n) for n in want} == want
    assert len(turns) <= components_module.ROUNDS + 1


def test_jaccard_leaves_only_its_result(spark, make, tmp_path, monkeypatch):
    """Sketches, sets and links of a join are gone before its result is read."""
    import lakewarden.llm.common as common

    monkeypatch.setattr(common, "checkpoint_root", lambda _: str(tmp_path))
    text = " ".join(f"w{i}" for i in range(40))
    got = jaccard.groups(make([(1, text), (2, text + " more"), (3, "other words of a text")]))
    assert [p.name.split("-")[1] for p in (tmp_path / "lakewarden").iterdir() if any(p.iterdir())] == ["groups"]
    assert dict(got.select("doc_id", "component_id").collect()) == {1: 1, 2: 1, 3: 3}


def test_pair_sketches_bound_the_edit_distance():
    """No line within its edits is ruled out, and unrelated lines of one length are."""
    rng = random.Random(4)
    for n in (1, 2, 9, 40, 90, 200):
        one = bytes(rng.choice(b"abcdefghij klmnopqrs") for _ in range(n))
        other = bytearray(one)
        edits = rng.randint(0, max(1, n // 10))
        for _ in range(edits):
            at = rng.randrange(len(other) + 1)
            kind = rng.randrange(3)
            other[at : at + (kind > 0)] = b"z" * (kind < 2)
        strange = bytes(rng.choice(b"abcdefghij klmnopqrs") for _ in range(n))
        data = np.frombuffer(one + bytes(other) + strange, np.uint8)
        bounds = np.cumsum([0, len(one), len(other), len(strange)])
        a, b, c = np.unpackbits(lines.pair_sketches(data, bounds).view(np.uint8), axis=1)
        assert (a != b).sum() <= lines.PER_EDIT * edits
        assert n < 40 or (a != c).sum() > lines.PER_EDIT * lines.edits(n, 0.9)
