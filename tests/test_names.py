"""Pairs of similar names against all pairs, for any threshold, and how they grow."""

import random

import pytest
from pyspark.sql import functions as F

from lakewarden.operators import mdm


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def frame(spark, names):
    return spark.createDataFrame([(n,) for n in names], "name string").withColumn("len", F.char_length("name"))


def some_names(seed, n=70):
    rng = random.Random(seed)
    names = set()
    while len(names) < n:
        base = "".join(rng.choice("abc ") for _ in range(rng.randint(1, 30)))
        names.add(base)
        for _ in range(rng.randint(0, 4)):
            at = rng.randrange(len(base))
            base = base[:at] + rng.choice(["", "a", "zz"]) + base[at + rng.randint(0, 1) :]
            names.add(base or "q")
    return sorted(names)


@pytest.mark.parametrize("threshold", [100, 95, 88, 84, 70, 50])
def test_similar_names_equal_all_pairs(spark, threshold):
    names = some_names(threshold)
    got = {(r.x, r.y) for r in mdm.similar_edges(frame(spark, names), threshold).collect()}
    want = {
        (a, b) for a in names for b in names
        if a != b and 200 * lcs(a, b) >= threshold * (len(a) + len(b))
    }
    assert got == want


def test_long_chains_of_leaders(spark):
    """Each name is similar to its neighbours only, so every other one leads and the rounds follow the chain."""
    words = [f"{'ab' * 6}{i:02d}" for i in range(3)]
    chain = ["x" * (10 + i) for i in range(8)]
    rows = [(i, n, None) for i, n in enumerate(chain + words)]
    rows += [(100 + i, f"other{i}" * 3, "m@x") for i in range(5)]
    nodes = spark.createDataFrame(rows, "node long, name string, email string").withColumn("len", F.char_length("name"))
    got = {r.node: r.leader for r in mdm.leader_clusters(nodes, 88).collect()}
    want = {}
    for i, n, mail in rows:
        similar = [
            j for j, m, other in rows
            if j < i and want[j] == j and (200 * lcs(n, m) >= 88 * (len(n) + len(m)) or mail and mail == other)
        ]
        want[i] = min(similar, default=i)
    assert got == want


def test_pairs_stay_far_below_the_square(spark):
    rng = random.Random(1)
    names = {f"{rng.getrandbits(28):07x} {rng.getrandbits(32):08x}" for _ in range(6000)}
    pairs = mdm.name_pairs(frame(spark, sorted(names)), 88).count()
    assert pairs < len(names) ** 2 / 2 / 100


@pytest.mark.parametrize("in_task", [True, False])
def test_leaders_in_batches_by_brute_force(spark, monkeypatch, in_task):
    """Many names that all resemble each other: batches of five nodes, whose leaders close late nodes as well."""
    rng = random.Random(5)
    names = sorted({"supplier " + "".join(rng.choice("01") * 4 for _ in range(5)) for _ in range(60)} | {"other name", "other nime"})
    rng.shuffle(names)
    rows = [(i, n, len(n), rng.choice([None, f"m{i % 9}"])) for i, n in enumerate(names * 2)]
    rows = list({(n, m): (i, n, k, m) for i, n, k, m in reversed(rows)}.values())
    nodes = spark.createDataFrame(rows, "node long, name string, len int, email string")
    monkeypatch.setattr(mdm, "PAIRS_PER_NAME", 0)
    if not in_task:
        monkeypatch.setattr(mdm, "TASK_NODES", 0)
    monkeypatch.setattr(mdm, "MOST_BESIDE", 10**9 if in_task else 0)
    want, leaders = {}, []
    for node, name, _, mail in sorted(rows):
        near = [
            a for a, n, m in leaders
            if n == name or (mail and m == mail) or 25 * lcs(n, name) >= 11 * (len(n) + len(name))
        ]
        want[node] = min(near, default=node)
        leaders += [(node, name, mail)] * (not near)
    got = {r.node: r.leader for r in mdm.leader_clusters(nodes, 88, most_pairs=0, first_batch=5).collect()}
    assert got == want and 5 < len(leaders) < len(rows) // 2


def test_meetings_of_names_are_counted(spark):
    names = frame(spark, ["supplier 0001", "supplier 0002", "other"])
    one, two = mdm.partitions("name", "len", 88)
    keys = names.select(F.explode(one).alias("key")).join(names.select(F.explode(two).alias("key")), "key").count()
    assert mdm._meetings(names, names, 88) == 2 * keys
