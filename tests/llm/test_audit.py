"""The audit of filters against brute force, over batches that take earlier counts back."""

import random
import re
from itertools import permutations

import pytest

from llm_texts import prose
from lakewarden.llm import audit


def masks(rows):
    """Part, set of failed filters and doc_id of each row."""
    out = []
    for i, text, part, *_ in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = set()
        if len(words) < 200:
            fails.add("A")
        if 100 * len(set(words)) < 50 * len(words):
            fails.add("B")
        if 100 * len(re.findall("[A-Z]", text)) > 3 * len(text):
            fails.add("C")
        if re.search(r"[#$%&*|]", text):
            fails.add("D")
        if i is not None and any(j is not None and j < i and (other or "") == text for j, other, *_ in rows):
            fails.add("E")
        out.append((part or "", fails, i))
    return out


def wanted(rows, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    known, out, shapley = masks(rows), {}, {}
    for order in permutations("ABCDE"):
        for part, fails, _ in known:
            first = next((f for f in order if f in fails), None)
            if first:
                shapley[part, first] = shapley.get((part, first), 0) + 1
    for part in {p for p, _, _ in known}:
        own = [(f, i) for p, f, i in known if p == part]
        for order in permutations("ABCDE"):
            for step, letter in enumerate(order, 1):
                before = set(order[: step - 1])
                here = [i for f, i in own if letter in f and not f & before]
                out[part, "".join(order), step] = (
                    sum(not f & (before | {letter}) for f, _ in own), len(here), sum(letter in f and bool(f & before) for f, _ in own),
                    sum(f == {letter} for f, _ in own), sum(i in good for i in here), sum(i in toxic for i in here),
                    shapley.get((part, letter), 0),
                )
    return out


def shaped(df):
    names = "kept removed redundant unique_fails good_lost toxic_lost shapley".split()
    return {(r.part, r.filter_order, r.step): tuple(r[n] for n in names) for r in df.collect()}


def texts(seed, n):
    rng = random.Random(seed)
    base = [prose(i, rng.choice([5, 150, 220])) for i in range(12)]
    base += ["Big " + x for x in base[:3]] + [x + " 50%" for x in base[:5]] + ["la " * 210, "", "LOUD " * 3]
    return [(i, rng.choice(base), rng.choice(["en", "de", None])) for i in rng.sample(range(10 * n), n)]


@pytest.mark.parametrize("states", [1, 7, 256])
def test_batches_take_back_what_smaller_ids_change(spark, make, tmp_path, states):
    rng = random.Random(states)
    rows = texts(states, 80) + [(None, "la " * 210, "en"), (None, "", None)]
    rows += [rows[0], rows[1], (rows[2][0], rows[2][1], "fr"), (-5, None, "de")]
    rng.shuffle(rows)
    # falling ids in the first half: nearly every batch takes something back
    rows = sorted(rows[:50], key=lambda r: -(r[0] or 0)) + rows[50:]
    labels = [(i, rng.randint(0, 1), rng.choice([0, 1, None])) for i, *_ in rows if i is not None and rng.random() < 0.5]
    labels += [(None, 1, 1), (10**6, 1, 1)]
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").selectExpr("*", "1 AS id", "2 AS mask")
    place = f"{tmp_path}/documents.parquet"
    for k in range(0, len(rows), 12):
        make(rows[k : k + 12]).coalesce(1).write.mode("append").parquet(place)
    folder = f"file://{tmp_path}/audit"
    got = shaped(audit.audit(spark, f"file://{place}", marks, folder, batches=5, texts_per_state=states))
    assert got == wanted(rows, labels)
    changes = [r.n for r in spark.read.schema(audit.ROW).parquet(f"{folder}/changes").collect()]
    assert min(changes) < 0  # something was taken back
    # started again, only new files are read
    more = [(-100 - k, t, "it") for k, (_, t, *_) in enumerate(rows[:15])]
    make(more).coalesce(1).write.mode("append").parquet(place)
    assert shaped(audit.audit(spark, f"file://{place}", marks, folder)) == wanted(rows + more, labels)
    assert shaped(audit.audit(spark, f"file://{place}", marks, folder)) == wanted(rows + more, labels)


def test_thresholds_and_settings_come_back(spark, make, tmp_path):
    place = f"{tmp_path}/documents.parquet"
    rows = [(1, "One two three @"), (2, "one two @ four")]
    make(rows).coalesce(1).write.parquet(place)
    marks = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    counted = audit.counters(spark, place, marks, least_words=4, capital_percent=50, symbols="@")
    assert [(r["part"], r["mask"], r["n"]) for r in counted.collect()] == [("", audit.BIT["D"], 2)]
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass").endswith("HDFSBackedStateStoreProvider")


def test_odd_documents(spark, make, odd, tmp_path):
    marks = spark.createDataFrame([(4, 1, 0), (4, 0, 1), (6, None, None)], "doc_id long, quality int, toxic int")
    place = f"{tmp_path}/documents.parquet"
    make(odd).repartition(3).write.parquet(place)
    got = shaped(audit.audit(spark, place, marks))
    rows = [(i, t, (own or [None])[0]) for i, t, *own in odd]
    assert got == wanted(rows, [(4, 1, 1)])
    make([]).write.parquet(f"{tmp_path}/none.parquet")
    assert audit.audit(spark, f"{tmp_path}/none.parquet", marks).collect() == []
