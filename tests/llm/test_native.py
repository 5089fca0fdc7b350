"""Mixing, fingerprints and personal data against brute force."""

import hashlib
import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from llm_texts import prose
from lakewarden.llm import fingerprint, mixing, personal

# personal data

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (2 if i % 2 else 1)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def base(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            fits = {
                "email": True,
                "ip": kind == "ip" and all(int(p) <= 255 for p in m.group().split(".")),
                "card": 16 <= len(digits) <= 19 and luhn(digits),
                "phone": 8 <= len(digits) <= 15,
            }[kind]
            if fits:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return ",".join(out)


TRICKY = [
    "a@b.c_d@e.f x@y@z.org a@b@c.d", "mail me: josé.ñ@café.com, x.y+z@host-1.co.uk.", "1.2.3.4.5.6.7.8 300.1.1.1 001.02.3.255 1.2.3",
    "4111 1111 1111 1111 4111-1111-1111-1112 4111  1111 1111 1111", "+1 (555) 010-9999 +49.30.1234567 +1() +123", "😀😀 +33 1 23 45 67 89 a@b.cd",
    "4" * 40 + " " + "1.1.1.1" * 3, "IBAN DE89 3704 0044 0532 0130 00 and GB82WEST12345698765432, DE89370400440532013001",
    "visa card 378282246310005 or 378282246310005", "+1+1+1 a@b a@b.", "%@-.-", "9.9.9.9999999999999999999", "a" * 3000 + "@" + "b." * 2000,
    "0" * 5000, "+" + "(" * 3000, None, "",
]


def test_base_spans_equal_the_plain_patterns(make):
    rows = list(enumerate(TRICKY))
    got = {r.doc_id: r.found for r in personal.find(make(rows), ["doc_id", "found", "n"]).collect()}
    for i, text in rows:
        own = ",".join(f"{s.kind}:{s.start}:{s.end}" for s in got[i] if s.kind in personal.BASE)
        assert own == base(text), text


def test_added_spans_need_their_checks(make):
    found = {r.doc_id: r.found for r in personal.find(make(list(enumerate(TRICKY))), ["doc_id"]).collect()}
    ibans = [TRICKY[7][s.start : s.end] for s in found[7] if s.kind == "iban"]
    assert ibans == ["DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432"]
    assert [(s.kind, s.start, s.score) for s in found[8]] == [("card_short", 10, 1.0)]
    assert all(0 < s.score <= 1 for spans in found.values() for s in spans)


def test_personal_data_of_odd_documents(make, odd):
    assert [len(r.found) for r in personal.find(make(odd), ["doc_id"]).collect()] == [0] * len(odd)
    assert personal.find(make([]), ["doc_id"]).collect() == []


# fingerprints


def weights(text):
    return Counter(w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w)


def jaccard(a, b):
    a, b = weights(a), weights(b)
    total = sum((a | b).values())
    return sum((a & b).values()) / total if total else 1.0


def test_edited_texts_and_neighbours(make, odd):
    rows = [r for r in odd if r[0] is not None and r[0] != 6] + [(40, "end"), (25, "an öther täxt " * 9)]
    order = sorted(rows, key=lambda r: -r[0])
    got = {r.doc_id: r for r in fingerprint.fingerprints(make(rows)).collect()}
    assert len(got) == len(rows)
    for i, (key, text, *_) in enumerate(order):
        text, after = text or "", order[(i + 1) % len(order)][1] or ""
        third = len(text) // 3
        want = text[: len(text) - third] + after[:third]
        assert got[key].n_chars == len(text)
        assert got[key].edited_sha256 == hashlib.sha256(want.encode()).hexdigest()
    assert got[1].fingerprint == got[2].fingerprint == got[3].fingerprint == ""
    assert got[2].near_next == 1.0 and got[4].near_next == 0.0


def test_repeated_and_null_ids(make, odd):
    got = fingerprint.fingerprints(make(odd)).collect()
    assert len(got) == len(odd)
    six = [r for r in got if r.doc_id == 6]
    assert len(six) == 2 and six[0] == six[1] and six[0].near_next == 1.0
    assert six[0].fingerprint == next(r.fingerprint for r in got if r.doc_id == 5)
    alone = fingerprint.fingerprints(make([(1, "a b c")])).collect()[0]
    assert alone.near_next == 1.0
    assert fingerprint.fingerprints(make([])).collect() == []


def test_collision_rate_is_the_weighted_similarity(make):
    rows, pairs = [], []
    for i in range(150):
        words = prose(i, 60).split()
        other = words[: 60 - i % 50] + words[: i % 30] * 2 + prose(500 + i, i % 50).split()
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(other))]
        pairs.append((2 * i, 2 * i + 1))
    got = {r.doc_id: r.fingerprint for r in fingerprint.fingerprints(make(rows)).collect()}
    texts, errors = dict(rows), []
    for a, b in pairs:
        lanes = range(0, len(got[a]), 2 * fingerprint.LANE)
        same = sum(got[a][k : k + 8] == got[b][k : k + 8] for k in lanes) / fingerprint.SAMPLES
        errors.append(same - jaccard(texts[a], texts[b]))
    # 150 pairs of 24 samples: the mean error has a deviation below 0.009
    assert abs(sum(errors) / len(errors)) < 0.04
    assert math.sqrt(sum(e * e for e in errors) / len(errors)) < 0.14


# mixing


def shares_frame(spark, totals):
    total = sum(totals.values())
    return spark.createDataFrame([(k, v / total) for k, v in totals.items()], "key string, share double")


def test_exponent_meets_entropy_and_repetition(spark):
    totals = {"a": 900, "b": 60, "c": 30, "d": 10, "none": 0}
    p = [v / 1000 for v in totals.values() if v]

    def entropy(x):
        w = [q**x for q in p]
        return -sum(v / sum(w) * math.log(v / sum(w)) for v in w)

    shares = shares_frame(spark, totals)
    x = mixing.exponent(shares, target_entropy=1.0)
    assert abs(entropy(x) - 1.0) < 1e-6
    x = mixing.exponent(shares, max_repetition=3.0)
    assert abs((0.9 / 0.01) ** (1 - x) - 3.0) < 1e-6
    x = mixing.exponent(shares, max_repetition=3.0, budget=1.0)
    assert abs(0.01 ** (x - 1) / sum(q**x for q in p) - 3.0) < 1e-6
    assert mixing.exponent(shares, target_entropy=5.0) == 0.0
    assert mixing.exponent(shares, target_entropy=0.01) == 1.0
    assert mixing.exponent(shares.limit(0), max_repetition=2.0) == 1.0


def corpus():
    rows = [(i, prose(i, 5 + i % 9), "en", "big") for i in range(300)]
    rows += [(1000 + i, prose(i, 4 + i % 5), "en", "small") for i in range(40)]
    return rows + [(2000 + i, prose(i, 6), "en", None) for i in range(10)]


def test_a_budget_is_filled_in_permuted_epochs(make):
    rows = corpus()
    got = mixing.mix(make(rows), evenness=0.9, max_repetition=8.0, budget=1.0, block_tokens=200).collect()
    total = sum(len(t.split()) for _, t, *_ in rows)
    for source in ("big", "small", None):
        own = [r for r in got if r.source == source]
        docs = [r for r in rows if r[3] == source]
        size = sum(len(t.split()) for _, t, *_ in docs)
        quota = round(own[0].weight * total)
        seen = sorted(own, key=lambda r: (r.epoch, r.place))
        at = 0
        for r in seen:  # the stream is gapless and ends with the document that reaches the quota
            assert r.offset == at and r.offset < quota
            at += r.tokens
        assert at >= quota or at == size * (max(r.epoch for r in own) + 1)
        for epoch in range(max(r.epoch for r in own)):  # all but the last epoch hold every document once
            assert sorted(r.doc_id for r in own if r.epoch == epoch) == sorted(d[0] for d in docs)
    sizes = Counter()
    for r in got:
        sizes[r.block, r.source] += r.tokens
    middle = [sizes[1, s] / 200 for s in ("big", "small")]
    assert abs(middle[0] - next(r.weight for r in got if r.source == "big")) < 0.1
    first, second = (sorted((r.place, r.doc_id) for r in got if r.source is None and r.epoch == e) for e in (0, 1))
    assert [d for _, d in first] != [d for _, d in second][: len(first)]


def test_without_a_budget_every_document_comes(make, odd):
    rows = corpus() + [(9000 + i, *r[1:]) for i, r in enumerate(odd)]
    docs = make(rows).where("length(text) < 40000 OR text IS NULL")
    wanted = docs.count()
    got = mixing.mixed(docs, max_repetition=2.0)
    assert got.columns == docs.columns
    counts = Counter(r.doc_id for r in got.select("doc_id").collect())
    assert len(counts) == wanted and max(counts.values()) <= 2 and max(counts.values()) > 1
    assert mixing.mixed(make([])).collect() == []
    assert mixing.mix(make([]), budget=1.0, max_repetition=2.0).collect() == []


def test_repeated_rows_keep_their_number(make):
    rows = [(1, "a b", "en", "s"), (1, "a b", "en", "s"), (2, "c", "en", "t"), (None, "d e", "en", "t"), (3, None, "en", "u")]
    got = Counter(r.doc_id for r in mixing.mixed(make(rows), max_repetition=1.0).collect())
    assert got == {1: 2, 2: 1, None: 1, 3: 1}


@pytest.mark.parametrize("value", [0.0, 1.0])
def test_the_shares_of_a_single_source(make, value):
    got = mixing.mix(make([(1, "a b c", "en", "s")]), max_repetition=2.0, budget=1.0 + value).collect()
    assert len(got) == 1 + int(value) and {r.weight for r in got} == {1.0}


def test_no_python_in_the_plans(make):
    docs = make(corpus())
    for df in (personal.find(docs, ["doc_id"]), fingerprint.fingerprints(docs), mixing.mix(docs, budget=1.0, max_repetition=2.0)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", plan)
    assert docs.select(F.col("doc_id")).count()
