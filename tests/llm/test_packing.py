"""Packing: ids against the tokenizers library, plans against best-fit piece by piece."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from llm_texts import prose
from lakewarden.llm import packing
from lakewarden.llm.packing import Limits

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
#: Rare white space, invisible signs, letters outside ASCII.
ODD_POINTS = [0x1C, 0x85, 0xA0, 0xE9, 0x1680, 0x180E, 0x2003, 0x200B, 0x2028, 0x3000, 0x4E2D, 0x1F600]
ENCODER = packing.Encoder(PATH)


def ids_of(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def slow_fit(lengths, limits, rule):
    """Piece by piece over single sequences."""
    full = [int(x) for x in limits.capacities]
    weight = [1 / c**2 for c in full]
    bins = []
    for n in sorted(lengths, reverse=True):
        x = (n, 1, n * n)
        best = None
        for b in bins:
            if all(r >= p for r, p in zip(b, x, strict=True)):
                if rule == "norm":
                    value = sum(w * float(r - p) ** 2 for w, r, p in zip(weight, b, x, strict=True))
                else:
                    value = -sum(w * float(r) * p for w, r, p in zip(weight, b, x, strict=True))
                if best is None or value < best[0] - 1e-12:
                    best = value, b
        b = best[1] if best else list(full)
        if not best:
            bins.append(b)
        for i in range(3):
            b[i] -= x[i]
    return sorted(map(tuple, bins))


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("ab'sZ  \n\t.1<|>" + "".join(map(chr, ODD_POINTS))), max_size=40))
def test_ids_equal_those_of_the_library(text):
    (got,) = ENCODER.encode([text + "<|endoftext|> it's " + text])
    assert np.frombuffer(got, "<u4").tolist() == ids_of(text + "<|endoftext|> it's " + text)


def test_ids_of_every_letter_equal_those_of_the_library():
    """Both libraries have tables of letters, digits and white space of their own."""
    points = [c for c in range(0x30000) if not 0xD800 <= c < 0xE000]
    for i in range(0, len(points), 512):
        text = "".join(f"a{chr(c) * 2}1 {chr(c)}! {chr(c)} b" for c in points[i : i + 512])
        assert ENCODER.fast.encode_ordinary(text) == ids_of(text), hex(points[i])


def test_ids_of_many_texts():
    texts = [prose(i, 300) for i in range(20)] + ["x" * 10_000, "", "a  b   c", " lead", "trail "]
    got = [np.frombuffer(x, "<u4").tolist() for x in ENCODER.encode(texts)]
    assert got == [ids_of(t) for t in texts]
    other = packing.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    assert ENCODER.fast and not other.fast
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(x, "<u4").tolist() for x in other.encode(texts)] == want


@pytest.mark.parametrize("rule", ["norm", "dot"])
@pytest.mark.parametrize("limits", [Limits(50), Limits(50, 3), Limits(50, None, 900), Limits(50, 4, 1500)])
def test_plans_equal_best_fit_piece_by_piece(rule, limits):
    for seed in range(25):
        rng = random.Random(seed)
        high = rng.choice([3, 8, 20, limits.piece])
        lengths = [rng.randint(1, min(high, limits.piece)) for _ in range(rng.randint(0, 150))] + [rng.randint(1, 9)] * rng.choice([0, 60])
        counts = {n: lengths.count(n) for n in set(lengths)}
        plan = packing.best_fit(counts, limits, rule)
        held = {}
        for n, c in counts.items():
            seq, off = plan.place(np.full(c, n), np.arange(c))
            for s, o in zip(seq.tolist(), off.tolist(), strict=True):
                held.setdefault(s, []).append((o, n))
        assert sorted(held) == list(range(plan.sequences))
        full, bins = [int(x) for x in limits.capacities], []
        for own in held.values():
            at = 0
            for o, n in sorted(own):  # without a gap
                assert o == at
                at += n
            bins.append((full[0] - at, full[1] - len(own), full[2] - sum(n * n for _, n in own)))
            assert min(bins[-1]) >= 0
        want = slow_fit(lengths, limits, rule)
        # ties between equal values may fall otherwise, which can't change much
        assert abs(len(bins) - len(want)) <= (1 if limits.documents or limits.attention else 0)


def test_plans_grow_with_the_lengths_only():
    rng = np.random.default_rng(1)
    counts = dict(zip(range(1, 2049), rng.integers(1, 10**9, 2048).tolist(), strict=True))
    plan = packing.best_fit(counts)
    tokens = sum(k * n for k, n in counts.items())
    assert len(plan.length) < 50_000 and -(-tokens // 2048) <= plan.sequences < 1.02 * tokens / 2048
    with pytest.raises(ValueError):
        packing.best_fit({2049: 1})
    with pytest.raises(ValueError):
        packing.best_fit({1: 1}, rule="other")


def check(rows, got, limits, end=0):
    """Every document comes back whole, and no sequence breaks a constraint or has a gap."""
    want = sorted(str((i, ids_of(t) + [end])) for i, t, *_ in rows)
    docs, held = {}, {}
    for r in got:
        docs.setdefault((r.doc_id, r.key_), []).append(r)
        held.setdefault(r.sequence_id, []).append(r)
        assert r.length == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
    back = []
    for (i, _), own in docs.items():
        own = sorted(own, key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own)))
        assert [r.start for r in own] == np.cumsum([0, *(r.length for r in own[:-1])]).tolist()
        assert all(r.length == limits.piece for r in own[1:])
        back.append(str((i, [x for r in own for x in r.ids])))
    assert sorted(back) == want
    for own in held.values():
        own = sorted(own, key=lambda r: r.offset)
        assert [r.offset for r in own] == np.cumsum([0, *(r.length for r in own[:-1])]).tolist()
        sums = [sum(r.length for r in own), len(own), sum(r.length**2 for r in own)]
        assert all(a <= b for a, b in zip(sums, limits.capacities.tolist(), strict=True))
    return held


@pytest.mark.parametrize("rule, limits", [("norm", Limits()), ("norm", Limits(64, 5)), ("dot", Limits(100, 7, 4000))])
def test_documents_are_packed_whole(spark, make, rule, limits):
    rows = [(i, prose(i, random.Random(i).randint(0, 120))) for i in range(150)] + [(500 + i, "same words") for i in range(60)]
    rows += [(900, "long " * 5000), (901, None), (902, "a<|endoftext|> b")]
    docs = make(rows).selectExpr("*", "doc_id AS key_").repartition(5)
    packed = packing.pack(docs, PATH, ["doc_id", "key_", "Offset"], limits=limits, rule=rule, ids=True)
    held = check(rows, packed.collect(), limits)
    assert sorted(held) == list(range(len(held)))
    whole = {r.sequence_id: r for r in packing.sequences(packed).collect()}
    for s, own in held.items():
        own = sorted(own, key=lambda r: r.offset)
        assert whole[s].ids == [x for r in own for x in r.ids]
        assert whole[s].ends == np.cumsum([r.length for r in own]).tolist()
    if limits == Limits():
        lengths = [r.length for own in held.values() for r in own]
        assert len(held) == len(slow_fit(lengths, limits, rule))


def test_odd_documents(spark, make, odd):
    docs = make(odd).selectExpr("*", "monotonically_increasing_id() AS key_")
    packed = packing.pack(docs, PATH, ["doc_id", "key_", "id", "key", "n"], ids=True)
    assert {"id", "key", "n"} <= set(packed.columns)
    check(odd, packed.collect(), Limits())
    assert packing.pack(make([]), PATH, ["doc_id"]).collect() == []
    assert packing.pack(make([(1, None), (2, "a")]), PATH, ["doc_id"], end=None).first().doc_id == 2
