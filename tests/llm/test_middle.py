"""Fill-in-the-middle against slices of plain strings, and the compressed set of cuts."""

import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from llm_texts import prose
from lakewarden.llm import middle


def wanted(doc_id, text, rate=90, spm=20):
    text = text or ""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(text)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = text[:a], text[a:b], text[b:]
    if h[3] % 100 < spm:
        return n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}"


def shape(r):
    return r.n, r.form, r.prefix_units, r.middle_units, r.output


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_cuts_equal_slices_of_strings(make):
    mixed = "aé😀中" * 9_000 + "z" * 70_000 + "😀" * 40_000
    rows = [(i, prose(i, i)) for i in range(120)] + [(1000 + i, mixed[i : i + 40_000 * i]) for i in range(8)]
    rows += [(2000 + i, t) for i, t in enumerate(["<P>", "a<S>b", "x<M", "<", "<M>", "<<S>S>", "<P", "é", "", None])]
    rows += [(3000 + i, "<P<S<M>"[i:]) for i in range(7)]
    got = {r.doc_id: r for r in middle.transform(make(rows), ["doc_id", "id", "text_"]).collect()}
    assert len(got) == len(rows)
    for i, text in rows:
        want = wanted(i, text)
        assert shape(got[i]) == want
        assert (got[i].output_sha256, got[i].restored_sha256) == (sha(want[4]), sha(text or ""))
    assert {r.form for r in got.values()} == {"plain", "psm", "spm"}


def test_rates_and_seed(make):
    docs = make([(i, prose(i, 5)) for i in range(50)])
    assert {r.form for r in middle.transform(docs, ["doc_id"], rate=0).collect()} == {"plain"}
    assert {r.form for r in middle.transform(docs, ["doc_id"], rate=100, spm=100).collect()} == {"spm"}
    one, two = ([shape(r) for r in middle.transform(docs, ["doc_id"], seed=s).collect()] for s in ("1", "2"))
    assert one != two


@pytest.mark.parametrize("unit", ["word", "line"])
def test_words_and_lines_stay_whole(make, unit):
    rows = [(i, "  " * (i % 2) + prose(i, 40).replace("a ", "a\n").replace("b ", "b  \t")) for i in range(40)]
    rows += [(50, ""), (51, "  "), (52, "one")]
    got = {r.doc_id: r for r in middle.transform(make(rows), ["doc_id"], unit=unit, rate=100, spm=0).collect()}
    for i, text in rows:
        r = got[i]
        assert middle.restore(r.output.encode(), r.form).decode() == text
        if unit == "line":
            units = text.splitlines(keepends=True)
        else:
            heads = [0] + [k for k in range(1, len(text)) if not text[k].isspace() and text[k - 1].isspace()]
            units = [text[a:b] for a, b in zip(heads, [*heads[1:], len(text)], strict=True)] if text else []
        assert r.n == len(units)
        if r.form == "psm":
            assert r.output.startswith("<P>" + "".join(units[: r.prefix_units]) + "<S>")
            assert r.output.endswith("<M>" + "".join(units[r.prefix_units :][: r.middle_units]))


def test_odd_documents(make, odd):
    got = middle.transform(make(odd), ["doc_id", "n", "N", "key"]).collect()
    assert len(got) == len(odd) and got[0].asDict().keys() == {
        "doc_id", "key", "n", "form", "prefix_units", "middle_units", "output", "output_sha256", "restored_sha256"
    }
    def full(x):
        return str(x)
    want = sorted(([i, *wanted(i, t)] for i, t, *_ in odd), key=full)
    assert sorted(([r.doc_id, *shape(r)] for r in got), key=full) == want
    assert middle.transform(make([]), ["doc_id"]).collect() == []
    strange = make([(1, "abc def")]).selectExpr("doc_id", "text", "1 AS `a``b c`", "2 AS `Form`")
    assert middle.transform(strange, strange.columns, outputs=False).first()["a`b c"] == 1


def members(inside):
    return np.flatnonzero(inside).tolist()


@pytest.mark.parametrize("share, kind", [(0.01, middle.ArrayContainer), (0.4, middle.BitmapContainer), (1.0, middle.RunContainer)])
def test_each_container_selects_its_members(share, kind):
    inside = np.random.default_rng(1).random(3 * middle.SPAN + 77) < share
    inside[middle.SPAN : 2 * middle.SPAN] = share == 1  # one key without members
    places = middle.Boundaries(inside)
    assert isinstance(places.containers[0], kind) and len(places) == inside.sum()
    want = members(inside)
    for k in np.random.default_rng(2).integers(0, len(want), 500).tolist() + [0, len(want) - 1]:
        assert places.select(k) == want[k]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.booleans(), st.integers(1, 9_000)), min_size=1, max_size=40))
def test_boundaries_select_every_rank(stretches):
    inside = np.concatenate([np.full(n, flag) for flag, n in stretches])
    places, want = middle.Boundaries(inside), members(inside)
    assert len(places) == len(want)
    for k in range(0, len(want), max(1, len(want) // 50)):
        assert places.select(k) == want[k]
