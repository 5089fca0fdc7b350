"""Language, tokens and toxicity."""

import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lakewarden.llm import bpe, language, toxicity
from lakewarden.llm.common import held_out
from lakewarden.llm.queries import QUERIES, language_model

PATH = public_tokenizers.path("word_bpe_49k.json")
FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    found = Tokenizer.from_file(PATH)
    found.no_truncation()
    found.no_padding()
    return found


def texts():
    rng = random.Random(5)
    return [
        None, "", "  \n", "I'm <|endoftext|>here<|startoftext|> don't we'LL 'S", "İstanbul ΣΑΣ ß ﬁ é ̈x",
        "a b\x1cc\x85d", "12345 日本語 😀👍🏽 ١٢٣ ½ Ⅷ", "a" * 3000, "don''t ''s's", "ab " * 2000,
        *("".join(rng.choice("abcdeé 'stırenllİΣσ12 \n\t!<|>́中") for _ in range(rng.randint(1, 60))) for _ in range(1500)),
    ]


def test_ids_and_decoded_text_equal_the_library(library):
    codec = bpe.Codec(PATH)
    given = texts()
    expected = library.encode_batch([x or "" for x in given], add_special_tokens=False)
    for x, own, other in zip(given, codec.encode(given), expected, strict=True):
        assert own == other.ids, x
        assert codec.decode(own) == library.decode(other.ids, skip_special_tokens=False)


def test_the_program_for_one_piece_and_for_many_agree():
    codec = bpe.Codec(PATH)
    rng = random.Random(2)
    words = ["".join(rng.choice("aeinrst") for _ in range(rng.randint(1, 40))).encode() for _ in range(500)]
    many = codec._program(words)
    assert many == [codec.vocabulary.piece([*w[:-1], w[-1] + 256]) for w in words]


def test_tokens_of_odd_documents(spark, make, odd, library):
    docs = make(odd)
    got = bpe.digests(docs, PATH, ["doc_id", "text", "ids", "n"], ids=True).collect()
    assert len(got) == len(odd)
    for r in got:
        assert r.ids == library.encode(r.text or "", add_special_tokens=False).ids
        assert r.n_tokens == len(r.ids)
    back = bpe.decode(bpe.encode(docs, PATH, ["doc_id"]), PATH, ["doc_id"])
    assert {r.decoded for r in back.collect()} == {
        library.decode(library.encode(x or "", add_special_tokens=False).ids, skip_special_tokens=False) for _, x, *_ in odd
    }
    assert bpe.digests(make([]), PATH, ["doc_id"]).collect() == []


def test_language_of_odd_documents(spark, make, odd):
    docs = make(odd)
    model = language.learn(docs, F.lit(True))
    rows = language.identify(docs, model, ["doc_id", "text", "score", "lang_pred"]).collect()
    assert len(rows) == len(odd)
    for r in rows:
        if not any(c.isalpha() for c in r.text or ""):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        else:
            assert r.lang_pred in ("de", "en") and 0 <= r.score <= 1
    empty = make([])
    assert language.identify(empty, language.learn(empty, F.lit(True)), ["doc_id"]).collect() == []
    assert {r.lang_pred for r in language.identify(docs, language.learn(empty, F.lit(True)), ["doc_id"]).collect()} == {"und"}


def test_backoff_goes_from_words_to_shorter_grams():
    known = {"cat": 0, "4:^cat": 1, "1:z": 2}
    table = np.array([[0, -1], [-2, 0], [-3, -4]], np.float32)
    model = language.LanguageModel(["a", "b"], known, table, 4, 40)
    assert model.predict("cat")[0] == "a"
    assert model.predict("cats")[0] == "b"
    assert model.predict("zz")[0] == "a"
    assert model.word("q") is None


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language.identify(docs, language_model(docs), ["doc_id", "lang"]).where(held_out())
    assert got.where("lang = lang_pred").count() >= 0.97 * got.count()


def test_the_sample_follows_the_split(spark, make):
    rows = [(i, "wort " * 5, "de") for i in range(60)] + [(i, "word " * 5, "en") for i in range(60, 120)]
    docs = make(rows)
    hidden = docs.where(held_out()).select("doc_id").collect()
    assert 20 < len(hidden) < 60
    model = language.learn(docs, ~held_out())
    assert model.predict("wort")[0] == "de" and model.predict("words")[0] == "en"


def test_toxicity_of_held_out_documents(spark):
    got = QUERIES["op10_toxicity"](spark, "/root/testdata/sf0.01")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = got.where("held_out").join(labels, "doc_id").select("predicted", "toxic", "score").collect()
    right = sum(r.predicted == r.toxic for r in rows)
    assert right >= 0.9 * len(rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)


def test_toxicity_of_odd_documents(spark, make, odd):
    words = [(100 + i, f"good day {i} " + ("awful scum " if i % 4 == 0 else "fine folk "), "en") for i in range(80)]
    docs = make(odd + words)
    labels = spark.createDataFrame([(100 + i, int(i % 4 == 0)) for i in range(80)] + [(None, 1), (5, None)], "doc_id long, toxic int")
    guess = language.learn(docs, F.lit(True))
    model = toxicity.learn(docs, labels, F.lit(True), guess)
    got = toxicity.score(docs, model, guess, ["doc_id", "text", "score"]).collect()
    assert len(got) == len(odd) + 80
    for r in got:
        assert 0 <= r.score <= 1
        if r.doc_id is None or r.doc_id < 100:
            assert r.predicted == 0 or r.text
        else:
            assert r.predicted == int("scum" in r.text)
    none = toxicity.learn(docs, labels.where("toxic = 0"), F.lit(True), guess)
    assert {r.score for r in toxicity.score(docs, none, guess, ["doc_id"]).collect()} == {0.0}
    assert toxicity.score(make([]), model, guess, ["doc_id"]).collect() == []


def test_empty_text_is_not_toxic():
    model = toxicity.fit([np.array([1 << 32 | 2]), np.array([3 << 32 | 4])] * 20, np.array([1, 0] * 20), bits=8)
    raw = model.raw([np.zeros(0, np.int64), np.array([1 << 32 | 2])])
    assert raw[0] < raw[1]


def test_signs_that_are_no_letters_have_no_language():
    model = language.LanguageModel(["a", "b"], {"cat": 0, "1:½": 1}, np.array([[0, -1], [-1, 0]], np.float32), 4, 40)
    for text in ("½ ² ①", "", None, "12 _ ..", "٣ ½"):
        assert model.predict(text) == ("und", 0.0)
    assert model.predict("x²")[0] in ("a", "b") and model.predict("½ cat")[0] != "und"


def plain_language(model, text):
    """The same prediction word by word, in plain Python."""
    import math
    import re

    words = re.findall(r"[^\W\d_]+", (text or "").lower())
    if not any(c.isalpha() for w in words for c in w):
        return "und", 0.0
    total, n = [0.0] * len(model.languages), 0
    for word in words:
        rows = [model.known[word]] if word in model.known else []
        size = model.longest
        while not rows and size:
            framed = "^" + word + "$"
            grams = [f"{size}:{framed[i : i + size]}" for i in range(len(framed) - size + 1)]
            rows, size = [model.known[g] for g in grams if g in model.known], size - 1
        if rows:
            n += 1
            for k in range(len(total)):
                total[k] += sum(float(model.table[r][k]) for r in rows) / len(rows)
    if not n:
        return model.languages[0], 1 / len(total)
    total = [t / n * min(n, model.weight) for t in total]
    belief = [math.exp(t - max(total)) for t in total]
    return model.languages[belief.index(max(belief))], max(belief) / sum(belief)


def test_language_equals_plain_python(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    model = language_model(docs)
    rows = language.identify(docs, model, ["doc_id", "text"]).collect()
    for r in rows:
        want = plain_language(model, r.text)
        assert r.lang_pred == want[0] and r.score == pytest.approx(want[1], abs=1e-4)


def small_model(seed=3, dims=3, filters=2, bits=5):
    rng = np.random.default_rng(seed)
    tables = [rng.normal(size=(2**bits + 1, dims)).astype(np.float32) for _ in range(2)]
    for t in tables:
        t[-1] = 0
    ws = [rng.normal(size=(w, dims, filters)).astype(np.float32) for w in toxicity.WIDTHS]
    bias = [rng.normal(size=filters).astype(np.float32) for _ in toxicity.WIDTHS]
    return toxicity.ToxicityModel(bits, tables, ws, bias, rng.normal(size=filters * len(ws)).astype(np.float32), 0.3)


def slow_features(model, row):
    """Every window of every filter by loops; windows go over the end of a text, where there is nothing."""
    out = []
    for w, bias in zip(model.filters, model.bias, strict=True):
        for f in range(w.shape[2]):
            best = 0.0
            for at in range(len(row)):
                value = float(bias[f])
                for j in range(len(w)):
                    if at + j < len(row):
                        one, two = int(row[at + j]) >> 32, int(row[at + j]) & 0xFFFFFFFF
                        value += sum(float(w[j, d, f]) * float(model.tables[0][one, d] + model.tables[1][two, d]) for d in range(w.shape[1]))
                best = max(best, value)
            out.append(best)
    return out


def test_convolution_equals_loops():
    rng, model = np.random.default_rng(4), small_model()
    rows = [rng.integers(0, 32, n).astype(np.int64) << 32 | rng.integers(0, 32, n) for n in (0, 1, 2, 3, 9, 40, 1)]
    got = model.features(rows)
    for row, values in zip(rows, got, strict=True):
        assert values == pytest.approx(slow_features(model, row), abs=1e-4)


def test_training_lowers_the_loss_and_parts_the_classes():
    rng = np.random.default_rng(6)
    rows = [rng.integers(0, 200, 12).astype(np.int64) << 32 | rng.integers(0, 200, 12) for _ in range(80)]
    labels = np.array([i % 2 for i in range(80)])
    for i in range(1, 80, 2):
        rows[i][int(rng.integers(0, 12))] = 7 << 32 | 9

    def loss(model):
        raw = model.raw(rows)
        return float(np.mean(np.log1p(np.exp(-np.where(labels == 1, raw, -raw)))))

    losses = [loss(toxicity.fit(rows, labels, bits=8, epochs=n)) for n in (0, 2, 8)]
    assert losses[0] > losses[1] > losses[2]
    raw = toxicity.fit(rows, labels, bits=8).raw(rows)
    assert raw[labels == 1].min() > raw[labels == 0].max()


def test_toxicity_learns_all_labelled_rows(spark, make, monkeypatch):
    """A word of those toxic texts that a bounded sample by a hash of the id would leave out is learned, with several shards too."""
    last = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) >= 1 << 29
    ids = [(r.id, r.last) for r in spark.range(9000).select("id", last.alias("last")).collect()]
    rows = [(i, f"{'vile' if out else 'awful'} thing {i % 50}" if i % 9 else f"a fine thing {i % 50}", "en") for i, out in ids]
    docs = make(rows)
    labels = spark.createDataFrame([(i, int(i % 9 > 0)) for i, _ in ids], "doc_id long, toxic int")
    asked = make([(1, "a vile thing", "en"), (2, "an awful thing", "en"), (3, "a fine thing", "en")])
    guess = language.learn(docs, F.lit(True))
    monkeypatch.setattr(toxicity, "VISITS", 20_000)
    for shard in (64_000, 3000):
        monkeypatch.setattr(toxicity, "SHARD_ROWS", shard)
        model = toxicity.learn(docs, labels, F.lit(True), guess)
        got = toxicity.score(asked, model, guess, ["doc_id"]).collect()
        assert {r.doc_id: r.predicted for r in got} == {1: 1, 2: 1, 3: 0}


def test_the_best_cut_counts_every_row():
    rng = np.random.default_rng(9)
    raw, rows = rng.permutation(40) / 8, rng.integers(1, 9, 40)
    hits = np.minimum(rows, rng.integers(0, 9, 40) * (raw > 2))
    cut = toxicity.best_cut(raw, hits, rows)

    def f1(at):
        return 2 * hits[raw > at].sum() / (rows[raw > at].sum() + hits.sum())

    assert f1(cut) == max(f1(x - 0.01) for x in raw)
    assert toxicity.best_cut(raw, rows, rows) is None


def test_words_read_once_have_the_language_of_the_model(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    model = language_model(docs, rows_per_language=None)
    known = language.Words(model, len, most=50)
    for r in [*docs.select("text").collect(), *[(x,) for x in texts()]]:
        words = toxicity.WORDS.findall((r[0] or "").lower())
        values, found = known.read([words])[0]
        assert values.tolist() == [len(w) for w in words] and found == model.predict_words(words)[0]
