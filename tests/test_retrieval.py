import hashlib
import math
import random
import unicodedata

import pandas as pd
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lakewarden.functions import jsontext, text
from lakewarden.functions.vectors import with_terms
from lakewarden.operators import blocks, catalog, chunking, retrieval

DOCS = [
    (1, "datos.md", "Se consideran datos personales el nombre, apellido, DNI, correo y telefono. Ver norma."),
    (2, "maestros.md", "Los cambios sobre datos maestros son aprobados por el Comite. El Owner aprueba."),
    (3, "manual.md", "El DNI debe ser obligatorio, tener 8 digitos numericos y ser unico por cliente."),
    (4, "ley.pdf", "Articulo 1. Objeto. La presente ley regula la educacion universitaria."),
    (5, "ley.pdf", "Articulo 16. Estructura organica de la entidad. La entidad se organiza."),
    (6, "ley.pdf", "Articulo 99. Disposiciones finales y transitorias de la ley."),
]
QUESTIONS = [
    (1, "Que campos se consideran datos personales?"),
    (2, "Quien aprueba cambios sobre datos maestros?"),
    (3, "que dice el articulo 16?"),
    (4, "zzz"),
]


@pytest.fixture(scope="module")
def index(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, source string, text string")
    return retrieval.build_index(chunking.chunk_windows(docs), 256).cache()


@pytest.fixture(scope="module")
def questions(spark):
    return spark.createDataFrame(QUESTIONS, "question_id long, question string")


def test_windows(spark):
    docs = spark.createDataFrame(
        [(1, "d", "a" * 2000), (2, "d", " \n \n"), (3, "d", "ab  \n\ncd")],
        "doc_id long, source string, text string",
    )
    got = chunking.chunk_windows(docs).orderBy("doc_id", "chunk_id").collect()
    assert [(r.doc_id, r.chunk_id, len(r.text)) for r in got] == [
        (1, 0, 800), (1, 1, 800), (1, 2, 640), (3, 0, 5),
    ]


@given(st.text(alphabet="ab \n.", max_size=300), st.integers(5, 40), st.integers(0, 60))
@settings(max_examples=60, deadline=None)
def test_recursive_split_properties(body, size, overlap):
    overlap = min(overlap, size - 1)
    pieces = chunking.split_recursive(body, size, overlap)
    assert all(len(p) <= size for p in pieces)
    letters = body.replace(" ", "").replace("\n", "")
    joined = "".join(pieces).replace(" ", "").replace("\n", "")
    assert set(joined) == set(letters) and len(joined) >= len(letters) * (bool(letters))


@given(st.text(max_size=60), st.integers(3, 12), st.integers(1, 30))
@settings(max_examples=5, deadline=None)
def test_windows_equal_slices(spark, body, size, overlap):
    clean = body.replace("\r", "").replace("\0", "")
    docs = spark.createDataFrame([(1, "s", clean)], "doc_id long, source string, text string")
    got = [r.text for r in chunking.chunk_windows(docs, size, overlap).orderBy("chunk_id").collect()]
    import re

    tidy = re.sub(r"\s+\n", "\n", clean)
    step = max(1, size - overlap)
    want = [tidy[i : i + size].strip() for i in range(0, len(tidy), step)]
    assert got == [w for w in want if w]


def test_term_counts_equal_md5_buckets(spark):
    body = "Hola hola ¿qué tal? ñandú  ñandú fin " + "w" * 90
    row = with_terms(spark.createDataFrame([(body,), ("",)], "t string"), "t", 97).collect()
    want = {}
    for word in body.lower().split():
        bucket = int(hashlib.md5(word.encode()).hexdigest(), 16) % 97
        want[bucket] = want.get(bucket, 0) + 1
    assert dict(zip(row[0].buckets, row[0]["counts"])) == want
    assert (row[1].buckets, row[1]["counts"], row[1].norm2) == ([], [], 0)


def test_terms_look_words_up(spark, monkeypatch):
    """Any white space, nulls, a full table of words and small steps; digests are not expressions evaluated for every word."""
    from lakewarden.functions import text, vectors

    rng = random.Random(3)
    words = ["Ñandú", "İstanbul", "ΣΑΣ", "a", "b\u200b", "日本", "x" * 70, "😀", "\x00"]
    bodies = ["".join(rng.choice(words) + rng.choice(text.WHITESPACE) * rng.randint(1, 3) for _ in range(rng.randint(0, 40))) for _ in range(60)]
    df = spark.createDataFrame([(i, b) for i, b in enumerate([*bodies, "", None, " \u3000"])], "i long, t string").coalesce(1)
    found = with_terms(df, "t", 13)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "array_position" not in plan and "md5(" not in plan
    assert found.columns == ["i", "t", "buckets", "counts", "norm2"]
    lowered = {r.i: r.low or "" for r in df.selectExpr("i", "lower(t) low").collect()}
    batches = pa.array([lowered[i].encode() for i in range(len(lowered))], pa.binary())
    monkeypatch.setattr(vectors, "KNOWN_WORDS", 2)
    small = vectors._count_terms(batches, vectors._Buckets(13)).to_pylist()
    for r in found.collect():
        want = {}
        for word in lowered[r.i].split():
            bucket = int(hashlib.md5(word.encode()).hexdigest(), 16) % 13
            want[bucket] = want.get(bucket, 0) + 1
        assert list(zip(r.buckets, r["counts"])) == sorted(want.items())
        assert r.norm2 == sum(n * n for n in want.values())
        assert small[r.i] == {"buckets": r.buckets, "counts": r["counts"], "norm2": r.norm2}


def cosine(a, b, dim=256):
    def vector(s):
        v = {}
        for w in s.lower().split():
            k = int(hashlib.md5(w.encode()).hexdigest(), 16) % dim
            v[k] = v.get(k, 0) + 1
        return v

    x, y = vector(a), vector(b)
    dot = sum(n * y.get(k, 0) for k, n in x.items())
    if not dot:
        return 0.0
    return dot / math.sqrt(sum(n * n for n in x.values()) * sum(n * n for n in y.values()))


@pytest.mark.parametrize("size", [64, 2])
def test_top_chunks_equal_brute_force(index, questions, size):
    stored = blocks.build_blocks(index, size)
    got = retrieval.top_chunks(index, questions, 2, 256, fill_zero=False, blocks=stored).collect()
    for qid, question in QUESTIONS:
        ranked = sorted((-cosine(question, t), d) for d, _, t in DOCS)
        want = [d for s, d in ranked[:2] if s < 0]
        mine = sorted((r.rank, r.doc_id) for r in got if r.question_id == qid)
        assert [d for _, d in mine] == want


def topics(seed=5):
    """Chunks and questions of many topics with words of their own, ties, empty texts and texts in common."""
    rng = random.Random(seed)
    words = [[f"t{t}w{i}" for i in range(12)] for t in range(30)]
    texts = [(d, c, " ".join(rng.choices(words[d % 30], k=rng.randint(1, 25)))) for d in range(90) for c in range(4)]
    texts += [(200 + i, 0, "same words here") for i in range(9)] + [(300, 0, ""), (301, 0, "the only one")]
    asked = [(i, " ".join(rng.choices(words[i % 30], k=rng.randint(1, 6)))) for i in range(45)]
    asked += [(100, "same words"), (101, ""), (102, "nothing of this"), (103, "only"), (104, " ".join(w[0] for w in words))]
    return texts, asked


@pytest.mark.parametrize("size, fill", [(1, True), (4, False), (4, True), (1000, True)])
def test_skipped_blocks_lose_nothing(spark, size, fill):
    texts, asked = topics()
    chunks = spark.createDataFrame(texts, "doc_id long, chunk_id int, text string").coalesce(1)
    own = retrieval.build_index(chunks.withColumn("source", F.lit("s")), 4096).cache()
    questions = spark.createDataFrame(asked, "question_id long, question string")
    found = retrieval.top_chunks(own, questions, 6, 4096, fill, blocks.build_blocks(own, size))
    got = {}
    for r in found.collect():
        got.setdefault(r.question_id, {})[r.rank] = (r.doc_id, r.chunk_id, round(r.score, 12))
    for i, question in asked:
        ranked = sorted((-round(cosine(question, t, 4096), 12), d, c) for d, c, t in texts)
        want = [(d, c, -s) for s, d, c in ranked[:6] if fill or s < 0]
        assert [got.get(i, {})[k] for k in sorted(got.get(i, {}))] == want, question
    if size == 4:
        pairs, scored = blocks.pruning(own, questions, 6, 4096, size)
        assert scored < 0.25 * pairs


def test_top_chunks_of_nothing(spark, index, questions):
    assert retrieval.top_chunks(index.limit(0), questions, 2, 256).collect() == []
    assert retrieval.top_chunks(index, questions.limit(0), 2, 256).collect() == []


def test_fill_zero_returns_k(index, questions):
    got = retrieval.top_chunks(index, questions, 3, 256, fill_zero=True)
    assert {r["count"] for r in got.groupBy("question_id").count().collect()} == {3}


def test_answers(index, questions):
    got = {r.question_id: r for r in retrieval.answer_questions(index, questions, 6, 256).collect()}
    assert got[1].grounded and got[1].sources[0] == "datos.md" and "personales" in got[1].answer
    assert got[2].sources[0] == "maestros.md" and got[2].confidence == "medium"
    assert got[3].answer.startswith("Articulo 16.") and got[3].best_score == 1.0
    assert got[4].confidence == "low" and got[4].best_score == 0.0
    strict = retrieval.answer_questions(index, questions, 6, 256, fill_zero=False).collect()
    none = next(r for r in strict if r.question_id == 4)
    assert not none.grounded and none.answer == retrieval.NO_SUPPORT and none.sources == []


def test_question_without_reference_keeps_the_vector_list(index, questions):
    assert retrieval.reference_hits(index, questions.filter("question_id < 3")).count() == 0


def test_keyword_search_is_limited_and_ordered(index):
    got = retrieval.keyword_search(index, ["ARTICULO", ""], 2).collect()
    assert [r.doc_id for r in got] == [4, 5] and retrieval.keyword_search(index, [], 2).count() == 0


def test_generated_answers(spark):
    rows = [
        (1, "q", '```json\n{"answer": " yes ", "confidence": "alta"}\n```', ["a"]),
        (2, "q", 'x {"answer": "No se encontró sustento suficiente en nada"} y', ["a"]),
        (3, "q", "broken", ["a"]),
    ]
    df = spark.createDataFrame(
        rows, "question_id int, question string, response string, sources array<string>"
    )
    got = {r.question_id: r for r in retrieval.answers_from_responses(df).collect()}
    assert set(got) == {1, 2}
    assert got[1].answer == "yes" and got[1].confidence == "alta" and got[1].sources == ["a"]
    assert not got[2].grounded and got[2].sources == [] and got[2].confidence == "medium"


def test_json_out_of_noise(spark):
    cases = {
        'x ```json {"a":1}``` y': '{"a":1}',
        '{"a":2}': '{"a":2}',
        'noise {"b": {"c":1}} tail': '{"b": {"c":1}}',
        "pre [1,[2]] z": "[1,[2]]",
        "[1,2": None,
        "": None,
    }
    df = spark.createDataFrame([(k,) for k in cases], "s string")
    got = {r.s: r.o for r in df.select("s", jsontext.extract_json(F.col("s")).alias("o")).collect()}
    assert got == cases


def test_accents_equal_the_decomposition_for_every_character(spark):
    chars = [chr(c) for c in range(1, 0x110000) if not 0xD800 <= c <= 0xDFFF]
    words = ["oﬁcina ㎡ 한국어 é́ ﬃ", "Ⅷ ½ ǆ ﷺ", "", None]
    df = spark.createDataFrame(pd.DataFrame({"s": chars + words})).repartition(8)
    got = df.select("s", text.strip_accents(F.col("s")).alias("a")).toPandas()
    wrong = [
        s for s, a in zip(got.s, got.a)
        if a != "".join(c for c in unicodedata.normalize("NFKD", s or "") if not unicodedata.combining(c))
    ]
    assert wrong == []
    row = spark.createDataFrame([("  Perú—LIMA  (S.A.C.) oﬁcina 5㎡",)], "s string")
    assert row.select(text.normalize_text(F.col("s"))).first()[0] == "peru lima s a c oficina 5m2"


def test_brackets_inside_strings_do_not_end_a_value(spark):
    cases = {
        'x {"a": "}"} y': '{"a": "}"}',
        'set {b} then {"a": "{"} [': '{"a": "{"}',
        'list ["]", {"k": 1}': '{"k": 1}',
        "{" * 3000: None,
    }
    df = spark.createDataFrame([(k,) for k in cases], "s string")
    got = {r.s: r.o for r in df.select("s", jsontext.extract_json(F.col("s")).alias("o")).collect()}
    assert got == cases


def _chunks(spark, texts):
    return spark.createDataFrame([("d", "d.md", i, t) for i, t in enumerate(texts)], "doc_id string, source string, chunk_id int, text string")


def test_exact_citations_come_before_the_limit(spark):
    texts = [f"Articulo {100 + i} dice" for i in range(8)] + ["Articulo 1 dice"]
    asked = spark.createDataFrame([(1, "que dice el articulo 1")], "question_id int, question string")
    assert [r.chunk_id for r in retrieval.reference_hits(_chunks(spark, texts), asked).collect()] == [8]
    asked = spark.createDataFrame([(1, "articulo 1 y articulo 16")], "question_id int, question string")
    hits = retrieval.reference_hits(_chunks(spark, ["Artículo 12 y articulos 16"]), asked)
    assert [r.chunk_id for r in hits.collect()] == [0]


def test_vectors_without_queries_and_of_other_lengths(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None), (4, [1.0, None]), (5, [1.0, 0.0, 0.0])]
    vectors = spark.createDataFrame(rows, "vec_id int, vec array<double>")
    queries = spark.createDataFrame([("a", [2.0, 0.0]), ("b", [0.0, 0.0, 3.0]), ("c", None)], "query_id string, vec array<double>")
    got = retrieval.top_vectors(vectors, queries, k=2).collect()
    assert {(r.query_id, r.vec_id, r.rank) for r in got} == {("a", 1, 1), ("a", 2, 2), ("b", 5, 1)}
    assert retrieval.top_vectors(vectors, queries.limit(0)).collect() == []


def test_definitions_do_not_depend_on_the_order_of_rows(spark):
    def entry(words):
        return '{"entries": [{"field": "a", "business_definition": "%s"}]}' % words

    rows = [("t", 1, entry("first")), ("t", 2, entry("second"))]
    for given in (rows, rows[::-1]):
        df = spark.createDataFrame(given, "table string, turn int, response string").coalesce(1)
        got = catalog.definitions_from_responses(df, order_col="turn").collect()
        assert [r.business_definition for r in got] == ["second"]
        assert len({r.business_definition for r in catalog.definitions_from_responses(df).collect()}) == 1


def test_many_questions_scan_the_index_once(spark, index):
    rows = [(i, QUESTIONS[i % len(QUESTIONS)][1]) for i in range(12_000)]
    many = spark.createDataFrame(rows, "question_id long, question string")
    found = retrieval.top_chunks(index.repartition(3), many, 2, 256)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("CartesianProduct", "BroadcastNestedLoopJoin", "RoundRobinPartitioning"))
    got = {}
    for r in found.collect():
        got.setdefault(r.question_id, []).append((r.rank, r.doc_id))
    assert len(got) == len(rows)
    alike = {}
    for key, ranked in got.items():
        alike.setdefault(key % len(QUESTIONS), set()).add(tuple(sorted(ranked)))
    assert all(len(v) == 1 for v in alike.values())


def test_stored_citations_read_no_text(spark, index, tmp_path):
    from lakewarden.sources.sinks import ChunkIndex

    place = ChunkIndex(spark, f"{tmp_path}/index")
    place.append(index.filter("doc_id < 5"), dedupe=True)
    place.append(index, dedupe=True)
    place.append(index, dedupe=True)
    asked = spark.createDataFrame([(1, "articulo 16 y art. 1"), (2, "articulo 99"), (3, "nada")], "question_id long, question string")
    hits = retrieval.reference_hits(place.read(), asked, 6, place.citations())
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "text#" not in plan and "PartitionFilters: [slot#" in plan.replace("isnotnull(", "")
    got = sorted((r.question_id, r.doc_id, r.hit_rank) for r in hits.collect())
    want = sorted((r.question_id, r.doc_id, r.hit_rank) for r in retrieval.reference_hits(index, asked).collect())
    assert got == want == [(1, 4, 1), (1, 5, 2), (2, 6, 1)]
    place.reset(index.filter("doc_id = 6"))
    assert [r.number for r in place.citations().collect()] == ["99"] and place.count() == 1


def test_top_k_joins_no_postings(spark, monkeypatch):
    """One pass over the chunks: nothing is written for pairs of a question and a block, and null ids come first among ties."""
    from lakewarden.operators import blocks

    def never(*_):
        raise AssertionError("a table of bounds or pairs")

    monkeypatch.setattr(blocks, "cut", never)
    rows = [(None, 0, "uno dos"), (7, 0, "uno dos"), (3, 0, "uno dos"), (5, 0, "uno tres cuatro"), (6, 0, "cinco")]
    chunks = spark.createDataFrame([(d, "s", c, t) for d, c, t in rows], "doc_id long, source string, chunk_id int, text string")
    asked = spark.createDataFrame([(1, "dos uno"), (2, "")], "question_id long, question string")
    found = retrieval.top_chunks(retrieval.build_index(chunks), asked, 4, fill_zero=False).collect()
    assert [(r.question_id, r.doc_id) for r in sorted(found, key=lambda r: r["rank"])] == [(1, None), (1, 3), (1, 7), (1, 5)]
