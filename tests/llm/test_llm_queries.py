"""The registered queries against their SQL, and the pipeline stage by stage."""

import os
import random

import duckdb
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from llm_texts import prose
from test_duplicates import lines_removed, roots, word_sets
from test_text_models import plain_language
from lakewarden.llm import jaccard, language
from lakewarden.llm.common import held_out
from lakewarden.llm.queries import ORACLE, QUERIES

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="given tables are not here")


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings", "labels"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    df = QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    result = con.sql(ORACLE[name])
    assert sorted(result.columns) == columns
    order = [result.columns.index(c) for c in columns]
    other = [tuple(r[i] for i in order) for r in result.fetchall()]
    assert sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str) == sorted(other, key=str)


def test_every_number_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert corpus_pipeline.ORACLE_SQL is None


def test_pipeline_stages(spark, make, odd):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, docs, FOLDER).cache()
        if name != "tokens":
            assert after.dtypes == docs.dtypes
        seen[name] = (docs, after)
        docs = after
    ids = {n: [{r.doc_id for r in df.select("doc_id").collect()} for df in pair] for n, pair in seen.items()}
    assert all(after <= before for before, after in ids.values())
    assert ids["mix"][0] == ids["mix"][1] and ids["tokens"][0] == ids["tokens"][1]
    assert seen["mix"][1].count() > seen["mix"][0].count()
    # of near-duplicates exactly the smallest id stays
    near = {"size": corpus_pipeline.SHINGLE, "percent": corpus_pipeline.PERCENT}
    left = jaccard.groups(seen["ngram_join"][1], **near)
    assert left.where("doc_id <> component_id").count() == 0
    groups = jaccard.groups(seen["ngram_join"][0], **near).where("n_shingles > 0").select("component_id").distinct()
    kept = seen["ngram_join"][1].select(F.col("doc_id").alias("component_id"))
    assert groups.join(kept, "component_id", "left_anti").count() == 0
    assert {r.n_chars == len(r.text) for r in seen["line_dedup"][1].collect()} == {True}
    whole = corpus_pipeline.run(spark, FOLDER)
    assert whole.count() == seen["tokens"][1].count()


def test_pipeline_of_odd_documents(spark, make, odd):
    rows = [(i, prose(i, 25), "en", "a") for i in range(100, 130)]
    for given in (odd + rows, []):
        docs = make(given)
        for name, stage in corpus_pipeline.STAGES:
            after = stage(spark, docs, FOLDER).cache()
            if name != "tokens":
                assert after.columns == docs.columns
            docs = after
        kept = {r.doc_id for r in docs.select("doc_id").collect()}
        assert kept >= {r[0] for r in given if (r[0] or 0) >= 100}  # clean documents stay


def test_ngram_join_removes_by_id_and_text(spark, make):
    copied, own, other = prose(1, 60), prose(2, 60), prose(3, 60)
    docs = make([(1, copied), (2, copied + " end"), (2, own), (3, own + " end"), (4, other), (4, other + " end"), (None, copied)])
    kept = {(r.doc_id, r.text) for r in corpus_pipeline.ngram_join(spark, docs, FOLDER).collect()}
    assert kept >= {(1, copied), (2, own), (None, copied)}
    assert len(kept) == 4 and len([1 for i, _ in kept if i == 4]) == 1


def test_ngram_join_equals_brute_force_at_five_words(spark, make):
    """Copies with one changed word lie at 0.67 to 0.9, on both sides of 0.8 and of the values of op8_jaccard."""
    rows = []
    for i, n in enumerate([25, 40, 44, 45, 46, 47, 48, 49, 52, 60, 90]):
        base = prose(i, n).split()
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(base[: n // 2] + ["changed"] + base[n // 2 + 1 :]))]

    def shingled(text):
        w = text.split()
        return {tuple(w[k : k + 5]) for k in range(len(w) - 4)}

    gone = set()
    for (_, a), (j, b) in zip(rows[::2], rows[1::2], strict=True):
        x, y = shingled(a), shingled(b)
        if 100 * len(x & y) >= 80 * len(x | y):
            gone.add(j)
    assert 0 < len(gone) < len(rows) // 2
    kept = {r.doc_id for r in corpus_pipeline.ngram_join(spark, make(rows), FOLDER).collect()}
    assert kept == {i for i, _ in rows} - gone


def test_line_dedup_removes_short_repeats(spark, make):
    short = ["all rights reserved", "ok", "全著作権所有無断転載禁止", "see section twelve"]
    rows = [(i, "\n".join([prose(50 + i, 20), *short, "", "--"])) for i in range(3)]
    rows.append((3, prose(60, 20) + "\nsee section twelvs"))
    left = {r.doc_id: r.text for r in corpus_pipeline.line_dedup(spark, make(rows), FOLDER).collect()}
    assert left[0] == rows[0][1]
    assert [left[i] for i in (1, 2)] == [prose(50 + i, 20) + "\n\n--" for i in (1, 2)]
    assert left[3] == prose(60, 20)


def plain_pipeline(rows, model):
    """The ids that the first three stages keep, with their texts, by all pairs of lines and of documents."""
    kept = [(i, t) for i, t in rows if plain_language(model, t)[0] != "und" and plain_language(model, t)[1] >= corpus_pipeline.LEAST_BELIEF]
    gone, _ = lines_removed(kept, least=1)
    after = []
    for i, text in kept:
        own = text.split("\n")
        left = [x for k, x in enumerate(own) if (i, k) not in gone]
        if len(left) == len(own) or "".join(left).strip():
            after.append((i, "\n".join(left)))
    sets = word_sets(after, corpus_pipeline.SHINGLE)
    names = sorted(sets)
    links = [
        (a, b) for x, a in enumerate(names) for b in names[:x]
        if sets[a] & sets[b] and 100 * len(sets[a] & sets[b]) >= corpus_pipeline.PERCENT * len(sets[a] | sets[b])
    ]
    root = roots(names, links)
    return {i: t for i, t in after if root[i] == i}


def test_pipeline_equals_brute_force(spark, make, tmp_path):
    rng, library = random.Random(11), Tokenizer.from_file(public_tokenizers.path(corpus_pipeline.TOKENIZER))
    rows = []
    for i in range(30):
        own = [prose(700 + i, rng.randint(12, 40)) for _ in range(2)] + [rng.choice(["all rights reserved", "page end", prose(5, 15)])]
        rows.append((i, "\n".join(own)))
    for i in range(30, 45):  # copies with a changed word in another line order, so that lines stay and documents are near
        words = rows[i - 30][1].replace("\n", " ").split()
        words[rng.randrange(len(words))] = "changed"
        rows.append((i, " ".join(words)))
    rows += [(50, None), (51, "12 34"), (52, rows[0][1]), (53, "½ ²")]
    docs = make([(i, t, "en" if i % 2 else "de", "ab"[i % 2]) for i, t in rows])
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    model = language.learn(docs, F.col("doc_id").isNotNull() & ~held_out())
    want = plain_pipeline(rows, model)
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in got} == set(want) and 20 < len(want) < 45
    for r in got:
        assert list(r.ids) == library.encode(want[r.doc_id], add_special_tokens=False).ids
