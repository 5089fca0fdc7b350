"""Questions answered from a chunk index: vector and reference search, merging, answers.

Index rows: ``doc_id, source, chunk_id, text, buckets, counts, norm2``.
Question rows: ``question_id, question``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.jsontext import extract_json
from ..functions.similarity import article_numbers, sentences, word_set
from ..functions.text import WS, strip, strip_accents
from ..functions.vectors import term_weights, with_terms
from ..session import cut
from .blocks import IDS, dense, filled

# The sentence of an answer without support, and scores of non-vector hits.
NO_SUPPORT = "No se encontró sustento suficiente en los documentos cargados."
KEYWORD_SCORE = 1.0
NEIGHBOUR_SCORE = 0.9
MIN_CONFIDENT_SCORE = 0.15

# Queries and rows that meet at once.
QUERY_BLOCK = 1024
ROWS_PER_STEP = 2048


def build_index(chunks: DataFrame, dim: int = 768) -> DataFrame:
    """T4: chunks with their hashed term vectors."""
    return with_terms(chunks, "text", dim)


def embedding_rows(index: DataFrame) -> DataFrame:
    """F19 in long form."""
    return term_weights(index, ["doc_id", "chunk_id"])


def _blocks(rows: DataFrame, size: int) -> DataFrame:
    """``rows`` in arrays of at most ``size`` elements, as they lie; nothing is shuffled."""
    names = rows.columns

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                inner = pa.StructArray.from_arrays(part.columns, names)
                one = pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), inner)
                yield pa.RecordBatch.from_arrays([one], ["rows"])

    return rows.mapInArrow(pack, T.StructType([T.StructField("rows", T.ArrayType(rows.schema))]))


def _query_blocks(queries: DataFrame, key: str, size: int) -> DataFrame:
    """Queries in arrays of about ``size`` elements with the number of the block, in one partition.

    The blocks never reach the driver. Every task that scans rows reads them one after the other.
    """
    parts = max(1, ceil(queries.count() / size))
    block = F.pmod(F.xxhash64(key), F.lit(parts)).cast("int").alias("block")
    return queries.groupBy(block).agg(F.collect_list(F.struct(*queries.columns)).alias("queries")).repartition(1)


def _best(pool: pd.DataFrame, ids: list[str], k: int) -> pd.DataFrame:
    """First ``k`` rows per query by score, ties by id."""
    ordered = pool.sort_values(["q", "score", *ids], ascending=[True, False] + [True] * len(ids), na_position="first")
    return ordered.groupby("q", sort=False).head(k)


class _Winners:
    """The ``k`` best rows so far of each query of one block."""

    def __init__(self, names: pa.Array, ids: list[str], k: int):
        self.names, self.ids, self.k = names, ids, k
        self.floor = np.full(len(names), -np.inf)
        self.pool = None

    def add(self, rows: pa.StructArray, scores: np.ndarray, keep_zero: bool) -> None:
        bar = self.floor
        if len(scores) > self.k:
            bar = np.maximum(bar, np.partition(scores, len(scores) - self.k, axis=0)[-self.k])
        hit = scores >= bar
        if not keep_zero:
            hit &= scores > 0
        row, q = np.nonzero(hit)
        if not len(row):
            return
        found = pd.DataFrame({"q": q, "score": scores[row, q]})
        for i in self.ids:
            found[i] = rows.field(i).take(pa.array(row)).to_pandas(integer_object_nulls=True)
        self.pool = _best(found if self.pool is None else pd.concat([self.pool, found]), self.ids, self.k)
        last = self.pool.groupby("q")["score"].agg(["size", "min"])
        last = last[last["size"] == self.k]
        self.floor[last.index.to_numpy()] = last["min"].to_numpy()


def _scan_top(
    rows: DataFrame, ids: list[str], queries: DataFrame, query: str, score, k: int, keep_zero: bool, block: int
) -> DataFrame:
    """The ``k`` best rows per query with their rank, in one pass over ``rows``.

    Blocks of rows meet blocks of queries: a query set against all rows. Each task keeps ``k`` rows per query and emits only
    those; the final rank is taken over the winners of the tasks.
    """
    id_fields = [rows.schema[i] for i in ids]
    schema = T.StructType([queries.schema[query], *id_fields, T.StructField("score", T.DoubleType())])
    arrow_schema = to_arrow_schema(schema)

    def top(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        winners: dict[int, _Winners] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                number = batch.column("block")[i].as_py()
                some, asked = batch.column("rows")[i].values, batch.column("queries")[i].values
                own = winners.setdefault(number, _Winners(asked.field(query), ids, k))
                own.add(some, score(some, asked), keep_zero)
        for own in winners.values():
            if own.pool is not None and len(own.pool):
                columns = [own.names.take(pa.array(own.pool["q"].to_numpy()))]
                columns += [pa.Array.from_pandas(own.pool[i]) for i in [*ids, "score"]]
                yield pa.RecordBatch.from_arrays(
                    [c.cast(f.type) for c, f in zip(columns, arrow_schema)], schema=arrow_schema
                )

    pairs = _blocks(rows, ROWS_PER_STEP).crossJoin(_query_blocks(queries, query, block))
    order = Window.partitionBy(query).orderBy(F.col("score").desc(), *ids)
    return (
        pairs.mapInArrow(top, schema)
        .withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
    )


def top_chunks(
    index: DataFrame,
    questions: DataFrame,
    k: int = 6,
    dim: int = 768,
    fill_zero: bool = True,
    blocks: DataFrame | None = None,
) -> DataFrame:
    """T5: ``question_id, doc_id, chunk_id, score, rank`` of the ``k`` nearest chunks.

    Chunks and questions meet as matrices in one pass over the chunks, which keeps ``k`` rows per question and task; ``blocks`` are
    those of ``build_blocks`` if they are stored. Chunks without a common term fill the list, first ids first, unless
    ``fill_zero`` is off.
    """
    rows = index if blocks is None else blocks.select(F.inline("rows"))
    terms = cut(with_terms(questions.select("question_id", "question"), "question", dim).drop("question"), "terms")
    rows = rows.select(*IDS, "buckets", "counts", "norm2")
    best = cut(_scan_top(rows, IDS, terms, "question_id", _term_scores(dim), k, False, QUERY_BLOCK), "best")
    return filled(best, questions, index, k) if fill_zero else best


def _term_scores(dim: int):
    """Cosine of term vectors; 0 where one of them is empty."""

    def scores(rows: pa.StructArray, queries: pa.StructArray) -> np.ndarray:
        held, wanted = (dense(x.field("buckets"), x.field("counts"), dim) for x in (rows, queries))
        dots = held @ wanted.T
        size = np.sqrt(np.multiply.outer((held * held).sum(axis=1), (wanted * wanted).sum(axis=1)))
        return np.divide(dots, size, out=np.zeros_like(dots), where=size > 0)

    return scores


def _dense_scores(rows: pa.StructArray, queries: pa.StructArray) -> np.ndarray:
    """Cosine with unit queries; -1 and less where a vector has another length than the query or holds a null."""
    out = np.full((len(rows), len(queries)), -np.inf)
    stored, asked = rows.field("vec").to_pylist(), queries.field("vec").to_pylist()
    for width in {len(v) for v in asked}:
        mine = [i for i, v in enumerate(stored) if len(v) == width]
        own = [i for i, v in enumerate(asked) if len(v) == width]
        if mine and width:
            table = np.array([stored[i] for i in mine])
            norms = np.sqrt((table * table).sum(axis=1))
            table = np.divide(table, norms[:, None], out=table.copy(), where=norms[:, None] > 0)
            out[np.ix_(mine, own)] = np.round(table @ np.array([asked[i] for i in own]).T, 9)
    return out


def top_vectors(
    vectors: DataFrame, queries: DataFrame, k: int = 6, block: int = QUERY_BLOCK
) -> DataFrame:
    """T5 on stored dense vectors ``vec_id, vec`` and queries ``query_id, vec``; all lists full.

    Scores are rounded to nine places before ranking, so equal vectors tie. Queries without a vector get no rows; stored
    vectors that are null, hold a null or have another length than the query are never found.
    """
    from ..functions.vectors import unit_vector

    whole = ~F.exists("vec", lambda x: x.isNull())
    base = vectors.select("vec_id", F.col("vec").cast("array<double>").alias("vec")).filter(whole)
    units = queries.filter("vec IS NOT NULL").select("query_id", unit_vector(F.col("vec")).alias("vec"))
    found = _scan_top(base, ["vec_id"], units, "query_id", _dense_scores, k, True, block)
    return found.filter(F.col("score") >= -2)


def keyword_search(index: DataFrame, needles: list[str], limit: int) -> DataFrame:
    """First chunks that contain any needle, whatever the case; a bounded top-n."""
    low = F.lower("text")
    wanted = [F.contains(low, F.lit(n.lower())) for n in needles if n]
    if not wanted:
        return index.limit(0).select("doc_id", "source", "chunk_id", "text", F.lit(1.0).alias("score"))
    return (
        index.filter(reduce(Column.__or__, wanted))
        .select("doc_id", "source", "chunk_id", "text", F.lit(KEYWORD_SCORE).alias("score"))
        .orderBy("doc_id", "chunk_id")
        .limit(limit)
    )


# Fixed value: what cites an article by its number.
CITATION = rf"(?U)art(?:iculo)?s?\.?{WS}*([0-9]+)\b"


#: Folders of stored citations. Fixed, since stored tables rely on it.
CITATION_SLOTS = 64


def _slot(number: Column) -> Column:
    return F.pmod(F.xxhash64(number), F.lit(CITATION_SLOTS)).cast("int")


def citations(index: DataFrame) -> DataFrame:
    """``slot, number, doc_id, chunk_id`` of every article that a chunk cites; made once, when chunks are indexed."""
    plain = F.lower(strip_accents(F.col("text")))
    cited = F.array_distinct(F.regexp_extract_all(plain, F.lit(CITATION), F.lit(1)))
    found = index.select("doc_id", "chunk_id", F.explode(cited).alias("number"))
    return found.select(_slot(F.col("number")).alias("slot"), "number", "doc_id", "chunk_id")


def reference_hits(index: DataFrame, questions: DataFrame, k: int = 6, stored: DataFrame | None = None) -> DataFrame:
    """T6 and T8, first half: ``question_id, doc_id, chunk_id, hit_rank`` of exact references.

    Only chunks that cite an asked number count, and the first ``k`` of them are taken. The first ``k`` of several numbers
    lie among the first ``k`` of each, so every number is cut before questions come in, and a popular number joins few rows.
    With ``stored`` citations no text is read, and of their folders only those of the asked numbers; the driver sees their slots, at
    most ``CITATION_SLOTS``.
    """
    asked = questions.select("question_id", F.explode(article_numbers(F.col("question"))).alias("number"))
    by_number = Window.partitionBy("number").orderBy("doc_id", "chunk_id")
    wanted = asked.select("number").distinct().withColumn("slot", _slot(F.col("number")))
    if stored is None:
        cited = citations(index)
    else:
        cited = stored.filter(F.col("slot").isin([r["slot"] for r in wanted.select("slot").distinct().collect()]))
    firsts = (
        cited.join(wanted, ["slot", "number"], "left_semi")
        .withColumn("place", F.row_number().over(by_number))
        .filter(F.col("place") <= k)
    )
    hits = asked.join(firsts, "number").select("question_id", "doc_id", "chunk_id").distinct()
    by_question = Window.partitionBy("question_id").orderBy("doc_id", "chunk_id")
    return (
        hits.withColumn("hit_rank", F.row_number().over(by_question))
        .filter(F.col("hit_rank") <= k)
        .select("question_id", "doc_id", "chunk_id", "hit_rank")
    )


def _with_text(found: DataFrame, index: DataFrame) -> DataFrame:
    """Source and text of found chunks.

    ``found`` is written first, so its size is known and Spark broadcasts it only if it is small.
    """
    return cut(found, "found").join(
        index.select("doc_id", "chunk_id", "source", "text"), ["doc_id", "chunk_id"]
    )


def merge_hits(vector: DataFrame, hits: DataFrame, k: int = 6) -> DataFrame:
    """Exact references in front of vector hits, equal first 200 characters once.

    Both inputs carry ``question_id, doc_id, chunk_id, source, text, score, rank``. Questions without
    a reference keep their vector list. Every list has at most ``2 k`` rows.
    """
    both = (
        hits.withColumn("part", F.lit(0))
        .unionByName(vector.withColumn("part", F.lit(1)))
        .withColumn("head", F.substring("text", 1, 200))
    )
    per_question = Window.partitionBy("question_id")
    same = Window.partitionBy("question_id", "head").orderBy("part", "rank")
    order = per_question.orderBy("part", "rank")
    merged = both.withColumn(
        "n_hits", F.count_if(F.col("part") == 0).over(per_question)
    ).withColumn("copy", F.row_number().over(same))
    return (
        merged.filter((F.col("n_hits") == 0) | (F.col("copy") == 1))
        .withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k + F.col("n_hits"))
        .select("question_id", "doc_id", "chunk_id", "source", "text", "score", "rank")
    )


def adjacent_chunks(index: DataFrame, anchors: DataFrame, window: int = 3) -> DataFrame:
    """anchors' neighbours in the same document, by an equi-join on every wanted chunk id."""
    wanted = anchors.withColumnRenamed("chunk_id", "anchor_id").withColumn(
        "chunk_id",
        F.explode(F.sequence(F.col("anchor_id") - window, F.col("anchor_id") + window)),
    )
    return _with_text(wanted, index).withColumn("score", F.lit(NEIGHBOUR_SCORE))


def expand_context(
    index: DataFrame, merged: DataFrame, k: int = 6, window: int = 3, anchors: int = 2
) -> DataFrame:
    """The first anchors pull in their neighbours in reading order; ``k + 8`` chunks at most."""
    once = Window.partitionBy("question_id", "doc_id", "chunk_id").orderBy("rank")
    order = Window.partitionBy("question_id").orderBy("rank")
    base = (
        merged.withColumn("copy", F.row_number().over(once))
        .filter("copy = 1")
        .withColumn("place", F.row_number().over(order))
        .select("question_id", "doc_id", "chunk_id", "source", "text", "score", "place")
    )
    own = base.withColumn("turn", F.lit(-1).cast("bigint"))
    top = base.filter(F.col("place") <= anchors).select("question_id", "doc_id", "chunk_id", "place")
    around = adjacent_chunks(index, top, window).select(
        "question_id", "doc_id", "chunk_id", "source", "text", "score", "place",
        F.col("chunk_id").cast("bigint").alias("turn"),
    )
    first = Window.partitionBy("question_id", "doc_id", "chunk_id").orderBy("place", "turn")
    reading = Window.partitionBy("question_id").orderBy("place", "turn")
    return (
        own.unionByName(around)
        .withColumn("copy", F.row_number().over(first))
        .filter("copy = 1")
        .withColumn("pos", F.row_number().over(reading))
        .filter(F.col("pos") <= k + 8)
        .select("question_id", "pos", "doc_id", "chunk_id", "source", "text", "score")
    )


def retrieve(
    index: DataFrame,
    questions: DataFrame,
    k: int = 6,
    dim: int = 768,
    fill_zero: bool = True,
    stored: DataFrame | None = None,
) -> DataFrame:
    """T5, T8 and T9 for a table of questions: ``question_id, pos, doc_id, chunk_id, …``."""
    vector = top_chunks(index, questions, k, dim, fill_zero)
    hits = reference_hits(index, questions, k, stored).select(
        "question_id", "doc_id", "chunk_id",
        F.lit(KEYWORD_SCORE).alias("score"), F.col("hit_rank").alias("rank"),
    )
    found = _with_text(
        vector.withColumn("part", F.lit(1)).unionByName(hits.withColumn("part", F.lit(0))), index
    )
    merged = merge_hits(
        found.filter("part = 1").drop("part"), found.filter("part = 0").drop("part"), k
    )
    return expand_context(index, merged, k)


def unique_sources(context: DataFrame) -> DataFrame:
    """Sources per question in order of first appearance."""
    firsts = context.groupBy("question_id", "source").agg(F.min("pos").alias("pos"))
    return firsts.filter("source <> ''").groupBy("question_id").agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct("pos", "source"))), lambda s: s["source"]
        ).alias("sources")
    )


def format_context(context: DataFrame) -> DataFrame:
    """One text block per question."""
    block = F.concat(F.lit("[Fuente: "), F.col("source"), F.lit("]\n"), F.col("text"))
    return context.groupBy("question_id").agg(
        F.array_join(
            F.transform(
                F.sort_array(F.collect_list(F.struct("pos", block.alias("block")))),
                lambda s: s["block"],
            ),
            "\n\n",
        ).alias("context")
    )


def extractive_answer(best: DataFrame) -> DataFrame:
    """The two sentences of the best chunk that share most words with the question.

    Input ``question_id, question, text, score``; works inside the row.
    """
    step = best.withColumn("words", word_set(F.col("question"))).withColumn(
        "parts", sentences(F.col("text"))
    )
    scored = step.withColumn(
        "scored",
        F.transform(
            "parts",
            lambda s, i: F.struct(
                (-F.size(F.array_intersect(F.col("words"), word_set(s)))).alias("neg"),
                i.alias("pos"),
                s.alias("sentence"),
            ),
        ),
    )
    top = F.transform(F.slice(F.sort_array("scored"), 1, 2), lambda s: s["sentence"])
    snippet = strip(F.array_join(top, " "))
    return scored.select(
        "question_id",
        F.when(snippet != "", snippet).otherwise(F.substring("text", 1, 300)).alias("answer"),
        F.when(F.col("score") > MIN_CONFIDENT_SCORE, "medium").otherwise("low").alias("confidence"),
        F.col("score").alias("best_score"),
    )


def answer_questions(
    index: DataFrame,
    questions: DataFrame,
    k: int = 6,
    dim: int = 768,
    fill_zero: bool = True,
    stored: DataFrame | None = None,
) -> DataFrame:
    """One answer row per question; no support when nothing is retrieved."""
    context = cut(retrieve(index, questions, k, dim, fill_zero, stored), "context")
    best = context.filter("pos = 1").join(
        questions.select("question_id", "question"), "question_id"
    )
    answered = extractive_answer(best).join(unique_sources(context), "question_id", "left")
    found = F.col("answer").isNotNull()
    return questions.select("question_id", "question").join(
        answered, "question_id", "left"
    ).select(
        "question_id",
        "question",
        F.coalesce("answer", F.lit(NO_SUPPORT)).alias("answer"),
        F.when(found, "Taken directly from the retrieved documents.")
        .otherwise("")
        .alias("rationale"),
        F.coalesce("sources", F.array().cast("array<string>")).alias("sources"),
        F.coalesce("confidence", F.lit("low")).alias("confidence"),
        found.alias("grounded"),
        "best_score",
    )


def answers_from_responses(responses: DataFrame, column: str = "response") -> DataFrame:
    """Generated JSON answers. Input ``question_id, question, sources`` and the raw text.

    Rows without a usable answer are left out, so a caller can fall back to the extractive ones.
    """
    shape = "STRUCT<answer: STRING, rationale: STRING, confidence: STRING>"
    parsed = responses.withColumn("doc", F.from_json(extract_json(F.col(column)), shape))
    answer = strip(F.col("doc.answer"))
    lost = F.contains(F.lower("answer"), F.lit(NO_SUPPORT.lower()[:30]))
    return (
        parsed.filter(F.coalesce(F.col("doc.answer"), F.lit("")) != "")
        .withColumn("answer", answer)
        .select(
            "question_id",
            "question",
            "answer",
            F.coalesce("doc.rationale", F.lit("")).alias("rationale"),
            F.when(lost, F.array().cast("array<string>")).otherwise(F.col("sources")).alias("sources"),
            F.coalesce("doc.confidence", F.lit("medium")).alias("confidence"),
            (~lost).alias("grounded"),
        )
    )
