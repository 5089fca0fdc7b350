"""Exact top-k search over blocks of chunks, which skips blocks that cannot reach the k-th score.

The index holds chunks in small blocks, as they lie, and for every bucket of a block the largest weight that a chunk of
the block has there. The sum of those weights times the weights of a question bounds every score in the block from above. Each
question first scores a few promising blocks; the k-th score found there is a bar, and of the other blocks only those
whose bound reaches it are scored. Questions meet postings and blocks by equi-joins on buckets and block numbers, so none is
copied past rows that it has nothing in common with.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.vectors import with_terms
from ..session import cut

IDS = ["doc_id", "chunk_id"]
#: Chunks of a block: fewer give closer bounds, more give fewer postings.
BLOCK_SIZE = 4
#: Neighbouring blocks that one call scores, and questions that it holds as whole vectors at once.
PACK, AT_ONCE = 64, 1024
#: Blocks that a question scores first: the most promising one of so many shares of the blocks.
PROBES = 8
#: Sums of rounded products may fall short of the exact ones by less than this share.
SLACK = 1e-9


def dense(buckets: pa.ListArray, counts: pa.ListArray, dim: int) -> np.ndarray:
    """Whole-number vectors from their buckets and counts."""
    row = np.repeat(np.arange(len(buckets)), buckets.value_lengths().to_numpy())
    slot = row * dim + buckets.flatten().to_numpy()
    return np.bincount(slot, weights=counts.flatten().to_numpy(), minlength=len(buckets) * dim).reshape(len(buckets), dim)


def build_blocks(index: DataFrame, size: int = BLOCK_SIZE) -> DataFrame:
    """``block, rows, tops``: chunks with their vectors, and the largest weight of each bucket. Written once, since the numbers
    of the blocks follow the rows as they lie."""
    rows = index.select(*IDS, "buckets", "counts", "norm2")
    names = rows.columns
    top = T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("high", T.DoubleType())])
    schema = T.StructType(
        [T.StructField("block", T.LongType()), T.StructField("rows", T.ArrayType(rows.schema)), T.StructField("tops", T.ArrayType(top))]
    )

    def pack(batches):
        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                buckets, counts = part.column("buckets"), part.column("counts")
                norm = np.sqrt(part.column("norm2").to_numpy(zero_copy_only=False).astype(float))
                weight = counts.flatten().to_numpy() / np.repeat(norm, buckets.value_lengths().to_numpy())
                which = buckets.flatten().to_numpy()
                order = np.argsort(which, kind="stable")
                which, weight = which[order], weight[order]
                start = np.flatnonzero(np.diff(which, prepend=-1))
                high = np.maximum.reduceat(weight, start) if len(which) else weight
                tops = pa.StructArray.from_arrays([pa.array(which[start], pa.int32()), pa.array(high)], ["bucket", "high"])
                inner = pa.StructArray.from_arrays(part.columns, names)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([number]),
                        pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), inner),
                        pa.ListArray.from_arrays(pa.array([0, len(tops)], pa.int32()), tops),
                    ],
                    ["block", "rows", "tops"],
                )
                number += 1

    return cut(rows.mapInArrow(pack, schema), "blocks")


def block_bounds(blocks: DataFrame, terms: DataFrame) -> DataFrame:
    """``question_id, block, bound`` of every block that has a bucket of the question."""
    asked = terms.select("question_id", "norm2", F.inline(F.arrays_zip("buckets", "counts")))
    asked = asked.select("question_id", F.col("buckets").alias("bucket"), (F.col("counts") / F.sqrt("norm2")).alias("weight"))
    postings = blocks.select("block", F.inline("tops"))
    bound = F.sum(F.col("weight") * F.col("high")) * (1 + SLACK)
    return asked.join(postings, "bucket").groupBy("question_id", "block").agg(bound.alias("bound"))


def _scored(pairs: DataFrame, terms: DataFrame, blocks: DataFrame, k: int, dim: int) -> DataFrame:
    """The chunks of each pair of a question and a block that are among its ``k`` best and reach the question's ``bar``."""
    inner = blocks.schema["rows"].dataType.elementType
    schema = T.StructType([terms.schema["question_id"], *[inner[i] for i in IDS], T.StructField("score", T.DoubleType())])
    arrow = to_arrow_schema(schema)
    asked = pairs.join(terms.select("question_id", "buckets", "counts"), "question_id")

    def score(_, questions: pa.Table, blocks: pa.Table) -> pa.Table:
        if not questions.num_rows or not blocks.num_rows:
            return arrow.empty_table()
        numbers = blocks.column("block").to_numpy()
        lists = pa.concat_arrays(blocks.column("rows").chunks)
        rows = lists.flatten()
        home = np.repeat(numbers, lists.value_lengths().to_numpy())
        held, norms = dense(rows.field("buckets"), rows.field("counts"), dim), rows.field("norm2").to_numpy()
        one = pa.Table.from_batches(questions.sort_by("question_id").to_batches()).combine_chunks()
        names = one.column("question_id").combine_chunks().dictionary_encode()
        which, found = names.indices.to_numpy(), []
        for low in range(0, len(names.dictionary), AT_ONCE):
            part = np.flatnonzero((which >= low) & (which < low + AT_ONCE))
            own, place = np.unique(which[part], return_index=True)
            asked = one.take(pa.array(part[place])).combine_chunks()
            wanted = dense(asked.column("buckets").combine_chunks(), asked.column("counts").combine_chunks(), dim)
            dots = held @ wanted.T
            size = np.sqrt(np.multiply.outer(norms, (wanted * wanted).sum(axis=1)))
            scores = np.divide(dots, size, out=np.zeros_like(dots), where=size > 0)
            # only the pairs that were asked for
            pairs = np.zeros((len(numbers), len(own)), bool)
            at = {n: i for i, n in enumerate(numbers.tolist())}
            pairs[[at[n] for n in one.column("block").take(pa.array(part)).to_pylist()], which[part] - low] = True
            scores[~pairs[[at[n] for n in home.tolist()]]] = 0
            bar = asked.column("bar").to_numpy()
            if len(scores) > k:
                bar = np.maximum(bar, np.partition(scores, len(scores) - k, axis=0)[-k])
            row, q = np.nonzero((scores >= bar) & (scores > 0))
            taken = [asked.column("question_id").take(pa.array(q)).combine_chunks(), *[rows.field(i).take(pa.array(row)) for i in IDS]]
            columns = [c.cast(f.type) for c, f in zip([*taken, pa.array(scores[row, q])], arrow)]
            found.append(pa.Table.from_arrays(columns, schema=arrow))
        return pa.concat_tables(found)

    pack = F.floor(F.col("block") / F.lit(PACK))
    left = asked.withColumn("pack", pack).groupBy("pack")
    return left.cogroup(blocks.select("block", "rows", pack.alias("pack")).groupBy("pack")).applyInArrow(score, schema)


def _first(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("question_id").orderBy(F.col("score").desc(), *IDS)
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def filled(best: DataFrame, questions: DataFrame, index: DataFrame, k: int) -> DataFrame:
    """Lists that are shorter than ``k`` go on with the first chunks that have nothing in common with the question.

    A short list holds less than ``k`` chunks, so the first ``2 k`` of the index are enough.
    """
    firsts = index.select(*IDS).orderBy(*IDS).limit(2 * k).collect()
    if not firsts:
        return best
    ids = F.array(*[F.struct(*[F.lit(r[i]).cast(index.schema[i].dataType).alias(i) for i in IDS]) for r in firsts])
    have = best.groupBy("question_id").agg(F.count("*").alias("have"))
    short = questions.select("question_id").join(have, "question_id", "left").fillna(0, ["have"]).filter(F.col("have") < k)
    more = short.select("question_id", "have", F.inline(ids))
    more = more.join(best.select("question_id", *IDS), ["question_id", *IDS], "left_anti")
    place = F.col("have") + F.row_number().over(Window.partitionBy("question_id").orderBy(*IDS))
    more = more.withColumn("rank", place.cast("int")).filter(F.col("rank") <= k)
    return best.unionByName(more.select("question_id", *IDS, F.lit(0.0).alias("score"), "rank"))


def _plan(blocks: DataFrame, terms: DataFrame, k: int, dim: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The bounds, the chunks of the first blocks, and the pairs of a question and another block that can hold better ones."""
    bounds = cut(block_bounds(blocks, terms), "bounds")
    share = F.pmod("block", F.lit(PROBES)).alias("share")
    first = bounds.groupBy("question_id", share).agg(F.max_by("block", F.struct("bound", "block")).alias("block"))
    first = cut(first.drop("share"), "first-blocks")
    probed = cut(_scored(first.withColumn("bar", F.lit(0.0)), terms, blocks, k, dim), "probed")
    bars = _first(probed, k).filter(F.col("rank") == k).select("question_id", F.col("score").alias("bar"))
    rest = bounds.join(first, ["question_id", "block"], "left_anti").join(bars, "question_id", "left").fillna(0.0, ["bar"])
    return bounds, probed, rest.filter(F.col("bound") >= F.col("bar")).select("question_id", "block", "bar")


def top_in_blocks(
    index: DataFrame, questions: DataFrame, k: int, dim: int, fill_zero: bool, blocks: DataFrame | None = None
) -> DataFrame:
    """``question_id, doc_id, chunk_id, score, rank`` of the ``k`` best chunks by cosine, ties by id."""
    blocks = build_blocks(index) if blocks is None else blocks
    terms = cut(with_terms(questions.select("question_id", "question"), "question", dim).drop("question"), "terms")
    _, probed, pairs = _plan(blocks, terms, k, dim)
    best = cut(_first(probed.unionByName(_scored(pairs, terms, blocks, k, dim)), k), "best")
    return filled(best, questions, index, k) if fill_zero else best


def pruning(index: DataFrame, questions: DataFrame, k: int = 6, dim: int = 768, size: int = BLOCK_SIZE) -> tuple[int, int]:
    """How many pairs of a question and a block there are, and how many of them are scored."""
    blocks = build_blocks(index, size)
    terms = cut(with_terms(questions.select("question_id", "question"), "question", dim).drop("question"), "terms")
    bounds, _, pairs = _plan(blocks, terms, k, dim)
    first = bounds.select("question_id", F.pmod("block", F.lit(PROBES))).distinct().count()
    return terms.filter("norm2 > 0").count() * blocks.count(), first + pairs.count()
