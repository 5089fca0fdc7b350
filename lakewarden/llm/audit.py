"""Audit of quality filters and of how they interact, kept up to date by incremental retraction.

Five filters judge a document: A (few words), B (repeated words), C (capitals), D (symbols), E (its text belongs to a smaller
id). The first four depend on the row alone; the fifth changes when a smaller id arrives later. All files are read as
available-now micro-batches of a stream. Its keyed state holds the least id of every text, with what that document counts for;
texts share a state by the hash of their digest, some dozens in one, so states stay small however many there are. When a
smaller id arrives, the state takes back the counts of the document that was least so far and counts it again as failing E.
Changes of the counters (part, mask of failed filters, labels) are summed in the task and appended to a table; the sums of
that table are the counters, at most 128 rows a part, and every order and step of the filters follows from them.

Before rows are shuffled, each task keeps one row of each text and sums up the others, so a text that a third of the rows
have is a row from each task. State, offsets and changes lie in ``folder``, which has to be shared; a job that is started
again with the same folder goes on where it was and reads only new files. Each batch is committed once.

Defined results: a null text counts as empty, a null part as ''. A row without an id never fails E, and makes no other one
fail. Rows that repeat an id count each. Of several labels of one id the highest counts; without a label a row is neither
good nor toxic. Other columns play no part. An empty table gives no rows.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator
from itertools import combinations, permutations
from math import ceil

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakewarden.llm.common import Scratch, lean

FILTERS = "ABCDE"
BIT = {letter: 1 << i for i, letter in enumerate(FILTERS)}
#: What a task holds of distinct texts before it sends them on.
COMBINED = 50_000
ROW = "part string, mask int, quality int, toxic int, n long"
#: State store that keeps its states on disk, with its memory bounded for all of an executor.
STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "200",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # else every partition takes megabytes in advance
}


def row_mask(text: Column, least_words: int = 200, distinct_percent: int = 50, capital_percent: int = 3, symbols: str = "#$%&*|") -> Column:
    """The filters A to D that a text fails, as bits."""
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    n = F.size(words)
    fails = {
        "A": n < least_words,
        "B": F.size(F.array_distinct(words)) * 100 < n * distinct_percent,
        "C": F.regexp_count(text, F.lit("[A-Z]")).cast("long") * 100 > F.length(text).cast("long") * capital_percent,
        "D": text.rlike("[" + "".join(f"\\{c}" for c in symbols) + "]"),
    }
    return sum((F.when(fail, BIT[letter]).otherwise(0) for letter, fail in fails.items()), F.lit(0))


def _combined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of every text that the task meets the rows with the least id, summed; the others, which surely fail E, and those without
    an id, summed over all texts and marked as ``final``."""
    names = ["bucket", "digest", "id", "final", "part", "mask", "quality", "toxic", "n"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.bool_(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int64()]
    held: dict[str, list] = {}
    final: Counter = Counter()
    place: dict[tuple, int] = {}

    def settle(bucket: int, what: tuple, n: int) -> None:
        final[what] += n
        place[what] = bucket

    def out() -> pa.RecordBatch:
        rows = [(bucket, d, i, False, *what, n) for d, (i, bucket, own) in held.items() for what, n in own.items()]
        rows += [(place[what], "", 0, True, *what, n) for what, n in final.items()]
        columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
        held.clear(), final.clear(), place.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    def failing(what: tuple) -> tuple:
        return (what[0], what[1] | BIT["E"], *what[2:])

    for batch in batches:
        for bucket, digest, i, *what in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            what = tuple(what)
            if i is None:
                settle(bucket, what, 1)
                continue
            known = held.get(digest)
            if known is None:
                held[digest] = [i, bucket, {what: 1}]
            elif i == known[0]:
                known[2][what] = known[2].get(what, 0) + 1
            elif i > known[0]:
                settle(bucket, failing(what), 1)
            else:
                for other, n in known[2].items():
                    settle(bucket, failing(other), n)
                held[digest] = [i, bucket, {what: 1}]
        if len(held) >= COMBINED:
            yield out()
    yield out()


def _advance(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    """The changes of the counters by new rows of the texts of one state."""
    # digest: [least id, [[part, mask, quality, toxic, rows], ...]]
    held = json.loads(state.get[0]) if state.exists else {}
    change: Counter = Counter()
    fails = BIT["E"]
    for frame in frames:
        columns = (frame[c].tolist() for c in ("digest", "id", "final", "part", "mask", "quality", "toxic", "n"))
        for digest, i, final, part, mask, quality, toxic, n in zip(*columns, strict=True):
            own = None if final else held.get(digest)
            if own is not None and i > own[0]:
                change[part, mask | fails, quality, toxic] += n
                continue
            change[part, mask, quality, toxic] += n
            if final:
                continue
            if own is not None and i < own[0]:  # what was least so far is taken back and fails from now on
                for p, m, q, t, k in own[1]:
                    change[p, m, q, t] -= k
                    change[p, m | fails, q, t] += k
            if own is not None and i == own[0]:
                own[1].append([part, mask, quality, toxic, n])
            else:
                held[digest] = [i, [[part, mask, quality, toxic, n]]]
    if held:
        state.update((json.dumps(held, separators=(",", ":")),))
    rows = [(*what, n) for what, n in change.items() if n]
    if rows:
        yield pd.DataFrame(rows, columns=["part", "mask", "quality", "toxic", "n"])


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each counter that the task changes."""
    total: Counter = Counter()
    names = ["part", "mask", "quality", "toxic", "n"]
    for batch in batches:
        for *what, n in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
            total[tuple(what)] += n
    rows = [(*what, n) for what, n in total.items() if n]
    kinds = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int64()]
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def counters(
    spark: SparkSession, path: str, labels: DataFrame, folder: str | None = None, by: str = "doc_id", text: str = "text",
    part: str = "lang", batches: int = 4, texts_per_state: int = 64, **thresholds,
) -> DataFrame:
    """``part``, ``mask``, ``quality``, ``toxic`` and ``n``, the number of rows, after all files of ``path`` that ``folder`` has
    not seen yet. The files are dealt to about ``batches`` micro-batches."""
    known = spark.read.parquet(path)
    folder = folder or Scratch(spark, "audit").root
    settings = f"{folder}/settings"
    if not _exists(spark, settings):  # as many states as the first files ask for; later runs keep to them
        states = max(1, ceil(known.count() / texts_per_state))
        spark.createDataFrame([(states,)], "states long").coalesce(1).write.parquet(settings)
    states = spark.read.schema("states long").parquet(settings).first()["states"]
    marks = labels.where(F.col(by).isNotNull()).groupBy(by).agg(
        *[F.max(F.when(F.col(c) == 1, 1).otherwise(0)).alias(f"__{c}") for c in ("quality", "toxic")]
    )
    marks = Scratch(spark, "audit-labels").keep(marks.select(F.col(by).alias("__by"), F.lit(0).alias("__none"), "__quality", "__toxic"), "labels")
    files = ceil(len(known.inputFiles()) / batches)
    # a pattern that only the path itself fits: the reader then takes a single file as well as a folder
    stream = spark.readStream.schema(known.schema).option("maxFilesPerTrigger", max(1, files)).parquet(f"{path[:-1]}[{path[-1]}]")
    body = F.coalesce(F.col(text), F.lit(""))
    rows = stream.select(
        F.sha2(body, 256).alias("digest"), F.col(by).cast("long").alias("id"), F.coalesce(F.col(part), F.lit("")).alias("part"),
        row_mask(body, **thresholds).alias("mask"),
    )
    bucket = F.pmod(F.xxhash64("digest"), F.lit(states))
    rows = rows.select(
        bucket.alias("bucket"), "*", F.col("id").isNull().cast("int").alias("__none"),
        F.coalesce("id", F.xxhash64("digest", F.rand(1))).alias("__by"),  # rows without an id meet no label, and not each other
    )
    marked = rows.join(marks, ["__by", "__none"], "left").select(
        "bucket", "digest", "id", "part", "mask",
        F.coalesce("__quality", F.lit(0)).alias("quality"), F.coalesce("__toxic", F.lit(0)).alias("toxic"),
    )
    least = marked.mapInArrow(lean(_combined), f"bucket long, digest string, id long, final boolean, {ROW}")
    changes = least.groupBy("bucket").applyInPandasWithState(_advance, ROW, "held string", "append", "NoTimeout")
    before = {k: spark.conf.get(k, None) for k in STORE}
    try:
        for k, v in STORE.items():
            spark.conf.set(k, v)
        query = (
            changes.mapInArrow(_summed, ROW).writeStream.format("parquet").outputMode("append")
            .option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start(f"{folder}/changes")
        )
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    changed = spark.read.schema(ROW).parquet(f"{folder}/changes")
    return changed.groupBy("part", "mask", "quality", "toxic").agg(F.sum("n").alias("n")).where("n <> 0")


def steps(spark: SparkSession) -> DataFrame:
    """``filter_order``, ``step``, the ``own`` filter's bit and those ``before`` it, for all orders: 600 rows."""
    rows = []
    for order in permutations(FILTERS):
        before = 0
        for step, letter in enumerate(order, 1):
            rows.append(("".join(order), step, BIT[letter], before))
            before |= BIT[letter]
    return spark.createDataFrame(rows, "filter_order string, step int, own int, before int")


def interactions(counted: DataFrame) -> DataFrame:
    """Per part, order and step the documents that the counters tell of, zeros included."""
    spark = counted.sparkSession
    pairs = [
        F.struct(F.lit(bit).alias("own"), F.lit(sum(before)).alias("before"))
        for bit in BIT.values()
        for size in range(len(FILTERS))
        for before in combinations([b for b in BIT.values() if b != bit], size)
    ]
    # what a step does depends on its filter and the set of those before it, not on their order: 80 cases
    cases = counted.withColumn("case", F.explode(F.array(*pairs))).select("*", "case.own", "case.before")
    mask, n = F.col("mask"), F.col("n")
    fails = mask.bitwiseAND(F.col("own")) != 0
    earlier = mask.bitwiseAND(F.col("before")) != 0
    # in an equal share of all 120 orders each filter that a document fails is the first of them
    share = n * F.expr("120 div greatest(1, bit_count(mask))")

    def rows(which: Column, weight: Column = n) -> Column:
        return F.sum(F.when(which, weight).otherwise(F.lit(0))).cast("long")

    summed = cases.groupBy("part", "own", "before").agg(
        rows(~fails & ~earlier).alias("kept"),
        rows(fails & ~earlier).alias("removed"),
        rows(fails & earlier).alias("redundant"),
        rows(mask == F.col("own")).alias("unique_fails"),
        rows(fails & ~earlier & (F.col("quality") == 1)).alias("good_lost"),
        rows(fails & ~earlier & (F.col("toxic") == 1)).alias("toxic_lost"),
        rows(fails, share).alias("shapley"),
    )
    return summed.join(F.broadcast(steps(spark)), ["own", "before"]).drop("own", "before")


def audit(spark: SparkSession, path: str, labels: DataFrame, folder: str | None = None, **options) -> DataFrame:
    """``part``, ``filter_order`` and ``step`` with ``kept`` (after the step), ``removed`` (by it), ``redundant`` (failing its
    filter, but removed earlier), ``unique_fails`` (failing its filter only), ``good_lost`` and ``toxic_lost`` (removed by it,
    with that label), and ``shapley`` (removed by its filter, summed over all orders)."""
    return interactions(counters(spark, path, labels, folder, **options))
