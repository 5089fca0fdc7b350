"""Sources, sinks and jobs as queries: the given tables are written to the scratch folder and read back."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from math import ceil

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import quality, recommend
from ..session import checkpoint_root
from ..sources import documents as files
from ..sources.sinks import ChunkIndex, write_report
from ..sources.tabular import MISSING_TOKENS, read_csv, read_table
from . import jobs
from .oracle import ORACLE, chunk_ctes
from .queries import AS_OF, RETAIL, STAR, STAR_AS_OF, _cited_documents, _cited_questions, documents, joined, query
from .retail import retail_tables


def _place(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_root(spark).rstrip('/')}/lakewarden/{name}-{uuid.uuid4().hex}"


@query
def csv_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Whole texts, line breaks and quotes included, through CSV files with detected format."""
    path = _place(spark, "csv")
    plain = {"quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    read_table(spark, folder, "documents").write.options(header=True, **plain).csv(path)
    back = read_csv(spark, path)
    return back.select("doc_id", F.md5("text").alias("text_md5"), "lang", "source", "n_chars")


_kept = "CASE WHEN {0} IN (" + ", ".join(f"'{t}'" for t in MISSING_TOKENS) + ") THEN NULL ELSE {0} END"
ORACLE["csv_documents"] = f"""SELECT CAST(doc_id AS VARCHAR) AS doc_id, md5({_kept.format("text")}) AS text_md5,
 {_kept.format("lang")} AS lang, {_kept.format("source")} AS source, CAST(n_chars AS VARCHAR) AS n_chars FROM documents"""


#: Text files that one task writes.
FILES_PER_TASK = 5000
#: The folder of rows without an id, as Spark's own writer names it.
NO_ID = "__HIVE_DEFAULT_PARTITION__"


def _write_texts(texts: DataFrame, path: str) -> None:
    """A file ``path/<task>/doc_id=<id>.txt`` for each id, with a line for each of its rows; those of an id must lie in one partition.

    Spark's own writer, used for stores that are not mounted, makes a folder for every file and starts some processes for each of a local or
    mounted folder, so there the tasks write themselves. A file gets its name when it is whole, so a task that is repeated leaves no half of one.
    """
    spark = texts.sparkSession
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    # a path without a scheme lies in the cluster's own store
    if place.getFileSystem(spark._jsc.hadoopConfiguration()).getUri().getScheme() != "file":
        texts.write.option("mapreduce.fileoutputcommitter.algorithm.version", "2").partitionBy("doc_id").text(path)
        return
    root = place.toUri().getPath()
    rows = texts.select(F.coalesce(F.col("doc_id").cast("string"), F.lit(NO_ID)).alias("doc_id"), "value")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, own = f"{root}/{TaskContext.get().partitionId():05d}", f".{uuid.uuid4().hex}"
        os.makedirs(place, exist_ok=True)
        count, now, out = 0, None, None

        def close() -> None:
            out.close()
            os.replace(f"{place}/{own}", f"{place}/doc_id={now}.txt")

        for batch in batches:
            for doc_id, value in zip(batch.column("doc_id").to_pylist(), batch.column("value").cast(pa.binary()).to_pylist(), strict=True):
                if doc_id != now:
                    if out is not None:
                        close()
                    now, out = doc_id, open(f"{place}/{own}", "wb")
                    count += 1
                out.write((value or b"") + b"\n")
        if out is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([count], pa.int64())], ["files"])

    os.makedirs(root, exist_ok=True)
    rows.sortWithinPartitions("doc_id").mapInArrow(write, "files long").agg(F.sum("files")).collect()


def _document_files(spark: SparkSession, folder: str) -> str:
    path = _place(spark, "texts")
    texts = read_table(spark, folder, "documents").select("doc_id", F.col("text").alias("value"))
    # a number of partitions that grows with the documents
    parts = max(1, ceil(texts.count() / FILES_PER_TASK))
    _write_texts(texts.repartition(parts, "doc_id"), path)
    return path


@query
def document_files(spark: SparkSession, folder: str) -> DataFrame:
    """One text file per document, read with its encoding detected."""
    docs = files.load_documents(spark, _document_files(spark, folder), recursive=True)
    number = F.regexp_extract("doc_id", "doc_id=([0-9]+)[/.]", 1).cast("long")
    return docs.select(number.alias("doc_id"), F.md5("text").alias("text_md5"))


ORACLE["document_files"] = "SELECT doc_id, md5(text || chr(10)) AS text_md5 FROM documents"


@query
def document_inventory(spark: SparkSession, folder: str) -> DataFrame:
    """Kinds and sizes of the same files."""
    found = files.file_inventory(spark, _document_files(spark, folder), recursive=True)
    return found.groupBy("file_type", "kind", "doc_type", "status").agg(
        F.count("*").alias("files"), F.sum("bytes").alias("bytes")
    )


ORACLE["document_inventory"] = """SELECT 'txt' AS file_type, 'document' AS kind, 'document' AS doc_type, 'loaded' AS status,
 count(*) AS files, CAST(sum(strlen(text) + 1) AS BIGINT) AS bytes FROM documents"""


@query
def report_files(spark: SparkSession, folder: str) -> DataFrame:
    """Findings written as JSON and read back."""
    found = quality.findings(retail_tables(spark, folder), RETAIL, AS_OF)
    paths = write_report({"findings": found}, _place(spark, "report"))
    return spark.read.schema(found.schema).json(paths["findings"])


ORACLE["report_files"] = ORACLE["retail_findings"]


@query
def index_jobs(spark: SparkSession, folder: str) -> DataFrame:
    """Documents indexed twice; the second time adds nothing."""
    index = ChunkIndex(spark, _place(spark, "index"))
    docs = documents(spark, folder)
    sizes = [jobs.document_job(docs, index, RETAIL, recursive=False) for _ in range(2)]
    per = index.read().groupBy("doc_id").agg(F.count("*").alias("chunks"), F.max("chunk_id").alias("last_chunk"))
    return per.withColumn("grown", F.lit(sizes[1] - sizes[0]).cast("long"))


ORACLE["index_jobs"] = f"""WITH {chunk_ctes()} SELECT doc_id, count(*) AS chunks, max(chunk_id) AS last_chunk,
 CAST(0 AS BIGINT) AS grown FROM chunks GROUP BY doc_id"""


@query
def question_jobs(spark: SparkSession, folder: str) -> DataFrame:
    """W3 on a stored index."""
    index = ChunkIndex(spark, _place(spark, "index"))
    jobs.document_job(_cited_documents(spark, folder), index, RETAIL, recursive=False)
    out = jobs.question_job(index, _cited_questions(spark, folder), RETAIL)
    return out.withColumn("sources", joined("sources")).withColumn("best_score", F.round("best_score", 9))


ORACLE["question_jobs"] = ORACLE["answers"]


@query
def default_recommendation(spark: SparkSession, folder: str) -> DataFrame:
    """What is recommended when every check of the rule pack passes, here on the orders that are not in the future."""
    orders = read_table(spark, folder, "orders").filter(F.col("o_orderdate") <= F.lit(STAR_AS_OF))
    tables = {"orders": orders}
    found = quality.findings(tables, STAR, STAR_AS_OF)
    scored = quality.quality_report(tables, STAR, STAR_AS_OF, found)
    nobody = spark.createDataFrame([], "entity string, entity_seq int, duplicates_detected long")
    return recommend.recommendations(scored, found, nobody)


ORACLE["default_recommendation"] = f"""WITH t AS (SELECT * FROM orders WHERE o_orderdate <= DATE '{STAR_AS_OF}'),
spelled AS (SELECT lower(trim(o_orderpriority)) AS k FROM t GROUP BY k HAVING count(DISTINCT o_orderpriority) > 1)
SELECT 1 AS seq, 'low' AS priority, 'Keep monitoring quality' AS title,
 'No critical findings.' AS risk, 'Schedule profiling and define quality thresholds.' AS suggested_action,
 'Data governance' AS responsible, 'Data quality that lasts.' AS expected_impact, 'low' AS estimated_effort
WHERE (SELECT count(*) = count(DISTINCT o_orderkey) FROM t)
 AND NOT EXISTS (SELECT 1 FROM t WHERE o_custkey IS NULL OR o_totalprice IS NULL OR isnan(o_totalprice) OR o_orderdate IS NULL
  OR coalesce(trim(o_orderstatus), '') IN ('', 'nan') OR coalesce(trim(o_orderpriority), '') IN ('', 'nan'))
 AND NOT EXISTS (SELECT 1 FROM spelled)"""
