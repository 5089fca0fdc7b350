"""Documents and the file inventory."""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# File kinds, and document types by a word in the file name, first match wins.
TABULAR = (".csv", ".xlsx", ".xls")
DOCUMENT = (".pdf", ".txt", ".md", ".docx")
READABLE = (".txt", ".md")
DOCUMENT_TYPES = (
    ("policy", ("politica", "policy")),
    ("quality_manual", ("manual", "calidad", "quality")),
    ("glossary", ("glosario", "glossary")),
    ("roles", ("rol", "role", "responsab")),
    ("dictionary", ("diccionario", "dictionary")),
    ("roadmap", ("roadmap",)),
    ("architecture", ("arquitectura", "architecture")),
    ("checklist", ("checklist", "migracion", "migration")),
    ("business_rules", ("regla", "rule", "negocio")),
)


def file_extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"[^./\\](\.[^./\\]+)$", 1))


def file_kind(name: Column) -> Column:
    ext = file_extension(name)
    return (
        F.when(ext.isin(*TABULAR), "tabular")
        .when(ext.isin(*DOCUMENT), "document")
        .otherwise("unknown")
    )


def document_type(name: Column) -> Column:
    low = F.lower(name)
    kinds = [
        F.when(F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(low, w)), F.lit(kind))
        for kind, words in DOCUMENT_TYPES
    ]
    return F.coalesce(*kinds, F.lit("document"))


def decode_text(content: Column) -> Column:
    """UTF-8 if valid, else Latin-1; a byte-order mark at the start is dropped."""
    text = F.when(F.is_valid_utf8(content.cast("string")), F.decode(content, "UTF-8")).otherwise(
        F.decode(content, "ISO-8859-1")
    )
    return F.regexp_replace(text, "^\\x{feff}", "")


#: Small files that one task reads, and tasks for each core of the cluster that there are at least.
FILES_PER_TASK, TASKS_PER_CORE = 5000, 3


def _files(spark: SparkSession, folder: str, recursive: bool) -> DataFrame:
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", recursive)
    found = reader.load(folder)
    # Spark packs files as if each had megabytes more, so small ones would make a task for every few
    size = int(found._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    most = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    tasks = max(ceil(size / most), ceil(len(found._jdf.inputFiles()) / FILES_PER_TASK))
    found = found.coalesce(max(tasks, TASKS_PER_CORE * spark.sparkContext.defaultParallelism))
    return found.withColumn("file_name", F.element_at(F.split("path", "/"), -1))


def load_documents(spark: SparkSession, folder: str, recursive: bool = False) -> DataFrame:
    """``doc_id, source, text`` of the text documents; ids sort in path order."""
    return (
        _files(spark, folder, recursive)
        .filter(file_extension(F.col("file_name")).isin(*READABLE))
        .select(
            F.col("path").alias("doc_id"),
            F.col("file_name").alias("source"),
            decode_text(F.col("content")).alias("text"),
        )
    )


def file_inventory(spark: SparkSession, folder: str, recursive: bool = False) -> DataFrame:
    """One row per file; contents are not read."""
    name = F.col("file_name")
    return _files(spark, folder, recursive).select(
        "file_name",
        F.regexp_replace(file_extension(name), "^[.]", "").alias("file_type"),
        file_kind(name).alias("kind"),
        F.when(file_kind(name) == "document", document_type(name)).alias("doc_type"),
        F.col("modificationTime").alias("loaded_at"),
        F.col("length").alias("bytes"),
        F.lit("loaded").alias("status"),
    )
