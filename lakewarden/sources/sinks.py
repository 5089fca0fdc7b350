"""Report files and the chunk index on disk."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.errors import AnalysisException

from ..operators.retrieval import citations
from ..session import cut


def write_report(tables: dict[str, DataFrame], folder: str, fmt: str = "json") -> dict[str, str]:
    """Each result table in its own folder; returns the paths."""
    paths = {}
    for name, df in tables.items():
        paths[name] = f"{folder.rstrip('/')}/{name}"
        df.write.mode("overwrite").format(fmt).save(paths[name])
    return paths


def write_markdown(lines: DataFrame, folder: str) -> str:
    """The report lines as one ordered text file; its length is the number of findings."""
    path = f"{folder.rstrip('/')}/report.md"
    ordered = lines.orderBy("section", "seq").select(F.col("line").alias("value"))
    ordered.coalesce(1).write.mode("overwrite").text(path)
    return path


class ChunkIndex:
    """A Parquet table of chunks with their term vectors, and beside it one of the article numbers that they cite."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark = spark
        self.path = path
        self.citation_path = f"{path.rstrip('/')}_citations"

    def read(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def citations(self) -> DataFrame:
        """``slot, number, doc_id, chunk_id``; slots are folders, so a question reads those of its numbers only."""
        ids = self.read().schema
        # the folder is empty where no chunk cites anything, so it can't tell its columns
        columns = T.StructType([T.StructField("number", T.StringType()), ids["doc_id"], ids["chunk_id"], T.StructField("slot", T.IntegerType())])
        return self.spark.read.schema(columns).parquet(self.citation_path)

    def _cite(self, mode: str, chunks: DataFrame) -> None:
        citations(chunks).write.mode(mode).partitionBy("slot").parquet(self.citation_path)

    def exists(self) -> bool:
        try:
            self.read()
        except AnalysisException:
            return False
        return True

    def append(self, index: DataFrame, dedupe: bool = False) -> None:
        """Add chunks; ``dedupe`` leaves out chunk keys that are there already."""
        keys = ["doc_id", "source", "chunk_id"]
        if dedupe:
            index = index.dropDuplicates(keys)
            if self.exists():
                index = index.join(self.read().select(*keys), keys, "left_anti")
        index = cut(index, "new-chunks")
        index.write.mode("append").parquet(self.path)
        self._cite("append", index)

    def reset(self, index: DataFrame) -> None:
        """Replace all chunks."""
        index.write.mode("overwrite").parquet(self.path)
        self._cite("overwrite", self.read())

    def count(self) -> int:
        return self.read().count() if self.exists() else 0
