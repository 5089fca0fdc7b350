"""Helpers shared by the operators: durable intermediates, batches bounded by bytes, the held-out split."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakewarden.session import checkpoint_root

#: White space of the word rule: space and U+0009 to U+000D.
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


class Scratch:
    """Tables of one job in the shared folder; ``drop`` removes what no later step reads."""

    def __init__(self, spark: SparkSession, job: str):
        self.spark = spark
        self.root = f"{checkpoint_root(spark).rstrip('/')}/lakewarden/{job}-{uuid.uuid4().hex}"
        self.made = 0
        self.paths: dict[int, str] = {}

    def keep(self, df: DataFrame, tag: str, light: bool = False) -> DataFrame:
        """Write ``df`` once and read it back: later steps survive the loss of any executor.

        A ``light`` table, a few columns of a part of the rows, goes to an eighth as many files as a shuffle has
        partitions: every file costs calls to the store, and with a local one new processes.
        """
        if light:
            df = df.coalesce(max(1, int(self.spark.conf.get("spark.sql.shuffle.partitions")) // 8))
        self.made += 1
        path = f"{self.root}/{self.made}-{tag}"
        df.write.parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(back)] = path
        # shuffles of plans that are done are deleted once the collector has seen that nobody holds them
        del df
        gc.collect()
        self.spark._jvm.System.gc()
        return back

    def keep_parts(self, df: DataFrame, tag: str, by: str, values: list[int]) -> list[DataFrame]:
        """Write ``df`` once and read back a table for each value of ``by``, so that they can be dropped one by one."""
        self.made += 1
        path = f"{self.root}/{self.made}-{tag}"
        df.write.partitionBy(by).parquet(path)
        schema = T.StructType([f for f in df.schema if f.name != by])
        out = []
        for value in values:
            own = f"{path}/{by}={value}"
            place = self.spark._jvm.org.apache.hadoop.fs.Path(own)
            place.getFileSystem(self.spark._jsc.hadoopConfiguration()).mkdirs(place)  # there may be no such row
            out.append(self.spark.read.schema(schema).parquet(own).withColumn(by, F.lit(value)))
            self.paths[id(out[-1])] = own
        return out

    def drop(self, *tables: DataFrame) -> None:
        for table in tables:
            self._delete(self.paths.pop(id(table)))

    def drop_all(self) -> None:
        """Remove every table of the job."""
        self.paths.clear()
        self._delete(self.root)

    def _delete(self, path: str) -> None:
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(place, True)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def held_out(doc_id: str = "doc_id") -> Column:
    """True where crc32 of the id as text leaves 1 on division by 3; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def by_bytes(
    batches: Iterable[pa.RecordBatch], column: str | int, most: int = 4_000_000
) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose texts hold about ``most`` bytes; a longer text stands alone."""
    for batch in batches:
        sizes = pa.compute.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
        start = total = 0
        for i, size in enumerate(sizes):
            if total and total + size > most:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += int(size)
        if start < batch.num_rows:
            yield batch.slice(start)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``run`` for mapInArrow, with the memory given back to the system when a task ends.

    Python workers live on for later stages, and what they keep counts against those.
    """

    @wraps(run)
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):  # another C library
            pass

    return whole


def share(rows: Column, total: int, wanted: int) -> Column:
    """Whether a row belongs to a sample of about ``wanted`` of ``total`` rows, decided by a hash."""
    part = min(1.0, wanted / max(1, total))
    return F.pmod(F.xxhash64(rows, F.lit("sample")), F.lit(1 << 30)) < int(part * (1 << 30))


def kept_columns(docs: DataFrame, keep: list[str], new: list[str]) -> tuple[list[str], list[Column], list[T.StructField]]:
    """The columns of ``keep`` whose names, in any case, are not among ``new``, as columns named by their place and as the
    fields they become again; names may hold any sign."""
    taken = {c.lower() for c in new}
    names = [c for c in keep if c.lower() not in taken]
    fields = [T.StructField(c, docs.schema[c].dataType) for c in names]
    return names, [docs[f"`{c.replace('`', '``')}`"].alias(f"__{i}") for i, c in enumerate(names)], fields
