"""Value counts per column: the shared shuffle under distinct counts, duplicates and spellings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def as_text(df: DataFrame, name: str) -> Column:
    """Column as text; ``-0.0`` and ``0.0`` become the same text."""
    col = F.col(f"`{name}`")
    kind = df.schema[name].dataType
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return (col + F.lit(0.0).cast(kind)).cast("string")
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        return F.to_json(col)
    if isinstance(kind, T.BinaryType):
        return F.hex(col)
    return col.cast("string")


def from_text(text: Column, kind: T.DataType) -> Column:
    """The value that ``as_text`` wrote."""
    if isinstance(kind, T.MapType) and not isinstance(kind.keyType, T.StringType):
        named = F.from_json(text, T.MapType(T.StringType(), kind.valueType))
        return F.transform_keys(named, lambda k, _: k.try_cast(kind.keyType))
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        return F.from_json(text, kind)
    if isinstance(kind, T.BinaryType):
        return F.unhex(text)
    return text.try_cast(kind)


def short_key(text: Column, most: int = 64) -> Column:
    """The text, or a digest (SHA-256) of one longer than ``most``; equal exactly when the texts are."""
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.lit("#"), F.sha2(text, 256)))


def long_form(df: DataFrame, columns: list[str], digest: bool = False) -> DataFrame:
    """``(ordinal, value)`` rows for the named columns, by one Expand over the scan."""
    texts = [as_text(df, c) for c in columns]
    if digest:
        texts = [short_key(t) for t in texts]
    wide = df.select(*[t.alias(f"c{i}") for i, t in enumerate(texts)])
    return wide.unpivot([], list(wide.columns), "slot", "value").select(
        F.substring("slot", 2, 10).cast("int").alias("ordinal"), "value"
    )


def value_counts(df: DataFrame, columns: list[str], digest: bool = False) -> DataFrame:
    """``(ordinal, value, n)``. Map-side partial counts absorb a value that fills the table."""
    return (
        long_form(df, columns, digest)
        .groupBy("ordinal", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )
