"""Tables from CSV and Parquet."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.naming import criticality_from_flag, dictionary_classification
from ..functions.text import strip

# Cell texts that the usual CSV readers take as missing.
MISSING_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)
SEPARATORS = (",", ";", "\t", "|")
DEFAULT_TABLES = ("clientes", "productos", "proveedores", "sucursales", "ventas")


def detect_separator(spark: SparkSession, path: str, lines: int = 20) -> str:
    """Separator that splits the first lines most evenly; reads ``lines`` rows."""
    head = [r.value for r in spark.read.text(path).limit(lines).collect() if r.value]
    if not head:
        return ","

    def fit(sep: str) -> tuple[int, int]:
        counts = [line.count(sep) for line in head]
        return (sum(c == counts[0] for c in counts) if counts[0] else 0, counts[0])

    return max(SEPARATORS, key=fit)


def detect_format(spark: SparkSession, path: str) -> tuple[str, bool]:
    """Encoding, and whether a quoted cell runs over several lines; one distributed pass.

    UTF-8 if every line is valid, else Latin-1. A line with an odd number of quotes opens or closes such a cell.
    """
    found = spark.read.text(path).agg(
        F.coalesce(F.bool_and(F.is_valid_utf8("value")), F.lit(True)).alias("valid"),
        F.coalesce(F.bool_or(F.regexp_count("value", F.lit('"')) % 2 == 1), F.lit(False)).alias("broken"),
    ).first()
    return "UTF-8" if found["valid"] else "ISO-8859-1", found["broken"]


def read_csv(
    spark: SparkSession,
    path: str,
    sep: str | None = None,
    encoding: str | None = None,
    missing: tuple[str, ...] = MISSING_TOKENS,
    row_id: str | None = None,
    multi_line: bool | None = None,
) -> DataFrame:
    """Every column as text, header row, missing words as null.

    ``row_id`` adds a number that identifies rows and grows with the place in a file. Line breaks inside quotes cost one
    task per file, so they are looked for unless ``multi_line`` says what to expect.
    """
    if encoding is None or multi_line is None:
        found = detect_format(spark, path)
        encoding, multi_line = encoding or found[0], found[1] if multi_line is None else multi_line
    df = (
        spark.read.option("header", True)
        .option("sep", sep or detect_separator(spark, path))
        .option("encoding", encoding)
        .option("escape", '"')
        .option("multiLine", multi_line)
        .csv(path)
    )
    cells = [
        F.when(~F.col(f"`{c}`").isin(*missing), F.col(f"`{c}`")).alias(c.lstrip("﻿"))
        for c in df.columns
    ]
    out = df.select(*cells)
    return out.withColumn(row_id, F.monotonically_increasing_id()) if row_id else out


def load_tables(
    spark: SparkSession, folder: str, names: tuple[str, ...] = DEFAULT_TABLES, **options
) -> dict[str, DataFrame]:
    """The named CSV files that exist in a folder, also as temporary views."""
    wanted = [f"{n}.csv" for n in names]
    found = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", "*.csv")
        .load(folder)
        .select(F.element_at(F.split("path", "/"), -1).alias("name"))
        .filter(F.col("name").isin(wanted))
    )
    present = {r.name for r in found.collect()}
    tables = {}
    for name in names:
        if f"{name}.csv" in present:
            tables[name] = read_csv(spark, f"{folder.rstrip('/')}/{name}.csv", **options)
            tables[name].createOrReplaceTempView(name)
    return tables


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One Parquet table of a folder."""
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def table_inventory(tables: dict[str, DataFrame]) -> DataFrame:
    """``table, rows, columns``."""
    return reduce(
        DataFrame.unionByName,
        [
            df.agg(F.count(F.lit(1)).alias("rows")).select(
                F.lit(name).alias("table"), "rows", F.lit(len(df.columns)).alias("columns")
            )
            for name, df in tables.items()
        ],
    )


# Column names of a data dictionary file.
DICTIONARY_COLUMNS = {
    "descripcion_negocio": "business_definition",
    "data_owner_sugerido": "data_owner",
    "data_steward_sugerido": "data_steward",
    "regla_calidad_base": "base_rule",
    "sistema_origen": "source_system",
}


def data_dictionary(raw: DataFrame, order_col: str) -> DataFrame:
    """One row per lower-case ``(table, field)``; the last row of a key wins."""
    present = {c.lower(): c for c in raw.columns}

    def cell(name: str, default: str = ""):
        if name not in present:
            return F.lit(default)
        return F.coalesce(strip(F.col(f"`{present[name]}`")), F.lit(default))

    rows = raw.select(
        F.lower(cell("tabla")).alias("table"),
        F.lower(cell("campo")).alias("field"),
        dictionary_classification(cell("clasificacion")).alias("classification"),
        criticality_from_flag(cell("es_critico", "No")).alias("criticality"),
        *[cell(old).alias(new) for old, new in DICTIONARY_COLUMNS.items()],
        F.col(f"`{order_col}`").alias("place"),
    ).filter("table <> '' AND field <> ''")
    last = Window.partitionBy("table", "field").orderBy(F.col("place").desc())
    return (
        rows.withColumn("copy", F.row_number().over(last)).filter("copy = 1").drop("copy", "place")
    )


def expected_metrics(spark: SparkSession, path: str) -> DataFrame:
    """``table, metric, expected`` from ``{table: {metric: number or list}}``."""
    return parse_expected(spark.read.text(path, wholetext=True))


def parse_expected(raw: DataFrame) -> DataFrame:
    """S7 on a ``value`` column; lists stay JSON text."""
    doc = F.from_json("value", "map<string, map<string, string>>")
    return raw.select(F.explode(doc).alias("table", "metrics")).select(
        "table", F.explode("metrics").alias("metric", "expected")
    )


def expected_from_dict(spark: SparkSession, expected: dict) -> DataFrame:
    return parse_expected(spark.createDataFrame([(json.dumps(expected),)], "value string"))
