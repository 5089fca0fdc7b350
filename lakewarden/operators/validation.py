"""Detected metrics against an expected ground truth."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .quality import records_involved, table_rows

# Metric map (table, metric, kind, field, dimension) of the five-table model.
METRICS = [
    ("clientes", "rows", "rows", None, None),
    ("clientes", "duplicate_dni_records", "involved", "dni", None),
    ("clientes", "invalid_dni_records", "finding", "dni", "validity"),
    ("clientes", "invalid_email_records", "finding", "correo", "validity"),
    ("clientes", "missing_telefono_records", "finding", "telefono", "completeness"),
    ("clientes", "missing_segmento_records", "finding", "segmento", "completeness"),
    ("clientes", "possible_sensitive_fields", "sensitive", None, None),
    ("productos", "rows", "rows", None, None),
    ("productos", "duplicate_sku_records", "involved", "sku", None),
    ("productos", "negative_price_records", "finding", "precio", "validity"),
    ("productos", "future_fecha_alta_records", "finding", "fecha_alta", "validity"),
    ("productos", "missing_moneda_records", "finding", "moneda", "completeness"),
    (
        "productos", "invalid_proveedor_reference_records", "finding", "proveedor_id",
        "referential_integrity",
    ),
    ("proveedores", "rows", "rows", None, None),
    ("proveedores", "duplicate_ruc_records", "involved", "ruc", None),
    ("proveedores", "invalid_ruc_records", "finding", "ruc", "validity"),
    ("proveedores", "missing_correo_records", "finding", "correo", "completeness"),
    ("ventas", "rows", "rows", None, None),
    (
        "ventas", "invalid_cliente_reference_records", "finding", "cliente_id",
        "referential_integrity",
    ),
    (
        "ventas", "invalid_producto_reference_records", "finding", "producto_id",
        "referential_integrity",
    ),
    ("ventas", "zero_quantity_records", "finding", "cantidad", "validity"),
    ("ventas", "future_fecha_venta_records", "finding", "fecha_venta", "validity"),
    ("ventas", "total_mismatch_records", "finding", "total", "accuracy"),
    ("ventas", "missing_canal_records", "finding", "canal", "completeness"),
    (
        "ventas", "invalid_sucursal_reference_records", "finding", "sucursal_id",
        "referential_integrity",
    ),
]
SOFT_PREFIX = "duplicate_"


def finding_count(metrics: DataFrame, found: DataFrame) -> DataFrame:
    """V2: affected count of the first finding that fits table, field and dimension, else 0."""
    first = (
        found.withColumn("field", F.lower("field"))
        .withColumnRenamed("quality_dimension", "dimension")
        .groupBy("table", "field", "dimension")
        .agg(
            F.min_by("affected_count", F.struct("check_seq", "col_ordinal")).alias("affected_count")
        )
    )
    return metrics.join(first, ["table", "field", "dimension"], "left").select(
        "table",
        "metric",
        F.coalesce("affected_count", F.lit(0).cast("bigint")).cast("string").alias("detected"),
    )


def detected_metrics(
    tables: dict[str, DataFrame],
    found: DataFrame,
    profiles: DataFrame,
    metrics: list[tuple] | None = None,
) -> DataFrame:
    """V3: ``table, metric, detected``; lists are JSON text."""
    metrics = METRICS if metrics is None else metrics
    spark = found.sparkSession
    plan = spark.createDataFrame(
        [m for m in metrics if m[0] in tables],
        "table string, metric string, kind string, field string, dimension string",
    )
    rows = table_rows(tables).select(
        "table", F.lit("rows").alias("kind"), F.col("rows").cast("string").alias("detected")
    )
    lists = profiles.select(
        "table",
        F.lit("sensitive").alias("kind"),
        F.to_json(F.transform("sensitive_fields", F.lower)).alias("detected"),
    )
    parts = [
        plan.join(rows.unionByName(lists), ["table", "kind"]).select("table", "metric", "detected"),
        finding_count(plan.filter("kind = 'finding'"), found),
    ]
    for name, df in tables.items():
        present = {c.lower() for c in df.columns}
        wanted = [
            (m[1], m[3]) for m in metrics if m[0] == name and m[2] == "involved" and m[3] in present
        ]
        if wanted:
            lookup = spark.createDataFrame(wanted, "metric string, field string")
            parts.append(
                records_involved(df, [f for _, f in wanted])
                .join(lookup, "field")
                .select(F.lit(name).alias("table"), "metric", F.col("involved").cast("string").alias("detected"))
            )
    return reduce(DataFrame.unionByName, parts)


def compare(expected: DataFrame, detected: DataFrame) -> DataFrame:
    """V4: equality, or superset for a list; an absent metric counts as 0."""
    both = expected.join(detected, ["table", "metric"], "left").withColumn(
        "detected", F.coalesce("detected", F.lit("0"))
    )
    want = F.from_json("expected", "array<string>")
    have = F.from_json("detected", "array<string>")
    as_list = F.col("expected").startswith("[")
    return both.select(
        "table",
        "metric",
        "expected",
        "detected",
        F.when(as_list, F.coalesce(F.size(F.array_except(want, have)) == 0, F.lit(False)))
        .otherwise(F.col("expected") == F.col("detected"))
        .alias("ok"),
        (~F.col("metric").startswith(SOFT_PREFIX)).alias("hard"),
    )


def hard_failures(checks: DataFrame) -> DataFrame:
    """V5."""
    return checks.filter("hard AND NOT ok")


def pass_rate(checks: DataFrame) -> DataFrame:
    """V5: per table passed, total and hard failures."""
    return checks.groupBy("table").agg(
        F.count_if(F.col("ok")).alias("passed"),
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("hard") & ~F.col("ok")).alias("hard_failures"),
    )


__all__ = ["METRICS", "compare", "detected_metrics", "hard_failures", "pass_rate"]
