"""Recommendations from findings and duplicate counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.jsontext import extract_json

COLUMNS = [
    "priority",
    "title",
    "risk",
    "suggested_action",
    "responsible",
    "expected_impact",
    "estimated_effort",
]


def table_recommendations(report: DataFrame, found: DataFrame) -> DataFrame:
    """One per table with a high finding, worst score first."""
    high = (
        found.filter("severity = 'high'")
        .groupBy("table")
        .agg(
            F.sort_array(F.collect_set("quality_dimension")).alias("dims"),
            F.slice(F.sort_array(F.collect_set("suggested_rule")), 1, 4).alias("rules"),
        )
    )
    score = F.col("quality_score")
    return report.join(high, "table").select(
        F.lit(1).alias("part"),
        score.cast("bigint").alias("rank"),
        F.col("table_seq").cast("bigint").alias("tie"),
        F.when(score < 65, "high").otherwise("medium").alias("priority"),
        F.concat(F.lit("Improve the quality of table "), F.col("table")).alias("title"),
        F.concat(
            F.lit("Score "), score.cast("string"), F.lit("/100 ("), F.col("risk_level"),
            F.lit(" risk); dimensions affected: "), F.array_join("dims", ", "), F.lit("."),
        ).alias("risk"),
        F.concat(F.lit("Implement validation rules: "), F.array_join("rules", "; ")).alias(
            "suggested_action"
        ),
        F.concat(F.lit("Data owner of "), F.col("table")).alias("responsible"),
        F.lit("Fewer errors and more trust in the reports.").alias("expected_impact"),
        F.lit("medium").alias("estimated_effort"),
    )


def entity_recommendations(duplicates: DataFrame) -> DataFrame:
    """R2: one per entity with duplicates."""
    return duplicates.filter("duplicates_detected > 0").select(
        F.lit(2).alias("part"),
        F.col("entity_seq").cast("bigint").alias("rank"),
        F.lit(0).cast("bigint").alias("tie"),
        F.lit("high").alias("priority"),
        F.concat(F.lit("Consolidate the duplicates of "), F.col("entity")).alias("title"),
        F.concat(
            F.col("duplicates_detected").cast("string"),
            F.lit(" possible duplicates blur the single view of "), F.col("entity"), F.lit("."),
        ).alias("risk"),
        F.lit("Apply the golden records and the matching rules (key, then similarity).").alias(
            "suggested_action"
        ),
        F.concat(F.lit("Data steward of "), F.col("entity")).alias("responsible"),
        F.lit("Single view of the master entity and fewer duplicates.").alias("expected_impact"),
        F.lit("medium").alias("estimated_effort"),
    )


def recommendations(report: DataFrame, found: DataFrame, duplicates: DataFrame) -> DataFrame:
    """R1 to R3 in order. ``duplicates`` has ``entity, entity_seq, duplicates_detected``."""
    some = table_recommendations(report, found).unionByName(entity_recommendations(duplicates))
    default = report.sparkSession.range(1).select(
        F.lit(3).alias("part"),
        F.lit(0).cast("bigint").alias("rank"),
        F.lit(0).cast("bigint").alias("tie"),
        F.lit("low").alias("priority"),
        F.lit("Keep monitoring quality").alias("title"),
        F.lit("No critical findings.").alias("risk"),
        F.lit("Schedule profiling and define quality thresholds.").alias("suggested_action"),
        F.lit("Data governance").alias("responsible"),
        F.lit("Data quality that lasts.").alias("expected_impact"),
        F.lit("low").alias("estimated_effort"),
    )
    # The default stays only when nothing else is there: it ranks last, so it is first only then.
    order = Window.orderBy("part", "rank", "tie", "title")
    return (
        some.unionByName(default)
        .withColumn("seq", F.row_number().over(order))
        .filter("part < 3 OR seq = 1")
        .select("seq", *COLUMNS)
    )


def finding_lines(found: DataFrame, report: DataFrame, duplicates: DataFrame, limit: int = 60):
    """The first lines of findings in table order, then duplicates per entity."""
    lines = found.join(report.select("table", "table_seq"), "table").select(
        F.lit(1).alias("part"),
        F.col("table_seq").cast("bigint").alias("a"),
        F.col("check_seq").cast("bigint").alias("b"),
        F.col("col_ordinal").cast("bigint").alias("c"),
        F.concat(
            "table", F.lit("."), "field", F.lit(": "), "problem", F.lit(" ["),
            "quality_dimension", F.lit(", "), "severity", F.lit("]"),
        ).alias("line"),
    )
    zero = F.lit(0).cast("bigint")
    dupes = duplicates.filter("duplicates_detected > 0").select(
        F.lit(2).alias("part"),
        F.col("entity_seq").cast("bigint").alias("a"),
        zero.alias("b"),
        zero.alias("c"),
        F.concat(
            F.col("entity"), F.lit(": "), F.col("duplicates_detected").cast("string"),
            F.lit(" possible duplicates (MDM)"),
        ).alias("line"),
    )
    top = lines.unionByName(dupes).orderBy("part", "a", "b", "c", "line").limit(limit)
    order = Window.orderBy("part", "a", "b", "c", "line")
    return top.select(F.row_number().over(order).alias("seq"), "line")


def recommendations_from_responses(responses: DataFrame, column: str = "response") -> DataFrame:
    """Recommendations out of raw JSON texts, with defaults for absent keys."""
    fields = ", ".join(f"{c}: STRING" for c in COLUMNS)
    parsed = responses.select(
        "response_id",
        F.from_json(
            extract_json(F.col(column)), f"STRUCT<recommendations: ARRAY<STRUCT<{fields}>>>"
        ).alias("doc"),
    )
    items = parsed.select("response_id", F.posexplode("doc.recommendations").alias("pos", "r"))
    return items.select(
        "response_id",
        (F.col("pos") + 1).alias("seq"),
        *[
            F.coalesce(f"r.{c}", F.lit("medium" if c == "priority" else "")).alias(c)
            for c in COLUMNS
        ],
    )
