"""Executive report tables: KPIs, risks, summary and report lines."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..rules import RulePack


def overall_score(report: DataFrame) -> DataFrame:
    """Mean score, halves to the even number, 100 without tables."""
    return report.agg(
        F.coalesce(F.bround(F.avg("quality_score"), 0).cast("bigint"), F.lit(100)).alias(
            "overall_score"
        )
    )


def risks(report: DataFrame, duplicates: DataFrame, profiles: DataFrame) -> DataFrame:
    """``seq, risk``. ``profiles`` and ``report`` carry ``table_seq``."""
    high = report.filter("risk_level = 'high'").select(
        F.lit(1).alias("part"),
        F.col("table_seq").alias("place"),
        F.concat(
            F.lit("Table "), F.col("table"), F.lit(" has a high quality risk (score "),
            F.col("quality_score").cast("string"), F.lit(")."),
        ).alias("risk"),
    )
    dupes = duplicates.filter("duplicates_detected > 0").select(
        F.lit(2).alias("part"),
        F.col("entity_seq").alias("place"),
        F.concat(
            F.col("duplicates_detected").cast("string"), F.lit(" possible duplicates in "),
            F.col("entity"), F.lit(" (single view at risk)."),
        ).alias("risk"),
    )
    sensitive = profiles.filter(F.size("sensitive_fields") > 0).select(
        F.lit(3).alias("part"),
        F.col("table_seq").alias("place"),
        F.concat(
            F.lit("Personal data without formal classification in "), F.col("table"),
            F.lit(": "), F.array_join("sensitive_fields", ", "), F.lit("."),
        ).alias("risk"),
    )
    return (
        high.unionByName(dupes)
        .unionByName(sensitive)
        .select(F.row_number().over(Window.orderBy("part", "place")).alias("seq"), "risk")
    )


def kpis(
    report: DataFrame,
    found: DataFrame,
    duplicates: DataFrame,
    profiles: DataFrame,
    catalog: DataFrame,
) -> DataFrame:
    """The seven KPIs as ``seq, kpi, value``."""
    zero = F.lit(0).cast("bigint")
    n = F.count(F.lit(1))
    parts = [
        ("datasets_analysed", profiles, n),
        ("findings_detected", found, n),
        (
            "suggested_rules",
            found.filter("suggested_rule <> ''").select("suggested_rule").distinct(),
            n,
        ),
        ("duplicates_detected", duplicates, F.coalesce(F.sum("duplicates_detected"), zero)),
        ("sensitive_fields", profiles, F.coalesce(F.sum(F.size("sensitive_fields")), zero)),
        ("catalogued_fields", catalog, n),
        ("mean_score", overall_score(report), F.max("overall_score")),
    ]
    rows = [
        df.agg(value.cast("bigint").alias("value")).select(
            F.lit(i).alias("seq"), F.lit(name).alias("kpi"), "value"
        )
        for i, (name, df, value) in enumerate(parts, 1)
    ]
    return reduce(DataFrame.unionByName, rows)


def summary(kpi: DataFrame, profiles: DataFrame, risk: DataFrame) -> DataFrame:
    """``executive_summary`` and ``facts``, one row."""

    def value(name: str) -> Column:
        return F.max(F.when(F.col("kpi") == name, F.col("value"))).cast("string").alias(name)

    wide = kpi.agg(
        *[
            value(k)
            for k in (
                "datasets_analysed",
                "findings_detected",
                "duplicates_detected",
                "sensitive_fields",
                "mean_score",
            )
        ]
    ).withColumn("one", F.lit(1))
    names = profiles.agg(
        F.array_join(
            F.transform(
                F.sort_array(F.collect_list(F.struct("table_seq", "table"))), lambda s: s["table"]
            ),
            ", ",
        ).alias("names")
    ).withColumn("one", F.lit(1))
    top = risk.filter("seq <= 4").agg(
        F.array_join(
            F.transform(
                F.sort_array(F.collect_list(F.struct("seq", "risk"))), lambda s: s["risk"]
            ),
            "; ",
        ).alias("top_risks")
    ).withColumn("one", F.lit(1))
    row = wide.join(names, "one").join(top, "one")
    return row.select(
        F.concat(
            F.lit("Analysed "), "datasets_analysed", F.lit(" datasets with an overall quality score of "),
            "mean_score", F.lit("/100. Found "), "findings_detected",
            F.lit(" quality findings and "), "duplicates_detected",
            F.lit(" possible duplicates. "), "sensitive_fields",
            F.lit(" fields with personal data need classification and owners."),
        ).alias("executive_summary"),
        F.concat(
            F.lit("Datasets: "), "names", F.lit(". Overall score: "), "mean_score",
            F.lit("/100. Findings: "), "findings_detected", F.lit(". Duplicates: "),
            "duplicates_detected", F.lit(". Sensitive fields: "), "sensitive_fields",
            F.lit(". Risks: "),
            F.when(F.col("top_risks") == "", "none relevant").otherwise(F.col("top_risks")),
            F.lit("."),
        ).alias("facts"),
    )


def _section(df: DataFrame, number: int, order: list, line: Column) -> DataFrame:
    """Lines of one section with a common sort key of four numbers and a text."""
    keys = [*order, *[F.lit(0)] * (4 - len(order))]
    return df.select(
        F.lit(number).alias("section"),
        *[k.cast("bigint").alias(f"k{i}") for i, k in enumerate(keys)],
        line.alias("line"),
    )


def _nothing(df: DataFrame) -> DataFrame:
    """One row if the table is empty, else none."""
    return df.agg(F.count("*").alias("n")).filter("n = 0")


def _report_rules(found: DataFrame) -> DataFrame:
    """Distinct suggested rules per field, at the place where each first appears."""
    return (
        found.filter("suggested_rule <> ''")
        .groupBy("table", "table_seq", "field", "suggested_rule")
        .agg(F.min(F.struct("check_seq", "col_ordinal")).alias("place"))
    )


def first_groups(groups: DataFrame, members: DataFrame, limit: int = 10) -> DataFrame:
    """The first groups per entity and, for each, all of its member ids as text.

    ``limit`` is the report's number of groups; the line of a group names every member.
    """
    per_entity = Window.partitionBy("entity").orderBy(
        F.when(F.col("match_type") == "exact_key", 0).otherwise(1),
        F.when(F.col("match_type") == "exact_key", F.col("group_id")),
        "first_ord",
    )
    top = groups.withColumn("place", F.row_number().over(per_entity)).filter(F.col("place") <= limit)
    ids = (
        members.join(top.select("entity", "group_id"), ["entity", "group_id"])
        .groupBy("entity", "group_id")
        .agg(
            F.array_join(
                F.transform(F.sort_array(F.collect_list(F.struct("ord", "member_id"))), lambda s: s["member_id"]), ", "
            ).alias("ids")
        )
    )
    return top.join(ids, ["entity", "group_id"]).select(
        "entity", "place", "match_type", "confidence", "size", "ids"
    )


def report_lines(tables: dict[str, DataFrame], pack: RulePack) -> DataFrame:
    """``section, seq, line`` of the report: title and overall score, ten sections, KPIs.

    A section without rows says so.

    ``tables`` holds ``summary, report, findings, profiles, duplicates, first_groups, risks,
    recommendations, kpis`` as the other functions return them.
    """
    report, profiles = tables["report"], tables["profiles"]
    found = tables["findings"].join(report.select("table", "table_seq"), "table")
    c = F.col
    text = F.concat
    spark = report.sparkSession
    roadmap = spark.createDataFrame(list(enumerate(pack.roadmap, 1)), "step int, text string")
    recs = tables["recommendations"]
    parts = [
        _section(spark.range(1), 0, [], F.lit("# Data governance report")),
        _section(
            overall_score(report), 0, [F.lit(1)],
            text(F.lit("Overall quality score: "), c("overall_score").cast("string"), F.lit("/100")),
        ),
        _section(_nothing(profiles), 2, [], F.lit("No datasets.")),
        _section(_nothing(tables["risks"]), 8, [], F.lit("No risks detected.")),
        _section(_nothing(recs), 9, [], F.lit("No recommendations.")),
        _section(tables["summary"], 1, [], c("executive_summary")),
        _section(profiles, 2, [c("table_seq")], text(F.lit("- "), c("table"))),
        _section(report, 3, [c("table_seq")], text(F.lit("### "), c("table"))),
        _section(
            report.filter("n_findings = 0"), 3, [c("table_seq"), F.lit(1)],
            F.lit("- No relevant findings."),
        ),
        _section(
            found, 3, [c("table_seq"), F.lit(2), c("check_seq"), c("col_ordinal")],
            text(
                F.lit("- ["), F.upper("severity"), F.lit("] "), "field", F.lit(": "), "problem",
                F.lit(" ("), "quality_dimension", F.lit(") -> "), "suggested_rule",
            ),
        ),
        _section(
            report, 4, [c("table_seq")],
            text(
                F.lit("| "), "table", F.lit(" | "), c("quality_score").cast("string"), F.lit(" | "),
                "risk_level", F.lit(" | "), c("rows").cast("string"), F.lit(" |"),
            ),
        ),
        _section(
            profiles.filter(F.size("sensitive_fields") > 0), 5, [c("table_seq")],
            text(F.lit("- "), "table", F.lit(": "), F.array_join("sensitive_fields", ", ")),
        ),
        _section(
            _report_rules(found), 6,
            [c("table_seq"), c("place.check_seq"), c("place.col_ordinal")],
            text(F.lit("- "), "table", F.lit("."), "field", F.lit(": "), "suggested_rule"),
        ),
        _section(
            tables["duplicates"], 7, [c("entity_seq")],
            text(
                F.lit("### "), "entity", F.lit(": "), c("duplicates_detected").cast("string"),
                F.lit(" duplicates in "), c("n_groups").cast("string"), F.lit(" groups"),
            ),
        ),
        _section(
            tables["first_groups"].join(
                tables["duplicates"].select("entity", "entity_seq"), "entity"
            ),
            7, [c("entity_seq"), F.lit(1), c("place")],
            text(
                F.lit("- ["), "match_type", F.lit(", conf="), c("confidence").cast("string"),
                F.lit("] "), "ids",
            ),
        ),
        _section(tables["risks"], 8, [c("seq")], text(F.lit("- "), c("risk"))),
        _section(
            recs, 9, [c("seq")],
            text(F.lit("- ["), F.upper("priority"), F.lit("] "), "title", F.lit(": "), "suggested_action"),
        ),
        _section(
            recs, 9, [c("seq"), F.lit(1)],
            text(
                F.lit("  - Risk: "), "risk", F.lit(" Responsible: "), "responsible",
                F.lit(". Impact: "), "expected_impact", F.lit(" Effort: "), "estimated_effort",
            ),
        ),
        _section(roadmap, 10, [c("step")], text(c("step").cast("string"), F.lit(". "), c("text"))),
        _section(
            tables["kpis"], 11, [c("seq")],
            text(F.lit("| "), "kpi", F.lit(" | "), c("value").cast("string"), F.lit(" |")),
        ),
    ]
    order = Window.partitionBy("section").orderBy("k0", "k1", "k2", "k3", "line")
    return reduce(DataFrame.unionByName, parts).select(
        "section", F.row_number().over(order).alias("seq"), "line"
    )
