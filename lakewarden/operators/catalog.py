"""Data catalog entries from profiles, findings and a data dictionary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.jsontext import extract_json
from ..functions.naming import classify, default_rules
from ..functions.text import strip
from ..rules import RulePack


def definitions_table(spark: SparkSession, pack: RulePack) -> DataFrame:
    """C3 lookup; its size is the size of the rule pack."""
    return spark.createDataFrame(
        list(pack.definitions.items()), "field_key string, known_definition string"
    )


def ownership_table(spark: SparkSession, pack: RulePack) -> DataFrame:
    """C4 lookup."""
    rows = [(t, o, s) for t, (o, s) in pack.ownership.items()]
    return spark.createDataFrame(rows, "table string, known_owner string, known_steward string")


def target_fields(columns: DataFrame, pack: RulePack) -> DataFrame:
    """Sensitive or identifying fields plus the fields with a known definition."""
    known = definitions_table(columns.sparkSession, pack)
    return (
        columns.withColumn("field_key", F.lower("column"))
        .join(known, "field_key", "left")
        .filter(
            "is_possible_sensitive OR is_possible_identifier OR known_definition IS NOT NULL"
        )
        .select("table", F.col("column").alias("field"), "field_key", "known_definition")
    )


def rules_by_field(found: DataFrame) -> DataFrame:
    """Sorted distinct suggested rules per field."""
    return found.groupBy("table", "field").agg(
        F.sort_array(F.collect_set("suggested_rule")).alias("found_rules")
    )


def _filled(name: str) -> Column:
    return F.when(F.col(name) != "", F.col(name))


def catalog(
    columns: DataFrame,
    found: DataFrame,
    pack: RulePack,
    dictionary: DataFrame | None = None,
    definitions_feed: DataFrame | None = None,
) -> DataFrame:
    """C1 to C7. One row per catalogued field, ordered by ``table, field`` if a caller sorts it."""
    spark = columns.sparkSession
    entries = (
        target_fields(columns, pack)
        .join(rules_by_field(found), ["table", "field"], "left")
        .join(ownership_table(spark, pack), "table", "left")
        .withColumn("kind", classify(F.col("field")))
    )
    if dictionary is None:
        dictionary = spark.createDataFrame(
            [],
            "table string, field string, business_definition string, classification string, "
            "criticality string, data_owner string, data_steward string, base_rule string",
        )
    words = dictionary.select(
        F.col("table").alias("table_key"),
        F.col("field").alias("field_key"),
        F.col("business_definition").alias("d_definition"),
        F.col("classification").alias("d_classification"),
        F.col("criticality").alias("d_criticality"),
        F.col("data_owner").alias("d_owner"),
        F.col("data_steward").alias("d_steward"),
        F.col("base_rule").alias("d_rule"),
    )
    entries = entries.withColumn("table_key", F.lower("table")).join(
        words, ["table_key", "field_key"], "left"
    )
    if definitions_feed is None:
        entries = entries.withColumn("f_definition", F.lit(None).cast("string"))
    else:
        entries = entries.join(
            definitions_feed.select(
                "table", "field_key", F.col("business_definition").alias("f_definition")
            ),
            ["table", "field_key"],
            "left",
        )
    generated = F.concat(
        F.lit("Field "), F.col("field"), F.lit(" of table "), F.col("table")
    )
    owner, steward = pack.default_owner
    base = F.coalesce("found_rules", default_rules(F.col("field")))
    return entries.select(
        "table",
        "field",
        F.coalesce(
            _filled("f_definition"), _filled("d_definition"), "known_definition", generated
        ).alias("business_definition"),
        F.coalesce(_filled("d_classification"), F.col("kind.classification")).alias(
            "classification"
        ),
        F.coalesce(_filled("d_criticality"), F.col("kind.criticality")).alias("criticality"),
        F.coalesce(_filled("d_owner"), "known_owner", F.lit(owner)).alias("data_owner"),
        F.coalesce(_filled("d_steward"), "known_steward", F.lit(steward)).alias("data_steward"),
        F.when(F.col("table").isin(*pack.daily_tables), "daily")
        .otherwise("on event")
        .alias("update_frequency"),
        F.when(_filled("d_rule").isNull() | F.array_contains(base, F.col("d_rule")), base)
        .otherwise(F.array_append(base, F.col("d_rule")))
        .alias("quality_rules"),
    )


def definitions_from_responses(
    responses: DataFrame, column: str = "response", order_col: str | None = None
) -> DataFrame:
    """Definitions out of raw JSON texts ``{"entries": [{"field", "business_definition"}]}``.

    Input needs ``table``; blank definitions are dropped, the last entry of a field wins: that of the last response by
    ``order_col``, and within it the last one. Without an order column, and among equal ones, the greatest text decides, so
    the result never depends on how the rows lie.
    """
    shape = "STRUCT<entries: ARRAY<STRUCT<field: STRING, business_definition: STRING>>>"
    parsed = responses.select(
        "table",
        (F.col(order_col) if order_col else F.lit(0)).alias("turn"),
        F.from_json(extract_json(F.col(column)), shape).alias("doc"),
    )
    return (
        parsed.select("table", "turn", F.posexplode("doc.entries").alias("pos", "e"))
        .select(
            "table",
            "turn",
            "pos",
            F.lower(F.coalesce("e.field", F.lit(""))).alias("field_key"),
            F.col("e.business_definition").alias("business_definition"),
        )
        .filter(F.coalesce(strip(F.col("business_definition")), F.lit("")) != "")
        .groupBy("table", "field_key")
        .agg(F.max_by("business_definition", F.struct("turn", "pos", "business_definition")).alias("business_definition"))
    )
