"""Quality checks, findings, score and table report."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import (
    WHITESPACE,
    is_missing,
    missing_sql,
    normalize_text,
    sql_text,
    strip,
)
from ..rules import ArithmeticRule, RulePack
from ..session import cut
from .skew import join_per_key
from .values import as_text, value_counts

FINDING_COLUMNS = [
    "table",
    "field",
    "rule_code",
    "problem",
    "quality_dimension",
    "severity",
    "suggested_rule",
    "affected_count",
    "check_seq",
    "col_ordinal",
]
# Order of the checks inside one table report.
SEQ = {
    "completeness": 1,
    "uniqueness": 2,
    "format": 3,
    "negative": 6,
    "zero": 7,
    "future": 8,
    "variants": 9,
    "accuracy": 10,
    "reference": 11,
    "classification": 12,
}


@dataclass(frozen=True)
class RowCheck:
    """A check that counts rows by a SQL predicate; all checks of a table share one aggregate."""

    field: str
    code: str
    dimension: str
    severity: str
    problem: str
    rule: str
    seq: int
    ordinal: int
    bad: str


def _lookup(df: DataFrame) -> dict[str, str]:
    return {c.lower(): c for c in df.columns}


def _is_critical(name: str, pack: RulePack) -> bool:
    """F10 for a name the driver already knows."""
    low = name.lower()
    return low.endswith("_id") or low == "sku" or any(h in low for h in pack.quality_hints)


def completeness_checks(df: DataFrame, pack: RulePack) -> list[RowCheck]:
    """Q1."""
    kinds = dict(df.dtypes)
    out = []
    for i, name in enumerate(df.columns):
        critical = _is_critical(name, pack)
        out.append(
            RowCheck(
                name, "missing", "completeness", "high" if critical else "medium",
                "missing or blank values",
                f"{'Mandatory' if critical else 'Recommended'} field: no blanks",
                SEQ["completeness"], i, missing_sql(name, kinds[name]),
            )
        )
    return out


def _future_sql(name: str, kind: str, pack: RulePack, as_of: date) -> str:
    """F9 and the comparison with the given day."""
    if kind in ("date", "timestamp", "timestamp_ntz"):
        when = f"cast(`{name}` AS TIMESTAMP)"
    else:
        text = f"btrim(cast(`{name}` AS STRING), '{WHITESPACE}')"
        tries = [f"try_to_timestamp({text}, {sql_text(f)})" for f in pack.date_formats]
        when = f"coalesce({', '.join(tries)}, try_cast({text} AS TIMESTAMP))"
    return f"{when} > timestamp'{as_of.isoformat()} 00:00:00'"


def validity_checks(df: DataFrame, pack: RulePack, as_of: date) -> list[RowCheck]:
    """Q3a to Q3f."""
    present = _lookup(df)
    out = []
    for k, rule in enumerate(pack.formats):
        for j, wanted in enumerate(rule.columns):
            if wanted in present:
                name = present[wanted]
                text = f"btrim(cast(`{name}` AS STRING), '{WHITESPACE}')"
                bad = f"NOT {missing_sql(name)} AND NOT ({text} RLIKE {sql_text(rule.pattern)})"
                out.append(
                    RowCheck(
                        name, rule.code, "validity", rule.severity, rule.problem, rule.rule,
                        SEQ["format"] + k, j, bad,
                    )
                )
    kinds = dict(df.dtypes)
    for i, name in enumerate(df.columns):
        low = name.lower()
        number = f"try_cast(`{name}` AS DOUBLE)"
        if any(h in low for h in pack.non_negative_hints):
            out.append(
                RowCheck(
                    name, "negative", "validity", "high", "negative values",
                    f"{name} cannot be negative", SEQ["negative"], i, f"{number} < 0",
                )
            )
        if low in pack.non_zero_columns:
            out.append(
                RowCheck(
                    name, "zero", "validity", "medium", "rows with zero",
                    f"{name} must be greater than 0", SEQ["zero"], i, f"{number} = 0",
                )
            )
        if any(h in low for h in pack.date_hints):
            out.append(
                RowCheck(
                    name, "future_date", "validity", "medium", "dates in the future",
                    f"{name} cannot be a future date", SEQ["future"], i,
                    _future_sql(name, kinds[name], pack, as_of),
                )
            )
    return out


def accuracy_checks(df: DataFrame, rules: tuple[ArithmeticRule, ...]) -> list[RowCheck]:
    """Q5: two expressions that must agree within a tolerance."""
    present = _lookup(df)
    return [
        RowCheck(
            present.get(rule.field, rule.field), "arithmetic", "accuracy", "high", rule.problem,
            rule.rule, SEQ["accuracy"], i,
            f"abs(({rule.left}) - ({rule.right})) > {rule.tolerance}D",
        )
        for i, rule in enumerate(rules)
        if set(rule.columns) <= set(present)
    ]


def _row_sql(table, field, code, problem, dimension, severity, rule, count, seq, ordinal) -> str:
    """One finding as a struct; every argument is SQL text."""
    values = [table, field, code, problem, dimension, severity, rule]
    values += [f"cast({count} AS BIGINT)", f"cast({seq} AS INT)", f"cast({ordinal} AS INT)"]
    return "named_struct(" + ", ".join(f"'{n}', {v}" for n, v in zip(FINDING_COLUMNS, values)) + ")"


def run_row_checks(table: str, df: DataFrame, checks: list[RowCheck]) -> DataFrame:
    """All row checks in one aggregate and one scan, then one row per check that found something."""
    counts = df.agg(*[F.expr(f"count_if({c.bad})").alias(f"n{i}") for i, c in enumerate(checks)])
    rows = [
        _row_sql(
            sql_text(table), sql_text(c.field), sql_text(c.code),
            f"concat(cast(n{i} AS STRING), {sql_text(' ' + c.problem)})",
            sql_text(c.dimension), sql_text(c.severity), sql_text(c.rule),
            f"n{i}", c.seq, c.ordinal,
        )
        for i, c in enumerate(checks)
    ]
    return counts.selectExpr(f"inline(array({', '.join(rows)}))").filter("affected_count > 0")


@dataclass(frozen=True)
class ValueSlot:
    """A column whose distinct values are checked."""

    table: str
    field: str
    kind: str
    ordinal: int


def value_slots(tables: dict[str, DataFrame], pack: RulePack) -> list[ValueSlot]:
    """Unique keys, country columns and category columns of all tables."""
    out = []
    for table, df in tables.items():
        keys = pack.unique_keys(table, df.columns)
        out += [ValueSlot(table, k, "key", i) for i, k in enumerate(keys)]
        for i, name in enumerate(df.columns):
            if name.lower() in pack.country_columns:
                out.append(ValueSlot(table, name, "country", i))
            elif name.lower() in pack.category_columns:
                out.append(ValueSlot(table, name, "category", i))
    return out


def slot_values(tables: dict[str, DataFrame], slots: list[ValueSlot]) -> DataFrame:
    """``slot, value, n`` of the non-missing values: one shuffle for all tables and columns."""
    parts = []
    for table, df in tables.items():
        mine = [(i, s) for i, s in enumerate(slots) if s.table == table]
        if mine:
            wide = df.select(*[as_text(df, s.field).alias(f"s{i}") for i, s in mine])
            parts.append(wide.unpivot([], wide.columns, "name", "value"))
    long = reduce(DataFrame.unionByName, parts).selectExpr(
        "cast(substring(name, 2) AS INT) AS slot", "value"
    )
    counted = long.groupBy("slot", "value").agg(F.count(F.lit(1)).alias("n"))
    return counted.filter(f"NOT {missing_sql('value')}")


def _slot_text(slots: list[ValueSlot], name: str) -> str:
    """SQL lookup of a slot attribute by slot number."""
    values = ", ".join(sql_text(str(getattr(s, name))) for s in slots)
    return f"element_at(array({values}), slot + 1)"


def _slot_list(slots: list[ValueSlot], *kinds: str) -> str:
    return ", ".join(str(i) for i, s in enumerate(slots) if s.kind in kinds) or "-1"


def uniqueness_findings(values: DataFrame, slots: list[ValueSlot]) -> DataFrame:
    """Q2: repeated untrimmed values of the unique keys."""
    extras = (
        values.filter(f"slot IN ({_slot_list(slots, 'key')})")
        .groupBy("slot")
        .agg((F.sum("n") - F.count(F.lit(1))).alias("extras"))
        .filter("extras > 0")
        .selectExpr("*", f"{_slot_text(slots, 'field')} AS f")
    )
    row = _row_sql(
        _slot_text(slots, "table"), "f", "'duplicate_key'",
        "concat(cast(extras AS STRING), ' repeated values in an identifier')",
        "'uniqueness'", "'high'", "concat('Validate the uniqueness of ', f)",
        "extras", SEQ["uniqueness"], _slot_text(slots, "ordinal"),
    )
    return extras.selectExpr(f"inline(array({row}))")


def variant_groups(values: DataFrame, slots: list[ValueSlot], pack: RulePack) -> DataFrame:
    """Q4 core: ``slot, canonical, value, n`` with the normalisation run on distinct values only."""
    value = F.col("value")
    country = F.expr(f"slot IN ({_slot_list(slots, 'country')})")
    plain = normalize_text(value)
    known = F.create_map(*[F.lit(x) for item in pack.country_synonyms.items() for x in item])
    return (
        values.filter(f"slot IN ({_slot_list(slots, 'country', 'category')})")
        .withColumn("plain", plain)
        .withColumn(
            "canonical",
            F.when(country, F.coalesce(F.try_element_at(known, F.col("plain")), strip(value))).otherwise(
                F.col("plain")
            ),
        )
        .select("slot", "canonical", "value", "n")
    )


def spelling_variants(df: DataFrame, pack: RulePack, table: str = "") -> DataFrame:
    """Q4 detail: every spelling of a country or category that has more than one."""
    tables = {table: df}
    slots = value_slots(tables, pack)
    groups = variant_groups(slot_values(tables, slots), slots, pack)
    groups = cut(groups.selectExpr("concat(slot, ':', canonical) AS key", "*"), "spellings")
    several = groups.groupBy("key").agg(F.count(F.lit(1)).alias("spellings"))
    return join_per_key(groups, several.filter("spellings > 1"), "key", "spellings").selectExpr(
        f"{_slot_text(slots, 'field')} AS field",
        "canonical",
        "value AS spelling",
        "n",
    )


def consistency_findings(values: DataFrame, slots: list[ValueSlot], pack: RulePack) -> DataFrame:
    """Q4a counts the spellings involved, Q4b the groups.

    The text of a country names every group, that of a category the first three, each with all of its
    spellings.
    """
    country = f"slot IN ({_slot_list(slots, 'country')})"
    groups = (
        variant_groups(values, slots, pack)
        .groupBy("slot", "canonical")
        .agg(
            F.count(F.lit(1)).alias("spellings"),
            F.array_join(F.sort_array(F.collect_list("value")), "/").alias("names"),
        )
        .filter("spellings > 1")
    )
    by_slot = Window.partitionBy("slot")
    first = (
        groups.withColumn("place", F.row_number().over(by_slot.orderBy("canonical")))
        .filter(f"place <= 3 OR {country}")
        .groupBy("slot")
        .agg(
            F.expr(
                "array_join(transform(sort_array(collect_list(struct(place, names))), g -> g.names), '; ') AS examples"
            )
        )
    )
    totals = groups.groupBy("slot").agg(
        F.sum("spellings").alias("spellings"), F.count(F.lit(1)).alias("groups")
    )
    field = _slot_text(slots, "field")
    row = _row_sql(
        _slot_text(slots, "table"), field,
        f"if({country}, 'country_spelling', 'category_spelling')",
        "concat('Inconsistent spellings (', examples, ')')",
        f"if({country}, 'conformity', 'consistency')", f"if({country}, 'medium', 'low')",
        f"if({country}, 'Map countries to a standard catalog', concat('Standardise the values of ', {field}))",
        f"if({country}, spellings, groups)", SEQ["variants"], _slot_text(slots, "ordinal"),
    )
    return totals.join(first, "slot").selectExpr(f"inline(array({row}))")


def value_findings(tables: dict[str, DataFrame], pack: RulePack) -> DataFrame | None:
    """Q2 and Q4 of all tables on one shared count of distinct values."""
    slots = value_slots(tables, pack)
    if not slots:
        return None
    values = slot_values(tables, slots)
    return uniqueness_findings(values, slots).unionByName(consistency_findings(values, slots, pack))


def _child_keys(df: DataFrame, column: str) -> DataFrame:
    """Trimmed non-missing keys with their row count."""
    key = f"btrim(cast(`{column}` AS STRING), '{WHITESPACE}')"
    return (
        df.selectExpr(f"{key} AS key")
        .filter(f"NOT {missing_sql('key')}")
        .groupBy("key")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def _parent_keys(df: DataFrame, column: str) -> DataFrame:
    return df.selectExpr(f"btrim(cast(`{column}` AS STRING), '{WHITESPACE}') AS key").filter(
        "key IS NOT NULL"
    )


def orphan_keys(
    child: DataFrame, column: str, parent: DataFrame, parent_column: str
) -> DataFrame:
    """Q6 detail: ``(key, n)`` of child keys without a parent.

    The child is counted per key first, so a key that fills a third of the child is one row when it
    reaches the join.
    """
    return _child_keys(child, column).join(
        _parent_keys(parent, parent_column), "key", "left_anti"
    )


def reference_findings(
    tables: dict[str, DataFrame], pack: RulePack, related: dict[str, DataFrame]
) -> DataFrame | None:
    """Q6 for every relation whose column and parent are there, all in one anti-join."""
    children, parents, rows = [], {}, []
    for table, df in tables.items():
        present = _lookup(df)
        for i, rel in enumerate(pack.relations):
            parent = related.get(rel.parent_table)
            if rel.column not in present or parent is None or rel.parent_table == table:
                continue
            parent_column = _lookup(parent).get(rel.parent_column)
            if parent_column is None:
                continue
            name = present[rel.column]
            tag = F.lit(len(rows)).alias("rel")
            children.append(_child_keys(df, name).select(tag, "key", "n"))
            parents[len(rows)] = _parent_keys(parent, parent_column).select(tag, "key")
            rows.append((table, name, rel, i))
    if not rows:
        return None
    union = DataFrame.unionByName
    orphans = (
        reduce(union, children)
        .join(reduce(union, parents.values()), ["rel", "key"], "left_anti")
        .groupBy("rel")
        .agg(F.sum("n").alias("orphans"))
    )
    texts = [
        _row_sql(
            sql_text(table), sql_text(name), "'orphan'",
            f"concat(cast(orphans AS STRING), {sql_text(f' rows whose {rel.column} is not in {rel.parent_table}')})",
            "'referential_integrity'", "'high'",
            sql_text(f"Validate that {rel.column} exists in {rel.parent_table}"),
            "orphans", SEQ["reference"], i,
        )
        for table, name, rel, i in rows
    ]
    return orphans.selectExpr(f"inline(array(element_at(array({', '.join(texts)}), rel + 1)))")


def classification_findings(
    spark: SparkSession, tables: dict[str, DataFrame], pack: RulePack
) -> DataFrame | None:
    """Q7: one finding per table that lists every column with a sensitive name."""
    rows = []
    for table, df in tables.items():
        names = [c for c in df.columns if any(h in c.lower() for h in pack.quality_hints)]
        if names:
            rows.append(
                _row_sql(
                    sql_text(table), sql_text(", ".join(names)), "'unclassified'",
                    "'Fields with possible personal data and no formal classification'",
                    "'classification'", "'high'",
                    "'Classify as personal or sensitive data and assign a data owner'",
                    len(names), SEQ["classification"], 0,
                )
            )
    if not rows:
        return None
    return spark.range(1).selectExpr(f"inline(array({', '.join(rows)}))")


def findings(
    tables: dict[str, DataFrame],
    pack: RulePack,
    as_of: date,
    related: dict[str, DataFrame] | None = None,
) -> DataFrame:
    """Q10 and Q12: findings of every table, each with the others as parents; one lazy plan.

    Row predicates cost one aggregate per table; keys and spellings of all tables share one shuffle
    of value counts, references share one anti-join.
    """
    related = tables if related is None else related
    spark = next(iter(tables.values())).sparkSession
    parts = [
        run_row_checks(
            name,
            df,
            completeness_checks(df, pack)
            + validity_checks(df, pack, as_of)
            + accuracy_checks(df, pack.arithmetic),
        )
        for name, df in tables.items()
    ]
    parts += [
        value_findings(tables, pack),
        reference_findings(tables, pack, related),
        classification_findings(spark, tables, pack),
    ]
    return reduce(DataFrame.unionByName, [p for p in parts if p is not None])


def table_findings(
    table: str,
    df: DataFrame,
    pack: RulePack,
    as_of: date,
    related: dict[str, DataFrame] | None = None,
) -> DataFrame:
    """All findings of one table."""
    return findings({table: df}, pack, as_of, related or {})


def table_rows(tables: dict[str, DataFrame]) -> DataFrame:
    """Row count per table, with the position of the table in the input."""
    return reduce(
        DataFrame.unionByName,
        [
            df.agg(F.count(F.lit(1)).alias("rows")).select(
                F.lit(name).alias("table"), F.lit(i).alias("table_seq"), "rows"
            )
            for i, (name, df) in enumerate(tables.items())
        ],
    )


def risk_level(score: Column, pack: RulePack) -> Column:
    """F24."""
    return (
        F.when(score >= pack.low_risk_score, "low")
        .when(score >= pack.medium_risk_score, "medium")
        .otherwise("high")
    )


def severity_rank(severity: Column) -> Column:
    return (
        F.when(severity == "high", 0).when(severity == "medium", 1).when(severity == "low", 2)
    ).otherwise(3)


def _lookup_map(values: dict[str, int]) -> Column:
    return F.create_map(*[F.lit(x) for item in values.items() for x in item])


def scores(found: DataFrame, pack: RulePack) -> DataFrame:
    """Q8: penalty per finding, capped per dimension, taken from 100; tables with findings only."""
    dim = F.col("quality_dimension")
    kind = F.when(
        (dim == "completeness") & (F.col("severity") == "high"), "completeness_high"
    ).otherwise(dim)
    per_dimension = (
        found.withColumn(
            "penalty",
            F.coalesce(
                F.try_element_at(_lookup_map(pack.penalties), kind), F.lit(pack.default_penalty)
            ),
        )
        .groupBy("table", "quality_dimension")
        .agg(F.sum("penalty").alias("raw"))
        .withColumn(
            "penalty", F.least("raw", F.try_element_at(_lookup_map(pack.caps), dim).cast("bigint"))
        )
    )
    return per_dimension.groupBy("table").agg(
        F.greatest(F.lit(0).cast("bigint"), 100 - F.sum("penalty")).cast("int").alias(
            "quality_score"
        )
    )


def main_issues(found: DataFrame, limit: int = 5) -> DataFrame:
    """Q9: the first issues by severity, in report order."""
    order = Window.partitionBy("table").orderBy(
        severity_rank(F.col("severity")), "check_seq", "col_ordinal"
    )
    return (
        found.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= limit)
        .groupBy("table")
        .agg(
            F.transform(
                F.sort_array(
                    F.collect_list(
                        F.struct("rank", F.concat("field", F.lit(": "), "problem").alias("text"))
                    )
                ),
                lambda s: s["text"],
            ).alias("main_issues")
        )
    )


def quality_report(
    tables: dict[str, DataFrame], pack: RulePack, as_of: date, found: DataFrame | None = None
) -> DataFrame:
    """Q10 and Q11: one row per table with score, risk, main issues and narrative.

    The findings feed three aggregations, so they are written once first.
    """
    found = cut(findings(tables, pack, as_of), "findings") if found is None else found
    counted = found.groupBy("table").agg(F.count(F.lit(1)).alias("n_findings"))
    report = (
        table_rows(tables)
        .join(counted, "table", "left")
        .join(scores(found, pack), "table", "left")
        .join(main_issues(found), "table", "left")
        .select(
            "table",
            "table_seq",
            "rows",
            F.coalesce("n_findings", F.lit(0).cast("bigint")).alias("n_findings"),
            F.coalesce("quality_score", F.lit(100)).alias("quality_score"),
            F.coalesce("main_issues", F.array().cast("array<string>")).alias("main_issues"),
        )
        .withColumn("risk_level", risk_level(F.col("quality_score"), pack))
    )
    return report.withColumn("narrative", narrative())


def narrative() -> Column:
    """Q11 over a report row."""
    clean = F.concat(
        F.lit("Table "), F.col("table"), F.lit(" has no relevant quality findings (score "),
        F.col("quality_score").cast("string"), F.lit("/100, "), F.col("risk_level"), F.lit(" risk)."),
    )
    dirty = F.concat(
        F.lit("Table "), F.col("table"), F.lit(" scores "), F.col("quality_score").cast("string"),
        F.lit("/100 ("), F.col("risk_level"), F.lit(" risk) with "),
        F.col("n_findings").cast("string"), F.lit(" findings; most relevant: "),
        F.array_join(F.slice("main_issues", 1, 3), "; "),
        F.lit(". Validation rules and the classification of sensitive fields come first."),
    )
    return F.when(F.col("n_findings") == 0, clean).otherwise(dirty)


def records_involved(df: DataFrame, columns: list[str]) -> DataFrame:
    """V1: rows that share their non-missing value of a column with another row."""
    names = F.array(*[F.lit(c) for c in columns])
    return (
        value_counts(df, columns)
        .filter(~is_missing(F.col("value")))
        .groupBy("ordinal")
        .agg(F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("involved"))
        .select(F.element_at(names, F.col("ordinal") + 1).alias("field"), "involved")
    )
