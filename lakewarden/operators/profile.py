"""Column and table profiles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.naming import looks_like_identifier, sensitive_reason
from ..functions.predicates import EMAIL_PATTERN
from ..functions.text import WHITESPACE, sql_text
from ..rules import RulePack
from ..session import cut
from .values import as_text, short_key, value_counts

# No e-mail address is longer, so a longer text can travel as a digest.
LONGEST_EMAIL = 254
SHOWN_SAMPLE = 3
# Rows of a table that are looked at before a column gets a search of its own.
PREFIX_ROWS = 500


def _slots(tables: dict[str, DataFrame]) -> list[tuple[str, int, str]]:
    """Every column of every table: ``(table, ordinal, column)``; the place in the list is its slot."""
    return [(t, i, c) for t, df in tables.items() for i, c in enumerate(df.columns)]


def _is_numeric(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, T.NumericType)


def _exact_statistics(tables: dict[str, DataFrame]) -> DataFrame:
    """One scan per table, one Expand and one shuffle of distinct ``(column, value)`` pairs.

    Partial counts absorb hot values; long texts travel as digests.
    """
    slots = _slots(tables)
    parts = []
    for table, df in tables.items():
        mine = [(s, c) for s, (t, _, c) in enumerate(slots) if t == table]
        wide = df.select(*[short_key(as_text(df, c), LONGEST_EMAIL).alias(f"s{s}") for s, c in mine])
        parts.append(wide.unpivot([], wide.columns, "name", "value"))
    numeric = [str(s) for s, (t, _, c) in enumerate(slots) if _is_numeric(tables[t], c)]
    counts = (
        reduce(DataFrame.unionByName, parts)
        .selectExpr("cast(substring(name, 2) AS INT) AS slot", "value")
        .groupBy("slot", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    number = f"if(slot IN ({', '.join(numeric) or '-1'}), try_cast(value AS DOUBLE), NULL)"
    return (
        counts.selectExpr("slot", "value", "n", f"nullif({number}, double('NaN')) AS number")
        .groupBy("slot")
        .agg(
            F.sum("n").alias("rows"),
            F.expr("coalesce(sum(n) FILTER (WHERE value IS NOT NULL), 0L)").alias("non_null"),
            F.count("value").alias("unique_count"),
            F.min("number").alias("min_value"),
            F.max("number").alias("max_value"),
            F.expr("sum(number * n) / sum(n) FILTER (WHERE number IS NOT NULL)").alias("mean_value"),
            F.expr(f"sum(n) FILTER (WHERE {_is_email('value')}) / sum(n) FILTER (WHERE value IS NOT NULL)").alias("email_share"),
        )
    )


def _approximate_statistics(tables: dict[str, DataFrame]) -> DataFrame:
    """One aggregate per table; no value is shuffled, distinct counts are within two percent."""
    slot = 0
    parts = []
    for df in tables.values():
        stats = []
        for name in df.columns:
            col = F.col(f"`{name}`")
            number = F.nanvl(col.cast("double"), F.lit(None)) if _is_numeric(df, name) else F.lit(None)
            stats.append(
                F.struct(
                    F.lit(slot).alias("slot"),
                    F.count(F.lit(1)).alias("rows"),
                    F.count(col).alias("non_null"),
                    F.approx_count_distinct(as_text(df, name), 0.02).alias("unique_count"),
                    F.min(number).cast("double").alias("min_value"),
                    F.max(number).cast("double").alias("max_value"),
                    F.avg(number.cast("double")).alias("mean_value"),
                    F.avg(F.btrim(as_text(df, name), F.lit(WHITESPACE)).rlike(EMAIL_PATTERN).cast("double")).alias("email_share"),
                )
            )
            slot += 1
        parts.append(df.agg(F.array(*stats).alias("stats")).select(F.inline("stats")))
    return reduce(DataFrame.unionByName, parts)


def _is_email(name: str) -> str:
    return f"btrim({name}, '{WHITESPACE}') RLIKE {sql_text(EMAIL_PATTERN)}"


def column_statistics(tables: dict[str, DataFrame], approximate: bool = False) -> DataFrame:
    """``slot, rows, non_null, unique_count, min_value, max_value, mean_value, email_share``.

    The share of e-mail addresses counts every value of the column.
    """
    return _approximate_statistics(tables) if approximate else _exact_statistics(tables)


def first_values(tables: dict[str, DataFrame], order_cols: dict[str, str], n: int) -> DataFrame:
    """``slot, firsts`` with the first ``n`` non-null values of every column.

    One bounded top-n per table gives its first rows, all columns at once. Only a column with fewer
    than ``n`` values in them (known after one small count per column) gets a top-n of its own.
    ``order_cols`` must identify rows.
    """
    slots = _slots(tables)
    union = DataFrame.unionByName
    heads = []
    for table, df in tables.items():
        mine = [(s, c) for s, (t, _, c) in enumerate(slots) if t == table]
        top = (
            df.select(
                F.col(f"`{order_cols[table]}`").alias("ord"),
                *[as_text(df, c).alias(f"s{s}") for s, c in mine],
            )
            .orderBy("ord")
            .limit(PREFIX_ROWS)
            .withColumn("place", F.row_number().over(Window.orderBy("ord")))
        )
        heads.append(top.unpivot(["place"], [f"s{s}" for s, _ in mine], "name", "value"))
    head = cut(
        reduce(union, heads).selectExpr("cast(substring(name, 2) AS INT) AS slot", "place", "value"),
        "first-rows",
    )
    known = head.groupBy("slot").agg(F.count(F.lit(1)).alias("rows"), F.count("value").alias("n"))
    sparse = [r.slot for r in known.collect() if r.rows == PREFIX_ROWS and r.n < n]
    parts = [head.filter("value IS NOT NULL")]
    for slot in sparse:
        table, _, name = slots[slot]
        df = tables[table]
        own = (
            df.select(F.col(f"`{order_cols[table]}`").alias("ord"), as_text(df, name).alias("value"))
            .filter("value IS NOT NULL")
            .orderBy("ord")
            .limit(n)
        )
        place = F.row_number().over(Window.orderBy("ord")).alias("place")
        parts[0] = parts[0].filter(F.col("slot") != slot)
        parts.append(own.select(F.lit(slot).alias("slot"), place, "value"))
    return (
        reduce(union, parts)
        .groupBy("slot")
        .agg(
            F.expr(f"slice(sort_array(collect_list(struct(place, value))).value, 1, {n}) AS firsts")
        )
    )


def _column_list(tables: dict[str, DataFrame], pack: RulePack) -> DataFrame:
    """The columns themselves, so that an empty table keeps its profile rows."""
    spark = next(iter(tables.values())).sparkSession
    places = {t: i for i, t in enumerate(tables)}
    rows = []
    for slot, (table, i, name) in enumerate(_slots(tables)):
        df = tables[table]
        is_key = name in pack.unique_keys(table, df.columns)
        kind = df.schema[name].dataType.simpleString()
        rows.append(
            f"named_struct('slot', {slot}, 'table', {sql_text(table)}, 'table_seq', {places[table]}, "
            f"'column', {sql_text(name)}, 'ordinal', {i}, 'dtype', {sql_text(kind)}, "
            f"'is_key', {str(is_key).lower()})"
        )
    return spark.range(1).selectExpr(f"inline(array({', '.join(rows)}))")


def column_profiles(
    tables: dict[str, DataFrame],
    pack: RulePack,
    order_cols: dict[str, str],
    approximate: bool = False,
) -> DataFrame:
    """One row per column of every table, on one shared pass of value counts."""
    samples = first_values(tables, order_cols, SHOWN_SAMPLE).withColumnRenamed("firsts", "sample_values")
    joined = (
        _column_list(tables, pack)
        .join(column_statistics(tables, approximate), "slot", "left")
        .join(samples, "slot", "left")
        .selectExpr(
            "* EXCEPT (rows, non_null, unique_count, sample_values)",
            "coalesce(rows, 0L) AS rows",
            "coalesce(non_null, 0L) AS non_null",
            "coalesce(unique_count, 0L) AS unique_count",
            "coalesce(sample_values, cast(array() AS ARRAY<STRING>)) AS sample_values",
        )
        .selectExpr(
            "*",
            "rows - non_null AS null_count",
            "if(non_null > 0, unique_count / non_null, 0.0D) AS ratio",
        )
    )
    name = F.col("column")
    by_name = sensitive_reason(name, pack.sensitive_reasons)
    by_content = F.when(F.col("email_share") > 0.6, F.lit("e-mail address"))
    return joined.withColumn("sensitive_reason", F.coalesce(by_name, by_content)).select(
        "table",
        "table_seq",
        "column",
        "ordinal",
        "dtype",
        "is_key",
        "rows",
        "non_null",
        "null_count",
        F.expr("if(rows > 0, round(100 * null_count / rows, 2), 0.0D)").alias("null_pct"),
        "unique_count",
        F.expr("unique_count <= 1").alias("is_constant"),
        F.expr(f"ratio >= {pack.high_cardinality_ratio}D AND non_null > 1").alias(
            "is_high_cardinality"
        ),
        looks_like_identifier(name, F.col("ratio"), pack.identifier_hints).alias(
            "is_possible_identifier"
        ),
        F.expr("sensitive_reason IS NOT NULL").alias("is_possible_sensitive"),
        "sensitive_reason",
        "min_value",
        "max_value",
        F.round("mean_value", 4).alias("mean_value"),
        "sample_values",
    )


def column_profile(
    table: str, df: DataFrame, pack: RulePack, order_col: str, approximate: bool = False
) -> DataFrame:
    """Column profiles of one table."""
    return column_profiles({table: df}, pack, {table: order_col}, approximate)


def duplicate_rows(df: DataFrame) -> DataFrame:
    """P10: rows beyond the first of each set of equal rows; rows shuffle as 32-byte digests."""
    parts = [F.coalesce(short_key(as_text(df, c)), F.lit("\0")) for c in df.columns]
    # The length in front of every part keeps ("a", "bc") and ("ab", "c") apart.
    whole = F.concat(*[F.concat(F.length(p).cast("string"), F.lit(":"), p) for p in parts])
    return (
        df.select(F.unhex(F.sha2(whole, 256)).alias("digest"))
        .groupBy("digest")
        .agg(F.count(F.lit(1)).alias("n"))
        .agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_rows"))
    )


def key_duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """``field, extras`` per key with repeated values; blanks count as values."""
    names = F.array(*[F.lit(k) for k in keys])
    return (
        value_counts(df, keys, digest=True)
        .filter("value IS NOT NULL")
        .groupBy("ordinal")
        .agg((F.sum("n") - F.count(F.lit(1))).alias("extras"))
        .filter("extras > 0")
        .select(F.element_at(names, F.col("ordinal") + 1).alias("field"), "extras")
    )


def composite_duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Extras (P11) and records involved (V1) of a key made of several columns."""
    counts = (
        df.dropna(subset=keys)
        .groupBy(*[F.col(f"`{k}`") for k in keys])
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return counts.agg(
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("extras"),
        F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("records_involved"),
    )


def _names_where(flag: str) -> Column:
    """Column names with a set flag, in table order."""
    return F.expr(
        f"transform(sort_array(collect_list(if({flag}, struct(ordinal, column), NULL))), c -> c.column)"
    )


def _counts_map(condition: str, count: str) -> Column:
    """Map from column name to a count, in table order."""
    entries = f"sort_array(collect_list(if({condition}, struct(ordinal, column, {count} AS n), NULL)))"
    return F.expr(f"map_from_entries(transform({entries}, c -> struct(c.column, c.n)))")


def table_profiles(
    tables: dict[str, DataFrame],
    pack: RulePack,
    order_cols: dict[str, str],
    columns: DataFrame | None = None,
) -> DataFrame:
    """One row per table, assembled from the column profiles.

    Key duplicates are ``non_null - unique_count`` of the key columns, so they cost nothing more.
    """
    columns = column_profiles(tables, pack, order_cols) if columns is None else columns
    body = columns.groupBy("table", "table_seq").agg(
        F.max("rows").alias("rows"),
        F.count(F.lit(1)).cast("int").alias("columns"),
        _counts_map("null_count > 0", "null_count").alias("nulls"),
        _counts_map("is_key AND non_null > unique_count", "non_null - unique_count").alias(
            "duplicates"
        ),
        _names_where("is_possible_sensitive").alias("sensitive_fields"),
        _names_where("is_possible_identifier").alias("identifier_fields"),
        _names_where("is_constant").alias("constant_fields"),
    )
    repeated = [
        duplicate_rows(df).select(F.lit(name).alias("table"), "duplicate_rows")
        for name, df in tables.items()
    ]
    return body.join(reduce(DataFrame.unionByName, repeated), "table").select(
        "table",
        "table_seq",
        "rows",
        "columns",
        "duplicate_rows",
        "nulls",
        "duplicates",
        "sensitive_fields",
        "identifier_fields",
        "constant_fields",
    )


def table_profile(
    table: str, df: DataFrame, pack: RulePack, order_col: str, columns: DataFrame | None = None
) -> DataFrame:
    """Profile row of one table."""
    return table_profiles({table: df}, pack, {table: order_col}, columns)
