"""User-level jobs: governance of a set of tables, indexing of documents, answering of questions."""

from __future__ import annotations

from datetime import date
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import (
    catalog,
    chunking,
    mdm,
    profile,
    quality,
    recommend,
    report,
    retrieval,
)
from ..rules import RulePack
from ..session import cut
from ..sources.sinks import ChunkIndex


def profiles(
    tables: dict[str, DataFrame],
    pack: RulePack,
    order_cols: dict[str, str],
    approximate: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """Column and table profiles of all tables; the first is written once and feeds the second."""
    columns = cut(profile.column_profiles(tables, pack, order_cols, approximate), "columns")
    return columns, profile.table_profiles(tables, pack, order_cols, columns)


def _sortable(df: DataFrame, name: str) -> DataFrame:
    """Order column as text that sorts like the original, so entities can share one table."""
    col = F.col(name)
    text = col.cast("string")
    if isinstance(df.schema[name].dataType, T.IntegralType):
        # a negative number counts up from the least one, behind a sign that sorts before digits
        up = (col.cast("decimal(20,0)") + F.lit("9223372036854775808").cast("decimal(20,0)")).cast("string")
        text = F.when(col < 0, F.concat(F.lit("-"), F.lpad(up, 19, "0"))).otherwise(F.lpad(text, 20, "0"))
    return df.withColumn(name, text)


def duplicates(
    tables: dict[str, DataFrame], pack: RulePack, order_cols: dict[str, str], **options: int
) -> dict[str, DataFrame]:
    """Groups, members and duplicate counts of every table that maps to an entity."""
    groups, members, golden, names = [], [], {}, []
    for name, df in tables.items():
        entity = pack.entity_of(name)
        if entity is None:
            continue
        found = mdm.detect_duplicates(entity.name, df, pack, order_cols[name], **options)
        names.append(entity.name)
        groups.append(_sortable(found["groups"], "first_ord"))
        members.append(_sortable(found["members"], "ord"))
        golden[entity.name] = found["golden"]
    return {"groups": groups, "members": members, "golden": golden, "names": names}


def _count_table(spark: SparkSession, names: list[str], groups: DataFrame) -> DataFrame:
    """M8 for every entity in input order, zero included."""
    seqs = spark.createDataFrame(list(enumerate(names)), "entity_seq int, entity string")
    zero = F.lit(0).cast("bigint")
    return seqs.join(mdm.duplicates_detected(groups), "entity", "left").select(
        "entity",
        "entity_seq",
        F.coalesce("duplicates_detected", zero).alias("duplicates_detected"),
        F.coalesce("n_groups", zero).alias("n_groups"),
    )


def duplicate_counts(
    tables: dict[str, DataFrame], pack: RulePack, order_cols: dict[str, str], **options: int
) -> DataFrame:
    """``entity, entity_seq, duplicates_detected, n_groups`` without golden records."""
    names, groups = [], []
    for name, df in tables.items():
        entity = pack.entity_of(name)
        if entity is not None:
            members = mdm.find_members(
                entity, df, order_cols[name], pack.similarity_threshold, **options
            )
            names.append(entity.name)
            groups.append(mdm.group_table(members).select("entity", "group_id", "size"))
    spark = next(iter(tables.values())).sparkSession
    return _count_table(spark, names, reduce(DataFrame.unionByName, groups))


def dataset_job(
    tables: dict[str, DataFrame],
    pack: RulePack,
    as_of: date,
    order_cols: dict[str, str],
    dictionary: DataFrame | None = None,
    approximate: bool = False,
    responses: DataFrame | None = None,
    **options: int,
) -> dict[str, DataFrame]:
    """Profile, quality, duplicates, catalog, recommendations and report tables.

    Findings, report, profiles, groups, duplicates and catalog are written once, so the later tables read those. ``responses`` are
    raw texts with written definitions (``table, response``, and ``turn`` if later ones replace earlier ones).
    """
    spark = next(iter(tables.values())).sparkSession
    found = cut(quality.findings(tables, pack, as_of), "findings")
    scored = cut(quality.quality_report(tables, pack, as_of, found), "report")
    columns, table_rows = profiles(tables, pack, order_cols, approximate)
    table_rows = cut(table_rows, "profiles")
    mdm_parts = duplicates(tables, pack, order_cols, **options)
    union = DataFrame.unionByName
    if mdm_parts["groups"]:
        groups = cut(reduce(union, mdm_parts["groups"]), "groups")
        members = reduce(union, mdm_parts["members"])
    else:
        groups = spark.createDataFrame(
            [],
            "entity string, group_id string, match_type string, confidence double, size bigint, "
            "evidence string, first_ord string",
        )
        members = spark.createDataFrame(
            [],
            "entity string, group_id string, match_type string, ord string, member_id string, "
            "size bigint",
        )
    dupes = cut(_count_table(spark, mdm_parts["names"], groups), "duplicates")
    feed = None
    if responses is not None:
        feed = catalog.definitions_from_responses(responses, order_col="turn" if "turn" in responses.columns else None)
    entries = cut(catalog.catalog(columns, found, pack, dictionary, feed), "catalog")
    recs = recommend.recommendations(scored, found, dupes)
    risk = report.risks(scored, dupes, table_rows)
    kpi = report.kpis(scored, found, dupes, table_rows, entries)
    out = {
        "findings": found,
        "report": scored,
        "column_profiles": columns,
        "profiles": table_rows,
        "groups": groups,
        "members": members,
        "duplicates": dupes,
        "catalog": entries,
        "recommendations": recs,
        "risks": risk,
        "kpis": kpi,
        "summary": report.summary(kpi, table_rows, risk),
        "first_groups": report.first_groups(groups, members),
        **{f"golden_{name}": df for name, df in mdm_parts["golden"].items()},
    }
    out["report_lines"] = report.report_lines(out, pack)
    return out


def document_job(
    documents: DataFrame, index: ChunkIndex, pack: RulePack, recursive: bool = True
) -> int:
    """Chunk, embed and append; returns the size of the index."""
    split = chunking.chunk_recursive if recursive else chunking.chunk_windows
    chunks = split(documents, pack.chunk_size, pack.chunk_overlap)
    index.append(retrieval.build_index(chunks, pack.embedding_dim), dedupe=True)
    return index.count()


def question_job(
    index: ChunkIndex, questions: DataFrame, pack: RulePack, fill_zero: bool = True
) -> DataFrame:
    """Answers with their sources for a table of questions."""
    return retrieval.answer_questions(
        index.read(), questions, pack.top_k, pack.embedding_dim, fill_zero, index.citations()
    )
