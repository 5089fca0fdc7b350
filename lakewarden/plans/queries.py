"""Every operator as a query over the given tables. Each callable takes ``(spark, folder)``."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import naming, text
from ..functions.jsontext import extract_json
from ..functions.predicates import EMAIL_PATTERN, matches
from ..functions.similarity import article_needles, article_numbers
from ..functions.vectors import unit_vector
from ..operators import (
    catalog,
    chunking,
    mdm,
    profile,
    quality,
    recommend,
    report,
    retrieval,
    validation,
)
from ..rules import ArithmeticRule, Entity, Relation, RulePack, rules_table
from ..session import cut
from ..sources.tabular import data_dictionary, expected_from_dict, read_table, table_inventory
from . import jobs
from .retail import retail_tables

AS_OF = date(2025, 6, 30)
STAR_AS_OF = date(2000, 1, 1)
GIVEN = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
RETAIL = RulePack()
# Exact keys only: duplicate counts that plain SQL can repeat.
RETAIL_BY_KEY = replace(
    RETAIL, entities=tuple(replace(e, name_columns=()) for e in RETAIL.entities)
)
STAR = RulePack(
    primary_keys={
        "customer": "c_custkey",
        "supplier": "s_suppkey",
        "part": "p_partkey",
        "orders": "o_orderkey",
        "lineitem": "l_orderkey",
        "events": "event_id",
        "documents": "doc_id",
        "labels": "doc_id",
    },
    business_keys=("p_name",),
    relations=(
        Relation("o_custkey", "customer", "c_custkey"),
        Relation("l_orderkey", "orders", "o_orderkey"),
        Relation("l_partkey", "part", "p_partkey"),
        Relation("l_suppkey", "supplier", "s_suppkey"),
        Relation("user_id", "customer", "c_custkey"),
        Relation("doc_id", "labels", "doc_id"),
    ),
    entities=(Entity("part", "p_partkey", "", ("p_name",)),),
    formats=(),
    non_negative_hints=("acctbal",),
    non_zero_columns=("l_discount", "l_tax"),
    date_hints=("date",),
    country_columns=(),
    category_columns=("c_mktsegment", "o_orderpriority", "event_type"),
    arithmetic=(),
    quality_hints=("name",),
)
STAR_TABLES = (
    "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "labels", "region",
    "nation", "embeddings", "pages", "benchmark", "conversations",
)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def given(spark: SparkSession, folder: str, names=GIVEN) -> dict[str, DataFrame]:
    return {n: read_table(spark, folder, n) for n in names}


# Setting that names the number of partitions for work on texts, for a table whose files can't be split into enough of them (a
# file of one row group is one task). Without it the table's own splits are taken.
TEXT_PARTITIONS = "spark.lakewarden.textPartitions"


def documents(spark: SparkSession, folder: str) -> DataFrame:
    table = read_table(spark, folder, "documents")
    wanted = int(spark.conf.get(TEXT_PARTITIONS, "0"))
    return table.repartition(wanted) if wanted else table


def joined(col: str | Column) -> Column:
    """Array of texts as one text, so any engine can compare it."""
    return F.array_join(col, "|")


def map_text(col: str) -> Column:
    entries = F.transform(
        F.sort_array(F.map_entries(col)),
        lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")),
    )
    return F.array_join(entries, "|")


# ---------------------------------------------------------------- inventory and profiles


@query
def table_inventory_all(spark, folder):
    return table_inventory(given(spark, folder))


def _profile(spark, folder, name, keep_row=True):
    df = retail_tables(spark, folder, (name,), keep_row)[name]
    out = profile.column_profile(name, df, RETAIL, "fila").drop("dtype", "table_seq")
    return out.withColumn("sample_values", joined("sample_values"))


@query
def profile_columns_clientes(spark, folder):
    return _profile(spark, folder, "clientes")


@query
def profile_columns_productos(spark, folder):
    return _profile(spark, folder, "productos")


@query
def profile_columns_ventas(spark, folder):
    return _profile(spark, folder, "ventas")


@query
def profile_columns_lineitem(spark, folder):
    out = profile.column_profile("lineitem", read_table(spark, folder, "lineitem"), STAR, "l_orderkey")
    return out.drop("dtype", "table_seq", "sample_values")


@query
def profile_tables(spark, folder):
    tables = retail_tables(spark, folder, keep_row=True)
    out = profile.table_profiles(tables, RETAIL, dict.fromkeys(tables, "fila"))
    return out.select(
        "table", "rows", "columns", "duplicate_rows",
        map_text("nulls").alias("nulls"), map_text("duplicates").alias("duplicates"),
        joined("sensitive_fields").alias("sensitive_fields"),
        joined("identifier_fields").alias("identifier_fields"),
        joined("constant_fields").alias("constant_fields"),
    )


@query
def duplicate_rows_lineitem(spark, folder):
    return profile.duplicate_rows(read_table(spark, folder, "lineitem"))


@query
def key_duplicates_lineitem(spark, folder):
    return profile.composite_duplicates(
        read_table(spark, folder, "lineitem"), ["l_orderkey", "l_linenumber"]
    )


# ---------------------------------------------------------------- quality


@query
def retail_findings(spark, folder):
    return quality.findings(retail_tables(spark, folder), RETAIL, AS_OF)


@query
def retail_quality_report(spark, folder):
    out = quality.quality_report(retail_tables(spark, folder), RETAIL, AS_OF)
    return out.withColumn("main_issues", joined("main_issues"))


@query
def star_findings(spark, folder):
    return quality.findings(given(spark, folder, STAR_TABLES), STAR, STAR_AS_OF)


@query
def star_quality_report(spark, folder):
    out = quality.quality_report(given(spark, folder, STAR_TABLES), STAR, STAR_AS_OF)
    return out.withColumn("main_issues", joined("main_issues"))


@query
def spelling_variants_clientes(spark, folder):
    df = retail_tables(spark, folder, ("clientes",))["clientes"]
    return quality.spelling_variants(df, RETAIL).select("field", "canonical", "spelling", "n")


@query
def completeness_contacts(spark, folder):
    """Contacts found in the documents; most documents have none, which counts as missing."""
    contacts = documents(spark, folder).select(
        "doc_id",
        F.array_join(F.regexp_extract_all("text", F.lit(r"([A-Za-z0-9._-]+@[A-Za-z0-9-]+\.[A-Za-z0-9.-]+)"), F.lit(1)), ";").alias("email"),
        F.array_join(F.regexp_extract_all("text", F.lit(r"(\+?[0-9]{2,3}[ -][0-9]{3}[ -][0-9]{3,4})"), F.lit(1)), ";").alias("phone"),
    )
    checks = quality.completeness_checks(contacts, RETAIL)
    return quality.run_row_checks("contacts", contacts, checks).select(
        "field", "severity", "affected_count"
    )


@query
def email_validity(spark, folder):
    """Loose tokens around an at sign, checked with the strict pattern."""
    tokens = documents(spark, folder).select(
        F.explode(F.regexp_extract_all("text", F.lit(r"([^ \n\t]+@[^ \n\t]+)"), F.lit(1))).alias("email")
    )
    return tokens.agg(
        F.count(F.lit(1)).alias("tokens"),
        F.count_if(~matches(F.col("email"), EMAIL_PATTERN)).alias("invalid"),
    )


@query
def line_price_accuracy(spark, folder):
    lines = read_table(spark, folder, "lineitem").join(
        read_table(spark, folder, "part"), F.col("l_partkey") == F.col("p_partkey")
    )
    rule = ArithmeticRule(
        ("l_quantity", "p_retailprice", "l_extendedprice"), "l_quantity * p_retailprice",
        "l_extendedprice", 0.01, "l_extendedprice", "prices that differ", "price rule",
    )
    return quality.run_row_checks("lineitem", lines, quality.accuracy_checks(lines, (rule,)))


@query
def order_total_accuracy(spark, folder):
    sums = (
        read_table(spark, folder, "lineitem")
        .groupBy("l_orderkey")
        .agg(F.sum("l_extendedprice").alias("line_total"))
    )
    orders = read_table(spark, folder, "orders").join(
        sums, F.col("o_orderkey") == F.col("l_orderkey")
    )
    rule = ArithmeticRule(
        ("line_total", "o_totalprice"), "line_total", "o_totalprice", 0.01, "o_totalprice",
        "totals that differ", "total rule",
    )
    return quality.run_row_checks("orders", orders, quality.accuracy_checks(orders, (rule,)))


@query
def orphans_unlabelled(spark, folder):
    t = given(spark, folder, ("documents", "labels"))
    return quality.orphan_keys(t["documents"], "doc_id", t["labels"], "doc_id")


@query
def orphans_filtered_parent(spark, folder):
    t = given(spark, folder, ("orders", "customer"))
    return quality.orphan_keys(
        t["orders"], "o_custkey", t["customer"].filter("c_acctbal >= 0"), "c_custkey"
    )


@query
def records_involved_retail(spark, folder):
    t = retail_tables(spark, folder, ("clientes", "productos", "proveedores"))
    parts = [
        quality.records_involved(t[n], [c]).select(F.lit(n).alias("table"), "field", "involved")
        for n, c in (("clientes", "dni"), ("productos", "sku"), ("proveedores", "ruc"))
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query
def key_rules(spark, folder):
    """F17 over the schemas of the derived tables, with the row count of each table."""
    tables = retail_tables(spark, folder)
    return rules_table(spark, RETAIL, tables).join(table_inventory(tables), "table")


# ---------------------------------------------------------------- names and text


@query
def name_rules(spark, folder):
    """F10 to F14 on the column names of every table, with that table's row count."""
    tables = {**retail_tables(spark, folder), **given(spark, folder)}
    names = spark.createDataFrame(
        [(t, c) for t, df in tables.items() for c in df.columns], "table string, column string"
    )
    name = F.col("column")
    return names.join(table_inventory(tables).select("table", "rows"), "table").select(
        "table",
        "column",
        "rows",
        naming.is_critical(name).alias("is_critical"),
        naming.sensitive_reason(name).alias("sensitive_reason"),
        naming.looks_like_identifier(name, F.lit(0.6)).alias("is_identifier"),
        naming.classify(name)["classification"].alias("classification"),
        naming.classify(name)["criticality"].alias("criticality"),
        joined(naming.default_rules(name)).alias("rules"),
    )


@query
def normalize_text_docs(spark, folder):
    plain = text.normalize_text(F.col("text"))
    return documents(spark, folder).select(
        "doc_id", F.char_length(plain).cast("bigint").alias("n_plain"), F.md5(plain).alias("plain_md5")
    )


@query
def normalize_contacts(spark, folder):
    t = retail_tables(spark, folder, ("clientes",), keep_row=True)["clientes"]
    return t.select(
        "fila",
        text.normalize_text(F.concat_ws(" ", "nombre", "apellido")).alias("name"),
        text.normalize_email(F.col("correo")).alias("email"),
        text.normalize_country(F.col("pais")).alias("country"),
        text.is_missing(F.col("telefono")).alias("no_phone"),
    )


@query
def json_extract(spark, folder):
    """Clean, fenced and embedded JSON built around the event properties."""
    events = read_table(spark, folder, "events").withColumn(
        "raw",
        F.when(F.col("event_type") == "view", F.col("props"))
        .when(F.col("event_type") == "click", F.concat(F.lit("Answer:\n```json\n"), "props", F.lit("\n```")))
        .when(F.col("event_type") == "error", F.lit("no structured answer"))
        .otherwise(F.concat(F.lit("The result is "), "props", F.lit(" as asked."))),
    )
    body = extract_json(F.col("raw"))
    return events.select("event_id", F.get_json_object(body, "$.k").cast("bigint").alias("k"))


# ---------------------------------------------------------------- duplicates


def _doc_entity() -> Entity:
    return Entity("document", "doc_id", "text", ())


@query
def mdm_exact_documents(spark, folder):
    df = documents(spark, folder).select("doc_id", "text")
    members = mdm.find_members(_doc_entity(), df, "doc_id")
    return members.select("group_id", F.col("ord").alias("doc_id"), "size")


@query
def mdm_exact_documents_total(spark, folder):
    df = documents(spark, folder).select("doc_id", "text")
    members = mdm.find_members(_doc_entity(), df, "doc_id")
    return mdm.duplicates_detected(mdm.group_table(members))


@query
def golden_part(spark, folder):
    df = read_table(spark, folder, "part")
    members = mdm.find_members(Entity("part", "p_partkey", "p_name", ()), df, "p_partkey")
    return mdm.golden_records(df, members, "p_partkey").select(
        F.expr("substr(group_id, 5)").alias("p_key"), *df.columns
    )


@query
def golden_clientes(spark, folder):
    df = retail_tables(spark, folder, ("clientes",), keep_row=True)["clientes"]
    entity = RETAIL_BY_KEY.entity("cliente")
    members = mdm.find_members(entity, df, "fila")
    return mdm.golden_records(df, members, "fila")


@query
def fuzzy_clusters_part(spark, folder):
    df = read_table(spark, folder, "part")
    members = mdm.find_members(STAR.entity("part"), df, "p_partkey")
    return members.select(
        F.col("group_id"), F.col("ord").alias("p_partkey"), F.col("member_id"), "size"
    )


@query
def fuzzy_groups_part(spark, folder):
    df = read_table(spark, folder, "part")
    members = mdm.find_members(STAR.entity("part"), df, "p_partkey")
    return mdm.group_table(members).select("group_id", "match_type", "confidence", "size", "evidence")


@query
def mdm_clientes(spark, folder):
    """Exact keys, then names and e-mails, on all derived customers."""
    df = retail_tables(spark, folder, ("clientes",), keep_row=True)["clientes"]
    found = mdm.find_members(RETAIL.entity("cliente"), df, "fila")
    return found.select("group_id", "match_type", "ord", "member_id", "size")


@query
def mdm_key_groups_clientes(spark, folder):
    df = retail_tables(spark, folder, ("clientes",), keep_row=True)["clientes"]
    members = mdm.find_members(RETAIL_BY_KEY.entity("cliente"), df, "fila")
    return mdm.group_table(members).select(
        "entity", "group_id", "match_type", "confidence", "size", "evidence", "first_ord"
    )


@query
def mdm_proveedores(spark, folder):
    df = retail_tables(spark, folder, ("proveedores",), keep_row=True)["proveedores"]
    members = mdm.find_members(RETAIL.entity("proveedor"), df, "fila")
    return mdm.group_table(members).select("group_id", "match_type", "confidence", "size")


# ---------------------------------------------------------------- catalog, report


def _dictionary(spark, folder):
    """A data dictionary built from the parts: one entry per brand, the last row of a key wins."""
    part = read_table(spark, folder, "part")
    raw = part.groupBy("p_brand").agg(F.max("p_partkey").alias("n")).select(
        F.lit("Productos ").alias("tabla"),
        F.when(F.col("p_brand").endswith("1"), "SKU").when(F.col("p_brand").endswith("2"), "precio")
        .otherwise("").alias("campo"),
        F.concat(F.lit("Entry of "), "p_brand").alias("descripcion_negocio"),
        F.when(F.col("p_brand").endswith("1"), " Interno ").otherwise("").alias("clasificacion"),
        F.when(F.col("p_brand").endswith("2"), "Sí").otherwise("No").alias("es_critico"),
        F.lit("").alias("data_owner_sugerido"),
        F.lit("Catalog steward").alias("data_steward_sugerido"),
        F.lit("must be unique").alias("regla_calidad_base"),
        F.lit("demo").alias("sistema_origen"),
        F.col("p_brand").alias("place"),
    )
    return data_dictionary(raw, "place")


@query
def dictionary_entries(spark, folder):
    return _dictionary(spark, folder)


@query
def catalog_entries(spark, folder):
    tables = retail_tables(spark, folder, keep_row=True)
    columns, _ = jobs.profiles(tables, RETAIL, dict.fromkeys(tables, "fila"))
    found = quality.findings(retail_tables(spark, folder), RETAIL, AS_OF)
    out = catalog.catalog(columns, found, RETAIL, _dictionary(spark, folder))
    return out.withColumn("quality_rules", joined("quality_rules"))


@query
def catalog_merged(spark, folder):
    """Written definitions in the catalog. Every customer gives a raw response; the last one on a field counts."""
    tables = retail_tables(spark, folder, keep_row=True)
    columns, _ = jobs.profiles(tables, RETAIL, dict.fromkeys(tables, "fila"))
    found = quality.findings(retail_tables(spark, folder), RETAIL, AS_OF)
    field = F.element_at(F.array(*[F.lit(f) for f in ("NOMBRE", "correo", "Pais", "dni")]), (F.col("c_custkey") % 4 + 1).cast("int"))
    responses = read_table(spark, folder, "customer").select(
        F.lit("clientes").alias("table"), F.col("c_custkey").alias("turn"),
        F.concat(
            F.lit('Here: {"entries": [{"field": "'), field, F.lit('", "business_definition": "Written for record '),
            F.col("c_custkey").cast("string"), F.lit('"}]}'),
        ).alias("response"),
    )
    feed = catalog.definitions_from_responses(responses, order_col="turn")
    out = catalog.catalog(columns, found, RETAIL, _dictionary(spark, folder), feed)
    return out.withColumn("quality_rules", joined("quality_rules"))


@query
def catalog_feed(spark, folder):
    """C7 on one raw response per market segment and nation."""
    responses = (
        read_table(spark, folder, "customer")
        .groupBy("c_mktsegment")
        .agg(F.max("c_custkey").alias("n"))
        .select(
            F.lit("clientes").alias("table"),
            F.concat(
                F.lit('Sure: {"entries": [{"field": "'), "c_mktsegment",
                F.lit('", "business_definition": "Segment '), "c_mktsegment",
                F.lit('"}, {"field": "empty", "business_definition": " "}]} done'),
            ).alias("response"),
        )
    )
    return catalog.definitions_from_responses(responses)


def _by_key(spark, folder):
    """Tables with their row number, findings and report, duplicate counts with exact keys only."""
    tables = retail_tables(spark, folder, keep_row=True)
    found = cut(quality.findings(tables, RETAIL_BY_KEY, AS_OF), "findings")
    scored = quality.quality_report(tables, RETAIL_BY_KEY, AS_OF, found)
    dupes = jobs.duplicate_counts(tables, RETAIL_BY_KEY, dict.fromkeys(tables, "fila"))
    return tables, found, scored, dupes


def _by_key_kpis(spark, folder):
    tables, found, scored, dupes = _by_key(spark, folder)
    scored, dupes = cut(scored, "report"), cut(dupes, "duplicates")
    columns, rows = jobs.profiles(tables, RETAIL_BY_KEY, dict.fromkeys(tables, "fila"))
    entries = catalog.catalog(columns, found, RETAIL_BY_KEY)
    rows = cut(rows, "profiles")
    return report.kpis(scored, found, dupes, rows, entries), rows, report.risks(scored, dupes, rows)


@query
def recommendations_by_key(spark, folder):
    _, found, scored, dupes = _by_key(spark, folder)
    return recommend.recommendations(scored, found, dupes)


@query
def risks_by_key(spark, folder):
    tables, _, scored, dupes = _by_key(spark, folder)
    _, rows = jobs.profiles(tables, RETAIL_BY_KEY, dict.fromkeys(tables, "fila"))
    return report.risks(scored, dupes, rows)


@query
def kpis_by_key(spark, folder):
    return _by_key_kpis(spark, folder)[0]


@query
def summary_by_key(spark, folder):
    return report.summary(*_by_key_kpis(spark, folder))


@query
def finding_lines_by_key(spark, folder):
    _, found, scored, dupes = _by_key(spark, folder)
    return recommend.finding_lines(found, scored, dupes)


@query
def report_lines_full(spark, folder):
    """W1 with every stage, names and e-mails included."""
    tables = retail_tables(spark, folder, keep_row=True)
    out = jobs.dataset_job(
        tables, RETAIL, AS_OF, dict.fromkeys(tables, "fila"), _dictionary(spark, folder)
    )
    return out["report_lines"]


@query
def report_lines_by_key(spark, folder):
    """The whole job with exact keys only, as plain SQL can repeat it."""
    tables = retail_tables(spark, folder, keep_row=True)
    out = jobs.dataset_job(tables, RETAIL_BY_KEY, AS_OF, dict.fromkeys(tables, "fila"))
    return out["report_lines"]


@query
def overall_score_retail(spark, folder):
    return report.overall_score(
        quality.quality_report(retail_tables(spark, folder), RETAIL, AS_OF)
    )


@query
def recommendation_feed(spark, folder):
    """R5 on one fenced response per order priority."""
    responses = (
        read_table(spark, folder, "orders")
        .groupBy("o_orderpriority")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(
            F.col("o_orderpriority").alias("response_id"),
            F.concat(
                F.lit('```json\n{"recommendations": [{"priority": "high", "title": "Check '),
                "o_orderpriority", F.lit('", "risk": "'), F.col("n").cast("string"),
                F.lit(' orders"}, {"title": "Second"}]}\n```'),
            ).alias("response"),
        )
    )
    return recommend.recommendations_from_responses(responses)


EXPECTED = {
    "clientes": {
        "rows": 1500,
        "duplicate_dni_records": 10,
        "invalid_dni_records": 20,
        "missing_telefono_records": 115,
        "possible_sensitive_fields": ["dni", "correo", "telefono", "nombre"],
    },
    "productos": {"rows": 2000, "negative_price_records": 54, "duplicate_sku_records": 160},
    "proveedores": {"invalid_ruc_records": 5, "missing_correo_records": 5},
    "ventas": {"zero_quantity_records": 246, "total_mismatch_records": 211, "unknown_metric": 0},
}


def _checks(spark, folder):
    tables = retail_tables(spark, folder, keep_row=True)
    found = quality.findings(tables, RETAIL, AS_OF)
    _, rows = jobs.profiles(tables, RETAIL, dict.fromkeys(tables, "fila"))
    detected = validation.detected_metrics(tables, found, rows)
    return validation.compare(expected_from_dict(spark, EXPECTED), detected)


@query
def ground_truth_check(spark, folder):
    return _checks(spark, folder)


@query
def ground_truth_pass_rate(spark, folder):
    return validation.pass_rate(_checks(spark, folder))


# ---------------------------------------------------------------- documents


@query
def chunks_windows(spark, folder):
    out = chunking.chunk_windows(documents(spark, folder))
    return out.select(
        "doc_id", "source", "chunk_id",
        F.char_length("text").cast("bigint").alias("n_chars"), F.md5("text").alias("text_md5"),
    )


@query
def chunks_recursive(spark, folder):
    return chunking.chunk_recursive(documents(spark, folder))


def _index(spark, folder):
    return retrieval.build_index(chunking.chunk_windows(documents(spark, folder)))


def _questions(spark, folder):
    return read_table(spark, folder, "benchmark").select(
        F.col("item_id").alias("question_id"), F.col("text").alias("question")
    )


@query
def hash_embedding(spark, folder):
    rows = retrieval.embedding_rows(_index(spark, folder))
    return rows.withColumn("weight", F.round("weight", 9))


@query
def topk_chunks(spark, folder):
    return retrieval.top_chunks(_index(spark, folder), _questions(spark, folder)).withColumn(
        "score", F.round("score", 9)
    )


@query
def topk_vectors(spark, folder):
    """Nearest vectors of every label's mean vector."""
    vectors = read_table(spark, folder, "embeddings")
    means = (
        vectors.select("label", F.posexplode("embedding").alias("pos", "x"))
        .groupBy("label", "pos")
        .agg(F.avg(F.col("x").cast("double")).alias("x"))
        .groupBy("label")
        .agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("vec"))
    )
    return retrieval.top_vectors(
        vectors.select("vec_id", F.col("embedding").alias("vec")),
        means.select(F.col("label").alias("query_id"), "vec"),
    ).withColumn("score", F.round("score", 6))


@query
def unit_vectors(spark, folder):
    return read_table(spark, folder, "embeddings").select(
        "vec_id", F.posexplode(unit_vector(F.col("embedding"))).alias("pos", "x")
    ).select("vec_id", "pos", F.round("x", 9).alias("x"))


NEEDLES = ["license", "copyright", "@"]


@query
def keyword_hits(spark, folder):
    chunks = chunking.chunk_windows(documents(spark, folder))
    return retrieval.keyword_search(chunks, NEEDLES, 25).select("doc_id", "chunk_id", "score")


def _cited_documents(spark, folder):
    """Documents that each open with an article heading."""
    heading = F.when(F.col("doc_id") % 3 == 0, "Artículo ").when(
        F.col("doc_id") % 3 == 1, "ARTICULO "
    ).otherwise("Art. ")
    return documents(spark, folder).withColumn(
        "text",
        F.concat(heading, (F.col("doc_id") % 97).cast("string"), F.lit(". "), F.col("text")),
    )


def _cited_index(spark, folder):
    """Written once, because several steps read it."""
    chunks = chunking.chunk_windows(_cited_documents(spark, folder))
    return cut(retrieval.build_index(chunks), "index")


def _cited_questions(spark, folder):
    """Benchmark texts; every other one asks for an article."""
    return _questions(spark, folder).withColumn(
        "question",
        F.when(
            F.col("question_id") % 2 == 0,
            F.concat(
                F.lit("Que dice el artículo "), (F.col("question_id") % 97).cast("string"),
                F.lit("? "), F.col("question"),
            ),
        ).otherwise(F.col("question")),
    )


@query
def article_references(spark, folder):
    numbers = article_numbers(F.col("question"))
    return _cited_questions(spark, folder).select(
        "question_id", joined(numbers).alias("numbers"), joined(article_needles(numbers)).alias("needles")
    )


@query
def reference_hits(spark, folder):
    chunks = chunking.chunk_windows(_cited_documents(spark, folder))
    return retrieval.reference_hits(chunks, _cited_questions(spark, folder))


@query
def adjacent_chunks(spark, folder):
    """Neighbours of the middle chunk of every labelled document."""
    index = chunking.chunk_windows(documents(spark, folder))
    labels = read_table(spark, folder, "labels").select("doc_id")
    anchors = labels.withColumn("chunk_id", F.lit(2))
    return retrieval.adjacent_chunks(index, anchors, 3).select(
        "doc_id", "chunk_id", "anchor_id", "score", F.md5("text").alias("text_md5")
    )


@query
def expanded_context(spark, folder):
    out = retrieval.retrieve(_cited_index(spark, folder), _cited_questions(spark, folder))
    return out.select("question_id", "pos", "doc_id", "chunk_id", F.round("score", 9).alias("score"))


@query
def formatted_context(spark, folder):
    out = retrieval.retrieve(_cited_index(spark, folder), _cited_questions(spark, folder))
    block = retrieval.format_context(out)
    return block.select(
        "question_id",
        F.char_length("context").cast("bigint").alias("n_chars"),
        F.md5("context").alias("context_md5"),
    )


@query
def answers(spark, folder):
    out = retrieval.answer_questions(_cited_index(spark, folder), _cited_questions(spark, folder))
    return out.withColumn("sources", joined("sources")).withColumn(
        "best_score", F.round("best_score", 9)
    )


@query
def answers_recursive(spark, folder):
    """W2 and W3 with separator-aware chunks."""
    chunks = chunking.chunk_recursive(_cited_documents(spark, folder))
    index = cut(retrieval.build_index(chunks), "index")
    return retrieval.answer_questions(index, _cited_questions(spark, folder), fill_zero=True)


@query
def generated_answers(spark, folder):
    """T15 on raw responses built around the conversation turns."""
    turns = read_table(spark, folder, "conversations")
    responses = turns.select(
        F.concat_ws("-", "conv_id", "turn").alias("question_id"),
        F.col("role").alias("question"),
        F.when(
            F.col("role") == "system",
            F.lit('{"answer": "No se encontró sustento suficiente en los documentos cargados."}'),
        )
        .when(F.col("role") == "assistant", F.lit("not json"))
        .otherwise(
            F.concat(
                F.lit('{"answer": "turn '), F.col("turn").cast("string"),
                F.lit('", "confidence": "high"}'),
            )
        )
        .alias("response"),
        F.array(F.lit("manual.md")).alias("sources"),
    )
    return retrieval.answers_from_responses(responses).withColumn("sources", joined("sources"))
