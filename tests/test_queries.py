"""Registered queries against their SQL counterparts on the smallest given tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as contract

FOLDER = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
# The rest runs in the driver's check; these cover every operator family in little time.
SAMPLE = [
    "retail_findings", "star_quality_report", "profile_columns_productos", "golden_part",
    "fuzzy_clusters_part", "mdm_exact_documents", "dictionary_entries", "recommendations_by_key",
    "chunks_windows", "hash_embedding", "topk_chunks", "topk_vectors", "answers", "json_extract",
    "csv_documents", "document_files", "catalog_merged", "index_jobs", "default_recommendation", "report_files",
]

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="given tables are not here")


def clean(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    return value


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for table in TABLES:
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    df = contract.queries()[name](spark, FOLDER)
    columns = sorted(df.columns)
    mine = [tuple(clean(r[c]) for c in columns) for r in df.collect()]
    result = con.sql(contract.oracle_sql()[name])
    assert sorted(result.columns) == columns
    order = [result.columns.index(c) for c in columns]
    other = [tuple(clean(r[i]) for i in order) for r in result.fetchall()]
    assert sorted(mine, key=str) == sorted(other, key=str)


def test_every_sql_text_belongs_to_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())
