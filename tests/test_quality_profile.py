from datetime import date

import pytest

from lakewarden.operators import profile, quality

AS_OF = date(2025, 1, 1)


def rows(df):
    ordered = df.orderBy("table", "check_seq", "col_ordinal").collect()
    return [(r.field, r.quality_dimension, r.severity, r.affected_count) for r in ordered]


def test_client_findings(clients, pack):
    found = quality.table_findings("clientes", clients, pack, AS_OF)
    assert rows(found) == [
        ("correo", "completeness", "high", 1),
        ("telefono", "completeness", "high", 2),
        ("segmento", "completeness", "medium", 1),
        ("dni", "uniqueness", "high", 1),
        ("correo", "validity", "medium", 1),
        ("dni", "validity", "high", 1),
        ("pais", "conformity", "medium", 3),
        ("nombre, apellido, dni, correo, telefono", "classification", "high", 5),
    ]


def test_sales_findings_with_parent(clients, sales, pack):
    found = quality.table_findings("ventas", sales, pack, AS_OF, {"clientes": clients})
    assert rows(found) == [
        ("canal", "completeness", "medium", 1),
        ("cantidad", "validity", "medium", 1),
        ("fecha_venta", "validity", "medium", 1),
        ("total", "accuracy", "high", 1),
        ("cliente_id", "referential_integrity", "high", 1),
    ]


def test_scores_and_issues(clients, sales, pack):
    report = quality.quality_report({"clientes": clients, "ventas": sales}, pack, AS_OF)
    got = {r.table: r for r in report.collect()}
    assert (got["clientes"].quality_score, got["clientes"].risk_level) == (38, "high")
    assert (got["ventas"].quality_score, got["ventas"].risk_level) == (58, "high")
    fields = [i.split(":")[0] for i in got["clientes"].main_issues]
    assert fields == ["correo", "telefono", "dni", "dni", "nombre, apellido, dni, correo, telefono"]


def test_clean_table_scores_100(spark, pack):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "code_name string, amount int")
    row = quality.quality_report({"things": df}, pack, AS_OF).first()
    assert (row.quality_score, row.n_findings, row.main_issues) == (100, 0, [])
    assert "no relevant" in row.narrative


def test_order_of_rows_does_not_matter(clients, pack):
    want = rows(quality.table_findings("clientes", clients, pack, AS_OF))
    mixed = clients.repartition(5, "telefono")
    assert rows(quality.table_findings("clientes", mixed, pack, AS_OF)) == want


def test_missing_and_unicode_space(spark, pack):
    df = spark.createDataFrame(
        [("NaN",), (" \t",), (None,), ("x",), ("",)], "telefono string"
    )
    found = quality.table_findings("t", df, pack, AS_OF).filter("quality_dimension='completeness'")
    assert found.first().affected_count == 4


def test_profile_of_clients(clients, pack):
    row = profile.table_profile("clientes", clients, pack, "cliente_id").first()
    assert (row.rows, row.columns, row.duplicate_rows) == (5, 8, 0)
    assert row.nulls == {} and row.duplicates == {"dni": 1}
    assert row.sensitive_fields == ["nombre", "apellido", "dni", "correo", "telefono"]
    assert row.identifier_fields == ["cliente_id", "dni"]


@pytest.mark.parametrize("approximate", [False, True])
def test_column_statistics(sales, pack, approximate):
    got = profile.column_profile("ventas", sales, pack, "venta_id", approximate).collect()
    total = next(r for r in got if r.column == "total")
    assert (total.min_value, total.max_value, total.mean_value) == (0.0, 999.0, 374.75)
    assert (total.unique_count, total.null_pct) == (4, 0.0)
    canal = next(r for r in got if r.column == "canal")
    assert canal.sample_values == ["Web", "Tienda", ""]


def test_profile_edges(spark, pack):
    df = spark.createDataFrame(
        [(1, None, "a@b.co", -0.0), (2, None, "c@d.co", 0.0), (3, None, None, float("nan"))],
        "pos int, nothing string, contact string, x double",
    )
    got = {r.column: r for r in profile.column_profile("t", df, pack, "pos").collect()}
    assert got["nothing"].is_constant and got["nothing"].null_pct == 100.0
    assert got["contact"].sensitive_reason == "e-mail address"
    assert got["x"].unique_count == 2 and got["x"].max_value == 0.0
    empty = profile.table_profile("t", df.limit(0), pack, "pos").first()
    assert (empty.rows, empty.duplicate_rows) == (0, 0)


def test_sparse_column_is_searched_beyond_the_first_rows(spark, pack, monkeypatch):
    monkeypatch.setattr(profile, "PREFIX_ROWS", 10)
    df = spark.range(100).selectExpr("id", "if(id >= 95, concat('v', id), null) AS late")
    got = {r.column: r for r in profile.column_profile("t", df, pack, "id").collect()}
    assert got["late"].sample_values == ["v95", "v96", "v97"]


def test_duplicate_rows_and_long_values(spark):
    long = "x" * 500
    df = spark.createDataFrame(
        [(long, None), (long, None), (long, "b"), ("ab", "c"), ("a", "bc")], "p string, q string"
    )
    assert profile.duplicate_rows(df.repartition(3)).first().duplicate_rows == 1
