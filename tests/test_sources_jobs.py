import json
import os
from datetime import date

import pytest
from pyspark.sql import functions as F

from lakewarden.operators import validation
from lakewarden.plans import io_queries, jobs
from lakewarden.session import cut, intermediates
from lakewarden.sources import documents, sinks, tabular
from lakewarden.streaming.ingest import findings_per_batch


def test_csv_detection(spark, tmp_path):
    semi = tmp_path / "a.csv"
    semi.write_bytes("﻿id;nombre;ruc\n1;José;010\n2;NA;\n".encode("utf-8"))
    df = tabular.read_csv(spark, str(semi), row_id="pos")
    assert df.columns == ["id", "nombre", "ruc", "pos"]
    got = df.orderBy("pos").collect()
    assert [tuple(r)[:3] for r in got] == [("1", "José", "010"), ("2", None, None)]
    latin = tmp_path / "b.csv"
    latin.write_bytes("id|nombre\n1|Núñez\n".encode("latin-1"))
    assert tabular.read_csv(spark, str(latin)).first().nombre == "Núñez"


def test_load_tables_skips_absent_files(spark, tmp_path):
    (tmp_path / "clientes.csv").write_text("cliente_id,nombre\nC1,Ana\n")
    tables = tabular.load_tables(spark, str(tmp_path))
    assert list(tables) == ["clientes"]
    assert spark.table("clientes").count() == 1
    row = tabular.table_inventory(tables).first()
    assert (row.table, row.rows, row["columns"]) == ("clientes", 1, 2)


def test_documents_and_inventory(spark, tmp_path):
    (tmp_path / "politica_datos.md").write_bytes("﻿hola ñ".encode("utf-8"))
    (tmp_path / "notas.txt").write_bytes("año".encode("latin-1"))
    (tmp_path / "manual.pdf").write_bytes(b"%PDF")
    (tmp_path / "x.csv").write_text("a\n1\n")
    docs = {r.source: r.text for r in documents.load_documents(spark, str(tmp_path)).collect()}
    assert docs == {"politica_datos.md": "hola ñ", "notas.txt": "año"}
    files = {r.file_name: r for r in documents.file_inventory(spark, str(tmp_path)).collect()}
    assert (files["x.csv"].kind, files["x.csv"].doc_type) == ("tabular", None)
    assert files["politica_datos.md"].doc_type == "policy" and files["manual.pdf"].file_type == "pdf"
    assert files["manual.pdf"].doc_type == "quality_manual"


def test_text_files_equal_those_of_spark(spark, tmp_path):
    """A file for each id, with a line for each of its rows; rows without an id or a text are there too, and no other file."""
    rows = [(1, "one"), (2, None), (3, "a\nb ñ"), (3, "again"), (None, "no id"), (-4, "")]
    texts = spark.createDataFrame(rows, "doc_id long, value string").repartition(3, "doc_id")
    io_queries._write_texts(texts, f"file://{tmp_path}/own")
    texts.write.partitionBy("doc_id").text(f"file://{tmp_path}/spark")
    own = {p.stem: sorted(p.read_text().split("\n")) for p in (tmp_path / "own").rglob("*") if p.is_file()}
    other = {p.parent.name: sorted(p.read_text().split("\n")) for p in (tmp_path / "spark").rglob("part-*.txt")}
    assert own == other and len(own) == 5


@pytest.mark.parametrize("read", [documents.load_documents, documents.file_inventory])
def test_small_files_share_tasks(spark, tmp_path, read):
    """Spark alone makes a task for every few files, however small they are."""
    for i in range(120):
        (tmp_path / f"part{i % 3}").mkdir(exist_ok=True)
        (tmp_path / f"part{i % 3}" / f"{i}.txt").write_text(f"text {i}")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4m")
    try:
        found = read(spark, str(tmp_path), recursive=True)
        assert found.count() == 120
        assert found.rdd.getNumPartitions() <= documents.TASKS_PER_CORE * spark.sparkContext.defaultParallelism
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_dictionary_last_row_wins(spark):
    raw = spark.createDataFrame(
        [
            (1, "Clientes", "DNI", "old", "Personal", "No"),
            (2, "clientes", "dni ", "new", "Publico", "Sí"),
            (3, "", "x", "", "", ""),
        ],
        "pos int, tabla string, campo string, descripcion_negocio string, clasificacion string, es_critico string",
    )
    got = tabular.data_dictionary(raw, "pos").collect()
    assert len(got) == 1
    row = got[0]
    assert (row.table, row.field, row.business_definition) == ("clientes", "dni", "new")
    assert (row.classification, row.criticality, row.data_owner) == ("operational data", "high", "")


def test_ground_truth(spark, clients, pack, tmp_path):
    path = tmp_path / "expected.json"
    expected = {"clientes": {"rows": 5, "duplicate_dni_records": 3, "possible_sensitive_fields": ["dni"]}}
    path.write_text(json.dumps(expected))
    from lakewarden.operators import profile, quality

    tables = {"clientes": clients}
    found = quality.findings(tables, pack, date(2025, 1, 1))
    rows = profile.table_profiles(tables, pack, {"clientes": "cliente_id"})
    checks = validation.compare(
        tabular.expected_metrics(spark, str(path)), validation.detected_metrics(tables, found, rows)
    )
    got = {r.metric: (r.ok, r.hard) for r in checks.collect()}
    assert got == {
        "rows": (True, True),
        "duplicate_dni_records": (False, False),
        "possible_sensitive_fields": (True, True),
    }
    assert validation.hard_failures(checks).count() == 0
    assert validation.pass_rate(checks).first().passed == 2


def test_dataset_job(spark, clients, sales, pack, tmp_path):
    tables = {"clientes": clients, "ventas": sales}
    out = jobs.dataset_job(
        tables, pack, date(2025, 1, 1), {"clientes": "cliente_id", "ventas": "venta_id"}
    )
    kpis = {r.kpi: r.value for r in out["kpis"].collect()}
    assert kpis["datasets_analysed"] == 2 and kpis["findings_detected"] == 13
    assert kpis["duplicates_detected"] == 1 and kpis["mean_score"] == 48
    recs = [r.title for r in out["recommendations"].orderBy("seq").collect()]
    assert recs[0].endswith("clientes") and recs[1].endswith("ventas") and recs[2].endswith("cliente")
    entry = out["catalog"].filter("table = 'clientes' AND field = 'dni'").first()
    assert entry.classification == "personal data" and entry.data_owner == "Gerencia Comercial"
    assert entry.quality_rules == ["DNI must have 8 digits", "Validate the uniqueness of dni"]
    lines = out["report_lines"].collect()
    assert {r.section for r in lines} == set(range(12))
    assert any("C001, C002" in r.line for r in lines)
    path = sinks.write_markdown(out["report_lines"], str(tmp_path))
    assert spark.read.text(path).count() == len(lines)
    sinks.write_report({"kpis": out["kpis"]}, str(tmp_path))
    assert spark.read.json(f"{tmp_path}/kpis").count() == 7


def test_index_appends_once(spark, pack, tmp_path):
    docs = spark.createDataFrame(
        [("a", "a.md", "uno dos. tres"), ("b", "b.md", "cuatro")], "doc_id string, source string, text string"
    )
    index = sinks.ChunkIndex(spark, str(tmp_path / "index"))
    assert index.count() == 0
    assert jobs.document_job(docs, index, pack) == 2
    assert jobs.document_job(docs, index, pack) == 2
    asked = spark.createDataFrame([("q1", "cuatro?  cuatro")], "question_id string, question string")
    row = jobs.question_job(index, asked, pack).first()
    assert row.grounded and row.sources == ["b.md", "a.md"]  # the list is filled
    row = jobs.question_job(index, asked, pack, fill_zero=False).first()
    assert row.grounded and row.sources == ["b.md"]


def test_findings_of_arriving_files(spark, sales, pack, tmp_path):
    source = str(tmp_path / "in")
    sales.write.parquet(source)
    stream = spark.readStream.schema(sales.schema).parquet(source)
    query = findings_per_batch(
        stream, "ventas", pack, date(2025, 1, 1), str(tmp_path / "out"), str(tmp_path / "cp")
    )
    query.awaitTermination()
    found = spark.read.parquet(str(tmp_path / "out"))
    assert found.agg(F.count(F.lit(1))).first()[0] == 4


def test_csv_with_line_breaks_in_quotes(spark, tmp_path):
    path = tmp_path / "c.csv"
    path.write_text('id,nota\n1,"una\nlinea ""rota"""\n2,normal\n')
    got = tabular.read_csv(spark, str(path), row_id="pos").orderBy("pos").collect()
    assert [(r.id, r.nota) for r in got] == [("1", 'una\nlinea "rota"'), ("2", "normal")]


def test_order_text_sorts_like_the_numbers(spark):
    values = [-(2**63), -10, -9, -1, 0, 1, 9, 10, 2**63 - 1]
    df = jobs._sortable(spark.createDataFrame([(v, v) for v in values], "ord long, v long"), "ord")
    assert [r.v for r in df.orderBy("ord").collect()] == values


def test_intermediates_are_deleted(spark):
    with intermediates(spark):
        kept = cut(spark.range(5), "t")
        path = kept.inputFiles()[0].removeprefix("file://")
        assert kept.count() == 5 and os.path.exists(path)
    assert not os.path.exists(path)


def test_index_jobs_use_the_text_partitions(spark, tmp_path, monkeypatch):
    """The named partitions spread documents of one file, in both runs."""
    from lakewarden.plans import io_queries
    from lakewarden.plans.queries import TEXT_PARTITIONS

    rows = [(i, f"uno dos {i}. tres", "es", "a", 15) for i in range(9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    real, seen = jobs.document_job, []

    def spied(documents, *args, **options):
        seen.append(documents.rdd.getNumPartitions())
        return real(documents, *args, **options)

    monkeypatch.setattr(jobs, "document_job", spied)
    spark.conf.set(TEXT_PARTITIONS, "3")
    try:
        got = io_queries.index_jobs(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset(TEXT_PARTITIONS)
    assert seen == [3, 3]
    assert sorted((r.doc_id, r.chunks, r.last_chunk, r.grown) for r in got) == [(i, 1, 0, 0) for i in range(9)]
