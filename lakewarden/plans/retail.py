"""The five commercial tables, derived from the given star schema with known kinds of defects.

The SELECT texts use only what Spark SQL and DuckDB share, so the queries and their SQL
counterparts start from the same rows. ``{name}`` stands for a given table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources.tabular import read_table


def _text(expr: str) -> str:
    return f"CAST({expr} AS STRING)"


def _id(letter: str, expr: str) -> str:
    return f"'{letter}' || lpad({_text(expr)}, 9, '0')"


def _day(key: str) -> str:
    """A date between 2018 and 2026 as text."""
    year = f"CAST(2018 + {key} % 9 AS STRING)"
    month = f"lpad(CAST(1 + {key} % 12 AS STRING), 2, '0')"
    return f"{year} || '-' || {month} || '-' || lpad(CAST(1 + {key} % 28 AS STRING), 2, '0')"


def _pick(expr: str, values: list[str]) -> str:
    cases = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values))
    return f"CASE {expr} {cases} END"


_FIRST = ["Juan", "María", "Pedro", "Ana", "Luis", "José", "Rosa", "Carlos"]
_MIDDLE = [
    "Quispe", "Flores", "Sánchez", "Rojas", "García", "Mamani", "Torres", "Díaz", "Vásquez",
    "Castillo", "Huamán",
]
_LAST = [
    "Paredes", "Mendoza", "Salazar", "Chávez", "Ortega", "Villanueva", "Cárdenas", "Becerra",
    "Zegarra", "Ibáñez", "Núñez", "Llanos", "Delgado",
]
_COUNTRIES = ["Peru", "Perú", "PE", "Chile", "Colombia", "Ecuador", "chile", " peru "]
_GOODS = ["Textil", "Minera", "Pesquera", "Andina", "Costera", "Lechera", "Maderera"]
_FORMS = ["SAC", "S.A.C.", "EIRL", "SRL", "SA"]

SELECTS = {
    "clientes": f"""
SELECT c_custkey AS fila, {_id("C", "c_custkey")} AS cliente_id,
  {_pick("c_custkey % 8", _FIRST)} AS nombre,
  {_pick("c_custkey % 11", _MIDDLE)} || ' ' || {_pick("c_custkey % 13", _LAST)} AS apellido,
  CASE WHEN c_custkey % 3 = 1 THEN ''
       WHEN c_custkey % 50 = 7 THEN '99' || {_text("c_custkey")}
       WHEN c_custkey % 40 = 11 THEN {_text("10000000 + c_custkey - 11")}
       ELSE {_text("10000000 + c_custkey")} END AS dni,
  CASE WHEN c_custkey % 23 = 5 THEN 'cliente#' || {_text("c_custkey")}
       WHEN c_custkey % 17 = 3 THEN ' '
       WHEN c_custkey % 29 = 4 THEN 'Ventas@Empresa.com'
       ELSE 'cliente' || {_text("c_custkey")} || '@email.com' END AS correo,
  CASE WHEN c_custkey % 13 = 6 THEN NULL
       ELSE '9' || lpad({_text("c_custkey")}, 8, '0') END AS telefono,
  {_pick("c_nationkey % 8", _COUNTRIES)} AS pais,
  {_day("c_custkey")} AS fecha_registro,
  {_pick("c_custkey % 3", ["activo", "Activo", "inactivo"])} AS estado_cliente,
  CASE WHEN c_custkey % 19 = 8 THEN '' WHEN c_custkey % 5 = 0 THEN lower(c_mktsegment)
       ELSE c_mktsegment END AS segmento
FROM {{customer}}""",
    "productos": f"""
SELECT p_partkey AS fila, {_id("P", "p_partkey")} AS producto_id,
  'SKU-' || {_text("p_partkey - CASE WHEN p_partkey % 25 = 24 THEN 1 ELSE 0 END")} AS sku,
  p_name AS nombre_producto,
  CASE WHEN p_partkey % 6 = 1 THEN lower(p_type) ELSE p_type END AS categoria,
  p_brand AS marca,
  CASE WHEN p_partkey % 37 = 5 THEN -p_retailprice ELSE p_retailprice END AS precio,
  CASE WHEN p_partkey % 11 = 3 THEN NULL WHEN p_partkey % 7 = 2 THEN 'usd'
       WHEN p_partkey % 2 = 0 THEN 'USD' ELSE 'PEN' END AS moneda,
  {_day("p_partkey")} AS fecha_alta,
  CASE WHEN p_partkey % 41 = 7 THEN 'S999999999'
       ELSE {_id("S", "p_partkey % 10")} END AS proveedor_id
FROM {{part}}""",
    "proveedores": f"""
SELECT s_suppkey AS fila, {_id("S", "s_suppkey")} AS proveedor_id,
  CASE WHEN s_suppkey % 21 = 4 THEN '123'
       ELSE '20' || lpad({_text("s_suppkey - CASE WHEN s_suppkey % 15 = 14 THEN 1 ELSE 0 END")}, 9, '0')
       END AS ruc,
  {_pick("s_suppkey % 7", _GOODS)} || ' ' || s_name || ' ' || {_pick("s_suppkey % 5", _FORMS)} AS razon_social,
  CASE WHEN s_suppkey % 20 = 9 THEN 'nan'
       ELSE 'contacto' || {_text("s_suppkey % 60")} || '@proveedor.pe' END AS correo,
  {_pick("s_nationkey % 8", _COUNTRIES)} AS pais,
  {_pick("s_suppkey % 4", ["activo", "ACTIVO", "inactivo", "activo"])} AS estado
FROM {{supplier}}""",
    "sucursales": f"""
SELECT n_nationkey AS fila, {_id("T", "n_nationkey")} AS sucursal_id,
  'Sucursal ' || n_name AS nombre_sucursal, n_name AS ciudad,
  CAST(n_regionkey AS STRING) AS region, 'activa' AS estado
FROM {{nation}}""",
    "ventas": f"""
SELECT o_orderkey AS fila,
  {_id("V", "o_orderkey - CASE WHEN o_orderkey % 100 = 99 THEN 1 ELSE 0 END")} AS venta_id,
  CASE WHEN o_orderkey % 97 = 13 THEN 'C999999999' ELSE {_id("C", "o_custkey")} END AS cliente_id,
  CASE WHEN o_orderkey % 89 = 5 THEN 'P999999999' ELSE {_id("P", "o_orderkey % 200")} END AS producto_id,
  CASE WHEN o_orderkey % 3 = 0 THEN {_id("T", "0")}
       ELSE {_id("T", "o_orderkey % 27")} END AS sucursal_id,
  CASE WHEN o_orderkey % 211 = 9 THEN '2031-01-15'
       ELSE CAST(CAST(o_orderdate AS DATE) AS STRING) END AS fecha_venta,
  CASE WHEN o_orderkey % 61 = 7 THEN 0 ELSE 1 + o_orderkey % 9 END AS cantidad,
  CAST(10 + o_orderkey % 500 AS DOUBLE) / 4 AS precio_unitario,
  CASE WHEN o_orderkey % 71 = 8 THEN 1.5E0 ELSE CAST(0 AS DOUBLE) END
    + (CASE WHEN o_orderkey % 61 = 7 THEN 0 ELSE 1 + o_orderkey % 9 END)
    * (CAST(10 + o_orderkey % 500 AS DOUBLE) / 4) AS total,
  CASE WHEN o_orderkey % 31 = 2 THEN '' WHEN o_orderkey % 4 = 0 THEN 'Web'
       WHEN o_orderkey % 4 = 1 THEN 'web' ELSE 'Tienda' END AS canal
FROM {{orders}}""",
}
BASE = {
    "clientes": "customer",
    "productos": "part",
    "proveedores": "supplier",
    "sucursales": "nation",
    "ventas": "orders",
}


def retail_tables(
    spark: SparkSession, folder: str, names: tuple[str, ...] = tuple(SELECTS), keep_row: bool = False
) -> dict[str, DataFrame]:
    """Derived tables; ``keep_row`` leaves the row number ``fila`` in."""
    out = {}
    for name in names:
        base = BASE[name]
        df = spark.sql(SELECTS[name], **{base: read_table(spark, folder, base)})
        out[name] = df if keep_row else df.drop("fila")
    return out


def retail_ctes(names: tuple[str, ...] = tuple(SELECTS)) -> str:
    """The same tables as common table expressions; the row number stays in."""
    return ",\n".join(
        f"{n} AS ({SELECTS[n].format(**{BASE[n]: BASE[n]})})" for n in names
    )
