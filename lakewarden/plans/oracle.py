"""SQL counterparts of the queries, for DuckDB on the same Parquet tables."""

from __future__ import annotations

import json

from ..functions.text import WHITESPACE
from ..rules import RulePack
from .queries import EXPECTED, GIVEN, NEEDLES, STAR_TABLES
from .retail import SELECTS, retail_ctes

ORACLE: dict[str, str] = {}

COLUMNS = {
    "clientes": "cliente_id nombre apellido dni correo telefono pais fecha_registro estado_cliente segmento",
    "productos": "producto_id sku nombre_producto categoria marca precio moneda fecha_alta proveedor_id",
    "proveedores": "proveedor_id ruc razon_social correo pais estado",
    "sucursales": "sucursal_id nombre_sucursal ciudad region estado",
    "ventas": "venta_id cliente_id producto_id sucursal_id fecha_venta cantidad precio_unitario total canal",
    "customer": "c_custkey c_name c_nationkey c_acctbal c_mktsegment",
    "supplier": "s_suppkey s_name s_nationkey s_acctbal",
    "part": "p_partkey p_name p_brand p_type p_size p_retailprice",
    "orders": "o_orderkey o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority",
    "lineitem": "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax "
    "l_returnflag l_linestatus l_shipdate",
    "events": "event_id ts user_id event_type value props",
    "documents": "doc_id text lang source n_chars",
    "labels": "doc_id quality toxic",
    "region": "r_regionkey r_name",
    "nation": "n_nationkey n_name n_regionkey",
    "embeddings": "vec_id embedding label",
    "pages": "page_id url html",
    "benchmark": "item_id text",
    "conversations": "conv_id turn role text",
}
COLUMNS = {t: c.split() for t, c in COLUMNS.items()}
NUMERIC = {"fila", "precio", "cantidad", "precio_unitario", "total"}


def missing(col: str) -> str:
    return f"coalesce(lower(trim(CAST({col} AS VARCHAR), '{WHITESPACE}')) IN ('', 'nan'), true)"


def plain(col: str) -> str:
    return f"trim(regexp_replace(lower(strip_accents({col})), '[^a-z0-9]+', ' ', 'g'))"


def country(col: str) -> str:
    names = {
        "Peru": ("peru", "pe", "per"),
        "Chile": ("chile", "cl"),
        "Colombia": ("colombia", "co"),
        "Ecuador": ("ecuador", "ec"),
    }
    cases = " ".join(
        f"WHEN {plain(col)} IN ({', '.join(repr(v) for v in vs)}) THEN '{k}'" for k, vs in names.items()
    )
    return f"CASE {cases} ELSE trim({col}, '{WHITESPACE}') END"


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


# ---------------------------------------------------------------- findings


def finding(table, field, code, problem, dim, sev, rule, seq, ordinal, source, count="n") -> str:
    """One finding per row of ``source`` with a positive count; problem and rule are SQL texts."""
    return f"""SELECT '{table}' AS "table", {text(field)} AS field, '{code}' AS rule_code, {problem} AS problem,
 '{dim}' AS quality_dimension, '{sev}' AS severity, {text(rule)} AS suggested_rule,
 CAST({count} AS BIGINT) AS affected_count, CAST({seq} AS INTEGER) AS check_seq,
 CAST({ordinal} AS INTEGER) AS col_ordinal
FROM ({source}) AS s WHERE {count} > 0"""


def row_finding(table, field, code, words, dim, sev, rule, seq, ordinal, cond) -> str:
    source = f"SELECT count(*) FILTER (WHERE {cond}) AS n FROM {table}"
    problem = f"CAST(n AS VARCHAR) || ' {words}'"
    return finding(table, field, code, problem, dim, sev, rule, seq, ordinal, source)


def critical(field: str, hints: tuple[str, ...]) -> bool:
    return field.endswith("_id") or field == "sku" or any(h in field for h in hints)


def table_parts(table: str, spec: dict, hints: tuple[str, ...], shift: int) -> list[str]:
    cols = COLUMNS[table]
    place = {c: i + shift for i, c in enumerate(cols)}
    out = []
    for c in cols:
        high = critical(c, hints)
        out.append(
            row_finding(
                table, c, "missing", "missing or blank values", "completeness",
                "high" if high else "medium",
                f"{'Mandatory' if high else 'Recommended'} field: no blanks", 1, place[c], missing(c),
            )
        )
    for i, c in enumerate(spec.get("keys", [])):
        source = (
            f"SELECT sum(n - 1) AS n FROM (SELECT count(*) AS n FROM {table} "
            f"WHERE NOT {missing(c)} GROUP BY {c})"
        )
        out.append(
            finding(
                table, c, "duplicate_key", "CAST(n AS VARCHAR) || ' repeated values in an identifier'",
                "uniqueness", "high", f"Validate the uniqueness of {c}", 2, i, source,
            )
        )
    for c, pattern, code, words, sev, rule, seq in spec.get("formats", []):
        bad = f"NOT {missing(c)} AND NOT regexp_matches(trim({c}), '{pattern}')"
        out.append(row_finding(table, c, code, words, "validity", sev, rule, seq, 0, bad))
    for c in spec.get("negative", []):
        out.append(
            row_finding(
                table, c, "negative", "negative values", "validity", "high",
                f"{c} cannot be negative", 6, place[c], f"{c} < 0",
            )
        )
    for c in spec.get("zero", []):
        out.append(
            row_finding(
                table, c, "zero", "rows with zero", "validity", "medium",
                f"{c} must be greater than 0", 7, place[c], f"{c} = 0",
            )
        )
    for c in spec.get("dates", []):
        out.append(
            row_finding(
                table, c, "future_date", "dates in the future", "validity", "medium",
                f"{c} cannot be a future date", 8, place[c],
                f"try_cast({c} AS TIMESTAMP) > TIMESTAMP '{spec['as_of']}'",
            )
        )
    for c in [*spec.get("country", []), *spec.get("category", [])]:
        is_country = c in spec.get("country", [])
        canon = country("v") if is_country else plain("v")
        source = f"""SELECT count(*) AS groups, sum(sp) AS spellings,
 string_agg(names, '; ' ORDER BY canonical) FILTER (WHERE rn <= 3 OR {str(is_country).lower()}) AS examples
 FROM (SELECT *, row_number() OVER (ORDER BY canonical) AS rn FROM (
  SELECT canonical, count(*) AS sp, string_agg(v, '/' ORDER BY v) AS names
  FROM (SELECT v, {canon} AS canonical FROM (SELECT DISTINCT {c} AS v FROM {table} WHERE NOT {missing(c)}))
  GROUP BY canonical HAVING count(*) > 1))"""
        problem = "'Inconsistent spellings (' || examples || ')'"
        if is_country:
            out.append(
                finding(
                    table, c, "country_spelling", problem, "conformity", "medium",
                    "Map countries to a standard catalog", 9, place[c], source, "spellings",
                )
            )
        else:
            out.append(
                finding(
                    table, c, "category_spelling", problem, "consistency", "low",
                    f"Standardise the values of {c}", 9, place[c], source, "groups",
                )
            )
    for field, left, right, words, rule in spec.get("arithmetic", []):
        out.append(
            row_finding(
                table, field, "arithmetic", words, "accuracy", "high", rule, 10, 0,
                f"abs(({left}) - ({right})) > 0.01",
            )
        )
    for c, parent, key, i in spec.get("refs", []):
        source = f"""SELECT count(*) AS n FROM {table} WHERE NOT {missing(c)} AND NOT EXISTS (
 SELECT 1 FROM {parent} AS p WHERE trim(CAST(p.{key} AS VARCHAR)) = trim(CAST({table}.{c} AS VARCHAR)))"""
        out.append(
            finding(
                table, c, "orphan", f"CAST(n AS VARCHAR) || ' rows whose {c} is not in {parent}'",
                "referential_integrity", "high", f"Validate that {c} exists in {parent}", 11, i, source,
            )
        )
    sensitive = [c for c in cols if any(h in c for h in hints)]
    if sensitive:
        out.append(
            finding(
                table, ", ".join(sensitive), "unclassified",
                "'Fields with possible personal data and no formal classification'",
                "classification", "high",
                "Classify as personal or sensitive data and assign a data owner", 12, 0,
                f"SELECT {len(sensitive)} AS n",
            )
        )
    return out


EMAIL = (
    ("correo", "^[^@\\s]+@[^@\\s]+\\.[^@\\s]+$", "email_format", "e-mails with an invalid format", "medium",
     "Validate the e-mail format", 3),
)
RETAIL_HINTS = ("dni", "ruc", "correo", "email", "telefono", "direccion", "nombre", "apellido")
RETAIL_SPEC = {
    "clientes": {
        "keys": ["cliente_id", "dni"],
        "formats": [
            *EMAIL,
            ("dni", "^[0-9]{8}$", "dni_format", "DNI without exactly 8 digits", "high", "DNI must have 8 digits", 4),
        ],
        "dates": ["fecha_registro"],
        "country": ["pais"],
        "category": ["estado_cliente", "segmento"],
    },
    "productos": {
        "keys": ["producto_id", "sku"],
        "negative": ["precio"],
        "dates": ["fecha_alta"],
        "category": ["categoria", "moneda"],
        "refs": [("proveedor_id", "proveedores", "proveedor_id", 2)],
    },
    "proveedores": {
        "keys": ["proveedor_id", "ruc"],
        "formats": [
            *EMAIL,
            ("ruc", "^[0-9]{11}$", "ruc_format", "RUC without exactly 11 digits", "high", "RUC must have 11 digits", 5),
        ],
        "country": ["pais"],
        "category": ["estado"],
    },
    "sucursales": {"keys": ["sucursal_id"], "category": ["estado"]},
    "ventas": {
        "keys": ["venta_id"],
        "negative": ["precio_unitario", "total"],
        "zero": ["cantidad"],
        "dates": ["fecha_venta"],
        "category": ["canal"],
        "arithmetic": [
            ("total", "cantidad * precio_unitario", "total",
             "totals that differ from cantidad x precio_unitario", "total = cantidad * precio_unitario"),
        ],
        "refs": [
            ("cliente_id", "clientes", "cliente_id", 0),
            ("producto_id", "productos", "producto_id", 1),
            ("sucursal_id", "sucursales", "sucursal_id", 3),
        ],
    },
}
for _spec in RETAIL_SPEC.values():
    _spec["as_of"] = "2025-06-30"
STAR_SPEC = {
    "customer": {"keys": ["c_custkey"], "negative": ["c_acctbal"], "category": ["c_mktsegment"]},
    "supplier": {"keys": ["s_suppkey"], "negative": ["s_acctbal"]},
    "part": {"keys": ["p_partkey", "p_name"]},
    "orders": {
        "keys": ["o_orderkey"],
        "dates": ["o_orderdate"],
        "category": ["o_orderpriority"],
        "refs": [("o_custkey", "customer", "c_custkey", 0)],
    },
    "lineitem": {
        "keys": ["l_orderkey"],
        "zero": ["l_discount", "l_tax"],
        "dates": ["l_shipdate"],
        "refs": [
            ("l_orderkey", "orders", "o_orderkey", 1),
            ("l_partkey", "part", "p_partkey", 2),
            ("l_suppkey", "supplier", "s_suppkey", 3),
        ],
    },
    "events": {
        "keys": ["event_id"],
        "category": ["event_type"],
        "refs": [("user_id", "customer", "c_custkey", 4)],
    },
    "documents": {"keys": ["doc_id"], "refs": [("doc_id", "labels", "doc_id", 5)]},
    "labels": {"keys": ["doc_id"]},
}
STAR_SPEC |= {t: {} for t in STAR_TABLES if t not in STAR_SPEC}
for _spec in STAR_SPEC.values():
    _spec["as_of"] = "2000-01-01"


def all_findings(spec: dict, hints: tuple[str, ...], shift: int = 0) -> str:
    parts = [p for t, s in spec.items() for p in table_parts(t, s, hints, shift)]
    return "\nUNION ALL\n".join(parts)


RETAIL_FINDINGS = f"{retail_ctes()},\nfound AS ({all_findings(RETAIL_SPEC, RETAIL_HINTS)})"
# The same with the row number as first column.
RETAIL_FINDINGS_ROW = f"{retail_ctes()},\nfound AS ({all_findings(RETAIL_SPEC, RETAIL_HINTS, 1)})"
STAR_FINDINGS = f"found AS ({all_findings(STAR_SPEC, ('name',))})"

ORACLE["retail_findings"] = f"WITH {RETAIL_FINDINGS} SELECT * FROM found"
ORACLE["star_findings"] = f"WITH {STAR_FINDINGS} SELECT * FROM found"


def report_ctes(tables) -> str:
    rows = " UNION ALL ".join(
        f"SELECT '{t}' AS \"table\", {i} AS table_seq, count(*) AS rows FROM {t}" for i, t in enumerate(tables)
    )
    return f"""scored AS (
 SELECT "table", greatest(0, 100 - sum(least(raw, cap))) AS quality_score FROM (
  SELECT "table", quality_dimension, sum(CASE quality_dimension
    WHEN 'completeness' THEN CASE severity WHEN 'high' THEN 10 ELSE 2 END WHEN 'uniqueness' THEN 18
    WHEN 'validity' THEN 7 WHEN 'referential_integrity' THEN 18 WHEN 'consistency' THEN 5
    WHEN 'conformity' THEN 6 ELSE 8 END) AS raw,
   CASE quality_dimension WHEN 'completeness' THEN 16 WHEN 'uniqueness' THEN 18 WHEN 'validity' THEN 14
    WHEN 'referential_integrity' THEN 18 WHEN 'consistency' THEN 5 WHEN 'conformity' THEN 6
    WHEN 'classification' THEN 8 ELSE 1000000 END AS cap
  FROM found GROUP BY "table", quality_dimension) GROUP BY "table"),
issues AS (
 SELECT "table", string_agg(field || ': ' || problem, '|' ORDER BY rn) AS main_issues,
  string_agg(field || ': ' || problem, '; ' ORDER BY rn) FILTER (WHERE rn <= 3) AS top3
 FROM (SELECT *, row_number() OVER (PARTITION BY "table" ORDER BY
   CASE severity WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, check_seq, col_ordinal) AS rn FROM found)
 WHERE rn <= 5 GROUP BY "table"),
base AS (
 SELECT r."table", r.table_seq, r.rows, coalesce(c.n, 0) AS n_findings,
  CAST(coalesce(s.quality_score, 100) AS INTEGER) AS quality_score,
  coalesce(i.main_issues, '') AS main_issues, coalesce(i.top3, '') AS top3
 FROM ({rows}) AS r
 LEFT JOIN (SELECT "table", count(*) AS n FROM found GROUP BY "table") AS c USING ("table")
 LEFT JOIN scored AS s USING ("table") LEFT JOIN issues AS i USING ("table")),
report AS (
 SELECT *, CASE WHEN quality_score >= 80 THEN 'low' WHEN quality_score >= 65 THEN 'medium' ELSE 'high' END AS risk_level
 FROM base)"""


def report_sql(found: str, tables) -> str:
    return f"""WITH {found},\n{report_ctes(tables)}
SELECT "table", CAST(table_seq AS INTEGER) AS table_seq, rows, CAST(n_findings AS BIGINT) AS n_findings,
 quality_score, main_issues, risk_level,
 CASE WHEN n_findings = 0 THEN 'Table ' || "table" || ' has no relevant quality findings (score ' || quality_score
   || '/100, ' || risk_level || ' risk).'
  ELSE 'Table ' || "table" || ' scores ' || quality_score || '/100 (' || risk_level || ' risk) with ' || n_findings
   || ' findings; most relevant: ' || top3
   || '. Validation rules and the classification of sensitive fields come first.' END AS narrative
FROM report"""


ORACLE["retail_quality_report"] = report_sql(RETAIL_FINDINGS, list(SELECTS))
ORACLE["star_quality_report"] = report_sql(STAR_FINDINGS, STAR_TABLES)
ORACLE["overall_score_retail"] = f"""WITH {RETAIL_FINDINGS}, {report_ctes(SELECTS)}
SELECT CAST(round_even(avg(quality_score), 0) AS BIGINT) AS overall_score FROM report"""
ORACLE["spelling_variants_clientes"] = f"WITH {retail_ctes(('clientes',))}, v AS (" + " UNION ALL ".join(
    f"""SELECT '{c}' AS field, {country("v") if c == "pais" else plain("v")} AS canonical, v AS spelling, n
 FROM (SELECT {c} AS v, count(*) AS n FROM clientes WHERE NOT {missing(c)} GROUP BY {c})"""
    for c in ("pais", "estado_cliente", "segmento")
) + ") SELECT field, canonical, spelling, n FROM v QUALIFY count(*) OVER (PARTITION BY field, canonical) > 1"
ORACLE["completeness_contacts"] = f"""WITH contacts AS (SELECT
 array_to_string(regexp_extract_all(text, '([A-Za-z0-9._-]+@[A-Za-z0-9-]+\\.[A-Za-z0-9.-]+)', 1), ';') AS email,
 array_to_string(regexp_extract_all(text, '(\\+?[0-9]{{2,3}}[ -][0-9]{{3}}[ -][0-9]{{3,4}})', 1), ';') AS phone FROM documents)
SELECT field, severity, n AS affected_count FROM (
 SELECT 'email' AS field, 'high' AS severity, count(*) FILTER (WHERE {missing("email")}) AS n FROM contacts
 UNION ALL SELECT 'phone', 'medium', count(*) FILTER (WHERE {missing("phone")}) FROM contacts) WHERE n > 0"""
ORACLE["email_validity"] = """SELECT count(*) AS tokens,
 count(*) FILTER (WHERE NOT regexp_matches(trim(t), '^[^@\\s]+@[^@\\s]+\\.[^@\\s]+$')) AS invalid
FROM (SELECT unnest(regexp_extract_all(text, '([^ \\n\\t]+@[^ \\n\\t]+)', 1)) AS t FROM documents)"""
ORACLE["line_price_accuracy"] = (
    "WITH lines AS (SELECT * FROM lineitem JOIN part ON l_partkey = p_partkey) "
    + row_finding(
        "lines", "l_extendedprice", "arithmetic", "prices that differ", "accuracy", "high", "price rule", 10, 0,
        "abs(l_quantity * p_retailprice - l_extendedprice) > 0.01",
    ).replace("'lines' AS", "'lineitem' AS")
)
ORACLE["order_total_accuracy"] = (
    "WITH totals AS (SELECT * FROM orders JOIN (SELECT l_orderkey, sum(l_extendedprice) AS line_total "
    "FROM lineitem GROUP BY l_orderkey) ON o_orderkey = l_orderkey) "
    + row_finding(
        "totals", "o_totalprice", "arithmetic", "totals that differ", "accuracy", "high", "total rule", 10, 0,
        "abs(line_total - o_totalprice) > 0.01",
    ).replace("'totals' AS", "'orders' AS")
)
ORACLE["orphans_unlabelled"] = """SELECT CAST(doc_id AS VARCHAR) AS key, count(*) AS n FROM documents
WHERE doc_id NOT IN (SELECT doc_id FROM labels) GROUP BY doc_id"""
ORACLE["orphans_filtered_parent"] = """SELECT CAST(o_custkey AS VARCHAR) AS key, count(*) AS n FROM orders
WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_acctbal >= 0) GROUP BY o_custkey"""
ORACLE["records_involved_retail"] = f"WITH {retail_ctes(('clientes', 'productos', 'proveedores'))} " + " UNION ALL ".join(
    f"""SELECT '{t}' AS "table", '{c}' AS field, CAST(coalesce(sum(n) FILTER (WHERE n > 1), 0) AS BIGINT) AS involved
FROM (SELECT count(*) AS n FROM {t} WHERE NOT {missing(c)} GROUP BY {c})"""
    for t, c in (("clientes", "dni"), ("productos", "sku"), ("proveedores", "ruc"))
)

# ---------------------------------------------------------------- inventory, profiles, names


def _counted(tables) -> str:
    """Row and column counts; ``fila`` is not part of the derived tables here."""
    return " UNION ALL ".join(
        f"SELECT '{t}' AS \"table\", count(*) AS rows, {len(COLUMNS[t])} AS columns FROM {t}" for t in tables
    )


ORACLE["table_inventory_all"] = _counted(GIVEN)
_rules = []
for _t, _s in RETAIL_SPEC.items():
    _rules += [(_t, k, "unique", None, None) for k in _s["keys"]]
    _rules += [(_t, c, "reference", p, k) for c, p, k, _ in _s.get("refs", [])]
_rule_rows = ", ".join(
    "(" + ", ".join("NULL" if v is None else text(v) for v in r) + ")" for r in _rules
)
ORACLE["key_rules"] = f"""WITH {retail_ctes()}, counted AS ({_counted(SELECTS)})
SELECT * FROM (VALUES {_rule_rows}) AS r("table", field, rule_kind, parent_table, parent_column)
JOIN counted USING ("table")"""

REASONS = [
    ("dni", "identity document"), ("ruc", "tax identifier"), ("correo", "e-mail address"),
    ("email", "e-mail address"), ("mail", "e-mail address"), ("telefono", "telephone number"),
    ("phone", "telephone number"), ("celular", "telephone number"), ("direccion", "postal address"),
    ("address", "postal address"), ("nombre", "person name"), ("apellido", "person name"),
    ("tarjeta", "financial data"), ("cuenta", "financial data"), ("pasaporte", "identity document"),
]


def reason(col: str) -> str:
    return "CASE " + " ".join(f"WHEN contains(lower({col}), '{h}') THEN '{r}'" for h, r in REASONS) + " END"


def hinted(col: str, hints) -> str:
    return "(" + " OR ".join(f"contains(lower({col}), '{h}')" for h in hints) + ")"


def identifier(col: str, ratio: str) -> str:
    return f"""(lower({col}) = 'id' OR ends_with(lower({col}), '_id') OR starts_with(lower({col}), 'id_')
 OR ({hinted(col, ("_id", "id_", "dni", "ruc", "sku", "codigo", "code"))} AND {ratio} > 0.5) OR {ratio} >= 0.98)"""


_PERSONAL = hinted("col", RETAIL_HINTS)
_names = ", ".join(f"('{t}', '{c}')" for t in [*SELECTS, *GIVEN] for c in COLUMNS[t])
ORACLE["name_rules"] = f"""WITH {retail_ctes()}, counted AS ({_counted([*SELECTS, *GIVEN])}),
names AS (SELECT * FROM (VALUES {_names}) AS v("table", col))
SELECT "table", col AS "column", rows,
 ({_PERSONAL} OR ends_with(col, '_id') OR col = 'sku') AS is_critical,
 {reason("col")} AS sensitive_reason, {identifier("col", "0.6")} AS is_identifier,
 CASE WHEN {_PERSONAL} THEN 'personal data' WHEN ends_with(col, '_id') OR col = 'sku' THEN 'master data'
  WHEN {hinted("col", ("precio", "total", "monto"))} THEN 'financial data' ELSE 'operational data' END AS classification,
 CASE WHEN {_PERSONAL} OR ends_with(col, '_id') OR col = 'sku' THEN 'high' ELSE 'medium' END AS criticality,
 CASE WHEN col = 'dni' THEN 'mandatory|8 digits|unique' WHEN col = 'ruc' THEN 'mandatory|11 digits|unique'
  WHEN {hinted("col", ("correo", "email"))} THEN 'valid e-mail format'
  WHEN ends_with(col, '_id') OR col = 'sku' THEN 'mandatory|unique' ELSE 'mandatory' END AS rules
FROM names JOIN counted USING ("table")"""


def profile_cte(table: str, columns: list[str], keys: list[str], numeric: set, samples: bool) -> str:
    parts = []
    for i, c in enumerate(columns):
        number = c in numeric
        stats = (
            f"CAST(min({c}) AS DOUBLE) AS min_value, CAST(max({c}) AS DOUBLE) AS max_value, round(avg({c}), 4) AS mean_value"
            if number
            else "CAST(NULL AS DOUBLE) AS min_value, CAST(NULL AS DOUBLE) AS max_value, CAST(NULL AS DOUBLE) AS mean_value"
        )
        sample = (
            f"""coalesce((SELECT string_agg(v, '|' ORDER BY fila) FROM (SELECT CAST({c} AS VARCHAR) AS v, fila
 FROM {table} WHERE {c} IS NOT NULL ORDER BY fila LIMIT 3)), '')"""
            if samples
            else "''"
        )
        share = (
            f"""(SELECT avg(CASE WHEN regexp_matches(trim(v), '^[^@\\s]+@[^@\\s]+\\.[^@\\s]+$') THEN 1.0 ELSE 0.0 END)
 FROM (SELECT CAST({c} AS VARCHAR) AS v FROM {table} WHERE {c} IS NOT NULL))"""
            if samples
            else "0.0"
        )
        parts.append(
            f"""SELECT '{table}' AS "table", '{c}' AS col, {i} AS ordinal, {str(c in keys).lower()} AS is_key,
 count(*) AS rows, count({c}) AS non_null, count(*) - count({c}) AS null_count,
 round(100.0 * (count(*) - count({c})) / count(*), 2) AS null_pct, count(DISTINCT {c}) AS unique_count, {stats},
 {sample} AS sample_values, {share} AS email_share FROM {table}"""
        )
    return "\nUNION ALL\n".join(parts)


PROFILE_COLUMNS = f"""profiled AS (
SELECT "table", col AS "column", CAST(ordinal AS INTEGER) AS ordinal, is_key, rows, non_null, null_count, null_pct,
 unique_count, unique_count <= 1 AS is_constant,
 coalesce(unique_count / nullif(non_null, 0), 0) >= 0.9 AND non_null > 1 AS is_high_cardinality,
 {identifier("col", "coalesce(unique_count / nullif(non_null, 0), 0)")} AS is_possible_identifier,
 coalesce({reason("col")}, CASE WHEN email_share > 0.6 THEN 'e-mail address' END) AS sensitive_reason,
 coalesce({reason("col")}, CASE WHEN email_share > 0.6 THEN 'e-mail address' END) IS NOT NULL AS is_possible_sensitive,
 min_value, max_value, mean_value, sample_values FROM raw_profile)"""


def retail_profile(tables, samples: bool = True) -> str:
    raw = "\nUNION ALL\n".join(
        profile_cte(t, ["fila", *COLUMNS[t]], RETAIL_SPEC[t]["keys"], NUMERIC, samples) for t in tables
    )
    return f"raw_profile AS ({raw}), {PROFILE_COLUMNS}"


for _t in ("clientes", "productos", "ventas"):
    ORACLE[f"profile_columns_{_t}"] = (
        f"WITH {retail_ctes((_t,))}, {retail_profile((_t,))} SELECT * FROM profiled"
    )
_LINE = "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus l_shipdate".split()
ORACLE["profile_columns_lineitem"] = f"""WITH raw_profile AS ({
    profile_cte("lineitem", _LINE, ["l_orderkey"], {*_LINE} - {'l_returnflag', 'l_linestatus', 'l_shipdate'}, False)
}), {PROFILE_COLUMNS} SELECT * EXCLUDE (sample_values) FROM profiled"""
_dup_rows = " UNION ALL ".join(
    f"""SELECT '{t}' AS "table", coalesce(sum(n - 1), 0) AS duplicate_rows
FROM (SELECT count(*) AS n FROM {t} GROUP BY ALL)""".replace("count(*) AS n", f"{', '.join(['fila', *COLUMNS[t]])}, count(*) AS n")
    for t in SELECTS
)
PROFILE_TABLES = f"""{retail_profile(SELECTS)},
dup_rows AS ({_dup_rows}),
table_profile AS (SELECT "table", max(rows) AS rows, CAST(count(*) AS INTEGER) AS columns,
 coalesce(string_agg("column", '|' ORDER BY ordinal) FILTER (WHERE is_possible_sensitive), '') AS sensitive_fields,
 coalesce(string_agg("column", '|' ORDER BY ordinal) FILTER (WHERE is_possible_identifier), '') AS identifier_fields,
 coalesce(string_agg("column", '|' ORDER BY ordinal) FILTER (WHERE is_constant), '') AS constant_fields,
 coalesce(string_agg("column" || '=' || null_count, '|' ORDER BY "column") FILTER (WHERE null_count > 0), '') AS nulls,
 coalesce(string_agg("column" || '=' || (non_null - unique_count), '|' ORDER BY "column")
  FILTER (WHERE is_key AND non_null > unique_count), '') AS duplicates
 FROM profiled GROUP BY "table")"""
ORACLE["profile_tables"] = f"""WITH {retail_ctes()}, {PROFILE_TABLES}
SELECT p.*, CAST(duplicate_rows AS BIGINT) AS duplicate_rows FROM table_profile AS p JOIN dup_rows USING ("table")"""
ORACLE["duplicate_rows_lineitem"] = """SELECT CAST(sum(n - 1) AS BIGINT) AS duplicate_rows FROM (
 SELECT count(*) AS n FROM (SELECT * FROM lineitem) AS l GROUP BY l)"""
ORACLE["key_duplicates_lineitem"] = """SELECT CAST(sum(n - 1) AS BIGINT) AS extras,
 CAST(sum(n) FILTER (WHERE n > 1) AS BIGINT) AS records_involved
FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber)"""
ORACLE["normalize_text_docs"] = f"""SELECT doc_id, CAST(length(p) AS BIGINT) AS n_plain, md5(p) AS plain_md5
FROM (SELECT doc_id, {plain("text")} AS p FROM documents)"""
ORACLE["normalize_contacts"] = f"""WITH {retail_ctes(("clientes",))}
SELECT fila, {plain("nombre || ' ' || apellido")} AS name, lower(trim(correo)) AS email,
 {country("pais")} AS country, {missing("telefono")} AS no_phone FROM clientes"""
ORACLE["json_extract"] = """SELECT event_id,
 CASE WHEN event_type = 'error' THEN NULL ELSE CAST(json_extract(props, '$.k') AS BIGINT) END AS k FROM events"""

# ---------------------------------------------------------------- duplicates


def key_members(source: str) -> str:
    """Members of exact-key groups of a relation ``ord, member_id, key``."""
    return f"""SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY key) AS size FROM (
 SELECT ord, member_id, trim(key, '{WHITESPACE}') AS key FROM {source})
 WHERE key IS NOT NULL AND key NOT IN ('', 'nan', 'None')) WHERE size > 1"""


_DOCS = "docs AS (SELECT doc_id AS ord, CAST(doc_id AS VARCHAR) AS member_id, text AS key FROM documents)"
ORACLE["mdm_exact_documents"] = f"""WITH {_DOCS} SELECT 'key:' || key AS group_id, ord AS doc_id, size
FROM ({key_members("docs")})"""
ORACLE["mdm_exact_documents_total"] = f"""WITH {_DOCS}
SELECT 'document' AS entity, CAST(sum(size - 1) AS BIGINT) AS duplicates_detected, count(*) AS n_groups
FROM (SELECT DISTINCT key, size FROM ({key_members("docs")}))"""


def golden(table: str, columns: dict[str, str], key: str, order: str, group: str) -> str:
    """Most frequent value per group and column, the longest if none repeats, then the first."""
    long = " UNION ALL ".join(
        f"SELECT g, '{c}' AS col, CAST({c} AS VARCHAR) AS v, {order} AS ord FROM members" for c in columns
    )
    picks = ", ".join(
        f"CAST(max(v) FILTER (WHERE col = '{c}') AS {t}) AS {c}" for c, t in columns.items()
    )
    return f"""members AS (SELECT *, trim({key}) AS g FROM {table} WHERE {key} IS NOT NULL
 AND trim({key}) NOT IN ('', 'nan', 'None') QUALIFY count(*) OVER (PARTITION BY trim({key})) > 1),
counted AS (SELECT g, col, v, count(*) AS n, min(ord) AS first FROM ({long})
 WHERE v IS NOT NULL AND trim(v) <> '' GROUP BY g, col, v),
best AS (SELECT * FROM counted QUALIFY row_number() OVER (PARTITION BY g, col
 ORDER BY n DESC, CASE WHEN n = 1 THEN -length(v) ELSE 0 END, first) = 1)
SELECT {group}, {picks} FROM best GROUP BY g"""


_PART_TYPES = {
    "p_partkey": "BIGINT", "p_name": "VARCHAR", "p_brand": "VARCHAR", "p_type": "VARCHAR",
    "p_size": "INTEGER", "p_retailprice": "DOUBLE",
}
ORACLE["golden_part"] = "WITH " + golden("part", _PART_TYPES, "p_name", "p_partkey", "g AS p_key")
ORACLE["golden_clientes"] = f"WITH {retail_ctes(('clientes',))}, " + golden(
    "clientes",
    {"fila": "BIGINT", **dict.fromkeys(COLUMNS["clientes"], "VARCHAR")},
    "dni",
    "fila",
    "'key:' || g AS group_id",
)


def fuzzy_ctes(source: str) -> str:
    """Greedy leader clusters of ``ord, member_id, key, name, email``, straight from the definition.

    Similarity by a bit-parallel longest common subsequence on names of up to 62 characters.
    """
    return f"""keyed AS ({key_members(source)}),
rest AS (SELECT ord, member_id, array_to_string(list_sort(string_split({plain("name")}, ' ')), ' ') AS name,
 CASE WHEN NOT {missing("email")} THEN lower(trim(email)) END AS email
 FROM {source} WHERE ord NOT IN (SELECT ord FROM keyed) AND {plain("name")} <> ''),
nodes AS (SELECT name, email, min(ord) AS node, count(*) AS size, length(name) AS len,
 row_number() OVER (ORDER BY min(ord)) AS idx FROM rest GROUP BY name, email),
names AS (SELECT DISTINCT name, len FROM nodes),
masks AS (SELECT a.name, c, CAST(sum(CAST(1 AS BIGINT) << (i - 1)) AS BIGINT) AS mask FROM (
 SELECT name, unnest(range(1, len + 1)) AS i, unnest(string_split(name, '')) AS c FROM names) AS a GROUP BY a.name, c),
maps AS (SELECT name, map_from_entries(list((c, mask))) AS m FROM masks GROUP BY name),
close AS (SELECT a.name AS x, b.name AS y FROM names AS a JOIN names AS b
 ON a.name < b.name AND 200 * least(a.len, b.len) >= 88 * (a.len + b.len)
 JOIN maps ON maps.name = a.name
 WHERE 200 * (a.len - bit_count(list_reduce(list_prepend((CAST(1 AS BIGINT) << a.len) - 1,
  list_transform(string_split(b.name, ''), lambda c: coalesce(m[c], 0))),
  lambda v, k: ((v + (v & k)) | (v & ~k)) & ((CAST(1 AS BIGINT) << a.len) - 1)))) >= 88 * (a.len + b.len)),
alike AS (SELECT x, y FROM close UNION ALL SELECT y, x FROM close UNION ALL SELECT name, name FROM names),
pairs AS (SELECT b.idx, a.node AS earlier FROM nodes AS a JOIN alike ON x = a.name JOIN nodes AS b ON b.name = y
  AND a.idx < b.idx
 UNION SELECT b.idx, a.node FROM nodes AS a JOIN nodes AS b ON a.email = b.email AND a.idx < b.idx),
adj AS (SELECT n.idx, n.node, coalesce(list(p.earlier) FILTER (WHERE p.earlier IS NOT NULL), []) AS earlier
 FROM nodes AS n LEFT JOIN pairs AS p USING (idx) GROUP BY n.idx, n.node),
walk AS (SELECT CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS leaders
 UNION ALL SELECT i + 1, CASE WHEN list_has_any(leaders, earlier) THEN leaders ELSE list_append(leaders, node) END
 FROM walk JOIN adj ON adj.idx = walk.i + 1),
final AS (SELECT leaders FROM walk ORDER BY i DESC LIMIT 1),
placed AS (SELECT node, CASE WHEN list_contains(leaders, node) THEN node
  ELSE list_min(list_intersect(leaders, earlier)) END AS leader FROM adj, final),
fuzzy AS (SELECT * FROM (SELECT rest.ord, rest.member_id, leader, count(*) OVER (PARTITION BY leader) AS size
 FROM rest JOIN nodes ON nodes.name = rest.name AND nodes.email IS NOT DISTINCT FROM rest.email
 JOIN placed USING (node)) WHERE size > 1),
members AS (
 SELECT 'key:' || key AS group_id, 'exact_key' AS match_type, ord, member_id, size FROM keyed
 UNION ALL SELECT 'name:' || leader, 'fuzzy_name', ord, member_id, size FROM fuzzy)"""


_PART_SOURCE = """src AS (SELECT p_partkey AS ord, CAST(p_partkey AS VARCHAR) AS member_id, CAST(NULL AS VARCHAR) AS key,
 p_name AS name, CAST(NULL AS VARCHAR) AS email FROM part)"""
_PARTS = f"WITH RECURSIVE {_PART_SOURCE}, {fuzzy_ctes('src')}"
GROUPS = """SELECT group_id, match_type, count(*) AS size, min(ord) AS first_ord,
 CASE match_type WHEN 'exact_key' THEN CAST(0.98 AS DOUBLE)
  ELSE round(least(CAST(0.97 AS DOUBLE), CAST(0.88 AS DOUBLE) + CAST(0.02 AS DOUBLE) * (count(*) - 1)), 2) END AS confidence,
 CASE match_type WHEN 'exact_key' THEN substr(group_id, 5) || ' shared by ' || count(*) || ' records'
  ELSE count(*) || ' records with very similar names or the same e-mail' END AS evidence
FROM members GROUP BY group_id, match_type"""
ORACLE["fuzzy_clusters_part"] = f"{_PARTS} SELECT group_id, ord AS p_partkey, member_id, size FROM members"
ORACLE["fuzzy_groups_part"] = f"""{_PARTS} SELECT group_id, match_type, confidence, size, evidence FROM ({GROUPS})"""
_CLIENTS = """src AS (SELECT fila AS ord, cliente_id AS member_id, dni AS key, nombre || ' ' || apellido AS name,
 correo AS email FROM clientes)"""
_SUPPLIERS = """src AS (SELECT fila AS ord, proveedor_id AS member_id, ruc AS key, razon_social AS name,
 correo AS email FROM proveedores)"""
ORACLE["mdm_clientes"] = f"""WITH RECURSIVE {retail_ctes(("clientes",))}, {_CLIENTS}, {fuzzy_ctes("src")}
SELECT * FROM members"""
ORACLE["mdm_proveedores"] = f"""WITH RECURSIVE {retail_ctes(("proveedores",))}, {_SUPPLIERS}, {fuzzy_ctes("src")}
SELECT group_id, match_type, confidence, size FROM ({GROUPS})"""
ORACLE["mdm_key_groups_clientes"] = f"""WITH {retail_ctes(("clientes",))}, {_CLIENTS},
members AS (SELECT 'key:' || key AS group_id, 'exact_key' AS match_type, ord, member_id, size FROM ({key_members("src")}))
SELECT 'cliente' AS entity, * FROM ({GROUPS})"""

# ---------------------------------------------------------------- catalog, recommendations, report

# Definitions of the default rule pack, as far as the derived tables have the fields.
DEFINITIONS = {
    "cliente_id": "Identificador único del cliente", "producto_id": "Identificador único del producto",
    "proveedor_id": "Identificador único del proveedor", "venta_id": "Identificador único de la venta",
    "dni": "Documento Nacional de Identidad del cliente", "ruc": "Registro Único de Contribuyentes",
    "sku": "Código único de inventario del producto (Stock Keeping Unit)",
    "correo": "Correo electrónico de contacto", "telefono": "Número telefónico de contacto",
    "nombre": "Nombre de la persona", "apellido": "Apellido de la persona",
    "razon_social": "Razón social del proveedor", "precio": "Precio del producto",
    "total": "Importe total de la venta", "fecha_registro": "Fecha de registro del cliente",
    "fecha_venta": "Fecha en que se realizó la venta",
}
_defs = ", ".join(f"({text(k)}, {text(v)})" for k, v in DEFINITIONS.items())
DICTIONARY = """entries AS (SELECT p_brand AS place,
 CASE WHEN p_brand LIKE '%1' THEN 'sku' WHEN p_brand LIKE '%2' THEN 'precio' ELSE '' END AS field,
 CASE WHEN p_brand LIKE '%1' THEN 'master data' ELSE 'operational data' END AS classification,
 CASE WHEN p_brand LIKE '%2' THEN 'high' ELSE 'medium' END AS criticality
 FROM (SELECT DISTINCT p_brand FROM part)),
dictionary AS (SELECT 'productos' AS "table", field, classification, criticality,
 'Entry of ' || place AS business_definition, '' AS data_owner, 'Catalog steward' AS data_steward,
 'must be unique' AS base_rule, 'demo' AS source_system
 FROM entries WHERE field <> '' QUALIFY row_number() OVER (PARTITION BY field ORDER BY place DESC) = 1)"""
ORACLE["dictionary_entries"] = f"WITH {DICTIONARY} SELECT * FROM dictionary"


def catalog_cte(dictionary: str) -> str:
    personal = hinted('p."column"', RETAIL_HINTS)
    master = "(ends_with(p.\"column\", '_id') OR p.\"column\" = 'sku')"
    money = hinted('p."column"', ("precio", "total", "monto"))
    return f"""known AS (SELECT * FROM (VALUES {_defs}) AS v(field, definition)),
owners AS (SELECT * FROM (VALUES ('clientes', 'Gerencia Comercial', 'Analista de Clientes'),
 ('productos', 'Gerencia de Producto', 'Analista de Catálogo'), ('ventas', 'Gerencia Comercial', 'Analista de Ventas'),
 ('proveedores', 'Gerencia de Compras', 'Analista de Proveedores')) AS v("table", owner, steward)),
field_rules AS (SELECT "table", field, list_sort(list_distinct(list(suggested_rule))) AS rules FROM found
 GROUP BY "table", field),
catalog AS (SELECT p."table", p."column" AS field,
 coalesce(nullif(d.business_definition, ''), k.definition, 'Field ' || p."column" || ' of table ' || p."table")
  AS business_definition,
 coalesce(nullif(d.classification, ''), CASE WHEN {personal} THEN 'personal data' WHEN {master} THEN 'master data'
  WHEN {money} THEN 'financial data' ELSE 'operational data' END) AS classification,
 coalesce(nullif(d.criticality, ''), CASE WHEN {personal} OR {master} THEN 'high' ELSE 'medium' END) AS criticality,
 coalesce(nullif(d.data_owner, ''), o.owner, 'Gobierno de Datos') AS data_owner,
 coalesce(nullif(d.data_steward, ''), o.steward, 'Data Steward asignado') AS data_steward,
 CASE WHEN p."table" = 'ventas' THEN 'daily' ELSE 'on event' END AS update_frequency,
 array_to_string(list_concat(base, CASE WHEN d.base_rule IS NULL OR list_contains(base, d.base_rule) THEN []
  ELSE [d.base_rule] END), '|') AS quality_rules
 FROM (SELECT p.*, coalesce(r.rules, CASE WHEN p."column" = 'dni' THEN ['mandatory', '8 digits', 'unique']
   WHEN p."column" = 'ruc' THEN ['mandatory', '11 digits', 'unique']
   WHEN {hinted('p."column"', ("correo", "email"))} THEN ['valid e-mail format']
   WHEN {master} THEN ['mandatory', 'unique'] ELSE ['mandatory'] END) AS base
  FROM profiled AS p LEFT JOIN field_rules AS r ON r."table" = p."table" AND r.field = p."column") AS p
 LEFT JOIN known AS k ON k.field = p."column" LEFT JOIN owners AS o ON o."table" = p."table"
 LEFT JOIN {dictionary} AS d ON d."table" = p."table" AND d.field = p."column"
 WHERE p.is_possible_sensitive OR p.is_possible_identifier OR k.definition IS NOT NULL)"""


ORACLE["catalog_entries"] = f"""WITH {RETAIL_FINDINGS}, {retail_profile(SELECTS)}, {DICTIONARY},
{catalog_cte("dictionary")} SELECT * FROM catalog"""
ORACLE["catalog_merged"] = f"""WITH written AS (
 SELECT 'clientes' AS t, CASE c_custkey % 4 WHEN 0 THEN 'nombre' WHEN 1 THEN 'correo' WHEN 2 THEN 'pais' ELSE 'dni' END AS f,
  'Written for record ' || max(c_custkey) AS d FROM customer GROUP BY 1, 2),
entries AS ({ORACLE["catalog_entries"]})
SELECT entries.* REPLACE (coalesce(d, business_definition) AS business_definition)
FROM entries LEFT JOIN written ON "table" = t AND lower(field) = f"""
ORACLE["catalog_feed"] = """SELECT 'clientes' AS "table", lower(c_mktsegment) AS field_key,
 'Segment ' || c_mktsegment AS business_definition FROM (SELECT DISTINCT c_mktsegment FROM customer)"""
ORACLE["recommendation_feed"] = """WITH c AS (SELECT o_orderpriority AS p, count(*) AS n FROM orders GROUP BY 1)
SELECT p AS response_id, CAST(1 AS INTEGER) AS seq, 'high' AS priority, 'Check ' || p AS title, n || ' orders' AS risk,
 '' AS suggested_action, '' AS responsible, '' AS expected_impact, '' AS estimated_effort FROM c
UNION ALL SELECT p, 2, 'medium', 'Second', '', '', '', '', '' FROM c"""

_entity_keys = [
    ("cliente", "clientes", "dni"), ("producto", "productos", "sku"), ("proveedor", "proveedores", "ruc"),
    ("sucursal", "sucursales", "sucursal_id"),
]
_dupes = " UNION ALL ".join(
    f"""SELECT '{e}' AS entity, {i} AS entity_seq, CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS duplicates_detected,
 count(*) AS n_groups FROM (SELECT count(*) AS n FROM {t} WHERE {k} IS NOT NULL AND trim({k}) NOT IN ('', 'nan', 'None')
 GROUP BY trim({k}) HAVING count(*) > 1)"""
    for i, (e, t, k) in enumerate(_entity_keys)
)
BY_KEY = f"""{RETAIL_FINDINGS_ROW}, {report_ctes(SELECTS)}, {PROFILE_TABLES},
no_dictionary AS (SELECT '' AS "table", '' AS field, '' AS business_definition, '' AS classification,
 '' AS criticality, '' AS data_owner, '' AS data_steward, CAST(NULL AS VARCHAR) AS base_rule),
{catalog_cte("no_dictionary")}, dupes AS ({_dupes}),
risk_rows AS (
 SELECT 1 AS part, table_seq AS place, 'Table ' || "table" || ' has a high quality risk (score ' || quality_score || ').' AS risk
 FROM report WHERE risk_level = 'high'
 UNION ALL SELECT 2, entity_seq, duplicates_detected || ' possible duplicates in ' || entity || ' (single view at risk).'
 FROM dupes WHERE duplicates_detected > 0
 UNION ALL SELECT 3, table_seq, 'Personal data without formal classification in ' || "table" || ': '
  || replace(sensitive_fields, '|', ', ') || '.' FROM table_profile JOIN report USING ("table") WHERE sensitive_fields <> ''),
risk AS (SELECT CAST(row_number() OVER (ORDER BY part, place) AS INTEGER) AS seq, risk FROM risk_rows),
kpi AS (
 SELECT 1 AS seq, 'datasets_analysed' AS kpi, (SELECT count(*) FROM table_profile) AS value
 UNION ALL SELECT 2, 'findings_detected', (SELECT count(*) FROM found)
 UNION ALL SELECT 3, 'suggested_rules', (SELECT count(DISTINCT suggested_rule) FROM found)
 UNION ALL SELECT 4, 'duplicates_detected', (SELECT CAST(sum(duplicates_detected) AS BIGINT) FROM dupes)
 UNION ALL SELECT 5, 'sensitive_fields', (SELECT count(*) FROM profiled WHERE is_possible_sensitive)
 UNION ALL SELECT 6, 'catalogued_fields', (SELECT count(*) FROM catalog)
 UNION ALL SELECT 7, 'mean_score', (SELECT CAST(round_even(avg(quality_score), 0) AS BIGINT) FROM report)),
high AS (SELECT "table", array_to_string(list_sort(list_distinct(list(quality_dimension))), ', ') AS dims,
 array_to_string(list_slice(list_sort(list_distinct(list(suggested_rule))), 1, 4), '; ') AS rules
 FROM found WHERE severity = 'high' GROUP BY "table"),
recs AS (
 SELECT 1 AS part, quality_score AS rank, table_seq AS tie, CASE WHEN quality_score < 65 THEN 'high' ELSE 'medium' END AS priority,
  'Improve the quality of table ' || "table" AS title,
  'Score ' || quality_score || '/100 (' || risk_level || ' risk); dimensions affected: ' || dims || '.' AS risk,
  'Implement validation rules: ' || rules AS suggested_action, 'Data owner of ' || "table" AS responsible,
  'Fewer errors and more trust in the reports.' AS expected_impact, 'medium' AS estimated_effort
 FROM report JOIN high USING ("table")
 UNION ALL SELECT 2, entity_seq, 0, 'high', 'Consolidate the duplicates of ' || entity,
  duplicates_detected || ' possible duplicates blur the single view of ' || entity || '.',
  'Apply the golden records and the matching rules (key, then similarity).', 'Data steward of ' || entity,
  'Single view of the master entity and fewer duplicates.', 'medium' FROM dupes WHERE duplicates_detected > 0),
lines AS (
 SELECT 1 AS part, table_seq AS a, check_seq AS b, col_ordinal AS c, f."table" || '.' || field || ': ' || problem || ' ['
  || quality_dimension || ', ' || severity || ']' AS line FROM found AS f JOIN report AS r ON r."table" = f."table"
 UNION ALL SELECT 2, entity_seq, 0, 0, entity || ': ' || duplicates_detected || ' possible duplicates (MDM)'
 FROM dupes WHERE duplicates_detected > 0)"""
ORACLE["risks_by_key"] = f"WITH {BY_KEY} SELECT seq, risk FROM risk"
ORACLE["kpis_by_key"] = f"WITH {BY_KEY} SELECT CAST(seq AS INTEGER) AS seq, kpi, CAST(value AS BIGINT) AS value FROM kpi"
ORACLE["recommendations_by_key"] = f"""WITH {BY_KEY}
SELECT CAST(row_number() OVER (ORDER BY part, rank, tie, title) AS INTEGER) AS seq,
 * EXCLUDE (part, rank, tie) FROM recs"""
ORACLE["finding_lines_by_key"] = f"""WITH {BY_KEY}
SELECT CAST(row_number() OVER (ORDER BY part, a, b, c, line) AS INTEGER) AS seq, line FROM lines QUALIFY seq <= 60"""


def _kpi(name: str) -> str:
    return f"(SELECT value FROM kpi WHERE kpi = '{name}')"


ORACLE["summary_by_key"] = f"""WITH {BY_KEY} SELECT
 'Analysed ' || {_kpi("datasets_analysed")} || ' datasets with an overall quality score of ' || {_kpi("mean_score")}
 || '/100. Found ' || {_kpi("findings_detected")} || ' quality findings and ' || {_kpi("duplicates_detected")}
 || ' possible duplicates. ' || {_kpi("sensitive_fields")}
 || ' fields with personal data need classification and owners.' AS executive_summary,
 'Datasets: ' || (SELECT string_agg("table", ', ' ORDER BY table_seq) FROM report) || '. Overall score: '
 || {_kpi("mean_score")} || '/100. Findings: ' || {_kpi("findings_detected")} || '. Duplicates: '
 || {_kpi("duplicates_detected")} || '. Sensitive fields: ' || {_kpi("sensitive_fields")} || '. Risks: '
 || coalesce((SELECT string_agg(risk, '; ' ORDER BY seq) FROM risk WHERE seq <= 4), 'none relevant') || '.' AS facts"""

_groups = " UNION ALL ".join(
    f"""SELECT '{e}' AS entity, {i} AS entity_seq, trim({k}) AS key, string_agg({p}, ', ' ORDER BY fila) AS ids
 FROM {t} WHERE {k} IS NOT NULL AND trim({k}) NOT IN ('', 'nan', 'None') GROUP BY trim({k}) HAVING count(*) > 1"""
    for i, (e, t, k) in enumerate(_entity_keys)
    for p in [COLUMNS[t][0]]
)
_roadmap = " UNION ALL ".join(
    f"SELECT 10, {i}, 0, 0, 0, '{i}. ' || {text(step)}" for i, step in enumerate(RulePack().roadmap, 1)
)
ORACLE["report_lines_by_key"] = f"""WITH {BY_KEY}, summary AS ({ORACLE["summary_by_key"].split(BY_KEY)[1]}),
groups AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY key) AS place FROM ({_groups})),
places AS (SELECT "table", field, suggested_rule, min({{'a': check_seq, 'b': col_ordinal}}) AS spot FROM found
 WHERE suggested_rule <> '' GROUP BY ALL),
numbered AS (SELECT row_number() OVER (ORDER BY part, rank, tie, title) AS seq, * FROM recs),
report_line(section, k0, k1, k2, k3, line) AS (
 SELECT 0, 0, 0, 0, 0, '# Data governance report'
 UNION ALL SELECT 0, 1, 0, 0, 0, 'Overall quality score: ' || {_kpi("mean_score")} || '/100'
 UNION ALL SELECT 1, 0, 0, 0, 0, executive_summary FROM summary
 UNION ALL SELECT 2, table_seq, 0, 0, 0, '- ' || "table" FROM report
 UNION ALL SELECT 3, table_seq, 0, 0, 0, '### ' || "table" FROM report
 UNION ALL SELECT 3, table_seq, 1, 0, 0, '- No relevant findings.' FROM report WHERE n_findings = 0
 UNION ALL SELECT 3, table_seq, 2, check_seq, col_ordinal, '- [' || upper(severity) || '] ' || field || ': ' || problem
  || ' (' || quality_dimension || ') -> ' || suggested_rule FROM found JOIN report USING ("table")
 UNION ALL SELECT 4, table_seq, 0, 0, 0, '| ' || "table" || ' | ' || quality_score || ' | ' || risk_level || ' | ' || rows || ' |'
  FROM report
 UNION ALL SELECT 5, table_seq, 0, 0, 0, '- ' || "table" || ': ' || replace(sensitive_fields, '|', ', ')
  FROM table_profile JOIN report USING ("table") WHERE sensitive_fields <> ''
 UNION ALL SELECT 6, table_seq, spot.a, spot.b, 0, '- ' || "table" || '.' || field || ': ' || suggested_rule
  FROM places JOIN report USING ("table")
 UNION ALL SELECT 7, entity_seq, 0, 0, 0, '### ' || entity || ': ' || duplicates_detected || ' duplicates in ' || n_groups || ' groups'
  FROM dupes
 UNION ALL SELECT 7, entity_seq, 1, place, 0, '- [exact_key, conf=0.98] ' || ids FROM groups WHERE place <= 10
 UNION ALL SELECT 8, seq, 0, 0, 0, '- ' || risk FROM risk
 UNION ALL SELECT 9, seq, 0, 0, 0, '- [' || upper(priority) || '] ' || title || ': ' || suggested_action FROM numbered
 UNION ALL SELECT 9, seq, 1, 0, 0, '  - Risk: ' || risk || ' Responsible: ' || responsible || '. Impact: '
  || expected_impact || ' Effort: ' || estimated_effort FROM numbered
 UNION ALL {_roadmap}
 UNION ALL SELECT 11, seq, 0, 0, 0, '| ' || kpi || ' | ' || value || ' |' FROM kpi)
SELECT CAST(section AS INTEGER) AS section,
 CAST(row_number() OVER (PARTITION BY section ORDER BY k0, k1, k2, k3, line) AS INTEGER) AS seq, line FROM report_line"""

_metrics = [
    ("clientes", "rows", "SELECT count(*) FROM clientes"),
    ("productos", "rows", "SELECT count(*) FROM productos"),
]
for _t, _m, _f, _d in (
    ("clientes", "invalid_dni_records", "dni", "validity"),
    ("clientes", "missing_telefono_records", "telefono", "completeness"),
    ("productos", "negative_price_records", "precio", "validity"),
    ("proveedores", "invalid_ruc_records", "ruc", "validity"),
    ("proveedores", "missing_correo_records", "correo", "completeness"),
    ("ventas", "zero_quantity_records", "cantidad", "validity"),
    ("ventas", "total_mismatch_records", "total", "accuracy"),
):
    _metrics.append(
        (_t, _m, f"""SELECT coalesce(max(affected_count), 0) FROM found WHERE "table" = '{_t}' AND field = '{_f}'
 AND quality_dimension = '{_d}'""")
    )
for _t, _m, _c in (
    ("clientes", "duplicate_dni_records", "dni"), ("productos", "duplicate_sku_records", "sku"),
):
    _metrics.append(
        (_t, _m, f"""SELECT coalesce(sum(n) FILTER (WHERE n > 1), 0) FROM (SELECT count(*) AS n FROM {_t}
 WHERE NOT {missing(_c)} GROUP BY {_c})""")
    )
_detected = " UNION ALL ".join(
    f"""SELECT '{t}' AS "table", '{m}' AS metric, CAST(({s}) AS VARCHAR) AS detected""" for t, m, s in _metrics
)
_sensitive = [c for c in COLUMNS["clientes"] if any(h in c for h, _ in REASONS)]
_expected = ", ".join(
    f"('{t}', '{m}', {text(json.dumps(v, separators=(',', ':')))})"
    for t, ms in EXPECTED.items()
    for m, v in ms.items()
)
CHECKS = f"""WITH {RETAIL_FINDINGS_ROW}, detected AS ({_detected}
 UNION ALL SELECT 'clientes', 'possible_sensitive_fields', {text(json.dumps(_sensitive, separators=(",", ":")))}),
checks AS (SELECT "table", metric, expected, coalesce(detected, '0') AS detected,
 CASE WHEN metric = 'possible_sensitive_fields' THEN true ELSE expected = coalesce(detected, '0') END AS ok,
 NOT starts_with(metric, 'duplicate_') AS hard
 FROM (VALUES {_expected}) AS v("table", metric, expected) LEFT JOIN detected USING ("table", metric))"""
ORACLE["ground_truth_check"] = f"{CHECKS} SELECT * FROM checks"
ORACLE["ground_truth_pass_rate"] = f"""{CHECKS} SELECT "table", count(*) FILTER (WHERE ok) AS passed,
 count(*) AS total, count(*) FILTER (WHERE hard AND NOT ok) AS hard_failures FROM checks GROUP BY "table\""""

# ---------------------------------------------------------------- documents

SPACE = f"[{WHITESPACE}]"


def chunk_ctes(docs: str = "documents") -> str:
    return f"""tidy AS (SELECT doc_id, source, regexp_replace(text, '{SPACE}+\n', '\n', 'g') AS t FROM {docs}),
windows AS (SELECT doc_id, source, s, trim(substr(t, s + 1, 800), '{WHITESPACE}') AS text
 FROM (SELECT *, unnest(generate_series(0, length(t) - 1, 680)) AS s FROM tidy)),
chunks AS (SELECT doc_id, source, text,
 CAST(row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1 AS INTEGER) AS chunk_id FROM windows WHERE text <> '')"""


def term_ctes(name: str, source: str, keys: str, text_col: str = "text") -> str:
    """Bucket counts of a text column and the squared length per row."""
    fold = "CAST('0x' || substr(h, 1, 15) AS BIGINT) % 768"
    for start, digits in ((16, 15), (31, 2)):
        fold = f"(({fold}) * {16**digits % 768} + CAST('0x' || substr(h, {start}, {digits}) AS BIGINT)) % 768"
    return f"""{name}_terms AS (SELECT {keys}, CAST({fold} AS INTEGER) AS bucket, count(*) AS n FROM (
 SELECT {keys}, md5(w) AS h FROM (SELECT {keys}, unnest(string_split_regex(lower({text_col}), '{SPACE}+')) AS w
 FROM {source}) WHERE w <> '') GROUP BY ALL),
{name}_norms AS (SELECT {keys}, CAST(sum(n * n) AS BIGINT) AS norm2 FROM {name}_terms GROUP BY {keys})"""


_keys = "doc_id, chunk_id"
ORACLE["chunks_windows"] = f"""WITH {chunk_ctes()} SELECT doc_id, source, chunk_id,
 CAST(length(text) AS BIGINT) AS n_chars, md5(text) AS text_md5 FROM chunks"""
ORACLE["hash_embedding"] = f"""WITH {chunk_ctes()}, {term_ctes("c", "chunks", _keys)}
SELECT {_keys}, bucket, round(n / sqrt(CAST(norm2 AS DOUBLE)), 9) AS weight FROM c_terms JOIN c_norms USING ({_keys})"""


def top_ctes(questions: str) -> str:
    return f"""q AS ({questions}), {term_ctes("c", "chunks", _keys)}, {term_ctes("q", "q", "question_id", "question")},
dots AS (SELECT question_id, doc_id, chunk_id, CAST(sum(q_terms.n * c_terms.n) AS DOUBLE) AS dot
 FROM q_terms JOIN c_terms USING (bucket) GROUP BY ALL),
scores AS (SELECT question_id, doc_id, chunk_id, dot / sqrt(CAST(q_norms.norm2 * c_norms.norm2 AS DOUBLE)) AS score
 FROM dots JOIN q_norms USING (question_id) JOIN c_norms USING ({_keys})),
vector AS (SELECT question_id, doc_id, chunk_id, score, CAST(row_number() OVER (PARTITION BY question_id
  ORDER BY score DESC, doc_id, chunk_id) AS INTEGER) AS rank
 FROM (SELECT q.question_id, chunks.doc_id, chunks.chunk_id, coalesce(score, 0) AS score FROM q CROSS JOIN chunks
  LEFT JOIN scores USING (question_id, {_keys})) QUALIFY rank <= 6)"""


_QUESTIONS = "SELECT item_id AS question_id, text AS question FROM benchmark"
ORACLE["topk_chunks"] = f"""WITH {chunk_ctes()}, {top_ctes(_QUESTIONS)}
SELECT question_id, {_keys}, round(score, 9) AS score, rank FROM vector"""
ORACLE["topk_vectors"] = """WITH means AS (SELECT label, list(x ORDER BY pos) AS vec FROM (
 SELECT label, pos, avg(CAST(x AS DOUBLE)) AS x FROM (
  SELECT label, unnest(embedding) AS x, unnest(range(len(embedding))) AS pos FROM embeddings) GROUP BY label, pos) GROUP BY label)
SELECT query_id, vec_id, round(score, 6) AS score, rank FROM (
 SELECT means.label AS query_id, vec_id, score, CAST(row_number() OVER (PARTITION BY means.label
  ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM means, LATERAL (
  SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), vec), 9) AS score FROM embeddings) QUALIFY rank <= 6)"""
ORACLE["unit_vectors"] = """SELECT vec_id, CAST(pos AS INTEGER) AS pos, round(x / norm, 9) AS x FROM (
 SELECT vec_id, unnest(CAST(embedding AS DOUBLE[])) AS x, unnest(range(len(embedding))) AS pos,
  sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda v: v * v))) AS norm FROM embeddings)"""
_needles = " OR ".join(f"contains(lower(text), '{n}')" for n in NEEDLES)
ORACLE["keyword_hits"] = f"""WITH {chunk_ctes()} SELECT {_keys}, CAST(1 AS DOUBLE) AS score FROM chunks
WHERE {_needles} ORDER BY {_keys} LIMIT 25"""
ORACLE["adjacent_chunks"] = f"""WITH {chunk_ctes()} SELECT doc_id, chunk_id, CAST(2 AS INTEGER) AS anchor_id,
 CAST(0.9 AS DOUBLE) AS score, md5(text) AS text_md5 FROM chunks JOIN labels USING (doc_id) WHERE chunk_id BETWEEN -1 AND 5"""

CITED = """cited AS (SELECT doc_id, source, CASE doc_id % 3 WHEN 0 THEN 'Artículo ' WHEN 1 THEN 'ARTICULO '
 ELSE 'Art. ' END || (doc_id % 97) || '. ' || text AS text FROM documents)"""
_CITED_Q = """SELECT item_id AS question_id, CASE WHEN item_id % 2 = 0 THEN 'Que dice el artículo ' || (item_id % 97)
 || '? ' || text ELSE text END AS question FROM benchmark"""
_NUMBERS = r"list_distinct(regexp_extract_all(lower(strip_accents(question)), 'art(?:iculo)?s?\.?\s*([0-9]+)', 1))"
_STEMS = "['rtículo ', 'rticulo ', 'RTÍCULO ', 'RTICULO ', 'rt. ', 'rt ']"
ORACLE["article_references"] = f"""SELECT question_id, array_to_string(numbers, '|') AS numbers,
 array_to_string(flatten(list_transform(numbers, lambda n: list_transform({_STEMS}, lambda s: s || n))), '|') AS needles
FROM (SELECT question_id, {_NUMBERS} AS numbers FROM ({_CITED_Q}))"""
HITS = rf"""asked AS (SELECT question_id, unnest({_NUMBERS}) AS number FROM q),
citing AS (SELECT DISTINCT question_id, doc_id, chunk_id FROM asked JOIN chunks ON
 regexp_matches(lower(strip_accents(text)), 'art(?:iculo)?s?\.?\s*' || number || '\b')),
hits AS (SELECT *, CAST(row_number() OVER (PARTITION BY question_id ORDER BY {_keys}) AS INTEGER) AS hit_rank
 FROM citing QUALIFY hit_rank <= 6)"""
ORACLE["reference_hits"] = f"WITH {CITED}, {chunk_ctes('cited')}, q AS ({_CITED_Q}), {HITS} SELECT * FROM hits"
CONTEXT = f"""{CITED}, {chunk_ctes("cited")}, {top_ctes(_CITED_Q)}, {HITS},
both_lists AS (SELECT question_id, {_keys}, CAST(1 AS DOUBLE) AS score, 0 AS part, hit_rank AS rank FROM hits
 UNION ALL SELECT question_id, {_keys}, score, 1, rank FROM vector),
listed AS (SELECT b.*, c.source, c.text, count(*) FILTER (WHERE part = 0) OVER (PARTITION BY question_id) AS n_hits,
 row_number() OVER (PARTITION BY question_id, substr(c.text, 1, 200) ORDER BY part, rank) AS copy
 FROM both_lists AS b JOIN chunks AS c USING ({_keys})),
merged AS (SELECT * EXCLUDE (rank), row_number() OVER (PARTITION BY question_id ORDER BY part, rank) AS rank
 FROM listed WHERE n_hits = 0 OR copy = 1 QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY part, rank) <= 6 + n_hits),
once AS (SELECT * FROM merged QUALIFY row_number() OVER (PARTITION BY question_id, {_keys} ORDER BY rank) = 1),
anchored AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY rank) AS place FROM once),
around AS (SELECT question_id, {_keys}, source, text, score, place, -1 AS turn FROM anchored
 UNION ALL SELECT a.question_id, c.doc_id, c.chunk_id, c.source, c.text, CAST(0.9 AS DOUBLE), a.place, c.chunk_id
 FROM anchored AS a JOIN chunks AS c ON c.doc_id = a.doc_id AND c.chunk_id BETWEEN a.chunk_id - 3 AND a.chunk_id + 3
 WHERE a.place <= 2),
kept AS (SELECT * FROM around QUALIFY row_number() OVER (PARTITION BY question_id, {_keys} ORDER BY place, turn) = 1),
context AS (SELECT *, CAST(row_number() OVER (PARTITION BY question_id ORDER BY place, turn) AS INTEGER) AS pos
 FROM kept QUALIFY pos <= 14)"""
ORACLE["expanded_context"] = f"""WITH {CONTEXT} SELECT question_id, pos, {_keys}, round(score, 9) AS score FROM context"""
ORACLE["formatted_context"] = f"""WITH {CONTEXT} SELECT question_id, CAST(length(t) AS BIGINT) AS n_chars, md5(t) AS context_md5
FROM (SELECT question_id, string_agg('[Fuente: ' || source || ']\n' || text, '\n\n' ORDER BY pos) AS t
 FROM context GROUP BY question_id)"""
_WORDS = r"[\p{L}\p{M}\p{Nd}\p{Pc}]+"
ORACLE["answers"] = rf"""WITH {CONTEXT},
best AS (SELECT question_id, question, text, score FROM context JOIN q USING (question_id) WHERE pos = 1),
split AS (SELECT question_id, question, unnest(parts) AS s, unnest(range(len(parts))) AS i FROM (
 SELECT *, string_split(regexp_replace(text, '([.!?]){SPACE}+', '\1' || chr(1), 'g'), chr(1)) AS parts FROM best)),
ranked AS (SELECT question_id, s, row_number() OVER (PARTITION BY question_id ORDER BY
 len(list_intersect(list_distinct(regexp_extract_all(lower(question), '{_WORDS}')),
  list_distinct(regexp_extract_all(lower(s), '{_WORDS}')))) DESC, i) AS rn FROM split),
snippet AS (SELECT question_id, trim(string_agg(s, ' ' ORDER BY rn), '{WHITESPACE}') AS answer FROM ranked
 WHERE rn <= 2 GROUP BY question_id),
named AS (SELECT question_id, string_agg(source, '|' ORDER BY pos) AS sources FROM (
 SELECT question_id, source, min(pos) AS pos FROM context WHERE source <> '' GROUP BY question_id, source) GROUP BY question_id)
SELECT q.question_id, q.question,
 coalesce(nullif(answer, ''), substr(text, 1, 300), 'No se encontró sustento suficiente en los documentos cargados.') AS answer,
 CASE WHEN answer IS NOT NULL THEN 'Taken directly from the retrieved documents.' ELSE '' END AS rationale,
 coalesce(sources, '') AS sources, CASE WHEN score > 0.15 THEN 'medium' ELSE 'low' END AS confidence,
 answer IS NOT NULL AS grounded, round(score, 9) AS best_score
FROM q LEFT JOIN best USING (question_id) LEFT JOIN snippet USING (question_id) LEFT JOIN named USING (question_id)"""
ORACLE["generated_answers"] = """SELECT conv_id || '-' || turn AS question_id, role AS question,
 CASE role WHEN 'system' THEN 'No se encontró sustento suficiente en los documentos cargados.'
  ELSE 'turn ' || turn END AS answer, '' AS rationale,
 CASE role WHEN 'system' THEN '' ELSE 'manual.md' END AS sources,
 CASE role WHEN 'system' THEN 'medium' ELSE 'high' END AS confidence, role <> 'system' AS grounded
FROM conversations WHERE role <> 'assistant'"""
