"""The rule pack: plain data that drives the operators."""

from __future__ import annotations

from dataclasses import dataclass, field

from .functions.naming import IDENTIFIER_HINTS, QUALITY_HINTS, SENSITIVE_REASONS
from .functions.predicates import DATE_FORMATS, EIGHT_DIGITS, ELEVEN_DIGITS, EMAIL_PATTERN
from .functions.text import COUNTRY_SYNONYMS


@dataclass(frozen=True)
class Relation:
    """Child column that must exist in a parent table, whatever the child table is."""

    column: str
    parent_table: str
    parent_column: str


@dataclass(frozen=True)
class FormatRule:
    columns: tuple[str, ...]
    pattern: str
    severity: str
    code: str
    problem: str
    rule: str


@dataclass(frozen=True)
class ArithmeticRule:
    """``abs(left - right) > tolerance`` is an error; every named column must exist."""

    columns: tuple[str, ...]
    left: str
    right: str
    tolerance: float
    field: str
    problem: str
    rule: str


@dataclass(frozen=True)
class Entity:
    name: str
    id_column: str
    exact_key: str
    name_columns: tuple[str, ...]
    email_column: str | None = None


@dataclass(frozen=True)
class RulePack:
    # Keys, relations and entities of the five-table commercial model.
    primary_keys: dict[str, str] = field(
        default_factory=lambda: {
            "clientes": "cliente_id",
            "productos": "producto_id",
            "proveedores": "proveedor_id",
            "ventas": "venta_id",
            "sucursales": "sucursal_id",
        }
    )
    business_keys: tuple[str, ...] = ("dni", "ruc", "sku")
    relations: tuple[Relation, ...] = (
        Relation("cliente_id", "clientes", "cliente_id"),
        Relation("producto_id", "productos", "producto_id"),
        Relation("proveedor_id", "proveedores", "proveedor_id"),
        Relation("sucursal_id", "sucursales", "sucursal_id"),
    )
    entities: tuple[Entity, ...] = (
        Entity("cliente", "cliente_id", "dni", ("nombre", "apellido"), "correo"),
        Entity("producto", "producto_id", "sku", ("nombre_producto",)),
        Entity("proveedor", "proveedor_id", "ruc", ("razon_social",), "correo"),
        Entity("sucursal", "sucursal_id", "sucursal_id", ("nombre_sucursal",)),
    )
    similarity_threshold: int = 88

    # Checks.
    formats: tuple[FormatRule, ...] = (
        FormatRule(
            ("correo", "email"), EMAIL_PATTERN, "medium", "email_format",
            "e-mails with an invalid format", "Validate the e-mail format",
        ),
        FormatRule(
            ("dni",), EIGHT_DIGITS, "high", "dni_format",
            "DNI without exactly 8 digits", "DNI must have 8 digits",
        ),
        FormatRule(
            ("ruc",), ELEVEN_DIGITS, "high", "ruc_format",
            "RUC without exactly 11 digits", "RUC must have 11 digits",
        ),
    )
    non_negative_hints: tuple[str, ...] = ("precio", "total", "monto")
    non_zero_columns: tuple[str, ...] = ("cantidad",)
    date_hints: tuple[str, ...] = ("fecha",)
    date_formats: tuple[str, ...] = DATE_FORMATS
    country_columns: tuple[str, ...] = ("pais",)
    category_columns: tuple[str, ...] = (
        "moneda",
        "categoria",
        "estado",
        "segmento",
        "canal",
        "estado_cliente",
        "estado_producto",
    )
    country_synonyms: dict[str, str] = field(default_factory=lambda: dict(COUNTRY_SYNONYMS))
    arithmetic: tuple[ArithmeticRule, ...] = (
        ArithmeticRule(
            ("cantidad", "precio_unitario", "total"),
            "try_cast(cantidad AS DOUBLE) * try_cast(precio_unitario AS DOUBLE)",
            "try_cast(total AS DOUBLE)",
            0.01, "total",
            "totals that differ from cantidad x precio_unitario",
            "total = cantidad * precio_unitario",
        ),
    )

    # Name hints.
    quality_hints: tuple[str, ...] = QUALITY_HINTS
    identifier_hints: tuple[str, ...] = IDENTIFIER_HINTS
    sensitive_reasons: dict[str, str] = field(default_factory=lambda: dict(SENSITIVE_REASONS))
    high_cardinality_ratio: float = 0.9

    # Penalty of one finding and cap of the sum, by dimension.
    penalties: dict[str, int] = field(
        default_factory=lambda: {
            "completeness_high": 10,
            "completeness": 2,
            "uniqueness": 18,
            "validity": 7,
            "referential_integrity": 18,
            "consistency": 5,
            "conformity": 6,
            "classification": 8,
        }
    )
    default_penalty: int = 8
    caps: dict[str, int] = field(
        default_factory=lambda: {
            "completeness": 16,
            "uniqueness": 18,
            "validity": 14,
            "referential_integrity": 18,
            "consistency": 5,
            "conformity": 6,
            "classification": 8,
        }
    )
    low_risk_score: int = 80
    medium_risk_score: int = 65

    # Catalog.
    definitions: dict[str, str] = field(
        default_factory=lambda: {
            "cliente_id": "Identificador único del cliente",
            "producto_id": "Identificador único del producto",
            "proveedor_id": "Identificador único del proveedor",
            "venta_id": "Identificador único de la venta",
            "dni": "Documento Nacional de Identidad del cliente",
            "ruc": "Registro Único de Contribuyentes",
            "sku": "Código único de inventario del producto (Stock Keeping Unit)",
            "correo": "Correo electrónico de contacto",
            "telefono": "Número telefónico de contacto",
            "direccion": "Dirección física",
            "nombre": "Nombre de la persona",
            "apellido": "Apellido de la persona",
            "razon_social": "Razón social del proveedor",
            "precio": "Precio del producto",
            "total": "Importe total de la venta",
            "fecha_registro": "Fecha de registro del cliente",
            "fecha_venta": "Fecha en que se realizó la venta",
        }
    )
    ownership: dict[str, tuple[str, str]] = field(
        default_factory=lambda: {
            "clientes": ("Gerencia Comercial", "Analista de Clientes"),
            "productos": ("Gerencia de Producto", "Analista de Catálogo"),
            "ventas": ("Gerencia Comercial", "Analista de Ventas"),
            "proveedores": ("Gerencia de Compras", "Analista de Proveedores"),
        }
    )
    default_owner: tuple[str, str] = ("Gobierno de Datos", "Data Steward asignado")
    daily_tables: tuple[str, ...] = ("ventas",)
    roadmap: tuple[str, ...] = (
        "Formalise the data catalog and assign data owners and stewards.",
        "Apply automated quality rules at ingestion.",
        "Consolidate master entities with golden records.",
        "Publish a quality score by domain.",
        "Define a classification policy and controls for personal data.",
        "Plan the modernisation of the data warehouse.",
    )

    # Document retrieval.
    chunk_size: int = 800
    chunk_overlap: int = 120
    top_k: int = 6
    embedding_dim: int = 768

    def primary_key(self, table: str) -> str | None:
        """known key, else the singular of the table name plus ``_id``."""
        name = table.lower()
        if name in self.primary_keys:
            return self.primary_keys[name]
        for ending in ("es", "s"):
            if name.endswith(ending):
                return name.removesuffix(ending) + "_id"
        return None

    def unique_keys(self, table: str, columns: list[str]) -> list[str]:
        """primary key, then business keys, as far as the table has them; never foreign keys."""
        present = {c.lower(): c for c in columns}
        wanted = [(self.primary_key(table) or "").lower(), *self.business_keys]
        return [present[k] for k in dict.fromkeys(wanted) if k in present]

    def entity_of(self, table: str) -> Entity | None:
        """Entity whose name starts the table name."""
        return next((e for e in self.entities if table.lower().startswith(e.name)), None)

    def entity(self, name: str) -> Entity | None:
        return next((e for e in self.entities if e.name == name), None)


def rules_table(spark, pack: RulePack, tables: dict):
    """F17 as rows: which key and relation rules apply to which table."""
    rows = []
    for table, df in tables.items():
        present = {c.lower(): c for c in df.columns}
        rows += [(table, k, "unique", None, None) for k in pack.unique_keys(table, df.columns)]
        rows += [
            (table, present[r.column], "reference", r.parent_table, r.parent_column)
            for r in pack.relations
            if r.column in present and r.parent_table != table
        ]
    return spark.createDataFrame(
        rows, "table string, field string, rule_kind string, parent_table string, parent_column string"
    )
