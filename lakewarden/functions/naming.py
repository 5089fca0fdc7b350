"""Rules that look only at column names. They run on the driver over the schema or as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Name hints of personal or sensitive data with the reason, first match wins.
SENSITIVE_REASONS = {
    "dni": "identity document",
    "ruc": "tax identifier",
    "correo": "e-mail address",
    "email": "e-mail address",
    "mail": "e-mail address",
    "telefono": "telephone number",
    "phone": "telephone number",
    "celular": "telephone number",
    "direccion": "postal address",
    "address": "postal address",
    "nombre": "person name",
    "apellido": "person name",
    "tarjeta": "financial data",
    "cuenta": "financial data",
    "pasaporte": "identity document",
}
# Name hints of the quality checks, and of identifiers.
QUALITY_HINTS = ("dni", "ruc", "correo", "email", "telefono", "direccion", "nombre", "apellido")
IDENTIFIER_HINTS = ("_id", "id_", "dni", "ruc", "sku", "codigo", "code")
FINANCIAL_HINTS = ("precio", "total", "monto")

# Dictionary vocabulary to catalog classification.
CLASSIFICATIONS = {
    "personal": "personal data",
    "sensible": "sensitive data",
    "interno": "master data",
    "financiero": "financial data",
    "operativo": "operational data",
    "publico": "operational data",
    "público": "operational data",
}
CRITICAL_FLAGS = ("sí", "si", "true", "1", "x")


def _any_hint(name: Column, hints: tuple[str, ...]) -> Column:
    return F.exists(F.array(*[F.lit(h) for h in hints]), lambda h: F.contains(name, h))


def is_critical(name: Column, hints: tuple[str, ...] = QUALITY_HINTS) -> Column:
    """F10."""
    low = F.lower(name)
    return _any_hint(low, hints) | low.endswith("_id") | (low == "sku")


def sensitive_reason(name: Column, reasons: dict[str, str] | None = None) -> Column:
    """reason of the first hint that the name contains, else null."""
    reasons = SENSITIVE_REASONS if reasons is None else reasons
    low = F.lower(name)
    return F.coalesce(*[F.when(F.contains(low, F.lit(h)), F.lit(r)) for h, r in reasons.items()])


def looks_like_identifier(
    name: Column, unique_ratio: Column, hints: tuple[str, ...] = IDENTIFIER_HINTS
) -> Column:
    """F12."""
    low = F.lower(name)
    by_name = (low == "id") | low.endswith("_id") | low.startswith("id_")
    return by_name | (_any_hint(low, hints) & (unique_ratio > 0.5)) | (unique_ratio >= 0.98)


def classify(name: Column) -> Column:
    """struct of classification and criticality."""
    low = F.lower(name)

    def label(kind: str, level: str) -> Column:
        return F.struct(F.lit(kind).alias("classification"), F.lit(level).alias("criticality"))

    return (
        F.when(_any_hint(low, QUALITY_HINTS), label("personal data", "high"))
        .when(low.endswith("_id") | (low == "sku"), label("master data", "high"))
        .when(_any_hint(low, FINANCIAL_HINTS), label("financial data", "medium"))
        .otherwise(label("operational data", "medium"))
    )


def default_rules(name: Column) -> Column:
    """F14."""
    low = F.lower(name)

    def rules(*items: str) -> Column:
        return F.array(*[F.lit(i) for i in items])

    return (
        F.when(low == "dni", rules("mandatory", "8 digits", "unique"))
        .when(low == "ruc", rules("mandatory", "11 digits", "unique"))
        .when(F.contains(low, F.lit("correo")) | F.contains(low, F.lit("email")), rules("valid e-mail format"))
        .when(low.endswith("_id") | (low == "sku"), rules("mandatory", "unique"))
        .otherwise(rules("mandatory"))
    )


def dictionary_classification(raw: Column) -> Column:
    """known word to the catalog vocabulary, unknown word kept, blank to operational."""
    from .text import strip

    text = strip(F.coalesce(raw, F.lit("")))
    pairs = [F.lit(x) for item in CLASSIFICATIONS.items() for x in item]
    return F.coalesce(
        F.element_at(F.create_map(*pairs), F.lower(text)),
        F.nullif(text, F.lit("")),
        F.lit("operational data"),
    )


def criticality_from_flag(raw: Column) -> Column:
    """F16."""
    from .text import strip

    flag = F.lower(strip(F.coalesce(raw.cast("string"), F.lit(""))))
    return F.when(flag.isin(*CRITICAL_FLAGS), F.lit("high")).otherwise(F.lit("medium"))
