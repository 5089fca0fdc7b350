"""Personal data in texts: patterns propose spans, checks confirm them, nearby words adjust the score.

Only built-in functions run. A pattern cuts the text into matches and the gaps between them, so that positions are
running sums of code points; the gap before a match holds the words near it. The patterns are written so that each
takes one pass over a text of any length.

Defined results: a null text counts as empty and has no spans. Positions count code points, the end is exclusive.
Spans of one kind never overlap; spans of different kinds may. A null id is kept as it is, repeated rows give repeated
results.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The kinds in the order of the result. The first four are the base.
KINDS = ["email", "ip", "card", "phone", "iban", "card_short"]
BASE = KINDS[:4]

#: Patterns that propose. A possessive repeat and a start at the border of a run keep them linear; the matches are those
#: of the plain greedy form, leftmost and without overlap.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "digits": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?",
}
#: What a text must hold before its pattern is tried.
NEEDED = {"email": "@", "ip": ".", "phone": "+"}

#: Words that raise the score of a span if they stand within ``NEAR`` code points before it.
CONTEXT = {
    "email": "mail|contact|write|kontakt|correo|courriel",
    "ip": "ip|host|server|address|adresse",
    "card": "card|visa|credit|karte|tarjeta|carte",
    "phone": "phone|tel|call|fax|mobile|handy",
    "iban": "iban|account|bank|konto|cuenta|compte",
    "card_short": "card|visa|credit|karte|tarjeta|carte",
}
NEAR = 40
#: Parts of the score, and the least score of a span that isn't of the base.
PROPOSED, CONFIRMED, NEARBY = 0.4, 0.4, 0.2
LEAST = {"iban": 0.8, "card_short": 1.0}


def digits_of(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the digits pass the check that doubles every second one from the right."""
    back = F.reverse(digits)

    def part(i: Column) -> Column:
        digit = back.substr(i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return digit - F.when(digit > 9, 9).otherwise(0)

    places = F.sequence(F.lit(1), F.length(digits))
    return F.aggregate(places, F.lit(0), lambda total, i: total + part(i)) % 10 == 0


def mod97(match: Column) -> Column:
    """Whether the letters and digits, the first four moved to the end, leave 1 on division by 97."""
    plain = F.regexp_replace(match, " ", "")
    turned = F.concat(plain.substr(F.lit(5), F.length(plain)), plain.substr(1, 4))

    def step(rest: Column, i: Column) -> Column:
        code = F.ascii(turned.substr(i, F.lit(1)))
        return F.when(code >= 65, rest * 100 + code - 55).otherwise(rest * 10 + code - 48) % 97

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), step) == 1


def confirmed(kind: str, match: Column) -> Column:
    n = F.length(digits_of(match))
    if kind == "ip":
        return F.forall(F.split(match, r"\."), lambda p: F.ltrim(p, F.lit("0")).rlike("^([0-9]{0,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        return n.between(16, 19) & luhn(digits_of(match))
    if kind == "card_short":
        return n.between(13, 15) & luhn(digits_of(match))
    if kind == "phone":
        return n.between(8, 15)
    if kind == "iban":
        return F.length(F.regexp_replace(match, " ", "")).between(15, 34) & mod97(match)
    return F.lit(True)


#: Cheap tests that spare most numbers of a text the later ones.
LIKELY: dict[str, Callable[[Column], Column]] = {
    "email": lambda m: F.lit(True),
    "ip": lambda m: confirmed("ip", m),
    "digits": lambda m: F.length(m) >= 13,
    "phone": lambda m: confirmed("phone", m),
    "iban": lambda m: confirmed("iban", m),
}


def _placed(matches: Column, gaps: Column, wanted: Callable[[Column], Column]) -> Column:
    """Each wanted match with its start, the text right before it and the letter after it."""

    def step(state: Column, i: Column) -> Column:
        match = F.get(matches, i)
        start = state["at"] + F.length(F.get(gaps, i))
        found = F.struct(
            start.alias("start"), (start + F.length(match)).alias("end"), match.alias("match"),
            F.right(F.get(gaps, i), F.lit(NEAR)).alias("before"), F.left(F.get(gaps, i + 1), F.lit(1)).alias("after"),
        )
        out = F.when(wanted(match), F.concat(state["out"], F.array(found))).otherwise(state["out"])
        return F.struct((start + F.length(match)).alias("at"), out.alias("out"))

    kind = "array<struct<start:int,end:int,match:string,before:string,after:string>>"
    begin = F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("out"))
    places = F.sequence(F.lit(0), F.size(matches) - 1)
    return F.when(F.size(matches) > 0, F.aggregate(places, begin, step, lambda s: s["out"])).otherwise(F.array().cast(kind))


def _spans(kind: str, placed: Column) -> Column:
    """The confirmed matches of a kind as spans with their scores."""

    def wanted(x: Column) -> Column:
        sure = confirmed(kind, x["match"])
        if kind == "iban":  # a code inside a longer word is none
            sure &= ~x["before"].rlike("[A-Za-z0-9]$") & ~x["after"].rlike("^[A-Za-z0-9]")
        return sure

    def span(x: Column) -> Column:
        near = F.lower(x["before"]).rlike(CONTEXT[kind])
        value = F.round(F.lit(PROPOSED + CONFIRMED) + F.when(near, NEARBY).otherwise(0.0), 2)
        return F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), value.alias("score"))

    spans = F.transform(F.filter(placed, wanted), span)
    return F.filter(spans, lambda s: s["score"] >= LEAST[kind]) if kind in LEAST else spans


def find(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The columns ``keep`` with ``found``: an array of kind, start, end and score for each whole text."""
    keep = [c for c in keep if c != "found"]
    rows = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("__text"))
    body = F.col("__text")
    none = F.array().cast("array<string>")
    for name, pattern in PATTERNS.items():
        tried = F.regexp_extract_all(body, F.lit(pattern), F.lit(0))
        if name in NEEDED:
            tried = F.when(F.contains(body, F.lit(NEEDED[name])), tried).otherwise(none)
        rows = rows.withColumn(f"__{name}", tried)
    for name, pattern in PATTERNS.items():
        cut = F.when(F.size(f"__{name}") > 0, F.split(body, pattern, -1))
        rows = rows.withColumn(f"__{name}_gaps", cut)
    for name in PATTERNS:
        placed = _placed(F.col(f"__{name}"), F.col(f"__{name}_gaps"), LIKELY[name])
        rows = rows.withColumn(f"__{name}", placed)
    parts = [_spans(kind, F.col("__digits" if kind.startswith("card") else f"__{kind}")) for kind in KINDS]
    return rows.select(*keep, F.concat(*parts).alias("found"))


def number(found: Column, kind: str) -> Column:
    return F.size(F.filter(found, lambda s: s["kind"] == kind)).cast("long")


def joined(found: Column) -> Column:
    """``kind:start:end`` of each span, joined by a comma."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

