"""Text normalisation and the missing-value predicate."""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that Unicode-aware trimming and splitting treat as white space.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
WS_CLASS = (
    r"\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
WS = f"[{WS_CLASS}]"

# Country spellings after normalisation and their standard form.
COUNTRY_SYNONYMS = {
    "peru": "Peru",
    "pe": "Peru",
    "per": "Peru",
    "chile": "Chile",
    "cl": "Chile",
    "colombia": "Colombia",
    "co": "Colombia",
    "ecuador": "Ecuador",
    "ec": "Ecuador",
    "bolivia": "Bolivia",
    "bo": "Bolivia",
    "argentina": "Argentina",
    "ar": "Argentina",
    "mexico": "Mexico",
    "mx": "Mexico",
}


def strip(col: Column) -> Column:
    """Trim every white-space character; Spark's ``trim`` knows only the plain space."""
    return F.btrim(col, F.lit(WHITESPACE))


@lru_cache(maxsize=1)
def _accent_tables() -> tuple[str, str, str, dict[str, str]]:
    """One-to-one letters, combining marks, and all other letters that change, generated from the Unicode data."""
    source, target, marks, other = [], [], [], {}
    for code in range(0x80, sys.maxunicode + 1):
        if 0xD800 <= code <= 0xDFFF or HANGUL[0] <= chr(code) <= HANGUL[1]:
            continue
        char = chr(code)
        if unicodedata.combining(char):
            if code <= 0xFFFF:
                marks.append(char)
            else:
                other[char] = ""
            continue
        plain = "".join(
            c for c in unicodedata.normalize("NFKD", char) if not unicodedata.combining(c)
        )
        if plain == char:
            continue
        if len(plain) == 1 and code <= 0xFFFF and ord(plain) <= 0xFFFF:
            source.append(char)
            target.append(plain)
        else:
            other[char] = plain
    return "".join(source), "".join(target), "".join(marks), other


# The Korean syllables, and the first of their leading, middle and closing letters with their numbers.
HANGUL = ("\uac00", "\ud7a3")
LEAD, VOWEL, TAIL = 0x1100, 0x1161, 0x11A7
VOWELS, TAILS = 21, 28


def _hangul(char: Column) -> Column:
    """The letters of a Korean syllable."""
    at = F.ascii(char) - ord(HANGUL[0])

    def letter(code: Column) -> Column:
        return F.lpad(F.hex(code), 4, "0")

    tail = at % TAILS
    codes = F.concat(
        letter(F.floor(at / (VOWELS * TAILS)) + LEAD),
        letter(F.floor(at / TAILS).cast("long") % VOWELS + VOWEL),
        F.when(tail > 0, letter(tail + TAIL)).otherwise(""),
    )
    return F.decode(F.unhex(codes), "UTF-16BE")


def strip_accents(col: Column) -> Column:
    """full compatibility decomposition without the combining marks, by built-in functions.

    Only the distinct letters outside ASCII of a text are looked up, and only those that change are replaced in it. What they
    become doesn't change again, so their order doesn't matter.
    """
    source, target, marks, other = _accent_tables()
    text = F.coalesce(col, F.lit(""))
    expanding = F.create_map(*[F.lit(x) for item in other.items() for x in item])
    letters = F.array_distinct(F.regexp_extract_all(text, F.lit(r"[^\x00-\x7f]"), F.lit(0)))

    def plain(c: Column) -> Column:
        listed = F.instr(F.lit("".join(other)), c) > 0
        return (
            F.when(c.between(*HANGUL), _hangul(c))
            .when(listed, F.try_element_at(expanding, c))
            .otherwise(F.translate(c, source + marks, target))
        )

    pairs = F.transform(letters, lambda c: F.struct(c.alias("old"), plain(c).alias("new")))
    changing = F.filter(pairs, lambda p: p["old"] != p["new"])
    out = F.aggregate(changing, text, lambda out, p: F.replace(out, p["old"], p["new"]))
    return F.when(has_non_ascii(col), out).otherwise(text)


def has_non_ascii(col: Column) -> Column:
    return F.octet_length(col) != F.char_length(col)


def normalize_text(col: Column) -> Column:
    """no accents, lower case, everything but letters and digits to single spaces."""
    return F.trim(F.regexp_replace(F.lower(strip_accents(col)), "[^a-z0-9]+", " "))


def normalize_email(col: Column) -> Column:
    """F3."""
    return F.coalesce(F.lower(strip(col)), F.lit(""))


def normalize_country(col: Column, synonyms: dict[str, str] | None = None) -> Column:
    """standard country name, or the trimmed input when the spelling is unknown."""
    synonyms = COUNTRY_SYNONYMS if synonyms is None else synonyms
    pairs = [F.lit(x) for item in synonyms.items() for x in item]
    known = F.element_at(F.create_map(*pairs), normalize_text(col))
    return F.coalesce(known, strip(col), F.lit(""))


def is_missing(col: Column) -> Column:
    """null, blank after trimming, or the word ``nan`` in any case."""
    return F.coalesce(F.lower(strip(col.cast("string"))).isin("", "nan"), F.lit(True))


def missing_sql(name: str, kind: str = "string") -> str:
    """F6 as SQL text for a column; one parser call instead of one call per function.

    Numbers and dates need no text, and of a long text only four characters are lower-cased.
    """
    if kind in ("float", "double"):
        return f"(`{name}` IS NULL OR isnan(`{name}`))"
    if kind in ("tinyint", "smallint", "int", "bigint", "boolean", "date", "timestamp"):
        return f"(`{name}` IS NULL)"
    text = f"btrim(cast(`{name}` AS STRING), '{WHITESPACE}')"
    return f"coalesce(lower(left({text}, 4)) IN ('', 'nan'), true)"


def sql_text(value: str) -> str:
    """String literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
