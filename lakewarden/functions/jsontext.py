"""JSON out of noisy text."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .text import strip


def first_value(text: str | None) -> str | None:
    """Text of the first object that can be read from one of its opening brackets on, else of the first list.

    The reader itself finds the end, so brackets inside strings don't count.
    """
    decoder = json.JSONDecoder()
    for bracket in "{[":
        places = (m.start() for m in re.finditer(re.escape(bracket), text or ""))
        for at in places:
            try:
                _, end = decoder.raw_decode(text, at)
            except (ValueError, RecursionError):
                continue
            return text[at:end]
    return None


@F.pandas_udf(StringType())
def _first_values(texts: pd.Series) -> pd.Series:
    return texts.map(first_value, na_action="ignore")


def extract_json(col: Column) -> Column:
    """JSON text inside ``col`` or null.

    A code fence is removed first. Text that parses as a whole never leaves the JVM; only the rest
    reaches the reader.
    """
    text = strip(col)
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)```", 1)
    has_fence = text.rlike(r"(?s)```.*?```")
    body = F.when(has_fence, strip(fenced)).otherwise(text)
    whole = F.try_parse_json(body).isNotNull() & (body != "")
    return F.when(whole, body).otherwise(_first_values(F.when(~whole, body)))
