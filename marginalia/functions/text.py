"""Text functions that Spark's own don't match: strip, prompt templates, JSON as the report needs it, money."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from marginalia.functions.coercion import compact

#: White space, as Python's str.strip() sees it.
_SPACES = "".join(c for c in map(chr, range(0x10000)) if c.isspace())


def strip(x: Column) -> Column:
    return F.trim(x, F.lit(_SPACES))


def render(template: str, **values: Column) -> Column:
    """The template with {name} replaced by the values' text, stripped as a whole. A null value reads None.

    A template that begins and ends with words of its own is stripped before it is filled.
    """
    parts, ends = [], []
    for part in re.split(r"(\{\w+\})", template.strip()):
        name = part[1:-1]
        if part.startswith("{") and name in values:
            parts.append(F.coalesce(values[name].cast("string"), F.lit("None")))
            ends.append(True)
        elif part:
            parts.append(F.lit(part))
            ends.append(False)
    filled = F.concat(*parts)
    if ends[0]:
        filled = F.ltrim(filled, F.lit(_SPACES))
    return F.rtrim(filled, F.lit(_SPACES)) if ends[-1] else filled


def compact_json(*columns: Column) -> Column:
    """An object of the columns in order, without spaces; nulls are kept."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def spaced(text: str | None) -> str | None:
    """JSON text again with ", " and ": " and ASCII escapes."""
    return None if text is None else json.dumps(json.loads(text))


def spaced_json(text: Column) -> Column:
    """Compact JSON -> the spaced, ASCII form; no built-in function writes it. For the JSON of a row, not of lists of rows."""

    @F.pandas_udf("string")
    def written(texts: pd.Series) -> pd.Series:
        return texts.map(spaced)

    return written(text)


def spaced_values(text: Column) -> Column:
    """The values of a JSON object in their order, each in the spaced, ASCII form: of these a row's objects are put together."""

    @F.pandas_udf("array<string>")
    def written(texts: pd.Series) -> pd.Series:
        return pd.Series([[json.dumps(v) for v in json.loads(t).values()] for t in texts], dtype=object)

    return written(text)


def extended(record: Column, more: Column) -> Column:
    """A JSON object with the members of another one, compact: a name that is there keeps its place and gets the new value.

    No built-in function merges objects whose names aren't known before.
    """

    @F.pandas_udf("string")
    def merged(records: pd.Series, others: pd.Series) -> pd.Series:
        pairs = ((json.loads(a), json.loads(b)) for a, b in zip(records, others))
        return pd.Series([compact({**a, **b}) for a, b in pairs], dtype=object)

    return merged(record, more)


def money(x: Column) -> Column:
    """Dollars with four decimals, or n/a."""
    return F.coalesce(F.concat(F.lit("$"), F.regexp_replace(F.format_number(x, 4), ",", "")), F.lit("n/a"))
