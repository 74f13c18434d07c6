"""JSON, array and map expressions."""

from __future__ import annotations

import json
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import MapType, StringType


def greedy_json(text: Column) -> Column:
    """A text as a variant, else its span from the first ``{`` to the last ``}``."""
    return F.coalesce(F.try_parse_json(text), F.try_parse_json(F.regexp_extract(text, r"(?s)\{.*\}", 0)))


def first_object(text: str | None) -> object:
    """The JSON value of a text, else the first object in it that can be read; else None."""
    if text is None:
        return None
    try:
        return json.loads(text)
    except ValueError:
        pass
    reader, at = json.JSONDecoder(), text.find("{")
    while at >= 0:
        try:
            return reader.raw_decode(text, at)[0]
        except ValueError:
            at = text.find("{", at + 1)
    return None


def flat(value: dict, prefix: str = "") -> dict[str, str]:
    """Nested objects under dotted keys; lists joined by semicolons, single items unwrapped."""
    out: dict[str, str] = {}
    for key, item in value.items():
        if isinstance(item, list) and len(item) == 1:
            item = item[0]
        if isinstance(item, dict):
            out |= flat(item, f"{prefix}{key}.")
        elif isinstance(item, list):
            out[f"{prefix}{key}"] = "; ".join(_text(x) for x in item)
        elif item is not None:
            out[f"{prefix}{key}"] = _text(item)
    return out


def _text(value: object) -> str:
    return value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


@pandas_udf(MapType(StringType(), StringType()))
def response_fields(text: pd.Series) -> pd.Series:
    """The first JSON object of a text as flat fields (N1, N2); null if there is none."""
    found = (first_object(t) for t in text)
    found = (x[0] if isinstance(x, list) and len(x) == 1 else x for x in found)
    return pd.Series([flat(x) if isinstance(x, dict) else None for x in found], dtype=object)


def response_text(response: Column) -> Column:
    """The text parts of a model response's first candidate, joined."""
    parts = F.get(response["candidates"], 0)["content"]["parts"]
    return F.array_join(F.transform(parts, lambda p: p["text"]), "")


def field(fields: Column, name: str, default: str = "") -> Column:
    """A field of a map, or a default."""
    return F.coalesce(F.try_element_at(fields, F.lit(name)), F.lit(default))


def observed_keys(df: DataFrame, fields: str) -> list[str]:
    """All keys of a map column, sorted (N8). A row per different key reaches the driver."""
    return [r[0] for r in df.select(F.explode(F.map_keys(fields)).alias("k")).distinct().orderBy("k").collect()]


def ordered_fields(wanted: Sequence[str], seen: Sequence[str]) -> list[str]:
    """Configured fields first, then the others that were seen, sorted."""
    return [*wanted, *sorted(set(seen) - set(wanted))]
