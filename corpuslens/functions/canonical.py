"""Canonical JSON (RFC 8785) of objects of any shape. Objects of fixed shape have theirs as Column expressions, in `ident`."""

from __future__ import annotations

import json
import math
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: The escapes that canonical JSON has; other control characters are written as \\u00xx.
ESCAPES = {'"': '\\"', "\\": "\\\\", "\b": "\\b", "\t": "\\t", "\n": "\\n", "\f": "\\f", "\r": "\\r"}
_CODES = str.maketrans({chr(c): f"\\u{c:04x}" for c in range(32)} | ESCAPES)


def number_text(x: float) -> str:
    """A double's shortest digits as browsers write them: plain from 1e-6 to below 1e21, else with an exponent."""
    if not math.isfinite(x):
        raise ValueError(x)
    if x == 0:
        return "0"
    sign, digits, exponent = Decimal(repr(x)).normalize().as_tuple()
    text, point = "".join(map(str, digits)), len(digits) + exponent
    if len(text) <= point <= 21:
        body = text.ljust(point, "0")
    elif 0 < point <= 21:
        body = f"{text[:point]}.{text[point:]}"
    elif -6 < point <= 0:
        body = f"0.{'0' * -point}{text}"
    else:
        power = point - 1
        body = f"{text[0]}{'.' * (len(text) > 1)}{text[1:]}e{'+' if power > 0 else '-'}{abs(power)}"
    return "-" * sign + body


def canonical(value: object) -> str:
    """A parsed value's canonical text: keys in the order of their UTF-16 units, no white space."""
    if value is None or isinstance(value, bool):
        return {None: "null", True: "true", False: "false"}[value]
    if isinstance(value, (int, float)):
        return number_text(float(value))
    if isinstance(value, str):
        return f'"{value.translate(_CODES)}"'
    if isinstance(value, list):
        return f"[{','.join(map(canonical, value))}]"
    keys = sorted(value, key=lambda k: k.encode("utf-16-be", "surrogatepass"))
    return "{" + ",".join(f"{canonical(k)}:{canonical(value[k])}" for k in keys) + "}"


def _refused(token: str) -> None:
    raise ValueError(token)


@F.pandas_udf(StringType())
def canonical_json(s: pd.Series) -> pd.Series:
    """JSON text in its canonical form; null for what isn't JSON, holds a number beyond doubles, or a text that has no UTF-8."""

    def one(x: str | None) -> str | None:
        try:
            out = None if x is None else canonical(json.loads(x, parse_constant=_refused))
            return out if out is None or out.encode() is not None else None
        except (ValueError, OverflowError, RecursionError):
            return None

    return s.map(one)


def canonical_digest(text: Column) -> Column:
    """sha256: and the hash of a JSON text's canonical form; null where it has none."""
    return F.concat(F.lit("sha256:"), F.sha2(canonical_json(text).cast("binary"), 256))


def schema_hash(files: DataFrame) -> DataFrame:
    """(schema_hash) of the files (name, sha256) of a format's schemas and vocabulary: one hash for all of them, a few by definition."""
    listed = F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "sha256"))))
    return files.agg(canonical_digest(F.to_json(listed)).alias("schema_hash"))
