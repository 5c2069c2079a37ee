"""Canonical JSON: members in UTF-16 order of their names, ECMAScript numbers, shortest escapes. Used to order records."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType

_SHORT = {8: "\\b", 9: "\\t", 10: "\\n", 12: "\\f", 13: "\\r", 34: '\\"', 92: "\\\\"}


def string(text: str) -> str:
    return '"' + "".join(_SHORT.get(ord(c)) or (f"\\u{ord(c):04x}" if ord(c) < 32 else c) for c in text) + '"'


def number(x: float | int) -> str:
    """As ECMAScript prints it: plain digits from 1e-6 up to 1e21, an exponent without padding beyond."""
    if isinstance(x, int) and not isinstance(x, bool) and abs(x) <= 1 << 53:
        return str(x)
    x = float(x)
    if not math.isfinite(x):
        raise ValueError("a number is not finite")
    if x == 0:
        return "0"
    shortest = repr(abs(x))
    mantissa, _, e = shortest.partition("e")
    whole, _, part = mantissa.partition(".")
    raw = (whole + part).lstrip("0")
    point = len(whole) + int(e or 0) if whole.strip("0") else int(e or 0) - (len(part) - len(part.lstrip("0")))
    raw = raw.rstrip("0") or "0"
    n, k = point, len(raw)
    if k <= n <= 21:
        body = raw + "0" * (n - k)
    elif 0 < n <= 21:
        body = raw[:n] + "." + raw[n:]
    elif -6 < n <= 0:
        body = "0." + "0" * -n + raw
    else:
        body = raw[0] + ("." + raw[1:] if k > 1 else "") + f"e{'+' if n > 0 else '-'}{abs(n - 1)}"
    return ("-" if x < 0 else "") + body


def dumps(value: object) -> str:
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, str):
        return string(value)
    if isinstance(value, int | float):
        return number(value)
    if isinstance(value, dict):
        members = sorted(value.items(), key=lambda kv: kv[0].encode("utf-16-be"))
        return "{" + ",".join(f"{string(k)}:{dumps(v)}" for k, v in members) + "}"
    return "[" + ",".join(map(dumps, value)) + "]"


def canonical(text: Column) -> Column:
    """Canonical form of a JSON text; null stays null."""
    import json

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else dumps(json.loads(t)))

    return F.pandas_udf(run, StringType())(text)
