"""Redaction of metadata keys at any depth."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lodestar.functions import variants as V


def _matches(key: str, exact: set[str], prefixes: tuple[str, ...]) -> bool:
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in key)
    return low in exact or low.startswith(prefixes)


#: A JSON token with the white space before it: a string, a sign, or a number or word.
TOKEN = re.compile(
    r"""[ \t\n\r]*+(?:("(?:[^"\\\x00-\x1f]++|\\(?:["\\/bfnrt]|u[0-9A-Fa-f]{4}))*+")|([{}\[\],:])|(-?(?:0|[1-9][0-9]*+)(?:\.[0-9]++)?(?:[eE][+-]?[0-9]++)?|true|false|null))"""
)
END = re.compile(r"[ \t\n\r]*+\Z")


def redacted(text: str, exact: set[str], prefixes: tuple[str, ...]) -> str | None:
    """The JSON text without the members whose keys match, at any depth; None if it is no JSON.

    One pass over the tokens with a stack of its own. What stays is copied as it is written.
    """
    out: list[str] = []
    stack: list[list] = []  # of each open object or list: its sign, and the members kept so far
    dropped = 0  # depth of the object whose member is being left out
    at, wants = 0, "value"
    while True:
        if wants == "done":
            return "".join(out) if END.match(text, at) else None
        token = TOKEN.match(text, at)
        if token is None:
            return None
        at = token.end()
        string, sign, word = token.groups()
        closes = sign in ("}", "]") and bool(stack) and (stack[-1][0] == "{") == (sign == "}") and wants in ("first key", "first value", "comma") if sign else False
        if closes:
            if not dropped:
                out.append(token[0])
            stack.pop()
        elif sign == "," and wants == "comma" and stack:
            wants = "key" if stack[-1][0] == "{" else "value"
            continue
        elif wants in ("first key", "key"):
            if string is None:
                return None
            if not dropped:
                if _matches(json.loads(string) if "\\" in string else string[1:-1], exact, prefixes):
                    dropped = len(stack)
                else:
                    out.append("," + token[0] if stack[-1][1] else token[0])
                    stack[-1][1] += 1
            wants = "colon"
            continue
        elif wants == "colon":
            if sign != ":":
                return None
            if not dropped:
                out.append(token[0])
            wants = "value"
            continue
        elif wants in ("first value", "value") and (string is not None or word is not None or sign in ("{", "[")):
            if not dropped:
                if stack and stack[-1][0] == "[":
                    if stack[-1][1]:
                        out.append(",")
                    stack[-1][1] += 1
                out.append(token[0])
            if sign:
                stack.append([sign, 0])
                wants = "first key" if sign == "{" else "first value"
                continue
        else:
            return None
        # a value has ended
        if dropped == len(stack):
            dropped = 0
        wants = "comma" if stack else "done"


def deep(metadata: Column, keys: list[str]) -> Column:
    """F8: JSON text without the keys (exact or `prefix*`, ASCII case ignored) at any depth; no JSON becomes null.

    Column expressions can't follow an unbounded depth, so this runs on Arrow batches. A text in which no
    such key is written is only checked to be JSON, by the library's parser, and comes back as it is.
    """
    exact = {k.lower() for k in keys if not k.endswith("*")}
    prefixes = tuple(k[:-1].lower() for k in keys if k.endswith("*"))
    names = [re.escape(k) + '"' for k in sorted(exact)] + [re.escape(p) for p in prefixes]
    written = re.compile(f'"(?:{"|".join(names)})' if names else r"(?!)", re.IGNORECASE)

    def one(text: str) -> str | None:
        if "\\" not in text and not written.search(text):
            try:
                json.loads(text, parse_constant=_no_constant)
                return text
            except ValueError:
                return None
            except RecursionError:
                pass
        return redacted(text, exact, prefixes)

    @F.pandas_udf(StringType())
    def apply(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else one(t) for t in texts], dtype=object)

    return apply(metadata)


def _no_constant(name: str) -> None:
    raise ValueError(f"{name} is no JSON")


def top_level(metadata: Column, keys: list[str]) -> Column:
    """F8 for flat metadata: only the outermost keys, as a column expression."""
    fields = F.try_variant_get(V.parsed(metadata), "$", V.Entry)

    def kept(key: Column) -> Column:
        low, out = F.lower(key), F.lit(True)
        for k in keys:
            out = out & ~(F.startswith(low, F.lit(k[:-1].lower())) if k.endswith("*") else low == k.lower())
        return out

    return F.to_json(F.map_filter(fields, lambda k, _: kept(k)))


def details(catalog: DataFrame, keys: list[str]) -> DataFrame:
    """The public detail of each row, its metadata redacted."""
    shown = ["id", "original_id", "source_portal", "url", "title", "description", "record_kind", "first_seen_at", "last_updated_at"]
    return catalog.select(*shown, deep(F.col("metadata"), keys).alias("metadata"))
