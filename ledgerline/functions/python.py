"""What Catalyst has no expression for, in Arrow batches."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable

import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType


@pandas_udf(StringType())
def nfc(s: pd.Series) -> pd.Series:
    """Canonical composition."""
    return s.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFC", x))


def fnv1a(ids: Iterable[str]) -> str:
    """64-bit FNV-1a over ids in the order given, a newline after each, as 16 hex digits."""
    h = 0xCBF29CE484222325
    for i in ids:
        for b in i.encode() + b"\n":
            h = (h ^ b) * 0x100000001B3 & (1 << 64) - 1
    return f"{h:016x}"


def llm_chunks(text: str, budget: int, encode, decode) -> list[str]:
    """Pieces of at most max(1, budget - 512) tokens that together are the text."""
    most, ids = max(1, budget - 512), encode(text)
    return [decode(ids[k : k + most]) for k in range(0, len(ids), most)]


def strip_json_fence(text: str) -> str:
    t = text.strip()
    if t.startswith("```"):
        t = t.partition("\n")[2] if "\n" in t else t[3:]
        t = t.rstrip().removesuffix("```")
    return t.strip()


def backoff_seconds(attempt: int) -> float:
    return min(60.0, 2.0 * 2 ** (attempt - 1))
