"""Decoding of page bytes in UTF-8, GB18030 or Big5, which Spark's own decoder does not all know."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, functions as F

CHARSETS = ("utf-8", "gb18030", "big5")


def _decoded(raw: bytes | None) -> tuple[str | None, str | None]:
    if raw is None:
        return None, None
    found = []
    for rank, name in enumerate(CHARSETS):
        try:
            text = bytes(raw).decode(name)
        except UnicodeDecodeError:
            continue
        if rank == 0:
            return text, name
        common = sum("一" <= c <= "鿿" or c < "\x7f" for c in text)
        found.append((-common / max(len(text), 1), rank, text, name))
    if found:
        _, _, text, name = min(found)
        return text, name
    return bytes(raw).decode("utf-8", "replace"), "utf-8"


def _frame(raw: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([_decoded(x) for x in raw], columns=["text", "charset"])


def decode_bytes(raw: Column) -> Column:
    """struct(text, charset): strict UTF-8 first, then the charset with the larger share of common characters; else UTF-8 with replacement."""
    return F.pandas_udf(_frame, "text string, charset string")(raw)
