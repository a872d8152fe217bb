"""A way that a session may lack, and the one to take instead."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import pandas as pd
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, functions as F

from . import codepoint
from .quality import once

Way = Callable[[DataFrame], DataFrame]
_TOKEN, _MARKS = re.compile(codepoint.TOKEN), ("\x01", "\x02", "\x03")
_RUN, _SURROGATE, _BARE = re.compile(codepoint.RUN), re.compile(codepoint.SURROGATE), str.maketrans("", "", "x\x01\x02\x03")


def first_available(df: DataFrame, *ways: Way) -> DataFrame:
    """The result of the first way that this session can analyse; the last one's error if none. Rows are not read for it, so an
    error that only rows cause is not hidden."""
    for way in ways[:-1]:
        try:
            found = way(df)
            found.schema  # analysis, no job
        except PySparkException:
            continue
        return found
    return ways[-1](df)


def _run(r: str, mapped: dict[str, str]) -> str:
    """The text of a run of tokens, none of which is half of a surrogate pair."""
    first = r[0]
    if first in mapped:
        return r.replace(first, mapped[first])
    if len(r) > 1 and (first == "x" or first in _MARKS):
        return bytes.fromhex(r.translate(_BARE)).decode("utf-16-be")
    return r if first >= " " and r != ";" else "\n" if r == "\x04" else ""


def _decoded(content: str | None, replace: str | None) -> str | None:
    if content is None:
        return None
    mapped, out, before = json.loads(replace or "{}"), [], ""
    if not _SURROGATE.search(content):
        return _RUN.sub(lambda m: _run(m.group(), mapped), content)
    for t in _TOKEN.findall(content):
        marked, point = before in _MARKS and before not in mapped, t[-4:]
        if len(t) == 1:
            out.append(mapped.get(t, "\n" if t == "\x04" else "" if t == ";" or t < " " else t))
        elif "d800" <= point.lower() <= "dfff":
            out.append(point if marked and len(t) == 5 else t)
        else:
            out.append(chr(int(point, 16)) if marked or len(t) == 5 else t)
        before = t
    return "".join(out)


def _series(content: pd.Series, replace: pd.Series) -> pd.Series:
    return pd.Series([_decoded(c, r) for c, r in zip(content, replace)], dtype=object)


def _batches(content: Column, replace: Column) -> Column:
    return F.pandas_udf(_series, "string")(content, replace)


def decode_by_batches(df: DataFrame, content: str, replace: str, out: str = "decoded") -> DataFrame:
    """What `codepoint.decode` gives, in Arrow batches."""
    given = once(df, {"__map": F.to_json(codepoint.replacement_map(F.col(replace)))})
    return given.withColumn(out, _batches(F.col(content), F.col("__map"))).drop("__map")
