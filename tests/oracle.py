"""Comparison of two results without regard to the order of rows."""

from __future__ import annotations

import datetime
import math

import pandas as pd


def plain(v):
    """A value that compares and sorts alike from either engine."""
    if v is None or v is pd.NaT:
        return None
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, dict):
        return tuple((k, plain(x)) for k, x in v.items())
    if hasattr(v, "asDict"):
        return tuple((k, plain(x)) for k, x in v.asDict().items())
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9) + 0.0
    if isinstance(v, pd.Timestamp):
        return v.to_pydatetime().replace(tzinfo=None)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return None if v is pd.NA else v


def rows_of(df: pd.DataFrame) -> list[tuple]:
    cols = sorted(df.columns)
    return sorted((tuple(plain(v) for v in r) for r in df[cols].itertuples(index=False, name=None)), key=repr)


def same(a: pd.DataFrame, b: pd.DataFrame) -> str:
    """"" if both hold the same rows, else what differs."""
    if sorted(a.columns) != sorted(b.columns):
        return f"columns {sorted(a.columns)} and {sorted(b.columns)}"
    x, y = rows_of(a), rows_of(b)
    if len(x) != len(y):
        return f"{len(x)} and {len(y)} rows; only left {sorted(set(x) - set(y), key=repr)[:2]}, only right {sorted(set(y) - set(x), key=repr)[:2]}"
    return next((f"{p} and {q}" for p, q in zip(x, y) if [*map(_loose, p)] != [*map(_loose, q)]), "")


def _loose(v):
    return float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v
