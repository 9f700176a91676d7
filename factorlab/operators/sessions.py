"""The way out for what windows can't say: a Python function of one session at a time.

A session's rows go to one task as an Arrow table in order of time. What the function returns is checked before it goes on: column names,
types and, where it adds columns to bars, the number of rows. A session is what a task holds, so this is for sessions and not for series.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from factorlab.functions.safe import require_columns
from factorlab.functions.windows import Session

Function = Callable[[pa.Table], dict]


def _schema(columns: str | T.StructType) -> T.StructType:
    return columns if isinstance(columns, T.StructType) else T.StructType.fromDDL(columns)


def _checked(found: dict, fields: T.StructType, rows: int | None) -> list[pa.Array]:
    """The columns in order and of their types; anything else is a ValueError that says what is wrong."""
    if set(found) != set(fields.names):
        raise ValueError(f"the function returns {', '.join(sorted(found))}, not {', '.join(sorted(fields.names))}")
    out = []
    for name, kind in zip(fields.names, to_arrow_schema(fields).types):
        value = found[name]
        if isinstance(value, np.ndarray) and value.dtype.kind == "f":
            value = pa.array(value, mask=np.isnan(value))
        elif isinstance(value, pa.ChunkedArray):
            value = value.combine_chunks()
        try:
            value = value.cast(kind) if isinstance(value, pa.Array) else pa.array(value, kind)
        except (pa.ArrowInvalid, pa.ArrowTypeError, pa.ArrowNotImplementedError) as e:
            raise ValueError(f"{name} is not {kind}: {e}") from e
        out.append(value)
    sizes = {len(x) for x in out} | ({rows} if rows is not None else set())
    if len(sizes) > 1:
        raise ValueError(f"columns of {', '.join(map(str, sorted(sizes)))} rows in one session" if rows is None else f"the session has {rows} rows; the function returns {', '.join(str(x) for x in sorted(sizes - {rows}))}")
    return out


def add_by_session(df: DataFrame, function: Function, adds: str | T.StructType, keys: list[str] | None = None) -> DataFrame:
    """df with the columns `adds`. function gets a session's table, in order of ts, and returns a dict of columns with a value for each row;
    NaN becomes NULL. Rows keep what they had; a new column takes the place of an old one of its name."""
    by = Session(keys).by
    require_columns(df, *by, "ts")
    fields = _schema(adds)
    plain = [c for c in df.columns if c not in fields.names]

    def f(table: pa.Table) -> pa.Table:
        table = table.sort_by("ts")
        return pa.Table.from_arrays([*[table.column(c) for c in plain], *_checked(function(table), fields, table.num_rows)], [*plain, *fields.names])

    return df.groupBy(*by).applyInArrow(f, T.StructType([*[df.schema[c] for c in plain], *fields.fields]))


def table_by_session(df: DataFrame, function: Function, columns: str | T.StructType, keys: list[str] | None = None) -> DataFrame:
    """keys, session and `columns`: as many rows for each session as the function returns."""
    by = Session(keys).by
    require_columns(df, *by, "ts")
    fields = _schema(columns)
    own = T.StructType([df.schema[c] for c in by])
    kinds = to_arrow_schema(own).types

    def f(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        found = _checked(function(table.sort_by("ts")), fields, None)
        n = len(found[0])
        return pa.Table.from_arrays([*[pa.array([k.as_py()] * n, kind) for k, kind in zip(key, kinds)], *found], [*by, *fields.names])

    return df.groupBy(*by).applyInArrow(f, T.StructType([*own.fields, *fields.fields]))


def ranks(x: np.ndarray) -> np.ndarray:
    """Average ranks of values without missing ones: equal values share the mean of their places."""
    order = np.argsort(x, kind="stable")
    value = x[order]
    fresh = np.concatenate([[True], value[1:] != value[:-1]]) if len(x) else np.zeros(0, bool)
    group = np.cumsum(fresh) - 1
    first = np.flatnonzero(fresh)
    size = np.diff(np.append(first, len(x)))
    out = np.empty(len(x))
    out[order] = (first + (size + 1) / 2)[group]
    return out


def correlation(x: np.ndarray, y: np.ndarray) -> float:
    """Pearson; NaN where one of the two is constant or there are fewer than two."""
    if len(x) < 2 or x.min() == x.max() or y.min() == y.max():
        return np.nan
    x, y = x - x.mean(), y - y.mean()
    return float((x @ y) / np.sqrt((x @ x) * (y @ y)))
