"""Rows of a micro-batch as plain values."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc


def plain_rows(frames: Iterable[pd.DataFrame], columns: Sequence[str]) -> Iterator[tuple]:
    """Rows of the columns, null as None; whole numbers that pandas made decimal because of nulls beside them are whole again."""
    for frame in frames:
        yield from zip(*(_plain(frame[c]) for c in columns))


def _plain(column: pd.Series) -> list:
    values = column.astype(object).where(column.notna(), None).tolist()
    return [None if v is None else int(v) for v in values] if column.dtype.kind == "f" else values


def plain_columns(table: pa.Table, columns: Sequence[str]) -> list[list]:
    """The columns of a table as lists of plain values, null as None; a column that it hasn't is null."""
    return [_listed(table.column(c)) if c in table.column_names else [None] * table.num_rows for c in columns]


def _listed(column: pa.ChunkedArray) -> list:
    if column.null_count == len(column):
        return [None] * len(column)
    kind = column.type
    if column.null_count == 0 or not (pa.types.is_integer(kind) or pa.types.is_boolean(kind)):
        return column.to_numpy().tolist()
    # numpy would make these decimal numbers.
    values = column.fill_null(False if pa.types.is_boolean(kind) else 0).to_numpy().tolist()
    for i in pc.indices_nonzero(column.is_null()).to_numpy().tolist():
        values[i] = None
    return values
