"""Computed columns that later steps take as values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def settle(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``withColumns``, with each expression evaluated once per row.

    The optimizer moves filters below plain projections by writing the expressions into them. With several layers of byte and text
    decoding, each using the one before more than once, these grow without end. A one-element explode keeps the layers apart; it
    stays in generated code and moves no data.
    """
    packed = F.struct(*[expression.alias(name) for name, expression in columns.items()])
    kept = [c for c in df.columns if c not in columns]
    return df.select(*kept, F.explode(F.array(packed)).alias("__settled")).select(
        *kept, *[F.col(f"__settled.{name}").alias(name) for name in columns]
    )

