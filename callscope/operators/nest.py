"""Stream statistics as one array column per call, and back."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callscope.functions.values import hex8
from callscope.schemas import STREAM_STATISTICS

def nest(df: DataFrame, keys: Sequence[str], item: Column) -> DataFrame:
    """Collect the struct ``item`` per key into ``items``, sorted by its fields from the first on: one row per key.

    The array is one value, so this is for items that are few by nature, such as the streams of a call. Keys without such a bound keep one row per item.
    """
    return df.select(*keys, item.alias("__item")).groupBy(*keys).agg(F.array_sort(F.collect_list("__item")).alias("items"))


def unnest(df: DataFrame, items: str = "items", outer: bool = False) -> DataFrame:
    """One row per array item, its fields as columns; ``outer`` keeps rows with an empty array."""
    explode = F.explode_outer if outer else F.explode
    rest = [c for c in df.columns if c != items]
    return df.select(*rest, explode(items).alias("__item")).select(*rest, "__item.*")


def stream_item() -> Column:
    """One stream as the delivered record."""
    made = {"ssrc": hex8("ssrc")}
    fields = STREAM_STATISTICS.elementType.fields
    return F.struct(*[made.get(f.name, F.col(f.name)).cast(f.dataType).alias(f.name) for f in fields])


def json_int(json_text: str | Column, field: str) -> Column:
    """Whole number of a JSON field."""
    text = F.col(json_text) if isinstance(json_text, str) else json_text
    return F.try_variant_get(F.try_parse_json(text), f"$.{field}", "bigint")
