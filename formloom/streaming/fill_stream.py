"""The fill on a stream of value records: stateless, so the batch expression is used as it is (an extension)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formloom.functions import text as X


def fill_stream(values: DataFrame, template: str, columns: list[str], key: str) -> DataFrame:
    """key and filled text of each record of a (streaming) DataFrame."""
    m = F.create_map(*[x for c in columns for x in (F.lit(c), F.col(c).cast("string"))])
    return values.select(key, X.fill(F.lit(template), m).alias("filled"))
