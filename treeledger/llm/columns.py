"""Columns that an operator carries but does not read."""

from __future__ import annotations

from pyspark.sql import DataFrame


def veiled(df: DataFrame, *read: str) -> DataFrame:
    """``df`` with all columns but those read renamed, so that none clashes with an operator's own; undo with ``toDF(*df.columns)``."""
    return df.toDF(*(c if c in read else f"carried{k}_" for k, c in enumerate(df.columns)))
