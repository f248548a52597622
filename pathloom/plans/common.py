"""Shared pieces of the registered queries: output quantisation and SQL fragments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pathloom.functions.expr import q6


def publish(df: DataFrame) -> DataFrame:
    """Quantise every double column to 1e-6, so that sums in any order print alike."""
    return df.select(
        *[q6(F.col(f.name)).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name) for f in df.schema.fields]
    )


def q(expr: str, name: str | None = None) -> str:
    """SQL twin of ``publish`` for one expression."""
    out = f"floor(({expr}) * 1e6 + 0.5) / 1e6"
    return f"{out} AS {name}" if name else out


def qs(*names: str) -> str:
    return ", ".join(q(n, n) for n in names)
