"""Choosing the columns an operator reads."""

from __future__ import annotations

from pyspark.sql import DataFrame


def pick(df: DataFrame, *names: str) -> DataFrame:
    """The columns of exactly these names. Others stay out, also where they differ
    from one of them in case only, or where a name comes twice (the first counts)."""
    lower = [c.lower() for c in df.columns]
    if len(set(lower)) == len(lower):
        return df.select(*names)
    places = [df.columns.index(n) for n in names]
    plain = df.toDF(*(f"c{i}" for i in range(len(lower))))
    return plain.select(*(plain[f"c{i}"].alias(n) for i, n in zip(places, names)))
