"""One row per record where a table holds it several times."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def current(df: DataFrame, stamp: str | None = None) -> DataFrame:
    """The copy with the latest ``stamp``; without one the copies are alike."""
    if stamp is None:
        return df.dropDuplicates(["id"])
    w = Window.partitionBy("id").orderBy(F.desc_nulls_last(stamp))
    return df.withColumn("_copy", F.row_number().over(w)).where("_copy = 1").drop("_copy")
