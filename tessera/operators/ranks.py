"""Positions of rows in a global order, without a window over all of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.components import checkpointed


def with_position(rows: DataFrame, *order: Column | str, name: str = "position") -> DataFrame:
    """Adds the row's position from 0 in the given order, which must not leave ties.

    The rows are dealt into ranges and sorted there; one count per range comes
    to the driver and gives each range its first position.
    """
    ordered = rows.orderBy(*order).withColumns({"_part": F.spark_partition_id(), "_in": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)})
    ordered = checkpointed(ordered)
    firsts, first = [], 0
    for r in ordered.groupBy("_part").agg(F.count("*").alias("n")).orderBy("_part").collect():
        firsts.append((r["_part"], first))
        first += r["n"]
    offsets = rows.sparkSession.createDataFrame(firsts, "_part int, _first long")
    return ordered.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_first") + F.col("_in")).drop("_part", "_in", "_first")
