"""Positions of rows within their key, without gathering a key in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.session import materialize


def ordered_rank(df: DataFrame, keys: list[str], order: list, name: str = "rank", total: str | None = None) -> DataFrame:
    """Add the 1-based position of each row among the rows of its key.

    Rows are range partitioned by key and order, so a hot key spreads over
    neighbouring partitions; each partition numbers its own rows, and a small
    table of counts (a row a key and partition) gives the numbers to start
    from.  Ties take the order in which the range sort leaves them: give
    columns that make rows distinct.  ``total`` adds the rows of the key.
    """
    order = [F.col(o) if isinstance(o, str) else o for o in order]
    spread = df.repartitionByRange(*[F.col(k) for k in keys], *order).withColumn("__part", F.spark_partition_id())
    laid = materialize(spread, "ranked")
    here = Window.partitionBy("__part", *keys).orderBy(*order)
    counts = laid.groupBy(*keys, "__part").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    start = counts.withColumn("__start", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    if total:
        start = start.withColumn(total, F.sum("__n").over(Window.partitionBy(*keys)))
    same = F.lit(True)
    renamed = start.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("__part").alias("__p"), "__start", *([total] if total else []))
    numbered = laid.withColumn(name, F.row_number().over(here))
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    joined = numbered.join(renamed, same & (F.col("__part") == F.col("__p")))
    return joined.withColumn(name, F.col(name) + F.col("__start")).drop("__part", "__p", "__start", *[f"__k{i}" for i in range(len(keys))])
