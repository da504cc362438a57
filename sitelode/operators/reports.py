"""Report tables whose columns come from the data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What stands for rows and columns beyond a report's limits.
REST = "(rest)"


def _top(rows: DataFrame, key: str, by: str, limit: int) -> DataFrame:
    """The keys with the largest sums, ties by name, null last: `limit` rows."""
    sums = rows.groupBy(key).agg(F.sum(by).alias("_sum")).orderBy(F.desc_nulls_last("_sum"), F.asc_nulls_last(key)).limit(limit)
    return sums.select(F.col(key).alias("_key"), F.lit(True).alias("_kept"))


def pivot(rows: DataFrame, row: str, column: str, measures: dict[str, Column], row_limit: int = 25, column_limit: int = 10) -> DataFrame:
    """row, column, row_total and column_total (of the first measure), the measures: a row for each pair that occurs.

    The rows and the columns with the largest totals of the first measure are kept, the limits being the report's; all others are
    summed as "(rest)", so nothing is lost and a table's sum is the sum of its rows. measures: name to a column to be summed;
    nulls add nothing. Null keys are keys; names of 200,000 letters or none are as good as any. An empty table gives no rows."""
    first = next(iter(measures))
    cells = rows.groupBy(F.col(row).cast("string").alias("row"), F.col(column).cast("string").alias("column")).agg(*[F.sum(c).alias(name) for name, c in measures.items()])
    sides = {"row": _top(cells, "row", first, row_limit), "column": _top(cells, "column", first, column_limit)}
    for side, kept in sides.items():  # at most as many rows as the report shows
        cells = cells.join(F.broadcast(kept), F.col(side).eqNullSafe(F.col("_key")), "left").withColumn(side, F.when(F.col("_kept"), F.col(side)).otherwise(REST)).withColumn(f"_{side}", F.col("_kept").isNotNull()).drop("_key", "_kept")
    cells = cells.groupBy("row", "column", "_row", "_column").agg(*[F.sum(name).alias(name) for name in measures])
    totals = {side: cells.groupBy(F.col(side).alias("_k"), F.col(f"_{side}").alias("_own")).agg(F.sum(first).alias(f"{side}_total")) for side in sides}
    for side, total in totals.items():  # one row more than the report shows
        cells = cells.join(F.broadcast(total), F.col(side).eqNullSafe(F.col("_k")) & (F.col(f"_{side}") == F.col("_own")), "left").drop("_k", "_own")
    return cells.select("row", "column", "row_total", "column_total", *measures, (~F.col("_row") | ~F.col("_column")).alias("beyond"))
