"""Shaping of evidence tables: scores, parameter grids, best rows, ragged unions, pivots, upserts, audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def grid_neighbours(cells: DataFrame, by: str, x: str, y: str, value: str) -> DataFrame:
    """Each cell's mean and smallest value over the cells next to it in the ordered lists of both parameters."""
    w = lambda c: Window.partitionBy(by).orderBy(c)
    r = cells.withColumn("rx", F.dense_rank().over(w(x))).withColumn("ry", F.dense_rank().over(w(y)))
    steps = F.array(*[F.struct(F.lit(a).alias("dx"), F.lit(b).alias("dy")) for a, b in ((1, 0), (-1, 0), (0, 1), (0, -1))])
    near = r.select(by, x, y, "rx", "ry", F.inline(steps)).select(by, x, y, (F.col("rx") + F.col("dx")).alias("rx"), (F.col("ry") + F.col("dy")).alias("ry"))
    found = near.join(r.select(by, "rx", "ry", F.col(value).alias("other")), [by, "rx", "ry"], "left")
    return found.groupBy(by, x, y).agg(F.avg("other").alias("mean_near"), F.min("other").alias("min_near"))


def best_per_group(rows: DataFrame, group: str, value: str, tie: str, n: int = 1) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(group).orderBy(F.desc(value), tie))
    return rows.withColumn("place", place).where(F.col("place") <= n)


def upsert(catalogue: DataFrame, new: DataFrame, key: str, ordinal: str) -> DataFrame:
    """The catalogue without the keys of `new`, then `new` at the end in its own order."""
    kept = catalogue.join(new.select(key), key, "left_anti")
    last = kept.agg(F.coalesce(F.max(ordinal), F.lit(-1)).alias("last"))
    added = new.crossJoin(F.broadcast(last)).withColumn(ordinal, (F.col("last") + F.row_number().over(Window.orderBy(ordinal, key))).cast(catalogue.schema[ordinal].dataType)).drop("last")
    return kept.unionByName(added)


def missing_cells(df: DataFrame) -> DataFrame:
    """One row: rows, columns and missing cells of a table."""
    gaps = sum((F.count_if(F.col(c).isNull()) for c in df.columns), F.lit(0))
    return df.agg(F.count("*").alias("rows"), F.lit(len(df.columns)).cast("long").alias("columns"), gaps.alias("missing"))


def pivot_metric(rows: DataFrame, index: str, columns: str, value: str, names: list) -> DataFrame:
    """Wide table; raises if a cell has more than one row, as then no value would be right."""
    one = F.when(F.count(F.lit(1)) > 1, F.raise_error(F.lit("a cell of the pivot has more than one row"))).otherwise(F.first(value))
    return rows.groupBy(index).pivot(columns, names).agg(one)


def resumable(todo: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """The configurations without a finished run."""
    return todo.dropDuplicates(keys).join(done.select(*keys), keys, "left_anti")
