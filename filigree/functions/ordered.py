"""Order within a key, for keys of any size: no task holds a whole key.

Rows are range-partitioned by key and order, so a key with very many rows lies in several
partitions. Windows run within a partition; what a key brings along from the partitions before is a
row for each partition at most.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import written


def ordered(df: DataFrame, key: Sequence[str], order: Sequence[str | Column], name: str, keep: Sequence[str | Column] = ("*",), parts: int | None = None) -> DataFrame:
    """The rows sorted by ``key`` and ``order``, written with ``pos``, a number that grows in this order,
    and ``part``, the partition; both replace columns of that name.

    Nulls come first unless ``order`` says otherwise. Equal rows are told apart by their place in
    the input, so that many of them don't meet in one partition. keep: the columns to write.
    """
    by = [*[F.col(k) if isinstance(k, str) else k for k in [*key, *order]], F.monotonically_increasing_id()]
    ranged = df.repartitionByRange(parts, *by) if parts else df.repartitionByRange(*by)
    placed = ranged.sortWithinPartitions(*by).select(*keep).withColumn("pos", F.monotonically_increasing_id())
    return written(placed.withColumn("part", F.shiftright("pos", 33)), name)


def _brought(table: DataFrame, key: Sequence[str], totals: dict[str, Column], over: dict[str, Column]) -> DataFrame:
    """(part, key, what ``over`` computes from the pieces of the key in the partitions before).

    totals: aggregates of a piece, that is of a key's rows in a partition; over: columns over ``_before``.
    A partition has one piece at most whose key has begun before.
    """
    pieces = table.groupBy("part", *key).agg(*[c.alias(k) for k, c in totals.items()])
    w = Window.partitionBy(*key).orderBy("part")
    pieces = pieces.select("part", *key, F.row_number().over(w).alias("_nth"), *[c.over(w.rowsBetween(Window.unboundedPreceding, -1)).alias(k) for k, c in over.items()])
    return pieces.where("_nth > 1").drop("_nth")


def _with_brought(table: DataFrame, key: Sequence[str], brought: DataFrame) -> DataFrame:
    """Add the columns of ``brought``, null where nothing is brought along; nulls in keys are equal."""
    renamed = brought.select(F.col("part").alias("_p"), *[F.col(k).alias(f"_k{i}") for i, k in enumerate(key)], *[c for c in brought.columns if c not in ("part", *key)])
    on = F.col("part") == F.col("_p")
    for i, k in enumerate(key):
        on &= F.col(k).eqNullSafe(F.col(f"_k{i}"))
    # One row for each partition at most, so its size is the number of partitions.
    return table.join(F.broadcast(renamed), on, "left").drop("_p", *[f"_k{i}" for i in range(len(key))])


def numbered(table: DataFrame, key: Sequence[str], into: str = "nth") -> DataFrame:
    """Number each key's rows of an ``ordered`` table from 0."""
    rows = _with_brought(table, key, _brought(table, key, {"_n": F.count("*")}, {"_n": F.sum("_n")}))
    w = Window.partitionBy("part", *key).orderBy("pos")
    return rows.withColumn(into, F.row_number().over(w) - 1 + F.coalesce("_n", F.lit(0))).drop("_n")


def lagged(table: DataFrame, key: Sequence[str], what: Column, into: str) -> DataFrame:
    """Add ``what`` of the row before in the key, null for the first row. what: a struct of the row's columns."""
    last = _brought(table, key, {"_last": F.max_by(what, "pos")}, {"_last": F.last("_last")})
    w = Window.partitionBy("part", *key).orderBy("pos")
    rows = _with_brought(table, key, last).withColumn("_first", F.row_number().over(w) == 1)
    return rows.withColumn(into, F.when(F.col("_first"), F.col("_last")).otherwise(F.lag(what).over(w))).drop("_last", "_first")


def running_sum(table: DataFrame, key: Sequence[str], value: str, into: str) -> DataFrame:
    """Add the sum of ``value`` (0 for null) over the key's rows up to and with each row of an ``ordered`` table."""
    rows = _with_brought(table, key, _brought(table, key, {"_n": F.sum(value)}, {"_n": F.sum("_n")}))
    w = Window.partitionBy("part", *key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(into, F.coalesce(F.sum(value).over(w), F.lit(0)) + F.coalesce("_n", F.lit(0))).drop("_n")
