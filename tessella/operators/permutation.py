"""Seeded random orders that are never sorted: place i of an order is worked out by a keyed permutation.

A Feistel network of ``ROUNDS`` rounds over two halves of sizes a and b permutes 0 .. a * b - 1; with a = ceil(sqrt(n)) and
b = ceil(n / a), at most a - 1 values lie beyond n, and an order leaves them out. So row i of a query's order of n things
is a number to join on, and a prefix of the order costs as many rows as it is long, whatever n is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.operators.lineage import cut

ROUNDS = 4


def halves(n: Column) -> tuple[Column, Column]:
    a = F.greatest(F.lit(1), F.ceil(F.sqrt(n.cast("double")))).cast("long")
    return a, F.greatest(F.lit(1), F.ceil(n / a)).cast("long")


def place(i: Column, n: Column, *key: Column | str | int) -> Column:
    """The value at ``i`` of the order that ``key`` gives the numbers below a * b (see ``halves``)."""
    a, b = halves(n)
    left, right = F.floor(i / b), i % b
    name = [F.lit(str(k)) if isinstance(k, (int, str)) else k.cast("string") for k in key]
    for r in range(ROUNDS):
        digest = F.sha2(F.concat_ws(":", *name, F.lit(str(r)), (right if r % 2 == 0 else left).cast("string")), 256)
        drawn = F.conv(F.substring(digest, 1, 12), 16, 10).cast("long")
        if r % 2 == 0:
            left = (left + drawn) % a
        else:
            right = (right + drawn) % b
    return left * b + right


def order(asked: DataFrame, n: str, width: int, *key: Column | str | int) -> DataFrame:
    """``asked`` with the first rows of each row's order of 0 .. n - 1: (.., position from 1, number).

    Reads the first ``width`` values, and so a few rows less than ``width`` where values beyond n are among them.
    """
    a, b = halves(F.col(n))
    last = F.least(F.lit(width).cast("long"), a * b) - 1
    each = asked.where(F.col(n) > 0).withColumn("position", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    return each.withColumn("number", place(F.col("position"), F.col(n), *key)).where(F.col("number") < F.col(n)).withColumn("position", F.col("position") + 1)


def numbered(rows: DataFrame, key: str, group: str) -> DataFrame:
    """``rows`` with ``number`` among all and ``mate`` among those of their ``group``, both from 0 by (group, key).

    Rows are dealt by ranges and counted per range, so no group is sorted by one task; the counts (ranges x groups that lie
    in them) are summed up in order.
    """
    placed = cut(rows.repartitionByRange(group, key).withColumn("_part", F.spark_partition_id()))
    sizes = placed.groupBy("_part", group).agg(F.count("*").alias("n"))
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("_part", group, before(Window.orderBy("_part", group)).alias("_all"), before(Window.partitionBy(group).orderBy("_part")).alias("_own"))
    nth = F.row_number().over(Window.partitionBy("_part", group).orderBy(key)) - 1
    return placed.withColumn("_nth", nth).join(F.broadcast(starts), ["_part", group]).withColumns({"number": F.col("_all") + F.col("_nth"), "mate": F.col("_own") + F.col("_nth")}).drop("_part", "_nth", "_all", "_own")
