"""Assertions on ids that run inside the job whose rows they guard: no scan or shuffle of their own.

Each returns the rows it was given; a violation raises, naming the id, in the job that reads them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _raise(*message: Column | str) -> Column:
    return F.raise_error(F.concat(*[F.lit(m) if isinstance(m, str) else m for m in message])).cast("boolean")


def checked(rows: DataFrame, *problems: tuple[Column, Column]) -> DataFrame:
    """The rows; the first problem (condition, error) that holds for a row raises."""
    for bad, error in problems:
        rows = rows.where(F.when(bad, error).otherwise(True))
    return rows


def unique(rows: DataFrame, key: str, what: str = "id") -> DataFrame:
    """The rows, each ``key`` once. They lie by key afterwards, so a join or grouping by it needs no further shuffle.

    Looks one row back only: the second row of a key fails the task, however many there are.
    """
    again = F.lag(F.lit(True)).over(Window.partitionBy(key).orderBy(key))
    marked = rows.withColumn("_again", again)
    return checked(marked, (F.col("_again"), _raise(f"{what} is not unique: ", F.col(key).cast("string")))).drop("_again")


def required(rows: DataFrame, key: str, what: str = "id") -> DataFrame:
    """The rows, each with a non-empty ``key``."""
    return checked(rows, (F.coalesce(F.length(key), F.lit(0)) == 0, _raise(f"a record has no {what}")))


def skills(pool: DataFrame) -> DataFrame:
    """The pool's rows with a non-empty skill_id, each id once; at least one."""
    valid = pool.where(F.length("skill_id") > 0)
    if valid.isEmpty():  # reads to the first valid row
        raise ValueError("the pool has no valid skill_id")
    return unique(valid, "skill_id", "skill_id")


def positives(records: DataFrame, pool: DataFrame, ids: str = "positive_skill_ids") -> DataFrame:
    """One row to each of a record's positives: query_id, position (from 0), and the columns of its skill in the pool.

    A record's list must hold non-empty ids, each once, at least one, and the pool each of them.
    """
    name = F.col("query_id")
    listed = checked(
        required(records, "query_id", "query_id"),
        (F.coalesce(F.size(ids), F.lit(-1)) < 1, _raise("no positives: ", name)),
        (F.exists(ids, lambda x: F.coalesce(F.length(x), F.lit(0)) == 0), _raise("an empty positive id: ", name)),
        (F.size(F.array_distinct(ids)) < F.size(ids), _raise("a positive id repeats: ", name)),
    )
    each = listed.select("query_id", F.posexplode(ids).alias("position", "skill_id"))
    known = skills(pool).withColumn("_known", F.lit(True))
    found = checked(each.join(known, "skill_id", "left"), (F.col("_known").isNull(), _raise("a positive is not in the pool: ", F.col("skill_id"))))
    return found.drop("_known")
