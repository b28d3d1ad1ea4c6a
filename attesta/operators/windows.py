"""Ordered-group operators. Each takes the columns that order a group; they must leave no ties."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_wins(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """The first row of each key. Spark limits each task's rows before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def first_wins_with_backfill(df: DataFrame, keys: list[str], order: str, fill: list[str]) -> DataFrame:
    """One row for each key: its first row, with blanks of `fill` taken from the first row that has them.

    Written as an aggregate, so that tasks combine rows of a key before the shuffle. The
    column dropped counts the other rows.
    """
    rest = [c for c in df.columns if c not in (*keys, *fill)]
    own = [F.min_by(c, order).alias(c) for c in rest]
    filled = [F.min_by(c, F.when(F.col(c).isNotNull() & (F.col(c).cast("string") != ""), F.col(order))).alias(c) for c in fill]
    return df.groupBy(*keys).agg(*own, *filled, (F.count("*") - 1).alias("dropped"))


def precedence_pick(df: DataFrame, key: str, is_current: Column, verdict: Column, newest: Column, tie: Column | str) -> DataFrame:
    """One check of each event: a current citation first, then the worst verdict, then the newest."""
    rank = F.when(verdict == "contradicted", 0).when(verdict == "no_quote", 1).when(verdict == "unreadable", 2).when(verdict == "verified", 3).otherwise(4)
    return first_wins(df, [key], [F.desc(is_current), rank, newest.desc(), tie])


def edition_order(df: DataFrame, series: str, year: str, tie: str) -> DataFrame:
    """is_latest marks one row of each series, that of the latest year."""
    w = Window.partitionBy(series).orderBy(F.desc(year), F.desc(tie))
    return df.withColumn("is_latest", F.row_number().over(w) == 1)


def changes(df: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """Rows whose value differs from the one before; blank and null are the same."""
    w = Window.partitionBy(key).orderBy(*order)
    old = F.lag(value).over(w)
    differs = F.coalesce(old.cast("string"), F.lit("")) != F.coalesce(F.col(value).cast("string"), F.lit(""))
    first = F.row_number().over(w) == 1
    return df.withColumn("old_value", old).withColumn("change_type", F.when(first, "new_record").when(differs, "updated")).where("change_type is not null")


def carry_forward(df: DataFrame, key: str, order: list[str], value: Column, out: str) -> DataFrame:
    """The last value that is not null so far: a blank never overwrites."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out, F.last(value, ignorenulls=True).over(w))


def seen_times(df: DataFrame, key: str, at: str, changed: Column) -> DataFrame:
    """first_seen, last_checked and last_changed of each key."""
    return df.groupBy(key).agg(F.min(at).alias("first_seen"), F.max(at).alias("last_checked"), F.max(F.when(changed, F.col(at))).alias("last_changed"))


def last_matching(df: DataFrame, key: str, pos: str, value: str, matching: Column) -> DataFrame:
    """The value of the last row of each key that matches; null if none does."""
    return df.groupBy(key).agg(F.max_by(value, F.when(matching, F.col(pos))).alias(value))


def best_candidate(df: DataFrame, key: str, score: Column, pos: str, floor: float) -> DataFrame:
    """The best scored row of each key, the earliest on ties; none below the floor."""
    scored = df.withColumn("score", score).where(F.col("score") >= floor)
    return first_wins(scored, [key], [F.desc("score"), pos])


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each key, ranked from 1."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def nearest(df: DataFrame, key: list[str], distance: Column, candidate: str) -> DataFrame:
    """The candidate at the least distance, the smaller id on ties; without any distance the largest id."""
    far = F.lit(10**9)
    return df.groupBy(*key).agg(F.coalesce(F.min_by(candidate, F.when(distance.isNotNull(), F.struct(F.coalesce(distance, far), candidate))), F.max(candidate)).alias(candidate))
