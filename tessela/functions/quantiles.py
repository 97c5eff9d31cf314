"""Exact order statistics from ranges of the values, so no task ever sorts the table."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessela.session import materialize


class Ranks:
    """The distinct values of a column with their counts, written once in ranges of the value order.

    Equal values are combined before the shuffle. The counts of the ranges, one row each, say which range holds a rank;
    only the distinct values of that range are then looked at.
    """

    def __init__(self, df: DataFrame, value: Column):
        ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        histogram = df.select(value.alias("v")).where(F.col("v").isNotNull()).groupBy("v").agg(F.count(F.lit(1)).alias("n"))
        ranged = histogram.repartitionByRange(ranges, "v").withColumn("range", F.spark_partition_id())
        self.table = materialize(ranged, "ranks")
        counts = self.table.groupBy("range").agg(F.sum("n").alias("n")).orderBy("range").collect()
        self.ranges = [r["range"] for r in counts]
        self.ends = list(accumulate(r["n"] for r in counts))
        self.total = self.ends[-1] if self.ends else 0

    def at(self, ranks: Sequence[int]) -> dict[int, object]:
        """The values at 0-based ranks."""
        if any(not 0 <= k < self.total for k in ranks):
            raise ValueError(f"ranks {list(ranks)} outside the table of {self.total} values")
        found, by_range = {}, {}
        for k in ranks:
            by_range.setdefault(bisect_right(self.ends, k), []).append(k)
        for place, inside in by_range.items():
            before = self.ends[place - 1] if place else 0
            part = self.table.where(F.col("range") == self.ranges[place])
            # the distinct values of one range
            upto = F.sum("n").over(Window.partitionBy("range").orderBy("v"))
            row = part.withColumn("upto", upto).agg(
                *[F.min(F.when(F.col("upto") > k - before, F.col("v"))).alias(f"r{k}") for k in inside]).first()
            found.update({k: row[f"r{k}"] for k in inside})
        return found


def kth_smallest(df: DataFrame, value: Column, k: int):
    """The value at 0-based rank ``k``."""
    return Ranks(df, value).at([k])[k]


def exact_quantiles(df: DataFrame, value: Column, quantiles: Sequence[float]) -> list[float | None]:
    """Quantiles with linear interpolation between the two nearest ranks; all null on an empty column."""
    ranks = Ranks(df, value)
    n = ranks.total
    if n == 0:
        return [None for _ in quantiles]
    places = [(n - 1) * q for q in quantiles]
    at = {k: float(v) for k, v in ranks.at(sorted({r for p in places for r in (int(p), min(int(p) + 1, n - 1))})).items()}
    result = []
    for place in places:
        low, fraction = int(place), place - int(place)
        high = min(low + 1, n - 1)
        result.append(at[low] if fraction == 0 else at[low] + (at[high] - at[low]) * fraction)
    return result
