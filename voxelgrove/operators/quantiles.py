"""Exact quantiles of groups of any size, by counting.

A rank's value lies in an interval, at first from the group's least to its greatest. Each round parts the intervals that are
still open into bins, counts the rows in each, and goes on with the bin that the rank falls in, narrowed to the values in it. What
travels is a count for each bin; no task holds a group's values."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import settle

#: Bins of an interval in a round. Two quantiles have four ranks, so a group has at most 65,536 bins in a round.
BINS = 16384
#: Over -ln of the least double above 0.
LEAST = 745.0


def _bin(v: Column, lo: Column, hi: Column, bins: int, by_size: bool) -> Column:
    """0 and bins - 1 hold the ends alone, so every round narrows an interval; the bins between have one width, or one ratio."""
    top = 1.7e308
    at = (lambda x: F.when(x == 0, 0.0).otherwise(F.signum(x) * (F.log(F.abs(x)) + LEAST))) if by_size else (lambda x: x / 4)
    v_, lo_, hi_ = (at(F.least(F.greatest(x, F.lit(-top)), F.lit(top))) for x in (v, lo, hi))
    share = F.when(hi_ > lo_, (v_ - lo_) / (hi_ - lo_)).otherwise(0.0)
    inner = F.least(F.greatest(F.floor(share * (bins - 2)), F.lit(0)), F.lit(bins - 3)).cast("int") + 1
    return F.when(v == lo, 0).when(v == hi, bins - 1).otherwise(inner)


def exact_quantiles(rows: DataFrame, ends: DataFrame, quantiles: Mapping[str, float], keys: Sequence[str], value: str = "value", weight: str | None = None, bins: int = BINS) -> DataFrame:
    """(keys, a column for each of quantiles, name -> q in [0, 1]): linear interpolation between the neighbours of q * (n - 1).

    ends: (keys, n, lo, hi) of each group, without nulls: the rows (or sum of weights), the least and the greatest value. Rows whose value is null
    or NaN must not be counted there; they are passed over. weight: a column of whole numbers, for rows that stand for several. A null key is a
    group. rows is read once for each round: one or two for values on a grid, about five for any others."""
    k = [f"__k{i}" for i in range(len(keys))]
    name = dict(zip(keys, k))
    places = [F.lit(float(q)) * (F.col("n") - 1) for q in quantiles.values()]
    ranks = F.array_distinct(F.array(*(f(p).cast("long") for p in places for f in (F.floor, F.ceil))))
    open_ = ends.where("n > 0").select(*(F.col(c).alias(a) for c, a in name.items()), "n", F.explode(ranks).alias("rank"), F.col("lo").cast("double").alias("lo"), F.col("hi").cast("double").alias("hi"), F.lit(0).cast("long").alias("before"))
    open_ = settle(open_)
    values = rows.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    values = values.select(*(F.col(c).alias(f"__v{i}") for i, c in enumerate(keys)), F.col(value).cast("double").alias("__v"), (F.col(weight).cast("long") if weight else F.lit(1).cast("long")).alias("__w"))
    n = 0
    while not open_.where("lo < hi").isEmpty():
        spans = open_.where("lo < hi").select(*k, "lo", "hi").distinct()
        same = F.lit(True)
        for i in range(len(keys)):
            same = same & F.col(f"__v{i}").eqNullSafe(F.col(k[i]))
        hit = values.join(spans, same & (F.col("__v") >= F.col("lo")) & (F.col("__v") <= F.col("hi")))
        hit = hit.withColumn("bin", _bin(F.col("__v"), F.col("lo"), F.col("hi"), bins, n % 2 == 1))
        counts = hit.groupBy(*k, "lo", "hi", "bin").agg(F.sum("__w").alias("c"), F.min("__v").alias("least"), F.max("__v").alias("most"))
        upto = F.sum("c").over(Window.partitionBy(*k, "lo", "hi").orderBy("bin"))
        counts = counts.withColumn("upto", upto).select(*(F.col(c).alias(f"__c{i}") for i, c in enumerate(k)), F.col("lo").alias("__lo"), F.col("hi").alias("__hi"), "c", "least", "most", "upto")
        mine = (F.col("lo") == F.col("__lo")) & (F.col("hi") == F.col("__hi"))
        for i in range(len(keys)):
            mine = mine & F.col(k[i]).eqNullSafe(F.col(f"__c{i}"))
        inside = (F.col("rank") - F.col("before") < F.col("upto")) & (F.col("rank") - F.col("before") >= F.col("upto") - F.col("c"))
        next_ = open_.where("lo < hi").join(counts, mine & inside).select(*k, "n", "rank", F.col("least").alias("lo"), F.col("most").alias("hi"), (F.col("before") + F.col("upto") - F.col("c")).alias("before"))
        open_ = settle(next_.unionByName(open_.where("lo >= hi")))
        n += 1
    found = open_.groupBy(*k, "n").agg(F.map_from_entries(F.collect_list(F.struct("rank", "lo"))).alias("at"))
    out = []
    for q, p in zip(quantiles, places):
        a, b = F.col("at")[F.floor(p).cast("long")], F.col("at")[F.ceil(p).cast("long")]
        out.append(F.when(a == b, a).otherwise(a + (b - a) * (p - F.floor(p))).alias(q))
    return found.select(*(F.col(a).alias(c) for c, a in name.items()), *out)
