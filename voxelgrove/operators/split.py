"""Deterministic splits: stratified, grouped, by ratios or k folds.

Groups are ranked in their stratum by SHA-256 of seed and group, so a split can be made again anywhere."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import ValidationError

#: First hex digits of the hash: the buckets that a stratum's groups are numbered in.
HEX = 3


def group_ranks(records: DataFrame, group: str, stratum: str | None, ordinal: str, seed: int) -> DataFrame:
    """(group, stratum, rank, n): each group once, in the stratum of its first record. Null is a group of its own.

    Groups are numbered within buckets of their hash; running sums of the buckets' counts, at most 16 ** HEX a stratum, go before."""
    s = F.col(stratum).cast("string") if stratum else F.lit("")
    groups = records.groupBy(F.col(group).cast("string").alias("group")).agg(F.min_by(s, F.col(ordinal)).alias("stratum"))
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce("group", F.lit(""))).cast("binary"), 256)
    groups = groups.withColumn("__key", key).withColumn("__b", F.substring("__key", 1, HEX))
    counts = groups.groupBy(F.col("stratum").alias("__s"), F.col("__b").alias("__c")).agg(F.count("*").alias("__m"))
    every = Window.partitionBy("__s")
    before = F.sum("__m").over(every.orderBy("__c").rowsBetween(Window.unboundedPreceding, 0)) - F.col("__m")
    counts = counts.select("__s", "__c", before.alias("__before"), F.sum("__m").over(every).alias("n"))
    order = Window.partitionBy("stratum", "__b").orderBy("__key", "group")
    placed = groups.withColumn("__r", F.row_number().over(order)).join(counts, F.col("stratum").eqNullSafe(F.col("__s")) & (F.col("__b") == F.col("__c")))
    return placed.select("group", "stratum", (F.col("__before") + F.col("__r") - 1).alias("rank"), "n")


def ratio_split(records: DataFrame, ratios: Mapping[str, float], group: str, stratum: str | None = None, ordinal: str = "ordinal", seed: int = 0) -> DataFrame:
    """records plus part. Ratios count groups; what rounding down leaves goes to the largest fractions first."""
    if not ratios or any(r < 0 for r in ratios.values()) or abs(sum(ratios.values()) - 1) > 1e-6:
        raise ValidationError("ratios must be positive and sum to 1")
    ranks = group_ranks(records, group, stratum, ordinal, seed)
    sizes = ranks.select("stratum", "n").distinct()
    parts = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(k).alias("part"), F.lit(float(r)).alias("r")) for i, (k, r) in enumerate(ratios.items())))
    dealt = sizes.select("stratum", "n", F.inline(parts))
    raw = F.round(F.col("r") * F.col("n"), 9)
    dealt = dealt.withColumn("base", F.floor(raw)).withColumn("frac", F.round(raw - F.col("base"), 9))
    every = Window.partitionBy("stratum")
    dealt = dealt.withColumns({"left": F.col("n") - F.sum("base").over(every), "turn": F.row_number().over(every.orderBy(F.desc("frac"), "i"))})
    dealt = dealt.withColumn("want", F.col("base") + (F.col("turn") <= F.col("left")).cast("int"))
    dealt = dealt.withColumn("stop", F.sum("want").over(every.orderBy("i").rowsBetween(Window.unboundedPreceding, 0)))
    bounds = dealt.select(F.col("stratum").alias("__st"), "part", (F.col("stop") - F.col("want")).alias("start"), "stop")
    near = F.col("stratum").eqNullSafe(F.col("__st")) & (F.col("rank") >= F.col("start")) & (F.col("rank") < F.col("stop"))
    placed = ranks.join(bounds, near).select(F.col("group").alias("__g"), "part")
    return records.join(placed, F.col(group).cast("string").eqNullSafe(F.col("__g"))).drop("__g")


def k_fold(records: DataFrame, k: int, group: str, stratum: str | None = None, ordinal: str = "ordinal", seed: int = 0) -> DataFrame:
    """records plus fold: the rank in the stratum modulo k. Fold f validates, all others train."""
    if k < 2:
        raise ValidationError("k must be at least 2")
    ranks = group_ranks(records, group, stratum, ordinal, seed).select(F.col("group").alias("__g"), (F.col("rank") % k).cast("int").alias("fold"))
    return records.join(ranks, F.col(group).cast("string").eqNullSafe(F.col("__g"))).drop("__g")


def fold_train(folds: DataFrame, fold: int) -> DataFrame:
    return folds.where(F.col("fold") != fold)


def make_splits(records: DataFrame, group: str, ratios: Mapping[str, float] | None = None, k_folds: int | None = None, **kw) -> DataFrame:
    """Exactly one of ratios and k_folds."""
    if (ratios is None) == (k_folds is None):
        raise ValidationError("give either ratios or k_folds")
    return ratio_split(records, ratios, group, **kw) if ratios is not None else k_fold(records, k_folds, group, **kw)
