"""Mixing sources to target weights: a token budget goes down a domain-language-source tree."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import named_aside, set_aside, settle, small

#: Shares of siblings, in whole units; names that aren't listed have DEFAULT.
DOMAIN_WEIGHTS = {"web": 5, "reference": 3, "forum": 2}
LANG_WEIGHTS = {"en": 4, "de": 2, "es": 2, "fr": 2}
DEFAULT_WEIGHT = 1
SEED = 17
#: Buckets of a leaf's seeded order; only the bucket at the end of a prefix is sorted by document.
HEX = 3


def token_count(text: Column) -> Column:
    """The number of words, [^\\x20\\x09-\\x0D]+. Null and texts without words: 0."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def _weight(name: str, weights: Mapping[str, int]) -> Column:
    w = F.lit(DEFAULT_WEIGHT)
    for k, v in weights.items():
        w = F.when(F.col(name) == k, v).otherwise(w)
    return w.cast("long")


def share(level: DataFrame, parent: list[str], name: str, weight: Column) -> DataFrame:
    """level (parent columns, name, cap, budget of the parent) with target: the parent's budget, dealt by weight.

    Who can't take its part gives the rest to its siblings, by weight; only what no sibling can take is left
    (and then went to the parent's siblings before, as cap of a parent is the sum of its children's). Whole
    tokens, rounded down. Weight 0 or less takes nothing."""
    level = level.withColumn("w", weight)
    order = Window.partitionBy(*parent).orderBy(F.when(F.col("w") > 0, F.col("cap") / F.col("w")).asc_nulls_last(), name)
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    after = F.sum(F.greatest("w", F.lit(0))).over(order.rowsBetween(0, Window.unboundedFollowing))
    level = level.withColumns({"rest": F.greatest(F.col("budget") - before, F.lit(0)), "ws": after, "k": F.row_number().over(order)})
    full = (F.col("w") > 0) & (F.col("cap") * F.col("ws") <= F.col("rest") * F.col("w"))
    level = level.withColumn("full", full)
    cut = F.min(F.when(~F.col("full") & (F.col("w") > 0), F.struct("k", "rest", "ws"))).over(Window.partitionBy(*parent))
    level = level.withColumn("cut", cut)
    part = F.expr("cut.rest * w div cut.ws")
    target = F.when(F.col("full"), F.col("cap")).when(F.col("w") > 0, F.least(part, F.col("cap"))).otherwise(0)
    return level.withColumn("target", target.cast("long")).drop("w", "rest", "ws", "k", "full", "cut")


def leaf_targets(leaves: DataFrame, percent: int, epochs: int, domain_weights: Mapping[str, int], lang_weights: Mapping[str, int]) -> DataFrame:
    """leaves (domain, lang, source, tokens) with target: percent of all tokens, dealt down the tree."""
    leaves = leaves.withColumn("cap", F.col("tokens") * epochs)
    langs = leaves.groupBy("domain", "lang").agg(F.sum("cap").alias("cap"), F.sum("tokens").alias("tokens"))
    domains = langs.groupBy("domain").agg(F.sum("cap").alias("cap"), F.sum("tokens").alias("tokens")).withColumn("all", F.lit(0))
    domains = domains.withColumn("budget", F.expr(f"sum(tokens) over (partition by all) * {int(percent)} div 100"))
    domains = share(domains, ["all"], "domain", _weight("domain", domain_weights)).select("domain", F.col("target").alias("budget"))
    langs = share(langs.join(domains, "domain"), ["domain"], "lang", _weight("lang", lang_weights)).select("domain", "lang", F.col("target").alias("budget"))
    return share(leaves.join(langs, ["domain", "lang"]), ["domain", "lang"], "source", F.lit(DEFAULT_WEIGHT).cast("long")).select("domain", "lang", "source", "tokens", "target")


def mix_sources(
    docs: DataFrame, tree: DataFrame, percent: int = 60, epochs: int = 2, seed: int = SEED, domain_weights: Mapping[str, int] = DOMAIN_WEIGHTS, lang_weights: Mapping[str, int] = LANG_WEIGHTS,
    id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
) -> DataFrame:
    """docs plus mix_domain, mix_tokens, mix_target (of the document's leaf) and copies (0 to epochs).

    tree: (source, domain), the domain of each source; sources that it lacks are in the domain `other`, and one that it
    has twice is in the first by name. A leaf's target is whole epochs and a prefix of one more: documents in the order
    of md5(seed:epoch:id), as long as the running sum of tokens stays within the target. Null lang and source are leaves
    named ''. Rows with a null id are given copies of the whole epochs only; rows with one id move together in the order.
    Null texts and texts without words have 0 tokens; an empty table gives an empty one. Columns of the added names are
    replaced. Texts are counted twice (for the plan and for the rows that are given back) and never shuffled: leaf plans
    and the prefix's last buckets are joined to them."""
    docs, back = set_aside(docs.drop("mix_domain", "mix_tokens", "mix_target", "copies"))
    id_col, text_col, lang_col, source_col = named_aside(back, id_col, text_col, lang_col, source_col)
    rows = docs.withColumns({"__l": F.coalesce(lang_col, F.lit("")), "__s": F.coalesce(source_col, F.lit("")), "__n": token_count(F.col(text_col)), "__i": F.col(id_col)})
    on = ["__l", "__s"]
    light = settle(rows.select("__i", "__n", *on))
    domains = tree.where("source is not null and domain is not null").groupBy(F.col("source").alias("__s")).agg(F.min("domain").alias("domain"))
    leaves = light.groupBy(*on).agg(F.sum("__n").alias("tokens")).join(domains, "__s", "left")
    leaves = leaves.select(F.coalesce("domain", F.lit("other")).alias("domain"), F.col("__l").alias("lang"), F.col("__s").alias("source"), "tokens")
    plan = leaf_targets(settle(leaves), percent, epochs, domain_weights, lang_weights)
    plan = plan.select(
        F.col("domain").alias("__d"), F.col("lang").alias("__l"), F.col("source").alias("__s"), F.col("target").alias("__t"),
        F.expr("case when tokens > 0 then target div tokens else 0 end").alias("__e"), F.expr("case when tokens > 0 then target % tokens else 0 end").alias("__r"),
    )
    plan = small(settle(plan))
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.col("__e").cast("string"), F.lit(":"), F.col("__i").cast("string")).cast("binary"))
    bucket = F.substring("__o", 1, HEX)

    def placed(df: DataFrame) -> DataFrame:
        return df.join(plan, on).withColumn("__o", order).withColumn("__b", bucket)

    light = placed(light).where("__i is not null and __r > 0")
    sums = light.groupBy(*on, "__r", "__b").agg(F.sum("__n").alias("n"))
    upto = Window.partitionBy(*on).orderBy("__b")
    sums = sums.withColumn("__end", F.sum("n").over(upto.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    last = sums.where(F.col("__end") > F.col("__r")).groupBy(*on).agg(F.min("__b").alias("__last"), F.min(F.struct("__b", (F.col("__end") - F.col("n")).alias("s")))["s"].alias("__before"))
    last = small(settle(last))
    inner = light.join(last, on).where("__b = __last")
    within = F.sum("__n").over(Window.partitionBy(*on).orderBy("__o").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    inner = inner.withColumn("__fits", F.col("__before") + within <= F.col("__r"))
    inner = inner.groupBy(*on).agg(F.max(F.when(F.col("__fits"), F.col("__o"))).alias("__upto"))
    last = small(settle(last.join(inner, on, "left")))
    out = placed(rows).join(last.select(*on, "__last", "__upto"), on, "left")
    taken = (F.col("__r") > 0) & F.col("__i").isNotNull() & (F.col("__last").isNull() | (F.col("__b") < F.col("__last")) | F.coalesce(F.col("__o") <= F.col("__upto"), F.lit(False)))
    copies = (F.col("__e") + F.when(taken, 1).otherwise(0)).cast("int")
    return out.select(*docs.columns, F.col("__d").alias("mix_domain"), F.col("__n").alias("mix_tokens"), F.col("__t").alias("mix_target"), copies.alias("copies")).withColumnsRenamed(back)
