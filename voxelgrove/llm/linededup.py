"""Cross-site boilerplate lines, by HyperLogLog sketches of the sites each line is seen on. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import named_aside, set_aside, settle

#: A line on this many distinct sites is boilerplate.
SITES = 10
#: log2 of the registers of a sketch, and the share of the threshold within which the exact count decides:
#: 256 registers have a standard error of 1.04 / 16 = 6.5 %, so half the threshold is over seven of them.
LG_K, MARGIN = 8, 0.5


def line_key(line: Column) -> Column:
    """The 64-bit hash of a trimmed line; null if it has no letter or digit, and so is never boilerplate."""
    return F.when(line.rlike("[\\p{L}\\p{N}]"), F.xxhash64(F.btrim(line, F.lit(" \t\r\x0b\x0c"))))


def occurrences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source") -> DataFrame:
    """(doc_id, row, pos, line, site): each line with a letter or digit. row is a hash of the text, which tells rows of one id apart."""
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("row"), F.col(site_col).alias("site"), F.split(F.col(text_col), "\n", -1).alias("lines"))
    rows = rows.select("doc_id", "row", "site", F.posexplode("lines").alias("pos", "raw"))  # the hash is taken once for a text, below the lines
    return rows.select("doc_id", "row", "pos", line_key(F.col("raw")).alias("line"), "site").where("line is not null")


def line_sketches(seen: DataFrame, lg_k: int = LG_K) -> DataFrame:
    """(line, sites binary, n, first): a mergeable sketch of the sites of each line, its occurrences and the first
    of them by (doc_id, pos, row). Partial sketches are merged on both sides of the shuffle, so a hot line is a few rows."""
    return seen.groupBy("line").agg(F.hll_sketch_agg("site", F.lit(lg_k)).alias("sites"), F.count("*").alias("n"), F.min(F.struct("doc_id", "pos", "row")).alias("first"))


def merge_sketches(*parts: DataFrame) -> DataFrame:
    """The sketches of several loads as those of one."""
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return rows.groupBy("line").agg(F.hll_union_agg("sites").alias("sites"), F.sum("n").alias("n"), F.min("first").alias("first"))


def spread_lines(seen: DataFrame, sketches: DataFrame, sites: int = SITES, margin: float = MARGIN) -> DataFrame:
    """(line, first): lines on `sites` distinct sites or more; the exact count decides where the sketch is near."""
    about = sketches.where(F.col("n") >= sites).select("line", "first", F.hll_sketch_estimate("sites").alias("about"))
    about = settle(about.where(F.col("about") >= sites * (1 - margin)))
    near = about.where(F.col("about") < sites * (1 + margin))
    pairs = seen.join(near.select("line"), "line", "left_semi").groupBy("line", "site").agg(F.lit(1).alias("one"))
    exact = pairs.groupBy("line").agg(F.count("site").alias("k")).where(F.col("k") >= sites)
    sure = about.where(F.col("about") >= sites * (1 + margin))
    return sure.select("line", "first").union(near.join(exact, "line", "left_semi").select("line", "first"))


def remove_boilerplate(docs: DataFrame, sites: int = SITES, margin: float = MARGIN, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source") -> DataFrame:
    """docs with the boilerplate lines taken out of text, plus n_lines and n_removed (long).

    A line (trimmed) seen on `sites` distinct sites or more is removed everywhere but at its first occurrence by
    (id, position), so no content is lost. Every row stays; rows with a null text or id stay as they are (a null
    text has 0 lines); null sites don't count as a site; an empty text is one line. Rows that share an id are told
    apart by their texts: each loses its own lines, and of rows equal in both every one keeps a first occurrence.
    An empty table gives an empty one. Columns named like the added ones are replaced. The work on a text grows with
    its length, whatever the number of its lines and of those that go."""
    docs, back = set_aside(docs.drop("n_lines", "n_removed"))
    id_col, text_col, site_col = named_aside(back, id_col, text_col, site_col)
    seen = settle(occurrences(docs, id_col, text_col, site_col))
    spread = spread_lines(seen, line_sketches(seen), sites, margin)
    gone = seen.join(spread, "line").where(F.struct("doc_id", "pos", "row") != F.col("first"))
    gone = gone.groupBy(F.col("doc_id").alias("__id"), F.col("row").alias("__row")).agg(F.collect_set("pos").alias("__gone"))
    out = docs.join(gone, (F.col(id_col) == F.col("__id")) & (F.xxhash64(text_col) == F.col("__row")), "left")
    lines = F.split(F.col(text_col), "\n", -1)

    def without(held: Column) -> Column:
        """The lines that stay. held is a variable of a lambda, so the text is split once, not once for each line."""
        stay = F.array_except(F.sequence(F.lit(0), F.size(held) - 1), F.col("__gone"))
        return F.array_join(F.transform(stay, lambda i: F.get(held, i)), "\n")

    clean = F.when(F.col("__gone").isNull(), F.col(text_col)).otherwise(F.transform(F.array(lines), without)[0])
    n, k = F.coalesce(F.size(lines), F.lit(0)).cast("long"), F.coalesce(F.size("__gone"), F.lit(0)).cast("long")
    n = F.when(F.col(text_col).isNull(), F.lit(0).cast("long")).otherwise(n)
    k = F.when(F.col("__gone").isNull(), F.lit(0).cast("long")).otherwise(k)
    return out.withColumns({"n_lines": n, "n_removed": k}).withColumn(text_col, clean).drop("__gone", "__id", "__row").withColumnsRenamed(back)
