"""The named queries over the driver's tables, and their DuckDB SQL.

Lineitem's measures stand for the modalities of a sample (an order), embeddings for volumes of 4 x 4 x 4,
documents with labels for a manifest, events for reviews, parts for boxes and geometry."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geometry as geo
from ..operators import boxes, cases, checksum, edit, grids, labels, manifest, patches, records, review, series, split, stats, transforms, validation
from ..session import settle, shared_folder
from ..sources import dicom, nifti, nifti_format, nnunet, samples, tiles

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Registers a function under its name, with the SQL that says the same."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d.rstrip('/')}/{name}.parquet")


MODALITIES = {"quantity": "l_quantity", "extendedprice": "l_extendedprice", "discount": "l_discount", "tax": "l_tax"}
POSITION = ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
_POS = "row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) - 1"
_VOX = "v as (select l_orderkey as sid, l_returnflag = 'R' as fg, unnest(['quantity', 'extendedprice', 'discount', 'tax']) as modality, unnest([l_quantity, l_extendedprice, l_discount, l_tax])::double as v from lineitem)"
_VOXP = f"v as (select sid, pos, unnest(['quantity', 'extendedprice', 'discount', 'tax']) as modality, unnest([l_quantity, l_extendedprice, l_discount, l_tax])::double as v from (select *, l_orderkey as sid, {_POS} as pos from lineitem))"
_STATS = "modality, count(*) as n_voxels, round(avg(v), 6) as mean, round(stddev_pop(v), 6) as std, min(v) as vmin, max(v) as vmax, round(quantile_cont(v, 0.01), 6) as p01, round(quantile_cont(v, 0.99), 6) as p99"


def voxels(spark: SparkSession, d: str, position: bool = False, heads: DataFrame | None = None, together: bool = False) -> DataFrame:
    """heads (sample_id and more columns) are joined to the lines, and with together a sample's lines come to one task, before there is a row for each measure."""
    rows = table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "sample_id")
    keys = ["sample_id", (F.col("l_returnflag") == "R").alias("fg")]
    if position:
        keys.append((F.row_number().over(Window.partitionBy("sample_id").orderBy(*POSITION)) - 1).cast("long").alias("pos"))
    wide, kept = rows.select(*keys, *MODALITIES.values()), ["sample_id", "fg", *(["pos"] if position else [])]
    if together:
        wide = wide.repartition("sample_id")
    if heads is not None:
        wide, kept = wide.join(heads, "sample_id"), kept + [c for c in heads.columns if c != "sample_id"]
    return stats.unpivot(wide, kept, MODALITIES)


def _rounded(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in cols})


def volume_voxels(spark: SparkSession, d: str) -> DataFrame:
    """(sample_id, label, p, c0, c1, c2, value) of the embeddings as 4 x 4 x 4 volumes."""
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("sample_id"), "label", F.posexplode("embedding").alias("p", "value"))
    c = patches.coordinates(F.col("p"), (4, 4, 4))
    return rows.select("sample_id", "label", F.col("p").cast("int").alias("p"), *(x.alias(f"c{a}") for a, x in enumerate(c)), F.col("value").cast("double").alias("value"))


_VOL = "e as (select vec_id, label, (generate_subscripts(embedding, 1) - 1)::int as p, unnest(embedding)::double as v from embeddings), x as (select vec_id, label, p, p // 16 as c0, (p // 4) % 4 as c1, p % 4 as c2, v from e)"


# ---- statistics


@query(f"with {_VOX} select {_STATS} from v where fg group by modality")
def modality_stats_foreground(spark, d):
    """Statistics of each modality inside the mask."""
    return _rounded(stats.modality_stats(stats.foreground(voxels(spark, d), "fg")), "mean", "std", "p01", "p99")


@query(f"with {_VOX} select {_STATS} from v group by modality")
def modality_stats_full(spark, d):
    return _rounded(stats.modality_stats(voxels(spark, d)), "mean", "std", "p01", "p99")


@query(f"with {_VOX}, m as (select o_orderkey as sid, o_orderstatus <> 'F' as has_mask from orders) select {_STATS} from v join m using (sid) where fg or not has_mask group by modality")
def modality_stats_fallback(spark, d):
    """Samples without a mask (orders of status F) count whole; a mask that is there but empty adds nothing."""
    masked = table(spark, d, "orders").select(F.col("o_orderkey").alias("sample_id"), (F.col("o_orderstatus") != "F").alias("has_mask"))
    rows = voxels(spark, d, heads=masked).withColumn("mask", F.when(F.col("has_mask"), F.col("fg")))
    return _rounded(stats.modality_stats(stats.foreground(rows, "mask")), "mean", "std", "p01", "p99")


@query(f"with {_VOX}, m as (select o_orderkey as sid, o_orderstatus <> 'F' and o_orderkey % 5 <> 0 as fits from orders) select {_STATS} from v join m using (sid) where fg or not fits group by modality")
def modality_stats_masked(spark, d):
    """As with modality_stats_fallback, from tables of masks and shapes; masks of every fifth order have another shape than its images."""
    rows = voxels(spark, d, position=True)
    n = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("sample_id")).agg(F.count("*").alias("n")).withColumn("modality", F.explode(F.array(*(F.lit(m) for m in MODALITIES))))
    with_mask = table(spark, d, "orders").where("o_orderstatus <> 'F'").select(F.col("o_orderkey").alias("sample_id"))
    none = F.lit(None).cast("string")
    its = n.where("modality = 'tax'").join(with_mask, "sample_id").select("sample_id", none.alias("modality"), F.lit("m").alias("mask"), F.array(F.col("n") + (F.col("sample_id") % 5 == 0).cast("long")).alias("shape"))
    shapes = n.select("sample_id", "modality", none.alias("mask"), F.array("n").alias("shape")).union(its)
    inside = rows.where("fg and modality = 'tax'").select("sample_id", F.lit("m").alias("mask"), "pos")
    return _rounded(stats.modality_stats(stats.masked(rows, inside, "m", shapes)), "mean", "std", "p01", "p99")


@query(f"with {_VOX} select sid as sample_id, modality, count(*) as n, round(avg(v), 6) as mean, round(sqrt(var_pop(v)), 5) as std, min(v) as vmin, max(v) as vmax from v group by all")
def per_sample_partials(spark, d):
    parts = stats.partials(voxels(spark, d, together=True)).withColumn("std", F.sqrt(F.col("m2") / F.col("n"))).drop("m2")
    return _rounded(_rounded(parts, "mean"), "std", digits=5)


@query(f"with {_VOX} select modality, count(*) as n_voxels, round(avg(v), 5) as mean, round(stddev_pop(v), 5) as std from v group by modality")
def chan_merge_check(spark, d):
    """Merged per-sample partials against the plain statistics."""
    return _rounded(stats.merge(stats.partials(voxels(spark, d, together=True))), "mean", "std", digits=5).select("modality", "n_voxels", "mean", "std")


@query("select quality::varchar as label, count(*) as n from documents d join labels l on d.doc_id = l.doc_id where quality is not null group by 1")
def label_counts(spark, d):
    rows = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left")
    return stats.label_counts(rows, "quality")


@query("select '(' || n || ',)' as shape_key, count(*) as n from (select l_orderkey, count(*) as n from lineitem group by 1) group by 1")
def shape_histogram(spark, d):
    rows = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array(F.count("*")).alias("shape"))
    return stats.shape_histogram(rows)


@query("select mask, round(avg(s), 6) as coverage from (select l_orderkey, 'R' as mask, avg((l_returnflag = 'R')::int) as s from lineitem group by 1 union all select l_orderkey, 'O' as mask, avg((l_linestatus = 'O')::int) as s from lineitem group by 1) group by mask")
def seg_coverage(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("sample_id"), F.expr("stack(2, 'R', l_returnflag = 'R', 'O', l_linestatus = 'O') as (mask, inside)"))
    return _rounded(stats.seg_coverage(rows), "coverage")


@query(f"with {_VOXP} select sid as sample_id, pos from (select sid, pos, row_number() over (partition by sid order by md5(sid || ':' || pos), pos) as k from v where modality = 'quantity') where k <= 3")
def sample_cap(spark, d):
    rows = voxels(spark, d, True).where("modality = 'quantity'")
    key = F.md5(F.concat_ws(":", F.col("sample_id").cast("string"), F.col("pos").cast("string")).cast("binary"))
    return stats.sample_cap(rows, 3, F.struct(key, "pos")).select("sample_id", "pos")


_DRAWN = """pl as (select sid, modality, pos, v, row_number() over (partition by sid, modality order by pos) - 1 as place from v),
s as (select sid, modality, count(*) as n from v group by all having count(*) > 3),
dr as (select sid, modality, ('0x' || substr(md5('0:' || sid || ':' || modality || ':' || i), 1, 15))::bigint % n as place, count(*) as weight from s, range(3) r(i) group by all),
po as (select pl.sid, pl.modality, pos, v, coalesce(weight, 1) as weight from pl left join dr using (sid, modality, place) where weight is not null or (pl.sid, pl.modality) not in (select (sid, modality) from s))"""


@query(f"with {_VOXP}, {_DRAWN} select sid as sample_id, modality, pos, weight from po")
def sample_replacement(spark, d):
    """Three draws with replacement from each order and measure with more lines, all lines of the others."""
    return stats.sample_with_replacement(voxels(spark, d, True), 3).select("sample_id", "modality", "pos", "weight")


@query(f"""with {_VOXP}, {_DRAWN}, q as (select modality, quantile_cont(v, 0.01) as p01, quantile_cont(v, 0.99) as p99 from (select modality, v, unnest(range(weight)) from po) group by modality)
select modality, count(*) as n_voxels, round(avg(v), 5) as mean, round(stddev_pop(v), 5) as std, min(v) as vmin, max(v) as vmax, round(any_value(p01), 6) as p01, round(any_value(p99), 6) as p99 from v join q using (modality) group by modality""")
def modality_stats_capped(spark, d):
    """Statistics of all voxels, percentiles of a pool in which no order counts for more than three."""
    rows = voxels(spark, d, True)
    out = stats.compute_stats(table(spark, d, "orders").select(F.lit(None).cast("string").alias("label"), F.array(F.lit(1)).alias("shape")), rows, cap=3)["modalities"]
    return _rounded(_rounded(out, "mean", "std", digits=5), "p01", "p99")


@query("select count(*) as n_files from documents")
def n_files(spark, d):
    return stats.compute_stats(table(spark, d, "documents").select("doc_id", F.lit("").alias("label"), F.array("n_chars").alias("shape")), voxels(spark, d))["n_files"]


# ---- manifest


@query("select d.doc_id from documents d join labels l on d.doc_id = l.doc_id where l.quality = 1 and d.lang = 'en' and d.n_chars >= 500")
def manifest_filter(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "lang", "n_chars").join(table(spark, d, "labels"), "doc_id", "left")
    keep = (F.col("quality") == 1) & (F.col("lang") == "en") & (F.col("n_chars") >= 500)
    return manifest.filter_records(rows, keep).select("doc_id")


@query("select k::bigint as k, count(*) as n from (select json_extract_string(props, '$.k') as k from events) group by 1")
def manifest_extra_lookup(spark, d):
    return table(spark, d, "events").groupBy(manifest.lookup("props", "k").cast("long").alias("k")).agg(F.count("*").alias("n"))


@query("select d.doc_id, case when toxic = 1 then 'flagged' when quality = 1 then 'reviewed' else 'pending' end as status from documents d left join labels l on d.doc_id = l.doc_id")
def review_status_default(spark, d):
    rows = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left")
    said = F.when(F.col("toxic") == 1, "flagged").when(F.col("quality") == 1, "reviewed")
    extra = F.when(F.col("quality").isNull(), F.lit('{"review": 3}')).otherwise(F.to_json(F.struct(F.struct(F.coalesce(said, F.lit("")).alias("status")).alias("review"))))
    return rows.select("doc_id", manifest.review_status(extra).alias("status"))


@query("select o_orderkey as id, case when o_orderkey % 7 = 0 then 'missing' when o_orderkey % 5 = 0 then 'o_totalprice' when o_orderkey % 11 = 0 then 'o_orderdate' end as why from orders where o_orderkey % 7 = 0 or o_orderkey % 5 = 0 or o_orderkey % 11 = 0")
def manifest_stale(spark, d):
    """The orders against a later listing of them, in which some are gone and some differ."""
    rows, k = table(spark, d, "orders"), F.col("o_orderkey")
    now = rows.where(k % 7 != 0).withColumn("o_totalprice", F.when(k % 5 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    now = now.withColumn("o_orderdate", F.when(k % 11 == 0, F.col("o_orderdate") + F.expr("interval 1 day")).otherwise(F.col("o_orderdate")))
    return manifest.stale(rows, now, "o_orderkey", ("o_totalprice", "o_orderdate")).withColumnRenamed("o_orderkey", "id")


@query("select max(n)::bigint as n, count(*) as parts from (select count(*) over (partition by lang) as n from documents)")
def manifest_summary(spark, d):
    rows = table(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n"))
    return rows.agg(F.max("n").alias("n"), F.sum("n").alias("parts"))


_RANK = "g as (select source as grp, arg_min(lang, doc_id) as st from documents group by 1), r as (select *, row_number() over (partition by st order by sha256('3:' || grp), grp) - 1 as rank, count(*) over (partition by st) as n from g)"


@query(f"""with {_RANK}, s as (select distinct st, n from r), p as (select st, n, unnest([0, 1, 2]) as i, unnest(['train', 'val', 'test']) as part, round(unnest([0.7::double, 0.15::double, 0.15::double]) * n, 9) as raw from s),
q as (select *, floor(raw) as base, round(raw - floor(raw), 9) as frac from p), t as (select *, n - sum(base) over (partition by st) as lft, row_number() over (partition by st order by frac desc, i) as turn from q),
u as (select *, base + case when turn <= lft then 1 else 0 end as want from t), w as (select *, sum(want) over (partition by st order by i rows unbounded preceding) as stop from u)
select d.doc_id, w.part from documents d join r on d.source = r.grp join w on w.st = r.st and r.rank >= w.stop - w.want and r.rank < w.stop""")
def split_ratio_grouped_stratified(spark, d):
    """70/15/15 of the sources, balanced by language; no source is in two parts."""
    rows = table(spark, d, "documents").select("doc_id", "source", "lang")
    return split.ratio_split(rows, {"train": 0.7, "val": 0.15, "test": 0.15}, "source", "lang", "doc_id", 3).select("doc_id", "part")


@query("with r as (select doc_id, lang, row_number() over (partition by lang order by sha256('3:' || doc_id), doc_id::varchar) - 1 as rank from documents) select lang, (rank % 5)::int as fold, count(*) as n from r group by all")
def split_kfold(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "lang")
    return split.k_fold(rows, 5, "doc_id", "lang", "doc_id", 3).groupBy("lang", "fold").agg(F.count("*").alias("n"))


@query("with r as (select doc_id, lang, row_number() over (partition by lang order by sha256('3:' || doc_id), doc_id::varchar) - 1 as rank from documents) select doc_id from r where rank % 5 <> 2")
def split_fold_train(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "lang")
    return split.fold_train(split.k_fold(rows, 5, "doc_id", "lang", "doc_id", 3), 2).select("doc_id")


# ---- patches and boxes


@query(f"with {_VOL} select label, c0 as z, count(*) as n, round(avg(v), 6) as m from x where c0 >= 1 and c0 < 3 and c1 >= 0 and c1 < 2 and c2 >= 1 and c2 < 4 group by label, c0")
def patch_slice(spark, d):
    rows = patches.slice_volume(volume_voxels(spark, d), (1, 0, 1), (3, 2, 4))
    return rows.groupBy("label", F.col("c0").alias("z")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("m"))


@query(f"""with {_VOL}, g as (select vec_id, label, k, ((vec_id + 3 * k) % 4 - 1)::int as s0, ((vec_id // 4) % 5)::int as s1, ((vec_id + k) % 3)::int as s2 from embeddings, range(2) r(k)),
p as (select *, i // 6 as d0, i // 2 % 3 as d1, i % 2 as d2 from g, range(18) q(i))
select p.vec_id, k::int as patch, n.name, i::int as i, round(coalesce(case n.name when 'v' then v when 'mask' then (v > 0)::int::double end, case n.name when 'v' then -1 else 0 end), 6) as value
from p cross join (values ('v'), ('mask')) n(name) left join x on x.vec_id = p.vec_id and c0 = s0 + d0 and c1 = s1 + d1 and c2 = s2 + d2""")
def patch_tiles(spark, d):
    """Two patches of 3 x 3 x 2 of every volume and its mask, some of them over the edges, read from written tiles of 2 x 3 x 2."""
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("sample_id"), F.array(F.lit(4), F.lit(4), F.lit(4)).alias("shape"), "embedding")
    path = _scratch(spark)
    images = rows.select("sample_id", F.lit("v").alias("modality"), "shape", F.col("embedding").alias("data"))
    masks = rows.select("sample_id", F.lit("mask").alias("modality"), "shape", F.transform("embedding", lambda x: x > 0).alias("data"))
    tiles.write(tiles.cut(images, 2, (2, 3, 2)).unionByName(tiles.cut(masks, 2, (2, 3, 2))), path)
    at = table(spark, d, "embeddings").select("vec_id", F.explode(F.sequence(F.lit(0), F.lit(1))).alias("patch"))
    v, k = F.col("vec_id"), F.col("patch")
    start = F.array(((v + 3 * k) % 4 - 1).cast("int"), (F.floor(v / 4) % 5).cast("int"), ((v + k) % 3).cast("int"))
    starts = at.select(v.alias("sample_id"), "patch", start.alias("start"), F.array(F.lit(3), F.lit(3), F.lit(2)).alias("size"))
    out = tiles.numbers(tiles.patches(spark.read.parquet(path), starts, 3, -1.0))
    return out.select(F.col("sample_id").alias("vec_id"), "patch", "name", F.posexplode("data").alias("i", "value")).withColumn("value", F.round("value", 6))


@query(f"with {_VOL}, g as (select vec_id, z, y, w from embeddings, range(5) a(z), range(5) b(y), range(4) c(w)) select g.vec_id, z::int as z, y::int as y, w::int as x, round(coalesce(v, -1), 6) as v from g left join x on x.vec_id = g.vec_id and c0 = z and c1 = y and c2 = w")
def patch_pad(spark, d):
    rows = volume_voxels(spark, d)
    out = patches.pad(rows, table(spark, d, "embeddings").select(F.col("vec_id").alias("sample_id")), (5, 5, 4), -1)
    return out.select(F.col("sample_id").alias("vec_id"), F.col("c0").alias("z"), F.col("c1").alias("y"), F.col("c2").alias("x"), F.round("value", 6).alias("v"))


def _u(a: int | str) -> str:
    return f"(('0x' || substr(md5('9:' || vec_id || ':{a}'), 1, 13))::bigint::double / {1 << 52}::double)"


_UNI = ", ".join(f"floor({_u(a)} * 3)::int as u{a}" for a in range(3))
_FG = f"{_VOL}, h as (select vec_id, arg_min([c0, c1, c2], md5('9:' || vec_id || ':' || c0 || ':' || c1 || ':' || c2)) as c from x where v > 0 group by vec_id), f as (select vec_id, " + ", ".join(f"least(greatest(c[{a + 1}] - 1, 0), 2)::int as f{a}" for a in range(3)) + " from h)"


def _starts(spark, d, strategy):
    rows = volume_voxels(spark, d)
    out = patches.starts(table(spark, d, "embeddings").select(F.col("vec_id").alias("sample_id")), rows.where("value > 0"), (4, 4, 4), (2, 2, 2), 9, strategy)
    return out.withColumnRenamed("sample_id", "vec_id")


@query(f"select vec_id, u0 as s0, u1 as s1, u2 as s2 from (select vec_id, {_UNI} from embeddings)")
def patch_start_uniform(spark, d):
    return _starts(spark, d, "uniform")


@query(f"with {_FG} select e.vec_id, coalesce(f0, u0) as s0, coalesce(f1, u1) as s1, coalesce(f2, u2) as s2 from (select vec_id, {_UNI} from embeddings) e left join f on e.vec_id = f.vec_id")
def patch_start_foreground(spark, d):
    return _starts(spark, d, "foreground")


@query(f"with {_FG} select e.vec_id, " + ", ".join(f"case when b < 0.5 then coalesce(f{a}, u{a}) else u{a} end as s{a}" for a in range(3)) + f" from (select vec_id, {_u('balanced')} as b, {_UNI} from embeddings) e left join f on e.vec_id = f.vec_id")
def patch_start_balanced(spark, d):
    return _starts(spark, d, "balanced")


@query("select vec_id, k * (select count(*) from embeddings) + vec_id as idx from embeddings, range(3) t(k)")
def patch_oversample(spark, d):
    rows = table(spark, d, "embeddings").select("vec_id", F.col("vec_id").alias("ordinal"))
    return patches.oversample(rows, 3).select("vec_id", "idx")


def part_boxes(spark, d):
    s, k = F.col("p_size"), F.col("p_partkey")
    lo = F.array((s - 3).cast("long"), k % 40, (s % 9).cast("long"))
    hi = F.array((s + 4).cast("long"), k % 40 + k % 13 - 2, (s % 9 + s % 5).cast("long"))
    return table(spark, d, "part").select(k.alias("box_id"), (k % 100).alias("sample_id"), lo.alias("lo"), hi.alias("hi"))


_BOX = "b as (select p_partkey as box_id, p_partkey % 100 as sample_id, [p_size - 3, p_partkey % 40, p_size % 9] as lo, [p_size + 4, p_partkey % 40 + p_partkey % 13 - 2, p_size % 9 + p_size % 5] as hi from part)"
_CLAMP = f"""{_BOX}, c as (select box_id, list_transform(lo, lambda x: greatest(x, 0)) as l, [least(hi[1], 50), least(hi[2], 45), least(hi[3], 8)] as h, len(list_filter(lo, lambda x: x < 0)) > 0 as i1, hi[1] > 50 or hi[2] > 45 or hi[3] > 8 as i2 from b),
i as (select box_id, l, h, concat_ws(';', case when i1 then 'min_below_zero' end, case when i2 then 'max_above_shape' end, case when l[1] > h[1] or l[2] > h[2] or l[3] > h[3] then 'min_above_max' end) as issues from c)"""


@query(f"with {_CLAMP} select box_id, issues, " + ", ".join(f"least(l[{a + 1}], h[{a + 1}])::bigint as lo{a}, greatest(l[{a + 1}], h[{a + 1}])::bigint as hi{a}" for a in range(3)) + " from i")
def bbox_clamp(spark, d):
    out = boxes.clamp(part_boxes(spark, d), (50, 45, 8))
    return out.select("box_id", "issues", *(F.get(c, F.lit(a)).alias(f"{c}{a}") for a in range(3) for c in ("lo", "hi")))


@query(f"with {_CLAMP} select issues, count(*) as n from i group by issues")
def bbox_issue_counts(spark, d):
    return boxes.clamp(part_boxes(spark, d), (50, 45, 8)).groupBy("issues").agg(F.count("*").alias("n"))


@query(f"""with {_BOX}, p as (select distinct sample_id, [sample_id % 30, sample_id % 20, sample_id % 3] as st from b), j as (select box_id, st, lo, hi from b join p using (sample_id))
select box_id, """ + ", ".join(f"(lo[{a}] - st[{a}])::bigint as lo{a - 1}, (hi[{a}] - st[{a}])::bigint as hi{a - 1}" for a in (1, 2, 3)) + " from j where " + " and ".join(f"hi[{a}] - st[{a}] >= 0 and lo[{a}] - st[{a}] < {p}" for a, p in ((1, 16), (2, 16), (3, 4))))
def patch_boxes(spark, d):
    s = F.col("sample_id")
    where = part_boxes(spark, d).select("sample_id").distinct().select("sample_id", F.array(s % 30, s % 20, s % 3).alias("start"))
    out = boxes.in_patches(part_boxes(spark, d), where, (16, 16, 4))
    return out.select("box_id", *(F.get(c, F.lit(a)).alias(f"{c}{a}") for a in range(3) for c in ("lo", "hi")))


@query("""with b as (select p_partkey as box_id, p_partkey // 50 as sample_id, [p_partkey * 37 % 480, p_partkey * 91 % 470, p_partkey * 13 % 60] as lo, p_size * case when p_partkey % 17 = 0 then 8 else 1 end as n from part),
e as (select box_id, sample_id, lo, [lo[1] + n, lo[2] + n - 5, lo[3] + n // 4] as hi from b),
p as (select sample_id, k::int as patch, [k * 53 % 450, k * 29 % 450, k * 7 % 40] as st from (select distinct sample_id from b), range(100) r(k))
select box_id, patch, """ + ", ".join(f"(lo[{a}] - st[{a}])::bigint as lo{a - 1}, (hi[{a}] - st[{a}])::bigint as hi{a - 1}" for a in (1, 2, 3)) + " from e join p using (sample_id) where " + " and ".join(f"hi[{a}] - st[{a}] >= 0 and lo[{a}] - st[{a}] < {p}" for a, p in ((1, 64), (2, 48), (3, 16))))
def boxes_touching_patches(spark, d):
    """A hundred patches of each sample and the boxes that they touch, large and small ones, some with ends the wrong way round."""
    k, s = F.col("p_partkey").cast("long"), F.col("p_size").cast("long")
    rows = table(spark, d, "part").select(k.alias("box_id"), F.floor(k / 50).alias("sample_id"), F.array(k * 37 % 480, k * 91 % 470, k * 13 % 60).alias("lo"), (s * F.when(k % 17 == 0, 8).otherwise(1)).alias("n"))
    at = lambda i: F.get("lo", F.lit(i))
    rows = rows.withColumn("hi", F.array(at(0) + F.col("n"), at(1) + F.col("n") - 5, at(2) + F.floor(F.col("n") / 4))).drop("n")
    q = F.col("patch")
    where = rows.select("sample_id").distinct().withColumn("patch", F.explode(F.sequence(F.lit(0), F.lit(99)))).withColumn("start", F.array(q * 53 % 450, q * 29 % 450, q * 7 % 40))
    out = boxes.touching(rows, where, (64, 48, 16))
    return out.select("box_id", "patch", *(F.get(c, F.lit(a)).alias(f"{c}{a}") for a in range(3) for c in ("lo", "hi")))


@query(f"with {_BOX} select box_id, 59 - hi[1] as lo0, 59 - lo[1] as hi0, lo[2] as lo1, hi[2] as hi1, 19 - hi[3] as lo2, 19 - lo[3] as hi2 from b")
def flip_boxes(spark, d):
    lo, hi = boxes.flip(F.col("lo"), F.col("hi"), (60, 60, 20), (0, 2))
    rows = part_boxes(spark, d).select("box_id", lo.alias("lo"), hi.alias("hi"))
    return rows.select("box_id", *(F.get(c, F.lit(a)).cast("long").alias(f"{c}{a}") for a in range(3) for c in ("lo", "hi")))


# ---- transforms


@query(f"with {_VOXP} select sid as sample_id, pos, modality, case when modality = 'quantity' then least(greatest(v, 10), 40) else v end as value from v")
def clip(spark, d):
    return transforms.clip(voxels(spark, d, True), 10, 40, ["quantity"]).select("sample_id", "pos", "modality", "value")


@query(f"with {_VOXP} select sid as sample_id, pos, modality, round((case modality when 'quantity' then (v::float - 25::float) / 14::float when 'discount' then (v::float - 0.05::float) / 0.03::float else v::float end)::double, 4) as value from v")
def normalize(spark, d):
    out = transforms.normalize(voxels(spark, d, True), {"quantity": 25.0, "discount": 0.05, "tax": 1.0}, {"quantity": 14.0, "discount": 0.03, "tax": 0.0})
    return out.select("sample_id", "pos", "modality", F.round(F.col("value").cast("double"), 4).alias("value"))


@query(f"with {_VOXP} select sid as sample_id, pos, modality, round((v - avg(v) over w) / (stddev_pop(v) over w + 1e-6), 4) + 0.0 as value from v where modality in ('quantity', 'discount') window w as (partition by sid, modality)")
def zscore(spark, d):
    rows = voxels(spark, d, True).where(F.col("modality").isin("quantity", "discount"))
    return transforms.zscore(rows).select("sample_id", "pos", "modality", (F.round("value", 4) + F.lit(0.0)).alias("value"))


@query(f"with {_VOL} select vec_id, ((3 - c0) * 16 + c1 * 4 + 3 - c2)::int as vpos, round(v, 6) as x from x")
def flip_voxels(spark, d):
    out = transforms.flip_voxels(volume_voxels(spark, d), (4, 4, 4), (0, 2))
    return out.select(F.col("sample_id").alias("vec_id"), (F.col("c0") * 16 + F.col("c1") * 4 + F.col("c2")).cast("int").alias("vpos"), F.round("value", 6).alias("x"))


@query(f"with {_VOXP} select sid as sample_id, pos, round(((least(greatest(v, 10), 40)::float - 25::float) / 14::float)::double, 4) as value from v where modality = 'quantity'")
def compose_pipeline(spark, d):
    steps = transforms.compose(lambda x: x.where("modality = 'quantity'"), lambda x: transforms.clip(x, 10, 40), lambda x: transforms.normalize(x, 25.0, 14.0))
    return voxels(spark, d, True).transform(steps).select("sample_id", "pos", F.round(F.col("value").cast("double"), 4).alias("value"))


@query("select p_partkey as id, round(p_size * 2.0 + 1, 6) as v from part")
def modality_lut(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.round(transforms.apply_lut(F.col("p_size").cast("double"), 2.0, 1.0), 6).alias("v"))


# ---- geometry


def part_geometry(spark, d):
    """Spacing, origin and a rotation about the last axis, from a part's numbers."""
    s, k = F.col("p_size").cast("double"), F.col("p_partkey").cast("double")
    t = s / 10
    arr = lambda *x: F.array(*(F.lit(y).cast("double") if isinstance(y, float) else y for y in x))
    direction = F.array(arr(F.cos(t), -F.sin(t), 0.0), arr(F.sin(t), F.cos(t), 0.0), arr(0.0, 0.0, 1.0))
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), arr(s / 4, s / 8, 2.5).alias("spacing"), arr(k, s, -k).alias("origin"), direction.alias("direction"))


_GEO = "g as (select p_partkey as id, [p_size / 4.0::double, p_size / 8.0::double, 2.5::double] as sp, [p_partkey::double, p_size::double, -p_partkey::double] as og, cos(p_size / 10.0::double) as c, sin(p_size / 10.0::double) as s from part)"
_MAT = f"{_GEO}, m as (select id, sp, og, c, s, [[c * sp[1], -s * sp[2], 0, og[1]], [s * sp[1], c * sp[2], 0, og[2]], [0, 0, sp[3], og[3]], [0, 0, 0, 1]] as a from g)"


@query(f"with {_MAT} select id, (r - 1)::int as r, (k - 1)::int as c, round(a[r][k], 6) + 0.0 as v from m, range(1, 5) x(r), range(1, 5) y(k)")
def affine_compose(spark, d):
    rows = part_geometry(spark, d).select("id", F.posexplode(geo.affine(F.col("spacing"), F.col("origin"), F.col("direction"))).alias("r", "row"))
    return rows.select("id", "r", F.posexplode("row").alias("c", "v")).select("id", "r", "c", (F.round("v", 6) + F.lit(0.0)).alias("v"))


@query(f"with {_GEO}, t as (select *, [[c, -s, 0], [s, c, 0], [0, 0, 1]] as m from g) select id, (i - 1)::int as i, round(sp[i], 6) as spacing, round(og[i], 6) + 0.0 as origin, " + ", ".join(f"round(m[i][{k + 1}], 6) + 0.0 as d{k}" for k in range(3)) + " from t, range(1, 4) x(i)")
def affine_decompose(spark, d):
    got = geo.decompose(F.col("m"))
    rows = part_geometry(spark, d).select("id", geo.affine(F.col("spacing"), F.col("origin"), F.col("direction")).alias("m"))
    rows = rows.select("id", got["spacing"].alias("s"), got["origin"].alias("o"), got["direction"].alias("d"))
    rows = rows.select("id", F.posexplode(F.arrays_zip("s", "o", "d")).alias("i", "x"))
    z = lambda c: F.round(c, 6) + F.lit(0.0)
    return rows.select("id", "i", F.round("x.s", 6).alias("spacing"), z(F.col("x.o")).alias("origin"), *(z(F.get("x.d", F.lit(k))).alias(f"d{k}") for k in range(3)))


@query(f"with {_GEO} select id, round(og[1] + c * sp[1] * 3 + 0 * sp[3] * 5, 6) + 0.0 as o0, round(og[2] + s * sp[1] * 3, 6) + 0.0 as o1, round(og[3] + sp[3] * 5, 6) + 0.0 as o2, round(-c, 6) + 0.0 as d00, round(-s, 6) + 0.0 as d01, round(-s, 6) + 0.0 as d10m, -1.0::double as d22 from g")
def flip_geometry(spark, d):
    o, m = geo.flip_geometry(F.col("spacing"), F.col("origin"), F.col("direction"), [4, 5, 6], [0, 2])
    rows = part_geometry(spark, d).select("id", o.alias("o"), m.alias("m"))
    z = lambda c: F.round(c, 6) + F.lit(0.0)
    at = lambda r, c: F.get(F.get("m", r), c)
    return rows.select("id", *(z(F.get("o", F.lit(a))).alias(f"o{a}") for a in range(3)), z(at(F.lit(0), F.lit(0))).alias("d00"), z(at(F.lit(0), F.lit(1))).alias("d01"), z(at(F.lit(1), F.lit(0))).alias("d10m"), z(at(F.lit(2), F.lit(2))).alias("d22"))


@query("select p_partkey as id, not (p_partkey % 3 = 1) as same_grid from part")
def grid_equality(spark, d):
    """Each grid against itself, moved by less than the tolerance or, for every third part, by more."""
    rows = part_geometry(spark, d).withColumn("m", F.flatten(geo.affine(F.col("spacing"), F.col("origin"), F.col("direction"))))
    step = F.when(F.col("id") % 3 == 1, 0.01 + F.abs(F.get("origin", F.lit(0))) * 1e-4).when(F.col("id") % 3 == 2, 1e-6).otherwise(0.0)
    other = F.transform("m", lambda x: x + step)
    return rows.select("id", geo.all_close(other, F.col("m")).alias("same_grid"))


@query(f"with {_GEO}, t as (select id, og, s * sin(id / 20.0::double) as x, -c * sin(id / 20.0::double) as y, cos(id / 20.0::double) as z from g) select id, round(x, 6) + 0.0 as nx, round(y, 6) + 0.0 as ny, round(z, 6) + 0.0 as nz, round(og[1] * x + og[2] * y + og[3] * z, 4) + 0.0 as pos from t")
def orientation_normal(spark, d):
    """Normals of slices that are tilted about their rotated rows, from row and column directions of any length."""
    tilt = F.col("id") / F.lit(20.0)
    part_of = lambda r, c: F.get(F.get("direction", F.lit(r)), F.lit(c))
    row = F.array(*(part_of(r, 0) * 3.0 for r in range(3)))
    col = F.array(*(part_of(r, 1) * F.cos(tilt) * 2.0 for r in range(2)), F.sin(tilt) * 2.0)
    rows = part_geometry(spark, d).select("id", "origin", geo.slice_normal(row, col).alias("n"))
    z = lambda c, k=6: F.round(c, k) + F.lit(0.0)
    return rows.select("id", *(z(F.get("n", F.lit(a))).alias(c) for a, c in enumerate(("nx", "ny", "nz"))), z(geo.slice_position(F.col("origin"), F.col("n")), 4).alias("pos"))


# ---- labels, cases, series


_DECLARED = {"A": 1, "N": 2, "R": 3}


def label_volume(spark, d):
    rows = table(spark, d, "lineitem")
    lab = F.when(F.col("l_linestatus") == "O", 0).when(F.col("l_returnflag") == "A", 1).when(F.col("l_returnflag") == "N", 2).otherwise(3)
    pos = (F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*POSITION)) - 1).cast("long")
    return rows.select(F.col("l_orderkey").alias("sample_id"), pos.alias("pos"), lab.cast("double").alias("value"))


_LAB = f"lab as (select l_orderkey as sample_id, {_POS} as pos, case when l_linestatus = 'O' then 0 when l_returnflag = 'A' then 1 when l_returnflag = 'N' then 2 else 3 end as v, l_returnflag, l_linestatus from lineitem)"


@query(f"with {_LAB} select sample_id, pos, case v when 1 then 'A' when 2 then 'N' else 'R' end as mask from lab where v > 0")
def label_split(spark, d):
    return labels.split_labels(label_volume(spark, d), _DECLARED)


@query(f"with {_LAB} select sample_id, pos, greatest(case when l_returnflag = 'R' then 1 else 0 end, case when l_linestatus = 'F' then 2 else 0 end)::int as lab from lab")
def label_merge(spark, d):
    """Overlapping masks R (1) and F (2): the larger value wins."""
    rows = table(spark, d, "lineitem")
    pos = (F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*POSITION)) - 1).cast("long")
    rows = rows.select(F.col("l_orderkey").alias("sample_id"), pos.alias("pos"), "l_returnflag", "l_linestatus")
    rows = rows.select("sample_id", "pos", F.expr("stack(2, 'R', l_returnflag = 'R', 'F', l_linestatus = 'F') as (mask, inside)"))
    return labels.merge_labels(rows, {"R": 1, "F": 2})


@query(f"with {_LAB} select v::double as value from lab where v > 2 group by v")
def label_undeclared(spark, d):
    return labels.undeclared(label_volume(spark, d), {"background": 0, "A": 1, "N": 2})


@query("select conv_id as case_id, count(distinct turn) as n from conversations where turn < 9999 group by 1")
def case_discovery(spark, d):
    files = table(spark, d, "conversations").select(cases.channel_name(F.col("conv_id"), F.col("turn")).alias("name"))
    found = cases.discover(cases.case_files(files))
    return found.where("missing = '' and extra = '' and duplicates = 0").select(F.col("case_id").cast("long").alias("case_id"), "n")


@query("select o_orderkey as case_id, o_custkey * 13 as channel, o_orderkey || '_' || lpad((o_custkey * 13)::varchar, greatest(4, length((o_custkey * 13)::varchar))::int, '0') || '.nii.gz' as name from orders")
def case_channel_names(spark, d):
    """Names of channels below and beyond 9999: no two channels of a case share one."""
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("case_id"), (F.col("o_custkey") * 13).alias("channel"))
    return rows.withColumn("name", cases.channel_name(F.col("case_id"), F.col("channel")))


@query("""with f as (select conv_id, turn from conversations where not (conv_id % 5 = 0 and turn = 1) union all select conv_id, turn from conversations where conv_id % 7 = 0 and turn = 0),
g as (select conv_id, count(*) as files, list_sort(list(distinct turn)) as have from f group by 1)
select conv_id as case_id, len(have)::bigint as n, (files - len(have))::bigint as duplicates, array_to_string(list_filter(range(0, 2), lambda x: not list_contains(have, x)), ',') as missing, array_to_string(list_filter(have, lambda x: x > 1), ',') as extra from g""")
def case_errors(spark, d):
    """Cases of two channels, with some channels taken out and some doubled."""
    rows = table(spark, d, "conversations").select("conv_id", "turn")
    rows = rows.where(~((F.col("conv_id") % 5 == 0) & (F.col("turn") == 1))).union(rows.where("conv_id % 7 = 0 and turn = 0"))
    files = cases.case_files(rows.select(cases.channel_name(F.col("conv_id"), F.col("turn")).alias("name")))
    return cases.discover(files, channels=2).withColumn("case_id", F.col("case_id").cast("long"))


@query("select l_suppkey::varchar as uid, count(*) as n from lineitem group by 1 order by n desc, uid limit 1")
def series_argmax(spark, d):
    return cases.largest_series(table(spark, d, "lineitem"), "l_suppkey")


@query("""with g as (select l_orderkey as sample_id, l_linenumber * 1.5::double as p, l_linenumber * 1.5::double - lag(l_linenumber * 1.5::double) over (partition by l_orderkey order by l_linenumber) as gap from lineitem),
a as (select sample_id, count(*) as n, arg_min(gap, p) filter (gap is not null) as fg, min(gap) as g0, max(gap) as g1 from g group by 1)
select sample_id, n, g0, g1, case when n = 1 then 'single' when g0 <= 1e-5 then 'duplicate' when abs(g0 - g1) <= 1e-3 then 'ok' else 'uneven' end as status from a""")
def slice_spacing_check(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("sample_id"), (F.col("l_linenumber") * 1.5).alias("p"))
    out = cases.slice_spacing(rows, "sample_id", "p")
    gap = rows.withColumn("gap", F.col("p") - F.lag("p").over(Window.partitionBy("sample_id").orderBy("p"))).groupBy("sample_id").agg(F.min("gap").alias("g0"), F.max("gap").alias("g1"))
    return out.join(gap, "sample_id").select("sample_id", "n", "g0", "g1", "status")


@query(f"with {_VOL} select vec_id, (z * 4 + y * 2 + w)::int as idx, round(v, 6) as v from x join (select z, y, w, z * 2 as a, y * 2 as b, w * 2 as c from range(2) p(z), range(2) q(y), range(2) r(w)) on c0 = a and c1 = b and c2 = c")
def resample_nearest(spark, d):
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("sample_id"), F.col("embedding").alias("data"))
    out = labels.resample(rows, (4, 4, 4), (2, 2, 2), (2, 2, 2), "nearest")
    return out.select(F.col("sample_id").alias("vec_id"), F.posexplode("data").alias("idx", "v")).withColumn("v", F.round("v", 6))


def _linear_volumes(spark, d):
    """(vec_id, i, v): the embeddings as 4 x 4 x 4 volumes on a grid of 7 x 7 x 7, half-way points between all neighbours."""
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("sample_id"), F.col("embedding").alias("data"))
    out = labels.resample(rows, (4, 4, 4), (7, 7, 7), (0.5, 0.5, 0.5), "linear")
    return out.select(F.col("sample_id").alias("vec_id"), F.posexplode("data").alias("i", "v"))


@query(f"with {_VOL}, g as (select c, k from range(7) r(c), range(2) u(k)) select vec_id, (c0 * 28 + c1 * 7 + c)::int as idx, round(avg(v), 6) + 0.0 as v from x join g on c2 = (c + k) // 2 group by vec_id, c0, c1, c")
def resample_linear(spark, d):
    """Every point of whole volumes at twice the density of the last axis."""
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("sample_id"), F.col("embedding").alias("data"))
    out = labels.resample(rows, (4, 4, 4), (4, 4, 7), (1, 1, 0.5), "linear")
    return out.select(F.col("sample_id").alias("vec_id"), F.posexplode("data").alias("idx", "v")).withColumn("v", F.round("v", 6) + F.lit(0.0))


@query(f"with {_VOL} select vec_id, (c1 * 16 + c0 * 4 + c2 - 1)::int as idx, round(v, 6) + 0.0 as v from x where c2 >= 1 union all select vec_id, (c1 * 16 + c0 * 4 + 3)::int, -1.0::double from x where c2 = 0")
def resample_to_grid(spark, d):
    """Whole volumes on a grid whose first two axes are swapped and whose last starts one point further on; -1 outside."""
    matrix = lambda *rows: F.array(*(F.lit(float(x)) for r in rows for x in r))
    shape = F.array(*[F.lit(4).cast("long")] * 3)
    unit, turned = matrix((1, 0, 0, 0), (0, 1, 0, 0), (0, 0, 1, 0), (0, 0, 0, 1)), matrix((0, 1, 0, 0), (1, 0, 0, 0), (0, 0, 1, 1), (0, 0, 0, 1))
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("sample_id"), shape.alias("shape"), F.lit("float32").alias("dtype"), unit.alias("affine"), F.transform("embedding", lambda x: x.cast("double")).alias("data"))
    out = grids.resample_to(rows, rows.select("sample_id", "shape", turned.alias("affine")), "linear", -1.0)
    return out.select(F.col("sample_id").alias("vec_id"), F.posexplode("data").alias("idx", "v")).withColumn("v", F.round("v", 6) + F.lit(0.0))


@query(f"with {_VOL}, g as (select a, b, c, (a + i) // 2 as ga, (b + j) // 2 as gb, (c + k) // 2 as gc from range(7) p(a), range(7) q(b), range(7) r(c), range(2) s(i), range(2) t(j), range(2) u(k)) select vec_id, (a * 49 + b * 7 + c)::int as idx, round(avg(v), 6) + 0.0 as v from x join g on c0 = ga and c1 = gb and c2 = gc group by vec_id, a, b, c")
def resample_linear_volume(spark, d):
    """Every point of whole volumes at twice the density of each axis."""
    return _linear_volumes(spark, d).select("vec_id", F.col("i").alias("idx"), (F.round("v", 6) + F.lit(0.0)).alias("v"))


#: 6 times the inverse of a mirrored spline's matrix of four points, in 45ths, and a spline's weights of coefficients at half steps, in 48ths.
_SPLINE = """m as (select k, i, w / 45.0::double as w from (values (0, 0, 78), (0, 1, -42), (0, 2, 12), (0, 3, -3), (1, 0, -21), (1, 1, 84), (1, 2, -24), (1, 3, 6), (2, 0, 6), (2, 1, -24), (2, 2, 84), (2, 3, -21), (3, 0, -3), (3, 1, 12), (3, 2, -42), (3, 3, 78)) t(k, i, w)),
b as (select c, abs(3 - abs(3 - ((c + 1) // 2 - 2 + j + (1 - c % 2)))) as k, w / 48.0::double as w from range(7) r(c), (values (0, 0, 8), (0, 1, 32), (0, 2, 8), (0, 3, 0), (1, 0, 1), (1, 1, 23), (1, 2, 23), (1, 3, 1)) t(odd, j, w) where odd = c % 2),
s as (select c, i, sum(b.w * m.w) as w from b join m using (k) group by c, i),
y0 as (select vec_id, s.c as a, c1, c2, sum(v * w) as v from x join s on i = c0 group by all),
y1 as (select vec_id, a, s.c as b, c2, sum(v * w) as v from y0 join s on i = c1 group by all),
y2 as (select vec_id, a, b, s.c as c, sum(v * w) as v from y1 join s on i = c2 group by all)"""


@query(f"with {_VOL}, {_SPLINE} select vec_id, (a * 49 + b * 7 + c)::int as idx, round(v, 6) + 0.0 as v from y2")
def resample_bspline(spark, d):
    """Every point of whole volumes at twice the density of each axis, by cubic B-splines."""
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("sample_id"), F.col("embedding").alias("data"))
    out = labels.resample(rows, (4, 4, 4), (7, 7, 7), (0.5, 0.5, 0.5), "bspline")
    return out.select(F.col("sample_id").alias("vec_id"), F.posexplode("data").alias("idx", "v")).withColumn("v", F.round("v", 6) + F.lit(0.0))


# ---- review, validation, checksum, edits


def review_events(spark, d):
    e = table(spark, d, "events")
    status = F.when(F.col("event_type") == "error", "flagged").when(F.col("event_type").isin("purchase", "view"), "reviewed").when(F.col("event_type") == "signup", "pending").otherwise("rejected")
    return e.select(F.col("user_id").alias("sample_id"), "ts", F.col("event_id").alias("seq"), status.alias("status"))


_REV = "r as (select user_id as sample_id, ts, event_id as seq, case event_type when 'error' then 'flagged' when 'purchase' then 'reviewed' when 'view' then 'reviewed' when 'signup' then 'pending' else 'rejected' end as status from events)"


@query(f"with {_REV} select seq, sample_id, status, coalesce(lag(status) over (partition by sample_id order by ts, seq), 'pending') as prev from r")
def review_history(spark, d):
    return review.history(review_events(spark, d), ["ts", "seq"]).select("seq", "sample_id", "status", "prev")


@query(f"with {_REV} select sample_id, arg_max(status, (ts, seq)) as status from r group by 1")
def review_current(spark, d):
    return review.current(review_events(spark, d), ["ts", "seq"])


@query(f"with {_REV}, c as (select sample_id, arg_max(status, (ts, seq)) as status from r group by 1) select status, count(*) as n from c group by 1")
def review_list_counts(spark, d):
    return review.current(review_events(spark, d), ["ts", "seq"]).groupBy("status").agg(F.count("*").alias("n"))


def document_samples(spark, d):
    """The documents as samples, with faults that depend on the id."""
    k, n = F.col("doc_id"), F.lit(None)
    one, m = F.array(F.lit("text")), k % 12
    mask = F.array(F.lit("m"))
    return table(spark, d, "documents").select(
        k.alias("path"), F.when(k % 97 == 0, "unreadable").alias("open_error"), F.when(k % 89 == 0, n.cast("array<string>")).when(k % 83 == 0, F.array().cast("array<string>")).otherwise(one).alias("images"),
        F.when(k % 79 == 0, F.array(F.lit("1"), F.lit("2"))).otherwise(F.array(F.col("n_chars").cast("string"))).alias("image_shapes"), F.when(k % 73 == 0, n.cast("string")).when(k % 71 == 0, F.lit("2")).otherwise(F.lit("1")).alias("schema_version"),
        F.array("n_chars").alias("shape"), F.array(F.lit(1.0)).alias("spacing"), F.when(k % 67 == 0, n.cast("array<string>")).otherwise(F.array(F.when(k % 61 == 0, "other").otherwise("text"))).alias("image_names"), 
        m.isin(2, 3).alias("has_seg"), F.when(m.isin(1, 2, 3), mask).alias("seg"), F.when(m == 2, F.array(F.lit("x"))).when(m.isin(1, 3), mask).alias("seg_names"), F.when(m == 3, F.array(F.lit("9x9"))).when(m.isin(1, 2), F.array(F.col("n_chars").cast("string"))).alias("seg_shapes"),
        m.isin(4, 5, 6, 7).alias("has_bbox"), F.when(m.isin(5, 6, 7), 2).cast("long").alias("n_boxes"), F.when(m == 5, 9).when(m.isin(6, 7), 1).cast("long").alias("box_axes"), F.when(m == 6, 3).when(m.isin(5, 7, 8), 2).cast("long").alias("n_scores"), F.when(m == 7, 1).cast("long").alias("n_box_labels"),
        F.when(m == 9, F.array(F.lit(0.0), F.lit(0.0))).when(m == 10, F.array(F.lit(float("nan")))).otherwise(F.array(F.lit(0.0))).alias("origin"),
        F.when(k % 59 != 0, F.md5(k.cast("string").cast("binary"))).alias("checksum"), F.when(k % 53 != 0, F.md5(k.cast("string").cast("binary"))).otherwise("0").alias("computed"),
    )


_ISS = """k as (select doc_id as path, doc_id % 97 = 0 as op, doc_id % 89 = 0 as ni, doc_id % 83 = 0 as ei, doc_id as i from documents),
g as (select *, not op and not ni and not (ei and not ni) as go, not op and not ni and not ei and not (i % 71 = 0 and i % 73 <> 0) as onn from k),
s as (select path, 'error' as severity, 'file_open_failed' as code, null as location from g where op
union all select path, 'error', 'missing_images_group', 'images' from g where not op and ni
union all select path, 'error', 'empty_images_group', 'images' from g where not op and not ni and ei
union all select path, 'error', 'image_shape_mismatch', 'images' from g where go and i % 79 = 0
union all select path, 'error', 'missing_schema_version', null from g where go and i % 73 = 0
union all select path, 'error', 'metadata_read_failed', null from g where go and i % 71 = 0 and i % 73 <> 0
union all select path, 'warning', 'missing_image_names', null from g where onn and i % 67 = 0
union all select path, 'error', 'image_names_mismatch', 'images' from g where onn and i % 67 <> 0 and i % 61 = 0
union all select path, 'error', 'shape_mismatch', 'images' from g where onn and i % 79 = 0
union all select path, 'error', 'metadata_invalid', null from g where onn and i % 12 in (9, 10)
union all select path, 'error', 'seg_presence_mismatch', 'seg' from g where onn and i % 12 = 1
union all select path, 'error', 'seg_names_mismatch', 'seg' from g where onn and i % 12 = 2
union all select path, 'error', 'seg_shape_mismatch', 'seg' from g where onn and i % 12 = 3 or onn and i % 12 in (1, 2) and i % 79 = 0
union all select path, 'error', 'bbox_presence_mismatch', 'bboxes' from g where onn and i % 12 = 4
union all select path, 'error', 'bbox_shape_invalid', 'bboxes' from g where onn and i % 12 = 5
union all select path, 'error', 'bbox_scores_mismatch', 'bbox_scores' from g where onn and i % 12 = 6
union all select path, 'error', 'bbox_labels_mismatch', 'bbox_labels' from g where onn and i % 12 = 7
union all select path, 'error', 'bbox_dependents_without_bboxes', 'bboxes' from g where onn and i % 12 = 8
union all select path, 'warning', 'missing_checksum', null from g where onn and i % 59 = 0
union all select path, 'error', 'checksum_mismatch', null from g where onn and i % 59 <> 0 and i % 53 = 0)"""


@query(f"with {_ISS} select path, severity, code, location from s")
def validation_issues(spark, d):
    return validation.issues(document_samples(spark, d))


@query(f"with {_ISS} select (select count(*) from documents) as checked, count(distinct path) as invalid from s where severity = 'error'")
def validation_summary(spark, d):
    rows = document_samples(spark, d)
    return validation.summary(rows, validation.issues(rows))


@query(f"with {_ISS} select path, min(code) as code from s where severity = 'error' group by path order by path limit 3")
def validation_fail_fast(spark, d):
    return validation.first_failures(validation.issues(document_samples(spark, d)), limit=3)


_DIG = "dig as (select l_orderkey as sample_id, sha256(string_agg(l_linenumber || ':' || l_partkey || ':' || l_suppkey || ':' || l_returnflag || '|', '' order by l_linenumber, l_partkey, l_suppkey, l_returnflag)) as digest from lineitem group by 1)"


def order_digests(spark, d):
    text = F.concat_ws(":", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")
    rows = table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "sample_id")
    out = rows.select("sample_id", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")
    joined = checksum.sample_digest(out, "sample_id", ["l_linenumber", "l_partkey", "l_suppkey", "l_returnflag"], text)
    return joined


@query(f"with {_DIG} select sample_id, digest from dig")
def checksum_digest(spark, d):
    return order_digests(spark, d)


_VER = f"{_DIG}, ver as (select sample_id, case when sample_id % 10 = 0 then 'missing' when sample_id % 11 = 0 then 'mismatch' else 'ok' end as status from dig)"


def _verified(spark, d):
    rows = order_digests(spark, d)
    stored = F.when(F.col("sample_id") % 10 == 0, None).when(F.col("sample_id") % 11 == 0, "0").otherwise(F.col("digest"))
    return rows.select("sample_id", checksum.verify(stored, F.col("digest")).alias("status"))


@query(f"with {_VER} select sample_id, status from ver")
def checksum_verify(spark, d):
    return _verified(spark, d)


@query(f"with {_VER} select count(*) as checked, count(*) filter (status = 'mismatch') as failed from ver")
def audit_summary(spark, d):
    return checksum.audit(_verified(spark, d))


def _said(name: str, mark: str, value: str) -> str:
    return f"'{name}=' || coalesce('{mark}' || octet_length(encode(({value})::varchar)) || ':' || ({value}), 'n') || ';'"


_STORED = f"""rec as (select o_orderkey as sample_id, 'samples/' as part, 0 as pos, {_said("custkey", "i", "o_custkey")} || {_said("priority", "s", "o_orderpriority")} || {_said("status", "s", "nullif(o_orderstatus, 'F')")} as text from orders
union all select sid, 'voxels/' || modality, pos, {_said("value", "i", "v")} from (select sid, pos, unnest(['partkey', 'suppkey']) as modality, unnest([l_partkey, l_suppkey]) as v from (select *, l_orderkey as sid, {_POS} as pos from lineitem))
union all select sid, 'voxels/' || modality, pos, {_said("value", "i", "v")} from (select sid, pos, 'hurt' as modality, l_partkey + (sid % 11 = 0 and pos = 0)::int as v from (select *, l_orderkey as sid, {_POS} as pos from lineitem))),
dig as (select sample_id, sha256(string_agg(part || '#' || pos || '#' || text || chr(10), '' order by part, pos)) as digest, count(*) filter (part = 'voxels/hurt' and pos = 0) as n from rec group by sample_id)"""


@query(f"with {_STORED} select sample_id, case when sample_id % 10 = 0 then 'missing' when sample_id % 11 = 0 and n > 0 then 'mismatch' else 'ok' end as status, digest from dig")
def audit_stored(spark, d):
    """Tables written with their digests, one voxel of every eleventh sample changed in the files, audited as they are read again."""
    path, orders = _scratch(spark), table(spark, d, "orders")
    rows = orders.select(F.col("o_orderkey").alias("sample_id"), F.col("o_custkey").alias("custkey"), F.col("o_orderpriority").alias("priority"), F.when(F.col("o_orderstatus") != "F", F.col("o_orderstatus")).alias("status"))
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("sample_id"), (F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*POSITION)) - 1).cast("long").alias("pos"), "l_partkey", "l_suppkey")
    lines = settle(lines).select("sample_id", "pos", F.expr("stack(3, 'partkey', l_partkey, 'suppkey', l_suppkey, 'hurt', l_partkey) as (modality, value)"))
    whole = checksum.stamped({"samples": rows, "voxels": lines})
    samples.write(whole.withColumn("checksum", F.when(F.col("sample_id") % 10 != 0, F.col("checksum"))), f"{path}/samples")
    hurt = (F.col("modality") == "hurt") & (F.col("sample_id") % 11 == 0) & (F.col("pos") == 0)
    samples.write(lines.withColumn("value", F.col("value") + hurt.cast("long")), f"{path}/voxels")
    return checksum.audited({name: samples.read(spark, f"{path}/{name}") for name in ("samples", "voxels")})


#: An extra and what is to be said of it.
_EXTRAS = (
    ('{"review": 1}', "review is not an object"), ('{"nnunetv2": [1]}', "nnunetv2 is not an object"), ('{"checksum": "x"}', "checksum is not an object"),
    ('{"review": {"schema_version": 2}}', "review has a newer version"), ('{"nnunetv2": {"schema_version": 9}}', "nnunetv2 has a newer version"), ('{"checksum": {"schema_version": 2}}', "checksum has a newer version"),
    ('{"review": {"status": 3}}', "review.status is not a string"), ('{"nnunetv2": {"labels": {"tumor": true}}}', "nnunetv2.labels is not a map to integers"), ("{broken", "extra is not JSON"),
)


@query(" union all ".join(f"select event_id as id, '{w}' as warning from events where event_id % 11 = {i}" for i, (_, w) in enumerate(_EXTRAS)))
def extra_warnings(spark, d):
    """Each warning, and none for what events have as properties nor for an extra without fault."""
    extra = F.when(F.col("event_id") % 11 == 9, '{"review": {"status": "flagged", "schema_version": 1}, "nnunetv2": {"labels": {"a": 1, "b": 2}}, "own": 5}').otherwise(F.col("props"))
    for i, (text, _) in enumerate(_EXTRAS):
        extra = F.when(F.col("event_id") % 11 == i, text).otherwise(extra)
    return validation.extra_warnings(table(spark, d, "events").select(F.col("event_id").alias("id"), extra.alias("extra")), "id")


@query("select o_orderkey as sample_id, case when o_orderkey % 3 = 0 then null when o_orderkey % 3 = 1 then 'X' else o_orderstatus end as label from orders")
def meta_update(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("sample_id"), F.col("o_orderstatus").alias("label"))
    changes = rows.where("sample_id % 3 < 2").select("sample_id", F.when(F.col("sample_id") % 3 == 1, "X").alias("new"))
    return edit.update_meta(rows, changes, {"label": "new"})


def _masks(spark, d):
    return table(spark, d, "lineitem").where("l_returnflag <> 'N'").groupBy(F.col("l_orderkey").alias("sample_id"), F.col("l_returnflag").alias("mask")).agg(F.count("*").alias("voxels"))


_MASK = "m as (select l_orderkey as sample_id, l_returnflag as mask, count(*) as voxels from lineitem where l_returnflag <> 'N' group by all), n as (select l_orderkey as sample_id, 'N' as mask, count(*) as voxels from lineitem where l_returnflag = 'N' group by 1)"


@query(f"with {_MASK} select * from m union all select * from n")
def seg_add(spark, d):
    new = table(spark, d, "lineitem").where("l_returnflag = 'N'").groupBy(F.col("l_orderkey").alias("sample_id")).agg(F.count("*").alias("voxels")).select("sample_id", F.lit("N").alias("mask"), "voxels")
    return edit.seg_add(_masks(spark, d), new)


@query(f"with {_MASK} select sample_id, mask, case when mask = 'R' then 0 else voxels end::bigint as voxels from m")
def seg_replace(spark, d):
    rows = _masks(spark, d)
    return edit.seg_replace(rows, rows.where("mask = 'R'").select("sample_id", "mask", F.lit(0).cast("long").alias("voxels")))


@query(f"with {_MASK} select * from m where mask <> 'A'")
def seg_remove(spark, d):
    rows = _masks(spark, d)
    return edit.seg_remove(rows, rows.where("mask = 'A'"))


@query("select p_partkey as sample_id, case when p_partkey % 4 = 0 then 0 else p_size end::int as lo from part where p_partkey % 4 <> 1")
def bbox_set(spark, d):
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("sample_id"), F.col("p_size").alias("lo"))
    out = edit.bbox_set(rows, rows.where("sample_id % 4 = 0").withColumn("lo", F.lit(0)))
    return edit.bbox_clear(out, rows.where("sample_id % 4 = 1"))


@query(f"with {_MASK}, s as (select sample_id, list_sort(list(distinct mask)) as names from m group by 1) select o_orderkey as sample_id, s.names is not null as has_seg, array_to_string(s.names, ',') as seg_names, o_orderkey % 2 = 0 as has_bbox from orders left join s on o_orderkey = s.sample_id")
def meta_resync(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("sample_id"))
    out = edit.resync(rows, _masks(spark, d), rows.where("sample_id % 2 = 0"))
    return out.select("sample_id", "has_seg", F.array_join("seg_names", ",").alias("seg_names"), "has_bbox")


@query("""with p as (select p_partkey as path, p_partkey % 13 = 0 as e, p_partkey % 11 = 0 as d, p_size - 5 as lv, p_partkey % 7 = 0 as sg, p_partkey % 5 = 0 as bx, p_partkey % 3 = 0 as sc from part)
select path, 'no images' as code from p where e union all select path, 'image shapes differ' from p where d and not e union all select path, 'compression level' from p where lv < 0 or lv > 9
union all select path, 'mask shape' from p where sg and not e union all select path, 'box shape' from p where bx and not e union all select path, 'score count' from p where sc""")
def write_input_issues(spark, d):
    """What would be refused on writing, over samples with faults that depend on the part."""
    k = F.col("p_partkey")
    text = lambda *x: F.array(*(F.lit(v) for v in x))
    rows = table(spark, d, "part").select(
        k.alias("path"), F.when(k % 13 == 0, F.array().cast("array<string>")).when(k % 11 == 0, text("4x4x4", "4x4x5")).otherwise(text("4x4x4")).alias("image_shapes"), (F.col("p_size") - 5).alias("level"),
        F.when(k % 7 == 0, text("2x2x2")).otherwise(text("4x4x4")).alias("seg_shapes"), F.lit(2).alias("n_boxes"), F.when(k % 5 == 0, 2).otherwise(3).alias("box_axes"), F.when(k % 3 == 0, 1).alias("n_scores"), F.lit(2).alias("n_box_labels"),
    )
    rows = rows.withColumn("seg_shapes", F.when(F.size("image_shapes") == 0, F.lit(None)).otherwise(F.col("seg_shapes")))
    return validation.write_issues(rows)


@query("select distinct conv_id as case_id, conv_id % 6 <> 0 as complete from conversations")
def case_label_join(spark, d):
    """Cases and their label files, some of which are missing."""
    rows = table(spark, d, "conversations").select(F.col("conv_id").alias("case_id")).distinct()
    files = rows.where("case_id % 6 <> 0").withColumn("path", F.concat(F.lit("labelsTr/"), F.col("case_id").cast("string"), F.lit(".nii.gz")))
    return cases.with_label(rows, files).select("case_id", "complete")


@query("select conv_id as case_id, array_to_string(list_sort(list_filter(['assistant', 'system', 'user'], lambda x: not list_contains(have, x))), ',') as missing, array_to_string(list_sort(list_filter(have, lambda x: not list_contains(['assistant', 'system', 'user'], x))), ',') as extra from (select conv_id, list(distinct role) as have from conversations group by 1)")
def channel_difference(spark, d):
    rows = table(spark, d, "conversations").groupBy(F.col("conv_id").alias("case_id")).agg(F.collect_set("role").alias("have"))
    missing, extra = cases.name_difference(F.col("have"), F.array(F.lit("user"), F.lit("assistant"), F.lit("system")))
    return rows.select("case_id", F.array_join(missing, ",").alias("missing"), F.array_join(extra, ",").alias("extra"))


@query("select conv_id as case_id, string_agg(role, '|' order by turn) as stack from conversations group by 1")
def stack_slices(spark, d):
    rows = cases.stack_slices(table(spark, d, "conversations"), "conv_id", "turn", "role")
    return rows.select(F.col("conv_id").alias("case_id"), F.array_join("role", "|").alias("stack"))


@query("select distinct l_returnflag as value from lineitem")
def distinct_label_values(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_returnflag").alias("value")).distinct()


@query(f"with {_VOX} select modality, count(*) as n_voxels, min(v) as vmin, max(v) as vmax from v where modality in ('quantity', 'tax') group by modality")
def modality_restriction(spark, d):
    """Statistics of chosen modalities only; in a partitioned table the others aren't read."""
    out = stats.compute_stats(table(spark, d, "documents").select(F.col("lang").alias("label"), F.array("n_chars").alias("shape")), voxels(spark, d), modalities=["quantity", "tax"], exact=False)
    return out["modalities"].select("modality", "n_voxels", "vmin", "vmax")


@query(f"with {_REV}, c as (select sample_id, arg_max(status, (ts, seq)) as status from r group by 1) select u as sample_id, coalesce(c.status, 'pending') as review_status from (select distinct user_id as u from events where user_id is not null union select * from range(200)) left join c on c.sample_id = u")
def review_status_of(spark, d):
    """All samples with events, and the ids below 200 so that some have none."""
    ids = table(spark, d, "events").where("user_id is not null").select(F.col("user_id").alias("sample_id")).union(spark.range(200)).distinct()
    events = review_events(spark, d).withColumn("seq", F.struct("ts", "seq"))
    return review.status_of(ids, events)


# ---- round trips


def _scratch(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


@query("select doc_id, source, lang from documents")
def manifest_roundtrip(spark, d):
    path = _scratch(spark)
    manifest.save(table(spark, d, "documents").select("doc_id", "source", "lang"), path)
    return manifest.load(spark, path, "doc_id long, source string, lang string, manifest_version int")


@query("select lang as label, count(*) as n from documents group by 1")
def stats_roundtrip(spark, d):
    path = _scratch(spark)
    stats.save({"labels": stats.label_counts(table(spark, d, "documents"), "lang")}, path)
    return stats.load(spark, path)["labels"]


def _recompressed(spark, d):
    from ..sources import samples

    path = _scratch(spark)
    samples.recompress(spark, f"{d.rstrip('/')}/embeddings.parquet", path, "max")
    return spark.read.parquet(path)


@query("select vec_id, label, len(embedding)::int as n, round(list_sum(list_transform(embedding, lambda x: x::double)), 5) + 0.0 as s, round(list_sum(list_transform(embedding, lambda x: x::double * x::double)), 5) as q from embeddings")
def recompress(spark, d):
    """Of each vector after recompress the number of its components, their sum and the sum of their squares."""
    add = lambda f: F.aggregate("embedding", F.lit(0.0), lambda acc, x: acc + f(x.cast("double")))
    return _recompressed(spark, d).select("vec_id", "label", F.size("embedding").alias("n"), (F.round(add(lambda x: x), 5) + F.lit(0.0)).alias("s"), F.round(add(lambda x: x * x), 5).alias("q"))


@query("select vec_id, label, (generate_subscripts(embedding, 1) - 1)::int as idx, unnest(embedding)::double as v from embeddings")
def recompress_components(spark, d):
    """All components after recompress, not rounded."""
    return _recompressed(spark, d).select("vec_id", "label", F.posexplode("embedding").alias("idx", "v")).withColumn("v", F.col("v").cast("double"))


# ---- metadata, validity, partial edits


_META = "m as (select p_partkey as path, case when p_partkey % 7 = 0 then 2 else 3 end as ns, p_partkey % 11 = 0 as lost_row, p_partkey % 13 = 0 as flat, p_partkey % 17 = 0 as odd from part)"


@query(f"""with {_META} select path, unnest(list_filter([case when ns = 2 then 'spacing has 2 entries; the axes are 3' end, case when odd then 'origin has entries that aren''t numbers' end, case when lost_row then 'direction isn''t a square of the axes' end,
case when flat then 'patch_size has entries that aren''t positive' end], lambda x: x is not null)) as problem from m""")
def metadata_issues(spark, d):
    """Geometry of parts, of which some lack a spacing, a row of the direction, a number of the origin or a patch length."""
    k, rows = F.col("id"), part_geometry(spark, d)
    origin = F.when(k % 17 == 0, F.array(F.lit(1.0), F.lit(float("nan")), F.lit(0.0))).otherwise(F.col("origin"))
    samples = rows.select(
        k.alias("path"), F.array(*[F.lit(8).cast("long")] * 3).alias("shape"), F.when(k % 7 == 0, F.slice("spacing", 1, 2)).otherwise(F.col("spacing")).alias("spacing"), origin.alias("origin"),
        F.when(k % 11 == 0, F.slice("direction", 1, 2)).otherwise(F.col("direction")).alias("direction"), F.array(F.lit(2), F.when(k % 13 == 0, 0).otherwise(2), F.lit(2)).alias("patch_size"),
    )
    return validation.metadata_issues(samples)


@query(f"with {_META} select path, not (ns = 2 or lost_row or odd) as valid from m")
def sample_validity(spark, d):
    """The same parts: faults of the geometry are errors, those of patches warnings."""
    found = metadata_issues(spark, d).withColumn("severity", F.when(F.col("problem").startswith("patch_size"), "warning").otherwise("error"))
    return validation.validity(table(spark, d, "part").select(F.col("p_partkey").alias("path")), found)


@query(f"with {_BOX}, n as (select box_id, sample_id, lo, hi, row_number() over (partition by sample_id order by box_id) - 1 as box from b) select box_id, box::bigint as box, lo[1]::bigint as lo0, hi[1]::bigint as hi0, case when sample_id % 3 = 0 then box / 8.0::double else box_id / 4.0::double end as score from n")
def bbox_partial_update(spark, d):
    """Scores alone replaced on the boxes of every third sample; ends and the other samples stay."""
    rows = part_boxes(spark, d).withColumn("box", (F.row_number().over(Window.partitionBy("sample_id").orderBy("box_id")) - 1).cast("long"))
    old = rows.withColumns({"score": F.col("box_id") / F.lit(4.0), "label": F.col("box_id").cast("string")})
    new = rows.where("sample_id % 3 = 0").select("sample_id", "box", (F.col("box") / F.lit(8.0)).alias("score"))
    out = edit.bbox_update(old.select("sample_id", "box", "lo", "hi", "score", "label"), new, ["score"])
    return out.select(F.col("label").cast("long").alias("box_id"), "box", F.get("lo", F.lit(0)).alias("lo0"), F.get("hi", F.lit(0)).alias("hi0"), "score")


@query(f"""with {_VOL}, s as (select vec_id, c0 as k, c1 * 4 + c2 as i, floor(1024 * v)::bigint as stored from x)
select vec_id, case when vec_id % 50 = 0 then 'uneven' when vec_id % 50 = 1 then 'shape' else 'ok' end as state, case when vec_id % 50 < 2 then -1 else k * 16 + i end::int as i, case when vec_id % 50 < 2 then null else 2 * stored - vec_id % 7 end::double as value,
  case when vec_id % 50 < 2 then null else 2.5 end as spacing, case when vec_id % 50 < 2 then null else vec_id::double end as z from s where vec_id % 50 > 1 or k = 0 and i = 0""")
def dicom_series(spark, d):
    """Every volume as four DICOM slices, written in three transfer syntaxes, parsed and put together again; some series are uneven or of two shapes."""
    v, k = F.col("vec_id"), F.col("k")
    rows = table(spark, d, "embeddings").select("vec_id", "embedding", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("k"))
    z = v + k * 2.5 + F.when((v % 50 == 0) & (k == 3), 1.0).otherwise(0.0)
    axis = lambda *x: F.array(*(F.lit(float(i)) for i in x))
    rows = rows.select(
        F.format_string("%d/%d.dcm", v, (k * 7) % 4).alias("path"), F.concat(F.lit("1.2."), v).alias("uid"), F.array(F.lit(0.0), F.lit(0.0), z).alias("position"), axis(1, 0, 0).alias("row_dir"), axis(0, 1, 0).alias("col_dir"), axis(0.5, 0.25).alias("pixel_spacing"),
        F.lit(2.0).alias("slope"), (0.0 - v % 7).alias("intercept"), F.when((v % 50 == 1) & (k == 2), F.array(F.lit(2), F.lit(8))).otherwise(F.array(F.lit(4), F.lit(4))).alias("shape"),
        F.transform(F.slice("embedding", k * 16 + 1, F.lit(16)), lambda x: F.floor(1024 * x.cast("double")).cast("int")).alias("data"), F.element_at(F.array(*(F.lit(s) for s in (dicom.EXPLICIT, dicom.IMPLICIT, dicom.DEFLATED))), (v % 3 + 1).cast("int")).alias("syntax"),
    )
    rows = rows.repartition(spark.sparkContext.defaultParallelism, "path")  # vectors are small and what is done to them isn't, so a file or two are dealt to all tasks
    out = series.volumes(dicom.slices(dicom.parsed(dicom.encoded(rows))))
    state = F.when(F.col("problem").isNull(), "ok").when(F.col("problem").contains("uneven"), "uneven").when(F.col("problem").contains("another shape"), "shape")
    out = out.select(F.split("uid", "\\.")[2].cast("long").alias("vec_id"), state.alias("state"), F.posexplode_outer("data").alias("i", "value"), F.when(F.col("problem").isNull(), F.get("spacing", F.lit(0))).alias("spacing"), F.when(F.col("problem").isNull(), F.get("origin", F.lit(2))).alias("z"))
    return out.withColumn("i", F.coalesce("i", F.lit(-1)))


@query(f"with {_VOL}, n as (select vec_id, row_number() over (partition by vec_id // 64 order by vec_id) - 1 as k from embeddings) select vec_id // 64 as volume, (k * 64 + c0 * 16 + c1 * 4 + c2)::int as i, round(v, 6) as value, 'float32' as dtype, (vec_id // 64)::double as origin from x join n using (vec_id)")
def nifti_files(spark, d):
    """Up to 64 vectors a volume of four axes, written as packed NIfTI files by the data source and read back by it."""
    nifti_format.register(spark)
    v = F.floor(F.col("vec_id") / 64)
    rows = table(spark, d, "embeddings").groupBy(v.alias("volume")).agg(F.array_sort(F.collect_list(F.struct("vec_id", "embedding"))).alias("items"))
    unit = F.array(*(F.col("volume").cast("double") if i == 3 else F.lit(float(i % 5 == 0)) for i in range(16)))
    files = rows.select(
        F.format_string("v%d/data.nii.gz", "volume").alias("name"), F.array(F.size("items"), *[F.lit(4)] * 3).cast("array<bigint>").alias("shape"), F.lit("float32").alias("dtype"), unit.alias("affine"),
        F.flatten(F.transform("items", lambda x: x["embedding"].cast("array<double>"))).alias("data"),
    )
    path = _scratch(spark)
    files.write.format("nifti").mode("append").save(path)
    got = tiles.numbers(spark.read.format("nifti").load(path).where("error is null"))
    out = got.select(F.regexp_extract("path", "/v([0-9]+)/", 1).cast("long").alias("volume"), F.posexplode("data").alias("i", "value"), "dtype", F.get("affine", F.lit(3)).alias("origin"))
    return out.withColumn("value", F.round("value", 6))


#: Vectors of each volume, stacked along its first axis.
_STACK = 64
_STACKED = f"{_VOL}, n as (select vec_id, row_number() over (partition by vec_id // {_STACK} order by vec_id) - 1 as k from embeddings), y as (select vec_id // {_STACK} as volume, k * 4 + c0 as r, c1, c2, (k * 64 + c0 * 16 + c1 * 4 + c2)::int as i, v from x join n using (vec_id))"


def _stacked(spark: SparkSession, d: str) -> DataFrame:
    """(sample_id, shape, affine, data) of up to 64 embeddings a volume, as doubles on a grid with a step of 1."""
    rows = table(spark, d, "embeddings").groupBy(F.floor(F.col("vec_id") / _STACK).alias("volume")).agg(F.array_sort(F.collect_list(F.struct("vec_id", "embedding"))).alias("items"))
    data = F.flatten(F.transform("items", lambda x: x["embedding"].cast("array<double>")))
    unit = F.array(*(F.lit(float(i % 5 == 0)) for i in range(16)))
    return rows.select(F.concat(F.lit("v"), "volume").alias("sample_id"), F.array(F.size("items") * 4, F.lit(4), F.lit(4)).cast("array<bigint>").alias("shape"), unit.alias("affine"), data.alias("data"))


@query(f"""with {_STACKED} select volume, case when volume % 5 = 4 then 'test' else 'train' end as part, i, round(v, 6) as raw, round(-v, 6) + 0.0 as turned, case when volume % 5 <> 4 then v > 0.1 end as high, case when volume % 5 <> 4 then v < -0.1 end as low from y""")
def nnunet_roundtrip(spark, d):
    """Stacked vectors as samples of two channels and two masks, written as a dataset folder, imported with all checks, written again by what the import kept, and read back."""
    base, first, second = _stacked(spark, d), _scratch(spark), _scratch(spark)
    number = F.substring("sample_id", 2, 20).cast("long")
    rows = base.withColumn("part", F.when(number % 5 == 4, "test").otherwise("train"))
    both = F.explode(F.array(*(F.struct(F.lit(m).alias("modality"), data.alias("data")) for m, data in (("turned", F.transform("data", lambda x: -x)), ("raw", F.col("data"))))))
    images = rows.withColumn("m", both).select("sample_id", "m.modality", "shape", F.lit("float32").alias("dtype"), "affine", "m.data")
    of = F.explode(F.array(*(F.struct(F.lit(m).alias("mask"), data.alias("data")) for m, data in (("high", F.transform("data", lambda x: x > 0.1)), ("low", F.transform("data", lambda x: x < -0.1))))))
    masks = rows.where("part = 'train'").withColumn("m", of).select("sample_id", "m.mask", "shape", "affine", "m.data")
    whole = {"samples": rows.select("sample_id", "part"), "images": images, "masks": masks}
    nnunet.export_dataset(whole, first, {"0": "turned", "1": "raw"}, {"background": 0, "low": 1, "high": 2})
    nnunet.export_dataset(nnunet.import_dataset(spark, first), second)
    got = nnunet.import_dataset(spark, second)
    out = samples.assemble(got["samples"], got["images"].select("sample_id", "modality", "data"), got["masks"].select("sample_id", "mask", "data"))
    raw, turned = (F.try_element_at("images", F.lit(m)) for m in ("raw", "turned"))
    high, low = (F.coalesce(F.try_element_at("masks", F.lit(m)), F.transform(raw, lambda x: F.lit(None).cast("boolean"))) for m in ("high", "low"))
    out = out.select(number.alias("volume"), "part", F.posexplode(F.arrays_zip(raw.alias("raw"), turned.alias("turned"), high.alias("high"), low.alias("low"))).alias("i", "x"))
    return out.select("volume", "part", "i", F.round("x.raw", 6).alias("raw"), (F.round("x.turned", 6) + F.lit(0.0)).alias("turned"), "x.high", "x.low")


@query(f"with {_STACKED}, z as (select *, (r // 2) * 4 + (c1 // 2) * 2 + c2 // 2 as j from y) select volume, i, round(v, 6) as raw, (j + volume)::double as half, case when volume % 4 <> 0 then (j + volume) % 3 = 0 end as spot from z")
def nifti_import(spark, d):
    """Stacked vectors with a second modality and a mask on a grid of twice the step, exported as files of a folder a sample, and imported on the first one's grid; each fourth sample has no mask."""
    base, path = _stacked(spark, d), _scratch(spark)
    number = F.substring("sample_id", 2, 20).cast("long")
    coarse = F.array(*(F.lit(float(x)) for x in (2, 0, 0, 0.5, 0, 2, 0, 0.5, 0, 0, 2, 0.5, 0, 0, 0, 1)))
    shape = F.transform("shape", lambda x: F.floor(x / 2))
    at = F.sequence(F.lit(0).cast("long"), F.floor(F.size("data") / 8) - 1)
    half = base.select("sample_id", shape.alias("shape"), coarse.alias("affine"), F.transform(at, lambda j: (j + number).cast("double")).alias("data"))
    images = base.select("sample_id", F.lit("raw").alias("modality"), "shape", F.lit("float32").alias("dtype"), "affine", "data")
    images = images.unionByName(half.select("sample_id", F.lit("half").alias("modality"), "shape", F.lit("int32").alias("dtype"), "affine", "data"))
    masks = half.where(number % 4 != 0).select("sample_id", F.lit("spot").alias("mask"), "shape", "affine", F.transform("data", lambda x: x % 3 == 0).alias("data"))
    nifti.export(nifti.export_volumes(images, masks), path)
    got = nifti.import_folder(spark, path, resample_to="raw", order="nearest", resample_masks=True)
    out = samples.assemble(got["samples"], got["images"].select("sample_id", "modality", "data"), got["masks"].select("sample_id", "mask", "data"))
    raw, two = (F.try_element_at("images", F.lit(m)) for m in ("raw", "half"))
    spot = F.coalesce(F.try_element_at("masks", F.lit("spot")), F.transform(raw, lambda x: F.lit(None).cast("boolean")))
    out = out.select(number.alias("volume"), F.posexplode(F.arrays_zip(raw.alias("raw"), two.alias("half"), spot.alias("spot"))).alias("i", "x"))
    return out.select("volume", "i", F.round("x.raw", 6).alias("raw"), "x.half", "x.spot")


_LINES = f"l as (select l_orderkey as sid, {_POS} as pos, l_partkey as a, l_suppkey as b, l_returnflag as f, l_linenumber as n from lineitem)"


@query(f"""with {_LINES}, i as (select sid, string_agg(a, ',' order by pos) as parts, string_agg(b, ',' order by pos) as supps, string_agg((f = 'A')::int, '' order by pos) as ma, string_agg((f = 'R')::int, '' order by pos) as mr, bool_or(f = 'A') as ha, bool_or(f = 'R') as hr from l group by sid),
b as (select sid, string_agg(pos || ':' || n || '-' || (n + a % 5), ';' order by pos) as boxes from l where b % 4 = 0 group by sid)
select o_orderkey as sample_id, o_orderstatus as label, 'parts=' || parts || ';supps=' || supps as images, nullif(concat_ws(';', case when ha then 'A=' || ma end, case when hr then 'R=' || mr end), '') as masks, boxes from orders left join i on i.sid = o_orderkey left join b on b.sid = o_orderkey""")
def assembled_samples(spark, d):
    """Orders with the lines' numbers as two images, return flags as masks and some lines as boxes, stored as a folder of tables and read back whole; orders without flags have no masks at all."""
    root = _scratch(spark)
    lines = table(spark, d, "lineitem").withColumns({"sample_id": F.col("l_orderkey"), "pos": (F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*POSITION)) - 1).cast("long")})
    sorted_of = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("pos", c.alias("v")))), lambda x: x["v"])
    wide = lines.groupBy("sample_id").agg(sorted_of(F.col("l_partkey")).alias("parts"), sorted_of(F.col("l_suppkey")).alias("supps"), *(sorted_of(F.col("l_returnflag") == f).alias(f) for f in "AR"))
    images = wide.select("sample_id", F.explode(F.create_map(F.lit("supps"), "supps", F.lit("parts"), "parts")).alias("modality", "data"))
    masks = wide.select("sample_id", F.explode(F.create_map(F.lit("R"), "R", F.lit("A"), "A")).alias("mask", "data")).where(F.exists("data", lambda x: x))
    boxes = lines.where("l_suppkey % 4 = 0").select("sample_id", F.col("pos").alias("box"), F.array(F.col("l_linenumber").cast("long")).alias("lo"), F.array(F.col("l_linenumber") + F.col("l_partkey") % 5).alias("hi"))
    heads = table(spark, d, "orders").select(F.col("o_orderkey").alias("sample_id"), F.col("o_orderstatus").alias("label"))
    for name, df in (("samples", heads), ("images", images), ("masks", masks), ("boxes", boxes)):
        samples.write(df, f"{root}/{name}")
    out = samples.SampleSet(spark, root).assembled()
    text = lambda c, sep, f: F.array_join(F.transform(F.array_sort(F.map_entries(c)), lambda e: F.concat(e["key"], F.lit("="), F.array_join(F.transform(e["value"], f), sep))), ";")
    span = F.array_join(F.transform("boxes", lambda b: F.concat_ws("", b["box"].cast("string"), F.lit(":"), b["lo"][0].cast("string"), F.lit("-"), b["hi"][0].cast("string"))), ";")
    return out.select("sample_id", "label", text("images", ",", lambda x: x.cast("string")).alias("images"), text("masks", "", lambda x: x.cast("int").cast("string")).alias("masks"), span.alias("boxes"))


@query(f"""with {_LINES}, a as (select sid, bool_or(f = 'A') as ha, bool_or(f = 'R') as hr from l group by sid), x as (select sid, count(*) as nb, count(*) filter (n % 2 = 0) as ns from l where b % 4 = 0 group by sid),
s as (select o_orderkey as path, o_orderkey % 7 <> 0 and a.sid is not null as ok, o_orderstatus <> 'F' as hs, o_orderkey % 2 = 0 as hb, coalesce(ha, false) as ha, coalesce(hr, false) as hr, nb, ns from orders left join a on a.sid = o_orderkey left join x on x.sid = o_orderkey)
select path, unnest(list_filter([case when not ok then 'missing_images_group' end, case when ok then 'missing_checksum' end, case when ok and path % 5 = 0 then 'image_shape_mismatch' end, case when ok and hs <> (ha or hr) then 'seg_presence_mismatch' end,
case when ok and hr then 'seg_names_mismatch' end, case when ok and path % 3 = 0 and ha then 'seg_shape_mismatch' end, case when ok and hb <> (nb is not null) then 'bbox_presence_mismatch' end, case when ok and ns > 0 and ns <> nb then 'bbox_scores_mismatch' end], lambda c: c is not null)) as code from s""")
def validation_observed(spark, d):
    """Orders' metadata against what tables of their images, masks and boxes hold: some have no images, images or masks of another shape, other masks, or boxes without scores."""
    lines = table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "sample_id")
    n = lines.groupBy("sample_id").agg(F.count("*").alias("n"), *(F.max(F.col("l_returnflag") == f).alias(f) for f in "AR"))
    k = F.col("sample_id")
    images = n.where(k % 7 != 0).select("sample_id", F.explode(F.create_map(F.lit("supps"), F.array(F.col("n") + (k % 5 == 0).cast("long")), F.lit("parts"), F.array("n"))).alias("modality", "shape"))
    shape = F.array(F.col("n") + ((k % 3 == 0) & (F.col("mask") == "A")).cast("long")).alias("shape")
    masks = n.select("sample_id", "n", F.explode(F.create_map(F.lit("A"), "A", F.lit("R"), "R")).alias("mask", "there")).where("there").select("sample_id", "mask", shape)
    boxes = lines.where("l_suppkey % 4 = 0").select("sample_id", F.array(F.col("l_linenumber")).alias("lo"), F.when(F.col("l_linenumber") % 2 == 0, 0.5).alias("score"))
    text = lambda *x: F.array(*(F.lit(v) for v in x))
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("sample_id"), F.lit("1").alias("schema_version"), text("supps", "parts").alias("image_names"), (F.col("o_orderstatus") != "F").alias("has_seg"), text("A").alias("seg_names"), (F.col("o_orderkey") % 2 == 0).alias("has_bbox"))
    return validation.issues(validation.observed(rows, images, masks, boxes), "sample_id").select(F.col("sample_id").alias("path"), "code")


@query(f"""with {_LINES}, m as (select sid, f, count(*) as voxels from l where f <> 'N' group by all), k as (select sid, case when f = 'R' and sid % 3 = 0 then 0 else voxels end as voxels, f as mask from m where not (f = 'A' and sid % 4 = 1) union all select o_orderkey, 7, 'new' from orders where o_orderkey % 5 = 0),
g as (select sid, string_agg(mask || ':' || voxels, ',' order by mask) as masks from k group by sid), b as (select sid, count(*) as n from l where b % 4 = 0 and sid % 6 <> 2 group by sid)
select o_orderkey as sample_id, case when o_orderkey % 2 = 0 then 'edited' else o_orderstatus end as label, g.masks, coalesce(b.n, 0) as n_boxes, g.sid is not null as has_seg, b.sid is not null as has_bbox, o_orderkey % 7 = 0 and not (o_orderkey % 2 = 0 or o_orderkey % 5 = 0 or (o_orderkey % 3 = 0 and exists (select 1 from m where m.sid = o_orderkey and m.f = 'R')) or (o_orderkey % 4 = 1 and exists (select 1 from m where m.sid = o_orderkey and m.f = 'A')) or o_orderkey % 6 = 2) as old_stamp
from orders left join g on g.sid = o_orderkey left join b on b.sid = o_orderkey""")
def update_whole(spark, d):
    """Labels, masks and boxes of orders edited at once; digests of what was touched are stored anew, and each seventh order's was wrong before, so the edit is forced."""
    lines = table(spark, d, "lineitem").withColumns({"sample_id": F.col("l_orderkey"), "pos": (F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*POSITION)) - 1).cast("long")})
    boxes = lines.where("l_suppkey % 4 = 0").select("sample_id", F.col("pos").alias("box"), F.col("l_linenumber").alias("lo"))
    masks = _masks(spark, d)
    heads = table(spark, d, "orders").select(F.col("o_orderkey").alias("sample_id"), F.col("o_orderstatus").alias("label"))
    masks, boxes = settle(masks), settle(boxes)  # the tables that are edited, as an edit reads stored ones
    tables = {"samples": heads, "masks": masks, "boxes": boxes}
    whole = checksum.computed(tables).withColumn("checksum", F.when(F.col("sample_id") % 7 == 0, "old").otherwise(F.col("computed")))  # stored and computed are of the same tables: one pass
    seg = {
        "remove": masks.where("mask = 'A' and sample_id % 4 = 1"), "replace": masks.where("mask = 'R' and sample_id % 3 = 0").withColumn("voxels", F.lit(0).cast("long")),
        "add": heads.where("sample_id % 5 = 0").select("sample_id", F.lit("new").alias("mask"), F.lit(7).cast("long").alias("voxels")),
    }
    changes = heads.where("sample_id % 2 = 0").select("sample_id", F.lit("edited").alias("new"))
    tables["samples"] = settle(whole)
    out = edit.update(tables, (changes, {"label": "new"}), seg, clear_boxes=heads.where("sample_id % 6 = 2"), digests=checksum.restamps(), force=True)
    names = out["masks"].groupBy("sample_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "mask", "voxels"))), ",").alias("masks"))
    n = out["boxes"].groupBy("sample_id").agg(F.count("*").alias("n_boxes"))
    rows = out["samples"].join(names, "sample_id", "left").join(n, "sample_id", "left").fillna(0, ["n_boxes"])
    return rows.select("sample_id", "label", "masks", "n_boxes", "has_seg", "has_bbox", (F.col("checksum") == "old").alias("old_stamp"))


@query("select doc_id::varchar as path, doc_id::varchar as file, lang as label, '[' || n_chars || ']' as shape, case when doc_id % 3 = 0 then 'flagged' else 'pending' end as review_status, case when doc_id % 3 = 0 then source end as kept, 17::bigint as n_keys, coalesce(doc_id % 2 = 0, false)::varchar as has_bbox from documents")
def info_payload(spark, d):
    """What there is to say of each document as a sample: JSON of 17 keys, read again by its paths."""
    extra = F.when(F.col("doc_id") % 3 == 0, F.to_json(F.struct("source", F.struct(F.lit("flagged").alias("status")).alias("review"))))
    rows = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), F.col("lang").alias("label"), F.array("n_chars").cast("array<bigint>").alias("shape"), extra.alias("extra"), (F.col("doc_id") % 2 == 0).alias("has_bbox"))
    at = lambda name: F.get_json_object("payload", f"$.{name}").alias(name.split(".")[-1])
    return records.info(rows).select("path", *map(at, ("file", "label", "shape", "review_status", "has_bbox")), at("extra.source").alias("kept"), F.size(F.json_object_keys("payload")).cast("long").alias("n_keys"))


@query("select doc_id::varchar as path, coalesce(lang, '') as label, row_number() over (order by doc_id::varchar) - 1 as place from documents")
def records_in_order(spark, d):
    """Records of documents as samples, in the order of their paths; places are counted within ranges of paths, then over the ranges."""
    rows = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), F.col("lang").alias("label"))
    found = records.build(rows).withColumn("range", F.substring("path", 1, 2))
    before = found.groupBy("range").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # 110 ranges at most
    place = F.row_number().over(Window.partitionBy("range").orderBy("path")) - 1
    return found.withColumn("k", place).join(F.broadcast(before), "range").select("path", F.coalesce("label", F.lit("")).alias("label"), (F.col("before") + F.col("k")).cast("long").alias("place"))
