"""The queries of this subpackage, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, ctw, cuckoo, hardneg, langid, lexical, linededup, minhash, mixing, topk, urlfilter, warc
from .common import table

#: The rank file of op4 and of the pipeline.
RANKS = "byte_bpe_50k.tiktoken"


def rank_file() -> tuple[str, str]:
    """(path, pattern) of the public vocabulary."""
    import public_tokenizers

    return public_tokenizers.path(RANKS), public_tokenizers.PATTERN


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), words=2, percent=80)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linededup.remove_boilerplate(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("clean_sha256"))


def op3_ctw_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctw.score_documents(table(spark, sf_dir, "documents"))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_digests(table(spark, sf_dir, "documents"), *rank_file())


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cuckoo.exact_duplicates(table(spark, sf_dir, "documents"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = urlfilter.judge_urls(table(spark, sf_dir, "pages"))
    return out.select("page_id", "host", "path", "n_strict", "n_soft", "soft_weight", "rule", "verdict")


def op7_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record of pages, audited against a replica with damaged pages: those whose id has an MD5 ending in 0.

    They are a byte longer there, so what follows them in their file has moved."""
    pages = table(spark, sf_dir, "pages")
    hurt = F.md5(F.col("page_id").cast("string").cast("binary")).endswith("0")
    replica = pages.withColumn("html", F.when(hurt, F.concat(F.coalesce("html", F.lit("")), F.lit("\u0001"))).otherwise(F.col("html")))
    out = warc.fixity(warc.records(pages), warc.records(replica))
    return out.select(F.col("record_id").alias("page_id"), "file", "pos", "offset", "length", "digest", "status")


def op8_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return topk.top_k(rows, rows.where("vec_id % 100 = 0"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify_languages(table(spark, sf_dir, "documents"))


def source_tree(docs: DataFrame) -> DataFrame:
    """(source, domain) of these tables, whose sources have numbers only: below 10 they stand for the web, below 16 for reference works, else for forums."""
    n = F.regexp_extract("source", "([0-9]{1,9})$", 1)
    n = F.when(n != "", n.cast("int"))
    domain = F.when(n < 10, "web").when(n < 16, "reference").when(n.isNotNull(), "forum")
    return docs.select("source").distinct().select("source", domain.alias("domain"))


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = mixing.mix_sources(docs, source_tree(docs))
    return out.select("doc_id", F.col("mix_domain").alias("domain"), F.col("mix_tokens").alias("n_tokens"), F.col("mix_target").alias("leaf_target"), "copies")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    rows = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hardneg.hard_negatives(rows, rows.where("vec_id % 100 = 0")).drop("anchor_key")


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and -7 of two turns that say marks."""
    said = F.lit("</s>[INST] ok [/INST]")
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    out = chat.format_chats(rows).withColumn("loss", chat.loss_text(F.col("formatted"), F.col("spans")))
    read = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id", "n_turns", F.sha2(read, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"), "n_escaped",
    )


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (op1_minhash_dedup, op2_line_dedup, op3_ctw_scoring, op4_byte_bpe, op5_exact_dedup, op6_url_filter, op7_warc_fixity, op8_exact_top_k, op9_language_id, op10_source_mixing, op11_hard_negatives, op12_lexical_search, op13_chat_format)
}

_LINES = """
lines as (select doc_id, source, i - 1 as pos, raw, trim(raw, chr(32) || chr(9) || chr(13) || chr(11) || chr(12)) as line
  from (select doc_id, source, generate_subscripts(s, 1) as i, unnest(s) as raw from (select doc_id, source, string_split(text, chr(10)) as s from documents)))
"""

ORACLES = {
    "op2_line_dedup": f"""
with {_LINES},
spread as (select line, min((doc_id, pos)) as first from lines where regexp_matches(raw, '[\\p{{L}}\\p{{N}}]')
  group by line having count(distinct source) >= {linededup.SITES}),
marked as (select l.*, s.line is not null and (l.doc_id, l.pos) <> s.first as gone from lines l left join spread s on l.line = s.line and regexp_matches(l.raw, '[\\p{{L}}\\p{{N}}]'))
select d.doc_id, coalesce(m.n_lines, 0)::bigint as n_lines, coalesce(m.n_removed, 0)::bigint as n_removed, sha256(coalesce(m.clean, '')) as clean_sha256
from documents d left join (select doc_id, count(*) as n_lines, count(*) filter (gone) as n_removed, string_agg(raw, chr(10) order by pos) filter (not gone) as clean from marked group by doc_id) m on d.doc_id = m.doc_id
""",
    "op5_exact_dedup": """
with n as (select doc_id, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g')) as text_sha256 from documents)
select doc_id, min(doc_id) over g as keep_id, count(*) over g as group_size, doc_id = min(doc_id) over g as kept, text_sha256 from n window g as (partition by text_sha256)
""",
    "op7_warc_fixity": f"""
with r as (select page_id, coalesce(url, '') as url, coalesce(html, '') as html from pages),
rec as (select page_id, 'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:record:' || page_id || '>' || chr(13) || chr(10) || 'WARC-Target-URI: ' || url || chr(13) || chr(10)
  || 'Content-Length: ' || octet_length(encode(html)) || chr(13) || chr(10) || chr(13) || chr(10) || html || chr(13) || chr(10) || chr(13) || chr(10) as body from r),
d as (select page_id, page_id // {warc.PER_FILE} as file, octet_length(encode(body))::bigint as length, sha256(body) as digest from rec)
select page_id, file, page_id % {warc.PER_FILE} as pos, (sum(length) over w - length)::bigint as "offset", length, digest,
  case when md5(page_id::varchar) like '%0' then 'corrupt' when count(*) filter (md5(page_id::varchar) like '%0') over w > 0 then 'moved' else 'ok' end as status
from d window w as (partition by file order by page_id)
""",
    "op8_exact_top_k": """
with v as (select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)::bigint) as e from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]))::bigint as score from v q, v c where q.vec_id % 100 = 0 and c.vec_id <> q.vec_id)
select query_id, rank::int as rank, vec_id, score from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s) where rank <= 10
""",
}

_TERMS = ", ".join(f"('{t}', {w})" for w, terms in {0: urlfilter.STRICT, **urlfilter.SOFT}.items() for t in terms)
_RULES = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in urlfilter.RULES)
ORACLES["op6_url_filter"] = f"""
with rules(rh, rp, rv) as (values {_RULES}), terms(term, weight) as (values {_TERMS}),
u as (select page_id, url, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') as path,
  list_distinct(regexp_split_to_array(lower(coalesce(url, '')), '[^a-z0-9]+')) as words from pages),
t as (select page_id, count(*) filter (weight = 0) as n_strict, count(*) filter (weight > 0) as n_soft, sum(weight) as soft_weight from (select page_id, unnest(words) as word from u) join terms on word = term group by page_id),
c as (select u.*, coalesce(n_strict, 0)::int as n_strict, coalesce(n_soft, 0)::int as n_soft, coalesce(soft_weight, 0)::int as soft_weight from u left join t using (page_id)),
m as (select page_id, max_by(rh || rp, len(rh || rp)) as rule, max_by(rv, len(rh || rp)) as rv from c join rules on (host = rh or ends_with(host, '.' || rh)) and starts_with(path, rp) group by page_id)
select c.page_id, host, path, n_strict, n_soft, soft_weight, rule, coalesce(rv, case when n_strict >= 1 or (n_soft >= {urlfilter.MIN_SOFT} and soft_weight >= {urlfilter.MIN_WEIGHT}) then 'block' else 'allow' end) as verdict from c left join m on c.page_id = m.page_id
"""


def _case(name: str, weights: dict[str, int]) -> str:
    return f"case {name} " + " ".join(f"when '{k}' then {v}" for k, v in weights.items()) + f" else {mixing.DEFAULT_WEIGHT} end"


def _share(rows: str, parent: str, name: str, weight: str) -> str:
    """mixing.share() in SQL: rows has parent, name, cap, budget."""
    return f"""(select * exclude (w, rest, ws, k, full_, cut), (case when full_ then cap when w > 0 then least(cut.rest * w // cut.ws, cap) else 0 end)::bigint as target from (
select *, min(case when not full_ and w > 0 then {{'k': k, 'rest': rest, 'ws': ws}} end) over (partition by {parent}) as cut from (
select *, w > 0 and cap * ws <= rest * w as full_ from (
select *, greatest(budget - coalesce(sum(cap) over (o rows between unbounded preceding and 1 preceding), 0), 0)::bigint as rest, sum(greatest(w, 0)) over (o rows between current row and unbounded following)::bigint as ws, row_number() over o as k
from (select *, ({weight})::bigint as w from {rows}) window o as (partition by {parent} order by case when w > 0 then cap / w end asc nulls last, {name}))))) """


def _mixing_sql(percent: int = 60, epochs: int = 2, seed: int = mixing.SEED) -> str:
    return f"""
with d as (select doc_id, coalesce(lang, '') as lang, coalesce(source, '') as source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::bigint as n_tokens,
  case when not regexp_matches(coalesce(source, ''), '[0-9]{{1,9}}$') then 'other' when regexp_extract(source, '([0-9]{{1,9}})$', 1)::int < 10 then 'web' when regexp_extract(source, '([0-9]{{1,9}})$', 1)::int < 16 then 'reference' else 'forum' end as domain from documents),
leaves as (select domain, lang, source, sum(n_tokens)::bigint as tokens, (sum(n_tokens) * {epochs})::bigint as cap from d group by all),
langs as (select domain, lang, sum(cap)::bigint as cap, sum(tokens)::bigint as tokens from leaves group by all),
domains as (select domain, sum(cap)::bigint as cap, 0 as top, (sum(sum(tokens)) over () * {percent} // 100)::bigint as budget from langs group by domain),
domains2 as (select domain, target as budget from {_share("domains", "top", "domain", _case("domain", mixing.DOMAIN_WEIGHTS))}),
langs2 as (select domain, lang, target as budget from {_share("(select langs.*, budget from langs join domains2 using (domain))", "domain", "lang", _case("lang", mixing.LANG_WEIGHTS))}),
plan as (select domain, lang, source, target, case when tokens > 0 then target // tokens else 0 end as e, case when tokens > 0 then target % tokens else 0 end as r
  from {_share("(select leaves.*, budget from leaves join langs2 using (domain, lang))", "domain, lang", "source", str(mixing.DEFAULT_WEIGHT))}),
o as (select d.*, target, e, r, sum(n_tokens) over (partition by domain, lang, source order by md5('{seed}:' || e || ':' || doc_id)) as upto from d join plan using (domain, lang, source))
select doc_id, domain, n_tokens, target as leaf_target, (e + case when r > 0 and upto <= r then 1 else 0 end)::int as copies from o
"""


ORACLES["op10_source_mixing"] = _mixing_sql()

_TAGS = {r: len(a) + len(b) + 2 for r, (a, b) in chat.MARKS.items()}
ORACLES["op13_chat_format"] = f"""
with t as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null
  union all values (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
m as (select *, regexp_matches(text, '{chat.MARK}') or regexp_matches(text, '{chat.ESCAPED}') as marked from t),
e as (select *, length(case when marked then regexp_replace(text, '{chat.MARKED}', '\\1\\\\\\2\\3', 'g') else text end) as n,
  case role {" ".join(f"when '{r}' then {n}" for r, n in _TAGS.items())} else {sum(map(len, chat.OTHER)) + 4} + length(replace(replace(role, '\\', '\\b'), '>', '\\g')) end as tags from m),
g as (select conv_id, count(*) as n_turns, string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text) as said,
  coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (role = 'assistant'), '') as loss, sum(n + tags)::bigint as formatted_chars, count(*) filter (marked) as n_escaped from e group by conv_id)
select conv_id, n_turns, sha256(said) as turns_sha256, length(loss) as loss_chars, sha256(loss) as loss_sha256, formatted_chars, n_escaped from g
"""

ORACLES["op11_hard_negatives"] = f"""
with v as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor({hardneg.SCALE} * x::double)::bigint) as e from embeddings
  where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.vec_id as anchor_id, a.label = c.label as same, c.vec_id, list_sum(list_transform(list_zip(a.e, c.e), lambda p: p[1] * p[2]))::bigint as score from v a, v c where a.vec_id % 100 = 0 and c.vec_id <> a.vec_id),
p as (select anchor_id, vec_id as positive_id, score as positive_score, row_number() over (partition by anchor_id order by score desc, vec_id) as positive_rank from s where same qualify positive_rank <= {hardneg.POSITIVES}),
n as (select p.*, vec_id as negative_id, score as negative_score, row_number() over (partition by p.anchor_id, positive_id order by score desc, vec_id) as rank from p join s on s.anchor_id = p.anchor_id and not same
  and {hardneg.LOW} * positive_score <= 100 * score and 100 * score <= 100 * positive_score qualify rank <= {hardneg.NEGATIVES})
select anchor_id, positive_id, rank::int as rank, negative_id, positive_score, negative_score, positive_rank::int as positive_rank from n
"""

_TERMS_OF = "regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
ORACLES["op12_lexical_search"] = f"""
with d as (select doc_id, unnest({_TERMS_OF.format("text")}) as term from documents where text is not null),
p as (select doc_id, term, count(*)::bigint as tf from d group by all),
n as (select doc_id, sum(tf)::bigint as n from p group by doc_id),
g as (select count(*)::bigint as docs, sum(n)::bigint as total from n),
w as (select term, floor(1000 * ln((2 * docs::double + 2) / (2 * count(*)::double + 1)))::bigint as w from p, g group by term, docs),
q as (select item_id, term, count(*)::bigint as q from (select item_id, unnest({_TERMS_OF.format("text")}) as term from benchmark where text is not null) group by all),
m as (select doc_id, 25 + (75 * n * docs) // total as m from n, g),
s as (select item_id, doc_id, sum(q * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::bigint as score from q join w using (term) join p using (term) join m using (doc_id) group by all having score > 0)
select item_id, row_number() over (partition by item_id order by score desc, doc_id)::int as rank, doc_id, score from s qualify rank <= {lexical.K}
"""
