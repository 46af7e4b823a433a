"""URL filter: host and path rules first, then a weighted vocabulary counted by an Aho-Corasick automaton."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import named_aside, set_aside

#: (host, path, verdict). A rule fits its host and all subdomains where the path starts with the rule's.
RULES = (
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
)
#: One strict term blocks. Soft terms block together: MIN_SOFT distinct ones whose weights make MIN_WEIGHT or more.
#: These are a start; read_vocabulary() takes a longer list.
STRICT = (
    "bestiality", "blowjob", "camgirl", "camgirls", "carding", "cialis", "creampie", "cumshot", "cvvshop", "darknet", "dildo", "escort", "escorts", "fetish", "gangbang", "hentai", "hardcore", "incest",
    "keygen", "malware", "milf", "masturbation", "nsfw", "onlyfans", "orgasm", "orgy", "phishing", "porn", "porno", "pornography", "pornstar", "ransomware", "serialz", "sexcam", "sexchat", "shemale",
    "spyware", "striptease", "swingers", "tramadol", "upskirt", "viagra", "voyeur", "warez", "webcamsex", "xanax", "xxx", "xvideos",
)
SOFT = {
    2: (
        "baccarat", "blackjack", "bookmaker", "casino", "casinos", "crack", "cracked", "erotic", "erotica", "gambling", "handjob", "jackpot", "jackpots", "kinky", "lingerie", "lottery", "naked", "nude",
        "nudes", "payday", "pharmacy", "pills", "pirated", "poker", "roulette", "sexual", "sexy", "slots", "spam", "steroids", "strip", "sportsbook", "topless", "torrent", "vape", "wager",
    ),
    1: (
        "adult", "babe", "babes", "bet", "betting", "bikini", "bonus", "cam", "cams", "cash", "cheap", "click", "coupon", "credit", "dating", "deal", "debt", "diet", "discount", "dosage", "download", "earn",
        "forex", "free", "girls", "guaranteed", "hack", "hot", "income", "loan", "loans", "lucky", "massage", "miracle", "mortgage", "offer", "prize", "promo", "rich", "singles", "teen", "trial", "unlimited",
        "weightloss", "win", "winner",
    ),
}
MIN_SOFT, MIN_WEIGHT = 2, 3
#: Terms are shared with every task inside the function, so their number is bounded.
MAX_TERMS = 100_000


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; empty without ://."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, "(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ? # or the end; empty without ://."""
    return F.coalesce(F.regexp_extract(url, "(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls; a few hundred rules make one expression."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, v).otherwise(verdict)
    return name, verdict


def read_vocabulary(spark: SparkSession, path: str) -> tuple[list[str], dict[int, list[str]]]:
    """(strict, soft by weight) of a CSV file with the columns term, kind (strict or soft) and weight (of soft terms; empty: 1).

    Terms are trimmed and lower-cased; nulls, empty terms and repeats are passed over. Over MAX_TERMS rows are an error."""
    rows = spark.read.csv(path, header=True, schema="term string, kind string, weight int").limit(MAX_TERMS + 1).collect()
    if len(rows) > MAX_TERMS:
        raise ValueError(f"over {MAX_TERMS} terms")
    strict, soft = set(), {}
    for r in rows:
        term = (r["term"] or "").strip().lower()
        if term and r["kind"] == "strict":
            strict.add(term)
        elif term and r["kind"] == "soft":
            soft[term] = r["weight"] or 1
        elif term:
            raise ValueError(f"kind is {r['kind']!r}")
    return sorted(strict), {w: sorted(t for t, x in soft.items() if x == w and t not in strict) for w in sorted(set(soft.values()))}


def term_counts(strict: Sequence[str] = STRICT, soft: Mapping[int, Sequence[str]] = SOFT):
    """A pandas UDF: url -> (n_strict, n_soft, soft_weight int), distinct terms met as whole words and the soft ones' weights.

    One automaton holds both lists; a hit counts if no ASCII letter or digit stands on either side."""
    words = [(t.lower(), 0) for t in strict] + [(t.lower(), w) for w, terms in soft.items() for t in terms]
    if len(words) > MAX_TERMS:
        raise ValueError(f"over {MAX_TERMS} terms")
    if any(w <= 0 for w in soft):
        raise ValueError("weights of soft terms are above 0")

    @F.pandas_udf("n_strict int, n_soft int, soft_weight int")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        automaton = ahocorasick.Automaton()
        for term, weight in words:
            automaton.add_word(term, (term, weight))
        automaton.make_automaton()

        def alone(s: str, i: int) -> bool:
            return not (0 <= i < len(s) and s[i].isascii() and s[i].isalnum())

        for urls in batches:
            rows = []
            for url in urls:
                s, found = (url or "").lower(), {}
                for end, (term, weight) in automaton.iter(s) if words else ():
                    if alone(s, end - len(term)) and alone(s, end + 1):
                        found[term] = weight
                soft_found = [w for w in found.values() if w]
                rows.append((len(found) - len(soft_found), len(soft_found), sum(soft_found)))
            yield pd.DataFrame(rows, columns=["n_strict", "n_soft", "soft_weight"]).astype("int32")

    return count


def judge_urls(pages: DataFrame, url_col: str = "url", rules: Sequence[tuple[str, str, str]] = RULES, strict: Sequence[str] = STRICT, soft: Mapping[int, Sequence[str]] = SOFT, min_soft: int = MIN_SOFT, min_weight: int = MIN_WEIGHT) -> DataFrame:
    """pages with host, path, n_strict, n_soft, soft_weight, rule and verdict (allow or block); clashing columns are replaced.

    A fitting rule decides; otherwise one strict term, or min_soft distinct soft terms that weigh min_weight together,
    block. A null URL or one without :// has an empty host and path and no rule; its terms still count (a null has none). Each
    row is judged by itself, so repeated rows come back as often; a URL of any length is read whole. No shuffle."""
    own = ("host", "path", "n_strict", "n_soft", "soft_weight", "rule", "verdict")
    pages, back = set_aside(pages)
    (url_col,) = named_aside(back, url_col)
    keep = [c for c in pages.columns if c not in own]
    url = F.col(url_col)
    out = pages.select(*keep, host_of(url).alias("host"), path_of(url).alias("path"), term_counts(strict, soft)(url).alias("__terms"))
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    bad = (F.col("__terms.n_strict") >= 1) | ((F.col("__terms.n_soft") >= min_soft) & (F.col("__terms.soft_weight") >= min_weight))
    judged = F.coalesce(verdict, F.when(bad, "block").otherwise("allow"))
    return out.select(*keep, "host", "path", "__terms.n_strict", "__terms.n_soft", "__terms.soft_weight", rule.alias("rule"), judged.alias("verdict")).withColumnsRenamed(back)
