"""URL filter: host and path rules first, then a weighted vocabulary matched by Aho-Corasick.

Strict terms reject on one hit, soft terms when several distinct ones hit. A hit
counts only between boundaries: the characters beside it are not ASCII letters or digits.
The built-in vocabulary is a small one; ``vocabulary`` reads another from a table of terms.
"""

from __future__ import annotations

from collections.abc import Sequence

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Rules as (verdict, host, path), and the vocabulary.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
STRICT = (
    "adult", "bdsm", "betting", "bookmaker", "camgirl", "camgirls", "casino", "cialis", "crackz", "escort", "escorts", "fetish", "gambling", "hardcore", "hentai", "hookup", "keygen", "malware", "milf",
    "nude", "nudes", "payday", "phishing", "porn", "porno", "roulette", "sexcam", "sexcams", "spam", "spyware", "tramadol", "viagra", "warez", "webcamsex", "xanax", "xxx",
)
SOFT = (
    "ads", "bet", "bets", "bingo", "bonus", "cams", "cash", "cheap", "clickbait", "clicks", "coupon", "coupons", "crack", "cracked", "credit", "dating", "deal", "deals", "debt", "diet", "discount", "doubleclick",
    "earn", "farm", "forex", "free", "giveaway", "horny", "hot", "jackpot", "keno", "lotto", "loan", "loans", "lottery", "meds", "mp3", "naked", "odds", "pharma", "pharmacy", "pill", "pills", "poker", "popup",
    "prize", "promo", "replica", "rx", "serial", "sex", "sexy", "singles", "slot", "slots", "sweepstakes", "torrent", "torrents", "track", "tracker", "tracking", "unlimited", "viral", "wager", "weightloss", "win", "winner",
)
SOFT_HITS = 2


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(F.coalesce(found, F.lit("")), UPPER, LOWER)


def path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits (its text) and its verdict; both null where none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), len(r[1]), r)):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def vocabulary_hits(strict: Sequence[str] = STRICT, soft: Sequence[str] = SOFT):
    """A column function: url text to ``struct<strict, soft>``, the numbers of distinct terms that hit."""
    found = ahocorasick.Automaton()
    for kind, terms in ((1, soft), (0, strict)):
        for t in terms:
            found.add_word(t, (kind, t))
    found.make_automaton()
    inside = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")

    def hits(urls: pd.Series) -> pd.DataFrame:
        out = []
        for u in urls:
            terms: tuple[set, set] = (set(), set())
            for end, (kind, t) in found.iter(u):
                a = end - len(t)
                if (a < 0 or u[a] not in inside) and (end + 1 == len(u) or u[end + 1] not in inside):
                    terms[kind].add(t)
            out.append((len(terms[0]), len(terms[1])))
        return pd.DataFrame(out, columns=["strict", "soft"]).astype("int64")

    return F.pandas_udf(hits, "strict long, soft long")


#: Terms that a vocabulary may have: it is broadcast with the automaton.
MOST_TERMS = 200_000


def vocabulary(terms: DataFrame) -> tuple[list[str], list[str]]:
    """The strict and the soft terms of ``terms(term, weight)``, A-Z lower-cased; a weight of 2 or more is strict, one under 1 is none."""
    low = F.translate("term", UPPER, LOWER)
    best = terms.where("term is not null and term <> '' and weight >= 1").groupBy(low.alias("term")).agg(F.max("weight").alias("weight")).limit(MOST_TERMS + 1).collect()
    if len(best) > MOST_TERMS:
        raise ValueError(f"the vocabulary has more than {MOST_TERMS} terms")
    return sorted(r.term for r in best if r.weight >= 2), sorted(r.term for r in best if r.weight < 2)


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, strict: Sequence[str] = STRICT, soft: Sequence[str] = SOFT, soft_hits: int = SOFT_HITS) -> DataFrame:
    """``page_id, host, path, rule, verdict, n_strict, n_soft`` for every row of ``pages(page_id, url)``.

    The rule's verdict wins; without a rule a url is blocked on one strict term or
    ``soft_hits`` distinct soft ones. A url that is null or has no ``://`` has empty
    host and path, no rule, and is judged by its text (null: allowed). Repeated rows
    stay; other columns are ignored; an empty table gives no rows.
    """
    parts = pages.select("page_id", "url").withColumn("host", host(F.col("url"))).withColumn("path", path(F.col("url")))
    name, verdict = rule(F.col("host"), F.col("path"), rules)
    text = F.translate(F.coalesce("url", F.lit("")), UPPER, LOWER)
    seen = parts.select("page_id", "host", "path", name.alias("rule"), verdict.alias("ruled"), vocabulary_hits(strict, soft)(text).alias("hit"))
    method = F.when((F.col("hit.strict") > 0) | (F.col("hit.soft") >= soft_hits), F.lit("block")).otherwise(F.lit("allow"))
    return seen.select("page_id", "host", "path", "rule", F.coalesce("ruled", method).alias("verdict"), F.col("hit.strict").alias("n_strict"), F.col("hit.soft").alias("n_soft"))


def _count_sql(terms: Sequence[str]) -> str:
    return " + ".join(f"CAST(regexp_matches(u, '(^|[^a-z0-9]){t}([^a-z0-9]|$)') AS BIGINT)" for t in terms)


JUDGE_SQL = f"""
WITH u AS (SELECT page_id, translate(coalesce(url, ''), '{UPPER}', '{LOWER}') AS u,
  translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
  regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
r AS (SELECT *, CASE
  WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
  WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
  WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
  WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule,
  {_count_sql(STRICT)} AS n_strict, {_count_sql(SOFT)} AS n_soft FROM u)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
       WHEN n_strict > 0 OR n_soft >= {SOFT_HITS} THEN 'block' ELSE 'allow' END AS verdict, n_strict, n_soft
FROM r
"""
