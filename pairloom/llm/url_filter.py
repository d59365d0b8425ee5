"""URL filters: host and path rules, then a weighted vocabulary.

Rules allow or block a host with its subdomains and a leading part of the path;
the longest rule that fits decides.  Any other URL is judged by its words, those
of its query and fragment included and whether or not it has a ``://``: an
Aho-Corasick automaton counts strict and soft terms in the decoded URL, a term
counting only where no letter or digit stands beside it.  One strict term blocks,
and so do several different soft ones.

Each URL is judged on its own, without a shuffle.  Rules and vocabulary are
parameters, small by nature, and go to the executors with the task.

Defined results: NULL counts as empty; that and a URL without ``://`` have an
empty host and path and fit no rule.  Escapes that are not UTF-8 leave the URL as
it is.  Repeated rows are judged alike, URLs of any length whole; an empty table
gives an empty one.  Other columns stay; those with the names of results are
replaced.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from functools import lru_cache
from urllib.parse import unquote

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.llm.common import ascii_lower, filled

# The rules of the contract, as (verdict, host, path).
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
# Common words of unwanted sites; strict ones have no everyday use in an address.
STRICT = (
    "porn", "porno", "xxx", "sex", "hentai", "camgirl", "camgirls", "escorts", "nsfw", "milf", "adult-x", "casino",
    "viagra", "cialis", "warez", "crackz", "keygen", "spam", "phishing", "malware",
)
SOFT = (
    "adult", "nude", "dating", "erotic", "hot", "bet", "bets", "betting", "poker", "slots", "jackpot", "lottery", "win",
    "bonus", "pills", "pharmacy", "cheap", "discount", "replica", "free", "loan", "loans", "credit", "payday", "crypto",
    "torrent", "crack", "serial", "ads", "adserver", "track", "tracker", "tracking", "click", "banner", "affiliate",
    "farm", "seo", "backlinks", "followers",
)


@dataclass(frozen=True)
class Vocabulary:
    strict: tuple[str, ...] = STRICT
    soft: tuple[str, ...] = SOFT
    min_soft: int = 2


@lru_cache(maxsize=4)
def _automaton(vocabulary: Vocabulary) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for kind, terms in (("soft", vocabulary.soft), ("strict", vocabulary.strict)):
        for term in terms:
            found.add_word(term, (kind, term))
    found.make_automaton()
    return found


def hits(text: str, vocabulary: Vocabulary = Vocabulary()) -> tuple[int, int]:
    """Number of strict hits, and of different soft terms, in a lower-case text."""
    strict, soft = 0, set()
    for last, (kind, term) in _automaton(vocabulary).iter(text):
        first = last + 1 - len(term)
        if (first and text[first - 1].isalnum()) or (last + 1 < len(text) and text[last + 1].isalnum()):
            continue
        if kind == "strict":
            strict += 1
        else:
            soft.add(term)
    return strict, len(soft)


def judged_text(url: str) -> str:
    """What terms are looked for in: the whole URL, unescaped, in lower case."""
    try:
        return unquote(url, errors="strict").lower()
    except UnicodeDecodeError:
        return url.lower()


def _rest(url: Column) -> Column:
    """What follows the first ``://``, or nothing."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(_rest(url), "^[^/?#]*", 0))


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: Iterable[Sequence[str]] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as host and path in one, and its verdict; NULL if there is none."""
    rule = verdict = None
    for what, own, start in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(start)
        rule = F.when(fits, own + start) if rule is None else rule.when(fits, own + start)
        verdict = F.when(fits, what) if verdict is None else verdict.when(fits, what)
    return (rule, verdict) if rule is not None else (F.lit(None).cast("string"), F.lit(None).cast("string"))


def judge(pages: DataFrame, url_col: str = "url", rules=RULES, vocabulary: Vocabulary = Vocabulary()) -> DataFrame:
    """Add ``host, path, rule, verdict, strict_hits, soft_terms``, in place of columns of those names."""
    own = ("host", "path", "rule", "verdict", "strict_hits", "soft_terms")

    @F.pandas_udf("strict int, soft int")
    def count(url: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([hits(judged_text(u), vocabulary) for u in url], columns=["strict", "soft"])

    kept = [c for c in pages.columns if c not in own]
    url = filled(pages[url_col])
    base = pages.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("d"), url.alias("url"), host_of(url).alias("host"), path_of(url).alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    counted = base.select("*", rule.alias("rule"), verdict.alias("told"), count("url").alias("n"))
    bad = (F.col("n.strict") >= 1) | (F.col("n.soft") >= vocabulary.min_soft)
    return counted.select(
        "d.*", "host", "path", "rule", F.coalesce("told", F.when(bad, "block").otherwise("allow")).alias("verdict"),
        F.col("n.strict").alias("strict_hits"), F.col("n.soft").alias("soft_terms"),
    )


# --- the query and its twin -------------------------------------------------------------------------------------------


def digest(pages: DataFrame) -> DataFrame:
    return judge(pages).select("page_id", "host", "path", "rule", "verdict")


def _sql(vocabulary: Vocabulary = Vocabulary()) -> str:
    def pattern(term: str) -> str:
        return f"(^|[^\\p{{L}}\\p{{N}}]){term}($|[^\\p{{L}}\\p{{N}}])"

    strict = " OR ".join(f"regexp_matches(t, '{pattern(w)}')" for w in vocabulary.strict)
    soft = " + ".join(f"CAST(regexp_matches(t, '{pattern(w)}') AS INTEGER)" for w in vocabulary.soft)
    rule = verdict = ""
    for what, own, start in sorted(RULES, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2])):
        when = f" WHEN (host = '{own}' OR ends_with(host, '.{own}')) AND starts_with(path, '{start}') THEN "
        rule += f"{when}'{own}{start}'"
        verdict += f"{when}'{what}'"
    return f"""
WITH u AS (SELECT page_id, coalesce(url, '') AS url, strpos(coalesce(url, ''), '://') AS p FROM pages),
r AS (SELECT page_id, url, CASE WHEN p > 0 THEN substr(url, p + 3) ELSE '' END AS r FROM u),
h AS (SELECT page_id, url, regexp_extract(r, '^[^/?#]*') AS h0, r FROM r),
s AS (SELECT page_id, url, translate(h0, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(substr(r, length(h0) + 1), '^[^?#]*') AS path FROM h),
v AS (SELECT *, lower(coalesce(TRY(url_decode(url)), url)) AS t FROM s)
SELECT page_id, host, path, CASE{rule} ELSE NULL END AS rule,
  CASE{verdict} WHEN {strict} OR ({soft}) >= {vocabulary.min_soft} THEN 'block' ELSE 'allow' END AS verdict
FROM v"""


SQL = _sql()
