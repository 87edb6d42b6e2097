"""URL filter by a weighted vocabulary.

One Aho-Corasick pass over a lower-cased URL counts vocabulary terms that stand between boundaries (characters that
are no letter or digit). One strict term rejects; soft terms reject when several distinct ones occur, by the sum
of their weights. Rules for hosts and paths come first: the longest rule that fits decides whatever the terms say."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrat.llm.common import lower_ascii

# Fixed values: (host and path, verdict); a rule fits its host and all subdomains.
RULES = (
    ("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"),
    ("net/fr/", "block"),
)
# Strict terms, and soft terms with their weights.
STRICT = ("porn", "porno", "xxx", "hentai", "camgirl", "camgirls", "escort", "escorts", "onlyfans", "milf", "bdsm",
          "warez", "keygen", "phishing", "malware", "darknet")
SOFT = {
    "sex": 1.0, "sexy": 1.0, "adult": 0.5, "nude": 1.0, "erotic": 1.0, "casino": 1.0, "poker": 0.5, "bet": 0.5,
    "betting": 1.0, "gambling": 1.0, "slots": 0.5, "jackpot": 0.5, "torrent": 0.5, "crack": 0.5, "serial": 0.5,
    "hack": 0.5, "viagra": 1.0, "cialis": 1.0, "pills": 0.5, "loan": 0.5, "payday": 0.5, "replica": 0.5, "free": 0.25,
    "dating": 0.5, "hookup": 1.0, "bitcoin": 0.25, "proxy": 0.25,
}
LEAST_SOFT = 2
LEAST_WEIGHT = 1.0


def host_of(url: Column) -> Column:
    return lower_ascii(F.regexp_extract(_rest(url), "^[^/?#]*", 0))


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    return F.when(url.contains("://"), F.regexp_replace(url, "(?s)^.*?://", "")).otherwise("")


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> Column:
    """The longest rule that fits, as (rule, verdict); NULL if none does."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule, verdict in sorted(rules, key=lambda r: len(r[0])):
        name, _, rest = rule.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(f"/{rest}")
        found = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


@lru_cache(maxsize=4)
def _automaton(terms: tuple[str, ...]) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for term in terms:
        found.add_word(term, term)
    found.make_automaton()
    return found


def terms_in(url: str, terms: tuple[str, ...]) -> set[str]:
    """The vocabulary terms of a URL that no letter or digit touches."""
    low = url.lower()
    inside = lambda i: 0 <= i < len(low) and low[i].isalnum()
    return {t for last, t in _automaton(terms).iter(low) if not inside(last - len(t)) and not inside(last + 1)}


def rejects(found: set[str], strict: frozenset[str], soft: dict[str, float], least_soft: int, least_weight: float) -> bool:
    weak = [soft[t] for t in found if t in soft]
    return bool(found & strict) or len(weak) >= least_soft and sum(weak) >= least_weight


def judge(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, strict: tuple[str, ...] = STRICT,
          soft: dict[str, float] | None = None, least_soft: int = LEAST_SOFT, least_weight: float = LEAST_WEIGHT) -> DataFrame:
    """`pages` with host, path, terms, rule and verdict; columns of these names are replaced.

    A null URL, or one without "://", has empty host and path; its text is searched for terms all the same."""
    soft = SOFT if soft is None else soft
    terms, sure = tuple(dict.fromkeys([*strict, *soft])), frozenset(strict)

    def find(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for urls in batches:
            found = [terms_in(u, terms) if isinstance(u, str) else set() for u in urls]
            yield pd.DataFrame({"terms": [sorted(f) for f in found],
                                "bad": [rejects(f, sure, soft, least_soft, least_weight) for f in found]})

    df = pages.drop("host", "path", "terms", "rule", "verdict")
    url = F.coalesce("url", F.lit(""))
    df = df.withColumns({"host": host_of(url), "path": path_of(url),
                         "__t": F.pandas_udf(find, "terms array<string>, bad boolean")(F.col("url"))})
    df = df.withColumn("__r", rule_of(F.col("host"), F.col("path"), rules))
    verdict = F.coalesce("__r.verdict", F.when(F.col("__t.bad"), "block").otherwise("allow"))
    return df.withColumns({"terms": F.col("__t.terms"), "rule": F.col("__r.rule"), "verdict": verdict}).drop("__t", "__r")
