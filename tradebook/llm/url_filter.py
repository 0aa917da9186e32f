"""URL filter: rules for hosts and paths, then a weighted vocabulary found by Aho-Corasick.

A term counts where no ASCII letter or digit stands next to it, in the whole url with A-Z lower-cased.
Distinct terms found add their weights; a strict term alone reaches ``LIMIT``, soft ones do so
together. The automaton is built once in each task.

Defined results: a null url, or one without ``://``, has an empty host and path and fits no rule; a
null url has no terms and is allowed; repeated rows are judged each; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradebook.llm.columns import lower_ascii

#: (verdict, host, path): fits the host and its subdomains where the path begins so.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))

STRICT = (
    "adult", "bdsm", "bestiality", "camgirl", "camgirls", "camsex", "erotica", "fetish", "gangbang", "hardcore", "hentai",
    "milf", "nsfw", "porn", "porno", "pornography", "sexcam", "sexcams", "upskirt", "voyeur", "warez", "xxx",
)
SOFT = (
    "babes", "bet", "betting", "bonus", "casino", "cheap", "crack", "dating", "escort", "escorts", "gambling", "girls", "hot",
    "jackpot", "keygen", "lingerie", "loan", "loans", "lottery", "naked", "nude", "payday", "pharmacy", "pills", "poker",
    "roulette", "serial", "sex", "sexy", "singles", "slots", "teen", "teens", "torrent", "torrents", "viagra", "webcam",
)
LIMIT = 2
VOCABULARY = dict.fromkeys(STRICT, LIMIT) | dict.fromkeys(SOFT, 1)
_BESIDE = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")


def host_and_path(url: Column) -> tuple[Column, Column]:
    after = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3))
    host = lower_ascii(F.regexp_extract(after, "^[^/?#]*", 0))
    path = F.regexp_extract(F.substr(after, F.length(host) + 1), "^[^?#]*", 0)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def _rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """The longest rule that fits, as a struct of rule and verdict."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        found = F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def _terms(weights: dict[str, int]):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = ahocorasick.Automaton()
        for term in weights:
            found.add_word(term, term)
        found.make_automaton()

        def hits(url: str) -> list[str]:
            return sorted({t for end, t in found.iter(url) if url[end + 1 : end + 2] not in _BESIDE and (end < len(t) or url[end - len(t)] not in _BESIDE)})

        for batch in batches:
            terms = [hits(u) if u else [] for u in batch.column("lowered").to_pylist()]
            names = [n for n in batch.schema.names if n != "lowered"]
            yield pa.record_batch([*(batch.column(n) for n in names), pa.array(terms, pa.list_(pa.string()))], [*names, "terms"])

    return run


def judge(
    pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, weights: dict[str, int] = VOCABULARY, limit: int = LIMIT
) -> DataFrame:
    """One row per row of ``pages`` (page_id, url): host, path, rule, verdict, the terms found and their weight."""
    host, path = host_and_path(F.col("url"))
    named = pages.select("page_id", F.col("url").cast("string").alias("url")).select(
        "page_id", host.alias("host"), path.alias("path"), lower_ascii(F.col("url")).alias("lowered")
    )
    kind = dict(named.dtypes)["page_id"]
    found = named.mapInArrow(_terms(weights), f"page_id {kind}, host string, path string, terms array<string>")
    weight = F.lit(0)
    for w in sorted(set(weights.values())):
        of_weight = F.array(*(F.lit(t) for t, x in weights.items() if x == w))
        weight = weight + w * F.size(F.array_intersect("terms", of_weight))
    by_rule = _rule(F.col("host"), F.col("path"), rules)
    by_terms = F.when(F.col("weight") >= limit, F.lit("block")).otherwise(F.lit("allow"))
    return found.withColumns({"weight": weight.cast("long"), "by_rule": by_rule}).select(
        "page_id", "host", "path", F.col("by_rule.rule").alias("rule"), F.coalesce("by_rule.verdict", by_terms).alias("verdict"),
        F.array_join("terms", " ").alias("terms"), "weight",
    )


def oracle_sql(
    rules: Sequence[tuple[str, str, str]] = RULES, weights: dict[str, int] = VOCABULARY, limit: int = LIMIT
) -> str:
    """The same for DuckDB, with a regular expression for each term."""
    cases = " ".join(
        f"when (host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}') then '{verdict} {h}{p}'"
        for verdict, h, p in sorted(rules, key=lambda r: -len(r[1] + r[2]))
    )
    letters = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
    terms = ", ".join(f"case when regexp_matches(u, '(^|[^a-z0-9]){t}([^a-z0-9]|$)') then '{t}' end" for t in sorted(weights))
    weight = " + ".join(f"{w} * cast(regexp_matches(u, '(^|[^a-z0-9]){t}([^a-z0-9]|$)') as bigint)" for t, w in weights.items())
    return f"""
with cut as (select page_id, coalesce(translate(url, {letters}), '') as u,
    case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) end as rest from pages),
named as (select page_id, u, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), {letters}), '') as host,
    coalesce(regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*'), '') as path from cut),
ruled as (select *, case {cases} end as ruling from named),
found as (select *, concat_ws(' ', {terms}) as terms, {weight} as weight from ruled)
select page_id, host, path, substr(ruling, 7) as rule,
    coalesce(substr(ruling, 1, 5), case when weight >= {limit} then 'block' else 'allow' end) as verdict, terms, weight
from found"""
