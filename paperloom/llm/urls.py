"""URL rules: allow or block by host and path, found through each rule's rarest literal token.

A rule is a host (with its subdomains) and the beginning of a path.  Its literal tokens
are the host's labels and the complete segments of the path; it is filed under the one
that the fewest rules have.  A URL's tokens fetch candidate rules, and only those run
their regular expressions.  Up to ``INLINE_RULES`` rules the file is a literal map in the
plan, so that judging is a projection; more rules are joined by token.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rules up to this number travel inside the plan; beyond it they are a table, joined by token.
INLINE_RULES = 2_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """``text`` is host and path, as in ``example.org/en/``."""

    verdict: str
    text: str

    @property
    def host(self) -> str:
        return self.text.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.text.partition("/")[2]

    def pattern(self) -> str:
        """For a host and a path written one after the other."""
        return rf"^(?:[^/]*\.)?{re.escape(self.host)}{re.escape(self.path)}"

    def tokens(self) -> list[str]:
        return [*self.host.split("."), *(x for x in self.path.split("/")[1:-1] if x)]


def index(rules: list[Rule]) -> dict[str, list[Rule]]:
    """Rules by their rarest token; of equally rare ones, the longest and then the last."""
    seen = Counter(t for r in rules for t in set(r.tokens()))
    out: dict[str, list[Rule]] = {}
    for r in rules:
        tokens = r.tokens()
        best = min(range(len(tokens)), key=lambda i: (seen[tokens[i]], -len(tokens[i]), -i))
        out.setdefault(tokens[best], []).append(r)
    return out


def host_of(url: Column) -> Column:
    """Between the first ``://`` and ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _struct(r: Rule) -> Column:
    return F.struct(F.lit(len(r.text)).alias("size"), F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict"), F.lit(r.pattern()).alias("pattern"))


def judge(pages: DataFrame, rules: list[Rule], url: str = "url", otherwise: str = "allow", inline: int = INLINE_RULES) -> DataFrame:
    """All columns of ``pages`` and host, path, rule and verdict.

    Of the rules that fit, the longest wins; of equally long ones, the greatest text and
    then the verdict ``block``.  Without one, rule is null and the verdict ``otherwise``.
    Null URLs and those without ``://`` have an empty host and path.  Each row is judged
    on its own, whatever repeats; columns of ``pages`` named like a result are replaced.
    """
    kept = [F.col(f"`{c}`") for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    split = pages.select(*kept, host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    filed = index(rules)
    tokens = F.array_distinct(F.concat(F.split("host", r"\."), F.split("path", "/")))
    best = lambda found: F.array_max(F.filter(found, lambda r: F.regexp_like(F.concat("host", "path"), r["pattern"])))
    if not rules:
        chosen = split.withColumn("_won", F.lit(None).cast("struct<size:int,rule:string,verdict:string>"))
    elif len(rules) <= inline:
        lookup = F.create_map(*(x for t, rs in sorted(filed.items()) for x in (F.lit(t), F.array(*map(_struct, rs)))))
        found = F.flatten(F.filter(F.transform(tokens, lambda t: F.try_element_at(lookup, t)), lambda x: x.isNotNull()))
        chosen = split.withColumn("_won", best(found))
    else:
        table = pages.sparkSession.createDataFrame([(t, len(r.text), r.text, r.verdict, r.pattern()) for t, rs in filed.items() for r in rs], "token string, size int, rule string, verdict string, pattern string")
        urls = split.select("host", "path").distinct()
        hits = urls.select("host", "path", F.explode(tokens).alias("token")).join(table, "token").where(F.regexp_like(F.concat("host", "path"), F.col("pattern")))
        won = hits.groupBy("host", "path").agg(F.max(F.struct("size", "rule", "verdict")).alias("_won"))
        chosen = split.join(won, ["host", "path"], "left")
    names = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    return chosen.select(*(F.col(f"`{c}`") for c in names), "host", "path", F.col("_won.rule").alias("rule"), F.coalesce("_won.verdict", F.lit(otherwise)).alias("verdict"))


#: The rules of the contract query.
CONTRACT = [Rule("allow", "org/"), Rule("block", "example.org/es/"), Rule("block", "example.org/en/1"), Rule("allow", "com/fr/"), Rule("block", "com/de/")]
