"""URL filter: longest matching host-and-path rule first, then a weighted vocabulary.

All terms are found in one pass of an Aho-Corasick automaton over the lower-cased URL. A
hit counts only between boundaries (no ASCII letter or digit on either side). One strict
term rejects, and so do `soft_limit` distinct soft terms.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from headwise.llm.common import without

OUT = ("host", "path", "rule", "n_strict", "n_soft", "verdict")
# Default vocabulary; pass your own lists for another policy.
STRICT = (
    "adult-content", "camgirls", "cheap-pills", "escort", "hardcore", "hentai", "porn", "porno",
    "spam-farm", "viagra", "warez", "xxx",
)
SOFT = (
    "bet", "bonus", "casino", "cheap", "crack", "deal", "deals", "discount", "farm", "free",
    "keygen", "loan", "loans", "nude", "pills", "poker", "sex", "spam", "torrent", "win", "winner",
)


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty without one."""
    rest = F.regexp_extract(url, r"^(?s).*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to `?`, `#` or the end."""
    return F.coalesce(F.regexp_extract(url, r"^(?s).*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting_rule(rules: dict[str, str], host: Column, path: Column) -> Column:
    """The longest rule (`host/path` text) that fits, or NULL: its host or a subdomain of
    it, and a path that starts with its path."""
    choice = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r), r)):
        at = rule.index("/")
        fits = ((host == rule[:at]) | F.endswith(host, F.lit("." + rule[:at]))) & F.startswith(path, F.lit(rule[at:]))
        choice = F.when(fits, F.lit(rule)).otherwise(choice)
    return choice


@cache
def _automaton(strict: tuple[str, ...], soft: tuple[str, ...]):
    found = ahocorasick.Automaton()
    for kind, terms in enumerate((soft, strict)):
        for term in terms:
            found.add_word(term, (kind, term))
    found.make_automaton()
    return found


def _plain(c: str) -> bool:
    return c.isascii() and c.isalnum()


def count_terms(url: str | None, strict: tuple[str, ...], soft: tuple[str, ...]) -> tuple[int, int]:
    """Distinct strict and distinct soft terms between boundaries."""
    text = "".join(c.lower() if c.isascii() else c for c in url or "")
    seen: tuple[set, set] = (set(), set())
    for end, (kind, term) in _automaton(strict, soft).iter(text) if text else ():
        start = end + 1 - len(term)
        if not (start and _plain(text[start - 1])) and not _plain(text[end + 1 : end + 2]):
            seen[kind].add(term)
    return len(seen[1]), len(seen[0])


def judge(
    pages: DataFrame,
    rules: dict[str, str],
    strict: tuple[str, ...] = STRICT,
    soft: tuple[str, ...] = SOFT,
    soft_limit: int = 2,
    url: str = "url",
) -> DataFrame:
    """`pages` with host, path, rule, n_strict, n_soft (distinct terms) and verdict (`allow`
    or `block`): the rule's verdict, else the vocabulary's.

    A term listed as both is strict. A NULL or malformed URL has an empty host and path, fits
    no rule, and its terms still count (none for NULL). Each row is judged alone: no shuffle;
    repeated rows stay, an empty table gives an empty result, and columns named like the new
    ones are replaced.
    """
    soft = tuple(sorted(set(soft) - set(strict)))
    base = without(pages, *OUT)
    schema = StructType([*base.schema, *[StructField(c, IntegerType()) for c in ("n_strict", "n_soft")]])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [count_terms(x.as_py(), strict, soft) for x in batch.column(url)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *[pa.array([c[i] for c in counts], pa.int32()) for i in (0, 1)]],
                names=[*batch.schema.names, "n_strict", "n_soft"],
            )

    host, path = host_of(F.col(url)), path_of(F.col(url))
    by_terms = F.when((F.col("n_strict") > 0) | (F.col("n_soft") >= soft_limit), "block").otherwise("allow")
    verdicts = F.lit(None).cast("string")
    for rule, verdict in rules.items():
        verdicts = F.when(F.col("rule") == rule, verdict).otherwise(verdicts)
    return (
        base.mapInArrow(scan, schema)
        .withColumns({"host": host, "path": path})
        .withColumn("rule", fitting_rule(rules, F.col("host"), F.col("path")))
        .withColumn("verdict", F.coalesce(verdicts, by_terms))
        .select(*[F.col(f"`{c}`") for c in base.columns], *OUT)
    )
