"""URL filters: allow and block entries in a trie over reversed host labels, then path segments.

A rule names a host and the beginning of a path. It fits its host and all
subdomains, when the URL's path starts with the rule's path. Of all rules that
fit, the one with most host labels wins, then the longest path; an allow and a
block entry for the same place count as block.

The trie is broadcast only while the entries stay below ``max_trie_bytes``.
A larger rule table is joined instead: every URL asks for the places on its way
through the trie, with the same result.

Defined cases: a null URL, or one without ``://``, has an empty host and path
and gets the default verdict; repeated rows are judged each; an empty table
gives an empty result; further columns are kept, but for those named like a
result and names that begin with an underscore.
"""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Rule = tuple[str, str, str]  # action, host, path

PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, PARTS, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def build(rules: Iterable[Rule]) -> dict:
    """The trie as nested dictionaries.

    Nodes are dictionaries by host label; a host's rules hang below it by whole path segments.

    What follows the last slash of a rule's path need not be a whole segment, so
    a path node keeps such endings apart and compares them with ``startswith``.
    """

    root: dict = {}
    for action, host, path in rules:
        node = root
        for label in reversed(host.split(".")):
            node = node.setdefault(label, {})
        place = node.setdefault(None, {})  # where the host ends and its paths begin
        *whole, ending = path.split("/")
        for segment in whole:
            place = place.setdefault("/" + segment, {})
        endings = place.setdefault(None, {})
        if endings.get(ending) != "block":
            endings[ending] = action
    return root


def find(root: dict, host: str, path: str) -> tuple[str | None, str | None]:
    """(rule, action) of the longest match."""
    best: tuple[str | None, str | None] = (None, None)
    if not host:
        return best
    labels, node = host.split("."), root
    for depth in range(1, len(labels) + 1):
        node = node.get(labels[-depth])
        if node is None:
            break
        found = _longest(node[None], path) if None in node else None
        if found:
            best = (".".join(labels[-depth:]) + found[0], found[1])
    return best


def _longest(place: dict, path: str) -> tuple[str, str] | None:
    found, at = None, 0
    while True:
        rest = path[at:]
        fits = [(len(e), e) for e in place.get(None, ()) if rest.startswith(e)]
        if fits:
            ending = max(fits)[1]
            found = (path[:at] + ending, place[None][ending])
        slash = path.find("/", at)
        place = place.get("/" + path[at:slash]) if slash >= 0 else None
        if place is None:
            return found
        at = slash + 1


def judge(urls: DataFrame, rules: list[Rule], default: str = "allow", max_trie_bytes: int = 32_000_000) -> DataFrame:
    """Add host, path, rule and verdict to rows with a ``url``."""
    rows = urls.drop("rule", "verdict").withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    if sum(len(host) + len(path) + 64 for _, host, path in rules) > max_trie_bytes:
        table = rows.sparkSession.createDataFrame(rules, "action string, rule_host string, rule_path string")
        return judge_by_join(rows, table, default)
    trie = rows.sparkSession.sparkContext.broadcast(build(rules))

    @F.pandas_udf("rule string, action string")
    def walk(host: pd.Series, path: pd.Series) -> pd.DataFrame:
        root = trie.value
        return pd.DataFrame([find(root, h, p) for h, p in zip(host, path, strict=True)], columns=["rule", "action"])

    return rows.withColumn("_found", walk("host", "path")).select(
        *rows.columns, F.col("_found.rule").alias("rule"), F.coalesce("_found.action", F.lit(default)).alias("verdict")
    )


def judge_by_join(rows: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """The same verdicts for rule tables of any size; ``rows`` have host and path.

    Distinct places meet their rules in an equi-join on (host suffix, whole
    segments); a popular suffix holds few distinct places per URL and is split
    by adaptive skew joins.
    """
    places = rows.select("host", "path").distinct()
    labels = F.split("host", r"\.")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), ".")
    )
    cuts = F.split("path", "/")
    starts = F.transform(F.sequence(F.lit(0), F.size(cuts) - 1), lambda k: F.array_join(F.slice(cuts, 1, k), "/"))
    asked = places.where("host <> ''").withColumn("rule_host", F.explode(suffixes)).withColumn("segments", F.explode(starts))
    offered = rules.withColumn("segments", F.regexp_extract("rule_path", r"(?s)^(.*)/[^/]*$", 1))
    met = asked.dropDuplicates().join(offered, ["rule_host", "segments"]).where(F.col("path").startswith(F.col("rule_path")))
    rank = F.struct(
        F.size(F.split("rule_host", r"\.")).alias("labels"), F.length("rule_path").alias("long"),
        (F.col("action") == "block").alias("hard"), F.concat("rule_host", "rule_path").alias("rule"), "action",
    )
    best = met.groupBy("host", "path").agg(F.max(rank).alias("best"))
    return rows.join(best, ["host", "path"], "left").select(
        *rows.columns, F.col("best.rule").alias("rule"), F.coalesce("best.action", F.lit(default)).alias("verdict")
    )
