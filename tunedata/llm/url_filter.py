"""URL filters: a trie over reversed host labels and path segments, longest match deciding."""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tunedata.llm.common import materialize

#: A pickled trie of more bytes than this is not broadcast; the rules are then joined by a shuffle.
TRIE_BYTES = 64 << 20
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def split_rule(rule: str) -> tuple[str, str]:
    """``example.org/en/1`` is host ``example.org`` and path ``/en/1``."""
    host, slash, path = rule.partition("/")
    return host.translate(str.maketrans(_UPPER, _LOWER)), slash + path


class UrlTrie:
    """Nodes are dicts. A host node has a child for each next label (from the top domain down) and,
    under ``"/"``, the root of its paths. A path node has a child for each whole segment, and under
    ``None`` the rules that end inside a segment: ``{beginning of the segment: rule}``."""

    def __init__(self, rules: Iterable[tuple[str, str]]):
        self.root: dict = {}
        for action, rule in rules:
            host, path = split_rule(rule)
            node = self.root
            for label in reversed(host.split(".")) if host else ():
                node = node.setdefault(label, {})
            node = node.setdefault("/", {})
            *whole, last = path.split("/")
            for segment in whole:
                node = node.setdefault(segment, {})
            ends = node.setdefault(None, {})
            if ends.get(last, ("allow",))[0] != "block":  # the same rule in both lists blocks
                ends[last] = (action, rule)

    def lookup(self, host: str, path: str) -> tuple[str, str] | None:
        """The (action, rule) that fits with the longest host, then the longest path."""
        best, node = self._paths(self.root, path), self.root
        for label in reversed(host.split(".")):
            node = node.get(label) if label else None
            if node is None:
                break
            best = self._paths(node, path) or best
        return best

    @staticmethod
    def _paths(node: dict, path: str) -> tuple[str, str] | None:
        node, best = node.get("/"), None
        for segment in path.split("/"):
            if node is None:
                break
            ends = node.get(None, {})
            for k in range(len(segment), -1, -1) if len(segment) < len(ends) else sorted(map(len, ends), reverse=True):
                if (hit := ends.get(segment[:k])) and k <= len(segment):
                    best = hit
                    break
            node = node.get(segment)
        return best


def filter_urls(pages: DataFrame, rules: DataFrame | list[tuple[str, str]], default: str = "allow",
                url_col: str = "url", trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """``pages`` and the columns ``host, path, rule, verdict``.

    ``rules`` are (action, rule) with action allow or block and rule ``host/path-beginning``. A rule
    fits its host and the subdomains of it where the path begins with the rule's path. Of the rules
    that fit the longest host wins, then the longest path; the same rule in both lists blocks.
    Without a fitting rule ``rule`` is null and the verdict is ``default``.

    The trie is broadcast if its pickled size is within ``trie_bytes``; a longer list (given as a
    DataFrame) is joined by the host's suffixes instead, with the same result.

    Defined cases: a null url or one without ``://`` has empty host and path, which only a rule
    without host fits; empty rules or pages are fine; columns of ``pages`` named like an added
    column are replaced; rows repeat as often as they do in ``pages``."""
    added = ("host", "path", "rule", "verdict")
    parsed = (pages.drop(*[c for c in added if c != url_col])
              .withColumns({"host": url_host(F.col(url_col)), "path": url_path(F.col(url_col))}))
    if isinstance(rules, DataFrame):
        rules = rules.select("action", "rule").filter("rule is not null")
        size = rules.agg(F.sum(F.octet_length("rule") + 64)).first()[0] or 0
        if size > trie_bytes:
            return _by_join(parsed, rules, default)
        rules = [tuple(r) for r in rules.collect()]  # within trie_bytes
    blob = pickle.dumps(UrlTrie(rules))
    if len(blob) > trie_bytes:
        raise ValueError("give a list of this size as a DataFrame")
    trie = pages.sparkSession.sparkContext.broadcast(blob)

    @F.pandas_udf("struct<action string, rule string>")
    def look(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        found = pickle.loads(trie.value)
        for hosts, paths in parts:
            hits = [found.lookup(h, p) or (None, None) for h, p in zip(hosts, paths)]
            yield pd.DataFrame(hits, columns=["action", "rule"], dtype=object)

    return (parsed.withColumn("__tdk_hit", look("host", "path"))
            .withColumns({"rule": F.col("__tdk_hit.rule"), "verdict": F.coalesce("__tdk_hit.action", F.lit(default))}).drop("__tdk_hit"))


def _by_join(parsed: DataFrame, rules: DataFrame, default: str) -> DataFrame:
    """Rules too many to broadcast: each distinct (host, path) meets the rules of its host's suffixes
    and its path's beginnings by equality; the longest is kept by a grouped maximum."""
    # Keys are spread over host suffix and path beginning, so that a hot host is no hot key.
    keyed = (rules.withColumn("_host", F.translate(F.substring_index("rule", "/", 1), _UPPER, _LOWER))
             .withColumn("_path", F.expr("substring(rule, length(substring_index(rule, '/', 1)) + 1)"))
             .groupBy("_host", "_path").agg(F.max_by(F.struct("action", "rule"), F.col("action")).alias("_r")))
    keyed = materialize(keyed, "url-rules")
    lengths = [r[0] for r in keyed.select(F.char_length("_path")).distinct().collect()]  # at most the longest url
    urls = parsed.select("host", "path").distinct()
    labels = F.split("host", r"\.")
    suffixes = F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.concat_ws(
        ".", F.slice(labels, k, F.size(labels)))))
    begins = F.filter(F.array(*[F.lit(n) for n in sorted(lengths)] or [F.lit(0)]), lambda n: n <= F.char_length("path"))
    tries = (urls.select("host", "path", F.explode(F.array_distinct(suffixes)).alias("_host"), begins.alias("_n"))
             .select("host", "path", "_host", F.explode("_n").alias("_n"))
             .withColumn("_path", F.expr("substring(path, 1, _n)")))
    best = (tries.join(keyed, ["_host", "_path"]).groupBy("host", "path")
            .agg(F.max_by("_r", F.struct(F.char_length("_host"), F.char_length("_path"))).alias("__tdk_hit")))
    return (parsed.join(best, ["host", "path"], "left")
            .withColumns({"rule": F.col("__tdk_hit.rule"), "verdict": F.coalesce("__tdk_hit.action", F.lit(default))}).drop("__tdk_hit"))
