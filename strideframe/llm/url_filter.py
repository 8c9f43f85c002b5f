"""URL filters by a trie over reversed host labels and path segments."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_TRIE_RULES = 200_000
_URL = re.compile(r"://([^/?#]*)([^?#]*)", re.S)
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split_url(url: str | None) -> tuple[str, str]:
    """Host (after the first ``://``, A-Z lower-cased) and path; both empty without ``://``."""
    m = _URL.search(url or "")
    return (m[1].translate(_LOWER), m[2]) if m else ("", "")


class UrlTrie:
    """Edges are host labels from the right, then complete path segments.

    A rule sits at the node of its last complete segment, with what follows
    the last slash kept as an open remainder that the url must start with.
    Of the fitting rules the one with the most host labels wins, then the one
    with the longest path; block wins over allow on the same host and path.
    """

    def __init__(self, rules: Iterable[tuple[str, str, str]]):
        self.root: dict = {}
        for verdict, host, path in rules:
            if verdict not in ("allow", "block"):
                raise ValueError(f"unknown verdict {verdict!r}")
            node = self.root
            for label in reversed(host.translate(_LOWER).split(".")):
                node = node.setdefault(label, {})
            node = node.setdefault(None, {})  # where the path begins
            *whole, rest = path.split("/")
            for part in whole:
                node = node.setdefault(part, {})
            held = node.setdefault(None, {})
            if held.get(rest, ("allow",))[0] == "allow":
                held[rest] = (verdict, f"{host}{path}")

    @staticmethod
    def _best_path(node: dict, path: str):
        best, at = None, 0
        while node is not None:
            for rest, rule in node.get(None, {}).items():
                if path.startswith(rest, at) and (best is None or at + len(rest) >= best[0]):
                    best = (at + len(rest), rule)
            stop = path.find("/", at)
            if stop < 0:
                break
            node, at = node.get(path[at:stop]), stop + 1
        return best

    def find(self, host: str, path: str):
        """The winning (verdict, rule), or None."""
        node, won = self.root, None
        for label in reversed(host.split(".")):
            node = node.get(label)
            if node is None:
                break
            if None in node and (found := self._best_path(node[None], path)):
                won = found[1]
        return won


def filter_urls(
    pages: DataFrame,
    rules: list[tuple[str, str, str]],
    *,
    id_col: str = "page_id",
    url_col: str = "url",
    default: str = "allow",
    max_trie_rules: int = MAX_TRIE_RULES,
) -> DataFrame:
    """(id, host, path, rule, verdict) for each row of ``pages``.

    ``rules`` are (verdict, host, path); each fits its host and all subdomains
    when the path starts with the rule's.  The trie is broadcast: its size is
    checked against ``max_trie_rules``, and a longer list is split into tries
    of that size, applied one after the other.  Null urls and urls without
    ``://`` have an empty host and path and take ``default`` with a null rule;
    so does any url that no rule fits.  Null ids pass, urls of any length are
    judged whole, of equally long rules block wins.  Repeated rows are judged alike, other
    columns are not read, an empty table gives an empty result.
    """
    spark = pages.sparkSession
    rows = pages.select(F.col(id_col).alias("_id"), F.col(url_col).cast("string").alias("_url"))
    parts = [rules[i : i + max_trie_rules] for i in range(0, len(rules), max_trie_rules)] or [[]]
    kind = "host string, path string, rule string, verdict string"

    def judge(part):
        held = spark.sparkContext.broadcast(UrlTrie(part))

        def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            trie = held.value
            for urls in batches:
                out = []
                for url in urls:
                    host, path = split_url(url)
                    verdict, rule = trie.find(host, path) or (default, None)
                    out.append((host, path, rule, verdict))
                yield pd.DataFrame(out, columns=["host", "path", "rule", "verdict"])

        return F.pandas_udf(run, kind)

    judged = rows.select("_id", *[judge(p)(F.col("_url")).alias(f"_j{i}") for i, p in enumerate(parts)])
    best = F.col("_j0")
    for i in range(1, len(parts)):
        other = F.col(f"_j{i}")
        rank = lambda c: F.when(c["rule"].isNull(), -1).otherwise(
            F.length(F.substring_index(c["rule"], "/", 1)).cast("long") * 100_000 + F.length(c["rule"])
        )
        other_wins = (rank(other) > rank(best)) | ((rank(other) == rank(best)) & (other["verdict"] == "block"))
        best = F.when(other_wins & other["rule"].isNotNull(), other).otherwise(best)
    return judged.select(
        F.col("_id").alias(id_col),
        best["host"].alias("host"), best["path"].alias("path"), best["rule"].alias("rule"), best["verdict"].alias("verdict"),
    )
