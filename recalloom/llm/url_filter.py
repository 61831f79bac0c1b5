"""URL rules in a trie over reversed host labels, then path segments; the longest match wins.

A rule is ``host/path`` with a verdict. It fits its host and all subdomains, where the path of
the url starts with the rule's path. Of several fitting rules the one with more host labels
wins, then the one with the longer path; rules of the same host and path must agree.

Edges: a null url, or one without ``://``, has an empty host and path, fits no rule and gets the
default verdict. Repeated urls get the same verdict each. An empty table gives no rows, an empty
rule set the default for every row. Extra columns are carried along whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh_name
from .line_dedup import host_of

# A larger rule set must be split among several calls: the trie goes to every executor.
MAX_RULES = 200_000


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


class Trie:
    """Nodes are dicts. A host node maps a label to a host node, and "/" to its path trie.

    A path node maps a whole segment with its ending "/" to a path node; None leads to its
    rules: pairs of what is left of the rule's path after that node, and the rule. What is left
    has no "/", so at a node only those few ends are compared as prefixes.
    """

    def __init__(self, rules: Sequence[tuple[str, str, str]]) -> None:
        if len(rules) > MAX_RULES:
            raise ValueError(f"{len(rules)} rules; at most {MAX_RULES} fit one trie")
        self.root: dict = {}
        seen: dict[tuple[str, str], str] = {}
        for verdict, host, path in rules:
            if seen.setdefault((host, path), verdict) != verdict:
                raise ValueError(f"two verdicts for {host}{path}")
            node = self.root
            for label in reversed(host.split(".")):
                node = node.setdefault(label, {})
            node = node.setdefault("/", {})
            *whole, rest = path.split("/")
            for segment in whole:
                node = node.setdefault(segment + "/", {})
            ends = node.setdefault(None, [])
            ends.append((rest, (host + path, verdict)))
            ends.sort(key=lambda end: -len(end[0]))

    def match(self, host: str, path: str) -> tuple[str, str] | None:
        """(rule, verdict) of the longest match."""
        tries, node = [], self.root
        for label in reversed(host.split(".")):
            node = node.get(label)
            if node is None:
                break
            if "/" in node:
                tries.append(node["/"])
        # The longest host first: a shorter one counts only where no path of it fits.
        for node in reversed(tries):
            best = None
            parts = path.split("/")
            for i, segment in enumerate(parts):
                left = segment if i == len(parts) - 1 else segment + "/"
                best = next((rule for rest, rule in node.get(None, ()) if left.startswith(rest)), best)
                node = node.get(segment + "/") if i < len(parts) - 1 else None
                if node is None:
                    break
            if best is not None:
                return best
        return None


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]], url_col: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` with host, path, rule and verdict in columns of those names.

    Columns of ``pages`` with those names keep theirs; the new ones then get underscores.
    """
    spark = pages.sparkSession
    shared = spark.sparkContext.broadcast(Trie(rules))
    names: list[str] = []
    for name in ("host", "path", "rule", "verdict"):
        names.append(fresh_name([*pages.columns, *names], name))
    host, path, rule, verdict = names
    cut = pages.withColumn(host, host_of(F.col(f"`{url_col}`"))).withColumn(path, path_of(F.col(f"`{url_col}`")))

    @F.pandas_udf(T.StructType([T.StructField("rule", T.StringType()), T.StructField("verdict", T.StringType())]))
    def found(hosts, paths):
        import pandas as pd

        trie = shared.value
        hits = [trie.match(h, p) or (None, default) for h, p in zip(hosts, paths, strict=True)]
        return pd.DataFrame(hits, columns=["rule", "verdict"], dtype=object)

    hit = fresh_name([*cut.columns, *names], "hit")
    return (cut.withColumn(hit, found(F.col(host), F.col(path))).withColumn(rule, F.col(f"{hit}.rule"))
            .withColumn(verdict, F.col(f"{hit}.verdict")).drop(hit))
