"""URL filters by a sort-merge range join of canonical keys with prefix rules.

A host is turned round label by label (``www.example.com`` becomes
``[com, example, www]``), so a host and all its subdomains form one interval of
the sorted keys. Pages are range-partitioned and sorted by (reversed host,
path); each task sweeps its run once and keeps a stack of the rule hosts whose
intervals are open. Intervals of hosts nest, hence opening and closing them is
push and pop. Path prefixes are looked up per open host.
"""

from __future__ import annotations

from bisect import bisect_left

from itertools import batched

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clipgrain.llm.common import ascii_lower

#: Rules that one sweep may hold. A longer list is cut into sweeps that follow each other over the same sorted rows.
RULES_PER_SWEEP = 200_000
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without it."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit("")))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty without a ``://``."""
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


class RuleSweep:
    """The open rule hosts while keys come in sorted order."""

    def __init__(self, rules: list[tuple[str, str, str]]):
        by_host: dict[tuple[str, ...], dict[str, str]] = {}
        for host, path, verdict in rules:
            paths = by_host.setdefault(tuple(reversed(host.split("."))), {})
            # Of rules that say both for one prefix, the stricter holds.
            paths[path] = max(paths.get(path, verdict), verdict)
        self.by_host = by_host
        self.lengths = {h: sorted({len(p) for p in paths}, reverse=True) for h, paths in by_host.items()}
        self.hosts = sorted(by_host)
        self.stack: list[tuple[str, ...]] = []
        self.at = -1
        self.key: tuple[str, ...] | None = None

    def _close(self, key: tuple[str, ...]) -> None:
        while self.stack and key[: len(self.stack[-1])] != self.stack[-1]:
            self.stack.pop()

    def move(self, key: tuple[str, ...]) -> None:
        """Close the intervals that end before ``key`` and open those that hold it."""
        if key == self.key:
            return
        if self.at < 0:  # the run starts inside the order: open what already holds its first key
            self.at = bisect_left(self.hosts, key)
            self.stack = [key[:i] for i in range(1, len(key)) if key[:i] in self.by_host]
        while self.at < len(self.hosts) and self.hosts[self.at] <= key:
            self._close(self.hosts[self.at])
            self.stack.append(self.hosts[self.at])
            self.at += 1
        self._close(key)
        self.key = key

    def best(self, path: str) -> tuple[str, str] | None:
        """The longest open rule whose path starts ``path``; at equal length, that of the longer host."""
        found, length = None, (-1, -1)
        for labels in reversed(self.stack):
            host_len = sum(map(len, labels)) + len(labels) - 1
            paths = self.by_host[labels]
            for n in self.lengths[labels]:
                if n <= len(path) and path[:n] in paths:
                    if (host_len + n, host_len) > length:
                        found, length = (".".join(reversed(labels)) + path[:n], paths[path[:n]]), (host_len + n, host_len)
                    break
        return found


def _sweep(shared):
    def run(batches):
        sweep = RuleSweep(shared.value)
        for batch in batches:
            t = pa.Table.from_batches([batch])
            rules, verdicts = t["rule"].to_pylist(), t["verdict"].to_pylist()
            for i, (key, path) in enumerate(zip(t["key"].to_pylist(), t["path"].to_pylist(), strict=True)):
                sweep.move(tuple(key))
                got = sweep.best(path)
                if got and (rules[i] is None or len(got[0]) > len(rules[i])):
                    rules[i], verdicts[i] = got
            for name, values in (("rule", rules), ("verdict", verdicts)):
                t = t.set_column(t.schema.get_field_index(name), name, pa.array(values, pa.string()))
            yield from t.to_batches()

    return run


def filter_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow", rules_per_sweep: int = RULES_PER_SWEEP) -> DataFrame:
    """Judge every url by the longest fitting rule.

    ``rules`` has host, path and verdict (``allow`` or ``block``). A rule fits its
    host and all subdomains where the url's path starts with the rule's path.

    Returns ``id_col, host, path, rule, verdict``. Defined cases: a null url or one
    without ``://`` has empty host and path, fits no rule and gets ``default``;
    repeated rows are each judged; a url of any length is judged whole; a rule with a
    null part is no rule; a rule may repeat, and of equal rules with both verdicts
    ``block`` holds; an empty rule table gives ``default`` everywhere, and an empty table
    of pages no rows; other columns of either table are ignored. Every
    ``rules_per_sweep`` rules take a sweep of their own.
    """
    spark = pages.sparkSession
    parts = pages.select(F.col(id_col).alias("id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    keyed = parts.select("id", "host", "path", F.reverse(F.split("host", r"\.")).alias("key"), F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    clean = rules.select(ascii_lower(F.col("host")).alias("host"), "path", "verdict").dropna().groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    # The path and the id let a host with a third of all rows be cut into many ranges.
    swept = keyed.repartitionByRange("key", "path", "id").sortWithinPartitions("key", "path")
    for held in batched(clean.toLocalIterator(), rules_per_sweep):
        swept = swept.mapInArrow(_sweep(spark.sparkContext.broadcast([tuple(r) for r in held])), swept.schema)
    return swept.select(F.col("id").alias(id_col), "host", "path", "rule", "verdict")
