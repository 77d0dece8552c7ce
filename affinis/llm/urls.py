"""URL filters (operator 8): a sorted digest array of rules.

A rule is a host and a path prefix, written ``host/prefix``. It fits its host and all
subdomains, if the url's path starts with the rule's; the longest fitting rule decides.
Rules are kept as 64-bit xxhash keys in sorted order with their full strings beside
them. A url is looked up by probes: every host suffix with every path prefix of a length
that rules have. Probes are hashed, found by binary search on the mapped array, all of
a batch at once, and a hit counts only if the stored string is equal, so collisions of
keys never decide.

Two lists share the array: stated rules, and a list of blocked hosts that is the
method's own verdict where no stated rule fits. Without a hit in either, a url is allowed.

Defined cases: a null url, or one without ``://``, has an empty host and path, which no
rule fits. Rules stated twice count once; of two verdicts for one rule, block wins.
Repeated rows each get their result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from affinis.llm.mapped import BYTES, MappedTable, places, publish
from affinis.llm.text import batches, materialise

SEED = 42  # what the SQL function xxhash64 uses
RULES = {
    "org/": "allow", "example.org/es/": "block", "example.org/en/1": "block", "com/fr/": "allow", "com/de/": "block"}
# Hosts of the method's own list, in any of the usual domains.
BLOCKED = [
    f"{name}.example.{domain}/" for name in ("spam-farm", "cheap-pills", "casino-win", "adult-x", "free-bets", "ads-track")
    for domain in ("com", "net", "org")]
STATED, LISTED = 1, 0

_JUDGED = pa.schema([("page_id", pa.int64()), ("host", pa.string()), ("path", pa.string()), ("rule", pa.string()), ("verdict", pa.string())])


def rule_table(spark: SparkSession, stated: dict[str, str] = RULES, blocked: list[str] = BLOCKED) -> DataFrame:
    """``rule, verdict, rank`` of rules given as Python values; larger lists come as tables of this form."""
    rows = [(r, v, STATED) for r, v in stated.items()] + [(r, "block", LISTED) for r in blocked]
    return spark.createDataFrame(rows, "rule string, verdict string, rank int")


class Filter:
    """The published rules and the path lengths that occur in them."""

    def __init__(self, table: MappedTable, lengths: list[int]):
        self.table, self.lengths = table, lengths


def compiled(rules: DataFrame, mounted: bool | None = None) -> Filter:
    """Rules as a sorted digest array in the shared folder."""
    # A rule starts with its host, lower-cased; one without a slash gets it.
    rule = F.when(F.instr("rule", "/") == 0, F.concat("rule", F.lit("/"))).otherwise(F.col("rule"))
    host = F.translate(F.substring_index(rule, "/", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    keyed = (
        rules.where("rule is not null").withColumn("rule", F.concat(host, F.substring(rule, F.length(host) + 1, F.length(rule))))
        .groupBy("rule", "rank").agg(F.max("verdict").alias("verdict")))
    keyed = materialise(keyed.select(
        F.xxhash64("rule").alias("key"), "rule", (F.col("rank") * 2 + (F.col("verdict") == "block").cast("int")).alias("kind"),
        (F.length("rule") - F.length(F.substring_index("rule", "/", 1))).alias("length")), "rules")
    # At most as many lengths as the longest path has characters.
    lengths = [r["length"] for r in keyed.select("length").distinct().orderBy("length").collect()]
    return Filter(publish(keyed, keyed.count(), {"key": np.int64, "rule": BYTES, "kind": np.int32}, "rules-mapped", mounted), lengths)


def parts_of(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    for stop in "?#":
        rest = rest.partition(stop)[0]
    host, slash, path = rest.partition("/")
    # Only A to Z, not every letter with a lower case.
    return host.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass"), slash + path


def probes(host: str, path: str, lengths: list[int]) -> Iterator[str]:
    """Every rule that could fit, longest host first."""
    if not host:
        return
    at = 0
    while True:
        for n in lengths:
            if n <= len(path):
                yield host[at:] + path[:n]
        at = host.find(".", at) + 1
        if not at:
            return


def judged(pages: DataFrame, rules: Filter) -> DataFrame:
    """``page_id, host, path, rule, verdict`` of every row of ``pages``."""

    def rows(parts) -> Iterator[tuple]:
        table = rules.table.arrays()
        for batch in parts:
            ids, urls = batch.column("page_id").to_pylist(), batch.column("url").to_pylist()
            split = [parts_of(u) for u in urls]
            owner, strings = [], []
            for i, (host, path) in enumerate(split):
                for probe in probes(host, path, rules.lengths):
                    owner.append(i)
                    strings.append(probe.encode("utf-8", "surrogatepass"))
            digests = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in strings), np.uint64, len(strings)).view(np.int64)
            order = np.argsort(digests)
            at, hit = places(table["key"], digests[order])
            best: dict[tuple[int, int], tuple[int, str, str]] = {}
            for k, place in zip(order[hit].tolist(), at[hit].tolist(), strict=True):
                # Equal keys lie side by side; the strings tell which of them is meant.
                while place < len(table["key"]) and table["key"][place] == digests[k]:
                    stored = table["rule"][table["rule_at"][place] : table["rule_at"][place + 1]].tobytes()
                    if stored == strings[k]:
                        rank, block = divmod(int(table["kind"][place]), 2)
                        found = len(stored), stored.decode(), "block" if block else "allow"
                        best[owner[k], rank] = max(best.get((owner[k], rank), (0, "", "")), found)
                    place += 1
            for i, (host, path) in enumerate(split):
                stated, listed = best.get((i, STATED)), best.get((i, LISTED))
                decided = stated or listed
                yield ids[i], host, path, stated[1] if stated else None, decided[2] if decided else "allow"

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url")).mapInArrow(
        lambda parts: batches(rows(parts), _JUDGED), "page_id long, host string, path string, rule string, verdict string")
