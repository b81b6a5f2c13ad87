"""URL rules by a sort-merge range join.

A host is keyed by its labels in reverse order, each with a dot behind it, so
the subdomains of a rule's host are one interval of keys. Hosts and rules are
swept in key order with a stack of the rules whose interval is open; intervals
nest, as they come from prefixes.
"""

from __future__ import annotations

import bisect

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import LOWER, ascii_lower, stored, trimmed

#: (host, path, verdict)
RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]
#: Characters of rules sent to each task at most; more are dealt to the key ranges that they cover.
MOST_SENT = 8 << 20


def host_of(url: Column) -> Column:
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    return F.when(F.instr(url, "://") > 0, ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0))).otherwise("")


def path_of(url: Column) -> Column:
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    return F.when(F.instr(url, "://") > 0, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)).otherwise("")


def key_of(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


class Paths:
    """The rules of one host: (path, host + path, verdict); finds the longest that a path starts with."""

    def __init__(self):
        self.rules: dict[str, tuple[str, str]] = {}
        self.sizes: list[int] = []

    def add(self, path: str, rule: str, verdict: str) -> None:
        if path not in self.rules and len(path) not in self.sizes:
            bisect.insort(self.sizes, len(path))
        self.rules[path] = rule, verdict

    def longest(self, path: str):
        """(length of host and path, length of path, rule, verdict), or nothing."""
        for n in reversed(self.sizes):
            if n <= len(path) and (found := self.rules.get(path[:n])):
                return len(found[0]), n, *found
        return None


class Sweep:
    """A pass over hosts in key order with a stack of the rules whose intervals are open."""

    def __init__(self, default: str):
        self.stack: list[tuple[str, Paths]] = []
        self.default = default

    def _leave(self, key: str) -> None:
        while self.stack and not key.startswith(self.stack[-1][0]):
            self.stack.pop()

    def rule(self, key: str, path: str, rule: str, verdict: str) -> None:
        self._leave(key)
        if not self.stack or self.stack[-1][0] != key:
            self.stack.append((key, Paths()))
        self.stack[-1][1].add(path, rule, verdict)

    def judge(self, key: str, path: str) -> tuple[str | None, str]:
        self._leave(key)
        fits = [x for _, own in self.stack if (x := own.longest(path))]
        best = max(fits, key=lambda x: x[:2], default=None)
        return (best[2], best[3]) if best else (None, self.default)


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] | DataFrame = RULES, id_col: str = "page_id", url_col: str = "url", default: str = "allow", most_sent: int = MOST_SENT) -> DataFrame:
    """Every page: page_id, host, path, rule, verdict.

    A rule (host, path, verdict) fits its host and all subdomains when the url's
    path starts with the rule's. The longest fitting rule wins (host and path
    together; on equal length the longer path). Without one, rule is null and
    verdict is ``default``. Hosts of rules are lower-cased in A-Z, as those of
    urls; rules with a null are ignored; of rules with equal host and path the
    smaller verdict counts.

    A null url or one without ``://`` has empty host and path and fits no rule
    but one of an empty host. Repeated and null ids stay rows of their own; no
    rows give no rows; other columns are not carried. Pages are ranged by key
    and id together, so one host may span many partitions.

    Rules of up to ``most_sent`` characters go to each task. More are dealt as
    rows to the ranges that their intervals meet, and every range is swept in
    the same way; the rows are the same.
    """
    spark = pages.sparkSession
    kind = pages.schema[id_col].dataType.simpleString()
    schema = f"page_id {kind}, host string, path string, rule string, verdict string"
    url = F.col(url_col).cast("string")
    base = pages.select(F.col(id_col).alias("page_id"), F.coalesce(host_of(url), F.lit("")).alias("host"), F.coalesce(path_of(url), F.lit("")).alias("path"))
    keyed = base.withColumn("key", key_of(F.col("host"))).repartitionByRange("key", "page_id")
    every = _listed(rules) if not isinstance(rules, DataFrame) else None
    if every is not None and sum(len(r[2]) + len(r[3]) + 8 for r in every) > most_sent:
        rules, every = spark.createDataFrame([tuple(r) for r in rules], "host string, path string, verdict string"), None
    if every is None:
        once = rules.where("host IS NOT NULL AND path IS NOT NULL AND verdict IS NOT NULL").groupBy(ascii_lower(F.col("host")).alias("host"), "path").agg(F.min("verdict").alias("verdict"))
        once = once.select(key_of(F.col("host")).alias("key"), "path", F.concat("host", "path").alias("rule"), "verdict")
        if (once.agg(F.sum(F.length("rule") + F.length("verdict") + 8)).first()[0] or 0) > most_sent:
            return _dealt(keyed, once, default, kind, schema)
        every = sorted((tuple(r) for r in once.collect()), key=lambda r: (r[0].encode(), r[1]))
    order = [r[0].encode() for r in every]

    def run(batches):
        at, sweep = None, Sweep(default)
        for batch in batches:
            found, verdicts = [], []
            for key, path in zip(batch.column(3).to_pylist(), batch.column(2).to_pylist()):
                code = key.encode()
                if at is None:  # the intervals that were opened before this partition: prefixes of its first key
                    parts = key.split(".")[:-1]
                    for i in range(1, len(parts)):
                        prefix = ".".join(parts[:i]) + "."
                        for k in range(bisect.bisect_left(order, prefix.encode()), bisect.bisect_right(order, prefix.encode())):
                            sweep.rule(*every[k])
                    at = bisect.bisect_left(order, code)
                while at < len(order) and order[at] <= code:
                    sweep.rule(*every[at])
                    at += 1
                rule, verdict = sweep.judge(key, path)
                found.append(rule)
                verdicts.append(verdict)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(found, pa.string()), pa.array(verdicts, pa.string())], names=["page_id", "host", "path", "rule", "verdict"])

    return keyed.sortWithinPartitions("key").mapInArrow(trimmed(run), schema)


def _listed(rules: list[tuple[str, str, str]]) -> list[tuple[str, str, str, str]]:
    """(key, path, rule, verdict) of rules that the caller holds, by key and path; they need no job."""
    once: dict[tuple[str, str], str] = {}
    for host, path, verdict in rules:
        if None not in (host, path, verdict):
            at = host.translate(LOWER), path
            once[at] = min(verdict, once.get(at, verdict))
    found = [(".".join(reversed(h.split("."))) + ".", p, h + p, v) for (h, p), v in once.items()]
    return sorted(found, key=lambda r: (r[0].encode(), r[1]))


def _dealt(keyed: DataFrame, rules: DataFrame, default: str, kind: str, schema: str) -> DataFrame:
    """As judge(), for rules of any number: each range of pages is swept together with the rules that meet it."""
    placed = stored(keyed.withColumn("range", F.spark_partition_id()), "urls")
    ends = [(r[0], r[1].encode(), r[2].encode()) for r in placed.groupBy("range").agg(F.min("key"), F.max("key")).collect()]  # a row for each partition
    ends.sort(key=lambda e: e[1])
    lows, highs = [e[1] for e in ends], [e[2] for e in ends]

    def deal(batches):
        """A rule in each range that holds keys between its own and the last one that it is a prefix of."""
        for batch in batches:
            keys = batch.column(0).to_pylist()
            at, where = [], []
            for i, key in enumerate(keys):
                code = key.encode()
                for k in range(bisect.bisect_left(highs, code), bisect.bisect_left(lows, code + b"\xff")):
                    at.append(i)
                    where.append(ends[k][0])
            out = batch.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(where, pa.int32()), *out.columns], names=["range", "key", "path", "rule", "verdict"])

    dealt = rules.mapInArrow(trimmed(deal), "range int, key string, path string, rule string, verdict string")
    none = lambda t, name: F.lit(None).cast(t).alias(name)
    both = dealt.select("range", "key", F.lit(0).alias("side"), none(kind, "page_id"), none("string", "host"), "path", "rule", "verdict")
    both = both.unionByName(placed.select("range", "key", F.lit(1).alias("side"), "page_id", "host", "path", none("string", "rule"), none("string", "verdict")))

    def run(batches):
        now, sweep = None, None
        for batch in batches:
            ranges, keys, sides, paths, rules_, verdicts_ = (batch.column(i).to_pylist() for i in (0, 1, 2, 5, 6, 7))
            at, found, verdicts = [], [], []
            for i, (where, key, side, path) in enumerate(zip(ranges, keys, sides, paths)):
                if where != now:
                    now, sweep = where, Sweep(default)
                if side:
                    rule, verdict = sweep.judge(key, path)
                    at.append(i)
                    found.append(rule)
                    verdicts.append(verdict)
                else:
                    sweep.rule(key, path, rules_[i], verdicts_[i])
            out = batch.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([out.column(3), out.column(4), out.column(5), pa.array(found, pa.string()), pa.array(verdicts, pa.string())], names=["page_id", "host", "path", "rule", "verdict"])

    return both.repartition("range").sortWithinPartitions("range", "key", "side").mapInArrow(trimmed(run), schema)
