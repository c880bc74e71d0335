"""URL filters by a sort-merge range join with a stack of nested rules."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import durable

#: Bytes of the rules open at the starts of partitions that may be broadcast; above it, they are shuffled to them.
OPEN = 1 << 25
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; empty without one."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    return F.coalesce(F.translate(F.regexp_extract(rest, "^[^/?#]*+", 0), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host, up to ? # or the end."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    return F.coalesce(F.regexp_extract(rest, "^[^/?#]*+([^?#]*+)", 1), F.lit(""))


def key_of(host: Column) -> Column:
    """The host's labels from the last to the first, each with a dot after it: those of a host and all its
    subdomains begin with the host's key, so they are one interval."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit("."))


class Sweep:
    """The rules open at a place of the sorted keys, as a stack of hosts, each within the one below."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, dict[str, tuple[str, str]], list[int]]] = []

    def close(self, key: str) -> None:
        while self.stack and not key.startswith(self.stack[-1][0]):
            self.stack.pop()

    def open(self, key: str, path: str, rule: str, verdict: str) -> None:
        self.close(key)
        if not self.stack or self.stack[-1][0] != key:
            self.stack.append((key, {}, []))
        _, paths, lengths = self.stack[-1]
        # Rules of one host and path: block before allow.
        paths[path] = max(paths.get(path, (rule, verdict)), (rule, verdict))
        if len(path) not in lengths:
            lengths.append(len(path))
            lengths.sort(reverse=True)

    def find(self, key: str, path: str) -> tuple[str, str] | None:
        """The longest rule that fits, and its verdict; of equally long ones, the one of the longer host."""
        self.close(key)
        best: tuple[int, tuple[str, str]] | None = None
        for _, paths, lengths in reversed(self.stack):
            for n in lengths:
                if n <= len(path) and (hit := paths.get(path[:n])):
                    if best is None or len(hit[0]) > best[0]:
                        best = (len(hit[0]), hit)
                    break
        return best and best[1]


def rules_frame(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """(verdict, host, path) as a table; or bring one with these columns."""
    return spark.createDataFrame(rules, "verdict string, host string, path string")


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", parts: int | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict for each row of pages (page_id, url).

    A rule (verdict, host, path) fits its host and all subdomains where the url's path begins with its own;
    the longest, as host and path together, wins; where none fits, rule is null and the verdict `default`.

    Pages and rules are range-partitioned together by reversed-host key (rules first, pages further by
    path, id and chance, so one host's pages, and even one page repeated, spread over many partitions) and
    checkpointed. A partition is swept in order with a stack of open rules. Which rules are open where a partition
    starts follows from its first key: those whose key begins it (a key has no more such keys than labels), found
    by an equi-join. They are broadcast if they take no more than OPEN bytes; else they are shuffled, with what is
    swept, to the front of their partition's rows. Null urls, and those without ://, have an empty host and path;
    urls of any length are judged whole. Repeated rows stay; of rules that tie in host and path, block comes before
    allow, and of equally long ones the longer host; only the named columns are read; empty tables are fine.
    """
    url = F.col("url").cast("string")
    own = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"))
    own = own.select(key_of(F.col("host")).alias("key"), F.lit(1).alias("kind"), "path", "page_id", "host", F.lit(None).cast("string").alias("verdict"))
    page_type = dict(pages.dtypes)["page_id"]
    theirs = rules.select(F.translate("host", _UPPER, _LOWER).alias("host"), "path", "verdict").where("host is not null and path is not null and verdict is not null").distinct()
    theirs = theirs.select(key_of(F.col("host")).alias("key"), F.lit(0).alias("kind"), "path", F.lit(None).cast(page_type).alias("page_id"), "host", "verdict")
    count = parts or int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["key", "kind", "path", "page_id", "tie"]
    both = own.unionByName(theirs).withColumn("tie", F.xxhash64(F.monotonically_increasing_id()))
    ranged = durable(both.repartitionByRange(count, *order).sortWithinPartitions(*order).drop("tie").withColumn("part", F.spark_partition_id()))

    firsts = ranged.groupBy("part").agg(F.min("key").alias("first"))
    begins = firsts.select("part", F.explode(_beginnings("first")).alias("key"))
    opened = durable(begins.join(theirs, "key").select("part", "key", "path", "host", "verdict"))
    size = opened.agg(F.sum(F.octet_length("key") + 2 * F.octet_length("path") + F.octet_length("host") + 64)).first()[0] or 0
    seeds: dict[int, list[tuple[str, str, str, str]]] = {}
    if size <= OPEN:
        for r in sorted(opened.collect()):
            seeds.setdefault(r.part, []).append((r.key, r.path, r.host + r.path, r.verdict))
    else:
        before = opened.select("key", F.lit(-1).alias("kind"), "path", F.lit(None).cast(page_type).alias("page_id"), "host", "verdict", "part")
        ranged = ranged.unionByName(before).repartition(count, "part").sortWithinPartitions("part", F.col("kind") >= 0, *order[:-1])
    shared = pages.sparkSession.sparkContext.broadcast(seeds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sweep, now = Sweep(), None
        for batch in batches:
            columns = [batch.column(n).to_pylist() for n in (0, 1, 2, 4, 5, 6)]
            at, rule, verdict = [], [], []
            for n, (key, kind, path, host, said, part) in enumerate(zip(*columns, strict=True)):
                if part != now:
                    sweep, now = Sweep(), part
                    for seed in shared.value.get(part, ()):
                        sweep.open(*seed)
                if kind <= 0:
                    sweep.open(key, path, host + path, said)
                else:
                    hit = sweep.find(key, path)
                    at.append(n)
                    rule.append(hit and hit[0])
                    verdict.append(hit[1] if hit else default)
            some = batch.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([some.column(3), some.column(4), some.column(2), pa.array(rule, pa.string()), pa.array(verdict, pa.string())], names=["page_id", "host", "path", "rule", "verdict"])

    return ranged.mapInArrow(run, f"page_id {page_type}, host string, path string, rule string, verdict string")


def _beginnings(key: str) -> Column:
    """All keys that begin a key, itself included: a.b. has a. and a.b."""
    return F.expr(f"transform(sequence(1, size(split({key}, '[.]', -1)) - 1), n -> concat(substring_index({key}, '.', n), '.'))")
