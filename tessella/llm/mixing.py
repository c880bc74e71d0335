"""Sources interleaved to target weights by proportionate-fair scheduling."""

from __future__ import annotations

import heapq
from bisect import bisect_right
from collections.abc import Iterator
from decimal import Decimal
from fractions import Fraction
from itertools import accumulate
from math import ceil, lcm, log2

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.llm.common import dealt, durable, text_of

#: Bytes of a block; power of a source's bytes that its weight follows where none is given.
BLOCK, TEMPER = 1 << 16, 0.5
#: Slots that are scheduled together; bytes of a bucket of rows on average; bits of the number of buckets at most; times
#: the average from which a bucket is hot, and dealt out further.
SEGMENT, BUCKET, BITS, HOT = 256, 1 << 20, 20, 16
#: What shares add up to where the weights have no smaller exact form, in bits.
PRECISION = 62


def order(shares: list[int], blocks: list[int]) -> Iterator[tuple[int, int, int, int]]:
    """(source, block, release, deadline) of each slot, from slot 0 on, in exact whole numbers: the plain form of
    `slots`, one slot after the other.

    While sources last, they are served at once in proportion to their shares, each at most for its blocks:
    that is the target. Block j of a source is released at the floor of when its target starts it and due at
    the ceiling of when its target ends it; each slot goes to the released block that is due first. As the
    targets fill every slot, every block meets its deadline, and no source is ever a whole block ahead of its
    target or behind, whichever sources have ended. Sources without a share come after all others, evenly.
    """
    begin = 0
    for some in _phases(shares, blocks):
        share = {s: shares[s] if shares[s] > 0 else 1 for s in some}
        # By when they end: at that time, what the first k have had in all, and the shares of those left.
        ends = sorted(some, key=lambda s: (Fraction(blocks[s], share[s]), s))
        about = [blocks[s] / share[s] for s in ends]
        had, left = [0, *accumulate(blocks[s] for s in ends)], [0, *accumulate(share[s] for s in reversed(ends))][::-1]

        def when(s: int, j: int) -> tuple[int, int]:
            """The time at which the target of s has had j blocks, as a fraction."""
            n = share[s]
            k = bisect_right(about, j / n)
            while k < len(ends) and blocks[ends[k]] * n < j * share[ends[k]]:
                k += 1
            while k and blocks[ends[k - 1]] * n >= j * share[ends[k - 1]]:
                k -= 1
            return had[k] * n + j * left[k], n

        def window(s: int, j: int) -> tuple[int, int]:
            start, n = when(s, j)
            end, _ = when(s, j + 1)
            return begin + start // n, begin - (-end // n)

        waiting = [(*window(s, 0), s, 0) for s in some]
        heapq.heapify(waiting)
        ready: list[tuple[int, int, int, int]] = []
        total = begin + had[-1]
        for t in range(begin, total):
            while waiting and waiting[0][0] <= t:
                release, due, s, j = heapq.heappop(waiting)
                heapq.heappush(ready, (due, s, j, release))
            due, s, j, release = heapq.heappop(ready)
            if due <= t:
                raise AssertionError("a deadline was missed")
            yield s, j, release, due
            if j + 1 < blocks[s]:
                heapq.heappush(waiting, (*window(s, j + 1), s, j + 1))
        begin = total


def _phases(shares: list[int], blocks: list[int]) -> list[list[int]]:
    """Sources with blocks: those with a share, then those without."""
    return [[s for s, n in enumerate(shares) if (n > 0) == first and blocks[s] > 0] for first in (True, False)]


def whole_shares(weights: list[float]) -> list[int]:
    """Whole numbers in the proportion of the weights, exactly if they then add up to PRECISION bits at most, else
    rounded to that (an error of 2^-30 of a block after 2^32 slots); all 1 if none is above zero."""
    exact = [Fraction(max(0, w)) for w in weights]
    scale = Fraction(lcm(*(x.denominator for x in exact)))
    total = sum(exact)
    if not total:
        return [1] * len(exact)
    if total * scale > 1 << PRECISION:
        scale = (1 << PRECISION) / total
    return [max(1, round(x * scale)) if x else 0 for x in exact]


_WHOLE = "decimal(38,0)"


def _let(value: str, name: str, body: str) -> str:
    """SQL: body, with value as name."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _when(x: str, j: str, up: bool) -> str:
    """SQL: the time at which the target of source x has had j blocks, rounded down or up."""
    more = f" + {x}.share - 1" if up else ""
    return _let(f"element_at(filter(ends, p -> p.last * {x}.share < {j} * p.of), -1)", "p", f"((p.had * {x}.share + {j} * p.left{more}) div {x}.share)")


def _phase(t: str, body: str) -> str:
    """SQL: body, with what holds at time t as p."""
    return _let(f"element_at(filter(ends, p -> p.at <= {t}), -1)", "p", body)


def _target(x: str, t: str, up: bool) -> str:
    """SQL, within _phase: how many blocks the target of source x has had at time t, rounded down or up."""
    return f"least({x}.blocks, (({x}.share * ({t} - p.had){' + p.left - 1' if up else ''}) div p.left))"


def _next(x: str, j: str) -> str:
    """SQL: the state of source x whose next block is j: never released if there is none."""
    never = "9223372036854775807"
    return (
        f"if({j} < {x}.blocks, named_struct('source', {x}.source, 'share', {x}.share, 'blocks', {x}.blocks, 'next', cast({j} as bigint), 'release', cast({_when(x, f'cast({j} as {_WHOLE})', False)} as bigint), "
        f"'due', cast({_when(x, f'cast({j} + 1 as {_WHOLE})', True)} as bigint)), "
        f"named_struct('source', {x}.source, 'share', {x}.share, 'blocks', {x}.blocks, 'next', cast({j} as bigint), 'release', {never}, 'due', {never}))"
    )


def _held(spark: SparkSession, ends: list[tuple[int, ...]], sources: list[tuple[int, ...]]) -> DataFrame:
    """One row, of one struct, of both tables."""
    whole = pa.decimal128(38)

    def made(rows: list[tuple[int, ...]], **kinds: pa.DataType) -> pa.Array:
        columns = [pa.array([Decimal(x) if kind == whole else x for x in column], kind) for column, kind in zip(zip(*rows, strict=True), kinds.values(), strict=True)]
        return pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), pa.StructArray.from_arrays(columns, list(kinds)))

    table = pa.table({
        "ends": made(ends, at=pa.int64(), had=whole, left=whole, last=whole, of=whole),
        "sources": made(sources, source=pa.int32(), share=whole, blocks=pa.int64()),
    })
    return spark.createDataFrame(table).select(F.struct("ends", "sources").alias("held"))


def slots(spark: SparkSession, shares: list[int], blocks: list[int], segment: int = SEGMENT) -> DataFrame:
    """(source int, block, release, deadline, slot): the schedule of `order`, a segment of slots a row of work.

    What has run before time T follows without the slots before it. A block due by T has run. Of each source, at
    most one other block was released before T; as earliest deadline first lets blocks due by T go before, such a
    block has run if it found a free slot, in turn by deadline. It does exactly if, for every time t up to its
    release, the blocks released from t on that are due by T or are in already do not fill the slots from t to T.
    Those are counts from the targets. Up to the earliest release of these blocks they leave room for as many as
    are missing before T, and so they do while the targets of the blocks released have moved by less than one
    block together; later times are gone through one by one. So every segment finds its own beginning, and is then
    scheduled slot by slot. The driver holds a row for each source, never the blocks. A segment costs as many steps
    as it has slots and sources; finding its beginning, at most the longest window of a block times the sources.
    """
    out, begin, parts = None, 0, int(spark.conf.get("spark.sql.shuffle.partitions"))
    for some in _phases(shares, blocks):
        if not some:
            continue
        share = {s: shares[s] if shares[s] > 0 else 1 for s in some}
        ends = sorted(some, key=lambda s: (Fraction(blocks[s], share[s]), s))
        had, left = 0, sum(share.values())
        table = [(0, 0, left, -1, 1)]  # from `at` on, the first ones have had `had`, and shares of `left` go on
        for s in ends:
            had, left = had + blocks[s], left - share[s]
            table.append((-(-(had * share[s] + left * blocks[s]) // share[s]), had, left, blocks[s], share[s]))
        # When the last one ends nothing is left, so that entry is never looked up.
        held = _held(spark, table[:-1], [(s, share[s], blocks[s]) for s in some])
        total = sum(blocks[s] for s in some)
        rows = spark.range(0, -(-total // segment), 1, min(parts, -(-total // segment)))
        rows = rows.select((F.col("id") * segment).alias("t"), F.least(F.lit(total), (F.col("id") + 1) * segment).alias("stop"), held.scalar().alias("held")).select("t", "stop", "held.*")
        rows = rows.withColumn("state", F.expr(_phase("t", f"transform(sources, x -> {_let(_target('x', 't', False), 'j', _next('x', 'j'))})")))
        rows = rows.withColumn("missing", F.expr("t - aggregate(state, 0L, (n, x) -> n + x.next)"))
        # Blocks that were released before t and are due after it, by deadline, and the times of their releases.
        rows = rows.withColumn("astride", F.expr("array_sort(transform(filter(state, x -> x.release < t), x -> named_struct('due', x.due, 'source', x.source, 'release', x.release)))"))
        rows = rows.withColumn("times", F.expr("array_sort(array_distinct(transform(astride, x -> x.release)))"))
        moved = _phase("r", f"aggregate(filter(state, x -> x.release < r), 0D, (n, x) -> n + least(1D, cast(x.share * (r - p.had) as double) / cast(p.left as double) - x.next))")
        free = _phase("u", f"t - u - aggregate(state, 0L, (n, x) -> n + greatest(0L, x.next - {_target('x', 'u', True)}))")
        least = f"if(k = 0 or {moved} < 0.999999D, missing, aggregate(sequence(times[k - 1] + 1, r), missing, (m, u) -> least(m, {free})))"
        rows = rows.withColumn("room", F.expr(f"transform(times, (r, k) -> named_struct('from', r, 'free', {least}))"))
        rows = rows.withColumn("ran", F.expr("""aggregate(astride, named_struct('room', room, 'ran', cast(array() as array<int>)), (a, x) ->
            if(forall(a.room, r -> r.from > x.release or r.free > 0),
               named_struct('room', transform(a.room, r -> if(r.from > x.release, r, named_struct('from', r.from, 'free', r.free - 1))), 'ran', concat(a.ran, array(x.source))), a), a -> a.ran)"""))
        rows = rows.withColumn("state", F.expr(f"transform(state, x -> if(array_contains(ran, x.source), {_next('x', 'x.next + 1')}, x))"))
        first = "array_min(transform(filter(a.state, x -> x.release <= i), x -> named_struct('due', x.due, 'source', x.source, 'block', x.next, 'release', x.release)))"
        made = F.expr(f"""aggregate(sequence(t, stop - 1), named_struct('state', state, 'out', cast(array() as array<struct<due:bigint,source:int,block:bigint,release:bigint>>)), (a, i) ->
            {_let(first, 'f', f"named_struct('state', transform(a.state, x -> if(x.source = f.source, {_next('x', 'x.next + 1')}, x)), 'out', concat(a.out, array(f)))")}, a -> a.out)""")
        made = rows.select("t", F.posexplode(made).alias("nth", "f"))
        made = made.select("f.source", "f.block", (F.col("f.release") + begin).alias("release"), (F.col("f.due") + begin).alias("deadline"), (F.col("t") + F.col("nth") + begin).alias("slot"))
        out = made if out is None else out.unionAll(made)
        begin += total
    return out


def _class() -> Column:
    """With a mark in front, so that a null source has a key as well."""
    return F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))


def _placed(rows: DataFrame, weights: dict[str, float] | None, block: int) -> DataFrame | None:
    """rows (row, source, size, key, crc, nth) with block, release, deadline, slot and start; None if there are none."""
    spark = rows.sparkSession
    rows = rows.withColumn("cls", _class()).withColumn("fine", F.shiftrightunsigned("key", 64 - BITS).cast("int"))
    sums = durable(rows.groupBy("cls", "source", "fine").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")))
    sources = sums.groupBy("cls", "source").agg(F.sum("bytes").alias("bytes")).orderBy(F.desc("bytes"), "source").collect()
    if not sources:
        return None
    if weights:
        unnamed = sum(weights.values()) / len(weights)
        wanted = [float(weights.get(r.source, unnamed)) for r in sources]
    else:
        wanted = [float(r.bytes) ** TEMPER for r in sources]
    blocks = [-(-r.bytes // block) for r in sources]
    total = sum(r.bytes for r in sources)
    bits = min(BITS, max(8, ceil(log2(max(1.0, total / BUCKET)))))
    bucket = F.shiftright("fine", BITS - bits).alias("bucket")
    sums = sums.groupBy("cls", bucket).agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("n")).withColumn("sub", F.lit(0))
    rows = rows.withColumn("bucket", F.shiftright("fine", BITS - bits)).withColumn("sub", F.lit(0))
    # At most 2^BITS / HOT of them can be.
    hot = durable(sums.where((F.col("n") > 1) & (F.col("bytes") > HOT * total / (1 << bits))).select("cls", "bucket", F.ceil(F.col("bytes") * (1 << bits) / total).cast("long").alias("subs")))
    if not hot.isEmpty():
        rows = rows.drop("sub").join(F.broadcast(hot), ["cls", "bucket"], "left")
        # Kept, so that a row has the same place in its table when it is read again.
        rows = durable(rows.withColumn("sub", F.coalesce(F.pmod(F.xxhash64("nth"), "subs"), F.lit(0)).cast("int")).drop("subs"))
        sums = durable(rows.groupBy("cls", "bucket", "sub").agg(F.sum("size").alias("bytes")))
    inside = Window.partitionBy("cls").orderBy("bucket", "sub").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("cls", "bucket", "sub", "bytes", F.coalesce(F.sum("bytes").over(inside), F.lit(0)).alias("before"))

    # The slots of the blocks that begin or go on in a bucket, in order, for each bucket.
    index = pa.table({"source": pa.array(range(len(sources)), pa.int32()), "cls": pa.array([r.cls for r in sources], pa.string())})
    made = slots(spark, whole_shares(wanted), blocks).join(spark.createDataFrame(index), "source").drop("source")
    spread = offsets.select("cls", "bucket", "sub", "before", F.explode(F.expr(f"sequence(before div {block}, (before + bytes - 1) div {block})")).alias("block"))
    of = spread.join(made, ["cls", "block"]).groupBy("cls", "bucket", "sub", "before").agg(F.array_sort(F.collect_list(F.struct("block", "release", "deadline", "slot"))).alias("plan"))

    keys = ["cls", "bucket", "sub"]
    upto = Window.partitionBy(*keys).orderBy("key", "crc", "size", "nth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = rows.withColumn("upto", F.sum("size").over(upto)).join(of, keys)
    placed = placed.withColumn("start", F.col("before") + F.col("upto") - F.col("size"))
    placed = placed.withColumn("at", F.element_at("plan", (F.expr(f"start div {block}") - F.col("plan")[0]["block"] + 1).cast("int")))
    return placed.select("row", "source", "size", "crc", "nth", "at.*", "start")


def _rows(docs: DataFrame, row: Column) -> DataFrame:
    """Rows without an id take the order of their texts' checksums."""
    rows = docs.select(row.alias("row"), F.col("source").cast("string").alias("source"), (F.octet_length(text_of()) + 1).cast("long").alias("size"), F.crc32(text_of().cast("binary")).alias("crc"), F.col("doc_id").alias("id"), F.monotonically_increasing_id().alias("nth"))
    return rows.withColumn("key", F.when(F.col("id").isNull(), F.xxhash64("crc", "size")).otherwise(F.xxhash64("id"))).drop("id")


def interleave(docs: DataFrame, weights: dict[str, float] | None = None, block: int = BLOCK) -> DataFrame:
    """doc_id, source, size, text_crc32, block, release, deadline, slot, start for each row of docs.

    A row weighs the UTF-8 bytes of its text plus one. A source's rows, in the order of their ids' hashes,
    are cut into blocks of `block` bytes: a row belongs to the block in which it starts, and one longer
    than a block uses up those after. Blocks are scheduled for their sources' weights, earliest deadline
    first (`slots`); when a source ends, the others keep their proportions, so every row has a slot, and a
    source's blocks never deviate by one from what its weight gives it (`whole_shares`). Within a slot, rows are
    ordered by start, the bytes of the source before them.

    weights: relative, by source, those of others being their mean; if none are given, a source's is the
    square root of its bytes. Every source is scheduled for itself, however many there are; a null source is
    one of its own. Sources of weight zero come last. Only the table of sources reaches the driver; the schedule
    is made in segments, by SQL functions, and met with rows by source and block. Bytes before a row come from totals
    of (source, bucket) and a window within each bucket, so a source that holds most rows is spread over many
    tasks; buckets that rows of one id make hot are dealt out further by place in the table. Rows of one id, or
    without one, are ordered by text checksum, size and place. An empty table gives an empty result. Repeated rows stay.
    """
    placed = _placed(durable(_rows(docs, F.struct("doc_id"))), weights, block)
    if placed is None:
        kind = dict(docs.dtypes)["doc_id"]
        return docs.sparkSession.createDataFrame([], f"doc_id {kind}, source string, size bigint, text_crc32 bigint, block bigint, release bigint, deadline bigint, slot bigint, start bigint")
    return placed.select("row.doc_id", "source", "size", F.col("crc").alias("text_crc32"), "block", "release", "deadline", "slot", "start")


def mix(docs: DataFrame, weights: dict[str, float] | None = None, block: int = BLOCK) -> DataFrame:
    """docs, all rows and columns, in the order of the schedule (`interleave`): partitions are runs of slots, sorted.

    Rows are carried through the schedule as they are, so nothing is matched afterwards and no column can clash;
    null texts weigh one byte, null ids and sources, repeated rows and ties are as there. An empty table stays
    one. The texts are read twice and shuffled twice, by source and bucket and by slot."""
    placed = _placed(_rows(docs, F.struct(*(F.col(f"`{c}`") for c in docs.columns))), weights, block)
    if placed is None:
        return docs
    order_ = ["slot", "start", "nth"]
    return placed.repartitionByRange(dealt(docs), *order_).sortWithinPartitions(*order_).select("row.*")
