"""Overlapping and gapped intervals: continuous periods and the gaps between them.

An ordered map of disjoint intervals is kept per entity in keyed state. Each insertion locates overlaps by binary search
and merges them, which moves the gaps. The map serves three places: a combiner before the shuffle, the keyed pass over
range partitions behind it, and the streaming operator in ``ripplegraph.streaming.intervals``.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ripplegraph.runtime import broadcast_if_small, checkpointed

#: Intervals the combiner holds before it hands on what it has; bounds its memory, not the result.
COMBINER_INTERVALS = 200_000


class IntervalMap:
    """Disjoint closed integer intervals in order; neighbours that touch are one."""

    __slots__ = ("ends", "starts")

    def __init__(self, starts: list[int] | None = None, ends: list[int] | None = None) -> None:
        self.starts, self.ends = starts or [], ends or []

    def insert(self, start: int, end: int) -> int:
        """Adds [start, end]; returns by how much the number of periods changed."""
        starts, ends = self.starts, self.ends
        if not ends or start > ends[-1] + 1:  # behind all
            starts.append(start)
            ends.append(end)
            return 1
        lo = bisect_left(ends, start - 1)  # the first period that reaches start
        hi = bisect_right(starts, end + 1)  # the first period that begins beyond end
        if lo == hi:
            starts.insert(lo, start)
            ends.insert(lo, end)
            return 1
        if hi == lo + 1:
            starts[lo], ends[lo] = min(start, starts[lo]), max(end, ends[lo])
            return 0
        starts[lo:hi], ends[lo:hi] = [min(start, starts[lo])], [max(end, ends[hi - 1])]
        return 1 - (hi - lo)

    def periods(self) -> list[tuple[int, int]]:
        return list(zip(self.starts, self.ends, strict=True))

    def gaps(self) -> list[tuple[int, int]]:
        return [(e + 1, s - 1) for e, s in zip(self.ends, self.starts[1:], strict=False)]


_SPANS = pa.schema([("k", pa.string()), ("s", pa.int64()), ("e", pa.int64())])


def _batch(keys: list[str], maps: list[IntervalMap]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            pa.array([k for k, m in zip(keys, maps, strict=True) for _ in m.starts], pa.string()),
            pa.array([x for m in maps for x in m.starts], pa.int64()),
            pa.array([x for m in maps for x in m.ends], pa.int64()),
        ],
        schema=_SPANS,
    )


def _combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merges what a task reads, by key, in whatever order it comes."""
    state: dict[str, IntervalMap] = {}
    held = 0
    for b in batches:
        for k, s, e in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            m = state.get(k)
            if m is None:
                m = state[k] = IntervalMap()
            held += m.insert(s, e)
        if held > COMBINER_INTERVALS:
            yield _batch(list(state), list(state.values()))
            state, held = {}, 0
    if state:
        yield _batch(list(state), list(state.values()))


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The keyed pass: rows come with the keys together, one map is alive at a time; a long one is handed on in parts.

    Rows of a key come by start, so periods that end before the last start can no longer change.
    """
    keys: list[str] = []
    maps: list[IntervalMap] = []
    key, m, held = None, IntervalMap(), 0
    for b in batches:
        for k, s, e in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            if k != key:
                if m.starts:
                    keys.append(key)
                    maps.append(m)
                key, m = k, IntervalMap()
            held += m.insert(s, e)
        if held > COMBINER_INTERVALS:  # all but the open last period are final
            keys.append(key)
            maps.append(IntervalMap(m.starts[:-1], m.ends[:-1]))
            m = IntervalMap(m.starts[-1:], m.ends[-1:])
            yield _batch(keys, maps)
            keys, maps, held = [], [], 1
    if m.starts:
        keys.append(key)
        maps.append(m)
    if keys:
        yield _batch(keys, maps)


def merge_intervals(ranges: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., kind, start, end): kind ``period`` for each maximal covered range, ``gap`` for each hole between two.

    ``ranges`` has ``keys`` (strings, null being a key of its own), ``start`` and ``end`` (whole numbers, end included).
    Rows with a null bound or end < start cover nothing. Touching ranges are one. Repeats and ties change nothing; other
    columns are ignored; an empty table gives an empty result.

    Scale: tasks merge what they read before the shuffle. Range partitions by (key, start) then cut a hot key into many
    tasks. A key's pieces are joined across partitions by what each partition knows of its last key: one row a partition
    and key, of which only keys that cross a border matter.
    """
    k = F.to_json(F.struct(*(F.col(c).cast("string").alias(f"k{i}") for i, c in enumerate(keys))))
    rows = ranges.where("start is not null and end is not null and end >= start").select(k.alias("k"), F.col("start").cast("long").alias("s"), F.col("end").cast("long").alias("e"))
    schema = "k string, s long, e long"
    combined = checkpointed(rows.mapInArrow(_combine, schema))
    parts = combined.repartitionByRange("k", "s").sortWithinPartitions("k", "s").mapInArrow(_keyed, schema)
    parts = checkpointed(parts.withColumn("p", F.spark_partition_id()))
    # Borders: a partition's first and last key are the only ones that other partitions may share.
    ends = parts.groupBy("p").agg(F.min("k").alias("first"), F.max("k").alias("last"))
    ends = ends.select("p", F.explode(F.array_distinct(F.array("first", "last"))).alias("k"))
    shared = ends.join(ends.groupBy("k").agg(F.count("*").alias("n")).where("n > 1").select("k"), "k")
    shared = broadcast_if_small(checkpointed(shared))
    inner = parts.join(shared, ["k", "p"], "left_anti").select("k", "p", "s", "e")
    border = parts.join(shared, ["k", "p"], "left_semi")
    # Of a key's partition only the last end reaches beyond it; what it reaches is a run at the next ones' beginning.
    reach = border.groupBy("k", "p").agg(F.max("e").alias("reach"))
    reach = reach.withColumn("carry", F.max("reach").over(W.partitionBy("k").orderBy("p").rowsBetween(W.unboundedPreceding, -1)))
    border = border.join(broadcast_if_small(checkpointed(reach.select("k", "p", "carry"))), ["k", "p"])
    joins = F.col("carry").isNotNull() & (F.col("s") <= F.col("carry") + 1)
    heads = border.where(~joins).select("k", "p", "s", "e")
    tails = border.where(joins).groupBy("k", "p").agg(F.max("e").alias("tail"))
    # A head that is the last of its partition takes the tails of the next partitions up to the one that has a head.
    marks = heads.groupBy("k", "p").agg(F.max("s").alias("head")).join(tails, ["k", "p"], "full")
    w = W.partitionBy("k").orderBy("p")
    owner = F.last("head", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1))
    grown = marks.withColumn("owner", owner).where("tail is not null and owner is not null")
    grown = grown.groupBy("k", F.col("owner").alias("s")).agg(F.max("tail").alias("tail"))
    outer = heads.join(grown, ["k", "s"], "left").select("k", "s", F.greatest("e", F.coalesce("tail", "e")).alias("e"), "p")
    edge = reach.join(tails, ["k", "p"], "left").select("k", "p", F.greatest("carry", "tail").alias("edge"))
    outer = outer.join(broadcast_if_small(checkpointed(edge)), ["k", "p"], "left")
    whole = inner.withColumn("edge", F.lit(None).cast("long")).unionByName(outer)
    # The hole before a period: from the period before it in its partition, or from what earlier partitions reach.
    before = F.lag("e").over(W.partitionBy("k", "p").orderBy("s"))
    x = whole.withColumn("before", F.coalesce(before, "edge"))
    found = F.array(
        F.struct(F.lit("period").alias("kind"), F.col("s").alias("start"), F.col("e").alias("end")),
        F.when(
            F.col("before").isNotNull(),
            F.struct(F.lit("gap").alias("kind"), (F.col("before") + 1).alias("start"), (F.col("s") - 1).alias("end")),
        ),
    )
    names = ", ".join(f"k{i} string" for i in range(len(keys)))
    x = x.select(F.from_json("k", names).alias("k"), F.explode(F.filter(found, lambda r: r.isNotNull())).alias("r"))
    return x.select(*(F.col(f"k.k{i}").alias(c) for i, c in enumerate(keys)), "r.kind", "r.start", "r.end")
