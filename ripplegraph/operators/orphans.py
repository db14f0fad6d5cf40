"""References to records that do not exist.

Per parent key a pending-orphan state is maintained over an ordered stream of events: a new reference probes whether the
parent is there and waits if not, an arriving parent resolves the waiting references, a deleted one reopens them. What
comes out are spans of time in which a reference had no parent; snapshots count them periodically.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplegraph.runtime import broadcast_if_small, checkpointed, stored

#: Order of the events of one moment: parents come and go before references are looked at.
PARENT_LEAVES, PARENT_ARRIVES, REFERENCE_CLOSES, REFERENCE_OPENS = range(4)
#: References to one key that one task follows; those of a hotter key are spread over salts, each with the parent's few events.
HOT_ROWS = 100_000

_TIE_BITS = 32


class PendingOrphans:
    """The state of one parent key."""

    __slots__ = ("attached", "present", "waiting")

    def __init__(self) -> None:
        self.present = False
        self.waiting: dict[str, int] = {}
        self.attached: set[str] = set()

    def apply(self, seq: int, op: int, ident: str | None) -> list[tuple[str, int, int]]:
        """The spans (reference, since, until) that this event ends."""
        if op == REFERENCE_OPENS:
            if self.present:
                self.attached.add(ident)
            else:
                self.waiting.setdefault(ident, seq)
        elif op == REFERENCE_CLOSES:
            self.attached.discard(ident)
            since = self.waiting.pop(ident, None)
            if since is not None and since < seq:
                return [(ident, since, seq)]
        elif op == PARENT_ARRIVES:
            self.present = True
            ended = [(i, since, seq) for i, since in self.waiting.items() if since < seq]
            self.attached.update(self.waiting)
            self.waiting.clear()
            return ended
        else:
            self.present = False
            self.waiting.update(dict.fromkeys(self.attached, seq))
            self.attached.clear()
        return []

    def rest(self) -> list[tuple[str, int, None]]:
        return [(i, since, None) for i, since in self.waiting.items()]


_SPANS = pa.schema([("ident", pa.string()), ("since", pa.int64()), ("since_tie", pa.int64()), ("until", pa.int64()), ("until_tie", pa.int64())])
SPAN_SCHEMA = "ident string, since long, since_tie long, until long, until_tie long"


def _batch(spans: list[tuple[str, int, int | None]]) -> pa.RecordBatch:
    """Spans whose moments are (seq, tie) in one number each."""
    low = (1 << _TIE_BITS) - 1
    ident, since, until = zip(*spans, strict=True)
    high = lambda m: None if m is None else m >> _TIE_BITS
    tie = lambda m: None if m is None else m & low
    cols = (ident, map(high, since), map(tie, since), map(high, until), map(tie, until))
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(cols, _SPANS, strict=True)], schema=_SPANS)


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Events come with the keys together and in order; one key's state is alive at a time."""
    at, state = None, PendingOrphans()
    for b in batches:
        out: list[tuple] = []
        for k1, k2, salt, seq, tie, op, ident in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if (k1, k2, salt) != at:
                out += state.rest()
                at, state = (k1, k2, salt), PendingOrphans()
            out += state.apply((seq << _TIE_BITS) | tie, op, ident)
        if out:
            yield _batch(out)
    if left := state.rest():
        yield _batch(left)


def orphan_spans(events: DataFrame) -> DataFrame:
    """(ident, since, until) for each time a reference had no parent; until is null while that lasts.

    ``events`` has key, seq, op and ident (the reference; null for parents). Events of a moment are ordered by op; repeats
    change nothing. With a column ``tie`` (not negative) moments are (seq, tie), and spans have since_tie and until_tie too.
    Rows with a null key or seq are no events; other columns are ignored; no events give no spans.

    Scale: keys shrink to 128-bit hashes, the events are written once, as they are read to count and to follow them, and
    shuffled once. However many references a key has, HOT_ROWS at most go to one task: the others are spread over salts by
    their ident, and the parent's events, few as they are, are copied to each salt.
    """
    tied = "tie" in events.columns
    tie = F.col("tie").cast("long") if tied else F.lit(0).cast("long")
    e = events.where("key is not null and seq is not null")
    e = stored(e.select(F.xxhash64("key").alias("k1"), F.xxhash64(F.lit(1), "key").alias("k2"), "seq", tie.alias("tie"), "op", "ident"))
    per = e.where(F.col("op") >= REFERENCE_CLOSES).groupBy("k1", "k2").agg(F.count("*").alias("n"))
    hot = checkpointed(per.where(F.col("n") > HOT_ROWS).select("k1", "k2", F.ceil(F.col("n") / HOT_ROWS).cast("int").alias("salts")))
    e = e.join(broadcast_if_small(hot), ["k1", "k2"], "left")
    salts = F.coalesce("salts", F.lit(1))
    mine = F.array(F.pmod(F.xxhash64("ident"), salts.cast("long")).cast("int"))
    e = e.withColumn("salt", F.explode(F.when(F.col("op") >= REFERENCE_CLOSES, mine).otherwise(F.sequence(F.lit(0), salts - 1))))
    keys = ["k1", "k2", "salt"]
    e = e.select(*keys, "seq", "tie", "op", "ident").repartition(*keys).sortWithinPartitions(*keys, "seq", "tie", "op")
    spans = e.mapInArrow(_spans, SPAN_SCHEMA)
    return spans if tied else spans.select("ident", "since", "until")


def orphans_per_snapshot(spans: DataFrame, snapshots: DataFrame) -> DataFrame:
    """(snapshot_id, columns of spans): each span counted at every snapshot of its repository that lies in it.

    ``spans`` has repo and since, since_tie, until, until_tie, and begins at a snapshot; ``snapshots`` repo, snapshot_id, idx
    (1, 2, ... in order of seq and tie), n (snapshots of the repository), seq and tie. Where a span ends at a snapshot, or not
    at all, its snapshots are a range of positions and nothing else is met; only spans that end between two snapshots look
    for their end. Broadcast only while the table of snapshots is small, else joins by repository and position.
    """
    s = broadcast_if_small(snapshots)
    at = lambda p, *cs: s.select(F.col("repo").alias(f"_r{p}"), F.col("seq").alias(f"_s{p}"), F.col("tie").alias(f"_t{p}"), *cs)
    first, last = at(1, F.col("idx").alias("lo"), "n"), at(2, F.col("idx").alias("hi"))
    when = lambda p, c: F.col("repo").eqNullSafe(F.col(f"_r{p}")) & (F.col(c) == F.col(f"_s{p}")) & (F.col(f"{c}_tie") == F.col(f"_t{p}"))
    x = spans.join(first, when(1, "since")).join(last, when(2, "until"), "left")
    x = x.withColumn("hi", F.when(F.col("until").isNull(), F.col("n") + 1).otherwise(F.col("hi")))
    own = [c for c in spans.columns if c not in ("since", "since_tie", "until", "until_tie")]
    name = s.select(F.col("repo").alias("_r"), F.col("idx").alias("_i"), "snapshot_id")
    known = x.where("hi is not null").select(*own, F.explode(F.sequence("lo", F.col("hi") - 1)).alias("idx"))
    known = known.join(name, F.col("repo").eqNullSafe(F.col("_r")) & (F.col("idx") == F.col("_i"))).select("snapshot_id", *own)
    later = s.select(F.col("repo").alias("_r"), F.col("idx").alias("_i"), F.col("seq").alias("_s"), "snapshot_id")
    # Such an end lies between two snapshots' times, or at the first of those of its microsecond.
    inside = F.col("repo").eqNullSafe(F.col("_r")) & (F.col("_i") >= F.col("lo")) & (F.col("_s") < F.col("until"))
    return known.unionByName(x.where("hi is null").join(later, inside).select("snapshot_id", *own))
