"""The references of a snapshot graph as events for the pending-orphan state."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ripplegraph.functions.paths import normalize_path
from ripplegraph.operators.orphans import (
    PARENT_ARRIVES,
    PARENT_LEAVES,
    REFERENCE_CLOSES,
    REFERENCE_OPENS,
    orphan_spans,
    orphans_per_snapshot,
)
from ripplegraph.operators.versions import delivered_snapshots, evidence_id, latest_rows
from ripplegraph.runtime import broadcast_if_small, checkpointed

def _moment(at: Column) -> Column:
    return F.unix_micros(at.cast("timestamp"))


def snapshot_sequence(snapshots: DataFrame, nodes: DataFrame) -> DataFrame:
    """(repo, snapshot_id, idx, n, seq, tie, next_seq, next_tie) of the delivered snapshots: their positions of n in the
    repository, and moments (microsecond, number among the snapshots of that microsecond), which order them and everything
    recorded."""
    w = W.partitionBy("repository_identity").orderBy("captured_at", "snapshot_id")
    tie = W.partitionBy("repository_identity", "captured_at").orderBy("snapshot_id")
    s = delivered_snapshots(snapshots, nodes)
    s = s.withColumns({"idx": F.row_number().over(w), "seq": _moment(F.col("captured_at")), "tie": (F.row_number().over(tie) - 1).cast("long")})
    s = s.withColumns({"next_seq": F.lead("seq").over(w), "next_tie": F.lead("tie").over(w), "n": F.count("*").over(W.partitionBy("repository_identity"))})
    return s.select(F.col("repository_identity").alias("repo"), "snapshot_id", "idx", "n", "seq", "tie", "next_seq", "next_tie")


#: Parts of a packed text are parted by a zero character; the sign before escapes that, itself, and null.
_PART, _SIGN = "\0", "\1"


def _packed(*parts: Column) -> Column:
    """Strings, nulls included, as one string that no other parts give."""
    escaped = lambda c: F.replace(F.replace(c, F.lit(_SIGN), F.lit(_SIGN + "s")), F.lit(_PART), F.lit(_SIGN + "p"))
    return F.concat_ws(_PART, *(F.coalesce(escaped(p), F.lit(_SIGN + "n")) for p in parts))


def _unpacked(text: Column, n: int) -> list[Column]:
    parts = F.split(text, _PART)
    plain = lambda c: F.replace(F.replace(c, F.lit(_SIGN + "p"), F.lit(_PART)), F.lit(_SIGN + "s"), F.lit(_SIGN))
    return [F.when(parts[i] != _SIGN + "n", plain(parts[i])) for i in range(n)]


def _with_item(event: Column) -> Callable[[Column], Column]:
    return lambda item: event.withField("item", item)


def _events(rows: DataFrame, *sets: tuple[str, int, int], by: list[str]) -> DataFrame:
    """(by..., name, item, seq, tie, op): where runs of an item over consecutive snapshots open, and behind them close.

    ``rows`` has one row per (by, idx) with seq, tie, next_seq, next_tie and, for each (name, opens, closes), an array of items.
    """
    w = W.partitionBy(*by).orderBy("idx")
    x = rows
    for name, _, _ in sets:
        none = F.array().cast(rows.schema[name].dataType)
        before = F.when(F.lag("idx").over(w) == F.col("idx") - 1, F.lag(name).over(w))
        after = F.when(F.lead("idx").over(w) == F.col("idx") + 1, F.lead(name).over(w))
        x = x.withColumns({f"{name}_before": F.coalesce(before, none), f"{name}_after": F.coalesce(after, none)})
    found = []
    for name, opens, closes in sets:
        for other, seq, tie, op in (("before", "seq", "tie", opens), ("after", "next_seq", "next_tie", closes)):
            moved = F.array_except(name, f"{name}_{other}")
            event = F.struct(F.lit(name).alias("name"), F.col(seq).alias("seq"), F.col(tie).alias("tie"), F.lit(op).alias("op"))
            found.append(F.when(F.col(seq).isNotNull(), F.transform(moved, _with_item(event))))
    flat = F.flatten(F.filter(F.array(*found), lambda a: a.isNotNull()))
    return x.select(*by, F.explode(flat).alias("e")).select(*by, "e.name", "e.item", "e.seq", "e.tie", "e.op")


def graph_orphans(snapshots: DataFrame, nodes: DataFrame, edges: DataFrame, evidence: DataFrame, sem_links: DataFrame) -> DataFrame:
    """(tbl, snapshot_id, rec_id, field, ref): every reference of a delivered snapshot that names nothing in it.

    ``edges``: from_id and to_id need a node of the snapshot. ``nodes``: each evidence entry needs an evidence id recorded
    not after the snapshot. ``sem_links``: ref needs, by kind, a node with that file_path, an evidence id, or a node id.
    Null references are none, repeats count once, the latest delivered row of a record counts. A link without owner_id
    counts under a null rec_id, one without kind as a node id. Empty tables give no rows, other columns are ignored.

    Scale: presence over snapshots becomes two events a run, so a record that stays costs no more than one that does not.
    """
    at = broadcast_if_small(checkpointed(snapshot_sequence(snapshots, nodes)))
    keyed = "snapshot_id is not null and id is not null"
    n = nodes.where(keyed).select("snapshot_id", "id", "delivered_at", normalize_path("file_path").alias("file_path"), F.array_distinct(F.filter(F.transform("evidence", evidence_id), lambda x: x.isNotNull())).alias("refs"))
    n = latest_rows(n, ["snapshot_id", "id"], "delivered_at", ["file_path", "refs"]).join(at, "snapshot_id")
    e = latest_rows(edges.where(keyed).select("snapshot_id", "id", "delivered_at", "from_id", "to_id"), ["snapshot_id", "id"], "delivered_at", ["from_id", "to_id"]).join(at, "snapshot_id")
    when = ["repo", "idx", "seq", "tie", "next_seq", "next_tie"]

    key = lambda kind, *parts: _packed(F.lit(kind), *parts)
    node_key, file_key = (lambda c: key("node", F.col("repo"), c)), (lambda c: key("file", F.col("repo"), c))
    ev_key = lambda c: key("evidence", c)

    some = lambda c: F.filter(F.array(c), lambda x: x.isNotNull())
    both_parent, both_ref = (PARENT_ARRIVES, PARENT_LEAVES), (REFERENCE_OPENS, REFERENCE_CLOSES)
    ident = lambda tbl, rec, field, ref: _packed(F.col("repo"), F.lit(tbl), F.col(rec), field, F.col(ref))
    nobody = F.lit(None).cast("string")

    own = _events(n.select(*when, "id", F.array("id").alias("present"), "refs"), ("present", *both_parent), ("refs", *both_ref), by=["repo", "id"])
    is_ref = F.col("name") == "refs"
    own = own.select(
        F.when(is_ref, ev_key(F.col("item"))).otherwise(node_key(F.col("id"))).alias("key"), "seq", "tie", "op",
        F.when(is_ref, ident("nodes", "id", F.lit("evidence"), "item")).otherwise(nobody).alias("ident"),
    )
    files = n.where("file_path is not null").select(*when, "file_path").distinct().withColumn("present", F.array("file_path"))
    files = _events(files, ("present", *both_parent), by=["repo", "file_path"]).select(file_key(F.col("file_path")).alias("key"), "seq", "tie", "op", nobody.alias("ident"))
    recorded = evidence.where("id is not null and recorded_at is not null").groupBy("id").agg(F.min("recorded_at").alias("at"))
    recorded = recorded.select(ev_key(F.col("id")).alias("key"), _moment(F.col("at")).alias("seq"), F.lit(0).cast("long").alias("tie"), F.lit(PARENT_ARRIVES).alias("op"), nobody.alias("ident"))

    ends = e.select(*when, "id", some(F.col("from_id")).alias("from_id"), some(F.col("to_id")).alias("to_id"))
    ends = _events(ends, ("from_id", *both_ref), ("to_id", *both_ref), by=["repo", "id"])
    ends = ends.select(node_key(F.col("item")).alias("key"), "seq", "tie", "op", ident("edges", "id", F.col("name"), "item").alias("ident"))

    links = sem_links.where("snapshot_id is not null and ref is not null").select("snapshot_id", "owner_id", "kind", "ref").distinct().join(at, "snapshot_id")
    target = F.when(F.col("kind") == "file", file_key(normalize_path("ref"))).when(F.col("kind") == "evidence", ev_key(F.col("ref"))).otherwise(node_key(F.col("ref")))
    links = links.select(*when, ident("sem_links", "owner_id", F.lit("ref"), "ref").alias("ident"), target.alias("key")).distinct()
    links = _events(links.withColumn("open", F.array("key")), ("open", *both_ref), by=["ident", "key"]).select("key", "seq", "tie", "op", "ident")

    events = reduce(DataFrame.unionByName, (own, files, recorded, ends, links))
    parts = dict(zip(("repo", "tbl", "rec_id", "field", "ref"), _unpacked(F.col("ident"), 5), strict=True))
    spans = checkpointed(orphan_spans(events).select(*(c.alias(k) for k, c in parts.items()), "since", "since_tie", "until", "until_tie"))
    found = lambda df: orphans_per_snapshot(df, at).select("tbl", "snapshot_id", "rec_id", "field", "ref")
    # One link may be asked for under several kinds; all other references have one parent key.
    return found(spans.where("tbl <> 'sem_links'")).unionByName(found(spans.where("tbl = 'sem_links'")).distinct())
