"""The containment forests of the newest snapshots, and references in snapshots as keyed events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplegraph.operators.versions import delivered_snapshots, latest_rows
from ripplegraph.runtime import broadcast_if_small, checkpointed


def containment_links(snapshots: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(scope, child, parent) in each repository's latest delivered snapshot.

    ``belongs_to`` leads from child to parent, ``declares`` from parent to child; of several rows of an edge the latest
    delivered counts. Ties of captured_at are settled by the greatest snapshot_id.
    """
    last = delivered_snapshots(snapshots, nodes).groupBy("repository_identity").agg(F.max(F.struct("captured_at", "snapshot_id")).alias("s"))
    last = broadcast_if_small(checkpointed(last.select(F.col("repository_identity").alias("scope"), "s.snapshot_id")))
    e = edges.where("snapshot_id is not null and id is not null").select("snapshot_id", "id", "delivered_at", "kind", "from_id", "to_id")
    e = latest_rows(e.join(last.select("snapshot_id"), "snapshot_id", "left_semi"), ["snapshot_id", "id"], "delivered_at", ["kind", "from_id", "to_id"])
    e = e.where("kind in ('belongs_to', 'declares') and from_id is not null and to_id is not null").join(last, "snapshot_id")
    down = F.col("kind") == "declares"
    return e.select("scope", F.when(down, F.col("to_id")).otherwise(F.col("from_id")).alias("child"), F.when(down, F.col("from_id")).otherwise(F.col("to_id")).alias("parent"))
