"""Which snapshots count, and which delivered row of a record counts in each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ripplegraph.functions.paths import normalize_path


def delivered_snapshots(snapshots: DataFrame, nodes: DataFrame) -> DataFrame:
    """The distinct snapshots that have a row in ``nodes``; of several rows of one snapshot_id the latest captured."""
    s = snapshots.groupBy("snapshot_id").agg(
        F.max(F.struct("captured_at", "repository_identity", "commit_id")).alias("s")
    )
    return s.join(nodes.select("snapshot_id").distinct(), "snapshot_id", "left_semi").select(
        "snapshot_id", "s.repository_identity", "s.commit_id", "s.captured_at"
    )


def one_per_commit(snapshots: DataFrame) -> DataFrame:
    """Of several snapshots of one commit the last captured; a snapshot without a commit stands for itself."""
    w = W.partitionBy("repository_identity", F.coalesce("commit_id", F.concat(F.lit("\0"), "snapshot_id"))).orderBy(
        F.desc("captured_at"), F.desc("snapshot_id")
    )
    return snapshots.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def with_positions(snapshots: DataFrame) -> DataFrame:
    """Adds ``idx`` (1 for a repository's first snapshot) and ``next_id``, the snapshot after it."""
    w = W.partitionBy("repository_identity").orderBy("captured_at", "snapshot_id")
    return snapshots.withColumns({"idx": F.row_number().over(w), "next_id": F.lead("snapshot_id").over(w)})


def latest_rows(rows: DataFrame, keys: list[str], at: str, payload: list[str]) -> DataFrame:
    """One row per ``keys``: the payload of the greatest ``at``.

    Rows of one ``at`` with other content are settled by the greatest payload, so the result does not depend on order.
    Repeats are combined before the shuffle.
    """
    best = rows.groupBy(*keys).agg(F.max(F.struct(at, *payload)).alias("_best"))
    return best.select(*keys, *(F.col(f"_best.{c}").alias(c) for c in [at, *payload]))


def evidence_id(e: Column) -> Column:
    """``ev:{source_kind}:{file_path}:{start or 0}:{end or 0}`` of an evidence entry."""
    return F.concat(
        F.lit("ev:"),
        F.coalesce(e["source_kind"], F.lit("")),
        F.lit(":"),
        F.coalesce(normalize_path(e["file_path"]), F.lit("")),
        F.lit(":"),
        F.coalesce(e["start_line"], F.lit(0)).cast("string"),
        F.lit(":"),
        F.coalesce(e["end_line"], F.lit(0)).cast("string"),
    )
