"""What changed between full snapshots.

Each key is windowed by snapshot position: a lag hash that differs reveals a change, a hole in the positions reveals a
removal and a later addition.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ripplegraph.functions.paths import normalize_path
from ripplegraph.operators.versions import delivered_snapshots, latest_rows, one_per_commit, with_positions
from ripplegraph.runtime import broadcast_if_small, checkpointed


def _canonical(col: Column, kind: T.DataType, path: bool = False) -> list[Column]:
    """Columns that are equal exactly if the values are: null and empty scalars differ, sets have no order or repeats."""
    if isinstance(kind, T.ArrayType):
        item = kind.elementType
        if isinstance(item, T.StructType):
            def plain(e: Column) -> Column:
                parts = [(f.name, normalize_path(e[f.name]) if f.name == "file_path" else e[f.name]) for f in item.fields]
                return F.struct(*(F.struct(v.isNull().alias("n"), v.alias("v")).alias(n) for n, v in parts))

            col = F.transform(col, plain)
        s = F.sort_array(F.array_distinct(col))
        return [F.greatest(F.coalesce(F.size(s), F.lit(0)), F.lit(0)), s]
    if isinstance(kind, T.MapType):
        entry = lambda e: F.struct(e["key"].alias("k"), e["value"].isNull().alias("n"), e["value"].alias("v"))
        s = F.sort_array(F.transform(F.map_entries(col), entry))
        return [F.greatest(F.coalesce(F.size(s), F.lit(0)), F.lit(0)), s]
    col = normalize_path(col) if path else col
    return [col.isNull(), col]


def content_hash(df: DataFrame, columns: list[str], paths: tuple[str, ...] = ("file_path",)) -> list[Column]:
    """Two independent 64-bit hashes of the columns' values, tags, evidence and metadata being sets."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    parts = [x for c in sorted(columns) for x in _canonical(F.col(f"`{c}`"), kinds[c], c in paths)]
    return [F.xxhash64(*parts).alias("h1"), F.xxhash64(F.lit("second"), *reversed(parts)).alias("h2")]


def snapshot_changes(snapshots: DataFrame, tables: dict[str, DataFrame], nodes: DataFrame) -> DataFrame:
    """(snapshot_id, tbl, id, change) for each record added, removed or changed since the snapshot before.

    ``tables`` holds, by name, tables of (snapshot_id, id, delivered_at, content...). Rows with a null snapshot_id or
    id, and rows of unknown or undelivered snapshots, count nowhere; a repository's first snapshot yields nothing; of
    equal delivered_at the greatest hash counts. Extra columns take part as content whatever their names. Empty tables
    give an empty result.

    Scale: content shrinks to two hashes in the scan; repeats combine before the first shuffle, which ends with one row
    per (snapshot, id); the second brings a key's snapshots together, at most one row each.
    """
    at = checkpointed(with_positions(one_per_commit(delivered_snapshots(snapshots, nodes))))
    at = broadcast_if_small(at.select("snapshot_id", "repository_identity", "idx", "next_id"))

    def versions(tbl: str, df: DataFrame) -> DataFrame:
        content = [c for c in df.columns if c not in ("snapshot_id", "id", "delivered_at")]
        rows = df.where("snapshot_id is not null and id is not null").select("snapshot_id", "id", "delivered_at", *content_hash(df, content))
        rows = rows.join(at.select(F.col("snapshot_id")), "snapshot_id", "left_semi")
        return latest_rows(rows, ["snapshot_id", "id"], "delivered_at", ["h1", "h2"]).select(F.lit(tbl).alias("tbl"), "snapshot_id", "id", "h1", "h2")

    rows = reduce(DataFrame.unionByName, (versions(t, df) for t, df in tables.items())).join(at, "snapshot_id")
    w = W.partitionBy("repository_identity", "tbl", "id").orderBy("idx")
    rows = rows.withColumns(
        {"was": F.lag("idx").over(w), "w1": F.lag("h1").over(w), "w2": F.lag("h2").over(w), "will": F.lead("idx").over(w)}
    )
    here = F.when(
        (F.col("idx") > 1) & (F.col("was").isNull() | (F.col("was") < F.col("idx") - 1)), F.lit("added")
    ).when((F.col("was") == F.col("idx") - 1) & ((F.col("h1") != F.col("w1")) | (F.col("h2") != F.col("w2"))), F.lit("changed"))
    gone = F.when(
        F.col("next_id").isNotNull() & (F.col("will").isNull() | (F.col("will") > F.col("idx") + 1)), F.lit("removed")
    )
    found = F.array(
        F.struct(F.col("snapshot_id").alias("snapshot_id"), here.alias("change")),
        F.struct(F.col("next_id").alias("snapshot_id"), gone.alias("change")),
    )
    return (
        rows.select("tbl", "id", F.explode(F.filter(found, lambda x: x["change"].isNotNull())).alias("x"))
        .select("x.snapshot_id", "tbl", "id", "x.change")
    )
