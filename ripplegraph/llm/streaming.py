"""Co-change counts over a stream of commits, by window of commit time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_co_change(commits: DataFrame, window: str = "30 days", late: str = "1 day", min_support: int = 2) -> DataFrame:
    """(window_start, file, co_file, commits) over a stream of (commit_id, files array, committed_at), a row a commit.

    Late commits count up to ``late`` behind the newest; a commit delivered twice within that time counts once. Pairs come
    from the commit's own row, so there is no stream-to-stream join.
    """
    c = commits.withWatermark("committed_at", late).dropDuplicatesWithinWatermark(["commit_id"])
    c = c.withColumn("f", F.array_sort(F.array_distinct(F.filter("files", lambda x: x.isNotNull()))))
    a = c.select("committed_at", "f", F.posexplode("f").alias("pos", "file"))
    pairs = a.select("committed_at", "file", F.explode(F.slice("f", F.col("pos") + 2, F.size("f"))).alias("co_file"))
    g = pairs.groupBy(F.window("committed_at", window), "file", "co_file").agg(F.count("*").alias("commits"))
    return g.where(F.col("commits") >= min_support).select(F.col("window.start").alias("window_start"), "file", "co_file", "commits")
