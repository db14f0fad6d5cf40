"""Top N items within every group, by a row_number window that the optimiser's group limit prunes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ripplegraph.functions.paths import code_unit_key, normalize_path
from ripplegraph.runtime import broadcast_if_small


def top_n(rows: DataFrame, by: list[str], score: str | Column, item: str | Column, most: int, limit: Column | None = None, pos: str = "pos") -> DataFrame:
    """The ``most`` rows of each group with the highest score, ``pos`` counting from 1; ``limit`` may narrow a group.

    Order: score descending with nulls last, then item ascending with nulls last. Rows equal in both are told apart by no rule, so give
    unique items for one defined result; repeats each take a position. Null group keys form a group. An existing column
    named ``pos`` is replaced. An empty table, or ``most`` below 1, gives no rows.

    Scale: the rank filter holds a literal, from which Spark plans a WindowGroupLimit on both sides of the shuffle: each
    task hands on at most ``most`` rows a group, so a group of any size reaches its final task as tasks x ``most`` rows.
    """
    rows = rows.drop(pos)
    score, item = (F.col(x) if isinstance(x, str) else x for x in (score, item))
    w = W.partitionBy(*by).orderBy(score.desc_nulls_last(), item.asc_nulls_last())
    ranked = rows.withColumn(pos, F.row_number().over(w)).where(F.col(pos) <= int(most))
    return ranked if limit is None else ranked.where(F.col(pos) <= limit)


def co_change_top(co_changes: DataFrame, options: DataFrame) -> DataFrame:
    """(repository_identity, file, pos, co_file): each file's co-changed files with the most commits.

    Rows without co_file or commits, or naming the file itself, do not count; of several rows of one pair the latest mined
    counts, and of equally late ones the one with most commits. min_support and max_per_file come from the row's option
    set; rows of an unknown option set are left out. ``options`` is the fixed table of option sets, a handful of rows: its
    largest max_per_file is the literal the group limit needs.
    """
    most = options.agg(F.max("max_per_file")).first()[0] or 0
    x = co_changes.where("co_file is not null and commits is not null and file is not null").select(
        "repository_identity", normalize_path("file").alias("file"), normalize_path("co_file").alias("co_file"), "option_set", "commits", "mined_at"
    ).where("file <> co_file")
    x = x.groupBy("repository_identity", "file", "co_file").agg(F.max(F.struct("mined_at", "commits", "option_set")).alias("b"))
    x = x.select("repository_identity", "file", "co_file", "b.commits", "b.option_set")
    x = x.join(broadcast_if_small(options.select("option_set", "min_support", "max_per_file").distinct()), "option_set").where("commits >= min_support")
    top = top_n(x, ["repository_identity", "file"], "commits", code_unit_key("co_file"), most, F.col("max_per_file"))
    return top.select("repository_identity", "file", "pos", "co_file")
