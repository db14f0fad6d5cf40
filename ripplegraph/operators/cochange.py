"""Files that changed together with changed files, from a history of commits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ripplegraph.functions.paths import normalize_path
from ripplegraph.runtime import broadcast_if_small, checkpointed, stored


def parse_name_status(logs: DataFrame) -> DataFrame:
    """(log_id, commit_no, file) from ``logs`` (log_id, text): records parted by 0x1e, then tab-separated status lines.

    Renames and copies give the old and the new path; files of a commit are a set; commits without files vanish.
    """
    rec = logs.select("log_id", F.posexplode(F.split("text", "\x1e")).alias("commit_no", "rec"))
    line = rec.select("log_id", "commit_no", F.explode(F.split("rec", "\r?\n")).alias("line"))
    part = F.split("line", "\t")
    both = part[0].rlike("^[RC]")
    files = F.when(both & (F.size(part) > 2), F.array(part[1], part[2])).when(F.size(part) > 1, F.array(part[1]))
    x = line.where(F.contains("line", F.lit("\t"))).select("log_id", "commit_no", F.explode(files).alias("file"))
    return x.select("log_id", "commit_no", normalize_path(F.trim("file")).alias("file")).where("file <> ''").distinct()


def commit_sets(commit_files: DataFrame) -> DataFrame:
    """(repo, commit_id, file): each commit as the set of its normalised files."""
    x = commit_files.where("commit_id is not null and file is not null")
    return x.select(F.col("repository_identity").alias("repo"), "commit_id", normalize_path("file").alias("file")).distinct()


#: Files of a commit beyond which its other side is cut into blocks, each met by all of its changed files in another task.
BLOCK = 256


def _shared_commits(a: DataFrame, b: DataFrame, commits: DataFrame, min_support: int) -> DataFrame:
    """(repo, file, co_file, commits) of each ``file`` of ``a`` and ``co_file`` of ``b`` that share so many commits.

    Files with fewer commits than that are dropped before pairing, which loses nothing. A wide commit is cut into blocks of
    its ``b`` side, so that it is many keys of the join; counts combine before their shuffle.
    """
    if min_support > 1:
        rare = commits.groupBy("repo", "file").agg(F.count("*").alias("k")).where(F.col("k") >= min_support).select("repo", "file")
        a, b = a.join(rare, ["repo", "file"], "left_semi"), b.join(rare.withColumnRenamed("file", "co_file"), ["repo", "co_file"], "left_semi")
    wide = commits.groupBy("repo", "commit_id").agg(F.count("*").alias("k")).where(F.col("k") > BLOCK)
    wide = broadcast_if_small(checkpointed(wide.select("repo", "commit_id", F.ceil(F.col("k") / BLOCK).alias("blocks"))))
    key, blocks = ["repo", "commit_id"], F.coalesce("blocks", F.lit(1))
    a = a.join(wide, key, "left").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1))).drop("blocks")
    b = b.join(wide, key, "left").withColumn("block", F.pmod(F.xxhash64("co_file"), blocks)).drop("blocks")
    pairs = a.join(b, [*key, "block"]).where("file <> co_file").groupBy("repo", "file", "co_file").agg(F.count("*").alias("commits"))
    return pairs.where(F.col("commits") >= min_support)


def co_change_counts(commits: DataFrame, changed: DataFrame, min_support: int = 2) -> DataFrame:
    """(repo, file, co_file, commits) of each changed file and each file beyond the change that it shares commits with.

    ``changed`` has file. The changed side is reduced by a semi join before the self join, the other side by an anti join,
    so the join is changed x unchanged within a commit, not all pairs.
    """
    c, commits = changed.select("file").distinct(), stored(commits)
    a = commits.join(c, "file", "left_semi")
    b = commits.join(c, "file", "left_anti").withColumnRenamed("file", "co_file")
    return _shared_commits(a, b, commits, min_support)


def co_changes(commits: DataFrame, changed: DataFrame, min_support: int = 2, max_per_file: int = 8) -> DataFrame:
    """The counts of ``co_change_counts``, the most of each file, ties by path, numbered by ``pos``."""
    w = W.partitionBy("repo", "file").orderBy(F.desc("commits"), "co_file")
    x = co_change_counts(commits, changed, min_support).withColumn("pos", F.row_number().over(w))
    return x.where(F.col("pos") <= max_per_file)


def co_changes_per_diff(commits: DataFrame, diff_files: DataFrame, min_support: int = 2, max_per_file: int = 8) -> DataFrame:
    """(diff_id, repo, file, co_file, commits, pos): for each file of each diff the files beyond that diff that changed with
    it most often. ``diff_files`` has diff_id and file.

    Pairs are counted once for all diffs; a diff then leaves out its own files, and only what it keeps is ranked.
    """
    d, commits = diff_files.select("diff_id", "file").distinct(), stored(commits)
    a = commits.join(d.select("file").distinct(), "file", "left_semi")
    pairs = _shared_commits(a, commits.withColumnRenamed("file", "co_file"), commits, min_support)
    x = d.join(pairs, "file").join(d.withColumnRenamed("file", "co_file"), ["diff_id", "co_file"], "left_anti")
    w = W.partitionBy("diff_id", "repo", "file").orderBy(F.desc("commits"), "co_file")
    x = x.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= max_per_file)
    return x.select("diff_id", "repo", "file", "co_file", "commits", "pos")
