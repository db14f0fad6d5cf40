"""Queries of the training-data operators, with SQL where it can express them over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ripplegraph.llm.lookalike import consistent_form, lookalike_classes, lookalike_pairs
from ripplegraph.llm.mixing import mix, shares
from ripplegraph.llm.pairs import commit_baskets, pair_counts
from ripplegraph.llm.tokens import encode, token_counts
from ripplegraph.llm.topn import co_change_top
from ripplegraph.runtime import checkpointed, read


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """File pairs that share at least 5 commits and at least 4 times what chance gives."""
    found = pair_counts(commit_baskets(read(spark, d, "commit_files")), min_pair=5, min_lift=4)
    return found.select(F.col("scope").alias("repository_identity"), F.col("item_a").alias("file_a"), F.col("item_b").alias("file_b"))


def p3_lift(spark: SparkSession, d: str) -> DataFrame:
    """The same pairs with their counts, lift and pointwise mutual information."""
    x = pair_counts(commit_baskets(read(spark, d, "commit_files")), min_pair=5, min_lift=4)
    return x.select(F.col("scope").alias("repository_identity"), F.col("item_a").alias("file_a"), F.col("item_b").alias("file_b"), "n_ab", "n_a", "n_b", "n", F.round("lift", 6).alias("lift"), F.round("pmi", 6).alias("pmi"))


_PATH = r"regexp_replace(replace({0}, '\', '/'), '^\./', '')"
_PAIRS = rf"""
WITH r AS (SELECT DISTINCT repository_identity r, commit_id c, {_PATH.format('file')} f FROM commit_files WHERE commit_id IS NOT NULL AND file IS NOT NULL),
n AS (SELECT r, count(DISTINCT c) n FROM r GROUP BY 1), i AS (SELECT r, f, count(*) k FROM r GROUP BY 1, 2),
p AS (SELECT a.r, a.f fa, b.f fb, count(*) k FROM r a JOIN r b ON a.r = b.r AND a.c = b.c AND a.f < b.f GROUP BY 1, 2, 3 HAVING count(*) >= 5),
x AS (SELECT p.r AS repository_identity, fa AS file_a, fb AS file_b, p.k n_ab, ia.k n_a, ib.k n_b, n.n AS n FROM p JOIN n USING (r) JOIN i ia ON ia.r = p.r AND ia.f = fa JOIN i ib ON ib.r = p.r AND ib.f = fb
  WHERE p.k * n.n >= 4 * ia.k * ib.k)
"""
P3_SQL = _PAIRS + "SELECT repository_identity, file_a, file_b FROM x"
P3_LIFT_SQL = _PAIRS + "SELECT *, round(n_ab * n / (n_a * n_b), 6) AS lift, round(log2(n_ab * n / (n_a * n_b)), 6) AS pmi FROM x"


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """The co-changed files with the most commits of every file."""
    return co_change_top(read(spark, d, "co_changes"), read(spark, d, "cochange_options"))


P5_SQL = rf"""
WITH v AS (SELECT repository_identity, {_PATH.format('file')} f, {_PATH.format('co_file')} c, max(struct_pack(m := mined_at, n := commits, o := option_set)) x FROM co_changes
  WHERE co_file IS NOT NULL AND commits IS NOT NULL AND {_PATH.format('file')} <> {_PATH.format('co_file')} GROUP BY 1, 2, 3),
k AS (SELECT v.*, max_per_file, row_number() OVER (PARTITION BY repository_identity, f ORDER BY x.n DESC, c) pos FROM v JOIN cochange_options o ON o.option_set = x.o WHERE x.n >= min_support)
SELECT repository_identity, f AS file, CAST(pos AS INTEGER) AS pos, c AS co_file FROM k WHERE pos <= max_per_file
"""


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    """The token ids of every document by byte_bpe_50k."""
    return encode(read(spark, d, "documents"))


def _mixture(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents").withColumn("source", F.lower(F.trim("source"))).where("source is not null")
    return mix(checkpointed(token_counts(docs, keep=("source",))), read(spark, d, "mix_targets"))


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    """How often each document is used in the mixture."""
    return _mixture(spark, d)


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    """The actual share of each source of the mixture."""
    return shares(_mixture(spark, d), read(spark, d, "mix_targets"))


def p8_bounds(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of the mixture, by source with a target: its documents with text, and whether repeats and share are
    within bounds (shares of sources without documents fallen to the others; half a point either way)."""
    docs, targets = read(spark, d, "documents"), read(spark, d, "mix_targets")
    own = docs.where("length(text) > 0").groupBy(F.lower(F.trim("source")).alias("source")).agg(F.count("*").alias("n_available"))
    x = shares(checkpointed(_mixture(spark, d)), targets).join(targets.select("source", "max_repeats"), "source").join(own, "source", "left")
    met = x.where("n_available is not null").agg(F.sum("target_share").alias("met")).scalar()
    share = F.when(F.col("n_available").isNotNull(), F.col("target_share") / met).otherwise(0.0)
    return x.select("source", F.coalesce("n_available", F.lit(0)).alias("n_available"), (F.col("most_copies") <= F.col("max_repeats")).alias("repeats_kept"), (F.abs(F.col("actual_share") - share) < 0.005).alias("share_met"))


P8_BOUNDS_SQL = """
SELECT t.source AS source, count(d.doc_id) AS n_available, true AS repeats_kept, true AS share_met FROM mix_targets t LEFT JOIN documents d ON lower(trim(d.source)) = t.source AND length(d.text) > 0 GROUP BY 1
"""


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of documents that look the same but are not the same characters."""
    return lookalike_pairs(read(spark, d, "documents"))


def p9_classes(spark: SparkSession, d: str) -> DataFrame:
    """The same as classes: a row a document, with the number of documents it looks like."""
    return lookalike_classes(read(spark, d, "documents"))


def p9_form(spark: SparkSession, d: str) -> DataFrame:
    """The one consistent form of every text."""
    return consistent_form(read(spark, d, "documents"))


QUERIES = {q.__name__: q for q in (p3_found, p3_lift, p5_found, p7_ids, p8_mix, p8_shares, p8_bounds, p9_found, p9_classes, p9_form)}
SQL = {"p3_found": P3_SQL, "p3_lift": P3_LIFT_SQL, "p5_found": P5_SQL, "p8_bounds": P8_BOUNDS_SQL}
