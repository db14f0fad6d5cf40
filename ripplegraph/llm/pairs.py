"""Items that appear together: pair counts over baskets, lift and pointwise mutual information from the marginals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplegraph.functions.paths import code_unit_less, normalize_path
from ripplegraph.runtime import broadcast_if_small, checkpointed, stored

#: Items of a basket that one task pairs; a wider basket is cut into blocks of about this many, paired block by block.
BLOCK = 256
#: Basket items to a salt of a scope: a scope's baskets stay together in parts of this size, so that equal pairs meet
#: before the shuffle.
SALT_ROWS = 200_000
#: Rows of the table of items that may be broadcast (some 60 bytes each).
BROADCAST_ITEMS = 200_000


def pair_counts(rows: DataFrame, min_pair: int = 1, min_lift: float = 0.0) -> DataFrame:
    """(scope, item_a, item_b, n_ab, n_a, n_b, n, lift, pmi) of each pair with n_ab >= min_pair and lift >= min_lift.

    ``rows`` has scope, basket and item; a basket is the set of its items within its scope, n the scope's baskets. item_a
    comes before item_b in code-unit order. lift = n_ab * n / (n_a * n_b), tested without division; pmi = log2(lift). Rows
    with a null basket or item do not count, a null scope is a scope; repeats count once; other columns are ignored; an
    empty table, or baskets of one item, give no pairs.

    Scale: the rows are read and deduplicated once, into a table of (scope, 128-bit basket hash, item); one pass over it
    counts baskets and items, a second pairs. Items that cannot be in a pair are dropped before pairing, which loses
    nothing: n_ab <= n_a gives n_a >= min_pair, and with lift >= min_lift also n_b * min_lift <= n. Pairs are of whole
    numbers; names wait in the table of items. Baskets wider than BLOCK are paired in blocks, so no task meets more than
    BLOCK x BLOCK pairs of a basket at once. Baskets of a scope lie together in salted parts, so equal pairs combine before
    their shuffle. A hot basket is spread by its items until it is paired, a hot item meets its id in a broadcast or a skew
    join.
    """
    r = rows.where("basket is not null and item is not null").select("scope", F.xxhash64("basket").alias("c1"), F.xxhash64(F.lit(1), "basket").alias("c2"), "item")
    held = stored(r.distinct())
    # Of one pass: (scope, item) with the item's baskets, and (scope, c1, c2) with the basket's items.
    counts = held.groupingSets([["scope", "item"], ["scope", "c1", "c2"]], "scope", "item", "c1", "c2").agg(F.count("*").alias("k"), F.grouping("item").alias("is_basket"))
    counts = checkpointed(counts.where(F.col("is_basket").cast("boolean") | (F.col("k") >= min_pair)).select("scope", "item", "c1", "c2", "k", "is_basket"))
    baskets = counts.where("is_basket = 1")
    scopes = baskets.groupBy(F.col("scope").alias("s")).agg(F.count("*").alias("n"), F.sum("k").alias("size"))
    scopes = broadcast_if_small(checkpointed(scopes))
    items = counts.where("is_basket = 0").select("scope", "item", F.col("k").alias("n_i"))
    items = items.join(scopes, items["scope"].eqNullSafe(scopes["s"])).where(F.col("n_i") * min_lift <= F.col("n"))
    items = checkpointed(items.select("scope", "item", "n_i", "n", F.ceil(F.col("size") / SALT_ROWS).alias("salts"), F.monotonically_increasing_id().alias("id")))
    wide = checkpointed(baskets.where(F.col("k") > BLOCK).select(F.col("scope").alias("s"), F.col("c1").alias("d1"), F.col("c2").alias("d2"), F.ceil(F.col("k") / BLOCK).alias("blocks")))

    small = broadcast_if_small(items.select(F.col("scope").alias("s"), F.col("item").alias("i"), "id", "salts"), BROADCAST_ITEMS)
    x = held.join(small, held["scope"].eqNullSafe(small["s"]) & (held["item"] == small["i"])).select("scope", "c1", "c2", "id", "salts")
    w = broadcast_if_small(wide)
    x = x.join(w, x["scope"].eqNullSafe(w["s"]) & (F.col("c1") == F.col("d1")) & (F.col("c2") == F.col("d2")), "left")
    # Block pairs (i <= j) of a wide basket; an item goes wherever its block is one of the two.
    blocks = F.coalesce("blocks", F.lit(1))
    mine = F.pmod(F.xxhash64("id"), blocks)
    units = F.transform(F.sequence(F.lit(0).cast("long"), blocks - 1), lambda o: F.struct(F.least(o, F.col("mine")).alias("i"), F.greatest(o, F.col("mine")).alias("j")))
    x = x.withColumn("mine", mine).select("scope", "c1", "c2", "id", "mine", F.pmod(F.col("c1"), "salts").alias("salt"), F.explode(units).alias("u"))
    x = x.select("scope", "salt", "c1", "c2", "u.i", "u.j", "id", (F.col("mine") == F.col("u.i")).alias("left"))
    spread = F.when(F.col("j") > 0, F.xxhash64("c1", "i", "j")).otherwise(F.lit(0))  # the units of a wide basket part ways
    x = x.withColumn("spread", spread).repartition("scope", "salt", "spread")
    x = x.groupBy("scope", "salt", "spread", "c1", "c2", "i", "j").agg(F.sort_array(F.collect_list(F.struct("id", "left"))).alias("m")).where("size(m) > 1")
    # Within one block every pair, between two blocks only pairs across.
    across = F.col("i") < F.col("j")
    a = x.select("m", across.alias("across"), F.posexplode("m").alias("pos", "a"))
    b = F.slice("m", F.col("pos") + 2, F.size("m"))
    pairs = a.select("a", "across", F.explode(b).alias("b")).where("not across or a.left <> b.left")
    pairs = pairs.groupBy(F.col("a.id").alias("a"), F.col("b.id").alias("b")).agg(F.count("*").alias("n_ab")).where(F.col("n_ab") >= min_pair)

    # Marginals by whole numbers first; names only for the pairs that stay.
    side = lambda k, *cs: broadcast_if_small(items.select(F.col("id").alias(k), *cs), BROADCAST_ITEMS)
    found = pairs.join(side("a", F.col("n_i").alias("n_a"), "n"), "a").join(side("b", F.col("n_i").alias("n_b")), "b")
    found = checkpointed(found.where(F.col("n_ab") * F.col("n") >= F.col("n_a") * F.col("n_b") * min_lift))
    names = items.join(found.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "id", "left_semi")
    names = broadcast_if_small(checkpointed(names.select("id", "scope", "item")))
    named = lambda k, *cs: names.select(F.col("id").alias(k), F.col("item").alias(f"item_{k}"), *cs)
    found = found.join(named("a", "scope"), "a").join(named("b"), "b")
    first = code_unit_less("item_a", "item_b")
    lift = F.col("n_ab") * F.col("n") / (F.col("n_a") * F.col("n_b"))
    pick = lambda p, q: F.when(first, F.col(p)).otherwise(F.col(q))
    return found.select(
        "scope", pick("item_a", "item_b").alias("item_a"), pick("item_b", "item_a").alias("item_b"), "n_ab",
        pick("n_a", "n_b").alias("n_a"), pick("n_b", "n_a").alias("n_b"), "n", lift.alias("lift"), F.log2(lift).alias("pmi"),
    )


def commit_baskets(commit_files: DataFrame) -> DataFrame:
    """Files of commits as (scope, basket, item)."""
    return commit_files.select(F.col("repository_identity").alias("scope"), F.col("commit_id").alias("basket"), normalize_path("file").alias("item"))
