"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks."""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ripplegraph.runtime import broadcast_if_small

#: Tokens of a block; tokens of a shard, within which blocks are put in seeded order; most shards of a source.
BLOCK_TOKENS, SHARD_TOKENS, MOST_SHARDS = 256, 4_000_000, 4_096
#: The part of all tokens below which scarce sources may not push a mixture whose size is not given.
FLOOR = 0.05


def sainte_lague(weights: list[float], seats: int, caps: list[int]) -> list[int]:
    """Seats by the highest quotients weight / (2 * held + 1), none beyond its cap; ties go to the earlier entry.

    Starts below the result, at the seats that a slightly large divisor gives, and hands out the rest one by one.
    """
    held = [0] * len(weights)
    open_ = [i for i, (w, c) in enumerate(zip(weights, caps, strict=True)) if w > 0 and c > 0]
    while open_:
        total, left = sum(weights[i] for i in open_), seats - sum(held[i] for i in range(len(held)) if i not in set(open_))
        fill = [i for i in open_ if weights[i] / total * left - 1 >= caps[i]]
        if not fill:
            for i in open_:
                held[i] = max(0, min(caps[i], int(weights[i] / total * left) - 1))
            break
        for i in fill:
            held[i] = caps[i]
        open_ = [i for i in open_ if i not in set(fill)]
    heap = [(-weights[i] / (2 * held[i] + 1), i) for i in range(len(weights)) if weights[i] > 0 and held[i] < caps[i]]
    heapq.heapify(heap)
    for _ in range(seats - sum(held)):
        if not heap:
            break
        _, i = heapq.heappop(heap)
        held[i] += 1
        if held[i] < caps[i]:
            heapq.heappush(heap, (-weights[i] / (2 * held[i] + 1), i))
    return held


def default_total(capacity: dict[str, int], share: dict[str, float], available: int, floor: float) -> int:
    """The largest total in which every source reaches its share, of the sources that allow a total of ``floor`` of what is
    available; a source that allows less (20 tokens of a source with a tenth) cannot set the size of the whole mixture."""
    allows = sorted(capacity[s] / share[s] for s in capacity)
    return int(next((t for t in allows if t >= floor * available), allows[-1] if allows else 0))


def mix(documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = 7, block_tokens: int = BLOCK_TOKENS, floor: float = FLOOR) -> DataFrame:
    """(doc_id, source, n_tokens, copies) of the documents in the mixture, copies from 1 to the source's max_repeats.

    ``documents`` has doc_id, source and n_tokens; ``targets`` source, target_share and max_repeats, a fixed small table.
    ``total_tokens`` is the mixture's size. Without it shares come first: the size is the largest in which every source that
    has documents can reach its share, but for sources so scarce that the mixture would fall below ``floor`` of the tokens
    there are; those give all that their repeats allow, the others take their place, and ``shares`` reports what is missing.
    Shares of sources without documents fall to the others in proportion. Sources without a target, with a share of 0 or
    max_repeats below 1, null sources and documents without tokens are left out. Ties in seeded order are settled by doc_id.
    Repeated rows count as documents of their own; an empty table gives an empty mixture.

    Quotas are whole blocks, at least one: first of each source, then of each of its shards. A shard takes its documents in
    seeded order, all of them as often as the quota goes round, and of the last round the first blocks; a document belongs to
    the block that holds its middle. The seeded order is the same in every shard, so shards cut it at nearly the same place
    and a source that grows by a shard keeps nearly all documents it had. Scale: the driver sees one row a source and shard,
    at most MOST_SHARDS a source; a source of any size is cut into shards by hash, so no window gathers a source, and a
    window's rows are three numbers.
    """
    t = targets.where("source is not null and target_share > 0 and max_repeats >= 1").groupBy("source").agg(F.max("target_share").alias("share"), F.max("max_repeats").alias("most"))
    t = broadcast_if_small(t)
    d = documents.where("n_tokens > 0").select("doc_id", "source", F.col("n_tokens").cast("long").alias("n_tokens")).join(t, "source")
    spark = documents.sparkSession
    sizes = {r["source"]: r for r in d.groupBy("source").agg(F.sum("n_tokens").alias("n"), F.max("share").alias("share"), F.max("most").alias("most")).collect()}
    names = sorted(sizes)
    shards = {s: max(1, min(MOST_SHARDS, -(-sizes[s]["n"] // SHARD_TOKENS))) for s in names}
    # Both plans are of as many rows as there are targets, and shards of those: broadcast because bounded.
    plan = spark.createDataFrame([(s, shards[s]) for s in names], "source string, shards int")
    d = d.join(F.broadcast(plan), "source").withColumn("shard", F.pmod(F.xxhash64(F.lit(seed), F.lit("shard"), "doc_id"), "shards").cast("int"))
    held = d.groupBy("source", "shard").agg(F.sum("n_tokens").alias("n")).collect()

    whole = sum(sizes[s]["share"] for s in names)
    capacity = {s: sizes[s]["most"] * sizes[s]["n"] for s in names}
    if total_tokens is None:
        total_tokens = default_total(capacity, {s: sizes[s]["share"] / whole for s in names}, sum(sizes[s]["n"] for s in names), floor)
    blocks = max(total_tokens // block_tokens, min(1, total_tokens))
    of_source = dict(zip(names, sainte_lague([sizes[s]["share"] for s in names], blocks, [-(-capacity[s] // block_tokens) for s in names]), strict=True))
    quotas = []
    for s in names:
        own = sorted((r["shard"], r["n"]) for r in held if r["source"] == s)
        got = sainte_lague([n for _, n in own], of_source[s], [-(-sizes[s]["most"] * n // block_tokens) for _, n in own])
        for (k, n), q in zip(own, got, strict=True):
            rounds = min(sizes[s]["most"], q * block_tokens // n)
            quotas.append((s, k, rounds, -(-max(0, q * block_tokens - rounds * n) // block_tokens)))
    quota = spark.createDataFrame(quotas, "source string, shard int, rounds int, first_blocks long")
    w = W.partitionBy("source", "shard").orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").rowsBetween(W.unboundedPreceding, 0)
    middle = F.sum("n_tokens").over(w) - F.col("n_tokens") / 2
    d = d.withColumn("block", F.floor(middle / block_tokens)).join(F.broadcast(quota), ["source", "shard"])
    copies = F.least(F.col("most"), F.col("rounds") + F.when(F.col("block") < F.col("first_blocks"), 1).otherwise(0)).cast("int")
    return d.select("doc_id", "source", "n_tokens", copies.alias("copies")).where("copies > 0")


def shares(mixture: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, actual_share, n_tokens, n_docs, most_copies, missing_tokens) of every source with a target;
    missing_tokens is how far a source stays below its share of the whole mixture."""
    own = mixture.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("n_tokens"), F.count("*").alias("n_docs"), F.max("copies").alias("most_copies"))
    total = mixture.agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("total"))
    x = targets.join(own, "source", "left").withColumn("total", total.scalar())
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    actual = F.coalesce(F.col("n_tokens") / F.col("total"), F.lit(0.0))
    missing = F.greatest(F.lit(0), F.round(F.col("target_share") * zero("total")).cast("long") - zero("n_tokens"))
    return x.select(
        "source", "target_share", actual.alias("actual_share"), zero("n_tokens").alias("n_tokens"), zero("n_docs").alias("n_docs"), zero("most_copies").alias("most_copies"), missing.alias("missing_tokens")
    )
