"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

Every source gets a target of words: its share, by weight, of ``ratio`` times all
words, at most ``repeats`` times its own size, the excess shared again by weight
until no target is above that. The house of blocks (total target over block size)
is given to the sources by highest quotients target / (2k + 1), and each source's
blocks to its shards in the same way by the shards' sizes, so every shard has an
integer quota. Within a shard documents lie in a seeded order, cut into equal-token
blocks; as many whole passes as the quota holds take every block, and the rest of the
quota takes the blocks whose places come first in a seeded permutation of the shard's
blocks (i * step + shift modulo their number). A document's ``taken`` is the number
of its words in chosen blocks.

A block has ``block`` words, or fewer so that the smallest target holds 16 blocks; only
the last block of a shard is short. Seats are found by bisection for the divisor, so
their number costs nothing.

Only one row for each source and one for each shard reaches the driver: a source
has a shard for each ``shard_docs`` documents, ``most_shards`` at most, beyond
which shards grow (a shard is a sorted, spillable window of ids and sizes). Empty and null
texts have size 0 and take 0; a null source is a source of its own, last in order. Rows that
repeat an id each have their own place. An empty table gives an empty result. Seeds make
reruns agree. Other columns of ``docs`` are not read, so their names can't clash.
"""

from __future__ import annotations

import heapq
import math
import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from locusframe.llm.common import cut

SPACE = r"[\x20\x09-\x0D]+"


def word_count(text: str) -> Column:
    """Number of runs without ASCII white space, JVM-side: the text is split at the runs of white space."""
    bare = F.regexp_replace(F.col(text), r"\A[\x20\x09-\x0D]+|[\x20\x09-\x0D]+\z", "")
    return F.when(F.coalesce(F.length(bare), F.lit(0)) == 0, 0).otherwise(F.size(F.split(bare, SPACE))).cast("long")


def targets(sizes: list[int], weights: list[float], ratio: float, repeats: float) -> list[float]:
    """Targets of sources: shares by weight of ratio x all sizes, no target above repeats x size."""
    left, out, open_ = ratio * sum(sizes), [0.0] * len(sizes), [i for i, s in enumerate(sizes) if s > 0]
    while open_:
        unit = left / sum(weights[i] for i in open_)
        full = [i for i in open_ if unit * weights[i] > repeats * sizes[i]]
        if not full:
            for i in open_:
                out[i] = unit * weights[i]
            break
        for i in full:
            out[i] = float(repeats * sizes[i])
            left -= out[i]
        open_ = [i for i in open_ if i not in set(full)]
    return out


def sainte_lague(votes: list[float], seats: int, most: list[int] | None = None) -> list[int]:
    """Seats by highest quotients votes / (2k + 1), ties to the earlier party, none above ``most``.

    Bisection finds a bar with no more than ``seats`` quotients above it; a heap hands out what is left.
    """
    most = most or [seats] * len(votes)

    def above(bar: float) -> list[int]:
        return [min(m, math.floor((v / bar + 1) / 2)) if v > bar else 0 for v, m in zip(votes, most, strict=True)]

    got = [0] * len(votes)
    if not votes or max(votes) <= 0 or seats <= 0:
        return got
    low, high = 0.0, 2.0 * max(votes)
    for _ in range(200):
        middle = (low + high) / 2
        if middle in (low, high):
            break
        if sum(above(middle)) > seats:
            low = middle
        else:
            high = middle
    got = above(high)
    heap = [(-v / (2 * g + 1), i) for i, (v, g) in enumerate(zip(votes, got, strict=True)) if v > 0 and g < most[i]]
    heapq.heapify(heap)
    for _ in range(seats - sum(got)):
        if not heap:
            break
        _, i = heapq.heappop(heap)
        got[i] += 1
        if got[i] < most[i]:
            heapq.heappush(heap, (-votes[i] / (2 * got[i] + 1), i))
    return got


def permutation(blocks: int, source: str | None, shard: int, seed: int) -> tuple[int, int]:
    """Step and shift of a shard's permutation of its blocks; the step has no factor in common with their number."""
    rng = random.Random(f"{seed} {shard} {source!r}")
    step = rng.randrange(1, max(2, min(blocks, 1 << 30)))
    while math.gcd(step, max(1, blocks)) > 1:
        step = rng.randrange(1, max(2, min(blocks, 1 << 30)))
    return step, rng.randrange(max(1, blocks))


def mix(
    docs: DataFrame,
    weights: tuple[float, ...] = (3.0, 1.0, 2.0),
    ratio: float = 1.5,
    repeats: int = 2,
    block: int = 64,
    shard_docs: int = 1000,
    most_shards: int = 4096,
    seed: int = 17,
    key: str = "doc_id",
) -> DataFrame:
    """One row per document: ``doc_id, source, size, source_size, target, shard, quota, taken``.

    ``quota`` is the number of blocks that the document's shard gives.
    """
    spark = docs.sparkSession
    sized = cut(docs.select(F.col(key).alias("doc_id"), F.col("source"), word_count("text").alias("size")))
    per = [(r["source"], int(r["n"]), int(r["w"] or 0)) for r in sized.groupBy("source").agg(F.count("*").alias("n"), F.sum("size").alias("w")).collect()]
    per.sort(key=lambda r: (r[0] is None, (r[0] or "").encode()))
    goal = targets([r[2] for r in per], [weights[i % len(weights)] for i in range(len(per))], ratio, repeats)
    plan = spark.createDataFrame(
        [(s, w, t, min(most_shards, -(-n // shard_docs))) for (s, n, w), t in zip(per, goal, strict=True)],
        "source string, source_size long, target double, shards int",
    )
    laid = sized.join(plan, sized["source"].eqNullSafe(plan["source"])).drop(plan["source"])
    laid = laid.withColumn("shard", F.pmod(F.xxhash64(F.lit(seed + 1), F.col("doc_id")), F.col("shards")).cast("int"))
    shards = laid.groupBy("source", "shard").agg(F.sum("size").alias("w")).collect()
    block = max(1, min([block, *[int(t // 16) for t in goal if t > 0]]))
    seats = sainte_lague(goal, round(sum(goal) / block), [repeats * -(-r[2] // block) for r in per])
    by_source: dict = {}
    for r in shards:
        by_source.setdefault(r["source"], []).append((r["shard"], int(r["w"])))
    quota = []
    for (source, _, _), n in zip(per, seats, strict=True):
        own = sorted(by_source.get(source, []))
        sizes = [-(-w // block) for _, w in own]
        for (k, w), m, g in zip(own, sizes, sainte_lague([float(w) for _, w in own], n, [repeats * m for m in sizes]), strict=True):
            quota.append((source, k, g, w, m, *permutation(m, source, k, seed + 2)))
    quotas = spark.createDataFrame(quota, "q_source string, q_shard int, quota long, shard_size long, blocks long, step long, shift long")
    laid = laid.join(quotas, laid["source"].eqNullSafe(quotas["q_source"]) & (laid["shard"] == quotas["q_shard"])).drop("q_source", "q_shard")

    within = Window.partitionBy("source", "shard").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    laid = laid.withColumn("h", F.xxhash64(F.lit(seed), F.col("doc_id"))).withColumn("start", F.coalesce(F.sum("size").over(within), F.lit(0)))
    n = F.greatest(F.col("blocks"), F.lit(1))
    passes, rest = F.floor(F.col("quota") / n), F.col("quota") % n
    end = F.col("start") + F.col("size")

    def chosen(taken: Column, i: Column) -> Column:
        inside = F.least(end, (i + 1) * block) - F.greatest(F.col("start"), i * block)
        return taken + F.when(F.pmod(i * F.col("step") + F.col("shift"), n) < rest, inside).otherwise(0)

    touched = F.sequence(F.floor(F.col("start") / block), F.floor((end - 1) / block))
    some = F.when((F.col("size") > 0) & (rest > 0), F.aggregate(touched, F.lit(0).cast("long"), chosen)).otherwise(0)
    taken = passes * F.col("size") + some
    return laid.select("doc_id", "source", "size", "source_size", "target", "shard", "quota", taken.cast("long").alias("taken"))
