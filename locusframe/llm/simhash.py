"""SimHash near-duplicate detection with a pigeonring filter.

A text's fingerprint has ``bits`` bits: one is 1 where more than half of the hashes
of its word shingles have it. Two fingerprints within ``tau`` differing bits are
linked. Their bits form a ring of ``segments`` segments; if all differences together
are at most tau, then from some segment on the cumulative differences of the next
1, 2, ... segments stay within 1, 2, ... times tau / segments. While that budget is
below one bit the segments of the chain must be equal, which makes an equi-join key;
the rest of the chain is checked by popcounts before the full Hamming check.

Equal fingerprints are one node, so copies are never paired with each other. A key
shared by more than ``wide`` different fingerprints is not paired off: its members
are spread over their variants with up to tau / 2 flipped bits outside the key, and
members that share a variant are linked to the smallest of them. Every link has such
a common variant and every two sharing one are linked (tau = 2), so components stay
exact and rows linear in the group's size.

Null and empty texts, and those of white space only, have fingerprint 0 and are linked
like any others. Texts with fewer words than a shingle are one shingle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusframe.llm.common import connected_components, cut, tidy

BITS = 64


def shingle_hashes(text: str | None, k: int, seed: int = 42) -> np.ndarray:
    """XXH64 of every word shingle, repeats included; A-Z lower-cased, words apart by ASCII white space."""
    tokens = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    n = len(tokens)
    if not n:
        return np.zeros(0, np.uint64)
    if n <= k:
        return np.array([xxhash.xxh64_intdigest(b" ".join(tokens), seed)], np.uint64)
    runs = map(b" ".join, zip(*(tokens[i:] for i in range(k)), strict=False))
    return np.fromiter((xxhash.xxh64_intdigest(s, seed) for s in runs), np.uint64, n - k + 1)


def fingerprint_of(hashes: np.ndarray) -> int:
    if not len(hashes):
        return 0
    ones = np.zeros(BITS, np.int64)
    for a in range(0, len(hashes), 1 << 14):
        part = np.ascontiguousarray(hashes[a : a + (1 << 14)])
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, k: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and ``fp`` (the 64 bits as a signed long) of every whole text; a map over rows."""

    @F.pandas_udf("long")
    @tidy
    def compute(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            fps = [fingerprint_of(shingle_hashes(t if isinstance(t, str) else None, k)) for t in batch]
            yield pd.Series(np.array(fps, np.uint64).view(np.int64))

    return docs.select(F.col(key), compute(F.col(text)).alias("fp"))


def _ring(segments: int) -> list[int]:
    return [round(i * BITS / segments) for i in range(segments + 1)]


def _mask(bounds: list[int], first: int, length: int) -> int:
    """Bits of ``length`` segments from ``first`` on around the ring, as a signed long."""
    m = 0
    for j in range(length):
        i = (first + j) % (len(bounds) - 1)
        for b in range(bounds[i], bounds[i + 1]):
            m |= 1 << b
    return m - (1 << 64) if m >> 63 else m


def near_pairs(prints: DataFrame, tau: int = 2, segments: int = 9, wide: int = 48) -> DataFrame:
    """Links ``u < v`` between different fingerprints of ``prints`` (one column ``fp``, distinct) that carry all their components.

    Keys with up to ``wide`` members give every link among them; wider ones, for
    tau = 2, links that connect the same fingerprints.
    """
    if tau != 2:
        raise ValueError("wide keys are spread by one flipped bit, which links fingerprints within two: tau is 2")
    bounds = _ring(segments)
    chain = next(n for n in range(1, segments + 1) if (n + 1) * tau // segments >= 1)  # segments that must be equal
    keys = F.array(*[F.struct(F.lit(i).cast("byte").alias("i"), F.col("fp").bitwiseAND(F.lit(_mask(bounds, i, chain))).alias("k")) for i in range(segments)])
    rows = prints.select("fp", F.explode(keys).alias("s")).select("fp", "s.i", "s.k")
    sizes = cut(rows.groupBy("i", "k").agg(F.count("*").alias("n")).where("n > 1"))
    rows = cut(rows.join(sizes, ["i", "k"]))

    # narrow keys: all pairs of at most ``wide`` members, the chain's budgets first, then the full distance
    groups = rows.where(F.col("n") <= wide).groupBy("i", "k").agg(F.sort_array(F.collect_list("fp")).alias("m"))
    pairs = groups.select("i", F.posexplode("m").alias("p", "u"), "m").select("i", "u", F.explode(F.slice("m", F.col("p") + 2, F.greatest(F.size("m") - F.col("p") - 1, F.lit(0)))).alias("v"))
    diff = F.col("u").bitwiseXOR(F.col("v"))
    within = F.lit(True)
    for n in range(chain + 1, segments):
        budget = n * tau // segments
        if budget < (n + 1) * tau // segments or n == segments - 1:  # the last length at each budget implies the shorter ones
            by_start = F.lit(False)
            for i in range(segments):
                by_start = by_start | ((F.col("i") == i) & (F.bit_count(diff.bitwiseAND(F.lit(_mask(bounds, i, n)))) <= budget))
            within = within & by_start
    near = pairs.where(within).where(F.bit_count(diff) <= tau).select("u", "v")

    # wide keys: members meet in a common variant
    flips = F.array(F.lit(0).cast("long"), *[F.lit(1 << b if b < 63 else -(1 << 63)).cast("long") for b in range(BITS)])
    spread = rows.where(F.col("n") > wide).select("fp", "i", "k", F.explode(flips).alias("b"))
    in_key = F.lit(False)
    for i in range(segments):
        in_key = in_key | ((F.col("i") == i) & (F.col("b").bitwiseAND(F.lit(_mask(bounds, i, chain))) != 0))
    spread = spread.where(~in_key).select("fp", F.col("fp").bitwiseXOR(F.col("b")).alias("w"), "i")
    low = cut(spread.groupBy("w", "i").agg(F.min("fp").alias("u")))
    linked = spread.join(low, ["w", "i"]).where("u <> fp").select("u", F.col("fp").alias("v"))
    return near.unionByName(linked).distinct()


def components(prints: DataFrame, key: str = "doc_id", tau: int = 2, segments: int = 9) -> DataFrame:
    """``key, fp, component_id``: the smallest key reachable over links, from columns ``key`` and ``fp``."""
    prints = cut(prints)
    nodes = cut(prints.groupBy("fp").agg(F.min(key).alias("first")))
    edges = near_pairs(nodes.select("fp"), tau, segments)
    joined = connected_components(edges)
    part = nodes.join(joined, nodes["fp"] == joined["node"], "left").select("fp", "first", F.coalesce("component", "fp").alias("part"))
    part = cut(part)
    smallest = cut(part.groupBy("part").agg(F.min("first").alias("component_id")))
    label = cut(part.join(smallest, "part").select("fp", "component_id"))
    return prints.join(label, "fp").select(key, "fp", "component_id")
