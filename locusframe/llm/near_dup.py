"""Near-duplicate groups by Jaccard similarity of word shingles.

Equal texts are one class from the start. First come the pairs of classes whose SimHash
fingerprints are within two bits, by operator 3's pigeonring join; a fingerprint is of a
text's different shingles, since repeats would move it. At similarity 0.8 the distance of
two fingerprints has no bound, so pairs further apart are found by bands of min-hashes
over the shingle hashes, in those band keys whose classes are in different components yet.

Candidates of either kind are pruned by a bound that loses nothing: a text's sketch counts
its different shingles by CELLS cells of their hashes, and two texts have at most the sum
of the cells' smaller counts in common. This holds for texts of any number of shingles,
with repeats or without. Every pair that the bound leaves is decided by the exact Jaccard
similarity of the shingle sets (of 32-bit hashes).

In a band key, every class is first compared with two centres, the one of smallest id and
the one whose own keys are shared most (in a family of copies, the text they derive from).
Then all classes of a key that
these links leave in different components are compared with each other: in a task for
each key of up to ``wide`` classes, and in blocks of a wider one. No pair that shares a
key is left undecided; a wide key of many components costs the square of its size.

Null, empty and blank texts have no shingle and are one class. Texts of fewer words
than a shingle are one shingle. Rows without an id are never dropped. The texts of an id that repeats
are classes of their own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusframe.llm.common import bloom_filter, connected_components, cut, tidy
from locusframe.llm.simhash import fingerprint_of, near_pairs, shingle_hashes

BANDS, ROWS = 24, 5
CELLS = 256
_rng = np.random.default_rng(77)
_MULTIPLY = _rng.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)


def min_hashes(hashes: np.ndarray) -> np.ndarray:
    """Smallest value of each of BANDS x ROWS multiply-shift hashes over the shingles (upper 32 bits)."""
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for a in range(0, len(hashes), 2048):
        part = hashes[a : a + 2048, None] * _MULTIPLY + _ADD
        low = np.minimum(low, part.min(axis=0))
    return (low >> np.uint64(32)).astype(np.uint32)


def sketch_of(shingles: np.ndarray) -> np.ndarray:
    """How many of a text's different shingles are in each cell, up to 255."""
    return np.minimum(np.bincount(shingles & np.uint32(CELLS - 1), minlength=CELLS), 255).astype(np.uint8)


def may_be_similar(a: np.ndarray, n_a: np.ndarray, b: np.ndarray, n_b: np.ndarray, similarity: float) -> np.ndarray:
    """Whether texts of these sketches and numbers of shingles can have the similarity; counts over 255 are bounded by their sum."""
    common = np.minimum(a, b).sum(-1, dtype=np.int64) + np.minimum(n_a - a.sum(-1, dtype=np.int64), n_b - b.sum(-1, dtype=np.int64))
    return common >= similarity * (n_a + n_b - common)


def _name(hashes: np.ndarray) -> np.ndarray:
    """The 128-bit name of a word sequence, from its shingle hashes in order, as two longs."""
    return np.frombuffer(xxhash.xxh3_128_digest(hashes.tobytes()), np.int64)


def signatures(docs: DataFrame, k: int) -> DataFrame:
    """``doc_id, text_hash, same_a, same_b`` (128-bit name of the word sequence), ``size`` (different shingles), ``sketch``, ``bands`` and ``fp`` (their SimHash).

    ``text_hash`` tells the different texts of an id apart.
    """

    @tidy
    def compute(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc, text_hash, text in zip(batch["doc_id"], batch["text_hash"], batch["text"], strict=True):
                hashes = shingle_hashes(text if isinstance(text, str) else None, k)
                name = _name(hashes)
                different = np.unique(hashes)
                m = min_hashes(different)
                bands = [xxhash.xxh64_intdigest(m[i : i + ROWS].tobytes(), i) - (1 << 63) for i in range(0, len(m), ROWS)]
                s = np.unique((hashes >> np.uint64(32)).astype(np.uint32))
                fp = int(np.uint64(fingerprint_of(different)).view(np.int64))
                rows.append((doc, text_hash, name[0], name[1], len(s), sketch_of(s).tobytes(), bands, fp))
            yield pd.DataFrame(rows, columns=["doc_id", "text_hash", "same_a", "same_b", "size", "sketch", "bands", "fp"])

    schema = "doc_id long, text_hash long, same_a long, same_b long, size long, sketch binary, bands array<long>, fp long"
    return docs.where(F.col("doc_id").isNotNull()).select("doc_id", "text", F.xxhash64("text").alias("text_hash")).mapInPandas(compute, schema)


def groups(docs: DataFrame, k: int = 5, similarity: float = 0.8, wide: int = 32, block: int = 2048) -> DataFrame:
    """``doc_id, text_hash, group_id`` (smallest id of its group) of every document with an id.

    A class of equal texts is a node with a number of its own: the different texts of an id that repeats are in different classes.
    """
    signed = cut(signatures(docs, k))
    classes = signed.groupBy("same_a", "same_b").agg(F.min("doc_id").alias("first"), F.min_by(F.struct("size", "sketch", "bands", "fp"), "doc_id").alias("s"))
    classes = cut(classes.select("same_a", "same_b", "first", F.monotonically_increasing_id().alias("node"), "s.*"))

    # first the classes with fingerprints within two bits
    links = _linked(docs, classes, by_fingerprint(classes), k, similarity)

    keys = classes.select("node", "first", F.posexplode("bands").alias("band", "key"))
    sizes = cut(keys.groupBy("band", "key").agg(F.count("*").alias("n")).where("n > 1"))
    may_repeat = _membership(sizes.select(F.xxhash64("band", "key").alias("h")))
    shared = cut(keys.where(may_repeat(F.xxhash64("band", "key"))).join(sizes, ["band", "key"]))  # most keys are of one class and stay where they are
    weight = cut(shared.groupBy("node").agg(F.sum("n").alias("weight")))
    # then every class with two centres of each of its keys that are not in one component yet
    left = _apart(shared, links)
    first, last = F.min(F.struct("first", "node", "part")), F.max_by(F.struct("node", "part"), F.struct("weight", -F.col("first"), -F.col("node")))
    centres = left.join(weight, "node").groupBy("band", "key").agg(first.alias("c1"), last.alias("c2"))
    centres = cut(centres.select("band", "key", F.array(F.struct("c1.node", "c1.part"), "c2").alias("c")))
    star = left.join(centres, ["band", "key"]).select("node", "part", F.explode("c").alias("c")).where("part <> c.part")
    star = star.select(F.least("node", "c.node").alias("u"), F.greatest("node", "c.node").alias("v"))
    links = links.unionByName(_linked(docs, classes, star.distinct(), k, similarity))
    # then all classes of such a key
    left = _apart(left.drop("part"), links)
    few = left.where(F.col("n") <= wide).groupBy("band", "key").agg(F.sort_array(F.collect_list(F.struct("node", "part"))).alias("m"))
    few = few.select(F.posexplode("m").alias("p", "x"), "m").select("x", F.explode(F.slice("m", F.col("p") + 2, F.greatest(F.size("m") - F.col("p") - 1, F.lit(0)))).alias("y"))
    few = few.where("x.part <> y.part").select(F.col("x.node").alias("u"), F.col("y.node").alias("v"))
    rest = few.unionByName(_across(left.where(F.col("n") > wide), classes, similarity, block)).distinct()
    links = links.unionByName(_linked(docs, classes, rest, k, similarity))

    joined = connected_components(links)
    part = cut(classes.select("same_a", "same_b", "first", "node").join(joined, "node", "left").withColumn("component", F.coalesce("component", "node")))
    smallest = part.groupBy("component").agg(F.min("first").alias("group_id"))
    label = cut(part.join(smallest, "component").select("same_a", "same_b", "group_id"))
    return signed.select("doc_id", "text_hash", "same_a", "same_b").join(label, ["same_a", "same_b"]).select("doc_id", "text_hash", "group_id")


def by_fingerprint(classes: DataFrame) -> DataFrame:
    """Pairs ``u < v`` of ``classes`` (``node, first, fp``) by their fingerprints: those of near ones, each by its class of smallest id, and those of equal ones with that class."""
    prints = cut(classes.groupBy("fp").agg(F.min(F.struct("first", "node"))["node"].alias("centre"), F.count("*").alias("n")))
    near = near_pairs(prints.select("fp")).join(prints.select(F.col("fp").alias("u"), F.col("centre").alias("a")), "u")
    near = near.join(prints.select(F.col("fp").alias("v"), F.col("centre").alias("b")), "v").select("a", "b")
    same = classes.join(prints.where("n > 1"), "fp").where("node <> centre").select(F.col("node").alias("a"), F.col("centre").alias("b"))
    return near.unionByName(same).select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct()


def _apart(shared: DataFrame, links: DataFrame) -> DataFrame:
    """Rows of ``shared`` (``band, key, node`` and others) of the keys that ``links`` leave in different components, with their component ``part``."""
    part = cut(connected_components(links).select("node", F.col("component").alias("part")))
    rows = cut(shared.join(part, "node", "left").withColumn("part", F.coalesce("part", "node")))
    split = cut(rows.groupBy("band", "key").agg(F.min("part").alias("a"), F.max("part").alias("b")).where("a <> b").select("band", "key"))
    return cut(rows.join(split, ["band", "key"]))


def _sketches(rows: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(rows), np.uint8).reshape(-1, CELLS)


def _across(members: DataFrame, classes: DataFrame, similarity: float, block: int) -> DataFrame:
    """Pairs ``u < v`` of one key's ``members`` (``band, key, n, node, part``) in different parts that may be similar.

    A key's members are dealt into ``n / block`` chunks, and a task compares two chunks.
    """
    chunks = F.ceil(F.col("n") / block).cast("int")
    own = members.join(classes.select("node", "size", "sketch"), "node").withColumn("chunk", F.pmod(F.xxhash64("node"), chunks).cast("int"))
    own = own.withColumn("j", F.explode(F.sequence(F.lit(0), chunks - 1)))
    dealt = own.select("band", "key", F.least("chunk", "j").alias("low"), F.greatest("chunk", "j").alias("high"), "chunk", "node", "part", "size", "sketch")

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        low, high = rows["low"].iloc[0], rows["high"].iloc[0]
        first, second = rows[rows["chunk"] == low], rows[rows["chunk"] == high]
        node, part, size, sketch = second["node"].to_numpy(), second["part"].to_numpy(), second["size"].to_numpy(), _sketches(second["sketch"])
        us, vs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for u, p, n, s in zip(first["node"], first["part"], first["size"], _sketches(first["sketch"]), strict=True):
            at = np.flatnonzero((part != p) & (np.minimum(size, n) >= similarity * np.maximum(size, n)) & ((low != high) | (node > u)))
            v = node[at[may_be_similar(s, n, sketch[at], size[at], similarity)]]
            us.append(np.minimum(u, v))
            vs.append(np.maximum(u, v))
        return pd.DataFrame({"u": np.concatenate(us), "v": np.concatenate(vs)})

    return dealt.groupBy("band", "key", "low", "high").applyInPandas(compare, "u long, v long")


def _linked(docs: DataFrame, classes: DataFrame, pairs: DataFrame, k: int, similarity: float) -> DataFrame:
    """Those of ``pairs`` of ``classes`` that are similar: the bound first, then the shingle sets."""
    one = classes.select(F.col("node").alias("u"), F.col("size").alias("n"), F.col("sketch").alias("x"))
    two = classes.select(F.col("node").alias("v"), F.col("size").alias("m"), F.col("sketch").alias("y"))

    @tidy
    def bounded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield batch.loc[may_be_similar(_sketches(batch["x"]), batch["n"].to_numpy(), _sketches(batch["y"]), batch["m"].to_numpy(), similarity), ["u", "v"]]

    sized = pairs.join(one, "u").join(two, "v").where(F.least("n", "m") >= similarity * F.greatest("n", "m"))
    return cut(_exactly(docs, classes, cut(sized.mapInPandas(bounded, "u long, v long")), k, similarity))


def _membership(rows: DataFrame) -> Callable[[Column], Column]:
    """A test of hashes (a long column without nulls) against a filter of bounded size: true for every ``h`` of ``rows``, false for most others."""
    shared = rows.sparkSession.sparkContext.broadcast(bloom_filter(rows, rows.count()))

    @F.pandas_udf("boolean")
    def has(hashes: pd.Series) -> pd.Series:
        return pd.Series(shared.value.has(hashes.to_numpy(np.int64).view(np.uint64)))

    return has


def _exactly(docs: DataFrame, classes: DataFrame, pairs: DataFrame, k: int, similarity: float) -> DataFrame:
    """Those of ``pairs`` whose shingle sets have the similarity; only texts of the first ids of classes in some pair move (and few others,
    which a filter of bounded size lets pass)."""
    nodes = pairs.select(F.col("u").alias("node")).unionByName(pairs.select(F.col("v").alias("node"))).distinct()
    nodes = cut(nodes.join(classes.select("node", "same_a", "same_b", "first"), "node"))

    @tidy
    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text in batch["text"]:
                hashes = shingle_hashes(text if isinstance(text, str) else None, k)
                rows.append((*_name(hashes), np.unique((hashes >> np.uint64(32)).astype(np.uint32)).view(np.int32)))
            yield pd.DataFrame(rows, columns=["same_a", "same_b", "s"])

    may_be_first = _membership(nodes.select(F.xxhash64("first").alias("h")))
    # texts that pass the filter wrongly have no node to join
    some = docs.select("doc_id", "text").where(may_be_first(F.xxhash64(F.col("doc_id").cast("long")))).mapInPandas(sets, "same_a long, same_b long, s array<int>")
    some = some.join(nodes.select("node", "same_a", "same_b"), ["same_a", "same_b"])
    some = cut(some.groupBy("node").agg(F.first("s").alias("s")))  # equal texts have equal sets
    both = pairs.join(some.select(F.col("node").alias("u"), F.col("s").alias("a")), "u").join(some.select(F.col("node").alias("v"), F.col("s").alias("b")), "v")
    common = F.size(F.array_intersect("a", "b"))
    return both.where(common >= similarity * (F.size("a") + F.size("b") - common)).select("u", "v")


def dedupe(docs: DataFrame, k: int = 5, similarity: float = 0.8) -> DataFrame:
    """The documents that stay: of each group the rows with its smallest id, and rows without an id; columns as given.

    Where an id repeats with different texts, each of its rows stays or goes with the group of its own text.
    """
    found = groups(docs, k, similarity)
    gone = cut(found.where("doc_id <> group_id").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct())
    may_go = _membership(gone.select(F.xxhash64("_id", "_hash").alias("h")))
    row = F.xxhash64(docs["doc_id"].cast("long"), F.xxhash64(docs["text"]))
    # rows that the filter lets pass wrongly, found by ids and hashes alone, so that texts that stay are not moved
    doubtful = docs.where(may_go(row) & docs["doc_id"].isNotNull()).select(F.col("doc_id").cast("long").alias("_id"), F.xxhash64("text").alias("_hash"))
    spared = cut(doubtful.join(gone, ["_id", "_hash"], "left_anti").distinct())
    stays = docs.where(~may_go(row) | docs["doc_id"].isNull())
    tested = docs.where(may_go(row) & docs["doc_id"].isNotNull())
    left = tested.join(spared, (docs["doc_id"] == spared["_id"]) & (F.xxhash64(docs["text"]) == spared["_hash"]), "left_semi")
    return stays.unionByName(left).select(*docs.columns)
