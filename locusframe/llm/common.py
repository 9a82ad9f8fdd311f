"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


FILTER_BITS = 27
_own_dirs: dict[str, str | None] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(column: str, modulus: int) -> Column:
    """crc32 of an id's decimal text, modulo ``modulus``; a null id is in fold 0."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % modulus, F.lit(0))


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; in a local session without one, a folder of its own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        app = spark.sparkContext.applicationId
        named = _own_dirs.setdefault(app, None) or tempfile.mkdtemp(prefix="checkpoints-")
        _own_dirs[app] = named
    return named.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Later plans start from that table: a lost executor costs a re-read of files,
    not a recomputation of what led to them.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cut_by(df: DataFrame, key: str) -> DataFrame:
    """As ``cut``, in buckets of ``key``, as many as there are shuffle partitions: grouping by it later moves no row again."""
    spark = df.sparkSession
    name = f"cut_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.bucketBy(buckets, key).format("parquet").option("path", f"{shared_dir(spark)}/{name}").saveAsTable(name)
    table_ = spark.table(name)
    table_.schema  # noqa: B018  resolved before the name goes; the files stay
    spark.sql(f"DROP TABLE {name}")
    return table_


def give_back() -> None:
    """Return what this worker has freed to the system: workers outlive their tasks, and the next ones need the room."""
    pyarrow.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not this C library
        pass


def tidy(batches: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``batches`` (a function of an iterator of batches), giving memory back at the end of each task."""

    @functools.wraps(batches)
    def run(rows: Iterator) -> Iterator:
        try:
            yield from batches(rows)
        finally:
            give_back()

    return run


def connected_components(edges: DataFrame) -> DataFrame:
    """Components of an undirected graph: columns ``node`` and ``component`` (the smallest node reachable).

    ``edges`` has columns ``u`` and ``v`` (long); loops, repeats and either
    direction are fine. Nodes without an edge to another node are not returned.
    Alternating large-star and small-star steps; each step is a min-aggregate
    and a join, so a hub's edges are pre-aggregated, and the join can be split
    by the skew handling of adaptive execution. An empty table gives an empty table.
    """
    spark = edges.sparkSession
    e = cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = cut(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = cut(large)
        low = cut(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        now = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if now == seen:
            break
        seen = now
    out = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = e.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return out.unionByName(roots)


def mix(x: np.ndarray) -> np.ndarray:
    """A permutation of 64-bit numbers that scatters them."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Filter:
    """A Bloom filter with two probes over 64-bit hashes: it has all that were put in, and says so of few others."""

    def __init__(self, words: np.ndarray) -> None:
        self.words = words

    @staticmethod
    def probes(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
        top = np.uint64(64 - bits)
        return hashes >> top, mix(hashes ^ np.uint64(0x5851F42D4C957F2D)) >> top

    def has(self, hashes: np.ndarray) -> np.ndarray:
        bits = int(len(self.words) * 64).bit_length() - 1
        found = np.ones(len(hashes), bool)
        for at in self.probes(hashes, bits):
            found &= (self.words[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1
        return found


def bloom_filter(hashes: DataFrame, rows: int) -> Filter:
    """A filter of the hashes ``h`` (long) of about ``rows`` rows: some 12 bits for each, 2 ** FILTER_BITS (16 MB) at most.

    Its words are put together by an aggregate, so the driver gets each word once, however many tasks there are.
    """
    bits = int(np.clip(int(12 * max(1, rows)).bit_length(), 12, FILTER_BITS))

    @tidy
    def probes(batches: Iterator[pyarrow.RecordBatch]) -> Iterator[pyarrow.RecordBatch]:
        for batch in batches:
            h = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            at = np.concatenate(Filter.probes(h, bits))
            mask = (np.uint64(1) << (at & np.uint64(63))).view(np.int64)
            yield pyarrow.RecordBatch.from_arrays([pyarrow.array((at >> np.uint64(6)).astype(np.int64)), pyarrow.array(mask)], ["slot", "mask"])

    masks = hashes.select("h").mapInArrow(probes, "slot long, mask long").groupBy("slot").agg(F.bit_or("mask").alias("mask")).toArrow()
    words = np.zeros(1 << bits >> 6, np.uint64)
    words[masks.column("slot").to_numpy()] = masks.column("mask").to_numpy().view(np.uint64)
    return Filter(words)
