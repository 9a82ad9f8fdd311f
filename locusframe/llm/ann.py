"""Approximate nearest neighbours by largest inner product over balanced posting lists.

Vectors get one more component, which makes all of them equally long, so the largest
inner product is the smallest distance. Centroids of balanced lists are fitted on a
sample of at most about ``sample`` vectors. Every vector goes to its nearest list, and
a boundary vector also to further lists within ``boundary`` of the nearest distance, up
to ``replicas``. Queries walk an in-memory neighbour graph of the centroids, bounded in
size by ``most_lists``, and probe the lists whose distance is within a ratio of the
nearest one's. The ratio is fitted too: the smallest at which queries of the sample find
``recall`` of their true neighbours in it. A query whose lists hold fewer than k + 1 ids
(each counted in its nearest list only) goes on through the next nearest of all lists
until they do, so it gets k rows wherever there are k candidates.

The sample's own k + 1 nearest of a query are candidates too, and none that is farther
than all of these can be in its result, so only what reaches them leaves a scan.

Equal vectors are stored once, with their k + 1 smallest ids: more can't be in a result.
Lists are put together into shards of bounded size, long ones cut over several by a hash,
so no task holds more than a shard; a query goes to a shard once, with its lists there.
Shards are scanned in single precision with a margin for its rounding; final scores are
double-precision inner products of the original vectors, ties go to smaller ids.

Null and zero vectors, those with null or non-finite components and those of another
length than the most common one take no part. Fewer candidates than k give fewer rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusframe.llm.common import cut


#: Numbers in the vectors of a shard, unless ``chunk`` vectors have more.
SHARD = 1 << 22


def usable(vectors: DataFrame, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """``id`` and ``v`` (doubles) of the vectors that take part."""
    v = F.transform(F.col(column), lambda x: x.cast("double"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col(key).alias("id"), v.alias("v")).where(F.col("id").isNotNull() & (F.size("v") > 0) & fine & F.exists("v", lambda x: x != 0))
    top = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.where(F.size("v") == (top["d"] if top else 0))


def _distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] + (centroids * centroids).sum(1) - 2 * x @ centroids.T, 0)


@dataclass
class Index:
    norm: float  # of the longest vector
    centroids: np.ndarray
    graph: np.ndarray  # neighbours of each centroid
    entries: np.ndarray
    boundary: float
    replicas: int
    ratio: float
    ids: np.ndarray | None = None  # of the sample, and its vectors
    known: np.ndarray | None = None

    def lifted(self, v: np.ndarray, query: bool = False) -> np.ndarray:
        """Vectors with their further component; queries are scaled to the common length and get 0."""
        if query:
            return np.hstack([v * (self.norm / np.sqrt((v * v).sum(1, keepdims=True))), np.zeros((len(v), 1))])
        return np.hstack([v, np.sqrt(np.maximum(self.norm**2 - (v * v).sum(1, keepdims=True), 0))])

    def lists_of(self, v: np.ndarray) -> list[np.ndarray]:
        """Lists of each stored vector: the nearest, and others that it is nearly as close to."""
        r, out = min(self.replicas, len(self.centroids)), []
        for a in range(0, len(v), 2048):
            d = _distances(self.lifted(v[a : a + 2048]), self.centroids)
            near = np.sort(np.argpartition(d, r - 1, axis=1)[:, :r], axis=1)
            near = np.take_along_axis(near, np.argsort(np.take_along_axis(d, near, 1), axis=1, kind="stable"), 1)
            kept = np.take_along_axis(d, near, 1) <= d.min(1, keepdims=True) * (1 + self.boundary)
            out += [n[k] for n, k in zip(near, kept, strict=True)]
        return out

    def nearest_known(self, v: np.ndarray, k: int) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
        """For each query ids and scores of the k + 1 nearest of the sample, and the score that its k + 1 nearest of all vectors reach at least."""
        s, n = v @ self.known.T, min(k + 1, len(self.known))
        low = np.partition(s, -n, axis=1)[:, -n]
        r, c = np.nonzero(s >= (low - 1e-9 * (1 + np.abs(low)))[:, None])
        exact = (v[r] * self.known[c]).sum(1)
        order = np.lexsort((self.ids[c], -exact, r))
        r, c, exact = r[order], c[order], exact[order]
        place = np.arange(len(r)) - np.searchsorted(r, r)
        first = place < n
        r, c, exact = r[first], c[first], exact[first]
        cuts = np.arange(n, len(r), n)
        least = exact[n - 1 :: n] if n == k + 1 else np.full(len(v), -np.inf)
        return np.split(self.ids[c], cuts), np.split(exact, cuts), least

    def probes(self, v: np.ndarray, held: np.ndarray | None = None, least: int = 0) -> list[np.ndarray]:
        """Lists to probe for each query: a walk over the centroid graph, then pruning by distance ratio;
        with ``held`` (ids of each list, none twice) further lists by distance until they hold ``least`` ids."""
        q, k = self.lifted(v, query=True), len(self.centroids)
        dist, done = np.full((len(q), k), np.inf), np.zeros((len(q), k), bool)
        dist[:, self.entries] = _distances(q, self.centroids[self.entries])
        beam = min(32, k) - 1
        while True:
            reach = np.maximum(dist.min(1) * (1 + self.ratio), np.partition(dist, beam, axis=1)[:, beam])
            rows, nodes = np.nonzero((dist <= reach[:, None]) & ~done & np.isfinite(dist))
            if not len(rows):
                break
            done[rows, nodes] = True
            rows, nodes = np.repeat(rows, self.graph.shape[1]), self.graph[nodes].ravel()
            new = ~np.isfinite(dist[rows, nodes])
            pair = np.unique(rows[new] * k + nodes[new])
            rows, nodes = pair // k, pair % k
            for a in range(0, len(rows), 1 << 16):
                r, c = rows[a : a + (1 << 16)], nodes[a : a + (1 << 16)]
                dist[r, c] = ((q[r] - self.centroids[c]) ** 2).sum(1)
        found = dist <= dist.min(1, keepdims=True) * (1 + self.ratio)
        few = np.flatnonzero(found @ held < least) if held is not None else []
        for a in range(0, len(few), 256):
            some = few[a : a + 256]
            near = np.argsort(np.where(found[some], -1, _distances(q[some], self.centroids)), axis=1, kind="stable")
            before = np.cumsum(held[near], axis=1) - held[near]
            r, place = np.nonzero((before < least) & (held[near] > 0))
            found[some[r], near[r, place]] = True
        return [np.flatnonzero(f) for f in found]


def build_index(sample: np.ndarray, lists: int, norm: float, boundary: float, replicas: int, recall: float, k: int, seed: int) -> Index:
    """Balanced k-means (a full list costs more), the centroids' graph, and the probing ratio."""
    rng = np.random.default_rng(seed)
    index = Index(norm, np.zeros((0, 0)), np.zeros((0, 0), int), np.zeros(0, int), boundary, replicas, 0.0)
    x = index.lifted(sample)
    c = x[rng.permutation(len(x))[:lists]].copy()
    penalty = np.zeros(len(c))
    for _ in range(8):
        near = np.argmin(_distances(x, c) * (1 + penalty), axis=1)
        size = np.bincount(near, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], x[rng.integers(0, len(x), len(c))])
        penalty = np.clip(penalty + 0.05 * (size / max(1.0, size.mean()) - 1), 0, 0.5)
    index.centroids = c
    near = np.argsort(_distances(c, c), axis=1, kind="stable")[:, : min(len(c), 17)]
    index.graph = np.hstack([near, rng.integers(0, len(c), (len(c), 4))])
    index.entries = np.unique(rng.integers(0, len(c), max(1, int(np.sqrt(len(c))))))
    # smallest ratio that finds enough of the true neighbours of some sampled queries
    queries = sample[rng.permutation(len(sample))[:400]]
    true = np.argsort(-(queries @ sample.T), axis=1, kind="stable")[:, : min(k + 1, len(sample))]
    d = _distances(index.lifted(queries, query=True), c)
    d = d / np.maximum(d.min(1, keepdims=True), 1e-300)
    stored = index.lists_of(sample)
    need = np.sort([d[i, stored[j]].min() - 1 for i, row in enumerate(true) for j in row])
    index.ratio = max(0.02, float(need[min(len(need) - 1, int(np.ceil(recall * len(need))))]))
    return index


def fit(rows: DataFrame, k: int, sample: int = 20_000, list_size: int = 256, most_lists: int = 2048, boundary: float = 0.08, replicas: int = 4, recall: float = 0.97, seed: int = 9) -> Index | None:
    """Fit on a sample of ``rows`` (columns ``id, v``), taken by a hash of the id; None without rows."""
    r = rows.agg(F.count("*").alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)).alias("m")).first()
    if not r["n"]:
        return None
    share = F.pmod(F.xxhash64(F.lit(seed), F.col("id")), F.lit(1_000_003)) / 1_000_003.0
    taken = rows.where(share < sample / r["n"]).select("id", "v").collect() or rows.limit(1).select("id", "v").collect()
    taken = list({t["id"]: t["v"] for t in sorted(taken, key=lambda t: (t["id"], t["v"]), reverse=True)}.items())[::-1]
    x = np.array([v for _, v in taken], float)
    lists = int(min(max(1, r["n"] // list_size), most_lists, max(1, len(x) // 4)))
    index = build_index(x.astype(np.float32).astype(float), lists, float(np.sqrt(r["m"])) or 1.0, boundary, replicas, recall, k, seed)
    index.ids, index.known = np.array([i for i, _ in taken], np.int64), x
    return index


def _once(rows: DataFrame, k: int) -> DataFrame:
    """Different vectors with their k + 1 smallest ids: ``ids, v``. Each task reduces its own copies first."""

    def reduce(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            held: dict[bytes, list[int]] = {}
            for i, v in zip(batch["id"], batch["v"], strict=True):
                held.setdefault((np.asarray(v) + 0.0).tobytes(), []).append(int(i))
            yield pd.DataFrame({"ids": [sorted(i)[: k + 1] for i in held.values()], "v": [np.frombuffer(v, float) for v in held]})

    merged = rows.mapInPandas(reduce, "ids array<long>, v array<double>").groupBy("v").agg(F.flatten(F.collect_list("ids")).alias("ids"))
    return merged.select(F.slice(F.array_sort(F.array_distinct("ids")), 1, k + 1).alias("ids"), "v")


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, chunk: int = 4096, **fitting: float) -> DataFrame:
    """The ``k`` nearest of ``vectors`` to each of ``queries`` (both ``id, v``, from ``usable``), the query's own id left out:
    ``query_id, rank, vec_id, score``."""
    spark = vectors.sparkSession
    vectors = cut(vectors)
    index = fit(vectors, k, **fitting)
    schema = "query_id long, rank int, vec_id long, score double"
    if index is None:
        return spark.createDataFrame([], schema)
    shared = spark.sparkContext.broadcast(index)

    def store(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                lists = shared.value.lists_of(np.stack(batch["v"]))
                at = np.repeat(np.arange(len(batch)), [len(x) for x in lists])
                home = np.concatenate(([True], at[1:] != at[:-1]))  # a vector's nearest list comes first
                yield pd.DataFrame({"list": np.concatenate(lists).astype(np.int32), "home": home, "ids": batch["ids"].to_numpy()[at], "v": batch["v"].to_numpy()[at]})

    def known(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for a in range(0, len(batch), 256):
                part = batch.iloc[a : a + 256]
                ids, scores, least = shared.value.nearest_known(np.stack(part["v"]), k)
                yield part.assign(ids=ids, scores=scores, least=least)

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, base, many = places.value
        for batch in batches:
            for a in range(0, len(batch), 512):
                part = batch.iloc[a : a + 512]
                at, shards, lists = [], [], []
                for i, probed in enumerate(shared.value.probes(np.stack(part["v"]), held, k + 1)):
                    probed = probed[many[probed] > 0]
                    if not len(probed):
                        continue
                    n = many[probed]
                    shard = np.repeat(base[probed], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    order = np.argsort(shard, kind="stable")
                    here, first = np.unique(shard[order], return_index=True)
                    at += [i] * len(here)
                    shards.append(here)
                    lists += np.split(np.repeat(probed, n)[order].astype(np.int32), first[1:])
                if at:
                    yield part.iloc[at][["a", "b", "v", "least"]].assign(shard=np.concatenate(shards).astype(np.int32), lists=lists)

    postings = cut(_once(vectors, k).mapInPandas(store, "list int, home boolean, ids array<long>, v array<double>"))
    sizes = postings.groupBy("list").agg(F.count("*").alias("n"), F.sum(F.when(F.col("home"), F.size("ids")).otherwise(0)).alias("held")).collect()  # a row for each list, most_lists at most
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    room = max(chunk, min(SHARD // index.known.shape[1], sum(r["n"] for r in sizes) // tasks))
    held, base, many = (np.zeros(len(index.centroids), np.int64) for _ in range(3))
    shards = filled = 0
    for r in sorted(sizes, key=lambda r: r["list"]):
        i, n = r["list"], -(-r["n"] // room)
        if filled and (n > 1 or filled + r["n"] > room):
            shards, filled = shards + 1, 0
        held[i], base[i], many[i] = r["held"], shards, n
        shards, filled = (shards + n, 0) if n > 1 else (shards, filled + r["n"])
    places = spark.sparkContext.broadcast((held, base, many))
    where = spark.createDataFrame([(i, int(base[i]), int(many[i])) for i in np.flatnonzero(many).tolist()], "list int, base int, many int")
    # equal queries are asked once, under a 128-bit name of their vector
    asked = cut(queries.select("id", "v", F.xxhash64(F.lit(1), F.col("v")).alias("a"), F.xxhash64(F.lit(2), F.col("v")).alias("b")))
    once = asked.groupBy("a", "b").agg(F.first("v").alias("v")).repartition(tasks, "a")
    near = cut(once.mapInPandas(known, "a long, b long, v array<double>, ids array<long>, scores array<double>, least double"))
    probes = near.select("a", "b", "v", "least").repartition(tasks, "a").mapInPandas(probe, "a long, b long, v array<double>, least double, shard int, lists array<int>")

    none = F.lit(None)
    shard = (F.col("base") + F.pmod(F.xxhash64("v"), F.col("many"))).cast("int").alias("shard")
    p = postings.join(F.broadcast(where), "list").select(shard, F.lit(0).alias("kind"), "list", "ids", "v", F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"), none.cast("double").alias("least"), none.cast("array<int>").alias("lists"))
    q = probes.select("shard", F.lit(1).alias("kind"), F.lit(-1).alias("list"), none.cast("array<long>").alias("ids"), "v", "a", "b", "least", "lists")
    work = p.unionByName(q).repartition(max(tasks, shards + 1), "shard").sortWithinPartitions("shard", "kind", "list")
    best = work.mapInPandas(lambda b: _scan(b, k), "a long, b long, id long, score double")
    best = best.unionByName(near.select("a", "b", F.explode(F.arrays_zip("ids", "scores")).alias("x")).select("a", "b", F.col("x.ids").alias("id"), F.col("x.scores").alias("score")))
    top = best.groupBy("a", "b").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), F.col("id").alias("i")))).alias("all"))
    # equal ones are neighbours now; array_distinct compares structs all with all
    top = top.select("a", "b", F.slice(F.filter("all", lambda x, i: (i == 0) | (x != F.get(F.col("all"), i - 1))), 1, k + 1).alias("found"))
    rows = asked.select("id", "a", "b").join(top, ["a", "b"])
    mine = F.slice(F.filter("found", lambda x: x["i"] != F.col("id")), 1, k)
    return rows.select(F.col("id").alias("query_id"), F.posexplode(mine).alias("p", "x")).select("query_id", (F.col("p") + 1).alias("rank"), F.col("x.i").alias("vec_id"), (-F.col("x.s")).alias("score"))


def _scan(batches: Iterator[pd.DataFrame], k: int, flush: int = 2_000_000) -> Iterator[pd.DataFrame]:
    """Shards of postings followed by the queries that probe them: the k + 1 best of each query in this task, as far as they reach its ``least``."""
    held, store = None, []
    matrix = None
    buffer: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
    size = 0

    def best(parts: list) -> tuple[np.ndarray, ...]:
        a, b, i, s = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((i, -s, b, a))
        a, b, i, s = a[order], b[order], i[order], s[order]
        new = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
        twice = np.concatenate(([False], (i[1:] == i[:-1]) & ~new[1:]))  # the same pair from two lists
        a, b, i, s = a[~twice], b[~twice], i[~twice], s[~twice]
        new = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
        first = np.flatnonzero(new)
        place = np.arange(len(a)) - np.repeat(first, np.diff(np.append(first, len(a))))
        return tuple(x[place <= k] for x in (a, b, i, s))

    for batch in batches:
        key = batch["shard"].to_numpy()
        edges = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1), len(key)]
        for lo, hi in zip(edges, edges[1:], strict=False):
            if lo == hi:
                continue
            if key[lo] != held:
                held, store, matrix = key[lo], [], None
            part = batch.iloc[lo:hi]
            is_query = part["kind"].to_numpy() == 1
            if not is_query.all():
                new = part[~is_query]
                store.append((new["list"].to_numpy(), new["ids"].tolist(), np.stack(new["v"])))
            if not is_query.any() or not store:
                continue
            if matrix is None:  # all postings of a shard come before its queries
                matrix = np.concatenate([m for _, _, m in store])
                ids = [i for _, x, _ in store for i in x]
                count = np.array([len(i) for i in ids])
                first = np.concatenate(([0], np.cumsum(count)))
                flat = np.concatenate(ids).astype(np.int64)
                lists, start = np.unique(np.concatenate([x for x, _, _ in store]), return_index=True)
                end = np.append(start[1:], len(matrix))
                scale = np.sqrt((matrix * matrix).sum(1).max())
                small = (matrix / scale).astype(np.float32)
                margin = 1.2e-7 * (matrix.shape[1] + 8)  # of the rounding of a single-precision product of vectors of at most unit length
                store = [(x[:0], [], m[:0]) for x, _, m in store[:1]]
            asked = part[is_query]
            for a in range(0, len(asked), 512):
                some = asked.iloc[a : a + 512]
                q, names = np.stack(some["v"]), some[["a", "b"]].to_numpy(np.int64)
                length = np.sqrt((q * q).sum(1))
                unit = (q / length[:, None]).astype(np.float32)
                low = some["least"].to_numpy(float) / (length * scale) - margin
                who = np.repeat(np.arange(len(q)), [len(x) for x in some["lists"]])
                probed = np.searchsorted(lists, np.concatenate(some["lists"].to_list()))
                order = np.argsort(probed, kind="stable")
                which, begin = np.unique(probed[order], return_index=True)
                for j, rows in zip(which, np.split(who[order], begin[1:]), strict=True):
                    s = unit[rows] @ small[start[j] : end[j]].T
                    reach = low[rows]
                    if not np.isfinite(reach).all():  # the sample has too few to tell
                        n = min(k + 1, s.shape[1])
                        reach = np.maximum(reach, np.partition(s, -n, axis=1)[:, -n] - 2 * margin)
                    at = np.flatnonzero(s >= reach[:, None].astype(np.float32))
                    if not len(at):
                        continue
                    r, c = rows[at // s.shape[1]], at % s.shape[1] + start[j]
                    exact = (q[r] * matrix[c]).sum(1)
                    many = np.repeat(np.arange(len(r)), count[c])
                    place = np.arange(len(many)) - np.repeat(np.cumsum(count[c]) - count[c], count[c])
                    buffer.append((names[r[many], 0], names[r[many], 1], flat[first[c[many]] + place], exact[many]))
                    size += len(many)
                    if size > flush:
                        buffer = [best(buffer)]
                        size = 0
                        if len(buffer[0][0]) > flush // 2:
                            yield pd.DataFrame(dict(zip(("a", "b", "id", "score"), buffer[0], strict=True)))
                            buffer = []
    if buffer:
        yield pd.DataFrame(dict(zip(("a", "b", "id", "score"), best(buffer), strict=True)))
