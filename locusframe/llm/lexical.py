"""Ranked lexical search by exact inner products over sparse ball trees.

A document is a sparse vector of integer impacts, one for each of its terms; an item is the set of its
terms, and a document's score is the sum of its impacts over them. Items go to the tasks in slices of about
``slice_chars`` characters, one after another, and a slice's terms are the only ones that its document vectors need:
they are written once as (term numbers, occurrences), and document frequencies are counted from there.

Every task builds ball trees over its documents, in trees of a bounded number of cells. A node has the mean of
its vectors, the distance from it to the farthest of them, and the terms that occur in it; distances are taken with
each term's axis divided by the root of its weight, so that rare terms don't widen the balls of all others. No document
below a node can score more than the mean's score plus the radius times the length of the item in that metric, over the
terms that occur there. Radius and bound are rounded up by more than double arithmetic can lose. For every item the nodes of a tree
are visited best bound first, until the best bound left is below the last score kept; a task carries the scores kept
from tree to tree. Leaves are scored in 64-bit integers. Of each task at most ``top`` documents for each item go on,
and are ranked within groups of tasks first.

Null and empty texts, of documents or items, have no term: such documents are not counted and items get no row.
Equal rows of the benchmark are one item; rows with one id and different texts are ranked each by itself.
Repeated documents each count and are ranked each; a null document id comes before all others of equal score.
Texts of any length are read whole, in pieces of about a megabyte.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from locusframe.llm.common import cut, tidy
from locusframe.llm.decontaminate import words

LEAF = 32
CELLS = 6_000_000  # of a tree: documents times terms
MOST_DOCS = 2048
_SAFE = 1e-9  # more than sums of a million rounded terms lose, relative to their size
_NONE = np.iinfo(np.int64).min


def _pieces(text: str, size: int = 1 << 20) -> Iterator[str]:
    """``text`` in pieces that end at spaces or line feeds."""
    at = 0
    while at < len(text):
        stop = len(text)
        if stop - at > size:
            ends = [e for e in (text.find(" ", at + size), text.find("\n", at + size)) if e >= 0]
            stop = min(ends, default=stop)
        yield text[at:stop]
        at = stop


def vectors(docs: DataFrame, vocabulary: dict[bytes, int], text: str = "text") -> DataFrame:
    """``docs`` with ``_n`` (terms with repeats), ``_terms`` (numbers in ``vocabulary``) and ``_tf`` in place of the text."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    @F.pandas_udf("_n long, _terms array<int>, _tf array<int>")
    @tidy
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        get = shared.value.get
        for batch in batches:
            rows = []
            for t in batch:
                n, found = 0, []
                for piece in _pieces(t) if isinstance(t, str) else ():
                    terms = words(piece)
                    n += len(terms)
                    ids = np.fromiter((get(w, -1) for w in terms), np.int32, len(terms))
                    found.append(ids[ids >= 0])
                ids, tf = np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.int32), np.zeros(0, np.int64))
                rows.append((n, ids.astype(np.int32), tf.astype(np.int32)))
            yield pd.DataFrame(rows, columns=["_n", "_terms", "_tf"])

    own = [c for c in docs.columns if c != text]
    return docs.select(*own, count(F.col(text)).alias("_v")).select(*own, "_v.*")


@dataclass
class Collection:
    """What scoring needs to know of all documents: counts, total terms, and weights of the vocabulary."""

    documents: int
    terms: int
    weight: np.ndarray

    def impacts(self, n: int, terms: np.ndarray, tf: np.ndarray) -> np.ndarray:
        m = 50 + 50 * n * self.documents // self.terms
        tf = tf.astype(np.int64)
        return self.weight[terms] * (1_000_000_000 * tf // (1000 * tf + 20 * m))


class BallTree:
    """Documents as rows of impacts over the terms that occur among them."""

    def __init__(self, docs: list[tuple[np.ndarray, np.ndarray]], weight: np.ndarray) -> None:
        self.terms = np.unique(np.concatenate([t for t, _ in docs]))
        self.x = np.zeros((len(docs), len(self.terms)), np.int64)
        for row, (t, impact) in enumerate(docs):
            self.x[row, np.searchsorted(self.terms, t)] = impact
        self.w = np.maximum(weight[self.terms], 1).astype(float)
        self.scaled = self.x / np.sqrt(self.w)
        self.norm = np.square(self.scaled).sum(1)
        self.rows: list[np.ndarray | None] = []  # of leaves
        self.kids: list[tuple[int, int] | None] = []
        centre, radius, inside = [], [], []
        todo = [np.arange(len(docs))]
        while todo:  # nodes in order of number: a node's children come later
            rows = todo.pop(0)
            mean = self.x[rows].mean(0)
            far, c = 0.0, mean / np.sqrt(self.w)
            apart = np.zeros(len(rows))
            for a in range(0, len(rows), 128):
                apart[a : a + 128] = np.square(self.scaled[rows[a : a + 128]] - c).sum(1)
            far = math.sqrt(apart.max()) * (1 + _SAFE) + _SAFE * math.sqrt(self.norm[rows].max())
            centre.append(mean)
            radius.append(far)
            inside.append(np.where(self.x[rows].any(0), self.w, 0))
            number, halves = len(self.rows), self._halves(rows, apart)
            if halves is None:
                self.rows.append(rows)
                self.kids.append(None)
            else:
                first = number + len(todo) + 1
                self.rows.append(None)
                self.kids.append((first, first + 1))
                todo.extend(halves)
        self.centre, self.radius, self.inside = np.array(centre), np.array(radius), np.array(inside)
        del self.scaled

    def _halves(self, rows: np.ndarray, apart: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """The rows nearer to each of two that lie far apart; halves by the difference if one side gets under a tenth."""
        if len(rows) <= LEAF or apart.max() <= _SAFE * self.norm[rows].max():
            return None
        x = self.scaled[rows]
        one = x[np.argmax(apart)]
        to_one = self.norm[rows] - 2 * (x @ one)
        two = x[np.argmax(to_one)]
        lean = to_one - (self.norm[rows] - 2 * (x @ two)) + one @ one - two @ two
        left = lean <= 0
        if min(left.sum(), len(rows) - left.sum()) * 10 < len(rows):
            left = np.zeros(len(rows), bool)
            left[np.argsort(lean, kind="stable")[: len(rows) // 2]] = True
        return rows[left], rows[~left]

    def columns(self, item: np.ndarray) -> np.ndarray:
        """Columns of an item's terms (sorted)."""
        at = np.searchsorted(self.terms, item)
        return at[self.terms[np.minimum(at, len(self.terms) - 1)] == item]

    def bounds(self, columns: np.ndarray) -> np.ndarray:
        """For every node, what no document below it can exceed."""
        reach = np.sqrt(self.inside[:, columns].sum(1)) * self.radius
        return (self.centre[:, columns].sum(1) + reach) * (1 + _SAFE) + 1

    def search(self, item: np.ndarray, kept: "Best", ids: np.ndarray) -> int:
        """Offer all documents that can be among the best; gives the number scored."""
        columns = self.columns(item)
        if not len(columns):
            return 0
        bound, scored = self.bounds(columns), 0
        open_ = [(-bound[0], 0)]
        while open_ and -open_[0][0] >= kept.least:
            _, node = heapq.heappop(open_)
            if self.kids[node] is None:
                rows = self.rows[node]
                kept.offer(self.x[np.ix_(rows, columns)].sum(1), ids[rows])
                scored += len(rows)
            else:
                for kid in self.kids[node]:
                    heapq.heappush(open_, (-bound[kid], kid))
        return scored


class Best:
    """The ``top`` best of an item so far: highest scores first, then smallest ids; scores of 0 never count."""

    def __init__(self, top: int) -> None:
        self.top, self.least = top, 1
        self.score, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def offer(self, score: np.ndarray, ids: np.ndarray) -> None:
        may = score >= self.least
        if not may.any():
            return
        score, ids = np.concatenate((self.score, score[may])), np.concatenate((self.ids, ids[may]))
        order = np.lexsort((ids, -score))[: self.top]
        self.score, self.ids = score[order], ids[order]
        if len(order) == self.top:
            self.least = int(self.score[-1])


def _best_of_tasks(found: DataFrame, top: int, seen: Collection, items: list[np.ndarray]) -> DataFrame:
    """``item, doc_id, score`` of the best of every task, from vectors."""
    shared = found.sparkSession.sparkContext.broadcast((seen, items))

    @tidy
    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen, items = shared.value
        limit = int(np.clip(CELLS // max(1, len(seen.weight)), LEAF, MOST_DOCS))
        best = [Best(top) for _ in items]
        held, ids = [], []

        def through() -> None:
            tree, numbers = BallTree(held, seen.weight), np.array(ids, np.int64)
            for item, kept in zip(items, best, strict=True):
                tree.search(item, kept, numbers)
            held.clear()
            ids.clear()

        for batch in batches:
            for doc, null, n, terms, tf in zip(batch["doc_id"].fillna(_NONE), batch["doc_id"].isna(), batch["_n"], batch["_terms"], batch["_tf"], strict=True):
                held.append((terms, seen.impacts(int(n), terms, tf)))
                ids.append(_NONE if null else int(doc))
                if len(held) >= limit:
                    through()
        if held:
            through()
        for k, b in enumerate(best):
            if len(b.ids):
                doc = pd.Series(b.ids, dtype="Int64").mask(b.ids == _NONE)
                yield pd.DataFrame({"item": k, "doc_id": doc, "score": b.score})

    return found.where(F.size("_terms") > 0).mapInPandas(search, "item int, doc_id long, score long")


def rank(docs: DataFrame, benchmark: DataFrame, top: int = 50, slice_chars: int = 1_000_000) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``top`` best documents (doc_id, text) for each item (item_id, text).

    N documents have a term and hold L terms in all; a term of df documents weighs floor(1000 ln((2 N + 2) / (2 df + 1))), and a
    document of n terms has m = 50 + 50 n N div L. A term that occurs tf times adds weight * ((10^9 tf) div (1000 tf + 20 m)).
    Equal scores go by id, the smaller first; documents with score 0 are left out.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    benchmark = benchmark.select("item_id", "text").distinct()
    total = benchmark.agg(F.sum(F.char_length("text"))).first()[0] or 0
    slices = max(1, -(-total // slice_chars))
    out = None
    for k in range(slices):
        part = benchmark if slices == 1 else benchmark.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(slices)) == k)
        taken = sorted(part.collect(), key=lambda r: (r["item_id"] is None, r["item_id"], r["text"] or ""))
        vocabulary: dict[bytes, int] = {}
        items = [np.unique(np.array([vocabulary.setdefault(w, len(vocabulary)) for w in words(r["text"])], np.int64)) for r in taken]
        found = cut(vectors(docs, vocabulary))
        sums = found.agg(F.count(F.when(F.col("_n") > 0, 1)).alias("documents"), F.sum("_n").alias("terms")).first()
        held = dict(found.select(F.explode("_terms").alias("t")).groupBy("t").count().toArrow().to_pandas().itertuples(index=False, name=None))
        n = sums["documents"]
        weight = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * held.get(t, 0) + 1))) for t in range(len(vocabulary))], np.int64)
        best = _best_of_tasks(found, top, Collection(n, sums["terms"] or 0, weight), items)
        best = best.withColumn("_group", F.spark_partition_id() % 256)
        order = (F.col("score").desc(), F.col("doc_id").asc_nulls_first())
        for keys in (["item", "_group"], ["item"]):
            best = best.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= top)
        names = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(taken)], f"item int, item_id {benchmark.schema['item_id'].dataType.simpleString()}")
        best = best.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")
        out = best if out is None else out.unionByName(best)
    return out
