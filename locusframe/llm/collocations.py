"""Phrase collocation mining with burst-trie counting.

Texts are lower-cased (A-Z), split into pieces at sentence marks and line ends, and pieces into
words at spaces and tabs. Phrases of one, two and three words are counted for each language in three
passes over the texts. In a pass every task keeps a trie over word ids for each language: phrases start
in one hash container, and a container that grows beyond BURST entries bursts, giving those
next words that hold a good part of it a container of their own, while the others go on sharing
it. When the tries of a task hold more than ``held`` entries, whole subtrees, the largest first,
leave it as sorted runs, and the runs are merged in partitions by prefix. The last word's hash adds
four bits to a prefix's partition, so a prefix with a third of all phrases is spread over sixteen.

A phrase can only be as frequent as its parts, so the second pass leaves out pairs with a word below
``min_count``, and the third leaves out triples with a pair below it. A Bloom filter of at most
2 ** FILTER_BITS bits (16 MB) carries the parts to the tasks: what it lets pass wrongly is only
counted and then dropped, so counts are exact at every fill.

Scores use decimals of 38 digits; they are exact for counts up to 1e15. The first ``top`` of each
language are found in two steps, first within 64 parts of its phrases.

Null and empty texts have no words; a null language is ``und``, together with texts that
say ``und``. Repeated rows count each time. Texts of any length are read whole, in slices of about
a megabyte; the last words of a slice begin the next. Columns besides the two that are read play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from locusframe.llm.common import Filter, bloom_filter, cut, mix, tidy

# Lower-cases A-Z, makes marks and line ends a line feed and a tab a space, on UTF-8 bytes.
_PREPARE = bytes(b + 32 if 65 <= b <= 90 else 10 if b in b".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b for b in range(256))
_SLICE = 1 << 20
BURST = 1 << 14
_ID_BITS = 21  # three word ids in one long
_MOST_IDS = 1 << 20
_GAP, _END = 0, 1  # ids of nothing between two spaces and of the end of a piece


def _follow(first: np.ndarray, then: np.ndarray) -> np.ndarray:
    """Hash of a sequence and one more word, from the hash of each."""
    return mix(first * np.uint64(3) + then)


def _name(data: bytes) -> int:
    return xxhash.xxh64_intdigest(data)


class _Ids(dict):
    """Word -> id in order of arrival, with the words' hashes."""

    def __init__(self) -> None:
        super().__init__({b"": _GAP, b"\n": _END})
        self.names: list[bytes] = [b"", b"\n"]
        self.hashes = np.zeros(1024, np.uint64)
        self.hashed = 2

    def __missing__(self, word: bytes) -> int:
        self[word] = i = len(self.names)
        self.names.append(word)
        return i

    def of(self, data: bytes) -> np.ndarray:
        tokens = data.replace(b"\n", b" \n ").split(b" ")
        ids = np.fromiter(map(self.__getitem__, tokens), np.int64, len(tokens))
        if len(self.names) > len(self.hashes):
            self.hashes = np.concatenate((self.hashes, np.zeros(len(self.names), np.uint64)))
        for i in range(self.hashed, len(self.names)):
            self.hashes[i] = _name(self.names[i])
        self.hashed = len(self.names)
        return ids[ids != _GAP]


class _Node:
    """A container of phrases, and below it the subtrees of next words that have burst out of it."""

    __slots__ = ("counts", "kids", "limit")

    def __init__(self) -> None:
        self.counts: dict[int, int] = {}
        self.kids: dict[int, _Node] = {}
        self.limit = BURST

    def size(self) -> int:
        return len(self.counts) + sum(k.size() for k in self.kids.values())

    def items(self) -> Iterator[tuple[int, int]]:
        yield from self.counts.items()
        for kid in self.kids.values():
            yield from kid.items()

    def add(self, keys: np.ndarray, n: np.ndarray, shift: int) -> None:
        """Count sorted ``keys``; ``shift`` is where the next word's id begins in a key."""
        if self.kids:
            rest = np.ones(len(keys), bool)
            step = np.int64(1) << np.int64(shift)
            for first, kid in self.kids.items():
                a, b = np.searchsorted(keys, [first * step, (first + 1) * step])
                if a < b:
                    kid.add(keys[a:b], n[a:b], shift - _ID_BITS)
                    rest[a:b] = False
            keys, n = keys[rest], n[rest]
        counts = self.counts
        get = counts.get
        for k, c in zip(keys.tolist(), n.tolist(), strict=True):
            counts[k] = get(k, 0) + c
        if shift and len(counts) > self.limit:
            self._burst(shift)

    def _burst(self, shift: int) -> None:
        held = np.fromiter(self.counts, np.int64, len(self.counts))
        first, many = np.unique(held >> np.int64(shift), return_counts=True)
        large = first[many * 64 >= len(held)]
        for word in large.tolist():
            self.kids[word] = _Node()
        for key in held[np.isin(held >> np.int64(shift), large)].tolist():
            self.kids[key >> shift].counts[key] = self.counts.pop(key)
        self.limit = max(BURST, 2 * len(self.counts))


class _Counter:
    """The trie of one language in one task, for phrases of ``n`` words."""

    def __init__(self, lang: str, n: int, known: Filter | None) -> None:
        self.lang, self.n, self.known = lang, n, known
        self.seed = np.array([_name(lang.encode())], np.uint64)
        self.clear()

    def clear(self) -> None:
        self.ids, self.root, self.size = _Ids(), _Node(), 0

    def count(self, data: bytes) -> Iterator[None]:
        """Count the phrases of prepared text, slice by slice; between two slices the trie may be emptied."""
        before: list[bytes] = []
        at = 0
        while at < len(data):
            stop = len(data)
            if stop - at > _SLICE:
                stop = max(data.rfind(b" ", at, at + _SLICE), data.rfind(b"\n", at, at + _SLICE)) + 1
                if stop <= at:  # one word longer than a slice
                    ends = [e for e in (data.find(b" ", at), data.find(b"\n", at)) if e >= 0]
                    stop = min(ends) + 1 if ends else len(data)
            ids = np.concatenate((np.array([self.ids[w] for w in before], np.int64), self.ids.of(data[at:stop])))
            self._add(ids)
            before = [self.ids.names[i] for i in ids[max(0, len(ids) - self.n + 1) :]]
            at = stop
            yield

    def _add(self, ids: np.ndarray) -> None:
        n, h = self.n, self.ids.hashes
        if len(ids) < n:
            return
        inside = ids > _END
        if self.known is not None and n == 2:
            ok = np.zeros(len(self.ids.names), bool)
            seen = np.unique(ids)
            ok[seen] = self.known.has(_follow(self.seed, h[seen]))
            inside &= ok[ids]
        whole = inside[: len(ids) - n + 1].copy()
        for i in range(1, n):
            whole &= inside[i : len(ids) - n + 1 + i]
        at = np.flatnonzero(whole)
        if self.known is not None and n == 3:
            pairs = self.known.has(_follow(_follow(self.seed, h[ids[:-1]]), h[ids[1:]]))
            at = at[pairs[at] & pairs[at + 1]]
        key = ids[at]
        for i in range(1, n):
            key = key << _ID_BITS | ids[at + i]
        keys, many = np.unique(key, return_counts=True)
        self.root.add(keys, many, _ID_BITS * (n - 1))
        self.size = self.root.size()

    def run(self, node: _Node, own: bool) -> pa.RecordBatch:
        """The phrases of a subtree (``own``: only those of its own container) as a run, sorted word by word."""
        n, size = self.n, len(node.counts) if own else node.size()
        if own:
            key, many = (np.fromiter(x, np.int64, size) for x in (node.counts, node.counts.values()))
        else:
            key, many = np.fromiter(chain.from_iterable(node.items()), np.int64, 2 * size).reshape(-1, 2).T
        words = [key >> np.int64(_ID_BITS * (n - 1 - i)) & np.int64((1 << _ID_BITS) - 1) for i in range(n)]
        used, at = np.unique(np.concatenate(words), return_inverse=True)
        names = [self.ids.names[i] for i in used.tolist()]
        rank = np.empty(len(used), np.int64)
        rank[sorted(range(len(names)), key=names.__getitem__)] = np.arange(len(names))
        at = at.reshape(n, -1)
        order = np.lexsort(rank[at[::-1]])
        prefix = np.repeat(self.seed, size)
        for w in words[: max(1, n - 1)]:
            prefix = _follow(prefix, self.ids.hashes[w])
        part = (prefix >> np.uint64(44)).astype(np.int32) << 4 | (self.ids.hashes[words[-1]] & np.uint64(15)).astype(np.int32) * (n > 1)
        spelt = pa.array(names, pa.string())
        phrase = pc.binary_join_element_wise(*(spelt.take(pa.array(i[order])) for i in at), " ") if n > 1 else spelt.take(pa.array(at[0][order]))
        lang = pa.DictionaryArray.from_arrays(pa.array(np.zeros(size, np.int32)), pa.array([self.lang])).cast(pa.string())
        return pa.RecordBatch.from_arrays([lang, pa.array(part[order]), phrase, pa.array(many[order])], ["lang", "part", "phrase", "n"])

    def spill(self, keep: int) -> Iterator[pa.RecordBatch]:
        """Give up whole subtrees, the largest first, until at most ``keep`` entries are held."""
        trees = sorted(((kid.size(), word) for word, kid in self.root.kids.items()), reverse=True)
        for many, word in trees:
            if self.size <= keep:
                break
            yield self.run(self.root.kids.pop(word), False)
            self.size -= many
        if self.size > keep:
            yield self.run(self.root, True)
            self.size -= len(self.root.counts)
            self.root.counts = {}
            self.root.limit = BURST


def phrase_counts(docs: DataFrame, n: int, known: Filter | None = None, held: int = 1_000_000, lang: str = "lang", text: str = "text") -> DataFrame:
    """``lang, phrase, n``: how often each phrase of ``n`` words occurs, with those left out whose parts ``known`` lacks."""
    shared = docs.sparkSession.sparkContext.broadcast(known)

    @tidy
    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tries: dict[str, _Counter] = {}
        for batch in batches:
            waiting: dict[str, list[bytes]] = {}
            room: dict[str, int] = {}
            langs, texts = batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())
            for i, name in enumerate(langs):
                t = texts[i].as_py()
                if not t:
                    continue
                name = "und" if name is None else name
                waiting.setdefault(name, []).append(t.translate(_PREPARE))
                room[name] = room.get(name, 0) + len(t)
                if room[name] > _SLICE // 2:
                    yield from counted(tries, name, b"\n".join(waiting.pop(name)))
                    room[name] = 0
            for name, parts in waiting.items():
                yield from counted(tries, name, b"\n".join(parts))
        for trie in tries.values():
            yield from trie.spill(-1)

    def counted(tries: dict[str, _Counter], name: str, data: bytes) -> Iterator[pa.RecordBatch]:
        trie = tries.get(name)
        if trie is None:
            trie = tries[name] = _Counter(name, n, shared.value)
        for _ in trie.count(data):
            if len(trie.ids.names) > _MOST_IDS // 2:
                yield from trie.spill(-1)
                trie.clear()
            while sum(t.size for t in tries.values()) > held:
                most = max(tries.values(), key=lambda t: t.size)
                yield from most.spill(most.size // 2)

    found = docs.select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text")).mapInArrow(runs, "lang string, part int, phrase string, n long")
    return found.repartition("lang", "part").groupBy("lang", "part", "phrase").agg(F.sum("n").alias("n")).select("lang", "phrase", "n")


def filter_of(phrases: DataFrame) -> Filter:
    """A filter of the phrases (``lang, phrase``)."""

    @tidy
    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first = np.zeros(batch.num_rows, np.uint64)
            lasts = np.zeros(batch.num_rows, np.uint64)
            for i, (lang, phrase) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True)):
                h = np.array([_name(lang.encode())], np.uint64)
                words = phrase.split(b" ")
                for w in words[:-1]:
                    h = _follow(h, np.array([_name(w)], np.uint64))
                first[i], lasts[i] = h[0], _name(words[-1])
            yield pa.RecordBatch.from_arrays([pa.array(_follow(first, lasts).view(np.int64))], ["h"])

    return bloom_filter(phrases.select("lang", "phrase").mapInArrow(hashes, "h long"), phrases.count())


def score(left: str, right: str) -> Column:
    """floor(1e6 a a / (l r)) of the column ``a`` and the columns of the parts' counts, in decimals."""
    whole, of = (f"CAST({c} AS DECIMAL(15,0))" for c in ("a", "{}"))
    return F.expr(f"CAST(1000000 * {whole} * {whole} AS DECIMAL(38,0)) div ({of.format(left)} * {of.format(right)})")


def collocations(docs: DataFrame, min_count: int = 10, inside_percent: int = 50, top: int = 2000, lang: str = "lang", text: str = "text") -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the first ``top`` phrases of two and three words of each language.

    ``a`` counts the phrase; it is cut where the parts' counts ``l`` and ``r`` give the lowest floor(1e6 a a / (l r)), at
    the first such place; ``n`` counts the language's words. Phrases of fewer than ``min_count`` occurrences don't count, nor
    do those that lie in a longer one with at least ``inside_percent`` in a hundred of their occurrences. Equal scores
    go by ``a``, the larger first, then by phrase in byte order. ``min_count`` is 1 at least.
    """
    if min_count < 1:
        raise ValueError("min_count is 1 at least")
    singles = cut(phrase_counts(docs, 1, lang=lang, text=text))
    total = singles.groupBy("lang").agg(F.sum("n").alias("n"))
    singles = singles.where(F.col("n") >= min_count)
    pairs = cut(phrase_counts(docs, 2, filter_of(singles), lang=lang, text=text).where(F.col("n") >= min_count))
    triples = cut(phrase_counts(docs, 3, filter_of(pairs), lang=lang, text=text).where(F.col("n") >= min_count))

    word = F.split("phrase", " ")
    two = pairs.select("lang", "phrase", F.col("n").alias("a"), F.array(word[0], word[1]).alias("parts"))
    first, last = F.concat_ws(" ", word[0], word[1]), F.concat_ws(" ", word[1], word[2])
    three = triples.select("lang", "phrase", F.col("n").alias("a"), F.array(word[0], last, first, word[2]).alias("parts"))
    needs = two.unionByName(three).select("lang", "phrase", "a", F.posexplode("parts").alias("at", "part"))
    counts = singles.unionByName(pairs).select("lang", F.col("phrase").alias("part"), F.col("n").alias("c"))
    rows = needs.join(counts, ["lang", "part"]).select("lang", "phrase", "a", "at", "c", F.lit(None).cast("long").alias("longer"))
    none = F.lit(None)
    inner = triples.select("lang", F.explode(F.array(first, last)).alias("phrase"), none.cast("long").alias("a"), none.cast("int").alias("at"), none.cast("long").alias("c"), F.col("n").alias("longer"))
    by_place = [F.max(F.when(F.col("at") == i, F.col("c"))).alias(f"c{i}") for i in range(4)]
    gathered = rows.unionByName(inner).groupBy("lang", "phrase").agg(F.max("a").alias("a"), F.max("longer").alias("longer"), *by_place)

    gathered = gathered.where(F.col("longer").isNull() | (100 * F.col("longer") < inside_percent * F.col("a")))
    gathered = gathered.withColumn("s1", score("c0", "c1")).withColumn("s2", F.when(F.col("c2").isNotNull(), score("c2", "c3")))
    later = F.coalesce(F.col("s2") < F.col("s1"), F.lit(False))
    scored = gathered.select("lang", "phrase", "a", *[F.when(later, F.col(y)).otherwise(F.col(x)).alias(z) for x, y, z in (("c0", "c2", "l"), ("c1", "c3", "r"), ("s1", "s2", "score"))])

    order = (F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc())
    some = scored.withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    some = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "_part").orderBy(*order))).where(F.col("rank") <= top)
    best = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return best.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
