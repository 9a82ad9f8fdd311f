"""Benchmark decontamination with suffix arrays over the training texts.

Texts are lower-cased (A-Z) and cut into words: runs of letters, digits and
non-ASCII characters. Each shard (texts of up to SHARD_WORDS words inside a task) is
indexed by a suffix array over its word positions, and every suffix of every benchmark
item is found in it by binary search, at each length up to ``window``; longer matches are
followed word by word. Suffixes of the shard that do not begin with two words adjacent
in some item match one word at most and are left out of the array before it is sorted.
A match of ``window`` words (an item of fewer words: the whole item) marks the document's
words. The search also gives each document's longest verbatim match, of one word or more,
and where it is: of equally long ones the first in the document, then the first item.

Documents never move: one map over their rows. The benchmark goes to the tasks in
slices of about ``slice_chars`` characters, one after another: the findings of a slice are
written beside the rows before the next slice is collected and broadcast, so a benchmark
of any size needs bounded memory, and rows without an id, or with an equal one, stay apart.

Null and empty texts have no words and match nothing. Items without a word never
occur. Items with one id count once; those without an id mark words and count as one
null id. Documents of any length are read whole, and held as word numbers, 4 bytes each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusframe.llm.common import cut as written
from locusframe.llm.common import tidy

# Lower-cases A-Z and turns what is not part of a word into a space, on UTF-8 bytes.
_TO_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
SHARD_WORDS = 1_000_000
_PIECE = 1 << 20  # bytes of a text split at once


def words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_TO_WORDS).split() if text else []


class Items:
    """One slice of the benchmark: its vocabulary and all suffixes of its items, to the depth of a window."""

    def __init__(self, rows: list[tuple[str | None, str | None]], window: int) -> None:
        self.window, self.vocab = window, {}
        texts = [(i, words(t)) for i, t in rows]
        coded = [(i, np.array([self.vocab.setdefault(w, len(self.vocab) + 1) for w in t], np.int32)) for i, t in texts if t]
        self.ids = [i for i, _ in coded]
        self.texts = [c for _, c in coded]
        self.flat = np.concatenate([*self.texts, np.zeros(window, np.int32)])
        size = np.array([len(c) for c in self.texts], np.int64)
        self.start = np.cumsum(size) - size
        self.end = self.start + size
        self.item = np.repeat(np.arange(len(size)), size)
        self.offset = np.arange(size.sum()) - self.start[self.item]
        left = size[self.item] - self.offset
        self.length = np.minimum(left, window)
        #: suffixes that are a window: whole ones, and items shorter than one
        self.whole = (left >= window) | (self.offset == 0)
        key = self.flat[np.arange(size.sum())[:, None] + np.arange(window)]
        self.key = np.where(np.arange(window) < self.length[:, None], key, 0)  # 0: past the end of the item
        pairs = self.key[self.length > 1, :2].astype(np.int64)
        self.pairs = np.unique(pairs[:, 0] << 32 | pairs[:, 1]) if window > 1 else np.zeros(0, np.int64)
        self.singles = np.unique(self.key[(self.length == 1) & self.whole, 0])
        self.order = np.lexsort((self.offset, self.item, *self.key.T[::-1]))
        self.sorted = _packed(self.key[self.order])

    def coded(self, text: str | None) -> np.ndarray:
        """The words of a text as numbers of the vocabulary, 0 for others; long texts are split in pieces at spaces."""
        if not text:
            return np.zeros(0, np.int32)
        get, out, at = self.vocab.get, [], 0
        data = text.encode("utf-8", "surrogatepass").translate(_TO_WORDS)
        while at < len(data):
            stop = len(data) if len(data) - at <= _PIECE else data.find(b" ", at + _PIECE)
            stop = len(data) if stop < 0 else stop
            part = data[at:stop].split()
            out.append(np.fromiter((get(w, 0) for w in part), np.int32, len(part)))
            at = stop
        return np.concatenate(out)


def _packed(rows: np.ndarray) -> np.ndarray:
    """Rows of word numbers as byte strings that sort as the rows do."""
    return np.ascontiguousarray(rows.astype(">i4")).view(f"S{4 * rows.shape[1]}").ravel() if len(rows) else np.zeros(0, "S4")


def _ranges(items: Items, suffixes: np.ndarray, n: int, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the suffixes of the array that share the first n words of the item suffixes ``which`` begin and end."""
    low = items.key[which].copy()
    low[:, n:] = 0
    high = low.copy()
    high[:, n:] = np.iinfo(np.int32).max
    return np.searchsorted(suffixes, _packed(low), "left"), np.searchsorted(suffixes, _packed(high), "right")


def _longer(items: Items, flat: np.ndarray, spot: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Lengths of matches of at least a window, followed word by word; ``row``: the item suffix that matches at ``spot``."""
    reach = items.length[row].copy()
    grow = np.flatnonzero(reach == items.window)
    while len(grow):
        at = items.start[items.item[row[grow]]] + items.offset[row[grow]] + reach[grow]
        inside = at < items.end[items.item[row[grow]]]
        grow, at = grow[inside], at[inside]
        grow = grow[flat[np.minimum(spot[grow] + reach[grow], len(flat) - 1)] == items.flat[at]]
        reach[grow] += 1
    return reach


def search_shard(items: Items, docs: list[np.ndarray]) -> list[dict]:
    """For each document of a shard (word numbers): spans of hit words, items found, longest match (words, place, item, place in item)."""
    sizes = np.array([len(d) for d in docs], np.int64)
    starts = np.concatenate(([0], np.cumsum(sizes + 1)))  # one separator after each document
    flat = np.zeros(int(starts[-1]) + items.window, np.int32)
    for s, d in zip(starts, docs, strict=False):
        flat[s : s + len(d)] = d
    out = [{"n_words": int(n), "spans": [], "items": (), "longest": 0, "at": None, "item": None, "item_at": None} for n in sizes]
    if not len(items.key):
        return out
    known = np.flatnonzero(flat[: -items.window])
    pair = flat[known].astype(np.int64) << 32 | flat[known + 1]
    may = np.zeros(len(known), bool)
    if len(items.pairs):
        at = np.minimum(np.searchsorted(items.pairs, pair), len(items.pairs) - 1)
        may = items.pairs[at] == pair
    if len(items.singles):
        may |= np.isin(flat[known], items.singles)
    place = known[may]
    key = flat[place[:, None] + np.arange(items.window)]
    # a zero (unknown word or end of text) ends what can match: all after it is zero as well
    key = np.where(np.cumsum(key == 0, axis=1) > 0, 0, key)
    suffixes = _packed(key)
    array = np.argsort(suffixes, kind="stable")  # the suffix array, to the depth of a window
    suffixes, place = suffixes[array], place[array]

    # every suffix of every item at every length: how long a match begins at each suffix of the shard
    depth = np.zeros(len(place), np.int64)
    for n in range(2, items.window + 1) if len(place) else ():
        low, high = _ranges(items, suffixes, n, np.flatnonzero(items.length >= n))
        change = np.zeros(len(place) + 1, np.int64)
        np.add.at(change, low, 1)
        np.add.at(change, high, -1)
        depth[np.cumsum(change[:-1]) > 0] = n
    # the windows that occur
    which = np.flatnonzero(items.whole)
    rows = spot = np.zeros(0, np.int64)
    if len(place):
        low, high = np.zeros(len(which), np.int64), np.zeros(len(which), np.int64)
        for n in np.unique(items.length[which]):
            some = items.length[which] == n
            low[some], high[some] = _ranges(items, suffixes, int(n), which[some])
        count = high - low
        rows = np.repeat(which, count)
        spot = place[np.repeat(low - (np.cumsum(count) - count), count) + np.arange(count.sum())]
    doc = np.searchsorted(starts, spot, "right") - 1
    if len(spot):
        change = np.zeros(len(flat) + 1, np.int64)
        np.add.at(change, spot, 1)
        np.add.at(change, spot + items.length[rows], -1)
        found = np.unique(np.stack([doc, items.item[rows]]), axis=1)
        cut = np.searchsorted(found[0], np.arange(len(docs) + 1))
        for d in np.unique(doc):
            out[d]["spans"] = _spans(change, int(starts[d]), int(sizes[d]))
            out[d]["items"] = tuple(dict.fromkeys(items.ids[i] for i in found[1, cut[d] : cut[d + 1]]))

    # longest matches: windows followed to their ends, shorter ones by their depth, then single words
    reach = _longer(items, flat, spot, rows)
    full = reach >= items.window
    short = np.flatnonzero((depth > 1) & (depth < items.window))
    first = known[np.concatenate(([True], np.diff(np.searchsorted(starts, known, "right")) > 0))] if len(known) else known
    at = np.concatenate([spot[full], place[short], first])
    size = np.concatenate([reach[full], depth[short], np.ones(len(first), np.int64)])
    row = np.concatenate([rows[full], np.full(len(short) + len(first), -1)])
    doc = np.searchsorted(starts, at, "right") - 1
    suffix_at = np.where(row >= 0, items.offset[row], 0)
    order = np.lexsort((suffix_at, np.where(row >= 0, items.item[row], 0), at, -size, doc))
    order = order[np.concatenate(([True], doc[order][1:] != doc[order][:-1]))] if len(order) else order
    for j in order:
        d, n, r = int(doc[j]), int(size[j]), int(row[j])
        if r < 0:  # the first item suffix that shares these words
            want = np.zeros((2, items.window), np.int32)
            want[:, :n] = flat[at[j] : at[j] + n]
            want[1, n:] = np.iinfo(np.int32).max
            low, high = np.searchsorted(items.sorted, _packed(want[:1]), "left")[0], np.searchsorted(items.sorted, _packed(want[1:]), "right")[0]
            r = int(items.order[low:high].min())
        out[d] |= {"longest": n, "at": int(at[j] - starts[d]), "item": items.ids[items.item[r]], "item_at": int(items.offset[r])}
    return out


def _spans(change: np.ndarray, start: int, size: int) -> list[int]:
    """Starts and ends, in turn, of a document's runs of hit words."""
    on = np.cumsum(change[start : start + size]) > 0
    return np.flatnonzero(np.diff(np.concatenate(([0], on.astype(np.int8), [0])))).tolist()


def _merged(spans: list[int], more: list[int]) -> list[int]:
    out: list[int] = []
    for a, b in sorted([*zip(spans[::2], spans[1::2], strict=True), *zip(more[::2], more[1::2], strict=True)]):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], int(b))
        else:
            out += [int(a), int(b)]
    return out


def _rank(best: tuple) -> tuple:
    """Longest first, then the place in the document, then the item."""
    n, at, item, item_at = best
    return -n, at or 0, item is None, item or "", item_at or 0


FIELDS = ("n_words", "spans", "items", "longest", "longest_at", "longest_item", "longest_item_at")
FOUND = "n_words long, spans array<long>, items array<string>, longest long, longest_at long, longest_item string, longest_item_at long"


def _look(shared, text: str, before: str | None):
    """The findings of one slice in column ``text``, put together with those of earlier slices in the struct ``before``."""

    def rows(texts: pd.Series, earlier: list[dict] | None) -> Iterator[tuple]:
        shard, size, first = [], 0, 0
        for i, t in enumerate(texts):
            shard.append(shared.value.coded(t if isinstance(t, str) else None))
            size += len(shard[-1])
            if size > SHARD_WORDS or i + 1 == len(texts):
                for k, r in enumerate(search_shard(shared.value, shard)):
                    spans, items, best = r["spans"], list(r["items"]), (r["longest"], r["at"], r["item"], r["item_at"])
                    if earlier is not None:
                        old = earlier[first + k]
                        spans = _merged(list(old["spans"]), spans)
                        items = list(dict.fromkeys([*old["items"], *items]))
                        best = min(best, (old["longest"], old["longest_at"], old["longest_item"], old["longest_item_at"]), key=_rank)
                    yield r["n_words"], spans, items, *best
                shard, size, first = [], 0, i + 1

    def found(texts: pd.Series, earlier: list[dict] | None = None) -> pd.DataFrame:
        return pd.DataFrame(list(rows(texts, earlier)), columns=FIELDS).astype({"longest_at": "Int64", "longest_item_at": "Int64"})

    @F.pandas_udf(FOUND)
    @tidy
    def first_slice(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield found(texts)

    @F.pandas_udf(FOUND)
    @tidy
    def next_slice(batches: Iterator[tuple[pd.Series, pd.DataFrame]]) -> Iterator[pd.DataFrame]:
        for texts, earlier in batches:
            yield found(texts, earlier.replace({np.nan: None}).to_dict("records"))

    return first_slice(F.col(text)) if before is None else next_slice(F.col(text), F.col(before))


def _searched(docs: DataFrame, benchmark: DataFrame, window: int, slice_chars: int, text: str, name: str) -> DataFrame:
    """``docs`` with the struct ``name`` of findings."""
    spark = docs.sparkSession
    total = benchmark.agg(F.sum(F.char_length("text"))).first()[0] or 0
    slices = max(1, -(-total // slice_chars))
    for k in range(slices):
        part = benchmark if slices == 1 else benchmark.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(slices)) == k)
        taken = [(None if r["item_id"] is None else str(r["item_id"]), r["text"]) for r in part.select("item_id", "text").collect()]
        taken.sort(key=lambda r: (r[0] is None, r[0] or "", r[1] or ""))
        shared = spark.sparkContext.broadcast(Items(taken, window))
        docs = docs.select(*[c for c in docs.columns if c != name], _look(shared, text, name if k else None).alias(name))
        if k + 1 < slices:
            docs = written(docs)
            shared.destroy()
    return docs


def search(docs: DataFrame, benchmark: DataFrame, window: int = 10, slice_chars: int = 8_000_000, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: its key, ``keep`` columns, ``n_words``, ``spans`` (starts and ends of hit word runs, in turn),
    ``items`` (ids of items found, as text) and the longest match with its places. Kept columns of these names are replaced.
    """
    own = [key, *[c for c in keep if c not in (key, *FIELDS)]]
    found = _searched(docs.select(*own, F.col(text).alias("_text")), benchmark, window, slice_chars, "_text", "_found")
    return found.select(*own, "_found.*")


def digest(found: DataFrame) -> DataFrame:
    """``found`` with ``n_hit`` (words inside the spans), ``n_items`` and ``items_sha256``, JVM-side."""
    ends = F.aggregate(
        F.transform("spans", lambda x, i: F.when(i % 2 == 1, x).otherwise(-x)), F.lit(0).cast("long"), lambda s, x: s + x
    )
    joined = F.sha2(F.array_join(F.array_sort("items"), ","), 256)
    return found.withColumn("n_hit", ends).withColumn("n_items", F.size("items").cast("long")).withColumn("items_sha256", joined)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, slice_chars: int = 8_000_000) -> DataFrame:
    """The documents in which no window of the benchmark occurs, with their own columns, whatever these are called."""
    name = next(n for n in (f"_found{i}" for i in range(len(docs.columns) + 1)) if n not in docs.columns)
    found = _searched(docs, benchmark, window, slice_chars, "text", name)
    return found.where(F.size(F.col(name)["items"]) == 0).select(*docs.columns)
