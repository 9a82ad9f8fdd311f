"""Language-model scoring with a weighted backoff automaton.

The states of the automaton are the histories (runs of up to order - 1 tokens) that
occur in the training texts, and the empty one. An arc (state h, token w) carries the
smoothed probability of a seen n-gram, (c(h w) + k P(w | h')) / (c(h) + k), and leads to the
longest suffix of h w that is a state; a state's failure arc leads to the history without its
first token, h', with weight k / (c(h) + k); from the empty state every token, unknown ones
too, has an arc of (c(w) + 1) / (N + V + 1). So each state's probabilities sum to one. k is
``strength`` of the n-gram's order. A text's score is the sum of log10 weights along one
left-to-right walk that carries its state, from the state of a text's beginning through its
end token: an arc where the state has one, else failure arcs until a state has.

All texts of a block are walked in step. Long texts are walked in stretches of ``STRETCH``
tokens: a state holds order - 1 tokens at most, so a stretch that first walks the order - 1
tokens before it begins in the state that the whole walk has there.

The automaton grows with the corpus and is never in one place. Tokenised texts are
written as blocks of about ``block_words`` tokens. Every block sends the n-grams its
texts can meet, with its own training counts, to the shards of the key space; a shard
adds the counts up over all blocks and answers each block with the sums, in the order
in which it asked. With its answers a block builds the part of the automaton that its
texts can reach, and walks it. Messages are sorted keys, as differences, compressed.
Every shard sees an even share of the keys, whatever words are frequent.

Words are keyed by 64-bit hashes (XXH64), longer n-grams by hashes of so many bits that
one shares its key with another with probability 2^-17 or less at any size of the corpus (up to 2^47 tokens).

Null and empty texts are their end token alone. Repeated rows count and are scored each.
Without training texts N, V and c are 0.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusframe.llm.common import cut, cut_by, give_back, tidy

STRETCH = 128
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_SEED = 7


def tokens(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def _hash(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word, _SEED)


_END, _BEGIN = np.uint64(xxhash.xxh64_intdigest(b"end", _SEED + 1)), np.uint64(xxhash.xxh64_intdigest(b"begin", _SEED + 1))


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays as compressed byte planes."""
    planes = [(a.dtype.str, np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T).tobytes() if len(a) else b"") for a in arrays]
    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps(planes, protocol=5))


def _unpack(data: bytes) -> list[np.ndarray]:
    out = []
    for kind, raw in pickle.loads(zstandard.ZstdDecompressor().decompress(data)):  # noqa: S301  written by _pack above
        width = np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, -1).T).view(kind).ravel() if raw else np.zeros(0, kind))
    return out


def _chain(history: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Keys of n-grams from the keys of their histories and their last words."""
    h = (history ^ (word * _M1)) * _M2
    return h ^ (h >> np.uint64(29))


class _Block:
    """Tokens of several texts, each between a begin mark and an end token, as word keys."""

    def __init__(self, vocab: np.ndarray, stream: np.ndarray, sizes: np.ndarray) -> None:
        # vocab[0] is the begin mark, vocab[1] the end token; stream holds both for each text
        self.word, self.sizes = vocab[stream], sizes  # sizes: tokens of each text, its end counted
        self.first = np.concatenate(([0], np.cumsum(sizes + 1)[:-1])).astype(np.int64)
        self.is_begin = np.zeros(len(stream), bool)
        self.is_begin[self.first] = True

    def grams(self, order: int, bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For n = 1, 2, ...: keys at every position of the n-grams that end there, and where there is one after the begin."""
        out = [(self.word, ~self.is_begin)]
        depth = np.arange(len(self.word)) - np.repeat(self.first, self.sizes + 1)
        for n in range(1, order):
            longer = np.zeros_like(self.word)
            longer[n:] = self.word[:-n]
            for j in range(n - 1, -1, -1):
                longer[n:] = _chain(longer[n:], self.word[n - j : len(self.word) - j])
            out.append((longer >> np.uint64(64 - bits), depth >= n))
        return out


class Automaton:
    """The part of the automaton that a block's texts can reach.

    ``index``: for n = 1, 2, ... the number of the n-gram that ends at each position (-1: none); ``counts``: training
    counts of these n-grams; ``begin``: whether a position is a begin mark, of which there are ``n_begin`` in training.
    """

    def __init__(self, index: list[np.ndarray], counts: list[np.ndarray], begin: np.ndarray, n_begin: int, n_train: int, n_words: int, strength: list[float]) -> None:
        order = len(index)
        words = len(counts[0])
        self.words = words + 1  # the last one is the begin mark
        self.token = np.where(begin, words, index[0])
        where = []
        for i, c in zip(index, counts, strict=True):  # a position of each n-gram
            at = np.zeros(len(c), np.int64)
            live = np.flatnonzero(i >= 0)
            at[i[live]] = live
            where.append(at)
        # states: the empty one, words and the begin mark, longer histories; those with a training count
        state, self.fail, self.back = [], [np.zeros(1, np.int64)], [np.zeros(1)]
        total = 1
        for n in range(1, order):
            c = np.append(counts[0], n_begin) if n == 1 else counts[n - 1]
            seen = np.flatnonzero(c > 0)
            ids = np.zeros(len(c), np.int64)
            ids[seen] = total + np.arange(len(seen))
            k = strength[n - 1]
            self.fail.append(np.zeros(len(seen), np.int64) if n == 1 else state[-1][self._at(index, n - 2, where[n - 1][seen])])
            self.back.append(np.log10(k / (c[seen] + k)))
            state.append(ids)
            total += len(seen)
        self.fail, self.back = np.concatenate(self.fail), np.concatenate(self.back)
        # arcs: from the empty state one for each word, from others those of seen n-grams
        self.base = np.log10((counts[0] + 1) / (n_train + n_words + 1))
        self.first_to = state[0][:words] if order > 1 else np.zeros(words, np.int64)
        prob, keys, logs, to = 10**self.base, [], [], []
        for n in range(2, order + 1):
            seen = np.flatnonzero(counts[n - 1] > 0)
            end = where[n - 1][seen]
            history = self._at(index, n - 2, end - 1)
            of_history = (np.append(counts[0], n_begin) if n == 2 else counts[n - 2])[history]
            k = strength[n - 2]
            p = np.zeros(len(counts[n - 1]))
            p[seen] = (counts[n - 1][seen] + k * prob[index[n - 2][end]]) / (of_history + k)
            keys.append(state[n - 2][history] * self.words + self.token[end])
            logs.append(np.log10(p[seen]))
            to.append(state[n - 1][seen] if n < order else state[n - 2][index[n - 2][end]])
            prob = p
        keys, logs, to = (np.concatenate(x) if x else np.zeros(0, t) for x, t in ((keys, np.int64), (logs, float), (to, np.int64)))
        by = np.argsort(keys)
        self.arcs, self.weight, self.to = keys[by], logs[by], to[by]
        self.start = int(state[0][words]) if order > 1 else 0
        self.order = order

    def _at(self, index: list[np.ndarray], n: int, positions: np.ndarray) -> np.ndarray:
        """Numbers of the (n + 1)-grams that end at ``positions``; a begin mark counts as a word."""
        return self.token[positions] if n == 0 else index[n][positions]

    def step(self, state: np.ndarray, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """States after one token each, and the log10 weights of the arcs taken."""
        state, log = state.copy(), np.zeros(len(state))
        left = np.flatnonzero(state)
        root = state == 0
        while len(left):
            key = state[left] * self.words + token[left]
            at = np.minimum(np.searchsorted(self.arcs, key), len(self.arcs) - 1)
            hit = self.arcs[at] == key if len(self.arcs) else np.zeros(len(left), bool)
            there = left[hit]
            state[there] = self.to[at[hit]]
            log[there] += self.weight[at[hit]]
            left = left[~hit]
            log[left] += self.back[state[left]]
            state[left] = self.fail[state[left]]
            down = state[left] == 0
            root[left[down]] = True
            left = left[~down]
        log[root] += self.base[token[root]]
        state[root] = self.first_to[token[root]]
        return state, log

    def walk(self, first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Log10 weights of texts: their begin marks stand at ``first``, their ``sizes`` tokens follow."""
        pieces = -(-sizes // STRETCH)
        text = np.repeat(np.arange(len(sizes)), pieces)
        offset = (np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * STRETCH
        length = np.minimum(sizes[text] - offset, STRETCH)
        by = np.argsort(-length, kind="stable")
        text, offset, length = text[by], offset[by], length[by]
        at = first[text] + 1 + offset
        state = np.full(len(text), self.start)
        later = np.flatnonzero(offset)
        state[later] = 0
        for j in range(self.order - 1, 0, -1):
            state[later] = self.step(state[later], self.token[at[later] - j])[0]
        total = np.zeros(len(text))
        for t in range(int(length.max(initial=0))):
            n = int(np.searchsorted(-length, -t, "left"))  # those longer than t
            state[:n], log = self.step(state[:n], self.token[at[:n] + t])
            total[:n] += log
        return np.bincount(text, weights=total, minlength=len(sizes))


def _blocks(docs: DataFrame, block_words: int) -> DataFrame:
    @tidy
    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        serial = TaskContext.get().partitionId() << 32

        def close() -> pd.DataFrame:
            nonlocal serial
            vocab = np.array([_BEGIN, _END] + [_hash(w) for w in index if isinstance(w, bytes)], np.uint64)
            row = (serial, len(ids) - sum(held), sum(sizes), sum(n for n, t in zip(sizes, held, strict=True) if not t),
                   pickle.dumps((ids, np.array(held, bool)), protocol=5),
                   _pack(vocab, np.concatenate(stream).astype(np.uint32), np.array(sizes, np.int64)))
            serial += 1
            return pd.DataFrame([row], columns=["block", "train_docs", "tokens", "train_tokens", "ids", "data"])

        def fresh() -> tuple:
            return {0: 0, 1: 1}, [], [], [], []

        index, ids, held, sizes, stream = fresh()
        size = 0
        for batch in batches:
            for doc, out, text in zip(batch["doc_id"], batch["held_out"], batch["text"], strict=True):
                words = tokens(text if isinstance(text, str) else None)
                for w in words:
                    if w not in index:
                        index[w] = len(index)
                row = np.empty(len(words) + 2, np.int64)
                row[0], row[-1] = 0, 1
                row[1:-1] = np.fromiter(map(index.__getitem__, words), np.int64, len(words))
                ids.append(None if pd.isna(doc) else int(doc))
                held.append(bool(out))
                sizes.append(len(words) + 1)
                stream.append(row)
                size += len(row)
                if size >= block_words:
                    yield close()
                    index, ids, held, sizes, stream = fresh()
                    size = 0
        if ids:
            yield close()

    return docs.select("doc_id", "held_out", "text").mapInPandas(build, "block long, train_docs long, tokens long, train_tokens long, ids binary, data binary")


def _asked(block: _Block, held: np.ndarray, order: int, bits: int) -> tuple[list[np.ndarray], list[np.ndarray], list[np.ndarray]]:
    """Sorted different keys of each order, their counts in the block's training texts, and the key's number at each position (-1: none)."""
    train = np.repeat(~held, block.sizes + 1)
    keys, counts, index = [], [], []
    for g, live in block.grams(order, bits):
        u, inv = np.unique(g[live], return_inverse=True)
        keys.append(u)
        counts.append(np.bincount(inv, weights=train[live], minlength=len(u)).astype(np.int64))
        at = np.full(len(g), -1, np.int32)
        at[live] = inv
        index.append(at)
    return keys, counts, index


def _ask(blocks: DataFrame, shards: int, order: int, bits: int) -> DataFrame:
    """Messages of blocks to shards: ``block, shard, data``."""
    edges = np.array([(i << 64) // shards for i in range(1, shards)], dtype=np.uint64)

    @tidy
    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for number, ids, data in zip(batch["block"], batch["ids"], batch["data"], strict=True):
                block, held = _Block(*_unpack(data)), pickle.loads(ids)[1]  # noqa: S301  written by _blocks
                keys, counts, _ = _asked(block, held, order, bits)
                cuts = [np.concatenate(([0], np.searchsorted(k, edges >> np.uint64(64 - bits) if n else edges), [len(k)])) for n, k in enumerate(keys)]
                rows = []
                for s in range(shards):
                    parts = []
                    for k, n, c in zip(keys, counts, cuts, strict=True):
                        here = slice(c[s], c[s + 1])
                        parts += [np.diff(k[here], prepend=np.uint64(0)), n[here].astype(np.uint32)]
                    rows.append((number, s, _pack(*parts)))
                yield pd.DataFrame(rows, columns=["block", "shard", "data"])

    return blocks.select("block", "ids", "data").mapInPandas(ask, "block long, shard int, data binary")


def _answer(messages: DataFrame, order: int) -> DataFrame:
    """Answers of shards to blocks, ``block, shard, data``, and the number of words with a training count (``known``, on one row of a shard)."""

    def answer(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        parts = [_unpack(d) for d in group["data"]]
        out = [[] for _ in parts]
        known = 0
        for n in range(order):
            keys = np.concatenate([np.cumsum(p[2 * n], dtype=np.uint64) for p in parts])
            counts = np.concatenate([p[2 * n + 1] for p in parts]).astype(np.float64)
            u, inv = np.unique(keys, return_inverse=True)
            total = np.bincount(inv, weights=counts, minlength=len(u)).astype(np.uint64)
            if n == 0:
                known = int((total > 0).sum())
            ends = np.cumsum([len(p[2 * n]) for p in parts])
            for o, got in zip(out, np.split(total[inv], ends[:-1]), strict=True):
                o.append(got)
        give_back()
        return pd.DataFrame({"block": group["block"], "shard": group["shard"], "known": [known] + [0] * (len(parts) - 1), "data": [_pack(*o) for o in out]})

    return messages.groupBy("shard").applyInPandas(answer, "block long, shard int, known long, data binary")


def score(docs: DataFrame, order: int = 3, strength: tuple[float, ...] = (500.0, 10.0), block_words: int = 900_000, shard_words: int = 1_600_000) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every row.

    ``docs`` has ``doc_id, text`` and ``held_out`` (its rows are scored, not learned from); its other columns are not read.
    ``strength`` has k for n-grams of 2, 3, ... tokens, the last one for all longer; ``order`` is the longest n-gram.
    """
    blocks = cut_by(_blocks(docs, block_words), "block")
    sums = blocks.agg(F.sum("train_tokens"), F.sum("tokens"), F.sum("train_docs")).first()
    n_train, n_all, n_begin = (int(x or 0) for x in sums)
    bits = min(64, 17 + n_all.bit_length())
    power = [strength[min(n, len(strength) - 1)] for n in range(order - 1)]
    shards = max(1, -(-n_train // shard_words))
    answers = cut(_answer(_ask(blocks, shards, order, bits), order))
    n_words = int(answers.agg(F.sum("known")).first()[0] or 0)

    def traverse(own: pd.DataFrame, group: pd.DataFrame) -> pd.DataFrame:
        own = own.iloc[0]
        ids, held = pickle.loads(own["ids"])  # noqa: S301  written by _blocks
        block = _Block(*_unpack(own["data"]))
        _, _, index = _asked(block, held, order, bits)
        got = [_unpack(d) for d in group.sort_values("shard")["data"]]
        counts = [np.concatenate([g[n] for g in got]).astype(np.float64) for n in range(order)]
        machine = Automaton(index, counts, block.is_begin, n_begin, n_train, n_words, power)
        text, word = np.repeat(np.arange(len(ids)), block.sizes + 1)[~block.is_begin], index[0][~block.is_begin]
        add = lambda v: np.bincount(text, weights=v[word], minlength=len(ids))
        out = pd.DataFrame(
            {
                "doc_id": pd.array(ids, dtype="Int64"), "held_out": held, "n_tokens": block.sizes, "n_known": add((counts[0] > 0).astype(float)).astype(np.int64),
                "train_tokens": n_train, "base_score": add(machine.base), "score": machine.walk(block.first, block.sizes),
            }
        )
        del machine, index, counts, got, text, word
        give_back()
        return out

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    # the blocks lie in buckets, so only the answers move
    return blocks.select("block", "ids", "data").groupBy("block").cogroup(answers.select("block", "shard", "data").groupBy("block")).applyInPandas(traverse, schema)
