"""Near-duplicate groups in band keys that many different texts share, and of texts with repeats."""

from collections import Counter

import numpy as np
import xxhash
from pyspark.sql import functions as F

from locusframe.llm import near_dup


def shingles(text, k=5):
    w = text.split()
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1)))


def exact(rows, similarity=0.8):
    """The smallest id of each row's component over all pairs of the similarity."""
    sets, root = {i: shingles(t) for i, t in rows}, {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in root}


def boilerplate_rows():
    """200 documents of long boilerplate (similarity 0.78 among them) and partners of 30 of them that share a bit more (0.81)."""
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(5000)]
    shared = list(rng.choice(words, 300))
    own = [list(rng.choice(words, 42)) for _ in range(200)]
    rows = [(i, " ".join(shared + t)) for i, t in enumerate(own)]
    return rows + [(1000 + j, " ".join(shared + own[20 + j][:12] + list(rng.choice(words, 30)))) for j in range(30)]


def test_wide_keys_with_unlike_centres(spark):
    rows = boilerplate_rows()
    want = exact(rows)
    assert sum(want[i] != i for i, _ in rows) == 30
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["group_id"] for r in near_dup.groups(df, block=16).collect()}
    assert all(got[i] == got[want[i]] for i in got)
    assert got == want  # texts of similarity 0.78 whose min-hashes agree more often stay apart


def test_repeated_passages(spark):
    # one set of shingles but for a few, a passage said once or 300 times
    rng = np.random.default_rng(8)
    text, passage = list(rng.choice([f"w{i}" for i in range(900)], 200)), [f"p{i}" for i in range(20)]
    rows = [(1, " ".join(text + passage)), (2, " ".join(text + passage * 300)), (3, "a b c d e f g h i"), (4, "a b c d e f g h"), (5, "a b c d e f g")]
    want = exact(rows)
    assert want == {1: 1, 2: 1, 3: 3, 4: 3, 5: 5}
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: r["group_id"] for r in near_dup.groups(df).collect()} == want


def test_bound_loses_nothing():
    rng = np.random.default_rng(2)
    for _ in range(300):
        n = int(rng.integers(1, 4)) * int(rng.choice([1, 30, 3000, 40_000]))
        base = rng.integers(0, 1 << 32, n, dtype=np.uint32) & np.uint32(rng.choice([0xFFFFFFFF, 0xFFFFFF03]))  # few cells: counts over 255
        a, b = np.unique(base[rng.random(n) < 0.95]), np.unique(base[rng.random(n) < 0.95])
        common, union = len(np.intersect1d(a, b)), len(np.union1d(a, b))
        s, t = near_dup.sketch_of(a), near_dup.sketch_of(b)
        assert near_dup.may_be_similar(s, len(a), t, len(b), 0.8) or common < 0.8 * union


def test_texts_of_a_repeated_id_are_apart(spark):
    """An id with several texts links and loses each of them by itself; a column's name may be one of the operator's."""
    words = [f"w{i}" for i in range(120)]
    a, b = " ".join(words), " ".join([*words[:118], "x", "y"])
    c, d = " ".join(f"c{i}" for i in range(90)), " ".join([*(f"c{i}" for i in range(89)), "z"])
    rows = [(5, c), (5, b), (7, a), (9, d), (3, " ".join(f"q{i}" for i in range(60))), (11, " ".join(f"q{i}" for i in range(60))), (11, "alone here"), (12, "alone here"), (None, a), (5, None), (6, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_hash", F.lit("own")).withColumn("_id", F.lit(0))
    got = Counter((r["doc_id"], r["text"]) for r in near_dup.dedupe(df).collect())
    # 7 and 9 go with two texts of 5; 11 goes with the text of 3 and stays with its other text, and 12 goes with that
    assert got == Counter([rows[0], rows[1], rows[4], rows[6], rows[8], rows[9]])
    found = {(r["doc_id"], r["group_id"]) for r in near_dup.groups(df).collect()}
    assert found == {(5, 5), (7, 5), (9, 5), (3, 3), (11, 3), (11, 11), (12, 11), (6, 5)}


def test_fingerprints_link_first(spark, monkeypatch):
    """Operator 3's fingerprints link by themselves what is within two bits of each other and similar; the rest is left to the band keys."""
    rng = np.random.default_rng(21)
    words = [f"w{i}" for i in range(4000)]
    rows, made = [], near_dup.signatures
    for i in range(40):
        t = list(rng.choice(words, 1500))
        rows += [(i, " ".join(t)), (100 + i, " ".join([*t[:-1], "end"])), (200 + i, " ".join(t + t[:50]))]
    t = list(rng.choice(words, 300))
    rows += [(300, " ".join(t)), (301, " ".join([*t[:30], "a", *t[31:200], "b", *t[201:]]))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)

    def bits(text):
        w = text.split()
        hashes = np.array(sorted({xxhash.xxh64_intdigest(" ".join(w[i : i + 5]), 42) for i in range(len(w) - 4)}), np.uint64)
        ones = (hashes[:, None] >> np.arange(64, dtype=np.uint64) & np.uint64(1)).sum(0)
        return sum(1 << b for b in range(64) if 2 * ones[b] > len(hashes))

    prints, texts = {i: bits(t) for i, t in rows}, dict(rows)
    assert {r["doc_id"]: r["fp"] & (2**64 - 1) for r in made(df, 5).collect()} == prints
    near = {(i, j) for i in prints for j in prints if i < j and bin(prints[i] ^ prints[j]).count("1") <= 2}
    assert len(near) >= 60 and (300, 301) not in near
    classes = made(df, 5).select(F.col("doc_id").alias("node"), F.col("doc_id").alias("first"), "fp")
    got = {(r["u"], r["v"]) for r in near_dup.by_fingerprint(classes).collect()}
    assert got <= near and components(got, texts) == components(near, texts)

    assert {r["doc_id"]: r["group_id"] for r in near_dup.groups(df).collect()} == exact(rows)
    lone = F.transform("bands", lambda b: F.xxhash64(b, F.col("doc_id")))  # no two texts share a band key
    monkeypatch.setattr(near_dup, "signatures", lambda docs, k: made(docs, k).withColumn("bands", lone))
    similar = {(i, j) for i, j in near if len(shingles(texts[i]) & shingles(texts[j])) >= 0.8 * len(shingles(texts[i]) | shingles(texts[j]))}
    assert {r["doc_id"]: r["group_id"] for r in near_dup.groups(df).collect()} == components(similar, texts)


def components(pairs, ids):
    root = {i: i for i in ids}
    for _ in ids:
        for i, j in pairs:
            root[i] = root[j] = min(root[i], root[j])
    return root
