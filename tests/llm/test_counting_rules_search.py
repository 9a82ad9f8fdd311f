"""Collocations, quality rules and lexical search against plain versions, and their results on awkward rows."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from locusframe.llm import collocations, lexical, quality_rules
from locusframe.llm.decontaminate import words as terms_of

DATA = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (t or ""))


@pytest.fixture(scope="module")
def docs(spark):
    """Documents with nulls, blanks, ties, repeated rows, a text above a slice, and columns that clash."""
    base = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "lang").limit(80)
    long = " ".join(f"big{i % 700} Long text, of one" for i in range(60_000))
    odd = [(9001, None, None), (9002, "", "en"), (9003, " \n\t ", None), (9004, "one two three", "und"), (9005, "a b", None), (9005, "a b", None), (None, "a b\nno id", "en"), (9006, "Ä ä \x1f x.y z İI", "de"), (9007, long, "en"), (9008, "x" * 2_200_000 + " end end", "fr")]
    return base.unionByName(spark.createDataFrame(odd, "doc_id long, text string, lang string")).withColumn("n", F.lit(1)).withColumn("kept", F.lit("clash")).withColumn("score", F.lit(2)).cache()


@pytest.fixture(scope="module")
def local(docs):
    return [r.asDict() for r in docs.collect()]


def plain_collocations(rows, min_count=10, inside=50, top=2000):
    f = defaultdict(Counter)
    for r in rows:
        lang = r["lang"] if r["lang"] is not None else "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(r["text"])):
            w = re.findall(r"[^\x20\x09]+", piece)
            for k in (1, 2, 3):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        n = sum(v for p, v in c.items() if len(p) == 1)
        found, longer = [], Counter()
        for p, a in c.items():
            if len(p) == 3 and a >= min_count:
                for part in (p[:2], p[1:]):
                    longer[part] = max(longer[part], a)
        for p, a in c.items():
            if len(p) > 1 and a >= min_count and (p not in longer or 100 * longer[p] < inside * a):
                score, k = min((1000000 * a * a // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        for i, (s, a, p, left, right) in enumerate(sorted(found)[:top]):
            out.append((lang, i + 1, p.decode(), -a, left, right, n, -s))
    return sorted(out)


@pytest.mark.parametrize("held", [1_000_000, 300])
def test_collocations(docs, local, held, monkeypatch):
    counts = collocations.phrase_counts
    monkeypatch.setattr(collocations, "phrase_counts", lambda *a, **k: counts(*a, **k, held=held))
    got = sorted(tuple(r) for r in collocations.collocations(docs, min_count=3, top=40).collect())
    assert got == plain_collocations(local, 3, top=40) and len(got) > 100


def test_collocation_scores_past_64_bits(spark):
    big = spark.createDataFrame([(3 * 10**12, 3 * 10**12 + 1, 7 * 10**12)], "a long, l long, r long")
    assert big.select(collocations.score("l", "r").alias("s")).first()["s"] == 10**6 * (3 * 10**12) ** 2 // ((3 * 10**12 + 1) * 7 * 10**12)


def test_trie_bursts_and_spills(monkeypatch):
    monkeypatch.setattr(collocations, "BURST", 50)
    monkeypatch.setattr(collocations, "_SLICE", 400)
    rng = random.Random(5)
    text = " ".join(rng.choice("the the the of a b c d e f g h i j k l".split()) if rng.random() > 0.05 else "x." for _ in range(9000))
    for n in (1, 2, 3):
        trie, found = collocations._Counter("en", n, None), Counter()
        runs = []
        for i, _ in enumerate(trie.count(text.encode().translate(collocations._PREPARE))):
            trie.size = trie.root.size()
            if i % 7 == 6:
                runs += trie.spill(trie.size // 3)
            if i % 40 == 39:
                runs += trie.spill(-1)
                trie.clear()
        assert n == 1 or any(k.counts for k in trie.root.kids.values())
        runs += trie.spill(-1)
        assert trie.size == 0 and trie.root.size() == 0
        for run in runs:
            phrase = run.column(2).to_pylist()
            assert phrase == sorted(phrase, key=str.encode)
            found.update(dict(zip(phrase, run.column(3).to_pylist(), strict=True)))
        want = Counter()
        for piece in text.split("."):
            w = piece.split()
            want.update(" ".join(w[i : i + n]) for i in range(len(w) - n + 1))
        assert found == want


def test_filter_lets_every_phrase_pass(spark):
    phrases = spark.createDataFrame([("en", f"w{i} v{i % 7}") for i in range(3000)] + [("fr", "w")], "lang string, phrase string")
    f = collocations.filter_of(phrases)
    name = lambda w: np.array([collocations._name(w.encode())], np.uint64)
    seed = collocations._follow
    assert all(f.has(seed(seed(name("en"), name(f"w{i}")), name(f"v{i % 7}")))[0] for i in range(3000)) and f.has(seed(name("fr"), name("w")))[0]
    wrong = sum(f.has(seed(seed(name("de"), name(f"w{i}")), name(f"v{i % 7}")))[0] for i in range(3000))
    assert wrong < 300
    assert not collocations.filter_of(phrases.where("false")).has(name("x")).any()


def test_collocations_of_nothing(docs):
    assert collocations.collocations(docs.where("false")).count() == 0
    assert collocations.collocations(docs.where("text = ''")).count() == 0


def plain_counts(t):
    t = t or ""
    w = WORD.findall(t)
    seen, again = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            again += line in seen
            seen.add(line)
    c = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    hit = [False] * len(w)
    for i in range(len(w) - 4):
        if c[tuple(w[i : i + 5])] > 1:
            hit[i : i + 5] = [True] * 5
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), again, sum(hit)


def test_quality_rules(spark, docs, local):
    labels = spark.read.parquet(f"{DATA}/labels.parquet").select("doc_id", "quality")
    labels = labels.unionByName(spark.createDataFrame([(9004, 1), (9004, 0), (None, 1), (9005, 7)], "doc_id long, quality int"))
    model = quality_rules.fit(docs, labels)
    got = quality_rules.judge(docs, model).collect()
    assert len(got) == len(local)
    by_row = Counter((r["doc_id"], *(r[c] for c in quality_rules.COUNTS)) for r in got)
    assert by_row == Counter((r["doc_id"], *plain_counts(r["text"])) for r in local)
    for r in got:
        assert r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"])
        assert r["kept"] == (not r["base_failed"] and r["rule_score"] >= 0.5) and r["score"] == 2
    assert len({r["rule_score"] for r in got if r["doc_id"] == 9005}) == 1
    assert quality_rules.judge(docs.where("false"), model).count() == 0
    none = quality_rules.judge(docs, quality_rules.fit(docs, labels.where("false"))).select("rule_score").distinct().collect()
    assert [r[0] for r in none] == [0.5]


def test_windows_across_texts_and_hash_ties():
    same = "a b c d e f"
    counts, _ = quality_rules.measure([same, same, same + " " + same, None, "", "a b c d e a b c d e"])
    assert counts[:, 4].tolist() == [0, 0, 12, 0, 0, 10]
    rng = random.Random(3)
    texts = [" ".join(rng.choice("ab c".split() + ["d\n", "\x1f"]) for _ in range(rng.randrange(60))) for _ in range(300)]
    assert [tuple(r) for r in quality_rules.measure(texts)[0].tolist()] == [plain_counts(t) for t in texts]


def test_trees_score_as_walked_one_by_one_and_never_rise():
    rng = np.random.default_rng(2)
    x = rng.random((900, len(quality_rules.STATS)))
    falling = [quality_rules.STATS.index(s) for s in quality_rules.FALLING]
    y = ((x[:, falling].sum(1) < 1.5) ^ (rng.random(900) < 0.1) ^ (x[:, 0] > 0.8)).astype(float)
    model = quality_rules.grow(x, y, rounds=30)

    def walk(row):
        total = model.base
        for node in model.roots:
            while np.isfinite(model.threshold[node]):
                node = model.left[node] if row[model.feature[node]] <= model.threshold[node] else model.right[node]
            total += model.value[node]
        return 1 / (1 + math.exp(-total))

    scores = model.scores(x)
    assert np.allclose(scores[:200], [walk(r) for r in x[:200]])
    assert ((scores >= 0.5) == (y > 0)).mean() > 0.8
    for f in falling:
        for more in (0.01, 0.1, 0.5):
            z = x.copy()
            z[:, f] += more
            assert (model.scores(z) <= scores + 1e-12).all()


def test_rules_on_held_out_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").where("quality IS NOT NULL")
    model = quality_rules.fit(docs, labels.where("doc_id % 4 <> 1"))
    found = quality_rules.judge(docs, model).join(labels.where("doc_id % 4 = 1"), "doc_id").select("quality", "rule_score").collect()
    assert sum((r["rule_score"] >= 0.5) == (r["quality"] == 1) for r in found) >= 0.95 * len(found) > 0


def plain_ranks(rows, items, top=50):
    docs = [(r["doc_id"], TERM.findall(lower(r["text"]))) for r in rows]
    docs = [(i, len(t), Counter(t)) for i, t in docs if t]
    n, total = len(docs), sum(d[1] for d in docs)
    df = Counter(t for d in docs for t in d[2])
    out = []
    for item, text in items:
        query = set(TERM.findall(lower(text)))
        found = []
        for i, size, tf in docs:
            m = 50 + 50 * size * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * tf[t] // (1000 * tf[t] + 20 * m)) for t in query & tf.keys())
            if s > 0:
                found.append((-s, i is not None, i or 0, i))
        out += [(item, k + 1, i, -s) for k, (s, _, _, i) in enumerate(sorted(found, key=lambda x: x[:3])[:top])]
    return out


@pytest.mark.parametrize("slice_chars", [1_000_000, 3000])
def test_lexical_search(spark, docs, local, slice_chars):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    items += [(901, None), (902, " ... "), (903, "big1 LONG one one"), (904, "zzz no such"), (905, "a b"), (None, "end"), (903, "big1 LONG one one")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = [tuple(r) for r in lexical.rank(docs, benchmark, top=20, slice_chars=slice_chars).collect()]
    want = plain_ranks(local, dict.fromkeys(items), 20)
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(got, key=key) == sorted(want, key=key) and len(want) > 500
    assert lexical.rank(docs.where("false"), benchmark).count() == 0
    assert lexical.rank(docs, benchmark.where("false")).count() == 0


def test_ball_bounds_hold_and_prune():
    rng = np.random.default_rng(8)
    weight = rng.integers(0, 9000, 300)
    seen = lexical.Collection(500, 60_000, weight)
    vectors = []
    for i in range(500):
        near = np.unique(rng.integers(0, 40, 25) + 40 * (i % 7))
        vectors.append((near, seen.impacts(int(rng.integers(20, 400)), near, rng.integers(1, 9, len(near)))))
    vectors += [vectors[0]] * 100  # copies
    tree = lexical.BallTree(vectors, weight)
    ids = np.arange(len(vectors))
    below = {}
    for node in range(len(tree.rows) - 1, -1, -1):
        below[node] = tree.rows[node] if tree.kids[node] is None else np.concatenate([below[k] for k in tree.kids[node]])
    assert sorted(below[0]) == ids.tolist()
    for i in range(40):
        item = np.unique(rng.integers(0, 300, 30) if i % 2 else rng.integers(0, 40, 12) + 40 * (i % 7))
        full = np.array([sum(int(v) for t, v in zip(*doc, strict=True) if t in item) for doc in vectors])
        bound = tree.bounds(tree.columns(item))
        assert all(bound[node] >= full[rows].max() for node, rows in below.items())
        kept = lexical.Best(15)
        scored = tree.search(item, kept, ids)
        want = sorted((-s, d) for d, s in enumerate(full) if s > 0)[:15]
        assert list(zip((-kept.score).tolist(), kept.ids.tolist(), strict=True)) == want
        assert i % 2 or scored < len(vectors)


def test_terms_match_the_pattern():
    odd = "A_b-c9\x7fé İx y [Z] `q` {w}"
    assert [w.decode() for w in terms_of(odd)] == TERM.findall(lower(odd))
