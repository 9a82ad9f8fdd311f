"""Each operator against a plain version, and its defined results on nulls, empty texts, ties, repeats, empty tables and extra columns."""

import hashlib
import html as html_module
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from locusframe.llm import ann, common, decontaminate, html_extract, lang_id, lm_score, mixing, near_dup, quality, simhash, toxicity, warc

DATA = "/root/testdata/sf0.001"
SPACE_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (t or ""))


@pytest.fixture(scope="module")
def docs(spark):
    """The small documents table with awkward rows and a clashing column."""
    base = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").limit(60)
    odd = spark.createDataFrame(
        [(9001, None, None, None, 0), (9002, "", "en", None, 0), (9003, " \n\t ", None, "src0", 4), (9004, "word", "en", "src0", 4), (9005, "a b", None, "srcX", 3), (9006, "a b", None, "srcX", 3), (9007, "$$$ 123", "fr", "srcX", 7), (9008, "same words here " * 4000, "en", "src1", 1)],
        "doc_id long, text string, lang string, source string, n_chars long",
    )
    return base.unionByName(odd).withColumn("score", F.lit("clash")).withColumn("size", F.lit(-1)).cache()


@pytest.fixture(scope="module")
def local(docs):
    return {r["doc_id"]: r.asDict() for r in docs.collect()}


def empty(docs):
    return docs.where("false")


def test_lang_id(spark, docs):
    model = lang_id.fit(docs, per_lang=50)
    got = {r["doc_id"]: r for r in lang_id.identify(docs, model).collect()}
    assert "score" in docs.columns and got[9004]["score"] == "clash"
    for i in (9001, 9002, 9003, 9007):
        assert got[i]["lang_pred"] == "und" and got[i]["lang_score"] == 0 and got[i]["lang_rejected"]
    known = [r for r in got.values() if r["lang"] and r["doc_id"] < 9000]
    assert sum(r["lang"] == r["lang_pred"] for r in known) >= 0.95 * len(known)
    assert all(0 <= r["lang_score"] <= 1 for r in got.values())
    assert lang_id.identify(empty(docs), model).count() == 0
    none = lang_id.fit(docs.where("lang IS NULL"))
    assert {r["lang_pred"] for r in lang_id.identify(docs, none).collect()} == {"und"}


def test_sainte_lague_and_targets():
    votes, seats = [53.0, 24.0, 23.0, 0.0], 20
    plain = [0] * 4
    for _ in range(seats):
        i = max(range(4), key=lambda k: (votes[k] / (2 * plain[k] + 1), -k))
        plain[i] += 1
    assert mixing.sainte_lague(votes, seats) == plain
    assert mixing.sainte_lague([1.0, 1.0], 5, [1, 10]) == [1, 4] and mixing.sainte_lague([], 3) == []
    rng = np.random.default_rng(4)
    for votes in ([100.0] + [0.6] * 200, list(rng.exponential(1, 30)), [1e12, 3.0, 3.0, 1.0]):
        for seats in (1, 7, 220, 5003):
            plain = [0] * len(votes)
            for _ in range(seats):
                i = max(range(len(votes)), key=lambda k: (votes[k] / (2 * plain[k] + 1), -k))
                plain[i] += 1
            assert mixing.sainte_lague(votes, seats) == plain
    assert mixing.targets([10, 100, 100], [3, 1, 2], 1.5, 2) == pytest.approx([20, (315 - 20) / 3, 2 * (315 - 20) / 3])
    assert mixing.targets([0, 0], [3, 1], 1.5, 2) == [0, 0]


def test_mixing(spark, docs, local):
    rows = mixing.mix(docs, block=8).collect()
    size = {i: len(SPACE_WORD.findall(r["text"] or "")) for i, r in local.items()}
    assert {r["doc_id"]: r["size"] for r in rows} == size
    by = {}
    for r in rows:
        assert 0 <= r["taken"] <= 2 * r["size"]
        s = by.setdefault(r["source"], [r["target"], r["source_size"], 0])
        s[2] += r["taken"]
    for s, (target, total, taken) in by.items():
        assert total == sum(size[i] for i, r in local.items() if r["source"] == s)
        assert abs(taken - target) <= 24
    names = sorted(by, key=lambda s: (s is None, s or ""))
    want = mixing.targets([by[s][1] for s in names], [(3, 1, 2)[i % 3] for i in range(len(names))], 1.5, 2)
    assert [by[s][0] for s in names] == pytest.approx(want)
    assert sorted(mixing.mix(docs, block=8).collect()) == sorted(rows)
    assert mixing.mix(empty(docs)).count() == 0


def test_mixing_takes_what_the_plain_version_takes(spark, docs, local):
    """Every word of every shard laid out one by one, blocks chosen by the permutation."""
    block, seed = 8, 17
    large = docs.where("source IN ('src0', 'src1', 'src2')")
    rows = {r["doc_id"]: r for r in mixing.mix(large, block=block, shard_docs=2, seed=seed).collect()}
    assert min(r["target"] for r in rows.values()) >= 16 * block
    order = dict(docs.select("doc_id", F.xxhash64(F.lit(seed), "doc_id")).collect())
    by = {}
    for r in rows.values():
        by.setdefault((r["source"], r["shard"]), []).append(r["doc_id"])
    assert len(by) > len({s for s, _ in by})
    for (source, shard), ids in by.items():
        line = [i for i in sorted(ids, key=lambda i: (order[i], i)) for _ in range(rows[i]["size"])]
        cuts = [line[a : a + block] for a in range(0, len(line), block)]
        quota = rows[ids[0]]["quota"]
        step, shift = mixing.permutation(len(cuts), source, shard, seed + 2)
        places = [(i * step + shift) % len(cuts) for i in range(len(cuts))]
        assert sorted(places) == list(range(len(cuts)))
        taken = Counter()
        for place, words in zip(places, cuts, strict=True):
            for i in words:
                taken[i] += quota // len(cuts) + (place < quota % len(cuts))
        assert {i: rows[i]["taken"] for i in ids} == {i: taken[i] for i in ids}


def test_mixing_small_sources(spark):
    """One large and many small sources: each comes near its target."""
    rows = [(i, "w " * 20, f"s{i:03}") for i in range(199)] + [(1000, "w " * 6400, "t")]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert all(abs(r["taken"] - r["target"]) <= 2 for r in got if r["size"] == 20)
    assert abs(sum(r["taken"] for r in got) - sum(r["target"] for r in got)) <= 16


def plain_fp(text, k):
    w = SPACE_WORD.findall(lower(text))
    if not w:
        return 0
    sh = [" ".join(w)] if len(w) < k else [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)]
    ones = [0] * 64
    for s in sh:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(sh))


def union(ids, links):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_simhash_fingerprints(spark, docs, local):
    got = {r["doc_id"]: r["fp"] & (2**64 - 1) for r in simhash.fingerprints(docs).collect()}
    assert got == {i: plain_fp(r["text"], 3) for i, r in local.items()}
    found = {r["doc_id"]: r["component_id"] for r in simhash.components(simhash.fingerprints(docs)).collect()}
    assert found[9001] == found[9002] == found[9003] and found[9005] == found[9006] == 9005
    assert simhash.components(simhash.fingerprints(empty(docs))).count() == 0


def test_simhash_links_are_whole(spark):
    rng = np.random.default_rng(1)
    base = [int(x) for x in rng.integers(0, 1 << 63, 40, dtype=np.int64)]
    fps = list(base)
    for b in base[:20]:
        for _ in range(4):
            fps.append(b ^ (1 << int(rng.integers(64))) ^ (1 << int(rng.integers(64))) if rng.random() < 0.7 else b ^ (1 << int(rng.integers(64))))
    hub = base[0]
    fps += [hub ^ (1 << i) for i in range(64)] + [hub, hub]  # one wide family
    ids = list(range(len(fps)))
    mask = 2**64 - 1
    want = union(ids, [(i, j) for i in ids for j in ids[:i] if bin((fps[i] ^ fps[j]) & mask).count("1") <= 2])
    rows = [(i, ((f & mask) ^ (1 << 63)) - (1 << 63)) for i, f in enumerate(fps)]
    prints = spark.createDataFrame(rows, "doc_id long, fp long")
    assert {r["doc_id"]: r["component_id"] for r in simhash.components(prints).collect()} == want
    distinct = prints.select("fp").distinct()
    narrow = {(r["u"], r["v"]) for r in simhash.near_pairs(distinct, wide=10_000).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).collect()}
    vals = sorted({r[1] for r in rows})
    assert narrow == {(a, b) for a in vals for b in vals if a < b and bin((a ^ b) & mask).count("1") <= 2}


def test_components(spark):
    edges = [(5, 4), (4, 3), (3, 9), (7, 7), (20, 21), (22, 21), (22, 22)] + [(100 + i, 101 + i) for i in range(30)]
    got = {r["node"]: r["component"] for r in common.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    want = union({x for e in edges for x in e}, edges)
    assert got == {n: c for n, c in want.items() if n != 7}
    assert common.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_near_duplicates(spark, docs, local):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(500)]
    texts = [" ".join(rng.choice(words, 120)) for _ in range(12)]
    rows = []
    for i, t in enumerate(texts):
        rows.append((i * 100, t))
        for j, edits in enumerate((0, 1, 2, 30)):
            w = t.split()
            for p in rng.choice(len(w), edits, replace=False):
                w[p] = "edited"
            rows.append((i * 100 + j + 1, " ".join(w)))
    rows += [(5000 + j, texts[0] + " tail" * (j % 3)) for j in range(80)] + [(7000, None), (7001, ""), (7002, " ")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("node", F.lit(1))

    def shingles(t):
        w = SPACE_WORD.findall(lower(t))
        return frozenset([tuple(w)] if w and len(w) < 5 else (tuple(w[i : i + 5]) for i in range(len(w) - 4)))

    sets = {i: shingles(t) for i, t in rows}
    links = [(a, b) for a in sets for b in sets if a < b and (sets[a] == sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))]
    want = union(sets, links)
    assert {r["doc_id"]: r["group_id"] for r in near_dup.groups(df).collect()} == want
    kept = near_dup.dedupe(df)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == set(want.values())
    assert near_dup.dedupe(df.where("false")).count() == 0


def test_quality(spark, docs, local):
    labels = spark.createDataFrame([(i, int(i % 3 != 0)) for i in local], "doc_id long, quality int")
    shouted = docs.select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.upper("text")).otherwise(F.col("text")).alias("text"))
    stats = quality.sample(shouted, labels.unionByName(spark.createDataFrame([(1, 7), (None, 1)], labels.schema))).cache()
    assert stats.count() == len(local)
    model = quality.fit(stats)
    got = {r["doc_id"]: r["quality_score"] for r in quality.score(shouted, model).collect()}
    assert all(0 <= s <= 1 for s in got.values()) and len(got) == len(local)
    normal = [i for i in local if i < 9000]
    assert np.mean([(got[i] >= 0.7) == (i % 3 != 0) for i in normal]) > 0.9
    assert got[9001] == got[9002] and quality.score(docs.withColumn("quality_score", F.lit("clash")).withColumn("stats", F.lit(1)), model).where("stats = 1").count() == len(local)
    assert quality.fit(quality.sample(docs, labels.where("false"))).scores(np.zeros((2, len(quality.STATS)))).tolist() == [0.5, 0.5]
    assert quality.isotonic(np.array([2, 0, 2, 2]), np.array([1, 0, 0, 2])).tolist() == sorted(quality.isotonic(np.array([2, 0, 2, 2]), np.array([1, 0, 0, 2])).tolist())
    # the plain version: all features at once, ridge on all rows, isotonic levels of scores by weights without the row's fold
    rows = stats.select("doc_id", "stats", "quality", F.pmod(F.xxhash64(F.lit(12), "doc_id"), F.lit(4)).alias("fold")).collect()
    x, y, fold = np.array([r["stats"] for r in rows]), np.array([r["quality"] for r in rows], float), np.array([r["fold"] for r in rows])
    z = np.clip((x - x.mean(0)) / np.maximum(1e-6, x.std(0)), -8, 8)
    f = np.hstack([np.cos(z @ model.omega + model.phase) * np.sqrt(2 / 192), np.ones((len(z), 1))])

    def plain(k):
        shrink = 1e-5 * len(k) * np.eye(193)
        shrink[-1, -1] = 1e-9
        return np.linalg.solve(f[k].T @ f[k] + shrink, f[k].T @ y[k])

    assert np.allclose(f @ plain(np.arange(len(y))), model.ridge(x), atol=1e-6)
    held = np.concatenate([(f[fold == k] @ plain(np.flatnonzero(fold != k))) for k in range(4)])
    at = np.clip(np.rint((held + 0.5) / (2 / 511)), 0, 511).astype(int)
    label = np.concatenate([y[fold == k] for k in range(4)])
    assert np.allclose(model.levels, quality.isotonic(np.bincount(at, minlength=512), np.bincount(at, weights=label, minlength=512)), atol=1e-3)
    # the features stand for a Gaussian kernel
    near = np.abs((f[:, :-1] @ f[:, :-1].T) - np.exp(-((z[:, None] - z[None]) ** 2).sum(2) / (2 * 10.0**2)))
    assert near.mean() < 0.06


def test_toxicity_network_gradients():
    rng = np.random.default_rng(0)
    net = toxicity.Net(5, 64, 3, 4, 3, 2, 1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x = rng.normal(size=(6, 7))
    ids, mask = rng.integers(0, 6, (4, 5)), np.ones((4, 5), bool)
    mask[0, 3:] = False
    y = np.array([1.0, 0, 1, 0])
    grad, dx, loss = net.gradients(x, ids, mask, y)

    def at():
        z = net.forward(*net.project(x), ids, mask)
        return float(np.mean(np.logaddexp(0, z) - y * z))

    for k in ("Wf", "Ub", "A", "v", "o", "bf"):
        old, e = net.p[k].flat[1], 1e-3
        net.p[k].flat[1] = old + e
        up = at()
        net.p[k].flat[1] = old - e
        down = at()
        net.p[k].flat[1] = old
        assert grad[k].flat[1] == pytest.approx((up - down) / (2 * e), abs=2e-4)
    assert at() == pytest.approx(loss, abs=1e-5)


def test_toxicity(spark, docs, local):
    rows = [(i, (r["text"] or "") + (" you vile scoundrel " if i % 2 else "")) for i, r in local.items() if i < 9000 for _ in range(1)]
    rows += [(i + 500, t) for i, t in rows] + [(i + 1000, t) for i, t in rows]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int("scoundrel" in t)) for i, t in rows], "doc_id long, toxic int")
    model = toxicity.fit(df, labels, rounds=2)
    got = {r["doc_id"]: r["toxicity"] for r in toxicity.score(df, model).collect()}
    assert np.mean([(got[i] >= 0.5) == ("scoundrel" in t) for i, t in rows]) > 0.9
    odd = {r["doc_id"]: r["toxicity"] for r in toxicity.score(docs, model).collect()}
    assert odd[9001] == odd[9002] == odd[9003] == 0 and all(0 <= s <= 1 for s in odd.values())
    starts = toxicity.window_starts(50, 12, 6)
    covered = Counter(p for s in starts for p in range(s, s + 12))
    assert set(covered) == set(range(50)) and min(covered[p] for p in range(6, 44)) >= 2
    assert toxicity.fit(df, labels.where("false")).scores(["any text"]).tolist() == [0.0]
    # a plain loop over the windows at every word, one at a time
    def logit(words):
        rows = model._project(words)
        mask = None if len(words) == 12 else np.ones((1, len(words)), bool)
        return float(model.net.forward(*rows, np.arange(len(words))[None], mask)[0])

    for i in [*range(0, 40, 7), 9004, 9008]:
        w = toxicity.tokenize(local[i]["text"])[:3000] if i in local else []
        if not w:
            continue
        want = max(logit(w[a : a + 12]) for a in range(max(1, len(w) - 11)))
        want = 1 / (1 + math.exp(-(model.scale * want + model.shift)))
        assert model.scores([" ".join(w)])[0] == pytest.approx(want, abs=1e-4)
        assert model.scores([" ".join(w)] * 2, words_at_once=10**9).tolist() == pytest.approx([want] * 2, abs=1e-4)
    long = "some words in a row " * 200 + "you vile scoundrel " + "more of them then " * 200
    assert model.scores([long], words_at_once=100)[0] == pytest.approx(model.scores([long])[0], abs=1e-4)
    assert [len(p) for p in toxicity._pieces("a b c d e f g", 4, 2)] == [4, 4, 3]


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_lm_score(spark, docs, local, order, monkeypatch):
    """Against the recursion written out; blocks, shards and stretches are small, so that all of them are crossed."""
    k = (40.0, 6.0, 3.0)
    df = docs.select("doc_id", "text", (F.col("doc_id") % 7 == 2).alias("held_out"))
    got = {r["doc_id"]: r for r in lm_score.score(df, order, k, block_words=500, shard_words=3000).collect()}
    toks = {i: SPACE_WORD.findall(lower(r["text"])) + [None] for i, r in local.items()}
    c, h = Counter(), Counter()
    for i, w in toks.items():
        if i % 7 != 2:
            w = ["<s>", *w]
            for p in range(1, len(w)):
                for m in range(1, order + 1):
                    if p - m + 1 >= 0:
                        c[tuple(w[p - m + 1 : p + 1])] += 1
            h["<s>",] += 1
    n, v = sum(x for g, x in c.items() if len(g) == 1), sum(len(g) == 1 for g in c)

    def prob(g):
        if len(g) == 1:
            return (c[g] + 1) / (n + v + 1)
        before = c[g[:-1]] or h[g[:-1]]
        return (c[g] + k[len(g) - 2] * prob(g[1:])) / (before + k[len(g) - 2]) if before else prob(g[1:])

    for i, w in toks.items():
        base = sum(math.log10((c[x,] + 1) / (n + v + 1)) for x in w)
        full = ["<s>", *w]
        s = sum(math.log10(prob(tuple(full[max(0, p - order + 1) : p + 1]))) for p in range(1, len(full)))
        r = got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w), sum(c[x,] > 0 for x in w), n)
        assert r["base_score"] == pytest.approx(base) and r["score"] == pytest.approx(s)
    # a state's arcs and its failure arc share one unit of probability
    words = [g[0] for g in c if len(g) == 1] + ["never seen"]
    for state in [("<s>",), ("the",), ("same", "words"), ("<s>", "same")][: 4 if order > 2 else 2]:
        assert sum(prob((*state[max(0, len(state) - order + 1) :], x)) for x in words) == pytest.approx(1)
    assert lm_score.score(df.where("false")).count() == 0
    none = {r["doc_id"]: r for r in lm_score.score(df.withColumn("held_out", F.lit(True)), order).collect()}
    assert all(r["train_tokens"] == 0 and r["n_known"] == 0 and r["score"] == pytest.approx(0) for r in none.values())


def test_automaton_walk_is_the_same_in_stretches(monkeypatch):
    rng = np.random.default_rng(5)
    sizes = np.array([1, 700, 3, 129, 128])
    stream = np.concatenate([[0, *rng.integers(2, 12, n - 1), 1] for n in sizes])
    block = lm_score._Block(rng.integers(1, 1 << 62, 12).astype(np.uint64), stream, sizes)
    _, counts, index = lm_score._asked(block, np.array([False, False, True, False, False]), 3, 60)
    machine = lm_score.Automaton(index, [c.astype(float) for c in counts], block.is_begin, 4, 958, 11, [5.0, 2.0])
    short = machine.walk(block.first, block.sizes)
    monkeypatch.setattr(lm_score, "STRETCH", 10_000)
    assert np.allclose(machine.walk(block.first, block.sizes), short)


def test_decontamination(spark, docs, local):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    some = next(r["text"] for r in local.values() if r["text"] and len(word.findall(r["text"])) > 60 and r["doc_id"] < 9000)
    w = word.findall(lower(some))
    items = [(1, " ".join(w[5:30])), (2, " ".join(w[5:30]).upper()), (3, "word"), (4, None), (5, "--"), (6, "a b"), (7, " ".join(w[20:29])), (10, "same words here " * 5)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    windows = {}
    for i, t in items:
        x = word.findall(lower(t))
        for s in range(max(1, len(x) - 9)) if x else []:
            windows.setdefault(tuple(x[s : s + 10]), set()).add(str(i))
    for slice_chars in (8_000_000, 60):
        got = {r["doc_id"]: r for r in decontaminate.digest(decontaminate.search(docs, bench, slice_chars=slice_chars)).collect()}
        for i, r in local.items():
            x, hit, found = word.findall(lower(r["text"])), set(), set()
            for n in {len(k) for k in windows}:
                for p in range(len(x) - n + 1):
                    if (k := tuple(x[p : p + n])) in windows:
                        hit.update(range(p, p + n))
                        found |= windows[k]
            g = got[i]
            assert (g["n_words"], g["n_hit"], g["n_items"]) == (len(x), len(hit), len(found)), i
            assert g["items_sha256"] == hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        # the longest verbatim match of every document, whatever its length, against all starts in all items
        coded = [(str(i), word.findall(lower(t))) for i, t in items]
        for i, r in local.items():
            x = word.findall(lower(r["text"]))
            if len(x) > 1200:
                continue
            starts = {}
            for name, y in sorted(coded):
                for b, w0 in enumerate(y):
                    starts.setdefault(w0, []).append((name, y, b))
            best = (0, 0, "", 0)
            for p, w0 in enumerate(x):
                for name, y, b in starts.get(w0, ()):
                    n = 0
                    while p + n < len(x) and b + n < len(y) and x[p + n] == y[b + n]:
                        n += 1
                    best = min(best, (-n, p, name, b))
            g = got[i]
            assert (-g["longest"], g["longest_at"] or 0, g["longest_item"] or "", g["longest_item_at"] or 0) == best, (i, slice_chars)
    first = got[next(i for i, r in local.items() if r["text"] == some)]
    assert first["longest"] >= 25
    clash = docs.select("*", *[F.lit(1).alias(c) for c in ("items", "n_words", "spans", "longest", "_found", "_found0")])
    assert decontaminate.decontaminate(clash, bench, slice_chars=60).columns == clash.columns
    left = decontaminate.decontaminate(docs, bench)
    assert left.columns == docs.columns and {r["doc_id"] for r in left.collect()} == {i for i in local if got[i]["n_hit"] == 0}
    assert decontaminate.search(docs, bench.where("false")).where("size(items) > 0").count() == 0


def test_ann(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(1500, 16)).astype(np.float32)
    x[100:400] = x[50]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(5000, None), (5020, [0.0] * 16), (5040, [float("nan")] * 16), (5060, [None] + [1.0] * 15), (5080, [1.0]), (5100, [])]
    t = ann.usable(spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit(1)))
    assert t.count() == 1500
    got = {}
    for r in ann.search(t, t.where("id % 20 = 0"), k=10, list_size=64).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    y, share = x.astype(float), []
    for q in range(0, 1500, 20):
        s = (y * y[q]).sum(1)
        want = sorted((i for i in range(1500) if i != q), key=lambda i: (-s[i], i))[:10]
        mine = sorted(got[q])
        assert [r for r, _, _ in mine] == list(range(1, 11)) and all(abs(s[v] - c) < 1e-9 for _, v, c in mine)
        assert [(-c, v) for _, v, c in mine] == sorted((-c, v) for _, v, c in mine)
        share.append(len({v for _, v, _ in mine} & set(want)) / 10)
    assert np.mean(share) >= 0.9
    few = ann.usable(spark.createDataFrame([(0, [1.0, 0.0]), (20, [0.0, 1.0]), (21, [1.0, 1.0])], "vec_id long, embedding array<float>"))
    assert sorted(tuple(r) for r in ann.search(few, few.where("id % 20 = 0"), k=5).collect()) == [(0, 1, 21, 1.0), (0, 2, 20, 0.0), (20, 1, 21, 1.0), (20, 2, 0, 0.0)]
    assert ann.search(few.where("false"), few.where("false")).count() == 0


def test_warc_urls_and_revisits(spark):
    urls = ["HTTP://WWW.Ex.com:80/a/index.html?b=2&utm_source=x&a=1#f", "https://ex.com/a/?a=1&b=2", None, "https://ex.com/A", "https://ex.com"]
    got = [r[0] for r in spark.createDataFrame([(u,) for u in urls], "u string").select(warc.canonical_url(F.col("u"))).collect()]
    assert got == ["ex.com/a?a=1&b=2", "ex.com/a?a=1&b=2", None, "ex.com/A", "ex.com"]
    h = {"date": "1", "content-type": "t", "etag": '"e"'}
    rec = [
        ("r1", urls[1], 10, 200, '"e"', None, "d1", h), ("r2", urls[1], 20, 200, '"f"', None, "d2", {**h, "etag": '"f"'}), ("v0", urls[1], 5, 304, '"e"', None, None, {}),
        ("v1", urls[0], 15, 304, 'W/"e"', None, None, {"date": "2", "content-length": "0"}), ("v2", urls[0], 25, 304, '"e"', None, None, {}), ("v3", None, 25, 304, None, None, None, {}),
        ("v4", urls[0], 20, 304, None, None, None, {}), ("x", urls[0], 30, 404, None, None, None, None), ("v5", urls[3], 30, 304, None, None, None, {}),
    ]
    df = spark.createDataFrame(rec, "record_id string, url string, ts long, status int, etag string, last_modified long, digest string, headers map<string,string>").withColumn("state", F.lit("clash"))
    got = {r["record_id"]: r for r in warc.resolve_revisits(df).collect()}
    assert {k: (r["state"], r["response_id"]) for k, r in got.items()} == {
        "r1": ("response", "r1"), "r2": ("response", "r2"), "v0": ("no_response", None), "v1": ("resolved", "r1"), "v2": ("mismatch", None), "v3": ("no_url", None),
        "v4": ("unchecked", "r2"), "x": ("other", None), "v5": ("no_response", None),
    }
    assert got["v1"]["merged_headers"] == {"date": "2", "content-type": "t", "etag": '"e"'} and got["v1"]["merged_digest"] == "d1"
    bare = df.withColumn("headers", F.when(F.col("record_id") == "v1", F.lit(None).cast("map<string,string>")).otherwise(F.col("headers")))
    assert {r["record_id"]: r["merged_headers"] for r in warc.resolve_revisits(bare).collect()}["v1"] == h
    bare = df.withColumn("headers", F.when(F.col("record_id") == "r1", F.lit(None).cast("map<string,string>")).otherwise(F.col("headers")))
    assert {r["record_id"]: r["merged_headers"] for r in warc.resolve_revisits(bare).collect()}["v1"] == {"date": "2"}
    assert warc.resolve_revisits(df.where("false")).count() == 0
    hot = spark.range(3000).select(F.concat(F.lit("k"), "id").alias("record_id"), F.lit("http://e.com/x").alias("url"), F.col("id").alias("ts"), F.when(F.col("id") % 10 == 0, 200).otherwise(304).alias("status"), F.lit(None).cast("string").alias("etag"), F.lit(None).cast("long").alias("last_modified"), F.lit(None).cast("string").alias("digest"), F.create_map().cast("map<string,string>").alias("headers"))
    assert warc.resolve_revisits(hot).where("response_ts <> ts - ts % 10").count() == 0


def test_warc_reader(spark, tmp_path):
    import gzip

    bodies = [b"<p>hi: there</p>", b"line\r\n\r\n", b"a WARC/1.0\r\nWARC-Type: fake\r\n\r\nb", bytes(range(256)), b""]
    http = [b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n" + x for x in bodies]
    rec = [b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:%d>\r\nWARC-Target-URI: http://e.com/%d\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (i, i, len(x), x) for i, x in enumerate(http)]
    (tmp_path / "a.warc").write_bytes(b"".join(rec))
    (tmp_path / "b.warc.gz").write_bytes(b"".join(map(gzip.compress, rec)))
    (tmp_path / "c.warc").write_bytes(rec[0][:-7])
    for name in ("a.warc", "b.warc.gz"):
        got = warc.read_warc(spark, str(tmp_path / name)).orderBy("record_id").collect()
        assert [(r["record_id"], r["type"], r["url"], r["http_status"], r["http_headers"]["content-type"], bytes(r["payload"]), r["truncated"]) for r in got] == [
            (f"<urn:{i}>", "response", f"http://e.com/{i}", 200, "text/html", x, False) for i, x in enumerate(bodies)
        ]
    assert [(r["truncated"], bytes(r["payload"])) for r in warc.read_warc(spark, str(tmp_path / "c.warc")).collect()] == [(True, bodies[0][:-3])]


def test_html_extract(spark):
    page = (
        '<!DOCTYPE html><html><head><title>T</title><style>p{a:"</p>"}</style></head><body><header>Site</header><nav><ul><li><a href="/x">Menu</a></li></ul></nav><div class="ad">Buy now</div>'
        '<article><h1>Head &amp; tail</h1><p>One<br>two  \n three.</p><aside>Side</aside><p>x &lt; y</p><script>var a="<p>no</p>";</script><div class="comments"><p>I say</p></div><p>Last.</p></article>'
        '<div id="cookie-notice">Accept</div><form><p>Mail</p></form><footer>&copy; us</footer></body></html>'
    )
    assert html_extract.extract_main(page) == "Head & tail One two three. x < y Last."
    body = " ".join(["This is a long enough sentence of the text."] * 4)
    assert html_extract.extract_main(f"<div class=nav><a>A</a></div><div><p>{body}</p><p>{body}</p></div><div><a href=q>link one</a> <a>link two</a></div>") == f"{body} {body}"
    named = '<div class="wrap"><div class="top"><p>Shop</p></div><div id="content"><h2>Hi</h2><div><p>Text one.</p></div><div><a href=x>all links</a></div><p>End.</p></div><div>Outside words here</div></div>'
    assert html_extract.extract_main(named) == "Hi Text one. End."
    for odd, want in ((None, ""), ("", ""), ("<nav>x</nav>", ""), ("plain", "plain"), ("<article><p>cut of", "cut of"), ("<article><p>a &amp", "a &"), ("<article>x<p", "x"), ("<nav><article>open nav</article>", "open nav")):
        assert html_extract.extract_main(odd) == want, odd
    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    for r in pages.join(html_extract.extract_pages(pages).select("page_id", "text", "n_chars"), "page_id").collect():
        inner = re.search(r"<article>(.*?)(</article>|\Z)", r["html"], re.S).group(1)
        want = " ".join(html_module.unescape(re.sub(r"<[^>]*(>|\Z)", " ", inner)).split())
        assert r["text"] == want and r["n_chars"] == len(want)
    assert html_extract.extract_pages(pages.where("false")).count() == 0


def test_folds(spark):
    df = spark.createDataFrame([(0,), (17,), (None,)], "doc_id long")
    assert [r[0] for r in df.select(common.fold("doc_id", 5)).collect()] == [zlib.crc32(b"0") % 5, zlib.crc32(b"17") % 5, 0]
