"""The pipeline's stages over the small tables: columns kept, decisions taken and held against plain versions, last stage mixed."""

import re

import numpy as np

import corpus_pipeline
from locusframe.llm import decontaminate, quality, toxicity

DATA = "/root/testdata/sf0.001"


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def plain_quality(spark, docs, rows):
    model = quality.fit(quality.sample(docs, spark.read.parquet(f"{DATA}/labels.parquet")))
    return {i for i, t in rows if model.scores(np.array([quality.text_stats(t)]))[0] >= 0.7}


def plain_toxicity(spark, docs, rows):
    """Each text by itself: the highest of its windows, one at every word."""
    model = toxicity.fit(docs, spark.read.parquet(f"{DATA}/labels.parquet"))

    def logit(words):
        return float(model.window_logits([words])[0][0])

    def score(text):
        words = [m.group() for m in toxicity.WORDS.finditer(text.lower())] if text else []
        if not words:
            return 0.0
        top = max(logit(words[a : a + model.length]) for a in range(max(1, len(words) - model.length + 1)))
        return 1 / (1 + np.exp(-(model.scale * top + model.shift)))

    return {i for i, t in rows if score(t) < 0.5}


def plain_near_duplicates(spark, docs, rows):
    def shingles(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", low(text))
        return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()

    sets = [(i, shingles(t)) for i, t in sorted(rows)]
    root = {i: i for i, _ in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if a == b or (a and b and len(a & b) >= 0.8 * len(a | b)):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {find(i) for i, _ in sets}


def plain_decontamination(spark, docs, rows):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))
    windows = set()
    for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect():
        w = words(r["text"])
        windows |= {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9))} if w else set()
    sizes = {len(w) for w in windows}
    return {i for i, t in rows if not any(tuple(w[a : a + n]) in windows for w in [words(t)] for n in sizes for a in range(len(w) - n + 1))}


PLAIN = {"quality": plain_quality, "toxicity": plain_toxicity, "near_duplicates": plain_near_duplicates, "decontamination": plain_decontamination}


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    ids = {r["doc_id"] for r in docs.select("doc_id").collect()}
    labels = {r["doc_id"]: r for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, DATA)
        out.write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        left = {r["doc_id"] for r in out.select("doc_id").collect()}
        assert left <= ids and out.count() == len(left)
        if i + 1 < len(corpus_pipeline.STAGES):
            assert out.columns == docs.columns
            assert left == PLAIN[name](spark, docs, [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()])
        if name == "quality":
            good = [k for k, r in labels.items() if r["quality"] == 1 and k in ids]
            assert sum(k in left for k in good) >= 0.95 * len(good)
        if name == "decontamination":
            bench = spark.read.parquet(f"{DATA}/benchmark.parquet")
            assert decontaminate.search(out, bench).where("size(items) > 0").count() == 0
        if name == "mixing":
            assert left == ids and out.where("taken > 2 * size").count() == 0
        docs, ids = out, left
