"""The toxicity network's scoring pass: as the plain one, at a bounded cost a window; words projected in bounded parts."""

import numpy as np

from locusframe.llm import toxicity

WORDS = ["a", "of", "word", "Straße".lower(), "naïve", "𝔘𝔫", "antidisestablishmentarianism"] + [f"{chr(97 + i % 26)}{chr(97 + i // 26)}rest" for i in range(300)]


def test_exponentials_of_a_window(monkeypatch):
    net, rng, n = toxicity.Net(50, 64, 4, 4, 8, 8, 5), np.random.default_rng(6), 12
    gf, gb = net.project(rng.normal(0, 2, (50, 8)).astype(np.float32))
    ids = rng.integers(0, 50, 5000).astype(np.int32)
    plain = net.forward(gf, gb, ids[np.arange(len(ids) - n + 1)[:, None] + np.arange(n)], None)
    taken, exp = [], np.exp

    def counted(x, *args, **kwargs):
        taken.append(np.size(x))
        return exp(x, *args, **kwargs)

    monkeypatch.setattr(np, "exp", counted)
    got = net.every(gf, gb, ids, n)
    assert np.allclose(got, plain, atol=2e-5)
    assert sum(taken) == n * len(got)  # one a word for attention; gates take tanh, in one pass


def test_words_are_projected_in_parts(monkeypatch):
    net = toxicity.Net(3, 128, 4, 4, 3, 2, 1)
    model = toxicity.ToxModel(net, {"word": 1, "of": 2}, 128, 12)
    whole, sizes, rows = model._project(WORDS), [], net.inputs

    def counted(word, grams, count):
        sizes.append(len(word))
        return rows(word, grams, count)

    monkeypatch.setattr(toxicity, "_WORDS", 64)
    monkeypatch.setattr(net, "inputs", counted)
    parts = model._project(WORDS)
    assert all(np.allclose(a, b, atol=1e-6) for a, b in zip(whole, parts, strict=True))
    assert sum(sizes) == len(WORDS) and max(sizes) == 64


def test_grams_of_words_together_are_those_of_each():
    for buckets in (128, 100):
        each = [toxicity.gram_ids([w], buckets) for w in WORDS]
        ids, count = toxicity.gram_ids(WORDS, buckets)
        assert ids.tolist() == np.concatenate([g for g, _ in each]).tolist()
        assert count.tolist() == [c[0] for _, c in each] == [sum(max(0, len(w) + 3 - i) for i in toxicity.GRAMS) for w in WORDS]
