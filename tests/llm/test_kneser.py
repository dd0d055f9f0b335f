from __future__ import annotations

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tallygrid.llm import kneser as kn
from tallygrid.llm.textkit import mix


def tokens(text):
    return (text or "").encode().lower().split() + ["</s>"]


class Plain:
    """The same model with dictionaries."""

    def __init__(self, texts):
        self.words, self.pairs = Counter(), Counter()
        for t in texts:
            w = tokens(t)
            self.words.update(w)
            self.pairs.update(zip(["<s>", *w], w, strict=False))
        self.n, self.v = sum(self.words.values()), len(self.words)
        self.ctx, self.seen, self.cont = defaultdict(lambda: [0, 0, 0]), Counter(), Counter()
        for (a, b), c in self.pairs.items():
            self.ctx[a][min(c, 3) - 1] += 1
            self.seen[a] += c
            self.cont[b] += 1
        kinds = lambda c: [sum(1 for x in c.values() if x == i) for i in (1, 2, 3, 4)]
        self.d, self.dl = kn._discounts(*kinds(self.pairs)), kn._discounts(*kinds(self.cont))
        self.low = [sum(1 for x in self.cont.values() if min(x, 3) == i) for i in (1, 2, 3)]

    def p(self, a, b):
        t = len(self.pairs)
        c = self.cont[b]
        off = lambda c, d: 0 if not c else d[min(c, 3) - 1]
        low = max(c - off(c, self.dl), 0) / t + sum(x * y for x, y in zip(self.dl, self.low, strict=True)) / t / (self.v + 1)
        if not self.seen[a]:
            return low
        c = self.pairs[a, b]
        return max(c - off(c, self.d), 0) / self.seen[a] + sum(x * y for x, y in zip(self.d, self.ctx[a], strict=True)) / self.seen[a] * low

    def score(self, text):
        w = tokens(text)
        return sum(math.log10(self.p(a, b)) for a, b in zip(["<s>", *w], w, strict=False))


def test_equals_dictionary_model(spark, documents, texts):
    out = {r["doc_id"]: r for r in kn.score_held_out(spark, documents).collect()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, *_ in texts}
    plain = Plain([t for i, t, *_ in texts if not held[i]])
    assert set(out) == set(held) and any(held.values())
    for i, t, *_ in texts:
        r, w = out[i], tokens(t)
        base = sum(math.log10((plain.words[x] + 1) / (plain.n + plain.v + 1)) for x in w)
        assert r["held_out"] == held[i] and r["train_tokens"] == plain.n and r["n_tokens"] == len(w)
        assert r["n_known"] == sum(plain.words[x] > 0 for x in w)
        assert r["base_score"] == pytest.approx(base, rel=1e-9) and r["score"] == pytest.approx(plain.score(t), rel=1e-6)


def test_probabilities_sum_to_one(documents, texts):
    plain = Plain([t for _, t, *_ in texts])
    for a in list(plain.seen)[:20]:
        assert sum(plain.p(a, b) for b in plain.words) + plain.p(a, b"unseen") == pytest.approx(1.0)


def test_unmix():
    x = np.array([0, 1, 2**63, 12345678901234567, 2**64 - 1], np.uint64)
    assert (kn.unmix(mix(x)) == x).all()


def test_held_counts_in_small_portions(spark, documents, monkeypatch):
    want = sorted(map(tuple, kn.score_held_out(spark, documents).collect()))
    monkeypatch.setattr(kn, "HOLD", 100)
    assert sorted(map(tuple, kn.score_held_out(spark, documents).collect())) == want


def test_empty_and_odd(spark, nothing, odd):
    assert kn.score_held_out(spark, nothing).count() == 0
    model = kn.fit(spark, nothing)
    r = kn.score(spark, spark.createDataFrame([(1, "a b")], "doc_id long, text string"), model).first()
    assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) == (3, 0, 0, 0.0, 0.0)
    assert kn.score_held_out(spark, odd).count() == odd.count()


def test_texts_end(texts):
    for _, _, h, starts in kn._texts(pa.array(["a b", None, "", "c"])):
        assert len(h) == 7 and starts.tolist() == [0, 3, 4, 5, 7] and (h[[2, 3, 4, 6]] == kn.END).all()
