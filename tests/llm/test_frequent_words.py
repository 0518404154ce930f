"""F2 of the fourth round: a word of very many tokens is dealt to several buckets, and scores are those of one word."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from memlake.llm import language_model


def texts(spark):
    rng = np.random.default_rng(5)
    docs = [(i, " ".join("the" if rng.random() < 0.3 else f"w{rng.zipf(1.4) % 400}" for _ in range(int(rng.integers(0, 120))))) for i in range(400)]
    return docs, spark.createDataFrame(docs, "doc_id long, text string")


def score(rows):
    return {r.doc_id: r for r in language_model.score(rows, F.col("doc_id") % 7 == 2).collect()}


def test_a_split_word_is_one_word(spark, monkeypatch):
    docs, rows = texts(spark)
    before = score(rows)
    seen = []
    plan = language_model.Split.plan
    monkeypatch.setattr(language_model, "SPLIT", 600)
    monkeypatch.setattr(language_model, "_SAMPLED", 1)
    monkeypatch.setattr(language_model.Split, "plan", staticmethod(lambda *a: seen.append(plan(*a)) or seen[-1]))
    after = score(rows)
    assert len(seen[0].names) >= 1 and seen[0].pieces.max() >= 10
    count = Counter(w for i, t in docs if i % 7 != 2 for w in [*t.split(), None])
    n, v = sum(count.values()), len(count)
    for i, t in docs:
        words_ = [*t.split(), None]
        assert (after[i].n_tokens, after[i].n_known, after[i].train_tokens) == (len(words_), sum(w in count for w in words_), n)
        assert after[i].base_score == pytest.approx(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in words_))
        assert after[i].score == pytest.approx(before[i].score, rel=0.12, abs=1)  # other seatings of the same customers
    assert sum(r.score for r in after.values()) == pytest.approx(sum(r.score for r in before.values()), rel=0.03)


def test_no_piece_grows_with_a_frequent_word():
    names = np.full(300_000, 77, np.uint64)
    contexts = np.arange(300_000, dtype=np.uint64) % np.uint64(5000)
    split = language_model.Split.plan(np.array([77, 5], np.uint64), np.array([3_000_000, 160_000]))
    assert split.names.tolist() == [5, 77] and split.pieces.tolist() == [2, 20]
    dealt = split.deal(names, contexts)
    assert np.bincount(np.unique(dealt, return_inverse=True)[1]).max() < 2 * 300_000 / 20
    assert (split.whole(dealt) == 2).all() and (split.whole(names) == 0).all()
    assert (split.deal(names + np.uint64(1), contexts) == 78).all() and (language_model.NONE.deal(names, contexts) == 77).all()
    of = dict(zip(contexts.tolist(), dealt.tolist()))
    assert all(of[c] == d for c, d in zip(contexts.tolist(), dealt.tolist()))  # all customers of a context's dish together
