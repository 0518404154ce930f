"""Findings of the third round: contexts of op8 are words, not classes of words."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from memlake.llm import language_model, words


def test_contexts_tell_words_apart():
    texts = pa.array([" ".join(f"w{i}" for i in range(200_000))])
    _, context, _ = language_model.tokens(words.Splitter(), texts)
    assert len(np.unique(context)) == 200_001  # 65,536 classes before; the first context is the start of a text


def test_context_names_are_packed_whole():
    rng = np.random.default_rng(0)
    for names in (np.zeros(0, np.uint64), np.array([0, 1, (1 << 40) - 1], np.uint64),
                  np.unique(rng.integers(0, 1 << 40, 5000).astype(np.uint64))):
        assert (language_model._unpack(language_model._pack(names)) == names).all()
        for homes in (1, 3, 7, 51):
            cut = language_model._homes(names, homes)
            assert cut[0] == 0 and cut[-1] == len(names)
            home = np.repeat(np.arange(homes), np.diff(cut))
            assert (home == [int(n) * homes >> 40 for n in names]).all()


def test_buckets_hear_the_totals_of_all_buckets(spark):
    docs = spark.createDataFrame([(i, " ".join(f"w{j}" for j in range(i % 7, 40, 1 + i % 3))) for i in range(60)], "doc_id long, text string")
    asked = {}
    totals = language_model._totals

    def watch(cells, parts, scalars=None):
        found = totals(cells, parts, scalars)
        if scalars is None:
            asked["rows"] = language_model._with_totals(cells, found[0], parts).collect()
            asked["parts"], asked["scalars"] = parts, found[1]
        return found

    language_model._totals = watch
    try:
        scores = language_model.score(docs, F.lit(False)).collect()
    finally:
        language_model._totals = totals
    assert len(scores) == 60
    before = [words_ for r in docs.collect() for words_ in ["", *r.text.split(" ")]]
    after = [words_ for r in docs.collect() for words_ in [*r.text.split(" "), "\n"]]
    hashed = language_model.tokens(words.Splitter(lower=True), pa.array([r.text for r in docs.collect()]))[1]
    name = dict(zip(before, hashed.tolist()))
    customers, kinds = {}, {}
    for b, a in zip(before, after):
        customers[name[b]] = customers.get(name[b], 0) + 1
        kinds.setdefault(name[b], set()).add(a)
    met = set()
    for row in asked["rows"]:
        batch = pa.RecordBatch.from_pylist([{"contexts": bytes(row.contexts), "totals": [t.asDict() for t in row.totals]}])
        known = language_model._known(batch, 0, language_model.homes_of(asked["parts"]), asked["scalars"])
        for context, n, t in zip(language_model._unpack(bytes(row.contexts)).tolist(), known.customers, known.tables):
            assert (n, t) == (customers[context], len(kinds[context]))
            met.add(context)
    assert met == set(customers) and asked["scalars"]["tokens"] == len(after)
