"""Cases of the third review."""

from __future__ import annotations

from pyspark.sql import functions as F


def _conversations(spark, folder, conv_ids):
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"conversation {c} turn {t} about plans. It was decided!") for c in conv_ids for t in range(4)]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(f"{folder}/conversations.parquet")
    return str(folder)


def test_backfill_reaches_the_last_day(spark, tmp_path):
    from memlake.catalog.daily import backfill_days

    sf = _conversations(spark, tmp_path, [3, 4, 5000, 5001, 5002, 5003])  # the last ones speak in 2033
    ledger = backfill_days(spark, sf).where("table_name = 'ledger'").select("item").collect()
    assert any(r.item.startswith("2033") for r in ledger)


def test_embedding_splits_words_once(spark):
    from memlake.functions import text as tx
    from memlake.plans.write import hashed_embedding

    rows = spark.createDataFrame([("one two two three, four",), ("",), ("x " * 50 + "yy",)], "text_used string")
    got = hashed_embedding(8)(rows)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "filter(transform(" not in plan  # words were split and hashed anew for each slot
    words = rows.select("text_used", F.explode(tx.match_tokens(F.col("text_used"))).alias("w")).select(
        "text_used", F.expr("pmod(xxhash64(w), 8)").alias("slot"), F.expr("if(pmod(hash(w), 2) = 0, 1.0, -1.0)").cast("double").alias("sign")).collect()
    for row in got.collect():
        raw = [sum(w.sign for w in words if w.text_used == row.text_used and w.slot == i) for i in range(8)]
        size = sum(v * v for v in raw) ** 0.5
        assert row.embedding == [v / size if size else v for v in raw]


def test_lexical_blocks_equal_pairwise_scores(spark):
    from memlake.functions import scores as sc, text as tx
    from memlake.operators import lexical

    long = "y" * 45
    queries = spark.createDataFrame([(i, "a" if i % 3 else "b", t) for i, t in enumerate(
        ["plan the plan", "an é x", long, "wholly other", "the", "", *[f"word{i} lan an" for i in range(70)]])], "query_id long, agent_id string, text string")
    rows = spark.createDataFrame([(i, "a" if i % 2 else "b", t) for i, t in enumerate(
        ["The plan, planned", "an lan", "yyy", long + "y", "", None, "é xx word1 word69", "w ord é", "𝄞lan ano"])], "row long, agent_id string, text string")
    terms = queries.select("query_id", "agent_id", tx.match_tokens(F.col("text")).alias("terms")).where("size(terms) > 0").localCheckpoint()
    tokens = rows.select("row", "agent_id", tx.match_tokens(F.col("text")).alias("tokens"))
    numbered, found = lexical.score_rows(terms, tokens, ["agent_id", "row"])
    # One row for a row and a block of queries, not one for each pair of a row and a query.
    assert found.count() == sum(-(-terms.where(F.col("agent_id") == r.agent_id).count() // lexical.BLOCK_QUERIES) for r in rows.collect())
    got = found.select("*", F.posexplode("_scores").alias("_pos", "s")).join(numbered, ["agent_id", "_block", "_pos"])
    pairs = terms.withColumn("parts", sc.term_parts(F.col("terms"))).join(tokens.withColumn("tokens", F.array_distinct("tokens")), "agent_id")
    want = pairs.select("query_id", "row", sc.lexical_score(F.col("terms"), F.col("parts"), F.col("tokens"), F.array_join("tokens", " ")).alias("s"))
    assert sorted(got.select("query_id", "row", "s").collect()) == sorted(want.collect())


def test_queries_set_plain_unions(spark, sf):
    from memlake.catalog import queries

    spark.conf.set("spark.sql.unionOutputPartitioning", "true")  # as in a session that `build_session` did not make
    queries()["recall_exact_long"](spark, sf)
    assert spark.conf.get("spark.sql.unionOutputPartitioning") == "false"


def test_findings_try_each_pattern_once(spark):
    from memlake.plans import write

    rows = spark.createDataFrame([("a", 1, 0, "user", "We decided to fix it! You must patch the config? Done.")],
                                 "agent_id string, chunk_id long, turn_index long, role string, text string")
    found = write.extract_summaries(rows.withColumns({"memory_date": F.lit("2024-01-01").cast("date"), "from_char": F.lit(0)}))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("must|should") == 1 and plan.count("let's use") == 1
    kinds = sorted((r.kind, r.weight, r.place.sentence) for r in found.where("kind != 'topic'").collect())
    assert kinds == [("decision", 0, 0), ("item:bug_fix", 0, 1), ("item:decision", 0, 0), ("peak", 3, 0), ("summary", 0, 0), ("todo", 0, 1)]


def test_pipeline_learns_languages_from_all_rows(spark, sf, monkeypatch):
    import corpus_pipeline
    from memlake.llm import common

    def sampled(*_):
        raise AssertionError("a sample was taken")

    monkeypatch.setattr(common, "bounded_sample", sampled)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert 0 < corpus_pipeline.language_id(spark, docs, sf).count() <= docs.count()


def test_lexical_texts_equal_token_lists(spark):
    from memlake.functions import text as tx
    from memlake.operators import lexical

    texts = ["The plan, planned-plan", "a\u3000b\u2028c\u00a0d，e", "İstanbul ΣΑΣ é_x", "", None, "  ", *[f"word{i} shared tail{i % 7}" for i in range(300)]]
    rows = spark.createDataFrame([(i, "a" if i % 2 else "b", t) for i, t in enumerate(texts)], "row long, agent_id string, text string")
    terms = spark.createDataFrame([(i, "a" if i % 3 else "b", ["plan", "c", f"word{i}", "tail", "σας", "i̇stanbul"]) for i in range(40)],
                                  "query_id long, agent_id string, terms array<string>").localCheckpoint()
    lists = lexical.score_rows(terms, rows.select("row", "agent_id", tx.match_tokens(F.col("text")).alias("tokens")), ["agent_id", "row"])[1]
    plain = lexical.score_rows(terms, rows.select("row", "agent_id", F.lower("text").alias("tokens")), ["agent_id", "row"])[1]
    assert sorted(plain.collect()) == sorted(lists.collect()) and plain.count() == len(texts)


def test_lexical_keeps_nothing_of_tokens_without_a_hit():
    from memlake.operators.lexical import Block

    block = Block([["plan", "word"], ["other"]])
    rows = [{f"zz{i}", f"qq{i}", "plans"} for i in range(5000)]
    assert block.scores(rows).tolist() == [[0.5, 0.0]] * 5000
    assert block.used == 2 and len(block.bits) == 1024  # bits of `plans` alone; each batch copied the bits of all tokens
    assert block.scores([{"word"}, set(), {"oth"}]).tolist() == [[1.0, 0.0], [0.0, 0.0], [0.0, 0.5]]


def test_recall_derives_anchored_documents_only(spark, sf):
    from memlake.catalog import fixtures as fx, recalling
    from memlake.plans import recall as rc
    from memlake.session import materialize

    index, documents, turns, vectors = recalling._memories(spark, sf)
    asked = fx.memory_queries(spark, sf)
    anchors = materialize(rc.recall_anchors(materialize(rc.score_index(asked, index, vectors, fx.query_vectors(spark, sf))), limit=1))
    keys = anchors.select(*rc.ROW).distinct()
    assert documents(keys).count() == keys.count() < fx.memory_documents(spark, sf).count()  # all were cut into pieces before
    for find, some, whole in ((rc.recall_summaries, documents, fx.memory_documents), (rc.recall_turns, turns, fx.memory_turns)):
        got, want = (find(asked, anchors, rows).select("query_id", "time_key", "information", "score", "layer_rank") for rows in (some, whole(spark, sf)))
        assert sorted(got.collect()) == sorted(want.collect()) and got.count() > 0


def test_pipeline_and_operators_hand_small_batches_to_python(spark, sf):
    import __spark_entry__
    import corpus_pipeline

    key, largest = "spark.sql.execution.arrow.maxBytesPerBatch", []
    rows = spark.range(0, 4000, 1, 1).select(F.expr("repeat(cast(id as string), 4000)").alias("text"))
    for start in (lambda: corpus_pipeline.STAGES[-1][1](spark, spark.read.parquet(f"{sf}/documents.parquet"), sf),
                  lambda: __spark_entry__.queries()["op7_mixing"](spark, sf)):
        spark.conf.unset(key)
        start()
        sizes = rows.mapInArrow(lambda batches: (b.from_pydict({"n": [b.nbytes]}) for b in batches), "n long").collect()
        largest.append(max(r.n for r in sizes))
    assert max(largest) < 8 << 20  # up to 64 MB before
