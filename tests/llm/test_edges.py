"""Every operator on nulls, empty and long texts, ties, repeated rows, empty tables and clashing column names."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from memlake.llm import (common, decontaminate, extraction, jaccard, langid, language_model, lines, mixing, neighbours,
                         substrings, toxicity)

DOCS = "doc_id long, text string, lang string, source string, n_chars long, "
CLASH = ("score string, spans string, n_words string, items string, kept string, removed string, component_id string, "
         "size string, target string, copies string, lang_pred string, id string, place string, class string, "
         "_text string, _id string, _key string, _whole_text string, _source string, name string, at string")
LONG = " ".join(f"word{i % 977} the of" for i in range(30000))
TEXTS = [None, "", "   \n\t ", "a", "Ünïcode wörds, the same line of some length here\nshort", LONG, LONG,
         "the same words again and again the same words again and again the same words again and again now",
         "the same words again and again the same words again and again the same words again and again now",
         "x " * 50, "12345 67890", "\n\n\n", "idiot idiot", "tie tie tie"]


def table(spark, texts=TEXTS):
    n_extra = len(CLASH.split(","))
    rows = [(i, t, None if i % 4 == 0 else ("en", "fr", "de")[i % 3], None if i % 5 == 0 else f"s{i % 2}", None,
             *["x"] * n_extra) for i, t in enumerate(texts)]
    rows += [rows[4], rows[4], (None, "no id here at all, just a text of some words", None, None, 3, *[None] * n_extra)]
    return spark.createDataFrame(rows if texts else [], DOCS + CLASH)


def labels(spark):
    return spark.createDataFrame([(1, None), (2, 0), (2, 1), (3, 0), (None, 1), (12, 1), (99, 1), (5, 0)],
                                 "doc_id long, toxic int")


def items(spark):
    return spark.createDataFrame([(1, "the same words again and again the same words again"), (2, None), (3, ""),
                                  (None, "some length here"), (4, "some length here"), (4, "wörds the same")],
                                 "item_id long, text string")


OPERATORS = {
    "toxicity": lambda s, d: toxicity.score(d, toxicity.learn(d, labels(s))),
    "jaccard": lambda s, d: jaccard.join(d),
    "substrings": lambda s, d: substrings.remove_repeats(d),
    "langid": lambda s, d: langid.identify(d, langid.learn(d)),
    "lines": lambda s, d: lines.dedup(d),
    "mixing": lambda s, d: mixing.plan(d),
    "language_model": lambda s, d: language_model.score(d, common.held_out("doc_id", 7, 2)),
    "decontaminate": lambda s, d: decontaminate.find(d, items(s)),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_awkward_rows_each_get_a_row(spark, name):
    docs = table(spark)
    rows = OPERATORS[name](spark, docs).collect()
    assert sorted(str(r.doc_id) for r in rows) == sorted(str(r.doc_id) for r in docs.select("doc_id").collect())
    if name != "language_model":
        assert set(docs.columns) <= set(rows[0].asDict())


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    empty = table(spark).limit(0)
    assert OPERATORS[name](spark, empty).collect() == []


def test_equal_rows_get_equal_results(spark):
    for name in ("toxicity", "jaccard", "substrings", "langid", "lines", "mixing", "decontaminate", "language_model"):
        rows = [r for r in OPERATORS[name](spark, table(spark)).collect() if r.doc_id == 4]
        assert len(rows) == 3 and len({str(r) for r in rows}) == 1, name


def test_empty_texts_have_defined_results(spark):
    docs = table(spark)
    by_id = lambda df: {r.doc_id: r for r in df.collect()}
    lang = by_id(OPERATORS["langid"](spark, docs))
    assert [(lang[i].lang_pred, lang[i].score) for i in (0, 1, 2, 10)] == [("und", 0.0)] * 4
    sets = by_id(OPERATORS["jaccard"](spark, docs))
    assert [(sets[i].n_shingles, sets[i].component_id) for i in (0, 1, 2)] == [(0, i) for i in (0, 1, 2)]
    assert sets[3].n_shingles == 1 and sets[6].component_id == 5 and sets[8].component_id == 7
    assert sets[None].component_id is None
    kept = by_id(OPERATORS["substrings"](spark, docs))
    assert (kept[0].kept, kept[0].n_words, kept[6].kept) == ("", 0, "")
    left = by_id(OPERATORS["lines"](spark, docs))
    assert left[0].kept_text is None and left[0].n_lines == 0 and left[11].kept_text == "\n\n\n"
    assert left[6].removed_lines == [0] and left[5].removed_lines == []
    tokens = by_id(OPERATORS["language_model"](spark, docs))
    assert (tokens[0].n_tokens, tokens[1].n_tokens, tokens[3].n_tokens) == (1, 1, 2)
    hits = by_id(OPERATORS["decontaminate"](spark, docs))
    assert hits[0].spans == [] and hits[0].items == []
    assert hits[4].items == ["4"] and [(s.start, s.end) for s in hits[4].spans] == [(1, 4), (6, 9)]


def test_no_labels_no_languages_no_items(spark):
    docs = table(spark)
    none = labels(spark).limit(0)
    scores = {r.score for r in toxicity.score(docs, toxicity.learn(docs, none)).collect()}
    assert scores == {0.5}
    plain = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in langid.identify(plain, langid.learn(plain)).collect()} == {"und"}
    found = decontaminate.find(docs, items(spark).limit(0))
    assert all(r.spans == [] for r in found.collect())


def test_vectors(spark):
    good = [(i, [float(i % 7 - 3), 1.0, float(i)], "x") for i in range(60)]
    odd = [(100, None, "x"), (101, [0.0, 0.0, 0.0], "x"), (102, [1.0, None, 2.0], "x"), (103, [1.0, float("nan"), 2.0], "x"),
           (104, [1.0, float("inf"), 2.0], "x"), (None, [1.0, 2.0, 3.0], "x"), (150, [1.0, 2.0], "x"), (105, [], "x"),
           (200, [1.0, 2.0], "x"), good[5], (61, good[5][1], "x")]
    rows = spark.createDataFrame(good + odd, "vec_id long, embedding array<float>, score string")
    found = neighbours.nearest(rows, rows.where("vec_id % 50 = 0")).collect()
    seen = {r.vec_id for r in found} | {r.query_id for r in found}
    assert seen.isdisjoint({100, 101, 102, 103, 104, 105, None})
    assert [(r.vec_id, r["rank"]) for r in found if r.query_id == 150] == [(200, 1)]
    assert sorted(r["rank"] for r in found if r.query_id == 0) == [1, 2, 3, 4, 5]
    empty = rows.limit(0)
    assert neighbours.nearest(empty, empty).collect() == []


def test_pages(spark):
    rows = spark.createDataFrame([(1, "http://a.b/c", None, "x"), (2, None, "", "x"), (3, "not a url", "<p>a", "y"),
                                  (3, "not a url", "<p>a", "y"), (None, "http://a.b", "<", "z")],
                                 "page_id long, url string, html string, text string")
    found = extraction.extract(rows).collect()
    assert sorted((str(r.page_id), r.text) for r in found) == [("1", ""), ("2", ""), ("3", "a"), ("3", "a"), ("None", "<")]
    assert extraction.extract(rows.limit(0)).collect() == []


def test_pipeline_on_awkward_and_empty_tables(spark, tmp_path):
    items(spark).write.parquet(f"{tmp_path}/benchmark.parquet")
    for docs in (table(spark), table(spark).limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            columns = docs.columns
            docs = common.materialize(stage(spark, docs, str(tmp_path)))
            assert name == "mixing" or docs.columns == columns
