"""Cases that a cut in an operator or stage would lose."""

import base64
import random
import string

import corpus_pipeline
from memlake.llm import lines


def stage(name):
    return dict(corpus_pipeline.STAGES)[name]


def test_jaccard_stage_takes_five_words_and_four_fifths(spark):
    rng = random.Random(21)
    some = lambda n: " ".join(f"n{rng.randrange(5000)}" for _ in range(n))
    long = some(300)
    docs = [(1, long), (2, f"{long} {some(40)}"), (3, f"{long} {some(90)}"), (4, some(300))]  # 0.88, 0.77 of the union
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    assert {r.doc_id for r in stage("ngram_jaccard")(spark, frame, "").collect()} == {1, 3, 4}


def test_short_lines_are_compared(spark):
    rows = [(1, "Read more\nOk.\n \n\nAAAAABBBBB"), (2, "Ok.\nReed morex\n \n\nOh."), (3, "AAAAABBBBB\nRead more\nOk."),
            (4, "abcde\nab"), (5, "abcdf\nac")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "length(text) n_chars")
    got = {r.doc_id: r for r in lines.dedup(frame, least_chars=None).collect()}
    assert {k: r.removed_lines for k, r in got.items()} == {1: [], 2: [0, 1], 3: [0, 1, 2], 4: [], 5: [0]}
    assert got[2].kept_text == " \n\nOh." and got[3].kept_text == ""
    assert {r.doc_id for r in stage("line_dedup")(spark, frame, "").collect()} == {1, 2, 4, 5}


def test_language_stage_drops_gibberish_and_other_languages(spark, sf):
    frame = spark.read.parquet(f"{sf}/documents.parquet")
    rng = random.Random(22)
    word = lambda: "".join(rng.choice(string.ascii_lowercase) for _ in range(rng.randint(2, 9)))
    planted = [" ".join(word() for _ in range(n)) for n in (20, 200, 2000)]
    planted += [base64.b64encode(rng.randbytes(n)).decode() for n in (100, 1000)]
    planted += ["Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki "
                "ja omatunto, ja heidän on toimittava toisiaan kohtaan veljeyden hengessä.",
                "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni "
                "rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa."]
    rows = spark.createDataFrame([(10**9 + i, t) for i, t in enumerate(planted)], "doc_id long, text string")
    kept = {r.doc_id for r in stage("language_id")(spark, frame.unionByName(rows, allowMissingColumns=True), sf).collect()}
    assert kept == {r.doc_id for r in frame.where("text rlike '[A-Za-z]'").collect()}
