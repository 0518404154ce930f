"""Language identification by rank-order profiles of letter n-grams.

A language's profile is the list of its most frequent n-grams (one to three
letters, words padded with a space), a document's profile is made the same way,
and the language with the least out-of-place distance wins.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from memlake.llm import common, words

PROFILE_GRAMS = 400
#: Bound of the training sample, in rows of one language.
ROWS_PER_LANGUAGE = 2000
MAX_LANGUAGES = 2000
UNDETERMINED = "und"
#: A text is like a language from this share of the closeness that all but one in a hundred of its held-out rows reach.
LEAST_SHARE, LOW_ROWS = 0.6, 0.01
_SHIFT = 21  # bits of a code point
_CELLS = 4096


def letters() -> np.ndarray:
    """Whether a code point is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def grams(text: str, letter: np.ndarray) -> np.ndarray:
    """Keys of all n-grams of a text, in order of length and place; none without a letter."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    inside = letter[codes]
    if not inside.any():
        return np.zeros(0, np.int64)
    codes = np.where(inside, codes, 32)
    keep = inside.copy()
    keep[1:] |= inside[:-1]
    codes = np.concatenate([[32], codes[keep], [32]])
    if codes[1] == 32:
        codes = codes[1:]
    if codes[-2] == 32:
        codes = codes[:-1]
    two = codes[:-1] << _SHIFT | codes[1:]
    three = two[:-1] << _SHIFT | codes[2:]
    return np.concatenate([codes[codes != 32], two, three[codes[1:-1] != 32]])


def top(keys: np.ndarray, most: int) -> np.ndarray:
    """The most frequent keys, most frequent first, ties by key."""
    values, counts = words.distinct(keys)
    return values[np.argsort(-counts, kind="stable")[:most]]


@dataclass
class Profiles:
    """Languages by code point, all their grams sorted, and the rank of each gram in each language."""
    languages: list[str]
    grams: np.ndarray
    ranks: np.ndarray
    most: int

    def distances(self, profile: np.ndarray) -> np.ndarray:
        """Mean out-of-place distance to each language, as a share of the largest possible."""
        at, known = words.lookup(self.grams, profile)
        ranks = np.where(known[:, None], self.ranks[at], self.most)
        own = np.arange(len(profile))[:, None]
        places = np.where(ranks < self.most, np.abs(ranks - own), self.most)
        return places.sum(0) / (len(profile) * self.most)


def _sampled(labelled: DataFrame, rows_per_language: int | None) -> DataFrame:
    """The rows of least hashed id of each language, or all rows."""
    if rows_per_language is None:
        return labelled
    chosen = common.bounded_sample(labelled.select("id", "lang"), "lang", "id", rows_per_language)
    return labelled.join(F.broadcast(chosen.distinct()), ["id", "lang"], "left_semi")  # at most the rows of all languages


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          rows_per_language: int | None = ROWS_PER_LANGUAGE, most: int = PROFILE_GRAMS) -> Profiles:
    """Profiles from a bounded sample of labelled rows, `rows_per_language` of each language, or from all of them (None).

    Rows without text or language are left out; no labelled row at all gives no
    language. The sample is the rows of least hashed id; counts are added up by
    Spark, and only the `most` best n-grams of each language reach the driver.
    """
    labelled = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    labelled = labelled.where("text is not null and lang is not null and id is not null")
    if labelled.select("lang").distinct().limit(MAX_LANGUAGES + 1).count() > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    sample = _sampled(labelled, rows_per_language)

    def start():
        letter = letters()

        def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            found: dict[str, list[np.ndarray]] = {}
            for text, lang in zip(batch["text"], batch["lang"]):
                found.setdefault(lang.as_py(), []).append(grams(text.as_py(), letter))
            for lang, keys in found.items():
                values, counts = words.distinct(np.concatenate(keys))
                yield pa.record_batch({"lang": pa.array([lang] * len(values), pa.string()), "gram": values,
                                       "n": counts.astype(np.int64)})
        return work

    counts = common.by_batch(sample.select("text", "lang"), "lang string, gram long, n long", start)
    counts = counts.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    best = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    rows = counts.withColumn("rank", F.row_number().over(best) - 1).where(F.col("rank") < most)
    found = rows.select("lang", "gram", "rank").collect()
    languages = sorted({r.lang for r in found})
    place = {lang: i for i, lang in enumerate(languages)}
    keys = np.unique(np.array([r.gram for r in found], np.int64))
    ranks = np.full((len(keys), len(languages)), most, np.int64)
    for r in found:
        ranks[np.searchsorted(keys, r.gram), place[r.lang]] = r.rank
    return Profiles(languages, keys, ranks, most)


def least_closeness(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                    rows_per_language: int | None = ROWS_PER_LANGUAGE) -> dict[str, float]:
    """The closeness from which a text is like a language, by language, from a quarter of the labelled rows.

    Profiles of the other rows score them (a bounded sample again, or all); the rows they
    find in their own language count, in cells of 1/4096. A language without such rows is left out.
    """
    part = common.fold(id_col, 4) == 2
    profiles = learn(docs.where(~part), id_col, text_col, lang_col, rows_per_language)
    labelled = docs.where(part).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"),
                                       F.col(lang_col).alias("lang")).where("text is not null and lang is not null")
    found = identify(_sampled(labelled, rows_per_language), profiles, keep=["lang"]).where("lang = lang_pred and score > 0")
    # A bounded number of cells for each language goes to the driver, whatever the number of rows.
    cells = found.groupBy("lang", F.floor(F.col("score") * _CELLS).alias("cell")).agg(F.count(F.lit(1)).alias("n")).collect()
    low: dict[str, float] = {}
    for lang in {r.lang for r in cells}:
        own = sorted((r.cell, r.n) for r in cells if r.lang == lang)
        upto = np.cumsum([n for _, n in own])
        low[lang] = LEAST_SHARE * own[int(np.searchsorted(upto, LOW_ROWS * (upto[-1] - 1), "right"))][0] / _CELLS
    return low


def identify(docs: DataFrame, profiles: Profiles, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add `lang_pred` and `score` to every row (its columns `keep`, or all), from its whole text.

    `score` is the closeness to the chosen language: 1 for equal profiles, 0
    when no n-gram is shared. Null texts, texts without a letter and all texts
    when no language was learned are `und` with score 0; equal distances go to
    the language that is smaller by code point. Columns named `lang_pred` or
    `score` are replaced.
    """
    kept = [c for c in docs.columns if c not in ("lang_pred", "score") and (keep is None or c in keep)]
    whole = common.fresh(docs, "_whole_text")
    docs = docs.select(*kept, F.col(text_col).alias(whole))
    schema = docs.select(*kept, F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema
    model = docs.sparkSession.sparkContext.broadcast(vars(profiles))

    def start():
        letter, profiles = letters(), Profiles(**model.value)

        def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            lang = np.full(batch.num_rows, UNDETERMINED, object)
            score = np.zeros(batch.num_rows)
            for i, text in enumerate(batch[whole]):
                keys = grams(text.as_py() or "", letter)
                if len(keys) and profiles.languages:
                    away = profiles.distances(top(keys, profiles.most))
                    best = int(away.argmin())
                    lang[i], score[i] = profiles.languages[best], 1 - away[best]
            yield pa.record_batch([*batch.columns[:-1], pa.array(lang, pa.string()), pa.array(score)],
                                  names=[*kept, "lang_pred", "score"])
        return work

    return common.by_batch(docs, schema, start)
