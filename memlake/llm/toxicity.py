"""Toxicity by two class-conditional Kneser-Ney models.

Each class has an interpolated Kneser-Ney model that makes a word in two steps,
first its leading bytes (a stem), then the word after the stem. Counts are
continuation counts: the distinct words that an item follows. Both classes back
off to continuation counts shared by them, so that an expression which either
has rarely seen weighs little. A text's margin is the difference of the two
log-likelihoods over its length, each word's log-ratio less the mean log-ratio
of the words that follow it in training texts: what is usual in its language and
topic, however the classes share these. A logistic scale makes it a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from memlake.llm import common, words

STEM_BYTES = 4
CLASS_DISCOUNT = 3.0
SHARED_DISCOUNT = 0.75
#: Weight of a stem's mean beside the followers of a word, in followers; of the mean over all, beside those of a stem.
COMPANY_PRIOR = 5.0
#: Bounds of the training sample, in rows of one class: for the counts, and for the logistic scale.
ROWS_PER_CLASS = 4000
SCALE_ROWS_PER_CLASS = 1200
_START = np.uint64(0x51A7)  # what a text's first word follows


@dataclass
class Model:
    """Log-ratios toxic to ordinary by name: of known stems and words, and of the weight left to unknown ones."""
    stem: np.ndarray
    stem_ratio: np.ndarray
    new_stem_ratio: float
    word: np.ndarray
    word_ratio: np.ndarray
    parent: np.ndarray
    new_word_ratio: np.ndarray
    word_usual: np.ndarray
    stem_usual: np.ndarray
    usual: float = 0.0
    slope: float = 1.0
    even: float = 0.0  # the margin that speaks for neither class
    offset: float = 0.0

    def ratios(self, stem: np.ndarray, word: np.ndarray) -> np.ndarray:
        """log P(word | toxic) - log P(word | ordinary) of each word."""
        left = _pick(self.parent, self.new_word_ratio, stem, 0.0)
        return _pick(self.stem, self.stem_ratio, stem, self.new_stem_ratio) + _pick(
            self.word, self.word_ratio, word, left)

    def usuals(self, stem: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The mean log-ratio among followers of each word; of an unknown one, of its stem or of all."""
        return _pick(self.word, self.word_usual, word, _pick(self.stem, self.stem_usual, stem, self.usual))

    def learn_usuals(self, word: np.ndarray, stem: np.ndarray, followers: np.ndarray, ratio: np.ndarray) -> None:
        """Set the means from the number of followers of each known word and the sum of their log-ratios."""
        if not followers.sum():
            return
        at = words.lookup(self.stem, stem)[0]
        by_stem = np.stack([np.bincount(at, x, len(self.stem)) for x in (followers, ratio)])
        self.usual = float(ratio.sum() / followers.sum())
        self.stem_usual = (by_stem[1] + COMPANY_PRIOR * self.usual) / (by_stem[0] + COMPANY_PRIOR)
        at, stem_at = words.lookup(self.word, word)[0], at
        self.word_usual = np.empty(len(self.word))
        self.word_usual[at] = (ratio + COMPANY_PRIOR * self.stem_usual[stem_at]) / (followers + COMPANY_PRIOR)

    def score(self, margin: np.ndarray, total: np.ndarray) -> np.ndarray:
        """The logistic scale: a margin weighs with the root of the length it was measured over."""
        scaled = self.slope * (margin - self.even) * np.sqrt(total) + self.offset
        return 1 / (1 + np.exp(-np.clip(scaled, -700, 700)))


def _pick(table: np.ndarray, values: np.ndarray, names: np.ndarray, rest: np.ndarray | float) -> np.ndarray:
    at, known = words.lookup(table, names)
    return np.where(known, values[at], rest) if len(table) else np.broadcast_to(rest, len(names))


def margins(excess: np.ndarray, found: words.Words) -> np.ndarray:
    """The mean of each row's words; 0 without a word."""
    total = np.diff(found.first)
    sums = np.concatenate([[0.0], np.cumsum(excess)])
    return (sums[found.first[1:]] - sums[found.first[:-1]]) / np.maximum(total, 1)


def probabilities(item: np.ndarray, parent: np.ndarray, counts: np.ndarray):
    """Both classes' P(item | parent) from classes x items counts; the parents, the weight of the shared counts after
    each in either class, and the part of that weight which an item not seen after the parent has."""
    parents, at = np.unique(parent, return_inverse=True)
    by_parent = lambda values: np.stack([np.bincount(at, v, len(parents)) for v in np.atleast_2d(values)])
    cut = np.minimum(counts, CLASS_DISCOUNT)
    total, lost = by_parent(counts), by_parent(cut)
    both = counts.sum(0)
    pooled, kinds = by_parent(both)[0], by_parent(both > 0)[0]
    shared = (both - SHARED_DISCOUNT + SHARED_DISCOUNT * (kinds / (kinds + 1))[at]) / pooled[at]
    weight = np.where(total > 0, lost / np.maximum(total, 1), 1.0)
    p = (counts - cut) / np.maximum(total[:, at], 1) + weight[:, at] * shared
    return p, parents, weight, SHARED_DISCOUNT * kinds / (kinds + 1) / pooled


def _ratios(item: np.ndarray, parent: np.ndarray, counts: np.ndarray):
    """Names and log-ratios of items, then of the weight left after each parent, from classes x items counts."""
    p, parents, weight, _ = probabilities(item, parent, counts)
    order = np.argsort(item)
    return item[order], np.log(p[1] / p[0])[order], parents, np.log(weight[1] / weight[0])


def estimate(stem: np.ndarray, word: np.ndarray, counts: np.ndarray) -> Model:
    """The model from distinct words, their stems, and their continuation counts (ordinary, toxic) x words."""
    if not len(word):
        none, flat = np.zeros(0, np.uint64), np.zeros(0)
        return Model(none, flat, 0.0, none, flat, none, flat, flat, flat)
    stems, at = np.unique(stem, return_inverse=True)
    by_stem = np.stack([np.bincount(at, c, len(stems)) for c in counts])
    first, first_ratio, _, left = _ratios(stems, np.zeros(len(stems), np.uint64), by_stem)
    second, second_ratio, parents, rest = _ratios(word, stem, counts.astype(float))
    return Model(first, first_ratio, float(left[0]), second, second_ratio, parents, rest,
                 np.zeros(len(second)), np.zeros(len(first)))


def scale(margin: np.ndarray, total: np.ndarray, toxic: np.ndarray) -> tuple[float, float, float]:
    """Logistic slope of the margin, the margin that speaks for neither class, and offset, from labelled rows; each
    class has half of the weight. A slope of 0 or less, from too few rows to tell, becomes 1 over an even margin of 0."""
    if toxic.all() or not toxic.any():
        return 1.0, 0.0, 0.0
    values = np.stack([margin * np.sqrt(total), np.sqrt(total)])
    mean, spread = values.mean(1), values.std(1)
    spread[spread == 0] = 1.0
    x = np.concatenate([(values - mean[:, None]) / spread[:, None], np.ones((1, len(margin)))])
    weight = np.where(toxic, 0.5 / toxic.mean(), 0.5 / (1 - toxic.mean()))
    ridge = np.array([1.0, 1.0, 1e-9])
    beta = np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(beta @ x, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))) @ x.T + np.diag(ridge),
                               x @ (weight * (toxic - p)) - ridge * beta)
        beta = beta + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    slope, by_length = beta[:2] / spread
    if slope <= 0:
        return 1.0, 0.0, 0.0
    return float(slope), float(-by_length / slope), float(beta[2] - slope * mean[0] - by_length * mean[1])


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "toxic", rows_per_class: int = ROWS_PER_CLASS,
          scale_rows_per_class: int = SCALE_ROWS_PER_CLASS) -> Model:
    """Fit on a bounded sample of labelled rows.

    Rows without id or label are left out; an id with several labels counts as
    toxic if one of them says so. A fixed quarter of the labelled ids, by hash,
    only sets the logistic scale. `rows_per_class` and `scale_rows_per_class` ids
    of each class, those of least hash, are used; for the counts as many as the
    rarer class has, so that neither class is smoothed more than the other.
    Without labels of both classes every text scores by the rest (0.5 if none).
    """
    tagged = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"))
    tagged = tagged.where("id is not null and label is not null").groupBy("id").agg(
        F.max((F.col("label") > 0).cast("int")).alias("toxic"))
    tagged = tagged.withColumn("for_scale", F.pmod(F.xxhash64("id", F.lit("scale")), F.lit(4)) == 0)
    sizes = {r.toxic: r["count"] for r in tagged.where(~F.col("for_scale")).groupBy("toxic").count().collect()}
    fewest = min(rows_per_class, *(sizes.get(kind, rows_per_class) for kind in (0, 1)))
    counted = common.bounded_sample(tagged.where(~F.col("for_scale")), "toxic", "id", fewest)
    scaled = common.bounded_sample(tagged.where("for_scale"), "toxic", "id", scale_rows_per_class)
    chosen = common.materialize(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(
        F.broadcast(counted.unionByName(scaled)), "id"))  # at most twice the two bounds together

    def start():
        splitter = words.Splitter("alnum", lower=True)

        def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            kind = batch["toxic"].to_numpy() > 0
            for at, texts in words.chunks(batch["text"]):
                found = splitter.split(texts)
                if not len(found.hash):
                    continue
                before = np.concatenate([[_START], found.hash[:-1]])
                before[found.first[:-1][np.diff(found.first) > 0]] = _START
                toxic = kind[at + found.row]
                _, which = np.unique(words.pair(before, found.hash) ^ toxic.astype(np.uint64), return_index=True)
                yield pa.record_batch({
                    "v": before[which].view(np.int64), "w": found.hash[which].view(np.int64),
                    "stem": splitter.prefixes(found, STEM_BYTES)[which].view(np.int64), "toxic": toxic[which]})
        return work

    pairs = common.materialize(common.by_batch(chosen.where(~F.col("for_scale")).select("text", "toxic"),
                            "v long, w long, stem long, toxic boolean", start).distinct())
    counts = pairs.groupBy("w", "stem").agg(F.count_if(~F.col("toxic")).alias("ordinary"),
                                            F.count_if("toxic").alias("toxic")).toArrow()
    column = lambda name: counts[name].to_numpy()
    model = estimate(column("stem").view(np.uint64), column("w").view(np.uint64),
                     np.stack([column("ordinary"), column("toxic")]))
    shared = docs.sparkSession.sparkContext.broadcast(vars(model))

    def rated():
        model = Model(**shared.value)

        def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            ratio = model.ratios(*(batch[c].to_numpy().view(np.uint64) for c in ("stem", "w")))
            yield pa.record_batch({"v": batch["v"], "billionths": np.rint(ratio * 1e9).astype(np.int64)})
        return work

    company = common.by_batch(pairs, "v long, billionths long", rated).groupBy("v").agg(
        F.count("*").alias("followers"), F.sum("billionths").alias("billionths"))  # whole numbers: equal in every order
    known = pairs.select("w", "stem").distinct().join(company, F.col("w") == F.col("v"), "left").select(
        "w", "stem", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("followers", "billionths"))).toArrow()
    model.learn_usuals(*(known[c].to_numpy().view(np.uint64) for c in ("w", "stem")), known["followers"].to_numpy(),
                       known["billionths"].to_numpy() / 1e9)
    held = score(chosen.where("for_scale"), model, keep=["toxic"]).toArrow()
    if held.num_rows:
        model.slope, model.even, model.offset = scale(
            held["margin"].to_numpy(), held["n_words"].to_numpy(), held["toxic"].to_numpy() > 0)
    return model


def score(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add `score` (0 to 1), `margin` (the difference of the log-likelihoods over the length) and `n_words` to every row's columns `keep`, or all.

    Whole texts are read. A null or empty text has margin 0 and the score of
    that margin. Columns with the names of the new ones are replaced.
    """
    new = ("score", "margin", "n_words")
    kept = [c for c in docs.columns if c not in new and (keep is None or c in keep)]
    whole = common.fresh(docs, "_whole_text")
    docs = docs.select(*kept, F.col(text_col).alias(whole))
    schema = docs.select(*kept, F.lit(0.0).alias("score"), F.lit(0.0).alias("margin"),
                         F.lit(0).cast("long").alias("n_words")).schema
    shared = docs.sparkSession.sparkContext.broadcast(vars(model))

    def start():
        splitter, model = words.Splitter("alnum", lower=True), Model(**shared.value)

        def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for at, texts in words.chunks(batch[whole]):
                found = splitter.split(texts)
                stem = splitter.prefixes(found, STEM_BYTES)
                margin = margins(model.ratios(stem, found.hash) - model.usuals(stem, found.hash), found)
                part, total = batch.slice(at, len(texts)), np.diff(found.first)
                yield pa.record_batch([*part.columns[:-1], model.score(margin, total), margin, total],
                                      names=[*kept, *new])
        return work

    return common.by_batch(docs, schema, start)
