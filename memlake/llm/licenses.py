"""License scans: fuzzy search for short notices.

A text is brought to its words, lower-cased and one space apart. A notice that
may have k edits is split into k + 1 seeds: any occurrence within k edits leaves
one of them whole, at most k places from where the notice would have it. All
seeds of all notices are found in one pass over the text; the stretches around
them are candidates, and the regex library's bounded-error matching decides on
them and gives the spans. A phrase without edits is its own seed.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from memlake.llm import common


class Notice(NamedTuple):
    """A phrase in normal form, how many edits an occurrence may have, and a word that must stand in it unchanged."""
    label: str
    phrase: str
    edits: int = 0
    word: str = ""


# --- fixed values: phrases of the base labels ----------------------------------------------
PHRASES = (Notice("mit", "mit license"), Notice("apache", "apache license"), Notice("gpl", "general public license"))
# ---------------------------------------------------------------------------------------------

#: Short notices of public licenses; one edit in ten characters, in long ones in fifteen.
NOTICES = (
    Notice("mit", "mit license", 1, "mit"),
    Notice("mit", "permission is hereby granted free of charge to any person obtaining a copy", 5),
    Notice("apache", "apache license", 1),
    Notice("apache", "licensed under the apache license version 2 0", 3),
    Notice("gpl", "general public license", 2),
    Notice("lgpl", "gnu lesser general public license", 2, "lesser"),
    Notice("agpl", "gnu affero general public license", 2, "affero"),
    Notice("bsd", "redistribution and use in source and binary forms with or without modification", 5),
    Notice("bsd", "bsd 3 clause license", 1, "bsd"),
    Notice("bsd", "bsd 2 clause license", 1, "bsd"),
    Notice("mpl", "mozilla public license", 2),
    Notice("epl", "eclipse public license", 2),
    Notice("isc", "permission to use copy modify and or distribute this software for any purpose", 5),
    Notice("unlicense", "this is free and unencumbered software released into the public domain", 5),
    Notice("cc by", "licensed under cc by", 1, "cc"),
    Notice("cc by", "creative commons attribution", 2),
    Notice("cc0", "cc0 1 0 universal", 1, "cc0"),
)
ASCII_LOWER = {c: c + 32 for c in range(65, 91)}
SEPARATORS = regex.compile(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")


class Match(NamedTuple):
    label: str
    first: int  # word
    last: int  # word
    begin: int  # character of the text in normal form
    end: int
    edits: int
    closeness: float  # 1 - edits / length of the phrase
    exact: bool  # of a phrase without edits


def normal(text: str | None) -> str:
    """Words with a space before and after each; '' without words."""
    words = SEPARATORS.sub(" ", (text or "").translate(ASCII_LOWER)).strip(" ")
    return f" {words} " if words else ""


def pieces(notice: Notice) -> Iterator[tuple[str, int]]:
    """Seeds of a notice with their places in it; one more than it may have edits."""
    text, parts = f" {notice.phrase} ", notice.edits + 1
    if not notice.edits:
        yield text, 0
        return
    text = notice.phrase
    for i in range(parts):
        low, high = len(text) * i // parts, len(text) * (i + 1) // parts
        yield text[low:high], low


class Scanner:
    """Seeds of all notices in one automaton, and a pattern for each notice with edits."""

    def __init__(self, phrases: tuple[Notice, ...], notices: tuple[Notice, ...]):
        self.notices = (*phrases, *notices)
        seeds: dict[str, list[tuple[int, int]]] = {}
        for number, notice in enumerate(self.notices):
            for seed, offset in pieces(notice):
                seeds.setdefault(seed, []).append((number, offset))
        self.seeds = ahocorasick.Automaton()
        for seed, uses in seeds.items():
            self.seeds.add_word(seed, (len(seed), uses))
        if seeds:
            self.seeds.make_automaton()
        self.empty = not seeds
        self.patterns = [regex.compile(rf"(?b)(?<= )(?:{regex.escape(n.phrase, literal_spaces=True)}){{e<={n.edits}}}(?= )")
                         if n.edits else None for n in self.notices]

    def spans(self, text: str) -> Iterator[tuple[int, int, int, int]]:
        """(notice, begin, end, edits) of a text in normal form; of overlapping matches of one notice the best."""
        stretches: dict[int, list[list[int]]] = {}
        for last, (length, uses) in () if self.empty else self.seeds.iter(text):
            for number, offset in uses:
                notice = self.notices[number]
                begin = last - length + 1 - offset
                if not notice.edits:
                    yield number, begin + 1, begin + 1 + len(notice.phrase), 0
                    continue
                low, high = begin - notice.edits - 1, begin + len(notice.phrase) + notice.edits + 1
                found = stretches.setdefault(number, [])
                if found and low <= found[-1][1]:
                    found[-1][1] = max(found[-1][1], high)
                else:
                    found.append([low, high])
        for number, found in stretches.items():
            notice, pattern = self.notices[number], self.patterns[number]
            for low, high in found:
                yield from self._verify(text, max(low, 0), min(high, len(text)), number, notice, pattern)

    @staticmethod
    def _verify(text: str, low: int, high: int, number: int, notice: Notice, pattern) -> Iterator[tuple[int, int, int, int]]:
        """Matches in a stretch, in windows of a few times the notice, each beginning where the last one ended.

        A window is long enough to hold any match that begins in its first half.
        """
        reach = 2 * (len(notice.phrase) + notice.edits + 2)
        at = low
        while at < high:
            until = min(at + 2 * reach, high)
            match = pattern.search(text, at, until)
            if match is None:
                if until == high:
                    return
                at += reach
                continue
            begin, end = match.span()
            if not notice.word or f" {notice.word} " in text[begin - 1: end + 1]:
                yield number, begin, end, sum(match.fuzzy_counts)
                at = max(end, at + 1)
            else:
                at = begin + 1

    def scan(self, text: str) -> list[Match]:
        """All matches, in order; `text` is in normal form."""
        found = sorted((b, e, n, k) for n, b, e, k in self.spans(text))
        out, word, at = [], 0, 0
        for begin, end, number, edits in found:
            word += text.count(" ", at, begin)  # spaces up to the match: one before each word
            at = begin
            notice = self.notices[number]
            out.append(Match(notice.label, word - 1, word - 1 + text.count(" ", begin, end), begin, end, edits,
                             1 - edits / len(notice.phrase), not notice.edits))
        return out


@cache
def _scanner(phrases: tuple[Notice, ...], notices: tuple[Notice, ...]) -> Scanner:
    return Scanner(phrases, notices)


SCHEMA = ("n_words long, n_base long, first_word long, last_word long, base_labels array<string>, labels array<string>, "
          "score double, spans array<struct<label: string, first: long, last: long, edits: int, text: string>>")


def scan(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None,
         phrases: tuple[Notice, ...] = PHRASES, notices: tuple[Notice, ...] = NOTICES) -> DataFrame:
    """License notices in every document.

    Adds `n_words`; `n_base`, all places of the exact `phrases`, with the word
    numbers `first_word` and `last_word` of the first and last of them (null
    without any) and their `base_labels`; `labels` with those of the fuzzy
    `notices` too (both distinct and sorted); `score`, the closeness of the best
    match (0 without any, 1 if exact); `spans` with label, first and last word,
    edits and the words found, by place.

    A null text counts as empty: no words, no labels, score 0. Texts of any
    length are read whole; seeds are found in one pass, and only the stretches
    around them are matched. Repeated rows get the same result; of matches of
    one notice that overlap, one is reported. Columns named as the new ones are
    replaced; an empty table stays empty.
    """
    names = [f.split(" ")[0] for f in SCHEMA.split(", ") if ": " not in f] + ["spans"]
    kept = [c for c in (keep if keep is not None else docs.columns) if c.lower() not in names]
    rows = docs.select(*kept, docs[text_col].alias(common.fresh(docs, "_scanned")))
    out = rows.select(*kept).schema
    fields = docs.sparkSession.createDataFrame([], SCHEMA).schema
    for f in fields:
        out = out.add(f)
    arrow = _arrow_types()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _scanner(phrases, notices)
        for batch in batches:
            made = [_row(scanner, text.as_py()) for text in batch.column(batch.num_columns - 1)]
            columns = [pa.array([row[i] for row in made], t) for i, t in enumerate(arrow)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns], [*kept, *names])

    return rows.mapInArrow(run, out)


def _arrow_types() -> list[pa.DataType]:
    span = pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("edits", pa.int32()), ("text", pa.string())])
    return [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.string()), pa.float64(), pa.list_(span)]


def _row(scanner: Scanner, text: str | None) -> tuple:
    words = normal(text)
    found = scanner.scan(words)
    base = [m for m in found if m.exact]
    spans = [{"label": m.label, "first": m.first, "last": m.last, "edits": m.edits, "text": words[m.begin: m.end]} for m in found]
    return (max(words.count(" ") - 1, 0), len(base), base[0].first if base else None, base[-1].first if base else None,
            sorted({m.label for m in base}), sorted({m.label for m in found}), max((m.closeness for m in found), default=0.0), spans)
