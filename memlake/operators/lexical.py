"""Word-overlap scores of many queries against many rows.

What a term scores in a row depends on single tokens of the row: the best of
equal (1), one inside the other (0.5) and none. Tokens repeat far more often than
rows do, so each distinct token of a batch is held against all terms of a block of
queries once, by lookups, and gives a row of bits. A row's bits are those of
its tokens joined, and its scores one product with the counts of terms in queries.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from memlake.functions import text as tx
from memlake.functions.scores import PART_TERM_LENGTH
from memlake.operators.prefix import ordinal

BLOCK_QUERIES = 32
_TOKENS_AT_ONCE = 1 << 18
_NEW_AT_ONCE = 1 << 16
_SHIFT = 21  # bits of a code point
_NO_LETTER = 0x110000  # ends a token
_KEPT_WORDS = 1 << 23  # 64-bit words of token bits that a task keeps
_KEPT_TOKENS = 1 << 19


class Block:
    """Distinct terms of some queries, their substrings, and how often each query has each term."""

    def __init__(self, queries: list[list[str]]):
        self.terms = {t: i for i, t in enumerate(dict.fromkeys(t for terms in queries for t in terms))}
        self.words = (len(self.terms) + 63) // 64
        self.counts = np.zeros((self.words * 64, len(queries)))
        for q, terms in enumerate(queries):
            for term in terms:
                self.counts[self.terms[term], q] += 0.5
        self.lengths = sorted({len(t) for t in self.terms})
        # Longer terms have too many substrings and are compared with tokens directly.
        self.long = [t for t in self.terms if len(t) > PART_TERM_LENGTH]
        self.parts: dict[str, int] = {}
        for term, i in self.terms.items():
            if len(term) <= PART_TERM_LENGTH:
                for part in {term[a:b] for a in range(len(term)) for b in range(a + 1, len(term) + 1)}:
                    self.parts[part] = self.parts.get(part, 0) | 1 << i
        self._trie()
        self.forget()

    def _trie(self) -> None:
        """Steps of a trie of the terms as sorted keys of state and code point, and the term that ends in a state."""
        steps: dict[tuple[int, int], int] = {}
        ends = [-1]
        for term, i in self.terms.items():
            state = 0
            for letter in term:
                after = steps.setdefault((state, ord(letter)), len(ends))
                if after == len(ends):
                    ends.append(-1)
                state = after
            ends[state] = i
        keys = np.array([a << _SHIFT | c for a, c in steps], np.int64)
        order = np.argsort(keys)
        self.step, self.after = keys[order], np.array(list(steps.values()), np.int64)[order]
        self.ends = np.array(ends)

    def hits(self, tokens: list[str]) -> np.ndarray:
        """For each token the bits of the terms that it equals, contains or lies in, then of the one it equals."""
        bits = np.zeros((len(tokens), 2 * self.words), np.uint64)

        def mark(token: np.ndarray, term: np.ndarray, half: int) -> None:
            np.bitwise_or.at(bits, (token, half * self.words + term // 64), np.uint64(1) << (term % 64).astype(np.uint64))

        sizes = np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1
        codes = np.frombuffer(("\n".join(tokens) + "\n").encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        codes[np.cumsum(sizes) - 1] = _NO_LETTER
        # All places at once walk down the trie; those without a step go.
        place, token, state = np.arange(len(codes)), np.repeat(np.arange(len(tokens)), sizes), np.zeros(len(codes), np.int64)
        while len(place):
            key = state << _SHIFT | codes[place]
            at = np.minimum(np.searchsorted(self.step, key), len(self.step) - 1)
            on = self.step[at] == key
            place, token, state = place[on] + 1, token[on], self.after[at[on]]
            ended = self.ends[state] >= 0
            mark(token[ended], self.ends[state[ended]], 0)
        for i, word in enumerate(tokens):
            near = self.parts.get(word, 0)
            for term in self.long:
                if word in term:
                    near |= 1 << self.terms[term]
            if near:
                bits[i, :self.words] |= np.frombuffer(near.to_bytes(self.words * 8, "little"), np.uint64)
            same = self.terms.get(word)
            if same is not None:
                bits[i, self.words + same // 64] |= np.uint64(1) << np.uint64(same % 64)
        return bits

    def places(self, rows: list[set[str]]) -> np.ndarray:
        """Rows of `bits` of the tokens of these rows, new ones added; those that hit no term share row 0."""
        new = list(set().union(*rows).difference(self.at))
        for some in (new[i:i + _NEW_AT_ONCE] for i in range(0, len(new), _NEW_AT_ONCE)):
            bits = self.hits(some)
            hit = bits.any(axis=1)
            end = self.used + int(hit.sum())
            if end > len(self.bits):
                self.bits = np.concatenate([self.bits, np.zeros((max(end, 2 * len(self.bits)) - len(self.bits), 2 * self.words), np.uint64)])
            self.bits[self.used:end] = bits[hit]
            self.at.update(zip(some, np.where(hit, self.used - 1 + np.cumsum(hit), 0).tolist()))
            self.used = end
        return np.fromiter(map(self.at.__getitem__, chain.from_iterable(rows)), np.int64, sum(map(len, rows)))

    def scores(self, rows: list[set[str]]) -> np.ndarray:
        """Scores of rows, given by their distinct tokens, by query."""
        out = np.zeros((len(rows), self.counts.shape[1]))
        sizes = np.fromiter(map(len, rows), np.int64, len(rows))
        place = self.places(rows)
        row = np.repeat(np.arange(len(rows)), sizes)[place > 0]
        place = place[place > 0]
        if not len(row):
            return out
        first = np.flatnonzero(np.diff(row, prepend=-1))
        joined = np.bitwise_or.reduceat(self.bits[place], first, axis=0)
        hit = np.unpackbits(joined.view(np.uint8), axis=1, bitorder="little").reshape(len(first), 2, -1)
        out[row[first]] = (hit[:, 0].astype(float) + hit[:, 1]) @ self.counts
        return out

    def forget(self) -> None:
        self.at, self.used = {}, 1
        self.bits = np.zeros((1024, 2 * self.words), np.uint64)


def _distinct(tokens: pa.Array) -> Iterator[tuple[int, list[set[str]]]]:
    """Distinct tokens of rows, some rows at a time with the first of them."""
    rows, size, first = [], 0, 0
    split = iter if pa.types.is_list(tokens.type) else re.compile(f"[^{re.escape(tx.BLANKS)}]+").findall
    for value in tokens:
        rows.append(set(split(value.as_py())) if value.is_valid else set())
        size += len(rows[-1])
        if size > _TOKENS_AT_ONCE:
            yield first, rows
            rows, size, first = [], 0, first + len(rows)
    if rows:
        yield first, rows


def _run(kept: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, known = None, None  # rows come in the order of their blocks
        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch["_key"].dictionary_encode()
            code = key.indices.to_numpy()
            names = key.dictionary.to_pylist()
            for i in sorted(range(len(names)), key=lambda i: names[i] != known):
                rows = np.flatnonzero(code == i)
                if names[i] != known:
                    block, known = Block(json.loads(batch["_terms"][int(rows[0])].as_py())), names[i]
                part = batch.select([*kept, "tokens"]).take(pa.array(rows))
                for at, some in _distinct(part["tokens"]):
                    scores = block.scores(some)
                    values = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1) * scores.shape[1], pa.int32()), scores.ravel())
                    yield pa.record_batch([*(part[c].slice(at, len(some)) for c in kept), values], names=[*kept, "_scores"])
                    if block.bits.size > _KEPT_WORDS or len(block.at) > _KEPT_TOKENS:
                        block.forget()
    return run


def score_rows(terms: DataFrame, rows: DataFrame, keep: list[str]) -> tuple[DataFrame, DataFrame]:
    """Word-overlap scores of the rows of each agent for all of its queries.

    `terms` has `query_id`, `agent_id` and `terms`, and is read twice, so pass a
    written table; `rows` has `agent_id`, `tokens` (a list, or a lower-case text
    that is split at `text.BLANKS`) and the columns `keep`. Returns the queries with
    their `_block` and `_pos`, and a row for each row and block of at most
    BLOCK_QUERIES queries with `_block` and the list `_scores` by `_pos`. Rows are
    put in the order of their blocks, so that a task meets few of them, one at a time.
    """
    name = F.col("query_id").cast("string")
    spread = F.pmod(F.xxhash64("query_id"), F.lit(1024))
    numbered = ordinal(terms, ["agent_id"], [spread], [spread, name], name="_n")
    numbered = numbered.withColumns({"_block": F.floor(F.col("_n") / BLOCK_QUERIES).cast("bigint"),
                                     "_pos": (F.col("_n") % BLOCK_QUERIES).cast("int")}).drop("_n")
    # A block has at most BLOCK_QUERIES queries.
    listed = F.array_sort(F.collect_list(F.struct("_pos", "terms")))
    blocks = numbered.groupBy("agent_id", "_block").agg(F.to_json(F.transform(listed, lambda q: q["terms"])).alias("_terms"))
    key = F.concat_ws("\n", F.col("_block").cast("string"), "agent_id").alias("_key")
    dealt = rows.join(blocks.select("agent_id", "_block"), "agent_id").select(*dict.fromkeys([*keep, "agent_id"]), "_block", "tokens", key)
    dealt = dealt.repartitionByRange("_key", F.xxhash64(*keep)).sortWithinPartitions("agent_id", "_block")
    # Terms are joined after rows are in order: no shuffle moves them with every row, and a join by these keys keeps it.
    joined = dealt.join(blocks, ["agent_id", "_block"]).select(*keep, "_block", "tokens", "_terms", "_key")
    schema = joined.select(*keep, "_block", F.array(F.lit(0.0)).alias("_scores")).schema
    return numbered, joined.mapInArrow(_run([*keep, "_block"]), schema)
