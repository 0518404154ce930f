"""Source divergence audit over a K-squared quadtree of the group-term count matrix.

A language's matrix has a row for each source and a column for each kept term.
It is cut by columns into blocks of a bounded number of terms and by rows into
tiles of a bounded number of sources; every (block, pair of tiles) is a group of
bounded size. Inside, the matrix is a quadtree that splits rows and columns in K
parts each: a quadrant without a count is one empty node, whatever its size. Two
rows are compared by walking the tree once for both: where both are empty, all
their cells hold the smoothed probability of a count of 0 and the quadrant is
priced by its width; other quadrants are followed down to leaves, which are
compared cell by cell. The row of the whole language is walked along with each
source. Blocks are added up per pair of sources.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window, functions as F

from memlake.llm import common, words

LEAST_DOCS, ADDED, SCALE, TOP = 30, 5, 10**9, 50
#: Columns of a block on average, rows of a tile, parts of a side of a quadrant, and the largest leaf.
BLOCK_TERMS, TILE, K = 2048, 128, 2
LEAF_ROWS, LEAF_TERMS = 8, 64
CHUNK_BYTES = 4 << 20

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


# --- counts -------------------------------------------------------------------------------

def terms_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Runs of ASCII letters and non-ASCII characters, A-Z lower-cased, and the row of each; null has none."""
    texts = pa.compute.fill_null(texts, "").cast(pa.large_binary())
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset: texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[bounds[0]: bounds[-1]] if raw is not None else np.zeros(0, np.uint8)
    bounds = bounds - bounds[0]
    inside = _LETTER[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    first = bounds[:-1][bounds[:-1] < len(data)]
    begins[first] = inside[first]  # a text that ends in a letter does not run into the next
    start = np.flatnonzero(begins)
    kept = _FOLD[data[inside]]
    offsets = np.append((np.cumsum(inside) - inside)[start], len(kept)).astype(np.int32)
    found = pa.Array.from_buffers(pa.string(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(kept)])
    return found, np.searchsorted(bounds, start, "right") - 1


def _count_chunk(langs: pa.Array, sources: pa.Array, texts: pa.Array) -> pa.RecordBatch:
    found, row = terms_of(texts)
    coded = found.dictionary_encode()
    width = max(len(coded.dictionary), 1)
    code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    in_row, n = np.unique(row * width + code, return_counts=True)
    names: dict[tuple[str, str], int] = {}
    group = np.array([names.setdefault(g, len(names)) for g in zip(langs.to_pylist(), sources.to_pylist())], np.int64)
    key, place = np.unique(group[in_row // width] * width + in_row % width, return_inverse=True)
    pairs = list(names)
    lang, source = (pa.array([p[i] for p in pairs], pa.string()) for i in (0, 1))
    of = pa.array(key // width)
    return pa.RecordBatch.from_arrays(
        [lang.take(of), source.take(of), coded.dictionary.take(pa.array(key % width)),
         pa.array(np.bincount(place, n, len(key)).astype(np.int64)), pa.array(np.bincount(place, minlength=len(key)))],
        ["lang", "source", "term", "n", "docs"])


def term_counts(docs: DataFrame) -> DataFrame:
    """Occurrences and documents of every (`lang`, `source`, term); counted per chunk of texts, then added up."""
    def start():
        def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for at, texts in words.chunks(batch["text"], CHUNK_BYTES):
                yield _count_chunk(batch["lang"].slice(at, len(texts)), batch["source"].slice(at, len(texts)), texts)

        return work

    counted = common.by_batch(docs.select("lang", "source", "text"), "lang string, source string, term string, n long, docs long", start)
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


# --- quadtree -------------------------------------------------------------------------------

@dataclass
class Quad:
    """Rows r0 to r1 and columns c0 to c1; `parts` by row then column, none in a leaf."""
    r0: int
    r1: int
    c0: int
    c1: int
    empty: bool
    parts: list[list[Quad]] = field(default_factory=list)


def _edges(low: int, high: int, most: int) -> list[int]:
    return [low, high] if high - low <= most else [low + (high - low) * i // K for i in range(K + 1)]


def quadtree(present: np.ndarray, r0: int, r1: int) -> Quad:
    """The tree of some rows of a matrix of which cells have a count."""
    sums = np.zeros((present.shape[0] + 1, present.shape[1] + 1), np.int64)
    np.cumsum(np.cumsum(present, 0), 1, out=sums[1:, 1:])

    def grow(r0: int, r1: int, c0: int, c1: int) -> Quad:
        quad = Quad(r0, r1, c0, c1, sums[r1, c1] - sums[r0, c1] - sums[r1, c0] + sums[r0, c0] == 0)
        if not quad.empty and (r1 - r0 > LEAF_ROWS or c1 - c0 > LEAF_TERMS):
            rows, columns = _edges(r0, r1, LEAF_ROWS), _edges(c0, c1, LEAF_TERMS)
            quad.parts = [[grow(a, b, c, d) for c, d in zip(columns, columns[1:])] for a, b in zip(rows, rows[1:])]
        return quad

    return grow(r0, r1, 0, present.shape[1])


def leaves(quad: Quad) -> Iterator[Quad]:
    """Leaves with a count."""
    if quad.parts:
        for row in quad.parts:
            for part in row:
                yield from leaves(part)
    elif not quad.empty:
        yield quad


def _strip(quad: Quad, column: int, columns: list[int]) -> list[Quad]:
    """The parts of a quadrant in one column range; an empty one or a leaf is cut to the range."""
    if quad.parts:
        return [row[column] for row in quad.parts]
    return [Quad(quad.r0, quad.r1, columns[column], columns[column + 1], quad.empty)]


def distances(left: Quad, right: Quad, p: np.ndarray, zero: np.ndarray, out: np.ndarray) -> None:
    """Add to `out` the distance of each row of `left` to each row of `right` over their common columns."""
    a, b = slice(left.r0, left.r1), slice(right.r0, right.r1)
    if left.empty and right.empty:
        out[a, b] += np.abs(zero[a, None] - zero[None, b]) * (left.c1 - left.c0)
    elif not left.parts and not right.parts:
        for c in range(left.c0, left.c1, LEAF_TERMS):
            columns = slice(c, min(c + LEAF_TERMS, left.c1))
            out[a, b] += np.abs(p[a, None, columns] - p[None, b, columns]).sum(2)
    else:
        columns = _edges(left.c0, left.c1, LEAF_TERMS)
        for at in range(len(columns) - 1):
            for one in _strip(left, at, columns):
                for other in _strip(right, at, columns):
                    distances(one, other, p, zero, out)


def audit_block(rows: pd.DataFrame, top: int = TOP) -> pd.DataFrame:
    """Distances of all pairs of sources of two tiles over the terms of a block; in a tile's own block also its terms.

    `rows` has a row without a term for each source, which also says how many
    terms the block has (`width`), and one for each count.
    """
    heads = rows[rows["term"].isna()].sort_values("place")
    cells = rows[rows["term"].notna()]
    names, zero, places = heads["source"].tolist(), heads["p"].to_numpy(np.int64), heads["place"].to_numpy()
    terms, code = np.unique(cells["term"].to_numpy(object), return_inverse=True)
    line = np.searchsorted(places, cells["place"].to_numpy())
    present = np.zeros((len(names), len(terms)), bool)
    present[line, code] = True
    order = np.lexsort(present[::-1]) if len(terms) and len(names) else np.arange(len(terms))  # like columns side by side
    column = np.empty(len(terms), np.int64)
    column[order] = np.arange(len(terms))
    present, terms, code = present[:, order], terms[order], column[code]
    p = np.repeat(zero[:, None], len(terms), 1)
    p[line, code] = cells["p"].to_numpy(np.int64)
    q = np.zeros(len(terms), np.int64)
    q[code] = cells["q"].to_numpy(np.int64)

    lang, tile, other = rows["lang"].iloc[0], rows["tile"].iloc[0], rows["other"].iloc[0]
    middle = int(np.searchsorted(places, (tile + 1) * TILE))
    own = tile == other
    left = quadtree(present, 0, middle)
    right = left if own else quadtree(present, middle, len(names))
    out = np.zeros((len(names), len(names)), np.int64)
    distances(left, right, p, zero, out)
    absent = int(heads["width"].iloc[0]) - len(terms)  # terms of the block that none of these sources has: one empty quadrant
    out += np.abs(zero[:, None] - zero) * absent
    a, b = np.nonzero(np.triu(np.ones_like(out, bool), 1) if own else
                      (np.arange(len(names))[:, None] < middle) & (np.arange(len(names)) >= middle))
    part, source, item, value = ["pair"] * len(a), [names[i] for i in a], [names[i] for i in b], out[a, b].tolist()
    best: dict[int, list] = {}
    for leaf in leaves(left) if own else ():
        r, c = np.nonzero(present[leaf.r0: leaf.r1, leaf.c0: leaf.c1])
        r, c = r + leaf.r0, c + leaf.c0
        more = p[r, c] - q[c]
        for i, t, v in zip(r[more > 0].tolist(), c[more > 0].tolist(), more[more > 0].tolist()):
            best.setdefault(i, []).append((-v, terms[t]))
    for i, found in best.items():
        for v, term in sorted(found)[:top]:
            part.append("term"), source.append(names[i]), item.append(term), value.append(-v)
    return pd.DataFrame({"lang": [lang] * len(part), "source": source, "part": part, "item": item, "value": value}, dtype=object)


# --- audit ----------------------------------------------------------------------------------

def _share(n: Column, all_: Column, terms: Column, added: int, scale: int) -> Column:
    """1 + floor(scale * (n + added) / (all + added * terms)) in whole numbers of 38 digits."""
    wide = lambda c: c.cast("decimal(19,0)")
    above = (wide(n) + F.lit(added)).cast("decimal(19,0)") * F.lit(scale).cast("decimal(10,0)")
    below = F.greatest(all_ + terms * added, F.lit(1))
    return F.call_function("div", above, wide(below)) + 1


def audit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
          least_docs: int = LEAST_DOCS, added: int = ADDED, scale: int = SCALE, top: int = TOP) -> DataFrame:
    """How far the sources of each language are from one another, and which terms set them apart.

    Terms are runs of letters; a language keeps those in at least `least_docs`
    of its documents (rows). A source's probability of a kept term is smoothed by
    `added` and scaled to whole numbers. Rows: `lang`, `source`, `part`, `item`,
    `value`, `rank` (from 1 per source and part, largest value first, then item).
    Part `pair`: for every other source its summed distance over all kept terms
    (0 without any). Part `term`: the `top` terms that the source has more often
    than its language, by the difference.

    Null text, lang and source count as ''. A source of empty texts has all
    counts 0; a language of one source has no pairs; repeated rows count each;
    equal values are in order of the item's code points. An empty table has no
    rows. Other columns play no part, whatever their names.
    """
    docs = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n)
                         for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])
    counts = common.materialize(term_counts(docs))
    totals = counts.groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("docs").alias("docs")).where(
        F.col("docs") >= least_docs).drop("docs")
    kept = common.materialize(counts.drop("docs").join(totals, ["lang", "term"]))

    own = kept.groupBy("lang", "source").agg(F.sum("n").alias("n_own"))
    terms = kept.groupBy("lang", "term").agg(F.max("total").alias("total"))
    whole = terms.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("total").alias("n_lang"))
    # One row per source of a language: its place among them decides its tile.
    groups = docs.select("lang", "source").distinct().join(own, ["lang", "source"], "left").join(whole, "lang", "left").fillna(
        0, ["n_own", "terms", "n_lang"])
    groups = groups.withColumns({
        "place": (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).cast("long"),
        "tiles": F.ceil(F.count(F.lit(1)).over(Window.partitionBy("lang")) / TILE).cast("int"),
        "blocks": F.greatest(F.ceil(F.col("terms") / BLOCK_TERMS), F.lit(1)).cast("long")})
    groups = common.materialize(groups.withColumn("tile", F.floor(F.col("place") / TILE).cast("int")))

    block = F.pmod(F.xxhash64("term"), F.col("blocks")).alias("block")
    widths = terms.join(groups.select("lang", "blocks").distinct(), "lang").groupBy("lang", block).agg(
        F.count(F.lit(1)).alias("width"))
    share = lambda n, all_: _share(n, F.col(all_), F.col("terms"), added, scale)
    keys = ["lang", "block", "tile", "other"]
    heads = groups.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"),
                          F.lit(None).cast("string").alias("term"), share(F.lit(0).cast("long"), "n_own").alias("p"),
                          F.lit(0).cast("long").alias("q")).join(widths, ["lang", "block"], "left").fillna(0, ["width"])
    cells = kept.join(groups, ["lang", "source"]).withColumns({
        "block": block, "width": F.lit(0).cast("long"), "p": share(F.col("n"), "n_own"),
        "q": share(F.col("total"), "n_lang")})
    columns = ["lang", "block", "tile", "tiles", "place", "source", "term", "p", "q", "width"]
    rows = heads.select(columns).unionByName(cells.select(columns))
    # Each pair of tiles is a group of its own: a tile goes to as many groups as the language has tiles.
    paired = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("_t")).select(
        *[c for c in columns if c not in ("tile", "tiles")], F.least("tile", "_t").alias("tile"),
        F.greatest("tile", "_t").alias("other"))
    found = paired.groupBy(*keys).applyInPandas(
        lambda part: audit_block(part, top), "lang string, source string, part string, item string, value long")
    found = common.materialize(found)

    pairs = found.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    both = pairs.select("lang", "part", "value", F.explode(F.array(
        F.struct(F.col("source"), F.col("item")), F.struct(F.col("item").alias("source"), F.col("source").alias("item")))).alias("_p")
        ).select("lang", "_p.source", "part", "_p.item", "value")
    by_value = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(by_value).cast("int"))
    return ranked(both).unionByName(ranked(found.where("part = 'term'")).where(F.col("rank") <= top))
