"""Approximate nearest neighbours with robust-pruned directed graphs, one for each shard.

Points enter a shard's graph in batches: a greedy beam search from the entry
point proposes neighbours, pruning keeps those that no kept one is much closer
to (relaxed by `alpha`, so that long edges survive), and edges are also added
backwards. Queries reach every shard in blocks and search its graph with a
beam; a query's best of all shards are its result. Scores are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from memlake.llm import common

SHARD_ROWS = 4096  # distinct vectors of a graph, about
DEGREE = 32
BUILD_BEAM = 64
SEARCH_BEAM = 128
ALPHA = 1.2
BATCH = 256
MENDED = 8  # further edges of a point, to points that a search for them misses
BLOCK_QUERIES = 512


def search(x: np.ndarray, graph: np.ndarray, entry: int, queries: np.ndarray, beam: int
           ) -> tuple[np.ndarray, np.ndarray]:
    """For every query the ids in its beam, nearest first (-1: none), and all points it expanded (-1: none)."""
    n = len(queries)
    ids = np.full((n, beam), -1, np.int64)
    away = np.full((n, beam), np.inf, np.float32)
    open_ = np.zeros((n, beam), bool)
    seen = np.zeros((n, len(x)), bool)
    ids[:, 0], open_[:, 0], seen[:, entry] = entry, True, True
    away[:, 0] = 1 - queries @ x[entry]
    expanded: list[np.ndarray] = []
    while True:
        rows = np.flatnonzero(open_.any(1))
        if not len(rows):
            break
        at = open_[rows].argmax(1)
        node = ids[rows, at]
        open_[rows, at] = False
        column = np.full(n, -1, np.int64)
        column[rows] = node
        expanded.append(column)
        near = graph[node]
        fresh = (near >= 0) & ~seen[rows[:, None], near]
        seen[np.repeat(rows, fresh.sum(1)), near[fresh]] = True
        gap = 1 - np.matmul(x[near], queries[rows][:, :, None])[:, :, 0]
        gap[~fresh] = np.inf
        all_away = np.concatenate([away[rows], gap], 1)
        order = np.argsort(all_away, 1, kind="stable")[:, :beam]
        away[rows] = np.take_along_axis(all_away, order, 1)
        ids[rows] = np.take_along_axis(np.concatenate([ids[rows], near], 1), order, 1)
        open_[rows] = np.take_along_axis(np.concatenate([open_[rows], fresh], 1), order, 1) & np.isfinite(away[rows])
        ids[rows] = np.where(np.isfinite(away[rows]), ids[rows], -1)
    return ids, np.stack(expanded, 1)


def prune(x: np.ndarray, points: np.ndarray, candidates: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Up to `degree` diverse neighbours of each point among its candidates (-1: none), -1 behind the last."""
    candidates = np.where(candidates == points[:, None], -1, candidates)
    order = np.argsort(candidates, 1, kind="stable")
    candidates = np.take_along_axis(candidates, order, 1)
    candidates[:, 1:][candidates[:, 1:] == candidates[:, :-1]] = -1
    vectors = x[candidates]
    away = 2 - 2 * np.matmul(vectors, x[points][:, :, None])[:, :, 0]
    away[candidates < 0] = np.inf
    order = np.argsort(away, 1, kind="stable")
    candidates, away = np.take_along_axis(candidates, order, 1), np.take_along_axis(away, order, 1)
    vectors = np.take_along_axis(vectors, order[:, :, None], 1)
    between = 2 - 2 * np.matmul(vectors, vectors.transpose(0, 2, 1))
    alive = np.isfinite(away)
    out = np.full((len(points), degree), -1, np.int64)
    every = np.arange(len(points))
    for slot in range(degree):
        rows = alive.any(1)
        if not rows.any():
            break
        best = alive.argmax(1)
        out[rows, slot] = candidates[every, best][rows]
        alive &= alpha * alpha * between[every, best] > away  # distances are squared
        alive[every, best] = False
    return out


def _connect(x: np.ndarray, graph: np.ndarray, points: np.ndarray, alpha: float) -> None:
    """Add the edges of `points` backwards; a list that overflows is pruned."""
    degree = graph.shape[1]
    source, target = np.repeat(points, degree), graph[points].ravel()
    ok = target >= 0
    source, target = source[ok], target[ok]
    new = ~(graph[target] == source[:, None]).any(1)
    order = np.argsort(target[new], kind="stable")
    source, target = source[new][order], target[new][order]
    ends, first = np.unique(target, return_index=True)
    count = np.diff(np.append(first, len(target)))
    for at in range(0, len(ends), BATCH):
        part = slice(at, at + BATCH)
        wide = int(count[part].max())
        lists = np.full((len(ends[part]), degree + wide), -1, np.int64)
        lists[:, :degree] = graph[ends[part]]
        for row, (begin, n) in enumerate(zip(first[part], count[part])):
            lists[row, degree: degree + n] = source[begin: begin + n]
        full = (lists >= 0).sum(1) > degree
        order = np.argsort(lists < 0, 1, kind="stable")
        graph[ends[part][~full]] = np.take_along_axis(lists, order, 1)[~full, :degree]
        if full.any():
            graph[ends[part][full]] = prune(x, ends[part][full], lists[full], degree, alpha)


def build(x: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, alpha: float = ALPHA
          ) -> tuple[np.ndarray, int]:
    """The graph (points x degree, -1: no edge) of unit vectors, and its entry point, the one nearest to the mean."""
    n = len(x)
    graph = np.full((n, degree), -1, np.int64)
    entry = int((x @ x.mean(0)).argmax())
    order = np.random.default_rng(n).permutation(n)
    order = np.concatenate([[entry], order[order != entry]])
    for slack in (1.0, alpha):
        at = 1 if slack == 1.0 else 0
        while at < n:
            points = order[at: at + (min(BATCH, at) if slack == 1.0 else BATCH)]
            _, expanded = search(x, graph, entry, x[points], beam)
            graph[points] = prune(x, points, np.concatenate([expanded, graph[points]], 1), degree, slack)
            _connect(x, graph, points, slack)
            at += len(points)
    return _mend(x, graph, entry, beam), entry


def _mend(x: np.ndarray, graph: np.ndarray, entry: int, beam: int) -> np.ndarray:
    """The graph with edges to points that a search for them does not find, from the nearest that it finds.

    Clumps of close points far from all others are left without edges into them
    by pruning; mending goes on while it finds such points and room for an edge.
    """
    graph = np.concatenate([graph, np.full((len(x), MENDED), -1, np.int64)], 1)
    room = np.full(len(x), graph.shape[1] - MENDED)
    lost = np.arange(len(x))
    for _ in range(4):
        missed = []
        for at in range(0, len(lost), BATCH):
            points = lost[at: at + BATCH]
            found, _ = search(x, graph, entry, x[points], beam)
            for point, near in zip(points[~(found == points[:, None]).any(1)], found[~(found == points[:, None]).any(1)]):
                missed.append(point)
                for other in near[near >= 0]:
                    if room[other] < graph.shape[1]:
                        graph[other, room[other]] = point
                        room[other] += 1
                        break
        if not missed:
            break
        lost = np.array(missed)
    return graph


def _unit(vectors: np.ndarray) -> np.ndarray:
    return (vectors / np.linalg.norm(vectors, axis=1, keepdims=True)).astype(np.float32)


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """`id, vector, dim` of rows with an id and a finite vector that is not zero."""
    value = F.col(vector_col).cast("array<double>")
    finite = F.forall(value, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    good = F.coalesce(finite & F.exists(value, lambda v: v != 0), F.lit(False))
    return vectors.where(F.col(id_col).isNotNull() & good).select(
        F.col(id_col).cast("long").alias("id"), value.alias("vector"), F.size(vector_col).alias("dim"))


def index(rows: DataFrame, k: int, shard_rows: int = SHARD_ROWS) -> tuple[DataFrame, int]:
    """One row for each shard with its graph, and the number of shards of a dimension.

    Equal vectors are one point with the `k` + 1 smallest ids, more of which no
    query can return. Points are dealt to shards by the hash of the least id.
    """
    rows = rows.distinct()
    window = Window.partitionBy("vector").orderBy("id")
    few = rows.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= k + 1)
    points = common.materialize(few.groupBy("vector").agg(F.array_sort(F.collect_list("id")).alias("ids"),
                                                          F.first("dim").alias("dim")))
    shards = max(1, -(-points.count() // shard_rows))

    def grow(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([("first", "ascending")])
        vectors = np.array(table["vector"].to_pylist(), np.float64)
        ids = np.full((len(vectors), k + 1), -1, np.int64)
        for row, found in enumerate(table["ids"].to_pylist()):
            ids[row, : len(found)] = found
        graph, entry = build(_unit(vectors))
        return pa.table({"dim": [key[0]], "shard": [key[1]], "vectors": [vectors.tobytes()], "ids": [ids.tobytes()],
                         "graph": [graph.astype(np.int32).tobytes()], "entry": pa.array([entry], pa.int32())
                         }).cast(pa.schema([("dim", pa.int32()), ("shard", pa.int32()), ("vectors", pa.binary()),
                                            ("ids", pa.binary()), ("graph", pa.binary()), ("entry", pa.int32())]))

    points = points.withColumn("first", F.element_at("ids", 1)).withColumn(
        "shard", F.pmod(F.xxhash64("first"), F.lit(shards)).cast("int"))
    graphs = points.groupBy("dim", "shard").applyInArrow(
        grow, "dim int, shard int, vectors binary, ids binary, graph binary, entry int")
    return common.materialize(graphs), shards


def nearest(vectors: DataFrame, queries: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5,
            beam: int = SEARCH_BEAM, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """`query_id, rank, vec_id, score`: the `k` nearest rows found for each query, the query's own id left out.

    Score is the cosine in double precision, ties go to the smaller id. Vectors
    that are null, zero, or hold null or non-finite components take no part, nor
    do null ids; vectors of different length are never compared. A repeated row
    counts once; a query with several vectors takes its best. With `k` other rows or fewer all are candidates.
    """
    graphs, shards = index(usable(vectors, id_col, vector_col), k, shard_rows)
    asked = common.materialize(usable(queries, id_col, vector_col).distinct())
    blocks = max(1, -(-asked.count() // BLOCK_QUERIES))
    packs = asked.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks))).groupBy("dim", "block").agg(
        F.collect_list(F.struct("id", "vector")).alias("queries"))
    packs = packs.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                one = {name: batch[name][row] for name in batch.schema.names}
                dim = one["dim"].as_py()
                x = np.frombuffer(one["vectors"].as_py(), np.float64).reshape(-1, dim)
                ids = np.frombuffer(one["ids"].as_py(), np.int64).reshape(len(x), -1)
                graph = np.frombuffer(one["graph"].as_py(), np.int32).reshape(len(x), -1).astype(np.int64)
                asked = one["queries"].as_py()
                q = np.array([a["vector"] for a in asked])
                own = np.array([a["id"] for a in asked], np.int64)
                found, _ = search(_unit(x), graph, one["entry"].as_py(), _unit(q), beam)
                best = found  # the whole beam is scored in double precision
                norm = np.linalg.norm(x, axis=1)
                score = np.einsum("qcd,qd->qc", x[best], q) / (norm[best] * np.linalg.norm(q, axis=1)[:, None])
                score[best < 0] = -np.inf
                names = ids[best]  # queries x points x copies
                value = np.repeat(score[:, :, None], names.shape[2], 2)
                value[(names < 0) | (names == own[:, None, None])] = -np.inf
                names, value = names.reshape(len(q), -1), value.reshape(len(q), -1)
                order = np.lexsort((names, -value))[:, :k]
                names, value = np.take_along_axis(names, order, 1), np.take_along_axis(value, order, 1)
                ok = np.isfinite(value)
                yield pa.record_batch({"query_id": np.repeat(own, ok.sum(1)), "vec_id": names[ok], "score": value[ok]})

    # Packs look as small as before they were told to every shard; as a broadcast all of them would go through the driver.
    joined = packs.hint("merge").join(graphs, ["dim", "shard"]).select("dim", "vectors", "ids", "graph", "entry", "queries")
    hits = joined.mapInArrow(find, "query_id long, vec_id long, score double")
    hits = hits.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")
