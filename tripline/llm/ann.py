"""Operator 1, approximate nearest neighbours: a hierarchical navigable small-world graph per shard, results merged.

Largest inner product becomes nearest neighbour on a sphere by one more coordinate, sqrt(longest^2 - length^2).  Equal vectors are
one node that carries its smallest ids.  Nodes are dealt to shards by hash; their number grows with the square root of the
vectors, so shards and the number of shards a query visits both stay moderate.  Nodes of a shard are numbered by falling level, so the graph of a level
is a prefix of the nodes and its neighbours are one flat array.  Nodes enter a level in batches that search it together.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tripline.llm.text import partitions, splitmix, table

K, LINKS, EF_BUILD, EF_SEARCH, QUERIES_PER_TASK = 20, 16, 96, 192, 4096


@dataclass
class Graph:
    """``vectors`` on the sphere; ``levels[l]`` the neighbours (-1: none) of the first len(levels[l]) nodes."""

    vectors: np.ndarray
    levels: list[np.ndarray]


def beam(vectors: np.ndarray, neighbours: np.ndarray, queries: np.ndarray, entry: np.ndarray, ef: int, step: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Best-first search of many queries at once: (queries x ef) node ids (-1: none) and similarities, best first."""
    n_q = len(queries)
    rows = np.arange(n_q)[:, None]
    width = entry.shape[1]
    ids = np.full((n_q, ef), -1, np.int64)
    sim = np.full((n_q, ef), -np.inf, np.float32)
    ids[:, :width] = entry
    sim[:, :width] = np.where(entry >= 0, np.einsum("qed,qd->qe", vectors[np.maximum(entry, 0)], queries), -np.inf)
    seen = np.zeros((n_q, len(neighbours) + 1), bool)  # the last column takes what is none
    seen[rows, ids] = True
    done = ids < 0
    live = np.arange(n_q)
    while len(live):
        open_sim = np.where(done[live], -np.inf, sim[live])
        pick = np.argsort(-open_sim, axis=1, kind="stable")[:, :step]
        here = live[:, None]
        can = np.take_along_axis(open_sim, pick, axis=1) > -np.inf
        going = can[:, 0]
        live, pick, can, here = live[going], pick[going], can[going], here[going]
        if not len(live):
            break
        done[here, pick] = True
        source = np.where(can, ids[here, pick], -1)
        near = np.where(source[:, :, None] >= 0, neighbours[source], -1).reshape(len(live), -1)
        near = np.sort(near, axis=1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
        near[seen[here, near]] = -1
        seen[here, near] = True
        s = np.where(near >= 0, np.einsum("qnd,qd->qn", vectors[np.maximum(near, 0)], queries[live]), -np.inf).astype(np.float32)
        all_ids, all_sim = np.concatenate((ids[live], near), axis=1), np.concatenate((sim[live], s), axis=1)
        all_done = np.concatenate((done[live], near < 0), axis=1)
        keep = np.argpartition(-all_sim, ef - 1, axis=1)[:, :ef]
        ids[live], sim[live], done[live] = (np.take_along_axis(a, keep, axis=1) for a in (all_ids, all_sim, all_done))
    order = np.argsort(-sim, axis=1, kind="stable")
    return np.take_along_axis(ids, order, axis=1), np.take_along_axis(sim, order, axis=1)


def diverse(vectors: np.ndarray, own: np.ndarray, ids: np.ndarray, sim: np.ndarray, most: int) -> np.ndarray:
    """For each node at most ``most`` of its candidates (best first): those nearer to it than to any one already chosen, then the nearest others."""
    order = np.argsort(-sim, axis=1, kind="stable")
    ids, sim = np.take_along_axis(ids, order, axis=1), np.take_along_axis(sim, order, axis=1)
    v = vectors[np.maximum(ids, 0)]
    between = v @ v.transpose(0, 2, 1)
    ok = ids >= 0
    chosen = np.zeros(ids.shape, bool)
    closest = np.full(ids.shape, -np.inf, np.float32)
    for c in range(ids.shape[1]):
        take = ok[:, c] & (closest[:, c] < sim[:, c]) & (chosen.sum(axis=1) < most)
        chosen[:, c] = take
        closest = np.where(take[:, None], np.maximum(closest, between[:, :, c]), closest)
    rank = np.where(chosen, 0, np.where(ok, 1, 2))
    order = np.argsort(rank, axis=1, kind="stable")[:, :most]
    out = np.take_along_axis(ids, order, axis=1)
    return np.pad(out, ((0, 0), (0, most - out.shape[1])), constant_values=-1) if out.shape[1] < most else out


def build(vectors: np.ndarray, seeds: np.ndarray, links: int = LINKS, ef: int = EF_BUILD) -> tuple[Graph, np.ndarray]:
    """The graph, and the order its nodes have (indices into ``vectors``)."""
    u = ((splitmix(seeds) >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53
    level = np.floor(-np.log(u) / math.log(links)).astype(int)
    order = np.lexsort((seeds, -level))
    vectors = np.ascontiguousarray(vectors[order], np.float32)
    level = level[order]
    levels: list[np.ndarray] = []
    for lv in range(int(level[0]) if len(level) else 0, -1, -1):
        n = int((level >= lv).sum())
        most = 2 * links if lv == 0 else links
        graph = np.full((n, most), -1, np.int64)
        lo = 1
        while lo < n:
            hi = min(n, lo + min(max(lo // 4, 1), 256))
            q = vectors[lo:hi]
            entry = np.zeros((hi - lo, 1), np.int64)
            for upper in levels:
                entry = beam(vectors, upper, q, entry, 1, 1)[0]
                if len(upper) >= lo:  # nodes that are not in this level yet are no entries
                    entry = np.where(entry < lo, entry, 0)
            ids, sim = beam(vectors, graph[:lo], q, entry, min(ef, max(lo, 1)))
            # nodes of one batch see each other too
            mates = q @ q.T
            np.fill_diagonal(mates, -np.inf)
            top = np.argsort(-mates, axis=1, kind="stable")[:, :most]
            mate_sim = np.take_along_axis(mates, top, axis=1)
            ids = np.concatenate((ids, np.where(mate_sim > -np.inf, top + lo, -1)), axis=1)
            sim = np.concatenate((sim, mate_sim), axis=1)
            graph[lo:hi] = diverse(vectors, np.arange(lo, hi), ids, np.where(ids >= 0, sim, -np.inf), most)
            # links back
            a = np.repeat(np.arange(lo, hi), most)
            b = graph[lo:hi].ravel()
            a, b = a[b >= 0], b[b >= 0]
            by = np.argsort(b, kind="stable")
            a, b = a[by], b[by]
            node, at, count = np.unique(b, return_index=True, return_counts=True)
            widest = int(count.max()) if len(count) else 0
            more = np.full((len(node), widest), -1, np.int64)
            more[np.repeat(np.arange(len(node)), count), np.arange(len(b)) - np.repeat(at, count)] = a
            both = np.sort(np.concatenate((graph[node], more), axis=1), axis=1)
            both[:, 1:][both[:, 1:] == both[:, :-1]] = -1
            for part in range(0, len(node), 512):
                p = slice(part, part + 512)
                full = (both[p] >= 0).sum(axis=1) > most
                packed = -np.sort(-both[p], axis=1)[:, :most]
                if packed.shape[1] < most:
                    packed = np.pad(packed, ((0, 0), (0, most - packed.shape[1])), constant_values=-1)
                if full.any():
                    s = np.einsum("qnd,qd->qn", vectors[np.maximum(both[p][full], 0)], vectors[node[p][full]])
                    packed[full] = diverse(vectors, node[p][full], both[p][full], np.where(both[p][full] >= 0, s, -np.inf), most)
                graph[node[p]] = packed
            lo = hi
        levels.append(graph.astype(np.int32))
    return Graph(vectors, levels), order


def search(graph: Graph, queries: np.ndarray, ef: int = EF_SEARCH, batch: int = 256) -> np.ndarray:
    """The ``ef`` nodes found for each query, nearest first (-1: none)."""
    out = []
    batch = max(1, min(batch, (64 << 20) // max(len(graph.vectors), 1)))
    for lo in range(0, len(queries), batch):
        q = queries[lo : lo + batch]
        entry = np.zeros((len(q), 1), np.int64)
        for upper in graph.levels[:-1]:
            entry = beam(graph.vectors, upper, q, entry, 1, 1)[0]
        out.append(beam(graph.vectors, graph.levels[-1], q, entry, min(ef, len(graph.vectors)))[0])
    return np.concatenate(out)


def usable(vectors: DataFrame, id_column: str, column: str) -> DataFrame:
    """(id, v): non-null ids with finite, non-zero vectors of one length, the most frequent one (the shortest of equals)."""
    v = F.col(column).cast("array<double>")
    rows = (vectors.select(F.col(id_column).cast("long").alias("id"), v.alias("v")).where("id is not null and v is not null and size(v) > 0")
            .where(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))).where(F.exists("v", lambda x: x != 0)))
    size = rows.groupBy(F.size("v").alias("s")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "s").limit(1).collect()
    return rows.where(F.size("v") == (size[0].s if size else -1))


def nearest(vectors: DataFrame, queries: str, k: int = K, id_column: str = "vec_id", column: str = "embedding", ef: int = EF_SEARCH, links: int = LINKS, ef_build: int = EF_BUILD) -> DataFrame:
    """(query_id, rank, vec_id, score): for each usable row that satisfies the SQL condition ``queries`` on ``id``, the ``k`` found
    among all other usable rows with the largest inner product (double precision), ties to the smaller id.

    Vectors that are null, zero, of another length or hold null or non-finite numbers take no part, nor do null ids.  Of repeated ids each
    distinct vector is a candidate, equal rows count once, and a query never finds its own id; other columns are ignored; without candidates there are no rows.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, id_column, column).distinct()
    first = Window.partitionBy("v").orderBy("id")
    nodes = table(rows.withColumn("r", F.row_number().over(first)).where(F.col("r") <= k + 1).groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids"))
                  .withColumn("sq", F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)))
    n, longest = nodes.agg(F.count(F.lit(1)), F.max("sq")).head()
    shards = max(1, math.ceil(math.sqrt(n) / 32))
    longest = longest or 1.0

    def index(t: pa.Table) -> pa.Table:
        v = np.array(t.column("v").combine_chunks().values.to_numpy()).reshape(t.num_rows, -1)
        ids = t.column("ids").to_pylist()
        extra = np.sqrt(np.maximum(longest - (v * v).sum(axis=1), 0))
        graph, order = build(np.column_stack((v, extra)), np.array([x[0] for x in ids], np.int64), links, ef_build)
        flat = [x for i in order for x in ids[i]]
        return pa.table({"shard": pa.array([t.column("shard")[0].as_py()], pa.int32()), "vectors": pa.array([v[order].astype("<f8").tobytes()], pa.binary()),
                         "ids": pa.array([np.array(flat, "<i8").tobytes()], pa.binary()), "n_ids": pa.array([np.array([len(ids[i]) for i in order], "<i4").tobytes()], pa.binary()),
                         "levels": pa.array([[g.astype("<i4").tobytes() for g in graph.levels]], pa.list_(pa.binary()))})

    built = table(nodes.withColumn("shard", F.pmod(F.xxhash64(F.col("ids")[0]), F.lit(shards)).cast("int")).select("shard", "v", "ids")
                  .groupBy("shard").applyInArrow(index, "shard int, vectors binary, ids binary, n_ids binary, levels array<binary>"))
    asked = rows.where(queries)
    salts = max(1, math.ceil(asked.count() / QUERIES_PER_TASK))

    def find(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["query_id", "vec_id", "score"]
        if not left.num_rows or not right.num_rows:
            return pa.table({n: pa.array([], t) for n, t in zip(names, (pa.int64(), pa.int64(), pa.float64()), strict=True)})
        q = np.array(right.column("v").combine_chunks().values.to_numpy()).reshape(right.num_rows, -1)
        who = right.column("id").to_numpy()
        row = left.to_pylist()[0]
        v = np.frombuffer(row["vectors"], "<f8").reshape(-1, q.shape[1])
        n_ids = np.frombuffer(row["n_ids"], "<i4").astype(np.int64)
        ids, at = np.frombuffer(row["ids"], "<i8"), np.cumsum(n_ids) - n_ids
        extra = np.sqrt(np.maximum(longest - (v * v).sum(axis=1), 0))
        graph = Graph(np.column_stack((v, extra)).astype(np.float32), [np.frombuffer(g, "<i4").reshape(-1, links if i + 1 < len(row["levels"]) else 2 * links) for i, g in enumerate(row["levels"])])
        found = search(graph, np.column_stack((q, np.zeros(len(q)))).astype(np.float32), ef)
        a, b, c = [], [], []
        for i in range(len(q)):
            node = found[i][found[i] >= 0]
            score = v[node] @ q[i]
            n = n_ids[node]
            each = ids[np.repeat(at[node], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
            s = np.repeat(score, n)
            other = each != who[i]
            each, s = each[other], s[other]
            best = np.lexsort((each, -s))[:k]
            a.append(np.full(len(best), who[i]))
            b.append(each[best])
            c.append(s[best])
        return pa.table({"query_id": pa.array(np.concatenate(a), pa.int64()), "vec_id": pa.array(np.concatenate(b), pa.int64()), "score": pa.array(np.concatenate(c))})

    dealt = (asked.withColumn("salt", F.pmod(F.xxhash64("id", "v"), F.lit(salts)).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).select("shard", "salt", "id", "v"))
    indexes = built.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    found = indexes.groupBy("shard", "salt").cogroup(dealt.groupBy("shard", "salt")).applyInArrow(find, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.dropDuplicates(["query_id", "vec_id", "score"]).withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
