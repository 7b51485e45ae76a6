"""Approximate nearest neighbours: a hierarchical navigable small-world graph per shard.

Rows are dealt to shards of bounded size by a hash of vec_id. In a shard, the nodes stand in a random order and
layer l holds the first n / 16^l of them, so a layer is a flat array of neighbour numbers with a row per node. Graphs are
built in batches: the beams of a batch advance together in numpy. Index rows hold ids, vectors and neighbour
arrays as binary; queries are searched in every shard, in blocks, and the shards' results are merged.

Candidates found are scored again in double precision on the original vectors.

Defined results: vectors that are null, zero, or hold null or non-finite components take no part; vectors of another
dimension than the query's aren't candidates; of rows that repeat a vec_id with different vectors the
smallest vector counts; equal vectors are one node, all their ids can be returned; ties go to the smaller vec_id;
fewer candidates than k give all; an empty table gives an empty result; rows without vec_id take no part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import groups, materialize, table

SHARD_ROWS, QUERY_BLOCK = 4096, 4096
DEGREE, DEGREE0, EF_BUILD, EF_SEARCH, EXPAND, BATCH, SEED_NODES, FANOUT = 16, 32, 80, 200, 4, 256, 32, 16
K, EVERY = 5, 50
INDEX_SCHEMA = "dim long, shard long, n_nodes long, ids binary, node_of binary, vectors binary, layers binary, neighbours binary"


class Graph:
    """Unit vectors and one neighbour array per layer (-1: none)."""

    def __init__(self, unit: np.ndarray, layers: list[np.ndarray]):
        self.unit, self.layers = unit, layers

    @staticmethod
    def sizes(n: int) -> list[int]:
        out = [n]
        while out[-1] > FANOUT:
            out.append(-(-out[-1] // FANOUT))
        return out

    @classmethod
    def build(cls, unit: np.ndarray) -> Graph:
        """``unit``: vectors in random order."""
        sizes = cls.sizes(len(unit))
        graph = cls(unit, [np.full((s, DEGREE0 if i == 0 else DEGREE), -1, np.int32) for i, s in enumerate(sizes)])
        seed = min(len(unit), SEED_NODES)
        for layer, s in enumerate(sizes):
            m = min(seed, s)
            far = 1 - unit[:m] @ unit[:m].T
            np.fill_diagonal(far, np.inf)
            near = np.argsort(far, axis=1, kind="stable")[:, : min(m - 1, DEGREE)]
            graph.layers[layer][:m, : near.shape[1]] = near
        start = seed
        while start < len(unit):
            level = max(i for i, s in enumerate(sizes) if start < s)
            stop = min(start + min(BATCH, start), sizes[level])
            graph._insert(start, stop, level)
            start = stop
        return graph

    def _insert(self, start: int, stop: int, level: int) -> None:
        new = self.unit[start:stop]
        within = 1 - new @ new.T
        np.fill_diagonal(within, np.inf)
        entry = np.zeros((stop - start, 1), np.int32)
        for layer in range(len(self.layers) - 1, -1, -1):
            ids, far = self.search_layer(new, layer, entry, EF_BUILD if layer <= level else 8)
            entry = ids[:, :8]
            if layer > level:
                continue
            m = min(EF_BUILD // 4, stop - start - 1)
            if m > 0:  # the batch's own nearest are candidates, too
                own = np.argpartition(within, m - 1, axis=1)[:, :m]
                ids = np.concatenate([ids, (own + start).astype(np.int32)], axis=1)
                far = np.concatenate([far, np.take_along_axis(within, own, 1)], axis=1)
            picked, dist = self._select(ids, far, DEGREE)
            self.layers[layer][start:stop, :DEGREE] = picked
            self._link_back(layer, start, picked, dist)

    def _select(self, ids: np.ndarray, far: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        """Diverse neighbours: a candidate counts if no picked one is closer to it; free places go to the nearest left."""
        order = np.argsort(far, axis=1, kind="stable")
        ids, far = np.take_along_axis(ids, order, 1), np.take_along_axis(far, order, 1)
        vectors = self.unit[np.maximum(ids, 0)]
        cross = 1 - vectors @ vectors.transpose(0, 2, 1)
        rows, width = ids.shape
        closest = np.full((rows, width), np.inf, np.float32)
        chosen, n = np.zeros((rows, width), bool), np.zeros(rows, np.int64)
        for c in range(width):
            ok = (ids[:, c] >= 0) & (far[:, c] < closest[:, c]) & (n < most) & np.isfinite(far[:, c])
            chosen[:, c] = ok
            n += ok
            closest[ok] = np.minimum(closest[ok], cross[ok, c])
        rank = np.where(chosen, 0, 1) + np.where((ids < 0) | ~np.isfinite(far), 2, 0)
        order = np.argsort(rank, axis=1, kind="stable")[:, :most]
        out, dist = np.take_along_axis(ids, order, 1), np.take_along_axis(far, order, 1)
        bad = np.take_along_axis(rank, order, 1) > 1
        out, dist = np.where(bad, -1, out).astype(np.int32), np.where(bad, np.inf, dist).astype(np.float32)
        if out.shape[1] < most:
            pad = most - out.shape[1]
            out, dist = np.pad(out, ((0, 0), (0, pad)), constant_values=-1), np.pad(dist, ((0, 0), (0, pad)), constant_values=np.inf)
        return out, dist

    def _link_back(self, layer: int, start: int, picked: np.ndarray, dist: np.ndarray) -> None:
        links, width = self.layers[layer], self.layers[layer].shape[1]
        to, far = picked.ravel(), dist.ravel()
        by = np.repeat(np.arange(start, start + len(picked), dtype=np.int32), picked.shape[1])
        keep = to >= 0
        to, far, by = to[keep], far[keep], by[keep]
        order = np.lexsort((far, to))
        to, far, by = to[order], far[order], by[order]
        nodes, first = np.unique(to, return_index=True)
        rank = np.arange(len(to)) - np.repeat(first, np.diff(np.append(first, len(to))))
        keep = rank < DEGREE
        add = np.full((len(nodes), DEGREE), -1, np.int32)
        add_far = np.full((len(nodes), DEGREE), np.inf, np.float32)
        row = np.searchsorted(nodes, to[keep])
        add[row, rank[keep]], add_far[row, rank[keep]] = by[keep], far[keep]
        old = links[nodes]
        old_far = np.where(old >= 0, 1 - np.einsum("nd,nmd->nm", self.unit[nodes], self.unit[np.maximum(old, 0)]), np.inf).astype(np.float32)
        twice = (add[:, :, None] == old[:, None, :]).any(axis=2) | (add == nodes[:, None])
        add[twice], add_far[twice] = -1, np.inf
        ids, far = np.concatenate([old, add], axis=1), np.concatenate([old_far, add_far], axis=1)
        full = (ids >= 0).sum(axis=1) > width
        order = np.argsort(np.where(ids >= 0, far, np.inf), axis=1, kind="stable")[:, :width]
        links[nodes] = np.take_along_axis(ids, order, 1)
        if full.any():
            links[nodes[full]] = self._select(ids[full], far[full], width)[0]

    def search_layer(self, queries: np.ndarray, layer: int, entry: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
        """Beams of ``ef`` nodes (-1 where there are fewer), nearest first; all queries advance together."""
        links, rows = self.layers[layer], len(queries)
        each = np.arange(rows)[:, None]
        seen = np.zeros((rows, len(links) + 1), bool)
        ids = np.full((rows, ef), -1, np.int32)
        far = np.full((rows, ef), np.inf, np.float32)
        width = min(entry.shape[1], ef)
        ids[:, :width] = entry[:, :width]
        far[:, :width] = np.where(entry[:, :width] >= 0, 1 - np.einsum("nd,nmd->nm", queries, self.unit[np.maximum(entry[:, :width], 0)]), np.inf)
        seen[each, ids] = True
        done = ids < 0
        while True:
            open_far = np.where(done, np.inf, far)
            take = np.argpartition(open_far, min(EXPAND, ef) - 1, axis=1)[:, :EXPAND] if ef > EXPAND else np.argsort(open_far, axis=1)
            live = np.isfinite(np.take_along_axis(open_far, take, 1))
            if not live.any():
                order = np.argsort(far, axis=1, kind="stable")
                return np.take_along_axis(ids, order, 1), np.take_along_axis(far, order, 1)
            np.put_along_axis(done, take, True, 1)
            nodes = np.where(live, np.take_along_axis(ids, take, 1), -1)
            found = np.where(nodes[:, :, None] >= 0, links[np.maximum(nodes, 0)], -1).reshape(rows, -1)
            found = np.where(seen[each, found], -1, found)
            found.sort(axis=1)
            found[:, 1:][found[:, 1:] == found[:, :-1]] = -1
            seen[each, found] = True
            active = np.flatnonzero((found >= 0).any(axis=1))
            if not len(active):
                continue
            part = found[active]
            part_far = np.where(part >= 0, 1 - np.einsum("nd,nmd->nm", queries[active], self.unit[np.maximum(part, 0)]), np.inf).astype(np.float32)
            all_ids, all_far, all_done = np.concatenate([ids[active], part], 1), np.concatenate([far[active], part_far], 1), np.concatenate([done[active], part < 0], 1)
            best = np.argpartition(all_far, ef - 1, axis=1)[:, :ef]
            ids[active], far[active], done[active] = np.take_along_axis(all_ids, best, 1), np.take_along_axis(all_far, best, 1), np.take_along_axis(all_done, best, 1)

    def search(self, queries: np.ndarray, ef: int = EF_SEARCH) -> np.ndarray:
        entry = np.zeros((len(queries), 1), np.int32)
        for layer in range(len(self.layers) - 1, -1, -1):
            entry, _ = self.search_layer(queries, layer, entry[:, :8], 16 if layer else ef)
        return entry


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    wide = vectors.astype(np.float64)
    scale = np.abs(wide).max(axis=1, keepdims=True)
    wide = wide / scale
    return (wide / np.sqrt((wide * wide).sum(axis=1, keepdims=True))).astype(np.float32)


def _vectors(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for group in groups(batches, ["dim", "shard"]):
        dim, shard = group.column("dim")[0].as_py(), group.column("shard")[0].as_py()
        ids, vectors = group.column("vec_id").to_numpy(), _vectors(group.column("vector"), dim)
        order = np.lexsort((*vectors.T[::-1], ids))
        order = order[np.concatenate([[True], ids[order][1:] != ids[order][:-1]])]  # ascending ids, the smallest vector of each
        ids, vectors = ids[order], vectors[order]
        raw = np.ascontiguousarray(vectors + 0.0).view(np.dtype((np.void, 8 * dim))).ravel()
        _, first, node = np.unique(raw, return_index=True, return_inverse=True)
        shuffle = np.random.default_rng(len(first)).permutation(len(first))
        place = np.empty(len(first), np.int32)
        place[shuffle] = np.arange(len(first))
        nodes = vectors[first[shuffle]]
        graph = Graph.build(unit_rows(nodes))
        yield pa.RecordBatch.from_arrays(
            [pa.array([dim]), pa.array([shard]), pa.array([len(nodes)])] + [pa.array([x.tobytes()], pa.binary()) for x in (ids.astype("<i8"), place[node].astype("<i4"), nodes.astype("<f8"), np.array([x.shape for x in graph.layers], "<i4"), np.concatenate([x.ravel() for x in graph.layers]).astype("<i4"))],
            [x.split()[0] for x in INDEX_SCHEMA.split(", ")],
        )


def load_index(row: dict) -> tuple[Graph, np.ndarray, np.ndarray, np.ndarray]:
    """(graph, vectors of the nodes, ids sorted by node then id, start of each node's ids)."""
    vectors = np.frombuffer(row["vectors"], "<f8").reshape(-1, row["dim"])
    shapes = np.frombuffer(row["layers"], "<i4").reshape(-1, 2)
    flat, layers, at = np.frombuffer(row["neighbours"], "<i4"), [], 0
    for n, m in shapes.tolist():
        layers.append(flat[at : at + n * m].reshape(n, m))
        at += n * m
    ids, node = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["node_of"], "<i4")
    order = np.lexsort((ids, node))
    return Graph(unit_rows(vectors), layers), vectors, ids[order], np.searchsorted(node[order], np.arange(len(vectors) + 1))


def _search(k: int, ef: int):
    def run(index: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[tuple[int, int, float]] = []
        for row in index.to_pylist() if queries.num_rows else []:
            graph, vectors, ids, start = load_index(row)
            length = np.sqrt((vectors * vectors).sum(axis=1))
            asked, wanted = queries.column("query_id").to_numpy(), _vectors(queries.column("vector"), row["dim"])
            for at in range(0, len(asked), BATCH):
                part = wanted[at : at + BATCH]
                found = graph.search(unit_rows(part), ef)
                for q, vector, nodes in zip(asked[at : at + BATCH].tolist(), part, found, strict=True):
                    nodes = nodes[nodes >= 0]
                    score = (vectors[nodes] * vector).sum(axis=1) / (length[nodes] * math.sqrt(float((vector * vector).sum())))
                    hits = [(-s, i, s) for n, s in zip(nodes.tolist(), score.tolist(), strict=True) for i in [x for x in ids[start[n] : min(start[n + 1], start[n] + k + 1)].tolist() if x != q]]
                    out.extend((q, i, s) for _, i, s in sorted(hits)[:k])
        a, b, c = zip(*out, strict=True) if out else ((), (), ())
        return pa.table({"query_id": pa.array(a, pa.int64()), "vec_id": pa.array(b, pa.int64()), "score": pa.array(c, pa.float64())})

    return run


def usable(rows: DataFrame, vec_id: str, vector: str) -> DataFrame:
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    rows = rows.select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("vector")).filter("vec_id is not null and vector is not null")
    return rows.filter(~F.exists("vector", odd) & F.exists("vector", lambda x: x != 0)).withColumn("dim", F.size("vector").cast("long"))


def build_index(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row per shard; every usable row is in it. Only a count per dimension comes to the driver."""
    good = usable(rows, vec_id, vector)
    counts = good.groupBy("dim").agg(F.ceil(F.count(F.lit(1)) / shard_rows).cast("long").alias("shards"))
    dealt = good.join(F.broadcast(counts) if counts.count() <= 1000 else counts, "dim").withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.col("shards")))
    total = counts.agg(F.sum("shards")).first()[0] or 1
    built = dealt.select("dim", "shard", "vec_id", "vector").repartitionByRange(int(total), "dim", "shard").sortWithinPartitions("dim", "shard")
    return materialize(built.mapInArrow(_build, INDEX_SCHEMA), "graphs")


def nearest(queries: DataFrame, index: DataFrame, k: int = K, ef: int = EF_SEARCH, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) of the k nearest found for each query row."""
    asked = usable(queries, vec_id, vector).groupBy("vec_id").agg(F.min("vector").alias("vector")).select(F.col("vec_id").alias("query_id"), "vector", F.size("vector").cast("long").alias("dim"))
    asked = materialize(asked, "queries")
    blocks = max(1, math.ceil(asked.count() / QUERY_BLOCK))
    shards = index.select(F.col("dim").alias("dim"), F.col("shard").alias("shard"))
    sent = asked.join(shards, "dim").withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)))
    graphs = index.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    keys = ["dim", "shard", "block"]
    found = graphs.groupBy(*keys).cogroup(sent.groupBy(*keys)).applyInArrow(_search(k, ef), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4_vector_graphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return nearest(rows.filter(F.col("vec_id") % EVERY == 0), build_index(rows))
