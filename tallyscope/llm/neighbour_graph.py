"""Nearest neighbours by hierarchical navigable small-world graphs, one per shard.

Distinct vectors are dealt over shards of bounded size. Each shard gets a layered graph kept as
flat neighbour arrays in a table, so it is built once and read by every block of queries. Nodes
enter in batches, highest level first, and all searches of a batch walk side by side in numpy: a
beam per query, several expansions a step. Neighbours are chosen by the usual rule that a candidate
must be nearer to the node than to those already chosen. Shard results carry exact double-precision
cosines and are merged by rank.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tallyscope.llm.common import keep

SHARD = 4096
BLOCK = 1024
LINKS = 16
BUILD_WIDTH = 64
SEARCH_WIDTH = 128
BATCH = 256
#: Nodes a beam expands in one step.
STRIDE = 4


#: Cosines this close may be ties once taken in double precision.
TIE = 1e-6


class Graph:
    """Vectors of a shard with, per layer, the member nodes and their neighbours (-1: none)."""

    def __init__(self, vectors: np.ndarray) -> None:
        self.vectors = vectors
        norms = np.linalg.norm(vectors.astype(np.float64), axis=1, keepdims=True)
        self.unit = (vectors / norms).astype(np.float32)
        self.layers: list[np.ndarray] = []
        self.entry = 0

    def search_layer(self, queries: np.ndarray, entries: np.ndarray, links: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Nodes (-1: none) and similarities of the beams, nearest first, for unit query rows."""
        n_q, n = len(queries), len(self.unit)
        seen = np.full((n_q, n), -1, np.int16)
        nodes = np.full((n_q, width), -1, np.int64)
        near = np.full((n_q, width), -np.inf, np.float32)
        fresh = np.zeros((n_q, width), bool)
        entries = entries[:, :width]
        k = entries.shape[1]
        rows = np.repeat(np.arange(n_q), k)
        nodes[:, :k] = entries
        near[:, :k] = np.einsum("qkd,qd->qk", self.unit[entries], queries)
        near[:, :k][entries < 0] = -np.inf
        fresh[:, :k] = entries >= 0
        seen[rows[entries.ravel() >= 0], entries.ravel()[entries.ravel() >= 0]] = 0
        going = np.arange(n_q)
        order = np.argsort(-near, axis=1, kind="stable")
        nodes, near, fresh = (np.take_along_axis(x, order, 1) for x in (nodes, near, fresh))
        columns = np.arange(STRIDE * links.shape[1], dtype=np.int16)
        while len(going):
            some = fresh[going]
            going = going[some.any(1)]
            if not len(going):
                break
            some = fresh[going]
            rank = np.cumsum(some, axis=1)
            chosen = some & (rank <= STRIDE)
            fresh[going] = some & ~chosen
            where = np.argsort(~chosen, axis=1, kind="stable")[:, :STRIDE]
            taken = np.take_along_axis(chosen, where, 1)
            from_nodes = np.where(taken, np.take_along_axis(nodes[going], where, 1), -1)
            around = np.where(from_nodes[:, :, None] >= 0, links[from_nodes], -1).reshape(len(going), -1)
            unseen = (around >= 0) & (seen[going[:, None], around] < 0)
            row, column = np.nonzero(unseen)
            found = around[row, column]
            seen[going[row], found] = columns[column]
            once = seen[going[row], found] == columns[column]
            row, column, found = row[once], column[once], found[once]
            close = np.einsum("ij,ij->i", self.unit[found], queries[going[row]])
            more = np.full(around.shape, -np.inf, np.float32)
            more[row, column] = close
            all_near = np.concatenate([near[going], more], axis=1)
            best = np.argsort(-all_near, axis=1, kind="stable")[:, :width]
            near[going] = np.take_along_axis(all_near, best, 1)
            nodes[going] = np.take_along_axis(np.concatenate([nodes[going], around], axis=1), best, 1)
            fresh[going] = np.take_along_axis(np.concatenate([fresh[going], np.isfinite(more)], axis=1), best, 1)
        nodes[~np.isfinite(near)] = -1
        return nodes, near

    def descend(self, queries: np.ndarray, to_layer: int) -> np.ndarray:
        """Entry nodes for ``to_layer``: the best found in each layer above it."""
        at = np.full((len(queries), 1), self.entry, np.int64)
        for layer in range(len(self.layers) - 1, to_layer, -1):
            at = self.search_layer(queries, at, self.layers[layer], 4)[0][:, :1]
        return at

    def _choose(self, near: np.ndarray, nodes: np.ndarray, most: int) -> np.ndarray:
        """Up to ``most`` of each row's candidates (nearest first) by the diversity rule, then the nearest others."""
        vectors = self.unit[nodes]
        pairs = vectors @ vectors.transpose(0, 2, 1)
        kept = np.zeros(nodes.shape, bool)
        closest = np.full(nodes.shape, -np.inf, np.float32)
        for j in range(nodes.shape[1]):
            take = (nodes[:, j] >= 0) & (closest[:, j] < near[:, j]) & (kept.sum(1) < most)
            kept[:, j] = take
            closest = np.where(take[:, None], np.maximum(closest, pairs[:, j]), closest)
        order = np.argsort(np.where(kept, 0, np.where(nodes >= 0, 1, 2)), axis=1, kind="stable")[:, :most]
        out = np.take_along_axis(nodes, order, 1)
        return np.pad(out, ((0, 0), (0, most - out.shape[1])), constant_values=-1) if out.shape[1] < most else out

    def _link(self, layer: int, new: np.ndarray, near: np.ndarray, nodes: np.ndarray) -> None:
        """Give new nodes their neighbours and add the links back."""
        links = self.layers[layer]
        most = links.shape[1]
        links[new] = chosen = self._choose(near, nodes, most)
        row, column = np.nonzero(chosen >= 0)
        target, source = chosen[row, column], new[row]
        order = np.argsort(target, kind="stable")
        target, source = target[order], source[order]
        hit, first, count = np.unique(target, return_index=True, return_counts=True)
        wide = np.full((len(hit), most + int(count.max(initial=0))), -1, np.int64)
        wide[:, :most] = links[hit]
        place = np.arange(len(target)) - np.repeat(first, count)
        wide[np.repeat(np.arange(len(hit)), count), most + place] = source
        close = np.where(wide >= 0, np.einsum("ikd,id->ik", self.unit[wide], self.unit[hit]), -np.inf)
        order = np.argsort(-close, axis=1, kind="stable")[:, :2 * most]
        close, wide = np.take_along_axis(close, order, 1), np.take_along_axis(wide, order, 1)
        repeated = np.zeros(wide.shape, bool)
        repeated[:, 1:] = (wide[:, 1:] == wide[:, :-1]) & (wide[:, 1:] >= 0)
        wide = np.where(repeated, -1, wide)
        full = (wide >= 0).sum(1) > most
        if full.any():
            links[hit[full]] = self._choose(np.where(wide >= 0, close, -np.inf)[full], wide[full], most)
        rest = wide[~full]
        order = np.argsort(rest < 0, axis=1, kind="stable")[:, :most]
        links[hit[~full]] = np.take_along_axis(rest, order, 1)

    def build(self, seed: int) -> "Graph":
        n = len(self.unit)
        rng = np.random.default_rng(seed)
        level = np.floor(-np.log(1 - rng.random(n)) / np.log(LINKS)).astype(np.int64)
        order = np.lexsort((rng.random(n), -level))
        top = int(level.max())
        self.layers = [np.full((n, LINKS if layer else 2 * LINKS), -1, np.int64) for layer in range(top + 1)]
        self.entry = int(order[0])
        at = 1
        while at < n:
            height = int(level[order[at]])
            same = int(np.searchsorted(-level[order], -height, side="right"))
            new = order[at:min(at + max(1, min(at, BATCH)), same)]
            queries = self.unit[new]
            mates = queries @ queries.T
            np.fill_diagonal(mates, -np.inf)
            mates[np.triu_indices(len(new))] = -np.inf
            entries = self.descend(queries, height)
            for layer in range(height, -1, -1):
                nodes, near = self.search_layer(queries, entries, self.layers[layer], BUILD_WIDTH)
                entries = nodes[:, :8]
                every = np.concatenate([near, mates], axis=1)
                names = np.concatenate([nodes, np.broadcast_to(new, mates.shape)], axis=1)
                best = np.argsort(-every, axis=1, kind="stable")[:, :BUILD_WIDTH]
                near = np.take_along_axis(every, best, 1)
                self._link(layer, new, near, np.where(np.isfinite(near), np.take_along_axis(names, best, 1), -1))
            at += len(new)
        self._reach()
        return self

    def _reach(self) -> None:
        """Link every node that the bottom layer cannot reach from a node that it links to."""
        links, n = self.layers[0], len(self.unit)
        for _ in range(n):
            reached = np.zeros(n, bool)
            reached[self.entry] = True
            front = np.array([self.entry])
            while len(front):
                around = links[front]
                around = np.unique(around[around >= 0])
                front = around[~reached[around]]
                reached[front] = True
            lost = np.flatnonzero(~reached)
            if not len(lost):
                return
            near = self.unit[lost[:BATCH]] @ self.unit[reached].T
            best = np.flatnonzero(reached)[near.argmax(1)]
            room = np.full((n, 1), -1, np.int64)
            room[best, 0] = lost[:BATCH]
            links = np.concatenate([links, room], axis=1)
            self.layers[0] = links

    def search(self, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``k`` nearest nodes found (-1: none) and their cosines in double precision."""
        exact = queries.astype(np.float64)
        length = np.linalg.norm(exact, axis=1)
        unit = (exact / length[:, None]).astype(np.float32)
        nodes = np.full((len(exact), k), -1, np.int64)
        cosine = np.full((len(exact), k), -np.inf)
        left, width = np.arange(len(exact)), max(SEARCH_WIDTH, k)
        while len(left):
            beam, _ = self.search_layer(unit[left], self.descend(unit[left], 0), self.layers[0], width)
            found = self.vectors[beam].astype(np.float64)
            near = np.einsum("qkd,qd->qk", found, exact[left]) / (np.linalg.norm(found, axis=2) * length[left, None])
            near = np.where(beam >= 0, near, -np.inf)
            order = np.lexsort((beam, -near), axis=1)  # nodes are numbered by id, so ties go to the smaller one
            beam, near = np.take_along_axis(beam, order, 1), np.take_along_axis(near, order, 1)
            got = min(k, beam.shape[1])
            nodes[left, :got], cosine[left, :got] = beam[:, :got], near[:, :got]
            # a beam full of ties may hide a smaller id: search wider
            full = near[:, -1] >= near[:, got - 1] - TIE if width < len(self.unit) else np.zeros(len(left), bool)
            left, width = left[full], 4 * width
        return nodes, cosine


_GRAPH = ("dim int, shard int, names binary, vectors binary, entry long, widths array<int>, links array<binary>")


def _build(key, rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("head")
    graph = Graph(np.array(rows["embedding"].tolist(), np.float64)).build(int(key[1]))
    return pd.DataFrame([{
        "dim": key[0], "shard": key[1], "names": rows["head"].to_numpy(np.int64).tobytes(),
        "vectors": graph.vectors.tobytes(), "entry": graph.entry, "widths": [x.shape[1] for x in graph.layers],
        "links": [x.astype(np.int32).tobytes() for x in graph.layers]}])


_FOUND = "query long, head long, score double"


def _search(k: int):
    def run(graphs: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(graphs) or not len(queries):
            return pd.DataFrame({"query": np.zeros(0, np.int64), "head": np.zeros(0, np.int64), "score": np.zeros(0)})
        row = graphs.iloc[0]
        graph = Graph(np.frombuffer(row["vectors"], np.float64).reshape(-1, row["dim"]))
        graph.layers = [np.frombuffer(x, np.int32).astype(np.int64).reshape(-1, w) for x, w in zip(row["links"], row["widths"])]
        graph.entry = int(row["entry"])
        names = np.frombuffer(row["names"], np.int64)
        own, parts = queries["query"].to_numpy(np.int64), []
        vectors = np.array(queries["embedding"].tolist(), np.float64)
        for at in range(0, len(own), BATCH):
            nodes, score = graph.search(vectors[at:at + BATCH], k)
            r, c = np.nonzero(nodes >= 0)
            parts.append(pd.DataFrame({"query": own[at:at + BATCH][r], "head": names[nodes[r, c]], "score": score[r, c]}))
        return pd.concat(parts)

    return run


def _usable(vector: Column) -> Column:
    """No nulls or non-finite components, and not all zero."""
    limit = F.lit(float("inf"))
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < limit))
    return vector.isNotNull() & F.coalesce(fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def nearest(vectors: DataFrame, k: int = 5, every: int = 50) -> DataFrame:
    """The ``k`` nearest other vectors, by cosine, of each vector whose vec_id is divisible by ``every``.

    query_id, rank from 1, vec_id, score. Vectors that are null, zero or hold null or non-finite
    components take no part, nor do rows without an id. Equal vectors are one node of the graph;
    its ``k`` + 1 smallest ids stand for it, which is as many as an answer can need. Rows repeating
    id and vector count once; rows with the query's id are its own. Vectors of different length
    are never neighbours. Further columns are ignored; with too few candidates all are returned.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = rows.where(F.col("vec_id").isNotNull()).where(_usable(F.col("embedding")))
    rows = keep(rows.withColumn("key", F.xxhash64("embedding")).distinct(), "vectors")
    same = W.partitionBy("key", "embedding")
    members = keep(
        rows.withColumn("place", F.row_number().over(same.orderBy("vec_id"))).where(F.col("place") <= k + 1)
        .withColumn("head", F.min("vec_id").over(same)), "members")
    heads = members.where("place = 1").select("key", "embedding", "head")
    asked = keep(rows.where(F.col("vec_id") % every == 0).join(heads, ["key", "embedding"]).select(
        F.col("vec_id").alias("query_id"), F.col("head").alias("query")), "asked")
    n, n_q = heads.count(), asked.count()
    shards, blocks = max(-(-n // SHARD), 1), max(-(-n_q // BLOCK), 1)
    dim = F.size("embedding").alias("dim")
    graphs = keep(heads.select("head", "embedding", dim, F.pmod(F.xxhash64("head"), F.lit(shards)).cast("int").alias("shard"))
                  .groupBy("dim", "shard").applyInPandas(_build, _GRAPH), "graphs")
    queries = heads.join(asked.select(F.col("query").alias("head")).distinct(), "head", "left_semi").select(
        F.col("head").alias("query"), "embedding", dim, F.pmod(F.xxhash64(F.col("head"), F.lit(1)), F.lit(blocks)).cast("int").alias("block"),
        F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))
    spread = graphs.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    key = ["dim", "shard", "block"]
    found = spread.groupBy(*key).cogroup(queries.groupBy(*key)).applyInPandas(_search(k + 1), _FOUND)
    best = W.partitionBy("query").orderBy(F.desc("score"), "head")
    merged = keep(found.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k + 1).drop("place"), "merged")
    answer = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        asked.join(merged, "query").join(members.select("head", "vec_id"), "head").where("vec_id <> query_id")
        .withColumn("rank", F.row_number().over(answer)).where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
