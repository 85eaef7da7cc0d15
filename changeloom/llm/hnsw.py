"""Approximate nearest neighbours: a navigable small-world graph per shard, as flat neighbour arrays, with merged results."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from changeloom.llm.common import materialize

#: Neighbours of a node above the ground layer (twice as many on it), width of the search while building and while answering.
LINKS, BUILD_WIDTH, SEARCH_WIDTH = 16, 96, 192
#: Vectors of a shard at most, shards at least, nodes linked at a time, queries answered at a time and by one task.
SHARD, SHARDS, BATCH, BLOCK, GROUP = 50_000, 8, 256, 512, 1 << 15
_F = np.float32


class Layer:
    """One layer: a row of neighbour numbers for each node number, -1 where there is none."""

    def __init__(self, n: int, width: int):
        self.links = np.full((n, width), -1, np.int32)
        self.nodes = np.zeros(0, np.int64)


def search(x: np.ndarray, off: np.ndarray, layer: Layer, queries: np.ndarray, entry: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``width`` best nodes found for each query by following links from its entries; best first, -1 where fewer were found.

    Best is the largest inner product less what ``off`` says of the node.
    """
    n, rows = len(queries), np.arange(len(queries))[:, None]
    seen = np.zeros((n, len(x)), bool)
    beam = np.full((n, width), -1, np.int64)
    score = np.full((n, width), -np.inf, _F)
    k = entry.shape[1]
    beam[:, :k] = entry
    valid = entry >= 0
    score[:, :k] = np.where(valid, np.einsum("qd,qkd->qk", queries, x[np.maximum(entry, 0)]) - off[np.maximum(entry, 0)], -np.inf)
    seen[np.nonzero(valid)[0], entry[valid]] = True
    opened = np.zeros((n, width), bool)
    live = np.arange(n)
    while len(live):
        wait = np.where(opened[live] | (beam[live] < 0), -np.inf, score[live])
        best = wait.argmax(axis=1)
        more = wait[np.arange(len(live)), best] > -np.inf
        live, best = live[more], best[more]
        if not len(live):
            break
        opened[live, best] = True
        near = layer.links[beam[live, best]].astype(np.int64)
        fresh = (near >= 0) & ~seen[live[:, None], np.maximum(near, 0)]
        seen[np.repeat(live, fresh.sum(axis=1)), near[fresh]] = True
        near = np.where(fresh, near, -1)
        new = np.where(fresh, np.einsum("qd,qkd->qk", queries[live], x[np.maximum(near, 0)]) - off[np.maximum(near, 0)], -np.inf).astype(_F)
        both = np.concatenate([score[live], new], axis=1)
        keep = np.argpartition(-both, width - 1, axis=1)[:, :width]
        at = np.arange(len(live))[:, None]
        score[live] = both[at, keep]
        beam[live] = np.concatenate([beam[live], near], axis=1)[at, keep]
        opened[live] = np.concatenate([opened[live], np.zeros_like(fresh)], axis=1)[at, keep]
    order = np.argsort(-score, axis=1, kind="stable")
    return np.where(np.isfinite(score[rows, order]), beam[rows, order], -1), score[rows, order]


def diverse(x: np.ndarray, half: np.ndarray, of: np.ndarray, near: np.ndarray, most: int) -> np.ndarray:
    """At most ``most`` of each row's candidates (best first): those nearer to the node than to one taken before, then the best of the rest. ``half`` is half of each node's squared length."""
    v, h = x[np.maximum(near, 0)], half[np.maximum(near, 0)]
    own = np.where(near >= 0, np.einsum("nd,nkd->nk", x[of], v) - h - half[of][:, None], -np.inf)
    order = np.argsort(-own, axis=1, kind="stable")
    rows = np.arange(len(of))[:, None]
    near, own, v, h = near[rows, order], own[rows, order], v[rows, order], h[rows, order]
    taken = np.zeros(near.shape, bool)
    blocked = np.full(near.shape, -np.inf, _F)
    for k in range(near.shape[1]):
        take = (near[:, k] >= 0) & (own[:, k] > blocked[:, k]) & (taken.sum(axis=1) < most)
        taken[:, k] = take
        if take.any():
            beside = np.einsum("nd,nkd->nk", v[:, k], v) - h - h[:, k, None]
            blocked = np.where(take[:, None], np.maximum(blocked, beside), blocked)
    rank = np.where(taken, 0, 1) * near.shape[1] + np.arange(near.shape[1])
    rank = np.where(near >= 0, rank, 10**6)
    first = np.argsort(rank, axis=1, kind="stable")[:, :most]
    out = near[rows, first]
    return np.pad(out, ((0, 0), (0, most - out.shape[1])), constant_values=-1)


class Graph:
    """A hierarchical navigable small-world graph over the rows of a matrix, for inner products."""

    def __init__(self, vectors: np.ndarray):
        self._place(vectors)
        n = len(self.x)
        level = np.minimum(-np.log(1 - np.random.default_rng(5).random(n)) / math.log(LINKS), 8).astype(int)
        self.layers = [Layer(n, LINKS * 2)] + [Layer(n, LINKS) for _ in range(int(level.max(initial=0)))]
        order = np.random.default_rng(6).permutation(n)
        at = 0
        while at < n:
            some = order[at : at + min(BATCH, max(1, at // 2))]
            self._add(some, level[some])
            at += len(some)

    def _place(self, vectors: np.ndarray) -> None:
        """Vectors get one more dimension that makes them equally long, so that the largest inner product is the smallest distance.

        That dimension is counted from the common length, which leaves distances as they are and keeps the numbers of ordinary vectors small beside a very long one.
        """
        norm = (vectors.astype(np.float64) ** 2).sum(axis=1)
        top = norm.max(initial=0)
        more = -norm / np.maximum(np.sqrt(top) + np.sqrt(np.maximum(top - norm, 0)), 1e-300)
        self.x = np.concatenate([vectors, more[:, None]], axis=1).astype(_F)
        self.half = ((norm + more**2) / 2).astype(_F)

    @classmethod
    def stored(cls, vectors: np.ndarray, layers: list[tuple[bytes, bytes]]) -> Graph:
        """A graph from its vectors and the stored links and nodes of its layers."""
        graph = cls.__new__(cls)
        graph._place(vectors)
        graph.layers = []
        for links, nodes in layers:
            layer = Layer(0, 1)
            layer.links, layer.nodes = np.frombuffer(links, np.int32).reshape(len(vectors), -1), np.frombuffer(nodes, np.int64)
            graph.layers.append(layer)
        return graph

    def _descend(self, queries: np.ndarray, off: np.ndarray, down_to: int) -> np.ndarray:
        top = max((k for k, layer in enumerate(self.layers) if len(layer.nodes)), default=0)
        entry = np.full((len(queries), 1), self.layers[top].nodes[0] if len(self.layers[top].nodes) else -1)
        for k in range(top, down_to, -1):
            entry = search(self.x, off, self.layers[k], queries, entry, 1)[0]
        return entry

    def _add(self, nodes: np.ndarray, level: np.ndarray) -> None:
        for k, layer in enumerate(self.layers):
            here = nodes[level >= k]
            if not len(here):
                continue
            width = layer.links.shape[1]
            q = self.x[here]
            beside = q @ q.T - self.half[here]
            np.fill_diagonal(beside, -np.inf)
            take = min(len(here), LINKS)
            mates = np.argsort(-beside, axis=1)[:, :take]
            found = np.where(np.take_along_axis(beside, mates, 1) > -np.inf, here[mates], -1)
            if len(layer.nodes):
                old, _ = search(self.x, self.half, layer, q, self._descend(q, self.half, k), min(BUILD_WIDTH, len(layer.nodes)))
                found = np.concatenate([old, found], axis=1)
            chosen = diverse(self.x, self.half, here, found, LINKS)
            layer.links[here, :LINKS] = chosen
            source, to = np.repeat(here, LINKS)[chosen.ravel() >= 0], chosen.ravel()[chosen.ravel() >= 0]
            self._link_back(layer, to, source, width)
            layer.nodes = np.concatenate([layer.nodes, here])

    def _link_back(self, layer: Layer, nodes: np.ndarray, new: np.ndarray, width: int) -> None:
        order = np.argsort(nodes, kind="stable")
        nodes, new = nodes[order], new[order]
        each, first, count = np.unique(nodes, return_index=True, return_counts=True)
        more = np.full((len(each), count.max(initial=0)), -1, np.int64)
        more[np.repeat(np.arange(len(each)), count), np.arange(len(nodes)) - np.repeat(first, count)] = new
        links = layer.links[each].astype(np.int64)
        more = np.where((more[:, :, None] == links[:, None, :]).any(axis=2), -1, more)
        layer.links[each] = diverse(self.x, self.half, each, np.concatenate([links, more], axis=1), width)

    def nearest(self, queries: np.ndarray, width: int) -> np.ndarray:
        """Node numbers for each query by inner product, best first, -1 where fewer were found."""
        q, none = np.concatenate([queries, np.zeros((len(queries), 1))], axis=1).astype(_F), np.zeros(len(self.x), _F)
        return search(self.x, none, self.layers[0], q, self._descend(q, none, 0), min(width, len(self.x)))[0]


def _matrix(column: pa.Array, kind) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(kind)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _by_length(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, pa.Array]]:
    """Ids and vectors of each length in a batch."""
    for part in parts:
        length = pc.list_value_length(part.column(1)).to_numpy()
        for k in np.unique(length):
            some = pa.array(np.flatnonzero(length == k))
            yield int(k), part.column(0).take(some).to_numpy(), part.column(1).take(some)


def _distinct(parts: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Distinct vectors of a partition with their smallest ids."""
    for _, ids, vectors in _by_length(parts):
        x = _matrix(vectors, np.float64)
        _, which = np.unique(x, axis=0, return_inverse=True)
        order = np.lexsort((ids, which.ravel()))
        cut = np.flatnonzero(np.diff(which.ravel()[order])) + 1
        groups = np.split(order, cut)
        yield pa.RecordBatch.from_arrays([vectors.take(pa.array([g[0] for g in groups])), pa.array([np.unique(ids[g])[:most].tolist() for g in groups], pa.list_(pa.int64()))], names=["vector", "ids"])


def _build(part: pa.Table) -> pa.Table:
    part = part.combine_chunks()
    x = _matrix(part.column("vector").combine_chunks() if part.num_rows else pa.array([], pa.list_(pa.float64())), np.float64)
    ids = part.column("ids").to_pylist()
    graph = Graph(x)
    flat = np.concatenate([np.array(i, np.int64) for i in ids])
    layers = [layer.links.tobytes() for layer in graph.layers]
    nodes = [layer.nodes.astype(np.int64).tobytes() for layer in graph.layers]
    columns = [[x.shape[1]], [part.column("shard")[0].as_py()], [len(x)], [x.tobytes()], [flat.tobytes()], [np.array([len(i) for i in ids], np.int64).tobytes()], [layers], [nodes]]
    return pa.table({n: pa.array(c, t) for n, c, t in zip(_INDEX, columns, (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.binary()), pa.list_(pa.binary())), strict=True)})


_INDEX = ["length", "shard", "n", "vectors", "ids", "counts", "links", "nodes"]
_INDEX_SCHEMA = "length int, shard int, n long, vectors binary, ids binary, counts binary, links array<binary>, nodes array<binary>"


def index(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", most: int = 21) -> DataFrame:
    """A row per length of vectors and shard: its distinct vectors, the smallest ``most`` ids of each, and the graph's flat neighbour arrays.

    Every vector is indexed. Equal vectors are one node, combined in each partition before the shuffle, so a vector that a third of the
    rows share is one node of one shard.
    """
    good = clean(df, id_col, vector_col)
    ids = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, most)
    nodes = materialize(good.mapInArrow(partial(_distinct, most=most), "vector array<double>, ids array<long>").groupBy("vector").agg(ids.alias("ids")))
    shards = max(SHARDS, math.ceil(nodes.count() / SHARD))
    return materialize(nodes.withColumn("shard", F.pmod(F.xxhash64("vector"), F.lit(shards)).cast("int")).groupBy(F.size("vector").alias("length"), "shard").applyInArrow(_build, _INDEX_SCHEMA))


def clean(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``id, vector`` of the rows that take part; of those that repeat an id the vector that sorts last."""
    v = F.col(vector_col).cast("array<double>")
    fine = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))) & F.exists(v, lambda c: c != 0)
    zero = F.transform(v, lambda c: F.when(c == 0, 0.0).otherwise(c))
    good = df.select(F.col(id_col).cast("long").alias("id"), zero.alias("vector")).where(F.col("id").isNotNull() & F.coalesce(fine, F.lit(False)))
    if good.groupBy("id").count().where("count > 1").isEmpty():
        return good
    return good.groupBy("id").agg(F.max("vector").alias("vector"))


def _blocks(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Queries of one length in blocks of BLOCK at most."""
    for length, ids, vectors in _by_length(parts):
        for k in range(0, len(ids), BLOCK):
            x = _matrix(vectors.slice(k, BLOCK), np.float64)
            yield pa.RecordBatch.from_arrays([pa.array([length], pa.int32()), pa.array([ids[k : k + BLOCK].tobytes()], pa.binary()), pa.array([x.tobytes()], pa.binary())], names=["length", "query_ids", "queries"])


def _answer(queries: pa.Table, shard: pa.Table, top: int, width: int) -> pa.Table:
    """The best of one shard for the queries of a group: the index is read once, and queries pass it in blocks."""
    out = []
    if queries.num_rows and shard.num_rows:
        (row,) = shard.to_pylist()
        x, counts, flat = np.frombuffer(row["vectors"], np.float64).reshape(row["n"], -1), np.frombuffer(row["counts"], np.int64), np.frombuffer(row["ids"], np.int64)
        start, graph = np.cumsum(counts) - counts, Graph.stored(x, list(zip(row["links"], row["nodes"], strict=True)))
        qids = np.concatenate([np.frombuffer(b, np.int64) for b in queries.column("query_ids").to_pylist()])
        asked = np.concatenate([np.frombuffer(b, np.float64) for b in queries.column("queries").to_pylist()]).reshape(len(qids), -1)
        for k in range(0, len(qids), BLOCK):
            for qid, q, near in zip(qids[k : k + BLOCK], asked[k : k + BLOCK], graph.nearest(asked[k : k + BLOCK], width), strict=True):
                near = near[near >= 0]
                score = (x[near] * q).sum(axis=1)
                keep = np.argsort(-score, kind="stable")[: top + 1]
                keep = np.flatnonzero(score >= score[keep[-1]]) if len(keep) else keep
                near, score = near[keep], score[keep]
                ids = np.concatenate([flat[start[k] : start[k] + counts[k]] for k in near]) if len(near) else np.zeros(0, np.int64)
                value = np.repeat(score, counts[near])
                other = ids != qid
                ids, value = ids[other], value[other]
                first = np.lexsort((ids, -value))[:top]
                out.append((np.full(len(first), qid), ids[first], value[first]))
    columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
    return pa.table(columns, names=["query_id", "vec_id", "score"])


def nearest(df: DataFrame, queries: DataFrame, top: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", width: int = SEARCH_WIDTH) -> DataFrame:
    """The ``top`` vectors of largest inner product found for each query: ``query_id, rank, vec_id, score``; a query's own id is left out.

    Ranks start at 1; equal scores go to the smaller id; the score is in double precision on the vectors as given. Rows with a null id, and vectors that
    are null, zero, empty, or hold null or non-finite components, take no part on either side. Of rows that repeat
    an id the vector that sorts last counts, as candidate and as query. A query is compared with the vectors of its own length only. Fewer candidates than ``top`` give fewer rows; empty tables
    give an empty table. Other columns are ignored.

    Queries go to every shard in groups of about GROUP; a task has one shard's index, once, and one group. Each answers from the graph
    with a beam of ``width``, and the answers are merged by query.
    """
    shards = index(df, id_col, vector_col, top + 1)
    asked = clean(queries, id_col, vector_col)
    blocks = materialize(asked.mapInArrow(_blocks, "length int, query_ids binary, queries binary"))
    groups = max(1, math.ceil((blocks.agg(F.sum(F.octet_length("query_ids"))).first()[0] or 0) / 8 / GROUP))
    which = shards.select("length", "shard").collect()
    keys = df.sparkSession.createDataFrame([tuple(w) for w in which], "length int, shard int")
    each = blocks.withColumn("group", F.pmod(F.xxhash64("query_ids"), F.lit(groups)).cast("int")).join(F.broadcast(keys), "length")
    index_of = shards.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    key = ["length", "shard", "group"]
    found = each.groupBy(*key).cogroup(index_of.groupBy(*key)).applyInArrow(partial(_answer, top=top, width=width), "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")
