"""Approximate nearest neighbours: a robust-pruned directed graph per shard, searched with a beam.

Equal vectors are one node. Nodes are dealt to shards by hash; each shard's graph is built by itself: points are inserted in random
order, a greedy search from the medoid proposes neighbours, and relaxed distance pruning (a neighbour goes if a kept one
is closer to it by the factor ``ALPHA``) keeps diverse edges; back edges are pruned the same way once a node has
twice its degree. A query runs a beam search in every shard; what the beams hold is measured again in double precision on
the original vectors.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reviewloom.llm.common import keep

#: Nodes of a shard on average; a shard is built and searched in one task's memory.
SHARD_NODES = 4096
#: Queries that one task takes through a shard.
QUERY_BLOCK = 512
DEGREE, BUILD_BEAM, BEAM, ALPHA, WIDE = 32, 64, 96, 1.2, 4


def _search(x: np.ndarray, norms: np.ndarray, graph: np.ndarray, start: int, queries: np.ndarray, beam: int):
    """Node numbers and squared distances of the beams, nearest first (-1 where a beam is not full), all queries in step."""
    many, nodes = len(queries), len(x)
    rows = np.arange(many)[:, None]
    seen = np.zeros((many, nodes + 1), bool)
    seen[:, [start, nodes]] = True
    ids = np.full((many, beam), nodes, np.int64)
    dist = np.full((many, beam), np.inf, np.float32)
    opened = np.ones((many, beam), bool)
    own = (queries * queries).sum(1, dtype=np.float32)
    ids[:, 0], opened[:, 0] = start, False
    dist[:, 0] = norms[start] + own - 2 * (queries @ x[start])
    active = np.arange(many)
    while len(active):
        # The nearest nodes of each beam that are not expanded yet.
        order = np.argsort(np.where(opened[active], np.inf, dist[active]), axis=1, kind="stable")[:, :WIDE]
        r = active[:, None]
        fresh = ~opened[r, order]
        opened[r, order] = True
        near = graph[np.where(fresh, ids[r, order], nodes)].reshape(len(active), -1)
        near = np.sort(near, axis=1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = nodes
        near[seen[r, near]] = nodes
        seen[r, near] = True
        room = int((near < nodes).sum(1).max()) if near.size else 0
        if room:
            near = np.sort(near, axis=1)[:, :room]
            at = np.minimum(near, nodes - 1)
            d = norms[at] + own[active][:, None] - 2 * np.matmul(x[at], queries[active][:, :, None])[:, :, 0]
            d[near == nodes] = np.inf
            all_ids, all_d = np.concatenate([ids[active], near], 1), np.concatenate([dist[active], d], 1)
            all_open = np.concatenate([opened[active], near == nodes], 1)
            best = np.argsort(all_d, axis=1, kind="stable")[:, :beam]
            k = np.arange(len(active))[:, None]
            ids[active], dist[active], opened[active] = all_ids[k, best], all_d[k, best], all_open[k, best]
        active = active[~opened[active].all(1)]
    return np.where(np.isfinite(dist), ids, -1), dist


def _prune(x: np.ndarray, point: int, near: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """The kept neighbours of ``point`` among ``near``, nearest first."""
    near = np.unique(near)
    near = near[(near != point) & (near >= 0)]
    own = x[near]
    far = ((own - x[point]) ** 2).sum(1)
    order = np.argsort(far, kind="stable")
    near, own, far = near[order], own[order], far[order]
    if len(near) <= 1:
        return near
    square = (own * own).sum(1)
    between = alpha * alpha * (square[:, None] + square - 2 * own @ own.T)
    alive = np.ones(len(near), bool)
    kept = []
    for k in range(len(near)):
        if alive[k]:
            kept.append(k)
            if len(kept) == degree:
                break
            alive &= between[k] > far
    return near[kept]


def build_graph(x: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, alpha: float = ALPHA, seed: int = 5
                ) -> tuple[np.ndarray, int]:
    """Out-neighbours of every node (``[nodes + 1, 2 * degree]``, padded with the number of nodes) and the node to start from."""
    x = np.ascontiguousarray(x, np.float32)
    nodes, random = len(x), np.random.default_rng(seed)
    norms = (x * x).sum(1)
    graph = np.full((nodes + 1, 2 * degree), nodes, np.int32)
    start = int(((x - x.mean(0)) ** 2).sum(1).argmin())
    if nodes <= 2 * degree:
        for k in range(nodes):
            graph[k, :nodes - 1] = np.delete(np.arange(nodes), k)
        return graph, start
    degrees = np.zeros(nodes, np.int64)
    # Random edges first, so that every search has somewhere to go.
    wild = random.integers(0, nodes, (nodes, degree // 2))
    graph[:nodes, :degree // 2] = wild
    degrees[:] = degree // 2
    order = random.permutation(nodes)
    for lo in range(0, nodes, 256):
        batch = order[lo:lo + 256]
        found, _ = _search(x, norms, graph, start, x[batch], beam)
        back: dict[int, list[int]] = {}
        for point, near in zip(batch, found):
            kept = _prune(x, point, np.concatenate([near, graph[point, :degrees[point]]]), degree, alpha)
            graph[point] = nodes
            graph[point, :len(kept)] = kept
            degrees[point] = len(kept)
            for q in kept:
                back.setdefault(int(q), []).append(int(point))
        for q, points in back.items():
            have = graph[q, :degrees[q]]
            new = [p for p in points if p not in have]
            if len(have) + len(new) <= 2 * degree:
                graph[q, len(have):len(have) + len(new)] = new
                degrees[q] += len(new)
            else:
                kept = _prune(x, q, np.concatenate([have, new]), degree, alpha)
                graph[q] = nodes
                graph[q, :len(kept)] = kept
                degrees[q] = len(kept)
    return graph, start


def usable(vector: Column) -> Column:
    """Neither null nor empty nor zero, and every component a finite number."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce(vector.isNotNull() & F.forall(vector, finite) & F.exists(vector, lambda x: x != 0), F.lit(False))


def _vectors(table: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    vector = F.col(vector_column).cast("array<double>")
    return table.where(F.col(id_column).isNotNull()).select(
        F.col(id_column).cast("long").alias("id"), vector.alias("vector")).where(usable(F.col("vector")))


def build_index(table: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", equal: int = 11,
                shard_nodes: int = SHARD_NODES) -> DataFrame:
    """``(shard, width, nodes, equal, ids, held, vectors, graph, start)``: one row per shard and vector length.

    Every usable row is in it: a node stands for all rows of one vector and names the ``equal`` smallest ids of them,
    which is what a search for ``equal - 1`` neighbours can return (ties go to the smaller id). Null and unusable
    vectors take no part; repeated rows count once.
    """
    rows = _vectors(table, id_column, vector_column).dropDuplicates(["id", "vector"])
    ranked = rows.withColumn("rank", F.row_number().over(W.partitionBy("vector").orderBy("id"))).where(F.col("rank") <= equal)
    nodes = keep(ranked.groupBy("vector").agg(F.array_sort(F.collect_list("id")).alias("ids")), "ann-nodes")
    shards = max(1, -(-nodes.count() // shard_nodes))

    def build(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("first", kind="stable")
        x = np.array(group["vector"].tolist(), np.float64)
        ids = np.full((len(x), equal), -1, np.int64)
        held = np.zeros((len(x), equal), bool)
        for k, own in enumerate(group["ids"]):
            ids[k, :len(own)] = own
            held[k, :len(own)] = True
        # Distances in the graph are single-precision: numbers of any size are brought to 1 first.
        graph, start = build_graph(x / np.abs(x).max())
        return pd.DataFrame({"shard": [group["shard"].iloc[0]], "width": [x.shape[1]], "nodes": [len(x)], "equal": [equal], "ids": [ids.tobytes()],
                             "held": [np.packbits(held).tobytes()], "vectors": [x.tobytes()], "graph": [graph.tobytes()], "start": [start]})

    dealt = nodes.select(F.pmod(F.xxhash64("vector"), F.lit(shards)).alias("shard"), F.size("vector").alias("width"),
                         F.get("ids", F.lit(0)).alias("first"), "vector", "ids")
    return keep(dealt.groupBy("shard", "width").applyInPandas(
        build, "shard long, width long, nodes long, equal long, ids binary, held binary, vectors binary, graph binary, start long"), "ann-index")


def search(index: DataFrame, queries: DataFrame, k: int = 10, id_column: str = "vec_id", vector_column: str = "embedding",
           beam: int = BEAM, block: int = QUERY_BLOCK) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` nearest found to each usable query, its own id left out.

    ``score`` is the Euclidean distance in double precision on the original vectors; ties go to the smaller id. Queries go in
    blocks, so neither side of a task grows with their number. A ``k`` for which the index holds too few ids of equal vectors is an
    error: build it with ``equal`` of ``k + 1`` at least.
    """
    held = index.agg(F.min("equal")).first()[0]
    if held is not None and k >= held:
        raise ValueError(f"the index names {held} rows of a vector; {k} neighbours need {k + 1}")
    asked = keep(_vectors(queries, id_column, vector_column).dropDuplicates(["id", "vector"]), "ann-queries")
    blocks = max(1, -(-asked.count() // block))
    asked = asked.select("id", "vector", F.size("vector").cast("long").alias("width"),
                         F.pmod(F.xxhash64("id", "vector"), F.lit(blocks)).alias("block"))
    # The stated queries against every shard.
    per_width = index.groupBy("width").agg(F.collect_set("shard").alias("shards"))
    asked = asked.join(per_width, "width").select("id", "vector", "width", "block", F.explode("shards").alias("shard"))
    parts = index.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"))

    def look(part: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        out = {"query_id": [], "vec_id": [], "score": []}
        if len(part) and len(own):
            row = part.iloc[0]
            x = np.frombuffer(row["vectors"], np.float64).reshape(row["nodes"], row["width"])
            equal = int(row["equal"])
            ids = np.frombuffer(row["ids"], np.int64).reshape(row["nodes"], equal)
            held = np.unpackbits(np.frombuffer(row["held"], np.uint8), count=ids.size).reshape(ids.shape).astype(bool)
            graph = np.frombuffer(row["graph"], np.int32).reshape(row["nodes"] + 1, -1)
            scale = np.abs(x).max()
            single = (x / scale).astype(np.float32)
            q = np.array(own["vector"].tolist(), np.float64)
            found, _ = _search(single, (single * single).sum(1), graph, int(row["start"]),
                               np.clip(q / scale, -1e9, 1e9).astype(np.float32), beam)
            for k_, (near, query) in enumerate(zip(found, own["id"])):
                near = near[near >= 0]
                exact = np.sqrt(((x[near] - q[k_]) ** 2).sum(1))
                name, far = ids[near], np.repeat(exact[:, None], equal, 1)
                use = held[near] & (name != query)
                name, far = name[use], far[use]
                best = np.lexsort((name, far))[:k]
                out["query_id"].extend([query] * len(best))
                out["vec_id"].extend(name[best])
                out["score"].extend(far[best])
        return pd.DataFrame({"query_id": np.array(out["query_id"], np.int64), "vec_id": np.array(out["vec_id"], np.int64),
                             "score": np.array(out["score"], float)})

    found = parts.groupBy("shard", "width", "block").cogroup(asked.groupBy("shard", "width", "block")).applyInPandas(
        look, "query_id long, vec_id long, score double")
    order = W.partitionBy("query_id").orderBy("score", "vec_id")
    return found.dropDuplicates(["query_id", "vec_id", "score"]).withColumn("rank", F.row_number().over(order)).where(
        F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")
