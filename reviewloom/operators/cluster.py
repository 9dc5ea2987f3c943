"""Clustering of vectors, one run over all groups at once.

Rows are ``(group_key, id, vector)``; groups never mix. Identical vectors are clustered once, with
their number as weight, so copies cost nothing.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewloom import constants as K
from reviewloom.functions import vectors as V
from reviewloom.operators import graph as G
from reviewloom.operators import hierarchy as H
from reviewloom.operators import minibatch as MB
from reviewloom.operators import neighbors as NB
from reviewloom.operators.joins import null_safe_join
from reviewloom.operators.ranks import running
from reviewloom.session import materialize


def unique_vectors(points: DataFrame) -> DataFrame:
    """Distinct vectors per group with their smallest id and their count."""
    return points.groupBy("group_key", "vector").agg(F.min("id").alias("id"), F.count("*").alias("weight"))


def _local_components(left: np.ndarray, right: np.ndarray, i: np.ndarray, j: np.ndarray,
                      same: bool) -> np.ndarray:
    """Smallest reachable id for left then right ids, given adjacent index pairs."""
    ids = left if same else np.concatenate([left, right])
    j = j if same else j + len(left)
    order = np.argsort(ids, kind="stable")
    rank = np.empty(len(ids), dtype=np.int64)
    rank[order] = np.arange(len(ids))
    label = rank.copy()
    while True:
        low = np.minimum(label[i], label[j])
        following = label.copy()
        np.minimum.at(following, i, low)
        np.minimum.at(following, j, low)
        following = np.minimum(following, following[order[following]])
        if (following == label).all():
            return ids[order[label]]
        label = following


def neighbour_counts(points: DataFrame, eps: float, id_type: str, key_type: str, block_rows: int) -> DataFrame:
    """Weighted number of points within ``eps`` of each point, itself included. ``points``: group_key, id, vector, weight."""
    def kernel(left: NB.Tile, right: NB.Tile, same: bool) -> pd.DataFrame:
        i, j, _ = NB.within(left.x, right.x, eps, False)
        parts = [(left.ids, np.bincount(i, weights=right.more[j], minlength=len(left.ids)))]
        if not same:
            parts.append((right.ids, np.bincount(j, weights=left.more[i], minlength=len(right.ids))))
        ids, counts = (np.concatenate(c) for c in zip(*parts))
        ids, counts = ids[counts > 0], counts[counts > 0]
        return NB._frame(group_key=[left.key] * len(ids), id=ids, n=counts.astype("int64"))

    def summed(rows: pd.DataFrame) -> pd.DataFrame:
        return rows.groupby(["group_key", "id"], as_index=False, dropna=False, sort=False)["n"].sum()

    found = NB.near_map(points, eps, kernel, f"group_key {key_type}, id {id_type}, n long", summed, "weight", block_rows)
    return found.groupBy("group_key", "id").agg(F.sum("n").alias("n"))


def core_edges(points: DataFrame, eps: float, id_type: str, key_type: str, block_rows: int) -> DataFrame:
    """A spanning set of the neighbour relation: at most one edge per point and block pair."""
    def kernel(left: NB.Tile, right: NB.Tile, same: bool) -> pd.DataFrame:
        i, j, _ = NB.within(left.x, right.x, eps, False)
        a, b = left.ids, right.ids
        if not len(i):
            return NB._frame(group_key=[], src=[], dst=[])
        low = _local_components(a, b, i, j, same)
        ids = a if same else np.concatenate([a, b])
        linked = low != ids
        return NB._frame(group_key=[left.key] * int(linked.sum()), src=ids[linked], dst=low[linked])

    def spanning(rows: pd.DataFrame) -> pd.DataFrame:
        ids, ends = np.unique(np.concatenate([rows["src"].to_numpy(), rows["dst"].to_numpy()]), return_inverse=True)
        low = _local_components(ids, ids, ends[:len(rows)], ends[len(rows):], True)
        linked = low != ids
        return NB._frame(group_key=[rows["group_key"].iloc[0]] * int(linked.sum()), src=ids[linked], dst=low[linked])

    return NB.near_map(points, eps, kernel, f"group_key {key_type}, src {id_type}, dst {id_type}", spanning, block_rows=block_rows)


def _numbered(roots: DataFrame) -> DataFrame:
    """Cluster numbers per group in the order of the smallest member; no task sees all clusters of a group."""
    clusters = roots.select("group_key", "root").distinct()
    return null_safe_join(roots, _in_order(clusters, "root", "label"), ["group_key", "root"])


def _in_order(clusters: DataFrame, by: str, name: str) -> DataFrame:
    """Numbers from 0 per group in the order of ``by``."""
    counted = running(clusters.withColumn("_one", F.lit(1)), ["group_key"], [F.col(by).asc()], {name: ("_one", "sum")})
    return counted.withColumn(name, (F.col(name) - 1).cast("int")).drop("_one")


def _roots(core: DataFrame, edges: DataFrame) -> DataFrame:
    found = G.connected_components(edges.select("src", "dst"))
    return core.select("group_key", "id").join(
        found.withColumnRenamed("node", "id"), "id", "left").select(
        "group_key", "id", F.coalesce("root", "id").alias("root"))


def cluster_dbscan(points: DataFrame, eps: float = 0.45, min_samples: int = 5,
                   block_rows: int = NB.BLOCK_ROWS) -> DataFrame:
    """DBSCAN labels: (group_key, id, label, is_core), noise -1.

    A core point has ``min_samples`` points within ``eps``, itself included; clusters are the
    components of core points within ``eps`` of each other, numbered by their first core row; a
    border point takes the lowest-numbered adjacent cluster. A group of one row is noise, and so is a row
    without a vector; a null ``group_key`` is a group. ``id`` must be unique over all groups.
    """
    id_type = points.schema["id"].dataType.simpleString()
    key_type = points.schema["group_key"].dataType.simpleString()
    unique = materialize(unique_vectors(points.where(F.col("vector").isNotNull()).select("group_key", "id", "vector")), "dbscan-unique")
    group_rows = points.groupBy("group_key").agg(F.count("*").alias("_rows"))
    needed = F.greatest(F.lit(1), F.least(F.lit(min_samples), F.col("_rows")))
    counts = neighbour_counts(unique, eps, id_type, key_type, block_rows)
    flagged = materialize(
        null_safe_join(null_safe_join(unique, counts, ["group_key", "id"]), group_rows, ["group_key"])
        .withColumn("is_core", (F.col("n") >= needed) & (F.col("_rows") > 1)), "dbscan-core")
    core = flagged.where("is_core")
    edges = materialize(core_edges(core, eps, id_type, key_type, block_rows), "dbscan-edges")
    labels = materialize(_numbered(_roots(core, edges)).select("group_key", "id", "label"), "dbscan-labels")

    def border(left: NB.Tile, right: NB.Tile, same: bool) -> pd.DataFrame:
        ids, found = [], []
        # Only points without a label ask, and only those with one answer.
        for one, other in ((left, right),) if same else ((left, right), (right, left)):
            free, held = one.part(one.more < 0), other.part(other.more >= 0)
            if len(free.ids) and len(held.ids):
                i, j, _ = NB.within(free.x, held.x, eps, False)
                ids.append(free.ids[i])
                found.append(held.more[j])
        if not ids:
            return NB._frame(group_key=[], id=[], label=[])
        out = pd.DataFrame({"id": np.concatenate(ids), "label": np.concatenate(found)})
        out = out.groupby("id", as_index=False)["label"].min()
        return NB._frame(group_key=[left.key] * len(out), id=out["id"].to_numpy(), label=out["label"].to_numpy())

    def lowest(rows: pd.DataFrame) -> pd.DataFrame:
        return rows.groupby(["group_key", "id"], as_index=False, dropna=False, sort=False)["label"].min()

    known = null_safe_join(flagged.select("group_key", "id", "vector"), labels, ["group_key", "id"], "left").withColumn(
        "label", F.coalesce("label", F.lit(-1)))
    edge_labels = NB.near_map(known, eps, border, f"group_key {key_type}, id {id_type}, label int", lowest, "label", block_rows)
    border_labels = edge_labels.groupBy("group_key", "id").agg(F.min("label").alias("_border"))
    settled = flagged.select("group_key", "id", "vector", "is_core")
    for found in (labels, border_labels):
        settled = null_safe_join(settled, found, ["group_key", "id"], "left")
    settled = settled.select("group_key", "vector", "is_core", F.coalesce("label", "_border", F.lit(-1)).cast("int").alias("label"))
    return null_safe_join(points, settled, ["group_key", "vector"], "left").select(
        "group_key", "id", F.coalesce("label", F.lit(-1)).alias("label"), F.coalesce("is_core", F.lit(False)).alias("is_core"))


def cluster_density(points: DataFrame, min_cluster_size: int = 15, min_samples: int = 5,
                    eps: float = 0.45, block_rows: int = NB.BLOCK_ROWS) -> DataFrame:
    """Components of the mutual-reachability graph at ``eps``; small ones are noise (-1).

    The reachability of two points is the largest of their distance and their core distances (to
    the ``min_samples``-th point, itself included), so it is at most ``eps`` exactly for two core
    points within ``eps``. Points without such a partner, and components smaller than
    ``min_cluster_size``, are noise. Sizes are clamped to the group as the small-input rules say.
    """
    labelled = cluster_dbscan(points, eps, min_samples, block_rows)
    core_only = labelled.withColumn("label", F.when(F.col("is_core"), F.col("label")).otherwise(-1))
    sizes = core_only.where("label >= 0").groupBy("group_key", "label").agg(
        F.count("*").alias("_n"), F.min("id").alias("_first"))
    group_rows = points.groupBy("group_key").agg(F.count("*").alias("_rows"))
    floor = F.greatest(F.lit(2), F.least(F.lit(min_cluster_size), F.col("_rows")))
    kept = null_safe_join(sizes, group_rows, ["group_key"]).where(F.col("_n") >= floor).select("group_key", "label", "_first")
    kept = _in_order(kept, "_first", "_new").drop("_first")
    return null_safe_join(core_only, kept, ["group_key", "label"], "left").select(
        "group_key", "id", F.coalesce("_new", F.lit(-1)).alias("label"))


def kmeans_count(n: int, min_cluster_size: int = 15) -> int:
    size = max(2, min(min_cluster_size, n))
    return max(2, min(8, n // size))


def micro_count(n: int, cap: int = 384) -> int:
    return max(12, min(cap, int((max(n, 2) / 2.0) ** 0.5)))


def _kmeans(points: DataFrame, k: int, seed: int, weight: str | None, name: str) -> DataFrame:
    model = KMeans(k=k, seed=seed, featuresCol="_v", predictionCol=name)
    if weight:
        model = model.setWeightCol(weight)
    ready = points.withColumn("_v", array_to_vector(V.as_double(F.col("vector"))))
    return model.fit(ready).transform(ready).drop("_v")


def cluster_kmeans(points: DataFrame, min_cluster_size: int = 15, seed: int = 42) -> DataFrame:
    """k-means labels per row: (group_key, id, label), numbered from 0 in every group.

    Each group has its own number of clusters and its own fit over all its rows; there is one fit
    per group, and groups are few (the sides of a review). A group of one row is noise.
    """
    sizes = {r["group_key"]: r["count"] for r in points.groupBy("group_key").count().collect()}
    parts = [points.select("group_key", "id", F.lit(-1).alias("label")).where("false")]
    for key, n in sorted(sizes.items(), key=lambda x: (x[0] is None, x[0])):
        own = points.where(F.col("group_key").eqNullSafe(F.lit(key)))
        if n < 2:
            parts.append(own.select("group_key", "id", F.lit(-1).alias("label")))
            continue
        found = _kmeans(own, kmeans_count(n, min_cluster_size), seed, None, "_k")
        # Numbered by their first row; a fit may end with fewer clusters than asked for.
        used = [r["_k"] for r in found.groupBy("_k").agg(F.min("id").alias("_first")).orderBy("_first").collect()]
        number = F.array_position(F.array(*[F.lit(u) for u in used]), F.col("_k")) - 1
        parts.append(found.select("group_key", "id", number.cast("int").alias("label")))
    return reduce(DataFrame.unionByName, parts)


def micro_clusters(points: DataFrame, cap: int = 384, seed: int = 42,
                   weight: str = "review_count", **batches: int) -> DataFrame:
    """Many small clusters of unique reviews, weighted by how often each occurs; adds ``micro_id``.

    Mini-batch k-means (:func:`~reviewloom.operators.minibatch.minibatch_centres`, which takes ``batches``) finds the centres; every row
    then goes to its nearest one. Rows without a vector get no number.
    """
    n = points.where(F.col("vector").isNotNull()).count()
    k = min(n, micro_count(n, cap))
    if k < 2:
        return points.withColumn("micro_id", F.when(F.col("vector").isNotNull(), F.lit(0)))
    centres = MB.minibatch_centres(points, k, weight, seed, **batches)
    return points.withColumn("micro_id", _nearest_label(np.arange(len(centres)), centres)("vector"))


def assign_nearest(points: DataFrame, centroids: DataFrame, slice_rows: int = 1024) -> DataFrame:
    """Label of the nearest centroid for every vector, ties to the smaller label.

    The centroids (label, centroid) are the model and are read as a whole. Distances come from one matrix
    product per slice of rows; where the product form cannot tell the nearest ones apart, they are
    measured directly.
    """
    rows = centroids.select("label", "centroid").orderBy("label").collect()
    labels = np.array([r["label"] for r in rows])
    matrix = np.array([r["centroid"] for r in rows], dtype=float)
    return points.select("group_key", "id", _nearest_label(labels, matrix, slice_rows)("vector").alias("label"))


def _nearest_label(labels: np.ndarray, matrix: np.ndarray, slice_rows: int = 1024):
    own = (matrix ** 2).sum(axis=1)

    @F.pandas_udf("int")
    def nearest(batch: pd.Series) -> pd.Series:
        known = np.flatnonzero(batch.notna().to_numpy())
        whole = NB._matrix(batch.iloc[known])
        out = np.zeros(len(whole), dtype="int32")
        for low in range(0, len(whole), slice_rows):
            x = whole[low:low + slice_rows]
            size = (x ** 2).sum(axis=1)
            square = size[:, None] + own - 2 * x @ matrix.T
            best = square.argmin(axis=1)
            slack = 1e-8 + 1e-12 * (size + own.max())
            near = square <= (square.min(axis=1) + slack)[:, None]
            for i in np.flatnonzero(near.sum(axis=1) > 1):
                some = np.flatnonzero(near[i])
                best[i] = some[np.round(((x[i] - matrix[some]) ** 2).sum(axis=1), 9).argmin()]
            out[low:low + slice_rows] = labels[best]
        if len(known) == len(batch):
            return pd.Series(out)
        return pd.Series(out, index=known, dtype="Int32").reindex(range(len(batch)))

    return nearest


CLUSTER_COLUMNS = ["cluster_id", "is_cluster_noise", "cluster_size", "cluster_x", "cluster_y",
                   "reducer_used", "cluster_algorithm_used", "cluster_embedding_model_id",
                   "cluster_min_cluster_size", "cluster_min_samples"]


def cluster_sizes(labels: DataFrame) -> DataFrame:
    """Rows per cluster, noise as its own group."""
    return labels.groupBy("group_key", "label").agg(F.count("*").alias("cluster_size"))


def add_cluster_columns(frame: DataFrame, labels: DataFrame, reduced: DataFrame, reducer: str,
                        algorithm: str, key: str = "review_id", min_cluster_size: int = 15,
                        min_samples: int = 5, model_id: str = K.MODEL_ID) -> DataFrame:
    """Cluster id, noise flag, size, first two coordinates and provenance for every row.

    ``labels``: group_key, id, label; ``reduced``: id, vector and, where groups differ in it,
    ``reducer_used``, which goes before ``reducer``. A group of one row has no algorithm, and one of up to
    two rows no reducer. The sizes are one row per cluster.
    """
    few = "none_too_few_rows"
    rows = labels.groupBy("group_key").agg(F.count("*").alias("_rows"))
    sized = null_safe_join(null_safe_join(labels, cluster_sizes(labels), ["group_key", "label"]), rows, ["group_key"])
    used = F.col("reducer_used") if "reducer_used" in reduced.columns else F.lit(None).cast("string")
    spots = reduced.select("id", F.get("vector", F.lit(0)).alias("_x"), F.get("vector", F.lit(1)).alias("_y"),
                           used.alias("_used"))
    small = F.when(F.col("_rows") <= 2, few) if reducer == "pca" else F.lit(None).cast("string")
    wide = sized.join(spots, "id", "left").select(
        F.col("id").alias(key),
        F.col("label").cast("int").alias("cluster_id"),
        (F.col("label") == -1).alias("is_cluster_noise"),
        F.col("cluster_size").cast("int").alias("cluster_size"),
        F.coalesce(F.col("_x").cast("double"), F.lit(0.0)).alias("cluster_x"),
        F.coalesce(F.col("_y").cast("double"), F.lit(0.0)).alias("cluster_y"),
        F.coalesce("_used", small, F.lit(reducer)).alias("reducer_used"),
        F.when(F.col("_rows") == 1, few).otherwise(algorithm).alias("cluster_algorithm_used"),
        F.lit(model_id).alias("cluster_embedding_model_id"),
        F.lit(min_cluster_size).alias("cluster_min_cluster_size"),
        F.lit(min_samples).alias("cluster_min_samples"),
    )
    return frame.join(wide, key)


def cluster_rows(frame: DataFrame, vectors: DataFrame, algorithm: str = "density",
                 reducer: str = "pca", key: str = "review_id", group: str = "side",
                 min_cluster_size: int = 15, min_samples: int = 5, eps: float = 0.45,
                 components: int = 10) -> DataFrame:
    """Reduce and cluster the rows of every group separately and add the cluster columns.

    ``vectors``: key, vector. A row without a vector is noise at the origin. An empty frame gives an
    empty result with the full schema.
    """
    from reviewloom.operators import reduce as D

    every = materialize(
        frame.select(F.col(group).alias("group_key"), F.col(key).alias("id"))
        .join(vectors.select(F.col(key).alias("id"), "vector"), "id", "left")
        .select("group_key", "id", V.l2_normalize(F.col("vector")).alias("vector")), "cluster-points")
    points = every.where(F.col("vector").isNotNull())
    reduced = D.reduce_pca(points, components) if reducer == "pca" else points
    reduced = materialize(reduced, "cluster-reduced")
    if algorithm == "kmeans":
        labels = cluster_kmeans(reduced, min_cluster_size)
    elif algorithm == "dbscan":
        labels = cluster_dbscan(reduced, eps, min_samples).drop("is_core")
    elif algorithm == "density":
        labels = cluster_density(reduced, min_cluster_size, min_samples, eps)
    elif algorithm == "hierarchy":
        labels = H.cluster_hierarchy(reduced.select("group_key", "id", "vector"), min_cluster_size, min_samples)
    else:
        raise ValueError(f"unknown clustering algorithm {algorithm}")
    without = every.where(F.col("vector").isNull()).select("group_key", "id", F.lit(-1).alias("label"))
    return add_cluster_columns(frame, labels.select("group_key", "id", "label").unionByName(without), reduced,
                               "pca" if reducer == "pca" else "none", algorithm, key, min_cluster_size, min_samples)
