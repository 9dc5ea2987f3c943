import numpy as np
import pytest
from pyspark.sql import functions as F

from reviewloom.operators import cluster as L
from reviewloom.operators import dedup as U
from reviewloom.operators import graph as G
from reviewloom.operators import neighbors as NB
from reviewloom.operators import reduce as D

SCHEMA = "group_key string, id long, vector array<double>"


def frame(spark, x, groups=None):
    rows = [(groups[i] if groups else "g", i, [float(v) for v in r]) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, SCHEMA)


def cloud(n=160, d=3, seed=1):
    rng = np.random.default_rng(seed)
    x = np.concatenate([rng.normal(c, 0.25, (n // 4, d)) for c in (0, 2, 4)] + [rng.uniform(-2, 6, (n // 4, d))])
    x[5:15] = x[5]  # copies
    return np.round(x, 3)


def brute_dbscan(x, eps, m):
    dist = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2)).round(9) <= eps
    core = dist.sum(axis=1) >= m
    label, current = np.full(len(x), -1), 0
    for s in range(len(x)):
        if not core[s] or label[s] >= 0:
            continue
        stack = [s]
        while stack:
            p = stack.pop()
            if label[p] >= 0:
                continue
            label[p] = current
            if core[p]:
                stack.extend(np.flatnonzero(dist[p] & (label < 0)))
        current += 1
    return label, core


def test_dbscan_matches_brute_force(spark):
    x = cloud()
    want, core = brute_dbscan(x, 0.4, 5)
    got = {r["id"]: r for r in L.cluster_dbscan(frame(spark, x), 0.4, 5, block_rows=16).collect()}
    assert len(got) == len(x) and want.max() >= 2
    for i in range(len(x)):
        assert got[i]["is_core"] == core[i] and got[i]["label"] == want[i]


def test_groups_never_mix(spark):
    x = np.zeros((8, 2))
    labels = L.cluster_dbscan(frame(spark, x, ["a", "b"] * 4), 0.5, 3).groupBy("group_key", "label").count()
    assert {(r["group_key"], r["label"], r["count"]) for r in labels.collect()} == {("a", 0, 4), ("b", 0, 4)}


def test_no_row_of_a_null_group_is_lost(spark):
    x = cloud()
    groups = [None if i % 2 else "a" for i in range(len(x))]
    rows = [(groups[i], i, [float(v) for v in r]) for i, r in enumerate(x)] + [(None, 7000, None), ("a", 7001, None)]
    points = spark.createDataFrame(rows, SCHEMA)
    got = {r["id"]: r for r in L.cluster_dbscan(points, 0.5, 4, block_rows=16).collect()}
    assert len(got) == len(rows) and got[7000]["label"] == got[7001]["label"] == -1
    dense = {r["id"]: r["label"] for r in L.cluster_density(points, 6, 4, 0.5, block_rows=16).collect()}
    for part in (None, "a"):
        ids = [i for i in range(len(x)) if groups[i] == part]
        want, core = brute_dbscan(x[ids], 0.5, 4)
        assert [(got[i]["label"], got[i]["is_core"]) for i in ids] == list(zip(want, core))
        assert len(dense) == len(rows) and {dense[i] for i in ids} >= {-1, 0}
    sized = L.add_cluster_columns(points.select(F.col("id").alias("review_id")), L.cluster_dbscan(points, 0.5, 4).drop("is_core"),
                                  points.where("vector IS NOT NULL"), "none", "dbscan")
    assert sized.count() == len(rows)


def test_renumbering_keeps_rows_without_a_cluster(spark):
    rows = [(i, None if i % 4 == 0 else i % 3) for i in range(40)]
    got = {r.id: r.cluster_number for r in G.renumber_by_size(spark.createDataFrame(rows, "id int, cluster_number int")).collect()}
    from collections import Counter
    sizes = Counter(c for _, c in rows if c is not None)
    want = {c: k for k, c in enumerate(sorted(sizes, key=lambda c: (-sizes[c], c)))}
    assert got == {i: None if c is None else want[c] for i, c in rows}
    plan = G.renumber_by_size(spark.createDataFrame(rows, "id int, cluster_number int"))._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan or "__all" in plan


@pytest.mark.parametrize("n", [0, 1, 2])
def test_small_inputs(spark, n):
    rows = L.cluster_dbscan(frame(spark, np.zeros((n, 2))), 0.45, 5).collect()
    # Two rows clamp the floor to two points, which identical rows reach.
    assert sorted(r["label"] for r in rows) == {0: [], 1: [-1], 2: [0, 0]}[n]


def test_border_takes_lower_cluster_and_lone_is_noise(spark):
    x = np.array([[0.0], [0.1], [0.2], [1.4], [1.5], [1.6], [0.8], [9.0]])
    rows = {r["id"]: r["label"] for r in L.cluster_dbscan(frame(spark, x), 0.6, 4).collect()}
    want, _ = brute_dbscan(x, 0.6, 4)
    assert [rows[i] for i in range(8)] == list(want) and rows[7] == -1


def test_eps_join_and_knn_match_brute_force(spark):
    x = cloud(80)
    pairs = {(r["a"], r["b"]) for r in NB.eps_join(frame(spark, x), 0.5, block_rows=8).collect()}
    dist = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2)).round(9)
    assert pairs == {(i, j) for i in range(80) for j in range(i + 1, 80) if dist[i, j] <= 0.5}
    unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    sims = np.round(unit @ unit.T, 9)
    got = NB.knn_join(frame(spark, x), 3, block_rows=16).orderBy("src", "rank").collect()
    for i in range(80):
        want = sorted((j for j in range(80) if j != i), key=lambda j: (-sims[i, j], j))[:3]
        assert [r["dst"] for r in got if r["src"] == i] == want


def knn_by_hand(x, k, groups=None):
    unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    sims = np.round(unit @ unit.T, 9)
    return {(i, r + 1): j for i in range(len(x)) for r, j in enumerate(sorted(
        (j for j in range(len(x)) if j != i and (groups is None or groups[i] == groups[j])), key=lambda j: (-sims[i, j], j))[:k])}


def clustered_points(n=600, d=4, seed=8):
    rng = np.random.default_rng(seed)
    directions = rng.normal(0, 1, (12, d))
    return np.concatenate([c + rng.normal(0, 0.02, (n // 12, d)) for c in directions])


def test_knn_visits_only_cells_that_may_hold_a_neighbour(spark):
    x = clustered_points()
    points = frame(spark, x)
    got = {(r["src"], r["rank"]): r["dst"] for r in NB.knn_join(points, 4, block_rows=32).collect()}
    assert got == knn_by_hand(x, 4)
    from reviewloom.functions import vectors as V
    unit = points.withColumn("vector", V.l2_normalize(F.col("vector"))).cache()
    pivots = NB.pick_pivots(unit, 600, 32)
    placed = NB.knn_placed(unit, pivots)
    inside = NB.triangles(placed, 32)
    own = spark.createDataFrame([("g", s, d, float(1 - 1e-4), r) for (s, r), d in got.items()], "group_key string, src long, dst long, sim double, rank int")
    count = lambda df: df.select("group_key", "cell", "bi", "bj").distinct().count()
    pairs = count(inside) + count(NB.knn_visits(placed, own, pivots, 4, 32))
    assert 3 * pairs < count(NB.blocked(unit, 2.0, 600, 32))


def test_knn_with_zeros_copies_groups_and_missing_vectors(spark):
    x = np.concatenate([clustered_points(240), np.zeros((9, 4)), np.ones((60, 4)), -np.ones((30, 4))])
    groups = [None if i % 5 == 0 else "a" if i % 2 else "b" for i in range(len(x))]
    rows = [(groups[i], i, [float(v) for v in r]) for i, r in enumerate(x)] + [("a", 9000, None), (None, 9001, None)]
    got = {(r["src"], r["rank"]): r["dst"] for r in NB.knn_join(spark.createDataFrame(rows, SCHEMA), 5, block_rows=24).collect()}
    assert got == knn_by_hand(x, 5, groups)


def pairs_by_hand(x, eps, groups):
    dist = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2)).round(9)
    return {(i, j) for i in range(len(x)) for j in range(i + 1, len(x)) if dist[i, j] <= eps and groups[i] == groups[j]}


def test_null_groups_and_missing_vectors_in_distance_joins(spark):
    x = cloud(120)
    groups = [None if i % 3 == 0 else "a" for i in range(len(x))]
    rows = [(groups[i], i, [float(v) for v in r]) for i, r in enumerate(x)]
    missing = rows + [(None, 5000, None)]
    got = {(r["a"], r["b"]) for r in NB.eps_join(spark.createDataFrame(missing, SCHEMA), 0.4, block_rows=16).collect()}
    assert got == pairs_by_hand(x, 0.4, groups)


def test_approximate_pairs_are_true_once_and_nearly_complete(spark):
    rng = np.random.default_rng(6)
    x = np.concatenate([c + rng.normal(0, 0.03, (30, 16)) for c in rng.normal(0, 1, (20, 16))] + [np.ones((50, 16))])
    groups = ["a" if i % 2 else None for i in range(len(x))]
    points = spark.createDataFrame([(groups[i], i, [float(v) for v in r]) for i, r in enumerate(x)], SCHEMA)
    got = [(r["a"], r["b"]) for r in NB.eps_join(points, 0.2, block_rows=16, mode="approximate", recall=0.95).collect()]
    want = pairs_by_hand(x, 0.2, groups)
    assert len(got) == len(set(got)) and set(got) <= want and len(got) >= 0.9 * len(want) > 1000
    # Far fewer rows meet than in a comparison of all: buckets are small beside the table.
    tables = NB.plan_tables(points, 0.2)
    largest = NB.bucketed(points, tables, 10 ** 6).groupBy("group_key", "cell").count().agg(F.max("count")).first()[0]
    assert largest <= 100
    assert NB.eps_join(points.where("false"), 0.2, mode="approximate").count() == 0
    with pytest.raises(ValueError):
        NB.eps_join(points, 0.2, mode="nearly")


def test_components_of_a_long_path(spark):
    edges = spark.range(200).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst")).where("id % 50 <> 49")
    roots = {r["node"]: r["root"] for r in G.connected_components(edges).collect()}
    assert all(roots[i] == i // 50 * 50 for i in range(200))


def test_communities_partition_nodes_and_beat_singletons(spark):
    rows = [(b * 5 + i, b * 5 + j, 1.0) for b in range(3) for i in range(5) for j in range(i + 1, 5)]
    rows += [(4, 5, 0.1), (9, 10, 0.1)]
    edges = spark.createDataFrame(rows, "src long, dst long, weight double")
    nodes = spark.range(15)
    found = G.graph_communities(edges, nodes, [1.0]).cache()
    assert found.count() == 15 and found.select("community").distinct().count() == 3
    quality = G.modularity(edges, found.select("node", F.col("community").alias("label"))).first()[0]
    single = G.modularity(edges, nodes.select(F.col("id").alias("node"), F.col("id").alias("label"))).first()[0]
    assert quality > single
    table = G.select_resolution(edges, found).collect()
    assert [r["selected"] for r in table] == [True]


def test_pca_and_scaling(spark):
    x = cloud(60, 4)
    reduced = D.reduce_pca(frame(spark, x), 10)
    got = np.array([r["vector"] for r in reduced.orderBy("id").collect()])
    variance = got.var(axis=0)
    assert {r["reducer_used"] for r in reduced.collect()} == {"pca"} and got.shape == (60, 4) and all(np.diff(variance) <= 1e-9)
    assert abs(got.mean(axis=0)).max() < 1e-9
    assert {r["reducer_used"] for r in D.reduce_pca(frame(spark, x[:2]), 10).collect()} == {"none_too_few_rows"}
    flat = np.concatenate([x, np.ones((60, 1))], axis=1)
    scaled = np.array([r["vector"] for r in D.standard_scale(frame(spark, flat)).orderBy("id").collect()])
    assert np.allclose(scaled[:, :4], (x - x.mean(axis=0)) / x.std(axis=0)) and abs(scaled[:, 4]).max() == 0


def test_svd_matches_numpy(spark):
    rng = np.random.default_rng(3)
    x = rng.random((30, 12)) * (rng.random((30, 12)) < 0.5)
    rows = [(i, f"t{j:02d}", float(x[i, j])) for i in range(30) for j in range(12) if x[i, j]]
    features = spark.createDataFrame(rows, "doc_id int, term string, weight double")
    got = np.array([r["vector"] for r in D.reduce_svd(features, k=3).orderBy("doc_id").collect()])
    _, s, _ = np.linalg.svd(x[np.abs(x).sum(axis=1) > 0], full_matrices=False)
    assert np.allclose(np.linalg.norm(got, axis=0), s[:3], rtol=1e-6)


def test_products_with_a_basis_are_summed_in_as_many_parts_as_there_are_cores(spark, monkeypatch):
    monkeypatch.setattr(D, "SLICE", 3)
    monkeypatch.setattr(D, "PART", 4)
    rng = np.random.default_rng(5)
    x = rng.random((40, 10)) * (rng.random((40, 10)) < 0.4)
    x[7] = 0
    lists = [([j for j in range(10) if r[j]], [float(v) for v in r if v]) for r in x]
    # A term that a row has twice counts with the sum of its weights.
    lists[3] = (lists[3][0] + lists[3][0][:1], lists[3][1] + [0.5])
    x[3, lists[3][0][0]] += 0.5
    rows = spark.createDataFrame(lists, "at array<int>, w array<double>").repartition(30)
    basis = rng.random((10, 3))
    assert np.allclose(D._gram_product(rows.where("false"), basis), 0)
    sent, whole = [], type(rows).collect
    monkeypatch.setattr(type(rows), "collect", lambda df: sent.append(df._jdf.queryExecution().executedPlan().toString()) or whole(df))
    assert np.allclose(D._gram_product(rows, basis), x.T @ (x @ basis))
    assert "Coalesce 4" in sent[0]


def test_products_of_coordinates_come_without_a_join(spark):
    x = np.random.default_rng(6).random((25, 4))
    rows = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(99, None)], "id int, vector array<double>").repartition(5)
    products = D.vector_products(rows)
    assert "Join" not in products._jdf.queryExecution().executedPlan().toString()
    got = {(r["p"], r["q"]): r["product"] for r in products.collect()}
    assert sorted(got) == [(p, q) for p in range(4) for q in range(p, 4)]
    assert all(np.isclose(v, (x.T @ x)[k]) for k, v in got.items())
    assert D.vector_products(rows.where("false")).count() == 0


def test_pairs_that_are_surely_within_are_not_measured():
    rng = np.random.default_rng(7)
    for x, y in ((rng.normal(0, 1, (60, 5)), rng.normal(0, 1, (40, 5))), (rng.normal(1e4, 1e-3, (60, 3)), rng.normal(1e4, 1e-3, (40, 3))),
                 (np.arange(30.0)[:, None], np.arange(20.0)[:, None] + 0.5), (np.zeros((0, 2)), np.ones((4, 2))), (np.ones((3, 2)), np.ones((0, 2)))):
        gap = np.sqrt(((x[:, None] - y[None]) ** 2).sum(axis=2))
        for eps in (1e-3, 1.5, 2.0):
            want = np.argwhere(np.round(gap, 9) <= eps).T.tolist()
            i, j, d = NB.within(x, y, eps)
            assert [i.tolist(), j.tolist()] == want and (d == gap[i, j]).all()
            i, j, d = NB.within(x, y, eps, measured=False)
            assert [i.tolist(), j.tolist()] == want and d is None


def test_cluster_rows_schema_and_sizes(spark):
    x = cloud(40)
    frame_ = spark.createDataFrame([(f"r{i}", "pros_gd" if i % 2 else "cons_gd") for i in range(40)],
                                   "review_id string, side string")
    vectors = spark.createDataFrame([(f"r{i}", [float(v) for v in x[i]]) for i in range(40)],
                                    "review_id string, vector array<double>")
    out = L.cluster_rows(frame_, vectors, "dbscan", eps=0.3, min_samples=3)
    assert out.columns[2:] == L.CLUSTER_COLUMNS and out.count() == 40
    bad = out.groupBy("side", "cluster_id").agg(F.count("*").alias("n"), F.max("cluster_size").alias("s")).where("n <> s")
    assert bad.count() == 0
    empty = L.cluster_rows(frame_.limit(0), vectors, "dbscan")
    assert empty.columns == out.columns and empty.count() == 0


def test_near_duplicates_match_brute_force(spark):
    rng = np.random.default_rng(5)
    x = rng.random((40, 30)) * (rng.random((40, 30)) < 0.4)
    for i in range(0, 20, 2):
        x[i + 1] = x[i] + rng.random(30) * 0.12 * (x[i] > 0)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = (x > 0).sum(axis=0)
    rows = [(i, f"t{j:02d}", float(x[i, j]), int(df[j])) for i in range(40) for j in range(30) if x[i, j]]
    features = spark.createDataFrame(rows, "doc_id int, term string, weight double, df int")
    for threshold in (0.98, 0.8, 0.5):
        got = {(r["a"], r["b"]) for r in U.near_duplicates(features, threshold).collect()}
        sims = np.round(x @ x.T, 9)
        assert got == {(i, j) for i in range(40) for j in range(i + 1, 40) if sims[i, j] >= threshold}


def test_near_duplicates_with_a_term_in_every_text(spark):
    rng = np.random.default_rng(11)
    x = np.zeros((260, 40))
    x[:, 0] = 1.0  # in every text, and all that many of them have
    for i in range(0, 200):
        x[i, 1 + rng.integers(39, size=2)] = rng.random(2) * (2 if i % 2 else 0.05)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = (x > 0).sum(axis=0)
    rows = [(i, f"t{j:02d}", float(x[i, j]), int(df[j])) for i in range(260) for j in range(40) if x[i, j]]
    features = spark.createDataFrame(rows, "doc_id int, term string, weight double, df int")
    got = {(r["a"], r["b"]): r["sim"] for r in U.near_duplicates(features, 0.95, term_rows=16).collect()}
    sims = x @ x.T
    want = {(i, j) for i in range(260) for j in range(i + 1, 260) if round(sims[i, j], 9) >= 0.95}
    assert set(got) == want and all(abs(s - sims[p]) < 1e-9 for p, s in got.items())
    # Every pair comes once per shared term, and the blocks of the hot term hold few rows each.
    heads = features.select(F.col("doc_id").alias("doc"), "term", "weight", F.lit(1.0).alias("carried"), F.lit(9.0).alias("total"), F.lit(1.0).alias("largest"))
    met = U.term_pairs(heads.where("term = 't00'"), 0.5, 16)
    assert met.count() == met.select("a", "b").distinct().count() == 260 * 259 // 2
    plan = U.term_pairs(heads, 0.5, 16)._jdf.queryExecution().optimizedPlan().toString()
    assert "bi" in plan and met.where("a >= b").count() == 0


def test_texts_that_share_little_are_no_candidates(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x = np.zeros((60, 900))
    x[:, 0] = 1.0  # the rarest term of all that are in two texts, and in all of them
    for i in range(0, 60, 2):
        own = rng.choice(np.arange(1, 900), 60, replace=False)
        x[i, own] = 0.5 + rng.random(60)
        x[i + 1, own] = x[i, own] * (1 + 0.1 * rng.random(60))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = (x > 0).sum(axis=0)
    rows = [(i, f"t{j:03d}", float(x[i, j]), 2 if j == 0 else 3 + int(df[j])) for i in range(60) for j in range(900) if x[i, j]]
    features = spark.createDataFrame(rows, "doc_id int, term string, weight double, df int")
    written, materialize = {}, U.materialize

    def counting(frame, label="step"):
        kept = materialize(frame, label)
        written[label] = kept.count()
        return kept

    monkeypatch.setattr(U, "materialize", counting)
    monkeypatch.setattr(U, "RARER", 1, raising=False)
    got = {(r["a"], r["b"]): r["sim"] for r in U.near_duplicates(features, 0.9).collect()}
    sims = x @ x.T
    want = {(i, j) for i in range(60) for j in range(i + 1, 60) if round(sims[i, j], 9) >= 0.9}
    assert set(got) == want and len(want) == 30 and all(abs(s - sims[p]) < 1e-9 for p, s in got.items())
    # All 1,770 pairs share the first term.
    assert len(want) <= written["met"] < 100


def test_minibatch_centres_are_close_to_a_full_fit(spark):
    from reviewloom.operators import minibatch as MB
    rng = np.random.default_rng(4)
    x = np.concatenate([c + rng.normal(0, 0.3, (150, 5)) for c in rng.normal(0, 3, (14, 5))])
    weight = rng.integers(1, 4, len(x))
    points = spark.createDataFrame([(i, [float(v) for v in r], int(weight[i])) for i, r in enumerate(x)] + [(9999, None, 1)],
                                   "vec_id long, vector array<double>, review_count long")

    def inertia(centres):
        return float((((x[:, None] - centres[None]) ** 2).sum(axis=2).min(axis=1) * weight).sum())

    centres = MB.minibatch_centres(points, 14, "review_count", batch_rows=256, batches=60)
    # Plain Lloyd iterations from the same places.
    full = centres.copy()
    for _ in range(50):
        near = ((x[:, None] - full[None]) ** 2).sum(axis=2).argmin(axis=1)
        full = np.array([np.average(x[near == c], axis=0, weights=weight[near == c]) if (near == c).any() else full[c] for c in range(len(full))])
    assert centres.shape == (14, 5) and inertia(centres) <= 1.05 * inertia(full)
    again = MB.minibatch_centres(points.repartition(7), 14, "review_count", batch_rows=256, batches=60)
    assert np.allclose(centres, again)
    micro = L.micro_clusters(points, cap=20, batch_rows=256, batches=20)
    assert micro.count() == len(x) + 1 and micro.where("micro_id IS NULL").count() == 1
    assert micro.agg(F.max("micro_id")).first()[0] < 20
    copies = points.limit(3).crossJoin(spark.range(4)).drop("id")
    assert {r.micro_id for r in L.micro_clusters(copies.where("vec_id = 0")).collect()} == {0}


def test_starved_centres_are_set_anew():
    from reviewloom.operators import minibatch as MB
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(0, 0.1, (200, 2)), rng.normal(5, 0.1, (200, 2))])
    state = MB.Centres(np.array([[0.0, 0.0], [100.0, 100.0]]), np.random.default_rng(1))
    for _ in range(30):
        state.update(x, np.ones(len(x)))
    assert sorted(np.round(state.at[:, 0] / 5)) == [0, 1]


def test_dedup_keeps_first_and_maps_back(spark):
    rows = spark.createDataFrame([(1, "A  b", 1.0), (2, "a B", 3.0), (3, "c", 5.0)], "id int, t string, s double")
    unique = U.dedup_exact(rows, "t", "id", ["s"])
    got = {r["review_text_normalized"]: (r["review_text_original"], r["_review_count"], r["s"]) for r in unique.collect()}
    assert got == {"a b": ("A  b", 2, 2.0), "c": ("c", 1, 5.0)}
    back = U.map_back(rows, unique, ["first_id"], "t")
    assert {(r["id"], r["first_id"]) for r in back.collect()} == {(1, 1), (2, 1), (3, 3)}


def test_each_side_is_clustered_by_itself(spark):
    sizes = {"a": 60, "b": 40, "two": 2, "one": 1}
    rows, at = [], 0
    for side, n in sizes.items():
        x = cloud(n, 6) if n > 2 else np.random.default_rng(n).random((n, 6))
        for v in x:
            rows.append((at, side, [float(y) for y in v]))
            at += 1
    rows.append((at, "a", None))
    both = spark.createDataFrame(rows, "review_id long, side string, vector array<double>")
    for algorithm in ("kmeans", "dbscan", "density"):
        def run(part):
            out = L.cluster_rows(part.select("review_id", "side"), part.select("review_id", "vector"), algorithm,
                                 eps=0.3, min_samples=3, min_cluster_size=5)
            return {r["review_id"]: r.asDict() for r in out.collect()}
        together = run(both)
        assert len(together) == at + 1 and together[at]["cluster_id"] == -1
        for side in sizes:
            for key, alone in run(both.where(F.col("side") == side)).items():
                for name, value in alone.items():
                    if isinstance(value, float):
                        assert abs(value - together[key][name]) < 1e-6
                    else:
                        assert value == together[key][name], (algorithm, side, name)
        marks = {r["side"]: (r["reducer_used"], r["cluster_algorithm_used"]) for r in together.values()}
        assert marks["one"] == ("none_too_few_rows", "none_too_few_rows")
        assert marks["two"] == ("none_too_few_rows", algorithm) and marks["b"] == ("pca", algorithm)


def test_copies_of_a_row_are_bounded_whatever_the_number_of_rows(spark):
    x = np.random.default_rng(4).normal(0, 1, (1500, 3))
    points = frame(spark, x)
    # 94 blocks of 16 rows would make up to 94 copies of a row.
    per_row = NB.triangles(points.withColumn("cell", F.lit(0)), 16).groupBy("id").count().agg(F.max("count")).first()[0]
    assert per_row == NB.MAX_BLOCKS
    copies = NB.blocked(points, 10.0, block_rows=16).count()
    assert copies <= 2 * NB.MAX_BLOCKS * len(x)
    assert NB.grown(10 ** 9, 16) == NB.LARGEST_BLOCK and NB.grown(160, 16) == 16


def test_blocks_of_many_tiles_give_the_same_results(spark, monkeypatch):
    monkeypatch.setattr(NB, "BLOCK_ROWS", 16)
    monkeypatch.setattr(NB, "MAX_BLOCKS", 3)
    monkeypatch.setattr(NB, "HELD_ROWS", 40)
    x = cloud(160)
    points = frame(spark, x)
    got = {(r["a"], r["b"]) for r in NB.eps_join(points, 0.5, block_rows=8).collect()}
    assert got == pairs_by_hand(x, 0.5, ["g"] * 160)
    monkeypatch.setattr(NB, "FEW_BLOCKS", 2)
    assert {(r["src"], r["rank"]): r["dst"] for r in NB.knn_join(points, 5, block_rows=8).collect()} == knn_by_hand(x, 5)
    want, core = brute_dbscan(x, 0.4, 5)
    labels = {r["id"]: (r["label"], r["is_core"]) for r in L.cluster_dbscan(points, 0.4, 5, block_rows=8).collect()}
    assert labels == {i: (want[i], core[i]) for i in range(160)}


@pytest.mark.parametrize("single", [True, False])
def test_vectors_within_a_radius_are_shuffled_once_and_met_exactly(spark, single):
    x = np.random.default_rng(5).normal(0, 1, (300, 3))
    x = x.astype(np.float32).astype(float) if single else x
    groups = [None if i % 3 else f"small{i // 30}" for i in range(len(x))]
    rows = [(groups[i], i, [float(v) for v in r]) for i, r in enumerate(x)]
    points = spark.createDataFrame(rows, SCHEMA)
    joined = NB.eps_join(points, 0.4, block_rows=16)
    gap = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2)).round(9)
    want = {(i, j) for i in range(len(x)) for j in range(i + 1, len(x)) if gap[i, j] <= 0.4 and groups[i] == groups[j]}
    got = [(r["a"], r["b"]) for r in joined.collect()]
    assert len(want) > 100 and len(got) == len(want) and set(got) == want
    packed = NB.packed_blocks(points.where("group_key IS NULL"), 200, None, 16).table
    assert sorted(i for r in packed.collect() for i in r["ids"]) == [i for i in range(len(x)) if groups[i] is None]
    # Blocks meet without a copy of their vectors for each pair of blocks.
    alone = NB.eps_join(points.where("group_key IS NULL"), 0.4, block_rows=16)
    plan = alone._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" in plan or "Cartesian" in plan
    assert "hashpartitioning(group_key" not in plan and "Sort [group_key" not in plan
