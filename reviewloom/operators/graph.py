"""Graph operators as iterated joins over edge tables of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reviewloom import constants as K
from reviewloom.operators import neighbors as NB
from reviewloom.operators.ranks import numbered
from reviewloom.session import discard, materialize


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Smallest node id of every component: (node, root). ``edges``: src, dst.

    Alternating large-star and small-star steps: the number of rounds grows with the logarithm of
    the graph, not with its diameter, and every step is a grouped minimum and a join.
    """
    def stars(pairs: DataFrame, large: bool) -> DataFrame:
        if large:
            both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
            low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
            return (both.join(low, "u").where(F.col("v") > F.col("u"))
                    .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        low = pairs.groupBy("u").agg(F.min("v").alias("m"))
        moved = pairs.join(low, "u").where(F.col("v") != F.col("m")).select(
            F.col("v").alias("u"), F.col("m").alias("v"))
        return moved.unionByName(low.select("u", F.col("m").alias("v"))).distinct()

    current = materialize(
        edges.where(F.col("src") != F.col("dst"))
        .select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct(), "cc")
    for _ in range(max_rounds):
        # Settled when every node hangs on one root and no root on another node.
        crossed = current.select(F.col("u").alias("node"), F.col("v").alias("root")).groupBy("node").agg(
            F.count("*").alias("roots"))
        loose = crossed.where("roots > 1").select("node").unionByName(
            crossed.select("node").join(current.select(F.col("v").alias("node")), "node", "left_semi"))
        if loose.isEmpty():
            roots = current.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            return current.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
        following = materialize(stars(stars(current, True), False), "cc")
        discard(current)
        current = following
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def micro_graph(profiles: DataFrame, sizes: DataFrame, k: int = 8, min_weight: float = 0.30,
                weights: tuple[float, float, float] = K.BLOCK_WEIGHTS,
                stability_boost: bool = True) -> DataFrame:
    """Edges (src, dst, weight) between micro-clusters.

    ``profiles``: id, semantic, seed, metric; ``sizes``: id, size. The blended similarity of two
    nodes is the cosine of their weighted unit blocks, so one nearest-neighbour join finds the edges.
    The boost is ``1 + 0.1 ln(1 + smaller size)``.
    """
    from reviewloom.functions import vectors as V

    parts = [V.scale(V.l2_normalize(F.col(c)), (w / sum(weights)) ** 0.5)
             for c, w in zip(("semantic", "seed", "metric"), weights)]
    points = profiles.select(F.lit("all").alias("group_key"), "id", F.concat(*parts).alias("vector"))
    edges = NB.symmetric_edges(NB.knn_join(points, k)).where(F.round("sim", 9) >= min_weight)
    if not stability_boost:
        return edges.select("src", "dst", F.col("sim").alias("weight"))
    a = sizes.select(F.col("id").alias("src"), F.col("size").alias("_a"))
    b = sizes.select(F.col("id").alias("dst"), F.col("size").alias("_b"))
    boost = 1 + 0.1 * F.log1p(F.least("_a", "_b"))
    return edges.join(a, "src").join(b, "dst").select("src", "dst", (F.col("sim") * boost).alias("weight"))


def modularity(edges: DataFrame, labels: DataFrame, resolution: float = 1.0) -> DataFrame:
    """One row with the weighted modularity of a node labelling. ``labels``: node, label."""
    a = labels.select(F.col("node").alias("src"), F.col("label").alias("la"))
    b = labels.select(F.col("node").alias("dst"), F.col("label").alias("lb"))
    both = edges.join(a, "src").join(b, "dst")
    ends = both.select(F.inline(F.array(
        F.struct(F.col("la").alias("label"), F.col("weight"),
                 F.when(F.col("la") == F.col("lb"), F.col("weight")).otherwise(0.0).alias("inside")),
        F.struct(F.col("lb").alias("label"), F.col("weight"), F.lit(0.0).alias("inside")))))
    per_label = ends.groupBy("label").agg(
        F.sum("weight").alias("degree"), F.sum("inside").alias("inside"))
    total = F.sum("degree") / 2
    return per_label.agg(
        (F.sum("inside") / total
         - resolution * F.sum(F.col("degree") * F.col("degree")) / (4 * total * total)).alias("modularity"))


def graph_communities(edges: DataFrame, nodes: DataFrame, resolutions: list[float] | None = None,
                      max_rounds: int = 100, max_levels: int = 40) -> DataFrame:
    """Communities per resolution: (resolution, node, community), community = a member id.

    Modularity-improving moves as grouped joins: in each round the nodes of one parity move to the
    neighbouring community with the largest gain (ties to the smaller id); after two quiet rounds
    communities are contracted to nodes and the rounds go on until nothing merges. All resolutions
    run in the same jobs, keyed by ``resolution``. A search that is still moving after
    ``max_rounds`` rounds or merging after ``max_levels`` levels is an error. ``edges``: src, dst,
    weight; ``nodes``: id.
    """
    resolutions = resolutions or [1.0]
    grid = F.explode(F.array(*[F.lit(float(r)) for r in resolutions])).alias("resolution")
    level_edges = materialize(edges.select(grid, "src", "dst", "weight"), "louvain-edges")
    members = materialize(
        nodes.select(grid, F.col("id").alias("node"), F.col("id").alias("community")), "louvain-members")

    for _ in range(max_levels):
        directed = level_edges.where("src <> dst")
        directed = directed.unionByName(directed.select(
            "resolution", F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
        ends = level_edges.select("resolution", F.inline(F.array(
            F.struct(F.col("src").alias("node"), F.col("weight")),
            F.struct(F.col("dst").alias("node"), F.col("weight")))))
        degree = ends.groupBy("resolution", "node").agg(F.sum("weight").alias("k"))
        top = members.select("resolution", F.col("community").alias("node")).distinct()
        state = materialize(
            top.join(degree, ["resolution", "node"], "left")
            .select("resolution", "node", F.col("node").alias("c"), F.coalesce("k", F.lit(0.0)).alias("k")),
            "louvain-state")
        # One row per resolution.
        totals = F.broadcast(materialize(level_edges.groupBy("resolution").agg(
            (2 * F.sum("weight")).alias("m2")), "louvain-total"))
        quiet, visited = 0, set()
        for turn in range(max_rounds):
            following = materialize(_move(state, directed, totals, turn % 2), "louvain-state")
            moves, place = following.agg(
                F.count_if("moved"),
                F.sum(F.xxhash64("resolution", "node", "c").cast("decimal(38,0)"))).first()
            discard(state)
            state = following.drop("moved")
            quiet = 0 if moves else quiet + 1
            # Stop when settled, or when two halves keep swapping the same communities.
            if quiet == 2 or (moves and (turn % 2, place) in visited):
                break
            visited.add((turn % 2, place))
        else:
            raise RuntimeError(f"communities did not settle in {max_rounds} rounds")
        before, after = state.agg(
            F.count("*"), F.count_distinct("resolution", "c")).first()
        if after == before:
            break
        mapping = state.select("resolution", F.col("node").alias("community"), F.col("c").alias("_to"))
        members = materialize(
            members.join(mapping, ["resolution", "community"])
            .select("resolution", "node", F.col("_to").alias("community")), "louvain-members")
        to_src = state.select("resolution", F.col("node").alias("src"), F.col("c").alias("_s"))
        to_dst = state.select("resolution", F.col("node").alias("dst"), F.col("c").alias("_d"))
        level_edges = materialize(
            level_edges.join(to_src, ["resolution", "src"]).join(to_dst, ["resolution", "dst"])
            .groupBy("resolution", F.least("_s", "_d").alias("src"), F.greatest("_s", "_d").alias("dst"))
            .agg(F.sum("weight").alias("weight")), "louvain-edges")
    else:
        raise RuntimeError(f"communities still merged after {max_levels} levels")
    return members


def _move(state: DataFrame, directed: DataFrame, totals: DataFrame, parity: int) -> DataFrame:
    volume = state.groupBy("resolution", "c").agg(F.sum("k").alias("volume"))
    neighbour = state.select("resolution", F.col("node").alias("dst"), F.col("c").alias("to"))
    ties = (directed.join(neighbour, ["resolution", "dst"])
            .groupBy("resolution", F.col("src").alias("node"), "to").agg(F.sum("weight").alias("w")))
    stay = state.select("resolution", "node", F.col("c").alias("to"), F.lit(0.0).alias("w"))
    options = ties.unionByName(stay).groupBy("resolution", "node", "to").agg(F.sum("w").alias("w"))
    scored = (options.join(state, ["resolution", "node"])
              .join(volume.select("resolution", F.col("c").alias("to"), "volume"), ["resolution", "to"])
              .join(totals, "resolution"))
    own = F.col("to") == F.col("c")
    others = F.col("volume") - F.when(own, F.col("k")).otherwise(0.0)
    gain = F.col("w") - F.col("resolution") * F.col("k") * others / F.col("m2")
    # Rounding keeps the choice independent of summation order.
    best = scored.select("resolution", "node", "c", "k", "to", F.round(gain, 9).alias("gain"), own.alias("own"))
    picked = best.groupBy("resolution", "node", "c", "k").agg(
        F.max_by("to", F.struct("gain", -F.col("to"))).alias("to"), F.max("gain").alias("top"),
        F.max(F.when(F.col("own"), F.col("gain"))).alias("now"))
    go = (F.pmod("node", F.lit(2)) == parity) & (F.col("top") > F.col("now") + 1e-9)
    return picked.select("resolution", "node", F.when(go, F.col("to")).otherwise(F.col("c")).alias("c"),
                         "k", go.alias("moved"))


def select_resolution(edges: DataFrame, communities: DataFrame, penalty: float = 0.20) -> DataFrame:
    """Model selection table: modularity minus penalty times the largest community's share.

    One row per resolution with ``selected`` on the best one; ties go to the lower resolution.
    """
    a = communities.select("resolution", F.col("node").alias("src"), F.col("community").alias("la"))
    b = communities.select("resolution", F.col("node").alias("dst"), F.col("community").alias("lb"))
    both = edges.join(a, "src").join(b, ["resolution", "dst"])
    ends = both.select("resolution", F.inline(F.array(
        F.struct(F.col("la").alias("label"), F.col("weight"),
                 F.when(F.col("la") == F.col("lb"), F.col("weight")).otherwise(0.0).alias("inside")),
        F.struct(F.col("lb").alias("label"), F.col("weight"), F.lit(0.0).alias("inside")))))
    total = F.sum("degree") / 2
    quality = ends.groupBy("resolution", "label").agg(
        F.sum("weight").alias("degree"), F.sum("inside").alias("inside")).groupBy("resolution").agg(
        (F.sum("inside") / total - F.col("resolution") * F.sum(F.col("degree") * F.col("degree"))
         / (4 * total * total)).alias("modularity"))
    sizes = communities.groupBy("resolution", "community").agg(F.count("*").alias("n"))
    shares = sizes.groupBy("resolution").agg(
        F.count("*").alias("n_communities"), (F.max("n") / F.sum("n")).alias("largest_share"))
    table = quality.join(shares, "resolution").withColumn(
        "selection_score", F.col("modularity") - penalty * F.col("largest_share"))
    # The window spans one row per resolution.
    best = F.row_number().over(W.orderBy(F.desc(F.round("selection_score", 9)), "resolution"))
    return table.withColumn("selected", best == 1)


def micro_to_final(micro: DataFrame, communities: DataFrame) -> DataFrame:
    """Give every row with a ``micro_id`` the number of its community."""
    mapping = communities.select(F.col("node").alias("micro_id"), F.col("community").alias("cluster_number"))
    return micro.join(mapping, "micro_id", "left")


def renumber_by_size(df: DataFrame, column: str = "cluster_number") -> DataFrame:
    """Cluster numbers 0.. by descending size, then by old number; rows without a number keep none.

    The ranking runs over one row per cluster, dealt to range partitions; the rows only join its result.
    """
    sizes = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("_n"))
    ranked = numbered(sizes, [F.desc("_n"), F.asc(column)], "_new").select(column, (F.col("_new") - 1).cast("int").alias("_new"))
    return df.join(ranked, column, "left").drop(column).withColumnRenamed("_new", column)
