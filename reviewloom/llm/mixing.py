"""Mixing sources to target weights by a minimum-cost flow over membership patterns."""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reviewloom.llm.common import WORD, keep

#: Hash ranges a pattern's documents are dealt into; only the range of a cut is looked at row by row.
BUCKETS = 4096


def target_quotas(sizes: list[int], weights: list[float], most: int) -> list[float]:
    """Shares of the total size by weight; a share stops at ``most`` times its source's size, and what is
    over goes to the others by weight until none is above."""
    total = float(sum(sizes))
    capped = [False] * len(sizes)
    while True:
        left = total - sum(most * s for s, c in zip(sizes, capped) if c)
        weight = sum(w for w, c in zip(weights, capped) if not c)
        over = [k for k, s in enumerate(sizes)
                if not capped[k] and weights[k] * left / weight > most * s]
        if not over:
            return [float(most * s) if c else w * left / weight for s, w, c in zip(sizes, weights, capped)]
        for k in over:
            capped[k] = True


def min_cost_flow(supply: list[int], members: list[list[int]], quotas: list[int], most: int) -> dict:
    """``(pattern, source) -> [tokens at repetition 1, 2, ...]`` of least cost.

    Arcs: start -> pattern once for each repetition (capacity: the pattern's size; cost 1, 2, 4, ..., a convex price,
    so a second use starts only where every first use that could help is taken), pattern -> source (free), source ->
    end (capacity: the quota). Successive shortest paths with potentials; every round saturates an arc.
    """
    patterns, sources = len(supply), len(quotas)
    start, end = patterns + sources, patterns + sources + 1
    arcs: list[list[int]] = []  # to, capacity left, cost, number of the reverse arc
    of: list[list[int]] = [[] for _ in range(end + 1)]

    def arc(a: int, b: int, capacity: int, cost: int) -> int:
        of[a].append(len(arcs))
        of[b].append(len(arcs) + 1)
        arcs.extend(([b, capacity, cost, len(arcs) + 1], [a, 0, -cost, len(arcs)]))
        return len(arcs) - 2

    for p, size in enumerate(supply):
        for level in range(most):
            arc(start, p, size, 1 << level)
    routed = {(p, s): arc(p, patterns + s, supply[p] * most, 0) for p, own in enumerate(members) for s in own}
    for s, quota in enumerate(quotas):
        arc(patterns + s, end, quota, 0)
    potential = [0] * (end + 1)
    while True:
        far = [float("inf")] * (end + 1)
        via = [-1] * (end + 1)
        far[start] = 0
        heap = [(0, start)]
        while heap:
            d, a = heapq.heappop(heap)
            if d > far[a]:
                continue
            for k in of[a]:
                b, capacity, cost, _ = arcs[k]
                if capacity and (new := d + cost + potential[a] - potential[b]) < far[b]:
                    far[b], via[b] = new, k
                    heapq.heappush(heap, (new, b))
        if far[end] == float("inf"):
            break
        reached = max(x for x in far if x < float("inf"))
        potential = [p + min(x, reached) for p, x in zip(potential, far)]
        path, b = [], end
        while b != start:
            path.append(via[b])
            b = arcs[arcs[via[b]][3]][0]
        flow = min(arcs[k][1] for k in path)
        for k in path:
            arcs[k][1] -= flow
            arcs[arcs[k][3]][1] += flow
    return {key: supply[key[0]] * most - arcs[k][1] for key, k in routed.items() if supply[key[0]] * most > arcs[k][1]}


def default_weights(n: int) -> list[float]:
    return [float(k % 3 + 1) for k in range(n)]


def mix_sources(documents: DataFrame, weights=default_weights, most: int = 3, seed: int = 1,
                id_column: str = "doc_id", text_column: str = "text", sources_column: str = "source"
                ) -> tuple[DataFrame, DataFrame]:
    """How often each document is used, and for which source.

    ``sources_column`` is a string or an array of strings (a document found in several sources). Gives two tables:

    * rows: one per input row, ``(id, size, pattern, seeded, repeats, use array<struct<source, tokens>>)``; size is the
      number of words of the whole text (null text: 0); ``repeats`` 0 to ``most``;
    * sources: ``(source, source_size, weight, target)``.

    Sources are weighed in order of code points, null last; a null element or array is the source null. Documents are
    summed by membership pattern on the executors; only patterns and sources come to the driver, and the flow is solved
    over them. A pattern's documents are then put in seeded order of their hash and the routed tokens laid out along
    it, level by level: a document whose midpoint lies in a stretch is used for it. Sums run over 4,096 hash
    ranges per pattern and row by row only in the ranges that hold a cut, so no pattern is one task's work. Ties in the
    hash go by id, then text hash; equal rows are used alike up to their order. Empty input gives no rows.
    """
    kind = dict(documents.dtypes)[sources_column]
    names = F.col(sources_column) if kind.startswith("array") else F.array(F.col(sources_column))
    names = F.when(F.coalesce(F.size(names), F.lit(0)) < 1, F.array(F.lit(None).cast("string"))).otherwise(
        F.array_sort(F.array_distinct(names)))
    text = F.col(text_column)
    rows = keep(documents.select(
        F.col(id_column).alias("id"),
        F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        names.alias("pattern"),
        F.xxhash64(F.lit(seed), F.col(id_column), text).alias("seeded")), "mix-sizes")
    bucket = F.shiftrightunsigned("seeded", 52)
    summed = rows.groupBy("pattern", bucket.alias("bucket")).agg(F.sum("size").alias("size"))
    summed = keep(summed, "mix-buckets")
    patterns = [(tuple(r["pattern"]), r["size"]) for r in
                summed.groupBy("pattern").agg(F.sum("size").alias("size")).collect()]
    order = lambda s: (s is None, s or "")
    patterns.sort(key=lambda p: [order(s) for s in p[0]])
    sources = sorted({s for p, _ in patterns for s in p}, key=order)
    number = {s: k for k, s in enumerate(sources)}
    given = weights(len(sources)) if callable(weights) else [float(weights[s]) for s in sources]
    # A document in several sources counts for each of them in its size, once in the total.
    sizes = [sum(size for p, size in patterns if s in p) for s in sources]
    targets = _targets(patterns, sources, sizes, given, most)
    flow = min_cost_flow([size for _, size in patterns], [[number[s] for s in p] for p, _ in patterns],
                         [round(t) for t in targets], most)
    stretches = []  # pattern, source, from, to: places along all the levels of the pattern
    for k, (pattern, size) in enumerate(patterns):
        at = 0
        for s in pattern:
            taken = flow.get((k, number[s]), 0)
            if taken:
                stretches.append((list(pattern), s, at, at + taken, size))
                at += taken
    spark = documents.sparkSession
    return _select(rows, summed, stretches, most), spark.createDataFrame(
        list(zip(sources, sizes, given, targets)), "source string, source_size long, weight double, target double")


def _targets(patterns, sources, sizes, weights, most) -> list[float]:
    total = sum(size for _, size in patterns)
    if not total:
        return [0.0] * len(sources)
    quotas = target_quotas(sizes, weights, most)
    # Shares are of what there is once, also where sources overlap.
    scale = total / sum(sizes)
    return quotas if scale == 1 else [q * scale for q in quotas]


def _select(rows: DataFrame, summed: DataFrame, stretches: list, most: int) -> DataFrame:
    spark = rows.sparkSession
    laid = spark.createDataFrame(
        stretches, "pattern array<string>, source string, low long, high long, whole long")
    per_pattern = laid.groupBy("pattern").agg(
        F.first("whole").alias("whole"),
        F.sort_array(F.collect_list(F.struct("low", "high", "source"))).alias("laid"))
    bucket = F.shiftrightunsigned("seeded", 52)
    # At most 4,096 rows for a pattern; places before every range.
    places = summed.withColumn("before", F.sum("size").over(
        W.partitionBy("pattern").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)))
    places = (places.join(per_pattern, "pattern")
              .withColumn("before", F.coalesce("before", F.lit(0)))
              .withColumn("cut", F.exists("laid", lambda x: F.pmod(x["high"], F.col("whole")).between(
                  F.col("before"), F.col("before") + F.col("size")))))
    placed = rows.withColumn("bucket", bucket).join(
        places.select("pattern", "bucket", "before", "cut", "laid", "whole"), ["pattern", "bucket"], "left")
    inside = W.partitionBy("pattern", "bucket").orderBy("seeded", "id").rowsBetween(W.unboundedPreceding, -1)
    cut = placed.where(F.col("cut")).withColumn(
        "mid", F.col("before") + F.coalesce(F.sum("size").over(inside), F.lit(0)) + F.col("size") / 2)
    whole = placed.where(~F.coalesce(F.col("cut"), F.lit(False))).withColumn("mid", F.col("before") + F.lit(0.5))
    uses = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda level: F.transform(
        F.filter("laid", lambda x: (F.col("mid") + level * F.col("whole") >= x["low"])
                 & (F.col("mid") + level * F.col("whole") < x["high"])), lambda x: x["source"])))
    uses = F.when(F.col("size") > 0, F.coalesce(uses, F.array().cast("array<string>"))).otherwise(
        F.array().cast("array<string>"))
    return cut.unionByName(whole).withColumn("use", uses).select(
        "id", "size", "pattern", "seeded", F.size("use").alias("repeats"), "use")
