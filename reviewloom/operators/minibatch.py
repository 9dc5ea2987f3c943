"""Mini-batch k-means: a bounded number of hash-drawn batches, whatever the size of the table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewloom.operators.neighbors import _matrix
from reviewloom.session import materialize

BATCH_ROWS = 4096
BATCHES = 100
STARTS = 10
#: A centre with less than this share of the largest centre's weight is set anew.
REASSIGNMENT_RATIO = 0.01
#: Batches without a better smoothed inertia after which the centres are settled.
PATIENCE = 10


def _squares(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum((x ** 2).sum(axis=1)[:, None] + (centres ** 2).sum(axis=1) - 2 * x @ centres.T, 0)


def first_centres(x: np.ndarray, weight: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k-means++: each next centre is a row drawn by weight times squared distance to the nearest centre so far."""
    chosen = [int(rng.choice(len(x), p=weight / weight.sum()))]
    gap = _squares(x, x[chosen]).ravel()
    while len(chosen) < k:
        mass = gap * weight
        total = mass.sum()
        at = int(rng.choice(len(x), p=mass / total)) if total > 0 else int(rng.integers(len(x)))
        chosen.append(at)
        gap = np.minimum(gap, _squares(x, x[at:at + 1]).ravel())
    return x[chosen]


class Centres:
    """Centres under way: each moves by the share of its weight that a batch brings."""

    def __init__(self, centres: np.ndarray, rng: np.random.Generator):
        self.at, self.rng = centres.astype(float), rng
        self.mass = np.zeros(len(centres))
        self.steps, self.smooth, self.best, self.waited = 0, None, np.inf, 0

    def update(self, x: np.ndarray, weight: np.ndarray) -> bool:
        """One batch; False once the centres are settled."""
        squares = _squares(x, self.at)
        near = squares.argmin(axis=1)
        inertia = float((squares[np.arange(len(x)), near] * weight).sum() / weight.sum())
        self.steps += 1
        if self.steps % 10 == 0:
            self._reassign(x)
            near = _squares(x, self.at).argmin(axis=1)
        brought = np.bincount(near, weights=weight, minlength=len(self.at))
        total = np.zeros_like(self.at)
        np.add.at(total, near, x * weight[:, None])
        used = brought > 0
        self.mass[used] += brought[used]
        self.at[used] += (total[used] - brought[used, None] * self.at[used]) / self.mass[used, None]
        self.smooth = inertia if self.smooth is None else 0.9 * self.smooth + 0.1 * inertia
        if self.smooth < self.best:
            self.best, self.waited = self.smooth, 0
        else:
            self.waited += 1
        return self.waited < PATIENCE

    def _reassign(self, x: np.ndarray) -> None:
        starved = np.flatnonzero(self.mass < REASSIGNMENT_RATIO * self.mass.max())[:len(x) // 2]
        if len(starved):
            self.at[starved] = x[self.rng.choice(len(x), len(starved), replace=False)]
            kept = np.delete(self.mass, starved)
            self.mass[starved] = kept.min() if len(kept) else 0.0


def minibatch_centres(points: DataFrame, k: int, weight: str | None = None, seed: int = 42, batch_rows: int = BATCH_ROWS,
                      batches: int = BATCHES, starts: int = STARTS) -> np.ndarray:
    """``k`` centres of ``points`` (vector, and a weight column if named), as a matrix.

    Equal vectors are one row with the sum of their weights. ``starts`` first centres are drawn from a sample of about three batches and the
    best of them goes on. A batch is what a hash of the vector deals into it, between one and two times ``batch_rows`` rows; an epoch deals
    out all rows. What one task sees is bounded by ``batches`` batches, and the result does not depend on partitions.
    """
    mass = F.col(weight).cast("double") if weight else F.lit(1.0)
    rows = materialize(points.where(F.col("vector").isNotNull() & (mass > 0)).groupBy("vector").agg(F.sum(mass).alias("weight")), "batch-rows")
    n = rows.count()
    if n == 0:
        raise ValueError("no vectors to cluster")
    k = min(k, n)

    def dealt(label: str):
        return F.xxhash64("vector", F.lit(label), F.lit(seed))

    share = min(1.0, 3 * batch_rows / n)
    some = rows.where(F.pmod(dealt("start"), F.lit(1 << 30)) < int(share * (1 << 30)) + 1).withColumn("order", dealt("order"))
    tried = some.withColumn("start", F.explode(F.sequence(F.lit(0), F.lit(starts - 1))))

    def begin(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("order")
        x, w = _matrix(frame["vector"]), frame["weight"].to_numpy()
        centres = first_centres(x, w, min(k, len(x)), np.random.default_rng([seed, key[0]]))
        inertia = float((_squares(x, centres).min(axis=1) * w).sum())
        return pd.DataFrame({"start": [key[0]], "inertia": [inertia], "centres": [list(map(list, centres))]})

    found = materialize(tried.groupBy("start").applyInPandas(begin, "start int, inertia double, centres array<array<double>>"), "batch-starts")
    best = found.orderBy("inertia", "start").limit(1).select("centres").first()
    centres = np.array(best["centres"], dtype=float)

    each = max(1, n // batch_rows)
    epochs = -(-batches // each)
    dealt_rows = (rows.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
                  .withColumn("place", F.xxhash64("vector", "epoch", F.lit(seed)))
                  .withColumn("batch", (F.col("epoch") * each + F.pmod("place", F.lit(each))).cast("int")).where(F.col("batch") < batches))

    def fit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state, number, held, going = Centres(centres, np.random.default_rng(seed)), None, [], True

        def step() -> bool:
            rows_of = pd.concat(held)
            return state.update(_matrix(rows_of["vector"]), rows_of["weight"].to_numpy())

        for frame in frames:
            if not going:
                continue
            for batch, part in frame.groupby("batch", sort=True):
                if held and batch != number:
                    going = step()
                    held = []
                    if not going:
                        break
                number = batch
                held.append(part)
        if going and held:
            step()
        yield pd.DataFrame({"label": np.arange(len(state.at), dtype="int32"), "centroid": [list(c) for c in state.at]})

    # One task takes the batches in turn; their number and size are fixed.
    fitted = (dealt_rows.select("batch", "place", "vector", "weight").repartition(1).sortWithinPartitions("batch", "place", "weight")
              .mapInPandas(fit, "label int, centroid array<double>")).collect()
    return np.array([r["centroid"] for r in sorted(fitted, key=lambda r: r["label"])], dtype=float)
