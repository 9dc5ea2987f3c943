"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Runs of one to three characters of the lower-cased whole text (everything that is no letter is one kind of
blank) are hashed to ``SLOTS`` features; weights are ``(1 + ln count) * idf`` on the unit sphere. The document
frequencies come from every training text. The regression is trained online with follow-the-regularised-leader
updates under an elastic-net penalty, which leaves most weights at zero; a temperature fitted on rows that it
has not seen makes its probabilities honest.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reviewloom.llm.common import constants, cross_fold

SLOTS_LOG2 = 15
SLOTS = 1 << SLOTS_LOG2
ORDERS = 3
#: The most rows the regression is trained on, dealt evenly over the languages, the smallest by hash; one in five is
#: kept for the temperature.
FITTED = 6000
EPOCHS = 3
#: Characters that one round of array work covers.
STRETCH = 1 << 20
UNKNOWN = "und"

_GRAM = constants(ORDERS + 1, 61)
_LETTER = np.array([chr(k).isalpha() for k in range(0x250)])


def counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Features of a text and how often each occurs."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    points = np.where((points >= 0x250) | _LETTER[np.minimum(points, 0x24F)], points, 32).astype(np.uint64)
    total = np.zeros(SLOTS, np.int64)
    shift = np.uint64(64 - SLOTS_LOG2)
    for lo in range(0, len(points), STRETCH):
        part = points[lo:lo + STRETCH + ORDERS - 1]
        for n in range(1, ORDERS + 1):
            # Runs begin in the stretch and may end in the next.
            many = min(STRETCH, len(part) - n + 1)
            if many < 1:
                continue
            key = np.full(many, _GRAM[ORDERS] * np.uint64(n), np.uint64)
            for j in range(n):
                key = (key ^ part[j:j + many]) * _GRAM[j]
                key ^= key >> np.uint64(29)
            total += np.bincount(((key * _GRAM[0]) >> shift).astype(np.int64), minlength=SLOTS)
    used = np.flatnonzero(total)
    return used, total[used]


class Model(NamedTuple):
    languages: tuple[str, ...]
    idf: np.ndarray
    weights: np.ndarray
    constant: np.ndarray
    temperature: float

    def features(self, used: np.ndarray, times: np.ndarray) -> np.ndarray:
        x = (1 + np.log(times)) * self.idf[used]
        return x / max(1e-12, float(np.sqrt(x @ x)))

    def probabilities(self, used: np.ndarray, times: np.ndarray) -> np.ndarray:
        z = (self.features(used, times) @ self.weights[used] + self.constant) / self.temperature
        p = np.exp(z - z.max())
        return p / p.sum()


def ftrl(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, classes: int, alpha: float = 0.5, beta: float = 1.0,
         l1: float = 0.02, l2: float = 1e-3, epochs: int = EPOCHS, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Weights ``[slot, class]`` and constants; ``rows`` are (slots, values)."""
    z = np.zeros((SLOTS + 1, classes))
    n = np.zeros((SLOTS + 1, classes))

    def weights(at):
        zz = z[at]
        return np.where(np.abs(zz) <= l1, 0.0, -(zz - np.sign(zz) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2))

    random = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in random.permutation(len(rows)):
            at = np.append(rows[i][0], SLOTS)
            x = np.append(rows[i][1], 1.0)
            w = weights(at)
            s = x @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y[i]] -= 1
            g = x[:, None] * p
            squares = g * g
            z[at] += g - (np.sqrt(n[at] + squares) - np.sqrt(n[at])) / alpha * w
            n[at] += squares
    w = weights(np.arange(SLOTS + 1))
    return w[:SLOTS], w[SLOTS]


def fit_temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least log loss, by golden section on its logarithm."""
    if not len(y):
        return 1.0

    def loss(t):
        z = logits / np.exp(t)
        z = z - z.max(1, keepdims=True)
        return float((np.log(np.exp(z).sum(1)) - z[np.arange(len(y)), y]).mean())

    lo, hi, ratio = np.log(0.02), np.log(10.0), (np.sqrt(5) - 1) / 2
    while hi - lo > 1e-4:
        a, b = hi - ratio * (hi - lo), lo + ratio * (hi - lo)
        lo, hi = (lo, b) if loss(a) <= loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


def _frequencies(batches):
    seen, rows = np.zeros(SLOTS, np.int64), 0
    for batch in batches:
        for text in batch.column(0):
            seen[counts(text.as_py() or "")[0]] += 1
            rows += 1
    used = np.flatnonzero(seen)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(used, -1)), pa.array(np.append(seen[used], rows))], names=["slot", "many"])


def _sparse(batches):
    for batch in batches:
        got = [counts(t.as_py() or "") for t in batch.column(2)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array([u.astype(np.int32) for u, _ in got], pa.list_(pa.int32())),
             pa.array([t.astype(np.float32) for _, t in got], pa.list_(pa.float32()))], names=["lang", "order", "used", "times"])


def train(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang: str = "lang",
          fitted: int = FITTED) -> Model | None:
    """A model of the languages given to rows outside the held-out fold; None if there is no such row with a letter."""
    rows = documents.where(F.col(lang).isNotNull() & (cross_fold(id_column) != 1) & F.col(text_column).rlike(r"\p{L}")).select(
        F.col(lang).cast("string").alias("lang"), F.col(text_column).alias("text"))
    frequency = rows.select("text").mapInArrow(_frequencies, "slot long, many long").groupBy("slot").agg(
        F.sum("many").alias("many")).toPandas()
    total = int(frequency.loc[frequency["slot"] == -1, "many"].sum())
    if not total:
        return None
    known = frequency[frequency["slot"] >= 0]
    seen = np.zeros(SLOTS)
    seen[known["slot"].to_numpy(np.int64)] = known["many"]
    idf = np.log((1 + total) / (1 + seen)) + 1
    # Chosen by keys alone: the rank limit is applied before the rows of a language meet, and texts follow for the few chosen.
    keyed = rows.select("lang", F.xxhash64("text", F.lit(17)).alias("order"))
    chosen = (keyed.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy("order")))
              .where(F.col("rank") <= fitted).orderBy("rank", "order", "lang").limit(fitted).select("lang", "order").distinct())
    texts = rows.withColumn("order", F.xxhash64("text", F.lit(17))).join(F.broadcast(chosen), ["lang", "order"])
    texts = texts.select("lang", "order", "text").dropDuplicates(["lang", "order"])
    fit = texts.mapInArrow(_sparse, "lang string, order long, used array<int>, times array<float>").toArrow().sort_by(
        [("order", "ascending"), ("lang", "ascending")])
    given = fit["lang"].to_pylist()
    languages = tuple(sorted(set(given)))
    blank = Model(languages, idf, np.zeros((SLOTS, len(languages))), np.zeros(len(languages)), 1.0)
    at = [u.values.to_numpy() for u in fit["used"]]
    x = [blank.features(u, t.values.to_numpy()).astype(np.float32) for u, t in zip(at, fit["times"])]
    y = np.array([languages.index(v) for v in given])
    kept = np.arange(len(y)) % 5 == 4
    learned = np.flatnonzero(~kept)
    weights, constant = ftrl([(at[i], x[i]) for i in learned], y[learned], len(languages))
    logits = np.array([x[i] @ weights[at[i]] + constant for i in np.flatnonzero(kept)]).reshape(-1, len(languages))
    return Model(languages, idf, weights.astype(np.float32), constant, fit_temperature(logits, y[kept]))


def identify(documents: DataFrame, model: Model | None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``(id, held_out, lang_pred, score)``, one row per input row.

    ``und`` with score 0 where the text is null, empty or has no letter, and for every row without a model. The fold of a
    null id is given as false. Repeated rows get equal results; ties go to the smaller language name; other columns are left
    out; an empty table gives no rows.
    """
    kind = dict(documents.dtypes)[id_column]

    def run(batches):
        for batch in batches:
            named, score = [], []
            for text, spoken in zip(batch.column(2), batch.column(3).to_pylist()):
                if model is None or not spoken:
                    named.append(UNKNOWN)
                    score.append(0.0)
                    continue
                p = model.probabilities(*counts(text.as_py()))
                named.append(model.languages[int(p.argmax())])
                score.append(float(p.max()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(named, pa.string()), pa.array(score, pa.float64())],
                                             names=["id", "held_out", "lang_pred", "score"])

    return documents.select(
        F.col(id_column).alias("id"), F.coalesce(cross_fold(id_column) == 1, F.lit(False)).alias("held_out"),
        F.col(text_column).alias("text"), F.coalesce(F.col(text_column).rlike(r"\p{L}"), F.lit(False)).alias("spoken")).mapInArrow(
        run, f"id {kind}, held_out boolean, lang_pred string, score double").withColumnRenamed("id", id_column)
