"""Toxicity by class-conditional Kneser-Ney models.

Words are lower-case runs of letters. For each class c (toxic, ordinary) an interpolated bigram model with absolute
discount D is counted over all training rows::

    P_c(w | u) = max(n_c(u w) - D, 0) / n_c(u .) + lambda_c(u) P_c(w)
    P_c(w)     = max(n_c(w) - D, 0) / n_c + lambda_c P(w)

P(w), the lowest level, is the share of distinct words that w follows, counted over both classes together: what is rare in
both is backed off to the same number and says nothing. Words and word pairs seen less than ``CUT`` times in
all give their mass to the level below. An expression is a word with the word before it; its log-likelihood ratio is
log P_toxic - log P_ordinary at the highest level that knows it.

A text is judged by two length-normalised ratios: the mean over all its words and the mean over its three most toxic
distinct expressions (a long text is not forgiven for being long otherwise). A logistic function of these and
of the length, fitted on training rows that the counts left out, gives the score.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewloom.llm.common import LOWER_ASCII, NOT_LETTER, KeyFilter, constants, cross_fold, keep, mix, sliced, span_hashes, texts

DISCOUNT = 0.75
CUT = 5
TOP = 3
#: The most expressions sent to every task (12 MB), the most frequent; the others are looked up by a join.
HEAD = 1 << 20
#: The most labels that are sent to every task (some 8 MB); more are joined by a shuffle.
SENT_LABELS = 500_000
#: About how many rows at most the logistic function is fitted on, chosen by hash.
FITTED = 20_000
#: At most one training text in so many is left out of the counts and used for the fit.
LEFT_OUT = 5

_PAIR = constants(2, 41)
_BEGIN = constants(1, 43)[0]


class Words(NamedTuple):
    rows: range
    word: np.ndarray
    before: np.ndarray
    first: np.ndarray


def _words(column):
    """Words and the words before them (a marker at the beginning of a text)."""
    for t in texts(column, LOWER_ASCII, NOT_LETTER, latin=True):
        word = span_hashes(t.data, t.begins, t.ends)
        before = np.empty_like(word)
        if len(word):
            before[1:] = word[:-1]
            begins = t.first[:-1]
            before[begins[begins < len(word)]] = _BEGIN
        yield Words(t.rows, word, before, t.first)


def _pair(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mix(before * _PAIR[0] + word * _PAIR[1])


#: Pairs that a task adds up before it sends them.
SUMMED = 1 << 18


def _count_pairs(batches):
    """Word pairs with their counts, toxic above ordinary in one number, summed over some ``SUMMED`` pairs at a time."""
    held, many = [], 0

    def summed():
        before, word, count = (np.concatenate(c) for c in zip(*held))
        _, at, to = np.unique(_pair(before, word), return_index=True, return_inverse=True)
        total = np.zeros(len(at), np.int64)
        np.add.at(total, to, count)
        return before[at], word[at], total

    def sent(rows):
        return pa.RecordBatch.from_arrays([pa.array(c.view(np.int64)) for c in rows], names=["u", "w", "n"])

    for batch in sliced(batches):
        toxic = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
        for t in _words(batch.column(0)):
            one = np.repeat(np.where(toxic[t.rows.start:t.rows.stop] == 1, 1 << 32, 1), np.diff(t.first))
            held.append((t.before, t.word, one))
            many += len(one)
            if many >= SUMMED:
                yield sent(summed())
                held, many = [], 0
    if many:
        yield sent(summed())


def _pair_key():
    """The key of a pair as a number of its own, computed on the executors with the same function as in scoring."""
    @F.pandas_udf("long")
    def key(u, w):
        import pandas as pd

        return pd.Series(_pair(u.to_numpy().view(np.uint64), w.to_numpy().view(np.uint64)).view(np.int64))

    return key("u", "w")


def count_expressions(training: DataFrame) -> tuple[DataFrame, float]:
    """``(key, weight, seen)`` for every word and word pair seen at least ``CUT`` times, and the weight of all others.

    ``training``: text, toxic. Everything is counted with partial sums; no word is one task's work.
    """
    pairs = keep(training.select("text", "toxic").mapInArrow(_count_pairs, "u long, w long, n long")
                 .groupBy("u", "w").agg(F.sum("n").alias("n"))
                 .select("u", "w", F.shiftright("n", 32).alias("t"), F.col("n").bitwiseAND((1 << 32) - 1).alias("o")),
                 "toxic-pairs")
    words = keep(pairs.groupBy("w").agg(F.sum("t").alias("t"), F.sum("o").alias("o"), F.count("*").alias("follows")), "toxic-words")
    kept = F.col("t") + F.col("o") >= CUT
    less = lambda c: F.greatest(F.col(c) - DISCOUNT, F.lit(0.0))
    total = words.agg(*[F.sum(c).alias(c) for c in ("t", "o", "follows")], F.count("*").alias("words"),
                      *[F.sum(F.when(kept, less(c))).alias(f"{c}_kept") for c in ("t", "o")]).first().asDict()
    n = {c: max(1, total[c] or 0) for c in ("t", "o")}
    back = {c: max(1e-9, 1 - (total[f"{c}_kept"] or 0) / n[c]) for c in n}
    types, vocabulary = total["follows"] or 1, total["words"] or 1
    shared = (F.col("follows") + 0.5) / (types + 0.5 * (vocabulary + 1))
    single = words.where(kept).select("w", (F.col("t") + F.col("o")).alias("seen"), *[
        (less(c) / n[c] + back[c] * shared).alias(f"p{c}") for c in n])
    histories = pairs.groupBy("u").agg(*[F.sum(c).alias(f"h{c}") for c in n],
                                       *[F.sum((F.col(c) > 0).cast("long")).alias(f"k{c}") for c in n])
    double = (pairs.where(kept).join(single.drop("seen"), "w").join(histories, "u"))
    for c in n:
        double = double.withColumn(f"q{c}", F.when(F.col(f"h{c}") == 0, F.col(f"p{c}")).otherwise(
            (less(c) + DISCOUNT * F.col(f"k{c}") * F.col(f"p{c}")) / F.col(f"h{c}")))
    weights = (single.select(F.col("w").alias("key"), (F.ln("pt") - F.ln("po")).alias("weight"), "seen")
               .unionByName(double.select(_pair_key().alias("key"), (F.ln("qt") - F.ln("qo")).alias("weight"),
                                          (F.col("t") + F.col("o")).alias("seen"))))
    return keep(weights, "toxic-weights"), float(np.log(back["t"] / back["o"]))


class _Known:
    """Weights by key: sorted keys behind an index of their leading bits."""

    def __init__(self, keys: np.ndarray, weights: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.weights = keys[order], weights[order].astype(np.float32)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """NaN where the key is not known."""
        if not len(self.keys):
            return np.full(len(keys), np.nan, np.float32)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.weights[at], np.float32(np.nan))


def _ratios(documents: DataFrame, weights: DataFrame, rest: float, head: int) -> DataFrame:
    """``(id, row, held_out, label, n, total, top)`` for ``documents`` (id, row, held_out, label, text)."""
    # The most frequent expressions, as many as fit: whole steps of frequency, of which there are a few hundred.
    step = F.floor(F.log2("seen") * 16).cast("int")
    steps = sorted(((r["step"], r["count"]) for r in weights.groupBy(step.alias("step")).count().collect()), reverse=True)
    least, taken = steps[0][0] + 1 if steps else 0, 0
    for at, many in steps:
        if taken + many > head:
            break
        least, taken = at, taken + many
    first = weights.where(step >= least).select("key", F.col("weight").cast("float").alias("weight")).toArrow()
    known = _Known(first["key"].to_numpy().view(np.uint64), first["weight"].to_numpy())
    rare = keep(weights.where(step < least).select("key", "weight"), "toxic-rare") if taken < sum(n for _, n in steps) else None
    may = KeyFilter.of(rare, "key") if rare is not None else None

    def run(batches):
        for batch in sliced(batches):
            rows = len(batch)
            n, total = np.zeros(rows, np.int64), np.zeros(rows)
            top, opened = [[]] * rows, [[]] * rows
            for t in _words(batch.column(4)):
                key = _pair(t.before, t.word)
                distinct, to = np.unique(key, return_inverse=True)
                at = np.empty(len(distinct), np.int64)
                at[to] = np.arange(len(key))
                word = t.word[at]
                pair, single = known(distinct), known(word)
                value = np.where(np.isnan(pair), np.where(np.isnan(single), np.float32(rest), single), pair)
                open_ = np.zeros(len(distinct), bool)
                if may is not None:
                    open_ = np.isnan(pair) & (may(distinct) | (np.isnan(single) & may(word)))
                for k, row in enumerate(t.rows):
                    own = to[t.first[k]:t.first[k + 1]]
                    n[row] = len(own)
                    sure = own[~open_[own]]
                    total[row] = value[sure].sum(dtype=float)
                    each = value[np.unique(sure)]
                    top[row] = np.sort(each)[-TOP:].astype(float)
                    if len(sure) < len(own):
                        distinct_open, times = np.unique(own[open_[own]], return_counts=True)
                        opened[row] = [
                            {"pair": int(distinct[d:d + 1].view(np.int64)[0]), "word": int(word[d:d + 1].view(np.int64)[0]),
                             "known": None if np.isnan(single[d]) else float(single[d]), "times": int(c)}
                            for d, c in zip(distinct_open, times)]
            kind = pa.list_(pa.struct([("pair", pa.int64()), ("word", pa.int64()), ("known", pa.float64()), ("times", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(k) for k in range(4)], pa.array(n), pa.array(total), pa.array(top, pa.list_(pa.float64())),
                 pa.array(opened, kind)], names=["id", "row", "held_out", "label", "n", "total", "top", "open"])

    kind = dict(documents.dtypes)["id"]
    scored = documents.select("id", "row", "held_out", "label", "text").mapInArrow(
        run, f"id {kind}, row long, held_out boolean, label int, n long, total double, top array<double>, "
             "open array<struct<pair: long, word: long, known: double, times: long>>")
    if rare is None:
        return scored.drop("open")
    scored = keep(scored, "toxic-open")
    looked_up = (scored.where(F.size("open") > 0).dropDuplicates(["row"]).select("row", F.inline("open"))
                 .join(rare.select(F.col("key").alias("pair"), F.col("weight").alias("by_pair")), "pair", "left")
                 .join(rare.select(F.col("key").alias("word"), F.col("weight").alias("by_word")), "word", "left")
                 .withColumn("value", F.coalesce("by_pair", "known", "by_word", F.lit(rest))))
    late = looked_up.groupBy("row").agg(F.sum(F.col("times") * F.col("value")).alias("more"),
                                        F.sort_array(F.collect_list("value"), False).alias("late"))
    joined = scored.join(late, "row", "left")
    every = F.sort_array(F.concat("top", F.slice(F.coalesce("late", F.array().cast("array<double>")), 1, TOP)))
    start = F.greatest(F.size(every) - TOP, F.lit(0)) + 1
    return joined.select("id", "row", "held_out", "label", "n",
                         (F.col("total") + F.coalesce("more", F.lit(0.0))).alias("total"),
                         F.slice(every, start, F.lit(TOP)).alias("top"))


def _features(c=F.col) -> list:
    n = F.greatest(c("n"), F.lit(1))
    sum_top = F.aggregate(c("top"), F.lit(0.0), lambda a, x: a + x)
    return [(sum_top / TOP).alias("top_ratio"), (c("total") / n).alias("mean_ratio"), F.log1p(c("n")).alias("length")]


def _fit(x: np.ndarray, y: np.ndarray, penalty: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Newton steps of a ridge logistic regression on standardised columns: centre, scale, coefficients (last: constant)."""
    if len(y) == 0 or y.min() == y.max():
        return np.zeros(x.shape[1]), np.ones(x.shape[1]), np.append(np.eye(1, x.shape[1])[0] * 0, -4.0)
    centre, scale = x.mean(0), np.maximum(x.std(0), 1e-9)
    z = np.column_stack([(x - centre) / scale, np.ones(len(x))])
    ridge = np.diag(np.append(np.full(x.shape[1], penalty), 0.0))
    b = np.zeros(z.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge + 1e-9 * np.eye(len(b)), z.T @ (y - p) - ridge @ b)
        b += step
        if np.abs(step).max() < 1e-8:
            break
    return centre, scale, b


def toxicity_scores(documents: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                    label: str = "toxic", threshold: float = 0.7, head: int = HEAD) -> DataFrame:
    """``(id, row, held_out, score, predicted)``, one row per input row.

    Models and fit use rows of ``labels`` outside the held-out fold (CRC-32 of the id as text, modulo 3, is 1); a document with
    several labels counts with each, one without a label not at all. The text alone is scored. Null and
    empty texts get the score of a text without words; rows with a null id are scored and held out of nothing (the
    fold of null is null, given as false). Without labels of both classes every score is the same low one. Repeated rows get equal
    scores, other columns are left out, an empty table gives no rows.
    """
    rows = documents.select(F.col(id_column).alias("id"), F.xxhash64(id_column, text_column).alias("row"),
                            F.coalesce(cross_fold(id_column) == 1, F.lit(False)).alias("held_out"),
                            F.col(text_column).alias("text"))
    given = labels.select(F.col(id_column).alias("id"), F.col(label).cast("int").alias("label")).where(
        F.col("label").isNotNull() & F.col("id").isNotNull() & (cross_fold("id") != 1))
    candidates = rows.where(~F.col("held_out") & F.col("id").isNotNull())
    # Labels go to the texts while they are small; beyond that only rows that may have a label move.
    if given.count() <= SENT_LABELS:
        given = F.broadcast(given)
    else:
        may = KeyFilter.of(given.select(F.xxhash64("id").alias("key")), "key")

        @F.pandas_udf("boolean")
        def labelled(key):
            import pandas as pd

            return pd.Series(may(key.to_numpy().view(np.uint64)))

        candidates = candidates.where(labelled(F.xxhash64("id")))
    training = (candidates.join(given, "id").withColumn("part", F.pmod(F.xxhash64("text", F.lit(5)), F.lit(LEFT_OUT))))
    # Equal texts are on one side; what the fit does not use is counted.
    many = training.where("part = 0").count()
    bound = (1 << 40) if many <= FITTED else int((1 << 40) * FITTED / many)
    fits = (F.col("part") == 0) & (F.pmod(F.xxhash64("text", F.lit(29)), F.lit(1 << 40)) < bound)
    weights, rest = count_expressions(training.where(~fits).select("text", (F.col("label") == 1).cast("int").alias("toxic")))
    left_out = training.where(fits)
    fitted = _ratios(left_out.select("id", "row", "held_out", "label", "text"), weights, rest, head).select(
        *_features(), (F.col("label") == 1).cast("int").alias("y")).toPandas()
    names = ["top_ratio", "mean_ratio", "length"]
    centre, scale, b = _fit(fitted[names].to_numpy(float), fitted["y"].to_numpy(float))
    scored = _ratios(rows.withColumn("label", F.lit(None).cast("int")), weights, rest, head)
    x = sum((F.col(c) - float(m)) / float(s) * float(k) for c, m, s, k in zip(names, centre, scale, b)) + float(b[-1])
    score = 1 / (1 + F.exp(-x))
    return (scored.select("id", "row", "held_out", *_features()).withColumn("score", score)
            .select(F.col("id").alias(id_column), "row", "held_out", "score",
                    (F.col("score") >= threshold).cast("int").alias("predicted")))
