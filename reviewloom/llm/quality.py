"""Quality rules: text statistics and a learned decision list over them."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewloom.llm.common import IS_SPACE, constants, cross_fold, mix, sample, sliced, span_hashes, spans, texts

FEATURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
IS_BREAK = np.zeros(256, bool)
IS_BREAK[10] = True
#: Bytes that begin a code point of a word.
BEGINS_CHARACTER = ~IS_SPACE & ((np.arange(256) & 0xC0) != 0x80)
_THREE = constants(3, 23)
#: About how many labelled rows at most a list is learned from, chosen by a hash of text and label.
MAX_LABELLED = 50_000


def statistics(column: pa.Array) -> dict[str, np.ndarray]:
    """The five counts of every whole text; null counts as no words."""
    out = {f: np.zeros(len(column), np.int64) for f in FEATURES}
    for t in texts(column):
        hashes = span_hashes(t.data, t.begins, t.ends)
        line_b, line_e = spans(t.data, IS_BREAK[t.data], t.bounds)
        lines, line_first = span_hashes(t.data, line_b, line_e), np.searchsorted(line_b, t.bounds)
        spoken = np.searchsorted(t.begins, line_e) > np.searchsorted(t.begins, line_b)
        chars = np.concatenate([[0], np.cumsum(BEGINS_CHARACTER[t.data])])
        signs = np.concatenate([[0], np.cumsum(SYMBOLS[t.data])])
        triples = mix(hashes[:-2] * _THREE[0] + hashes[1:-1] * _THREE[1] + hashes[2:] * _THREE[2])
        for k, row in enumerate(t.rows):
            a, b = t.first[k], t.first[k + 1]
            out["n_words"][row] = b - a
            out["word_chars"][row] = chars[t.bounds[k + 1]] - chars[t.bounds[k]]
            out["n_symbols"][row] = signs[t.bounds[k + 1]] - signs[t.bounds[k]]
            own = lines[line_first[k]:line_first[k + 1]][spoken[line_first[k]:line_first[k + 1]]]
            out["n_dup_lines"][row] = len(own) - len(np.unique(own))
            if b - a > 3:
                _, at, times = np.unique(triples[a:b - 2], return_inverse=True, return_counts=True)
                again = np.concatenate([[False, False], times[at] > 1, [False, False]])
                out["n_repeat_words"][row] = (again[2:] | again[1:-1] | again[:-2]).sum()
    return out


def with_statistics(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, key)``, one row per input row; ``key`` is a hash of the text."""
    kind = dict(documents.dtypes)[id_column]

    def run(batches):
        for batch in sliced(batches):
            got = statistics(batch.column(1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(got[f]) for f in FEATURES], batch.column(2)], names=["id", *FEATURES, "key"])

    return documents.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"), F.xxhash64(text_column).alias("key")).mapInArrow(
        run, f"id {kind}, " + ", ".join(f"{f} long" for f in FEATURES) + ", key long")


def ratios(c=F.col) -> dict[str, Column]:
    """What the rules look at; each is a number for every text (no words: 0)."""
    words = F.greatest(c("n_words"), F.lit(1))
    return {
        "n_words": c("n_words").cast("double"),
        "mean_word": c("word_chars") / words,
        "symbol_share": c("n_symbols") / words,
        "dup_lines": c("n_dup_lines").cast("double"),
        "repeat_share": c("n_repeat_words") / words,
    }


class Rule(NamedTuple):
    """A conjunction of thresholds ``(feature, is it an upper bound, value)`` and the verdict where it holds."""

    conditions: tuple[tuple[str, bool, float], ...]
    good: bool


class DecisionList(NamedTuple):
    rules: tuple[Rule, ...]
    otherwise: bool

    def verdict(self, features: dict[str, Column]) -> Column:
        """The ordered conditional expression."""
        out = None
        for rule in self.rules:
            holds = reduce(lambda a, b: a & b, [
                features[f] <= F.lit(v) if upper else features[f] >= F.lit(v) for f, upper, v in rule.conditions])
            out = F.when(holds, F.lit(rule.good)) if out is None else out.when(holds, F.lit(rule.good))
        return F.lit(self.otherwise) if out is None else out.otherwise(F.lit(self.otherwise))


def learn(values: dict[str, np.ndarray], good: np.ndarray, max_rules: int = 24, max_conditions: int = 4,
          min_precision: float = 0.9, min_cover: int = 5, seed: int = 7, key: np.ndarray | None = None) -> DecisionList:
    """Sequential covering of the bad rows.

    A rule is grown on two thirds of the rows (by a hash of ``key``, where one is given, so that the order of the rows does not
    matter) that no rule holds for yet, by the threshold of the largest
    information gain, then pruned on the last third: final conditions go while the worth (bad - good) / covered does
    not fall. It is kept if at least ``min_precision`` of what it covers in both parts is bad. A list that finds no
    rule, or has no labels, passes everything.
    """
    names = list(values)
    x = np.column_stack([values[n] for n in names]) if len(good) else np.zeros((0, len(names)))
    bad = ~np.asarray(good, bool)
    if key is None:
        grow = np.random.default_rng(seed).random(len(bad)) < 2 / 3
    else:
        with np.errstate(over="ignore"):
            grow = mix(mix(np.asarray(key, np.uint64)) + constants(seed, 79)[-1]) % np.uint64(3) < 2
    left = np.ones(len(bad), bool)
    rules: list[Rule] = []

    def holds(conditions, rows):
        ok = np.ones(len(rows), bool)
        for f, upper, v in conditions:
            ok &= rows[:, f] <= v if upper else rows[:, f] >= v
        return ok

    def best_condition(rows, is_bad):
        p0, n0 = is_bad.sum(), (~is_bad).sum()
        base = np.log2(p0 / (p0 + n0))
        best = (0.0, None)
        for f in range(len(names)):
            order = np.argsort(rows[:, f], kind="stable")
            v, y = rows[order, f], is_bad[order]
            change = np.flatnonzero(v[1:] > v[:-1])
            if not len(change):
                continue
            p = np.cumsum(y)[change].astype(float)
            n = np.cumsum(~y)[change].astype(float)
            middle = (v[change] + v[change + 1]) / 2
            for upper, a, b in ((True, p, n), (False, p0 - p, n0 - n)):
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where((a > 0) & (a + b >= min_cover), a * (np.log2(a / (a + b)) - base), -1)
                k = int(np.argmax(gain))
                if gain[k] > best[0] + 1e-9:
                    best = (gain[k], (f, upper, float(middle[k])))
        return best[1]

    while len(rules) < max_rules:
        now = grow & left
        if bad[now].sum() < min_cover:
            break
        conditions = []
        while len(conditions) < max_conditions:
            inside = now.copy()
            inside[now] = holds(conditions, x[now])
            if not (~bad[inside]).any() or not bad[inside].any():
                break
            found = best_condition(x[inside], bad[inside])
            if found is None:
                break
            conditions.append(found)
        if not conditions:
            break
        rest, rest_bad = x[~grow & left], bad[~grow & left]

        def worth(c):
            h = holds(c, rest)
            return ((h & rest_bad).sum() - (h & ~rest_bad).sum()) / max(1, h.sum())

        while len(conditions) > 1 and worth(conditions[:-1]) >= worth(conditions):
            conditions.pop()
        covered = left & holds(conditions, x)
        if covered.sum() < min_cover or bad[covered].mean() < min_precision:
            break
        rules.append(Rule(tuple((names[f], u, v) for f, u, v in conditions), False))
        left &= ~covered
    return DecisionList(tuple(rules), True)


def learn_rules(stats: DataFrame, labels: DataFrame, id_column: str = "doc_id", label: str = "quality",
                max_labelled: int = MAX_LABELLED, **options) -> DecisionList:
    """A list learned from labelled rows of :func:`with_statistics` outside the held-out fold.

    About ``max_labelled`` rows at most are used, chosen by a hash of text and label: a sample that does not
    depend on partitions. Rows without a label or statistics teach nothing; a document with several labels counts
    with each.
    """
    given = labels.select(F.col(id_column).alias("id"), F.col(label).cast("int").alias("__label")).where(
        F.col("__label").isNotNull() & (cross_fold("id") != 1))
    rows = (sample(stats.join(given, "id"), max_labelled, "key", "__label")
            .select(*[v.alias(n) for n, v in ratios().items()], "__label", "key")).toArrow()
    good, key = rows["__label"].to_numpy() == 1, rows["key"].to_numpy().view(np.uint64)
    # A text that is labelled both ways lies in one part with each label by itself.
    return learn({n: rows[n].to_numpy() for n in ratios(F.col)}, good, key=key ^ good.astype(np.uint64), **options)


def quality_verdicts(documents: DataFrame, labels: DataFrame, id_column: str = "doc_id",
                     text_column: str = "text", **options) -> DataFrame:
    """Statistics, ``base_failed`` and ``kept`` of every row.

    ``base_failed``: fewer than 50 words, or more than half of the words lie in repeated three-word windows. ``kept`` is
    false there, else the verdict of the learned list. Null and empty texts have no words and fail; repeated rows get
    equal verdicts; other columns are left out; an empty table gives no rows.
    """
    stats = with_statistics(documents, id_column, text_column)
    rules = learn_rules(stats, labels, id_column, **options)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return stats.select(F.col("id").alias(id_column), *FEATURES, failed.alias("base_failed"),
                        (~failed & rules.verdict(ratios())).alias("kept"))
