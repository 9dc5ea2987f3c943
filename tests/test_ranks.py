"""Numbers and running totals over range partitions against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from reviewloom.operators.ranks import numbered, running


@pytest.mark.parametrize("parts", [1, 7])
def test_numbers_follow_the_order(spark, parts):
    rng = random.Random(3)
    rows = [(k, rng.randrange(5), None if k % 11 == 0 else "x") for k in range(500)]
    df = spark.createDataFrame(rows, "id long, score int, position_note string").repartition(5)
    got = numbered(df, [F.col("score").desc(), F.col("id").asc()], "rank", parts)
    assert got.columns == ["id", "score", "position_note", "rank"]
    want = [r[0] for r in sorted(rows, key=lambda r: (-r[1], r[0]))]
    assert [r.id for r in sorted(got.collect(), key=lambda r: r.rank)] == want
    assert sorted(r.rank for r in got.collect()) == list(range(1, 501))
    assert numbered(df.where("false"), [F.col("id")]).count() == 0


def test_running_totals_cross_parts(spark):
    rng = random.Random(4)
    rows = [(None if k % 50 == 0 else 1 if k % 3 else k % 7, k, None if k % 13 == 0 else rng.randrange(-9, 9)) for k in range(600)]
    df = spark.createDataFrame(rows, "key long, at long, v long").repartition(3)
    got = running(df, ["key"], [F.col("at")], {"s": ("v", "sum"), "x": ("v", "xor"), "m": ("v", "max"), "low": ("v", "min")}, 9)
    want = {}
    state = {}
    for key, at, v in sorted(rows, key=lambda r: r[1]):
        s, x, m, low = state.get(key, (None, None, None, None))
        if v is not None:
            s, x = (v, v) if s is None else (s + v, x ^ v)
            m, low = (v, v) if m is None else (max(m, v), min(low, v))
        state[key] = want[at] = (s, x, m, low)
    assert {r["at"]: (r["s"], r["x"], r["m"], r["low"]) for r in got.collect()} == want
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan
