"""Ranks of few values reach the rows without a shuffle; those of many by one whose parts follow the number of rows."""

import contextlib
import io
import random

from tablegauge.operators import ranktests as R


def average(values):
    ordered = sorted(v for v in values if v is not None)
    first, last = {}, {}
    for i, v in enumerate(ordered, 1):
        first.setdefault(v, i)
        last[v] = i
    return {v: (first[v] + last[v]) / 2 for v in first}


def rows_of(n):
    rng = random.Random(3)
    return [(float(rng.randrange(5)), rng.choice([7.0, 7.0, rng.random(), -0.0, None]), rng.random()) for _ in range(n)]


def ranked(spark, rows):
    return R.rank_rows(spark.createDataFrame(rows, "a double, b double, c double"), ["a", "b", "c"])


def test_ranks_by_both_ways(spark, monkeypatch):
    rows = rows_of(3000)
    sides = [average([r[i] for r in rows]) for i in range(3)]
    wanted = sorted((sides[0][a], sides[1].get(b, -1.0), sides[2][c]) for a, b, c in rows)
    for few, limit, most in ((10_000, 500_000, 200), (10, 200, 200), (0, 200, 3)):
        monkeypatch.setattr(R, "FEW_VALUES", few)
        monkeypatch.setattr(R, "RANKED_ROWS", limit)
        monkeypatch.setattr(R, "RANKED_PARTS", most)
        found = ranked(spark, rows).collect()
        assert sorted((r.r0, -1.0 if r.r1 is None else r.r1, r.r2) for r in found) == wanted


def test_parts_follow_rows(spark, monkeypatch):
    monkeypatch.setattr(R, "FEW_VALUES", 10)
    monkeypatch.setattr(R, "RANKED_ROWS", 50)
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        ranked(spark, rows_of(3000)).explain()
    shuffled = [line for line in out.getvalue().splitlines() if "hashpartitioning(" in line]
    assert shuffled and all(", 60)" in line for line in shuffled)  # 8 whatever the rows before
