import math

import numpy as np

from tablegauge.llm import vectors as v


def brute(rows, threshold):
    unit = lambda x: np.array(x, float) / max(map(abs, x)) / np.linalg.norm(np.array(x, float) / max(map(abs, x)))
    good = [(k, unit(x), lab) for k, x, lab in rows if k is not None and lab is not None and x and all(
        c is not None and math.isfinite(c) for c in x) and any(x)]
    links = {k: set() for k, *_ in rows}
    for a, x, p in good:
        for b, y, q in good:
            if a != b and p == q and len(x) == len(y) and x @ y >= threshold:
                links[a].add(b)
    least = {}
    for k in links:
        seen, todo = {k}, [k]
        while todo:
            for n in links[todo.pop()]:
                if n not in seen:
                    seen.add(n)
                    todo.append(n)
        least[k] = min(seen, key=lambda z: (z is None, z))
    return {k: (len(links[k]), least[k]) for k in links}


def test_matches_brute_force_over_blocks(spark):
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((6, 16))
    rows = [(i, [float(np.float32(x)) for x in centres[i % 6] + rng.standard_normal(16) * (0.06 if i % 3 else 0.5)], int(i % 2)) for i in range(300)]
    rows += [(300 + i, rows[0][1], 0) for i in range(5)]
    rows += [(400, [0.0] * 16, 0), (401, None, 0), (402, [1.0, None], 0), (403, [float("nan")] * 16, 0), (404, rows[0][1], None),
             (405, [float("inf")] * 16, 1), (406, [], 1), (407, [1e300, 1e300], 1), (408, [1.0, 1.0], 1), (409, [-1.0, -1.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").selectExpr("*", "1 AS node", "2 AS n")
    found = {r.vec_id: (r.n_links, r.component_id) for r in v.near_vectors(df, block=20).collect()}
    assert found == brute(rows, 0.98)


def test_repeated_rows_and_empty_table(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], 3), (1, [1.0, 0.0], 3), (None, [1.0, 0.0], 3)], "vec_id long, embedding array<float>, label int")
    assert sorted((r.vec_id or 0, r.n_links, r.component_id) for r in v.near_vectors(df).collect()) == [(0, 0, None), (1, 1, 1), (1, 1, 1)]
    assert v.near_vectors(df.limit(0)).count() == 0


def test_table_count_follows_recall():
    k, tables = v.shape(10**6, 0.98, 0.999)
    assert (1 - v.meet(0.2, v.CELL) ** k) ** tables <= 0.001
    assert v.shape(10**9, 0.98, 0.999)[0] > k
