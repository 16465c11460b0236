"""Values at the edge of a function's domain give what the SQL of the query gives."""

import duckdb
import pytest

from tablegauge.operators import cleaning as K, features as G
from tablegauge.queries import load_all

ZERO = "SELECT i AS event_id, [0.0, 0.5, 1.0, 20.25, NULL][i]::DOUBLE AS value FROM range(1, 6) r(i)"


def both(spark, folder, name):
    """Rows of a query and of its SQL over events that hold a zero and a gap, by event_id."""
    con = duckdb.connect()
    con.execute(f"COPY ({ZERO}) TO '{folder}/events.parquet' (FORMAT parquet)")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet'")
    registry = load_all()
    mine = registry.QUERIES[name](spark, folder)
    theirs = con.execute(f"SELECT {', '.join(mine.columns)} FROM ({registry.ORACLE[name]}) ORDER BY event_id").fetchall()
    return [tuple(r) for r in mine.orderBy("event_id").collect()], theirs


def test_clean_log(spark, folder, frame):
    mine, theirs = both(spark, folder, "clean_log")
    assert mine == theirs and mine[0] == (1, float("-inf"))
    with pytest.raises(K.CleaningRefused, match="1 values are negative"):
        K.log_transform(frame("v double", [(-1.0,), (0.0,)]), "v", zeros=True)


def test_apply_transforms(spark, folder, frame):
    mine, theirs = both(spark, folder, "apply_transforms")
    assert mine == theirs and mine[0] == (1, float("-inf"), 0.0, 0.0, 0.0, float("inf"))
    poles = G.apply_transforms(frame("v double", [(-0.0,), (-1.0,), (-2.0,)]), [("v", o) for o in ("reciprocal", "log1p", "log")])
    assert [tuple(r)[1:] for r in poles.collect()] == [(float("-inf"), 0.0, float("-inf")), (-1.0, float("-inf"), None), (-0.5, None, None)]


def test_ridge_cv_gram(spark, folder):
    """An r2 just below 0: balanced rows in every fold, the labels of fold 0 moved a little."""
    from tablegauge.queries.features import UNIT

    con, registry = duckdb.connect(), load_all()
    con.execute(f"""COPY (WITH r AS (SELECT i, {UNIT.format('(i * 10 + 1)').replace('|42', '|43')} % 5 AS fold FROM range(1, 400) r(i)),
      p AS (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY i) - 1 AS nth FROM r)
      SELECT i AS l_orderkey, 1 AS l_linenumber, (nth & 1)::DOUBLE AS l_quantity, ((nth >> 1) & 1)::DOUBLE AS l_discount,
        ((nth >> 2) & 1)::DOUBLE + CASE fold WHEN 0 THEN 0.0002 ELSE 0 END AS l_extendedprice FROM p WHERE nth < 40) TO '{folder}/lineitem.parquet'""")
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{folder}/lineitem.parquet'")
    mine = registry.QUERIES["ridge_cv_gram"](spark, folder)
    theirs = con.execute(f"SELECT {', '.join(mine.columns)} FROM ({registry.ORACLE['ridge_cv_gram']}) WHERE fold = 0").fetchall()
    found = [tuple(r) for r in mine.where("fold = 0").collect()]
    assert len(found) == 8 and {repr(r[4]) for r in theirs} == {"-0.0"}
    assert sorted(map(repr, found)) == sorted(map(repr, theirs))


def test_counts_of_many_parts_are_whole(spark):
    """Sums over parts of unequal size keep the exact number of rows of a fold."""
    from pyspark.ml.functions import array_to_vector
    from pyspark.sql import functions as F

    from tablegauge.operators import gram

    for parts in range(3, 40, 4):
        rows = spark.range(0, 20_011, 1, parts).select(
            array_to_vector(F.array(F.col("id").cast("double"))).alias("features"), F.col("id").alias("label"), (F.col("id") % 7 % 3).alias("fold"))
        assert {k: g[0, 0] for k, g in gram.grams(rows).folds.items()} == {r.fold: r.n for r in rows.groupBy("fold").agg(F.count("*").alias("n")).collect()}
