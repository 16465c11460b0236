"""Nearest-neighbour and k-NN mutual information queries."""

from pyspark.sql import functions as F

from tablegauge.operators import neighbours as N
from tablegauge.queries.registry import query, rounded, table


def mi_sql(points: str, k: int = 3) -> str:
    """Brute force over all pairs: k-th Chebyshev distance, strict counts per axis, digamma by harmonic sums."""
    return f"""WITH p AS (SELECT row_number() OVER () AS i, x, y FROM ({points})),
    d AS (SELECT a.i, min(greatest(abs(a.x - b.x), abs(a.y - b.y)), {k}) AS near FROM p a JOIN p b ON a.i <> b.i GROUP BY a.i),
    e AS (SELECT i, near[{k}] AS eps FROM d),
    c AS (SELECT a.i, count(*) FILTER (abs(a.x - b.x) < eps OR (eps = 0 AND a.x = b.x)) AS nx,
      count(*) FILTER (abs(a.y - b.y) < eps OR (eps = 0 AND a.y = b.y)) AS ny
      FROM p a JOIN e ON e.i = a.i JOIN p b ON a.i <> b.i GROUP BY a.i),
    n AS (SELECT count(*) AS n FROM p),
    h AS (SELECT m, -0.57721566490153286 + sum(CASE WHEN m > 1 THEN 1.0::DOUBLE / (m - 1) ELSE 0 END) OVER (ORDER BY m) AS psi
      FROM range(1, (SELECT n + 2 FROM n)) t(m)),
    s AS (SELECT avg(hx.psi + hy.psi) AS t FROM c JOIN h hx ON hx.m = nx + 1 JOIN h hy ON hy.m = ny + 1)
    SELECT n.n AS n, round((SELECT psi FROM h WHERE m = {k}) + (SELECT psi FROM h WHERE m = n.n) - s.t, 6) + 0.0::DOUBLE AS raw FROM s, n"""


@query("knn_mutual_information", mi_sql("SELECT s_acctbal AS x, s_nationkey::DOUBLE AS y FROM supplier"))
def knn_mutual_information(spark, sf):
    result = N.knn_mutual_information(table(spark, sf, "supplier"), "s_acctbal", "s_nationkey")
    return rounded(result.select("n", "raw"))


@query("knn_mutual_information_documents", mi_sql("SELECT n_chars::DOUBLE AS x, doc_id::DOUBLE AS y FROM documents"))
def knn_mutual_information_documents(spark, sf):
    result = N.knn_mutual_information(table(spark, sf, "documents"), "n_chars", "doc_id")
    return rounded(result.select("n", "raw"))


@query(
    "knn_mutual_information_dependent",
    mi_sql("SELECT p_retailprice AS x, p_partkey::DOUBLE AS y FROM part"),
)
def knn_mutual_information_dependent(spark, sf):
    result = N.knn_mutual_information(table(spark, sf, "part"), "p_retailprice", "p_partkey")
    return rounded(result.select("n", "raw"))


@query("datetime_mutual_information")
def datetime_mutual_information(spark, sf):
    """Too many row pairs for a SQL check on the whole table; the estimator is tested against brute force."""
    result = N.datetime_mutual_information(table(spark, sf, "events"), "ts", "value")
    return rounded(result.select("n", "raw", "mutual_information"))


KNN_SQL = """WITH p AS (SELECT vec_id, label, embedding FROM embeddings), q AS (SELECT * FROM p WHERE vec_id % 5 = 0),
    t AS (SELECT * FROM p WHERE vec_id % 5 <> 0),
    r AS (SELECT q.vec_id, t.label, row_number() OVER (PARTITION BY q.vec_id
        ORDER BY list_distance(q.embedding::DOUBLE[], t.embedding::DOUBLE[]), t.vec_id) AS i FROM q JOIN t ON TRUE),
    n AS (SELECT * FROM r WHERE i <= 5)"""


def _neighbours(spark, sf, k=5):
    e = table(spark, sf, "embeddings").select(
        "vec_id", F.col("embedding").cast("array<double>").alias("v"), F.col("label").cast("double").alias("payload")
    )
    held_out = e.where("vec_id % 5 = 0").select(F.col("vec_id").alias("qid"), "v")
    train = e.where("vec_id % 5 <> 0").select(F.col("vec_id").alias("pid"), "v", "payload")
    return N.nearest(held_out, train, k)


@query(
    "knn_classify",
    KNN_SQL
    + """ SELECT vec_id AS qid, prediction FROM (SELECT vec_id, label::DOUBLE AS prediction,
      row_number() OVER (PARTITION BY vec_id ORDER BY count(*) DESC, label) AS r FROM n GROUP BY vec_id, label) WHERE r = 1""",
)
def knn_classify(spark, sf):
    return N.knn_predict(_neighbours(spark, sf), 5, classify=True)


@query("knn_regress", KNN_SQL + " SELECT vec_id AS qid, round(avg(label), 6) AS prediction FROM n GROUP BY 1")
def knn_regress(spark, sf):
    return rounded(N.knn_predict(_neighbours(spark, sf), 5, classify=False))
