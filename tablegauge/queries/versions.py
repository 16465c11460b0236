"""Source, sink, registry, diff and lineage queries."""

from pyspark.sql import functions as F

from tablegauge.operators import cleaning as K, profile as P, versions as V
from tablegauge.queries.registry import query, rounded, table
from tablegauge.session import scratch_folder, staged
from tablegauge.sources import landing, readers, registry as Reg


# --- sources and sinks --------------------------------------------------------------------------------------------


@query("csv_round_trip", "SELECT c_custkey, c_name, c_nationkey::BIGINT AS c_nationkey, c_acctbal, c_mktsegment FROM customer")
def csv_round_trip(spark, sf):
    path = scratch_folder(spark, "customer") + ".csv"
    table(spark, sf, "customer").write.csv(path, header=True)
    return readers.read_csv(spark, path)


@query(
    "csv_missing_tokens",
    """SELECT event_id, CASE WHEN event_id % 10 = 0 THEN NULL ELSE event_type END AS event_type,
    CASE WHEN event_id % 9 = 0 THEN NULL ELSE value END AS value FROM events""",
)
def csv_missing_tokens(spark, sf):
    path = scratch_folder(spark, "events") + ".csv"
    table(spark, sf, "events").select(
        "event_id",
        F.expr("CASE WHEN event_id % 20 = 0 THEN 'NA' WHEN event_id % 10 = 0 THEN 'null' ELSE event_type END").alias("event_type"),
        F.expr("CASE WHEN event_id % 9 = 0 THEN 'N/A' ELSE CAST(value AS STRING) END").alias("value"),
    ).write.csv(path, header=True)
    return readers.read_csv(spark, path)


@query(
    "csv_rejects",
    """SELECT 'too_many_fields' AS reason, count(*) AS rejected FROM orders WHERE o_orderkey % 5 = 0 HAVING count(*) > 0
    UNION ALL SELECT 'too_few_fields', count(*) FROM orders WHERE o_orderkey % 5 = 1 HAVING count(*) > 0""",
)
def csv_rejects(spark, sf):
    path = scratch_folder(spark, "orders") + ".csv"
    lines = table(spark, sf, "orders").repartition(6, "o_custkey").select(
        F.expr(
            """CASE o_orderkey % 5 WHEN 0 THEN concat_ws(',', o_orderkey, o_custkey, o_orderstatus, 'extra')
            WHEN 1 THEN CAST(o_orderkey AS STRING) ELSE concat_ws(',', o_orderkey, o_custkey, o_orderstatus) END"""
        ).alias("o_orderkey,o_custkey,o_orderstatus")
    )
    write_lines(lines, path)
    return readers.reject_report(spark, path).select("reason", "rejected")


def write_lines(lines, path):
    """Whole lines under one column that is named like the header: every file gets the header line."""
    lines.write.options(header=True, sep="\x01", quote="\x00", escapeQuotes=False, emptyValue="").csv(path)


@query("format_dispatch", "SELECT 'orc' AS fmt, count(*) AS n, round(sum(s_acctbal), 4) AS total FROM supplier "
       "UNION ALL SELECT 'json', count(*), round(sum(s_acctbal), 4) FROM supplier "
       "UNION ALL SELECT 'parquet', count(*), round(sum(s_acctbal), 4) FROM supplier")
def format_dispatch(spark, sf):
    s = table(spark, sf, "supplier")
    out = None
    for fmt in ("orc", "json", "parquet"):
        path = scratch_folder(spark, "supplier") + "." + fmt
        s.write.format(fmt).save(path)
        part = readers.read_dataset(spark, path).agg(
            F.lit(fmt).alias("fmt"), F.count("*").alias("n"), F.round(F.sum("s_acctbal"), 4).alias("total")
        ).select("fmt", "n", "total")
        out = part if out is None else out.unionByName(part)
    return out


@query("file_manifest")
def file_manifest(spark, sf):
    """Sizes and SHA-256 of the table files themselves (their location is not visible to SQL)."""
    files = landing.file_manifest(spark, sf, "*.parquet")
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), "size_bytes", "sha256")


@query(
    "raw_landing",
    """SELECT octet_length(encode(t)) AS size_bytes, sha256(t) AS sha256
    FROM (SELECT string_agg(o_orderkey || ',' || o_custkey || ',' || o_orderpriority || chr(10), '' ORDER BY o_orderkey) AS t FROM orders
      GROUP BY o_orderkey % 7)""",
)
def raw_landing(spark, sf):
    """The landed bytes of many files, whose content SQL can put together."""
    source = scratch_folder(spark, "orders") + ".csv"
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    for part in range(7):
        o.where(F.col("o_orderkey") % 7 == part).repartitionByRange(1, "o_orderkey").sortWithinPartitions("o_orderkey").write.mode("append").csv(source)
    return landing.land_raw(spark, source, scratch_folder(spark, "landed")).select("size_bytes", "sha256")


@query(
    "processed_sink",
    "SELECT count(*) AS row_count, 5 AS column_count, count(*) AS read_back, TRUE AS has_checksum FROM customer",
)
def processed_sink(spark, sf):
    c = table(spark, sf, "customer")
    stored = landing.save_processed(c, scratch_folder(spark, "processed"), "customer", "run1")
    back = spark.read.parquet(stored["path"])
    return back.agg(
        F.lit(stored["row_count"]).cast("long").alias("row_count"),
        F.lit(stored["column_count"]).alias("column_count"),
        F.count("*").alias("read_back"),
        F.lit(len(stored["sha256"]) == 64).alias("has_checksum"),
    )


@query(
    "version_registry",
    """SELECT 'v1' AS version_id, 'raw' AS kind, count(*) AS row_count, 1 AS children FROM events UNION ALL SELECT 'v2', 'processed', count(*), 0 FROM events WHERE event_id % 2 = 0""",
)
def version_registry(spark, sf):
    e = table(spark, sf, "events")
    path = scratch_folder(spark, "versions")
    Reg.register_versions(spark, path, Reg.version_row(e, "events", "v1", "raw", 1, with_quality=False))
    half = e.where("event_id % 2 = 0")
    Reg.register_versions(
        spark, path, Reg.version_row(half, "events", "v2", "processed", 2, "v1", "run1", with_quality=False)
    )
    known = Reg.versions(spark, path, "events")
    below = known.groupBy(F.col("parent_version_id").alias("version_id")).agg(F.count("*").cast("int").alias("children"))
    return known.join(below, "version_id", "left").select(
        "version_id", "kind", "row_count", F.coalesce("children", F.lit(0)).alias("children")
    ).where("row_count > 0")


def _experiments(spark, sf):
    """One experiment per brand: its mean price as score."""
    p = table(spark, sf, "part")
    return p.groupBy(F.col("p_brand").alias("experiment_id")).agg(
        F.lit("classical").alias("source"),
        F.lit(None).cast("timestamp_ntz").alias("created_at"),
        F.lit("part").alias("dataset_id"),
        F.lit("rmse").alias("metric"),
        F.lit("minimize").alias("direction"),
        F.avg("p_retailprice").alias("score"),
        F.lit("linear").alias("winner"),
        F.lit("{}").alias("parameters"),
    )


@query("experiment_registry", "SELECT count(*) AS experiments, round(min(s), 6) AS best FROM (SELECT avg(p_retailprice) AS s FROM part GROUP BY p_brand)")
def experiment_registry(spark, sf):
    path = scratch_folder(spark, "experiments")
    Reg.register_experiments(spark, path, _experiments(spark, sf))
    return Reg.query_table(
        Reg.experiments(spark, path), "SELECT count(*) AS experiments, round(min(score), 6) AS best FROM experiments"
    )


@query(
    "read_only_sql",
    """SELECT o_orderstatus, o_orderpriority, count(*) AS n, rank() OVER (PARTITION BY o_orderstatus ORDER BY count(*) DESC)::INTEGER AS r
    FROM orders GROUP BY 1, 2""",
)
def read_only_sql(spark, sf):
    return Reg.query_table(
        table(spark, sf, "orders"),
        """SELECT o_orderstatus, o_orderpriority, count(*) AS n,
        rank() OVER (PARTITION BY o_orderstatus ORDER BY count(*) DESC) AS r FROM experiments GROUP BY 1, 2""",
    )


# --- diffs --------------------------------------------------------------------------------------------------------


def _changed_customer(spark, sf):
    c = table(spark, sf, "customer")
    return c.select(
        "c_name", "c_custkey", F.col("c_nationkey").cast("long").alias("c_nationkey"), "c_acctbal",
        F.lower("c_mktsegment").alias("segment"),
    )


@query(
    "schema_diff",
    """SELECT * FROM (VALUES ('c_name', 'string', 'string', 'moved'), ('c_custkey', 'bigint', 'bigint', 'moved'),
    ('c_nationkey', 'int', 'bigint', 'type_changed'), ('c_mktsegment', 'string', '-', 'removed'), ('segment', '-', 'string', 'added'))
    t("column", dtype_before, dtype_after, change) WHERE (SELECT count(*) FROM customer) > 0""",
)
def schema_diff(spark, sf):
    out = V.schema_diff(V.schema_rows(table(spark, sf, "customer")), V.schema_rows(_changed_customer(spark, sf)))
    return out.na.fill("-", ["dtype_before", "dtype_after"])


def _edited_customer(spark, sf):
    c = table(spark, sf, "customer")
    edited = c.withColumn("c_acctbal", F.expr("CASE WHEN c_custkey % 10 = 3 THEN NULL ELSE c_acctbal END"))
    return edited.where("c_custkey % 25 <> 7").unionAll(edited.where("c_custkey % 50 = 1"))


EDITED = """edited AS (WITH e AS (SELECT c_custkey, c_name, c_nationkey, CASE WHEN c_custkey % 10 = 3 THEN NULL ELSE c_acctbal END AS c_acctbal,
    c_mktsegment FROM customer) SELECT * FROM e WHERE c_custkey % 25 <> 7 UNION ALL SELECT * FROM e WHERE c_custkey % 50 = 1)"""


@query(
    "content_diff",
    f"""WITH {EDITED} SELECT (SELECT count(*) FROM customer) AS row_count_before, count(*) AS row_count_after,
    0::BIGINT AS duplicate_rows_before, count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM edited)) AS duplicate_rows_after,
    0::BIGINT AS missing_cells_before, count(*) - count(c_acctbal) AS missing_cells_after, FALSE AS identical FROM edited""",
)
def content_diff(spark, sf):
    return V.content_diff(table(spark, sf, "customer"), _edited_customer(spark, sf))


@query("content_equal", "SELECT count(*) AS row_count_before, TRUE AS identical FROM lineitem")
def content_equal(spark, sf):
    li = table(spark, sf, "lineitem")
    # dealt anew by rows, in parts that follow the table's size
    return V.content_diff(li, li.hint("rebalance", *li.columns)).select("row_count_before", "identical")


@query(
    "row_diff",
    f"""WITH {EDITED} SELECT (SELECT count(*) FROM (SELECT * FROM customer EXCEPT ALL SELECT * FROM edited)) AS only_before,
    (SELECT count(*) FROM (SELECT * FROM edited EXCEPT ALL SELECT * FROM customer)) AS only_after""",
)
def row_diff(spark, sf):
    return V.row_diff(table(spark, sf, "customer"), _edited_customer(spark, sf))


@query("content_fingerprint")
def content_fingerprint(spark, sf):
    return V.content_fingerprint(table(spark, sf, "lineitem"))


# --- lineage over a tree of versions, one per customer ------------------------------------------------------------


def _versions(spark, sf, broken=False):
    """Version k of customer k; its parent is (k - 1) / 2, so the versions form one tree."""
    parent = F.expr("CASE WHEN c_custkey > 0 THEN 'v' || ((c_custkey - 1) DIV 2) END")
    if broken:
        parent = F.expr(
            """CASE WHEN c_custkey % 101 = 100 THEN 'gone' WHEN c_custkey % 103 = 102 THEN 'v' || c_custkey
            WHEN c_custkey > 0 THEN 'v' || ((c_custkey - 1) DIV 2) END"""
        )
    return table(spark, sf, "customer").select(
        F.lit("customer").alias("dataset_id"),
        F.expr("'v' || c_custkey").alias("version_id"),
        parent.alias("parent_version_id"),
        F.expr("CASE WHEN c_custkey = 0 THEN 'raw' ELSE 'processed' END").alias("kind"),
        F.col("c_custkey").cast("int").alias("version_number"),
        F.expr("'run' || c_custkey").alias("execution_id"),
        F.col("c_name").alias("path"),
        (F.col("c_custkey") * 100).alias("size_bytes"),
        F.sha2("c_name", 256).alias("sha256"),
        F.col("c_custkey").alias("row_count"),
        F.lit(5).alias("column_count"),
        F.col("c_acctbal").alias("score"),
        (F.col("c_custkey") % 7).alias("total_findings"),
        (F.col("c_custkey") % 11).alias("missing_cells"),
    )


UP = """up(v, a, d) AS (SELECT c_custkey, c_custkey, 0 FROM customer UNION ALL
    SELECT v, (a - 1) // 2, d + 1 FROM up WHERE a > 0)"""


@query(
    "lineage_closure",
    f"WITH RECURSIVE {UP} SELECT 'v' || v AS version_id, 'v' || a AS ancestor_id, d AS distance FROM up",
)
def lineage_closure(spark, sf):
    return V.closure(_versions(spark, sf))


@query("lineage_ancestors", f"WITH RECURSIVE {UP} SELECT 'v' || a AS ancestor_id, d AS distance FROM up WHERE v = 100 AND d > 0")
def lineage_ancestors(spark, sf):
    return V.ancestors(_versions(spark, sf), "v100")


@query("lineage_descendants", f"WITH RECURSIVE {UP} SELECT 'v' || v AS version_id, d AS distance FROM up WHERE a = 5 AND d > 0")
def lineage_descendants(spark, sf):
    return V.descendants(_versions(spark, sf), "v5")


@query("lineage_roots", f"WITH RECURSIVE {UP} SELECT 'v' || v AS version_id, 'v0' AS root_id, max(d) AS depth FROM up GROUP BY v")
def lineage_roots(spark, sf):
    return V.roots(_versions(spark, sf))


@query(
    "lineage_path",
    f"""WITH RECURSIVE {UP} SELECT (SELECT d FROM up WHERE v = 100 AND a = 2) - d AS step, 'v' || a AS version_id FROM up
    WHERE v = 100 AND d <= (SELECT d FROM up WHERE v = 100 AND a = 2)""",
)
def lineage_path(spark, sf):
    return V.path(_versions(spark, sf), "v2", "v100")


@query(
    "lineage_relationship",
    """SELECT * FROM (VALUES ('v2', 'v5', 'ancestor'), ('v5', 'v2', 'descendant'), ('v5', 'v6', 'sibling'), ('v3', 'v6', 'related'))
    t(version_a, version_b, relationship) WHERE (SELECT count(*) FROM customer) > 6""",
)
def lineage_relationship(spark, sf):
    versions = staged(_versions(spark, sf), "versions")
    out, jumps = None, V.jump_tables(versions)
    for a, b in (("v2", "v5"), ("v5", "v2"), ("v5", "v6"), ("v3", "v6")):
        part = V.relationship(versions, a, b, jumps)
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "lineage_problems",
    """WITH RECURSIVE p AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 101 = 100 THEN -2 WHEN c_custkey % 103 = 102 THEN c_custkey
      WHEN c_custkey > 0 THEN (c_custkey - 1) // 2 END AS parent FROM customer),
    up(k, a) AS (SELECT k, parent FROM p WHERE parent >= 0 AND parent <> k
      UNION ALL SELECT up.k, p.parent FROM up JOIN p ON p.k = up.a WHERE p.parent >= 0 AND p.parent <> p.k)
    SELECT DISTINCT 'v' || up.k AS version_id, 'not reachable from a root' AS problem FROM up JOIN p ON p.k = up.a AND p.parent = p.k
    UNION ALL SELECT 'v' || k AS version_id, 'parent does not exist' AS problem FROM p WHERE parent = -2
    UNION ALL SELECT 'v' || k, 'version is its own parent' FROM p WHERE parent = k""",
)
def lineage_problems(spark, sf):
    return V.lineage_problems(_versions(spark, sf, broken=True)).select("version_id", "problem")


@query(
    "file_integrity",
    """SELECT 'v' || c_custkey AS version_id, CASE WHEN c_custkey % 10 = 0 THEN 'missing' WHEN c_custkey % 10 = 1 THEN 'size_mismatch'
    WHEN c_custkey % 10 = 2 THEN 'checksum_mismatch' ELSE 'intact' END AS status FROM customer""",
)
def file_integrity(spark, sf):
    files = table(spark, sf, "customer").where("c_custkey % 10 <> 0").select(
        F.col("c_name").alias("path"),
        F.expr("c_custkey * 100 + CASE WHEN c_custkey % 10 = 1 THEN 1 ELSE 0 END").alias("size_bytes"),
        F.sha2(F.expr("c_name || CASE WHEN c_custkey % 10 = 2 THEN 'x' ELSE '' END"), 256).alias("sha256"),
    )
    return V.integrity(_versions(spark, sf), files).select("version_id", "status")


@query(
    "log_consistency",
    """SELECT 'run' || c_custkey AS execution_id, CASE WHEN c_custkey % 10 = 4 THEN 'version has no operation log'
      ELSE 'row counts disagree' END AS problem FROM customer WHERE c_custkey > 0 AND c_custkey % 10 IN (4, 5)""",
)
def log_consistency(spark, sf):
    log = table(spark, sf, "customer").where("c_custkey > 0 AND c_custkey % 10 <> 4").select(
        F.expr("'run' || c_custkey").alias("execution_id"),
        F.lit(1).alias("step"),
        F.lit("executed").alias("status"),
        F.expr("c_custkey + CASE WHEN c_custkey % 10 = 5 THEN 1 ELSE 0 END").alias("rows_after"),
    )
    return V.log_consistency(_versions(spark, sf), log).select("execution_id", "problem")


@query(
    "version_metadata_diff",
    """WITH a AS (SELECT * FROM customer WHERE c_custkey = 3), b AS (SELECT * FROM customer WHERE c_custkey = 4)
    SELECT 'version_number' AS field, '3' AS before, '4' AS after, TRUE AS changed FROM a, b
    UNION ALL SELECT 'size_bytes', '300', '400', TRUE FROM a, b UNION ALL SELECT 'kind', 'processed', 'processed', FALSE FROM a, b
    UNION ALL SELECT 'path', a.c_name, b.c_name, a.c_name <> b.c_name FROM a, b
    UNION ALL SELECT 'dataset_id', 'customer', 'customer', FALSE FROM a, b
    UNION ALL SELECT 'sha256', sha256(a.c_name), sha256(b.c_name), a.c_name <> b.c_name FROM a, b
    UNION ALL SELECT 'row_count', '3', '4', TRUE FROM a, b UNION ALL SELECT 'column_count', '5', '5', FALSE FROM a, b""",
)
def version_metadata_diff(spark, sf):
    return V.version_metadata_diff(_versions(spark, sf), "v3", "v4")


@query(
    "version_quality_diff",
    """WITH a AS (SELECT * FROM customer WHERE c_custkey = 3), b AS (SELECT * FROM customer WHERE c_custkey = 12)
    SELECT 'score' AS field, CASE WHEN b.c_acctbal > a.c_acctbal THEN 'improved' WHEN b.c_acctbal < a.c_acctbal THEN 'regressed'
      ELSE 'unchanged' END AS verdict FROM a, b
    UNION ALL SELECT 'total_findings', CASE WHEN 12 % 7 < 3 % 7 THEN 'improved' WHEN 12 % 7 > 3 % 7 THEN 'regressed' ELSE 'unchanged' END FROM a, b
    UNION ALL SELECT 'missing_cells', CASE WHEN 12 % 11 < 3 % 11 THEN 'improved' WHEN 12 % 11 > 3 % 11 THEN 'regressed' ELSE 'unchanged' END FROM a, b""",
)
def version_quality_diff(spark, sf):
    return V.version_quality_diff(_versions(spark, sf), "v3", "v12").select("field", "verdict")


@query(
    "experiment_comparison",
    """SELECT experiment_id, round(s, 6) AS score, CAST(row_number() OVER (ORDER BY s, experiment_id) AS INTEGER) AS "rank", 'ranked' AS status
    FROM (SELECT p_brand AS experiment_id, avg(p_retailprice) AS s FROM part GROUP BY 1)""",
)
def experiment_comparison(spark, sf):
    out = V.compare_experiments(_experiments(spark, sf))
    return rounded(out.select("experiment_id", "score", "rank", "status"))


@query(
    "clean_and_register",
    """SELECT 'raw' AS kind, (SELECT count(*) FROM events) + (SELECT count(*) FROM events WHERE event_id % 50 = 0) AS row_count
    UNION ALL SELECT 'processed', count(*) FROM events""",
)
def clean_and_register(spark, sf):
    from tablegauge.plans import cleaning_run
    from tablegauge.queries.registry import dirty_events

    df = dirty_events(spark, sf).select("event_id", "event_type", "value")
    result = cleaning_run.clean_and_register(
        df, "events", scratch_folder(spark, "workspace"), K.RunOptions(run_recommended=True, allow_full_fit=True)
    )
    return result.versions.select("kind", "row_count")


@query("schema_snapshot", "SELECT 0 AS position, 's_suppkey' AS \"column\", 'bigint' AS dtype WHERE (SELECT count(*) FROM supplier) > 0 "
       "UNION ALL SELECT 1, 's_name', 'string' UNION ALL SELECT 2, 's_nationkey', 'int' UNION ALL SELECT 3, 's_acctbal', 'double'")
def schema_snapshot(spark, sf):
    row = Reg.version_row(table(spark, sf, "supplier"), "supplier", "s1", "raw", 1)
    return V.snapshot_rows(row, "s1")
