"""Dataset versions: snapshots, diffs, lineage over the version table, integrity and experiment comparison."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tablegauge.functions import columns as C
from tablegauge.operators import profile as P
from tablegauge.session import staged

VERSION_SCHEMA = (
    "dataset_id string, version_id string, parent_version_id string, kind string, version_number int, "
    "execution_id string, path string, size_bytes long, sha256 string, row_count long, column_count int, "
    "schema_snapshot array<struct<name:string,dtype:string>>, score double, total_findings long, missing_cells long, "
    "created_at timestamp_ntz"
)


def schema_snapshot(df: DataFrame) -> list[tuple[str, str]]:
    return [(f.name, f.dataType.simpleString()) for f in df.schema.fields]


# --- diffs --------------------------------------------------------------------------------------------------------


def snapshot_rows(versions: DataFrame, version_id: str) -> DataFrame:
    return versions.where(F.col("version_id") == version_id).select(
        F.posexplode("schema_snapshot").alias("position", "field")
    ).select("position", F.col("field.name").alias("column"), F.col("field.dtype").alias("dtype"))


def schema_rows(df: DataFrame) -> DataFrame:
    rows = [(i, n, t) for i, (n, t) in enumerate(schema_snapshot(df))]
    return df.sparkSession.createDataFrame(rows, "position int, column string, dtype string")


def schema_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Added, removed, retyped and moved columns, from two (position, column, dtype) tables.

    A kept column counts as moved when its place among the kept columns differs.
    """
    kept = before.select("column").join(after.select("column"), "column", "left_semi")

    def placed(rows: DataFrame, name: str) -> DataFrame:
        among = rows.join(F.broadcast(kept), "column", "left_semi")  # schema rows, one per column of a table
        order = among.withColumn(name, F.row_number().over(W.partitionBy(F.lit(0)).orderBy("position")))
        return rows.join(F.broadcast(order.select("column", name)), "column", "left")

    b = placed(before, "place_before").select("column", F.col("dtype").alias("dtype_before"), "place_before")
    a = placed(after, "place_after").select("column", F.col("dtype").alias("dtype_after"), "place_after")
    both = b.join(a, "column", "full_outer")
    change = (
        F.when(F.col("dtype_before").isNull(), "added")
        .when(F.col("dtype_after").isNull(), "removed")
        .when(F.col("dtype_before") != F.col("dtype_after"), "type_changed")
        .when(F.col("place_before") != F.col("place_after"), "moved")
    )
    return both.select("column", "dtype_before", "dtype_after", change.alias("change")).where(
        F.col("change").isNotNull()
    )


def content_facts(df: DataFrame) -> DataFrame:
    """Row count, duplicates, missing cells and an order-free digest of the rows.

    The digest sums a 64-bit hash per row as decimal: unlike XOR, repeated rows do not cancel.
    """
    clean = C.normalise_missing(df)
    nulls = reduce(lambda a, b: a + b, [F.when(C.quote(c).isNull(), 1).otherwise(0) for c in df.columns], F.lit(0))
    return (
        clean.groupBy(P.row_digest(clean).alias("digest"))
        .agg(F.count("*").alias("copies"), F.first(nulls).alias("nulls"))
        .agg(
            F.coalesce(F.sum("copies"), F.lit(0)).alias("row_count"),
            F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("duplicate_rows"),
            F.coalesce(F.sum(F.col("nulls") * F.col("copies")), F.lit(0)).alias("missing_cells"),
            F.coalesce(F.sum(F.xxhash64("digest").cast("decimal(38,0)") * F.col("copies")), F.lit(0))
            .cast("string")
            .alias("content_digest"),
        )
    )


def content_fingerprint(df: DataFrame) -> DataFrame:
    """Cheap fingerprint without a shuffle: row count and the summed row hashes."""
    clean = C.normalise_missing(df)
    return clean.agg(
        F.count("*").alias("row_count"),
        F.coalesce(F.sum(F.xxhash64(*map(C.quote, clean.columns)).cast("decimal(38,0)")), F.lit(0))
        .cast("string")
        .alias("fingerprint"),
    )


def content_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Side-by-side content facts and whether the tables hold the same rows (columns matched by name)."""
    same_columns = sorted(before.columns) == sorted(after.columns)
    b, a = content_facts(before), content_facts(after.select(*map(C.quote, before.columns)) if same_columns else after)
    one = C.attach_row(
        b.select([F.col(c).alias(c + "_before") for c in b.columns]),
        a.select([F.col(c).alias(c + "_after") for c in a.columns]),
    )
    identical = F.lit(same_columns) & (F.col("row_count_before") == F.col("row_count_after")) & (
        F.col("content_digest_before") == F.col("content_digest_after")
    )
    return one.select(
        "row_count_before",
        "row_count_after",
        "duplicate_rows_before",
        "duplicate_rows_after",
        "missing_cells_before",
        "missing_cells_after",
        identical.alias("identical"),
    )


def row_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """How many rows only one side holds, counting copies.

    One grouped pass over both sides on the row digest instead of two full-row set differences.
    """
    sides = before.select(P.row_digest(before).alias("digest"), F.lit(1).alias("side")).unionAll(
        after.select(*map(C.quote, before.columns)).select(P.row_digest(before).alias("digest"), F.lit(-1).alias("side"))
    )
    balance = sides.groupBy("digest").agg(F.sum("side").alias("extra"))
    return balance.agg(
        F.coalesce(F.sum(F.greatest("extra", F.lit(0))), F.lit(0)).alias("only_before"),
        F.coalesce(F.sum(F.greatest(-F.col("extra"), F.lit(0))), F.lit(0)).alias("only_after"),
    )


def field_diff(before: DataFrame, after: DataFrame, fields: list[str]) -> DataFrame:
    """Field-by-field comparison of two one-row tables: (field, before, after, changed)."""

    def long(rows: DataFrame, name: str) -> DataFrame:
        return rows.select(
            F.inline(
                F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias(name)) for f in fields])
            )
        )

    joined = long(before, "before").join(long(after, "after"), "field", "full_outer")
    return joined.withColumn("changed", ~F.col("before").eqNullSafe(F.col("after")))


def version_metadata_diff(versions: DataFrame, before: str, after: str) -> DataFrame:
    fields = ["dataset_id", "kind", "version_number", "path", "size_bytes", "sha256", "row_count", "column_count"]
    pick = lambda v: versions.where(F.col("version_id") == v)
    return field_diff(pick(before), pick(after), fields)


def version_quality_diff(versions: DataFrame, before: str, after: str) -> DataFrame:
    """Quality snapshot of two versions: better scores and fewer findings or gaps are improvements."""
    pick = lambda v: versions.where(F.col("version_id") == v)
    rows = field_diff(pick(before), pick(after), ["score", "total_findings", "missing_cells"])
    gain = F.col("after").cast("double") - F.col("before").cast("double")
    gain = F.when(F.col("field") == "score", gain).otherwise(-gain)
    return rows.withColumn(
        "verdict", F.when(gain > 0, "improved").when(gain < 0, "regressed").otherwise("unchanged")
    )


# --- lineage ------------------------------------------------------------------------------------------------------


def _edges(versions: DataFrame) -> DataFrame:
    """(version_id, parent_id) of versions with another version as parent."""
    return versions.select("version_id", F.col("parent_version_id").alias("parent_id")).where(
        F.col("parent_id").isNotNull() & (F.col("parent_id") != F.col("version_id"))).distinct()


def _rounds(versions: DataFrame) -> int:
    """Doublings until every distance is covered."""
    return max(1, math.ceil(math.log2(versions.count() + 1)))


def closure(versions: DataFrame) -> DataFrame:
    """(version_id, ancestor_id, distance) for every version and all its ancestors, itself at distance 0.

    Known distances double with each round: an ancestor's ancestors are the version's. Rounds are staged, their number is
    the logarithm of the longest chain. In broken data with a cycle every pair keeps its smallest distance, and the walk ends.
    """
    known = staged(_edges(versions).select("version_id", F.col("parent_id").alias("ancestor_id"), F.lit(1).alias("distance")), "closure")
    for done in range(_rounds(versions)):
        far = known.where(F.col("distance") == 2**done)
        step = known.select(F.col("version_id").alias("ancestor_id"), F.col("ancestor_id").alias("next"), F.col("distance").alias("more"))
        found = far.join(step, "ancestor_id").select("version_id", F.col("next").alias("ancestor_id"), (F.col("distance") + F.col("more")).alias("distance"))
        if found.isEmpty():
            break
        known = staged(known.unionByName(found).where(F.col("version_id") != F.col("ancestor_id")).groupBy("version_id", "ancestor_id").agg(
            F.min("distance").alias("distance")), "closure")
    itself = versions.select("version_id", F.col("version_id").alias("ancestor_id"), F.lit(0).alias("distance")).distinct()
    return itself.unionByName(known)


def jump_tables(versions: DataFrame, up: bool = True) -> list[DataFrame]:
    """(a, b): where 2^k steps up or down lead, for k from 0 on; written once, for any number of walks over the same versions.

    Jumps of all versions are shuffled, never broadcast: each table would pass through the driver."""
    here, there = ("version_id", "parent_id") if up else ("parent_id", "version_id")
    jumps = [staged(_edges(versions).select(F.col(here).alias("a"), F.col(there).alias("b")), "jumps")]
    for _ in range(_rounds(versions)):
        last = jumps[-1]
        joined = last.select("a", F.col("b").alias("m")).hint("merge").join(last.select(F.col("a").alias("m"), "b").hint("merge"), "m")
        further = staged(joined.select("a", "b").distinct(), "jumps")
        if further.isEmpty():
            break
        jumps.append(further)
    return jumps


def _reach(versions: DataFrame, version_id: str, up: bool, jumps: list[DataFrame] | None = None) -> DataFrame:
    """(version_id, distance) of all versions above or below one, itself at 0, without the closure of the others.

    Going from the longest jump to the shortest, the set reached doubles each time."""
    jumps = jump_tables(versions, up) if jumps is None else jumps
    reached = versions.where(F.col("version_id") == version_id).select("version_id", F.lit(0).alias("distance")).distinct()
    for k in reversed(range(len(jumps))):
        more = reached.join(jumps[k].withColumnRenamed("a", "version_id").hint("merge"), "version_id").select(
            F.col("b").alias("version_id"), (F.col("distance") + 2**k).alias("distance"))
        reached = staged(reached.unionByName(more).groupBy("version_id").agg(F.min("distance").alias("distance")), "reached")
    return reached


def ancestors(versions: DataFrame, version_id: str) -> DataFrame:
    return _reach(versions, version_id, up=True).where("distance > 0").select(F.col("version_id").alias("ancestor_id"), "distance")


def descendants(versions: DataFrame, version_id: str) -> DataFrame:
    return _reach(versions, version_id, up=False).where("distance > 0").select("version_id", "distance")


def roots(versions: DataFrame) -> DataFrame:
    """Root of every version, the ancestor that has no parent, and its distance; a version that leads into a cycle has none.

    Pointer jumping over one row per version."""
    rows = versions.select("version_id", F.when(F.col("parent_version_id") != F.col("version_id"), F.col("parent_version_id")).alias("up")).groupBy(
        "version_id").agg(F.min("up").alias("up"))
    known = staged(rows.select("version_id", F.coalesce("up", "version_id").alias("root_id"), F.when(F.col("up").isNull(), 0).otherwise(1).alias("depth"),
                               F.col("up").isNull().alias("ended")), "roots")
    for _ in range(_rounds(versions)):
        if known.where("not ended").isEmpty():
            break
        step = known.select(F.col("version_id").alias("root_id"), F.col("root_id").alias("next"), F.col("depth").alias("more"), F.col("ended").alias("end"))
        known = staged(known.where("ended").unionByName(known.where("not ended").drop("ended").join(step, "root_id", "left").select(
            "version_id", F.coalesce("next", "root_id").alias("root_id"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"),
            F.coalesce("end", F.lit(True)).alias("ended"))), "roots")
    return known.where("ended").select("version_id", "root_id", "depth")


def path(versions: DataFrame, start: str, end: str) -> DataFrame:
    """Versions from ancestor ``start`` down to ``end`` with their step; empty when not related that way."""
    up = _reach(versions, end, up=True).select(F.col("version_id").alias("ancestor_id"), "distance")
    limit = up.where(F.col("ancestor_id") == start).select(F.col("distance").alias("limit"))
    return (
        C.attach_row(up, limit)
        .where(F.col("distance") <= F.col("limit"))
        .select((F.col("limit") - F.col("distance")).alias("step"), F.col("ancestor_id").alias("version_id"))
    )


def relationship(versions: DataFrame, a: str, b: str, jumps: list[DataFrame] | None = None) -> DataFrame:
    """same, ancestor, descendant, sibling, related (shared root) or unrelated: what a is to b. ``jumps``: the tables of
    ``jump_tables``, for more than one pair."""
    jumps = jump_tables(versions) if jumps is None else jumps
    over_a, over_b = (_reach(versions, v, True, jumps) for v in (a, b))
    parents = versions.select("version_id", "parent_version_id")
    facts = C.attach_row(
        over_b.agg(F.max(F.col("version_id") == a).alias("a_above_b")), over_a.agg(F.max(F.col("version_id") == b).alias("b_above_a")))
    family = parents.agg(
        F.max(F.when(F.col("version_id") == a, F.col("parent_version_id"))).alias("parent_a"),
        F.max(F.when(F.col("version_id") == b, F.col("parent_version_id"))).alias("parent_b"),
    )
    root = C.attach_row(
        over_a.agg(F.max_by("version_id", "distance").alias("root_a")), over_b.agg(F.max_by("version_id", "distance").alias("root_b")))
    one = C.attach_row(C.attach_row(facts, family), root)
    return one.select(
        F.lit(a).alias("version_a"),
        F.lit(b).alias("version_b"),
        F.when(F.lit(a == b), "same")
        .when(F.col("a_above_b"), "ancestor")
        .when(F.col("b_above_a"), "descendant")
        .when(F.col("parent_a") == F.col("parent_b"), "sibling")
        .when(F.col("root_a") == F.col("root_b"), "related")
        .otherwise("unrelated")
        .alias("relationship"),
    )


def lineage_problems(versions: DataFrame) -> DataFrame:
    """(dataset_id, version_id, problem): duplicate ids, missing parents, self parents, cycles, wrong root count."""
    ids = versions.select(F.col("version_id").alias("parent_version_id"))
    flag = lambda rows, problem: rows.select("dataset_id", "version_id", F.lit(problem).alias("problem"))
    duplicate = versions.groupBy("dataset_id", "version_id").agg(F.count("*").alias("n")).where(F.col("n") > 1)
    child = versions.where(F.col("parent_version_id").isNotNull())
    self_parent = child.where(F.col("parent_version_id") == F.col("version_id"))
    orphan = child.join(ids, "parent_version_id", "left_anti")
    top = versions.where(F.col("parent_version_id").isNull())
    wrong_roots = (
        versions.select("dataset_id")
        .distinct()
        .join(top.groupBy("dataset_id").agg(F.count("*").alias("n")), "dataset_id", "left")
        .where(F.coalesce("n", F.lit(0)) != 1)
        .select("dataset_id", F.lit(None).cast("string").alias("version_id"), F.lit("root count is not one").alias("problem"))
    )
    raw_below = child.where(F.col("kind") == "raw")
    # a walk up ends at a root or a missing parent, or it never does: a cycle, or a version that is its own parent
    ended = roots(versions).join(self_parent.select(F.col("version_id").alias("root_id")), "root_id", "left_anti")
    cyclic = (
        versions.join(ended.select("version_id"), "version_id", "left_anti")
        .where(F.col("parent_version_id") != F.col("version_id"))
    )
    parts = [
        flag(duplicate, "duplicate version id"),
        flag(self_parent, "version is its own parent"),
        flag(orphan, "parent does not exist"),
        flag(raw_below, "raw version has a parent"),
        flag(cyclic, "not reachable from a root"),
        wrong_roots,
    ]
    return reduce(DataFrame.unionByName, parts)


def integrity(versions: DataFrame, files: DataFrame) -> DataFrame:
    """Compare recorded size and checksum with a file manifest (path, size_bytes, sha256)."""
    found = files.select("path", F.col("size_bytes").alias("actual_size"), F.col("sha256").alias("actual_sha256"))
    status = (
        F.when(F.col("actual_size").isNull(), "missing")
        .when(F.col("actual_size") != F.col("size_bytes"), "size_mismatch")
        .when(F.col("actual_sha256") != F.col("sha256"), "checksum_mismatch")
        .otherwise("intact")
    )
    return versions.join(found, "path", "left").select("dataset_id", "version_id", "path", status.alias("status"))


def log_consistency(versions: DataFrame, log: DataFrame) -> DataFrame:
    """Problems between an operation log (with execution_id) and the versions it produced."""
    per_run = log.groupBy("execution_id").agg(
        F.count_if(F.col("status") == "executed").alias("executed"),
        F.max_by("rows_after", "step").alias("rows_after"),
        F.count_distinct("step").alias("steps"),
        F.count("*").alias("entries"),
        F.max("step").alias("last_step"),
    )
    processed = versions.where(F.col("kind") == "processed").select("execution_id", "version_id", "row_count")
    joined = per_run.join(processed, "execution_id", "full_outer")
    problem = (
        F.when(F.col("version_id").isNull() & (F.col("executed") > 0), "run has no registered version")
        .when(F.col("entries").isNull(), "version has no operation log")
        .when(F.col("executed") == 0, "version of a run that executed nothing")
        .when((F.col("steps") != F.col("entries")) | (F.col("last_step") != F.col("entries")), "steps are not 1..n")
        .when(F.col("rows_after") != F.col("row_count"), "row counts disagree")
    )
    return joined.select("execution_id", "version_id", problem.alias("problem")).where(F.col("problem").isNotNull())


# --- experiments --------------------------------------------------------------------------------------------------


def compare_experiments(records: DataFrame) -> DataFrame:
    """Rank experiments by their own selection metric; ineligible ones come last without a rank.

    ``records``: experiment_id, metric, direction (minimize / maximize), score. When eligible records disagree on
    metric or direction, no rank is given and ``status`` is ``mixed_metrics``.
    """
    score = F.col("score").cast("double")
    eligible = (
        F.col("metric").isNotNull() & F.col("direction").isNotNull() & score.isNotNull() & ~F.isnan(score)
        & (F.abs(score) < F.lit(float("inf")))
    )
    marked = records.withColumn("eligible", F.coalesce(eligible, F.lit(False)))
    kinds = marked.where("eligible").agg(F.count_distinct("metric", "direction").alias("kinds"))
    oriented = F.when(F.col("direction") == "minimize", score).otherwise(-score)
    # one registry, ranked as a whole: one window over the (small) experiment table
    order = W.partitionBy("eligible").orderBy(oriented, "experiment_id")
    single = F.col("kinds") <= 1
    return C.attach_row(marked, kinds).select(
        "experiment_id",
        "metric",
        "direction",
        "score",
        F.when(F.col("eligible") & single, F.row_number().over(order)).alias("rank"),
        F.when(~single, "mixed_metrics").when(F.col("eligible"), "ranked").otherwise("ineligible").alias("status"),
    )
