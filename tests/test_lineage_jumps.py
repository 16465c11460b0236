"""Jump tables of a lineage are made once and never broadcast."""

from pyspark.sql import functions as F

from tablegauge.operators import versions as V


def test_jumps_are_shared_and_shuffled(spark, monkeypatch):
    tree = spark.range(300).select(
        F.concat(F.lit("v"), "id").alias("version_id"),
        F.when(F.col("id") > 0, F.concat(F.lit("v"), F.floor((F.col("id") - 1) / 2).cast("string"))).alias("parent_version_id"))
    made = []

    def noted(df, name, of=V.staged):
        made.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return of(df, name)

    monkeypatch.setattr(V, "staged", noted)
    jumps = V.jump_tables(tree)
    count = len(made)
    pairs = {"v2": "ancestor", "v6": "sibling", "v4": "related"}
    found = {v: V.relationship(tree, v, "v5", jumps).first()["relationship"] for v in pairs}
    assert found == pairs and V.relationship(tree, "v5", "v5").first()["relationship"] == "same"
    assert [name for name, _ in made[:count]] == ["jumps"] * count
    assert {name for name, _ in made[count:count + 2 * len(pairs) * len(jumps)]} == {"reached"}
    assert not any("BroadcastExchange" in plan for name, plan in made if name == "jumps")
