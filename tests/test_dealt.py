"""The second table of content_equal is dealt anew without a fixed number of parts."""

import pytest

from tablegauge.operators import versions as V
from tablegauge.queries import load_all


def test_parts_follow_the_table(spark, monkeypatch):
    class Asked(Exception):
        pass

    def stop(before, after):
        raise Asked(after)

    monkeypatch.setattr(V, "content_diff", stop)
    with pytest.raises(Asked) as found:
        load_all().QUERIES["content_equal"](spark, "/root/testdata/sf0.001")
    after = found.value.args[0]
    plan = after._jdf.queryExecution().optimizedPlan().toString()
    assert "RebalancePartitions" in plan and "Repartition 7" not in plan and after.count() > 0
