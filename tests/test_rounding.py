"""Doubles near a half of the last digit, and those that round to a zero, come out as in the SQL of the query."""

import duckdb
import pytest

from tablegauge.queries import load_all

VALUES = [0.9999999, 1.0000001, 33.4710365, 33.5300495, 114.7066345, 0.2502135, 0.0, 1e-7, 5e-324, 0.5, 12.25, 4e9, 7.3e15, 1e300, 1.7e308]


@pytest.mark.parametrize("name", ["clean_log", "apply_transforms"])
def test_rounded_as_in_sql(spark, folder, name):
    con, registry = duckdb.connect(), load_all()
    con.execute(f"COPY (SELECT unnest(range({len(VALUES)})) AS event_id, unnest(?::DOUBLE[]) AS value) TO '{folder}/events.parquet' (FORMAT parquet)", [VALUES])
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet'")
    mine = registry.QUERIES[name](spark, folder)
    theirs = con.execute(f"SELECT {', '.join(mine.columns)} FROM ({registry.ORACLE[name]}) ORDER BY event_id").fetchall()
    found = [tuple(r) for r in mine.orderBy("event_id").collect()]
    assert list(map(repr, found)) == list(map(repr, theirs))  # the text of a double tells signed zeros apart
