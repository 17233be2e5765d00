"""Reports count distinct means to the last bit: the order in which files and tasks deliver events must not count."""

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from sigloom import oracles
from sigloom import queries as engine

COUNTED = ["feature_rules_met", "report_availability", "report_completeness", "report_summarize", "report_targets"]


@pytest.fixture(scope="module")
def layouts(tmp_path_factory):
    """The same events in order in one file, and partly from the last to the first in two. 0.1 + 0.2 + 0.3 has two sums; users 0
    and 6 have the same values, and so on."""
    rows = [(n, n * 1_000_000, user, kind, v) for n, (user, kind, v) in enumerate((user, kind, v + user % 6) for v in (0.1, 0.2, 0.3) for user in range(12) for kind in engine.TYPES)]
    half = [r for r in rows if r[2] < 6]
    other = [r for r in rows if r[2] >= 6]
    out = []
    for files in ([rows], [half, other[::-1]]):
        d = tmp_path_factory.mktemp("events")
        (d / "events.parquet").mkdir()
        for k, part in enumerate(files):
            ids, ts, users, kinds, values = zip(*part, strict=True)
            pq.write_table(pa.table({"event_id": ids, "ts": pa.array(ts, pa.timestamp("us")), "user_id": users, "event_type": kinds, "value": values}), d / "events.parquet" / f"{k}.parquet")
        out.append(str(d))
    return out


@pytest.mark.parametrize("name", COUNTED)
def test_order_of_events(spark, layouts, name):
    column = {"report_targets": "target", "report_availability": "feature"}.get(name, "column")
    con = duckdb.connect()
    con.sql("SET threads = 1")
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{layouts[0]}/events.parquet/*.parquet' ORDER BY event_id")
    sql = oracles.oracle_sql()[name]
    want = sorted(con.sql(f'SELECT "{column}", n_unique FROM ({sql})').fetchall(), key=str)
    assert len(want) > 1
    for d in layouts:
        assert sorted((tuple(r) for r in engine.queries()[name](spark, d).select(column, "n_unique").collect()), key=str) == want
