"""Operators beside their SQL: hosts that are rejected, hard negatives and phrases on the given tables."""

from __future__ import annotations

import duckdb
import pytest

from sigloom.llm.queries import oracle_sql, queries

from . import fixtures


def same(spark, folder, name, tables):
    con = duckdb.connect()
    for t in tables:
        path = f"{folder}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'' if folder.startswith('/root/testdata') else '/*.parquet'}'")
    want = con.sql(oracle_sql()[name])
    got = queries()[name](spark, folder)
    names = sorted(want.columns)
    assert sorted(got.columns) == names or set(names) <= set(got.columns)
    at = [want.columns.index(c) for c in names]
    rows = sorted((tuple(r[k] for k in at) for r in want.fetchall()), key=str)
    assert sorted((tuple(r[c] for c in names) for r in got.collect()), key=str) == rows
    return rows, names


def test_quality_with_rejected_hosts(spark, tmp_path):
    good = " ".join(f"word{k}" for k in range(60))
    junk = " ".join(f"word{k} ### $$$" for k in range(60))
    again = " ".join(["one two three four"] * 20)
    rows = [(k, junk if k % 20 else good, "aa", "bad", 0) for k in range(200)] + [(1000 + k, good, "aa", f"h{k % 10}", 0) for k in range(400)]
    rows += [(5000, junk, "aa", "tiny", 0), (5001, good, "aa", "tiny", 0), (6000, good, "aa", None, 0), (6001, None, "aa", "bad", 0), (6002, again, "aa", "bad", 0), (6003, f"{good}\n{good}", "aa", "h1", 0)]
    found, names = same(spark, fixtures.write(spark, tmp_path, rows), "op2_quality", ["documents"])
    kept, failed = names.index("kept"), names.index("base_failed")
    assert sum(not r[kept] and not r[failed] for r in found) > 150 and sum(r[kept] for r in found) > 390


@pytest.mark.parametrize(("name", "tables"), [("op12_hard_negatives", ["embeddings"]), ("op13_phrases", ["documents"])])
@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_new_operators(spark, name, tables, sf):
    same(spark, f"/root/testdata/sf{sf}", name, tables)
