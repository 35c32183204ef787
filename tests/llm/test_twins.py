"""Queries of text operators that SQL can express give the rows of their DuckDB twins."""

import math

import duckdb
import pytest

from tidewise.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_twin(spark, data, name):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{data}/documents.parquet'")
    found = con.execute(queries.ORACLES[name])
    names = [c[0] for c in found.description]
    df = queries.QUERIES[name](spark, data)
    assert sorted(df.columns) == sorted(names)
    a = sorted((tuple(r[c] for c in sorted(names)) for r in df.collect()), key=repr)
    b = sorted((tuple(r[names.index(c)] for c in sorted(names)) for r in found.fetchall()), key=repr)
    assert len(a) == len(b) > 0
    for r, s in zip(a, b, strict=True):
        assert all(x == y or (isinstance(x, float) and math.isclose(x, y, rel_tol=1e-12)) for x, y in zip(r, s, strict=True)), (r, s)
