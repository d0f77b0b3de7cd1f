"""The registered queries against their DuckDB twins, on the smallest tables."""

import os

import duckdb
import pytest

from alnspark.llm.oracles import ORACLES
from alnspark.llm.queries import QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_turn_repair", "op12_pivot_top_k", "op13_collocations"])
def test_twin(spark, name):
    con = duckdb.connect()
    for t in os.listdir(DATA):
        con.execute(f"CREATE VIEW {t[:-8]} AS SELECT * FROM '{DATA}/{t}'")
    df = QUERIES[name](spark, DATA)
    found = con.execute(ORACLES[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(df.columns)
    want = sorted((tuple(row[columns.index(c)] for c in df.columns) for row in found.fetchall()), key=repr)
    assert sorted(map(tuple, df.collect()), key=repr) == want
    assert want
