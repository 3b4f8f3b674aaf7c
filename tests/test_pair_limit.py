from functools import partial

import duckdb
import pytest

from tessella.operators import graph
from tessella.plans import queries as plans

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", ["pairs", "rejections", "pilot_selection"])
def test_sql_states_the_limit_of_all_pairs(spark, monkeypatch, name):
    monkeypatch.setattr(graph, "build", partial(graph.build, limits=graph.Limits(max_pairs=100)))
    got = getattr(plans, name)(spark, SF)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    rows = con.execute(f"SELECT {', '.join(got.columns)} FROM ({plans.ORACLES[name].replace(str(graph.Limits().max_pairs), '100')})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(rows)
    assert name != "rejections" or any(r[2] == "global_pair_limit" for r in rows)
