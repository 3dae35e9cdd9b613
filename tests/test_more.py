"""The further queries against their SQL, and the gaps of their operators."""

import glob
import os

import pytest

from recoflux import queries_more as M
from recoflux.operators import candidates as C
from recoflux.plans import models as MD

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(M.SQL))
def test_sql_oracle(spark, name):
    import duckdb

    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    want, got = c.sql(M.SQL[name]).df(), M.QUERIES[name](spark, SF).toPandas()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols and len(got) == len(want) > 0
    same = lambda x: x[cols].astype({k: float for k in cols if x[k].dtype.kind in "fiu"}).astype(str).sort_values(cols).values.tolist()
    assert same(got) == same(want)


def test_popularity_beyond_the_ranked_array(spark, monkeypatch):
    ratings = spark.createDataFrame([(u, i) for u in range(8) for i in range(u + 3)], "user_id long, item_id long")
    users, rows = spark.createDataFrame([(u,) for u in range(10)], "user_id long"), []
    for most in (MD.RANKED_ITEMS, 1):
        monkeypatch.setattr(MD, "RANKED_ITEMS", most)
        rows.append([sorted(tuple(r) for r in MD.Popularity.fit(ratings).recommend(users, k, seen).select("user_id", "item_id", "score", "rank").collect()) for k in (0, 4, 30) for seen in (None, ratings)])
    assert rows[0] == rows[1] and len(rows[0][2]) == 40


def test_missing_titles_and_empty_pools(spark):
    recs = spark.createDataFrame([(1, 5, 1), (1, 6, 2)], "user_id long, item_id long, rank int")
    items = spark.createDataFrame([(5, "five"), (7, None)], "item_id long, title string")
    assert {r.item_id: r.title for r in C.with_titles(recs, items).collect()} == {5: "five", 6: ""}
    assert C.ordered_pool(recs.limit(0), recs.limit(0)).collect() == []
    assert [(r.user_id, r.n) for r in C.user_counts(spark.createDataFrame([(3,)], "user_id long"), recs).collect()] == [(3, 0)]
