"""Goldens, properties and the SQL oracle."""

import glob
import os

import numpy as np
import pytest

from recoflux import queries as Q
from recoflux.functions import scalars as S
from recoflux.operators import candidates as C
from recoflux.operators import metrics as M
from recoflux.operators import splits as P
from recoflux.plans import evaluate as E
from recoflux.plans import models as MD

SF = "/root/testdata/sf0.001"
ROW = "user_id long, item_id long, rating double, ts timestamp, k1 long, k2 long"


def users(spark, sizes):
    import datetime as dt

    rows = [(n, i, 1.0 + i % 5, dt.datetime(2020, 1, 1) + dt.timedelta(days=i), i, n) for n in sizes for i in range(n)]
    return spark.createDataFrame(rows, ROW)


def counts(df):
    out = {}
    for r in df.groupBy("user_id", "split").count().collect():
        out.setdefault(r.user_id, {})[r.split] = r["count"]
    return {u: tuple(c.get(x, 0) for x in ("train", "val", "test")) for u, c in out.items()}


def test_split_goldens(spark):
    got = counts(P.leave_last_n(users(spark, range(1, 15))))
    assert {n: got[n][2] for n in (1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 14)} == {1: 0, 2: 1, 3: 1, 4: 2, 5: 2, 6: 3, 7: 3, 8: 4, 9: 4, 10: 5, 14: 5}
    want = {1: (1, 0, 0), 2: (1, 0, 1), 3: (2, 0, 1), 5: (4, 0, 1), 9: (7, 0, 2), 10: (8, 1, 1), 11: (8, 1, 2), 19: (15, 1, 3), 20: (16, 2, 2), 21: (16, 2, 3)}
    assert counts(P.temporal_user(users(spark, want))) == want == counts(P.random_user(users(spark, want)))
    want = {1: (1, 0, 0), 2: (1, 0, 1), 3: (1, 1, 1), 5: (3, 1, 1), 6: (4, 1, 1), 7: (5, 1, 1), 10: (7, 1, 2), 15: (11, 2, 2), 20: (14, 3, 3)}
    assert counts(P.banded(users(spark, want))) == want


def test_splits_of_nothing(spark):
    none = users(spark, [])
    for f in (P.leave_last_n, P.temporal_user, P.random_user, P.banded, P.global_temporal, P.kfold, P.user_holdout, P.tuning_split):
        assert f(none).collect() == []


def test_metric_goldens(spark):
    recs = spark.createDataFrame([(1, i, i) for i in range(1, 6)], "user_id long, item_id long, rank int")
    rel = spark.createDataFrame([(1, 2), (1, 5), (1, 9), (2, 1)], "user_id long, item_id long")
    r = {x.user_id: x for x in M.per_user(recs, rel, (0, 5)).collect()}
    assert r[1].precision == pytest.approx(0.4) and r[1].recall == pytest.approx(2 / 3) and r[1].f1 == pytest.approx(0.5)
    assert r[1].dcg == pytest.approx(1.0177825608) and r[1].ndcg == pytest.approx(0.4776237035) and r[1]["map"] == pytest.approx(0.3) and r[1].mrr == 0.5
    assert r[2].hits == 0 and r[2].ndcg == 0


def test_text_goldens(spark):
    df = spark.createDataFrame([(["tom hanks", "tim allen", "x y", "z w"], " A \t b ", ["ab", "Cats "]), ([], None, None)], "c array<string>, t string, k array<string>")
    got = df.select(S.cast_text(df.c), S.clean(df.t), S.keyword_text(df.k)).collect()
    assert tuple(got[0]) == ("tom hanks tom hanks tom hanks tim allen tim allen x y z w", "a b", "cats") and tuple(got[1]) == ("unknown",) * 3


def test_als_half_step(spark):
    r = spark.createDataFrame([(7, 1, 4.0), (7, 2, 3.0)], "id long, other long, r double")
    other = spark.createDataFrame([(1, 0.1, [1.0]), (2, -0.2, [2.0])], "id long, bias double, factors array<double>")
    got = MD.BiasedALS.half_step(r, other, 3.5, 0.02).first()
    assert got.bias == pytest.approx(0.9663276, abs=1e-6) and got.factors[0] == pytest.approx(-0.61732725, abs=1e-6)


def test_als_recommends_what_it_scores(spark):
    df = users(spark, [6, 7, 9, 12, 12])
    m = MD.BiasedALS.fit(df, k=3, epochs=2, least=1)
    seen = df.filter("item_id < 3")
    got = m.recommend(df.select("user_id"), 3, seen).collect()
    all_ = m.score(df.select("user_id").distinct().crossJoin(df.select("item_id").distinct())).toPandas()
    for u in {r.user_id for r in got}:
        mine = all_[(all_.user_id == u) & (all_.item_id >= 3)].sort_values(["raw", "item_id"], ascending=[False, True])
        assert [r.item_id for r in sorted(got, key=lambda r: r["rank"]) if r.user_id == u] == mine.item_id.head(3).tolist()
    assert np.isclose(m.score(spark.createDataFrame([(999, 1)], "user_id long, item_id long")).first().score, np.clip(m.mu, 0.5, 5))


def test_exclusions_and_zero_k(spark):
    df = users(spark, [4, 8])
    m = MD.Popularity.fit(df)
    got = m.recommend(df.select("user_id"), 5, df)
    assert got.join(df, ["user_id", "item_id"]).count() == 0 and m.recommend(df.select("user_id"), 0).count() == 0
    with pytest.raises(ValueError):
        C.require(df.limit(0), "user_id")
    with pytest.raises(ValueError):
        E.evaluate({}, df, df, ks=(50,), most=20)


def test_search_resumes():
    f = lambda p: -abs(p["alpha"] - 0.5)
    full = E.search(f, E.SPACES["hybrid"], 8)
    assert E.search(f, E.SPACES["hybrid"], 8, done=full[:3]) == full and E.best(full)["value"] == max(r["value"] for r in full)
    assert E.pareto([{"a": 1, "b": 2}, {"a": 2, "b": 1}, {"a": 1, "b": 1}], "a", "b") == [{"a": 1, "b": 2}, {"a": 2, "b": 1}]


def test_stream_counts_like_a_batch(spark, tmp_path):
    from recoflux.streaming.popularity import windowed_popularity

    e = spark.read.parquet(f"{SF}/events.parquet").selectExpr("cast(ts as timestamp) as ts", "user_id as item_id")
    e.write.parquet(str(tmp_path / "in"))
    s = windowed_popularity(spark.readStream.schema(e.schema).parquet(str(tmp_path / "in")))
    q = s.writeStream.format("memory").queryName("pop").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.sql("select * from pop").collect())) == sorted(map(tuple, windowed_popularity(e).collect()))


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_sql_oracle(spark, name):
    import duckdb

    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    want, got = c.sql(Q.SQL[name]).df(), Q.QUERIES[name](spark, SF).toPandas()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols and len(got) == len(want)
    same = lambda x: x[cols].astype({k: float for k in cols if x[k].dtype.kind in "fiu"}).astype(str).sort_values(cols).values.tolist()
    assert same(got) == same(want)
