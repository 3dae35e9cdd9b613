"""Content fit, candidate order, studies and stores."""

import glob
import os
import random

import pytest

from recoflux import queries_fit as Q
from recoflux.operators import features as X
from recoflux.plans import content as T
from recoflux.plans import evaluate as E
from recoflux.plans import models as MD
from recoflux.plans import tuning as U
from recoflux.sources import sinks

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_sql_oracle(spark, name):
    import duckdb

    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    want, got = c.sql(Q.SQL[name]).df(), Q.QUERIES[name](spark, SF).toPandas()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols and len(got) == len(want) > 0
    same = lambda x: x[cols].astype({k: float for k in cols if x[k].dtype.kind in "fiu"}).astype(str).replace("<NA>", "None").sort_values(cols).values.tolist()
    assert same(got) == same(want)


def test_content_blocks_equal_scores(spark):
    items = spark.createDataFrame([(i, f"a{i % 3}", f"d{i % 4}", [f"a{i % 3}", f"c{i}"], [f"word{i % 5}"], "x|y" if i % 2 else "z", 90 + i, 1990 + i, 5.0 + i % 3) for i in range(12)], "item_id long, main_actor string, director string, cast array<string>, keywords array<string>, genres string, runtime int, year int, rating double")
    ratings = spark.createDataFrame([(u, (u * 5 + n) % 12, 4.0 + (n % 2) / 2) for u in range(6) for n in range(4)], "user_id long, item_id long, rating double")
    m = T.fit(items, ratings, T.Settings(threshold=0.0, top_k=3))
    users = spark.createDataFrame([(u,) for u in range(8)], "user_id long")  # two of them without a profile
    plain = MD.Model.recommend(m, users, 5, ratings)
    for block in (1000, 4):
        got = {(r.user_id, r["rank"]): (r.item_id, round(r.score, 9)) for r in m.recommend(users, 5, ratings, block=block).collect()}
        assert got == {(r.user_id, r["rank"]): (r.item_id, round(r.score, 9)) for r in plain.collect()}
    assert m.edges.groupBy("src_item").count().filter("count > 3").isEmpty()
    few = T.metadata_features(items.select("item_id", "director"))
    assert few.filter("feature like 'number:%'").isEmpty() and few.filter("feature like 'director:%'").count() == 12
    with pytest.raises(ValueError):
        T.Settings(0, 0, 0, 0, 0, 0).shares()


def test_block_product_takes_empty_rows():
    out = X.block_product([["a", "b"], None], [[1.0, 2.0], None], [["b"], ["c"], None], [[3.0], [1.0], None])
    assert out.tolist() == [[6.0, 0.0, 0.0], [0.0, 0.0, 0.0]]


def test_study_resumes_and_keeps_failures(spark, tmp_path):
    path, space = str(tmp_path / "trials"), {"x": (0.0, 1.0), "n": (1, 9, 2), "kind": ["a", "b"], "r": (1e-3, 0.5)}
    f = lambda p: -abs(p["x"] - 0.4) + (p["kind"] == "a")
    first = U.study(spark, path, "s", f, space, 3)
    assert U.study(spark, path, "s", lambda p: 1 / 0, space, 4)[:3] == first  # the fourth fails and is stored as 0
    again = U.study(spark, path, "s", f, space, 12)
    assert again[:3] == first and again[3]["value"] == 0.0 and len(sinks.read_trials(spark, path, "s")) == 12
    assert sinks.read_trials(spark, path, "other") == [] == sinks.read_trials(spark, str(tmp_path / "none"), "s")
    for r in again:
        assert 0 <= r["params"]["x"] <= 1 and r["params"]["n"] in (1, 3, 5, 7, 9) and 1e-3 <= r["params"]["r"] <= 0.5


def test_search_near_good_trials_beats_chance():
    f, space = (lambda p: -((p["x"] - 0.3) ** 2) - (p["y"] - 0.7) ** 2), {"x": (0.0, 1.0), "y": (0.0, 1.0)}
    rows = []
    for t in range(60):
        p = U.tpe(space, rows, random.Random(t))
        rows.append({"trial": t, "params": p, "value": f(p)})
    assert sum(r["value"] for r in rows[30:]) / 30 > sum(r["value"] for r in rows[:10]) / 10


def test_evolution_reaches_the_front():
    goals = lambda p: {"map": 1 - p["x"] ** 2 - p["y"] ** 2, "coverage": 1 - (p["x"] - 1) ** 2 - p["y"] ** 2}
    front = U.evolve(goals, {"x": (-2.0, 2.0), "y": (-2.0, 2.0)}, population=20, generations=12)
    assert len(front) > 5 and all(-0.2 < r["params"]["x"] < 1.2 and abs(r["params"]["y"]) < 0.3 for r in front)
    assert len(E.pareto(front, "map", "coverage")) == len(front)


def test_failing_models_are_skipped(spark, tmp_path):
    ratings = spark.createDataFrame([(u, i, 4.0 + (i % 2) / 2) for u in range(5) for i in range(u + 3)], "user_id long, item_id long, rating double")
    with pytest.raises(ValueError):
        E.results(spark, str(tmp_path / "none"))
    out = E.evaluate_all({"bad": MD.Model(), "popularity": MD.Popularity.fit(ratings)}, ratings, ratings, str(tmp_path / "r"), ks=(2,), most=5, n_users=3)
    assert [r.model for r in out.collect()] == ["popularity"] and E.results(spark, str(tmp_path / "r")).count() == 1
    assert "comparison" in E.save_frames(out, str(tmp_path / "f"), 2)


def test_catalog_sweep(spark):
    ratings = spark.createDataFrame([(u, (i + 3 * u) % 40, 4.5, i, i, u) for u in range(12) for i in range(30)], "user_id long, item_id long, rating double, ts long, k1 long, k2 long")
    out = U.catalog_sweep(ratings, lambda t: {"popularity": MD.Popularity.fit(t)}, (0.5, 1.0), ks=(5,), most=5).collect()
    assert [r.catalog_fraction for r in out] == [0.5, 1.0] and all(r.n_evaluated == 12 for r in out)
    nobody = ratings.filter("user_id < 0")
    assert E.evaluate({"popularity": MD.Popularity.fit(ratings)}, ratings, nobody, ks=(5,)).count() == 0 and U.validation_score(MD.Popularity.fit(ratings), ratings, nobody) == 0.0


def test_tuning_writes_the_best(spark, tmp_path):
    items = spark.createDataFrame([(i, f"d{i % 4}") for i in range(20)], "item_id long, director string")
    ratings = spark.createDataFrame([(u, (u * 3 + n) % 20, 4.0 + (n % 3) / 2, n, n, u) for u in range(10) for n in range(12)], "user_id long, item_id long, rating double, ts long, k1 long, k2 long")
    space = {"als": {"k": (2, 4, 2), "epochs": (1, 2, 1), "least": (1, 2, 1), "penalty": (0.1, 0.9)}}
    at = str(tmp_path / "best.json")
    got = U.tune(ratings, items, str(tmp_path / "t"), at, 2, space, ("als",))
    assert got["als"]["params"]["k"] in (2, 4) and sinks.read_params(at) == got
    assert U.tune(ratings, items, str(tmp_path / "t"), at, 5, space, ("als",), skip_saved=True) == got
    assert U.profiled(lambda x: x + 1)(2) == 3


def test_model_parameters_are_stored(spark, tmp_path):
    sinks.save_model({"t": spark.range(3)}, str(tmp_path), {"k": 3})
    assert sinks.load_params(spark, str(tmp_path)) == {"k": 3} and sinks.load_model(spark, str(tmp_path), ["t"])["t"].count() == 3
