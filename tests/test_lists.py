import __spark_entry__
import numpy as np
import pytest
from pyspark.sql import functions as F

from recoflux.operators import candidates as C
from recoflux.plans import models as MD


@pytest.mark.parametrize("name", ["content", "hybrid"])
def test_lists_equal_scored_pairs(spark, monkeypatch, name):
    rng = np.random.default_rng(5)  # 40 items in six kinds of equal rows, one without a row; user 9 has no profile
    rows = [(int(u), int(i), float(rng.choice([3.0, 4.0, 5.0]))) for u in range(8) for i in rng.choice(39, 3 + u, replace=False)]
    ratings = C.landed(spark.createDataFrame(rows + [(0, i, 3.0) for i in range(0, 39, 2)], "user_id long, item_id long, rating double").coalesce(1))
    features = C.landed(spark.createDataFrame([(i, f"word{(i + j * j) % 6}", 0.8 - 0.2 * j) for i in range(39) for j in range(2)], "item_id long, feature string, value double").coalesce(1))
    users = spark.createDataFrame([(u,) for u in [*range(8), 9]], "user_id long").coalesce(1)
    m = MD.Content.fit(features, ratings)
    m = m if name == "content" else MD.Hybrid(MD.Popularity.fit(ratings), m, 0.3)
    pairs = C.exclude_seen(users.join(m.items(), how="cross"), ratings)
    lists = lambda df: {(r.user_id, r["rank"]): (r.item_id, round(r.score, 9)) for r in df.collect()}
    plain = lists(C.top_k(m.score(pairs).withColumn("score", F.round("score", 9)), 12))
    monkeypatch.setattr(MD.Model, "recommend", None)  # all pairs are not an option
    monkeypatch.setattr(C, "exclude_seen", None)  # nor are blocks
    assert lists(m.recommend(users, 12, ratings)) == plain and len(plain) > 90


@pytest.mark.parametrize("name", ["content", "factors"])
def test_blocks_meet_in_many_partitions(spark, name):
    rng = np.random.default_rng(7)
    ratings = C.landed(spark.createDataFrame([(int(u), int(i), float(rng.choice([4.0, 4.5, 5.0]))) for u in range(12) for i in rng.choice(30, 6, replace=False)], "user_id long, item_id long, rating double").coalesce(1))
    users = ratings.select("user_id").distinct()
    if name == "content":
        features = spark.createDataFrame([(i, f"f{j}", float(rng.random())) for i in range(30) for j in range(4)], "item_id long, feature string, value double")
        m = MD.Content.fit(features, ratings)
    else:
        both = [spark.createDataFrame([(i, float(rng.random()), rng.random(3).tolist()) for i in range(n)], "id long, bias double, factors array<double>") for n in (12, 30)]
        m = MD.BiasedALS(3.0, *both, MD.Popularity.fit(ratings))
    lists = lambda df: {(r.user_id, r["rank"]): r.item_id for r in df.collect()}
    scored = m.score(C.exclude_seen(users.join(m.items(), how="cross"), ratings))
    plain = lists(C.top_k(scored, 5, order="raw" if name == "factors" else "score"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = [lists(m.recommend(users, 5, ratings, block=n)) for n in (1000, 7)]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == [plain, plain] and len(plain) == 60


@pytest.mark.parametrize("name", ["q_ordered_pool", "q_content_topk"])
def test_ratings_are_landed_once(spark, name):
    files = __spark_entry__.queries()[name](spark, "/root/testdata/sf0.001").inputFiles()
    assert files and not [x for x in files if "lineitem" in x]
