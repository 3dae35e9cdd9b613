import random

from pyspark.sql import functions as F

from recoflux.functions.scalars import PRIME
from recoflux.operators import candidates as C
from recoflux.plans import evaluate as E
from recoflux.plans import models as MD


def order(seed, u, i):
    h = (seed + u % PRIME * 1103515245) % PRIME
    return ((h + i % PRIME * 12345) % PRIME * 48271 % PRIME, i)


def test_negatives_walk_the_circle(spark):
    """Against every pair; ids beyond the prime, negative ones and more taken than left included. No cross join of users and items."""
    r = random.Random(4)
    users, items = [*range(15), -3, PRIME + 2], [*range(0, 200, 5), 7 - PRIME, -8, PRIME + 5, 2 * PRIME + 5]
    taken = {(u, i) for u in users for i in r.sample(items, r.choice([0, 3, 20, len(items) - 2]))}
    u, i = spark.createDataFrame([(x,) for x in users], "user_id long"), spark.createDataFrame([(x,) for x in items], "item_id long")
    out = C.negatives(u, i, spark.createDataFrame([*taken, (1, 9999)], "user_id long, item_id long"), 6, 42)
    got = {}
    for x in out.collect():
        got.setdefault(x.user_id, set()).add(x.item_id)
    want = {x: set(sorted([y for y in items if (x, y) not in taken], key=lambda y, x=x: order(42, x, y))[:6]) for x in users}
    assert got == {x: y for x, y in want.items() if y}


def test_negatives_of_null_ids(spark):
    u = spark.createDataFrame([(1,), (None,)], "user_id long")
    i = spark.createDataFrame([(4,), (5,), (None,)], "item_id long")
    none = spark.createDataFrame([(1, 4)], "user_id long, item_id long")
    got = {(x.user_id, x.item_id) for x in C.negatives(u, i, none, 2).collect()}
    assert {(1, 5), (1, None)} <= got and sum(x is None for x, _ in got) == 2 and (1, 4) not in got
    assert C.negatives(u, i, none, 0).count() == 0 and C.negatives(u, i.limit(0), none, 5).count() == 0


def test_negatives_do_not_cross_users_and_items(spark):
    u, i = spark.range(40_000).withColumnRenamed("id", "user_id"), spark.range(40_000).withColumnRenamed("id", "item_id")
    assert C.negatives(u, i, spark.createDataFrame([], "user_id long, item_id long"), 2).count() == 80_000  # 1.6 billion pairs before


def test_lists_are_made_once(spark):
    made = spark.sparkContext.accumulator(0)

    class Counted(MD.Model):
        def recommend(self, users, k, seen=None, candidates=None):
            def one(x):
                made.add(1)
                return x

            item = F.udf(one, "long").asNondeterministic()("user_id")
            return users.distinct().select("user_id", item.alias("item_id"), F.lit(1.0).alias("score"), F.lit(1).alias("rank"))

    ratings = spark.createDataFrame([(u, u, 5.0) for u in range(7)], "user_id long, item_id long, rating double")
    rows = E.evaluate({"m": Counted()}, ratings, ratings, ks=(1, 2), most=2, n_negatives=3).collect()
    assert [r.recall for r in rows] == [1.0, 1.0] and made.value == 7
