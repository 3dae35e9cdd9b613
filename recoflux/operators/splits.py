"""Splits of ratings (user_id, item_id, rating, ts, row keys) into train, val and test; every order is total."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import arithmetic_hash

ORDER = ("ts", "item_id", "k1", "k2")


def positions(df: DataFrame, order: list[Column] | None = None) -> DataFrame:
    """n (rows of the user) and pos (from 0)."""
    by = Window.partitionBy("user_id")
    keys = order or [F.col(c) for c in ORDER]
    return df.withColumn("n", F.count(F.lit(1)).over(by)).withColumn("pos", F.row_number().over(by.orderBy(*keys)) - 1)


def shuffled(seed: int) -> list[Column]:
    """A user's rows in a seeded order."""
    return [arithmetic_hash(seed, *(F.col(c) for c in ("user_id", "item_id", "k1", "k2"))), *(F.col(c) for c in ORDER)]


def _cut(df: DataFrame, train: Column, val: Column) -> DataFrame:
    split = F.when(F.col("pos") < train, "train").when(F.col("pos") < train + val, "val").otherwise("test")
    return df.withColumn("split", split).drop("n", "pos")


def cold_start(df: DataFrame) -> DataFrame:
    """Without the val and test rows whose user or item has no train row."""
    train = df.filter("split = 'train'")
    rest = df.filter("split <> 'train'").join(train.select("item_id").distinct(), "item_id", "left_semi").join(train.select("user_id").distinct(), "user_id", "left_semi")
    return train.unionByName(rest.select(df.columns))


def leave_last_n(df: DataFrame, test_size: int = 5, val_size: int = 0) -> DataFrame:
    """The last min(test_size, max(1, n // 2)) rows of each user with two or more are test; before them, val."""
    n = F.col("n")
    test = F.when(n >= 2, F.least(F.lit(test_size), F.greatest(F.lit(1), F.floor(n / 2)))).otherwise(0)
    val = F.when(n - test > 1, F.least(F.lit(val_size), n - test - 1)).otherwise(0)
    return _cut(positions(df), n - test - val, val)


def _shares(train: float, val: float) -> tuple[Column, Column]:
    n = F.col("n")
    a = F.greatest(F.lit(1), F.floor(n * F.lit(train)))
    b = F.least(F.floor(n * F.lit(val)), n - a)
    none = (n - a - b == 0) & (n >= 2)
    return F.when(none & (b == 0), a - 1).otherwise(a), F.when(none & (b > 0), b - 1).otherwise(b)


def temporal_user(df: DataFrame, train: float = 0.8, val: float = 0.1) -> DataFrame:
    return _cut(positions(df), *_shares(train, val))


def random_user(df: DataFrame, train: float = 0.8, val: float = 0.1, seed: int = 42) -> DataFrame:
    return _cut(positions(df, shuffled(seed)), *_shares(train, val))


def banded(df: DataFrame, seed: int = 42) -> DataFrame:
    """Users with 6 rows or more give 30 % (half to even) to val and test, with 3 to 5 one row each, with 2 one to test."""
    n = F.col("n")
    hold = F.bround(n * F.lit(0.3)).cast("int")
    val = F.when(n >= 6, F.floor(hold / 2)).when(n >= 3, 1).otherwise(0)
    test = F.when(n >= 6, hold - F.floor(hold / 2)).when(n >= 2, 1).otherwise(0)
    return _cut(positions(df, shuffled(seed)), n - val - test, val)


def global_positions(df: DataFrame) -> DataFrame:
    """pos of each row in the order of all (ts, user_id, ...): row number in its day, after the rows of the days before. Only day counts pass one task."""
    day = F.to_date("ts")
    some = df.withColumn("day", day)
    counts = some.groupBy("day").agg(F.count(F.lit(1)).alias("c"))
    before = counts.withColumn("before", F.sum("c").over(Window.partitionBy(F.lit(0)).orderBy(F.col("day").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)))
    place = F.row_number().over(Window.partitionBy("day").orderBy("ts", "user_id", "item_id", "k1", "k2")) - 1
    return some.withColumn("place", place).join(before.select(F.col("day").alias("d"), F.coalesce("before", F.lit(0)).alias("before")), F.col("day").eqNullSafe(F.col("d"))).withColumn("pos", F.col("place") + F.col("before")).drop("day", "d", "before", "place")


def global_temporal(df: DataFrame, train: float = 0.8) -> DataFrame:
    n = df.count()
    return global_positions(df).withColumn("split", F.when(F.col("pos") < int(n * train), "train").otherwise("test")).drop("pos")


def prefix_fractions(df: DataFrame, parts: int = 7) -> DataFrame:
    """The time-ordered rows once for each of the cumulative fractions 1/parts ... 1 that hold them."""
    n = df.count()
    first = F.expr(f"cast(least({parts}, floor(pos * {parts} / {max(n, 1)}) + 1) as int)")
    some = global_positions(df).withColumn("a", first)
    part = F.filter(F.sequence(F.lit(1), F.lit(parts)), lambda i: (F.col("pos") < F.floor(i * F.lit(n) / parts)) & (i >= F.col("a") - 1))
    return some.withColumn("part", F.explode(part)).withColumn("fraction", F.col("part") / parts).drop("a", "pos")


def kfold(df: DataFrame, k: int = 5) -> DataFrame:
    """k - 1 chronological folds of each user, long: fold f trains on the parts before f and tests on part f."""
    size = F.greatest(F.lit(1), F.floor(F.col("n") / k))
    part = F.least(F.floor(F.col("pos") / size), F.lit(k - 1))
    some = positions(df).withColumn("part", part).drop("n", "pos")
    return some.withColumn("fold", F.explode(F.sequence(F.lit(1), F.lit(k - 1)))).filter("part <= fold").withColumn("split", F.when(F.col("part") == F.col("fold"), "test").otherwise("train")).drop("part")


def sample_users(df: DataFrame, share: float | None = None, n: int | None = None, seed: int = 42) -> DataFrame:
    """Distinct users in a seeded order: the first n, or that share of them (at least one)."""
    users = df.select("user_id").distinct()
    n = max(1, int(users.count() * share)) if n is None else n
    return users.orderBy(arithmetic_hash(seed, F.col("user_id")), "user_id").limit(n)


def user_holdout(df: DataFrame, test: float = 0.2, seed: int = 42) -> DataFrame:
    """All rows of a sample of users are test."""
    held = sample_users(df, test, seed=seed).withColumn("held", F.lit(True))
    return df.join(held, "user_id", "left").withColumn("split", F.when(F.col("held"), "test").otherwise("train")).drop("held")


def tuning_split(df: DataFrame, val: float = 0.2, seed: int = 42) -> DataFrame:
    """leave_last_n, then a sample of the train users becomes val."""
    first = cold_start(leave_last_n(df))
    held = user_holdout(first.filter("split = 'train'").drop("split"), val, seed)
    return held.withColumn("split", F.when(F.col("split") == "test", "val").otherwise("train")).unionByName(first.filter("split = 'test'"))
