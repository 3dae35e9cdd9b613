"""Candidate sets, exclusions, top-k and samples. Orders are total: score descending, item ascending."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import PRIME, arithmetic_hash, finite


def valid_ratings(df: DataFrame) -> DataFrame:
    return df.filter(finite(F.col("rating")))


def require(df: DataFrame, *names: str) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    if df.isEmpty():
        raise ValueError("no rows")
    return df


def min_ratings(df: DataFrame, least: int = 5) -> DataFrame:
    """Rows of items with at least `least` rows."""
    return df.join(df.groupBy("item_id").count().filter(F.col("count") >= least), "item_id", "left_semi")


def exclude_seen(scored: DataFrame, seen: DataFrame | None) -> DataFrame:
    return scored if seen is None else scored.join(seen.select("user_id", "item_id").distinct(), ["user_id", "item_id"], "left_anti")


def only_candidates(scored: DataFrame, candidates: DataFrame | None) -> DataFrame:
    """candidates: (item_id), shared by all users, or (user_id, item_id)."""
    if candidates is None:
        return scored
    on = [c for c in ("user_id", "item_id") if c in candidates.columns]
    return scored.join(candidates.select(on).distinct(), on, "left_semi")


def top_k(scored: DataFrame, k: int, by: str = "user_id", order: str = "score") -> DataFrame:
    """The k best rows of each group with their rank; k <= 0: none."""
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.col(order).desc(), "item_id"))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= max(k, 0))


def negatives(users: DataFrame, catalog: DataFrame, excluded: DataFrame, n: int = 99, seed: int = 42) -> DataFrame:
    """min(n, available) items of the catalog for each user that excluded (user_id, item_id) doesn't hold, in a seeded order.

    arithmetic_hash(seed, user, item) is a user's hash plus an item's, modulo PRIME. So every user has one circle of items, ordered by the item's hash, and
    takes the places from its own start on: n and as many as it has excluded are enough. No user meets the whole catalog.
    """
    n = max(n, 0)
    items = catalog.select("item_id").distinct()
    plain = items.filter("item_id is not null").select("item_id", arithmetic_hash(0, F.lit(0), F.col("item_id")).alias("at"))
    taken = excluded.select("user_id", "item_id").distinct().join(items, "item_id", "left_semi").groupBy("user_id").agg(F.count(F.lit(1)).alias("taken"))
    asked = users.select("user_id").distinct()
    most = F.lit(n) + F.coalesce("taken", F.lit(0))
    asked = asked.filter("user_id is not null").join(taken, "user_id", "left").select("user_id", most.alias("most"), F.pmod(-arithmetic_hash(seed, F.col("user_id")), F.lit(PRIME)).alias("at"))
    # places: of an item its rank on the circle, of a user that of the first item at or after its start; each stretch of the circle is ranked by itself
    both = plain.select("at", F.lit(1).alias("is_item"), F.col("item_id").alias("id"), F.lit(0).alias("most")).unionByName(asked.select("at", F.lit(0).alias("is_item"), F.col("user_id").alias("id"), "most"))
    both = both.withColumn("stretch", F.shiftright("at", 18))  # 8,192 stretches
    counts = landed(both.filter("is_item = 1").groupBy("stretch").agg(F.count(F.lit(1)).alias("c")))
    size = counts.agg(F.sum("c")).first()[0] or 0
    before = both.sparkSession.range(PRIME + 1 >> 18).select(F.col("id").alias("stretch")).join(counts, "stretch", "left").select("stretch", F.coalesce("c", F.lit(0)).alias("c"))
    before = before.select("stretch", (F.sum("c").over(Window.partitionBy(F.lit(0)).orderBy("stretch")) - F.col("c")).alias("before"))
    inside = F.sum("is_item").over(Window.partitionBy("stretch").orderBy("at", "is_item", "id").rowsBetween(Window.unboundedPreceding, -1))
    placed = landed(both.withColumn("inside", F.coalesce(inside, F.lit(0))).join(F.broadcast(before), "stretch").select("is_item", "id", "most", (F.col("inside") + F.col("before")).alias("place")))
    circle = placed.filter("is_item = 1").select("place", F.col("id").alias("item_id"))
    starts = placed.filter("is_item = 0").select(F.col("id").alias("user_id"), "place", F.least("most", F.lit(size)).alias("most")).filter("most > 0")
    walk = starts.select("user_id", F.explode(F.sequence(F.col("place"), F.col("place") + F.col("most") - 1)).alias("step")).withColumn("place", F.pmod("step", F.lit(max(size, 1))))
    pairs = walk.join(circle, "place").select("user_id", "item_id")
    # null ids have no hash: a user without an id is one row against the catalog, an item without one comes last for every user
    odd = users.select("user_id").filter("user_id is null").limit(1).join(items, how="cross")
    last = asked.select("user_id").join(F.broadcast(items.filter("item_id is null")), how="cross")
    pairs = exclude_seen(pairs.unionByName(odd).unionByName(last), excluded)
    return top_k(pairs.withColumn("score", -arithmetic_hash(seed, F.col("user_id"), F.col("item_id"))), n).drop("score", "rank")


def catalog(*frames: DataFrame) -> DataFrame:
    out = frames[0].select("item_id")
    for f in frames[1:]:
        out = out.union(f.select("item_id"))
    return out.distinct()


def hash_sample(df: DataFrame, key: str, share: float, seed: int = 42) -> DataFrame:
    return df.filter(F.pmod(arithmetic_hash(seed, F.col(key)), F.lit(10_000)) < int(share * 10_000))


def relevant(test: DataFrame, threshold: float = 4.0, users: DataFrame | None = None, items: DataFrame | None = None) -> DataFrame:
    out = test.filter(F.col("rating") >= threshold)
    out = out if users is None else out.join(users.select("user_id").distinct(), "user_id", "left_semi")
    out = out if items is None else out.join(items.select("item_id").distinct(), "item_id", "left_semi")
    return out.select("user_id", "item_id").distinct()


def matrix(df: DataFrame, row: str, column: str, value: str | None = None) -> DataFrame:
    """Triplets (row, column, value): the sum over duplicates, or their count."""
    return df.groupBy(row, column).agg((F.sum(value) if value else F.count(F.lit(1))).alias("value"))


def complete_rows(df: DataFrame, *columns: str) -> DataFrame:
    """Rows without a null in these columns, or in any."""
    return df.na.drop("any", subset=list(columns) or None)


def text_defaults(df: DataFrame, *columns: str) -> DataFrame:
    """df with these text columns, "" where a column or a value is missing."""
    return df.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in df.columns else F.lit("") for c in columns})


def user_counts(users: DataFrame, ratings: DataFrame) -> DataFrame:
    """(user_id, n) for every user, 0 without ratings."""
    counts = ratings.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    return users.select("user_id").distinct().join(counts, "user_id", "left").select("user_id", F.coalesce("n", F.lit(0)).alias("n"))


def with_group_mean(df: DataFrame, by: str, value: str, name: str) -> DataFrame:
    """df with the mean of its group beside each row, by a pre-aggregated join: a group may hold a third of all rows."""
    return df.join(df.groupBy(by).agg(F.avg(value).alias(name)), by, "left")


def ordered_pool(rel: DataFrame, neg: DataFrame) -> DataFrame:
    """(user_id, item_id, pos): relevant items first, then negatives, each by item."""
    both = rel.select("user_id", "item_id", F.lit(0).alias("part")).unionByName(neg.select("user_id", "item_id", F.lit(1).alias("part")))
    return both.withColumn("pos", F.row_number().over(Window.partitionBy("user_id").orderBy("part", "item_id"))).drop("part")


def with_titles(recs: DataFrame, items: DataFrame) -> DataFrame:
    """Recommendations with their titles; an item without one has ""."""
    return recs.join(items.select("item_id", "title"), "item_id", "left").withColumn("title", F.coalesce("title", F.lit("")))


def prefixed(df: DataFrame, prefix: str) -> list[str]:
    """The names of the columns with a prefix, in their order."""
    return [c for c in df.columns if c.startswith(prefix)]


def union_all(*frames: DataFrame) -> DataFrame:
    """All rows of all frames; a column that some frame lacks is null there."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def shared_folder(spark) -> str:
    """The checkpoint folder that the session names; a temporary one only in local mode, as in tests."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        named = sc.getConf().get("spark.checkpoint.dir", None)
        if not named and sc.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or "/tmp/recoflux-checkpoints")
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """df written to the shared checkpoint folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def landed(df: DataFrame) -> DataFrame:
    """df as compressed files in the shared folder, evaluated once; shuffles that no frame needs any more are then let go."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/landed-{uuid.uuid4().hex}"
    df.write.parquet(path)
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    return spark.read.parquet(path)


def let_go(*frames: DataFrame) -> None:
    """Removes the folders that landed() wrote for these frames, which nothing may read any more."""
    for df in frames:
        jvm, conf = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
        for folder in {x.rpartition("/")[0] for x in df.inputFiles()}:
            if folder.rpartition("/")[2].startswith("landed-"):
                path = jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(conf).delete(path, True)
