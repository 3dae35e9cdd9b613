"""Registered queries of the content fit, candidate order, studies and sweeps, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import queries as Q
from . import queries_more as M
from .functions import scalars as S
from .operators import candidates as C
from .operators import features as X
from .operators import splits as P
from .plans import adapters as A
from .plans import content as T
from .plans import evaluate as E
from .plans import models as MD
from .plans import tuning as U
from .sources import movielens as ML

QUERIES: dict = {}
SQL: dict[str, str] = {}


def register(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


def _metadata(spark, d) -> DataFrame:
    """Part rows with every column of the content fit."""
    i = A.items(spark, d)
    return i.select("item_id", F.col("cast")[0].alias("main_actor"), "director", "cast", F.col("cast").alias("keywords"), "genres", "runtime", "year", "rating")


def _exact(sql: str) -> str:
    """A query's SQL without its last rounding."""
    return sql.replace("round(", "(").replace(", 6) AS value", ") AS value").replace(", 5) AS value", ") AS value")


def _text_block(name: str, table: str, weight: float) -> str:
    return (
        rf"{name}_t AS (SELECT item_id, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]{{2,}}')) AS term FROM ({table})), {name}_f AS (SELECT item_id, term, count(*) AS tf FROM {name}_t GROUP BY 1, 2), {name}_d AS (SELECT term, count(*) AS df FROM {name}_f GROUP BY 1), "
        f"{name}_v AS (SELECT item_id, term, (1 + ln(tf)) * (ln((1.0 + (SELECT count(*) FROM part)) / (1 + df)) + 1) AS v FROM {name}_f JOIN {name}_d USING (term)), {name}_b AS (SELECT item_id, '{name}:' || term AS feature, {weight}::DOUBLE * v / sqrt(sum(v * v) OVER (PARTITION BY item_id)) AS value FROM {name}_v)"
    )


W = X.WEIGHTS
ACTOR = Q.SQL["q_creator_rating"].replace("lower(trim(p_brand))", "lower(string_split(p_name, ' ')[1])")
BLOCKS = ", ".join(
    (
        f"words AS ({Q.SQL['q_cast_keywords']})",
        _text_block("actor", "SELECT p_partkey AS item_id, string_split(p_name, ' ')[1] AS text FROM part", W["actor"]),
        _text_block("director", "SELECT p_partkey AS item_id, p_brand AS text FROM part", W["director"]),
        _text_block("cast", "SELECT item_id, weighted AS text FROM words", W["cast"]),
        _text_block("keywords", "SELECT item_id, keywords AS text FROM words", W["keywords"]),
        "numbers AS (" + " UNION ALL ".join(f"SELECT item_id, 'number:{n}' AS feature, value FROM ({_exact(sql)})" for n, sql in (("runtime", Q.SQL["q_numeric_scale"]), ("year", Q.SQL["q_quantile_year"]), ("main_actor", ACTOR), ("director", Q.SQL["q_creator_rating"]))) + ")",
        f"blocks AS (SELECT * FROM actor_b UNION ALL SELECT * FROM director_b UNION ALL SELECT * FROM cast_b UNION ALL SELECT * FROM keywords_b UNION ALL SELECT item_id, genre, {W['genre']}::DOUBLE FROM ({Q.SQL['q_genres']}) UNION ALL SELECT item_id, feature, {W['numerical']}::DOUBLE * value FROM numbers)",
        "x AS MATERIALIZED (SELECT item_id, feature, value / sqrt(sum(value * value) OVER (PARTITION BY item_id)) AS value FROM blocks WHERE value <> 0)",
    )
)


@register(f"WITH {BLOCKS} SELECT item_id, feature, round(value, 5) AS value FROM x")
def q_content_features(spark, d):
    return T.metadata_features(_metadata(spark, d)).select("item_id", "feature", F.round("value", 5).alias("value"))


@register(f"WITH {BLOCKS}, p AS (SELECT a.item_id AS src_item, b.item_id AS dst_item, sum(a.value * b.value) AS s FROM x a JOIN x b USING (feature) WHERE a.item_id <> b.item_id GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY src_item ORDER BY round(s, 9) DESC, dst_item) AS rank FROM p WHERE s >= 0.15) SELECT src_item, rank, round(s, 5) AS similarity FROM r WHERE rank <= 10")
def q_content_graph(spark, d):
    return T.similarity_graph(_metadata(spark, d)).select("src_item", "rank", F.round("similarity", 5).alias("similarity"))


@register("SELECT p_partkey AS item_id, 'genre_' || lower(p_type) AS genre FROM part WHERE p_partkey % 4 = 1")
def q_genre_columns(spark, d):
    wide = ML.genres_wide(A.items(spark, d).filter("item_id % 4 = 1"), "item_id")
    return wide.unpivot("item_id", C.prefixed(wide, "genre_"), "genre", "one").filter("one > 0").select("item_id", "genre")


@register("SELECT p_partkey AS item_id, p_name AS title, NULL AS director FROM part WHERE p_size < 10 UNION ALL SELECT p_partkey, NULL, p_brand FROM part WHERE p_size >= 10")
def q_union_all(spark, d):
    p = A.items(spark, d)
    return C.union_all(p.filter("year < 10").select("item_id", "title"), p.filter("year >= 10").select("item_id", "director"))


#: Each user's candidates: 40 items by a rule, every seventh of them unknown to the model, in a given order.
OFFERED = "offered AS (SELECT user_id, (user_id * 7 + n * 13) % 200 + CASE WHEN n % 7 = 0 THEN 1000000 ELSE 0 END AS item_id, min(n) AS pos FROM (SELECT DISTINCT user_id FROM test UNION ALL SELECT -1), range(0, 40) t(n) GROUP BY 1, 2)"


@register(f"WITH {Q.POPULAR}, {M.BIAS}, {OFFERED}, asked AS (SELECT o.user_id, o.item_id, pos, u2.b IS NOT NULL AND i2.b IS NOT NULL AS known, mu + u2.b + i2.b AS raw, mu FROM offered o CROSS JOIN mu LEFT JOIN u2 ON o.user_id = u2.user_id LEFT JOIN i2 ON o.item_id = i2.item_id ANTI JOIN (SELECT DISTINCT user_id, item_id FROM train) z ON o.user_id = z.user_id AND o.item_id = z.item_id), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY known DESC, CASE WHEN known THEN -raw END, CASE WHEN NOT known THEN pos END, item_id) AS rank FROM asked) SELECT user_id, rank, round(greatest(0.5, least(5.0, CASE WHEN known THEN raw ELSE mu END)), 5) AS score FROM r WHERE rank <= 30")
def q_als_bias_candidates(spark, d):
    m, train, test = M._bias(spark, d)
    users = test.select("user_id").distinct().unionByName(spark.range(1).select(F.lit(-1).cast("long").alias("user_id")))
    n = F.col("n")
    item = (F.col("user_id") * 7 + n * 13) % 200 + F.when(n % 7 == 0, F.lit(1_000_000)).otherwise(F.lit(0))
    offered = users.select("user_id", F.explode(F.sequence(F.lit(0), F.lit(39))).alias("n")).select("user_id", item.cast("long").alias("item_id"), n.alias("pos"))
    return m.recommend(users, 30, train, offered).select("user_id", "rank", F.round("score", 5).alias("score"))


VALIDATED = f"WITH {Q.POPULAR}, rel AS (SELECT DISTINCT user_id, item_id FROM test WHERE rating >= 4), items AS (SELECT DISTINCT item_id FROM (SELECT item_id FROM train UNION ALL SELECT item_id FROM test)), taken AS (SELECT DISTINCT user_id, item_id FROM (SELECT user_id, item_id FROM train UNION ALL SELECT * FROM rel)), neg AS (SELECT user_id, item_id FROM (SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY {Q._hash(42, 'user_id', 'item_id')}, item_id) AS r FROM users CROSS JOIN items ANTI JOIN taken USING (user_id, item_id)) WHERE r <= 99), pool AS (SELECT user_id, item_id, 1 AS hit FROM rel UNION ALL SELECT user_id, item_id, 0 FROM neg), ranked AS (SELECT user_id, hit, row_number() OVER (PARTITION BY user_id ORDER BY coalesce(score, 0) DESC, item_id) AS rank FROM pool LEFT JOIN pop USING (item_id) ANTI JOIN seen USING (user_id, item_id)), each AS (SELECT user_id, n_rel, coalesce((SELECT sum(1 / log2(rank + 1)) FROM ranked WHERE ranked.user_id = nr.user_id AND hit = 1 AND rank <= 10), 0) AS dcg FROM (SELECT user_id, count(*) AS n_rel FROM rel GROUP BY 1) nr) SELECT 'popularity' AS model, round(avg(dcg / (SELECT sum(1 / log2(i + 1)) FROM range(1, 11) t(i) WHERE i <= least(n_rel, 10))), 6) AS ndcg FROM each"


@register(VALIDATED)
def q_validation_objective(spark, d):
    train, test = Q._train_test(spark, d)
    return spark.createDataFrame([("popularity", U.validation_score(MD.Popularity.fit(train), train, test))], "model string, ndcg double").select("model", F.round("ndcg", 6).alias("ndcg"))


@register("SELECT study, trial, value FROM (SELECT event_type AS study, event_id AS trial, value, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS r FROM events) WHERE r = 1")
def q_best_trials(spark, d):
    return U.best_trials(A.table(spark, d, "events").select(F.col("event_type").alias("study"), F.col("event_id").alias("trial"), "value"))


@register(f"WITH {Q.GLOBAL}, parts AS (SELECT part, g.* FROM g JOIN range(1, 8) r(part) ON pos < (part * n) // 7), each AS (SELECT part, item_id, count(*) AS c FROM parts GROUP BY 1, 2), top AS (SELECT *, row_number() OVER (PARTITION BY part ORDER BY c DESC, item_id) AS rank FROM each) SELECT part, item_id, c AS score, rank FROM top WHERE rank <= 20")
def q_scaling_prefixes(spark, d):
    parts = P.prefix_fractions(A.ratings(spark, d)).groupBy("part", "item_id").agg(F.count(F.lit(1)).alias("score"))
    return C.top_k(parts, 20, by="part").select("part", "item_id", "score", "rank")


FRACTIONS = (0.2, 0.6, 1.0)


@register(f"WITH {Q.RATINGS}, h AS (SELECT *, {Q._hash(42, 'item_id')} % 10000 AS share FROM ratings), f AS (SELECT fraction, h.* FROM h JOIN (VALUES (0.2), (0.6), (1.0)) v(fraction) ON share < CAST(fraction * 10000 AS INT)), p AS (SELECT *, count(*) OVER w AS n, row_number() OVER (w ORDER BY {Q.TIME}) - 1 AS pos FROM f WINDOW w AS (PARTITION BY fraction, user_id)), s AS (SELECT *, CASE WHEN pos < n - (CASE WHEN n >= 2 THEN least(5, greatest(1, n // 2)) ELSE 0 END) THEN 'train' ELSE 'test' END AS split FROM p), train AS (SELECT * FROM s WHERE split = 'train'), ti AS (SELECT DISTINCT fraction, item_id FROM train), tu AS (SELECT DISTINCT fraction, user_id FROM train), test AS (SELECT s.* FROM s SEMI JOIN ti ON s.fraction = ti.fraction AND s.item_id = ti.item_id SEMI JOIN tu ON s.fraction = tu.fraction AND s.user_id = tu.user_id WHERE split = 'test') SELECT CAST(fraction AS DOUBLE) AS catalog_fraction, count(DISTINCT user_id) FILTER (WHERE rating >= 4) AS n_users FROM test GROUP BY 1")
def q_catalog_sizes(spark, d):
    r = C.hash_sample
    out = None
    for f in FRACTIONS:
        mine = P.cold_start(P.leave_last_n(r(A.ratings(spark, d), "item_id", f)))
        got = mine.filter("split = 'test'").agg(F.count_distinct(F.when(F.col("rating") >= 4, F.col("user_id"))).alias("n_users")).select(F.lit(f).alias("catalog_fraction"), "n_users")
        out = got if out is None else out.unionByName(got)
    return out


@register("SELECT upper(p_brand) AS name, avg(p_retailprice) AS mean, median(p_retailprice) AS middle, min(p_retailprice) AS least, max(p_retailprice) AS most FROM part GROUP BY 1")
def q_describe_groups(spark, d):
    p = A.table(spark, d, "part").groupBy(F.upper("p_brand").alias("name"))
    return p.agg(F.avg("p_retailprice").alias("mean"), F.median("p_retailprice").alias("middle"), F.min("p_retailprice").alias("least"), F.max("p_retailprice").alias("most"))


@register(f"WITH {M.EVALUATED} SELECT model, round(coverage, 6) AS coverage, round(novelty, 6) AS novelty FROM table_ WHERE k = 10")
def q_coverage_novelty(spark, d):
    return E.frames(M._evaluated(spark, d))["coverage_novelty"].select("model", F.round("coverage", 6).alias("coverage"), F.round("novelty", 6).alias("novelty"))


@register("SELECT p_partkey AS item_id, round(CASE WHEN p_size % 5 = 0 THEN 0 ELSE p_retailprice / p_size END, 6) AS ratio, greatest(0.5, least(5.0, p_size / 8.0)) AS clipped FROM part")
def q_safe_ratio(spark, d):
    p = A.table(spark, d, "part")
    divisor = F.when(F.col("p_size") % 5 != 0, F.col("p_size").cast("double")).otherwise(F.lit(0.0))
    return p.select(F.col("p_partkey").alias("item_id"), F.round(S.safe_divide(F.col("p_retailprice").cast("double"), divisor), 6).alias("ratio"), X.clipped(F.col("p_size") / F.lit(8.0)).alias("clipped"))
