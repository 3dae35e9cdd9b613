"""Further registered queries: sources, candidate sets, explanations, bias-only factor models and evaluation tables, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import queries as Q
from .functions import scalars as S
from .operators import candidates as C
from .operators import features as X
from .operators import splits as P
from .plans import adapters as A
from .plans import evaluate as E
from .plans import models as MD
from .sources import movielens as ML

QUERIES: dict = {}
SQL: dict[str, str] = {}


def register(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


def _gappy(spark, d) -> DataFrame:
    """Items with gaps: some have no title, size or price."""
    p = A.table(spark, d, "part")
    gap = lambda c, n: F.when(F.col("p_size") % n != 0, F.col(c))
    return p.select(F.col("p_partkey").alias("item_id"), gap("p_name", 9).alias("title"), gap("p_size", 5).alias("size"), gap("p_retailprice", 4).alias("price"))


GAPPY = "g AS (SELECT p_partkey AS item_id, CASE WHEN p_size % 9 <> 0 THEN p_name END AS title, CASE WHEN p_size % 5 <> 0 THEN p_size END AS size, CASE WHEN p_size % 4 <> 0 THEN p_retailprice END AS price FROM part)"


@register(f"WITH {GAPPY} SELECT * FROM g WHERE title IS NOT NULL AND size IS NOT NULL AND price IS NOT NULL")
def q_drop_any_null(spark, d):
    return C.complete_rows(_gappy(spark, d))


@register(f"WITH {GAPPY} SELECT * FROM g WHERE size IS NOT NULL")
def q_drop_null_in_column(spark, d):
    return C.complete_rows(_gappy(spark, d), "size")


@register(f"WITH {GAPPY} SELECT item_id, coalesce(title, '') AS title, '' AS keywords FROM g")
def q_text_defaults(spark, d):
    return C.text_defaults(_gappy(spark, d), "title", "keywords").drop("size", "price", "no_such_column")


@register("SELECT c_custkey AS user_id, count(o_custkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'F' GROUP BY 1")
def q_user_counts(spark, d):
    users = A.table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"))
    return C.user_counts(users, A.table(spark, d, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("user_id")))


@register("SELECT p_partkey AS item_id, p_brand, round(avg(p_retailprice) OVER (PARTITION BY p_brand), 4) AS mean FROM part")
def q_group_mean(spark, d):
    p = A.table(spark, d, "part").select(F.col("p_partkey").alias("item_id"), "p_brand", "p_retailprice")
    return C.with_group_mean(p, "p_brand", "p_retailprice", "mean").select("item_id", "p_brand", F.round("mean", 4).alias("mean"))


@register("SELECT p_partkey, p_name FROM part ORDER BY p_partkey LIMIT 20")
def q_head(spark, d):
    return A.table(spark, d, "part").select("p_partkey", "p_name").orderBy("p_partkey").limit(20)


def _landed(spark, d) -> tuple[DataFrame, DataFrame]:
    """Part rows as JSON metadata records, parsed with the landed schema, and links to them."""
    p = A.table(spark, d, "part")
    name = lambda c: F.struct(F.col(c).alias("name")) if isinstance(c, str) else F.struct(c.alias("name"))
    record = F.struct(
        F.col("p_partkey").cast("int").alias("id"), F.when(F.col("p_size") % 9 != 0, F.col("p_name")).alias("title"), F.concat((F.col("p_size") + 1950).cast("string"), F.lit("-01-02")).alias("release_date"),
        F.when(F.col("p_size") % 4 != 0, F.col("p_retailprice")).alias("vote_average"), F.col("p_size").alias("vote_count"), F.when(F.col("p_size") % 6 != 0, F.col("p_size") * 2).alias("runtime"),
        F.struct(F.transform(F.split("p_name", " "), name).alias("cast"), F.array(F.struct(F.col("p_type").alias("name"), F.lit("Producer").alias("job")), F.struct(F.col("p_brand").alias("name"), F.lit("Director").alias("job"))).alias("crew")).alias("credits"),
        F.struct(F.array(name("p_type"), name(F.lit(""))).alias("keywords")).alias("keywords"),
    )
    raw = p.select(F.from_json(F.to_json(record), ML.JSON).alias("r")).select("r.*")
    links = p.select(F.col("p_partkey").cast("int").alias("movieId"), F.lit(None).cast("int").alias("imdbId"), F.when(F.col("p_partkey") % 7 != 0, F.col("p_partkey")).cast("int").alias("tmdbId"))
    return raw, links


META = "meta AS (SELECT p_partkey AS movieId, CASE WHEN p_size % 9 <> 0 THEN p_name ELSE '' END AS title, CAST(1950 + p_size AS VARCHAR) AS year, array_to_string(string_split(p_name, ' ')[1:5], '|') AS cast_names, string_split(p_name, ' ')[1] AS main_actor, p_brand AS director, CASE WHEN p_size % 4 <> 0 THEN p_retailprice ELSE 0 END AS rating, CASE WHEN p_size % 6 <> 0 THEN p_size * 2 ELSE 0 END AS runtime, p_type AS words, p_size AS vote_count FROM part WHERE p_partkey % 7 <> 0)"


@register(f"WITH {META} SELECT * FROM meta")
def q_project_metadata(spark, d):
    m = ML.project_metadata(*_landed(spark, d))
    return m.select("movieId", "title", "year", F.array_join("cast", "|").alias("cast_names"), "main_actor", "director", "rating", "runtime", F.array_join("keywords", "|").alias("words"), "vote_count")


@register("SELECT p_partkey AS movieId, p_partkey AS tmdbId FROM part WHERE p_partkey % 7 <> 0 AND p_partkey % 3 <> 0")
def q_missing_links(spark, d):
    raw, links = _landed(spark, d)
    return ML.missing_links(links, ML.project_metadata(raw, links).filter("movieId % 3 = 0")).select("movieId", "tmdbId")


@register(f"WITH {META} SELECT p_partkey AS movieId, p_name AS title, lower(p_type) AS genres, director, coalesce(runtime, -1) AS runtime, year FROM part LEFT JOIN meta ON p_partkey = movieId")
def q_with_metadata(spark, d):
    movies = A.table(spark, d, "part").select(F.col("p_partkey").cast("int").alias("movieId"), F.col("p_name").alias("title"), F.lower("p_type").alias("genres"))
    return ML.with_metadata(movies, ML.project_metadata(*_landed(spark, d))).select("movieId", "title", "genres", "director", F.coalesce("runtime", F.lit(-1)).alias("runtime"), "year")


@register(f"WITH {Q.POPULAR}, v AS (SELECT user_id, item_id, score, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS rank FROM users CROSS JOIN pop ANTI JOIN seen USING (user_id, item_id) WHERE item_id % 10 = 3) SELECT user_id, item_id, score, rank FROM v WHERE rank <= 10")
def q_popularity_valid_items(spark, d):
    train, test = Q._train_test(spark, d)
    valid = A.items(spark, d).filter("item_id % 10 = 3").select("item_id")
    return MD.Popularity.fit(train).recommend(test.select("user_id"), 10, train, valid).select("user_id", "item_id", "score", "rank")


@register(f"WITH {Q.POPULAR} SELECT user_id, rank, item_id, p_name AS title, score FROM recs JOIN part ON p_partkey = item_id")
def q_popularity_titles(spark, d):
    return C.with_titles(Q._popular(spark, d)[0], A.items(spark, d)).select("user_id", "rank", "item_id", "title", "score")


@register(f"WITH {Q.LLO}, test AS (SELECT * FROM s WHERE split = 'test'), train AS (SELECT * FROM s WHERE split = 'train') SELECT DISTINCT item_id FROM (SELECT item_id FROM train UNION ALL SELECT item_id FROM test)")
def q_catalog(spark, d):
    s = P.leave_last_n(A.ratings(spark, d))
    return C.catalog(s.filter("split = 'train'"), s.filter("split = 'test'"))


POOL = f"WITH {Q.RATINGS}, rel AS (SELECT DISTINCT user_id, item_id FROM ratings WHERE rating >= 4), i AS (SELECT DISTINCT item_id FROM ratings), u AS (SELECT DISTINCT user_id FROM ratings), p AS (SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY {Q._hash(42, 'user_id', 'item_id')}, item_id) AS r FROM u CROSS JOIN i ANTI JOIN (SELECT DISTINCT user_id, item_id FROM ratings) USING (user_id, item_id)), b AS (SELECT user_id, item_id, 0 AS part FROM rel UNION ALL SELECT user_id, item_id, 1 FROM p WHERE r <= 9) SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY part, item_id) AS pos FROM b"


@register(POOL)
def q_ordered_pool(spark, d):
    r = C.landed(A.ratings(spark, d).select("user_id", "item_id", "rating"))
    return C.ordered_pool(C.relevant(r), C.negatives(r, r, r, 9))


@register(f"WITH h AS (SELECT p_partkey AS item_id, {Q._hash(42, 'p_partkey')} AS h FROM part) SELECT item_id FROM h WHERE h % 10000 < 2000")
def q_hash_sample(spark, d):
    return C.hash_sample(A.items(spark, d).select("item_id"), "item_id", 0.2)


TUNE = f"{Q.LLO}, ti AS (SELECT DISTINCT item_id FROM s WHERE split = 'train'), tu AS (SELECT DISTINCT user_id FROM s WHERE split = 'train'), c AS (SELECT s.* FROM s LEFT JOIN ti ON s.item_id = ti.item_id LEFT JOIN tu ON s.user_id = tu.user_id WHERE split = 'train' OR (ti.item_id IS NOT NULL AND tu.user_id IS NOT NULL)), held AS (SELECT user_id FROM tu ORDER BY {Q._hash(42, 'user_id')}, user_id LIMIT (SELECT greatest(1, CAST(floor(count(*) * 0.2::DOUBLE) AS BIGINT)) FROM tu))"


@register(f"WITH {TUNE} SELECT {Q.KEYS}, CASE WHEN split = 'test' THEN 'test' WHEN c.user_id IN (SELECT user_id FROM held) THEN 'val' ELSE 'train' END AS split FROM c")
def q_tuning_split(spark, d):
    return P.tuning_split(A.ratings(spark, d)).select("user_id", "item_id", "k1", "k2", "split")


def _vectors(spark, d) -> DataFrame:
    e = A.table(spark, d, "embeddings").select(F.col("vec_id").alias("item_id"), F.posexplode("embedding").alias("p", "value"))
    return X.similarity(X.l2_normalise(e.select("item_id", F.col("p").alias("feature"), F.col("value").cast("double").alias("value"))), k=10)


EDGES = Q.SQL["q_similarity_topk"].partition(" SELECT src_item, dst_item")[0] + ", edges AS (SELECT src_item, dst_item, s, rank FROM r WHERE rank <= 10)"


@register(f"{EDGES} SELECT src_item, dst_item, round(s, 6) AS similarity, rank FROM edges WHERE src_item % 5 = 0 AND rank <= 3")
def q_similar_items(spark, d):
    edges = _vectors(spark, d)
    asked = A.table(spark, d, "embeddings").filter("vec_id % 5 = 0").select(F.col("vec_id").alias("item_id"))
    out = MD.Content(None, None, None, edges).similar(asked, 3)
    return out.select("src_item", "dst_item", F.round("similarity", 6).alias("similarity"), "rank")


@register(f"{EDGES}, liked AS (SELECT label AS user_id, vec_id AS reason_item FROM embeddings WHERE vec_id % 2 = 1), x AS (SELECT user_id, src_item AS item_id, reason_item, s, row_number() OVER (PARTITION BY user_id, src_item ORDER BY s DESC, reason_item) AS n FROM edges JOIN liked ON dst_item = reason_item WHERE src_item % 10 = 0) SELECT user_id, item_id, n AS rank, round(s, 6) AS similarity FROM x WHERE n <= 3")
def q_content_explain(spark, d):
    e = A.table(spark, d, "embeddings")
    users = e.select(F.col("label").cast("long").alias("user_id")).distinct()
    pairs = users.join(F.broadcast(e.filter("vec_id % 10 = 0").select(F.col("vec_id").alias("item_id"))))  # a sample of 50 to 200 items
    liked = e.filter("vec_id % 2 = 1").select(F.col("label").cast("long").alias("user_id"), F.col("vec_id").alias("item_id"))
    out = MD.Content(None, None, None, _vectors(spark, d)).explain(pairs, liked, 3)
    return out.select("user_id", "item_id", "rank", F.round("similarity", 6).alias("similarity"))


@register(f"WITH {Q.CONTENT}, r AS (SELECT user_id, pv, row_number() OVER (PARTITION BY user_id ORDER BY round(pv, 9) DESC, feature) AS rank FROM prof) SELECT user_id, rank, round(pv, 6) AS value FROM r WHERE rank <= 5")
def q_profile_view(spark, d):
    m, r = Q._content(spark, d)
    return m.profile_view(r.select("user_id")).select("user_id", "rank", F.round("value", 6).alias("value"))


@register(f"WITH {Q.RATINGS}, {Q.TFIDF}, liked AS (SELECT user_id, item_id, rating FROM ratings WHERE rating >= 4), nl AS (SELECT user_id, sum(rating) AS c FROM liked GROUP BY 1) SELECT user_id, feature, round(sum(value * rating) / any_value(c), 6) AS value FROM liked JOIN x USING (item_id) JOIN nl USING (user_id) GROUP BY 1, 2")
def q_rating_weighted_profile(spark, d):
    r = A.ratings(spark, d)
    m = MD.Content.fit(Q._item_features(spark, d), r, rating_weighted=True)
    return m.profiles.select("user_id", "feature", F.round("value", 6).alias("value"))


@register(f"WITH {Q.CONTENT}, g AS (SELECT item_id, count(*) AS a FROM ratings GROUP BY 1), r AS (SELECT user_id, 0.3 * coalesce(a, 0) + 0.7 * score AS v, row_number() OVER (PARTITION BY user_id ORDER BY round(0.3 * coalesce(a, 0) + 0.7 * score, 9) DESC, item_id) AS rank FROM sc LEFT JOIN g USING (item_id) ANTI JOIN (SELECT DISTINCT user_id, item_id FROM ratings) USING (user_id, item_id)) SELECT user_id, rank, round(v, 5) AS score FROM r WHERE rank <= 10")
def q_hybrid_topk(spark, d):
    m, r = Q._content(spark, d)
    users = r.filter("rating >= 4").select("user_id").distinct()
    out = MD.Hybrid(MD.Popularity.fit(r), m, 0.3).recommend(users, 10, r)
    return out.select("user_id", "rank", F.round("score", 5).alias("score"))


#: Two epochs of the half-steps with no factors: each bias is the ridge mean of what the other side leaves.
BIAS = "few AS (SELECT * FROM train WHERE item_id IN (SELECT item_id FROM train GROUP BY 1 HAVING count(*) >= 5)), mu AS (SELECT avg(rating) AS mu FROM few), a AS (SELECT user_id, item_id, sum(rating) AS r FROM few GROUP BY 1, 2), u1 AS (SELECT user_id, sum(r - mu) / (count(*) + 0.02) AS b FROM a, mu GROUP BY 1), i1 AS (SELECT item_id, sum(r - mu - b) / (count(*) + 0.02) AS b FROM a JOIN u1 USING (user_id), mu GROUP BY 1), u2 AS (SELECT user_id, sum(r - mu - b) / (count(*) + 0.02) AS b FROM a JOIN i1 USING (item_id), mu GROUP BY 1), i2 AS (SELECT item_id, sum(r - mu - b) / (count(*) + 0.02) AS b FROM a JOIN u2 USING (user_id), mu GROUP BY 1)"


def _bias(spark, d):
    train, test = Q._train_test(spark, d)
    return MD.BiasedALS.fit(train, k=0, epochs=2), train, test


@register(f"WITH {Q.POPULAR}, {BIAS} SELECT t.user_id, t.item_id, round(greatest(0.5, least(5.0, CASE WHEN u2.b IS NULL OR i2.b IS NULL THEN mu ELSE mu + u2.b + i2.b END)), 5) AS score FROM test t CROSS JOIN mu LEFT JOIN u2 ON t.user_id = u2.user_id LEFT JOIN i2 ON t.item_id = i2.item_id")
def q_als_bias_score(spark, d):
    m, _, test = _bias(spark, d)
    return m.score(test.select("user_id", "item_id")).select("user_id", "item_id", F.round("score", 5).alias("score"))


@register(f"WITH {Q.POPULAR}, {BIAS} SELECT t.user_id, t.item_id, round(greatest(0.5, least(5.0, CASE WHEN u2.b IS NULL OR i2.b IS NULL THEN mu ELSE mu + u2.b + i2.b END)) / pow(greatest(coalesce(pop.score, 1), 1), 0.5), 5) AS score FROM test t CROSS JOIN mu LEFT JOIN u2 ON t.user_id = u2.user_id LEFT JOIN i2 ON t.item_id = i2.item_id LEFT JOIN pop ON t.item_id = pop.item_id")
def q_als_popularity_penalty(spark, d):
    from dataclasses import replace

    m, _, test = _bias(spark, d)
    return replace(m, penalty=0.5).score(test.select("user_id", "item_id")).select("user_id", "item_id", F.round("score", 5).alias("score"))


@register(f"WITH {Q.POPULAR}, {BIAS}, r AS (SELECT user_id, mu + u2.b + i2.b AS raw, row_number() OVER (PARTITION BY user_id ORDER BY mu + u2.b + i2.b DESC, item_id) AS rank FROM (SELECT DISTINCT user_id FROM test) JOIN u2 USING (user_id) CROSS JOIN i2 CROSS JOIN mu ANTI JOIN (SELECT DISTINCT user_id, item_id FROM train) USING (user_id, item_id)) SELECT user_id, rank, round(greatest(0.5, least(5.0, raw)), 5) AS score FROM r WHERE rank <= 10")
def q_als_bias_topk(spark, d):
    m, train, test = _bias(spark, d)
    known = test.select("user_id").distinct().join(m.users_.select(F.col("id").alias("user_id")), "user_id", "left_semi")
    return m.recommend(known, 10, train).select("user_id", "rank", F.round("score", 5).alias("score"))


EVALUATED = f"{Q.METRICS}, each AS (SELECT user_id, k, hits, hits / k AS precision, hits / n_rel AS recall, dcg / (SELECT sum(1 / log2(i + 1)) FROM range(1, 11) r(i) WHERE i <= least(n_rel, k)) AS ndcg, ap / least(n_rel, k) AS map, coalesce(1.0 / first, 0) AS mrr FROM m), means AS (SELECT k, avg(precision) AS precision, avg(recall) AS recall, avg(ndcg) AS ndcg, avg(map) AS map, avg(mrr) AS mrr, count(*) FILTER (WHERE hits > 0) AS n_users, count(*) AS n_evaluated FROM each GROUP BY k), cov AS (SELECT k, count(DISTINCT item_id) / (SELECT count(DISTINCT item_id)::DOUBLE FROM (SELECT item_id FROM train UNION ALL SELECT item_id FROM test)) AS coverage FROM recs JOIN (VALUES (5), (10)) v(k) ON rank <= k GROUP BY k), nov AS (SELECT k, sum(-log2(score / (SELECT count(*) FROM train))) AS s FROM recs JOIN (VALUES (5), (10)) v(k) ON rank <= k WHERE user_id IN (SELECT user_id FROM nr) GROUP BY k), table_ AS (SELECT 'popularity' AS model, k, precision, recall, ndcg, map, mrr, s / (n_evaluated * k) AS novelty, coverage, n_users FROM means JOIN cov USING (k) JOIN nov USING (k))"
NAMES = ("precision", "recall", "ndcg", "map", "mrr", "novelty", "coverage")


def _evaluated(spark, d) -> DataFrame:
    train, test = Q._train_test(spark, d)
    return E.evaluate({"popularity": MD.Popularity.fit(train)}, train, test, ks=(5, 10), most=10)


@register(f"WITH {EVALUATED} SELECT model, k, {', '.join(f'round({n}, 6) AS {n}' for n in NAMES)}, n_users FROM table_")
def q_eval_popularity(spark, d):
    return _evaluated(spark, d).select("model", "k", *(F.round(n, 6).alias(n) for n in NAMES), "n_users")


@register(f"WITH {EVALUATED} SELECT model, k, round(precision, 6) AS value, round(precision - sqrt(precision * (1 - precision) / n_users), 6) AS low, round(precision + sqrt(precision * (1 - precision) / n_users), 6) AS high FROM table_")
def q_metric_trend(spark, d):
    return E.metric_trend(_evaluated(spark, d), "precision").select("model", "k", *(F.round(c, 6).alias(c) for c in ("value", "low", "high")))


@register(f"WITH {EVALUATED} SELECT model, metric, round(value, 6) AS value FROM (UNPIVOT (SELECT model, {', '.join(NAMES)} FROM table_ WHERE k = 10) ON {', '.join(NAMES)} INTO NAME metric VALUE value)")
def q_metric_frame(spark, d):
    return E.unpivot_results(_evaluated(spark, d), 10).select("model", "metric", F.round("value", 6).alias("value"))


@register("SELECT user_id % 3 AS fraction, 100 AS n_train_ratings, round(avg(value) FILTER (WHERE event_type = 'click'), 6) AS click, round(avg(value) FILTER (WHERE event_type = 'view'), 6) AS view FROM events GROUP BY 1")
def q_pivot_results(spark, d):
    e = A.table(spark, d, "events").select((F.col("user_id") % 3).alias("fraction"), F.lit(100).alias("n_train_ratings"), F.col("event_type").alias("model"), "value")
    return E.pivot_results(e, "value", ["click", "view"]).select("fraction", "n_train_ratings", F.round("click", 6).alias("click"), F.round("view", 6).alias("view"))


@register("SELECT p_partkey AS item_id, CASE WHEN p_size % 5 = 0 THEN 0 ELSE CAST(p_size AS DOUBLE) / 7 END AS value, CAST(1950 + p_size AS VARCHAR) AS year, round(sqrt(0.25 / p_size), 6) AS se FROM part")
def q_scalars(spark, d):
    p = A.table(spark, d, "part")
    odd = F.when(F.col("p_size") % 10 == 0, F.lit(float("nan"))).when(F.col("p_size") % 5 == 0, F.lit(float("inf"))).otherwise(F.col("p_size").cast("double") / 7)
    return p.select(F.col("p_partkey").alias("item_id"), S.zero_if_not_finite(odd).alias("value"), S.year_of(F.concat((F.col("p_size") + 1950).cast("string"), F.lit("-05-06"))).alias("year"), F.round(S.standard_error(F.lit(0.5), F.col("p_size")), 6).alias("se"))


@register("SELECT p_size, count(*) AS n FROM part GROUP BY 1")
def q_histogram(spark, d):
    return A.table(spark, d, "part").groupBy("p_size").agg(F.count(F.lit(1)).alias("n"))


@register("SELECT item_id, rank FROM (SELECT p_partkey AS item_id, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS rank FROM part WHERE p_size = 7) WHERE rank <= 10")
def q_top_items_of_group(spark, d):
    p = A.table(spark, d, "part").filter("p_size = 7").select(F.col("p_partkey").alias("item_id"), F.col("p_retailprice").alias("score"), F.col("p_size").alias("user_id"))
    return C.top_k(p, 10).select("item_id", "rank")
