"""The registered queries and, by the same name, their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .functions import scalars as S
from .operators import candidates as C
from .operators import features as X
from .operators import metrics as M
from .operators import splits as P
from .plans import adapters as A
from .plans import models as MD

QUERIES: dict = {}
SQL: dict[str, str] = {}
RATINGS = "ratings AS (SELECT o_custkey AS user_id, l_partkey AS item_id, ceil(l_quantity / 5) * 0.5 AS rating, l_shipdate AS ts, l_orderkey AS k1, l_linenumber AS k2 FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"
KEYS = "user_id, item_id, k1, k2"
POS = "count(*) OVER (PARTITION BY user_id) AS n, row_number() OVER (PARTITION BY user_id ORDER BY {order}) - 1 AS pos"
TIME = "ts, item_id, k1, k2"


def _hash(seed: int, *keys: str) -> str:
    h = f"CAST({seed} AS BIGINT)"
    for k, m in zip(keys, (1103515245, 12345, 69069, 362437), strict=False):
        h = f"(({h} + (CAST({k} AS BIGINT) % 2147483647) * {m}) % 2147483647)"
    return f"(({h} * 48271) % 2147483647)"


SHUFFLED = _hash(42, "user_id", "item_id", "k1", "k2") + ", " + TIME
LLO = f"{RATINGS}, p AS (SELECT *, {POS.format(order=TIME)} FROM ratings), s AS (SELECT *, CASE WHEN pos < n - (CASE WHEN n >= 2 THEN least(5, greatest(1, n // 2)) ELSE 0 END) THEN 'train' ELSE 'test' END AS split FROM p)"
POPULAR = f"{LLO}, train AS (SELECT * FROM s WHERE split = 'train'), test AS (SELECT * FROM s WHERE split = 'test' AND item_id IN (SELECT item_id FROM train) AND user_id IN (SELECT user_id FROM train)), pop AS (SELECT item_id, CAST(count(*) AS DOUBLE) AS score FROM train GROUP BY 1), users AS (SELECT DISTINCT user_id FROM test), seen AS (SELECT DISTINCT user_id, item_id FROM train), most AS (SELECT max(c) + 10 AS m FROM (SELECT count(*) AS c FROM seen GROUP BY user_id)), near AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY score DESC, item_id) AS place FROM pop) WHERE place <= (SELECT m FROM most)), recs AS (SELECT * FROM (SELECT user_id, item_id, score, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS rank FROM users CROSS JOIN near ANTI JOIN seen USING (user_id, item_id)) WHERE rank <= 10)"


def register(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _train_test(spark, d) -> tuple[DataFrame, DataFrame]:
    s = C.landed(P.cold_start(P.leave_last_n(A.ratings(spark, d))))
    return s.filter("split = 'train'"), s.filter("split = 'test'")


def _popular(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    train, test = _train_test(spark, d)
    return MD.Popularity.fit(train).recommend(test.select("user_id"), 10, train), train, test


@register(f"WITH {POPULAR} SELECT user_id, item_id, score, rank FROM recs")
def q_popularity_topk(spark, d):
    return _popular(spark, d)[0].select("user_id", "item_id", "score", "rank")


def _split(name, f, sql):
    def q(spark, d):
        return f(A.ratings(spark, d)).select("user_id", "item_id", "k1", "k2", "split")

    q.__name__ = name
    register(sql)(q)


def _shares_sql(order: str) -> str:
    return f"WITH {RATINGS}, p AS (SELECT *, {POS.format(order=order)} FROM ratings), a AS (SELECT *, greatest(1, floor(n * 0.8::DOUBLE)) AS a0, least(floor(n * 0.1::DOUBLE), n - greatest(1, floor(n * 0.8::DOUBLE))) AS b0 FROM p), b AS (SELECT *, CASE WHEN n - a0 - b0 = 0 AND n >= 2 AND b0 = 0 THEN a0 - 1 ELSE a0 END AS a1, CASE WHEN n - a0 - b0 = 0 AND n >= 2 AND b0 > 0 THEN b0 - 1 ELSE b0 END AS b1 FROM a) SELECT {KEYS}, CASE WHEN pos < a1 THEN 'train' WHEN pos < a1 + b1 THEN 'val' ELSE 'test' END AS split FROM b"


_split("q_leave_last_n", P.leave_last_n, f"WITH {LLO} SELECT {KEYS}, split FROM s")
_split("q_cold_start", lambda r: P.cold_start(P.leave_last_n(r)), f"WITH {LLO}, b AS MATERIALIZED (SELECT {KEYS}, split FROM s), ti AS MATERIALIZED (SELECT DISTINCT item_id, 1 AS known_item FROM b WHERE split = 'train'), tu AS MATERIALIZED (SELECT DISTINCT user_id, 1 AS known_user FROM b WHERE split = 'train') SELECT {KEYS}, split FROM b LEFT JOIN ti USING (item_id) LEFT JOIN tu USING (user_id) WHERE split = 'train' OR (known_item = 1 AND known_user = 1)")
_split("q_temporal_user", P.temporal_user, _shares_sql(TIME))
_split("q_stratified", P.random_user, _shares_sql(SHUFFLED))
_split("q_hybrid_stratified", P.banded, f"WITH {RATINGS}, p AS (SELECT *, {POS.format(order=SHUFFLED)} FROM ratings), h AS (SELECT *, CAST(round_even(n * 0.3::DOUBLE, 0) AS INT) AS hold FROM p), b AS (SELECT *, CASE WHEN n >= 6 THEN hold // 2 WHEN n >= 3 THEN 1 ELSE 0 END AS v, CASE WHEN n >= 6 THEN hold - hold // 2 WHEN n >= 2 THEN 1 ELSE 0 END AS t FROM h) SELECT {KEYS}, CASE WHEN pos < n - v - t THEN 'train' WHEN pos < n - t THEN 'val' ELSE 'test' END AS split FROM b")
GLOBAL = f"{RATINGS}, g AS (SELECT *, row_number() OVER (ORDER BY ts, user_id, item_id, k1, k2) - 1 AS pos, count(*) OVER () AS n FROM ratings)"
_split("q_global_temporal", P.global_temporal, f"WITH {GLOBAL} SELECT {KEYS}, CASE WHEN pos < floor(n * 0.8::DOUBLE) THEN 'train' ELSE 'test' END AS split FROM g")
HELD = f"{RATINGS}, u AS (SELECT DISTINCT user_id FROM ratings), held AS (SELECT user_id FROM u ORDER BY {_hash(42, 'user_id')}, user_id LIMIT (SELECT greatest(1, CAST(floor(count(*) * 0.2::DOUBLE) AS BIGINT)) FROM u))"
_split("q_user_holdout", P.user_holdout, f"WITH {HELD} SELECT {KEYS}, CASE WHEN user_id IN (SELECT user_id FROM held) THEN 'test' ELSE 'train' END AS split FROM ratings")


@register(f"WITH {RATINGS}, p AS (SELECT *, {POS.format(order=TIME)} FROM ratings), f AS (SELECT *, least(pos // greatest(1, n // 5), 4) AS part FROM p) SELECT {KEYS}, fold, CASE WHEN part = fold THEN 'test' ELSE 'train' END AS split FROM f JOIN range(1, 5) r(fold) ON part <= fold")
def q_kfold(spark, d):
    return P.kfold(A.ratings(spark, d)).select("user_id", "item_id", "k1", "k2", "fold", "split")


@register(f"WITH {GLOBAL} SELECT part, count(*) AS n_rows, sum(item_id) AS items, max(ts) AS last_ts FROM g JOIN range(1, 8) r(part) ON pos < (part * n) // 7 GROUP BY part")
def q_prefix_fractions(spark, d):
    return P.prefix_fractions(A.ratings(spark, d)).groupBy("part").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("item_id").alias("items"), F.max("ts").alias("last_ts"))


@register(f"WITH {RATINGS} SELECT user_id, item_id, sum(rating) AS value FROM ratings GROUP BY 1, 2")
def q_user_item_matrix(spark, d):
    return C.matrix(A.ratings(spark, d), "user_id", "item_id", "rating")


@register("SELECT user_id, event_type, count(*) AS value FROM events GROUP BY 1, 2")
def q_tag_counts(spark, d):
    return C.matrix(A.table(spark, d, "events"), "user_id", "event_type")


@register(f"WITH {RATINGS} SELECT item_id, count(*) AS n, avg(rating) AS mean FROM ratings GROUP BY 1 HAVING count(*) >= 25")
def q_min_ratings(spark, d):
    return C.min_ratings(C.valid_ratings(A.ratings(spark, d)), 25).groupBy("item_id").agg(F.count(F.lit(1)).alias("n"), F.avg("rating").alias("mean"))


@register(f"WITH {RATINGS} SELECT user_id, avg(rating) AS mean, avg(rating) - (SELECT avg(rating) FROM ratings) > 0 AS above FROM ratings GROUP BY 1")
def q_user_means(spark, d):
    r = A.ratings(spark, d)
    total = r.agg(F.avg("rating").alias("all"))
    return r.groupBy("user_id").agg(F.avg("rating").alias("mean")).join(F.broadcast(total)).select("user_id", "mean", (F.col("mean") - F.col("all") > 0).alias("above"))


@register(f"WITH {RATINGS}, c AS (SELECT p_partkey AS item_id, ln(1 + count(user_id)) AS l FROM part LEFT JOIN ratings ON p_partkey = item_id GROUP BY 1) SELECT item_id, round(l / max(l) OVER (), 6) AS pop FROM c")
def q_pop_norm(spark, d):
    return MD.pop_norm(A.items(spark, d).select("item_id"), A.ratings(spark, d)).select("item_id", F.round("pop", 6).alias("pop"))


@register(r"""WITH t AS (SELECT doc_id, trim(regexp_replace(lower(coalesce(text, '')), '\s+', ' ', 'g')) AS c FROM documents) SELECT doc_id, CASE WHEN c = '' THEN 'unknown' ELSE c END AS cleaned FROM t""")
def q_clean_text(spark, d):
    return A.table(spark, d, "documents").select("doc_id", S.clean(F.col("text")).alias("cleaned"))


@register("WITH w AS (SELECT p_partkey AS item_id, string_split(lower(p_name), ' ') AS c FROM part) SELECT item_id, array_to_string(flatten(list_transform(c, lambda x, i: list_transform(range(greatest(1, 4 - i)), lambda y: x))), ' ') AS weighted, CASE WHEN len(list_filter(c, lambda x: length(x) >= 3)) > 0 THEN array_to_string(list_filter(c, lambda x: length(x) >= 3), ' ') ELSE 'unknown' END AS keywords FROM w")
def q_cast_keywords(spark, d):
    return A.items(spark, d).select("item_id", S.cast_text(F.col("cast")).alias("weighted"), S.keyword_text(F.col("cast")).alias("keywords"))


@register("SELECT p_partkey AS item_id, 'genre_' || lower(unnest(string_split(p_type, '|'))) AS genre FROM part")
def q_genres(spark, d):
    from .sources.movielens import genres_long

    return genres_long(A.items(spark, d), "item_id")


TFIDF = r"""t AS (SELECT p_partkey AS item_id, unnest(regexp_extract_all(lower(p_name), '[\p{L}\p{N}_]{2,}')) AS term FROM part), tf AS (SELECT item_id, term, count(*) AS tf FROM t GROUP BY 1, 2), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1), raw AS (SELECT item_id, term, (1 + ln(tf)) * (ln((1.0 + (SELECT count(*) FROM part)) / (1 + df)) + 1) AS v FROM tf JOIN df USING (term)), x AS (SELECT item_id, 'text:' || term AS feature, v / sqrt(sum(v * v) OVER (PARTITION BY item_id)) AS value FROM raw)"""


def _item_features(spark, d):
    return X.tfidf(A.items(spark, d).select("item_id", F.col("title").alias("text")))


@register(f"WITH {TFIDF} SELECT item_id, feature, round(value, 6) AS value FROM x")
def q_tfidf(spark, d):
    return _item_features(spark, d).select("item_id", "feature", F.round("value", 6).alias("value"))


@register("WITH q AS (SELECT quantile_cont(p_retailprice, 0.01) AS a, quantile_cont(p_retailprice, 0.99) AS b FROM part), c AS (SELECT p_partkey AS item_id, least(greatest(p_retailprice, a), b) AS v FROM part, q) SELECT item_id, round((v - min(v) OVER ()) / (max(v) OVER () - min(v) OVER ()), 6) AS value FROM c")
def q_numeric_scale(spark, d):
    return X.scale_runtime(A.items(spark, d)).select("item_id", F.round("value", 6).alias("value"))


@register("WITH v AS (SELECT p_partkey AS item_id, CAST(p_size AS DOUBLE) AS v FROM part), n AS (SELECT least(1000, count(*)) AS n, list(v ORDER BY v) AS l FROM v), t AS (SELECT i, CAST(i AS DOUBLE) / (n - 1) AS ref, (i * (len(l) - 1)) // (n - 1) AS place, CAST((i * (len(l) - 1)) % (n - 1) AS DOUBLE) / (n - 1) AS beyond, l FROM n, range(0, 1000) r(i) WHERE i < n), grid AS (SELECT i, ref, l[place + 1] + beyond * (l[least(place + 2, len(l))] - l[place + 1]) AS g FROM t), ends AS (SELECT min(g) AS lo, max(g) AS hi, any_value(n.n) AS n FROM grid, n), x AS (SELECT DISTINCT v FROM v), rl AS (SELECT v, max(CASE WHEN g <= v THEN i END) AS r0, min(CASE WHEN g >= v THEN i END) AS l0 FROM x, grid GROUP BY v), y AS (SELECT v, a.ref + CASE WHEN a.g = v OR a2.g IS NULL THEN 0 ELSE (v - a.g) / (a2.g - a.g) / (n - 1) END AS yr, b.ref - CASE WHEN b.g = v OR b2.g IS NULL THEN 0 ELSE (b.g - v) / (b.g - b2.g) / (n - 1) END AS yl, lo, hi FROM rl CROSS JOIN ends JOIN grid a ON a.i = r0 JOIN grid b ON b.i = l0 LEFT JOIN grid a2 ON a2.i = r0 + 1 LEFT JOIN grid b2 ON b2.i = l0 - 1) SELECT item_id, round(CASE WHEN v = lo THEN 0 WHEN v = hi THEN 1 ELSE 0.5 * (yr + yl) END, 5) AS value FROM v JOIN y USING (v)")
def q_quantile_year(spark, d):
    return X.quantile_uniform(A.items(spark, d)).select("item_id", F.round("value", 5).alias("value"))


@register("WITH m AS (SELECT lower(trim(p_brand)) AS name, avg(p_retailprice) AS m FROM part GROUP BY 1), l AS (SELECT name, CASE WHEN m > 0 THEN ln(1 + m) ELSE 0 END AS v FROM m) SELECT p_partkey AS item_id, round((v - (SELECT min(v) FROM l)) / ((SELECT max(v) FROM l) - (SELECT min(v) FROM l)), 6) AS value FROM part JOIN l ON lower(trim(p_brand)) = name")
def q_creator_rating(spark, d):
    return X.creator_rating(A.items(spark, d), "director").select("item_id", F.round("value", 6).alias("value"))


@register("WITH e AS (SELECT vec_id, embedding FROM embeddings), p AS (SELECT a.vec_id AS src_item, b.vec_id AS dst_item, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS s FROM e a JOIN e b ON a.vec_id <> b.vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY src_item ORDER BY round(s, 9) DESC, dst_item) AS rank FROM p WHERE s >= 0.15) SELECT src_item, dst_item, round(s, 6) AS similarity, rank FROM r WHERE rank <= 10")
def q_similarity_topk(spark, d):
    e = A.table(spark, d, "embeddings").select(F.col("vec_id").alias("item_id"), F.posexplode("embedding").alias("p", "value"))
    f = X.l2_normalise(e.select("item_id", F.col("p").alias("feature"), F.col("value").cast("double").alias("value")))
    return X.similarity(f, k=10).select("src_item", "dst_item", F.round("similarity", 6).alias("similarity"), "rank")


CONTENT = f"{RATINGS}, {TFIDF}, liked AS (SELECT user_id, item_id FROM ratings WHERE rating >= 4), nl AS (SELECT user_id, count(*) AS c FROM liked GROUP BY 1), prof AS (SELECT user_id, feature, sum(value) / any_value(c) AS pv FROM liked JOIN x USING (item_id) JOIN nl USING (user_id) GROUP BY 1, 2), pl AS (SELECT p_partkey AS item_id, ln(1 + count(user_id)) AS l FROM part LEFT JOIN (SELECT * FROM ratings) ON p_partkey = item_id GROUP BY 1), pn AS (SELECT item_id, l / max(l) OVER () AS pop FROM pl), dots AS (SELECT user_id, item_id, sum(pv * value) AS dot FROM prof JOIN x USING (feature) GROUP BY 1, 2), sc AS (SELECT user_id, item_id, 0.95 * coalesce(dot, 0) + 0.05 * pop AS score FROM (SELECT user_id FROM nl) CROSS JOIN pn LEFT JOIN dots USING (user_id, item_id))"


def _content(spark, d):
    r = C.landed(A.ratings(spark, d).select("user_id", "item_id", "rating"))
    return MD.Content.fit(_item_features(spark, d), r), r


@register(f"WITH {CONTENT} SELECT user_id, feature, round(pv, 6) AS value FROM prof")
def q_user_profile(spark, d):
    return _content(spark, d)[0].profiles.select("user_id", "feature", F.round("value", 6).alias("value"))


@register(f"WITH {CONTENT}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY round(score, 9) DESC, item_id) AS rank FROM sc ANTI JOIN (SELECT DISTINCT user_id, item_id FROM ratings) USING (user_id, item_id)) SELECT user_id, rank, round(score, 5) AS score FROM r WHERE rank <= 10")
def q_content_topk(spark, d):
    m, r = _content(spark, d)
    users = r.filter("rating >= 4").select("user_id").distinct()
    return m.recommend(users, 10, r).select("user_id", "rank", F.round("score", 5).alias("score"))


@register(f"WITH {CONTENT}, g AS (SELECT item_id, count(*) AS a FROM ratings GROUP BY 1), pr AS (SELECT DISTINCT user_id, item_id FROM ratings WHERE user_id IN (SELECT user_id FROM nl)) SELECT user_id, item_id, round(0.3 * a + 0.7 * score, 5) AS score FROM pr JOIN sc USING (user_id, item_id) JOIN g USING (item_id)")
def q_hybrid_blend(spark, d):
    m, r = _content(spark, d)
    users = r.filter("rating >= 4").select("user_id").distinct()
    pairs = r.join(users, "user_id", "left_semi").select("user_id", "item_id").distinct()
    return MD.Hybrid(MD.Popularity.fit(r), m, 0.3).score(pairs).select("user_id", "item_id", F.round("score", 5).alias("score"))


PAIRS = "pairs AS (SELECT DISTINCT user_id, item_id FROM ratings), cb AS (SELECT user_id, item_id, 0.95 * coalesce(dot, 0) + 0.05 * pop AS b FROM {} JOIN pn USING (item_id) LEFT JOIN dots USING (user_id, item_id))"


@register(f"WITH {CONTENT}, {PAIRS.format('pairs')}, g AS (SELECT item_id, CAST(count(*) AS DOUBLE) AS a FROM ratings GROUP BY 1), w AS (SELECT user_id, item_id, a, b, min(a) OVER u AS a0, max(a) OVER u AS a1, min(b) OVER u AS b0, max(b) OVER u AS b1 FROM cb JOIN g USING (item_id) WINDOW u AS (PARTITION BY user_id)) SELECT user_id, item_id, round(0.5 * CASE WHEN a1 > a0 THEN (a - a0) / (a1 - a0) ELSE 0 END + 0.5 * CASE WHEN b1 > b0 THEN (b - b0) / (b1 - b0) ELSE 0 END, 5) AS score FROM w")
def q_hybrid_minmax(spark, d):
    m, r = _content(spark, d)
    out = MD.Hybrid(MD.Popularity.fit(r), m, 0.5, normalize=True).score(r.select("user_id", "item_id").distinct())
    return out.select("user_id", "item_id", F.round("score", 5).alias("score"))


@register(f"WITH {CONTENT}, g AS (SELECT item_id, count(*) AS a FROM ratings GROUP BY 1), fr AS (SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY a DESC, item_id) AS place FROM (SELECT DISTINCT user_id FROM ratings) CROSS JOIN g ANTI JOIN (SELECT DISTINCT user_id, item_id FROM ratings) USING (user_id, item_id)), few AS (SELECT * FROM fr WHERE place <= 50), {PAIRS.format('few')}, r AS (SELECT user_id, b, row_number() OVER (PARTITION BY user_id ORDER BY b DESC, place) AS rank FROM cb JOIN few USING (user_id, item_id)) SELECT user_id, rank, round(b, 5) AS score FROM r WHERE rank <= 10")
def q_cascade(spark, d):
    m, r = _content(spark, d)
    out = MD.Cascade(MD.Popularity.fit(r), m, 50).recommend(r.select("user_id"), 10, r)
    return out.select("user_id", "rank", F.round("score", 5).alias("score"))


def _als(spark, d):
    train, test = _train_test(spark, d)
    return MD.BiasedALS.fit(train, k=MD.FACTORS, epochs=MD.EPOCHS), train, test


@register()
def q_als_score(spark, d):
    m, _, test = _als(spark, d)
    return m.score(test.select("user_id", "item_id"))


@register()
def q_als_topk(spark, d):
    m, train, test = _als(spark, d)
    return m.recommend(test.select("user_id"), 10, train)


@register()
def q_als_explain(spark, d):
    m, train, test = _als(spark, d)
    return m.explain(test.select("user_id", "item_id").distinct(), train.filter("rating >= 4"))


NEG = f"WITH {RATINGS}, i AS (SELECT DISTINCT item_id FROM ratings), u AS (SELECT DISTINCT user_id FROM ratings), p AS (SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY {_hash(42, 'user_id', 'item_id')}, item_id) AS r FROM u CROSS JOIN i ANTI JOIN (SELECT DISTINCT user_id, item_id FROM ratings) USING (user_id, item_id)) SELECT user_id, item_id FROM p WHERE r <= 9"


@register(NEG)
def q_negatives(spark, d):
    r = C.landed(A.ratings(spark, d).select("user_id", "item_id"))
    return C.negatives(r, r, r, 9).select("user_id", "item_id")


METRICS = f"{POPULAR}, rel AS (SELECT DISTINCT user_id, item_id FROM test WHERE rating >= 4), nr AS (SELECT user_id, count(*) AS n_rel FROM rel GROUP BY 1), h AS (SELECT user_id, rank, row_number() OVER (PARTITION BY user_id ORDER BY rank) AS nth FROM recs JOIN rel USING (user_id, item_id)), m AS (SELECT user_id, k, n_rel, count(rank) AS hits, coalesce(sum(1 / log2(rank + 1)), 0) AS dcg, coalesce(sum(nth / rank), 0) AS ap, min(rank) AS first FROM nr CROSS JOIN (VALUES (5), (10)) v(k) LEFT JOIN h ON nr.user_id = h.user_id AND h.rank <= k GROUP BY ALL)".replace("SELECT user_id, k, n_rel", "SELECT nr.user_id, k, n_rel")


@register(f"WITH {METRICS} SELECT user_id, k, hits, n_rel, round(hits / k, 6) AS precision, round(hits / n_rel, 6) AS recall, round(CASE WHEN hits = 0 THEN 0 ELSE 2.0 * (hits / k) * (hits / n_rel) / ((hits / k) + (hits / n_rel)) END, 6) AS f1, round(dcg / (SELECT sum(1 / log2(i + 1)) FROM range(1, 11) r(i) WHERE i <= least(n_rel, k)), 6) AS ndcg, round(ap / least(n_rel, k), 6) AS map, round(coalesce(1.0 / first, 0), 6) AS mrr FROM m")
def q_metrics(spark, d):
    recs, _, test = _popular(spark, d)
    out = M.per_user(recs, C.relevant(test), (5, 10))
    return out.select("user_id", "k", "hits", "n_rel", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1", "ndcg", "map", "mrr")))


@register(f"WITH {POPULAR}, t AS (SELECT count(*) AS total FROM train) SELECT user_id, round(avg(-log2(score / total)), 6) AS novelty FROM recs, t GROUP BY 1")
def q_novelty(spark, d):
    recs, train, _ = _popular(spark, d)
    return M.list_novelty(recs, train).select("user_id", F.round("novelty", 6).alias("novelty"))


@register(f"WITH {POPULAR} SELECT count(DISTINCT item_id) / (SELECT count(DISTINCT item_id)::DOUBLE FROM s) AS coverage FROM recs")
def q_coverage(spark, d):
    recs, _, _ = _popular(spark, d)
    return M.coverage(recs, A.ratings(spark, d).select("item_id").distinct().count())


@register("WITH r AS (SELECT label AS user_id, vec_id, embedding::DOUBLE[] AS e, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS rank FROM embeddings), t AS (SELECT * FROM r WHERE rank <= 10) SELECT a.user_id, round(1 - avg(list_cosine_similarity(a.e, b.e)), 6) AS diversity FROM t a JOIN t b ON a.user_id = b.user_id AND a.rank < b.rank GROUP BY 1")
def q_diversity(spark, d):
    e = A.table(spark, d, "embeddings")
    lists = e.select(F.col("label").alias("user_id"), F.col("vec_id").alias("item_id"), F.row_number().over(Window.partitionBy("label").orderBy("vec_id")).alias("rank")).filter("rank <= 10")
    return M.diversity(lists, e.select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vector"))).select("user_id", F.round("diversity", 6).alias("diversity"))


@register()
def q_eval_table(spark, d):
    from .plans.evaluate import evaluate

    train, test = _train_test(spark, d)
    models = {"popularity": MD.Popularity.fit(train), "als": MD.BiasedALS.fit(train, k=MD.FACTORS, epochs=MD.EPOCHS)}
    return evaluate(models, train, test, ks=(5, 10), most=10)


@register("SELECT time_bucket(INTERVAL '1 hour', ts) AS start, CAST(json_extract_string(props, '$.k') AS BIGINT) AS item_id, count(*) AS n FROM events GROUP BY 1, 2")
def q_windowed_popularity(spark, d):
    from .streaming.popularity import windowed_popularity

    e = A.table(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.get_json_object("props", "$.k").cast("long").alias("item_id"))
    out = windowed_popularity(e)
    return out.withColumn("start", F.col("start").cast("timestamp_ntz"))
