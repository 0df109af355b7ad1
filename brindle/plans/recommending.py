"""Content-based and collaborative recommendation queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.functions.text import STOP_WORDS, cleaned_sql
from brindle.operators import content as C
from brindle.operators import recommending as R
from brindle.operators.similarity import LSH
from brindle.plans.registry import query
from brindle.sources import tables as T
from brindle.sources.shared import written

_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)
_COUNTS = rf"""
    w AS (SELECT key, unnest(string_split(trim({cleaned_sql("text")}), ' ')) AS raw FROM (SELECT DISTINCT source AS key, text FROM documents)),
    c AS (SELECT key, regexp_replace(raw, '^\s+|\s+$', '', 'g') AS word, count(*) AS n FROM w WHERE raw NOT IN ({_STOP}) GROUP BY ALL),
    v AS (SELECT word, log2((SELECT count(DISTINCT key) FROM c) / count(*)) AS idf FROM c GROUP BY word HAVING sum(n) >= (SELECT sum(n) FROM c) * 1e-6),
    t AS (SELECT key, word, round(n / max(n) OVER (PARTITION BY key) * idf, 9) AS tfidf FROM c JOIN v USING (word)),
    p AS (SELECT key, word AS item FROM t QUALIFY row_number() OVER (PARTITION BY key ORDER BY tfidf DESC, word) <= 200)"""


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.table(spark, sf_dir, "documents").select(F.col("source").alias("key"), "text")


def _seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.table(spark, sf_dir, "documents").select(F.col("lang").alias("user_id"), F.col("source").alias("business_id")).distinct()


@query(f"WITH {_COUNTS} SELECT key, count(*) AS n_words, round(sum(tfidf), 4) AS total, max(tfidf) AS top FROM t GROUP BY key")
def content_tfidf(spark: SparkSession, sf_dir: str) -> DataFrame:
    weighted = C.tf_idf(C.term_counts(_texts(spark, sf_dir)))
    return weighted.groupBy("key").agg(F.count("*").alias("n_words"), F.round(F.sum("tfidf"), 4).alias("total"), F.max("tfidf").alias("top"))


@query(f"WITH {_COUNTS} SELECT key, item FROM p")
def content_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.profiles(C.tf_idf(C.term_counts(_texts(spark, sf_dir))))


@query(
    f"""WITH {_COUNTS}, s AS (SELECT DISTINCT lang AS user_id, source AS business_id FROM documents),
    u AS (SELECT DISTINCT user_id, item FROM s JOIN p ON p.key = s.business_id),
    a AS (SELECT user_id, count(*) AS n FROM u GROUP BY ALL), b AS (SELECT key AS business_id, count(*) AS n FROM p GROUP BY ALL),
    m AS (SELECT user_id, key AS business_id, count(*) AS common FROM u JOIN p USING (item) GROUP BY ALL)
    SELECT user_id, business_id, round(common / (sqrt(a.n) * sqrt(b.n)), 6) AS sim
    FROM s JOIN m USING (user_id, business_id) JOIN a USING (user_id) JOIN b USING (business_id) WHERE common / (sqrt(a.n) * sqrt(b.n)) >= 0.01"""
)
def content_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    business = written(C.profiles(C.tf_idf(C.term_counts(_texts(spark, sf_dir)))), "profiles")
    seen = written(_seen(spark, sf_dir), "seen")
    got = C.predicted(C.user_profiles(seen, business), business, seen)
    return got.select("user_id", "business_id", F.round("sim", 6).alias("sim"))


_PEARSON = "round(covar_pop(x.stars, y.stars) / nullif(stddev_pop(x.stars) * stddev_pop(y.stars), 0), 9)"
_TRAIN = f"r AS MATERIALIZED (SELECT * FROM {T.TRAIN}), w AS (SELECT * FROM {T.TEST})"


def _model(key: str, over: str) -> str:
    return (
        f"m AS MATERIALIZED (SELECT id1, id2, sim FROM (SELECT x.{key} AS id1, y.{key} AS id2, count(*) AS n, {_PEARSON} AS sim "
        f"FROM r x JOIN r y ON x.{over} = y.{over} AND x.{key} < y.{key} GROUP BY ALL) WHERE n >= 3 AND sim > 0), "
        "l AS (SELECT id1 AS own, id2 AS other, sim FROM m UNION ALL SELECT id2, id1, sim FROM m)"
    )


@query(f"WITH {_TRAIN}, {_model('business_id', 'user_id')} SELECT id1, id2, round(sim, 6) AS sim FROM m")
def cf_item_sim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.item_model(T.ratings(spark, sf_dir, train=True)).select("id1", "id2", F.round("sim", 6).alias("sim"))


@query(
    f"""WITH {_TRAIN}, {_model('business_id', 'user_id')},
    k AS (SELECT w.user_id, w.business_id, r.stars AS s, l.sim FROM w JOIN r ON r.user_id = w.user_id JOIN l ON l.own = w.business_id AND l.other = r.business_id
          QUALIFY row_number() OVER (PARTITION BY w.user_id, w.business_id ORDER BY sim DESC, l.other) <= 5)
    SELECT user_id, business_id, round(sum(sim * s) / sum(sim), 6) AS stars FROM k GROUP BY ALL"""
)
def cf_item_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    train = T.ratings(spark, sf_dir, train=True)
    got = R.item_predictions(train, R.item_model(train), T.test_pairs(spark, sf_dir))
    return got.select("user_id", "business_id", F.round("stars", 6).alias("stars"))


@query(f"WITH {_TRAIN}, {_model('user_id', 'business_id')} SELECT id1, id2, round(sim, 6) AS sim FROM m")
def cf_user_sim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.user_model(T.ratings(spark, sf_dir, train=True)).select("id1", "id2", F.round("sim", 6).alias("sim"))


_NEAR = (
    "h(f, a, b, m) AS (VALUES " + ", ".join(f"({i}, {a}, {b}, {m})" for i, (a, b, m) in enumerate(LSH[:33])) + "), "
    "d AS (SELECT item, row_number() OVER (ORDER BY item) - 1 AS x FROM (SELECT DISTINCT business_id AS item FROM r)), "
    "g AS (SELECT user_id AS key, f, min((h.a * x + h.b) % h.m) AS v FROM r JOIN d ON item = business_id, h GROUP BY ALL), "
    "n AS (SELECT user_id AS key, count(*) AS n FROM r GROUP BY ALL), "
    "z AS (SELECT x.user_id AS id1, y.user_id AS id2, count(*) AS common FROM r x JOIN r y ON x.business_id = y.business_id AND x.user_id < y.user_id GROUP BY ALL), "
    "near AS MATERIALIZED (SELECT DISTINCT id1, id2 FROM z JOIN n i ON i.key = id1 JOIN n j ON j.key = id2 JOIN g p ON p.key = id1 JOIN g q ON q.key = id2 AND q.f = p.f AND q.v = p.v "
    "WHERE common >= 3 AND common / (i.n + j.n - common) >= 0.01)"
)


@query(f"WITH {_TRAIN}, {_model('user_id', 'business_id')}, {_NEAR} SELECT id1, id2, round(sim, 6) AS sim FROM m JOIN near USING (id1, id2)")
def cf_user_sim_lsh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MinHash candidates only: a subset of cf_user_sim."""
    return R.lsh_user_model(T.ratings(spark, sf_dir, train=True), LSH[:33]).select("id1", "id2", F.round("sim", 6).alias("sim"))


@query(
    f"""WITH {_TRAIN}, {_model('user_id', 'business_id')}, a AS (SELECT user_id, avg(stars) AS own FROM r GROUP BY ALL),
    k AS MATERIALIZED (SELECT w.user_id, w.business_id, l.other, r.stars AS s, l.sim FROM w JOIN r ON r.business_id = w.business_id JOIN l ON l.own = w.user_id AND l.other = r.user_id
          QUALIFY row_number() OVER (PARTITION BY w.user_id, w.business_id ORDER BY sim DESC, l.other) <= 50),
    c AS (SELECT u.user_id, u.other, avg(y.stars) AS co FROM (SELECT DISTINCT user_id, other FROM k) u JOIN r x ON x.user_id = u.user_id
          JOIN r y ON y.user_id = u.other AND y.business_id = x.business_id GROUP BY ALL)
    SELECT k.user_id, business_id, round(any_value(own) + sum((s - co) * sim) / sum(abs(sim)), 6) AS stars
    FROM k JOIN c USING (user_id, other) JOIN a ON a.user_id = k.user_id GROUP BY ALL"""
)
def cf_user_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    train = written(T.ratings(spark, sf_dir, train=True), "ratings")
    wanted = written(T.test_pairs(spark, sf_dir), "wanted")
    got = R.nearest_user_predictions(train, wanted)
    return got.select("user_id", "business_id", F.round("stars", 6).alias("stars"))


@query(
    f"""WITH {_TRAIN}, {_model('user_id', 'business_id')}, {_NEAR}, l2 AS (SELECT own, other, sim FROM l JOIN near ON id1 = least(own, other) AND id2 = greatest(own, other)),
    a AS (SELECT user_id, avg(stars) AS own FROM r GROUP BY ALL),
    k AS MATERIALIZED (SELECT w.user_id, w.business_id, l2.other, r.stars AS s, l2.sim FROM w JOIN r ON r.business_id = w.business_id JOIN l2 ON l2.own = w.user_id AND l2.other = r.user_id
          QUALIFY row_number() OVER (PARTITION BY w.user_id, w.business_id ORDER BY sim DESC, l2.other) <= 50),
    c AS (SELECT u.user_id, u.other, avg(y.stars) AS co FROM (SELECT DISTINCT user_id, other FROM k) u JOIN r x ON x.user_id = u.user_id
          JOIN r y ON y.user_id = u.other AND y.business_id = x.business_id GROUP BY ALL)
    SELECT k.user_id, business_id, round(any_value(own) + sum((s - co) * sim) / sum(abs(sim)), 6) AS stars
    FROM k JOIN c USING (user_id, other) JOIN a ON a.user_id = k.user_id GROUP BY ALL"""
)
def cf_user_predict_lsh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The MinHash model through to predictions."""
    train = written(T.ratings(spark, sf_dir, train=True), "ratings")
    got = R.nearest_user_predictions(train, T.test_pairs(spark, sf_dir), constants=LSH[:33])
    return got.select("user_id", "business_id", F.round("stars", 6).alias("stars"))
