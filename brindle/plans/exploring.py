"""Exploration queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.functions.text import STOP_WORDS
from brindle.operators import exploring as X
from brindle.plans.registry import query
from brindle.sources import tables as T

_WORDS = "(SELECT unnest(string_split(trim(translate(lower(text), '([,.!?:;])', '')), ' ')) AS word FROM documents)"
_STOP = ", ".join(f"'{w}'" for w in ("", " ", *STOP_WORDS))
_CATEGORIES = f"(SELECT business_id, trim(unnest(string_split(categories, ','))) AS category FROM {T.BUSINESSES})"


@query(f"SELECT count(*) AS n_reviews, count(*) FILTER (WHERE year(date) = 1998) AS n_year, count(DISTINCT business_id) AS n_businesses FROM {T.REVIEWS}")
def explore_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.summary(T.reviews(spark, sf_dir), 1998)


@query(f"SELECT count(*) AS n FROM {T.REVIEWS}")
def explore_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.reviews(spark, sf_dir).agg(F.count("*").alias("n"))


@query(f"SELECT count(*) AS n FROM {T.REVIEWS} WHERE year(date) = 1998")
def explore_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.in_year(T.reviews(spark, sf_dir), 1998).agg(F.count("*").alias("n"))


@query(f"SELECT count(DISTINCT business_id) AS n FROM {T.REVIEWS}")
def explore_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.reviews(spark, sf_dir).agg(F.count_distinct("business_id").alias("n"))


@query(f"SELECT user_id, count(*) AS n FROM {T.REVIEWS} GROUP BY user_id ORDER BY n DESC, user_id LIMIT 20")
def top_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.top_counts(T.reviews(spark, sf_dir), "user_id", 20)


@query(rf"SELECT word, count(*) AS n FROM {_WORDS} WHERE regexp_replace(word, '^\s+|\s+$', '', 'g') NOT IN ({_STOP}) GROUP BY word ORDER BY n DESC, word LIMIT 50")
def top_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.top_counts(X.words(T.table(spark, sf_dir, "documents"), "text", STOP_WORDS), "word", 50)


@query(f"SELECT category, avg(stars) AS avg_stars FROM {T.REVIEWS} JOIN {_CATEGORIES} USING (business_id) GROUP BY category ORDER BY avg_stars DESC, category LIMIT 50")
def category_avg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.category_average(T.reviews(spark, sf_dir), T.businesses(spark, sf_dir), 50)


@query(f"SELECT category, avg(stars) AS avg_stars FROM {T.REVIEWS} JOIN {_CATEGORIES} USING (business_id) GROUP BY category ORDER BY avg_stars DESC, category LIMIT 10")
def category_avg_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    doubled = T.businesses(spark, sf_dir)
    return X.category_average(T.reviews(spark, sf_dir), doubled.union(doubled), 10, once=True)


@query(f"SELECT business_id, count(*) AS n FROM {T.REVIEWS} GROUP BY business_id HAVING count(*) > 30")
def partition_counts_over_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.counts_over(T.reviews(spark, sf_dir), "business_id", 30)


@query()
def partition_sizes_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.partition_sizes(T.table(spark, sf_dir, "lineitem"))


@query(f"SELECT 27 AS n_partitions, count(*) AS n_items FROM {T.REVIEWS}")
def partition_sizes_hashed(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = X.partition_sizes(T.reviews(spark, sf_dir).select("business_id"), 27, "business_id")
    return sizes.agg(F.lit(27).alias("n_partitions"), F.sum("n_items").alias("n_items"))


@query(f"SELECT user_id, state FROM (SELECT user_id, supplier_id AS business_id FROM {T.REVIEWS}) JOIN {T.SUPPLIERS} USING (business_id) WHERE stars >= 4")
def user_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.user_states(T.reviews(spark, sf_dir, "l_suppkey"), T.suppliers(spark, sf_dir))
