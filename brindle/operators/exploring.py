"""Counts, rankings and averages over reviews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.functions.text import categories, plain_words, stripped


def summary(reviews: DataFrame, year: int) -> DataFrame:
    """One row: reviews, those of a year, distinct businesses. One pass, map-side combined."""
    return reviews.agg(
        F.count("*").alias("n_reviews"),
        F.count_if(F.year("date") == year).alias("n_year"),
        F.count_distinct("business_id").alias("n_businesses"),
    )


def in_year(reviews: DataFrame, year: int) -> DataFrame:
    return reviews.where(F.year(F.to_timestamp("date")) == year)


def top_counts(df: DataFrame, key: str, n: int) -> DataFrame:
    """The n most frequent keys; ties by key."""
    return df.groupBy(key).agg(F.count("*").alias("n")).orderBy(F.desc("n"), key).limit(n)


def words(texts: DataFrame, text: str, stop_words: tuple[str, ...] | DataFrame) -> DataFrame:
    """The words of all texts but stop words. The test strips white space off a word; the word itself
    keeps it. A DataFrame of stop words is joined, a tuple becomes a predicate."""
    found = texts.select(F.explode(plain_words(F.col(text))).alias("word"))
    if isinstance(stop_words, tuple):
        return found.where(~stripped(F.col("word")).isin("", " ", *stop_words))
    stop = stop_words.select(F.col("word").alias("stop"))
    return found.join(stop, stripped(F.col("word")) == F.col("stop"), "left_anti").where(stripped(F.col("word")) != "")


def category_average(reviews: DataFrame, businesses: DataFrame, n: int, once: bool = False) -> DataFrame:
    """The n best categories by average stars, then name. Businesses without categories drop out
    before the join; `once` keeps one row per business id (the least categories)."""
    known = businesses.where(F.col("categories").isNotNull()).select("business_id", "categories")
    if once:
        known = known.groupBy("business_id").agg(F.min("categories").alias("categories"))
    per = reviews.groupBy("business_id").agg(F.sum("stars").alias("stars"), F.count("stars").alias("n"))
    # stars are summed per business before the join and per category after it: rows shrink early
    joined = per.join(known, "business_id").select(F.explode(categories(F.col("categories"))).alias("category"), "stars", "n")
    found = joined.groupBy("category").agg((F.sum("stars") / F.sum("n")).alias("avg_stars"))
    return found.orderBy(F.desc("avg_stars"), "category").limit(n)


def partition_sizes(df: DataFrame, n: int | None = None, key: str | None = None) -> DataFrame:
    """Rows in each partition, as they are or after hashing `key` into n."""
    spread = df.repartition(n, key) if n and key else df
    return spread.groupBy(F.spark_partition_id().alias("partition")).agg(F.count("*").alias("n_items"))


def counts_over(df: DataFrame, key: str, n: int) -> DataFrame:
    """Keys with more than n rows."""
    return df.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > n)


def user_states(reviews: DataFrame, businesses: DataFrame, least: float = 4.0) -> DataFrame:
    """user_id and state of each review of a business with enough stars."""
    good = businesses.where(F.col("stars") >= least).select("business_id", "state")
    return reviews.select("user_id", "business_id").join(good, "business_id").select("user_id", "state")


def rounded(x: Column, digits: int = 6) -> Column:
    return F.round(x, digits)
