"""Content-based recommendation: entities by their texts' most telling words."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions.text import STOP_WORDS, cleaned_words, stripped
from brindle.operators.similarity import cosine_pairs
from brindle.sources.shared import written

#: Share of all tokens that a word must make up to be in the vocabulary.
RARE = 1e-6


def term_counts(texts: DataFrame, stop_words: tuple[str, ...] = STOP_WORDS) -> DataFrame:
    """(key, word, n) from (key, text). Each distinct text of a key counts once."""
    words = texts.distinct().select("key", F.explode(cleaned_words(F.col("text"))).alias("raw")).where(~F.col("raw").isin(*stop_words))
    return words.groupBy("key", stripped(F.col("raw")).alias("word")).agg(F.count("*").alias("n"))


def tf_idf(counts: DataFrame, rare: float = RARE) -> DataFrame:
    """(key, word, tfidf): counts over the key's largest count, times log2 of keys over keys with the
    word. Words rarer than `rare` of all tokens are left out."""
    counts = written(counts, "counts")
    total = counts.agg(F.sum("n").alias("tokens"), F.count_distinct("key").alias("keys"))
    per_word = counts.groupBy("word").agg(F.sum("n").alias("all"), F.count("*").alias("df"))
    kept = per_word.join(F.broadcast(total), F.col("all") >= F.col("tokens") * F.lit(rare)).select("word", F.log2(F.col("keys") / F.col("df")).alias("idf"))
    # few words beside the counts of them by key
    known = counts.join(kept, "word")
    top = known.groupBy("key").agg(F.max("n").alias("top"))
    return known.join(top, "key").select("key", "word", F.round(F.col("n") / F.col("top") * F.col("idf"), 9).alias("tfidf"))


def profiles(weighted: DataFrame, n: int = 200) -> DataFrame:
    """(key, item): each key's n words of the largest weight; ties by word."""
    place = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("tfidf"), "word"))
    return weighted.withColumn("place", place).where(F.col("place") <= n).select("key", F.col("word").alias("item"))


def user_profiles(seen: DataFrame, business: DataFrame) -> DataFrame:
    """(key, item): all words of the businesses that a user (user_id, business_id) has seen."""
    return seen.distinct().join(business.withColumnRenamed("key", "business_id"), "business_id").select(F.col("user_id").alias("key"), "item").distinct()


def predicted(user: DataFrame, business: DataFrame, wanted: DataFrame, least: float = 0.01) -> DataFrame:
    """(user_id, business_id, sim) with binary cosine >= least."""
    pairs = wanted.select(F.col("user_id").alias("a"), F.col("business_id").alias("b")).distinct()
    got = cosine_pairs(user, business, pairs).where(F.col("sim") >= least)
    return got.select(F.col("a").alias("user_id"), F.col("b").alias("business_id"), "sim")
