"""Collaborative filtering over (user_id, business_id, stars), one row per pair.

Ratings are rounded by the caller where results are compared between engines. Models are tables
(id1, id2, sim), id1 < id2; prediction joins them, nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.operators import blocks
from brindle.operators.similarity import affine_table, lsh_pairs
from brindle.sources.shared import written


def _pearson() -> Column:
    """Null where a side does not vary."""
    return F.round(F.covar_pop("x", "y") / F.nullif(F.stddev_pop("x") * F.stddev_pop("y"), F.lit(0.0)), 9)


def _in_blocks(ratings: DataFrame) -> DataFrame | None:
    """(key, item, stars) of users and businesses where few businesses make products cheaper than the join by business."""
    rated = ratings.where("user_id is not null and business_id is not null").select(F.col("user_id").alias("key"), F.col("business_id").alias("item"), F.col("stars").cast("double").alias("stars"))
    rated = written(rated, "rated")
    return rated if blocks.few_items(rated) and not rated.where("stars is null").limit(1).count() else None


def _co_rated(ratings: DataFrame, key: str, over: str) -> DataFrame:
    """(id1, id2, x, y) of two keys' ratings over the same thing."""
    a = ratings.select(over, F.col(key).alias("id1"), F.col("stars").alias("x"))
    b = ratings.select(over, F.col(key).alias("id2"), F.col("stars").alias("y"))
    return a.join(b, over).where("id1 < id2").select("id1", "id2", "x", "y")


def _similar(co: DataFrame, least: int) -> DataFrame:
    return (
        co.groupBy("id1", "id2").agg(F.count("*").alias("n"), _pearson().alias("sim"))
        .where((F.col("n") >= least) & (F.col("sim") > 0)).select("id1", "id2", "sim")
    )


def item_model(ratings: DataFrame, least: int = 3) -> DataFrame:
    """Pairs of businesses with at least `least` common raters and positive Pearson correlation."""
    return _similar(_co_rated(ratings, "business_id", "user_id"), least)


def user_model(ratings: DataFrame, least: int = 3, near: DataFrame | None = None, of: DataFrame | None = None) -> DataFrame:
    """Pairs of users with at least `least` co-rated businesses and positive Pearson correlation;
    `near` (a, b) restricts them to candidates, `of` (user_id) to pairs with one of these users. Users
    with fewer ratings can't have any."""
    if near is None and of is None and (few := _in_blocks(ratings)) is not None:
        return _block_model(few, blocks.rating_measure(least))
    active = ratings.groupBy("user_id").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("user_id")
    rated = ratings.join(active, "user_id", "left_semi")
    if near is None and of is not None:
        some = rated.join(of.distinct().withColumn("asked", F.lit(True)), "user_id", "left").withColumn("asked", F.coalesce("asked", F.lit(False)))
        some = written(some, "rated")
        x = some.select("business_id", F.col("user_id").alias("id1"), F.col("stars").alias("x"), F.col("asked").alias("p"))
        y = some.select("business_id", F.col("user_id").alias("id2"), F.col("stars").alias("y"), F.col("asked").alias("q"))
        return _similar(x.join(y, "business_id").where("id1 < id2 and (p or q)").select("id1", "id2", "x", "y"), least)
    if near is None:
        return _similar(_co_rated(rated, "user_id", "business_id"), least)
    x = rated.select(F.col("user_id").alias("id1"), "business_id", F.col("stars").alias("x"))
    y = rated.select(F.col("user_id").alias("id2"), "business_id", F.col("stars").alias("y"))
    return _similar(near.select(F.col("a").alias("id1"), F.col("b").alias("id2")).join(x, "id1").join(y, ["id2", "business_id"]), least)


def _block_model(rated: DataFrame, measure: blocks.Measure, constants: tuple | None = None) -> DataFrame:
    found = blocks.classes(rated, "stars")
    near = blocks.class_pairs(found, measure, affine_table(found.index, constants) if constants else None)
    return blocks.expanded(near, found.members).select(F.col("a").alias("id1"), F.col("b").alias("id2"), "sim")


def lsh_user_model(ratings: DataFrame, constants: tuple, least_jaccard: float = 0.01, least: int = 3) -> DataFrame:
    """The same over MinHash candidates with enough Jaccard similarity."""
    if (few := _in_blocks(ratings)) is not None:
        return _block_model(few, blocks.rating_measure(least, least_jaccard), constants)
    sets = ratings.select(F.col("user_id").alias("key"), F.col("business_id").alias("item")).distinct()
    return user_model(ratings, least, lsh_pairs(sets, least_jaccard, 1, constants, shared=least))


def _both_ways(model: DataFrame) -> DataFrame:
    return model.select(F.col("id1").alias("own"), F.col("id2").alias("other"), "sim").union(model.select("id2", "id1", "sim"))


def item_predictions(ratings: DataFrame, model: DataFrame, wanted: DataFrame, n: int = 5) -> DataFrame:
    """(user_id, business_id, stars): the average of the user's ratings of the n most similar
    businesses, weighted by similarity (0 where the model has none); no row without any weight."""
    known = wanted.distinct().join(ratings.select("user_id", F.col("business_id").alias("other"), F.col("stars").alias("r")), "user_id")
    weighted = known.join(_both_ways(model).withColumnRenamed("own", "business_id"), ["business_id", "other"])
    # pairs without a weight add nothing to either sum, so they need not be ranked
    place = F.row_number().over(Window.partitionBy("user_id", "business_id").orderBy(F.desc("sim"), "other"))
    top = weighted.withColumn("place", place).where(F.col("place") <= n)
    return top.groupBy("user_id", "business_id").agg((F.sum(F.col("sim") * F.col("r")) / F.sum("sim")).alias("stars"))


def user_predictions(ratings: DataFrame, model: DataFrame, wanted: DataFrame, n: int = 50) -> DataFrame:
    """(user_id, business_id, stars): the user's average plus the weighted mean deviation of the n most
    similar users' ratings of the business from their averages over what they co-rated with the user.
    Unknown users, and pairs without any weight, give no row."""
    average = ratings.groupBy("user_id").agg(F.avg("stars").alias("own_avg"))
    linked = _both_ways(written(model, "model"))
    rated = ratings.select("business_id", F.col("user_id").alias("other"), F.col("stars").alias("r"))
    asked = wanted.distinct().join(rated, "business_id").join(linked.withColumnRenamed("own", "user_id"), ["user_id", "other"])
    place = F.row_number().over(Window.partitionBy("user_id", "business_id").orderBy(F.desc("sim"), "other"))
    top = written(asked.withColumn("place", place).where(F.col("place") <= n).drop("place"), "top")
    # averages over co-rated businesses only for the pairs of users that are in use
    used = top.select("user_id", "other").distinct()
    mine = ratings.select("user_id", F.col("business_id").alias("both"))
    theirs = ratings.select(F.col("user_id").alias("other"), F.col("business_id").alias("both"), F.col("stars").alias("s"))
    co = used.join(mine, "user_id").join(theirs, ["other", "both"]).groupBy("user_id", "other").agg(F.avg("s").alias("co_avg"))
    moved = top.join(co, ["user_id", "other"]).groupBy("user_id", "business_id").agg(
        (F.sum((F.col("r") - F.col("co_avg")) * F.col("sim")) / F.nullif(F.sum(F.abs("sim")), F.lit(0.0))).alias("shift")
    )
    return moved.where("shift is not null").join(average, "user_id").select("user_id", "business_id", (F.col("own_avg") + F.col("shift")).alias("stars"))


def nearest_user_predictions(ratings: DataFrame, wanted: DataFrame, least: int = 3, n: int = 50, constants: tuple | None = None, least_jaccard: float = 0.01) -> DataFrame:
    """`user_predictions` by `user_model`, or by `lsh_user_model` with its constants, without the model as a table
    where few businesses make nearly all users pairs: each user meets all others, and keeps n of them."""
    few = _in_blocks(ratings)
    if few is None:
        model = lsh_user_model(ratings, constants, least_jaccard, least) if constants else user_model(ratings, least, of=wanted.select("user_id"))
        return user_predictions(ratings, model, wanted, n)
    asked = wanted.select(F.col("user_id").alias("key"), F.col("business_id").alias("item"))
    lsh = {"jaccard": least_jaccard, "hashes": lambda index: affine_table(index, constants)} if constants else {}
    got = blocks.user_predictions(few, asked, least, n, **lsh)
    return got.select(F.col("key").alias("user_id"), F.col("item").alias("business_id"), "stars")
