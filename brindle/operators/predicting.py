"""Rating prediction: factors, boosted trees over features, and their blend."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import Imputer, MinMaxScaler, VectorAssembler
from pyspark.ml.recommendation import ALS, ALSModel
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.functions.numeric import clamped, hours_class, years_since


def averages(ratings: DataFrame, key: str, name: str) -> DataFrame:
    return ratings.groupBy(key).agg(F.avg("stars").alias(name))


def als_model(ratings: DataFrame, rounds: int = 20, regularisation: float = 0.4, seed: int = 2) -> ALSModel:
    """Over integer user_id and business_id. Unseen ids predict NaN."""
    als = ALS(userCol="user_id", itemCol="business_id", ratingCol="stars", maxIter=rounds, regParam=regularisation, coldStartStrategy="nan", seed=seed)
    return als.fit(ratings)


def filled(prediction: Column, average: Column) -> Column:
    """The average for NaN and null, then within 1 to 5."""
    return clamped(F.coalesce(F.nanvl(prediction, F.lit(None).cast("double")), average), 1.0, 5.0)


def als_predictions(model: ALSModel, wanted: DataFrame, ratings: DataFrame) -> DataFrame:
    """(user_id, business_id, als)."""
    mean = ratings.agg(F.avg("stars").alias("mean"))
    got = model.transform(wanted.select("user_id", "business_id").distinct())
    one = F.lit(1)
    return got.withColumn("_", one).join(F.broadcast(mean.withColumn("_", one)), "_").select("user_id", "business_id", filled(F.col("prediction").cast("double"), F.col("mean")).alias("als"))


def user_features(users: DataFrame, user_average: DataFrame, year: int = 2020) -> DataFrame:
    """Friends and elite years by number of entries, account age, activity, average rating."""
    entries = lambda c: F.when(F.trim(F.coalesce(c, F.lit(""))) == "", 0).otherwise(F.size(F.split(c, ",")))
    return users.join(user_average, "user_id", "left").withColumns(
        {"friends": entries(F.col("friends")), "elite": entries(F.col("elite")), "yelping_since": years_since(F.col("yelping_since"), year)}
    )


def business_features(businesses: DataFrame, business_average: DataFrame) -> DataFrame:
    """Categories as a list (empty for null), the class of opening days, average rating."""
    categories = F.when(F.col("categories").isNull(), F.array().cast("array<string>")).otherwise(F.split("categories", ", "))
    return businesses.join(business_average, "business_id", "left").withColumns({"categories": categories, "hrs": hours_class(F.col("hours"))})


def tree_pipeline(features: list[str], trees: int = 250, depth: int = 5, rate: float = 0.1, least: int = 15, seed: int = 2) -> Pipeline:
    """Missing values become medians, all is scaled to 0..1, boosted trees regress the stars."""
    known = [f"{f}_known" for f in features]
    return Pipeline(
        stages=[
            Imputer(inputCols=features, outputCols=known, strategy="median"),
            VectorAssembler(inputCols=known, outputCol="raw"),
            MinMaxScaler(inputCol="raw", outputCol="features"),
            GBTRegressor(featuresCol="features", labelCol="stars", predictionCol="trees", maxIter=trees, maxDepth=depth, stepSize=rate, minInstancesPerNode=least, seed=seed),
        ]
    )


def tree_predictions(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """(user_id, business_id, trees), within 1 to 5."""
    return model.transform(rows).select("user_id", "business_id", clamped(F.col("trees"), 1.0, 5.0).alias("trees"))


def blend(als: DataFrame, trees: DataFrame, share: float = 0.1) -> DataFrame:
    """(user_id, business_id, stars): so much of ALS, the rest of the trees."""
    stars = F.lit(share) * F.col("als") + F.lit(1 - share) * F.col("trees")
    return als.join(trees, ["user_id", "business_id"]).select("user_id", "business_id", stars.alias("stars"))


def rmse(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: root mean square error over the pairs that both have."""
    both = predicted.withColumnRenamed("stars", "p").join(truth, ["user_id", "business_id"])
    return both.agg(F.sqrt(F.avg(F.pow(F.col("p") - F.col("stars"), 2))).alias("rmse"), F.count("*").alias("n"))
