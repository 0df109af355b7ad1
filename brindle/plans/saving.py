"""What is saved and read back: lists, dictionaries, chunks, models, streams; and small cases with known
answers for operators whose results SQL can't compute."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.feature import Imputer, MinMaxScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.operators import clustering as C
from brindle.operators import graphs as G
from brindle.operators import predicting as P
from brindle.operators import recommending as R
from brindle.plans.recommending import _TRAIN, _model
from brindle.plans.registry import query
from brindle.sources import readers, sinks
from brindle.sources import tables as T
from brindle.sources.schemas import EVENT
from brindle.sources.shared import shared_path
from brindle.streaming import stateful, windows


@query("SELECT r_name AS word FROM region UNION SELECT '' UNION SELECT ' '")
def word_list_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "words")
    T.table(spark, sf_dir, "region").select("r_name").write.text(path)
    return readers.word_list(spark, path)


@query("SELECT n_name AS name, n_regionkey::DOUBLE AS region FROM nation")
def dictionary_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One JSON object in one file, an entry per nation."""
    path = shared_path(spark, "dictionary")
    entries = F.map_from_entries(F.collect_list(F.struct("n_name", F.col("n_regionkey").cast("double"))))
    T.table(spark, sf_dir, "nation").agg(F.to_json(entries).alias("value")).write.text(path)
    return readers.dictionary(spark, path, "name", "region")


@query("SELECT * FROM (VALUES ('C1', 4.0), ('C3', 0.5), ('C8', 3.0)) AS v(name, value)")
def in_memory_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.collection(spark, [("C1", 4.0), ("C3", 0.5), ("C8", 3.0)], "name string, value double")


@query(f"SELECT (id % 4)::INT AS chunk, count(*) AS n, round(sum(features[2]), 6) AS total FROM {T.POINTS} GROUP BY ALL")
def chunk_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points in four text files, found by listing the folder, in path order."""
    folder = shared_path(spark, "chunks")
    text = F.concat_ws(",", F.col("id").cast("string"), F.col("features").cast("array<string>")).alias("value")
    for k in range(4):
        sinks.text_file(T.points(spark, sf_dir).where(F.col("id") % 4 == k).select(text), f"{folder}/{k}.txt")
    parts = [p.withColumn("chunk", F.lit(k)) for k, (_, p) in enumerate(readers.point_chunks(spark, folder))]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.groupBy("chunk").agg(F.count("*").alias("n"), F.round(F.sum(F.col("features")[1]), 6).alias("total"))


def _one_text(spark: SparkSession, path: str, join: str) -> DataFrame:
    """The lines of a result in order; small ones only."""
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("at"), "value")
    return lines.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "value"))), lambda x: x.value), join).alias("text"))


@query("SELECT string_agg('''' || r_name || ''', ' || r_regionkey, ';' ORDER BY r_regionkey) AS text FROM region")
def tuple_lines_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "tuples")
    sinks.tuple_lines(T.table(spark, sf_dir, "region").orderBy("r_regionkey").select("r_name", "r_regionkey"), path)
    return _one_text(spark, path, ";")


@query("SELECT string_agg(CASE WHEN n_regionkey = 1 THEN 'T ' ELSE 'F ' END, '' ORDER BY n_nationkey) AS text FROM nation")
def flags_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "flags")
    sinks.flags_line(T.table(spark, sf_dir, "nation").select("n_nationkey", (F.col("n_regionkey") == 1).alias("flag")), "n_nationkey", "flag", path)
    return _one_text(spark, path, "").select("text")


@query(
    """WITH s AS (SELECT 1 AS k, string_agg('(''' || n_name || ''')', ',' ORDER BY n_name) AS t FROM nation
    UNION ALL SELECT 2, string_agg('(''' || r_name || ''', ''' || n_name || ''')', ',' ORDER BY r_name, n_name) FROM nation JOIN region ON r_regionkey = n_regionkey)
    SELECT 'Frequent:' || chr(10) || string_agg(t, chr(10) ORDER BY k) AS text FROM s"""
)
def itemset_text_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of nations, and with their regions, as sets of one and two."""
    path = shared_path(spark, "itemsets")
    n, r = T.table(spark, sf_dir, "nation"), T.table(spark, sf_dir, "region")
    two = n.join(r, n.n_regionkey == r.r_regionkey).select(F.array("r_name", "n_name").alias("itemset"))
    sinks.itemset_text(n.select(F.array("n_name").alias("itemset")).unionByName(two).withColumn("phase", F.lit("Frequent")), path)
    return _one_text(spark, path, "\n")


@query(
    f"""WITH {_TRAIN}, {_model('business_id', 'user_id')},
    k AS (SELECT w.user_id, w.business_id, r.stars AS s, l.sim FROM w JOIN r ON r.user_id = w.user_id JOIN l ON l.own = w.business_id AND l.other = r.business_id
          QUALIFY row_number() OVER (PARTITION BY w.user_id, w.business_id ORDER BY sim DESC, l.other) <= 5)
    SELECT user_id, business_id, round(sum(sim * s) / sum(sim), 6) AS stars FROM k GROUP BY ALL"""
)
def cf_item_saved_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The model is trained, saved as JSON lines, loaded, and predicts."""
    path = shared_path(spark, "model")
    train = T.ratings(spark, sf_dir, train=True)
    model = R.item_model(train)
    sinks.json_lines(model.select(F.col("id1").cast("string").alias("b1"), F.col("id2").cast("string").alias("b2"), "sim"), path)
    loaded = readers.pair_model(spark, path, ("b1", "b2")).select(F.col("id1").cast("long").alias("id1"), F.col("id2").cast("long").alias("id2"), "sim")
    got = R.item_predictions(train, loaded, T.test_pairs(spark, sf_dir))
    return got.select("user_id", "business_id", F.round("stars", 6).alias("stars"))


@query(f"SELECT count(DISTINCT user_id) AS users, count(DISTINCT business_id) AS businesses, 10 AS rank FROM {T.TRAIN}")
def factors_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Factors of every user and business of the training ratings, after saving and loading."""
    path = shared_path(spark, "factors")
    sinks.model(P.als_model(T.ratings(spark, sf_dir, train=True), rounds=2), path)
    loaded = readers.factors(path)
    users, businesses = loaded.userFactors.agg(F.count("*").alias("users")), loaded.itemFactors.agg(F.count("*").alias("businesses"))
    one = F.lit(1)
    return users.withColumn("_", one).join(businesses.withColumn("_", one), "_").select("users", "businesses", F.lit(loaded.rank).alias("rank"))


@query(
    """WITH p AS (SELECT p_partkey, CASE WHEN p_partkey % 7 <> 0 THEN p_size::DOUBLE END AS x FROM part), m AS (SELECT quantile_disc(x, 0.5) AS mid, min(x) AS low, max(x) AS high FROM p)
    SELECT p_partkey, round((coalesce(x, mid) - low) / (high - low), 6) AS scaled FROM p, m"""
)
def scaler_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Medians for missing values and scaling to 0..1, fitted, saved, loaded, applied."""
    path = shared_path(spark, "scaler")
    rows = T.table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_partkey") % 7 != 0, F.col("p_size").cast("double")).alias("x"))
    stages = [Imputer(inputCols=["x"], outputCols=["known"], strategy="median", relativeError=0.0), VectorAssembler(inputCols=["known"], outputCol="raw"), MinMaxScaler(inputCol="raw", outputCol="v")]
    sinks.model(Pipeline(stages=stages).fit(rows), path)
    return readers.fitted(path).transform(rows).select("p_partkey", F.round(vector_to_array("v")[0], 6).alias("scaled"))


@query(
    f"""WITH r AS (SELECT * FROM {T.TRAIN}), w AS (SELECT * FROM {T.TEST}), u AS (SELECT user_id, avg(stars) AS a FROM r GROUP BY ALL), b AS (SELECT business_id, avg(stars) AS a FROM r GROUP BY ALL),
    m AS (SELECT avg(stars) AS a FROM r)
    SELECT user_id, business_id, round(0.1 * least(greatest(coalesce(u.a, m.a), 1), 5) + 0.9 * least(greatest(coalesce(b.a, m.a), 1), 5), 6) AS stars
    FROM w LEFT JOIN u USING (user_id) LEFT JOIN b USING (business_id), m"""
)
def blend_averages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The blend of two predictions that SQL can make: averages of users and of businesses, NaN where
    unknown, filled with the overall average."""
    train, wanted = T.ratings(spark, sf_dir, train=True), T.test_pairs(spark, sf_dir)
    mean = train.agg(F.avg("stars").alias("mean")).withColumn("_", F.lit(1))
    rows = wanted.join(P.averages(train, "user_id", "u"), "user_id", "left").join(P.averages(train, "business_id", "b"), "business_id", "left").withColumn("_", F.lit(1)).join(F.broadcast(mean), "_")
    known = lambda c: P.filled(F.coalesce(c, F.lit(float("nan"))), F.col("mean"))
    got = P.blend(rows.select("user_id", "business_id", known("u").alias("als")), rows.select("user_id", "business_id", known("b").alias("trees")))
    return got.select("user_id", "business_id", F.round("stars", 6).alias("stars"))


@query("SELECT event_type AS tag, count(*) AS n FROM events WHERE event_id % 3 <> 0 GROUP BY ALL")
def pushed_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statuses of all events in a receiver's buffer, one in three in another language."""
    buffer, out = shared_path(spark, "buffer"), shared_path(spark, "tags")
    tags = F.array(F.struct(F.col("event_type").alias("text")))
    status = T.table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.when(F.col("event_id") % 3 == 0, "de").otherwise("en").alias("lang"), F.struct(tags.alias("hashtags")).alias("entities"))
    sinks.json_lines(status, buffer)
    sinks.stream_to_table(readers.pushed_tags(spark, buffer), out).awaitTermination()
    return spark.read.schema("id long, place int, tag string").parquet(out).groupBy("tag").agg(F.count("*").alias("n"))


@query("SELECT strftime(time_bucket(INTERVAL 1 DAY, ts), '%Y-%m-%d %H:%M:%S') AS time, count(*)::VARCHAR AS n FROM events GROUP BY ALL")
def appended_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each window's time as text and its count, appended as CSV micro-batch by micro-batch."""
    events, path = windows.timed(readers.file_stream(spark, sf_dir, EVENT, "events.parquet")), shared_path(spark, "appended")
    counted = windows.shown(windows.tumbling(events, "1 day")).select(F.col("window_start").alias("time"), "n")
    stateful.run_for(sinks.stream_to_csv(counted, path), 600)
    return spark.read.schema("time string, n string").option("header", True).csv(path).select("time", "n")


_BLOBS = [(i, [10.0 * (i % 3) + (i % 7) * 0.01, 5.0 * (i % 3) + (i % 5) * 0.01]) for i in range(90)]


def _least(found: DataFrame) -> DataFrame:
    """Clusters by their least id."""
    names = found.groupBy("cluster").agg(F.min("id").alias("least"))
    return found.join(names, "cluster").select("id", F.col("least").alias("cluster"))


@query("SELECT i AS id, i % 3 AS cluster FROM range(90) t(i)")
def kmeans_known(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three blobs far apart."""
    return _least(C.kmeans(readers.collection(spark, _BLOBS, "id long, features array<double>"), 3))


@query("SELECT i AS id, i % 3 AS cluster FROM range(90) t(i)")
def bfr_known(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = readers.collection(spark, _BLOBS, "id long, features array<double>")
    bfr = C.Bfr(3, small=2)
    for part in range(2):
        bfr.add(points.where(F.floor(F.col("id") / 3) % 2 == part))
    return _least(bfr.finish(points))


@query("SELECT round(sum(d), 4) AS cost FROM (SELECT min(list_distance(p.features, c.features)) AS d FROM " + T.POINTS + " p, (SELECT * FROM " + T.POINTS + " WHERE id < 5) c GROUP BY p.id)")
def kmeans_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sum of the distances to the nearest of five given centres."""
    points = T.points(spark, sf_dir)
    centres = {r.id: list(r.features) for r in points.where("id < 5").collect()}
    return C.assigned(points, centres).agg(F.round(F.sum("distance"), 4).alias("cost"))


@query("SELECT * FROM (VALUES ('a', 'a'), ('b', 'a'), ('c', 'a'), ('d', 'd'), ('e', 'd'), ('f', 'd'), ('x', 'x'), ('y', 'x')) AS v(node, label)")
def gn_known(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two triangles joined by an edge, which is the first to go, and an edge apart."""
    edges = [("a", "b"), ("b", "c"), ("a", "c"), ("d", "e"), ("e", "f"), ("d", "f"), ("c", "d"), ("x", "y")]
    return G.girvan_newman(readers.collection(spark, edges, "src string, dst string"))
