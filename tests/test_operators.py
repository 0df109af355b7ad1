"""Small cases with known answers, and invariants."""

from __future__ import annotations

import math
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from brindle.functions import numeric as N
from brindle.functions import text as X
from brindle.operators import clustering, content, exploring, graphs, itemsets, predicting, recommending, similarity, sketches
from brindle.operators.ordering import dense_index
from brindle.plans import baskets
from brindle.plans.registry import QUERIES
from brindle.sources import readers, sinks
from brindle.streaming import stateful

BASKETS = [("1", "a"), ("1", "b"), ("1", "c"), ("2", "a"), ("2", "b"), ("3", "a"), ("3", "c"), ("4", "b")]
TRIANGLES = [("a", "b"), ("b", "c"), ("a", "c"), ("d", "e"), ("e", "f"), ("d", "f"), ("c", "d")]


def test_category_average(spark):
    reviews = spark.createDataFrame([("x", 5.0), ("x", 3.0), ("y", 4.0)], "business_id string, stars double")
    known = spark.createDataFrame([("x", "A, B"), ("y", "A"), ("z", None)], "business_id string, categories string")
    assert [tuple(r) for r in exploring.category_average(reviews, known, 5).collect()] == [("A", 4.0), ("B", 4.0)]


@pytest.mark.parametrize("method", ["levels", "growth"])
def test_itemsets(spark, method):
    pairs = itemsets.baskets(spark.createDataFrame(BASKETS + BASKETS[:1], "key string, item string"))
    found = itemsets.frequent(pairs, 2, 4) if method == "levels" else itemsets.fp_growth(pairs, 2)
    assert {("".join(r.itemset), r.n) for r in found.collect()} == {("a", 3), ("b", 3), ("c", 2), ("ab", 2), ("ac", 2)}


def test_itemsets_of_all_sizes(spark, monkeypatch):
    """Six users share five items: every set of them, up to all six, is frequent."""
    rows = [(user, item) for user in range(6) for item in range(5)] + [(7, 0), (8, 1)]
    monkeypatch.setattr(baskets.T, "purchases", lambda *_: spark.createDataFrame(rows, "key long, item long"))
    got = {(r.size, r.itemset, r.n) for r in QUERIES["itemsets_swapped_all"](spark, "").collect()}
    assert got == {(k, ",".join(map(str, c)), 5) for k in range(1, 7) for c in combinations(range(6), k)}
    monkeypatch.setattr(baskets.T, "baskets", lambda *_: spark.createDataFrame([(str(b), i) for b in range(3) for i in "abcdef"], "key string, item string"))
    got = {(r.size, r.itemset, r.n) for r in QUERIES["itemsets_all"](spark, "").collect()}
    assert got == {(k, ",".join(c), 3) for k in range(1, 7) for c in combinations("abcdef", k)}


def test_jaccard_and_cosine(spark):
    rows = [(1, i) for i in (0, 1, 2)] + [(2, i) for i in (1, 2, 3)]
    pairs = spark.createDataFrame(rows, "key int, item int")
    assert [tuple(r) for r in similarity.jaccard_pairs(pairs, 0.5).collect()] == [(1, 2, 0.5)]
    left = spark.createDataFrame([("u", i) for i in (1, 2, 3, 4)], "key string, item int")
    right = spark.createDataFrame([("b", i) for i in (3, 4, 5, 6)], "key string, item int")
    wanted = spark.createDataFrame([("u", "b"), ("v", "b")], "a string, b string")
    assert [tuple(r) for r in similarity.cosine_pairs(left, right, wanted).collect()] == [("u", "b", 0.5)]


def test_minhash_constants():
    assert similarity.LSH[:3] == ((926, 1500, 21390), (5915, 2770, 25048), (4121, 9927, 23476))
    assert sketches.BLOOM == ((926, 1500),)
    assert sketches.FM[:2] == ((60, 151, 270), (33, 94, 278))


def test_lsh_is_a_subset_of_the_exact_join(spark):
    rows = [(k, (k * 7 + i * i) % 23) for k in range(30) for i in range(8)]
    pairs = similarity.sets(spark.createDataFrame(rows, "key int, item int"))
    exact = {tuple(r) for r in similarity.jaccard_pairs(pairs, 0.3).collect()}
    assert {tuple(r) for r in similarity.lsh_pairs(pairs, 0.3).collect()} <= exact


def test_pearson_and_predictions(spark):
    ratings = spark.createDataFrame([("u", i, float(s)) for i, s in enumerate((5, 3, 4))] + [("v", i, float(s)) for i, s in enumerate((4, 2, 5))] + [("w", i, 3.0) for i in range(3)], "user_id string, business_id int, stars double")
    model = recommending.user_model(ratings)
    assert [(r.id1, r.id2) for r in model.collect()] == [("u", "v")]  # w does not vary
    assert model.first().sim == pytest.approx(0.654653671)
    train = spark.createDataFrame([("u", 1, 4.0), ("u", 2, 2.0)], "user_id string, business_id int, stars double")
    items = spark.createDataFrame([(1, 3, 0.5), (2, 3, 0.5)], "id1 int, id2 int, sim double")
    wanted = spark.createDataFrame([("u", 3), ("new", 3)], "user_id string, business_id int")
    assert [tuple(r) for r in recommending.item_predictions(train, items, wanted).collect()] == [("u", 3, 3.0)]


def test_user_prediction(spark):
    # target average 4; neighbours (r 5, average 3, weight .5) and (r 2, average 4, weight .25)
    rows = [("t", 1, 4.0), ("a", 1, 3.0), ("a", 9, 5.0), ("b", 1, 4.0), ("b", 9, 2.0)]
    train = spark.createDataFrame(rows, "user_id string, business_id int, stars double")
    model = spark.createDataFrame([("a", "t", 0.5), ("b", "t", 0.25)], "id1 string, id2 string, sim double")
    wanted = spark.createDataFrame([("t", 9)], "user_id string, business_id int")
    assert recommending.user_predictions(train, model, wanted).first().stars == pytest.approx(4.666666666666667)


def test_betweenness_modularity_components(spark):
    edges = graphs.undirected(spark.createDataFrame(TRIANGLES, "a string, b string"))
    got = {r.src + r.dst: r.betweenness for r in graphs.betweenness(edges).collect()}
    assert got == pytest.approx({"ab": 1, "ef": 1, "ac": 4, "bc": 4, "de": 4, "df": 4, "cd": 9})
    labels = spark.createDataFrame([(v, "a") for v in "abc"] + [(v, "d") for v in "def"], "node string, label string")
    values = [graphs.modularity(edges, labels, *how).first()[0] for how in ((2,), (1,), (2, True))]
    assert values == pytest.approx([0.530612, 0.204082, 0.357143], abs=1e-6)
    assert {r.node: r.label for r in graphs.girvan_newman(edges).collect()} == {**dict.fromkeys("abc", "a"), **dict.fromkeys("def", "d")}
    cut = graphs.undirected(spark.createDataFrame([("a", "b"), ("b", "c"), ("d", "e")], "a string, b string"))
    assert {r.node: r.label for r in graphs.components(cut).collect()} == {"a": "a", "b": "a", "c": "a", "d": "d", "e": "d"}
    assert [(r.size, r.members) for r in graphs.communities(graphs.components(cut)).collect()] == [(2, ["d", "e"]), (3, ["a", "b", "c"])]


def test_bloom(spark):
    names = spark.createDataFrame([("Starbucks",), ("Zürich",), ("",), (None,)], "name string")
    bits = {r.bit for r in sketches.bloom_filter(names, "name").collect()}
    assert bits == {7098326, 65870860}
    probed = sketches.bloom_probe(names, "name", sketches.bloom_filter(names.limit(2), "name"))
    assert {r.name: r.member for r in probed.collect()} == {"Starbucks": True, "Zürich": True, "": False, None: False}


def test_flajolet_martin(spark):
    names = "AZ NV ON OH NC PA QC AB WI IL SC CA NY TX XWY".split()
    rows = [(1, "AZ"), (1, "AZ")] + [(3, n) for n in names[:3]] + [(15, n) for n in names]
    got = sketches.flajolet_martin(spark.createDataFrame(rows, "k int, v string"), "v", ["k"])
    assert {r.k: (r.truth, r.estimate) for r in got.collect()} == {1: (1, 1.5), 3: (3, 3.0), 15: (15, 17.0)}


def test_top_frequencies(spark):
    rows = spark.createDataFrame([(t,) for t in "aaaabbbbcccdde"], "tag string")
    assert sorted((r.tag, r.n) for r in sketches.top_frequencies(rows, "tag").collect()) == [("a", 4), ("b", 4), ("c", 3), ("d", 2)]


def test_scalars(spark):
    row = spark.sql("SELECT 8L AS a, 1L AS b, 0L AS c").select(*(N.trailing_zeros(F.col(x)) for x in "abc")).first()
    assert tuple(row) == (3, 0, 1)
    values = spark.createDataFrame([(5.7,), (0.2,), (3.0,), (math.nan,)], "x double").select(N.clamped(F.col("x"), 1.0, 5.0)).collect()
    assert [v[0] for v in values[:3]] == [5.0, 1.0, 3.0] and math.isnan(values[3][0])
    hours = [({"Monday": "", "Friday": ""},), ({"Sunday": ""},), ({"Monday": "", "Sunday": ""},), ({},), (None,)]
    got = spark.createDataFrame(hours, "h map<string,string>").select(N.hours_class(F.col("h"))).collect()
    assert [r[0] for r in got] == ["d", "e", "b", "d", None]
    text = spark.createDataFrame([("I can't, you'll\nsee $100 (well) didn't x",)], "t string").select(X.cleaned(F.col("t"))).first()[0]
    assert text == "i can not  you see   well  x"


def test_dense_index(spark):
    got = dense_index(spark.createDataFrame([("b",), ("a",), ("c",), ("a",), (None,)], "v string"), "v")
    assert sorted(tuple(r) for r in got.collect()) == [("a", 0), ("b", 1), ("c", 2)]


def test_statistics_and_mahalanobis(spark):
    points = spark.createDataFrame([(0, [1.0, 2.0]), (0, [3.0, 4.0])], "cluster int, features array<double>")
    r = clustering.statistics(points).first()
    assert (r.n, r.sum, r.sumsq) == (2, [4.0, 6.0], [10.0, 20.0])
    c = clustering.Cluster(r.n, r.sum, r.sumsq)
    assert c.centre == [2.0, 3.0] and c.variance == [1.0, 1.0]
    assert spark.range(1).select(N.mahalanobis(F.lit([4.0, 3.0]), F.lit(c.centre), F.lit(c.variance))).first()[0] == 2.0


def test_kmeans_and_bfr_find_blobs(spark):
    rows = [(i, [10.0 * (i % 3) + (i % 7) * 0.01, 5.0 * (i % 3) + (i % 5) * 0.01]) for i in range(90)]
    points = spark.createDataFrame(rows, "id long, features array<double>")
    whole = {r.id: r.cluster for r in clustering.kmeans(points, 3).collect()}
    assert all(len({whole[i] for i in range(b, 90, 3)}) == 1 for b in range(3)) and len(set(whole.values())) == 3
    bfr = clustering.Bfr(3, small=2)
    for part in range(2):
        bfr.add(points.where(F.col("id") % 2 == part))
    got = {r.id: r.cluster for r in bfr.finish().collect()}
    assert len(got) == 90 and sum(v == -1 for v in got.values()) < 10
    assert [r[0] for r in bfr.reports] == [1, 2]


def test_blend_and_features(spark):
    a = spark.createDataFrame([(1, 1, 4.0)], "user_id int, business_id int, als double")
    t = spark.createDataFrame([(1, 1, 2.0)], "user_id int, business_id int, trees double")
    assert predicting.blend(a, t).first().stars == pytest.approx(2.2)
    ratings = spark.createDataFrame([(u, b, float(1 + (u + b) % 5)) for u in range(8) for b in range(8)], "user_id int, business_id int, stars double")
    wanted = spark.createDataFrame([(1, 1), (99, 1)], "user_id int, business_id int")
    got = {r.user_id: r.als for r in predicting.als_predictions(predicting.als_model(ratings, rounds=3), wanted, ratings).collect()}
    assert 1 <= got[1] <= 5 and got[99] == pytest.approx(ratings.agg(F.avg("stars")).first()[0])


def test_content(spark):
    texts = spark.createDataFrame([("x", "rare common common"), ("y", "common other")], "key string, text string")
    weights = {(r.key, r.word): r.tfidf for r in content.tf_idf(content.term_counts(texts)).collect()}
    assert weights == {("x", "rare"): 0.5, ("x", "common"): 0.0, ("y", "common"): 0.0, ("y", "other"): 1.0}


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "a.json").write_bytes(b'\xef\xbb\xbf{"id1": "a", "stars": 1.5}\n\n{"id1": "b"}\n')
    assert [tuple(r) for r in readers.json_lines(spark, str(tmp_path / "a.json"), "id1 string, stars double").collect()] == [("a", 1.5), ("b", None)]
    (tmp_path / "p.csv").write_text('user,state\nu1,"A, B"\nuser,state\nu2,C\n')
    assert [tuple(r) for r in readers.csv_pairs(spark, str(tmp_path / "p.csv")).collect()] == [("u1", "A, B"), ("u2", "C")]
    (tmp_path / "words").write_text("the\nof\n")
    assert {r.word for r in readers.word_list(spark, str(tmp_path / "words")).collect()} == {"the", "of", "", " "}
    (tmp_path / "d.json").write_text('{"u": 3.5, "v": 1}')
    assert {tuple(r) for r in readers.dictionary(spark, str(tmp_path / "d.json")).collect()} == {("u", 3.5), ("v", 1.0)}
    chunks = tmp_path / "chunks"
    chunks.mkdir()
    (chunks / "b.txt").write_text("2,0.5,1\n")
    (chunks / "a.txt").write_text("1,1,2\n")
    assert [df.first().id for _, df in readers.point_chunks(spark, str(chunks))] == [1, 2]
    sets = spark.createDataFrame([("Candidates", ["a"]), ("Candidates", ["b"]), ("Candidates", ["a", "b"])], "phase string, itemset array<string>")
    sinks.itemset_text(sets, str(tmp_path / "sets"))
    sinks.tuple_lines(spark.createDataFrame([("a", 1.5)], "x string, y double"), str(tmp_path / "lines"))
    sinks.flags_line(spark.createDataFrame([(2, False), (1, True)], "i int, f boolean"), "i", "f", str(tmp_path / "flags"))
    sinks.json_object(spark.createDataFrame([(1, "x")], "A int, B string"), str(tmp_path / "object"))
    text = lambda d: "".join(p.read_text() for p in sorted((tmp_path / d).glob("part-*")))
    assert text("sets") == "Candidates:\n('a'),('b')\n('a', 'b')"
    assert (text("lines"), text("flags"), text("object")) == ("'a', 1.5\n", "T F ", '{"A":1,"B":"x"}\n')


def test_tag_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.json").write_text('{"id": 1, "lang": "en", "entities": {"hashtags": [{"text": "a"}, {"text": "b"}]}}\n{"id": 2, "lang": "de", "entities": {"hashtags": [{"text": "c"}]}}\n')
    out = str(tmp_path / "out")
    sinks.stream_to_table(readers.tag_stream(spark, str(tmp_path / "in")), out).awaitTermination()
    assert sorted(r.tag for r in spark.read.parquet(out).collect()) == ["a", "b"]


def test_girvan_newman_on_tables(spark, monkeypatch):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d")], "src string, dst string")
    small = {tuple(r) for r in graphs.girvan_newman(edges).collect()}
    monkeypatch.setattr(graphs, "SMALL", 0)
    assert {tuple(r) for r in graphs.girvan_newman(edges).collect()} == small == {("a", "a"), ("b", "a"), ("c", "c"), ("d", "c")}


def test_minhash_recall(spark):
    from brindle.operators import similarity
    from brindle.sources import tables

    pairs = similarity.sets(tables.purchases(spark, "/root/testdata/sf0.01"))
    exact = {(r.a, r.b) for r in similarity.jaccard_pairs(pairs, 0.055).collect()}
    found = {(r.a, r.b) for r in similarity.lsh_pairs(pairs, 0.055).collect()}
    assert found <= exact and len(found) >= 0.9 * len(exact)


def test_push_source_and_appended_windows(spark, tmp_path):
    buffer, out = tmp_path / "buffer", str(tmp_path / "out")
    buffer.mkdir()
    say = lambda n, lang, *tags: (buffer / f"{n}.json").write_text('{"id": %d, "lang": "%s", "entities": {"hashtags": [%s]}}\n' % (n, lang, ", ".join('{"text": "%s"}' % t for t in tags)))
    say(0, "en", "a", "b")
    say(1, "de", "c")
    counted = lambda: readers.pushed_tags(spark, str(buffer)).groupBy("tag").count()
    query = sinks.stream_to_csv(counted(), out, every="1 second")
    query.processAllAvailable()
    assert not stateful.run_for(query, 1) and not query.isActive
    rows = spark.read.option("header", True).csv(out)
    assert {(r.tag, r["count"]) for r in rows.collect()} == {("a", "1"), ("b", "1")}


def test_other_queries_stop_when_one_fails(spark, tmp_path):
    rate = spark.readStream.format("rate").load()
    listener = stateful.StopOn(spark, lambda error: "420" in error)
    spark.streams.addListener(listener)
    try:
        going = rate.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "a")).start()

        def fail(batch, number):
            raise RuntimeError("status 420")

        failing = rate.writeStream.foreachBatch(fail).option("checkpointLocation", str(tmp_path / "b")).start()
        with pytest.raises(Exception, match="420"):
            failing.awaitTermination(60)
        assert going.awaitTermination(60) and "420" in listener.reason
    finally:
        spark.streams.removeListener(listener)
        for query in spark.streams.active:
            query.stop()


def test_models_come_back(spark, tmp_path):
    ratings = spark.createDataFrame([(u, b, float(1 + (u + b) % 5)) for u in range(8) for b in range(8)], "user_id int, business_id int, stars double")
    model = predicting.als_model(ratings, rounds=3)
    sinks.model(model, str(tmp_path / "als"))
    ask = ratings.select("user_id", "business_id")
    shown = lambda m: sorted(map(tuple, m.transform(ask).collect()))
    assert shown(readers.factors(str(tmp_path / "als"))) == shown(model)
    trees = predicting.tree_pipeline(["user_id", "business_id"], trees=2, least=1).fit(ratings.select(F.col("user_id").cast("double"), F.col("business_id").cast("double"), "stars"))
    sinks.model(trees, str(tmp_path / "trees"))
    rows = ask.select(F.col("user_id").cast("double"), F.col("business_id").cast("double"))
    assert sorted(map(tuple, predicting.tree_predictions(readers.fitted(str(tmp_path / "trees")), rows).collect())) == sorted(map(tuple, predicting.tree_predictions(trees, rows).collect()))


def test_what_is_written_within_goes(spark):
    from pathlib import Path

    from brindle.sources.shared import scratch, shared_dir, written

    with scratch(spark):
        before = set(Path(shared_dir(spark)).iterdir())
        written(spark.range(3), "gone")
        made = set(Path(shared_dir(spark)).iterdir()) - before
        assert len(made) == 1
    assert not next(iter(made)).exists()
