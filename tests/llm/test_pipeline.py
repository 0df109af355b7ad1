"""The pipeline against its stages' brute-force versions, and the registered queries against SQL."""

from __future__ import annotations

import re

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from brindle.llm import decontamination, hilbert_sharding, jaccard_join, toxicity
from brindle.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sql():
    c = duckdb.connect()
    for t in ("documents", "benchmark", "labels"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    yield c
    c.close()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, sql, name):
    got, want = QUERIES[name](spark, SF), sql.execute(ORACLES[name])
    names = sorted(d[0] for d in want.description)
    assert sorted(got.columns) == names
    rows = want.fetchall()
    at = [[d[0] for d in want.description].index(n) for n in names]
    assert sorted(map(repr, (tuple(r[n] for n in names) for r in got.collect()))) == sorted(map(repr, (tuple(r[i] for i in at) for r in rows)))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_one_row_per_document(spark, name):
    ids = sorted(r.doc_id for r in QUERIES[name](spark, SF).select("doc_id").collect())
    assert ids == sorted(r.doc_id for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect())


def test_stages(spark):
    from test_llm import brute_hits, brute_links

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    model = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"), toxicity.not_held_out())
    bad = {r.doc_id for r in toxicity.score(docs, model).where(F.col("score") >= toxicity.THRESHOLD).collect()}
    left = {i: t for i, t in rows.items() if i not in bad}
    first = {}
    for i in sorted(left):
        first.setdefault(re.sub("[\x20\x09-\x0d]+", " ", left[i] or ""), i)
    left = {i: left[i] for i in first.values()}
    ids = sorted(left)
    left = {i: left[i] for i, (_, _, c) in zip(ids, brute_links([left[i] for i in ids], ids)) if c == i}
    ids = sorted(left)
    items = [(str(r.item_id), r.text) for r in bench.collect()]
    left = {i for i, (_, hit, _) in zip(ids, brute_hits([left[i] for i in ids], items)) if not hit}
    got = corpus_pipeline.run(spark, SF)
    assert {r.doc_id for r in got.collect()} == left
    assert decontamination.WINDOW == 10 and jaccard_join.PERCENT == 70


def test_stages_keep_columns(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), SF).columns == docs.columns


CLASHING = ("_row", "_ROW_", "y", "weight", "shard", "slot", "row_id", "id", "size", "sig", "rep", "n", "score", "spans", "matches", "form", "prefix", "place", "_hot", "component", "toxic", "quality")


def test_columns_of_any_name_stay_as_they_are(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    more = docs.withColumns({c: F.col("doc_id") * 10 + k for k, c in enumerate(CLASHING)})
    names = more.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, more, SF).write.parquet(str(tmp_path / str(k)))
        more = spark.read.parquet(str(tmp_path / str(k)))
        assert more.columns == names, name
        assert not more.where(" or ".join(f"`{c}` <> doc_id * 10 + {i}" for i, c in enumerate(CLASHING))).limit(1).count(), name
    hilbert_sharding.write_shards(more, str(tmp_path / "shards"), 3)
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert set(back.columns) == {*names, "shard_"} and back.count() == more.count() and not back.where("shard <> doc_id * 10 + 4").count()
