"""Queries against DuckDB at the smallest scale, and readers, writers and the stream."""

import os

import duckdb
import pytest

import __spark_entry__
from tallyreef.plans import registry
from tallyreef.sources import io, views
from tallyreef.streaming import activity

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SOME = [
    "ratings_matrix", "kcore_filter", "center_score", "bias_terms", "posneg_split", "rating_hist", "metric_quartiles", "cos_pairs", "knn_cos", "knn_predict",
    "recommend_topn", "split_global", "knn_eval_full", "knn_k_sweep", "choose_users_distant", "words_freq", "bigram_diff_freq", "tfidf_bi", "rouge2_topx", "bleu_2",
    "batch_assign", "parse_range", "user_tag_profile", "tag_jaccard", "cluster_entropy", "silhouette", "find_phrases", "push_points", "app_colors", "build_users_info",
]


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if hasattr(v, "tolist"):
        v = v.tolist()
    return "[" + ",".join(map(plain, v)) + "]" if isinstance(v, (list, tuple)) else repr(v) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", SOME)
def test_same_as_sql(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    got = duck.execute(registry.oracle_sql()[name])
    names = [x[0] for x in got.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted(tuple(plain(row[names.index(c)]) for c in df.columns) for row in got.fetchall())
    assert sorted(tuple(plain(x) for x in row) for row in df.collect()) == want


def test_every_oracle_has_a_query():
    assert set(registry.oracle_sql()) <= set(registry.queries())
    assert len(registry.queries()) > 150


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_files(spark, tmp_path):
    df = spark.createDataFrame([(1, 'say "hi"\nthere', None), (2, "é, x", 4.5)], "id long, body string, rating double")
    io.write_csv(df, str(tmp_path / "c"))
    assert sorted(map(tuple, io.read_csv(spark, str(tmp_path / "c"), "id long, body string, rating double").collect())) == sorted(map(tuple, df.collect()))
    io.write_records(df, str(tmp_path / "j"))
    back = spark.read.schema(df.schema).json(str(tmp_path / "j"))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    (tmp_path / "r.json").write_text('[{"x": 1, "y": "a"}, {"x": 2, "y": null}]')
    assert io.read_records(spark, str(tmp_path / "r.json"), "x long, y string").count() == 2
    (tmp_path / "n.csv").write_text("1,a,\n1,a,\n2,b,3.5\n")
    assert io.read_csv(spark, str(tmp_path / "n.csv"), "u long, n string, r double", header=False, distinct=True).count() == 2
    m = spark.createDataFrame([(1, [1.0, 2.0])], "id long, v array<double>")
    io.write_matrix(m, str(tmp_path / "m"))
    assert io.read_matrix(spark, str(tmp_path / "m")).first()["values"] == [1.0, 2.0]
    assert io.rating_triples(df.withColumn("i", df.id), "id", "i", "rating").count() == 1


def test_stream(spark, tmp_path):
    os.makedirs(tmp_path / "in")
    views.table(spark, SF, "events").coalesce(2).write.mode("overwrite").parquet(str(tmp_path / "in"))
    events = spark.readStream.schema(views.table(spark, SF, "events").schema).parquet(str(tmp_path / "in"))
    activity.run(events, str(tmp_path / "out"), str(tmp_path / "ck"), size="7 days").awaitTermination()
    got, all_ = spark.read.parquet(str(tmp_path / "out")), views.table(spark, SF, "events").count()
    assert 0 < got.agg({"n": "sum"}).first()[0] <= all_
