"""The pipeline's stages on a small table."""

import corpus_pipeline
from tallyreef.llm import _common as C
from tallyreef.llm import decontaminate, jaccard

from .helpers import docs, prose


def test_stages(spark, tmp_path):
    item = prose(900, 30)
    rows = [(k, f"{prose(k)} ", "en" if k % 2 else "fr", f"src{k % 3}") for k in range(1, 41)]
    rows += [(50, prose(1), "en", "src0"), (51, f"{prose(77)} {item} {prose(78)}", "en", "src1"), (52, "123 !!", "en", "src1"), (53, None, None, "src2"), (54, "", "en", None), (55, prose(5), None, None), (55, prose(5), None, None)]
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    df, columns = docs(spark, rows), docs(spark, []).columns
    counts = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        df = C.keep(stage(spark, df, str(tmp_path)), "stage")
        if k < 4:
            assert df.columns == columns
        counts.append(df.count())
    assert counts == [len(rows) - 3, 41, 40, 40, 40]
    assert {r["doc_id"] for r in df.collect()} == set(range(1, 41))
    assert df.agg({"start": "min"}).first()[0] == 0


def test_tokens_beside_columns_of_the_same_names(spark):
    df = docs(spark, [(2, "b c"), (1, None), (3, "d")]).selectExpr("*", "'x' AS file_", "'y' AS name_", "0 AS row_", "1 AS start", "2 AS n_tokens")
    for given in (df, C.keep(df, "clash")):
        got = corpus_pipeline.write_tokens(spark, given, "").collect()
        assert {r["doc_id"] for r in got} == {1, 2, 3}
        assert sorted(r["start"] for r in got)[0] == 0 and sum(r["n_tokens"] == 1 for r in got) == 1


def test_run_on_documents(spark):
    got = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    rows = sorted(map(tuple, got.collect()), key=lambda r: r[1])
    assert all(a[1] + a[2] == b[1] for a, b in zip(rows[:-1], rows[1:]))
    assert len({r[0] for r in rows}) == len(rows) > 100


def _exchanges(df) -> list[str]:
    """Shuffles by key in the first plan."""
    return [line for line in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning" in line]


def test_texts_are_shuffled_once_for_the_least_ids(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = jaccard.keep_one(docs(spark, [(k, prose(k // 2)) for k in range(20)] + [(None, prose(99)), (None, prose(99))]))
        # one for the rows and one or two for the ids that are kept
        assert sum("id_#" in line for line in _exchanges(kept)) <= 3 and "text_" not in kept._jdf.queryExecution().executedPlan().toString()
        assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == list(range(0, 20, 2)) and kept.where("doc_id IS NULL").count() == 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_documents_are_not_shuffled_for_few_leaks(spark):
    item = prose(900, 30)
    b = spark.createDataFrame([(1, item)], "item_id long, text string")
    kept = decontaminate.without_leaks(C.keep(docs(spark, [(k, prose(k)) for k in range(5)] + [(9, f"{prose(7)} {item}")]), "docs"), b)
    assert not _exchanges(kept)
    assert sorted(r["doc_id"] for r in kept.collect()) == list(range(5))
