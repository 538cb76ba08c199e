"""The sweep of k-core thresholds against the filter itself, and what it writes."""

import random

from tallyreef.operators import prep


def size(folder):
    return sum(f.stat().st_size for f in folder.rglob("part-*"))


def test_sweep_is_the_filter_and_writes_no_copy_for_each_threshold(spark, tmp_path):
    r = random.Random(3)
    rows = sorted({(int(r.paretovariate(0.7) * 3) % 150, int(r.paretovariate(0.7) * 3) % 120) for _ in range(40000)})
    df = spark.createDataFrame([(u, i, 1.0) for u, i in rows] + [(None, 1, 1.0), (1, None, 1.0)], "user_id long, item_id long, rating double").repartition(4)
    spark.sparkContext.setCheckpointDir(str(tmp_path / "sweep"))
    got = {x["threshold"]: (x["n_users"], x["n_items"], x["n_rows"]) for x in prep.kcore_sweep(df, range(14, 22)).collect()}
    written = size(tmp_path / "sweep")
    spark.sparkContext.setCheckpointDir(str(tmp_path / "one"))
    df.checkpoint(eager=True)
    assert written < 6 * size(tmp_path / "one")
    spark.sparkContext.setCheckpointDir(str(tmp_path / "rest"))
    for t in (14, 18, 21):
        kept = prep.kcore(df, t).collect()
        assert got[t] == (len({x["user_id"] for x in kept}), len({x["item_id"] for x in kept}), len(kept))
    assert len(set(got.values())) > 2
