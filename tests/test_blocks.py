"""All pairs by blocks: against brute force, with blocks of a few users, and plans that shuffle no pair."""

import contextlib
import io
import math
import random
import re

import numpy as np
import pytest

from tallyreef.operators import blocks as B
from tallyreef.operators import predict as P
from tallyreef.operators import similarity as S
from tallyreef.operators import tags as G
from tallyreef.operators import text as T
from tallyreef.plans import recommender, registry
from tallyreef.sources import views

SF = "/root/testdata/sf0.001"
#: Queries on pairs of users or items.
BY_BLOCKS = """
cos_pairs_centered
app_colors
build_users_info
choose_users_distant
choose_users_random
choose_users_similar
cos_pairs
cos_pairs_activity
dist_hist_all
dist_hist_knn
eucl_pairs
item_cooc_norm
item_cooc
knn_cos
knn_eval_full
knn_eval_user
knn_eucl
knn_eval_per_user
knn_k_sweep
knn_predict
knn_predict_wcount
"""


def plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue()


@pytest.mark.parametrize("name", BY_BLOCKS.split())
def test_no_shuffle_by_pair(spark, name):
    found = plan(registry.queries()[name](spark, SF))
    assert "CartesianProduct" in found
    assert not re.search(r"hashpartitioning\((u|user_id|a)#\d+L?, (v|b)#", found)
    assert not re.search(r"Join \[(item_id|tag)#\d+L?\], \[(item_id|tag)#\d+L?\], Inner, .*<", found)


def test_raters_of_some_users(spark):
    of = (lambda df: sorted(map(tuple, df.select("user_id", "item_id", "v", "dist").collect())))
    some = of(recommender.raters(spark, SF, "user_id < 9"))
    assert some and some == of(recommender.raters(spark, SF).where("user_id < 9 AND v < 9"))


@pytest.fixture(scope="module")
def rows():
    r = random.Random(5)
    out = [(u, i, r.randint(1, 50) / 5) for u in range(40) for i in r.sample(range(30), r.randint(1, 12))]
    return out + [(100 + u, i, x) for u, i, x in out if u < 9]  # with users that rate alike


def test_neighbours_by_brute_force(spark, monkeypatch, rows):
    monkeypatch.setattr(B, "SIZE", 7)
    monkeypatch.setattr(B, "WIDE", 4)
    r = spark.createDataFrame(rows, "user_id long, item_id long, rating double")
    by = {}
    for u, i, x in rows:
        by.setdefault(u, {})[i] = x
    norm = {u: math.sqrt(sum(x * x for x in xs.values())) for u, xs in by.items()}
    cos, root = {}, {}
    for u in by:
        for v in by:
            both = by[u].keys() & by[v].keys()
            if u != v:
                cos[u, v] = round(1 - sum(by[u][i] * by[v][i] for i in both) / (norm[u] * norm[v]), 9) + 0.0
                if both:
                    root[u, v] = round(math.sqrt(sum((by[u][i] - by[v][i]) ** 2 for i in both) / len(both)), 9)
    met = {(x["u"], x["v"]): (x["n"], x["dist"]) for x in S.cosine_pairs(r).collect()}
    assert met == {(u, v): (len(by[u].keys() & by[v].keys()), pytest.approx(cos[u, v], abs=2e-9)) for u, v in root if u < v}
    assert {(x["u"], x["v"]): x["dist"] for x in S.euclidean_pairs(r).collect()} == pytest.approx({p: d for p, d in root.items() if p[0] < p[1]}, abs=2e-9)
    for got, of in ((S.knn_cosine(r, 5), cos), (S.knn_euclidean(r, 5), root)):
        want = {u: sorted((d, v) for (a, v), d in of.items() if a == u)[:5] for u in by}
        assert {(x["u"], x["rank"]): x["v"] for x in got.collect()} == {(u, k + 1): v for u, some in want.items() for k, (_, v) in enumerate(some)}


def test_tags_in_common(spark, monkeypatch):
    monkeypatch.setattr(B, "SIZE", 2)
    t = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (2, "b"), (3, "b"), (4, "c"), (5, "a")], "item_id long, tag string")
    assert {(x["a"], x["b"]): x["n"] for x in G.item_pairs(t).collect()} == {(1, 2): 2, (1, 3): 1, (1, 5): 1, (2, 3): 1, (2, 5): 1}
    assert {(x["a"], x["b"]): x["weight"] for x in G.item_pairs(t, weighted=True).collect()} == {(1, 2): 0.5, (1, 3): 0.5, (1, 5): 0.5, (2, 3): 0.5, (2, 5): 0.5}


@pytest.mark.parametrize("kind", ["cosine", "euclidean"])
def test_far_owners_are_not_rounded(monkeypatch, kind):
    rng, seen = np.random.RandomState(5), []

    def block(number, at):
        xs = rng.rand(100, 8) + 0.1
        return B.Block(number, at + np.arange(100), np.arange(8), (np.arange(101) * 8).astype(np.int64).tobytes(), np.tile(np.arange(8), 100).astype(np.int32).tobytes(), xs.tobytes(), np.sqrt((xs**2).sum(axis=1)).tobytes(), np.full(100, 8, dtype=np.int64).tobytes())

    real = S.rounded
    monkeypatch.setattr(S, "rounded", lambda x, *how: seen.append(x.size) or real(x, *how))
    one, found = block(0, 0), S._Nearest(kind, 3)
    for k in range(1, 6):
        found.meet(one, block(k, 100 * k))
    assert sum(seen) < 100 * 100 and len(next(found.done())) == 300


def test_blocks_are_as_many_as_they_need_be(spark, monkeypatch, rows):
    monkeypatch.setattr(B, "SIZE", 30)
    r = spark.createDataFrame(rows, "user_id long, item_id long, rating double")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        got = [len(x["owners"]) for x in B.packed(r, "user_id", "item_id", "rating", 3).collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sorted(got) == [24, 25]


def test_means_of_neighbours(spark, monkeypatch, rows):
    """With null ratings, a null item and neighbours that rated nothing; no row is shuffled for each of a neighbour's ratings."""
    monkeypatch.setattr(B, "SIZE", 7)
    rated = [*rows, (1, 77, None), (2, 77, 4.0), (3, None, 2.0), (4, None, None), (5, 78, None)]
    r = spark.createDataFrame(rated, "user_id long, item_id long, rating double")
    near = [(u, v) for u in range(12) for v in (u + 1, u + 2, u + 500)]
    got = P.by_mean(spark.createDataFrame([(u, v, 0.5, 1) for u, v in near], "u long, v long, dist double, rank long"), r)
    want = {}
    for u, v in near:
        for w, i, x in rated:
            if w == v:
                want.setdefault((u, i), []).append(x)
    means = {k: [x for x in xs if x is not None] for k, xs in want.items()}
    assert {(x["user_id"], x["item_id"]): (x["pred"], x["n"]) for x in got.collect()} == {k: (pytest.approx(sum(means[k]) / len(means[k])) if means[k] else None, len(xs)) for k, xs in want.items()}
    assert "Aggregate" not in plan(got) and "SortMergeJoin" not in plan(got)


def test_sweep_by_blocks(spark, monkeypatch, rows):
    """Against brute force, with null ratings, a null item and neighbours that rated nothing; no row is shuffled for each of a neighbour's ratings."""
    monkeypatch.setattr(B, "SIZE", 7)
    rated = [*rows, (1, 77, None), (2, 77, 4.0), (3, None, 2.0), (5, 78, None)]
    r = spark.createDataFrame(rated, "user_id long, item_id long, rating double")
    near = [(u, v, k + 1) for u in range(12) for k, v in enumerate((u + 1, u + 500, u + 2, u + 3))]
    got = P.sweep(spark.createDataFrame([(u, v, 0.5, k) for u, v, k in near], "u long, v long, dist double, rank long"), r, r.where("user_id % 2 = 0"), [1, 3, 4])
    want = {}
    for k in (1, 3, 4):
        err = []
        for u, i, x in rated:
            xs = [y for a, v, rank in near if a == u and rank <= k for w, j, y in rated if w == v and j == i and i is not None and y is not None]
            if u % 2 == 0 and xs and x is not None:
                err.append(x - sum(xs) / len(xs))
        want |= {(k, "RMSE"): math.sqrt(sum(e * e for e in err) / len(err)), (k, "MAE"): sum(map(abs, err)) / len(err)}
    assert {(x["k"], x["type"]): x["value"] for x in got.collect()} == pytest.approx(want)
    assert plan(registry.queries()["knn_k_sweep"](spark, SF)).count("CartesianProduct") == 2


def test_colors_deal_predictions_out_once(spark):
    found = plan(registry.queries()["app_colors"](spark, SF))
    after = found[: found.index("CartesianProduct")]
    assert after.count("Exchange") == 1 and "Join" not in after


def test_terms_are_dealt_out_once(spark):
    of = (lambda df: sorted(map(tuple, df.select("user_id", "item_id", "gram").collect())))
    got = of(views.comment_bigrams(spark, SF))
    assert got and got == of(T.bigrams(views.lemmas(spark, SF)))
    found = plan(registry.queries()["explain_rouge_groups"](spark, SF))
    assert "FullOuter" not in found and not re.search(r"hashpartitioning\([^)]*term#", found)
    assert not re.search(r"hashpartitioning\(review_id#", found)
