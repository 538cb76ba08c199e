"""Operators on tiny hand-computed frames, and invariants."""

import math

import pytest
from pyspark.sql import functions as F

from tallyreef.functions import maths as M
from tallyreef.functions import strings as X
from tallyreef.operators import clusters as C
from tallyreef.operators import factor as A
from tallyreef.operators import predict as P
from tallyreef.operators import prep
from tallyreef.operators import similarity as S
from tallyreef.operators import text as T

RATINGS = [(1, 1, 8), (1, 2, 6), (1, 3, 4), (2, 1, 8), (2, 2, 6), (2, 4, 10), (3, 3, 2), (3, 4, 9), (4, 5, 5)]


@pytest.fixture(scope="module")
def r(spark):
    return spark.createDataFrame([(u, i, float(x)) for u, i, x in RATINGS], "user_id long, item_id long, rating double")


def pairs(df):
    return {(x["u"], x["v"]): x["dist"] for x in df.collect()}


def test_cosine_distances(r):
    got = pairs(S.cosine_pairs(r))
    assert got[1, 2] == pytest.approx(0.343468, abs=1e-6)
    assert got[1, 3] == pytest.approx(0.919434, abs=1e-6)
    assert got[2, 3] == pytest.approx(0.309732, abs=1e-6)
    assert (1, 4) not in got


def test_masked_euclidean(r):
    assert pairs(S.euclidean_pairs(r)) == {(1, 2): 0.0, (1, 3): 2.0, (2, 3): 1.0}


def test_centring(r):
    got = {(x["user_id"], x["item_id"]): x["centered"] for x in prep.center(r).collect()}
    assert [got[1, i] for i in (1, 2, 3)] == [2, 0, -2]
    assert [got[3, i] for i in (3, 4)] == [-3.5, 3.5]
    assert got[4, 5] == 0


def test_centred_cosine(r):
    got = pairs(S.cosine_pairs(prep.center(r), "centered"))
    assert got == pytest.approx({(1, 2): 1.0, (1, 3): 0.5, (2, 3): 0.5})


def test_neighbours_and_predictions(r):
    knn = S.knn_cosine(r, 2)
    assert [x["v"] for x in knn.where("u = 1").orderBy("rank").collect()] == [2, 3]
    assert knn.where("u = v").isEmpty()
    assert knn.groupBy("u").count().where("count <> 2").isEmpty()
    pred = P.by_mean(knn, r)
    assert {x["item_id"]: x["pred"] for x in pred.where("user_id = 1").collect()} == {1: 8, 2: 6, 3: 2, 4: 9.5}
    top = P.recommend(P.unseen(pred, r), 1).where("user_id = 1").first()
    assert top["item_id"] == 4


def test_zero_distance_weighs_nothing(r):
    knn = S.knn_euclidean(r, 2)
    got = {x["item_id"]: x["pred"] for x in P.by_distance(knn.where("u = 1"), r).collect()}
    assert got == {3: 2.0, 4: 9.0}


def test_normalise_equal_bounds(r):
    assert prep.normalize(r).where("user_id = 4").first()["normalized"] == 0


def test_kcore_is_a_fixpoint(spark, r):
    k = prep.kcore(r, 2)
    assert k.count() > 0
    for key in ("user_id", "item_id"):
        assert k.groupBy(key).count().where("count < 2").isEmpty()
    assert prep.kcore(r, 100).count() == 0
    assert prep.kcore(r.limit(0), 2).count() == 0


def test_splits_partition_the_rows(r):
    for split, n in ((prep.split_global(r, 0.3), math.floor(0.3 * 9)), (prep.split_per_user(r, 0.5), 1 + 1 + 1 + 0)):
        assert split.count() == 9
        assert split.where("hidden").count() == n


def test_histogram_of_all_others(r):
    got = S.histogram_all(S.mirrored(S.cosine_pairs(r)), r).groupBy("u").agg(F.sum("n").alias("n")).collect()
    assert {x["u"]: x["n"] for x in got} == {1: 3, 2: 3, 3: 3, 4: 3}


def test_entropy(spark):
    p = spark.createDataFrame([(1, 1), (1, 1), (1, 2)], "cluster int, user_id long")
    assert C.entropy(p).first()["weight"] == pytest.approx(0.636514, abs=1e-6)


def test_tfidf(spark):
    rows = spark.createDataFrame([(1, 1, "a1"), (1, 2, "b1"), (1, 3, "a1"), (2, 1, "b1"), (2, 2, "c1")], "review_id long, pos int, lemma string")
    got = {(x["review_id"], x["term"]): x["weight"] for x in T.tfidf(rows, "lemma", least=1, most=1.0).collect()}
    assert got == pytest.approx({(1, "a1"): 0.942156, (1, "b1"): 0.335176, (2, "b1"): 0.579739, (2, "c1"): 0.814802}, abs=1e-6)


@pytest.mark.parametrize("words, batches", [([3, 4, 5, 2, 9], [0, 0, 1, 1, 2]), ([9, 1], [1, 2])])
def test_batches(spark, words, batches):
    df = spark.createDataFrame([(1, k, w) for k, w in enumerate(words)], "conv_id long, turn long, n long")
    assert [x["batch"] for x in T.batches(df, "conv_id", "turn", "n", 8).orderBy("turn").collect()] == batches


def test_bleu_and_rouge_bounds(spark):
    a = spark.createDataFrame([(1, "x", 3), (1, "y", 1)], "k int, term string, n long")
    b = spark.createDataFrame([(1, "x", 1), (1, "z", 1)], "k int, term string, n long")
    row = T.clipped(a, b, ["k"]).withColumn("r", T.recall()).withColumn("p", T.precision()).first()
    assert (row["common"], row["n_pred"], row["n_ref"], row["r"], row["p"]) == (1, 4, 2, 50.0, 25.0)


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first()["y"]


def test_cleaning(spark):
    lohi = {"jusqu'à 4": (1, 4), "à partir de 2": (2, None), "3": (3, 3), "2 à 6": (2, 6), "8 ans et +": (8, 99), None: (None, None), "?": (None, None)}
    for text, (lo, hi) in lohi.items():
        assert tuple(one(spark, X.parse_range, text)) == (lo, hi)
    assert tuple(one(spark, M.leading_digit, 24, "long")) == (2, 4)
    assert tuple(one(spark, M.leading_digit, 213, "long")) == (2, 13)
    assert one(spark, X.collapse_repeats, "superrrr") == "super"
    assert one(spark, X.strip_accents, "Éçà") == "eca"
    assert one(spark, M.hex_rgb, "#ff0a10") == [255, 10, 16]
    assert one(spark, lambda x: X.clean_tokens(x, 2, 20), "Il n'aime PAS le jeuuuu 4eme deadbeef0123456789abcdef, vraiment!") == ["aime", "pas", "jeu", "vraiment"]
    assert one(spark, X.first_tags, None) == "-"


def test_ward_and_spectral(spark):
    v = spark.createDataFrame([(k, [float(k // 3 * 10 + k % 3), 0.0]) for k in range(6)], "id long, v array<double>")
    got = {x["id"]: x["cluster"] for x in A.ward(v, "id", "v", 2).collect()}
    assert len({got[k] for k in range(3)}) == len({got[k] for k in range(3, 6)}) == 1 and got[0] != got[5]
    m = spark.createDataFrame([(f"r{i}", f"c{j}", 5.0 if i // 2 == j // 2 else 0.1) for i in range(4) for j in range(4)], "r string, c string, v double")
    assert A.spectral_coclusters(m, "r", "c", "v", 2).count() == 8


def test_prompts(spark):
    df = spark.createDataFrame([(["a", "b"],), ([],)], "b array<string>").select(T.prompt("user", F.col("b")).alias("messages"))
    got = T.generate(df, T.template_responder).collect()
    assert [len(x["messages"]) for x in got] == [2, 1]
    assert got[0]["response"].endswith("a b")
