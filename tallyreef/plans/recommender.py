"""Queries on ratings: preparation, distances, neighbours, predictions and evaluation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import predict as P
from ..operators import prep, similarity as S
from ..operators.base import r6, ranked, shuffled
from ..sources import views as V
from .registry import register
from .sqlviews import r6 as q6
from .sqlviews import sql

K = 10
CORE = 20
L = "long"


def reg(name, build, query=None):
    register(name, build, sql(query) if query else None)


def cen(s, d):
    return prep.center(V.ratings_dense(s, d))


# --- preparation ---------------------------------------------------------------------------------------------------

reg("ratings_matrix", lambda s, d: V.ratings(s, d).select("user_id", "item_id", r6("rating").alias("rating")), f"SELECT user_id, item_id, {q6('rating')} AS rating FROM ratings")


def id_index(s, d):
    ids = V.ratings(s, d).select("user_id").distinct()
    return ids.select("user_id", (F.dense_rank().over(Window.orderBy("user_id")) - 1).cast(L).alias("user_index"))


reg("id_index", id_index, "SELECT user_id, dense_rank() OVER (ORDER BY user_id) - 1 AS user_index FROM (SELECT DISTINCT user_id FROM ratings)")


def _rounds(source: str, least: int, op: str, rounds: int, prefix: str) -> tuple[str, str]:
    """Unrolled k-core rounds as CTEs, and the last one's name."""
    out, last = [], source
    for k in range(rounds):
        out.append(f"{prefix}u{k} AS (SELECT * FROM {last} WHERE user_id IN (SELECT user_id FROM {last} GROUP BY 1 HAVING count(*) {op} {least}))")
        out.append(f"{prefix}i{k} AS (SELECT * FROM {prefix}u{k} WHERE item_id IN (SELECT item_id FROM {prefix}u{k} GROUP BY 1 HAVING count(*) {op} {least}))")
        last = f"{prefix}i{k}"
    return ", ".join(out), last


for _name, _op in (("kcore_filter", ">="), ("kcore_filter_strict", ">")):
    _ctes, _last = _rounds("ratings", CORE, _op, 10, "c")
    reg(_name, lambda s, d, strict=_op == ">": prep.kcore(V.ratings(s, d), CORE, strict=strict).select("user_id", "item_id", r6("rating").alias("rating")), f"WITH {_ctes} SELECT user_id, item_id, {q6('rating')} AS rating FROM {_last}")

_parts, _sel = [], []
for _t in range(16, 22):
    _c, _l = _rounds("ratings", _t, ">=", 10, f"t{_t}_")
    _parts.append(_c)
    _sel.append(f"SELECT CAST({_t} AS BIGINT) AS threshold, count(DISTINCT user_id) AS n_users, count(DISTINCT item_id) AS n_items, count(*) AS n_rows FROM {_l}")
reg("kcore_sweep", lambda s, d: prep.kcore_sweep(V.ratings(s, d), range(16, 22)), f"WITH {', '.join(_parts)} {' UNION ALL '.join(_sel)}")

reg("center_score", lambda s, d: prep.center(V.ratings(s, d)).select("user_id", "item_id", r6("mean").alias("mean"), r6("centered").alias("centered")), f"SELECT user_id, item_id, {q6('avg(rating) OVER (PARTITION BY user_id)')} AS mean, {q6('rating - avg(rating) OVER (PARTITION BY user_id)')} AS centered FROM ratings")
reg("normalize_score", lambda s, d: prep.normalize(V.ratings(s, d)).select("user_id", "item_id", r6("normalized").alias("normalized")), f"SELECT user_id, item_id, {q6('coalesce((rating - min(rating) OVER w) / nullif(max(rating) OVER w - min(rating) OVER w, 0), 0)')} AS normalized FROM ratings WINDOW w AS (PARTITION BY user_id)")
reg("user_minmax", lambda s, d: V.ratings(s, d).groupBy("user_id").agg(r6(F.max("rating")).alias("max"), r6(F.min("rating")).alias("min")), f"SELECT user_id, {q6('max(rating)')} AS max, {q6('min(rating)')} AS min FROM ratings GROUP BY 1")
reg("bias_terms", lambda s, d: prep.biases(V.ratings(s, d)).select("user_id", "item_id", r6("mu").alias("mu"), r6("bu").alias("bu"), r6("bi").alias("bi"), r6("residual").alias("residual")), f"""WITH m AS (SELECT *, avg(rating) OVER () AS mu FROM ratings), b AS (SELECT *, avg(rating - mu) OVER (PARTITION BY user_id) AS bu FROM m), c AS (SELECT *, avg(rating - mu - bu) OVER (PARTITION BY item_id) AS bi FROM b)
SELECT user_id, item_id, {q6('mu')} AS mu, {q6('bu')} AS bu, {q6('bi')} AS bi, {q6('rating - mu - bu - bi')} AS residual FROM c""")

def polarity():
    """Side of the user's mean."""
    return F.when(F.round("centered", 9) >= 0, "positive").otherwise("negative")


QPOL = "CASE WHEN round(centered, 9) >= 0 THEN 'positive' ELSE 'negative' END"
reg("posneg_split", lambda s, d: cen(s, d).select("user_id", "item_id", polarity().alias("polarity")), f"SELECT user_id, item_id, {QPOL} AS polarity FROM centered_dense")
reg("posneg_items", lambda s, d: cen(s, d).withColumn("p", polarity()).groupBy("item_id").agg(F.count_if(F.col("p") == "positive").alias("n_pos"), F.count_if(F.col("p") == "negative").alias("n_neg")).where("n_pos >= 10 AND n_neg >= 10"), f"SELECT * FROM (SELECT item_id, count(*) FILTER ({QPOL} = 'positive') AS n_pos, count(*) FILTER ({QPOL} = 'negative') AS n_neg FROM centered_dense GROUP BY 1) WHERE n_pos >= 10 AND n_neg >= 10")


def posneg_union(s, d):
    c = cen(s, d).withColumn("p", polarity())
    part = (lambda p: c.where(F.col("p") == p).groupBy("item_id").agg(r6(F.avg("rating")).alias("mean"), F.count("*").alias("n")).withColumn("polarity", F.lit(p)))
    return part("positive").unionByName(part("negative"))


reg("posneg_union", posneg_union, f"SELECT item_id, {q6('avg(rating)')} AS mean, count(*) AS n, {QPOL} AS polarity FROM centered_dense GROUP BY 1, 4")


def stratified_users(s, d):
    n = V.ratings(s, d).groupBy("user_id").agg(F.count("*").alias("n")).withColumn("class", prep.activity_class(F.col("n")))
    return ranked(n, "class", [(F.col("user_id") * 7919) % 100003, "user_id"], 77).select("user_id", "n", "class")


reg("stratified_users", stratified_users, "SELECT user_id, n, class FROM (SELECT *, row_number() OVER (PARTITION BY class ORDER BY (user_id * 7919) % 100003, user_id) AS k FROM (SELECT user_id, count(*) AS n, CASE WHEN count(*) < 10 THEN 'under 10' WHEN count(*) < 50 THEN '10-49' WHEN count(*) < 100 THEN '50-99' WHEN count(*) < 200 THEN '100-199' ELSE '200 and more' END AS class FROM ratings GROUP BY 1)) WHERE k <= 77")
reg("sample_users", lambda s, d: V.ratings(s, d).select("user_id").distinct().orderBy((F.col("user_id") * 7919) % 100003, "user_id").limit(50), "SELECT user_id FROM (SELECT DISTINCT user_id FROM ratings) ORDER BY (user_id * 7919) % 100003, user_id LIMIT 50")

# --- profiles ------------------------------------------------------------------------------------------------------

reg("user_activity", lambda s, d: V.ratings(s, d).groupBy("user_id").agg(F.count("rating").alias("n")), "SELECT user_id, count(rating) AS n FROM ratings GROUP BY 1")
for _n, _k in (("user_rating_stats", "user_id"), ("item_rating_stats", "item_id")):
    reg(_n, lambda s, d, k=_k: V.ratings(s, d).groupBy(k).agg(F.count("*").alias("n"), r6(F.avg("rating")).alias("mean")), f"SELECT {_k}, count(*) AS n, {q6('avg(rating)')} AS mean FROM ratings GROUP BY 1")
reg("user_activity_buckets", lambda s, d: V.ratings(s, d).groupBy("user_id").agg(F.count("*").alias("n")).groupBy(F.floor(F.col("n") / 10).cast(L).alias("bucket")).agg(F.count("*").alias("users")), "SELECT CAST(floor(n / 10) AS BIGINT) AS bucket, count(*) AS users FROM (SELECT user_id, count(*) AS n FROM ratings GROUP BY 1) GROUP BY 1")
reg("rating_hist", lambda s, d: V.ratings(s, d).groupBy(F.least(F.floor(F.round("rating", 9)), F.lit(9)).cast(L).alias("bin")).agg(F.count("*").alias("n")), "SELECT CAST(least(floor(round(rating, 9)), 9) AS BIGINT) AS bin, count(*) AS n FROM ratings GROUP BY 1")
reg("activity_by_year", lambda s, d: V.table(s, d, "orders").groupBy(F.year("o_orderdate").cast(L).alias("year")).agg(F.count("o_orderkey").alias("n")), "SELECT year(o_orderdate) AS year, count(o_orderkey) AS n FROM orders GROUP BY 1")
reg("activity_by_month", lambda s, d: V.table(s, d, "events").groupBy(F.year("ts").cast(L).alias("year"), F.month("ts").cast(L).alias("month")).agg(F.count("event_id").alias("n")), "SELECT year(ts) AS year, month(ts) AS month, count(event_id) AS n FROM events GROUP BY 1, 2")

UA = f"(SELECT user_id, count(*) AS n, {q6('avg(rating)')} AS mean FROM ratings GROUP BY 1)"


def _users(s, d):
    return V.ratings(s, d).groupBy("user_id").agg(F.count("*").alias("n"), r6(F.avg("rating")).alias("mean"))


reg("most_active_users", lambda s, d: _users(s, d).orderBy(F.desc("n"), "user_id").limit(10), f"SELECT * FROM {UA} ORDER BY n DESC, user_id LIMIT 10")
reg("top_rated_users", lambda s, d: _users(s, d).where("n >= 5").orderBy(F.desc("mean"), "user_id").limit(10), f"SELECT * FROM {UA} WHERE n >= 5 ORDER BY mean DESC, user_id LIMIT 10")
reg("bottom_rated_users", lambda s, d: _users(s, d).where("n >= 5").orderBy("mean", "user_id").limit(10), f"SELECT * FROM {UA} WHERE n >= 5 ORDER BY mean, user_id LIMIT 10")
reg("top_items", lambda s, d: V.ratings(s, d).groupBy("item_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "item_id").limit(12), "SELECT item_id, count(*) AS n FROM ratings GROUP BY 1 ORDER BY n DESC, item_id LIMIT 12")
reg("distinct_counts", lambda s, d: V.ratings(s, d).agg(F.count_distinct("user_id").alias("n_users"), F.count_distinct("item_id").alias("n_items"), F.count("*").alias("n_rows")), "SELECT count(DISTINCT user_id) AS n_users, count(DISTINCT item_id) AS n_items, count(*) AS n_rows FROM ratings")

# --- joins, sets, shapes -------------------------------------------------------------------------------------------


def join_left(s, d):
    return V.table(s, d, "documents").select("doc_id", "source").join(V.table(s, d, "labels").select("doc_id", "quality"), "doc_id", "left").select("doc_id", "source", F.col("quality").cast(L).alias("quality"))


reg("join_left", join_left, "SELECT d.doc_id, source, CAST(quality AS BIGINT) AS quality FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")


def join_right(s, d):
    lab = V.table(s, d, "labels").where("quality = 0").select("doc_id", F.lit("low").alias("note"))
    return lab.join(V.table(s, d, "documents").select("doc_id", "lang"), "doc_id", "right").fillna("", ["note"])


reg("join_right", join_right, "SELECT d.doc_id, coalesce(l.note, '') AS note, d.lang FROM (SELECT doc_id, 'low' AS note FROM labels WHERE quality = 0) l RIGHT JOIN documents d ON d.doc_id = l.doc_id")
_top = (lambda s, d, desc: V.ratings(s, d).where(F.round("rating", 6) >= 8 if desc else F.round("rating", 6) <= 2).select("item_id").distinct())
reg("setop_intersect", lambda s, d: _top(s, d, True).intersect(_top(s, d, False)), "SELECT item_id FROM ratings WHERE round(rating, 6) >= 8 INTERSECT SELECT item_id FROM ratings WHERE round(rating, 6) <= 2")
reg("setop_except", lambda s, d: V.ratings(s, d).select("user_id").distinct().join(V.ratings(s, d).where(F.round("rating", 6) >= 10).select("user_id").distinct(), "user_id", "left_anti"), "SELECT user_id FROM ratings EXCEPT SELECT user_id FROM ratings WHERE round(rating, 6) >= 10")
STATS = ["mean", "min", "max"]
reg("metrics_unpivot", lambda s, d: V.ratings(s, d).groupBy("user_id").agg(r6(F.avg("rating")).alias("mean"), r6(F.min("rating")).alias("min"), r6(F.max("rating")).alias("max")).unpivot("user_id", STATS, "metric", "value"), " UNION ALL ".join(f"SELECT user_id, '{m}' AS metric, {q6(('avg' if m == 'mean' else m) + '(rating)')} AS value FROM ratings GROUP BY 1" for m in STATS))


def metric_minmax(s, d):
    m = V.ratings(s, d).groupBy("item_id").agg(F.avg("rating").alias("mean"))
    b = m.agg(F.min("mean").alias("lo"), F.max("mean").alias("hi"))
    return m.crossJoin(F.broadcast(b)).select("item_id", r6(F.coalesce(F.try_divide(F.col("mean") - F.col("lo"), F.col("hi") - F.col("lo")), F.lit(0.0))).alias("scaled"))


reg("metric_minmax", metric_minmax, f"SELECT item_id, {q6('coalesce((mean - min(mean) OVER ()) / nullif(max(mean) OVER () - min(mean) OVER (), 0), 0)')} AS scaled FROM (SELECT item_id, avg(rating) AS mean FROM ratings GROUP BY 1)")
reg("metric_quartiles", lambda s, d: V.ratings(s, d).groupBy("user_id").agg(*[r6(F.percentile("rating", q)).alias(n) for n, q in (("q1", 0.25), ("median", 0.5), ("q3", 0.75))]), f"SELECT user_id, {q6('quantile_cont(rating, 0.25)')} AS q1, {q6('quantile_cont(rating, 0.5)')} AS median, {q6('quantile_cont(rating, 0.75)')} AS q3 FROM ratings GROUP BY 1")

# --- distances -----------------------------------------------------------------------------------------------------

reg("cos_pairs", lambda s, d: S.cosine_pairs(V.ratings_dense(s, d), shown=True), f"SELECT u, v, n, {q6('dist')} AS dist FROM cos_both WHERE u < v")
reg("cos_pairs_centered", lambda s, d: S.cosine_pairs(cen(s, d), "centered", shown=True), f"SELECT u, v, n, {q6('cdist')} AS dist FROM cos_both WHERE u < v")
reg("eucl_pairs", lambda s, d: S.euclidean_pairs(V.ratings_dense(s, d), shown=True), f"SELECT u, v, n, {q6('edist')} AS dist FROM cos_both WHERE u < v")
reg("cos_pairs_activity", lambda s, d: S.cosine_pairs(V.ratings_dense(s, d), activity=True, shown=True), f"SELECT u, v, n, {q6('dist * least(mu_, mv_) / greatest(mu_, mv_)')} AS dist FROM cos_both WHERE u < v")

_knn = (lambda df: df.select("u", "v", "rank", r6("dist").alias("dist")))
reg("knn_cos", lambda s, d: _knn(S.knn_cosine(V.ratings_dense(s, d), K)), f"SELECT u, v, rank, {q6('dist')} AS dist FROM knn")
reg("knn_eucl", lambda s, d: _knn(S.knn_euclidean(V.ratings_dense(s, d), K)), f"SELECT u, v, rank, {q6('edist')} AS dist FROM (SELECT *, row_number() OVER (PARTITION BY u ORDER BY edist, v) AS rank FROM cos_both) WHERE rank <= {K}")
reg("neighbor_cdf", lambda s, d: S.cdf(S.mirrored(S.euclidean_pairs(V.ratings_dense(s, d))), 1, 11), "SELECT x, count(u) AS n FROM (SELECT unnest(range(0, 11)) AS x) LEFT JOIN (SELECT u, edist FROM cos_both WHERE u = 1) ON edist <= x GROUP BY 1")
_bin = (lambda c: f"(round_even({c}, 2) + 0.0)")
reg("dist_hist_knn", lambda s, d: S.histogram(S.knn_cosine(V.ratings_dense(s, d), K)), f"SELECT u, {_bin('dist')} AS bin, count(*) AS n FROM knn GROUP BY 1, 2")
reg("dist_hist_all", lambda s, d: S.histogram_cosine(V.ratings_dense(s, d)), f"SELECT u, {_bin('dist')} AS bin, count(*) AS n FROM all_pairs GROUP BY 1, 2")

# --- predictions ---------------------------------------------------------------------------------------------------


def knn_c(s, d):
    return S.knn_cosine(cen(s, d), K, "centered")


def pred(s, d):
    return P.by_mean(knn_c(s, d), V.ratings_dense(s, d))


_p = (lambda df: df.select("user_id", "item_id", r6("pred").alias("pred")))
reg("knn_predict", lambda s, d: pred(s, d).select("user_id", "item_id", r6("pred").alias("pred"), "n"), f"SELECT user_id, item_id, {q6('pred')} AS pred, n FROM pred_mean")
reg("knn_predict_wdist", lambda s, d: _p(P.by_distance(knn_c(s, d), V.ratings_dense(s, d))), f"SELECT user_id, item_id, {q6('pred')} AS pred FROM (SELECT u AS user_id, item_id, sum(w * rating) / nullif(sum(w), 0) AS pred FROM (SELECT *, coalesce(1 / nullif(dist, 0), 0) AS w FROM knn_centered) JOIN ratings_dense r ON r.user_id = v GROUP BY 1, 2) WHERE pred IS NOT NULL")
reg("knn_predict_wcount", lambda s, d: _p(P.by_activity(knn_c(s, d), V.ratings_dense(s, d), cen(s, d))), f"SELECT p.user_id, item_id, {q6('off + mean')} AS pred FROM (SELECT u AS user_id, item_id, sum(m * centered) / sum(m) AS off FROM knn_centered JOIN centered_dense c ON c.user_id = v JOIN norms n ON n.user_id = v GROUP BY 1, 2) p JOIN (SELECT user_id, avg(rating) AS mean FROM ratings_dense GROUP BY 1) m ON m.user_id = p.user_id")
UNSEEN = "SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY round(pred, 9) DESC, item_id) AS rank FROM pred_mean p WHERE NOT EXISTS (SELECT 1 FROM ratings_dense r WHERE r.user_id = p.user_id AND r.item_id = p.item_id)"
reg("recommend_topn", lambda s, d: P.recommend(P.unseen(pred(s, d), V.ratings_dense(s, d)), 5).select("user_id", "item_id", "rank", r6("pred").alias("pred")), f"SELECT user_id, item_id, rank, {q6('pred')} AS pred FROM ({UNSEEN}) WHERE rank <= 5")

# --- evaluation ----------------------------------------------------------------------------------------------------

reg("split_global", lambda s, d: prep.split_global(V.ratings_dense(s, d)).select("user_id", "item_id", "hidden"), "SELECT user_id, item_id, hidden FROM split_all")
reg("split_per_user", lambda s, d: prep.split_per_user(V.ratings_dense(s, d)).select("user_id", "item_id", "hidden"), "SELECT user_id, item_id, hidden FROM split_user")


def own_errors(s, d, users="true"):
    split = prep.split_per_user(V.ratings_dense(s, d))
    return P.errors(split.where("hidden").where(users), P.by_mean(P.own_hidden_knn(split, K, users), split))


reg("knn_eval_user", lambda s, d: own_errors(s, d).groupBy("user_id").agg(r6(F.sum(F.pow("err", F.lit(2.0)))).alias("se"), r6(F.sum(F.abs("err"))).alias("ae"), F.count("*").alias("n")), f"SELECT user_id, {q6('sum(err * err)')} AS se, {q6('sum(abs(err))')} AS ae, count(*) AS n FROM own_err GROUP BY 1")
reg("knn_eval_per_user", lambda s, d: own_errors(s, d).groupBy("user_id").agg(r6(P.rmse()).alias("rmse"), r6(P.mae()).alias("mae")), f"SELECT user_id, {q6('sqrt(avg(err * err))')} AS rmse, {q6('avg(abs(err))')} AS mae FROM own_err GROUP BY 1")


def knn_eval_full(s, d):
    split = prep.split_global(V.ratings_dense(s, d))
    train, hidden = split.where("NOT hidden").drop("hidden"), split.where("hidden")
    e = P.errors(hidden, P.by_mean(S.knn_cosine(train, K), train))
    return e.agg(r6(P.rmse()).alias("rmse"), r6(P.mae()).alias("mae"), F.count("*").alias("n")).crossJoin(hidden.agg(F.count("*").alias("n_hidden")))


reg("knn_eval_full", knn_eval_full, f"""WITH tr AS (SELECT * FROM split_all WHERE NOT hidden), nn AS (SELECT user_id, sqrt(sum(rating * rating)) AS norm FROM tr GROUP BY 1),
pp AS (SELECT a.user_id AS u, b.user_id AS v, sum(a.rating * b.rating) AS dot FROM tr a JOIN tr b ON a.item_id = b.item_id AND a.user_id <> b.user_id GROUP BY 1, 2),
rk AS (SELECT x.user_id AS u, y.user_id AS v, row_number() OVER (PARTITION BY x.user_id ORDER BY coalesce(round(1 - dot / nullif(x.norm * y.norm, 0), 9), 1.0), y.user_id) AS rank FROM nn x JOIN nn y ON x.user_id <> y.user_id LEFT JOIN pp ON pp.u = x.user_id AND pp.v = y.user_id),
pd AS (SELECT u AS user_id, item_id, avg(rating) AS pred FROM rk JOIN tr r ON r.user_id = v WHERE rank <= {K} GROUP BY 1, 2),
er AS (SELECT h.rating - pd.pred AS err FROM split_all h JOIN pd ON pd.user_id = h.user_id AND pd.item_id = h.item_id WHERE h.hidden)
SELECT {q6('sqrt(avg(err * err))')} AS rmse, {q6('avg(abs(err))')} AS mae, count(*) AS n, (SELECT count(*) FROM split_all WHERE hidden) AS n_hidden FROM er""")


def knn_k_sweep(s, d):
    split = prep.split_per_user(V.ratings_dense(s, d))
    return P.sweep(P.own_hidden_knn(split, 20), split, split.where("hidden"), [5, 10, 20]).select("k", "type", r6("value").alias("value"))


_sw = "SELECT k, sqrt(avg(err * err)) AS rmse, avg(abs(err)) AS mae FROM (SELECT k, h.rating - p.pred AS err FROM split_user h JOIN (SELECT k, u AS user_id, item_id, avg(rating) AS pred FROM (SELECT unnest([5, 10, 20]) AS k) JOIN own_ranked ON rank <= k JOIN ratings_dense r ON r.user_id = v GROUP BY 1, 2, 3) p ON p.user_id = h.user_id AND p.item_id = h.item_id WHERE h.hidden) GROUP BY 1"
reg("knn_k_sweep", knn_k_sweep, f"WITH sw AS ({_sw}) SELECT CAST(k AS BIGINT) AS k, 'RMSE' AS type, {q6('rmse')} AS value FROM sw UNION ALL SELECT CAST(k AS BIGINT), 'MAE', {q6('mae')} FROM sw")

# --- comparison groups ---------------------------------------------------------------------------------------------


def well(s, d, users="true"):
    return own_errors(s, d, users).where(F.abs(F.round("err", 9)) < 2)


WELL = "SELECT * FROM own_err WHERE abs(round(err, 9)) < 2"
reg("well_predicted", lambda s, d: well(s, d).select("user_id", "item_id", r6("err").alias("err")), f"SELECT user_id, item_id, {q6('err')} AS err FROM ({WELL})")


def raters(s, d, users="true"):
    """Raters of each well-predicted item, other than the user, with their distance; both among users that a condition keeps."""
    split = prep.split_per_user(V.ratings_dense(s, d))
    some = split.where(users)
    dist = S.cosine_pairs(some, left=some.where("NOT hidden")).select(F.col("u").alias("user_id"), "v", "dist")
    who = some.select(F.col("user_id").alias("v"), "item_id")
    near = well(s, d, users).select("user_id", "item_id").join(who, "item_id").where("user_id <> v")
    return near.join(dist, ["user_id", "v"], "left").withColumn("dist", F.coalesce("dist", F.lit(1.0)))


RATERS = f"SELECT w.user_id, w.item_id, s.user_id AS v, o.dist FROM ({WELL}) w JOIN split_user s ON s.item_id = w.item_id AND s.user_id <> w.user_id JOIN own_ranked o ON o.u = w.user_id AND o.v = s.user_id"


def _by_distance(distant):
    """Five raters of each well-predicted item by distance; those of one block of users are ranked where distances are made."""
    return lambda s, d: S.chosen(well(s, d), P.left_over(prep.split_per_user(V.ratings_dense(s, d))), 5, distant, "kept").select("user_id", "item_id", "v", "rank")


def _by_order(s, d):
    """Five raters of each well-predicted item in the repeatable order, which is the same for all users: the item's first six, less the user."""
    first = ranked(V.ratings_dense(s, d).select(F.col("user_id").alias("v"), "item_id").where("v IS NOT NULL"), "item_id", [shuffled("v", "item_id"), "v"], 6, "place")
    near = well(s, d).select("user_id", "item_id").join(first, "item_id").where("user_id <> v")
    return ranked(near, ["user_id", "item_id"], ["place"], 5).select("user_id", "item_id", "v", "rank")


for _n, _b, _q in (
    ("choose_users_similar", _by_distance(False), "dist, v"),
    ("choose_users_random", _by_order, "(v * 7919 + item_id * 104729) % 100003, v"),
    ("choose_users_distant", _by_distance(True), "dist DESC, v"),
):
    reg(_n, _b, f"SELECT user_id, item_id, v, rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id, item_id ORDER BY {_q}) AS rank FROM ({RATERS})) WHERE rank <= 5")
reg("raters_by_similarity", lambda s, d: ranked(raters(s, d), ["user_id", "item_id"], ["dist", "v"]).select("user_id", "item_id", "v", "rank", r6("dist").alias("dist")), f"SELECT user_id, item_id, v, rank, {q6('dist')} AS dist FROM (SELECT *, row_number() OVER (PARTITION BY user_id, item_id ORDER BY dist, v) AS rank FROM ({RATERS}))")
reg("sim_raters_per_item", lambda s, d: P.neighbour_ratings(S.knn_cosine(V.ratings_dense(s, d), K), V.ratings_dense(s, d)).groupBy(F.col("u").alias("user_id"), "item_id").agg(F.count("*").alias("n")), "SELECT u AS user_id, item_id, count(*) AS n FROM knn JOIN ratings_dense r ON r.user_id = v GROUP BY 1, 2")
reg("posneg_pred", lambda s, d: pred(s, d).join(V.ratings_dense(s, d).groupBy("user_id").agg(F.avg("rating").alias("mean")), "user_id").select("user_id", "item_id", F.when(r6("pred") > r6("mean"), "positive").otherwise("negative").alias("polarity")), "SELECT p.user_id, item_id, CASE WHEN round(pred + 2.3e-10, 6) > round(mean + 2.3e-10, 6) THEN 'positive' ELSE 'negative' END AS polarity FROM pred_mean p JOIN (SELECT user_id, avg(rating) AS mean FROM ratings_dense GROUP BY 1) m ON m.user_id = p.user_id")
