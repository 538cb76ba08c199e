"""Queries behind the explorer, explanations from phrases, and models."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import maths as M
from ..functions import strings as X
from ..operators import clusters as C
from ..operators import factor as A
from ..operators import predict as P
from ..operators import text as T
from ..operators.base import r6, ranked
from ..sources import views as V
from .items import CEN, DIST, THEMES
from .items import theme as theme_col
from .recommender import RATERS, UNSEEN, pred, raters
from .registry import register
from .sqlviews import r6 as q6
from .sqlviews import sql

L = "long"


def reg(name, build, query=None):
    register(name, build, sql(query) if query else None)


ph = V.phrases

# --- layout and points ---------------------------------------------------------------------------------------------

#: Clusters of the embeddings' labels that are laid out together.
GROUPS = {0: 0, 1: 0, 2: 1, 3: 1, 4: 1, 5: 2, 6: 2}


def points(s, d):
    v = F.transform(F.slice("embedding", 1, 3), lambda x: x.cast("double") * 100)
    return ph(s, d).select("phrase_id", "cluster", v.alias("v"))


PTS = "(SELECT phrase_id, cluster, CAST(embedding[1] AS DOUBLE) * 100 AS x, CAST(embedding[2] AS DOUBLE) * 100 AS y, CAST(embedding[3] AS DOUBLE) * 100 AS z FROM phrases)"
_xyz = lambda: [F.col("v")[k].alias(c) for k, c in enumerate("xyz")]
reg("push_points", lambda s, d: C.pushed(points(s, d), GROUPS).select("phrase_id", "cluster", *_xyz()).select("phrase_id", "cluster", *[r6(c, 5).alias(c) for c in "xyz"]), f"""WITH g AS (SELECT * FROM (VALUES {', '.join(str(x) for x in GROUPS.items())}) t(cluster, grp)),
c AS (SELECT p.cluster, grp, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM {PTS} p JOIN g ON g.cluster = p.cluster GROUP BY 1, 2),
m AS (SELECT c.cluster, c.x - avg(c.x) OVER w AS dx, c.y - avg(c.y) OVER w AS dy, c.z - avg(c.z) OVER w AS dz FROM c WINDOW w AS (PARTITION BY grp)),
u AS (SELECT *, nullif(sqrt(dx * dx + dy * dy + dz * dz), 0) AS len FROM m)
SELECT p.phrase_id, p.cluster, {q6('x + coalesce(dx / len, 0) * 20', 5)} AS x, {q6('y + coalesce(dy / len, 0) * 20', 5)} AS y, {q6('z + coalesce(dz / len, 0) * 20', 5)} AS z FROM {PTS} p LEFT JOIN u ON u.cluster = p.cluster""")
_extent = "greatest(max(x) - min(x), max(y) - min(y), max(z) - min(z))"
reg("app_zoom", lambda s, d: points(s, d).select("cluster", *_xyz()).groupBy("cluster").agg(F.expr(_extent).alias("extent")).select("cluster", r6(M.zoom(F.col("extent"))).alias("zoom")), f"SELECT cluster, {q6('CASE WHEN extent = 0 THEN 16 ELSE greatest(least(log2(350 / extent), 5), 0) END')} AS zoom FROM (SELECT cluster, {_extent} AS extent FROM {PTS} GROUP BY 1)")
reg("app_point_size", lambda s, d: ph(s, d).groupBy("cluster").agg((F.count("*") * 6).alias("n")).select("cluster", r6(M.point_size(F.col("n"))).alias("size")), f"SELECT cluster, {q6('2.5 + (600 - greatest(150, least(count(*) * 6, 600))) / 450.0 * 2')} AS size FROM phrases GROUP BY 1")
_one = list(THEMES)[3]
reg("app_theme_points", lambda s, d: V.items(s, d).where(F.col("cluster").isin(THEMES[_one])).select("item_id", "cluster", "name"), f"SELECT item_id, cluster, name FROM items WHERE cluster IN ({', '.join(map(str, THEMES[_one]))})")
reg("app_cluster_view", lambda s, d: points(s, d).select("cluster", *_xyz()).groupBy("cluster").agg(*[r6(F.avg(c), 5).alias(c) for c in "xyz"], F.count("*").alias("n")), f"SELECT cluster, {', '.join(f'{q6(f'avg({c})', 5)} AS {c}' for c in 'xyz')}, count(*) AS n FROM {PTS} GROUP BY 1")
reg("app_item_card", lambda s, d: V.items(s, d).join(V.comments(s, d).where("polarity = 'positive'").groupBy(F.col("item_id").alias("i")).agg(F.min("review_id").alias("summary")), F.col("item_id") == F.col("i"), "left").select("item_id", "name", X.first_tags(F.col("tags")).alias("type"), theme_col().alias("theme"), "summary"), "SELECT i.item_id, name, array_to_string(string_split(tags, '|')[1:2], ', ') AS type, CASE cluster " + " ".join(f"WHEN {c} THEN '{t}'" for t, cs in THEMES.items() for c in cs) + " END AS theme, s.summary FROM items i LEFT JOIN (SELECT item_id, min(review_id) AS summary FROM comments WHERE polarity = 'positive' GROUP BY 1) s ON s.item_id = i.item_id")

# --- scores --------------------------------------------------------------------------------------------------------

reg("score_display", lambda s, d: pred(s, d).select("user_id", "item_id", r6(M.stored_score(F.col("pred"))).alias("stored")).select("user_id", "item_id", "stored", (M.shown_score(F.col("stored")) + 0.0).alias("shown")), f"SELECT user_id, item_id, stored, round_even(greatest(least(stored * 8 + 2, 10.0), 0.0), 1) + 0.0 AS shown FROM (SELECT user_id, item_id, {q6('greatest(least(pred - 2, 10.0), 0.0) / 8')} AS stored FROM pred_mean)")


def app_colors(s, d):
    """Colour of each item for a user: blue where rated, pink where recommended, else red to green by prediction."""
    p = M.clip(r6(M.stored_score(F.col("pred"))), 0.0, 1.0)
    rated = V.ratings_dense(s, d).select("user_id", "item_id", F.lit(None).cast("double").alias("pred"), F.lit(True).alias("rated"))
    # predictions and ratings of a user come together once, for both windows
    both = pred(s, d).select("user_id", "item_id", "pred", F.lit(None).cast("boolean").alias("rated")).withColumn("asked", F.lit(True)).unionByName(rated, allowMissingColumns=True).repartition("user_id")
    own = both.withColumn("rated", F.when(F.col("item_id").isNotNull(), F.max("rated").over(Window.partitionBy("user_id", "item_id")))).where("asked")
    best = F.row_number().over(Window.partitionBy("user_id", F.col("rated").isNull()).orderBy(F.desc(F.round("pred", 9)), "item_id"))
    rgb = (lambda *x: F.array(*[F.lit(c).cast(L) for c in x]))
    color = F.when(F.col("rated"), rgb(0, 0, 255)).when(F.col("best") <= 5, rgb(255, 105, 180)).otherwise(M.rating_rgb(p))
    return own.withColumn("best", best).select("user_id", "item_id", color.alias("color"))


reg("app_colors", app_colors, f"""WITH t AS (SELECT user_id, item_id FROM ({UNSEEN}) WHERE rank <= 5), p AS (SELECT user_id, item_id, greatest(least({q6('greatest(least(pred - 2, 10.0), 0.0) / 8')}, 1.0), 0.0) AS p FROM pred_mean)
SELECT p.user_id, p.item_id, CASE WHEN r.item_id IS NOT NULL THEN [0, 0, 255] WHEN t.item_id IS NOT NULL THEN [255, 105, 180] ELSE [CAST(trunc(255 * (1 - p)) AS INT), CAST(trunc(255 * p) AS INT), 0] END AS color FROM p LEFT JOIN ratings_dense r ON r.user_id = p.user_id AND r.item_id = p.item_id LEFT JOIN t ON t.user_id = p.user_id AND t.item_id = p.item_id""")
reg("user_item_lists", lambda s, d: V.ratings_dense(s, d).groupBy("user_id").agg(F.array_sort(F.collect_list("item_id")).alias("items")), "SELECT user_id, list(item_id ORDER BY item_id) AS items FROM ratings_dense GROUP BY 1")


def build_items_info(s, d):
    mean = V.ratings(s, d).groupBy("item_id").agg(r6(F.avg("rating")).alias("rating"))
    i = V.items(s, d).join(mean, "item_id")
    return i.select("item_id", (F.dense_rank().over(Window.orderBy("item_id")) - 1).cast(L).alias("item_index"), "name", X.first_tags(F.col("tags")).alias("type"), X.range_display(F.col("cluster"), F.col("cluster") + 5, 25).alias("age"), "cluster", "rating")


reg("build_items_info", build_items_info, f"SELECT i.item_id, dense_rank() OVER (ORDER BY i.item_id) - 1 AS item_index, name, array_to_string(string_split(tags, '|')[1:2], ', ') AS type, CASE WHEN cluster + 5 > 25 THEN cluster || '+' ELSE cluster || '-' || (cluster + 5) END AS age, cluster, r.rating FROM items i JOIN (SELECT item_id, {q6('avg(rating)')} AS rating FROM ratings GROUP BY 1) r ON r.item_id = i.item_id")


def build_users_info(s, d):
    top = P.recommend(P.unseen(pred(s, d), V.ratings_dense(s, d)), 5).groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "item_id"))), lambda x: x["item_id"]).alias("top"))
    rated = V.ratings_dense(s, d).groupBy("user_id").agg(F.array_sort(F.collect_list("item_id")).alias("rated"))
    return rated.join(top, "user_id").select("user_id", (F.dense_rank().over(Window.orderBy("user_id")) - 1).cast(L).alias("user_index"), "rated", "top")


reg("build_users_info", build_users_info, f"WITH t AS (SELECT user_id, list(item_id ORDER BY rank) AS top FROM ({UNSEEN}) WHERE rank <= 5 GROUP BY 1), r AS (SELECT user_id, list(item_id ORDER BY item_id) AS rated FROM ratings_dense GROUP BY 1) SELECT r.user_id, dense_rank() OVER (ORDER BY r.user_id) - 1 AS user_index, rated, top FROM r JOIN t ON t.user_id = r.user_id")

# --- explanations --------------------------------------------------------------------------------------------------


def item_clusters(s, d):
    """Clusters of an item's phrases with their overall weight (entropy over users)."""
    p = ph(s, d).select("item_id", "cluster").distinct()
    return p.join(C.entropy(ph(s, d)).withColumn("weight", r6("weight")), "cluster")


ENT = f"(SELECT cluster, {q6('-sum(p * ln(p))')} AS weight FROM (SELECT cluster, count(*) / sum(count(*)) OVER (PARTITION BY cluster) AS p FROM phrases GROUP BY cluster, user_id) GROUP BY 1)"
ICL = f"(SELECT DISTINCT f.item_id, f.cluster, e.weight FROM phrases f JOIN {ENT} e ON e.cluster = f.cluster)"


def _selected(s, d):
    return C.head_and_tail(item_clusters(s, d), ["item_id"], "weight", "cluster", over=6, each=3)


SEL = f"(SELECT item_id, cluster, weight, n_ FROM (SELECT *, count(*) OVER (PARTITION BY item_id) AS n_, row_number() OVER (PARTITION BY item_id ORDER BY weight DESC, cluster) AS h, row_number() OVER (PARTITION BY item_id ORDER BY weight, cluster DESC) AS t FROM {ICL}) WHERE n_ <= 6 OR h <= 3 OR t <= 3)"
reg("phrase_cluster_select", lambda s, d: _selected(s, d).select("item_id", "cluster", "weight"), f"SELECT item_id, cluster, weight FROM {SEL}")


def find_phrases(s, d):
    """For each selected cluster of an item: the phrases of the whole cluster nearest to the mean of the item's own."""
    own = ph(s, d).join(_selected(s, d).select("item_id", "cluster"), ["item_id", "cluster"], "left_semi")
    c = C.centroids(own, ["item_id", "cluster"])
    return C.nearest_phrases(c, ph(s, d), ["item_id"], 2).select("item_id", "cluster", "phrase_id", "rank", r6("dist").alias("dist"))


ICEN = f"(SELECT item_id, cluster, list(m ORDER BY p) AS center FROM (SELECT item_id, cluster, p, avg(x) AS m FROM (SELECT f.item_id, f.cluster, unnest(range(1, len(embedding) + 1)) AS p, CAST(unnest(embedding) AS DOUBLE) AS x FROM phrases f JOIN {SEL} s ON s.item_id = f.item_id AND s.cluster = f.cluster) GROUP BY 1, 2, 3) GROUP BY 1, 2)"
FND = f"(SELECT * FROM (SELECT c.item_id, c.cluster, f.phrase_id, round(1 - list_cosine_similarity(CAST(f.embedding AS DOUBLE[]), c.center), 9) AS dist, row_number() OVER (PARTITION BY c.item_id, c.cluster ORDER BY round(1 - list_cosine_similarity(CAST(f.embedding AS DOUBLE[]), c.center), 9), f.phrase_id) AS rank FROM {ICEN} c JOIN phrases f ON f.cluster = c.cluster) WHERE rank <= 2)"
reg("find_phrases", find_phrases, f"SELECT item_id, cluster, phrase_id, rank, {q6('dist')} AS dist FROM {FND}")


def describe_cluster(s, d):
    """Most frequent bigrams of the texts nearest to each cluster's centre."""
    near = ranked(C.with_distance(ph(s, d)), "cluster", ["dist", "phrase_id"], 10).where("phrase IS NOT NULL").select("cluster", F.col("phrase_id").alias("review_id"))
    g = T.bigrams(V.lemmas(s, d).select("review_id", "pos", "lemma").join(near.select("review_id"), "review_id", "left_semi")).join(near, "review_id")
    n = g.groupBy("cluster", F.col("gram").alias("term")).agg(F.count("*").alias("n"))
    return T.top_terms(n, ["cluster"], 10)


NEAR = f"(SELECT cluster, phrase_id, phrase FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY dist, phrase_id) AS k FROM {DIST}) WHERE k <= 10 AND phrase IS NOT NULL)"
_gram = "(SELECT * FROM (SELECT review_id, lemma || ' ' || lead(lemma) OVER (PARTITION BY review_id ORDER BY pos) AS gram FROM lemmas) WHERE gram IS NOT NULL)"
reg("describe_cluster", describe_cluster, f"SELECT * FROM (SELECT cluster, gram AS term, count(*) AS n, row_number() OVER (PARTITION BY cluster ORDER BY count(*) DESC, gram) AS rank FROM {_gram} g JOIN {NEAR} n ON n.phrase_id = g.review_id GROUP BY 1, 2) WHERE rank <= 10")


def group_scores(s, d):
    """Clipped bigram recall of what similar, random and distant raters say of an item, against the user's own comments.

    Raters' comments are those of the review table's users on its items (ids modulo 15 and 20, as in comments).
    """
    base = raters(s, d, "user_id < 15").where("item_id < 20")
    keys = ["user_id", "item_id"]
    w = Window.partitionBy(*keys)
    orders = {"similar": ["dist", "v"], "random": [(F.col("v") * 7919 + F.col("item_id") * 104729) % 100003, "v"], "distant": [F.desc("dist"), "v"]}
    kinds = F.array_compact(F.array(*[F.when(F.row_number().over(w.orderBy(*o)) <= 3, F.lit(k)) for k, o in orders.items()]))
    chosen = base.withColumn("kinds", kinds).select(*keys, "v", F.explode("kinds").alias("type"))
    # terms are dealt out once, by item and term, for their counts and for the terms that two users of an item have in common
    terms = V.comment_bigrams(s, d).repartition("item_id", "gram").groupBy("user_id", "item_id", "gram").agg(F.count("*").alias("n"))
    total = terms.groupBy("user_id", "item_id").agg(F.sum("n").alias("n"))
    met = terms.withColumnRenamed("n", "nr").join(terms.select(F.col("user_id").alias("v"), "item_id", "gram", F.col("n").alias("np")), ["item_id", "gram"])
    groups = [*keys, "type"]
    common = met.join(chosen, [*keys, "v"]).groupBy(*groups, "gram").agg(F.sum("np").alias("np"), F.first("nr").alias("nr")).groupBy(*groups).agg(F.sum(F.least("np", "nr")).alias("common"))
    said = chosen.join(total.select(F.col("user_id").alias("v"), "item_id", "n"), ["v", "item_id"], "left").groupBy(*groups).agg(F.sum("n").alias("n_pred"))
    found = said.join(total.withColumnRenamed("n", "n_ref"), keys, "left").join(common, groups, "left").where("n_pred IS NOT NULL OR n_ref IS NOT NULL")
    return found.select(*groups, *[F.coalesce(c, F.lit(0)).alias(c) for c in ("common", "n_pred", "n_ref")])


_orders = {"similar": "dist, v", "random": "(v * 7919 + item_id * 104729) % 100003, v", "distant": "dist DESC, v"}
GSC = f"""WITH b AS (SELECT * FROM ({RATERS}) WHERE user_id < 15 AND v < 15 AND item_id < 20),
ch AS ({' UNION ALL '.join(f"SELECT user_id, item_id, v, '{k}' AS type FROM (SELECT *, row_number() OVER (PARTITION BY user_id, item_id ORDER BY {o}) AS k FROM b) WHERE k <= 3" for k, o in _orders.items())}),
tm AS (SELECT user_id AS w, item_id, gram AS term, count(*) AS n FROM (SELECT user_id, item_id, lemma || ' ' || lead(lemma) OVER (PARTITION BY review_id ORDER BY pos) AS gram FROM lemmas) WHERE gram IS NOT NULL GROUP BY 1, 2, 3),
sa AS (SELECT ch.user_id, ch.item_id, type, term, sum(n) AS n FROM ch JOIN tm ON tm.w = ch.v AND tm.item_id = ch.item_id GROUP BY 1, 2, 3, 4),
ow AS (SELECT c.user_id, c.item_id, type, term, n FROM (SELECT DISTINCT user_id, item_id, type FROM ch) c JOIN tm ON tm.w = c.user_id AND tm.item_id = c.item_id),
sc AS (SELECT coalesce(s.user_id, o.user_id) AS user_id, coalesce(s.item_id, o.item_id) AS item_id, coalesce(s.type, o.type) AS type, CAST(sum(least(coalesce(s.n, 0), coalesce(o.n, 0))) AS BIGINT) AS common, CAST(sum(coalesce(s.n, 0)) AS BIGINT) AS n_pred, CAST(sum(coalesce(o.n, 0)) AS BIGINT) AS n_ref FROM sa s FULL JOIN ow o ON o.user_id = s.user_id AND o.item_id = s.item_id AND o.type = s.type AND o.term = s.term GROUP BY 1, 2, 3)"""
REC, PRE = "coalesce(common * 100.0 / nullif(n_ref, 0), 0)", "coalesce(common * 100.0 / nullif(n_pred, 0), 0)"
reg("explain_eval", lambda s, d: group_scores(s, d).select("user_id", "item_id", "type", r6(T.recall()).alias("rouge2"), r6(T.precision()).alias("precision2")), f"{GSC} SELECT user_id, item_id, type, {q6(REC)} AS rouge2, {q6(PRE)} AS precision2 FROM sc")
reg("explain_rouge_groups", lambda s, d: group_scores(s, d).withColumn("r", T.recall()).groupBy("user_id", "type").agg(r6(F.avg("r")).alias("rouge2"), F.count("*").alias("n")), f"{GSC} SELECT user_id, type, {q6(f'avg({REC})')} AS rouge2, count(*) AS n FROM sc GROUP BY 1, 2")
reg("score_group_means", lambda s, d: group_scores(s, d).withColumn("r", T.recall()).groupBy("type").agg(r6(F.avg("r")).alias("rouge2"), F.count("*").alias("n")), f"{GSC} SELECT type, {q6(f'avg({REC})')} AS rouge2, count(*) AS n FROM sc GROUP BY 1")

# --- models: rows only ---------------------------------------------------------------------------------------------

reg("als_nmf_eval", lambda s, d: A.cross_validate(V.ratings_dense(s, d), [5, 15], folds=2))
reg("als_topn", lambda s, d: A.top_items(A.als(V.ratings_dense(s, d)), V.ratings_dense(s, d), 5))
reg("factor_neighbors", lambda s, d: A.factor_neighbours(A.als(V.ratings_dense(s, d)).userFactors, 10))
reg("kmeans_clusters", lambda s, d: A.kmeans(ph(s, d), 10).select("phrase_id", "label_k", "dist"))
reg("pca_components", lambda s, d: A.pca(ph(s, d), 3)[0].select("phrase_id", "point"))
reg("gmm_clusters", lambda s, d: A.gmm(ph(s, d)).select("phrase_id", "label_g"))
