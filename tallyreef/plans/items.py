"""Queries on items, tags and clusters."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import maths as M
from ..functions import strings as X
from ..operators import clusters as C
from ..operators import tags as G
from ..operators.base import r6, ranked
from ..sources import views as V
from .registry import register
from .sqlviews import r6 as q6
from .sqlviews import sql

L = "long"


def reg(name, build, query=None):
    register(name, build, sql(query) if query else None)


tg = V.item_tags

# --- cleaning ------------------------------------------------------------------------------------------------------

_f = lambda: [a.alias(n) for n, a in zip(("f0", "f1", "f2"), X.split_fields(F.replace(F.col("tags"), F.lit("Brand#11"), F.lit("~")), 3), strict=True)]
reg("clean_extra", lambda s, d: V.items(s, d).select("item_id", *_f()), "SELECT item_id, " + ", ".join(f"nullif(string_split(replace(tags, 'Brand#11', '~'), '|')[{k + 1}], '~') AS f{k}" for k in range(3)) + " FROM items")
_n = lambda: F.col("cluster").cast("string")
_range = lambda: F.when(F.col("item_id") % 5 == 0, F.concat(F.lit("jusqu'à "), _n())).when(F.col("item_id") % 5 == 1, F.concat(F.lit("à partir de "), _n())).when(F.col("item_id") % 5 == 2, _n()).when(F.col("item_id") % 5 == 3, F.concat(_n(), F.lit(" à 40"))).otherwise(F.concat(_n(), F.lit(" ans et +")))
reg("parse_range", lambda s, d: V.items(s, d).select("item_id", X.parse_range(_range()).alias("r")).select("item_id", "r.lo", "r.hi"), "SELECT item_id, CAST(CASE item_id % 5 WHEN 0 THEN 1 ELSE cluster END AS BIGINT) AS lo, CAST(CASE item_id % 5 WHEN 0 THEN nullif(cluster, 0) WHEN 1 THEN NULL WHEN 2 THEN nullif(cluster, 0) WHEN 3 THEN 40 ELSE 99 END AS BIGINT) AS hi FROM items")
reg("digit_sep", lambda s, d: V.items(s, d).select("item_id", M.leading_digit(F.col("item_id")).alias("x")).select("item_id", "x.lead", "x.rest"), "SELECT item_id, CAST(left(CAST(item_id AS VARCHAR), 1) AS BIGINT) AS lead, CAST('0' || substr(CAST(item_id AS VARCHAR), 2) AS BIGINT) AS rest FROM items")
reg("range_display", lambda s, d: V.items(s, d).select("item_id", X.range_display(F.nullif("cluster", F.lit(7)), F.nullif(F.col("cluster") + 3, F.lit(9)), 18).alias("players")), "SELECT item_id, CASE WHEN cluster = 7 THEN '-' WHEN cluster + 3 = 9 OR cluster + 3 > 18 THEN cluster || '+' ELSE cluster || '-' || (cluster + 3) END AS players FROM items")
reg("tag_display", lambda s, d: V.items(s, d).select("item_id", X.first_tags(F.col("tags")).alias("type")), "SELECT item_id, array_to_string(string_split(tags, '|')[1:2], ', ') AS type FROM items")
reg("user_label", lambda s, d: V.table(s, d, "customer").select(F.col("c_custkey").alias("user_id"), F.format_string("%s (%d)", "c_name", "c_custkey").alias("label")), "SELECT c_custkey AS user_id, c_name || ' (' || c_custkey || ')' AS label FROM customer")
reg("hex_rgb", lambda s, d: V.items(s, d).select("item_id", M.hex_rgb(F.concat(F.lit("#"), F.lpad(F.lower(F.hex(F.col("item_id") * 7919 % 16777216)), 6, "0"))).alias("rgb")), "SELECT item_id, [CAST((item_id * 7919 % 16777216) // 65536 AS BIGINT), CAST((item_id * 7919 % 16777216) // 256 % 256 AS BIGINT), CAST(item_id * 7919 % 256 AS BIGINT)] AS rgb FROM items")
_zip = lambda: F.explode(F.arrays_zip(F.split("tags", r"\|").alias("tag"), F.sequence(F.lit(1), F.size(F.split("tags", r"\|"))).alias("pos")))
reg("zip_explode", lambda s, d: V.items(s, d).select("item_id", _zip().alias("z")).select("item_id", "z.tag", F.col("z.pos").cast(L).alias("pos")), "SELECT item_id, unnest(string_split(tags, '|')) AS tag, unnest(range(1, len(string_split(tags, '|')) + 1)) AS pos FROM items")
#: Themes of the explorer and the clusters of each.
THEMES = {
    "🧩🕵️ Logique & Déduction": [22, 23],
    "🏗️🏰 Construction & expansion": [0, 19],
    "🧠⚡ Rapide & Tactique": [14, 20],
    "📚⏳ Longs & complexes": [2, 9, 13, 25, 29],
    "💎🃏 Collecte": [1, 17, 26],
    "🪖💣 Guerre": [5],
    "🏛️🎲 Eurogames": [15, 16],
    "🌍🏺 Civilisation": [12, 18, 21],
    "🗡️🚩 Capture territoire": [3, 11, 27],
    "🌅🖼️ Superbes visuels": [4, 8],
    "🐉📜 Culture | Fantaisie": [6, 7, 28],
    "👎 Coups de blues": [10],
    "🏆 Coups de coeurs": [24],
}
THEME_OF = {c: t for t, cs in THEMES.items() for c in cs}
_theme_sql = "CASE cluster " + " ".join(f"WHEN {c} THEN '{t}'" for c, t in THEME_OF.items()) + " END"
theme = lambda: F.get(F.array(*[F.lit(THEME_OF[c]) for c in range(30)]), F.col("cluster"))
reg("theme_recode", lambda s, d: V.items(s, d).select("item_id", theme().alias("theme")), f"SELECT item_id, {_theme_sql} AS theme FROM items")
reg("tag_counts", lambda s, d: tg(s, d).groupBy("tag").agg(F.count("*").alias("n")), "SELECT tag, count(*) AS n FROM item_tags GROUP BY 1")
reg("tag_counts_with_null", lambda s, d: V.comments(s, d).groupBy("polarity").agg(F.count("*").alias("n")), "SELECT polarity, count(*) AS n FROM comments GROUP BY 1")
reg("dup_names", lambda s, d: V.items(s, d).groupBy("name").agg(F.count("*").alias("n")).where("n > 1"), "SELECT name, count(*) AS n FROM items GROUP BY 1 HAVING count(*) > 1")
reg("null_profile", lambda s, d: V.phrases(s, d).agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in ("phrase_id", "cluster", "embedding", "phrase")]), "SELECT " + ", ".join(f"count(*) FILTER ({c} IS NULL) AS {c}" for c in ("phrase_id", "cluster", "embedding", "phrase")) + " FROM phrases")

# --- tags ----------------------------------------------------------------------------------------------------------

reg("tag_explode", lambda s, d: tg(s, d).select("item_id", "tag"), "SELECT item_id, tag FROM item_tags")
TOP5 = ["STANDARD", "SMALL", "MEDIUM", "LARGE", "ECONOMY"]
reg("item_tag_onehot", lambda s, d: V.items(s, d).select("item_id", F.explode(F.split(F.regexp_replace("tags", r"\|| ", "|"), r"\|")).alias("tag")).groupBy("item_id").pivot("tag", TOP5).count().fillna(0), "SELECT item_id, " + ", ".join(f"count(*) FILTER (tag = '{t}') AS {t}" for t in TOP5) + " FROM (SELECT item_id, unnest(string_split(replace(tags, ' ', '|'), '|')) AS tag FROM items) GROUP BY 1")


def user_tag_profile(s, d):
    """Counts of a user's tags, scaled between the least (0 where a tag is missing) and the greatest, then to sum 1."""
    t = tg(s, d)
    n = V.ratings(s, d).select("user_id", "item_id").join(t, "item_id").groupBy("user_id", "tag").agg(F.count("*").alias("n"))
    total = t.agg(F.count_distinct("tag").alias("all_"))
    w = Window.partitionBy("user_id")
    low = F.when(F.count("*").over(w) < F.col("all_"), F.lit(0)).otherwise(F.min("n").over(w))
    scaled = n.crossJoin(F.broadcast(total)).withColumn("x", F.coalesce(F.try_divide(F.col("n") - low, F.max("n").over(w) - low), F.lit(0.0)))
    return scaled.select("user_id", "tag", r6(F.coalesce(F.try_divide(F.col("x"), F.sum("x").over(w)), F.lit(0.0))).alias("share"))


reg("user_tag_profile", user_tag_profile, f"""WITH n AS (SELECT user_id, tag, count(*) AS n FROM ratings r JOIN item_tags t ON t.item_id = r.item_id GROUP BY 1, 2),
b AS (SELECT *, CASE WHEN count(*) OVER w < (SELECT count(DISTINCT tag) FROM item_tags) THEN 0 ELSE min(n) OVER w END AS lo, max(n) OVER w AS hi FROM n WINDOW w AS (PARTITION BY user_id)),
x AS (SELECT user_id, tag, coalesce((n - lo) / nullif(hi - lo, 0), 0) AS x FROM b)
SELECT user_id, tag, {q6('coalesce(x / nullif(sum(x) OVER (PARTITION BY user_id), 0), 0)')} AS share FROM x""")
reg("item_tag_idf_like", lambda s, d: tg(s, d).select("item_id", "tag", r6(1.0 / F.count("*").over(Window.partitionBy("tag"))).alias("weight")), f"SELECT item_id, tag, {q6('1.0 / count(*) OVER (PARTITION BY tag)')} AS weight FROM item_tags")
reg("tag_share", lambda s, d: G.cluster_counts(tg(s, d)).select("cluster", "tag", r6(F.col("n") / F.sum("n").over(Window.partitionBy("cluster"))).alias("share")), f"SELECT cluster, tag, {q6('count(*) / sum(count(*)) OVER (PARTITION BY cluster)')} AS share FROM item_tags GROUP BY 1, 2")
reg("tag_freq_min", lambda s, d: tg(s, d).groupBy("tag").agg(F.count("*").alias("n")).where("n >= 20"), "SELECT tag, count(*) AS n FROM item_tags GROUP BY 1 HAVING count(*) >= 20")


def tag_substring_counts(s, d):
    t = tg(s, d).select("tag").distinct()
    return V.items(s, d).join(F.broadcast(t), F.contains(F.lower("tags"), F.lower("tag"))).groupBy("tag").agg(F.count("*").alias("n"))


reg("tag_substring_counts", tag_substring_counts, "SELECT tag, count(*) AS n FROM items i JOIN (SELECT DISTINCT tag FROM item_tags) t ON contains(lower(i.tags), lower(t.tag)) GROUP BY 1")
_pc = "SELECT a.tag AS a, b.tag AS b, count(*) AS n FROM item_tags a JOIN item_tags b ON a.item_id = b.item_id AND a.tag < b.tag GROUP BY 1, 2"
reg("tag_pair_counts", lambda s, d: G.pair_counts(tg(s, d)), _pc)
reg("tag_cooc", lambda s, d: G.mirrored(G.pair_counts(tg(s, d))), _pc.replace("a.tag < b.tag", "a.tag <> b.tag"))


def tag_heatmap(s, d):
    top = tg(s, d).groupBy("tag").agg(F.count("*").alias("m")).orderBy(F.desc("m"), "tag").limit(20)
    return G.mirrored(G.pair_counts(tg(s, d).join(F.broadcast(top), "tag", "left_semi")))


_t20 = "(SELECT * FROM item_tags WHERE tag IN (SELECT tag FROM item_tags GROUP BY 1 ORDER BY count(*) DESC, tag LIMIT 20))"
reg("tag_heatmap", tag_heatmap, f"SELECT a.tag AS a, b.tag AS b, count(*) AS n FROM {_t20} a JOIN {_t20} b ON a.item_id = b.item_id AND a.tag <> b.tag GROUP BY 1, 2")
reg("item_cooc", lambda s, d: G.item_pairs(tg(s, d)), "SELECT a.item_id AS a, b.item_id AS b, count(*) AS n FROM item_tags a JOIN item_tags b ON a.tag = b.tag AND a.item_id < b.item_id GROUP BY 1, 2")
reg("tag_cooc_norm", lambda s, d: G.normalized(tg(s, d).select("item_id", "tag"), "item_id", "tag").select("a", "b", r6("weight", 9).alias("weight")), f"WITH w AS (SELECT item_id, tag, 1.0 / count(*) OVER (PARTITION BY tag) AS w FROM item_tags) SELECT a.tag AS a, b.tag AS b, {q6('sum(a.w * b.w)', 9)} AS weight FROM w a JOIN w b ON a.item_id = b.item_id AND a.tag < b.tag GROUP BY 1, 2")
reg("item_cooc_norm", lambda s, d: G.item_pairs(tg(s, d), weighted=True), f"WITH w AS (SELECT item_id, tag, 1.0 / count(*) OVER (PARTITION BY item_id) AS w FROM item_tags) SELECT a.item_id AS a, b.item_id AS b, {q6('sum(a.w * b.w)')} AS weight FROM w a JOIN w b ON a.tag = b.tag AND a.item_id < b.item_id GROUP BY 1, 2")
reg("tag_jaccard", lambda s, d: G.jaccard(tg(s, d)).select("a", "b", r6("jaccard").alias("jaccard")), f"WITH k AS (SELECT * FROM item_tags WHERE tag NOT IN (SELECT tag FROM item_tags GROUP BY 1 ORDER BY count(*) DESC, tag LIMIT 3)), m AS (SELECT tag, count(*) AS m FROM k GROUP BY 1), p AS (SELECT a.tag AS a, b.tag AS b, count(*) AS n FROM k a JOIN k b ON a.item_id = b.item_id AND a.tag < b.tag GROUP BY 1, 2) SELECT a, b, {q6('n / (x.m + y.m - n)')} AS jaccard FROM p JOIN m x ON x.tag = a JOIN m y ON y.tag = b")
CT = "(SELECT cluster, tag, count(*) AS n FROM item_tags GROUP BY 1, 2)"
reg("cluster_tag_freq", lambda s, d: G.cluster_counts(tg(s, d)), f"SELECT * FROM {CT}")
reg("cluster_top_tags", lambda s, d: G.top_per_cluster(G.cluster_counts(tg(s, d)), 5), f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY n DESC, tag) AS rank FROM {CT}) WHERE rank <= 5")
reg("cluster_label_tag", lambda s, d: G.cluster_counts(tg(s, d)).groupBy("cluster").agg(F.min_by("tag", F.struct(-F.col("n"), F.col("tag"))).alias("tag")), f"SELECT cluster, tag FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY n DESC, tag) AS rank FROM {CT}) WHERE rank = 1")


def cluster_tag_weighted(s, d):
    """Tags of a cluster weighted by one over the item's distance in price to the cluster's mean."""
    i = V.items(s, d).select("item_id", "price", F.avg("price").over(Window.partitionBy("cluster")).alias("m"))
    w = tg(s, d).join(i, "item_id").withColumn("w", 1 / (F.abs(F.col("price") - F.col("m")) + 1e-6))
    n = w.groupBy("cluster", "tag").agg(F.sum("w").alias("w"))
    return n.select("cluster", "tag", r6(F.col("w") / F.sum("w").over(Window.partitionBy("cluster")), 5).alias("share"))


reg("cluster_tag_weighted", cluster_tag_weighted, f"SELECT cluster, tag, {q6('sum(w) / sum(sum(w)) OVER (PARTITION BY cluster)', 5)} AS share FROM (SELECT t.cluster, tag, 1 / (abs(price - m) + 1e-6) AS w FROM item_tags t JOIN (SELECT item_id, price, avg(price) OVER (PARTITION BY cluster) AS m FROM items) i ON i.item_id = t.item_id) GROUP BY 1, 2")


def cluster_tag_presence(s, d):
    """Frequent tags inside a cluster, without the ten most popular tags overall."""
    n = tg(s, d).groupBy("tag").agg(F.count("*").alias("m")).orderBy(F.desc("m"), "tag").limit(10)
    c = G.cluster_counts(tg(s, d).join(F.broadcast(n), "tag", "left_anti"))
    share = c.withColumn("share", r6(F.col("n") / F.sum("n").over(Window.partitionBy("cluster"))))
    return ranked(share, "cluster", [F.desc("n"), "tag"], 20)


reg("cluster_tag_presence", cluster_tag_presence, f"SELECT * FROM (SELECT cluster, tag, n, {q6('n / sum(n) OVER (PARTITION BY cluster)')} AS share, row_number() OVER (PARTITION BY cluster ORDER BY n DESC, tag) AS rank FROM {CT} WHERE tag NOT IN (SELECT tag FROM item_tags GROUP BY 1 ORDER BY count(*) DESC, tag LIMIT 10)) WHERE rank <= 20")

# --- clusters of vectors -------------------------------------------------------------------------------------------

ph = V.phrases
CEN = "(SELECT cluster, list(m ORDER BY p) AS center FROM (SELECT cluster, p, avg(x) AS m FROM (SELECT cluster, unnest(range(1, len(embedding) + 1)) AS p, CAST(unnest(embedding) AS DOUBLE) AS x FROM phrases) GROUP BY 1, 2) GROUP BY 1)"
DIST = f"(SELECT f.*, round(list_distance(CAST(f.embedding AS DOUBLE[]), c.center), 9) AS dist FROM phrases f JOIN {CEN} c ON c.cluster = f.cluster)"
reg("centroid", lambda s, d: C.centroids(ph(s, d), "cluster").select("cluster", F.posexplode("center").alias("p", "m")).select("cluster", (F.col("p") + 1).cast(L).alias("p"), r6("m").alias("m")), f"SELECT cluster, p, {q6('avg(x)')} AS m FROM (SELECT cluster, unnest(range(1, len(embedding) + 1)) AS p, CAST(unnest(embedding) AS DOUBLE) AS x FROM phrases) GROUP BY 1, 2")
reg("cluster_quality", lambda s, d: C.quality(ph(s, d), 1.0).select("cluster", r6("mean_dist").alias("mean_dist"), "n"), f"SELECT cluster, {q6('avg(dist)')} AS mean_dist, count(*) AS n FROM {DIST} GROUP BY 1 HAVING avg(dist) < 1.0")
ENT = "SELECT cluster, -sum(p * ln(p)) AS weight FROM (SELECT cluster, count(*) / sum(count(*)) OVER (PARTITION BY cluster) AS p FROM {src} GROUP BY cluster, user_id) GROUP BY 1"
reg("cluster_entropy", lambda s, d: C.entropy(ph(s, d)).select("cluster", r6("weight").alias("weight")), f"SELECT cluster, {q6('weight')} AS weight FROM ({ENT.format(src='phrases')})")
reg("cluster_count_weight", lambda s, d: ph(s, d).groupBy("cluster").agg(F.count("phrase").alias("weight")), "SELECT cluster, count(phrase) AS weight FROM phrases GROUP BY 1")


def hide_comments(s, d):
    """Weights of clusters before and after the phrases of user 3 on even items are hidden."""
    p = ph(s, d)
    left = p.join(p.where("user_id = 3 AND item_id % 2 = 0").select("phrase_id"), "phrase_id", "left_anti")
    return C.entropy(p).withColumnRenamed("weight", "before").join(C.entropy(left).withColumnRenamed("weight", "after"), "cluster", "left").select("cluster", r6("before").alias("before"), r6("after").alias("after"))


reg("hide_comments", hide_comments, f"SELECT a.cluster, {q6('a.weight')} AS before, {q6('b.weight')} AS after FROM ({ENT.format(src='phrases')}) a LEFT JOIN ({ENT.format(src='(SELECT * FROM phrases WHERE NOT (user_id = 3 AND item_id % 2 = 0))')}) b ON b.cluster = a.cluster")


def cluster_rating_stats(s, d):
    i = V.items(s, d).select("item_id", "cluster", "price")
    r = V.ratings(s, d).join(i, "item_id")
    return r.groupBy("cluster").agg(F.count_distinct("item_id").alias("n_items"), r6(F.avg("rating")).alias("mean"), r6(F.stddev_samp("rating")).alias("std"))


reg("cluster_rating_stats", cluster_rating_stats, f"SELECT cluster, count(DISTINCT r.item_id) AS n_items, {q6('avg(rating)')} AS mean, {q6('stddev_samp(rating)')} AS std FROM ratings r JOIN items i ON i.item_id = r.item_id GROUP BY 1")


def _vec(f):
    def build(s, d):
        p = ph(s, d)
        one = p.where("phrase_id = 0").select(F.col("embedding").alias("e0"))
        return p.crossJoin(F.broadcast(one)).select("phrase_id", r6(f(F.col("embedding"), F.col("e0"))).alias("dist"))

    return build


_c = "CAST({} AS DOUBLE[])"
reg("vec_cosine", _vec(M.cosine_distance), f"SELECT p.phrase_id, {q6('1 - list_cosine_similarity(' + _c.format('p.embedding') + ', ' + _c.format('q.embedding') + ')')} AS dist FROM phrases p, phrases q WHERE q.phrase_id = 0")
reg("vec_euclid", _vec(M.euclidean), f"SELECT p.phrase_id, {q6('list_distance(' + _c.format('p.embedding') + ', ' + _c.format('q.embedding') + ')')} AS dist FROM phrases p, phrases q WHERE q.phrase_id = 0")
reg("near_center", lambda s, d: C.with_distance(ph(s, d)).withColumn("lo", F.min("dist").over(Window.partitionBy("cluster"))).where(F.col("dist") <= 1.25 * F.col("lo")).select("cluster", "phrase_id", r6("dist").alias("dist")), f"SELECT cluster, phrase_id, {q6('dist')} AS dist FROM (SELECT *, min(dist) OVER (PARTITION BY cluster) AS lo FROM {DIST}) WHERE dist <= 1.25 * lo")
reg("medoid_like", lambda s, d: ranked(C.with_distance(ph(s, d)), "cluster", ["dist", "phrase_id"], 1).select("cluster", "phrase_id", r6("dist").alias("dist")), f"SELECT cluster, phrase_id, {q6('dist')} AS dist FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY dist, phrase_id) AS k FROM {DIST}) WHERE k = 1")


def centroid_separation(s, d):
    c = C.centroids(ph(s, d), "cluster")
    a, b = c.select(F.col("cluster").alias("a"), F.col("center").alias("x")), c.select(F.col("cluster").alias("b"), F.col("center").alias("y"))
    return a.join(F.broadcast(b), F.col("a") < F.col("b")).select("a", "b", r6(M.euclidean(F.col("x"), F.col("y"))).alias("dist"))


reg("centroid_separation", centroid_separation, f"SELECT a.cluster AS a, b.cluster AS b, {q6('list_distance(a.center, b.center)')} AS dist FROM {CEN} a JOIN {CEN} b ON a.cluster < b.cluster")
reg("silhouette", lambda s, d: C.silhouette(ph(s, d), "phrase_id").select("phrase_id", "cluster", r6("silhouette").alias("silhouette")), f"""WITH m AS (SELECT a.phrase_id AS i, a.cluster AS ci, b.cluster AS cj, avg(list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))) AS d FROM phrases a JOIN phrases b ON a.phrase_id <> b.phrase_id GROUP BY 1, 2, 3),
s AS (SELECT i, ci, min(d) FILTER (ci = cj) AS a, min(d) FILTER (ci <> cj) AS b FROM m GROUP BY 1, 2) SELECT i AS phrase_id, ci AS cluster, {q6('coalesce((b - a) / greatest(a, b), 0)')} AS silhouette FROM s""")
