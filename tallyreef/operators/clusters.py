"""Clusters of vectors and what they say: centroids, quality, entropy, silhouettes and phrase selection."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import maths as M
from .base import ranked


def centroids(df: DataFrame, key: str | list[str], vector: str = "embedding") -> DataFrame:
    """Mean vector of each group: one partial average for each place."""
    keys = [key] if isinstance(key, str) else key
    mean = df.select(*keys, F.posexplode(vector).alias("p", "x")).groupBy(*keys, "p").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return mean.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "m"))), lambda s: s["m"]).alias("center"))


def with_distance(df: DataFrame, key: str = "cluster", vector: str = "embedding", center: DataFrame | None = None) -> DataFrame:
    """Rows with the Euclidean distance to their group's centroid."""
    c = center if center is not None else centroids(df, key, vector)
    return df.join(F.broadcast(c) if center is None else c, key).withColumn("dist", F.round(M.euclidean(F.col(vector), F.col("center")), 9)).drop("center")


def quality(df: DataFrame, most: float) -> DataFrame:
    """Clusters whose mean distance to the centroid is under most."""
    return with_distance(df).groupBy("cluster").agg(F.avg("dist").alias("mean_dist"), F.count("*").alias("n")).where(F.col("mean_dist") < most)


def entropy(phrases: DataFrame) -> DataFrame:
    """Shannon entropy, in nats, of each cluster's rows over users."""
    n = phrases.groupBy("cluster", "user_id").agg(F.count("*").alias("n"))
    p = n.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("cluster")))
    return p.groupBy("cluster").agg((-F.sum(F.col("p") * F.ln("p"))).alias("weight"))


def silhouette(df: DataFrame, id_column: str) -> DataFrame:
    """Exact silhouette of each row under Euclidean distance; 0 for the only row of a cluster. Quadratic: for samples."""
    a = df.select(F.col(id_column).alias("i"), F.col("cluster").alias("ci"), F.col("embedding").alias("x"))
    b = df.select(F.col(id_column).alias("j"), F.col("cluster").alias("cj"), F.col("embedding").alias("y"))
    m = a.crossJoin(b).where("i <> j").groupBy("i", "ci", "cj").agg(F.avg(M.euclidean(F.col("x"), F.col("y"))).alias("d"))
    s = m.groupBy("i", "ci").agg(F.min(F.when(F.col("ci") == F.col("cj"), F.col("d"))).alias("a"), F.min(F.when(F.col("ci") != F.col("cj"), F.col("d"))).alias("b"))
    return s.select(F.col("i").alias(id_column), F.col("ci").alias("cluster"), F.coalesce((F.col("b") - F.col("a")) / F.greatest("a", "b"), F.lit(0.0)).alias("silhouette"))


def head_and_tail(df: DataFrame, keys: list[str], weight: str, tie: str, over: int = 15, each: int = 8) -> DataFrame:
    """Of groups of more than over rows the each heaviest and each lightest, else all; n_ is the group's size."""
    w = Window.partitionBy(*keys)
    out = df.withColumn("n_", F.count("*").over(w)).withColumn("h_", F.row_number().over(w.orderBy(F.desc(weight), tie))).withColumn("t_", F.row_number().over(w.orderBy(F.asc(weight), F.desc(tie))))
    return out.where((F.col("n_") <= over) | (F.col("h_") <= each) | (F.col("t_") <= each)).drop("h_", "t_")


def nearest_phrases(centers: DataFrame, phrases: DataFrame, keys: list[str], n: int) -> DataFrame:
    """For each (keys, cluster) with a center, the n nearest phrases of the whole cluster."""
    j = centers.join(phrases.select("cluster", "phrase_id", "embedding"), "cluster")
    d = j.withColumn("dist", F.round(M.cosine_distance(F.col("embedding"), F.col("center")), 9)).drop("embedding", "center")
    return ranked(d, [*keys, "cluster"], ["dist", "phrase_id"], n)


def pushed(points: DataFrame, groups: dict[int, int], by: float = 20.0) -> DataFrame:
    """Points (id, cluster, v) moved by so much away from the centre of their group of clusters.

    groups: cluster -> group; other clusters stay. The centre of a group is the mean of its clusters' centroids.
    """
    spark = points.sparkSession
    g = spark.createDataFrame(list(groups.items()), "cluster int, grp int")
    c = centroids(points, "cluster", "v").join(F.broadcast(g), "cluster")
    gc = centroids(c.select("grp", F.col("center").alias("v")), "grp", "v").withColumnRenamed("center", "mid")
    d = c.join(gc, "grp").withColumn("dir", F.zip_with("center", "mid", lambda x, y: x - y)).withColumn("len", M.norm(F.col("dir")))
    move = d.select("cluster", F.transform("dir", lambda x: F.coalesce(F.try_divide(x, F.col("len")), F.lit(0.0)) * by).alias("move"))
    out = points.join(F.broadcast(move), "cluster", "left")
    return out.withColumn("v", F.when(F.col("move").isNull(), F.col("v")).otherwise(F.zip_with("v", "move", lambda x, y: x + y))).drop("move")
