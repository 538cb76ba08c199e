"""Matrix factorisation, clustering and projections with pyspark.ml."""

from __future__ import annotations

from pyspark.ml.clustering import GaussianMixture, KMeans
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.recommendation import ALS
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import maths as M
from .base import ranked


def als(ratings: DataFrame, rank: int = 20, reg: float = 0.1, nonnegative: bool = True, rounds: int = 10, seed: int = 42):
    """Factor model of (user_id, item_id, rating); users or items unknown to it have no prediction."""
    return ALS(rank=rank, regParam=reg, nonnegative=nonnegative, maxIter=rounds, seed=seed, userCol="user_id", itemCol="item_id", ratingCol="rating", coldStartStrategy="drop").fit(ratings)


def cross_validate(ratings: DataFrame, ranks: list[int], folds: int = 5, **options) -> DataFrame:
    """(k, fold, test_rmse, test_mae, n): folds by the repeatable order of the ids."""
    spark = ratings.sparkSession
    r = ratings.withColumn("fold", ((F.col("user_id") * 7919 + F.col("item_id") * 104729) % folds).cast("int"))
    out = []
    for k in ranks:
        for f in range(folds):
            model = als(r.where(F.col("fold") != f), rank=k, **options)
            e = model.transform(r.where(F.col("fold") == f)).withColumn("e", F.col("rating") - F.col("prediction"))
            out.append((k, f, *e.agg(F.sqrt(F.avg(F.col("e") * F.col("e"))), F.avg(F.abs("e")), F.count("*")).first()))
    return spark.createDataFrame(out, "k int, fold int, test_rmse double, test_mae double, n long")


def top_items(model, ratings: DataFrame, n: int) -> DataFrame:
    """The n best items that a user has not rated: scored in blocks by the model, with room for the rated ones."""
    most = ratings.groupBy("user_id").count().agg(F.max("count")).first()[0] or 0
    recs = model.recommendForAllUsers(int(most) + n).select("user_id", F.explode("recommendations").alias("r")).select("user_id", F.col("r.item_id").alias("item_id"), F.col("r.rating").cast("double").alias("pred"))
    unseen = recs.join(ratings.select(F.col("user_id").cast("int").alias("user_id"), F.col("item_id").cast("int").alias("item_id")), ["user_id", "item_id"], "left_anti")
    return ranked(unseen, "user_id", [F.desc("pred"), "item_id"], n)


def factor_neighbours(factors: DataFrame, k: int) -> DataFrame:
    """Rows of (id, features) nearest by cosine, without the row itself. Meant for one side's factors, in a broadcast if small."""
    a, b = factors.select(F.col("id").alias("u"), F.col("features").alias("x")), factors.select(F.col("id").alias("v"), F.col("features").alias("y"))
    d = a.join(b, F.col("u") != F.col("v")).select("u", "v", F.round(M.cosine_distance(F.col("x"), F.col("y")), 9).alias("dist"))
    return ranked(d, "u", ["dist", "v"], k)


def _vectors(df: DataFrame, column: str = "embedding") -> DataFrame:
    return df.withColumn("vec", array_to_vector(F.col(column).cast("array<double>")))


def kmeans(df: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """Rows with their cluster and the distance to its centre."""
    model = KMeans(k=k, seed=seed, featuresCol="vec", predictionCol="label_k").fit(_vectors(df))
    spark = df.sparkSession
    centers = spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())], "label_k int, center array<double>")
    out = model.transform(_vectors(df)).join(F.broadcast(centers), "label_k")
    return out.withColumn("dist", M.euclidean(F.col("embedding"), F.col("center"))).drop("vec", "center")


def kmeans_sweep(df: DataFrame, ks: list[int], seed: int = 42) -> DataFrame:
    """Inertia over rows for each number of clusters."""
    n = df.count()
    rows = [(k, KMeans(k=k, seed=seed, featuresCol="vec").fit(_vectors(df)).summary.trainingCost / max(n, 1)) for k in ks]
    return df.sparkSession.createDataFrame(rows, "k int, inertia double")


def pca(df: DataFrame, k: int = 3) -> tuple[DataFrame, list[float]]:
    """Centred rows on k principal components, and the share of variance of each."""
    v = _vectors(df)
    centred = StandardScaler(withMean=True, withStd=False, inputCol="vec", outputCol="cen").fit(v).transform(v)
    model = PCA(k=k, inputCol="cen", outputCol="pc").fit(centred)
    return model.transform(centred).withColumn("point", vector_to_array("pc")).drop("vec", "cen", "pc"), [float(x) for x in model.explainedVariance]


def gmm(df: DataFrame, k: int = 5, dims: int = 4, seed: int = 42) -> DataFrame:
    """Gaussian mixture on the first principal components."""
    points, _ = pca(df, dims)
    v = _vectors(points, "point")
    return GaussianMixture(k=k, seed=seed, maxIter=20, featuresCol="vec", predictionCol="label_g").fit(v).transform(v).drop("vec", "probability")


def ward(df: DataFrame, id_column: str, vector: str, clusters: int, most: int = 2000) -> DataFrame:
    """Ward clusters of a small table of vectors, such as tags: one task merges the nearest pair until so many are left.

    Over most rows it is refused; BisectingKMeans serves there.
    """
    import numpy as np
    import pandas as pd

    if df.count() > most:
        raise ValueError(f"over {most} rows")

    def run(pdf):
        pdf = pdf.sort_values(id_column)
        x = np.stack([np.asarray(v, dtype=float) for v in pdf[vector]])
        size, label, mean = np.ones(len(x)), np.arange(len(x)), x.copy()
        alive = list(range(len(x)))
        while len(alive) > max(clusters, 1):
            m, s = mean[alive], size[alive]
            d = ((m[:, None] - m[None]) ** 2).sum(axis=2) * (s[:, None] * s) / (s[:, None] + s)
            d[np.tril_indices(len(alive))] = np.inf
            i, j = divmod(int(d.argmin()), len(alive))
            a, b = alive[i], alive[j]
            mean[a] = (mean[a] * size[a] + mean[b] * size[b]) / (size[a] + size[b])
            size[a] += size[b]
            label[label == b] = a
            alive.pop(j)
        names = {c: k for k, c in enumerate(sorted(set(label.tolist())))}
        return pd.DataFrame({id_column: pdf[id_column], "cluster": [names[c] for c in label.tolist()]})

    return df.withColumn("one_", F.lit(0)).groupBy("one_").applyInPandas(run, f"{id_column} {df.schema[id_column].dataType.simpleString()}, cluster int")


def spectral_coclusters(df: DataFrame, row: str, column: str, value: str, clusters: int, most: int = 4_000_000) -> DataFrame:
    """Co-clusters of a small matrix in long form, from singular vectors of the normalised matrix; one task."""
    import numpy as np
    import pandas as pd

    n = df.agg(F.count_distinct(row), F.count_distinct(column)).first()
    if n[0] * n[1] > most:
        raise ValueError(f"over {most} cells")

    def run(pdf):
        m = pdf.pivot_table(index=row, columns=column, values=value, fill_value=0.0).astype(float)
        a = m.to_numpy()
        r, c = np.sqrt(np.maximum(a.sum(1), 1e-12)), np.sqrt(np.maximum(a.sum(0), 1e-12))
        u, _, vt = np.linalg.svd(a / r[:, None] / c[None], full_matrices=False)
        k = max(1, int(np.ceil(np.log2(clusters))))
        z = np.concatenate([u[:, 1 : 1 + k] / r[:, None], vt[1 : 1 + k].T / c[:, None]])
        center = z[np.random.RandomState(0).choice(len(z), min(clusters, len(z)), replace=False)]
        for _ in range(50):
            label = ((z[:, None] - center[None]) ** 2).sum(2).argmin(1)
            center = np.stack([z[label == j].mean(0) if (label == j).any() else center[j] for j in range(len(center))])
        names = [("row", str(x)) for x in m.index] + [("column", str(x)) for x in m.columns]
        return pd.DataFrame({"side": [s for s, _ in names], "name": [x for _, x in names], "cluster": label.astype("int32")})

    return df.withColumn("one_", F.lit(0)).groupBy("one_").applyInPandas(run, "side string, name string, cluster int")
