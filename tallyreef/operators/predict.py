"""Rating prediction from neighbours, recommendation and hide-and-predict evaluation."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import blocks as B
from . import similarity as S
from .base import ranked


def neighbour_ratings(knn: DataFrame, r: DataFrame) -> DataFrame:
    """(u, v, rank, dist, item_id, rating) of every item that a neighbour rated."""
    return knn.join(r.select(F.col("user_id").alias("v"), "item_id", "rating"), "v")


#: Stands for a null item while ratings are packed.
NO_ITEM = -(2**63)


class _Means:
    """(user_id, item_id, pred, n) of a block of users with their neighbours, once all blocks of ratings were met."""

    def __init__(self):
        self.users, self.found = None, []

    def meet(self, a, b):
        self.users = a.owners
        _, i, j = np.intersect1d(a.keys, b.owners, assume_unique=True, return_indices=True)
        place = np.full(len(a.keys), -1)
        place[i] = j
        v = place[a.codes]
        u, near, v = a.row[v >= 0], a.xs[v >= 0], v[v >= 0]
        size = b.edges[v + 1] - b.edges[v]
        at = np.arange(int(size.sum())) + np.repeat(b.edges[v] - (np.cumsum(size) - size), size)
        if len(at):
            self.found.append(self._summed(np.repeat(u, size), b.keys[b.codes[at]], *self._parts(b.xs[at], np.repeat(near, size))))
        return ()

    def _parts(self, x, near):
        """What is summed of ratings x of neighbours whose value is near."""
        known = ~np.isnan(x)
        return np.where(known, x, 0.0), known.astype(np.int64), np.ones(len(x), dtype=np.int64)

    @staticmethod
    def _summed(u, item, *parts):
        """Sums of parts, once for each user and item."""
        order = np.lexsort((item, u))
        u, item = u[order], item[order]
        begin = np.flatnonzero(np.append(True, (u[1:] != u[:-1]) | (item[1:] != item[:-1])))
        return (u[begin], item[begin], *(np.add.reduceat(x[order], begin) for x in parts))

    def done(self):
        if self.found:
            u, item, x, known, n = self._summed(*(np.concatenate(y) for y in zip(*self.found, strict=True)))
            pred = np.divide(x, known, out=np.full(len(x), np.nan), where=known > 0)
            for some in np.array_split(np.arange(len(u)), -(-len(u) // 500_000)):
                yield pd.DataFrame({"user_id": self.users[u[some]], "item_id": item[some], "pred": pred[some], "n": n[some]})


class _Sweep(_Means):
    """(user_id, item_id, k, pred) of a block of users with their neighbours' ranks, for each number k of neighbours."""

    def __init__(self, ks):
        super().__init__()
        self.ks = ks

    def _parts(self, x, near):
        return [y for k in self.ks for y in (np.where(near <= k, x, 0.0), (near <= k).astype(np.int64))]

    def done(self):
        if self.found:
            u, item, *parts = self._summed(*(np.concatenate(y) for y in zip(*self.found, strict=True)))
            for k, x, n in zip(self.ks, parts[::2], parts[1::2], strict=True):
                has = np.flatnonzero(n)
                for some in np.array_split(has, -(-len(has) // 500_000) or 1):
                    yield pd.DataFrame({"user_id": self.users[u[some]], "item_id": item[some], "k": k, "pred": x[some] / n[some]})


def by_mean(knn: DataFrame, r: DataFrame) -> DataFrame:
    """(user_id, item_id, pred, n): mean of the neighbours' ratings and their number, null ratings among it.

    Neighbours and ratings by blocks: no row is shuffled for each rating of each neighbour.
    """
    u, i = knn.schema["u"].dataType.simpleString(), r.schema["item_id"].dataType.simpleString()
    if i != "bigint":
        return neighbour_ratings(knn, r).groupBy(F.col("u").alias("user_id"), "item_id").agg(F.avg("rating").alias("pred"), F.count("*").alias("n"))
    near = B.packed(knn.select("u", "v", F.lit(1.0).alias("x")), "u", "v", "x", B.n_partitions(r))
    rated = B.packed(r.select("user_id", F.coalesce("item_id", F.lit(NO_ITEM)).alias("item_id"), "rating"), "user_id", "item_id", "rating", 1, nulls=True)
    out = B.crossed(near, rated, _Means, f"user_id {u}, item_id {i}, pred double, n long")
    return out.select("user_id", F.nullif("item_id", F.lit(NO_ITEM)).alias("item_id"), F.nanvl("pred", F.lit(None).cast("double")).alias("pred"), "n")


def by_distance(knn: DataFrame, r: DataFrame) -> DataFrame:
    """Mean weighted by one over the distance; a distance of 0 weighs 0, and items of such neighbours alone have no prediction."""
    w = F.coalesce(F.try_divide(F.lit(1.0), F.col("dist")), F.lit(0.0))
    out = neighbour_ratings(knn, r).withColumn("w", w).groupBy(F.col("u").alias("user_id"), "item_id").agg(F.try_divide(F.sum(F.col("w") * F.col("rating")), F.sum("w")).alias("pred"))
    return out.where("pred IS NOT NULL")


def by_activity(knn: DataFrame, r: DataFrame, centered: DataFrame) -> DataFrame:
    """Centred ratings weighted by the neighbour's number of ratings, with the user's own mean added back."""
    n = r.groupBy(F.col("user_id").alias("v")).agg(F.count("*").alias("m"))
    mean = r.groupBy("user_id").agg(F.avg("rating").alias("mean"))
    rows = knn.join(centered.select(F.col("user_id").alias("v"), "item_id", "centered"), "v").join(n, "v")
    out = rows.groupBy(F.col("u").alias("user_id"), "item_id").agg((F.sum(F.col("m") * F.col("centered")) / F.sum("m")).alias("off"))
    return out.join(mean, "user_id").select("user_id", "item_id", (F.col("off") + F.col("mean")).alias("pred"))


def unseen(pred: DataFrame, r: DataFrame) -> DataFrame:
    return pred.join(r.select("user_id", "item_id"), ["user_id", "item_id"], "left_anti")


def recommend(pred: DataFrame, n: int) -> DataFrame:
    """The n items of the best prediction of each user, ties by item."""
    return ranked(pred.withColumn("pred", F.round("pred", 9)), "user_id", [F.desc("pred"), "item_id"], n)


def errors(hidden: DataFrame, pred: DataFrame) -> DataFrame:
    """Hidden ratings that could be predicted, with the error."""
    return hidden.select("user_id", "item_id", "rating").join(pred, ["user_id", "item_id"]).withColumn("err", F.col("rating") - F.col("pred"))


def rmse(e: str = "err") -> Column:
    return F.sqrt(F.avg(F.pow(F.col(e), F.lit(2.0))))


def mae(e: str = "err") -> Column:
    return F.avg(F.abs(F.col(e)))


def left_over(split: DataFrame) -> DataFrame:
    """split with what is left of ratings: null where they are hidden, so that no user is lost."""
    return split.withColumn("kept", F.when(~F.col("hidden"), F.col("rating")))


def own_hidden_knn(split: DataFrame, k: int, users: str = "true") -> DataFrame:
    """Neighbours of each user, or of some, by what is left of its own ratings, against all ratings of the others."""
    return S.knn_cosine(split, k, left=left_over(split).where(users), left_value="kept")


def sweep(knn: DataFrame, r: DataFrame, hidden: DataFrame, ks: list[int]) -> DataFrame:
    """(k, type, value): RMSE and MAE for each number of neighbours, from one ranking, by blocks as by_mean()."""
    u, i = knn.schema["u"].dataType.simpleString(), r.schema["item_id"].dataType.simpleString()
    near = B.packed(knn.select("u", "v", F.col("rank").cast("double").alias("x")), "u", "v", "x", B.n_partitions(r))
    pred = B.crossed(near, B.packed(r, "user_id", "item_id", "rating", 1), lambda: _Sweep(ks), f"user_id {u}, item_id {i}, k long, pred double")
    out = errors(hidden, pred).groupBy("k").agg(rmse().alias("RMSE"), mae().alias("MAE"))
    return out.unpivot("k", ["RMSE", "MAE"], "type", "value")
