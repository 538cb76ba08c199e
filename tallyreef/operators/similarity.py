"""User-user distances, nearest neighbours and distance histograms, on rating triples."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import blocks as B
from .base import NUDGE, ranked

DIST_DIGITS = 9


def rounded(x: np.ndarray, digits: int, nudge: float = 0.0) -> np.ndarray:
    """Rounded with ties upward from zero, without negative zero."""
    return np.copysign(np.floor(np.abs(x + nudge) * 10.0**digits + 0.5) / 10.0**digits, x + nudge) + 0.0


def cosines(a: B.Block, b: B.Block, dot: np.ndarray) -> np.ndarray:
    """Cosine distances of two blocks' users; 1 where a norm is zero."""
    by = np.outer(a.norms, b.norms)
    return rounded(1 - np.divide(dot, by, out=np.zeros_like(dot), where=by != 0), DIST_DIGITS)


def roots(n: np.ndarray, sq: np.ndarray) -> np.ndarray:
    """Roots of mean squared differences."""
    return rounded(np.sqrt(np.divide(np.maximum(sq, 0.0), n, out=np.zeros_like(sq), where=n > 0)), DIST_DIGITS)


class _Pairs:
    """(u, v, n, dist) of pairs with a common item."""

    def __init__(self, kind: str, half: bool, activity: bool, shown: bool):
        self.kind, self.half, self.activity, self.shown = kind, half, activity, shown

    def meet(self, a, b):
        n, dot, sq = B.sums(a, b, self.kind == "euclidean", self.kind == "cosine")
        dist = cosines(a, b, dot) if self.kind == "cosine" else roots(n, sq)
        if self.activity:
            x, y = a.counts[:, None], b.counts[None, :]
            dist = dist * np.minimum(x, y) / np.maximum(x, y)
        if self.shown:
            dist = rounded(dist, 6, NUDGE)
        for u, v, i, j in B.met(a, b, n > 0, self.half):
            yield pd.DataFrame({"u": u, "v": v, "n": n[i, j].astype(np.int64), "dist": dist[i, j]})

    def done(self):
        return ()


class _Nearest:
    """(u, v, dist) of the k nearest in the blocks met: by cosine of all users, by roots of those with a common item."""

    #: More than rounding moves a distance: what is farther than the k-th by this is not rounded or sorted.
    SLACK = 4.0 * 10.0**-DIST_DIGITS

    def __init__(self, kind: str, k: int):
        self.kind, self.k, self.bound = kind, k, None

    def meet(self, a, b):
        n, dot, sq = B.sums(a, b, self.kind == "euclidean", self.kind == "cosine", self.kind != "cosine")
        if self.kind == "cosine":
            by = np.outer(a.norms, b.norms)
            raw = 1 - np.divide(dot, by, out=np.zeros_like(dot), where=by != 0)
        else:
            raw = np.full(n.shape, np.inf)
            np.divide(np.maximum(sq, 0.0, out=sq), n, out=raw, where=n > 0)
            np.sqrt(raw, out=raw)
        i, j = B.itself(a, b)
        raw[i, j] = np.inf
        if self.bound is None:
            self.users, self.bound = a.owners, np.full(len(a.owners), np.inf)
            self.row, self.v, self.d = np.zeros(0, dtype=np.int64), b.owners[:0], np.zeros(0)
        bound = self.bound
        open_ = np.flatnonzero(np.isinf(bound))
        if len(open_) and self.k <= raw.shape[1]:
            bound = bound.copy()
            bound[open_] = np.partition(raw[open_], self.k - 1, axis=1)[:, self.k - 1]
        i, j = np.nonzero((raw <= bound[:, None] + self.SLACK) & (raw < np.inf))
        if len(i):
            self._keep(np.append(self.row, i), np.append(self.v, b.owners[j]), np.append(self.d, rounded(raw[i, j], DIST_DIGITS)))
        return ()

    def _keep(self, row, v, d):
        """The k least of each row by distance, ties to the smaller owner."""
        order = np.lexsort((v, d, row))
        row, v, d = row[order], v[order], d[order]
        begin = np.searchsorted(row, np.arange(len(self.users)))
        some = np.arange(len(row)) - begin[row] < self.k
        self.row, self.v, self.d = row[some], v[some], d[some]
        full = np.flatnonzero(np.bincount(self.row, minlength=len(self.users)) == self.k)
        self.bound[full] = self.d[np.searchsorted(self.row, full, "right") - 1]

    def done(self):
        if self.bound is not None:
            yield pd.DataFrame({"u": self.users[self.row], "v": self.v, "dist": self.d})


def _least(dist: np.ndarray, owners: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Owners and distances of the k least of each row, ties to the owner that comes first."""
    k = min(k, dist.shape[1])
    kth = np.partition(dist, k - 1, axis=1)[:, k - 1 : k]
    i, j = np.nonzero(dist <= kth)
    d = dist[i, j]
    order = np.lexsort((j, d, i))
    i, j, d = i[order], j[order], d[order]
    begin = np.searchsorted(i, np.arange(len(dist)))
    at = begin[:, None] + np.arange(k)[None, :]
    return owners[j[at]], d[at]


def _merged(best: tuple, more: tuple, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k least of both by distance, ties to the smaller owner."""
    out = [np.concatenate([x, y], axis=1) for x, y in zip(best, more, strict=True)]
    for by in (0, 1):
        order = np.argsort(out[by], axis=1, kind="stable")
        out = [np.take_along_axis(x, order, axis=1) for x in out]
    return out[0][:, :k], out[1][:, :k]


class _Counts:
    """(u, bin, n) of all other users' cosine distances, rounded half-even to two places."""

    def __init__(self):
        self.users, self.found = None, {}

    def meet(self, a, b):
        _, dot, _ = B.sums(a, b, counts=False)
        bins = np.rint(np.rint(cosines(a, b, dot) * 10.0**DIST_DIGITS) / 10.0 ** (DIST_DIGITS - 2)).astype(np.int64)
        i, j = B.itself(a, b)
        low = int(bins.min())
        wide = int(bins.max()) - low + 1
        n = np.bincount((bins - low + np.arange(len(bins))[:, None] * wide).ravel(), minlength=len(bins) * wide).reshape(len(bins), wide)
        np.subtract.at(n, (i, bins[i, j] - low), 1)
        self.users = a.owners
        for k in np.flatnonzero(n.any(axis=0)):
            self.found[low + int(k)] = self.found.get(low + int(k), 0) + n[:, k]
        return ()

    def done(self):
        if self.found:
            bins = np.array(sorted(self.found))
            n = np.stack([self.found[x] for x in bins], axis=1)
            i, j = np.nonzero(n)
            yield pd.DataFrame({"u": self.users[i], "bin": bins[j] / 100.0, "n": n[i, j]})


class _Chosen:
    """(user_id, item_id, v, dist) of the k raters of items asked for that are nearest or, with sign -1, most distant."""

    def __init__(self, k: int, sign: float, users: np.ndarray, items: np.ndarray):
        self.k, self.sign, self.best = k, sign, None
        order = np.argsort(items, kind="stable")
        self.users, self.items = users[order], items[order]
        self.begin = np.flatnonzero(np.append(True, self.items[1:] != self.items[:-1]))
        self.end = np.append(self.begin[1:], len(order))

    def meet(self, a, b):
        _, dot, _ = B.sums(a, b, counts=False)
        dist = self.sign * cosines(a, b, dot)
        i, j = B.itself(a, b)
        dist[i, j] = np.inf
        if self.best is None:
            self.rows = np.searchsorted(a.owners, self.users)
            self.best = [None] * len(self.begin)
        # raters of each key of b, in order of user
        order = np.argsort(b.codes, kind="stable")
        edges = np.searchsorted(b.codes[order], np.arange(len(b.keys) + 1))
        known = {x: k for k, x in enumerate(b.keys.tolist())}
        for g, (lo, hi) in enumerate(zip(self.begin, self.end, strict=True)):
            k = known.get(self.items[lo : lo + 1].tolist()[0])
            if k is None:
                continue
            who = b.row[order[edges[k] : edges[k + 1]]]
            v, d = _least(dist[np.ix_(self.rows[lo:hi], who)], b.owners[who], self.k)
            self.best[g] = (v, d) if self.best[g] is None else _merged(self.best[g], (v, d), self.k)
        return ()

    def done(self):
        for g, found in enumerate(self.best or ()):
            if found is not None:
                v, d = found
                i, j = np.nonzero(np.isfinite(d))
                lo = self.begin[g]
                yield pd.DataFrame({"user_id": self.users[lo + i], "item_id": self.items[lo + i], "v": v[i, j], "dist": self.sign * d[i, j] + 0.0})


def _sides(r: DataFrame, value: str, left: DataFrame | None, left_value: str | None) -> tuple[DataFrame, DataFrame]:
    """Blocks of the users of left, or of all, and few parts of blocks of all for them to be set against."""
    a = B.packed(left if left is not None else r, "user_id", "item_id", left_value or value, B.n_partitions(r))
    return a, B.packed(r, "user_id", "item_id", value, B.AGAINST)


def _pairs(r: DataFrame, value: str, left: DataFrame | None, *how) -> DataFrame:
    u, item = (r.schema[c].dataType.simpleString() for c in ("user_id", "item_id"))
    schema = f"u {u}, v {u}, n long, dist double"
    if left is None:
        a = B.packed(r, "user_id", "item_id", value, B.side(B.n_partitions(r)))
        return B.crossed(a, a, lambda: _Pairs(how[0], True, *how[1:]), schema, half=True)
    return B.crossed(*_sides(r, value, left, None), lambda: _Pairs(how[0], False, *how[1:]), schema)


def cosine_pairs(r: DataFrame, value: str = "rating", left: DataFrame | None = None, activity: bool = False, shown: bool = False) -> DataFrame:
    """(u, v, n, dist): cosine distance of pairs with a common item; 1 where a norm is zero.

    Of all pairs u < v, or of the users of left with all others. Blocks of users meet in a Cartesian product; no pair is
    shuffled. activity multiplies by the lesser over the greater number of ratings of the two; shown rounds for display.
    """
    return _pairs(r, value, left, "cosine", activity, shown)


def euclidean_pairs(r: DataFrame, value: str = "rating", shown: bool = False) -> DataFrame:
    """(u, v, n, dist): root of the mean squared difference over common items, kept where it is 0."""
    return _pairs(r, value, None, "euclidean", False, shown)


def mirrored(pairs: DataFrame) -> DataFrame:
    """Both directions of symmetric pairs."""
    rest = [c for c in pairs.columns if c not in ("u", "v")]
    return pairs.select("u", "v", *rest).unionAll(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"), *rest))


def nearest(candidates: DataFrame, k: int) -> DataFrame:
    """(u, v, dist, rank): the k nearest by distance, ties by id."""
    return ranked(candidates.select("u", "v", "dist"), "u", ["dist", "v"], k)


def _near(r: DataFrame, k: int, value: str, kind: str, left: DataFrame | None = None, left_value: str | None = None) -> DataFrame:
    u = r.schema["user_id"].dataType.simpleString()
    return nearest(B.crossed(*_sides(r, value, left, left_value), lambda: _Nearest(kind, k), f"u {u}, v {u}, dist double"), k)


def knn_cosine(r: DataFrame, k: int, value: str = "rating", left: DataFrame | None = None, left_value: str | None = None) -> DataFrame:
    """The k nearest of all others, of whom those without a common item are at distance 1.

    Of the users of left, by its left_value, where it is given. A null value is no rating, but its user is known.
    """
    return _near(r, k, value, "cosine", left, left_value)


def knn_euclidean(r: DataFrame, k: int, value: str = "rating") -> DataFrame:
    """The k nearest of those with a common item."""
    return _near(r, k, value, "euclidean")


def chosen(asked: DataFrame, r: DataFrame, k: int, distant: bool = False, left_value: str = "rating") -> DataFrame:
    """(user_id, item_id, v, dist): the k raters nearest to the user, or most distant, of each item asked for, the user left out.

    Users of asked (user_id, item_id) are known by their left_value in r, the others by their rating. Ties go to the smaller id.
    """
    u, i = (r.schema[c].dataType.simpleString() for c in ("user_id", "item_id"))
    a, b = _sides(r, "rating", r, left_value)
    # what is asked of a block's users comes along with it
    own = a.select("block", F.explode("owners").alias("u")).join(asked.select(F.col("user_id").alias("u"), F.col("item_id").alias("i")), "u")
    lists = own.groupBy("block").agg(F.collect_list(F.struct("u", "i")).alias("l")).select("block", F.col("l.u").alias("asked_u"), F.col("l.i").alias("asked_i"))
    sign = -1.0 if distant else 1.0
    with_lists = a.join(lists, "block").repartition(B.n_partitions(r))
    found = B.crossed(with_lists, b, lambda *x: _Chosen(k, sign, *x), f"user_id {u}, item_id {i}, v {u}, dist double", extra=("asked_u", "asked_i"))
    return ranked(found, ["user_id", "item_id"], [F.desc("dist") if distant else "dist", "v"], k)


def histogram(pairs: DataFrame) -> DataFrame:
    """Users' counts of distances rounded half-even to two places."""
    return pairs.groupBy("u", (F.bround("dist", 2) + F.lit(0.0)).alias("bin")).agg(F.count("*").alias("n"))


def histogram_cosine(r: DataFrame, value: str = "rating") -> DataFrame:
    """As histogram(), over all other users: those without a common item count at distance 1, without being listed."""
    u = r.schema["user_id"].dataType.simpleString()
    return B.crossed(*_sides(r, value, None, None), _Counts, f"u {u}, bin double, n long").groupBy("u", "bin").agg(F.sum("n").alias("n"))


def histogram_all(both: DataFrame, r: DataFrame) -> DataFrame:
    """As histogram(), over all other users: those without a common item count at distance 1, without being listed."""
    users = r.select(F.col("user_id").alias("u")).distinct()
    met = both.groupBy("u").agg(F.count("*").alias("c_"))
    rest = users.join(met, "u", "left").crossJoin(F.broadcast(users.agg(F.count("*").alias("all_"))))
    rest = rest.select("u", F.lit(1.0).alias("bin"), (F.col("all_") - 1 - F.coalesce("c_", F.lit(0))).alias("n")).where("n > 0")
    return histogram(both).unionByName(rest).groupBy("u", "bin").agg(F.sum("n").alias("n"))


def cdf(pairs: DataFrame, user: int, steps: int) -> DataFrame:
    """Neighbours of one user within each whole distance from 0."""
    spark = pairs.sparkSession
    mine = pairs.where(F.col("u") == user).groupBy(F.ceil("dist").cast("long").alias("x")).agg(F.count("*").alias("c"))
    grid = spark.range(steps).select(F.col("id").alias("x"))
    out = grid.join(mine, "x", "left").withColumn("n", F.sum(F.coalesce("c", F.lit(0))).over(Window.orderBy("x")).cast("long"))
    return out.select("x", "n")
