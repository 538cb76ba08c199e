"""Approximate nearest neighbours by cosine: one vantage-point tree for each shard of the vectors."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _common as C


class Tree:
    """Vantage-point tree over unit vectors under Euclidean distance, which orders as cosine does.

    A node's points are halved by distance to its vantage point; each half keeps the least and greatest distance in it.
    """

    def __init__(self, points: np.ndarray, leaf: int = 48, seed: int = 7):
        self.points, self.leaf = points, leaf
        self.squares = (points**2).sum(axis=1)
        self.random = np.random.RandomState(seed)
        self.root = self._build(np.arange(len(points)))

    def _far(self, q: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Distances of queries and points."""
        square = (q**2).sum(axis=1)[:, None] + self.squares[rows] - 2 * (q @ self.points[rows].T)
        return np.sqrt(np.maximum(square, 0.0))

    def _build(self, rows: np.ndarray):
        if len(rows) <= self.leaf:
            return rows
        tries = self.random.choice(rows, size=min(5, len(rows)), replace=False)
        some = self.random.choice(rows, size=min(200, len(rows)), replace=False)
        vantage = tries[self._far(self.points[tries], some).std(axis=1).argmax()]
        far = self._far(self.points[[vantage]], rows)[0]
        order = np.argsort(far, kind="stable")
        half = len(rows) // 2
        sides = []
        for part in (order[:half], order[half:]):
            sides.append((float(far[part].min()), float(far[part].max()), self._build(rows[part])))
        return self.points[vantage], sides

    def nearest(self, queries: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray]:
        """(distances, points) of the k nearest found of each query, -1 where there are fewer.

        A half is left out when factor times the least distance that the triangle inequality allows in it is over the k-th
        distance so far. Factor 1 is exact; more looks at fewer points. All queries go down the tree together.
        """
        far = np.full((len(queries), k), np.inf)
        who = np.full((len(queries), k), -1, dtype=np.int64)

        def visit(node, active):
            if not len(active):
                return
            if isinstance(node, np.ndarray):
                d = np.concatenate([far[active], self._far(queries[active], node)], axis=1)
                w = np.concatenate([who[active], np.broadcast_to(node, (len(active), len(node)))], axis=1)
                top = np.argpartition(d, k - 1, axis=1)[:, :k]
                far[active], who[active] = np.take_along_axis(d, top, axis=1), np.take_along_axis(w, top, axis=1)
                return
            vantage, sides = node
            d = np.sqrt(np.maximum(((queries[active] - vantage) ** 2).sum(axis=1), 0.0))
            low = [np.maximum(np.maximum(d - hi, lo - d), 0.0) for lo, hi, _ in sides]
            inner = low[0] <= low[1]
            for first, mine in ((0, inner), (1, ~inner)):
                visit(sides[first][2], active[mine])
            for second, mine in ((1, inner), (0, ~inner)):
                at = np.flatnonzero(mine)
                visit(sides[second][2], active[at[factor * low[second][at] <= far[active[at]].max(axis=1) + 1e-12]])

        if len(self.points):
            visit(self.root, np.arange(len(queries)))
        order = np.argsort(far, axis=1, kind="stable")
        return np.take_along_axis(far, order, axis=1), np.take_along_axis(who, order, axis=1)


def _usable(id_column: str, vector: str):
    x = F.col(vector)
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return F.col(id_column).isNotNull() & x.isNotNull() & (F.size(x) > 0) & finite & F.exists(x, lambda v: v != 0)


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, factor: float = 1.0, shard_rows: int = 4000, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of vectors of largest cosine found for each query, but the query's own id.

    Scores are cosines in double precision of the vectors as given; ties go to the smaller id. Vectors that are null,
    empty, zero or hold a null or non-finite component take no part; vectors of different lengths are not compared; an id
    given twice counts once for each distinct vector; further columns are left out. Rows with equal vectors are indexed as
    one point that keeps its k + 1 smallest ids, which is all of them that a result can hold. Shards hold about
    shard_rows points each and every shard sees every query, batch by batch.
    """
    spark = vectors.sparkSession
    clean = vectors.where(_usable(id_column, vector)).select(F.col(id_column).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).dropDuplicates(["id", "v"])
    order = Window.partitionBy("v").orderBy("id")
    points = clean.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1).groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    points = C.keep(points.withColumn("dim", F.size("v")), "points")
    shards = max(1, -(-points.count() // shard_rows))
    ask = queries.where(_usable(id_column, vector)).select(F.col(id_column).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).dropDuplicates(["id"])
    sides = points.select(F.pmod(F.xxhash64("v"), F.lit(shards)).cast("int").alias("shard"), "dim", F.lit(0).alias("side"), "ids", "v").unionByName(
        ask.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.size("v").alias("dim"), F.lit(1).alias("side"), F.array("id").alias("ids"), "v")
    )
    dealt = sides.repartition(max(shards, 1), "shard", "dim").sortWithinPartitions("shard", "dim", "side")

    def run(batches):
        key, held, ids, tree, unit, norms = None, [], [], None, None, None
        for pdf in batches:
            keys = list(zip(pdf["shard"], pdf["dim"], strict=True))
            cuts = [i for i in range(len(keys)) if i == 0 or keys[i] != keys[i - 1] or pdf["side"].iat[i] != pdf["side"].iat[i - 1]] + [len(keys)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if keys[a] != key:
                    key, held, ids, tree = keys[a], [], [], None
                block = np.stack([np.asarray(x, dtype=float) for x in pdf["v"].iloc[a:b]])
                names = pdf["ids"].iloc[a:b].tolist()
                if pdf["side"].iat[a] == 0:
                    held.append(block)
                    ids.extend(names)
                    continue
                if not held:
                    continue
                if tree is None:
                    points_ = np.concatenate(held)
                    norms = np.sqrt((points_**2).sum(axis=1))
                    tree = Tree(points_ / norms[:, None])
                    unit = points_
                size = np.sqrt((block**2).sum(axis=1))
                out = []
                for at in range(0, len(block), 1024):
                    _, who = tree.nearest(block[at : at + 1024] / size[at : at + 1024, None], min(2 * k + 2, len(unit)), factor)
                    for q, row in enumerate(who, start=at):
                        own, row = int(names[q][0]), row[row >= 0]
                        score = (unit[row] * block[q]).sum(axis=1) / (norms[row] * size[q])
                        found = sorted((-s, int(i)) for s, r in zip(score.tolist(), row.tolist(), strict=True) for i in ids[r] if i != own)
                        best: dict[int, float] = {}
                        for s, i in found:
                            best.setdefault(i, -s)
                            if len(best) == k:
                                break
                        out.extend((own, i, s) for i, s in best.items())
                yield pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    found = dealt.mapInPandas(run, "query_id long, vec_id long, score double").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
