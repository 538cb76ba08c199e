"""Tags of items: counts, co-occurrence, similarity and profiles, all in long form."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import blocks as B
from .base import NUDGE, ranked
from .similarity import rounded


def pair_counts(tags: DataFrame, by: str = "item_id", of: str = "tag") -> DataFrame:
    """(a, b, n) with a < b: by's in common."""
    x = tags.select(by, F.col(of).alias("a"))
    y = tags.select(by, F.col(of).alias("b"))
    return x.join(y, by).where("a < b").groupBy("a", "b").agg(F.count("*").alias("n"))


class _Common:
    """(a, b, n), or (a, b, weight) with weight 1 of each owner spread over its keys, of owners with common keys."""

    def __init__(self, weighted: bool):
        self.weighted = weighted

    def meet(self, x, y):
        n, _, _ = B.sums(x, y, dots=False)
        if self.weighted:
            weight = rounded(n * np.outer(1.0 / x.counts, 1.0 / y.counts), 6, NUDGE)
        for a, b, i, j in B.met(x, y, n > 0, True):
            yield pd.DataFrame({"a": a, "b": b, "weight": weight[i, j]} if self.weighted else {"a": a, "b": b, "n": n[i, j].astype(np.int64)})

    def done(self):
        return ()


def item_pairs(tags: DataFrame, weighted: bool = False) -> DataFrame:
    """(a, b, n) with a < b: tags that two items have in common; weighted: (a, b, weight), rounded, as normalized() has it.

    Items are many and share few tags, so blocks of items meet instead of rows by tag.
    """
    item = tags.schema["item_id"].dataType.simpleString()
    blocks = B.packed(tags.select("item_id", "tag", F.lit(1.0).alias("x")), "item_id", "tag", "x", B.side(B.n_partitions(tags)))
    return B.crossed(blocks, blocks, lambda: _Common(weighted), f"a {item}, b {item}, {'weight double' if weighted else 'n long'}", half=True)


def mirrored(pairs: DataFrame) -> DataFrame:
    return pairs.unionAll(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), *[c for c in pairs.columns if c not in ("a", "b")]))


def normalized(tags: DataFrame, by: str, of: str) -> DataFrame:
    """Co-occurrence where each of `of` has weight 1 spread over its by's: sum of products of shares."""
    share = tags.withColumn("w", 1.0 / F.count("*").over(Window.partitionBy(of)))
    x = share.select(by, F.col(of).alias("a"), F.col("w").alias("wa"))
    y = share.select(by, F.col(of).alias("b"), F.col("w").alias("wb"))
    return x.join(y, by).where("a < b").groupBy("a", "b").agg(F.sum(F.col("wa") * F.col("wb")).alias("weight"))


def jaccard(tags: DataFrame, drop_top: int = 3) -> DataFrame:
    """Jaccard index of tags over items, without the most frequent tags."""
    n = tags.groupBy("tag").agg(F.count("*").alias("n"))
    top = n.orderBy(F.desc("n"), "tag").limit(drop_top).select("tag")
    kept = tags.join(F.broadcast(top), "tag", "left_anti")
    m = kept.groupBy("tag").agg(F.count("*").alias("m"))
    p = pair_counts(kept).join(m.select(F.col("tag").alias("a"), F.col("m").alias("ma")), "a").join(m.select(F.col("tag").alias("b"), F.col("m").alias("mb")), "b")
    return p.select("a", "b", (F.col("n") / (F.col("ma") + F.col("mb") - F.col("n"))).alias("jaccard"))


def cluster_counts(tags: DataFrame) -> DataFrame:
    return tags.groupBy("cluster", "tag").agg(F.count("*").alias("n"))


def top_per_cluster(counts: DataFrame, k: int) -> DataFrame:
    return ranked(counts, "cluster", [F.desc("n"), "tag"], k)
