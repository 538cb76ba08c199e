"""Sparse rows packed into blocks of owners, and every block set against every other: all pairs without a shuffle by pair.

A block holds up to SIZE owners (users, say) with all of their entries. Blocks meet in a Cartesian product, of which only the blocks themselves
are shuffled; what is made of two blocks is computed with matrices in Python, a slice of WIDE keys at a time.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIZE = 1000
#: Entries of a block, beyond which it holds fewer owners.
ENTRIES = 1_000_000
WIDE = 1024
#: Parts of the blocks that all others are set against, where results are merged by owner.
AGAINST = 2

PARTS = ["block", "owners", "keys", "edges", "codes", "xs", "norms", "counts"]


def n_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def side(n: int) -> int:
    """Parts of both sides, so that their product is about twice the partitions of a shuffle."""
    return math.ceil(math.sqrt(2 * n))


def packed(rows: DataFrame, owner: str, key: str, value: str, out: int, nulls: bool = False) -> DataFrame:
    """Blocks of rows (owner, key, value), of which owner and key are unique together, in out partitions.

    A null value or key is no entry, but its owner is known and counts the row; a null owner is left out. With nulls, null
    values are entries too, as not a number. Owners within a block ascend. Rows are dealt by their size, not over all partitions of a shuffle, so that few owners make no more blocks
    than they fill; the blocks of one part are about equal.
    """
    o, k = (rows.schema[c].dataType.simpleString() for c in (owner, key))
    whole = F.when(F.col(key).isNull(), F.lit(0).cast(k)).otherwise(F.col(key))
    chosen = rows.select(F.col(owner).alias("o"), whole.alias("k"), F.col(value).cast("double").alias("x"), F.col(key).isNotNull().alias("known")).where("o IS NOT NULL")

    def pack(batches):
        from pyspark import TaskContext

        at, held = TaskContext.get().partitionId() << 32, None

        def block(pdf, number):
            own, xs = pdf["o"].to_numpy(), pdf["x"].to_numpy(dtype=np.float64)
            begin = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
            counts = np.diff(np.append(begin, len(own)))
            norms = np.sqrt(np.add.reduceat(np.where(np.isnan(xs), 0.0, xs) ** 2, begin))
            here = pdf["known"].to_numpy() & (nulls | ~np.isnan(xs))
            codes, keys = pd.factorize(pdf["k"].to_numpy()[here], sort=True)
            row = np.repeat(np.arange(len(begin)), counts)[here]
            edges = np.searchsorted(row, np.arange(len(begin) + 1))
            return (number, own[begin], keys, edges.astype(np.int64).tobytes(), codes.astype(np.int32).tobytes(), xs[here].tobytes(), norms.tobytes(), counts.astype(np.int64).tobytes())

        def cut(pdf, last):
            """Blocks of whole owners, and the rows that are left; the last owner may go on."""
            nonlocal at
            own = pdf["o"].to_numpy()
            begin = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
            ends = np.append(begin[1:], len(own))
            out, first = [], 0
            while first < len(begin):
                left = len(begin) - first
                if not last and left <= 2 * SIZE and len(own) - begin[first] <= 2 * ENTRIES:
                    break
                even = -(-left // -(-left // SIZE)) if last else SIZE
                to = min(first + even, int(np.searchsorted(ends, begin[first] + ENTRIES, "right")))
                to = max(to, first + 1)
                if to >= len(begin) and not last:
                    break
                out.append(block(pdf.iloc[begin[first] : ends[to - 1]], at))
                at, first = at + 1, to
            return out, (pdf.iloc[begin[first] :] if first < len(begin) else None)

        for pdf in batches:
            if not len(pdf):
                continue
            held = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            out, held = cut(held, False)
            if out:
                yield pd.DataFrame(out, columns=PARTS)
        if held is not None:
            out, _ = cut(held, True)
            yield pd.DataFrame(out, columns=PARTS)

    dealt = chosen.repartition("o").sortWithinPartitions("o", "k")
    blocks = dealt.mapInPandas(pack, f"block long, owners array<{o}>, keys array<{k}>, edges binary, codes binary, xs binary, norms binary, counts binary")
    return blocks.repartition(out)


class Block:
    def __init__(self, number, owners, keys, edges, codes, xs, norms, counts):
        self.number, self.owners, self.keys = int(number), np.asarray(owners), np.asarray(keys)
        self.edges = np.frombuffer(edges, dtype=np.int64)
        self.codes, self.xs = np.frombuffer(codes, dtype=np.int32), np.frombuffer(xs)
        self.norms, self.counts = np.frombuffer(norms), np.frombuffer(counts, dtype=np.int64)
        self.row = np.repeat(np.arange(len(self.owners)), np.diff(self.edges))

    def dense(self, place: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
        """Values and presence of the keys that place puts at low to high."""
        to = place[self.codes]
        some = np.flatnonzero((to >= low) & (to < high))
        x, m = np.zeros((2, len(self.owners), high - low))
        x[self.row[some], to[some] - low] = self.xs[some]
        m[self.row[some], to[some] - low] = 1.0
        return x, m


def common(a: Block, b: Block):
    """Values and presence of a and of b on their common keys, slice by slice."""
    if not len(a.keys) or not len(b.keys):
        return
    shared, ia, ib = np.intersect1d(a.keys, b.keys, assume_unique=True, return_indices=True)
    pa, pb = np.full(len(a.keys), -1), np.full(len(b.keys), -1)
    pa[ia] = pb[ib] = np.arange(len(shared))
    for low in range(0, len(shared), WIDE):
        high = min(low + WIDE, len(shared))
        yield (*a.dense(pa, low, high), *b.dense(pb, low, high))


def sums(a: Block, b: Block, squares: bool = False, dots: bool = True, counts: bool = True) -> tuple[np.ndarray | None, np.ndarray | None, np.ndarray | None]:
    """(n, dot, sq) of each owner of a with each of b over common keys: their number, sum of products and of squared differences."""
    shape = (len(a.owners), len(b.owners))
    n, dot, sq = np.zeros(shape) if counts else None, np.zeros(shape) if dots else None, np.zeros(shape) if squares else None
    for x, mx, y, my in common(a, b):
        if counts:
            n += mx @ my.T
        if dots:
            dot += x @ y.T
        if squares:
            left, right = (x * x) @ my.T, mx @ (y * y).T
            part = left + right - 2 * (x @ y.T)
            # where all but little cancels out, the differences themselves are summed
            near = np.nonzero((part <= 1e-3 * (left + right)) & (left + right > 0))
            for some in np.array_split(np.arange(len(near[0])), -(-len(near[0]) // 4000) or 1):
                i, j = near[0][some], near[1][some]
                part[i, j] = ((x[i] - y[j]) ** 2 * (mx[i] * my[j])).sum(axis=1)
            sq += part
    return n, dot, sq


def itself(a: Block, b: Block) -> tuple[np.ndarray, np.ndarray]:
    """Places in a and in b of owners that are in both."""
    _, i, j = np.intersect1d(a.owners, b.owners, assume_unique=True, return_indices=True)
    return i, j


def met(a: Block, b: Block, where: np.ndarray, half: bool):
    """(u, v, i, j) of different owners where they are to be given, and their places; half gives each two once, with u < v.

    Some rows at a time, so that a frame stays small.
    """
    where = where.copy()
    if half and a.number == b.number:
        where &= np.arange(len(a.owners))[:, None] < np.arange(len(b.owners))[None, :]
    i, j = itself(a, b)
    where[i, j] = False
    for some in np.array_split(np.arange(len(where)), max(1, where.size // 500_000)):
        i, j = np.nonzero(where[some])
        i = some[i]
        u, v = a.owners[i], b.owners[j]
        if half:
            u, v = np.where(u < v, u, v), np.where(u < v, v, u)
        yield u, v, i, j


def crossed(a: DataFrame, b: DataFrame, start, schema: str, half: bool = False, extra: tuple[str, ...] = ()) -> DataFrame:
    """Rows that an object made by start() yields for blocks of a against blocks of b.

    Its method meet(block, other) is called for each two, other blocks in a row for one of a, and done() after the last of these; both
    return frames. half leaves out the second order of two blocks. The values of a's columns that extra names are given to start().
    """
    x = a.select(*[F.col(c).alias(f"a_{c}") for c in PARTS], *extra)
    y = b.select(*[F.col(c).alias(f"b_{c}") for c in PARTS])
    both = x.join(y.hint("shuffle_replicate_nl"), F.col("a_block") <= F.col("b_block") if half else F.lit(True))

    def run(batches):
        one = state = None
        for pdf in batches:
            left, right = ([pdf[f"{s}_{c}"].tolist() for c in PARTS] for s in "ab")
            further = [pdf[c].tolist() for c in extra]
            for at, (p, q) in enumerate(zip(zip(*left, strict=True), zip(*right, strict=True), strict=True)):
                if one is None or one.number != p[0]:
                    if state is not None:
                        yield from state.done()
                    one, state = Block(*p), start(*(x[at] for x in further))
                yield from state.meet(one, Block(*q))
        if state is not None:
            yield from state.done()

    return both.mapInPandas(run, schema)
