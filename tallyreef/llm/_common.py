"""Helpers shared by the operators: tables in the shared folder, hashed words and connected components."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; where it is unset, as in tests, one of the driver's own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = f"file://{tempfile.mkdtemp(prefix='tallyreef-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it again, so that lineage ends there and lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._kept_at = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete tables that keep() wrote, once nothing reads them."""
    for df in tables:
        path = getattr(df, "_kept_at", None)
        if path:
            jvm = df.sparkSession._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def n_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fold(key: str, of: int) -> Column:
    """crc32 of the id as text, modulo of."""
    return F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(of))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- hashed words, for whole batches of texts at once -------------------------------------------------------------

_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_powers: dict[str, np.ndarray] = {}


def _table(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the odd base and of its inverse modulo 2**64."""
    if not len(_powers) or len(_powers["up"]) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base & _MASK, dtype=np.uint64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"], _powers["down"]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end] for bytes data; equal spans get equal hashes wherever they stand."""
    up, down = _table(len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs of bytes other than ASCII white space and control bytes."""
    inside = np.zeros(len(data) + 2, dtype=np.int8)
    inside[1:-1] = data > 32
    edge = np.diff(inside)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def words_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-case words of all texts in order, and where each text's words begin (one more at the end)."""
    raw = [t.lower().encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b"\n".join(raw) + b"\n", dtype=np.uint8)
    lengths = np.fromiter((len(r) + 1 for r in raw), dtype=np.int64, count=len(raw))
    starts, ends = word_spans(data)
    edges = np.searchsorted(starts, np.concatenate([[0], np.cumsum(lengths)]))
    return span_hashes(data, starts, ends), edges


_STEP = np.array([pow(0xD6E8FEB86659FD93, k + 1, 1 << 64) for k in range(64)], dtype=np.uint64)


def shingles(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n words; fewer words make one shingle of them all, none make none."""
    if len(words) == 0:
        return words
    n = min(n, len(words))
    out = np.zeros(len(words) - n + 1, dtype=np.uint64)
    for k in range(n):
        out += words[k : k + len(out)] * _STEP[k % 64]
    return mixed(out)


def texts_of(column) -> list[str]:
    """Strings of a pandas or Arrow column; null is the empty text."""
    values = column.to_pylist() if hasattr(column, "to_pylist") else column.tolist()
    return [v if isinstance(v, str) else "" for v in values]


def slabs(batches, text: str = "text", chars: int = 4_000_000):
    """Pandas frames cut so that the texts of one hold about so many characters; a longer text comes alone."""
    for pdf in batches:
        if not len(pdf):
            continue
        size = pdf[text].str.len().fillna(0).to_numpy(dtype=np.int64)
        group = np.cumsum(size) // chars
        for at in np.split(np.arange(len(pdf)), np.flatnonzero(np.diff(group)) + 1):
            yield pdf.iloc[at]


# --- connected components -----------------------------------------------------------------------------------------


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for all nodes of edges (a, b): root is the least node of the component.

    Each round hangs every node and its root's neighbours on the least label seen and then halves the paths, so rounds
    grow with the logarithm of the diameter. Every round is a table in the shared folder.
    """
    both = keep(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "edges")
    labels = keep(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("root")), "labels")
    for _ in range(max_rounds):
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("root").alias("near"))
        seen = labels.join(near, labels.node == near.a, "left").select("node", "root", F.least("root", F.coalesce("near", "root")).alias("low"))
        # a root takes the least label that any of its nodes has seen, so whole trees merge in one round
        lift = seen.groupBy(F.col("root").alias("r")).agg(F.min("low").alias("lift")).where("lift < r")
        moved = seen.join(lift, seen.root == lift.r, "left").select("node", "root", F.least("low", F.coalesce("lift", "low")).alias("next"))
        moved = keep(moved, "labels")
        if moved.where("next <> root").isEmpty():
            drop(labels, both)
            return moved.select("node", F.col("next").alias("root"))
        old, labels = labels, keep(_jump(moved), "labels")
        drop(old, moved)
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def _jump(moved: DataFrame) -> DataFrame:
    up = moved.select(F.col("node").alias("n2"), F.col("next").alias("root2"))
    return moved.join(up, moved.next == up.n2, "left").select("node", F.coalesce("root2", "next").alias("root"))


def frame(**columns) -> pd.DataFrame:
    return pd.DataFrame(columns)
