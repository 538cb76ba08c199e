"""Quality classifier: similarity-weighted votes of the nearest labelled documents in a latent-semantic space."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _common as C

#: Kinds of byte whose runs of four are the terms of a document: blank, line end, small and capital letter, digit and groups of marks.
_GROUPS = [b" \t", b"\n\r", b"abcdefghijklmnopqrstuvwxyz" + bytes(range(128, 256)), b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,;:", b"!?", b"|", b"#$%&*@^~+=_\\", b"()[]{}<>/", b"\"'`-"]
_KIND = np.full(256, len(_GROUPS), dtype=np.int64)
for _k, _group in enumerate(_GROUPS):
    _KIND[list(_group)] = _k
_N_KINDS = len(_GROUPS) + 1
_SHAPES, _LEVELS = 1900, 16
TERMS = _SHAPES + 3 * _LEVELS


def term_weights(texts: list[str]) -> np.ndarray:
    """Texts x terms: square roots of the shares of hashed shape 4-grams, and levels of repetition of words and lines."""
    out = np.zeros((len(texts), TERMS), dtype=np.float32)
    words, edges = C.words_of(texts)
    for k, text in enumerate(texts):
        data = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
        if len(data) >= 1:
            s = _KIND[data]
            s = np.concatenate([[0, 0, 0], s])
            grams = ((s[:-3] * _N_KINDS + s[1:-2]) * _N_KINDS + s[2:-1]) * _N_KINDS + s[3:]
            counts = np.bincount(grams * 40503 % 65521 % _SHAPES, minlength=_SHAPES)
            out[k, :_SHAPES] = np.sqrt(counts / len(grams))
        w = words[edges[k] : edges[k + 1]]
        if len(w):
            again = np.mean(w[1:] == w[:-1]) if len(w) > 1 else 0.0
            fresh = len(np.unique(w)) / len(w)
            long = min(np.log2(len(w) + 1), _LEVELS - 1)
            for j, level in enumerate((again * (_LEVELS - 1), fresh * (_LEVELS - 1), long)):
                low = int(level)
                part = np.float32(level - low)
                scale = (0.6, 0.3, 0.05)[j]
                out[k, _SHAPES + j * _LEVELS + low] = scale * (1 - part)
                if low + 1 < _LEVELS:
                    out[k, _SHAPES + j * _LEVELS + low + 1] = scale * part
    return out


class Model:
    """Term weights by rarity, the projection to latent dimensions, and labelled unit vectors with their votes."""

    def __init__(self, weights: np.ndarray, labels: np.ndarray, votes: np.ndarray, dims: int, neighbours: int):
        self.neighbours, self.labels, self.votes = neighbours, labels.astype(np.float32), votes.astype(np.float32)
        self.prior = float((labels * votes).sum() / votes.sum()) if len(labels) else 0.5
        n = len(labels)
        self.rarity = np.log((1 + n) / (1 + (weights > 0).sum(axis=0))).astype(np.float32) + 1 if n else np.ones(TERMS, dtype=np.float32)
        gram = np.zeros((TERMS, TERMS))
        for at in range(0, n, 2000):
            block = weights[at : at + 2000] * self.rarity
            gram += block.T @ block
        values, vectors = np.linalg.eigh(gram)
        self.basis = vectors[:, ::-1][:, :dims].astype(np.float32)
        self.vectors = self.project(weights)

    def project(self, weights: np.ndarray) -> np.ndarray:
        v = (weights * self.rarity) @ self.basis
        norm = np.linalg.norm(v, axis=1, keepdims=True)
        return np.divide(v, norm, out=np.zeros_like(v), where=norm > 0)

    def scores(self, weights: np.ndarray, block: int = 4096) -> np.ndarray:
        """Votes of the nearest labelled vectors, found by exact cosines in blocks."""
        if not len(self.labels):
            return np.full(len(weights), self.prior)
        v = self.project(weights)
        best = np.full((len(v), 0), 0, dtype=np.float32)
        which = np.zeros((len(v), 0), dtype=np.int64)
        for at in range(0, len(self.labels), block):
            cosine = v @ self.vectors[at : at + block].T
            k = min(self.neighbours, cosine.shape[1])
            top = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
            best = np.concatenate([best, np.take_along_axis(cosine, top, axis=1)], axis=1)
            which = np.concatenate([which, top + at], axis=1)
        k = min(self.neighbours, best.shape[1])
        top = np.argpartition(-best, k - 1, axis=1)[:, :k]
        near, who = np.take_along_axis(best, top, axis=1).astype(float), np.take_along_axis(which, top, axis=1)
        weight = np.maximum(near, 0.0) ** 8 * self.votes[who]
        total = weight.sum(axis=1)
        return np.where(total > 0, (weight * self.labels[who]).sum(axis=1) / np.where(total > 0, total, 1), self.prior)


def train(docs: DataFrame, labels: DataFrame, rows: int = 5000, dims: int = 64, neighbours: int = 25, id_column: str = "doc_id", label: str = "quality") -> Model:
    """Fit on a bounded sample: of each of the two labels the rows documents least by hash of the id.

    docs: id, text; labels: id, label. Rows with a null label take no part, nor do labels without a document; null texts
    count as empty; a label given twice counts twice. A label's votes are weighted so that both labels have their share of
    all labelled rows. The sample is found from ids alone, at most 2 * rows ids are broadcast to find its texts, and as many
    term vectors come to the driver, whatever the corpus holds.
    """
    known = labels.where(F.col(label).isin(0, 1)).select(id_column, F.col(label).cast("int").alias("y"))
    total = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    # ids of least hash: a threshold leaves a few more than are wanted, so that no task ranks a whole label
    low = F.pmod(F.xxhash64(F.col(id_column), F.lit(11)), F.lit(1 << 30))
    share = (lambda y: min(1.0, (1.2 * rows + 200) / total[y]) if total.get(y) else 0.0)
    some = known.withColumn("low", low).where(F.col("low") < F.when(F.col("y") == 1, F.lit(share(1) * (1 << 30))).otherwise(F.lit(share(0) * (1 << 30))))
    order = Window.partitionBy("y").orderBy("low", id_column)
    picked = some.withColumn("rank_", F.row_number().over(order)).where(F.col("rank_") <= rows).select(id_column, "y")
    chosen = docs.select(id_column, "text").join(F.broadcast(picked), id_column).select("y", F.col(id_column).alias("id"), F.col("text").alias("text_"))

    def run(batches):
        for pdf in C.slabs(batches, "text_", 500_000):
            w = term_weights(C.texts_of(pdf["text_"]))
            yield pd.DataFrame({"y": pdf["y"], "id": pdf["id"], "terms": [np.flatnonzero(x).astype("<u2").tobytes() for x in w], "weights": [x[x != 0].astype("<f2").tobytes() for x in w]})

    got = chosen.mapInPandas(run, f"y int, id {docs.schema[id_column].dataType.simpleString()}, terms binary, weights binary").toPandas().sort_values(["id", "y"], ignore_index=True)
    weights = np.zeros((len(got), TERMS), dtype=np.float32)
    for k, (terms, values) in enumerate(zip(got["terms"], got["weights"], strict=True)):
        weights[k, np.frombuffer(terms, dtype="<u2")] = np.frombuffer(values, dtype="<f2")
    labels = got["y"].to_numpy(dtype=float)
    sampled = {y: max(1, int((labels == y).sum())) for y in (0, 1)}
    votes = np.array([total[int(y)] / sampled[int(y)] for y in labels])
    return Model(weights, labels, votes, dims, neighbours)


def score(docs: DataFrame, model: Model, carry: list[str], text: str = "text") -> DataFrame:
    """The carry columns with score (0 to 1) of every whole text.

    Empty and null texts, and a model without labelled rows, get the share of label 1; copies get equal scores; further
    columns are left out.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for pdf in C.slabs(batches, "text_", 1_000_000):
            yield pdf.drop(columns="text_").assign(score=sent.value.scores(term_weights(C.texts_of(pdf["text_"]))).astype(float))

    chosen = docs.select(*carry, F.col(text).alias("text_"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema if f.name != "text_")
    return chosen.mapInPandas(run, schema + ", score double")
