"""N-gram Jaccard join: near-duplicate documents by banded min-hashes, verified on their full sets of word n-grams."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _common as C

#: Stands for a null document id.
NO_ID = -(2**63)


def banding(threshold: float, recall: float, most: int = 160) -> tuple[int, int]:
    """(bands, rows) that find a pair at the threshold with the target recall, with the most rows that so many hashes allow.

    A pair of similarity s shares a band with probability 1 - (1 - s**rows) ** bands. More rows make fewer false candidates.
    """
    best = (max(1, math.ceil(math.log(1 - recall) / math.log(1 - threshold))) if threshold < 1 else 1, 1)
    for rows in range(1, 33):
        p = threshold**rows
        bands = 1 if p >= 1 else math.ceil(math.log(1 - recall) / math.log(1 - p))
        if bands * rows <= most:
            best = (bands, rows)
    return best


def sketches(docs: DataFrame, n: int, bands: int, rows: int, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, the fingerprint of the set of n-grams (f1, f2), its size and its band hashes."""
    random = np.random.RandomState(20240229)
    factors = (random.randint(0, 2**63, size=bands * rows, dtype=np.int64).astype(np.uint64) << np.uint64(1)) | np.uint64(1)
    step = np.array([pow(0x9FB21C651E98DF25, k + 1, 1 << 64) for k in range(rows)], dtype=np.uint64)

    def run(batches):
        for pdf in C.slabs(batches, "text_", 1_000_000):
            words, edges = C.words_of(C.texts_of(pdf["text_"]))
            one, two, size, hashes = [], [], [], []
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                s = np.unique(C.shingles(words[a:b], n))
                least = np.zeros(bands * rows, dtype=np.uint64)
                if len(s):
                    least[:] = np.iinfo(np.uint64).max
                    for at in range(0, len(s), 512):
                        least = np.minimum(least, ((s[at : at + 512, None] * factors) >> np.uint64(16)).min(axis=0))
                band = C.mixed((least.reshape(bands, rows) * step).sum(axis=1, dtype=np.uint64) + np.arange(bands, dtype=np.uint64))
                one.append(C.mixed(s).sum(dtype=np.uint64))
                two.append(C.mixed(s ^ np.uint64(0xA5A5A5A55A5A5A5A)).sum(dtype=np.uint64))
                size.append(len(s))
                hashes.append(band.view(np.int64))
            yield pd.DataFrame({"doc_id": pdf["doc_id"].to_numpy(), "f1": np.array(one, dtype=np.uint64).view(np.int64), "f2": np.array(two, dtype=np.uint64).view(np.int64), "size": np.array(size, dtype=np.int32), "bands": hashes})

    chosen = docs.select(F.coalesce(F.col(id_column).cast("long"), F.lit(NO_ID)).alias("doc_id"), F.col(text).alias("text_"))
    return chosen.mapInPandas(run, "doc_id long, f1 long, f2 long, size int, bands array<long>")


def _groups(batches, keys: list[str]):
    """Whole groups of rows that stand together, from batches sorted by keys."""
    held = []
    for pdf in batches:
        if not len(pdf):
            continue
        change = np.zeros(len(pdf), dtype=bool)
        for k in keys:
            v = pdf[k].to_numpy()
            change[1:] |= v[1:] != v[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), len(pdf)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            part = pdf.iloc[a:b]
            if held and any(held[-1][k].iat[-1] != part[k].iat[0] for k in keys):
                yield pd.concat(held) if len(held) > 1 else held[0]
                held = []
            held.append(part)
    if held:
        yield pd.concat(held) if len(held) > 1 else held[0]


def _owned(g: pd.DataFrame, threshold: float) -> np.ndarray:
    """Which pairs (i < j) of a bucket's members are to be verified here.

    A pair belongs to the first band that it shares, and to the task of its two blocks; sizes must allow the threshold.
    """
    bands = np.stack(g["bands"].to_numpy())
    size = g["size"].to_numpy().astype(float)
    block = g["block"].to_numpy()
    out = np.minimum(size[:, None], size) >= threshold * np.maximum(size[:, None], size) - 1e-9
    for k in range(int(g["band"].iat[0])):
        out &= bands[:, k][:, None] != bands[:, k]
    if g["first"].iat[0] != g["second"].iat[0]:
        out &= block[:, None] != block
    return np.triu(out, 1)


def _common_counts(sets: list[np.ndarray], wide: int = 8192) -> np.ndarray:
    """Sizes of the intersections of all pairs of sets of 64-bit values, in blocks of columns."""
    sizes = [len(s) for s in sets]
    values, column = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    shared = np.bincount(column, minlength=len(values)) > 1
    place = np.cumsum(shared) - 1
    keep = shared[column]
    owner, column = owner[keep], place[column[keep]]
    out = np.zeros((len(sets), len(sets)))
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    for at in range(0, int(shared.sum()), wide):
        a, b = np.searchsorted(column, [at, at + wide])
        block = np.zeros((len(sets), min(wide, int(shared.sum()) - at)), dtype=np.float32)
        block[owner[a:b], column[a:b] - at] = 1
        out += block @ block.T
    return out


def _roots(linked: np.ndarray, names: np.ndarray) -> np.ndarray:
    """Least name of each member's component."""
    root = names.copy()
    a, b = np.nonzero(linked)
    while True:
        low = root.copy()
        np.minimum.at(low, a, root[b])
        np.minimum.at(low, b, root[a])
        if (low == root).all():
            return root
        root = low


def classes(docs: DataFrame, n: int = 5, threshold: float = 0.8, recall: float = 0.999, block_rows: int = 1500, block_grams: int = 4_000_000, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, class_id, n_links, n_copies: one row for each row of docs.

    Two documents are linked if the Jaccard similarity of their sets of n lower-case words in a row is threshold or more; a
    text of fewer words has one n-gram of them all. class_id is the least id of those joined by links, n_links the number of
    other documents linked to this one, n_copies of documents with the same set, itself included. Null, empty and blank
    texts have no n-grams: each is a class by itself without links. Rows with a null id count as documents that share it;
    ids are taken to be unique otherwise. Further columns are left out.

    Documents of equal sets become one point before any pair is looked at. Points meet in buckets by band hash. A bucket finds
    which of its pairs share no earlier band; only points with such pairs are sent on with their sets, and each pair is
    verified in one bucket, so no pair is made twice and none is written: a bucket gives its members' counts of links
    and one edge to the least of those they are joined with. Buckets over block_rows points or block_grams n-grams are
    split into pairs of blocks, each a task of its own; nothing is capped.
    """
    spark = docs.sparkSession
    bands, rows = banding(threshold, recall)
    sketch = C.keep(sketches(docs, n, bands, rows, id_column, text), "sketches")
    full = sketch.where("size > 0")
    points = C.keep(full.groupBy("f1", "f2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n"), F.first("size").alias("size"), F.first("bands").alias("bands")), "points")
    laid = points.select("rep", "size", F.posexplode("bands").alias("band", "key"))
    buckets = laid.groupBy("band", "key").agg(F.count("*").alias("members"), F.sum("size").alias("grams")).where("members > 1")
    blocks = F.greatest(F.ceil(F.col("members") / block_rows), F.ceil(F.col("grams") / F.lit(block_grams))).cast("int")
    met = laid.join(buckets.withColumn("blocks", blocks).drop("members", "grams"), ["band", "key"]).drop("size")
    met = met.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select("band", "key", "rep", "block", F.least("block", "other").alias("first"), F.greatest("block", "other").alias("second"))
    members = met.join(points.select("rep", "size", "bands"), "rep")
    by = ["key", "band", "first", "second"]
    parts = C.n_partitions(spark)

    def choose(batches):
        for g in _groups(batches, by):
            own = _owned(g, threshold)
            at = np.flatnonzero(own.any(axis=0) | own.any(axis=1))
            if len(at):
                yield g.iloc[at][[*by, "rep", "block"]]

    columns = "key long, band int, first int, second int"
    chosen = members.repartition(parts, *by).sortWithinPartitions(*by).select(*by, "rep", "block", "size", "bands").mapInPandas(choose, columns + ", rep long, block int")
    asked = C.keep(chosen.groupBy("rep").agg(F.collect_list(F.struct(*by, "block")).alias("asks")), "asked")
    wanted = asked.join(points.select("rep", "bands", F.col("n").alias("copies")), "rep")
    texts = docs.select(F.coalesce(F.col(id_column).cast("long"), F.lit(NO_ID)).alias("rep"), F.col(text).alias("text_"))
    sourced = texts.join(wanted, "rep")

    def send(batches):
        for pdf in C.slabs(batches, "text_", 1_000_000):
            words, edges = C.words_of(C.texts_of(pdf["text_"]))
            out = []
            for k, (rep, copies, own, asks) in enumerate(zip(pdf["rep"], pdf["copies"], pdf["bands"], pdf["asks"], strict=True)):
                grams = np.unique(C.shingles(words[edges[k] : edges[k + 1]], n))
                if not len(grams):
                    continue
                for ask in asks:
                    out.append((ask["key"], ask["band"], ask["first"], ask["second"], rep, ask["block"], copies, own, len(grams), grams.tobytes()))
                    if len(out) >= 500:
                        yield pd.DataFrame(out, columns=[*by, "rep", "block", "copies", "bands", "size", "grams"])
                        out = []
            if out:
                yield pd.DataFrame(out, columns=[*by, "rep", "block", "copies", "bands", "size", "grams"])

    sent = sourced.mapInPandas(send, columns + ", rep long, block int, copies long, bands array<long>, size int, grams binary")

    def verify(batches):
        for g in _groups(batches, by):
            g = g.drop_duplicates("rep")
            own = _owned(g, threshold)
            if not own.any():
                continue
            common = _common_counts([np.frombuffer(x, dtype=np.uint64) for x in g["grams"]])
            size = g["size"].to_numpy().astype(float)
            linked = own & (common >= threshold * (size[:, None] + size - common) - 1e-9)
            at = np.flatnonzero(linked.any(axis=0) | linked.any(axis=1))
            if not len(at):
                continue
            copies, names = g["copies"].to_numpy(), g["rep"].to_numpy()
            links = linked @ copies + copies @ linked
            root = _roots(linked, names)
            yield pd.DataFrame({"rep": names[at], "links": links[at].astype(np.int64), "root": root[at]})

    found = C.keep(sent.repartition(parts, *by).sortWithinPartitions(*by).mapInPandas(verify, "rep long, links long, root long"), "links")
    joined = C.components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    known = points.select("f1", "f2", "rep", "n").join(joined, points.rep == joined.node, "left").join(links, "rep", "left")
    known = known.select("f1", "f2", "n", F.coalesce("root", "rep").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"))
    classed = full.select("doc_id", "f1", "f2").join(known, ["f1", "f2"]).select("doc_id", "class_id", "n_links", F.col("n").alias("n_copies"))
    alone = sketch.where("size = 0").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(1).cast("long").alias("n_copies"))
    null_id = (lambda c: F.nullif(F.col(c), F.lit(NO_ID)).alias(c))
    out = C.keep(classed.unionByName(alone).select(null_id("doc_id"), null_id("class_id"), "n_links", "n_copies"), "classes")
    C.drop(sketch, points, asked, found, joined)
    return out


def keep_one(docs: DataFrame, id_column: str = "doc_id", **options) -> DataFrame:
    """Rows of docs without near duplicates: of each class the document of the least id, of rows that repeat an id the text that comes first."""
    from pyspark.sql import Window

    got = classes(docs, id_column=id_column, **options)
    known = (lambda c: F.coalesce(F.col(c).cast("long"), F.lit(NO_ID)))
    kept = got.where(F.col("doc_id").eqNullSafe(F.col("class_id"))).select(known("doc_id").alias("id_")).distinct()
    # a row travels once, with one copy of its text: the join and the window deal it by the same key
    rows = docs.select(F.struct(*docs.columns).alias("row_"), known(id_column).alias("id_"))
    once = Window.partitionBy("id_").orderBy("row_.text")
    return rows.join(kept, "id_", "left_semi").withColumn("n_", F.row_number().over(once)).where("n_ = 1").select("row_.*")
