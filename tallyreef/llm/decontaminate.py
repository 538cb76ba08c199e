"""Benchmark decontamination with SimHash fingerprints of item-sized windows, in DataFrame functions alone."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _common as C

def _words(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def _shingle_hash(words: Column, at: Column, n: int) -> Column:
    return F.xxhash64(*[F.get(words, at + F.lit(k)) for k in range(n)])


def _positions(words: Column, n: int) -> Column:
    return F.when(F.size(words) >= n, F.sequence(F.lit(0), F.size(words) - F.lit(n))).otherwise(F.array().cast("array<int>"))


def _shingles(words: Column, n: Column) -> Column:
    """Shingles of n words as texts."""
    return F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda i: F.array_join(F.slice(words, i, n), " "))


def _hashes(shingles: Column) -> Column:
    return F.transform(shingles, lambda s: F.xxhash64(s))


def fingerprint(hashes: Column, bits: int = 64) -> Column:
    """SimHash of shingles by their hashes, each weighing as often as it stands there: a bit is set where most have it set.

    hashes: a column of its own, so that it is computed once and not for every bit.
    """
    one = F.lit(1).cast("long")

    def bit(b: Column) -> Column:
        votes = F.aggregate(hashes, F.lit(0).cast("long"), lambda acc, h: acc + F.call_function("shiftright", h, b).bitwiseAND(one))
        return F.when(votes * 2 > F.size(hashes), F.call_function("shiftleft", one, b)).otherwise(F.lit(0).cast("long"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(bits - 1)), F.lit(0).cast("long"), lambda acc, b: acc.bitwiseOR(bit(b)))


def _blocks(print_: Column, radius: int, bits: int = 64) -> Column:
    """radius + 1 blocks of the fingerprint: two of them within the radius agree on one block at least."""
    cuts = [round(k * bits / (radius + 1)) for k in range(radius + 2)]
    return F.array(*[F.struct(F.lit(k).alias("no"), F.shiftrightunsigned(print_, a).bitwiseAND(F.lit((1 << (b - a)) - 1).cast("long")).alias("value")) for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))])


def weighted_similarity(a: Column, b: Column) -> Column:
    """Sum of the lesser over sum of the greater counts of each shingle in either."""
    times = (lambda xs, x: F.size(F.filter(xs, lambda y: y == x)))
    common = F.aggregate(F.array_distinct(a), F.lit(0), lambda acc, x: acc + F.least(times(a, x), times(b, x)))
    return common / (F.size(a) + F.size(b) - common)


def leaks(docs: DataFrame, benchmark: DataFrame, n: int = 5, threshold: float = 0.8, radius: int = 22, at_once: int = 100_000, id_column: str = "doc_id", item_column: str = "item_id", text: str = "text") -> DataFrame:
    """doc_id, item_id, similarity, hamming, start_word, n_words: the best window of each document for each item it leaks.

    A window is as many words of a document as an item has, cut off where the document ends; words are lower-case runs
    of letters and digits. A window leaks an item if their SimHashes differ in radius bits or fewer and their weighted
    similarity of n-word shingles is threshold or more. Looked at are the windows that lay a shingle of the document over
    the same shingle of an item, since no others have a similarity over 0; their fingerprints meet the items' in a
    multi-index of radius + 1 blocks, which finds all within the radius, and the exact similarity follows. Items of
    fewer than n words are one shingle of them all. Null and wordless texts and items leak nothing; equal items are
    reported each; a document given twice is reported once; documents with a null id are reported under it together;
    further columns are left out. About at_once shingles of the items are laid over the documents at a time, and the items'
    fingerprints are sent to every task where they have no more in all; a larger benchmark takes a scan of the documents
    for each so many, and its fingerprints are shuffled.
    """
    items = benchmark.select(F.col(item_column).alias("item_id"), _words(F.col(text)).alias("item_words")).where(F.size("item_words") > 0)
    items = items.withColumn("m", F.least(F.lit(n), F.size("item_words")))
    items = items.withColumn("item_shingles", _shingles(F.col("item_words"), F.col("m"))).withColumn("item_size", F.size("item_words")).drop("item_words")
    found = items.select("m", "item_size", F.posexplode("item_shingles").alias("offset", "shingle"))
    # the hash of the words one by one, as documents have it
    keyed = found.select("m", "item_size", "offset", F.expr(f"CASE {' '.join(f'WHEN m = {m} THEN xxhash64({', '.join(f'split(shingle, chr(32))[{k}]' for k in range(m))})' for m in range(1, n + 1))} END").alias("hash")).distinct()
    spark, anchors = docs.sparkSession, C.keep(keyed, "anchors")
    total = items.agg(F.coalesce(F.sum(F.size("item_shingles")), F.lit(0))).first()[0]
    rounds = max(1, -(-anchors.count() // at_once))
    # explode of a single array gives one row as before, but the optimizer cannot copy what it holds into later expressions
    words = docs.select(F.col(id_column).alias("doc_id"), F.explode(F.array(_words(F.col(text)))).alias("words"))
    tables = []
    for k in range(rounds):
        rows = anchors.where(F.pmod(F.xxhash64("hash", "offset", "item_size"), F.lit(rounds)) == k).collect()
        spans = None
        for m in sorted({r["m"] for r in rows}):
            own = [r for r in rows if r["m"] == m]
            hashes = sorted({r["hash"] for r in own})
            laid_by = F.broadcast(spark.createDataFrame([(r["hash"], r["offset"], r["item_size"]) for r in own], "hash long, offset int, item_size int"))
            at = words.withColumn("hits", F.filter(_positions(F.col("words"), m), lambda i: _shingle_hash(F.col("words"), i, m).isin(hashes))).where(F.size("hits") > 0)
            hits = at.select("doc_id", "words", F.explode("hits").alias("at")).withColumn("hash", _shingle_hash(F.col("words"), F.col("at"), m))
            laid = hits.join(laid_by, "hash")
            start, end = F.greatest(F.col("at") - F.col("offset"), F.lit(0)), F.least(F.col("at") - F.col("offset") + F.col("item_size"), F.size("words"))
            cut = laid.select("doc_id", start.alias("start_word"), (end - start).alias("n_words"), F.array_join(F.slice("words", start + 1, end - start), " ").alias("window"), F.lit(m).alias("m")).where(F.col("n_words") >= m)
            spans = cut if spans is None else spans.unionByName(cut)
        if spans is not None:
            tables.append(C.keep(spans.distinct(), "windows"))
    C.drop(anchors)
    if not tables:
        return spark.createDataFrame([], f"doc_id {docs.schema[id_column].dataType.simpleString()}, item_id {benchmark.schema[item_column].dataType.simpleString()}, similarity double, hamming int, start_word int, n_words int")
    spans = reduce(DataFrame.unionByName, tables)
    if rounds > 1:
        spans = spans.distinct()
    # Tables cut the plan here: the optimizer would copy fingerprints and similarities into filters and run them for every row.
    windows = spans.withColumn("window_words", F.split("window", " ")).withColumn("shingles", _shingles(F.col("window_words"), F.col("m"))).withColumn("hashes", _hashes(F.col("shingles"))).withColumn("print", fingerprint(F.col("hashes")))
    windows = C.keep(windows.select("doc_id", "start_word", "n_words", "m", "shingles", "print"), "prints")
    cut_windows = windows.withColumn("block", F.explode(_blocks(F.col("print"), radius)))
    index = items.withColumn("hashes", _hashes(F.col("item_shingles"))).withColumn("item_print", fingerprint(F.col("hashes"))).select("item_id", F.col("m").alias("item_m"), "item_shingles", "item_print")
    index = C.keep(index, "items").withColumn("item_block", F.explode(_blocks(F.col("item_print"), radius)))
    away = F.bit_count(F.col("print").bitwiseXOR(F.col("item_print")))
    # no similarity is over the ratio of the sizes
    sizes = (F.size("shingles"), F.size("item_shingles"))
    alike = F.least(*sizes) >= F.greatest(*sizes) * threshold - 1e-9
    near = cut_windows.join(F.broadcast(index) if total <= at_once else index, (F.col("block") == F.col("item_block")) & (F.col("m") == F.col("item_m")) & alike & (away <= radius))
    near = near.withColumn("hamming", away.cast("int")).drop("block", "item_block", "print", "item_print").distinct()
    near = C.keep(near, "near")
    scored = near.withColumn("similarity", weighted_similarity(F.col("shingles"), F.col("item_shingles"))).where(F.col("similarity") >= threshold)
    best = scored.groupBy("doc_id", "item_id").agg(F.max(F.struct("similarity", -F.col("hamming"), -F.col("start_word"), "n_words")).alias("best"))
    C.drop(*tables, windows)
    return best.select("doc_id", "item_id", F.col("best.similarity").alias("similarity"), (-F.col("best.col2")).alias("hamming"), (-F.col("best.col3")).alias("start_word"), F.col("best.n_words").alias("n_words"))


def without_leaks(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", **options) -> DataFrame:
    """Rows of docs whose id no leak names.

    The ids are written first, so that their size is known: documents are shuffled only where these are too many to be sent to every task.
    """
    found = C.keep(leaks(docs, benchmark, id_column=id_column, **options).select(F.col("doc_id").alias("leaked_")).distinct(), "leaked")
    return docs.join(found, F.col(id_column).eqNullSafe(F.col("leaked_")), "left_anti")
