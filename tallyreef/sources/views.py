"""Domain relations over the driver's tables: ratings, items, comments, lemmas, phrases and turns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def ratings(spark, sf) -> DataFrame:
    """Sparse user x item ratings, repeated purchases averaged."""
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("user_id"))
    li = table(spark, sf, "lineitem").select("l_orderkey", F.col("l_partkey").alias("item_id"), "l_quantity")
    return li.join(o, li.l_orderkey == o.o_orderkey).groupBy("user_id", "item_id").agg((F.avg("l_quantity") / 5.0).alias("rating"))


def ratings_dense(spark, sf) -> DataFrame:
    """Half-filled user x item ratings from events."""
    e = table(spark, sf, "events").select("user_id", F.get_json_object("props", "$.k").cast("long").alias("item_id"), "value")
    return e.groupBy("user_id", "item_id").agg((F.avg(F.least("value", F.lit(50.0))) / 5.0).alias("rating"))


def items(spark, sf) -> DataFrame:
    p = table(spark, sf, "part")
    tags = F.concat_ws("|", "p_type", "p_brand", F.replace("p_name", F.lit(" "), F.lit("|")))
    return p.select(F.col("p_partkey").alias("item_id"), F.col("p_name").alias("name"), tags.alias("tags"), (F.col("p_size") % 30).alias("cluster"), F.col("p_retailprice").alias("price"))


def comments(spark, sf) -> DataFrame:
    d, b = table(spark, sf, "documents"), table(spark, sf, "labels").select("doc_id", "quality")
    polarity = F.when(F.col("quality") == 1, "positive").when(F.col("quality") == 0, "negative")
    return d.join(b, "doc_id", "left").select(F.col("doc_id").alias("review_id"), (F.col("doc_id") % 15).alias("user_id"), (F.col("doc_id") % 20).alias("item_id"), "lang", "text", polarity.alias("polarity"))


def words(text):
    """Words between runs of punctuation and white space."""
    return F.filter(F.split(F.regexp_replace(text, r"[\p{Punct}\s]+", " "), " "), lambda x: x != "")


def lemmas(spark, sf) -> DataFrame:
    """One row for each word of a comment, in lower case, with its place from 1."""
    c = comments(spark, sf)
    rows = c.select("review_id", "user_id", "item_id", "polarity", F.posexplode(words(F.col("text"))).alias("p", "tok"))
    return rows.select("review_id", "user_id", "item_id", "polarity", (F.col("p") + 1).cast("long").alias("pos"), F.lower("tok").alias("lemma"))


def comment_bigrams(spark, sf) -> DataFrame:
    """One row for each pair of successive words of a comment, in lower case; none across comments, and nothing is shuffled."""
    w = F.transform(words(F.col("text")), F.lower)
    rows = comments(spark, sf).select("user_id", "item_id", w.alias("w")).withColumn("more", F.greatest(F.size("w") - 1, F.lit(0)))
    pairs = F.zip_with(F.slice("w", F.lit(1), F.col("more")), F.slice("w", F.lit(2), F.col("more")), lambda x, y: F.concat_ws(" ", x, y))
    return rows.select("user_id", "item_id", F.explode(pairs).alias("gram"))


def phrases(spark, sf) -> DataFrame:
    e, d = table(spark, sf, "embeddings"), table(spark, sf, "documents").select("doc_id", "text")
    return e.join(d, e.vec_id == d.doc_id, "left").select(F.col("vec_id").alias("phrase_id"), (F.col("vec_id") % 15).alias("user_id"), (F.col("vec_id") % 20).alias("item_id"), F.col("label").alias("cluster"), "embedding", F.col("text").alias("phrase"))


def word_count(text):
    """Words between runs of white space."""
    return F.size(F.filter(F.split(F.regexp_replace(text, r"\s+", " "), " "), lambda x: x != "")).cast("long")


def turns(spark, sf) -> DataFrame:
    return table(spark, sf, "conversations").select("conv_id", "turn", "text", word_count(F.col("text")).alias("n_words"))


def item_tags(spark, sf) -> DataFrame:
    """One row for each distinct tag of an item."""
    return items(spark, sf).select("item_id", "cluster", F.explode(F.array_distinct(F.split("tags", r"\|"))).alias("tag"))
