"""Cleaning, k-core filtering, centring, normalising and splits of ratings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .base import ranked, shuffled


def kcore(df: DataFrame, least: int, rounds: int = 10, strict: bool = False, user: str = "user_id", item: str = "item_id") -> DataFrame:
    """Keep users, then items among what is left, with at least (strict: more than) so many rows, until nothing changes.

    Stops when a round keeps all rows, when none are left or after so many rounds; a checkpoint cuts lineage each round.
    """
    if df.sparkSession.sparkContext.getCheckpointDir() is None:
        _checkpoint_dir(df.sparkSession)
    enough = (F.col("n_") > least) if strict else (F.col("n_") >= least)
    before = -1
    for _ in range(rounds):
        for key in (user, item):
            kept = df.groupBy(key).agg(F.count("*").alias("n_")).where(enough).select(key)
            df = df.join(kept, key, "left_semi")
        df = df.checkpoint(eager=True)
        now = df.count()
        if now in (before, 0):
            break
        before = now
    return df


def _checkpoint_dir(spark) -> None:
    import tempfile

    spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="tallyreef-"))


def kcore_sweep(df: DataFrame, thresholds, rounds: int = 10) -> DataFrame:
    """Users, items and rows that survive kcore() with each threshold, without a copy of the rows for each.

    Rows are written twice, by user and by item, as lists. For all thresholds at once, the numbers of rows that users and items have
    left are kept (below zero: gone); what leaves in a round takes one from each of its partners. User and item are unique together.
    """
    spark, ts = df.sparkSession, [int(t) for t in thresholds]
    if spark.sparkContext.getCheckpointDir() is None:
        _checkpoint_dir(spark)
    # once for both orders, which are made of it
    rows = df.select(F.col("user_id").alias("u"), F.col("item_id").alias("i")).checkpoint(eager=True)
    # in joins a null meets nothing, so its rows are gone from the start
    rows = rows.where("u IS NOT NULL AND i IS NOT NULL")
    order = [(x, y, rows.groupBy(F.col(x).alias("id")).agg(F.collect_list(y).alias("to")).checkpoint(eager=True)) for x, y in (("u", "i"), ("i", "u"))]
    of_users, of_items = (t for _, _, t in order)
    users, items = (t.select("id", F.array_repeat(F.size("to"), len(ts)).alias("left")) for t in (of_users, of_items))

    def leave(own: DataFrame, partners: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame, int]:
        """own without those that have too few rows, and partners without their rows; how many went."""
        gone = F.array(*[(F.col("left")[k].between(0, t - 1)).cast("int") for k, t in enumerate(ts)])
        marked = own.select("id", "left", gone.alias("gone"))
        out = marked.where(F.exists("gone", lambda x: x == 1)).select("id", "gone").checkpoint(eager=True)
        n = out.count()
        if not n:
            return own, partners, 0
        own = marked.select("id", F.zip_with("left", "gone", lambda x, y: F.when(y == 1, -1).otherwise(x)).alias("left")).checkpoint(eager=True)
        lost = links.join(out, "id").select(F.explode("to").alias("id"), "gone").groupBy("id").agg(*[F.sum(F.col("gone")[k]).cast("int").alias(f"g{k}") for k in range(len(ts))])
        less = F.array(*[F.when(F.col("left")[k] < 0, -1).otherwise(F.col("left")[k] - F.coalesce(f"g{k}", F.lit(0))) for k in range(len(ts))])
        return own, partners.join(lost, "id", "left").select("id", less.alias("left")).checkpoint(eager=True), n

    for _ in range(rounds):
        users, items, a = leave(users, items, of_users)
        items, users, b = leave(items, users, of_items)
        if not a + b:
            break
    count = (lambda t, k: F.count_if(F.col("left")[k] > 0).alias(f"n{k}"))
    n_users = users.agg(*[count(users, k) for k in range(len(ts))]).first()
    n_items = items.agg(*[count(items, k) for k in range(len(ts))], *[F.sum(F.greatest(F.col("left")[k], F.lit(0)).cast("long")).alias(f"r{k}") for k in range(len(ts))]).first()
    found = [(t, n_users[f"n{k}"], n_items[f"n{k}"], n_items[f"r{k}"] or 0) for k, t in enumerate(ts)]
    return spark.createDataFrame(found, "threshold long, n_users long, n_items long, n_rows long")


def center(df: DataFrame, user: str = "user_id", value: str = "rating") -> DataFrame:
    """Rating less the user's mean, and the mean."""
    w = Window.partitionBy(user)
    return df.withColumn("mean", F.avg(value).over(w)).withColumn("centered", F.col(value) - F.col("mean"))


def normalize(df: DataFrame, user: str = "user_id", value: str = "rating") -> DataFrame:
    """Rating between the user's least and greatest; 0 where they are equal."""
    w = Window.partitionBy(user)
    low, high = F.min(value).over(w), F.max(value).over(w)
    return df.withColumn("min", low).withColumn("max", high).withColumn("normalized", F.coalesce(F.try_divide(F.col(value) - F.col("min"), F.col("max") - F.col("min")), F.lit(0.0)))


def biases(df: DataFrame) -> DataFrame:
    """Rating, overall mean, user and item bias and what is left; the item's bias is taken after the user's."""
    u, i = Window.partitionBy("user_id"), Window.partitionBy("item_id")
    mu = df.agg(F.avg("rating").alias("mu"))
    out = df.crossJoin(F.broadcast(mu)).withColumn("bu", F.avg(F.col("rating") - F.col("mu")).over(u))
    out = out.withColumn("bi", F.avg(F.col("rating") - F.col("mu") - F.col("bu")).over(i))
    return out.withColumn("residual", F.col("rating") - F.col("mu") - F.col("bu") - F.col("bi"))


def split_global(df: DataFrame, part: float = 0.2) -> DataFrame:
    """Every row with hidden: true for floor(part * n) rows, by the repeatable order.

    The cut is a threshold on the order's values, so that no task ranks all rows; only rows of the value cut through are ranked.
    """
    keyed = df.withColumn("h_", shuffled("user_id", "item_id"))
    per = keyed.groupBy("h_").agg(F.count("*").alias("c_"))
    w = Window.orderBy("h_").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cum = per.withColumn("upto_", F.sum("c_").over(w)).crossJoin(F.broadcast(per.agg(F.floor(F.sum("c_") * F.lit(part)).alias("n_"))))
    cum = cum.withColumn("room_", F.col("n_") - F.col("upto_") + F.col("c_")).select("h_", "c_", "room_")
    joined = keyed.join(cum, "h_")
    inner = Window.partitionBy("h_").orderBy("user_id", "item_id")
    return joined.withColumn("hidden", F.row_number().over(inner) <= F.col("room_")).drop("h_", "c_", "room_")


def split_per_user(df: DataFrame, part: float = 0.3) -> DataFrame:
    """Every row with hidden: true for floor(part * n) rows of each user."""
    w = Window.partitionBy("user_id")
    out = ranked(df.withColumn("n_", F.count("*").over(w)), "user_id", [shuffled("user_id", "item_id"), "item_id"], name="k_")
    return out.withColumn("hidden", F.col("k_") <= F.floor(F.col("n_") * F.lit(part))).drop("n_", "k_")


def activity_class(n: Column) -> Column:
    """Half-open classes of numbers of ratings."""
    return F.when(n < 10, "under 10").when(n < 50, "10-49").when(n < 100, "50-99").when(n < 200, "100-199").otherwise("200 and more")
