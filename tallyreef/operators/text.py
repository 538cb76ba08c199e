"""Word and n-gram frequencies, TF-IDF, clipped overlap scores and batching, on one row for each word."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .base import ranked


def bigrams(lemmas: DataFrame) -> DataFrame:
    """One row for each pair of successive words of a document; none across documents."""
    w = Window.partitionBy("review_id").orderBy("pos")
    return lemmas.withColumn("gram", F.concat_ws(" ", "lemma", F.lead("lemma").over(w))).withColumn("last_", F.lead("lemma").over(w).isNull()).where("NOT last_").drop("last_", "lemma")


def frequencies(rows: DataFrame, term: str = "lemma") -> DataFrame:
    """Occurrences over the number of documents."""
    n = rows.agg(F.count_distinct("review_id").alias("docs"))
    return rows.groupBy(F.col(term).alias("term")).agg(F.count("*").alias("n")).crossJoin(F.broadcast(n)).select("term", "n", (F.col("n") / F.col("docs")).alias("freq"))


def raw_frequencies(grams: DataFrame, lemmas: DataFrame) -> DataFrame:
    """Occurrences over the number of words."""
    n = lemmas.agg(F.count("*").alias("words"))
    return grams.groupBy(F.col("gram").alias("term")).agg(F.count("*").alias("n")).crossJoin(F.broadcast(n)).select("term", "n", (F.col("n") / F.col("words")).alias("freq"))


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Difference of the frequencies of shared terms."""
    return a.select("term", F.col("freq").alias("fa")).join(b.select("term", F.col("freq").alias("fb")), "term").select("term", (F.col("fa") - F.col("fb")).alias("diff"))


def tfidf(rows: DataFrame, term: str, least: int = 5, most: float = 0.8) -> DataFrame:
    """(review_id, term, tf, weight): tf * (ln((1 + n) / (1 + df)) + 1), to length 1 in each document.

    Terms in fewer than least documents or in more than most of all documents are left out; n counts all documents.
    """
    tf = rows.groupBy("review_id", F.col(term).alias("term")).agg(F.count("*").alias("tf"))
    n = rows.agg(F.count_distinct("review_id").alias("docs"))
    df = tf.groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(n)).where((F.col("df") >= least) & (F.col("df") <= F.lit(most) * F.col("docs")))
    w = tf.join(df, "term").withColumn("w", F.col("tf") * (F.ln((1 + F.col("docs")) / (1 + F.col("df"))) + 1))
    length = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("review_id")))
    return w.withColumn("weight", F.col("w") / length).select("review_id", "term", "tf", "weight")


def clipped(pred: DataFrame, ref: DataFrame, keys: list[str]) -> DataFrame:
    """Sum of the lesser counts of each term, and both lengths, by keys; both have keys, term and n."""
    both = pred.select(*keys, "term", F.col("n").alias("np")).join(ref.select(*keys, "term", F.col("n").alias("nr")), [*keys, "term"], "full")
    z = (lambda c: F.coalesce(F.col(c), F.lit(0)))
    return both.groupBy(*keys).agg(F.sum(F.least(z("np"), z("nr"))).alias("common"), F.sum(z("np")).alias("n_pred"), F.sum(z("nr")).alias("n_ref"))


def recall() -> Column:
    return F.coalesce(F.try_divide(F.col("common") * 100.0, F.col("n_ref")), F.lit(0.0))


def precision() -> Column:
    return F.coalesce(F.try_divide(F.col("common") * 100.0, F.col("n_pred")), F.lit(0.0))


def bleu(orders: list[tuple[str, str]], n_pred: str, n_ref: str) -> Column:
    """Geometric mean of clipped precisions times the brevity penalty, of 100; orders: (common, length) of each order.

    Orders that the prediction is too short for are left out.
    """
    logs = [F.when(F.col(n) > 0, F.ln(F.when(F.col(c) > 0, F.col(c) / F.col(n)))) for c, n in orders]
    used = sum((F.when(F.col(n) > 0, 1).otherwise(0) for _, n in orders), F.lit(0))
    zero = F.lit(False)
    for c, n in orders:
        zero = zero | ((F.col(n) > 0) & (F.col(c) == 0))
    total = sum((F.coalesce(x, F.lit(0.0)) for x in logs), F.lit(0.0))
    brevity = F.when(F.col(n_pred) >= F.col(n_ref), F.lit(1.0)).otherwise(F.exp(1 - F.col(n_ref) / F.col(n_pred)))
    return F.when((used == 0) | zero, F.lit(0.0)).otherwise(100 * brevity * F.exp(total / used))


def top_terms(counts: DataFrame, keys: list[str], x: int) -> DataFrame:
    return ranked(counts, keys, [F.desc("n"), "term"], x)


def batches(df: DataFrame, group: str, order: str, words: str, limit: int) -> DataFrame:
    """Rows with the number of their batch: a new one begins where the running sum would go over the limit.

    A first text over the limit by itself begins batch 1. The sum resets, so it runs over a group's rows in order; a group is a
    conversation or an item, whose rows stand in one array.
    """
    rows = F.array_sort(F.collect_list(F.struct(F.col(order), F.col(words).alias("w"))))
    start = F.struct(F.array().cast("array<long>").alias("out"), F.lit(0).cast("long").alias("batch"), F.lit(0).cast("long").alias("sum"))

    def step(acc, row):
        over = acc["sum"] + row["w"] > limit
        batch = acc["batch"] + F.when(over, 1).otherwise(0).cast("long")
        total = F.when(over, row["w"]).otherwise(acc["sum"] + row["w"])
        return F.struct(F.concat(acc["out"], F.array(batch)).alias("out"), batch.alias("batch"), total.alias("sum"))

    got = df.groupBy(group).agg(rows.alias("rows")).withColumn("b", F.aggregate("rows", start, step, lambda acc: acc["out"]))
    return got.select(group, F.explode(F.arrays_zip("rows", "b")).alias("x")).select(group, F.col(f"x.rows.{order}").alias(order), F.col("x.b").alias("batch"))


#: What each kind of prompt asks for.
PROMPTS = {
    "user": "These are one person's comments on several games, a line each. Say what this person likes and dislikes overall.",
    "game": "These are several people's comments on one game, a line each. Say where the game is strong and where it is weak.",
    "generate_comment": "These are comments on one game, a line each. Write a new comment that a person of like mind could have written.",
    "descriptions": "These are descriptions of games, a line each. Say what the games have in common: mechanics, audience, complexity.",
    "desc_summary": "These are descriptions of ten games, a line each. Summarise them one by one.",
    "comment_summary": "These are all comments on one game, a line each. Summarise them briefly.",
    "combine_phrases": "These are phrases about one game, a line each. Make one short comment of them that keeps what matters.",
    "few_shot": "Here are comments and how they were rated. Write a comment for the last rating.",
}


def prompt(kind: str, batches: Column) -> Column:
    """A chat prompt: the request with the first batch, then a message for each further batch."""
    message = (lambda c: F.struct(F.lit("user").alias("role"), c.alias("content")))
    first = F.concat(F.lit(PROMPTS[kind] + "\n"), F.coalesce(F.get(batches, 0), F.lit("")))
    return F.concat(F.array(message(first)), F.transform(F.slice(batches, 2, F.greatest(F.size(batches) - 1, F.lit(0))), message))


def generate(prompts: DataFrame, respond, column: str = "messages") -> DataFrame:
    """Prompts with a response, by any function from a list of messages to text; it runs once for each batch's rows."""
    schema = StructType([*prompts.schema.fields, StructField("response", StringType())])

    def run(frames):
        for pdf in frames:
            yield pdf.assign(response=[respond([dict(m.asDict() if hasattr(m, "asDict") else m) for m in x]) for x in pdf[column]])

    return prompts.mapInPandas(run, schema)


def template_responder(messages_: list[dict]) -> str:
    """Stands in for a model: repeats what the user said."""
    return " ".join(m["content"] for m in messages_ if m["role"] == "user")
