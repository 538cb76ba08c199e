"""One query for each operator, over its whole table and with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _common as C
from . import ann, chat, decontaminate, jaccard, langid, lines, mixing, passages, quality, tokens

#: The document's end in token files.
END_ID = 2

#: How far pruning is relaxed in neighbour search, by recall against brute force; 1 is exact.
ANN_FACTOR = 5.0


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "labels")
    seen = labels.where(C.fold("doc_id", 5) != 0).select("doc_id", "quality")
    model = quality.train(docs, seen)
    held = docs.select("doc_id", "text", (C.fold("doc_id", 5) == 0).alias("held_out"))
    out = quality.score(held, model, ["doc_id", "held_out"])
    return out.select("doc_id", "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op2_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeats(C.table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_shards(C.table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary_path(), END_ID)


#: Target weights of the sources; those not named share one part.
SOURCE_WEIGHTS = {f"src{k}": 1 + k % 4 for k in range(20)}


def op4_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(C.table(spark, sf_dir, "documents").select("doc_id", "source"), SOURCE_WEIGHTS)
    return mixed.select("doc_id", "source", F.col("mix_block_").alias("block"), F.col("mix_slot_").alias("slot"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents")
    model = langid.train(docs.where(C.fold("doc_id", 3) != 1).select("doc_id", "text", "lang"))
    held = docs.select("doc_id", "text", (C.fold("doc_id", 3) == 1).alias("held_out"))
    return langid.identify(held, model, ["doc_id", "held_out"]).select("doc_id", "held_out", "lang_pred", "score")


def op6_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.classes(C.table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.classes(C.table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    turns = C.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], turns.schema)
    return chat.digest(C.keep(chat.render(turns.unionByName(more)), "rendered"))


def op9_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = C.table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return ann.search(vectors, vectors.where(F.col("vec_id") % 50 == 0), k=5, factor=ANN_FACTOR)


def op10_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(C.table(spark, sf_dir, "documents").select("doc_id", "text"), C.table(spark, sf_dir, "benchmark"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {
        "pipeline": pipeline,
        "op1_quality": op1_quality,
        "op2_passages": op2_passages,
        "op3_tokens": op3_tokens,
        "op4_mix": op4_mix,
        "op5_language": op5_language,
        "op6_jaccard": op6_jaccard,
        "op7_lines": op7_lines,
        "op8_chat": op8_chat,
        "op9_neighbours": op9_neighbours,
        "op10_leaks": op10_leaks,
    }


def oracle_sql() -> dict:
    return {}
