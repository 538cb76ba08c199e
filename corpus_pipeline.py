"""A corpus pipeline: each stage takes (spark, docs, sf_dir) and returns a DataFrame, written as Parquet and read again as the next one's docs.

Every stage works on all that its predecessor kept. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyreef.llm import _common as C
from tallyreef.llm import decontaminate, jaccard, langid, mixing, tokens
from tallyreef.llm.queries import END_ID, SOURCE_WEIGHTS, vocabulary_path


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that can be told. Those without a letter, and null texts, go. lang becomes what was found.

    The model learns from the labelled rows of docs that op5_language learns from.
    """
    model = langid.train(docs.where(C.fold("doc_id", 3) != 1).select("doc_id", "text", "lang"))
    # the whole row goes through Python, so that nothing has to be joined, under names that clash with none
    own = {c: f"doc_{c}" for c in docs.columns}
    found = langid.identify(docs.withColumnsRenamed(own), model, list(own.values()), text=own["text"])
    kept = found.where(F.col("lang_pred") != "und").withColumn(own["lang"], F.col("lang_pred"))
    return kept.select(*[F.col(name).alias(c) for c, name in own.items()])


def join_ngrams(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one of the least id."""
    return jaccard.keep_one(docs)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontaminate.without_leaks(docs, C.table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order in which sources are mixed to their target weights: over the files and within each."""
    return mixing.in_order(mixing.mix(docs, SOURCE_WEIGHTS))


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, as read back from token files in the order of the mix.

    The order is that of the files that the stage before wrote; docs that come from no file go by id.
    """
    if docs.inputFiles():
        place = docs.select("doc_id", "text", F.regexp_extract(F.col("_metadata.file_name"), r"part-(\d+)", 1).cast("long").alias("file_"), F.col("_metadata.file_name").alias("name_"), F.col("_metadata.row_index").alias("row_"))
        return tokens.token_shards(place, vocabulary_path(), END_ID, order=["file_", "name_", "row_"])
    return tokens.token_shards(docs, vocabulary_path(), END_ID)


STAGES = [
    ("language ID", identify_language),
    ("n-gram Jaccard join", join_ngrams),
    ("benchmark decontamination", decontaminate_benchmark),
    ("mixing sources to target weights", mix_sources),
    ("token-ID / binary output", write_tokens),
]

#: No SQL expresses a learned language model or the tokenizer; tests/llm holds the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; the tables between them lie in the shared folder."""
    docs = C.table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = C.keep(docs, f"stage{k}")
    return docs
