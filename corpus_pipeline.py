"""The corpus pipeline: toxic documents go, near copies go, repeated passages go, sources are mixed, the rest is packed.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as
the next stage's documents. All but the last return the columns of `documents`. Every stage works on all that
the one before it kept. Empty input gives empty output; nulls are as the operators' modules say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docloom.llm.common import documents, drop, ready, store
from docloom.llm.queries import tokenizer_path

#: SQL cannot express the fitted field of the first stage, nor the tokens of the last.
ORACLE_SQL = None

#: Bytes of a passage that counts as repeated: passages of over fifty words are longer.
PASSAGE_BYTES = 200


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity operator does not reject; it learns from labelled documents as its query does."""
    from docloom.llm.toxicity import fit, keep_clean

    ready(spark)
    return keep_clean(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of 5-word shingle sets with similarity 0.8 or more."""
    from docloom.llm.ngram_join import keep_first

    return keep_first(docs, 5, 8, 10)


def drop_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings of `PASSAGE_BYTES` bytes that also start elsewhere."""
    from docloom.llm.suffix_dedup import strip_repeats

    return strip_repeats(docs, PASSAGE_BYTES)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target weight asks for."""
    from docloom.llm.mixing import mix

    return mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in the training sequences."""
    from docloom.llm.packing import pack

    return pack(docs, tokenizer_path("word_bpe_49k.json"), "words", 1, 4096)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_copies),
    ("suffix_array_dedup", drop_passages),
    ("mixing", mix_sources),
    ("best_fit_packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        before, docs = docs, store(stage(spark, docs, sf_dir), f"stage-{name}")
        drop(before)
    return docs
