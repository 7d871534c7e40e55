"""The corpus pipeline: toxicity filter, n-gram Jaccard dedup, substring dedup, packing.

Each stage takes (spark, docs, sf_dir), works on all that the stage before it kept, and
returns a DataFrame: the columns of documents, but for the last one, which returns packed
pieces. ``run`` writes every stage's result to the shared folder and reads it back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starlode.llm import common, jaccard_join, packing, substring_dedup, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below 0.5 stay. The model learns from the labelled documents that are not held out.

    Null and empty texts have the bias's score. Each row is judged by its own text; without
    usable labels every score is 0.5 and nothing could be told apart, so all rows stay.
    """
    model = toxicity.model_for(docs.select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    limit = 0.5 if len(model.index) else 1.1
    return toxicity.score(docs, model, "__toxicity").where(F.col("__toxicity") < limit).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that links of similar shingle sets connect, the row with the smallest id stays (the first of several).

    Sets are of five-word shingles at a Jaccard similarity of 0.8. Rows are judged by their
    own sets, also those that share an id. Documents without words or without an id stay.
    """
    found = jaccard_join.components_of(spark, docs, jaccard_join.Settings(k=5, num=80, den=100))
    gone = found.where("NOT stays").select(F.col("row").alias("__row"))
    return docs.withColumn("__row", F.monotonically_increasing_id()).join(gone, "__row", "left_anti").select(*docs.columns)


def cut_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that a document with a smaller id holds are cut out; n_chars follows the text.

    Rows that share an id keep each their own text's passages; rows without id or text stay
    as they are. A document of which nothing is left goes.
    """
    scratch = common.Scratch(spark, "substring")
    found = scratch.keep(substring_dedup.passages(spark, docs, scratch=scratch), "passages")
    cut = substring_dedup.without(docs, found)
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return cut.select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each packed piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts are a piece of the end id alone; rows that share an id, or have
    none, are packed each on its own.
    """
    import public_tokenizers

    return packing.pack(spark, docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("jaccard_join", drop_near_copies),
    ("substring_dedup", cut_passages),
    ("best_fit_packing", pack_sequences),
]

#: The trained, fuzzy and packing stages have no SQL; tests/llm holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = common.Scratch(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
