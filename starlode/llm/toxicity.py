"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Training reads a bounded sample of labelled documents (``Settings.max_documents``, the
first ones in the order of a hash of their id); scoring reads every whole text. Only the
non-zero weights leave the training task, at most ``2 ** bits`` of them; they are what
the scoring tasks receive.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as V


@dataclass(frozen=True)
class Settings:
    """max_documents: the bound of the training sample. skips: distances of the word pairs (1: bigrams, more: skip-grams)."""

    max_documents: int = 8192
    bits: int = 22
    skips: tuple[int, ...] = (1, 2, 3)
    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 10.0
    l2: float = 0.0
    epochs: int = 6


@dataclass(frozen=True)
class Model:
    """index (ascending) and weight of the features that L1 has left, and the bias."""

    settings: Settings
    bias: float
    index: np.ndarray
    weight: np.ndarray


def feature_ids(column: pa.Array, settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of all documents, repeats included, and the document that each belongs to."""
    hashes, _, _, first = V.word_hashes(*V.text_bytes(column), V.plain_separators())
    owner = np.repeat(np.arange(len(column)), np.diff(first))
    ids, owners = [V.join_hash(hashes)], [owner]
    for skip in settings.skips:
        same = np.flatnonzero(owner[skip:] == owner[:-skip]) if len(owner) > skip else np.zeros(0, np.int64)
        ids.append(V.join_hash(hashes[same], hashes[same + skip]) + np.uint64(skip))
        owners.append(owner[same])
    return (np.concatenate(ids) >> np.uint64(64 - settings.bits)).astype(np.int64), np.concatenate(owners)


def features(df: DataFrame, settings: Settings) -> DataFrame:
    """(label, ids): the distinct features of each text as little-endian 32-bit numbers."""

    def run(batches):
        for batch in batches:
            for part in V.slices(batch):
                ids, owner = feature_ids(part.column("text"), settings)
                order = np.lexsort((ids, owner))
                edge = np.searchsorted(owner[order], np.arange(part.num_rows + 1))
                sets = [np.unique(ids[order[edge[i] : edge[i + 1]]]).astype("<u4").tobytes() for i in range(part.num_rows)]
                yield pa.RecordBatch.from_arrays([part.column("label"), pa.array(sets, pa.binary())], ["label", "ids"])

    return df.select(F.coalesce("text", F.lit("")).alias("text"), F.col("label").cast("int").alias("label")).mapInArrow(run, "label int, ids binary")


def learn(examples: list[tuple[np.ndarray, int]], settings: Settings) -> tuple[float, np.ndarray, np.ndarray]:
    """FTRL-proximal with a rate per coordinate, one example at a time; the bias is not regularised."""
    size = 1 << settings.bits
    z, n = np.zeros(size + 1, np.float64), np.zeros(size + 1, np.float64)
    order = np.random.default_rng(7)

    def weights(ids: np.ndarray) -> np.ndarray:
        zi = z[ids]
        w = -(zi - np.sign(zi) * settings.l1) / ((settings.beta + np.sqrt(n[ids])) / settings.alpha + settings.l2)
        w[np.abs(zi) <= settings.l1] = 0.0
        free = ids == size
        w[free] = -z[size] / ((settings.beta + np.sqrt(n[size])) / settings.alpha)
        return w

    for _ in range(settings.epochs):
        for k in order.permutation(len(examples)):
            ids, label = examples[k]
            ids = np.append(ids, size).astype(np.int64)
            w = weights(ids)
            gradient = 1.0 / (1.0 + np.exp(-np.clip(w.sum(), -35, 35))) - label
            grown = n[ids] + gradient * gradient
            z[ids] += gradient - (np.sqrt(grown) - np.sqrt(n[ids])) / settings.alpha * w
            n[ids] = grown
    touched = np.flatnonzero(np.abs(z[:size]) > settings.l1)
    return float(weights(np.array([size]))[0]), touched, weights(touched)


def fit(labelled: DataFrame, settings: Settings = Settings()) -> Model:
    """Fits on (doc_id, text, label); rows with a null label or id teach nothing.

    With no usable row the model scores every text 0.5.
    """
    chosen = (
        labelled.where("label IS NOT NULL AND doc_id IS NOT NULL")
        .select("doc_id", "label")
        .groupBy("doc_id")
        .agg(F.max("label").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(settings.max_documents)
    )
    # At most max_documents pairs of numbers: their size is bounded.
    return train(features(sample_of(labelled, chosen), settings), settings)


def sample_of(documents: DataFrame, chosen: DataFrame) -> DataFrame:
    """(doc_id, label, text) of ``chosen`` (doc_id, label), once each: of rows that share an id the smallest text counts."""
    return documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))


def train(examples: DataFrame, settings: Settings) -> Model:
    def run(batches):
        seen = []
        for batch in batches:
            for label, ids in zip(batch.column(0).to_pylist(), batch.column(1)):
                seen.append((np.frombuffer(ids.as_py(), "<u4"), int(label > 0)))
        # The order in which tasks deliver is not fixed.
        seen.sort(key=lambda x: (x[1], len(x[0]), hashlib.blake2b(x[0], digest_size=16).digest()))
        bias, index, weight = learn(seen, settings) if seen else (0.0, np.zeros(0), np.zeros(0))
        yield pa.RecordBatch.from_arrays([pa.array([bias]), pa.array([index.astype("<u4").tobytes()]), pa.array([weight.astype("<f8").tobytes()])], ["bias", "index", "weight"])

    row = examples.repartition(1).mapInArrow(run, "bias double, index binary, weight binary").first()
    return Model(settings, row["bias"], np.frombuffer(row["index"], "<u4"), np.frombuffer(row["weight"], "<f8"))


def score(df: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """``df`` with the score (0 to 1, higher: likelier toxic) of its whole ``text`` as column ``name``; null and empty texts get the bias's score.

    A column of ``df`` called ``name`` is replaced.
    """
    from pyspark.sql import types as T

    df = df.drop(name)
    schema = T.StructType([*df.schema.fields, T.StructField(name, T.DoubleType(), False)])
    settings, bias = model.settings, model.bias
    # At most 2 ** bits weights.
    shared = df.sparkSession.sparkContext.broadcast((np.asarray(model.index, np.int64), np.asarray(model.weight, np.float32)))

    def run(batches):
        index, weight = shared.value
        at = np.zeros(1 << settings.bits, bool)
        at[index] = True
        for batch in batches:
            for part in V.slices(batch):
                text = part.column(part.schema.get_field_index("text"))
                ids, owner = feature_ids(text, settings)
                hit = np.flatnonzero(at[ids])
                pairs = np.unique((owner[hit] << settings.bits) | ids[hit])  # each feature counts once a document
                found = weight[np.searchsorted(index, pairs & (len(at) - 1))] if len(pairs) else np.zeros(0, np.float32)
                logit = bias + np.bincount(pairs >> settings.bits, found, part.num_rows)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(1.0 / (1.0 + np.exp(-np.clip(logit, -35, 35))))], [*part.schema.names, name])

    return df.mapInArrow(run, schema)


def held_out(column: str = "doc_id"):
    return F.crc32(F.col(column).cast("string")) % 5 == 0


def model_for(documents: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model:
    """The model of the labelled documents that are not held out.

    The sample is drawn from ``labels`` alone, so only the texts of its documents move. Of
    several labels of an id the largest counts, of several texts the smallest, so repeated
    rows don't enlarge the sample; null texts are empty, null labels and ids teach nothing.
    """
    chosen = (
        labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL")
        .where(~held_out())
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("label"))
        .join(documents.select("doc_id").distinct(), "doc_id", "left_semi")
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(settings.max_documents)
    )
    return train(features(sample_of(documents, chosen), settings), settings)


def op1_toxicity(spark, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = model_for(documents, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(documents, model).select(
        "doc_id",
        F.coalesce(held_out(), F.lit(False)).alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"),
    )
