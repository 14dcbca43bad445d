"""Toxicity by logistic regression on hashed word n-grams and skip-grams, trained with FTRL-proximal.

Every coordinate has its own learning rate, and L1 keeps the weights sparse, so the fitted model is
a short list of (index, weight) that is broadcast to score all texts.  The learner is sequential and
sees a bounded sample of labelled rows (``max_rows``) as a stream in one task; scoring is a map
over all documents.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logquarry.llm.common import fresh, quoted, rows_of, ship_package, text_or_empty

# Words hashed at once: bounds memory for very long texts.
BLOCK_WORDS = 65_536
# Distances of the pairs of words: neighbours, and words with one or two others between.
GAPS = (1, 2, 3)
_KEEP = bytes(c if chr(c).isalnum() or c >= 128 else 32 for c in range(256))
_MIX = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Model:
    """Sparse weights over ``2**bits`` coordinates."""

    bits: int
    bias: float
    index: np.ndarray
    weight: np.ndarray


def features(text: str | None, bits: int) -> Iterator[np.ndarray]:
    """Blocks of the coordinates of words, neighbours and skip-grams, with repeats.

    Words are runs of letters and digits in lower case; a text without any has no coordinate.
    """
    words = text.lower().encode("utf-8", "replace").translate(_KEEP).split() if text else []
    shift = np.uint64(64 - bits)
    reach = max(GAPS)
    for at in range(0, len(words), BLOCK_WORDS):
        part = words[at : at + BLOCK_WORDS + reach]
        own = min(len(part), BLOCK_WORDS)
        code = np.fromiter(map(zlib.crc32, part), np.uint64, len(part)) * _MIX
        mixed = [code[:own]]
        for gap in GAPS:
            left = code[: max(0, min(own, len(code) - gap))]
            right = code[gap : gap + len(left)]
            mixed.append((left ^ (right >> np.uint64(29)) ^ np.uint64(gap)) * _MIX + right)
        yield (np.concatenate(mixed) * _MIX >> shift).astype(np.int32)


class FtrlProximal:
    """FTRL-proximal for binary coordinates and a bias without L1."""

    def __init__(self, bits: int, alpha: float, beta: float, l1: float, l2: float) -> None:
        self.bits, self.alpha, self.beta, self.l1, self.l2 = bits, alpha, beta, l1, l2
        # The bias is the last coordinate.
        self.z, self.n = np.zeros(2**bits + 1), np.zeros(2**bits + 1)

    def weights(self, index: np.ndarray) -> np.ndarray:
        """The weights that the sums imply at these coordinates."""
        z = self.z[index]
        l1 = np.where(index == 2**self.bits, 0.0, self.l1)
        rate = (self.beta + np.sqrt(self.n[index])) / self.alpha + self.l2
        return np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / rate)

    def learn(self, index: np.ndarray, label: int) -> None:
        """One step on an example given by its distinct coordinates."""
        index = np.append(index, 2**self.bits)
        w = self.weights(index)
        g = sigmoid(float(w.sum())) - label
        n = self.n[index]
        self.z[index] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[index] = n + g * g


def sigmoid(x: float) -> float:
    """The logistic function, without overflow."""
    return 1 / (1 + math.exp(-x)) if x >= 0 else 1 - 1 / (1 + math.exp(x))


def fit(
    labelled: DataFrame,
    text_col: str,
    label_col: str,
    order_col: str,
    bits: int = 20,
    epochs: int = 2,
    alpha: float = 2.0,
    beta: float = 1.0,
    l1: float = 3.5,
    l2: float = 0.0,
) -> Model:
    """A model of a bounded table of labelled texts, read ``epochs`` times by one task in ``order_col``.

    No row gives the model that scores every text 0.5.
    """
    ship_package(labelled.sparkSession)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learner = FtrlProximal(bits, alpha, beta, l1, l2)
        for text, label in rows_of(batches):
            blocks = [np.unique(block) for block in features(text, bits)]
            learner.learn(np.unique(np.concatenate(blocks)) if blocks else np.empty(0, np.int32), label)
        weight = learner.weights(np.arange(2**bits + 1))
        kept = np.flatnonzero(weight[:-1]).astype(np.int32)
        row = [[float(weight[-1])], [kept.tobytes()], [weight[kept].astype(np.float32).tobytes()]]
        kinds = [pa.float64(), pa.binary(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(*x) for x in zip(row, kinds, strict=True)], ["bias", "i", "w"])

    passes = F.explode(F.sequence(F.lit(1), F.lit(epochs))).alias("epoch")
    rows = labelled.select(F.col(text_col).alias("text"), F.col(label_col).cast("int").alias("label"), order_col, passes)
    stream = rows.repartition(1).sortWithinPartitions("epoch", order_col).select("text", "label")
    found = stream.mapInArrow(learn, "bias double, i binary, w binary").first()
    if found is None:
        return Model(bits, 0.0, np.empty(0, np.int32), np.empty(0, np.float32))
    return Model(bits, found.bias, np.frombuffer(found.i, np.int32), np.frombuffer(found.w, np.float32))


def score(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with the probability of label 1 in ``score_col``, whose place it takes where there is one.

    A text without words gets the model's base rate.
    """
    ship_package(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def of(texts: pd.Series) -> pd.Series:
        model = sent.value
        dense = np.zeros(2**model.bits, np.float32)
        dense[model.index] = model.weight

        def one(text: str | None) -> float:
            hits = [block[dense[block] != 0] for block in features(text, model.bits)]
            seen = np.unique(np.concatenate(hits)) if hits else np.empty(0, np.int32)
            return sigmoid(model.bias + float(dense[seen].sum(dtype=np.float64)))

        return pd.Series([one(text) for text in texts], dtype="float64")

    return docs.withColumn(score_col, of(quoted(text_col)))


def held_out(id_col: str):
    """Whether a row is kept from the learner: crc32 of its id as text, modulo 3, is 1."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1


def toxicity_model(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    max_rows: int = 24_000,
    **options: float,
) -> Model:
    """A model of the labelled documents that are not held out.

    At most ``max_rows`` rows take part, those with the smallest hashes of their ids: a bounded sample
    with the labels' own shares, which one task reads in the order of the hashes.  Labels other than
    0 and 1 and null ids are left out; a document with several labels takes part once for each.
    """
    usable = labels.where(F.col(label_col).isin(0, 1) & ~held_out(id_col))
    usable = usable.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_label")).distinct()
    usable = usable.withColumn("_order", F.xxhash64("_id"))
    sample = F.broadcast(usable.orderBy("_order", "_id", "_label").limit(max_rows))  # small rows of a bounded number
    texts = docs.select(quoted(id_col).alias("_id"), text_or_empty(quoted(text_col)).alias("_text"))
    return fit(texts.join(sample, "_id"), "_text", "_label", "_order", **options)


def toxicity(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    threshold: float = 0.7,
    **options: float,
) -> DataFrame:
    """``(<id_col>, held_out, score, predicted)`` for every row of ``docs``.

    ``score`` looks at the text alone.  A null text counts as empty; a null id is not held out;
    repeated rows stay; other columns are not read.  An empty table gives no rows.
    """
    model = toxicity_model(docs, labels, id_col, text_col, label_col, **options)
    scored = score(docs.select(id_col, F.col(text_col).alias("_text")), model, "_text", "_score")
    out = scored.select(
        id_col,
        F.coalesce(held_out(id_col), F.lit(False)).alias("held_out"),
        F.col("_score").alias("score"),
        (F.col("_score") >= threshold).cast("int").alias("predicted"),
    )
    return out


def drop_toxic(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    threshold: float = 0.7,
    **options: float,
) -> DataFrame:
    """``docs`` without the rows that score ``threshold`` or more; all columns are kept as they are."""
    model = toxicity_model(docs, labels, id_col, text_col, label_col, **options)
    own = fresh(docs, "_toxicity")
    return score(docs, model, text_col, own).where(quoted(own) < threshold).drop(quoted(own))
