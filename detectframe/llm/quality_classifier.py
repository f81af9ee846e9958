"""Quality classifier: Naive Bayes support vectors over byte n-gram indicators.

Indicators of byte 1- to 4-grams are scaled by the class log-count ratios of the labelled rows, a linear
hinge-loss model is fitted by dual coordinate descent, and its margins become probabilities.

The fit uses at most ``PER_CLASS`` labelled rows of each class (least hashes of their ids), whole texts; it
runs in one task over that bounded sample.  Every document is scored in one pass without a shuffle.

NULL and empty texts score by the model's bias.  Repeated documents score alike.  Repeated labels of one id
count once (the smallest).  Without labels every score is 0.5; with one class only, its smoothed share.
Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from detectframe.llm.common import one_each, strings
from detectframe.llm.features import RAW, bayes_score, bayes_support_vectors, slots

#: Bound of the fit: labelled rows per class.
PER_CLASS = 4000
BITS, ORDERS = 16, (1, 2, 3, 4)


def present_slots(text: pa.Array) -> Iterator[np.ndarray]:
    """Distinct slots of every text."""
    data, offsets, _ = strings(text)
    flags = np.zeros(1 << BITS, bool)
    for _, found in slots(data, offsets, RAW, ORDERS, BITS):
        flags[found] = True
        at = np.flatnonzero(flags)
        flags[at] = False
        yield at


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int) -> DataFrame:
    """``doc_id, y, text`` of at most ``per_class`` labelled documents of each class 0 and 1.

    The chosen ids are bounded by 2 * per_class, so they are broadcast and no text is shuffled.  An id that comes
    in several rows has all of them here.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(label).alias("y"))
    known = known.withColumn("h", F.xxhash64("doc_id"))
    parts = [known.where(F.col("y") == y).orderBy("h", "doc_id").limit(per_class) for y in (0, 1)]
    chosen = parts[0].unionByName(parts[1]).select("doc_id", "y")
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = PER_CLASS) -> tuple[np.ndarray, np.ndarray, float] | None:
    """(weights, squares, shift) for :func:`score`, or None without labels."""

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [x.astype(np.uint16).tobytes() for x in present_slots(b.column("text"))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("y"), pa.array(found, pa.binary())], ["doc_id", "y", "x"])

    def learn(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pdf = pd.concat([pd.DataFrame({"doc_id": [], "y": [], "x": []}), *frames]).sort_values("doc_id", kind="stable")
        if len(pdf):
            rows = [np.frombuffer(x, np.uint16).astype(np.int64) for x in pdf["x"]]
            weight, square, shift, _ = bayes_support_vectors(rows, np.where(pdf["y"].to_numpy() == 1, 1, -1), 1 << BITS)
            yield pd.DataFrame({"weight": [weight.tobytes()], "square": [square.tobytes()], "shift": [shift]})

    sample = labelled_sample(docs, labels, label, per_class).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("y").cast("int").alias("y"), "text")
    found = one_each(sample.mapInArrow(features, "doc_id long, y int, x binary"), "doc_id").repartition(1).mapInPandas(learn, "weight binary, square binary, shift double").collect()
    if not found:
        return None
    return np.frombuffer(found[0]["weight"]), np.frombuffer(found[0]["square"]), float(found[0]["shift"])


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float] | None) -> DataFrame:
    """``doc_id, score`` for every document."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if model is None:
                got = [0.5] * b.num_rows
            else:
                got = [bayes_score(x, *model) for x in present_slots(b.column("text"))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(got, pa.float64())], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(judge, "doc_id long, score double")


def fold(doc_id: str, n: int) -> Column:
    """crc32 of the id as text, modulo n."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % n


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality", held: tuple[int, int] = (3, 1), per_class: int = PER_CLASS) -> DataFrame:
    """``doc_id, held_out, score, predicted``; labels of the held-out fold are never learned."""
    n, part = held
    model = fit(docs, labels.where(F.coalesce(fold("doc_id", n) != part, F.lit(False))), label, per_class)
    return score(docs, model).select(
        "doc_id", F.coalesce(fold("doc_id", n) == part, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
