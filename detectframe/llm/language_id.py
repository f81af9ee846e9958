"""Language identification in two levels: the family by multinomial Naive Bayes, then one-versus-one linear
support vector machines between the languages of that family.

Features are hashed byte 1- to 4-grams of the lower-cased letters.  The fit uses at most ``PER_LANGUAGE``
rows of each language (least hashes of their ids), whole texts, one task per family; scoring is one pass
without a shuffle.

A text that is NULL or has no letter is ``und`` with score 0.  Repeated rows are judged alike.  Without
languages to learn every text with a letter is ``und``.  Languages outside ``FAMILIES`` are families of their
own.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from detectframe.llm.common import chunks, one_each, release, released, strings
from detectframe.llm.features import GRAM_BYTES, LETTERS, byte_grams, hinge_fit, sigmoid_fit

#: Bound of the fit: rows per language.  Spark keeps ranks up to 1000 per group in each task before the shuffle.
PER_LANGUAGE = 1000
BITS, ORDERS = 15, (1, 2, 3, 4)
#: Family of a language code.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af".split(),
    "romance": "fr es it pt ro ca gl".split(),
    "slavic": "ru uk be pl cs sk bg sr hr sl mk".split(),
}
_FAMILY_OF = {lang: family for family, langs in FAMILIES.items() for lang in langs}


def family_of(lang: str) -> str:
    return _FAMILY_OF.get(lang, lang)


def gram_slots(text: pa.Array) -> Iterator[np.ndarray]:
    """Slots of all n-grams of every text, with repeats."""
    data, offsets, _ = strings(text)
    for a, b in chunks(offsets, GRAM_BYTES):
        lo = int(offsets[a])
        part = LETTERS[data[lo : int(offsets[b])]]
        grams = [(n, byte_grams(part, n, BITS)) for n in ORDERS]
        for row in range(a, b):
            s, e = int(offsets[row]) - lo, int(offsets[row + 1]) - lo
            yield np.concatenate([g[s : max(s, e - n + 1)] for n, g in grams])


def _has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE) -> dict | None:
    """Model from ``doc_id, text, lang``; None if no row has a language."""
    known = docs.where("lang IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "lang", F.xxhash64("doc_id").alias("h"))
    first = Window.partitionBy("lang").orderBy("h", "doc_id")
    chosen = known.withColumn("r", F.row_number().over(first)).where(F.col("r") <= per_language).select("doc_id", "lang").distinct()
    sample = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang").join(F.broadcast(chosen), ["doc_id", "lang"])

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found, total = [], []
            for x in gram_slots(b.column("text")):
                count = np.bincount(x, minlength=1 << BITS)
                at = np.flatnonzero(count)
                found.append(at.astype(np.uint16).tobytes())
                total.append(count[at].astype(np.int32).tobytes())
            families = pa.array([family_of(x) for x in b.column("lang").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("lang"), families, pa.array(found, pa.binary()), pa.array(total, pa.binary())], ["doc_id", "lang", "family", "x", "c"])

    def learn(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["lang", "doc_id"], kind="stable")
        at = [np.frombuffer(x, np.uint16) for x in pdf["x"]]
        count = [np.frombuffer(c, np.int32) for c in pdf["c"]]
        value = [10.0 * c / max(c.sum(), 1) for c in count]
        total = np.zeros(1 << BITS)
        for x, c in zip(at, count):
            total[x] += c / max(c.sum(), 1)  # every document weighs the same
        out = [(pdf["family"].iloc[0], "", "", total.tobytes(), 1.0, 0.0)]
        langs = pdf["lang"].to_numpy()
        for a, b in combinations(sorted(set(langs)), 2):
            own = np.flatnonzero((langs == a) | (langs == b))
            y = np.where(langs[own] == a, 1, -1)
            rows = [(at[i], value[i]) for i in own]
            w = hinge_fit(rows, y, 1 << BITS, c=10.0)
            slope, shift = sigmoid_fit(np.array([w[x] @ v + w[-1] for x, v in rows]), y)
            out.append((pdf["family"].iloc[0], a, b, (slope * w[:-1]).tobytes(), slope, slope * w[-1] + shift))
        if not out[1:]:
            out.append((pdf["family"].iloc[0], langs[0], langs[0], np.zeros(1 << BITS).tobytes(), 1.0, 0.0))
        return pd.DataFrame(out, columns=["family", "a", "b", "w", "slope", "shift"])

    def learned(pdf: pd.DataFrame) -> pd.DataFrame:
        try:
            return learn(pdf)
        finally:
            release()  # the worker goes on to other groups and tasks

    rows = (
        one_each(sample.mapInArrow(released(features), "doc_id long, lang string, family string, x binary, c binary"), "doc_id", "lang")
        .groupBy("family").applyInPandas(learned, "family string, a string, b string, w binary, slope double, shift double").collect()
    )
    if not rows:
        return None
    families = sorted({r["family"] for r in rows})
    shares = np.stack([next(np.frombuffer(r["w"]) for r in rows if r["family"] == f and not r["a"]) for f in families])
    shares = shares + 1e-3 * max(shares.sum(), 1) / shares.size
    pairs = {f: [(r["a"], r["b"], np.frombuffer(r["w"]).astype(np.float32), r["shift"]) for r in rows if r["family"] == f and r["a"]] for f in families}
    return {"families": families, "log": np.log(shares / shares.sum(axis=1, keepdims=True)).astype(np.float32), "pairs": pairs}


def judge(x: np.ndarray, model: dict) -> tuple[str, float]:
    """(language, score) of one text's slots."""
    n = max(len(x), 1)
    mean = model["log"][:, x].sum(axis=1) / n
    z = (mean - mean.max()) * min(n, 200)
    family_p = np.exp(z) / np.exp(z).sum()
    best = int(family_p.argmax())
    pairs = model["pairs"][model["families"][best]]
    votes: dict[str, float] = {}
    for a, b, w, shift in pairs:
        if a == b:
            return a, float(family_p[best])
        p = float(1 / (1 + np.exp(-np.clip(10 * w[x].sum() / n + shift, -30, 30))))
        votes[a] = votes.get(a, 0.0) + (p > 0.5) + p * 1e-3
        votes[b] = votes.get(b, 0.0) + (p <= 0.5) + (1 - p) * 1e-3
    lang = max(sorted(votes), key=votes.get)
    own = [p if a == lang else 1 - p for a, b, p in ((a, b, float(1 / (1 + np.exp(-np.clip(10 * w[x].sum() / n + s, -30, 30))))) for a, b, w, s in pairs if lang in (a, b))]
    return lang, float(family_p[best]) * float(np.mean(own))


def predict(docs: DataFrame, model: dict | None) -> DataFrame:
    """``doc_id, lang_pred, score`` for every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = b.column("text")
            langs, scores = [], []
            for t, x in zip(text, gram_slots(text)):
                lang, p = judge(x, model) if model and _has_letter(t.as_py()) else ("und", 0.0)
                langs.append(lang)
                scores.append(p)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(released(run), "doc_id long, lang_pred string, score double")
