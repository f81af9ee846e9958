"""Mixing to target weights with soft memberships.

A classifier learned from the labelled table gives every document posteriors over the domains ``clean``,
``low`` (quality 0) and ``toxic``: one Naive Bayes support vector model per domain against the rest, over byte
3-gram and word indicators, normalized to sum 1.  Then nonnegative rates r are fitted so that the expected
domain totals ``sum(r * n_tokens * p)`` match the targets: projected gradient steps on the least squares
objective, weighted by the inverse second moment of the posteriors, from r = 1.  A document's step depends
only on its posteriors and on the few residuals so far, so every round is one aggregation of a narrow table;
no state is kept per document.  ``copies`` rounds a rate up or down by a hash of the document, unbiased.

The fit of the classifier is bounded by ``PER_CLASS`` rows per domain.  NULL and empty texts have 0 tokens
and get posteriors from the biases.  Repeated rows are rated alike.  Without labels all posteriors are equal.
An empty table has no rates.  Tokens are counted as words.  An id with several labels has the worst of them.
Other columns are not read and not returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from detectframe.llm.common import chunks, one_each, released, spaced, strings
from detectframe.llm.features import GRAM_BYTES, LETTERS, bayes_score, bayes_support_vectors, byte_grams, word_slots
from detectframe.scale import cut

DOMAINS = ("clean", "low", "toxic")
#: Share of tokens that each domain shall have, of as many tokens as there are.
TARGETS = {"clean": 0.93, "low": 0.05, "toxic": 0.02}
PER_CLASS = 3000
BITS = 16
ROUNDS = 15


def present_slots(text: pa.Array) -> Iterator[tuple[np.ndarray, int]]:
    """Distinct slots of every text (even: byte 3-grams, odd: words) and its number of words."""
    data, offsets, _ = strings(text)
    flags = np.zeros(1 << BITS, bool)
    for a, b in chunks(offsets, GRAM_BYTES):
        part, begin = spaced(data, offsets, a, b)
        grams = byte_grams(part, 3, BITS - 1) * 2
        plain = LETTERS[part]
        words, starts = word_slots(plain, BITS - 1)
        words = words * 2 + 1
        solid = (part != 32) & ~((part >= 9) & (part <= 13))
        heads = np.flatnonzero(solid & ~np.concatenate([[False], solid[:-1]]))
        for s, e in zip(begin[:-1], begin[1:] - 1):
            flags[grams[s : max(s, e - 2)]] = True
            flags[words[np.searchsorted(starts, s) : np.searchsorted(starts, e)]] = True
            at = np.flatnonzero(flags)
            flags[at] = False
            n = int(np.searchsorted(heads, e) - np.searchsorted(heads, s))
            yield at, n


def domain(labels: DataFrame) -> Column:
    return F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "low").when(F.col("quality") == 1, "clean")


def worst_labels(labels: DataFrame) -> DataFrame:
    """``doc_id, domain`` of every labelled id, once: the last of ``DOMAINS`` among its labels."""
    known = labels.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), domain(labels).alias("domain")).where("domain IS NOT NULL")
    place = F.max(F.array_position(F.array(*map(F.lit, DOMAINS)), F.col("domain")))
    return known.groupBy("doc_id").agg(F.element_at(F.array(*map(F.lit, DOMAINS)), place.cast("int")).alias("domain"))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> list[tuple] | None:
    """One (weight, square, shift) per domain, or None without labels."""
    known = worst_labels(labels).withColumn("h", F.xxhash64("doc_id"))
    chosen = [known.where(F.col("domain") == d).orderBy("h", "doc_id").limit(per_class) for d in DOMAINS]
    chosen = chosen[0].unionByName(chosen[1]).unionByName(chosen[2]).select("doc_id", "domain")
    sample = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [x.astype(np.uint16).tobytes() for x, _ in present_slots(b.column("text"))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("domain"), pa.array(found, pa.binary())], ["doc_id", "domain", "x"])

    def learn(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pdf = pd.concat([pd.DataFrame({"doc_id": [], "domain": [], "x": []}), *frames]).sort_values("doc_id", kind="stable")
        if not len(pdf):
            return
        rows = [np.frombuffer(x, np.uint16) for x in pdf["x"]]
        for i, d in enumerate(DOMAINS):
            weight, square, shift, _ = bayes_support_vectors(rows, np.where(pdf["domain"] == d, 1, -1), 1 << BITS)
            yield pd.DataFrame({"i": [i], "weight": [weight.tobytes()], "square": [square.tobytes()], "shift": [shift]})

    got = one_each(sample.mapInArrow(released(features), "doc_id long, domain string, x binary"), "doc_id").repartition(1).mapInPandas(released(learn), "i int, weight binary, square binary, shift double").collect()
    return [(np.frombuffer(r["weight"]), np.frombuffer(r["square"]), float(r["shift"])) for r in sorted(got, key=lambda r: r["i"])] or None


def posteriors(docs: DataFrame, models: list[tuple] | None) -> DataFrame:
    """``doc_id, n_tokens`` (words) and ``p_<domain>`` of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, p = [], []
            for x, words in present_slots(b.column("text")):
                s = np.array([bayes_score(x, *m) for m in models]) if models else np.ones(len(DOMAINS))
                n.append(words)
                p.append(s / max(s.sum(), 1e-12))
            p = np.array(p).reshape(len(n), len(DOMAINS))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), *[pa.array(c) for c in p.T]], ["doc_id", "n_tokens", *[f"p_{d}" for d in DOMAINS]])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(released(run), "doc_id long, n_tokens long, " + ", ".join(f"p_{d} double" for d in DOMAINS))


def fit_rates(rows: DataFrame, targets: dict[str, float], domains: tuple[str, ...] = DOMAINS, rounds: int = ROUNDS, tolerance: float = 1e-5, bounds: tuple[Column, Column] | None = None) -> Column:
    """The rate as a column over ``n_tokens, p_<domain>``.

    targets: token totals as shares of all tokens (they may sum to more or less than 1).
    bounds: least and greatest rate of a document, of which 1 is between.
    """
    p, n = [F.col(f"p_{d}") for d in domains], F.col("n_tokens")
    d = len(domains)
    first = rows.agg(F.sum(n).alias("n"), *[F.sum(n * p[i] * p[j]).alias(f"g{i}_{j}") for i in range(d) for j in range(i, d)]).first()
    if not first["n"]:
        return F.lit(1.0)
    total = float(first["n"])
    g = np.array([[first[f"g{min(i, j)}_{max(i, j)}"] / total for j in range(d)] for i in range(d)])
    inverse = np.linalg.inv(g + 1e-6 * np.eye(d))
    want = np.array([targets.get(x, 0.0) for x in domains])
    rate, (least, most) = F.lit(1.0), bounds or (F.lit(0.0), None)
    for _ in range(rounds):
        got = rows.agg(*[F.sum(rate * n * c).alias(f"t{i}") for i, c in enumerate(p)]).first()
        error = np.array([got[f"t{i}"] / total for i in range(d)]) - want
        if np.abs(error).max() < tolerance:
            break
        step = inverse @ error
        rate = F.greatest(least, rate - sum((float(s) * c for s, c in zip(step, p)), F.lit(0.0)))
        rate = rate if most is None else F.least(most, rate)
    return rate


def relative(rows: DataFrame, targets: dict[str, float] = TARGETS) -> dict[str, float]:
    """Totals as shares of all tokens: clean keeps its measured one, another domain has at most its own, and beside clean at most its target."""
    got = rows.agg(F.sum("n_tokens").alias("n"), *[F.sum(F.col("n_tokens") * F.col(f"p_{d}")).alias(d) for d in DOMAINS]).first()
    if not got["n"]:
        return dict(targets)
    own = {d: got[d] / got["n"] for d in DOMAINS}
    return {d: own[d] if d == "clean" else min(own[d], own["clean"] * targets[d] / targets["clean"]) for d in DOMAINS}


def rate_documents(docs: DataFrame, models: list[tuple] | None, targets: dict[str, float] = TARGETS) -> DataFrame:
    """``doc_id, n_tokens, p_<domain>, rate, copies`` of every document."""
    rows = cut(posteriors(docs, models), "posteriors")
    return _copied(rows, fit_rates(rows, targets))


def _copied(rows: DataFrame, rate: Column) -> DataFrame:
    unit = F.pmod(F.xxhash64("doc_id", F.lit("copies")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return rows.withColumn("rate", rate).withColumn("copies", F.floor(F.col("rate") + unit).cast("int"))


def thin_documents(docs: DataFrame, models: list[tuple] | None, targets: dict[str, float] = TARGETS) -> DataFrame:
    """:func:`rate_documents` for a corpus that shall lose no clean document: targets are those of :func:`relative`, documents
    whose most likely domain is clean have a rate of 1 at least, the others of 1 at most.  Without models every rate is 1."""
    rows = cut(posteriors(docs, models), "posteriors")
    clean = F.col("p_clean") >= F.greatest(*[F.col(f"p_{d}") for d in DOMAINS if d != "clean"])
    bounds = F.when(clean, 1.0).otherwise(0.0), F.when(clean, float("inf")).otherwise(1.0)
    return _copied(rows, fit_rates(rows, relative(rows, targets), bounds=bounds) if models else F.lit(1.0))


def mix_to_targets(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, per_class: int = PER_CLASS) -> DataFrame:
    """:func:`rate_documents` with a classifier learned from ``labels (doc_id, quality, toxic)``."""
    return rate_documents(docs, fit(docs, labels, per_class), targets)
