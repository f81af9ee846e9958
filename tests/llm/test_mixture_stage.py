"""The mixture stage keeps clean documents and raises no other domain, whatever the corpus holds."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from detectframe.llm import mixing


@pytest.mark.parametrize("low,toxic,mixed", [(10, 5, 0), (110, 120, 0), (0, 0, 0), (10, 5, 30), (110, 120, 60)])
def test_clean_stays_whatever_the_corpus_holds(spark, monkeypatch, low, toxic, mixed):
    kind = lambda i: "low" if i < low else "toxic" if i < low + toxic else "mixed" if i < low + toxic + mixed else "clean"
    p = {"low": (0.05, 0.9, 0.05), "toxic": (0.05, 0.05, 0.9), "mixed": (0.5, 0.3, 0.2), "clean": (0.97, 0.02, 0.01)}
    docs = spark.createDataFrame([(i, kind(i)) for i in range(1000)], "doc_id long, text string")
    rows = spark.createDataFrame([(i, 100, *p[kind(i)]) for i in range(1000)], "doc_id long, n_tokens long, p_clean double, p_low double, p_toxic double")
    monkeypatch.setattr(mixing, "posteriors", lambda docs, models: rows)
    monkeypatch.setattr(mixing, "fit", lambda docs, labels: [()])
    monkeypatch.setattr(corpus_pipeline, "table", lambda *a: docs)
    n = {r["text"]: (r["n"], r["ids"]) for r in corpus_pipeline.mixture(spark, docs, "").groupBy("text").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("ids")).collect()}
    clean = 1000 - low - toxic - mixed
    assert n["clean"][1] == clean and n["clean"][0] <= 1.05 * clean
    assert not mixed or n["mixed"][1] == mixed
    for d, had in (("low", low), ("toxic", toxic)):
        got = n.get(d, (0, 0))[0]
        assert got <= had
        if had > 100:
            assert got <= 0.6 * had


def test_an_id_with_several_labels_has_the_worst(spark):
    rows = [(1, 1, 0), (1, 1, 1), (2, 1, 0), (2, 0, 0), (3, 1, 0), (3, 1, 0), (4, None, None), (None, 1, 0), (5, 0, 1), (5, None, None)]
    labels = spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
    assert {r.doc_id: r.domain for r in mixing.worst_labels(labels).collect()} == {1: "toxic", 2: "low", 3: "clean", 5: "toxic"}
