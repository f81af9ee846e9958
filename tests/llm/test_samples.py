"""Classifiers learn one row of each chosen id, however often it comes, after features that many tasks make."""

import random

import numpy as np
import pytest

from detectframe.llm import language_id, mixing, quality_classifier


def flat(x):
    if isinstance(x, dict):
        return [flat(v) for _, v in sorted(x.items(), key=str)]
    if isinstance(x, (list, tuple)):
        return [flat(v) for v in x]
    return np.asarray(x).tolist()


@pytest.mark.parametrize("fit", ["mixing", "quality", "language"])
def test_repeated_rows_do_not_change_the_model(spark, fit):
    rng = random.Random(4)
    text = lambda i: " ".join(f"{'ab'[i % 2]}{rng.randrange(50)}" for _ in range(30))
    rows = [(i, text(i), ["en", "fr"][i % 2]) for i in range(40)]
    labels = spark.createDataFrame([(i, i % 2, int(i % 5 == 0)) for i in range(40)], "doc_id long, quality int, toxic int")
    frame = lambda x: spark.createDataFrame(x, "doc_id long, text string, lang string").repartition(4)
    run = {"mixing": lambda d: mixing.fit(d, labels), "quality": lambda d: quality_classifier.fit(d, labels), "language": language_id.fit}[fit]
    assert flat(run(frame(rows))) == flat(run(frame(rows + [rows[3]] * 60)))
