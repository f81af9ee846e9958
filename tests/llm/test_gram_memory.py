"""N-grams of many texts are made a little at a time, and are those of each text alone."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from detectframe.llm import language_id, mixing

TEXTS = [f"Größe {i} " + f"word{i * 37 % 101} of a text, " * 90 for i in range(1000)] + ["", None, "a", "long " * 60_000]


@pytest.mark.parametrize("slots", [language_id.gram_slots, lambda t: (x for x, _ in mixing.present_slots(t))])
def test_grams_hold_little_and_are_those_of_each_text_alone(slots):
    together = pa.array(TEXTS, pa.string())
    tracemalloc.start()
    for _ in slots(together.slice(0, 1003)):  # 2 MB
        pass
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 16 << 20
    for text, found in zip(TEXTS, slots(together), strict=True):
        assert np.array_equal(found, next(slots(pa.array([text], pa.string()))))
