"""Workers give back what a task held; rows come in small batches only inside."""

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

from detectframe.llm import common, near_dedup, packing


def test_a_shipped_task_empties_the_words_of_its_worker():
    texts = pa.RecordBatch.from_arrays([pa.array([1]), pa.array(["some words of one text that are kept"])], ["key", "text"])
    packing._LOADED["left by another operator"] = object()
    task = cloudpickle.loads(cloudpickle.dumps(near_dedup._features(5)))  # as Spark sends it: by value
    assert [b.num_rows for b in task(iter([texts]))] == [1]
    assert not common.WORDS and not packing._LOADED


def test_a_packing_task_leaves_no_words_in_its_worker():
    docs = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([1]), pa.array(["some words of one text that are kept"])], ["key", "doc_id", "text"])
    packing._LOADED["left by another operator"] = object()
    common.WORDS[b"left"] = 1
    task = cloudpickle.loads(cloudpickle.dumps(packing._pieces(None, 4096, 1)))
    assert [b.num_rows for b in task(iter([docs]))] == [1]
    assert not common.WORDS and not packing._LOADED


def test_a_packing_task_holds_few_words():
    ids = packing.word_ids(None)
    for i in range(30):
        ids.learn({b"%d" % n for n in range(10_000 * i, 10_000 * i + 10_000)})
    assert len(ids.young) + len(ids.old) < 150_000
    assert all(np.frombuffer(ids.young[w], "<u4").tolist() == ids.tokenizer.encode(w.decode(), add_special_tokens=False).ids for w in (b"290000", b"299999"))
    packing._LOADED.clear()


def test_batches_are_small_inside_only(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    seen = lambda: max(r.n for r in spark.range(0, 5000, 1, 1).mapInArrow(lambda bs: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in bs), "n long").collect())
    with common.small_batches(spark):
        assert seen() == common.BATCH_ROWS
        spark.conf.set(name, 10)
        with common.small_batches(spark):
            assert seen() == 10
    assert spark.conf.get(name) == before
