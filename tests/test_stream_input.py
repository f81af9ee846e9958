"""Tables as streams: rows without a time, empty tables, many files, the order of batches."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from detectframe.catalog import streams
from detectframe.scale import scratch_path


@pytest.mark.parametrize("n,file_rows", [(0, 10_000), (60, 10_000), (60, 4)])
def test_every_row_comes_in_order_of_batches(spark, monkeypatch, n, file_rows):
    monkeypatch.setattr(streams, "FILE_ROWS", file_rows)
    day = dt.datetime(2024, 1, 1)
    rows = [(i, day + dt.timedelta(hours=i) if i % 6 else None) for i in range(n)]
    seen, out = {}, scratch_path(spark, "seen")

    def look(batch, i):
        seen[i] = [r.i for r in batch.collect()]

    stream = streams.as_stream(spark.createDataFrame(rows, "i long, ts timestamp").orderBy(F.desc("i")))
    stream.writeStream.foreachBatch(look).option("checkpointLocation", out).trigger(availableNow=True).start().awaitTermination()
    assert sorted(x for b in seen.values() for x in b) == list(range(n))
    timed = [[x for x in seen[i] if x % 6] for i in sorted(seen)]
    assert all(max(a) < min(b) for a, b in zip(timed, timed[1:]) if a and b)
    if n:
        assert len(seen) == 4 and {x for x in range(n) if x % 6 == 0} <= set(seen[0])
