"""What the training-data operators share: row keys, bounded Arrow chunks, scratch tables."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import wraps

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from detectframe import scale

#: Bytes of text one vectorized step holds at once (a longer document comes alone).
CHUNK_BYTES = 1 << 20


_SCOPE: ContextVar[scale.Scratch | None] = ContextVar("scope", default=None)


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Lineage cut; inside a :func:`scratch` function it goes when that function has written its result."""
    scope = _SCOPE.get()
    return scope.cut(df, name) if scope else scale.cut(df, name)


def drop(df: DataFrame) -> None:
    """Removes a cut of the running :func:`scratch` function that has no reader left."""
    if _SCOPE.get():
        _SCOPE.get().drop(df)


#: Rows that go to a Python worker at once, as a batch is held in several copies on its way (10,000 by Spark's default).
BATCH_ROWS = 1000


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """What is run inside sends rows to Python workers in batches of ``BATCH_ROWS`` at most."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = int(spark.conf.get(name))
    spark.conf.set(name, min(before, BATCH_ROWS) if before > 0 else BATCH_ROWS)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def scratch(fn: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """The function's result is written once and its lineage cuts are removed then; its first argument is a frame.

    Rows go to Python workers in small batches meanwhile.
    """

    @wraps(fn)
    def run(first: DataFrame, *args, **kwargs) -> DataFrame:
        with scale.Scratch(first.sparkSession) as scope, small_batches(first.sparkSession):
            token = _SCOPE.set(scope)
            try:
                out = fn(first, *args, **kwargs)
            finally:
                _SCOPE.reset(token)
            return cut(out, fn.__name__)

    return run


def keyed(docs: DataFrame) -> DataFrame:
    """``(key, row)``: a unique, non-null long per row that keeps the order of ``doc_id``, and the row as a struct.

    The key is ``doc_id`` itself where that is unique and never NULL.  Otherwise the rows are sorted by
    ``(doc_id, text)`` (NULL first) and numbered in that order, and the numbered table is written once, so
    repeated rows stay apart and every later pass sees the same numbers.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    odd = docs.groupBy("doc_id").count().where("count > 1 OR doc_id IS NULL")
    if not odd.limit(1).count():
        return docs.select(F.col("doc_id").cast("long").alias("key"), row)
    return cut(docs.sort("doc_id", "text").select(F.monotonically_increasing_id().alias("key"), row), "keyed")


def texts(docs: DataFrame) -> DataFrame:
    """``(key, doc_id, text)`` of :func:`keyed`; text as it is (NULL stays NULL)."""
    return keyed(docs).select("key", F.col("row.doc_id").alias("doc_id"), F.col("row.text").alias("text"))


def strings(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """UTF-8 bytes, their offsets, and the mask of non-null values of an Arrow string column, without copies."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    valid = np.ones(len(column), bool) if not column.null_count else column.is_valid().to_numpy(zero_copy_only=False)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), at, valid


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes, of one row at least."""
    start, n = 0, len(offsets) - 1
    while start < n:
        end = int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1
        end = min(max(end, start + 1), n)
        yield start, end
        start = end


def spaced(data: np.ndarray, offsets: np.ndarray, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
    """Texts a..b-1 with a space after each, and where each begins (one more: the end)."""
    view = memoryview(data)
    joined = b" ".join([*(view[s:e] for s, e in zip(offsets[a:b], offsets[a + 1 : b + 1])), b""])
    return np.frombuffer(joined, np.uint8), offsets[a : b + 1] - offsets[a] + np.arange(b - a + 1)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scramble of 64-bit values."""
    x = x ^ (x >> np.uint64(32))  # the caller's array stays; all further steps are in place
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(32)
    return x


#: Places in a word up to which the values of its bytes come from a table.
PLACES = 64
_BYTES = mix(np.arange(PLACES << 8, dtype=np.uint64))


def _byte_values(data: np.ndarray, place: np.ndarray) -> np.ndarray:
    """``mix(byte + 256 * place)`` of each byte; place: int32, is overwritten."""
    far = np.flatnonzero(place >= PLACES)
    beyond = mix(data[far].astype(np.uint64) + (place[far].astype(np.uint64) << np.uint64(8)))
    place[far] = 0
    place <<= 8
    place += data
    value = _BYTES[place]
    value[far] = beyond
    return value


def word_hashes(data: np.ndarray, solid: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, begin, end) of every maximal run of ``solid`` bytes."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], solid, [False]]).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64), starts, ends
    place = np.arange(len(data), dtype=np.int32)
    place[starts[0] :] -= np.repeat(starts.astype(np.int32), np.diff(np.append(starts, len(data))))
    place[~solid] = 0
    value = _byte_values(data, place)
    value[~solid] = 0
    return mix(np.add.reduceat(value, starts) + (ends - starts).astype(np.uint64)), starts, ends


#: Ids up to this many are broadcast to pick rows; more are joined by a shuffle.
BROADCAST_IDS = 500_000


def pick(rows: DataFrame, ids: DataFrame, on: str = "key") -> DataFrame:
    """Rows whose key is among ``ids`` (one distinct column); the ids are counted before they are broadcast."""
    small = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return rows.join(F.broadcast(ids) if small else ids, on, "left_semi")


def without(rows: DataFrame, ids: DataFrame, on: str = "key") -> DataFrame:
    """Rows whose key is not among ``ids``; the ids are counted before they are broadcast."""
    ids = ids.distinct()
    small = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return rows.join(F.broadcast(ids) if small else ids, on, "left_anti")


def one_each(rows: DataFrame, *by: str) -> DataFrame:
    """One row for each value of ``by``: the greatest by its other columns, in their order."""
    rest = [c for c in rows.columns if c not in by]
    return rows.groupBy(*by).agg(F.max(F.struct(*rest)).alias("rest")).select(*[c if c in by else F.col(f"rest.{c}").alias(c) for c in rows.columns])


class WordHash(dict):
    """64-bit hashes of words, kept for words seen before; emptied when it holds ``limit`` words."""

    limit = 400_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


WORDS = WordHash()


#: What empties the words that other operators' tasks left in this worker.
FORGET: list[Callable[[], None]] = []
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def release() -> None:
    """Gives known words and all free memory of this process back, as workers serve later stages too."""
    WORDS.clear()
    for forget in FORGET:
        forget()
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)


def released(run: Callable[[Iterator], Iterator]):
    """A task over batches or frames that begins without the words and the free memory of earlier tasks, and leaves none behind."""

    @wraps(run)
    def task(batches: Iterator) -> Iterator:
        release()
        try:
            yield from run(batches)
        finally:
            release()

    return task


_STEP = np.uint64(0x9E3779B97F4A7C15)


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k-word shingle; of the whole sequence if it is shorter; nothing without words."""
    n = len(words)
    if not n:
        return words
    if n < k:
        return mix(np.array([sum(int(mix(words[i : i + 1] + np.uint64(i))[0]) for i in range(n)) + n & 0xFFFFFFFFFFFFFFFF], np.uint64))
    total = np.zeros(n - k + 1, np.uint64)
    factor = np.uint64(k)
    with np.errstate(over="ignore"):
        for i in range(k):
            factor = factor * _STEP + np.uint64(2 * i)
            total += words[i : n - k + 1 + i] * (factor | np.uint64(1))
    return mix(total)
