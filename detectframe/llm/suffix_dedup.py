"""Exact substring dedup by prefix-free parsing of the corpus.

A byte goes if a string of ``LENGTH`` bytes around it also starts earlier in the corpus (smaller id, or earlier
in the same document).  Sorting all suffixes would move the whole corpus many times, so the corpus is parsed:

* **Triggers.**  A rolling hash runs over the text; a position triggers where its 8-byte hash is the least of 64
  neighbours.  Every window of ``LENGTH`` bytes holds the trigger of its first 64 positions, chosen by the
  window's own bytes.  Windows with the same trigger form a phrase; a phrase overlaps the next by its context,
  so that all its windows lie inside it.  There is a phrase for about every 32 bytes.
* **Dictionary and parse.**  Phrases meet by the fingerprint of the 37 bytes at their trigger, which all equal
  windows share.  A fingerprint that occurs once ends there.  Equal phrases are one dictionary entry: its first
  occurrence stays, in all others every window repeats.
* **Suffix order.**  Only where different phrases share a fingerprint (the ends of repeats) single suffixes
  matter: the ``LENGTH``-byte prefixes of their suffixes are ordered by fingerprint and corpus place, and all
  but the first of equal ones repeat.  Order among different suffixes is never used, so fingerprints (128 bits
  in all) take the place of letters; that lets phrases and suffixes be dealt to independent buckets.

A task first settles what repeats inside itself and sends one record per distinct entry, so a passage that
every document holds sends one record per task.  Buckets follow ``spark.sql.shuffle.partitions``.

NULL and empty texts have no bytes.  Long documents are parsed in segments.  Rows that share an id are told
apart (see ``keyed``) and ordered by their text.  Repeated rows: all but the first lose every byte of strings
that are long enough.  Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from detectframe.llm.common import chunks, mix, pick, strings, texts
from detectframe.scale import cut

LENGTH = 100
GRAM, NEAR = 8, 64
#: Bytes from a trigger to the end of the shortest window that has it.
SURE = LENGTH - NEAR + 1
#: Bytes of one long document that are parsed at once, and records that a task holds before it sends them.
SEGMENT, HOLD = 1 << 21, 1 << 20
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_ROWS = "bucket int, kind int, key long, data binary"
_NAMES = ["bucket", "kind", "key", "data"]
RECORDS, REPEATED, UNSURE = 0, 1, 2


class Hashes:
    """Fingerprints of any range of a buffer (polynomials over its scrambled 8-byte grams, one of two bases)."""

    _powers = [(np.ones(1, np.uint64), np.ones(1, np.uint64))] * len(_BASES)

    def __init__(self, data: np.ndarray, base: int = 0):
        n = max(len(data) - GRAM + 1, 0)
        x = data.astype(np.uint64)
        gram = x[:n].copy()
        for i in range(1, GRAM):
            gram |= x[i : n + i] << np.uint64(8 * i)
        self.gram = mix(gram)
        if len(Hashes._powers[base][0]) <= n:
            factors = _BASES[base], pow(_BASES[base], -1, 1 << 64)
            Hashes._powers[base] = tuple(np.concatenate([np.ones(1, np.uint64), np.multiply.accumulate(np.full(n, f, np.uint64))]) for f in factors)
        up, self.down = Hashes._powers[base]
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.gram * up[:n], dtype=np.uint64)])

    def of(self, start: np.ndarray, end: np.ndarray, salt: int) -> np.ndarray:
        """Fingerprints of bytes start..end-1 (at least 8 of them)."""
        e = end - GRAM + 1
        return mix(((self.sums[e] - self.sums[start]) * self.down[start]) ^ np.uint64(salt))


def phrases(data: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, ...] | None:
    """(document, first window, last window, trigger fingerprint, phrase fingerprint) of the phrases of
    concatenated documents; ``begins`` has one more entry, the end.  Places count from the document's begin."""
    n = len(data) - LENGTH + 1
    if n < 1:
        return None
    inside = np.zeros(n, bool)
    for s, e in zip(begins[:-1], begins[1:]):
        inside[s : max(s, e - LENGTH + 1)] = True
    start = np.flatnonzero(inside)
    if not len(start):
        return None
    h = Hashes(data)
    least = (h.gram & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h.gram), dtype=np.uint64)
    for step in (1, 2, 4, 8, 16, 32):
        least = np.minimum(least[:-step], least[step:])
    trigger = (least[start] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    fresh = np.flatnonzero(np.concatenate([[True], (trigger[1:] != trigger[:-1]) | (start[1:] != start[:-1] + 1)]))
    lo, hi, at = start[fresh], start[np.append(fresh[1:], len(start)) - 1], trigger[fresh]
    doc = np.searchsorted(begins, lo, "right") - 1
    return doc, lo - begins[doc], hi - begins[doc], h.of(at, at + SURE, 1), h.of(lo, hi + LENGTH, 2)


def _merged(kind: int, key: np.ndarray, lo: np.ndarray, hi: np.ndarray, buckets: int) -> Iterator[tuple]:
    """Rows of window ranges by key, neighbours joined."""
    if not len(key):
        return
    order = np.lexsort((lo, key))
    key, lo, hi = key[order], lo[order], hi[order]
    fresh = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (lo[1:] > hi[:-1] + 1)]))
    ranges = np.column_stack([lo[fresh], np.maximum.reduceat(hi, fresh)]).astype(np.int32)
    key = key[fresh]
    own = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    for s, e in zip(own, np.append(own[1:], len(key))):
        yield int(key[s]) % buckets, kind, int(key[s]), ranges[s:e].tobytes()


def _batches(rows: Iterator[tuple], size: int = 4096) -> Iterator[pa.RecordBatch]:
    held, weight = [], 0
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.binary()]
    for row in rows:
        held.append(row)
        weight += len(row[3])
        if len(held) >= size or weight > 1 << 23:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), kinds)], _NAMES)
            held, weight = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), kinds)], _NAMES)


_FIELDS = (np.uint64, np.uint64, np.int64, np.int32, np.uint8)


def _settle(fp: np.ndarray, xh: np.ndarray, key: np.ndarray, lo: np.ndarray, span: np.ndarray, many: np.ndarray, entries: bool) -> tuple[np.ndarray, ...]:
    """Masks over records sorted by (fp, xh, key, lo): first of its entry; entry among others of its fingerprint."""
    new_fp = np.concatenate([[True], fp[1:] != fp[:-1]])
    first = new_fp | np.concatenate([[True], xh[1:] != xh[:-1]])
    if not entries:
        return first, np.zeros(len(fp), bool)
    group = np.cumsum(new_fp) - 1
    mixed = (np.bincount(group, first) > 1) | (np.bincount(group, many) > 0)
    return first, mixed[group]


def _repeats(fp: np.ndarray) -> np.ndarray:
    """Mask over sorted fingerprints of those that occur more than once."""
    same = fp[1:] == fp[:-1]
    return np.concatenate([[False], same]) | np.concatenate([same, [False]])


def _send(fp, xh, key, lo, span, buckets: int, entries: bool) -> Iterator[tuple]:
    """Settles the records of one task among themselves, then sends one per entry to its bucket.

    A fingerprint with several entries here sends a single record, marked: its entries are unsure already."""
    order = np.argsort(fp, kind="stable")
    fp, xh, key, lo, span = fp[order], xh[order], key[order], lo[order], span[order]
    many = np.zeros(len(fp), bool)
    keep = np.ones(len(fp), bool)
    twice = np.flatnonzero(_repeats(fp))
    if len(twice):
        inner = twice[np.lexsort((lo[twice], key[twice], xh[twice], fp[twice]))]
        first, mixed = _settle(fp[inner], xh[inner], key[inner], lo[inner], span[inner], many[inner], entries)
        gone = inner[~first]
        yield from _merged(REPEATED, key[gone], lo[gone], lo[gone] + span[gone], buckets)
        unsure = inner[first & mixed]
        yield from _merged(UNSURE, key[unsure], lo[unsure], lo[unsure] + span[unsure], buckets)
        keep[gone] = False
        keep[unsure] = False
        if len(unsure):
            told = unsure[np.concatenate([[True], fp[unsure][1:] != fp[unsure][:-1]])]
            keep[told], many[told] = True, True
    fp, xh, key, lo, span = fp[keep], xh[keep], key[keep], lo[keep], span[keep]
    tail = span.astype(np.uint8) | (many[keep].astype(np.uint8) << 7)
    bucket = ((fp >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(fp) else []
    for s, e in zip(cuts, np.append(cuts[1:], len(fp))):
        yield int(bucket[s]), RECORDS, None, b"".join(c[s:e].astype(t).tobytes() for c, t in zip((fp, xh, key, lo, tail), _FIELDS))


def _collected(parts: Iterator[tuple[np.ndarray, ...]], buckets: int, entries: bool) -> Iterator[tuple]:
    """Sends (fp, xh, key, lo, span) arrays whenever ``HOLD`` records are together."""
    held, n = [], 0
    for part in parts:
        held.append(part)
        n += len(part[0])
        if n >= HOLD:
            yield from _send(*[np.concatenate(c) for c in zip(*held)], buckets, entries)
            held, n = [], 0
    if n:
        yield from _send(*[np.concatenate(c) for c in zip(*held)], buckets, entries)


def _parse(buckets: int):
    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
        for b in batches:
            data, offsets, _ = strings(b.column("text"))
            keys = b.column("key").to_numpy()
            for first, last in chunks(offsets):
                lo, hi = int(offsets[first]), int(offsets[last])
                for s in range(lo, max(hi, lo + 1), SEGMENT) if last == first + 1 else (lo,):
                    begins = offsets[first : last + 1] - lo if last > first + 1 else np.array([0, min(hi - s, SEGMENT + LENGTH - 1)])
                    found = phrases(data[s : s + int(begins[-1])], begins)
                    if found:
                        doc, a, z, fp, xh = found
                        yield fp, xh, keys[first + doc], (a + (s - lo)).astype(np.int64), z - a

    return lambda batches: _batches(_collected(parts(batches), buckets, True))


def _bucket_rows(entries: bool, buckets: int):
    """Settles each bucket (rows come sorted by bucket); ranges only pass through."""

    def settled(blobs: list[bytes]) -> Iterator[tuple]:
        width = sum(np.dtype(t).itemsize for t in _FIELDS)
        columns: list[list[np.ndarray]] = [[] for _ in _FIELDS]
        for blob in blobs:
            n, at = len(blob) // width, 0
            for c, t in zip(columns, _FIELDS):
                size = n * np.dtype(t).itemsize
                c.append(np.frombuffer(blob, t, n, at))
                at += size
        fp = np.concatenate(columns[0])
        order = np.argsort(fp, kind="stable")
        order = order[_repeats(fp[order])]
        if not len(order):
            return
        fp, xh, key, lo, tail = (np.concatenate(c)[order] for c in columns)
        inner = np.lexsort((lo, key, xh, fp))
        fp, xh, key, lo, tail = fp[inner], xh[inner], key[inner], lo[inner].astype(np.int64), tail[inner]
        many, span = tail >= 128, (tail & 127).astype(np.int64)
        first, mixed = _settle(fp, xh, key, lo, span, many, entries)
        gone, unsure = ~first & ~many, first & mixed & ~many
        yield from _merged(REPEATED, key[gone], lo[gone], lo[gone] + span[gone], buckets)
        yield from _merged(UNSURE, key[unsure], lo[unsure], lo[unsure] + span[unsure], buckets)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        now, held = None, []
        for b in batches:
            for bucket, kind, key, data in zip(*(b.column(c).to_pylist() for c in _NAMES)):
                if kind != RECORDS:
                    yield bucket, kind, key, data
                    continue
                if bucket != now:
                    if held:
                        yield from settled(held)
                    now, held = bucket, []
                held.append(data)
        if held:
            yield from settled(held)

    return lambda batches: _batches(rows(batches))


def _ranges(blobs) -> np.ndarray:
    return np.concatenate([np.frombuffer(x, np.int32).reshape(-1, 2) for x in blobs]).astype(np.int64)


def _suffixes(buckets: int):
    """Records of single windows inside the unsure ranges of each document."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
        unpack = zstandard.ZstdDecompressor().decompress
        for b in batches:
            for key, packed, blobs in zip(b.column("key").to_pylist(), b.column("packed"), b.column("ranges").to_pylist()):
                data = np.frombuffer(unpack(packed.as_py()), np.uint8)
                todo = _ranges(blobs)
                todo = todo[np.argsort(todo[:, 0], kind="stable")]
                i = 0
                while i < len(todo):  # ranges that lie close together share one pass of the rolling hash
                    base = int(todo[i, 0])
                    j = max(i + 1, int(np.searchsorted(todo[:, 0], base + SEGMENT)))
                    end = int(todo[i:j, 1].max()) + LENGTH
                    at = np.concatenate([np.arange(s, e + 1) for s, e in todo[i:j]])
                    one, two = (Hashes(data[base:end], i).of(at - base, at - base + LENGTH, 3) for i in (0, 1))
                    yield one, two, np.full(len(at), key, np.int64), at, np.zeros(len(at), np.int64)
                    i = j

    return lambda batches: _batches(_collected(parts(batches), buckets, False))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compressed texts, so that they travel small."""
    pack = zstandard.ZstdCompressor(level=1).compress
    for b in batches:
        data, at, _ = strings(b.column("text"))
        for lo in range(0, b.num_rows, 512):
            rows = range(lo, min(lo + 512, b.num_rows))
            yield pa.RecordBatch.from_arrays([b.column("key").slice(lo, len(rows)), pa.array([pack(data[at[i] : at[i + 1]].tobytes()) for i in rows], pa.binary())], ["key", "packed"])


def covered(ranges: np.ndarray) -> np.ndarray:
    """Maximal byte runs covered by windows that start in the ranges (both ends included)."""
    ranges = ranges[np.argsort(ranges[:, 0], kind="stable")]
    lo, hi = ranges[:, 0], np.maximum.accumulate(ranges[:, 1]) + LENGTH
    fresh = np.flatnonzero(np.concatenate([[True], lo[1:] > hi[:-1]]))
    return np.column_stack([lo[fresh], hi[np.append(fresh[1:], len(lo)) - 1]])


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unpack = zstandard.ZstdDecompressor().decompress
    names = ["key", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"]
    for b in batches:
        out = []
        for key, packed, blobs in zip(b.column("key").to_pylist(), b.column("packed"), b.column("ranges").to_pylist()):
            data = unpack(packed.as_py())
            runs = covered(_ranges(blobs)) if blobs else np.zeros((0, 2), np.int64)
            digest, at = hashlib.sha256(), 0
            for s, e in runs.tolist():
                digest.update(data[at:s])
                at = e
            digest.update(data[at:])
            out.append((key, len(data), int((runs[:, 1] - runs[:, 0]).sum()), len(runs), digest.hexdigest(), runs.tolist()))
        if out:
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)


def repeated_spans(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans`` per document; spans are [begin, end) in bytes."""
    spark = docs.sparkSession
    corpus = texts(docs)
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = 4 * partitions
    body = corpus.select("key", F.coalesce("text", F.lit("")).alias("text"))

    def dealt(rows: DataFrame, entries: bool, name: str) -> DataFrame:
        return cut(rows.repartition(partitions, "bucket").sortWithinPartitions("bucket").mapInArrow(_bucket_rows(entries, buckets), _ROWS).select("kind", "key", "data"), name)

    gathered = lambda rows: rows.groupBy("key").agg(F.collect_list("data").alias("ranges"))
    marks = dealt(body.mapInArrow(_parse(buckets), _ROWS), True, "phrases")
    unsure = gathered(marks.where(F.col("kind") == UNSURE))
    some = pick(body, cut(marks.where(F.col("kind") == UNSURE).select("key").distinct(), "ids"))
    more = dealt(some.mapInArrow(_packed, "key long, packed binary").join(unsure, "key").mapInArrow(_suffixes(buckets), _ROWS), False, "suffixes")
    gone = gathered(marks.where(F.col("kind") == REPEATED).select("key", "data").unionAll(more.where(F.col("kind") == REPEATED).select("key", "data")))
    full = body.mapInArrow(_packed, "key long, packed binary").join(gone, "key", "left")
    out = full.mapInArrow(_removed, "key long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<array<long>>")
    return out.join(corpus.select("key", "doc_id"), "key").drop("key").select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans")
