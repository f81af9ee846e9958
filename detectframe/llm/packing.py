"""Best-fit packing of token sequences by bin completion with branch and bound.

Texts become token ids, an end id is added, documents longer than ``capacity`` are cut into pieces, and the
pieces are packed into sequences of at most ``capacity`` ids.

Pieces are dealt by a hash of document and piece to groups of about ``GROUP``; a group is packed in one task.
There the largest piece left is completed by the best undominated filling: fillings are enumerated largest
piece first, a filling to which another piece could be added is never closed, equal lengths are tried once, and
the search ends at zero waste or after ``NODES`` steps with the best-fit filling found so far.  Best-fit
decreasing gives the incumbent, the total length a lower bound; the last ``TAIL`` sequences are branched over
several fillings each, pruned by the waste that would still beat the incumbent.  Sequences that are not nearly
full are opened again and packed together in ever fewer groups, so the loss does not grow with the number of
groups.

NULL and empty texts are one end id.  Repeated rows are packed each.  Rows that share an id are told apart by
their place.  An empty table has no sequences.  Other columns are not read.
"""

from __future__ import annotations

import codecs
import json
import os
import re
import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from detectframe.llm.common import FORGET, chunks, released, strings
from detectframe.scale import cut

CAPACITY, END_ID = 4096, 1
GROUP, NODES, TAIL, NEARLY, ROUNDS = 8192, 300, 12, 0.995, 3
#: Words whose ids a worker keeps, in each of two generations.
WORDS_KEPT = 50_000
_MARK = "\x01"

#: A tokenizer set up like this cuts lower-cased words of plain characters into the matches of ``_PARTS`` and writes
#: their bytes with the characters of ``_BYTE_CHARS``; its model makes ids of each part alone.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
_SPLIT = {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}
_PRE_TOKENIZER = {"type": "Sequence", "pretokenizers": [_SPLIT, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}
#: Not plain: all but printable ASCII, letters of Latin-1, dashes and quotes, which NFC leaves as they are.
_ODD = re.compile("[^ -~À-ÖØ-öø-ÿ\u2010-\u2027]|<\\|")
_PARTS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^ a-z0-9ß-öø-ÿ]+| ")
_HIGH = count(256)
_BYTE_CHARS = "".join(chr(b if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174 else next(_HIGH)) for b in range(256))


class WordIds:
    """Token ids of words, each word encoded once while it is in use.

    Holds for tokenizers that never join text across ASCII white space.  Unknown words of many texts are
    encoded in one call, with a mark between them; where plain words are cut in a known way, their parts go
    straight to the tokenizer's model.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        mark = self.tokenizer.encode(_MARK, add_special_tokens=False).ids
        self.mark = mark[0] if len(mark) == 1 else None
        steps = [x and json.loads(x.__getstate__()) for x in (self.tokenizer.normalizer, self.tokenizer.pre_tokenizer)]
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.plain = steps == [_NORMALIZER, _PRE_TOKENIZER] and all("<|" in t.content for t in added)
        self.model = self.tokenizer.model

    def _odd(self, words: list[bytes]) -> set[bytes]:
        """Words for the whole tokenizer."""
        if not self.plain:
            return set(words)
        if not _ODD.search(b" ".join(words).decode("utf-8", "replace")):
            return set()
        return {w for w in words if _ODD.search(w.decode("utf-8", "replace"))}

    def _by_parts(self, words: list[str]) -> list[bytes]:
        """Ids of words of plain characters."""
        ids: list[int] = []
        ends = [0]
        for part in _PARTS.findall(" ".join(words).lower()):
            if part == " ":
                ends.append(4 * len(ids))
                continue
            if not part.isascii():
                part = codecs.charmap_decode(part.encode(), "strict", _BYTE_CHARS)[0]
            ids += [t.id for t in self.model.tokenize(part)]
        found = np.array(ids, "<u4").tobytes()
        return [found[s:e] for s, e in zip(ends, [*ends[1:], len(found)])]

    def _encode(self, words: list[str]) -> Iterator[bytes]:
        if self.mark is not None and len(words) > 1:
            ids = np.array(self.tokenizer.encode(f" {_MARK} ".join(words), add_special_tokens=False).ids, "<u4")
            cuts = np.flatnonzero(ids == self.mark)
            if len(cuts) == len(words) - 1:
                for s, e in zip(np.append(0, cuts + 1), np.append(cuts, len(ids))):
                    yield ids[s:e].tobytes()
                return
        for w in words:
            yield np.array(self.tokenizer.encode(w, add_special_tokens=False).ids, "<u4").tobytes()

    def learn(self, words: set[bytes]) -> None:
        if len(self.young) > WORDS_KEPT:
            self.young, self.old = {}, self.young
        new = []
        for w in words.difference(self.young):
            known = self.old.get(w)
            if known is None:
                new.append(w)
            else:
                self.young[w] = known
        odd = self._odd(new)
        plain = [w for w in new if w not in odd]
        whole = [w for w in odd if b"\x01" not in w]
        for encode, some in ((self._by_parts, plain), (self._encode, whole)):
            for s in range(0, len(some), 2000):
                part = some[s : s + 2000]
                self.young.update(zip(part, encode([w.decode("utf-8", "replace") for w in part])))
        for w in odd.difference(whole):
            self.young[w] = next(self._encode([w.decode("utf-8", "replace")]))


_LOADED: dict[str, WordIds] = {}
FORGET.append(_LOADED.clear)


def word_ids(path: str | None) -> WordIds:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    if path not in _LOADED:
        _LOADED[path] = WordIds(path)
    return _LOADED[path]


def lowered(text: bytes) -> bytes:
    """A-Z lower-cased where the tokenizer does the same: not with combining marks or special tokens around."""
    return text if b"\xcc" in text or b"\xcd" in text or b"<|" in text else text.lower()


def _pieces(path: str | None, capacity: int, end_id: int):
    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = word_ids(path)
        end = end_id.to_bytes(4, "little")
        for b in batches:
            data, at, _ = strings(b.column("text"))
            keys, doc_ids = b.column("key").to_pylist(), b.column("doc_id").to_pylist()
            for first, last in chunks(at):
                words = [lowered(data[at[i] : at[i + 1]].tobytes()).split() for i in range(first, last)]
                ids.learn(set().union(*words))
                out = []
                for i, w in zip(range(first, last), words):
                    tokens = b"".join([*map(ids.young.__getitem__, w), end])
                    n = len(tokens) // 4
                    for p, s in enumerate(range(0, n, capacity)):
                        e = min(s + capacity, n)
                        out.append((keys[i], doc_ids[i], p, s, e - s, zlib.crc32(tokens[4 * s : 4 * e])))
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], ["key", "doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """``key, doc_id, piece, start, length, ids_crc32``; tokenizer: path of a file, by default word_bpe_49k."""
    number = F.monotonically_increasing_id().alias("key")  # tells equal rows apart; the pieces are written once
    body = docs.select(number, F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return body.mapInArrow(_pieces(tokenizer, capacity, end_id), "key long, doc_id long, piece int, start long, length long, ids_crc32 long")


class Stock:
    """Lengths that are still to be packed, with their numbers."""

    def __init__(self, lengths: list[int]):
        self.count: dict[int, int] = {}
        for x in lengths:
            self.count[x] = self.count.get(x, 0) + 1
        self.sorted = sorted(self.count)

    def take(self, x: int) -> None:
        self.count[x] -= 1
        if not self.count[x]:
            del self.count[x]
            del self.sorted[bisect_left(self.sorted, x)]

    def put(self, x: int) -> None:
        if x not in self.count:
            insort(self.sorted, x)
        self.count[x] = self.count.get(x, 0) + 1

    def fillings(self, room: int, nodes: int) -> Iterator[tuple[int, tuple[int, ...]]]:
        """(waste, lengths) of closed fillings of ``room``, largest piece first; each better than those before."""
        lengths, count = self.sorted, self.count
        if not lengths:
            yield room, ()
            return
        least, best = lengths[0], room + 1
        path: list[int] = []  # places in ``lengths``
        left = room
        at = bisect_right(lengths, room) - 1
        while True:
            # go down: add the largest piece that fits, at most as large as the last one
            while at >= 0 and left >= least:
                at = min(at, bisect_right(lengths, left) - 1)
                while at >= 0 and path and path[-1] == at and path.count(at) >= count[lengths[at]]:
                    at -= 1
                if at < 0:
                    break
                path.append(at)
                left -= lengths[at]
                nodes -= 1
            if left < best:
                best = left
                yield left, tuple(lengths[i] for i in path)
            if best == 0 or nodes <= 0 or not path:
                return
            # go back: the last piece gives way to the next smaller one
            last = path.pop()
            left += lengths[last]
            at = last - 1
            nodes -= 1


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing."""
    rooms: list[tuple[int, int]] = []  # (room, sequence), sorted
    out: list[list[int]] = []
    for x in sorted(lengths, reverse=True):
        at = bisect_left(rooms, (x, -1))
        if at == len(rooms):
            out.append([x])
            insort(rooms, (capacity - x, len(out) - 1))
        else:
            room, i = rooms.pop(at)
            out[i].append(x)
            insort(rooms, (room - x, i))
    return out


def branch(lengths: list[int], capacity: int, incumbent: list[list[int]], nodes: int = 2000) -> list[list[int]]:
    """Bin completion over few sequences: the largest piece first, several fillings each, pruned by the bound."""
    stock = Stock(lengths)
    best, budget, now = incumbent, [nodes], []

    def go(left: int) -> None:
        nonlocal best
        if not left:
            if len(now) < len(best):
                best = [list(x) for x in now]
            return
        budget[0] -= 1
        if budget[0] < 0 or len(now) + -(-left // capacity) >= len(best):
            return
        top = stock.sorted[-1]
        stock.take(top)
        found = list(stock.fillings(capacity - top, NODES))
        for waste, filling in reversed(found):
            for x in filling:
                stock.take(x)
            now.append([top, *filling])
            go(left - top - sum(filling))
            now.pop()
            for x in filling:
                stock.put(x)
        stock.put(top)

    go(sum(lengths))
    return best


def complete(lengths: list[int], capacity: int) -> list[list[int]]:
    """Sequences of lengths, each at most ``capacity`` in all, as few as found."""
    incumbent = best_fit(lengths, capacity)
    bound = -(-sum(lengths) // capacity)
    if len(incumbent) <= bound:
        return incumbent
    stock, out = Stock(lengths), []
    while stock.sorted:
        top = stock.sorted[-1]
        stock.take(top)
        *_, (_, filling) = stock.fillings(capacity - top, NODES)
        for x in filling:
            stock.take(x)
        out.append([top, *filling])
    if len(out) > bound:
        tail = out[-TAIL:]
        out = out[:-TAIL] + branch([x for s in tail for x in s], capacity, tail)
    return min(out, incumbent, key=len)


def _pack_group(capacity: int, level: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "key", "piece"], kind="stable").reset_index(drop=True)
        lengths = pdf["length"].to_numpy()
        base = (level << 56) + (int(pdf["g"].iloc[0]) << 24)
        open_: dict[int, list[int]] = {}
        for i in range(len(pdf) - 1, -1, -1):
            open_.setdefault(int(lengths[i]), []).append(i)
        sequence, offset, fill = (np.zeros(len(pdf), np.int64) for _ in range(3))
        full = open_.pop(capacity, [])
        plan = [[capacity]] * len(full) + complete([x for x, rows in open_.items() for _ in rows], capacity)
        open_[capacity] = full
        for s, parts in enumerate(plan):
            at, total = 0, sum(parts)
            for x in parts:
                i = open_[x].pop()
                sequence[i], offset[i], fill[i] = base + s, at, total
                at += x
        pdf["sequence_id"], pdf["offset"], pdf["fill"] = sequence, offset, fill
        return pdf.drop(columns="g")

    return run


_PACKED = "key long, doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, fill long"


def pack(found: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds ``sequence_id, offset, fill`` (ids in the sequence) to the pieces."""
    rows, done = cut(found, "pieces"), None
    n = rows.count()
    for level in range(ROUNDS):
        groups = max(1, -(-n // GROUP))
        dealt = rows.select("key", "doc_id", "piece", "start", "length", "ids_crc32", F.pmod(F.xxhash64("key", "piece", F.lit(level)), F.lit(groups)).alias("g"))
        packed = cut(dealt.groupBy("g").applyInPandas(_pack_group(capacity, level), _PACKED), "packed")
        last = groups == 1 or level == ROUNDS - 1
        nearly = F.col("fill") >= int(NEARLY * capacity)
        closed = packed if last else packed.where(nearly)
        done = closed if done is None else done.unionAll(closed)
        if last:
            break
        rows = packed.where(~nearly)
        n = rows.count()
        if not n:
            break
    return done


def pack_documents(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset, fill`` per piece."""
    return pack(pieces(docs, tokenizer, capacity, end_id), capacity).drop("key")
