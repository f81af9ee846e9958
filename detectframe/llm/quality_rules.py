"""Quality rules as a bitmask ledger: every rule is evaluated once, policies and ablations read the bits.

``ledger`` makes one narrow pass over the texts and stores measurements and failure bits; it needs no
shuffle.  ``apply_policy`` and ``ablation`` never look at a text again: a policy is a mask with a version.

NULL and empty texts have no words: all counts are 0 and ``few_words`` fails.  Repeated rows are judged
alike, each on its own.  Other columns are not read.  An empty table gives an empty ledger.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]

#: Rule -> failing condition over the measurements; the place in the list is its bit.
RULES: list[tuple[str, str]] = [
    ("few_words", "n_words < 50"),
    ("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    ("symbols", "n_symbols > n_words"),
    ("repeated_lines", "n_lines >= 4 AND 100 * n_dup_lines > 50 * n_lines"),
    ("long_words", "word_chars > 25 * n_words"),
    ("short_words", "n_words > 0 AND 2 * word_chars < 3 * n_words"),
]
BIT = {name: 1 << i for i, (name, _) in enumerate(RULES)}


@dataclass(frozen=True)
class Policy:
    """A versioned choice of rules; a document is kept if none of them failed."""

    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(BIT[r] for r in self.rules)


BASE = Policy("base-1", ("few_words", "repeated_windows"))
STRICT = Policy("strict-1", tuple(name for name, _ in RULES))

_SYMBOLS = "#*$%&|<>"
_SPACES = " \t\n\r\x0b\x0c"


def repeated_words(words: list[bytes]) -> int:
    """Words inside windows of three words that occur more than once, first occurrences included."""
    windows = list(zip(words, words[1:], words[2:]))
    counts = Counter(windows)
    if len(counts) == len(windows):
        return 0
    covered = bytearray(len(words))
    for i, w in enumerate(windows):
        if counts[w] > 1:
            covered[i : i + 3] = b"\1\1\1"
    return covered.count(1)


def measure(text: str | None) -> tuple[int, ...]:
    """The measurements of one text, in the order of ``MEASURES``."""
    if not text:
        return (0,) * len(MEASURES)
    words = text.encode("utf-8", "surrogatepass").split()
    seen: set[str] = set()
    lines = dup = 0
    for line in text.split("\n"):
        if line.strip(_SPACES):
            lines += 1
            if line in seen:
                dup += 1
            else:
                seen.add(line)
    chars = len(text) - sum(map(text.count, _SPACES))
    return len(words), chars, sum(map(text.count, _SYMBOLS)), dup, repeated_words(words), lines


def _measure_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        got = [measure(t.as_py()) for t in batch.column("text")]
        columns = [pa.array([g[i] for g in got], pa.int64()) for i in range(len(MEASURES))]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", *MEASURES])


def ledger(docs: DataFrame) -> DataFrame:
    """``doc_id``, the measurements, and ``failed``: one bit per rule that the text fails."""
    measured = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        _measure_batches, "doc_id long, " + ", ".join(f"{m} long" for m in MEASURES)
    )
    bits = " | ".join(f"CASE WHEN {cond} THEN {BIT[name]}L ELSE 0L END" for name, cond in RULES)
    return measured.withColumn("failed", F.expr(bits))


def apply_policy(rows: DataFrame, policy: Policy) -> DataFrame:
    """Adds ``policy`` and ``kept`` to a ledger."""
    return rows.withColumn("policy", F.lit(policy.version)).withColumn("kept", F.col("failed").bitwiseAND(F.lit(policy.mask)) == 0)


def ablation(rows: DataFrame, policy: Policy) -> DataFrame:
    """Per rule of a policy: documents it fails, documents only it fails, and documents kept without it.

    One aggregation over the ledger gives all counts (bits are tested, no text is read); the few totals are
    then laid out as rows.
    """
    mask, hit = policy.mask, F.col("failed").bitwiseAND(F.lit(policy.mask))
    kept = F.count_if(hit == 0)
    per_rule = [
        F.struct(
            F.lit(r).alias("rule"),
            F.count_if(hit.bitwiseAND(F.lit(BIT[r])) != 0).alias("n_failed"),
            F.count_if(hit == BIT[r]).alias("n_only"),
            F.count_if(hit.bitwiseAND(F.lit(mask & ~BIT[r])) == 0).alias("n_kept_without"),
            kept.alias("n_kept"),
        )
        for r in policy.rules
    ]
    return rows.agg(F.array(*per_rule).alias("r")).select(F.explode("r").alias("r")).select(F.lit(policy.version).alias("policy"), "r.*")
