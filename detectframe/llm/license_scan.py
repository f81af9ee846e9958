"""License scan: Aho-Corasick over words finds identifier tags and notice phrases, a shunting-yard parser reads expressions.

One automaton holds all phrases as whole words; one pass over a text's words finds every place of every phrase, so a
text costs the same however many phrases there are.  Where an identifier tag occurs, the license expression behind it
(``MIT OR (Apache-2.0 WITH LLVM-exception AND BSD-3-Clause)``) is brought into postfix order by precedence (WITH, AND,
OR) and evaluated: OR lets the reader choose the least obligation, AND binds to the greatest, WITH lowers it by one.

The pass is narrow: no shuffle, no state, one text at a time.

Defined results: NULL and empty texts have no words, no labels and score 0; texts of any length are read whole;
repeated rows are judged alike, each on its own; of notice phrases that cover one another the longest counts (equal
ones cannot be at one place), base phrases always count; an expression ends at the first token that cannot go on, and
one without its closing brackets is malformed: its identifiers are named, but it has no obligation; other columns, with
any names, are not read; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Phrases and labels of the base scan.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Further notice phrases (as words): label, and how sure the phrase alone makes it.
NOTICES = {
    "permission is hereby granted free of charge to any person obtaining a copy": ("mit", 0.9),
    "permission to use copy modify and or distribute this software for any purpose": ("isc", 0.9),
    "redistribution and use in source and binary forms": ("bsd", 0.9),
    "this is free and unencumbered software released into the public domain": ("unlicense", 0.9),
    "gnu lesser general public license": ("lgpl", 0.8),
    "gnu library general public license": ("lgpl", 0.8),
    "gnu affero general public license": ("agpl", 0.8),
    "mozilla public license": ("mpl", 0.8),
    "eclipse public license": ("epl", 0.8),
    "european union public licence": ("eupl", 0.8),
    "common development and distribution license": ("cddl", 0.8),
    "boost software license": ("bsl", 0.8),
    "creative commons attribution sharealike": ("cc-by-sa", 0.8),
    "creative commons attribution noncommercial": ("cc-by-nc", 0.8),
    "creative commons attribution": ("cc-by", 0.8),
    "creative commons zero": ("cc0", 0.8),
    "sil open font license": ("ofl", 0.8),
    "bsd license": ("bsd", 0.6),
    "bsd 2 clause": ("bsd", 0.6),
    "bsd 3 clause": ("bsd", 0.6),
    "isc license": ("isc", 0.6),
    "zlib license": ("zlib", 0.6),
    "artistic license": ("artistic", 0.6),
    "cc by nc": ("cc-by-nc", 0.6),
    "cc by nd": ("cc-by-nd", 0.6),
    "cc by sa": ("cc-by-sa", 0.6),
    "cc by": ("cc-by", 0.5),
    "cc0 1 0": ("cc0", 0.6),
    "all rights reserved": ("proprietary", 0.4),
}
BASE_WEIGHT, EXPRESSION_WEIGHT, MALFORMED_WEIGHT = 0.6, 0.95, 0.5

#: Fields whose value is a license expression.
TAGS = ("spdx-license-identifier", "license-expression")

#: Obligations from the least on.
OBLIGATIONS = ("permissive", "weak copyleft", "strong copyleft", "restricted")

#: Identifier prefix -> label and obligation; the longest prefix wins, anything else is ("other", 3).
FAMILIES = {
    "mit": ("mit", 0), "x11": ("mit", 0), "apache-": ("apache", 0), "bsd-": ("bsd", 0), "0bsd": ("bsd", 0), "isc": ("isc", 0), "zlib": ("zlib", 0),
    "bsl-": ("bsl", 0), "unlicense": ("unlicense", 0), "wtfpl": ("wtfpl", 0), "cc0-": ("cc0", 0), "cc-by-": ("cc-by", 0), "python-": ("python", 0), "psf-": ("python", 0),
    "postgresql": ("postgresql", 0), "ofl-": ("ofl", 1), "lgpl-": ("lgpl", 1), "mpl-": ("mpl", 1), "epl-": ("epl", 1), "cddl-": ("cddl", 1), "artistic-": ("artistic", 1),
    "cc-by-sa-": ("cc-by-sa", 2), "eupl-": ("eupl", 2), "osl-": ("osl", 2), "gpl-": ("gpl", 2), "agpl-": ("agpl", 2), "cc-by-nc-": ("cc-by-nc", 3), "cc-by-nd-": ("cc-by-nd", 3),
}

# ------------------------------------------------------------------ expressions

_PRECEDENCE = {"or": 1, "and": 2, "with": 3}
_TOKEN = re.compile(r"[ \t]*([()]|[a-z0-9][a-z0-9.:+-]*)")


def tokens(text: str) -> Iterator[str]:
    """Tokens of a lower-cased expression up to the first character that can be none."""
    at = 0
    while m := _TOKEN.match(text, at):
        yield m.group(1)
        at = m.end()


def postfix(found: Iterator[str]) -> tuple[list[str], bool]:
    """Postfix order by the shunting-yard method, and whether the expression is whole.

    Operands and operators alternate; the first token out of place ends the expression.  An operator that ends the
    expression has no right side and is taken back.
    """
    out, stack, operand = [], [], False
    for t in found:
        if t == "(" and not operand:
            stack.append(t)
        elif t == ")" and operand and "(" in stack:
            while stack[-1] != "(":
                out.append(stack.pop())
            stack.pop()
        elif t in _PRECEDENCE and operand:
            while stack and stack[-1] != "(" and _PRECEDENCE[stack[-1]] >= _PRECEDENCE[t]:
                out.append(stack.pop())
            stack.append(t)
            operand = False
        elif t not in _PRECEDENCE and t not in "()" and not operand:
            out.append(t)
            operand = True
        else:
            break
    whole = operand and "(" not in stack
    if not operand:
        while stack and stack[-1] == "(":
            stack.pop()
        if stack:
            stack.pop()
    return out + [t for t in reversed(stack) if t != "("], whole


def family(identifier: str) -> tuple[str, int]:
    """Label and obligation of one identifier."""
    name = identifier.rstrip("+.")
    fits = [p for p in FAMILIES if (name + "-").startswith(p if p.endswith("-") else p + "-")]
    return FAMILIES[max(fits, key=len)] if fits else ("other", 3)


def evaluate(order: list[str]) -> tuple[set[str], int] | None:
    """Labels and obligation of a postfix expression; None if there is none.

    What stands right of WITH is an exception, not a license.
    """
    stack: list[tuple[frozenset[str], int]] = []
    for t in order:
        if t not in _PRECEDENCE:
            label, rank = family(t)
            stack.append((frozenset([label]), rank))
            continue
        if len(stack) < 2:
            return None
        right, left = stack.pop(), stack.pop()
        if t == "with":
            stack.append((left[0], max(left[1] - 1, 0)))
        else:
            stack.append((left[0] | right[0], (min if t == "or" else max)(left[1], right[1])))
    return (set(stack[-1][0]), stack[-1][1]) if stack else None


def expressions(text: bytes) -> Iterator[tuple[str, bool]]:
    """Behind every tag of a lower-cased text: the postfix expression, and whether it is whole."""
    for m in re.finditer(rb"(?:" + b"|".join(re.escape(t.encode()) for t in TAGS) + rb")[ \t]*:([^\r\n]*)", text):
        order, whole = postfix(tokens(m.group(1).decode()))
        if order:
            yield " ".join(order), whole


# ------------------------------------------------------------------ the pass over the texts

_WORD_BYTES = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(128)) + bytes(range(128, 256))
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


@cache
def _automaton() -> ahocorasick.Automaton:
    """All phrases and tags, each between spaces; the value tells its kind."""
    found = ahocorasick.Automaton()
    values: dict[str, tuple] = {}
    for phrase in [*BASE, *NOTICES, *(t.replace("-", " ") for t in TAGS)]:
        values[phrase] = (phrase, phrase in BASE, phrase in NOTICES)
    for phrase, value in values.items():
        found.add_word(f" {phrase} ", value)
    found.make_automaton()
    return found


def judge(text: str | None) -> tuple:
    """``n_words, n_base, first_word, last_word, base_labels, labels, score, expressions, obligation`` of one text."""
    raw = (text or "").encode().translate(_LOWER)
    words = raw.translate(_WORD_BYTES).split()
    # one byte per character, so that places are byte places
    line = (b" " + b" ".join(words) + b" ").decode("latin-1")
    base, notices, tagged = [], [], False
    for end, (phrase, is_base, is_notice) in _automaton().iter(line):
        start = end - len(phrase) - 1
        if is_base:
            base.append((start, phrase))
        if is_notice:
            notices.append((start, end, phrase))
        tagged |= not is_base and not is_notice
    evidence = {("base", p): (BASE[p], BASE_WEIGHT) for _, p in base}
    # longest first at each start; one that ends inside an earlier one is covered
    reach = -1
    for _, end, phrase in sorted(notices, key=lambda n: (n[0], -n[1])):
        if end > reach:
            evidence[("notice", phrase)] = NOTICES[phrase]
            reach = end
    read, ranks = {}, []
    for order, whole in expressions(raw) if tagged else ():
        value = evaluate(order.split(" ")) if order not in read else None
        read.setdefault(order, None)
        if value is not None:
            for label in value[0]:
                evidence[("tag", order, label)] = (label, 0.0)
            evidence[("tag", order)] = (min(value[0]), EXPRESSION_WEIGHT if whole else MALFORMED_WEIGHT)
            ranks += [value[1]] if whole else []
    doubt = 1.0
    for key in sorted(evidence):
        doubt *= 1.0 - evidence[key][1]
    starts = [s for s, _ in base]
    return (
        len(words), len(base), line.count(" ", 0, min(starts)) if base else None, line.count(" ", 0, max(starts)) if base else None,
        ",".join(sorted({BASE[p] for _, p in base})), ",".join(sorted({label for label, _ in evidence.values()})), 1.0 - doubt,
        list(read), OBLIGATIONS[max(ranks)] if ranks else None,
    )


_FOUND = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, expressions array<string>, obligation string"
_FIELDS = [
    ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()),
    ("score", pa.float64()), ("expressions", pa.list_(pa.string())), ("obligation", pa.string()),
]


def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [judge(t.as_py()) for t in batch.column("text")]
        found = [pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(_FIELDS)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *found], ["doc_id", *(n for n, _ in _FIELDS)])


def scan(docs: DataFrame) -> DataFrame:
    """One row per document: base counts and places, labels, score, the expressions read (postfix) and their obligation.

    Several expressions hold together, so the greatest obligation counts.  ``score`` is the chance that not all
    evidence misleads; each phrase or expression counts once.
    """
    body = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return body.mapInArrow(_judged, f"doc_id long, {_FOUND}")
