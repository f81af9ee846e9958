"""Content scan: many patterns over whole texts, in one pass.

A rule is ``{"rule", "patterns": {name: regex}, "need": n, "guard": Column-maker,
"need_guarded": n}``: it fires when enough of its patterns occur.
"""

from __future__ import annotations

import json
import re
import warnings
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from detectframe import fixed
from detectframe.functions.leaf import two_valued
from detectframe.operators.rules import choose, quoted
from detectframe.scale import any_true, fired, literal_table

# fixed values: the script and command patterns the reference results depend on
CONTENT_RULES: list[dict] = [
    {
        "rule": "suspicious_powershell_download", "need": 1,
        "patterns": {
            "$a": r"(?i)powershell.{0,200}(IWR|Invoke-WebRequest|Net\.WebClient|DownloadString|DownloadFile|FromBase64String)",
            "$b": r"-enc ",
            "$c": r"(?i)bypass.{0,40}executionpolicy",
            "$d": r"(?i)(IEX|Invoke-Expression).{0,80}(DownloadString|DownloadFile|FromBase64String|Net\.WebClient)",
            "$e": r"(?i)\.(DownloadString|DownloadFile|DownloadData)\s*\(",
            "$f": r"(?i)(IWR|Invoke-WebRequest).{0,120}-OutFile",
            "$g": r"(?i)New-Object\s+Net\.WebClient",
        },
    },
    {
        "rule": "suspicious_cmd_commands", "need": 1, "need_guarded": 2,
        "patterns": {
            "$a": r"(?i)cmd\.exe.{0,100}(/c|/k)",
            "$b": r"(?i)rundll32\.exe\s+[^\s]+,#\d+",
            "$c": r"(?i)regsvr32\.exe\s+/s\s+/i\s*:",
            "$d": r"(?i)mshta\.exe\s+(http|vbscript|javascript)",
            "$e": r"(?i)certutil\.exe.{0,80}(decode|urlcache|encode)",
        },
    },
    {
        "rule": "suspicious_urls", "need": 1,
        "patterns": {
            "$a": r"(?i)https?://[a-zA-Z0-9.\-]{5,}/[a-zA-Z0-9._\-]{5,}\.(exe|dll|bat|ps1|vbs|js|scr|cmd)",
            "$b": r"https?://[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}",
        },
    },
]


def is_executable(text: Column) -> Column:
    """Guard: the content starts with the executable mark ``MZ``."""
    return two_valued(F.substring(text, 1, 2) == "MZ")


def needed(rule: dict, guard: Column | None) -> Column:
    """O3: how many patterns a rule needs, by guard."""
    if guard is None or "need_guarded" not in rule:
        return F.lit(rule.get("need", 1))
    return F.when(guard, rule["need_guarded"]).otherwise(rule.get("need", 1))


def rule_fires(rule: dict, text: Column, guard: Column | None = None) -> Column:
    """O1/O3: enough different patterns occur in the text."""
    hits = [two_valued(text.rlike(p)) for p in rule["patterns"].values()]
    if rule.get("need", 1) == 1 and "need_guarded" not in rule:
        return any_true(hits)
    total = hits[0].cast("int")
    for h in hits[1:]:
        total = total + h.cast("int")
    return total >= needed(rule, guard)


#: Shortest literal worth looking for before a pattern is tried.
MIN_LITERAL = 3


def literals_of(pattern: str) -> set[str] | None:
    """Lower-case texts of which every match of the pattern contains at least one (ASCII case aside); None = not known.

    Patterns this reading does not cover, or whose case folding goes beyond ASCII, have none and are always tried.
    """
    flags = re.match(r"\(\?([a-zA-Z]+)\)", pattern)
    if flags and set(flags.group(1)) & set("uUx") or "\\v" in pattern or "\\b{" in pattern:
        return None
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("error")
            found = _cover(re._parser.parse(pattern.replace("(?<", "(?P<") if re.search(r"\(\?<[a-zA-Z]", pattern) else pattern))
    except (re.error, Warning, OverflowError, RecursionError):
        return None
    return found


def _cover(items) -> set[str] | None:
    best: list[set[str]] = []
    run = ""

    def close(run: str) -> str:
        if len(run) >= MIN_LITERAL and run.isascii():
            best.append({run.lower()})
        return ""

    for op, value in items:
        name = str(op)
        if name == "LITERAL":
            run += chr(value)
            continue
        run = close(run)
        inner = None
        if name == "SUBPATTERN":
            inner = _cover(value[-1])
        elif name == "ATOMIC_GROUP":
            inner = _cover(value)
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and value[0] > 0:
            inner = _cover(value[2])
        elif name == "BRANCH":
            parts = [_cover(x) for x in value[1]]
            inner = set().union(*parts) if all(parts) else None
        if inner:
            best.append(inner)
    close(run)
    return max(best, key=lambda c: (min(map(len, c)), -len(c)), default=None)


_ASCII_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def with_candidates(rows: DataFrame, text: str, patterns: list[str]) -> DataFrame:
    """Adds ``__cand``: places of the patterns that can occur in the text.

    One pass of a shared automaton over each text finds the literals of all patterns, so its time does not grow with
    their number.
    """
    covers = [literals_of(p) for p in patterns]
    always = [i for i, c in enumerate(covers) if c is None]
    if len(always) == len(patterns):
        return rows.withColumn("__cand", F.when(F.col(text).isNotNull(), F.sequence(F.lit(0), F.lit(len(patterns) - 1))).otherwise(F.array().cast("array<int>")))
    index: dict[str, list[int]] = {}
    for i, c in enumerate(covers):
        for lit in c or ():
            index.setdefault(lit, []).append(i)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        found = ahocorasick.Automaton()
        for lit, places in index.items():
            found.add_word(lit, tuple(places))
        found.make_automaton()
        for batch in batches:
            out = []
            for value in batch.column(text):
                value = value.as_py()
                # one byte a character: literals are ASCII
                line = "" if value is None else value.encode().translate(_ASCII_LOWER).decode("latin-1")
                out.append([] if value is None else sorted({i for _, places in found.iter(line) for i in places}.union(always)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.list_(pa.int32()))], [*batch.schema.names, "__cand"])

    return rows.mapInArrow(look, StructType([*rows.schema.fields, StructField("__cand", ArrayType(IntegerType()))]))


def _numbered(rules: list[dict]) -> list[tuple[int, str, str]]:
    return [(r, name, p) for r, rule in enumerate(rules) for name, p in rule["patterns"].items()]


def pattern_scan(docs: DataFrame, rules: list[dict], key: str = "doc_id", text: str = "text", guard: Callable[[Column], Column] = is_executable) -> DataFrame:
    """O1: (key, rule) of every rule that fires; one pass over the texts, no shuffle.

    Only patterns whose literals occur in a text are tried on it, and a rule is looked at only if one of its patterns
    occurs, so neither part grows with the rule set.
    """
    patterns = _numbered(rules)
    x = with_candidates(docs.select(key, F.col(text).alias("__t")), "__t", [p for _, _, p in patterns]).withColumn("__guard", guard(F.col("__t")))
    tests = [f"coalesce(__t RLIKE {quoted(p)}, false)" for _, _, p in patterns]
    fixed_lists = {"__of": [r for r, _, _ in patterns], "__need": [r.get("need", 1) for r in rules], "__more": [r.get("need_guarded", r.get("need", 1)) for r in rules]}
    x = x.withColumns({name: F.from_json(F.lit(json.dumps(v)), "array<int>") for name, v in fixed_lists.items()})
    x = x.withColumn("__ids", F.from_json(F.lit(json.dumps([r["rule"] for r in rules])), "array<string>"))
    hits = f"transform(filter(__cand, n -> {choose(tests, 0, len(tests))}), n -> __of[n])" if patterns else "array()"
    idle = ", ".join(str(i) for i, r in enumerate(rules) if min(r.get("need", 1), r.get("need_guarded", 1)) <= 0)
    enough = "size(filter(h, y -> y = r)) >= if(coalesce(__guard, false), __more[r], __need[r])"
    # generated as values first: the filter Spark derives from an explode would evaluate all of it again
    x = x.select("*", F.explode(F.array(F.expr(f"CAST({hits} AS array<int>)"))).alias("h"))
    fires = F.expr(f"transform(filter(array_union(array_distinct(h), CAST(array({idle}) AS array<int>)), r -> {enough}), r -> __ids[r])")
    return x.select(key, F.explode(F.array(fires)).alias("__rules")).select(key, F.explode("__rules").alias("rule"))


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lengths between hits and the hits to one row per hit; a hit starts after everything before it."""
    for batch in batches:
        *front, gaps, found = batch.columns
        n = np.diff(found.offsets.to_numpy())
        if not n.sum():
            continue
        of = np.repeat(np.arange(batch.num_rows), n)
        hits = found.flatten()
        long = pa.compute.utf8_length(hits).to_numpy().astype(np.int64)
        # the gap before a hit is the one at its own place; there may be more gaps than hits
        first = gaps.offsets.to_numpy()[:-1] - gaps.offsets.to_numpy()[0]
        inside = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
        before = gaps.flatten().to_numpy()[np.repeat(first, n) + inside].astype(np.int64)
        total = np.cumsum(before + long)
        start = np.repeat(np.concatenate([[0], total])[np.cumsum(n) - n], n)
        offset = total - long - start
        yield pa.RecordBatch.from_arrays([c.take(pa.array(of)) for c in front] + [pa.array(offset, pa.int32()), hits], [*batch.schema.names[:-2], "offset", "data"])


def pattern_hits(docs: DataFrame, rules: list[dict], key: str = "doc_id", text: str = "text") -> DataFrame:
    """O2: every hit of every pattern: rule, pattern name, 0-based offset, matched text.

    The pieces between hits and the hits themselves alternate, so an offset is the length of everything before it: a
    running sum over the hits of an Arrow batch, linear in their number.
    """
    patterns = _numbered(rules)
    x = with_candidates(docs.select(key, F.col(text).alias("__t")), "__t", [p for _, _, p in patterns])
    t = F.col("__t")

    def found(i: int, r: int, name: str, p: str) -> Column:
        hits = F.regexp_extract_all(t, F.lit(f"({p})"), F.lit(1))
        row = F.struct(F.lit(rules[r]["rule"]).alias("rule"), F.lit(name).alias("pattern"), F.transform(F.split(t, p), F.char_length).alias("gaps"), hits.alias("found"))
        return F.when(F.array_contains("__cand", i) & t.rlike(p), row)

    each = x.select(key, F.explode(F.array(*[found(i, *one) for i, one in enumerate(patterns)])).alias("h")).filter(F.col("h").isNotNull()).select(key, "h.*")
    schema = StructType([docs.schema[key], StructField("rule", StringType()), StructField("pattern", StringType()), StructField("offset", IntegerType()), StructField("data", StringType())])
    return each.mapInArrow(_places, schema)


def describe_patterns(spark, rules: list[dict]) -> DataFrame:
    """Catalog of the patterns."""
    rows = [(r["rule"], n, p, int(r.get("need", 1))) for r in rules for n, p in r["patterns"].items()]
    return literal_table(spark, rows, "rule string, pattern string, regex string, need int")


def family_hits(matches: DataFrame, tokens: dict[str, list[str]] = fixed.FAMILY_TOKENS) -> DataFrame:
    """Matched rule names that contain a token of a family, as (key.., rule, family)."""
    low = F.lower("rule")
    hits = fired([(any_true([low.contains(t) for t in toks]), F.lit(fam)) for fam, toks in tokens.items()])
    return matches.select("*", F.explode(hits).alias("family"))
