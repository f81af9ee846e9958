"""Row shaping of collected telemetry, as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from detectframe import fixed
from detectframe.functions.leaf import two_valued
from detectframe.functions.scalar import as_num
from detectframe.scale import cut
from detectframe.schema import fld


def classify_event_id(source: Column, event_id: Column) -> Column:
    """A3: type name of a (source, id); an unlisted id is named after its source.

    The table has some sixty entries: a literal map, no join.
    """
    key = F.concat_ws(":", source, event_id.cast("string"))
    names = F.create_map(*[F.lit(x) for s, ids in fixed.EVENT_TYPES.items() for i, n in ids.items() for x in (f"{s}:{i}", n)])
    prefix = F.create_map(*[F.lit(x) for kv in fixed.EVENT_TYPE_FALLBACK.items() for x in kv])
    return F.coalesce(names[key], F.concat(F.coalesce(prefix[source], F.concat(F.initcap(source), F.lit("Event"))), event_id.cast("string")))


def filter_event_ids(events: DataFrame, ids: list[int]) -> DataFrame:
    """A4: keep the ids a rule set names; an IN list that Parquet can push down."""
    return events.filter(F.col("event_id").isin(ids))


def since_baseline(events: DataFrame, record_id: int | None = None, ts=None, record_col: str = "record_id") -> DataFrame:
    """A5: increment after a baseline, by record id if there is one (clocks jump), else by time."""
    if record_id is not None:
        return events.filter(F.col(record_col) > record_id)
    return events if ts is None else events.filter(F.col("ts") >= F.lit(ts))


def normalize_api_trace(raw: DataFrame) -> DataFrame:
    """Raw ``(run_id, seq, ts, api, category, pid, tid, arg0)`` to events; a bad epoch becomes now."""
    return raw.select(
        "run_id", "seq", F.lit("apitrace").alias("source"), F.lit(9200).alias("event_id"), F.lit("ApiCall").alias("event_type"),
        F.coalesce(F.timestamp_micros((as_num(F.col("ts")) * 1_000_000).cast("bigint")), F.current_timestamp()).alias("ts"),
        F.col("api").alias("Api"), F.col("category").alias("Category"), F.col("pid").cast("string").alias("ProcessId"),
        F.col("tid").cast("string").alias("ThreadId"), F.col("arg0").alias("Arg0"),
    )


def unify(*sources: DataFrame) -> DataFrame:
    """One table out of several sources; ordering is left to whoever needs it (``ts, source, seq``)."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), sources)


def time_order() -> list[Column]:
    """The collector's order: time (missing first), then source and position."""
    return [F.col("ts").asc_nulls_first(), F.col("source").asc(), F.col("seq").asc()]


def positions(events: DataFrame, order: list[Column]) -> DataFrame:
    """Adds ``pos``, the place in the given order from 1 on.

    A range-partitioned sort is written once; a row's place is its place in its range after the sizes of the
    ranges before it (one row per range is gathered).
    """
    placed = cut(events.sort(*order).withColumn("__at", F.monotonically_increasing_id()), "ordered").withColumn("__range", F.shiftright("__at", 33))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy("__range").agg(F.count("*").alias("__n")).withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    inside = F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.join(sizes, "__range").withColumn("pos", F.col("__before") + inside + 1).drop("__at", "__range", "__n", "__before")


def source_health(events: DataFrame, expected: DataFrame) -> DataFrame:
    """Count per expected (run, source) with an empty flag."""
    n = events.groupBy("run_id", "source").agg(F.count("*").alias("n"))
    return expected.join(n, ["run_id", "source"], "left").select(
        "run_id", "source", F.coalesce("n", F.lit(0)).alias("n"), F.col("n").isNull().alias("empty"))


def title_case(text: Column) -> Column:
    """Upper-case the first letter of every letter run, lower-case the rest."""
    words = F.regexp_extract_all(text, F.lit(r"([\p{L}]+|[^\p{L}]+)"), F.lit(1))
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1_000_000)))), "")


def classify_trace_opcode(opcode: Column) -> Column:
    """Coarse class of a kernel-trace opcode; unknown text in title case, none -> Unknown."""
    op = F.lower(F.coalesce(opcode, F.lit("")))
    first: dict[str, str] = {}
    for cls, ops in fixed.TRACE_CLASSES:
        for o in ops:
            first.setdefault(o, cls)
    table = F.create_map(*[F.lit(x) for kv in first.items() for x in kv])
    return F.coalesce(table[op], F.when(op == "", "Unknown").otherwise(title_case(op)))


def decode_scan_content(content: Column, max_chars: int = fixed.MAX_SCAN_CONTENT) -> Column:
    """A10: ``0x`` hex of UTF-16LE to text, cut at the collector's own limit with a marker."""
    digits = F.substring(content, 3, 2**30)
    ok = content.startswith("0x") & digits.rlike("^([0-9a-fA-F]{2})*$")
    text = F.decode(F.unhex(F.when(ok, digits)), "UTF-16LE")
    cut = F.when(F.char_length(text) > max_chars, F.concat(F.substring(text, 1, max_chars), F.lit(fixed.SCAN_CONTENT_MARKER))).otherwise(text)
    return F.coalesce(cut, F.lit(""))


def keep_fields(data: Column, names: list[str] = fixed.WMI_FIELDS) -> Column:
    """Only the listed fields, compared in lower case."""
    return F.map_filter(data, lambda k, v: F.lower(k).isin(names))


def alias_field(data: Column, name: str, spellings: list[str]) -> Column:
    """Add ``name`` from the first other spelling present, unless it is there already."""
    found = F.coalesce(*[data[s] for s in spellings])
    have = F.map_contains_key(data, name) | found.isNull()
    return F.when(have, data).otherwise(F.map_concat(data, F.create_map(F.lit(name), found)))


def filetime_to_ts(ticks: Column) -> Column:
    """100 ns ticks since 1601 to a timestamp (microseconds, rounded down)."""
    return F.timestamp_micros(F.call_function("div", ticks.cast("bigint"), F.lit(10)) - F.lit(11_644_473_600_000_000))


def first_n(df: DataFrame, key: str, order: str, n: int, width: int = 4096) -> DataFrame:
    """First ``n`` rows per key by an integer order column, without a key's rows or stretches in one task.

    Row counts per (key, stretch of ``width`` order values) tell which stretch holds the last kept row; stretches
    before it are kept whole and only rows of that one are ranked.  The stretch is found the same way, among ``width``
    stretches of one wide stretch, so the cut has two levels and a task at most ``width`` stretches.
    """
    x = df.withColumn("__b", F.floor(F.col(order) / width))
    counts = x.groupBy(key, "__b").agg(F.count("*").alias("__c")).withColumn("__w", F.floor(F.col("__b") / width))

    def up_to(rows: DataFrame, within: list[str], place: str, size: str, start: Column) -> DataFrame:
        w = Window.partitionBy(*within).orderBy(place).rowsBetween(Window.unboundedPreceding, -1)
        return rows.withColumn("__before", start + F.coalesce(F.sum(size).over(w), F.lit(0))).filter(F.col("__before") < n)

    wide = up_to(counts.groupBy(key, "__w").agg(F.sum("__c").alias("__n")), [key], "__w", "__n", F.lit(0)).withColumnRenamed("__before", "__start")
    kept = up_to(counts.join(wide.drop("__n"), [key, "__w"]), [key, "__w"], "__b", "__c", F.col("__start")).drop("__start", "__w")
    x = x.join(kept, [key, "__b"])
    edge = F.col("__before") + F.col("__c") > n
    rank = F.row_number().over(Window.partitionBy(key, "__b").orderBy(order))
    last = x.filter(edge).withColumn("__rn", rank).filter(F.col("__before") + F.col("__rn") <= n).drop("__rn")
    return x.filter(~edge).unionByName(last).drop("__b", "__c", "__before")


def cap_events(events: DataFrame, n: int = fixed.MAX_CAPTURE_EVENTS, key: str = "run_id", order: str = "seq") -> DataFrame:
    """The first n events per capture, with a flag that more existed."""
    total = events.groupBy(key).agg(F.count("*").alias("__n"))
    return first_n(events, key, order, n).join(total, key).withColumn("truncated", F.col("__n") > n).drop("__n")


def missing_ids(events: DataFrame) -> DataFrame:
    """Events without an id get 0."""
    return events.withColumn("event_id", F.coalesce("event_id", F.lit(0)))


def has_field(events: DataFrame, name: str) -> Column:
    return two_valued(fld(events, name) != "")
