"""Paging and listing: filters, ordered limits, exact totals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from detectframe.functions.leaf import two_valued
from detectframe.functions.scalar import row_contains


def _names(text: str | list[str] | None) -> list[str]:
    if text is None:
        return []
    return [x.strip() for x in (text.split(",") if isinstance(text, str) else text) if x.strip()]


def filter_events(events: DataFrame, types=None, sources=None, q: str | None = None) -> DataFrame:
    out = events
    if _names(sources):
        out = out.filter(F.col("source").isin(_names(sources)))
    if _names(types):
        out = out.filter(F.col("event_type").isin(_names(types)))
    return out.filter(row_contains(q)) if q else out


def page(df: DataFrame, offset: int, limit: int, order: list) -> DataFrame:
    """One ordered page; a top-k operator, not a full sort, while offset + limit is small."""
    return df.orderBy(*order).offset(offset).limit(limit)


def page_events(events: DataFrame, offset=0, limit=200, types=None, sources=None, q=None) -> DataFrame:
    """Page of the event stream; comma lists of types and sources, substring of the row's JSON."""
    return page(filter_events(events, types, sources, q), offset, limit, ["seq"])


def page_totals(events: DataFrame, filtered: DataFrame) -> DataFrame:
    """Total and filtered total as one row."""
    zero = F.lit(0).cast("bigint")
    both = events.agg(F.count("*").alias("total"), zero.alias("filtered_total")).unionByName(
        filtered.agg(zero.alias("total"), F.count("*").alias("filtered_total")))
    return both.agg(F.sum("total").alias("total"), F.sum("filtered_total").alias("filtered_total"))


def filter_alerts(alerts: DataFrame, scope: str | None = None, event_type: str | None = None, q: str | None = None) -> DataFrame:
    """Scope ``sample`` means not explicitly out of scope."""
    out = alerts
    if scope == "sample":
        out = out.filter(~two_valued(~F.col("in_scope")))
    elif scope == "environment":
        out = out.filter(two_valued(~F.col("in_scope")))
    if event_type:
        out = out.filter(F.col("event_type") == event_type)
    return out.filter(row_contains(q)) if q else out


def page_alerts(alerts: DataFrame, offset=0, limit=200, scope=None, event_type=None, q=None) -> DataFrame:
    """J2."""
    return page(filter_alerts(alerts, scope, event_type, q), offset, limit, ["seq"])


def filter_packets(packets: DataFrame, protocol=None, ip=None, port=None, q=None) -> DataFrame:
    """J3."""
    out = packets
    if protocol:
        out = out.filter(F.col("protocol") == protocol)
    if ip:
        out = out.filter((F.col("src") == ip) | (F.col("dst") == ip))
    if port is not None:
        out = out.filter((F.col("sport") == port) | (F.col("dport") == port))
    if q:
        low = q.lower()
        out = out.filter(two_valued(F.lower("summary").contains(low)) | two_valued(F.lower("dns_qname").contains(low)))
    return out


def page_packets(packets: DataFrame, offset=0, limit=100, protocol=None, ip=None, port=None, q=None) -> DataFrame:
    """A page in capture order; packets of one place are ordered by what they show, so pages never overlap."""
    return page(filter_packets(packets, protocol, ip, port, q), offset, limit, ["run_id", "idx", "ts", "src", "dst", "sport", "dport", "length", "summary"])


def packet_totals_exact(packets: DataFrame, filtered: DataFrame, truncated: bool = False) -> DataFrame:
    """Totals and whether the filtered one is exact (it is not for a truncated capture)."""
    return page_totals(packets, filtered).withColumn("filtered_total_is_exact", F.lit(not truncated))


def trim_alerts(alerts: DataFrame) -> DataFrame:
    """Alerts that stay in a trimmed report: everything not explicitly out of scope."""
    return filter_alerts(alerts, scope="sample")


def trim_counts(alerts: DataFrame, events: DataFrame) -> DataFrame:
    """What the trimmed report says about the rest."""
    a = alerts.groupBy("run_id").agg(
        F.count_if(~two_valued(~F.col("in_scope"))).alias("alerts_kept"), F.count_if(two_valued(~F.col("in_scope"))).alias("environment_alerts_total"))
    e = events.groupBy("run_id").agg(F.count("*").alias("events_total"))
    return e.join(a, "run_id", "full")


def list_runs(runs: DataFrame, limit: int, since=None, text: str | None = None, status: str | None = None, level: str | None = None) -> DataFrame:
    """Newest first (missing times last), filtered by age, text, status and verdict."""
    out = runs
    if since is not None:
        out = out.filter(F.col("ts") >= F.lit(since))
    if status:
        out = out.filter(F.col("status") == status)
    if level:
        out = out.filter(F.coalesce("verdict_level", F.lit("")) == level)
    if text:
        hay = F.lower(F.concat_ws(" ", "filename", "sha256_short", "run_id"))
        out = out.filter(hay.contains(text.lower()))
    return out.orderBy(F.desc_nulls_last("ts"), "run_id").limit(limit)
