"""Row shapes shared by all operators.

``data`` holds provider fields as strings.  A table may promote hot fields to
real columns of the same name (``ProcessId``, ``Image`` ...): :func:`fld` prefers
such a column, so Parquet column pruning reaches the scan.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EVENT = (
    "run_id string, seq bigint, source string, provider_name string, event_id int, "
    "ts timestamp, computer string, event_type string, data map<string,string>"
)
TECH = "struct<technique_id:string,technique_name:string,tactic:string>"
ALERT = (
    EVENT + ", family string, rule_id string, title string, level string, "
    f"primary_tech {TECH}, candidates array<{TECH}>, priority string, "
    "priority_reason string, severity string, in_scope boolean, scope_reason string"
)
PACKET = (
    "run_id string, idx bigint, ts timestamp, protocol string, src string, sport int, "
    "dst string, dport int, length int, summary string, dns_qname string, "
    "http_host string, http_path string, http_method string"
)
LABEL = "match_kind string, match_value string, label string, family string"


def fld(df: DataFrame, name: str) -> Column:
    """Column of an event field: ``EventID``, a promoted column, ``data[name]`` or NULL."""
    if name == "EventID":
        return F.col("event_id").cast("string")
    if name in df.columns:
        return F.col(f"`{name}`")
    if "data" in df.columns:
        return F.col("data")[name]
    return F.lit(None).cast("string")


def opt(df: DataFrame, name: str, dtype: str = "string") -> Column:
    """An optional envelope column, NULL when the table does not carry it."""
    return F.col(f"`{name}`") if name in df.columns else F.lit(None).cast(dtype)
