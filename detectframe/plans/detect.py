"""The whole detection over many runs; alerts are written once when found and once when classified.

The order of the steps matters: alerts are annotated before scoping, launcher
artifacts are removed, everything after that only re-labels.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from detectframe import fixed
from detectframe.functions.scalar import micros
from detectframe.operators import joins as J
from detectframe.operators import lineage as L
from detectframe.operators import quality as Q
from detectframe.operators import rules as R
from detectframe.operators import scoring as S
from detectframe.operators import sequence as G
from detectframe.operators import triage as T
from detectframe.operators import windows as W
from detectframe.scale import cut
from detectframe.schema import fld, opt

#: Provider fields an alert keeps, besides the envelope.
FIELDS = [
    "ProcessId", "ProcessGuid", "SourceProcessId", "SourceProcessGuid", "TargetProcessId", "Image", "SourceImage", "ImageLoaded",
    "TargetObject", "Details", "PipeName", "QueryName", "DestinationHostname", "StartAddress", "User", "Query", "Type", "BurstKind", "Threat Name", "Severity Name",
    "Signed", "SignatureStatus",
]
_ENVELOPE = ["run_id", "seq", "ts", "source", "event_id", "event_type"]


@dataclass
class Detection:
    alerts: DataFrame
    verdicts: DataFrame
    reasons: DataFrame


def with_fields(events: DataFrame) -> DataFrame:
    """Events with the fields alerts keep as columns of their own (taken from ``data`` once)."""
    missing = [f for f in FIELDS if f not in events.columns]
    return events.select("*", *[fld(events, f).cast("string").alias(f) for f in missing])


def alert_rows(events: DataFrame, runs: DataFrame, ruleset: R.RuleSet, both_apis: list[str]) -> DataFrame:
    """Alerts of every producer, before priority and scope."""
    events = with_fields(events)
    out = T.select_alert_events(events).select(*_ENVELOPE, *FIELDS, "in_scope")

    late = F.lit(1 << 60)  # synthesized alerts come after the events
    text = lambda c: c.cast("string")
    bursts = W.process_burst(events).select(
        "run_id", late.alias("seq"), F.col("end").alias("ts"), F.lit("heuristic").alias("source"), F.lit(9101).alias("event_id"), F.lit("ProcessBurstDetected").alias("event_type"),
        F.col("ppid").alias("ProcessId"), F.concat(text(F.col("n")), F.lit(" short-lived child processes")).alias("Type"))
    net = W.network_burst(events).select("run_id", "pid", "kind", "count", "end").unionByName(W.dns_burst(events).select("run_id", "pid", "kind", "count", "end"))
    net = net.select(
        "run_id", late.alias("seq"), F.col("end").alias("ts"), F.lit("heuristic").alias("source"), F.lit(9105).alias("event_id"), F.lit("NetworkBurstDetected").alias("event_type"),
        text(F.col("pid")).alias("ProcessId"), F.col("kind").alias("BurstKind"), F.concat_ws(": ", "kind", text(F.col("count"))).alias("Type"))
    av = T.av_detections(events, T.sample_starts(events, runs)).select(
        "run_id", "seq", "ts", F.lit("windefend").alias("source"), F.lit(1116).alias("event_id"), F.lit("DefenderThreatDetected").alias("event_type"),
        F.col("threat").alias("Threat Name"), F.col("severity_name").alias("Severity Name"), "in_scope")
    sig = G.as_alerts(G.all_signatures(events)).select(
        "run_id", F.col("first_seq").alias("seq"), "ts", F.lit("apitrace").alias("source"), "event_id", "event_type",
        text(F.col("actor")).alias("ProcessId"), text(F.col("named_pid")).alias("TargetProcessId"), F.col("detail").alias("Type"),
        F.col("apis").alias("EvidenceApis"), F.col("samples").alias("Evidence"))
    blind = J.counterpart_misses(events).select(
        "run_id", F.col("first_seq").alias("seq"), F.col("first_ts").alias("ts"), F.lit("apitrace").alias("source"), F.lit(9215).alias("event_id"), F.lit("ApitraceBlindSpot").alias("event_type"),
        text(F.col("pid")).alias("ProcessId"), F.concat(F.lit("hook "), "hook", F.lit(" blind: "), text(F.col("misses"))).alias("Type"))
    silent = G.trace_silence(events, both_apis).select(
        "run_id", late.alias("seq"), F.col("last_event").alias("ts"), F.lit("apitrace").alias("source"), F.lit(9216).alias("event_id"), F.lit("ApitraceSilence").alias("event_type"),
        text(F.col("pid")).alias("ProcessId"))
    driver = G.driver_alerts(events).select("run_id", "seq", "ts", F.lit("guardian").alias("source"), "event_id", "event_type", "ProcessId", "TargetProcessId", F.col("detail").alias("Type"))
    rules = R.rule_table(events.sparkSession, ruleset)
    hits = R.apply_rules(events, ruleset, keep=[*_ENVELOPE, *FIELDS])
    for part in (bursts, net, av, sig, blind, silent, driver):
        out = out.unionByName(part, allowMissingColumns=True)
    ruled = R.build_alert(hits, rules).select(*_ENVELOPE, *FIELDS, "rule_id", "title", "level", "rule_techniques", "event_source")
    corr = R.correlation_alerts(events, ruleset)
    if corr is not None:
        c = corr.join(rules.select("rule_id", "title", "level", "tags"), "rule_id").withColumn("seq", late).withColumn("source", F.lit("sigma"))
        c = c.withColumn("rule_techniques", R.techniques_from_tags(F.col("tags"))).withColumn("event_id", F.lit(None).cast("int"))
        keep = [x for x in [*_ENVELOPE, *FIELDS, "rule_id", "title", "level", "rule_techniques"] if x in c.columns]
        ruled = ruled.unionByName(c.select(*keep), allowMissingColumns=True)
    return out.unionByName(ruled, allowMissingColumns=True)


def detect(
    events: DataFrame, runs: DataFrame, ruleset: R.RuleSet, static: DataFrame | None = None, extra: DataFrame | None = None,
    both_apis: list[str] | None = None,
) -> Detection:
    """Alerts, verdicts and reasons of all runs.

    ``runs(run_id, root_pid, root_image[, staged_path])``; ``static`` are F9 rows;
    ``extra`` are alert rows of other producers (content matches, capabilities,
    call signatures).  ``events`` is read by every producer: cache it, or better
    have it partitioned by event type.
    """
    apis = both_apis or sorted({a for v in fixed.EVENT_CALLS.values() for a in v})
    alerts = alert_rows(events, runs, ruleset, apis)
    if extra is not None:
        alerts = alerts.unionByName(extra, allowMissingColumns=True)
    # written once: the producers run a single time, and no later step plans them again
    alerts = cut(alerts, "alerts")
    alerts = J.enrich_techniques(alerts, J.technique_map(events.sparkSession), opt(alerts, "rule_techniques", "array<string>"))
    alerts = T.annotate_priority(alerts)
    alerts = T.suppress_launcher_artifacts(alerts, runs)
    guids, pids = L.lineage(events, runs)
    alerts = L.scope(alerts, guids, pids)
    alerts = T.rescope(alerts, events, runs)
    alerts = S.classify_alert(alerts)
    alerts = cut(alerts.withColumn("severity", S.alert_severity(alerts)), "classified")
    return Detection(alerts, S.verdict(runs, alerts, static), S.top_reasons(alerts, static))


def evaluate(detection: Detection, runs: DataFrame, labels: DataFrame) -> dict[str, DataFrame]:
    """Quality of a labeled corpus: labels resolved, older runs of a sample dropped, metrics."""
    resolved = J.resolve_labels(runs, labels).filter(F.col("label").isNotNull())
    kept = W.latest_per_key(resolved, "sha256", "ts", "run_id", F.col("label_by") == "report").filter("kept")
    scored = Q.scored_runs(kept, detection.verdicts)
    return {
        "scored": scored, "confusion": Q.confusion(scored), "rates": Q.rates_with_intervals(scored), "families": Q.family_detection(scored),
        "boundary": Q.boundary_violations(scored), "drivers": Q.fp_drivers(scored, detection.reasons.select(F.col("run_id").alias("id"), F.col("label").alias("reason"))),
    }


def span_seconds(events: DataFrame) -> DataFrame:
    """Length of every run."""
    return events.groupBy("run_id").agg(((F.max(micros(F.col("ts"))) - F.min(micros(F.col("ts")))) / 1e6).alias("seconds"))
