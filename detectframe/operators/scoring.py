"""Alert classification and run verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from detectframe import fixed
from detectframe.functions.leaf import two_valued

from detectframe.schema import fld, opt


def _text(c: Column, default: Column | str) -> Column:
    """Value or default; an empty text counts as missing."""
    d = F.lit(default) if isinstance(default, str) else default
    return F.coalesce(F.nullif(c.cast("string"), F.lit("")), d)


def weight_of(severity: Column, weights: dict = fixed.SEVERITY_WEIGHTS) -> Column:
    m = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
    return F.coalesce(m[severity], F.lit(weights["informational"]))


def classify_alert(alerts: DataFrame, weights: dict = fixed.SEVERITY_WEIGHTS) -> DataFrame:
    """adds family, severity, weight, group_key and label; unscored alerts get NULLs.

    Ten ordered cases in one CASE; the first that applies decides.
    """
    d = lambda name: fld(alerts, name)
    etype = F.col("event_type")
    lower = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))

    def row(family, severity, group_key, label, weight=None) -> Column:
        sev = F.lit(severity) if isinstance(severity, str) else severity
        w = weight_of(sev, weights) if weight is None else F.lit(weight)
        lab = F.lit(label) if isinstance(label, str) else label
        key = F.lit(group_key) if isinstance(group_key, str) else group_key
        return F.struct(
            F.lit(family).alias("family"), sev.alias("severity"), w.cast("int").alias("weight"),
            key.alias("group_key"), lab.alias("label"),
        )

    pattern = _text(d("Rule"), "unknown rule")
    burst = F.coalesce(d("BurstKind"), F.lit(""))
    burst_sev = F.when(burst.isin("port_scan", "dns_tunnel_suspect"), "high").otherwise("medium")
    threat = _text(d("Threat Name"), "unknown threat")
    av_map = F.create_map(*[F.lit(x) for kv in fixed.AV_SEVERITY.items() for x in kv])
    av_sev = F.coalesce(av_map[lower(d("Severity Name"))], F.lit("high"))
    rule_id, title = opt(alerts, "rule_id"), opt(alerts, "title")
    level = F.lower(F.coalesce(opt(alerts, "level"), F.lit("")))
    sig_sev = lower(_text(d("SeverityStr"), "low"))
    sig_sev = F.when(sig_sev.isin(list(weights)), sig_sev).otherwise("low")
    call_map = F.create_map(*[F.lit(x) for kv in fixed.SIGNATURE_SEVERITY.items() for x in kv])
    call_sev = call_map[etype]
    cap = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    scored_sig = F.coalesce(F.col("cape_score") if "cape_score" in alerts.columns else F.lit(True), F.lit(True))

    result = (
        F.when(two_valued(F.col("event_id") == 25),
               row("heuristic", "critical", "event_id:25", "Process tampering (hollowing/injection)", fixed.TAMPERING_WEIGHT))
        .when(etype.isin("DmpYaraMatch", "DroppedFileYaraMatch"),
              row("yara", "high", F.concat(F.lit("yara:"), pattern), F.concat(F.lit("YARA match: "), pattern), fixed.CONTENT_MATCH_WEIGHT))
        .when(etype == "DroppedFileCapaHit",
              row("heuristic", "medium",
                  F.concat_ws(":", F.lit("capa-dropped"), _text(d("Origin"), "created"), cap(d("DroppedFilename")), _text(d("Capability"), "unknown")),
                  _text(d("Type"), etype)))
        .when(etype == "NetworkBurstDetected",
              row("heuristic", burst_sev, F.concat_ws(":", F.lit("netburst"), burst, cap(d("ProcessId"))), _text(d("Type"), etype)))
        .when(etype == "DefenderThreatDetected",
              row("heuristic", av_sev, F.concat(F.lit("defender:"), threat), F.concat(F.lit("Microsoft Defender detected "), threat)))
        .when(rule_id.isNotNull() | title.isNotNull(),
              row("sigma", _text(level, "informational"), F.concat(F.lit("sigma:"), _text(rule_id, title)),
                  F.concat(F.lit("Sigma: "), F.coalesce(title, F.lit("None")))))
        .when(two_valued(opt(alerts, "priority") == "high"),
              row("heuristic", "high", F.concat(F.lit("heuristic-high:"), etype),
                  _text(opt(alerts, "priority_reason"), F.concat(etype, F.lit(" (high priority)"))), fixed.HIGH_PRIORITY_WEIGHT))
        .when((etype == "CapeSignature") & ~scored_sig, None)
        .when(etype == "CapeSignature",
              row("cape", sig_sev, F.concat(F.lit("cape:"), _text(d("Name"), "unknown")),
                  F.concat(F.lit("CAPE: "), _text(d("Description"), _text(d("Name"), "unknown")))))
        .when(call_sev.isNotNull(),
              row("behavioral", call_sev,
                  F.concat_ws(":", F.lit("apitrace"), etype, F.coalesce(d("ProcessId").cast("string"), F.lit("None")), _nonzero(d("TargetProcessId"))),
                  _text(d("Type"), etype)))
        .when(two_valued(etype != "") & ~etype.isin(fixed.UNSCORED_TYPES),
              row("heuristic", "low", F.concat(F.lit("heuristic:"), etype), etype, fixed.BASELINE_WEIGHT))
    )
    # generated, not projected: a later filter on a result must not copy the CASE below the scan
    kept = [c for c in alerts.columns if c not in ("family", "severity", "weight", "group_key", "label")]
    return alerts.select(*[F.col(f"`{c}`") for c in kept], F.explode_outer(F.array(result)).alias("__c")).select(
        *[F.col(f"`{c}`") for c in kept], "__c.family", "__c.severity", "__c.weight", "__c.group_key", "__c.label"
    )


def _nonzero(c: Column) -> Column:
    s = F.coalesce(c.cast("string"), F.lit(""))
    return F.when(s == "0", "").otherwise(s)


def static_signals(facts: DataFrame) -> DataFrame:
    """one row per static signal of a run, in reporting order.

    ``facts(run_id, packed, signature_status, signed, pattern_names,
    capability_names, obfuscator_markers)``; name arrays hold one file's hits.
    """
    w = fixed.STATIC_WEIGHTS
    top3 = lambda a: F.array_join(F.slice(a, 1, 3), ", ")
    has = lambda a: two_valued(F.size(a) > 0)
    item = lambda cond, ord_, name, label: F.when(cond, F.struct(
        F.lit(ord_).alias("ord"), F.lit(w[name]).alias("weight"), label.alias("label")))
    checked = F.coalesce("signature_status", F.lit(""))
    rows = F.filter(F.array(
        item(two_valued(F.col("packed")), 0, "packed", F.lit("Sample appears packed/encrypted")),
        item(~checked.isin("", "UnknownError") & ~two_valued(F.col("signed")), 1, "unsigned", F.lit("Sample binary is unsigned")),
        item(has(F.col("pattern_names")), 2, "pattern", F.concat(F.lit("Static YARA match on sample: "), top3(F.col("pattern_names")))),
        item(has(F.col("capability_names")), 3, "capability", F.concat(F.lit("capa high-signal capability: "), top3(F.col("capability_names")))),
        item(F.col("obfuscator_markers").isNotNull(), 4, "obfuscator", F.concat(F.lit(".NET obfuscator/packer markers: "), top3(F.col("obfuscator_markers")))),
    ), lambda x: x.isNotNull())
    return facts.select("run_id", F.explode(rows).alias("s")).select("run_id", "s.ord", "s.weight", "s.label")


def level_of(score: Column, thresholds=tuple(fixed.LEVEL_THRESHOLDS)) -> Column:
    out = None
    for floor, level in thresholds:
        out = F.when(score >= floor, level) if out is None else out.when(score >= floor, level)
    return out.otherwise(thresholds[-1][1])


def findings(classified: DataFrame) -> DataFrame:
    """Best instance of every distinct in-scope finding: (run, group_key) -> weight, label, first_seq.

    Repeats of one finding count once, so volume cannot raise a score; the
    aggregation is partial on the map side, so a noisy rule costs no shuffle.
    """
    rows = classified.filter(two_valued(F.col("in_scope")) & F.col("group_key").isNotNull())
    return rows.groupBy("run_id", "group_key").agg(
        F.max_by(F.struct("weight", "label"), F.struct(F.col("weight"), -F.col("seq"))).alias("b"), F.min("seq").alias("first_seq")
    ).select("run_id", "group_key", "b.weight", "b.label", "first_seq")


def verdict(
    runs: DataFrame, classified: DataFrame, static: DataFrame | None = None, cap=fixed.ALERT_SCORE_CAP,
    thresholds=tuple(fixed.LEVEL_THRESHOLDS),
) -> DataFrame:
    """F8: score and level of every run: alerts capped, plus static signals, capped again."""
    a = findings(classified).groupBy("run_id").agg(F.least(F.sum("weight"), F.lit(cap)).alias("alert_score"), F.count("*").alias("n_findings"))
    x = runs.select("run_id").distinct().join(a, "run_id", "left")
    if static is not None:
        x = x.join(static.groupBy("run_id").agg(F.sum("weight").alias("static_score")), "run_id", "left")
    else:
        x = x.withColumn("static_score", F.lit(0))
    zero = lambda c: F.coalesce(c, F.lit(0))
    score = F.least(zero("alert_score") + zero("static_score"), F.lit(fixed.MAX_SCORE)).cast("int")
    return x.select("run_id", score.alias("score"), level_of(score, thresholds).alias("level"),
                    zero("n_findings").alias("n_findings"))


def top_reasons(classified: DataFrame, static: DataFrame | None = None, k: int = fixed.TOP_REASONS) -> DataFrame:
    """The k heaviest reasons per run; ties by first appearance, alerts before static."""
    r = findings(classified).select("run_id", "weight", "label", F.lit(0).alias("part"), F.col("first_seq").alias("ord"))
    if static is not None:
        r = r.unionByName(static.select("run_id", "weight", "label", F.lit(1).alias("part"), F.col("ord").cast("bigint").alias("ord")))
    w = Window.partitionBy("run_id").orderBy(F.desc("weight"), "part", "ord", "label")
    return r.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("run_id", "rank", "weight", "label")


def alert_severity(classified: DataFrame) -> Column:
    """Severity shown on an alert: its signature's, else the classification's."""
    call_map = F.create_map(*[F.lit(x) for kv in fixed.SIGNATURE_SEVERITY.items() for x in kv])
    return F.coalesce(call_map[F.col("event_type")], F.col("severity"))


