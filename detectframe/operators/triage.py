"""Alert selection, priority and suppression: projections and small semi-joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from detectframe import fixed
from detectframe.functions.leaf import matches_unusual_load, two_valued
from detectframe.functions.scalar import as_int, basename, entropy_label, hex_to_int
from detectframe.scale import all_true, any_true, first_match
from detectframe.schema import fld, opt


def select_alert_events(events: DataFrame) -> DataFrame:
    """Events that are alerts by type, plus unusual module loads; some are in scope by nature."""
    t = F.col("event_type")
    load = t.isin(fixed.LOAD_TYPES) & matches_unusual_load(
        fld(events, "Signed"), fld(events, "SignatureStatus"), fld(events, "ImageLoaded")
    )
    forced = F.when(t.isin(fixed.FORCED_SCOPE_TYPES), F.lit(True))
    return events.filter(t.isin(fixed.ALWAYS_ALERT) | load).withColumn("in_scope", forced)


def registry_priority(target: Column) -> Column:
    """Reason of the first rule whose substrings are all in the path."""
    low = F.lower(target)
    return first_match([(all_true([low.contains(s) for s in subs]), F.lit(why)) for subs, why in fixed.REGISTRY_PRIORITY])


def pipe_priority(name: Column) -> Column:
    """D3: reason of the first matching pipe name rule, substrings before regexes."""
    low = F.lower(name)
    return first_match(
        [(low.contains(s), F.lit(why)) for s, why in fixed.PIPE_PRIORITY]
        + [(low.rlike("(?d)" + p), F.lit(why)) for p, why in fixed.PIPE_PRIORITY_REGEX]
    )


def clean_domain(name: Column) -> Column:
    return F.lower(F.regexp_replace(F.coalesce(name, F.lit("")), r"^\.+|\.+$", ""))


def os_noise_domain(name: Column) -> Column:
    """Name equals, or ends on a dot boundary with, a known vendor suffix."""
    dotted = F.concat(F.lit("."), name)
    return two_valued(any_true([dotted.endswith("." + s) for s in fixed.OS_NOISE_SUFFIXES]))


def domain_label(name: Column) -> Column:
    """Label before the last dot of a cleaned name; NULL without a dot."""
    parts = F.split(name, r"\.")
    return F.when(F.size(parts) >= 2, F.get(parts, F.size(parts) - 2))


def dga_suspect(domain: Column) -> Column:
    """The registrable label looks generated: long, high entropy, vowel-poor, consonant run."""
    name = clean_domain(domain)
    sld = domain_label(name)
    vowels = F.char_length(sld) - F.char_length(F.translate(sld, "aeiou", ""))
    return two_valued(
        sld.isNotNull()
        & ~name.endswith(".in-addr.arpa") & ~name.endswith(".ip6.arpa") & ~os_noise_domain(name)
        & (F.char_length(sld) >= fixed.DGA_MIN_LABEL) & sld.rlike(r"^\p{ASCII}*\z")
        & sld.rlike("[bcdfghjklmnpqrstvwxz]{%d,}" % fixed.DGA_MIN_RUN)
        & (vowels / F.char_length(sld) <= fixed.DGA_MAX_VOWELS)
        & (entropy_label(sld) >= fixed.DGA_MIN_ENTROPY)
    )


def dga_reason(domain: Column) -> Column:
    sld = domain_label(clean_domain(domain))
    return F.format_string(
        "DGA-suspect domain (label '%s': len=%d, entropy=%.2f, vowel-poor) (T1568.002)",
        F.substring(sld, 1, 24), F.char_length(sld), entropy_label(sld),
    )


def annotate_priority(alerts: DataFrame) -> DataFrame:
    """high/low priority with a reason; drops nothing and never lowers a high."""
    t = F.col("event_type")
    old, old_why = opt(alerts, "priority"), opt(alerts, "priority_reason")
    high = F.when(t.isin(fixed.REGISTRY_TYPES), registry_priority(fld(alerts, "TargetObject"))).when(
        t.isin(fixed.PIPE_TYPES), pipe_priority(F.nullif(fld(alerts, "PipeName"), F.lit("")))
    )
    host = F.when(t == "DnsQuery", fld(alerts, "QueryName")).when(t == "NetworkConnect", fld(alerts, "DestinationHostname"))
    name = clean_domain(host)
    net = F.when(name == "", None).when(dga_suspect(name), F.lit("high")).when(
        os_noise_domain(name), F.when(two_valued(old == "high"), None).otherwise("low")
    )
    net_why = F.when(dga_suspect(name), dga_reason(name)).otherwise(F.lit(fixed.OS_NOISE_REASON))
    x = alerts.withColumn("__h", high).withColumn("__n", net)
    return x.withColumn(
        "priority", F.when(F.col("__h").isNotNull(), "high").otherwise(F.coalesce("__n", old))
    ).withColumn(
        "priority_reason",
        F.coalesce("__h", F.when(F.col("__n").isNotNull(), net_why), old_why),
    ).drop("__h", "__n")


def sample_starts(events: DataFrame, runs: DataFrame) -> DataFrame:
    """Earliest creation of each run's root process (image must be the launcher when known)."""
    c = events.filter((F.col("event_type") == "ProcessCreate") & F.col("ts").isNotNull()).select(
        "run_id", as_int(fld(events, "ProcessId")).alias("pid"), basename(fld(events, "Image")).alias("image"), "ts"
    )
    r = runs.select("run_id", F.col("root_pid").cast("bigint").alias("pid"), basename(F.col("root_image")).alias("want"))
    return c.join(r, ["run_id", "pid"]).filter((F.col("want") == "") | (F.col("image") == F.col("want"))).groupBy("run_id").agg(
        F.min("ts").alias("sample_start")
    )


def av_detections(events: DataFrame, starts: DataFrame) -> DataFrame:
    """One alert per (run, threat, path); our own probe's test threat is dropped
    unless it was seen with a foreign path at or after the sample started."""
    rows = events.filter(F.col("event_type") == "DefenderThreatDetected").select(
        "run_id", "seq", "ts", fld(events, "Threat Name").alias("threat"), fld(events, "Path").alias("path"),
        fld(events, "Severity Name").alias("severity_name"), fld(events, "Detection Time").alias("detected"),
    )
    low = F.lower(F.coalesce("path", F.lit("")))
    when = F.coalesce(F.col("detected").try_cast("timestamp"), F.col("ts").cast("timestamp"))
    probe = two_valued(F.lower("threat").contains("mptest"))
    x = rows.join(starts, "run_id", "left").filter(
        ~probe | ((low != "") & ~low.contains("sandboxagent") & two_valued(when >= F.col("sample_start").cast("timestamp")))
    )
    return x.groupBy("run_id", "threat", "path").agg(
        F.min_by(F.struct("seq", "ts", "severity_name"), "seq").alias("f")
    ).select("run_id", "threat", "path", "f.seq", "f.ts", "f.severity_name", F.lit(True).alias("in_scope"))


def explode_content_matches(files: DataFrame, kind: str) -> DataFrame:
    """One alert per pattern match in a dump or dropped file; error entries are skipped.

    ``files(run_id, filename, matches array<struct<rule,error>>)``.
    """
    x = files.select("run_id", "filename", F.explode("matches").alias("m")).filter(F.col("m.error").isNull())
    if kind == "dump":
        x = x.filter(~two_valued(F.col("m.rule").isin(fixed.DUMP_RULE_EXCLUSIONS)))
    etype, eid = ("DmpYaraMatch", 9103) if kind == "dump" else ("DroppedFileYaraMatch", 9104)
    where = "memory dump" if kind == "dump" else "dropped file"
    return x.select(
        "run_id", F.lit(eid).alias("event_id"), F.lit(etype).alias("event_type"), F.lit(True).alias("in_scope"),
        F.col("m.rule").alias("Rule"), "filename",
        F.concat(F.lit("YARA rule '"), F.col("m.rule"), F.lit(f"' matched in {where} "), F.col("filename")).alias("Type"),
    )


def explode_capabilities(files: DataFrame) -> DataFrame:
    """One alert per high-signal capability; ``files(run_id, filename, origin, available, capabilities)``."""
    x = files.filter(two_valued(F.col("available"))).select("run_id", "filename", "origin", F.explode("capabilities").alias("c"))
    name = F.coalesce(F.nullif(F.col("c.name"), F.lit("")), F.lit("unknown"))
    return x.filter(two_valued(F.col("c.high_signal"))).select(
        "run_id", F.lit(9106).alias("event_id"), F.lit("DroppedFileCapaHit").alias("event_type"), F.lit(True).alias("in_scope"),
        name.alias("Capability"), F.col("filename").alias("DroppedFilename"),
        F.coalesce(F.nullif("origin", F.lit("")), F.lit("created")).alias("Origin"),
        F.concat(F.lit("capa high-signal capability '"), name, F.lit("' in dropped file "), F.col("filename")).alias("Type"),
    )


def suppress_launcher_artifacts(alerts: DataFrame, runs: DataFrame) -> DataFrame:
    """Drop rule alerts on the root's own creation when an interpreter launched the sample."""
    launcher = F.lower(F.coalesce("root_image", F.lit("")))
    r = runs.select(
        "run_id", F.col("root_pid").cast("bigint").alias("__root"), any_true([launcher.endswith(x) for x in fixed.LAUNCH_INTERPRETERS]).alias("__interp")
    )
    create = two_valued(F.col("event_id") == 1) | two_valued(F.lower("event_type").isin("processcreate", "process_creation"))
    drop = two_valued(F.col("__interp")) & opt(alerts, "rule_id").isNotNull() & create & two_valued(as_int(fld(alerts, "ProcessId")) == F.col("__root"))
    return alerts.join(r, "run_id", "left").filter(~drop).drop("__root", "__interp")


def trace_addresses(events: DataFrame) -> DataFrame:
    """(run, address) logged by the monitor's own marker event."""
    found = F.regexp_extract_all(F.coalesce(fld(events, "Text"), F.lit("")), F.lit(fixed.TRACE_MARKER), F.lit(1))
    return events.filter(F.col("event_type") == "GuardianRegistered").select("run_id", F.explode(found).alias("h")).select(
        "run_id", hex_to_int(F.col("h")).alias("addr")
    ).filter(F.col("addr") != 0).distinct()


def _marked(alerts: DataFrame, keys: DataFrame, cols: list[str], flag: str) -> DataFrame:
    return alerts.join(keys.distinct().withColumn(flag, F.lit(True)), cols, "left").withColumn(flag, two_valued(F.col(flag)))


def tooling_remote_threads(alerts: DataFrame, events: DataFrame) -> DataFrame:
    """Adds ``tooling_thread``: a remote thread that starts at a logged monitor address."""
    start = F.when(F.col("event_type") == "CreateRemoteThread", hex_to_int(F.coalesce(fld(alerts, "StartAddress"), F.lit("0"))))
    return _marked(alerts.withColumn("addr", start), trace_addresses(events), ["run_id", "addr"], "tooling_thread").drop("addr")


def tooling_pairs(alerts: DataFrame, events: DataFrame) -> DataFrame:
    """(run, source, target) pairs of monitor threads; their sibling process opens are tooling too."""
    x = tooling_remote_threads(alerts, events).filter("tooling_thread")
    return x.select("run_id", as_int(fld(alerts, "SourceProcessId")).alias("src"), as_int(fld(alerts, "TargetProcessId")).alias("tgt")).filter(
        F.col("src").isNotNull() & F.col("tgt").isNotNull()
    ).distinct()


def placed_pairs(events: DataFrame) -> DataFrame:
    """(run, trace root, target) where the sandbox placed its monitor."""
    pid = as_int(fld(events, "ProcessId"))
    root = events.filter((F.col("source") == "apitrace") & (fld(events, "Api") == fixed.META_ATTACHED) & pid.isNotNull()).groupBy("run_id").agg(
        F.min_by(pid, "seq").alias("src")
    )
    placed = events.filter(F.col("event_type") == "GuardianInjectionPlaced").select(
        "run_id", as_int(fld(events, "TargetProcessId")).alias("tgt")
    ).filter(F.col("tgt").isNotNull()).distinct()
    return placed.join(root, "run_id").select("run_id", "src", "tgt")


def tooling_pids(events: DataFrame) -> DataFrame:
    """(run, pid) of processes whose image is in the monitor's folder."""
    return events.filter(
        (F.col("event_type") == "ProcessCreate") & two_valued(F.lower(fld(events, "Image")).contains(fixed.TOOLING_DIR))
    ).select("run_id", as_int(fld(events, "ProcessId")).alias("pid")).filter(F.col("pid").isNotNull()).distinct()


def rescope(alerts: DataFrame, events: DataFrame, runs: DataFrame) -> DataFrame:
    """In-scope alerts caused by tooling or the OS become out of scope, with a reason.

    Nothing is dropped.  The steps run in the reference order: monitor threads,
    OS noise, monitor injections; the first reason wins because later steps only
    look at alerts still in scope.
    """
    t = F.col("event_type")
    d = lambda n: fld(alerts, n)
    low = lambda c: F.lower(F.coalesce(c.cast("string"), F.lit("")))
    src, tgt, pid = as_int(d("SourceProcessId")), as_int(d("TargetProcessId")), as_int(d("ProcessId"))
    x = tooling_remote_threads(alerts, events).withColumn("__src", src).withColumn("__tgt", tgt).withColumn("__pid", pid)
    x = x.join(tooling_pairs(alerts, events).select("run_id", F.col("src").alias("__src"), F.col("tgt").alias("__tgt"), F.lit(True).alias("__pair")),
               ["run_id", "__src", "__tgt"], "left")
    x = x.join(tooling_pids(events).select("run_id", F.col("pid").alias("__pid"), F.lit(True).alias("__tool")), ["run_id", "__pid"], "left")
    x = x.join(placed_pairs(events).select("run_id", F.col("src").alias("__pid"), F.col("tgt").alias("__tgt"), F.lit(True).alias("__placed")),
               ["run_id", "__pid", "__tgt"], "left")
    staged = opt(runs, "staged_path")
    x = x.join(runs.select("run_id", F.lower(F.coalesce(staged, F.lit(""))).alias("__staged")), "run_id", "left")

    no_guid = (low(d("ProcessGuid")) == "") & (low(d("SourceProcessGuid")) == "")
    image = basename(F.coalesce(*[F.nullif(d(n), F.lit("")) for n in ("SourceImage", "Image", "ProcessName")]))
    origin = F.col("event_source") if "event_source" in alerts.columns else opt(alerts, "source")
    reason = first_match([
        (F.col("tooling_thread"), F.lit(fixed.SCOPE_REASONS["monitor_thread"])),
        ((t == "ImageLoad") & low(d("ImageLoaded")).contains(fixed.TOOLING_DIR), F.lit(fixed.SCOPE_REASONS["monitor_dll"])),
        ((t == "PipeConnected") & low(d("PipeName")).isin(fixed.TOOLING_PIPES), F.lit(fixed.SCOPE_REASONS["monitor_pipe"])),
        (no_guid & image.isin(fixed.OS_NOISE_IMAGES), F.concat(F.lit("os-noise: "), image, F.lit(" adopted via recycled pid"))),
        (no_guid & two_valued(origin == "wmi_etw") & F.upper(F.coalesce(d("User"), F.lit(""))).startswith("NT AUTHORITY\\")
         & two_valued(d("Query").rlike(fixed.HEALTH_PROBE)), F.lit(fixed.SCOPE_REASONS["health_probe"])),
        (low(d("SourceImage")).contains(fixed.TOOLING_DIR), F.lit(fixed.SCOPE_REASONS["loader_action"])),
        (two_valued(origin == "apitrace") & two_valued(F.col("__tool")), F.lit(fixed.SCOPE_REASONS["loader_injection"])),
        (two_valued(origin == "apitrace") & two_valued(F.col("__placed")), F.lit(fixed.SCOPE_REASONS["loader_marked"])),
        ((t == "ProcessAccess") & two_valued(F.col("__pair")), F.lit(fixed.SCOPE_REASONS["process_open"])),
        (two_valued(opt(alerts, "rule_id").isin(fixed.STAGING_RULE_IDS)) & two_valued(F.col("__staged") != "") & (low(d("Image")) == F.col("__staged")),
         F.lit(fixed.SCOPE_REASONS["staging"])),
    ])
    in_scope = two_valued(F.col("in_scope"))
    x = x.withColumn("__why", F.when(in_scope, reason))
    return x.withColumn("in_scope", in_scope & F.col("__why").isNull()).withColumn(
        "scope_reason", F.coalesce("__why", opt(alerts, "scope_reason"))
    ).drop("__why", "__src", "__tgt", "__pid", "__pair", "__tool", "__placed", "__staged", "tooling_thread")


def severity_rank(severity: Column) -> Column:
    """0 critical, 1 high, 2 medium, 3 anything else."""
    return F.when(severity == "critical", 0).when(severity == "high", 1).when(severity == "medium", 2).otherwise(3)


def forensic_groups(alerts: DataFrame) -> DataFrame:
    """Per (run, event type) the worst severity rank and count, ordered worst first."""
    return alerts.groupBy("run_id", F.coalesce("event_type", F.lit("(unknown)")).alias("event_type")).agg(
        F.min(severity_rank(F.col("severity"))).alias("worst"), F.count("*").alias("n_alerts")
    )


def forensic_preview(alerts: DataFrame, k: int = 10) -> DataFrame:
    """First k alerts of every (run, event type)."""
    w = Window.partitionBy("run_id", "event_type").orderBy("seq")
    return alerts.withColumn("event_type", F.coalesce("event_type", F.lit("(unknown)"))).withColumn(
        "pos", F.row_number().over(w)
    ).filter(F.col("pos") <= k)
