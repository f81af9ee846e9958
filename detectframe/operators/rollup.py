"""Counts, summaries and set comparisons.

Plain aggregations with partial counts before the shuffle; lists that could grow
without bound are rows, not arrays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from detectframe import fixed
from detectframe.functions.leaf import two_valued
from detectframe.functions.scalar import as_int, technique_parent
from detectframe.operators.lineage import in_lineage
from detectframe.schema import fld


def event_histogram(events: DataFrame) -> DataFrame:
    """F1."""
    return events.groupBy("run_id", F.coalesce("event_type", F.lit("unknown")).alias("event_type")).agg(F.count("*").alias("n"))


def source_list(events: DataFrame) -> DataFrame:
    """distinct sources of each run."""
    return events.filter(two_valued(F.col("source") != "")).select("run_id", "source").distinct()


def type_group_counts(events: DataFrame, groups: dict[str, str]) -> DataFrame:
    """events per run in named type families given as regexes (families may overlap)."""
    h = event_histogram(events)
    return h.groupBy("run_id").agg(*[
        F.coalesce(F.sum(F.when(F.col("event_type").rlike(rx), F.col("n"))), F.lit(0)).alias(name) for name, rx in groups.items()
    ])


def trace_summary(events: DataFrame) -> DataFrame:
    """per traced pid: when it attached (order of first sight), its calls, its cap marks."""
    api = fld(events, "Api")
    t = events.filter(F.col("source") == "apitrace").select("run_id", "seq", fld(events, "ProcessId").alias("pid"), api.alias("api"))
    attached, cap = F.col("api") == fixed.META_ATTACHED, F.col("api") == fixed.META_CAP
    return t.filter(two_valued(F.col("api") != "") & F.col("pid").isNotNull()).groupBy("run_id", "pid").agg(
        F.min(F.when(attached, F.col("seq"))).alias("attached_seq"),
        F.count_if(~attached & ~cap).alias("calls"), F.count_if(cap).alias("cap_marks"),
    )


def coverage_matrix(events: DataFrame, alerts: DataFrame, techniques: DataFrame, static: DataFrame | None = None) -> DataFrame:
    """per (run, type) the number of events plus alerts; types seen only as alerts are marked."""
    e = events.groupBy("run_id", F.coalesce("event_type", F.lit("unknown")).alias("event_type")).agg(F.count("*").alias("__e"))
    a = alerts.filter(two_valued(F.col("event_type") != "")).groupBy("run_id", "event_type").agg(F.count("*").alias("__a"))
    x = e.join(a, ["run_id", "event_type"], "full").join(techniques, "event_type", "left")
    out = x.select(
        "run_id", "event_type", (F.coalesce("__e", F.lit(0)) + F.coalesce("__a", F.lit(0))).alias("count"),
        F.when(F.col("__e").isNull(), "alert").alias("source"),
        F.coalesce(F.transform("techniques", lambda t: t["technique_id"]), F.array().cast("array<string>")).alias("techniques"),
    )
    return out if static is None else out.unionByName(
        static.select("run_id", F.lit("capa (static capabilities)").alias("event_type"), F.col("capability_count").alias("count"),
                      F.lit("static").alias("source"), F.col("attack").alias("techniques")))


def detections_fired(alerts: DataFrame, static_patterns: DataFrame | None = None) -> DataFrame:
    """counts per (run, family, label); the family is decided by ordered tests."""
    t = F.col("event_type")
    src, prov = fld(alerts, "source"), fld(alerts, "provider_name")
    unknown = F.lit("(unknown)")
    some = lambda *c: F.coalesce(*[F.nullif(x, F.lit("")) for x in c], unknown)
    pair = lambda fam, label: F.struct(F.lit(fam).alias("family"), label.alias("label"))
    rule = F.coalesce(F.nullif(fld(alerts, "Rule"), F.lit("")), F.lit("unknown"))
    x = (
        F.when(fld(alerts, "rule_id").isNotNull(), pair("sigma", F.coalesce(fld(alerts, "rule_id"), fld(alerts, "title"))))
        .when(t == "DmpYaraMatch", pair("yara", F.concat(rule, F.lit("@process dump"))))
        .when(t == "DroppedFileYaraMatch", pair("yara", F.concat(rule, F.lit("@dropped file"))))
        .when((src == "cape") | (prov == "CapeSignatures"), pair("cape", some(fld(alerts, "Name"), t)))
        .when((src == "apitrace") | (prov == "BehavioralSignatures"), pair("behavioral", some(t)))
        .otherwise(pair("heuristic", some(fld(alerts, "priority_reason"), t)))
    )
    out = alerts.select("run_id", x.alias("x")).groupBy("run_id", "x.family", "x.label").agg(F.count("*").alias("n"))
    return out if static_patterns is None else out.unionByName(
        static_patterns.select("run_id", F.lit("yara").alias("family"), F.concat("rule", F.lit("@sample")).alias("label"), F.lit(1).cast("bigint").alias("n")).distinct())


def alerts_per_process(alerts: DataFrame) -> DataFrame:
    """F6."""
    pid = F.coalesce(fld(alerts, "ProcessId"), fld(alerts, "SourceProcessId"))
    return alerts.select("run_id", as_int(pid).alias("pid")).filter(F.col("pid").isNotNull()).groupBy("run_id", "pid").agg(F.count("*").alias("n_alerts"))


def is_high_signal(name: Column, techniques: Column) -> Column:
    """Capability that counts for the score: by wording or by technique parent."""
    by_tech = F.exists(techniques, lambda t: technique_parent(t).isin(fixed.HIGH_SIGNAL_TECHNIQUES))
    return two_valued(name.rlike(fixed.HIGH_SIGNAL_NAME)) | two_valued(by_tech)


CAPABILITY_DOC = (
    "struct<meta:struct<version:string>,rules:map<string,struct<source:string,matches:array<string>,"
    "meta:struct<is_subscope_rule:boolean,lib:boolean,description:string,"
    "attack:array<struct<id:string,tactic:string>>,mbc:array<struct<id:string>>>>>>"
)


def capabilities(docs: DataFrame) -> DataFrame:
    """one row per standalone capability of a result document ``(run_id, doc)``."""
    x = docs.select("run_id", F.from_json("doc", CAPABILITY_DOC).alias("d")).select("run_id", F.explode("d.rules").alias("name", "r"))
    ids = F.transform(F.filter(F.col("r.meta.attack"), lambda a: two_valued(a["id"] != "")), lambda a: a["id"])
    ids = F.coalesce(ids, F.array().cast("array<string>"))
    return x.filter(~two_valued(F.col("r.meta.is_subscope_rule"))).select(
        "run_id", "name", F.nullif(F.trim(F.regexp_extract(F.coalesce("r.source", F.lit("")), r"(?m)^\s*namespace:\s*(.+?)\s*$", 1)), F.lit("")).alias("namespace"),
        ids.alias("attack"), F.coalesce(F.col("r.meta.attack.tactic"), F.array().cast("array<string>")).alias("tactics"),
        two_valued(F.col("r.meta.lib")).alias("lib"), F.coalesce(F.size("r.matches"), F.lit(0)).alias("match_count"),
        is_high_signal(F.col("name"), ids).alias("high_signal"),
    )


def capability_summary(caps: DataFrame) -> DataFrame:
    """counts and the technique and tactic vocabularies per run."""
    tech = caps.select("run_id", F.explode("attack").alias("t")).groupBy("run_id").agg(F.array_sort(F.collect_set("t")).alias("attack"))
    return caps.groupBy("run_id").agg(
        F.count("*").alias("capability_count"), F.count_if("high_signal").alias("high_signal_count")
    ).join(tech, "run_id", "left")


def script_blocks(fragments: DataFrame) -> DataFrame:
    """one row per block, its texts joined in fragment order.

    ``fragments(run_id, block_id, number, text, path, seq)``.
    """
    return _script_rows(fragments, ["run_id", "block_id"])


def script_block_parts(fragments: DataFrame, part_size: int = 1000) -> DataFrame:
    """blocks as ordered parts of ``part_size`` fragments each, so no task ever holds an unbounded text."""
    rows = fragments.withColumn("part", F.floor((F.col("number") - 1) / part_size).cast("bigint"))
    return _script_rows(rows, ["run_id", "block_id", "part"])


def _script_rows(fragments: DataFrame, by: list[str]) -> DataFrame:
    keys = ["run_id", "block_id"]
    path = fragments.filter(two_valued(F.col("path") != "")).groupBy(*keys).agg(F.min_by("path", "seq").alias("path"))
    parts = fragments.groupBy(*by).agg(
        F.array_sort(F.collect_list(F.struct("number", "seq", F.coalesce("text", F.lit("")).alias("text")))).alias("f")
    ).select(*by, F.size("f").alias("n_fragments"), F.array_join(F.col("f.text"), "").alias("text"))
    return parts.join(path, keys, "left").withColumn("path", F.coalesce("path", F.lit("")))


def iocs_network(events: DataFrame, guids: DataFrame, pids: DataFrame) -> DataFrame:
    """distinct (ip, port) per run, in scope if any occurrence is."""
    rows = events.filter(F.col("event_type") == "NetworkConnect").select(
        "run_id", fld(events, "DestinationIp").alias("ip"), fld(events, "DestinationPort").alias("port"),
        F.coalesce(F.nullif(fld(events, "ProcessGuid"), F.lit("")), fld(events, "SourceProcessGuid")).alias("g"),
        as_int(F.coalesce(F.nullif(fld(events, "ProcessId"), F.lit("")), fld(events, "SourceProcessId"))).alias("p"),
    ).filter(two_valued(F.col("ip") != ""))
    x = in_lineage(rows, guids, pids, F.col("g"), F.col("p"))
    return x.groupBy("run_id", "ip", "port").agg(F.max("__in").alias("in_scope"))


def iocs_registry(alerts: DataFrame) -> DataFrame:
    """registry alerts of high priority."""
    return alerts.filter(F.col("event_type").isin(fixed.REGISTRY_TYPES) & two_valued(F.col("priority") == "high")).select(
        "run_id", fld(alerts, "TargetObject").alias("target_object"), fld(alerts, "Details").alias("details"), "priority_reason"
    )


def iocs_dropped(files: DataFrame) -> DataFrame:
    """dropped files that were retrieved."""
    return files.filter(two_valued(F.col("status") == "retrieved")).select("run_id", "filename", "original_path", "sha256")


def packet_totals(packets: DataFrame) -> DataFrame:
    """packets, bytes and duration (seconds, 3 digits) between the first and last packet by index."""
    return packets.groupBy("run_id").agg(
        F.count("*").alias("total_packets"), F.sum("length").alias("total_bytes"),
        F.min_by("ts", "idx").alias("first_ts"), F.max_by("ts", "idx").alias("last_ts"),
    ).withColumn("duration_s", F.round((F.unix_micros(F.col("last_ts").cast("timestamp")) - F.unix_micros(F.col("first_ts").cast("timestamp"))) / 1e6, 3))


def protocol_counts(packets: DataFrame) -> DataFrame:
    """F14."""
    return packets.groupBy("run_id", "protocol").agg(F.count("*").alias("n"))


def dns_counts(packets: DataFrame) -> DataFrame:
    """F14."""
    return packets.filter(two_valued(F.col("dns_qname") != "")).groupBy("run_id", "dns_qname").agg(F.count("*").alias("n"))


def http_counts(packets: DataFrame) -> DataFrame:
    """F14."""
    e = lambda c: F.coalesce(c, F.lit(""))
    return packets.filter((e("http_host") != "") | (e("http_path") != "")).groupBy(
        "run_id", e("http_method").alias("method"), e("http_host").alias("host"), e("http_path").alias("path")
    ).agg(F.count("*").alias("n"))


def conversations(packets: DataFrame) -> DataFrame:
    """bytes and packets per protocol and unordered endpoint pair."""
    end = lambda h, p: F.when(F.col(p).isNull(), F.col(h)).otherwise(F.concat_ws(":", F.col(h), F.col(p).cast("string")))
    a, b = end("src", "sport"), end("dst", "dport")
    rows = packets.filter(two_valued(F.col("src") != "") & two_valued(F.col("dst") != ""))
    return rows.groupBy("run_id", "protocol", F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).agg(
        F.sum("length").alias("bytes"), F.count("*").alias("packets")
    )


def top_per_run(df: DataFrame, order: list, k: int, key: str = "run_id") -> DataFrame:
    """First k rows per run; Spark limits every group inside each task before the shuffle."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def baseline_counts(events: DataFrame, alerts: DataFrame) -> DataFrame:
    """F16: total events, total alerts and events per type, as (run, metric, value) rows."""
    return (
        events.groupBy("run_id").agg(F.count("*").alias("value")).withColumn("metric", F.lit("total_events"))
        .unionByName(alerts.groupBy("run_id").agg(F.count("*").alias("value")).withColumn("metric", F.lit("alert_count")))
        .unionByName(event_histogram(events).select("run_id", F.col("n").alias("value"), F.concat(F.lit("type:"), "event_type").alias("metric")))
        .select("run_id", "metric", "value")
    )


def baseline_drift(now: DataFrame, saved: DataFrame) -> DataFrame:
    """F16: metrics against a saved baseline."""
    x = now.withColumnRenamed("value", "__n").join(saved.withColumnRenamed("value", "__s"), ["run_id", "metric"], "full")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return x.select("run_id", "metric", zero("__s").alias("baseline"), zero("__n").alias("current"), (zero("__n") - zero("__s")).alias("delta"))


def per_process_profile(events: DataFrame, kinds: dict[str, tuple[str, str]], k: int = 10) -> DataFrame:
    """first k facts of each kind per process; ``kinds`` maps event type -> (kind, field)."""
    cases = [F.when(F.col("event_type") == t, F.struct(F.lit(kind).alias("kind"), fld(events, f).cast("string").alias("fact"))) for t, (kind, f) in kinds.items()]
    rows = events.filter(F.col("event_type").isin(list(kinds))).select(
        "run_id", fld(events, "ProcessId").alias("pid"), "seq", F.coalesce(*cases).alias("x")
    ).select("run_id", "pid", "seq", "x.kind", "x.fact")
    w = Window.partitionBy("run_id", "pid", "kind").orderBy("seq")
    return rows.withColumn("pos", F.row_number().over(w)).filter(F.col("pos") <= k).drop("seq")


def hook_inventory(hooks: DataFrame, categories: DataFrame) -> DataFrame:
    """hooks with their category's order and description, in display order."""
    x = hooks.withColumn("category", F.coalesce(F.nullif("category", F.lit("")), F.lit("misc"))).join(categories, "category", "left")
    return x.withColumn("order", F.coalesce("order", F.lit(99))).withColumn("description", F.coalesce("description", F.lit("")))


def hook_categories(inventory: DataFrame) -> DataFrame:
    """hooks per category."""
    return inventory.groupBy("category", "order").agg(F.count("*").alias("n_hooks"))


# ------------------------------------------------------------------ 2.L


def compare_runs(old: DataFrame, new: DataFrame, key: str = "event_type") -> DataFrame:
    """L1: counts per key on both sides and the difference."""
    o = old.groupBy(key).agg(F.count("*").alias("old"))
    n = new.groupBy(key).agg(F.count("*").alias("new"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return o.join(n, key, "full").select(key, zero("old").alias("old"), zero("new").alias("new"), (zero("new") - zero("old")).alias("delta"))


def appeared(old: DataFrame, new: DataFrame, key: str = "event_id") -> DataFrame:
    """L2: (key, image) of keys that only the new side has; swap the arguments for disappeared."""
    k = lambda d: d.filter(F.col(key).isNotNull() & (F.col(key) != 0)).select(key).distinct()
    only = k(new).subtract(k(old))
    imgs = new.join(only, key, "left_semi").select(
        key, F.explode(F.array(fld(new, "Image"), fld(new, "SourceImage"), fld(new, "TargetImage"))).alias("image")
    ).filter(two_valued(F.col("image") != "")).distinct()
    return only.join(imgs, key, "left")


def iocs_domains(events: DataFrame, packets: DataFrame) -> DataFrame:
    """L3: distinct names from both vantage points."""
    a = events.filter(F.col("event_type") == "DnsQuery").select("run_id", fld(events, "QueryName").alias("domain"))
    b = packets.select("run_id", F.col("dns_qname").alias("domain"))
    return a.unionByName(b).filter(two_valued(F.col("domain") != "")).distinct()


def validate_map(hooks: DataFrame, entries: DataFrame, enabled: DataFrame) -> DataFrame:
    """L4: problems between the hook list, the curated map and the enabled ids.

    ``hooks(api, hook_module)``, ``entries(api, hook_module, coverage, counterparts array<int>)``,
    ``enabled(event_id)``.
    """
    msg = lambda d, text: d.select("api", text.alias("error"))
    n = F.coalesce(F.size("counterparts"), F.lit(0))
    missing = msg(hooks.join(entries, "api", "left_anti"), F.lit("no map entry"))
    unknown = msg(entries.join(hooks, "api", "left_anti"), F.lit("names no real hook"))
    module = msg(entries.alias("e").join(hooks.alias("h"), "api").filter(~F.col("e.hook_module").eqNullSafe(F.col("h.hook_module"))), F.lit("hook_module differs"))
    kind = msg(entries.filter(~two_valued(F.col("coverage").isin("both", "hook_only"))), F.lit("coverage must be both or hook_only"))
    empty = msg(entries.filter(two_valued(F.col("coverage") == "both") & (n == 0)), F.lit("both without counterparts"))
    extra = msg(entries.filter(two_valued(F.col("coverage") == "hook_only") & (n > 0)), F.lit("hook_only with counterparts"))
    ids = entries.select("api", F.explode("counterparts").alias("event_id"))
    off = ids.join(enabled, "event_id", "left_anti").select("api", F.concat(F.lit("counterpart not enabled: "), F.col("event_id").cast("string")).alias("error"))
    out = missing
    for d in (unknown, module, kind, empty, extra, off):
        out = out.unionByName(d)
    return out


def invert_map(entries: DataFrame) -> DataFrame:
    """(event_id, api) pairs of dual-covered calls, with the api's place in the list."""
    return entries.filter(F.col("coverage") == "both").select(F.explode("counterparts").alias("event_id"), "api").distinct()


def one_sided_ids(enabled: DataFrame, entries: DataFrame) -> DataFrame:
    """Enabled ids that no call explains."""
    return enabled.select("event_id").distinct().subtract(invert_map(entries).select("event_id"))
