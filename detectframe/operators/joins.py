"""The joins hidden in detection logic.

Right sides are reduced to one row per key before every join, so a hot key can
never multiply rows; Spark picks broadcast or shuffle by measured size (AQE).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from detectframe import fixed
from detectframe.functions.leaf import two_valued
from detectframe.functions.scalar import as_int, kv_bool, kv_int, let, micros, norm_ioc, parse_kv, technique_parent
from detectframe.scale import literal_table
from detectframe.schema import fld


def resolve_labels(runs: DataFrame, labels: DataFrame) -> DataFrame:
    """Label of a run by run id, then sha256, then filename; the last label of a key wins.

    ``labels(match_kind, match_value, label, family[, ord])``.
    """
    order = F.col("ord") if "ord" in labels.columns else F.struct("label", "family")
    one = labels.groupBy("match_kind", "match_value").agg(F.max_by(F.struct("label", "family"), order).alias("__l"))
    out = runs
    for kind, col in (("report", "run_id"), ("sha256", "sha256"), ("filename", "filename")):
        side = one.filter(F.col("match_kind") == kind).select(F.col("match_value").alias(f"__k_{kind}"), F.col("__l").alias(f"__l_{kind}"))
        out = out.join(side, out[col] == F.col(f"__k_{kind}"), "left")
    best = F.coalesce("__l_report", "__l_sha256", "__l_filename")
    return (
        out.withColumn("label", best["label"]).withColumn("family", best["family"])
        .withColumn("label_by", F.when(F.col("__l_report").isNotNull(), "report").when(F.col("__l_sha256").isNotNull(), "sha256")
                    .when(F.col("__l_filename").isNotNull(), "filename"))
        .drop(*[f"__{p}_{k}" for p in "kl" for k in ("report", "sha256", "filename")])
    )


def near_time(a: DataFrame, b: DataFrame, keys: list[str], seconds: float, out: str = "near") -> DataFrame:
    """Adds ``out``: is there a ``b`` row of the same keys within ``seconds`` of the ``a`` row?

    Exact without pairing rows.  ``b`` is reduced to the first and last time of
    each (keys, bucket) with buckets as wide as the window: a neighbour in the
    own bucket is always close enough, in the bucket before only its last time
    matters, in the bucket after only its first.  One equi-join, N:1.
    """
    width = int(round(seconds * 1_000_000))
    us = micros(F.col("ts"))
    lo_hi = b.filter(F.col("ts").isNotNull()).groupBy(*keys, F.floor(us / width).cast("bigint").alias("__b")).agg(
        F.min(us).alias("__lo"), F.max(us).alias("__hi")
    )
    none = F.lit(None).cast("bigint")
    seen_from = lo_hi.select(*keys, F.explode(F.array(
        F.struct(F.col("__b").alias("__b"), none.alias("before"), F.lit(True).alias("same"), none.alias("after")),
        F.struct((F.col("__b") + 1).alias("__b"), F.col("__hi").alias("before"), F.lit(False).alias("same"), none.alias("after")),
        F.struct((F.col("__b") - 1).alias("__b"), none.alias("before"), F.lit(False).alias("same"), F.col("__lo").alias("after")),
    )).alias("x")).select(*keys, "x.*")
    cover = seen_from.groupBy(*keys, "__b").agg(
        F.max("before").alias("__before"), F.max("same").alias("__same"), F.min("after").alias("__after")
    )
    side = cover.select(*[F.col(k).alias(f"__k_{k}") for k in keys], F.col("__b").alias("__kb"), "__before", "__same", "__after")
    cond = F.floor(us / width).cast("bigint") == F.col("__kb")
    for k in keys:
        cond = cond & (F.col(k) == F.col(f"__k_{k}"))
    x = a.join(side, cond, "left").drop("__kb", *[f"__k_{k}" for k in keys])
    near = two_valued(F.col("__same")) | two_valued(us - F.col("__before") <= width) | two_valued(F.col("__after") - us <= width)
    return x.withColumn(out, near).drop("__before", "__same", "__after")


def trace_rows(events: DataFrame) -> DataFrame:
    """Call-trace rows: run, pid, time, call name, argument text."""
    return events.filter(
        (F.col("source") == "apitrace") & (F.col("event_id") == 9200) & (F.col("event_type") == "ApiCall")
    ).select(
        "run_id", "seq", "ts", as_int(fld(events, "ProcessId")).alias("pid"), fld(events, "Api").alias("api"),
        fld(events, "Arg0").alias("arg"), fld(events, "Category").alias("category"),
    ).filter(two_valued(F.col("api") != ""))


def own_children(events: DataFrame) -> DataFrame:
    """(run, pid, child) of processes an actor created, from the call trace."""
    t = trace_rows(events).filter(F.col("api") == "NtCreateUserProcess")
    return t.select("run_id", "pid", kv_int(parse_kv(F.col("arg")), "child_pid").alias("child")).filter(
        F.col("pid").isNotNull() & two_valued(F.col("child") != 0)
    ).distinct()


def exclude_own_children(pairs: DataFrame, children: DataFrame) -> DataFrame:
    """Drop (run, pid, target) pairs whose target the actor itself created."""
    return pairs.join(children.withColumnRenamed("child", "target"), ["run_id", "pid", "target"], "left_anti")


def counterpart_misses(
    events: DataFrame, event_calls: dict[int, list[str]] = fixed.EVENT_CALLS, window_s=fixed.BLINDSPOT_S,
    min_misses=fixed.BLINDSPOT_MIN, wow64_s=fixed.WOW64_S, image_grace_s=fixed.IMAGE_GRACE_S,
) -> DataFrame:
    """Host events of a traced process that no hooked call explains.

    A miss is an event whose mapped calls do not occur for the same pid within
    the window.  Suppressed: kernel-written registry paths, untraced pids, no
    earlier call, capped traces, events before the monitor attached, image loads
    right after it, re-injection gaps, actions on own children, reused pids.
    """
    trace = trace_rows(events).filter(F.col("pid").isNotNull() & F.col("ts").isNotNull())
    meta = [fixed.META_CAP, fixed.META_WOW64, fixed.META_ATTACHED]
    facts = trace.groupBy("run_id", "pid").agg(
        F.min(F.when(~F.col("api").isin(meta), F.col("ts"))).alias("first_call"),
        F.max((F.col("api") == fixed.META_CAP)).alias("capped"),
        F.min(F.when(F.col("api") == fixed.META_ATTACHED, F.col("ts"))).alias("attached"),
    )
    host = events.filter(F.col("source") == "sysmon")
    src_pid = as_int(fld(events, "SourceProcessId"))
    actor = F.coalesce(F.when(src_pid != 0, src_pid), as_int(fld(events, "ProcessId")))
    created = host.filter((F.col("event_id") == 1) & F.col("ts").isNotNull()).select(
        "run_id", as_int(fld(events, "ProcessId")).alias("pid"), "ts"
    )
    reused = created.join(facts.select("run_id", "pid", "attached"), ["run_id", "pid"]).filter(
        F.col("ts") > F.col("attached")
    ).groupBy("run_id", "pid").agg(F.min("ts").alias("reused_from"))
    facts = facts.join(reused, ["run_id", "pid"], "left")

    path = F.lower(F.coalesce(fld(events, "TargetObject"), F.lit("")))
    kernel = (F.col("event_id") == 13) & (path.contains(fixed.KERNEL_REGISTRY[0]) | path.contains(fixed.KERNEL_REGISTRY[1]))
    rows = host.filter(F.col("event_id").isin(list(event_calls)) & ~kernel & F.col("ts").isNotNull()).select(
        "run_id", "seq", "ts", "event_id", actor.alias("pid"), as_int(fld(events, "TargetProcessId")).alias("target")
    ).filter(F.col("pid").isNotNull())
    secs = lambda a, b: (micros(a) - micros(b)) / 1_000_000.0
    rows = rows.join(facts, ["run_id", "pid"]).filter(
        two_valued(F.col("first_call") <= F.col("ts")) & ~F.col("capped")
        & ~two_valued(F.col("ts") < F.col("attached"))
        & ~((F.col("event_id") == 7) & two_valued(secs(F.col("ts"), F.col("attached")) <= image_grace_s))
        & ~two_valued(F.col("ts") >= F.col("reused_from"))
    ).select("run_id", "seq", "ts", "event_id", "pid", "target")
    gaps = trace.filter(F.col("api") == fixed.META_WOW64).select("run_id", "pid", "ts")
    rows = near_time(rows, gaps, ["run_id", "pid"], wow64_s, "in_gap").filter(~F.col("in_gap")).drop("in_gap")
    kids = own_children(events).withColumnRenamed("child", "target").withColumn("__own", F.lit(True))
    rows = rows.join(kids, ["run_id", "pid", "target"], "left").filter(
        ~(F.col("event_id").isin(8, 10) & two_valued(F.col("__own")))
    ).drop("__own")

    pairs = [(api, eid) for eid, apis in event_calls.items() for api in apis]
    calls = trace.join(literal_table(events.sparkSession, pairs, "api string, event_id int"), "api").select(
        "run_id", "pid", "event_id", "ts"
    )
    missed = near_time(rows, calls, ["run_id", "pid", "event_id"], window_s, "covered").filter(~F.col("covered"))
    hook = F.create_map(*[F.lit(x) for eid, apis in event_calls.items() for x in (eid, apis[0])])[F.col("event_id")]
    return missed.groupBy("run_id", "pid", hook.alias("hook")).agg(
        F.count("*").alias("misses"), F.min_by(F.struct("event_id", "ts", "seq"), "seq").alias("f")
    ).filter(F.col("misses") >= min_misses).select(
        "run_id", "pid", "hook", "misses", "f.event_id", F.col("f.ts").alias("first_ts"), F.col("f.seq").alias("first_seq")
    )


def same_value_sequence(first: DataFrame, then: DataFrame, keys: list[str], carry: str | None = None) -> DataFrame:
    """Rows of ``then`` with an earlier ``first`` row of the same keys (both carry ``seq``).

    Only the earliest ``first`` per key matters, so the join is N:1.  ``carry`` names a column of that row to bring
    along as ``first_<carry>``.
    """
    start = first.groupBy(*keys).agg(F.min("seq").alias("first_seq"), *([F.min_by(carry, "seq").alias(f"first_{carry}")] if carry else []))
    return then.join(start, keys).filter(F.col("seq") > F.col("first_seq"))


def alloc_then_start(events: DataFrame) -> DataFrame:
    """Executable allocation at an address, later a thread started there.

    ``row`` and ``first_row`` hold the start and the allocation as ``(seq, ts, api, arg)``.
    """
    starters = fixed.THREAD_APIS + ["NtResumeThread"]
    t = trace_rows(events).filter(F.col("pid").isNotNull() & F.col("api").isin(fixed.ALLOC_APIS + starters))

    def parts(kv):
        at = lambda key: F.when(~kv[key].isin("", "0x0"), kv[key])
        return F.struct(at("base").alias("base"), at("start").alias("start"), kv_bool(kv, "executable").alias("executable"))

    # generated, so that later filters do not parse the argument again
    row = F.struct("seq", "ts", "api", F.coalesce("arg", F.lit("")).alias("arg")).alias("row")
    t = t.select("run_id", "pid", "seq", "ts", "api", row, F.explode(F.array(let(parse_kv(F.col("arg")), parts))).alias("p"))
    allocs = t.filter(F.col("api").isin(fixed.ALLOC_APIS) & F.col("p.executable")).select("run_id", "pid", "seq", "row", F.col("p.base").alias("addr"))
    starts = t.filter(F.col("api").isin(starters)).select("run_id", "pid", "seq", "ts", "api", "row", F.col("p.start").alias("addr"))
    return same_value_sequence(allocs, starts, ["run_id", "pid", "addr"], carry="row")


def ioc_matches(known: DataFrame, conns: DataFrame, domains: DataFrame) -> DataFrame:
    """Known indicators and whether the run showed them.

    ``known(sha256, ioc_type, ioc, confidence)``; ``conns(sha256, ip, port)`` and
    ``domains(sha256, domain)`` are the run's observations (in scope).
    """
    kind = F.lower("ioc_type")
    k = known.filter(kind.isin(fixed.IOC_KINDS) & two_valued(as_int(F.col("confidence")) >= fixed.IOC_MIN_CONFIDENCE))
    k = k.withColumn("__p", norm_ioc(kind, F.col("ioc"))).filter(F.col("__p").isNotNull()).select(
        "sha256", "ioc_type", "ioc", "__p.domain", "__p.ip", F.nullif("__p.port", F.lit("")).alias("port")
    )
    c = conns.select("sha256", F.lower("ip").alias("ip"), F.col("port").cast("string").alias("port"))
    by_ip = c.select("sha256", "ip").distinct().withColumn("__ip", F.lit(True))
    by_port = c.distinct().withColumn("__ipp", F.lit(True))
    by_name = domains.select("sha256", F.regexp_replace(F.lower("domain"), r"\.+$", "").alias("domain")).distinct().withColumn("__dom", F.lit(True))
    x = k.join(by_ip, ["sha256", "ip"], "left").join(by_port, ["sha256", "ip", "port"], "left").join(by_name, ["sha256", "domain"], "left")
    kind_of = F.when(two_valued(F.col("__ipp")) | (F.col("port").isNull() & two_valued(F.col("__ip"))), "connection").when(
        two_valued(F.col("__dom")), "dns_query"
    )
    return x.select("sha256", "ioc_type", "ioc", kind_of.alias("match_kind"), kind_of.isNotNull().alias("matched"))


def ioc_verdicts(samples: DataFrame, matches: DataFrame, conns: DataFrame, domains: DataFrame) -> DataFrame:
    """Per sample observed / missed / inconclusive / no_groundtruth_iocs."""
    m = matches.groupBy("sha256").agg(F.count("*").alias("total"), F.count_if("matched").alias("hit"))
    tried = conns.select("sha256").unionByName(domains.select("sha256")).distinct().withColumn("__t", F.lit(True))
    x = samples.join(m, "sha256", "left").join(tried, "sha256", "left")
    verdict = (
        F.when(F.col("total").isNull(), "no_groundtruth_iocs").when(F.col("hit") > 0, "observed")
        .when(two_valued(F.col("__t")), "missed").otherwise("inconclusive")
    )
    return x.select(*samples.columns, verdict.alias("verdict"), F.coalesce("hit", F.lit(0)).alias("matched"),
                    F.coalesce("total", F.lit(0)).alias("total_iocs"))


def technique_overlap(observed: DataFrame, expected: DataFrame, key: str = "run_id", min_overlap=fixed.MIN_TECHNIQUE_OVERLAP) -> DataFrame:
    """Exact and parent-level overlap of ``(key, technique)`` sets; technique sets are bounded vocabularies."""
    exact = observed.select(key, "technique").distinct().join(expected.select(key, "technique").distinct(), [key, "technique"])
    par = lambda d: d.select(key, technique_parent(F.col("technique")).alias("parent")).distinct()
    both = par(observed).join(par(expected), [key, "parent"])
    keys = observed.select(key).unionByName(expected.select(key)).distinct()
    return (
        keys.join(exact.groupBy(key).agg(F.count("*").alias("n_exact")), key, "left")
        .join(both.groupBy(key).agg(F.count("*").alias("n_parent")), key, "left")
        .select(key, F.coalesce("n_exact", F.lit(0)).alias("overlap"), F.coalesce("n_parent", F.lit(0)).alias("parent_overlap"),
                (F.coalesce("n_parent", F.lit(0)) >= min_overlap).alias("behavior_ok"))
    )


def technique_covered(wanted: DataFrame, seen: DataFrame, key: str = "run_id") -> DataFrame:
    """Is the wanted technique, a parent or a child of it among the seen ones?

    The prefix test becomes equi-joins: a wanted sub-technique is covered by
    itself or its parent, a wanted parent by anything below it.
    """
    s = seen.select(key, F.col("technique").alias("t")).distinct()
    marks = s.select(key, "t").unionByName(s.select(key, technique_parent(F.col("t")).alias("t"))).distinct()
    exact = s.withColumnRenamed("t", "__e").withColumn("__x", F.lit(True))
    w = wanted.withColumn("__is_parent", ~F.col("technique").contains("."))
    m = marks.withColumn("__m", F.lit(True)).withColumnRenamed("t", "technique")
    x = w.join(m, [key, "technique"], "left")  # exact, or (for a parent) any child
    x = x.withColumn("__e", technique_parent(F.col("technique"))).join(exact, [key, "__e"], "left")  # its parent seen
    hit = two_valued(F.col("__m")) | two_valued(F.col("__x"))
    return x.withColumn("covered", hit).drop("__m", "__x", "__e", "__is_parent")


def manifest_audit(manifest: DataFrame, latest: DataFrame, seen: DataFrame) -> DataFrame:
    """Each expected sample against its latest run; samples without a run stay.

    ``manifest(file, technique, expected_min)``, ``latest(file, run_id, level, score)``,
    ``seen(run_id, technique)``.
    """
    rank = F.create_map(F.lit("clean"), F.lit(0), F.lit("suspicious"), F.lit(1), F.lit("malicious"), F.lit(2))
    x = manifest.join(latest, "file", "left")
    x = technique_covered(x, seen, "run_id")
    has = F.col("run_id").isNotNull()
    ok = rank[F.coalesce("level", F.lit("clean"))] >= rank[F.coalesce("expected_min", F.lit("suspicious"))]
    return x.select(
        "file", "technique",
        F.when(has, F.concat_ws("/", F.coalesce("level", F.lit("None")), F.coalesce(F.col("score").cast("string"), F.lit("None")))).otherwise("NO-REPORT").alias("verdict"),
        F.when(has, F.when(ok, "yes").otherwise("NO")).otherwise("-").alias("band_ok"),
        (has & F.col("covered")).alias("technique_hit"),
    )


def technique_map(spark, mapping: dict = fixed.TYPE_TECHNIQUES) -> DataFrame:
    rows = [(k, [tuple(t) for t in v]) for k, v in mapping.items()]
    return literal_table(
        spark, rows, "event_type string, techniques array<struct<technique_id:string,technique_name:string,tactic:string>>"
    )


def enrich_techniques(alerts: DataFrame, mapping: DataFrame, rule_techniques: Column | None = None) -> DataFrame:
    """``primary_tech`` and ``candidates`` from the event type, then the rule's own tags."""
    empty = F.array().cast("array<struct<technique_id:string,technique_name:string,tactic:string>>")
    none = F.lit(None).cast("string")
    extra = empty if rule_techniques is None else F.coalesce(
        F.transform(rule_techniques, lambda t: F.struct(t.alias("technique_id"), none.alias("technique_name"), none.alias("tactic"))), empty
    )
    x = alerts.join(mapping, "event_type", "left").withColumn("__all", F.concat(F.coalesce("techniques", empty), extra))
    return x.withColumn("primary_tech", F.get("__all", F.lit(0))).withColumn(
        "candidates", F.slice("__all", 2, F.greatest(F.size("__all") - 1, F.lit(0)))
    ).drop("__all", "techniques")


def process_names(events: DataFrame) -> DataFrame:
    """Image name of each (run, pid), the first one seen."""
    return events.filter(F.col("event_type") == "ProcessCreate").select(
        "run_id", as_int(fld(events, "ProcessId")).alias("pid"), "seq",
        F.substring_index(fld(events, "Image"), "\\", -1).alias("name"),
    ).filter(two_valued(F.col("pid") != 0) & two_valued(F.col("name") != "")).groupBy("run_id", "pid").agg(
        F.min_by("name", "seq").alias("process_name")
    )


