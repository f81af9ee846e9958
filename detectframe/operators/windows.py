"""Time windows.

Sliding counts never sort one key in one task: equal times are counted first,
then a key's time line is cut into slots that are wider than the window, each
slot also sees the tail of the slot before it, and the window function runs per
(key, slot).  The result is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from detectframe import fixed
from detectframe.functions.leaf import two_valued
from detectframe.functions.scalar import micros
from detectframe.schema import fld

#: Slots are this many windows wide; the halo copies 1/SLOT of the points.
SLOT = 8


def window_counts(df: DataFrame, keys: list[str], ts: str, seconds: float) -> DataFrame:
    """Per (keys, distinct time): ``n`` rows in the closed window of ``seconds`` ending there.

    Also ``start`` (first member's time).  Rows without a time give one row with n = 0.
    """
    width = int(round(seconds * 1_000_000))
    slot = max(1, width * SLOT)
    points = df.groupBy(*keys, F.col(ts).alias("ts")).agg(F.count("*").alias("__c"))
    points = points.withColumn("__us", micros(F.col("ts")))
    own = F.col("__us") - F.pmod(F.col("__us"), F.lit(slot))
    tail = F.pmod(F.col("__us"), F.lit(slot)) >= slot - width
    spread = points.withColumn("__own", own).withColumn(
        "__slot", F.explode(F.when(tail, F.array(own, own + slot)).otherwise(F.array(own)))
    )
    w = Window.partitionBy(*keys, "__slot").orderBy("__us").rangeBetween(-width, 0)
    return (
        spread.withColumn("__n", F.sum("__c").over(w))
        .withColumn("start", F.min("ts").over(w))
        .filter(F.col("__slot").eqNullSafe(F.col("__own")))
        .select(
            *keys, "ts", F.when(F.col("__us").isNull(), F.lit(0)).otherwise(F.col("__n")).cast("bigint").alias("n"), "start"
        )
    )


#: Stretches of a window's width into which running counts are divided.
STRETCH = 8


def running_counts(points: DataFrame, keys: list[str]) -> DataFrame:
    """Per (keys, distinct time ``us``): ``n`` rows in the closed window of the row's own ``width`` ending there.

    ``points(keys.., us, width)`` in microseconds; all rows of a key have the same width, keys are never NULL.  A row
    counts from its time on and is taken back after its width, so ``n`` is a running sum and one pass serves any mix
    of widths.  The sum has two levels: inside short stretches of time, and over the totals of the stretches before;
    no task holds more than one stretch of a key.
    """
    counted = points.groupBy(*keys, "us", "width").agg(F.count("*").alias("c"))
    change = F.explode(F.array(
        F.struct(F.col("us").alias("at"), F.col("c").alias("d"), F.lit(True).alias("real")),
        F.struct((F.col("us") + F.col("width") + 1).alias("at"), (-F.col("c")).alias("d"), F.lit(False).alias("real"))))
    moves = counted.select(*keys, "width", change.alias("x")).select(*keys, "x.*", F.expr(f"x.at div greatest(width div {STRETCH}, 1)").alias("stretch"))
    # a row's start and another row's end may fall together: one change per time
    moves = moves.groupBy(*keys, "stretch", "at").agg(F.sum("d").alias("d"), F.max("real").alias("real"))
    inside = Window.partitionBy(*keys, "stretch").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    totals = moves.groupBy(*keys, "stretch").agg(F.sum("d").alias("d"))
    before = Window.partitionBy(*keys).orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(*keys, "stretch", F.coalesce(F.sum("d").over(before), F.lit(0)).alias("carried"))
    local = moves.withColumn("local", F.sum("d").over(inside)).filter("real")
    return local.join(carried, [*keys, "stretch"]).select(*keys, F.col("at").alias("us"), (F.col("local") + F.col("carried")).alias("n"))


def densest_window(df: DataFrame, keys: list[str], ts: str, seconds: float) -> DataFrame:
    """H1: per key the first densest window: ``start``, ``end``, ``n``."""
    best = F.max_by(F.struct("start", F.col("ts").alias("end"), "n"), F.struct("n", -micros(F.col("ts"))))
    return (
        window_counts(df.filter(F.col(ts).isNotNull()), keys, ts, seconds)
        .groupBy(*keys).agg(best.alias("__b")).select(*keys, "__b.start", "__b.end", "__b.n")
    )


def window_members(df: DataFrame, windows: DataFrame, keys: list[str], ts: str) -> DataFrame:
    """Rows inside their key's window (one window per key, so the join cannot multiply)."""
    return df.join(windows.select(*keys, "start", "end", "n"), keys).filter(
        (F.col(ts) >= F.col("start")) & (F.col(ts) <= F.col("end"))
    )


def pair_start_end(events: DataFrame) -> DataFrame:
    """E5: per (run, pid) the last create and last terminate, in one aggregation."""
    pid = F.trim(fld(events, "ProcessId").cast("string")).try_cast("bigint")
    rows = events.filter(F.col("event_type").isin("ProcessCreate", "ProcessTerminate")).select(
        "run_id", pid.alias("pid"), "seq", "ts", fld(events, "ParentProcessId").alias("ppid"),
        (F.col("event_type") == "ProcessCreate").alias("created"),
    )
    last = lambda what, cond: F.max_by(what, F.when(cond, F.col("seq")))
    return (
        rows.filter(F.col("pid").isNotNull()).groupBy("run_id", "pid").agg(
            last(F.struct("ts", "ppid"), F.col("created")).alias("__s"),
            last(F.col("ts"), ~F.col("created")).alias("end"),
        )
        .select("run_id", "pid", F.col("__s.ts").alias("start"), "end", F.col("__s.ppid").alias("ppid"),
                ((micros(F.col("end")) - micros(F.col("__s.ts"))) / 1_000_000.0).alias("lifetime_s"))
    )


def process_burst(
    events: DataFrame, lived_s=fixed.SHORT_LIVED_S, window_s=fixed.PROCESS_BURST_S, min_count=fixed.PROCESS_BURST_MIN
) -> DataFrame:
    """H2: parents that start many short-lived children close together."""
    return densest_window(_short_lived(events, lived_s), ["run_id", "ppid"], "start_ts", window_s).filter(
        F.col("n") >= min_count
    )


def process_burst_members(events: DataFrame, bursts: DataFrame, lived_s=fixed.SHORT_LIVED_S) -> DataFrame:
    """H2: the children of each burst as rows (a list could grow without bound)."""
    return window_members(_short_lived(events, lived_s), bursts, ["run_id", "ppid"], "start_ts").select(
        "run_id", "ppid", "pid", "start_ts"
    )


def _short_lived(events: DataFrame, lived_s: float) -> DataFrame:
    life = pair_start_end(events)
    return life.filter(
        two_valued(F.col("ppid") != "") & F.col("lifetime_s").between(0, lived_s)
    ).select("run_id", "ppid", "pid", F.col("start").alias("start_ts"))


def connects(events: DataFrame) -> DataFrame:
    """Outbound connections with pid and time."""
    outbound = F.lower(F.trim(F.coalesce(F.nullif(fld(events, "Initiated"), F.lit("")), F.lit("true")))) == "true"
    return events.filter((F.col("event_type") == "NetworkConnect") & outbound & F.col("ts").isNotNull()).select(
        "run_id", fld(events, "ProcessId").alias("pid"), "ts",
        F.coalesce(fld(events, "DestinationIp"), F.lit("")).alias("ip"),
        F.coalesce(fld(events, "DestinationPort"), F.lit("")).alias("port"),
    ).filter(F.col("pid").isNotNull())


def network_burst(
    events: DataFrame, window_s=fixed.NETWORK_BURST_S, scan_min=fixed.PORT_SCAN_MIN, flood_min=fixed.CONN_FLOOD_MIN
) -> DataFrame:
    """H3, connection part: port scans per (pid, ip), else connection floods per pid."""
    rows = connects(events)
    keys = ["run_id", "pid"]
    best = densest_window(rows, keys, "ts", window_s)
    members = window_members(rows, best, keys, "ts")
    ports = (
        members.filter((F.col("ip") != "") & (F.col("port") != ""))
        .groupBy(*keys, "ip", "port").agg(F.max("end").alias("end"))
        .groupBy(*keys, "ip").agg(F.count("*").alias("count"), F.max("end").alias("end"))
    )
    scans = ports.filter(F.col("count") >= scan_min)
    floods = best.filter(F.col("n") >= flood_min).join(scans.select(*keys).distinct(), keys, "left_anti")
    return scans.select(*keys, F.lit("port_scan").alias("kind"), "ip", "count", "end").unionByName(
        floods.select(*keys, F.lit("connection_flood").alias("kind"), F.lit(None).cast("string").alias("ip"),
                      F.col("n").alias("count"), "end")
    )


def burst_top(events: DataFrame, bursts: DataFrame, window_s=fixed.NETWORK_BURST_S, k: int = 5) -> DataFrame:
    """The k busiest destinations in each flooding pid's window."""
    rows = connects(events)
    keys = ["run_id", "pid"]
    flood = bursts.filter(F.col("kind") == "connection_flood").select(*keys)
    best = densest_window(rows.join(flood, keys, "left_semi"), keys, "ts", window_s)
    counts = window_members(rows, best, keys, "ts").filter(F.col("ip") != "").groupBy(*keys, "ip").agg(
        F.count("*").alias("count")
    )
    w = Window.partitionBy(*keys).orderBy(F.desc("count"), "ip")
    return counts.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def dns_burst(
    events: DataFrame, window_s=fixed.NETWORK_BURST_S, flood_min=fixed.DNS_FLOOD_MIN, tunnel_min=fixed.DNS_TUNNEL_MIN,
    tunnel_len=fixed.DNS_TUNNEL_NAME_LEN, tunnel_unique=fixed.DNS_TUNNEL_UNIQUE,
) -> DataFrame:
    """H3, name part: tunnel suspects (many long, mostly unique names), else floods."""
    rows = events.filter((F.col("event_type") == "DnsQuery") & F.col("ts").isNotNull()).select(
        "run_id", fld(events, "ProcessId").alias("pid"), "ts", F.coalesce(fld(events, "QueryName"), F.lit("")).alias("name")
    ).filter(F.col("pid").isNotNull())
    keys = ["run_id", "pid"]
    best = densest_window(rows, keys, "ts", window_s)
    # two steps instead of count(DISTINCT): partial sums per name first
    names = window_members(rows, best, keys, "ts").filter(F.col("name") != "").groupBy(*keys, "name").agg(
        F.count("*").alias("c"), F.max("end").alias("end"), F.max("n").alias("n")
    )
    stats = names.groupBy(*keys).agg(
        F.max("n").alias("count"), F.max("end").alias("end"),
        (F.sum(F.col("c") * F.char_length("name")) / F.sum("c")).alias("avg_len"),
        (F.count("*") / F.sum("c")).alias("unique_ratio"),
    )
    kind = F.when(
        (F.col("count") >= tunnel_min) & (F.col("avg_len") >= tunnel_len) & (F.col("unique_ratio") >= tunnel_unique),
        F.lit("dns_tunnel_suspect"),
    ).when(F.col("count") >= flood_min, F.lit("dns_flood"))
    return stats.withColumn("kind", kind).filter(F.col("kind").isNotNull())


def first_per_key(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """H4: first row per key.  Spark keeps one row per key and task before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") == 1).drop("__rn")


def latest_per_key(runs: DataFrame, key: str, ts: str, run_id: str, pinned: Column | None = None) -> DataFrame:
    """H5: newest run per key (ties: greater id), pinned runs and runs without a key always kept.

    Adds ``kept`` and ``superseded_by``.  The winner is an aggregate joined back,
    so a key with very many runs is never sorted in one task.
    """
    free = (F.lit(False) if pinned is None else two_valued(pinned)) | F.col(key).isNull()
    rows = runs.withColumn("__free", free)
    winner = (
        rows.filter(~F.col("__free")).groupBy(key)
        .agg(F.max(F.struct(F.col(ts).alias("t"), F.col(run_id).alias("r"))).alias("__w"))
        .select(F.col(key).alias("__k"), F.col("__w.r").alias("__winner"))
    )
    joined = rows.join(winner, rows[key] == F.col("__k"), "left")
    kept = F.col("__free") | (F.col(run_id) == F.col("__winner"))
    return joined.withColumn("kept", two_valued(kept)).withColumn(
        "superseded_by", F.when(~two_valued(kept), F.col("__winner"))
    ).drop("__free", "__k", "__winner")


def triage_rank(alerts: DataFrame) -> DataFrame:
    """H6: per host name the priority that counts, high beats low, then the first one."""
    name = F.lower(F.regexp_replace(
        F.coalesce(F.nullif(fld(alerts, "QueryName"), F.lit("")), fld(alerts, "DestinationHostname"), F.lit("")), r"\.$", ""
    ))
    rows = alerts.filter(
        F.col("event_type").isin(fixed.NETWORK_TYPES) & two_valued(F.col("priority_reason") != "")
    ).select(name.alias("host"), "priority", "priority_reason", "seq").filter(F.col("host") != "")
    rank = F.struct((F.col("priority") == "high").cast("int"), -F.col("seq"))
    return rows.groupBy("host").agg(
        F.max_by(F.struct("priority", "priority_reason"), rank).alias("__b")
    ).select("host", "__b.priority", "__b.priority_reason")
