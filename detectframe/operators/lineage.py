"""Process lineage and trees.

Closures run over (parent, child) edges of *all* runs at once.  A node with one
parent points to it, and pointers are doubled until they end at a seed or at a
node with several parents, so a chain of ten thousand processes takes 14 rounds.
Only the nodes with several parents are left to a frontier loop.  Every round is
written to the shared folder, so plans stay flat and lost executors cost nothing;
the rounds go when the result is written.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from detectframe.functions.leaf import two_valued
from detectframe.functions.scalar import as_int, basename, micros
from detectframe.scale import Scratch, cut
from detectframe.schema import fld


def _halves(s: Scratch, frame: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """Rows that have found their head, and the others; written once."""
    written = s.cut(frame, name)
    return written.filter("done"), written.filter("NOT done")


def _to_heads(s: Scratch, parents: DataFrame, heads: DataFrame) -> DataFrame:
    """Pointer doubling: ``run_id, node, to, dist, seg`` for each node below a head.

    ``parents`` are single-parent nodes that are no heads.  A row points ``dist`` steps up to ``to``; ``seg`` are the
    ids on the way, ``to`` not among them.  Nodes without a head above them fall out, at a cycle after as many rounds
    as the longest possible chain needs.
    """
    ends = heads.select("run_id", "node", F.col("node").alias("to"), F.lit(0).alias("dist"), F.array().cast("array<string>").alias("seg"))
    done = ends.withColumn("done", F.lit(True))
    first = parents.select("run_id", "node", F.col("parent").alias("to"), F.lit(1).alias("dist"), F.col("seg")).withColumn("done", F.lit(False))
    left = s.cut(first, "pointers")
    rounds = max(left.count(), 1).bit_length() + 1
    for _ in range(rounds):
        if left.isEmpty():
            break
        over = done.unionByName(left).select("run_id", F.col("node").alias("to"), F.col("to").alias("__to"), F.col("dist").alias("__dist"), F.col("seg").alias("__seg"), F.col("done").alias("__done"))
        moved = left.drop("done").join(over, ["run_id", "to"]).select(
            "run_id", "node", F.col("__to").alias("to"), (F.col("dist") + F.col("__dist")).alias("dist"), F.concat("__seg", "seg").alias("seg"), F.col("__done").alias("done"))
        found, left = _halves(s, moved, "pointers")
        done = done.unionByName(found)
    return done.drop("done")


def descend(edges: DataFrame, seeds: DataFrame, max_levels: int = 100_000, with_path: bool = False) -> DataFrame:
    """Closure of ``seeds(run_id, node)`` over ``edges(run_id, parent, child)``.

    Returns ``run_id, node, depth`` (the least number of steps) and, if asked,
    ``path`` (ids from the seed down; the smallest of the shortest ones).
    """
    spark = edges.sparkSession
    with Scratch(spark) as s:
        narrow = edges.select("run_id", "parent", "child").filter(F.col("parent") != F.col("child"))
        start = s.cut(seeds.select("run_id", "node").filter(F.col("node").isNotNull()).distinct(), "seeds")
        links = s.cut(narrow.groupBy("run_id", F.col("child").alias("node")).agg(F.min("parent").alias("parent"), F.max("parent").alias("other")), "links")
        several = links.filter("parent <> other").select("run_id", "node")
        heads = start.unionByName(several).distinct()
        seg = F.array(F.col("node").cast("string")) if with_path else F.array().cast("array<string>")
        single = links.filter("parent = other").join(start, ["run_id", "node"], "left_anti").withColumn("seg", seg)
        below = _to_heads(s, single, heads)
        best = start.select("run_id", "node", F.lit(0).alias("depth"), (F.array(F.col("node").cast("string")) if with_path else F.array().cast("array<string>")).alias("path"))
        if not several.isEmpty():
            best = _over_heads(s, narrow.join(several, [narrow["run_id"] == several["run_id"], narrow["child"] == several["node"]]).select(narrow["*"]), below, best, max_levels, with_path)
        top = best.select("run_id", F.col("node").alias("to"), "depth", "path")
        out = below.join(top, ["run_id", "to"]).select("run_id", "node", (F.col("depth") + F.col("dist")).alias("depth"), F.concat("path", "seg").alias("path"))
        return s.keep(out if with_path else out.drop("path"), "closure")


def _over_heads(s: Scratch, into: DataFrame, below: DataFrame, best: DataFrame, max_levels: int, with_path: bool) -> DataFrame:
    """Least ``(depth, path)`` of every reached head; ``into`` are the edges into nodes with several parents.

    An edge is lengthened to the head above its parent, so one step crosses a whole chain.
    """
    end = F.array(F.col("child").cast("string")) if with_path else F.array().cast("array<string>")
    via = below.select("run_id", F.col("node").alias("parent"), "to", "dist", "seg")
    hops = into.join(via, ["run_id", "parent"]).groupBy("run_id", F.col("to").alias("node"), "child").agg(
        F.min(F.struct((F.col("dist") + 1).alias("w"), F.concat("seg", end).alias("seg"))).alias("hop"))
    hops = s.cut(hops, "hops")
    known = s.cut(best, "reached")
    front = known
    for _ in range(max_levels):
        step = front.join(hops, ["run_id", "node"]).groupBy("run_id", F.col("child").alias("node")).agg(
            F.min(F.struct((F.col("depth") + F.col("hop.w")).alias("depth"), F.concat("path", F.col("hop.seg")).alias("path"))).alias("x")).select("run_id", "node", "x.*")
        old = known.groupBy("run_id", "node").agg(F.min(F.struct("depth", "path")).alias("old"))
        better = step.join(old, ["run_id", "node"], "left").filter(F.col("old").isNull() | (F.struct("depth", "path") < F.col("old"))).drop("old")
        front = s.cut(better, "reached")
        if front.isEmpty():
            return known.groupBy("run_id", "node").agg(F.min(F.struct("depth", "path")).alias("x")).select("run_id", "node", "x.*")
        known = known.unionByName(front)
    raise RuntimeError(f"more than {max_levels} levels")


def ascend(links: DataFrame, seeds: DataFrame) -> DataFrame:
    """``seeds(run_id, node)`` and all their ancestors over ``links(run_id, node, parent)``.

    Each round adds the ancestors as far up again as the rounds before reached.  With several parents to a node the
    doubled links could outgrow the input; such links take the frontier loop.
    """
    spark = links.sparkSession
    up = links.select("run_id", "node", "parent").filter(F.col("node") != F.col("parent")).distinct()
    if not up.groupBy("run_id", "node").count().filter("count > 1").isEmpty():
        return descend(up.select("run_id", F.col("node").alias("parent"), F.col("parent").alias("child")), seeds).select("run_id", "node")
    with Scratch(spark) as s:
        pointers = s.cut(up, "up")
        known = s.cut(seeds.select("run_id", "node").filter(F.col("node").isNotNull()).distinct(), "known")
        while True:
            new = known.join(pointers, ["run_id", "node"]).select("run_id", F.col("parent").alias("node")).distinct()
            new = s.cut(new.join(known, ["run_id", "node"], "left_anti"), "new")
            if new.isEmpty():
                return s.keep(known, "ancestors")
            known = known.unionByName(new)
            far = pointers.select("run_id", F.col("node").alias("parent"), F.col("parent").alias("far"))
            pointers = s.cut(pointers.join(far, ["run_id", "parent"]).select("run_id", "node", F.col("far").alias("parent")), "up")


def creates(events: DataFrame) -> DataFrame:
    """Process creations with integer ids; rows without both ids are skipped."""
    return events.filter(F.col("event_type") == "ProcessCreate").select(
        "run_id", "seq", "ts", as_int(fld(events, "ProcessId")).alias("pid"),
        as_int(fld(events, "ParentProcessId")).alias("ppid"),
        F.nullif(fld(events, "ProcessGuid"), F.lit("")).alias("guid"),
        F.nullif(fld(events, "ParentProcessGuid"), F.lit("")).alias("parent_guid"),
        basename(fld(events, "Image")).alias("image"),
    ).filter(F.col("pid").isNotNull() & F.col("ppid").isNotNull())


def root_guids(events: DataFrame, runs: DataFrame) -> DataFrame:
    """GUIDs of each run's root process; ``runs(run_id, root_pid, root_image)``.

    Best of three: incarnations whose image is the launcher, else the parent
    GUIDs its children name, else every GUID seen for the pid.
    """
    c = creates(events).filter(F.col("guid").isNotNull())
    r = runs.select("run_id", F.col("root_pid").cast("bigint").alias("root_pid"), basename(F.col("root_image")).alias("want"))
    # one pass: a create row can name the root itself, or its parent as the root
    cand = c.join(r, "run_id").select(
        "run_id",
        F.explode(F.array(
            F.struct(
                F.when((F.col("pid") == F.col("root_pid")) & (F.col("want") != "") & (F.col("image") == F.col("want")), 1)
                .when(F.col("pid") == F.col("root_pid"), 3).alias("step"),
                F.col("guid").alias("guid"),
            ),
            F.struct(
                F.when((F.col("ppid") == F.col("root_pid")) & F.col("parent_guid").isNotNull(), 2).alias("step"),
                F.col("parent_guid").alias("guid"),
            ),
        )).alias("x"),
    ).select("run_id", "x.step", "x.guid").filter(F.col("step").isNotNull()).distinct()
    # step 1 rows also count as "any GUID of the pid", harmless: step 1 wins whenever present
    best = cand.groupBy("run_id").agg(F.min("step").alias("best"))
    return cand.join(best, "run_id").filter(F.col("step") == F.col("best")).select("run_id", "guid").distinct()


def closure_guid(events: DataFrame, roots: DataFrame) -> DataFrame:
    """GUIDs descending from ``roots(run_id, guid)``, with depth."""
    edges = creates(events).filter(F.col("guid").isNotNull()).select(
        "run_id", F.col("parent_guid").alias("parent"), F.col("guid").alias("child")
    )
    return descend(edges, roots.select("run_id", F.col("guid").alias("node"))).withColumnRenamed("node", "guid")


def lineage_pids(events: DataFrame, guids: DataFrame, runs: DataFrame) -> DataFrame:
    """Pids of the in-tree GUIDs, plus each root pid."""
    own = creates(events).filter(F.col("guid").isNotNull()).groupBy("run_id", "guid").agg(
        F.max_by("pid", "seq").alias("pid")
    )
    return own.join(guids.select("run_id", "guid"), ["run_id", "guid"], "left_semi").select("run_id", "pid").unionByName(
        runs.select("run_id", F.col("root_pid").cast("bigint").alias("pid"))
    ).distinct()


def timed_edges(events: DataFrame, slack_s: float = 1.0) -> DataFrame:
    """Edges ppid -> pid, without children born after the parent's end (a reused pid)."""
    c = creates(events)
    born = c.filter(F.col("ts").isNotNull()).groupBy("run_id", "pid").agg(F.min_by("ts", "seq").alias("born"))
    died = (
        events.filter((F.col("event_type") == "ProcessTerminate") & F.col("ts").isNotNull())
        .select("run_id", as_int(fld(events, "ProcessId")).alias("ppid"), "ts")
        .groupBy("run_id", "ppid").agg(F.min("ts").alias("died"))
    )
    links = c.select("run_id", "ppid", "pid").distinct()
    late = two_valued(micros(F.col("born")) > micros(F.col("died")) + int(slack_s * 1_000_000))
    return (
        links.join(born, ["run_id", "pid"], "left").join(died, ["run_id", "ppid"], "left").filter(~late)
        .select("run_id", F.col("ppid").alias("parent"), F.col("pid").alias("child"))
    )


def closure_pid_timed(events: DataFrame, runs: DataFrame, slack_s: float = 1.0) -> DataFrame:
    """I4: fallback without GUIDs: pids reached from the root pid over time-checked edges."""
    seeds = runs.select("run_id", F.col("root_pid").cast("bigint").alias("node"))
    return descend(timed_edges(events, slack_s), seeds).withColumnRenamed("node", "pid")


def lineage(events: DataFrame, runs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both views of each run's lineage: ``(run_id, guid)`` and ``(run_id, pid)``."""
    roots = root_guids(events, runs)
    guids = closure_guid(events, roots).select("run_id", "guid")
    by_guid = lineage_pids(events, guids, runs.join(guids.select("run_id").distinct(), "run_id", "left_semi"))
    bare = runs.join(roots.select("run_id").distinct(), "run_id", "left_anti")
    by_time = closure_pid_timed(events, bare).select("run_id", "pid")
    return guids, by_guid.unionByName(by_time)


def processes(events: DataFrame) -> DataFrame:
    """One row per (run, pid): the latest create's facts, the latest end."""
    pid = as_int(fld(events, "ProcessId"))
    rows = events.filter(F.col("event_type").isin("ProcessCreate", "ProcessTerminate")).select(
        "run_id", pid.alias("pid"), "seq", "ts", (F.col("event_type") == "ProcessCreate").alias("created"),
        F.coalesce(as_int(fld(events, "ParentProcessId")), F.lit(0)).alias("ppid"),
        fld(events, "Image").alias("image"), fld(events, "CommandLine").alias("command_line"), fld(events, "User").alias("user"),
    ).filter(F.col("pid") >= 0)
    on_create = F.when(F.col("created"), F.col("seq"))
    facts = F.struct("ppid", "image", "command_line", F.col("ts").alias("start_time"), "user")
    return rows.groupBy("run_id", "pid").agg(
        F.max_by(facts, on_create).alias("c"),
        F.max_by("ts", F.when(~F.col("created"), F.col("seq"))).alias("end_time"),
        F.min_by("image", F.when(~F.col("created"), F.col("seq"))).alias("__img"),
    ).select(
        "run_id", "pid", "c.ppid", F.coalesce(F.col("c.image"), F.when(F.col("c").isNull(), F.col("__img"))).alias("image"),
        "c.command_line", "c.start_time", "c.user", "end_time",
    )


def parent_links(procs: DataFrame) -> DataFrame:
    """Parent pid of each process when it is a known other process, else NULL (a root)."""
    known = procs.select("run_id", F.col("pid").alias("__p"))
    hit = (procs["run_id"] == known["run_id"]) & (procs["ppid"] == known["__p"]) & (procs["ppid"] != 0) & (procs["ppid"] != procs["pid"])
    return procs.join(known, hit, "left").select(procs["*"], F.col("__p").alias("parent_pid"))


def process_tree(events: DataFrame) -> DataFrame:
    """Flat forest: process facts, parent link, depth and path from its root.

    Processes on a parent cycle have no root; they keep NULL depth and path.
    """
    nodes = parent_links(processes(events))
    nodes = cut(nodes, "procs")
    roots = nodes.filter(F.col("parent_pid").isNull()).select("run_id", F.col("pid").alias("node"))
    edges = nodes.select("run_id", F.col("parent_pid").alias("parent"), F.col("pid").alias("child"))
    reach = descend(edges, roots, with_path=True).withColumnRenamed("node", "pid")
    return nodes.join(reach, ["run_id", "pid"], "left")


def interesting_subtree(links: DataFrame, roots: DataFrame, marked: DataFrame) -> DataFrame:
    """Each root's subtree plus every marked process, all with their ancestors.

    ``links(run_id, pid, parent_pid)``, ``roots`` and ``marked`` are ``(run_id, pid)``.
    """
    edges = links.select("run_id", F.col("parent_pid").alias("parent"), F.col("pid").alias("child"))
    down = descend(edges, roots.select("run_id", F.col("pid").alias("node"))).select("run_id", "node")
    seeds = down.unionByName(marked.select("run_id", F.col("pid").alias("node"))).distinct()
    known = links.select("run_id", F.col("pid").alias("node"))
    up = ascend(links.select("run_id", F.col("pid").alias("node"), F.col("parent_pid").alias("parent")), seeds)
    return up.join(known, ["run_id", "node"], "left_semi").withColumnRenamed("node", "pid")


def in_lineage(rows: DataFrame, guids: DataFrame, pids: DataFrame, guid: Column, pid: Column) -> Column | DataFrame:
    """Adds ``__in``: by GUID when the row has one and its run has GUID lineage, else by pid."""
    g = guids.select(F.col("run_id").alias("__gr"), F.col("guid").alias("__g")).distinct()
    p = pids.select(F.col("run_id").alias("__pr"), F.col("pid").alias("__p")).distinct()
    has = guids.select(F.col("run_id").alias("__hr")).distinct()
    x = rows.withColumn("__guid", F.nullif(guid, F.lit(""))).withColumn("__pid", pid)
    # rows without an id match nothing; a key per input partition keeps them from meeting in one task
    part = F.spark_partition_id()
    x = x.withColumn("__gk", F.coalesce("__guid", F.concat(F.lit("\0"), part.cast("string")))).withColumn("__pk", F.coalesce("__pid", F.lit(-(1 << 62)) + part))
    x = x.join(g, (F.col("run_id") == F.col("__gr")) & (F.col("__gk") == F.col("__g")), "left")
    x = x.join(p, (F.col("run_id") == F.col("__pr")) & (F.col("__pk") == F.col("__p")), "left")
    x = x.join(has, F.col("run_id") == F.col("__hr"), "left")
    use_guid = F.col("__guid").isNotNull() & F.col("__hr").isNotNull()
    return x.withColumn("__in", F.when(use_guid, F.col("__g").isNotNull()).otherwise(F.col("__p").isNotNull())).drop(
        "__gr", "__g", "__pr", "__p", "__hr", "__guid", "__pid", "__gk", "__pk"
    )


def scope(alerts: DataFrame, guids: DataFrame, pids: DataFrame) -> DataFrame:
    """``in_scope`` of alerts; a preset value is kept, no usable id means false."""
    guid = F.coalesce(F.nullif(fld(alerts, "ProcessGuid"), F.lit("")), fld(alerts, "SourceProcessGuid"))
    pid = as_int(F.coalesce(F.nullif(fld(alerts, "ProcessId"), F.lit("")), fld(alerts, "SourceProcessId")))
    x = in_lineage(alerts, guids, pids, guid, pid)
    preset = F.col("in_scope") if "in_scope" in alerts.columns else F.lit(None).cast("boolean")
    return x.withColumn("in_scope", F.coalesce(preset, F.col("__in"))).drop("__in")


def dropped_files(events: DataFrame, guids: DataFrame, pids: DataFrame, tool_dir: str, max_files: int | None = None) -> DataFrame:
    """Distinct paths the lineage created outside the tool folder, in first-seen order.

    ``max_files`` is the feature's own cap per run (first N paths).
    """
    rows = events.filter(F.col("event_type") == "FileCreate").select(
        "run_id", "seq", fld(events, "ProcessGuid").alias("g"), as_int(fld(events, "ProcessId")).alias("p"),
        fld(events, "TargetFilename").alias("path"),
    ).filter(two_valued(F.col("path") != "") & ~F.lower("path").startswith(tool_dir.rstrip("\\").lower()))
    x = in_lineage(rows, guids, pids, F.col("g"), F.col("p")).filter("__in")
    first = x.groupBy("run_id", "path").agg(F.min("seq").alias("first_seq"))
    return _first_n(first, max_files)


def _first_n(df: DataFrame, n: int | None) -> DataFrame:
    if n is None:
        return df
    w = Window.partitionBy("run_id").orderBy("first_seq", *[c for c in df.columns if c not in ("run_id", "first_seq")])
    return df.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") <= n).drop("__rn")


def deleted_hashes(events: DataFrame, guids: DataFrame, pids: DataFrame, max_files: int | None = None) -> DataFrame:
    """I8: distinct md5/sha256 of files the lineage deleted; first occurrence kept.

    With ``max_files`` whole files are taken until that many hashes are reached
    (the count is looked at after each file), per run.
    """
    rows = events.filter(F.col("event_type") == "FileDelete").select(
        "run_id", "seq", fld(events, "ProcessGuid").alias("g"), as_int(fld(events, "ProcessId")).alias("p"),
        F.coalesce(fld(events, "TargetFilename"), F.lit("")).alias("path"), fld(events, "Hashes").alias("h"),
    )
    x = in_lineage(rows, guids, pids, F.col("g"), F.col("p")).filter("__in")
    parts = x.select("run_id", "seq", "path", F.posexplode(F.split(F.coalesce("h", F.lit("")), ",")).alias("pos", "part")).filter(
        F.col("part").contains("=")
    ).select(
        "run_id", "seq", "path", "pos", F.lower(F.trim(F.substring_index("part", "=", 1))).alias("algo"),
        F.lower(F.trim(F.regexp_replace("part", "^[^=]*=", ""))).alias("hash"),
    ).filter(F.col("algo").isin("md5", "sha256") & (F.col("hash") != ""))
    first = parts.groupBy("run_id", "hash").agg(
        F.min_by(F.struct("algo", "path", "seq"), F.struct("seq", "pos")).alias("f")
    ).select("run_id", "hash", "f.algo", "f.path", F.col("f.seq").alias("first_seq"))
    if max_files is None:
        return first
    # the first max_files hashes decide the last file that is still taken whole
    w = Window.partitionBy("run_id").orderBy("first_seq", "hash")
    last = first.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") <= max_files).groupBy("run_id").agg(
        F.max("first_seq").alias("__last")
    )
    return first.join(last, "run_id").filter(F.col("first_seq") <= F.col("__last")).drop("__last")
