"""Declarative call and fact signatures."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from detectframe import fixed
from detectframe.functions.leaf import two_valued
from detectframe.functions.scalar import KV_PATTERN_LOOSE, as_int, hex8, let, parse_kv
from detectframe.operators.joins import process_names
from detectframe.scale import any_true, fired, literal_table
from detectframe.schema import fld


def alias_table(spark, aliases: dict[str, list[str]] = fixed.API_ALIASES) -> DataFrame:
    return literal_table(spark, [(a, n) for a, names in aliases.items() for n in names], "api string, name string")


def alias_names(calls: DataFrame, aliases: DataFrame) -> DataFrame:
    """A call under every name a signature may use; unknown calls keep their own name."""
    return calls.join(aliases, "api", "left").withColumn("name", F.coalesce("name", "api"))


def accepted_names(wanted: list[str], aliases: dict[str, list[str]] = fixed.API_ALIASES) -> list[str]:
    """Trace names whose aliases meet the wanted names (so a filter can reach the scan)."""
    known = [a for a, names in aliases.items() if set(names) & set(wanted)]
    return sorted(set(known) | {w for w in wanted if w not in aliases})


def normalize_args(api: Column, arg: Column) -> Column:
    """Argument map with canonical names and formats next to the raw keys.

    Calls with a target get a handle: the self handle for same-process calls,
    the formatted target pid for cross-process ones.
    """
    text = F.coalesce(arg, F.lit(""))
    return let(parse_kv(text, KV_PATTERN_LOOSE), lambda kv: _named_args(api, text, kv))


def _named_args(api: Column, text: Column, kv: Column) -> Column:
    raw = F.element_at(F.map_keys(kv), 1) == "_raw"
    none = F.array().cast("array<struct<k:string,v:string>>")
    entry = lambda name, value: F.struct(F.lit(name).alias("k"), value.alias("v"))
    keyed, plain = None, None
    for call, spec in fixed.ARG_NAMES.items():
        known = F.filter(F.array(*[
            F.when(kv[key].isNotNull(), entry(name, hex8(kv[key]) if as_hex else kv[key])) for key, name, as_hex in spec
        ]), lambda x: x.isNotNull())
        whole = F.array(*[entry(name, text) for name in dict.fromkeys(n for _, n, _ in spec)])
        keyed = F.when(api == call, known) if keyed is None else keyed.when(api == call, known)
        plain = F.when(api == call, whole) if plain is None else plain.when(api == call, whole)
    canonical = F.when(raw, F.concat(F.coalesce(plain, none), F.array(entry("value", text)))).otherwise(F.coalesce(keyed, none))
    handle = F.when(kv["cross_process"] == "0", "0xffffffff").otherwise(hex8(kv["target_pid"]))
    targets = F.when(
        api.isin(fixed.TARGET_PID_APIS) & kv["target_pid"].isNotNull(),
        F.array(entry("ProcessHandle", handle), entry("ThreadHandle", handle), entry("ProcessIdentifier", kv["target_pid"])),
    ).otherwise(none)
    base = F.when(raw, none).otherwise(F.transform(F.map_entries(kv), lambda e: F.struct(e["key"].alias("k"), e["value"].alias("v"))))
    # a canonical name equal to a raw key is already there with the same value
    allp = F.concat(base, canonical, targets)
    entries = F.struct(F.transform(allp, lambda e: e["k"]).alias("k"), F.transform(allp, lambda e: e["v"]).alias("v"))
    return let(entries, lambda x: let(F.array_distinct(x["k"]), lambda names: F.map_from_arrays(
        names, F.transform(names, lambda n: F.get(x["v"], F.array_position(x["k"], n).cast("int") - 1)))))


@dataclass
class CallSpec:
    """A call signature: filters plus a predicate over ``api, category, process_name, args``."""

    name: str
    apis: list[str] = field(default_factory=list)
    categories: list[str] = field(default_factory=list)
    process_names: list[str] = field(default_factory=list)
    where: Column | None = None
    severity: int = 1
    description: str = ""
    order: int = 0


def call_rows(events: DataFrame) -> DataFrame:
    """Calls with pid, category, process name and canonical arguments; own-child spawn writes are left out."""
    cats = F.create_map(*[F.lit(x) for kv in fixed.CALL_CATEGORIES.items() for x in kv])
    api = fld(events, "Api")
    t = events.filter((F.col("source") == "apitrace") & (F.col("event_type") == "ApiCall") & ~two_valued(api.startswith("__"))).select(
        "run_id", "seq", as_int(fld(events, "ProcessId")).alias("pid"), api.alias("api"),
        F.coalesce(cats[F.coalesce(fld(events, "Category"), F.lit(""))], F.lit("misc")).alias("category"), fld(events, "Arg0").alias("arg"),
    ).filter(F.col("pid").isNotNull())
    t = t.select("*", F.explode(F.array(normalize_args(F.col("api"), F.col("arg")))).alias("args"))
    return drop_spawn_calls(t, spawned(events, t)).join(process_names(events), ["run_id", "pid"], "left").withColumn(
        "process_name", F.coalesce("process_name", F.lit("")))


def spawned(events: DataFrame, t: DataFrame) -> DataFrame:
    """(run, pid, child, born): earliest sight of each child, from creations and from the trace itself."""
    digits = lambda c: F.when(c.rlike("^[0-9]+$"), c.try_cast("bigint"))
    a = events.filter(F.col("event_type") == "ProcessCreate").select(
        "run_id", as_int(fld(events, "ParentProcessId")).alias("pid"), as_int(fld(events, "ProcessId")).alias("child"), "seq")
    b = t.filter(F.col("api").isin("CreateProcessW", "NtCreateUserProcess")).select("run_id", "pid", digits(F.col("args")["child_pid"]).alias("child"), "seq")
    return a.unionByName(b).filter(two_valued(F.col("pid") != 0) & two_valued(F.col("child") != 0)).groupBy("run_id", "pid", "child").agg(F.min("seq").alias("born"))


def drop_spawn_calls(t: DataFrame, kids: DataFrame) -> DataFrame:
    """E6 for the call stream: writes and resumes on a child the actor had already created."""
    target = F.when(F.col("api").isin("NtWriteVirtualMemory", "NtResumeThread"), F.col("args")["target_pid"].try_cast("bigint"))
    x = t.withColumn("child", target).join(kids, ["run_id", "pid", "child"], "left")
    return x.filter(~two_valued(F.col("born") < F.col("seq"))).drop("child", "born")


def _matches(s: CallSpec) -> Column:
    cond = F.lit(True)
    if s.apis:
        cond = cond & F.col("api").isin(accepted_names(s.apis))
    if s.categories:
        cond = cond & F.col("category").isin(s.categories)
    if s.process_names:
        cond = cond & F.lower("process_name").isin([p.lower() for p in s.process_names])
    return two_valued(cond if s.where is None else cond & s.where)


def call_signature(calls: DataFrame, specs: list[CallSpec]) -> DataFrame:
    """First matching call of each (run, signature); every spec in one projection."""
    names = sorted({a for s in specs for a in accepted_names(s.apis)}) if all(s.apis for s in specs) else None
    rows = calls.filter(F.col("api").isin(names)) if names else calls
    hits = rows.select("run_id", "pid", "seq", "api", F.explode(fired([(_matches(s), F.lit(s.name)) for s in specs])).alias("signature"))
    return hits.groupBy("run_id", "signature").agg(F.min_by(F.struct("seq", "pid", "api"), "seq").alias("e")).select(
        "run_id", "signature", F.col("e.seq").alias("first_seq"), F.col("e.pid").alias("pid"), F.col("e.api").alias("api"))


def run_facts(events: DataFrame, pids: DataFrame | None = None) -> DataFrame:
    """In-scope facts of each run as distinct rows ``(run_id, kind, value)``.

    Rows instead of one array per run: a run's list has no bound.
    """
    cr = events.filter(F.col("event_type") == "ProcessCreate").select(
        "run_id", as_int(fld(events, "ProcessId")).alias("pid"), F.lit("executed_commands").alias("kind"), fld(events, "CommandLine").alias("value"))
    t = events.filter((F.col("source") == "apitrace") & (F.col("event_type") == "ApiCall")).select(
        "run_id", as_int(fld(events, "ProcessId")).alias("pid"), fld(events, "Api").alias("api"), F.coalesce(fld(events, "Arg0"), F.lit("")).alias("arg")
    ).filter(F.col("pid").isNotNull() & F.col("api").isin("NtCreateFile", "CreateFileW", "NtSetValueKey", "CreateProcessW"))
    t = t.select("*", F.explode(F.array(normalize_args(F.col("api"), F.col("arg")))).alias("args"))
    args = F.col("args")
    some = lambda name: F.coalesce(F.nullif(args[name], F.lit("")), F.col("arg"))
    kind = F.when(F.col("api").isin("NtCreateFile", "CreateFileW"), F.array(F.lit("files"))).when(
        F.col("api") == "NtSetValueKey", F.array(F.lit("keys"), F.lit("write_keys"))).otherwise(F.array(F.lit("executed_commands")))
    value = F.when(F.col("api") == "NtSetValueKey", some("ValueName")).when(F.col("api") == "CreateProcessW", F.col("arg")).otherwise(some("FilePath"))
    c = t.select("run_id", "pid", F.explode(kind).alias("kind"), value.alias("value"))
    rows = cr.unionByName(c).filter(two_valued(F.col("value") != ""))
    if pids is not None:
        # scoping applies only to runs that have a lineage
        p = pids.select("run_id", "pid").distinct()
        x = rows.join(p.select("run_id").distinct().withColumn("__has", F.lit(True)), "run_id", "left").join(
            p.withColumn("__in", F.lit(True)), ["run_id", "pid"], "left")
        rows = x.filter(~two_valued(F.col("__has")) | two_valued(F.col("__in")))
    return rows.select("run_id", "kind", "value").distinct()


@dataclass
class FactSpec:
    """A fact signature: regexes anchored at the start (case-folded) or exact texts."""

    name: str
    kind: str
    patterns: list[str]
    regex: bool = True
    cased: bool = False
    severity: int = 1
    description: str = ""


def _fact_test(s: FactSpec, value: Column) -> Column:
    if s.regex:
        return any_true([two_valued(value.rlike(f"(?iud)^(?:{p})")) for p in s.patterns])
    if s.cased or s.kind == "mutexes":
        return value.isin(s.patterns)
    return F.lower(value).isin([p.lower() for p in s.patterns])


def fact_signature(facts: DataFrame, specs: list[FactSpec]) -> DataFrame:
    """P5: (run, signature) with the smallest matching fact as evidence."""
    kinds = sorted({s.kind for s in specs})
    hits = facts.filter(F.col("kind").isin(kinds)).select("run_id", "value", F.explode(fired([
        ((F.col("kind") == s.kind) & _fact_test(s, F.col("value")), F.lit(s.name)) for s in specs])).alias("signature"))
    return hits.groupBy("run_id", "signature").agg(F.min("value").alias("evidence"))


def meta_signature(matches: DataFrame, name: str, needs: list[str], at_least: int | None = None) -> DataFrame:
    """Fires for runs whose earlier matches include enough of ``needs``."""
    n = len(needs) if at_least is None else at_least
    return matches.filter(F.col("signature").isin(needs)).select("run_id", "signature").distinct().groupBy("run_id").agg(
        F.count("*").alias("n")).filter(F.col("n") >= n).select("run_id", F.lit(name).alias("signature"))


def emit_match(matches: DataFrame, specs: DataFrame, min_severity: int = 1, score: bool = True, scoping: bool = False) -> DataFrame:
    """Alerts of the matches at or above the severity floor; ``specs(signature, severity, description)``."""
    levels = F.create_map(*[F.lit(x) for kv in fixed.SIGNATURE_LEVELS.items() for x in kv])
    sev = F.coalesce("severity", F.lit(1))
    pid = fld(matches, "pid")
    return matches.join(specs, "signature").filter(sev >= min_severity).select(
        "run_id", F.lit(9300).alias("event_id"), F.lit("CapeSignature").alias("event_type"), F.lit("cape").alias("source"),
        F.col("signature").alias("Name"), F.coalesce("description", F.lit("")).alias("Description"), pid.cast("bigint").alias("ProcessId"),
        F.coalesce(levels[sev], F.lit("low")).alias("SeverityStr"), F.lit(score).alias("cape_score"),
        F.when(pid.isNull() & F.lit(scoping), F.lit(True)).alias("in_scope"))


def spec_table(spark, specs: list) -> DataFrame:
    return literal_table(spark, [(s.name, s.severity, s.description) for s in specs], "signature string, severity int, description string")


def user_predicate(fn):
    """A vectorized row predicate: ``fn(pd.Series, ...) -> pd.Series`` of bool."""
    return F.pandas_udf(fn, "boolean")


def per_process(calls: DataFrame, on_calls, schema: str, cols: list[str], merge, chunk: int = 100_000) -> DataFrame:
    """A user's own signature over all calls of a process, in order.

    ``on_calls(pdf) -> pdf`` sees ``chunk`` consecutive ``seq`` values of one process, in order, so no group is
    unbounded; the rows it returns (of ``schema``) carry the state of the stretch.  ``merge(pdf) -> pdf`` sees
    the rows of all stretches of a process, in order of the stretches and as they were returned within one, and
    returns the rows of the process.
    """
    extra = [c for c in cols if c not in ("run_id", "pid", "seq")]
    x = calls.select("run_id", "pid", "seq", *extra).withColumn("chunk", F.floor(F.col("seq") / chunk))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        found = on_calls(pdf.sort_values("seq")).reset_index(drop=True)
        return found.assign(__run=key[0], __pid=key[1], __chunk=key[2], __nth=range(len(found)))

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        return merge(pdf.sort_values(["__chunk", "__nth"], ignore_index=True).drop(columns=["__run", "__pid", "__chunk", "__nth"]))

    kinds = dict(x.dtypes)
    parts = x.groupBy("run_id", "pid", "chunk").applyInPandas(run, f"{schema}, __run {kinds['run_id']}, __pid {kinds['pid']}, __chunk {kinds['chunk']}, __nth bigint")
    return parts.groupBy("__run", "__pid").applyInPandas(whole, schema)


class CallSignature:
    """Base of a user's own signature as a table function: one object per process, fed call by call.

    Subclasses override ``on_call(row)`` and, for what is told at the end, ``on_complete()``; both may yield rows.
    ``start()`` sets the state up.  A call is seen and gone, so memory is what the signature keeps.
    """

    def start(self) -> None:
        pass

    def on_call(self, row):
        return ()

    def on_complete(self):
        return ()

    def __init__(self):
        self.start()

    def eval(self, row):
        yield from self.on_call(row)

    def terminate(self):
        yield from self.on_complete()


def run_signature(calls: DataFrame, signature: type[CallSignature], schema: str, name: str) -> DataFrame:
    """The signature over every process of ``calls(run_id, pid, seq, ...)``, in order of ``seq``, as a table function.

    It is registered under ``name``, so SQL can use it too:
    ``SELECT * FROM name(TABLE(calls) PARTITION BY (run_id, pid) ORDER BY seq)``.
    """
    spark = calls.sparkSession
    spark.udtf.register(name, F.udtf(signature, returnType=schema))
    view = f"__{name}_{uuid.uuid4().hex}"
    calls.createOrReplaceTempView(view)
    return spark.sql(f"SELECT * FROM {name}(TABLE({view}) PARTITION BY (run_id, pid) ORDER BY seq)")


def keyword_spans(text: Column, words: list[str]) -> Column:
    """Table-function form: ``explode`` this to get (word, count) rows of a text."""
    return F.filter(
        F.array(*[F.struct(F.lit(w).alias("word"), F.regexp_count(text, F.lit(f"(?i)\\b{w}\\b")).alias("n")) for w in words]),
        lambda s: s["n"] > 0,
    )
