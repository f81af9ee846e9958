"""Readers and writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from detectframe import fixed
from detectframe.functions.leaf import two_valued
from detectframe.functions.scalar import parse_time
from detectframe.sources.normalize import classify_event_id

RAW_EVENT = (
    "run_id string, source string, provider_name string, event_id int, timestamp string, computer string, "
    "event_type string, data map<string,string>, _corrupt_record string"
)


def file_name(path: Column) -> Column:
    return F.regexp_replace(F.substring_index(path, "/", -1), r"\.[^.]*$", "")


def line_seq() -> Column:
    """Position of a line in its file, increasing and unique per file.

    A split's rows are numbered in order and a line has at least one byte, so
    split start plus row number never reaches the next split's start.
    """
    return F.col("_metadata.file_block_start") + F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))


def read_raw_events(spark: SparkSession, path: str) -> DataFrame:
    """All non-blank lines; malformed ones have ``_corrupt_record`` set."""
    text = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file_path"), line_seq().alias("seq"))
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}
    parsed = text.filter(F.trim("value") != "").withColumn("e", F.from_json("value", RAW_EVENT, options))
    return parsed.select("file_path", "seq", "e.*")


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """A1: JSON lines to events; blank and malformed lines are skipped.

    ``run_id`` is the line's own or the file's name.
    """
    raw = read_raw_events(spark, path)
    return raw.filter(F.col("_corrupt_record").isNull()).select(
        F.coalesce("run_id", file_name(F.col("file_path"))).alias("run_id"), "seq", "source", "provider_name", "event_id",
        parse_time(F.coalesce("timestamp", F.col("data")["UtcTime"])).alias("ts"), "computer", "event_type", "data",
    )


def count_malformed(spark: SparkSession, path: str) -> DataFrame:
    """A1: malformed lines per file."""
    return read_raw_events(spark, path).groupBy("file_path").agg(F.count("*").alias("n_lines"), F.count("_corrupt_record").alias("n_malformed"))


XML_EVENT = (
    "System struct<EventID:struct<_VALUE:string>,TimeCreated:struct<_SystemTime:string>,Computer:string,"
    "Provider:struct<_Name:string>>, EventData struct<Data:array<struct<_Name:string,_VALUE:string>>>"
)


def read_winevent_xml(spark: SparkSession, path: str, source: str) -> DataFrame:
    """A2: ``<Event>`` XML to events; named data fields become the map, a missing id is 0.

    Files hold one ``<Events>`` root or bare ``<Event>`` elements.  The closing tag
    is the record separator, so a large export is split between tasks like text.
    """
    raw = spark.read.option("lineSep", "</Event>").text(path).select(
        F.regexp_extract("value", r"(?s)<Event[\s>].*", 0).alias("x"), F.col("_metadata.file_path").alias("file_path"), line_seq().alias("seq")
    ).filter(F.col("x") != "")
    raw = raw.withColumn("e", F.from_xml(F.concat("x", F.lit("</Event>")), XML_EVENT))
    named = F.filter(F.coalesce("e.EventData.Data", F.array().cast("array<struct<_Name:string,_VALUE:string>>")), lambda d: two_valued(d["_Name"] != ""))
    # a name given twice keeps its last value
    keys = F.reverse(F.transform(named, lambda d: d["_Name"]))
    vals = F.reverse(F.transform(named, lambda d: d["_VALUE"]))
    names = F.array_distinct(keys)
    data = F.map_from_arrays(names, F.transform(names, lambda k: F.get(vals, F.array_position(keys, k).cast("int") - 1)))
    event_id = F.coalesce(F.trim(F.col("e.System.EventID._VALUE")).try_cast("int"), F.lit(0))
    x = raw.filter(F.col("e.System").isNotNull()).select(
        file_name(F.col("file_path")).alias("run_id"), "seq", F.lit(source).alias("source"),
        F.col("e.System.Provider._Name").alias("provider_name"), event_id.alias("event_id"),
        parse_time(F.col("e.System.TimeCreated._SystemTime")).alias("ts"), F.col("e.System.Computer").alias("computer"), data.alias("data"),
    )
    typed = x.withColumn("event_type", classify_event_id(F.col("source"), F.col("event_id")))
    return typed.select("run_id", "seq", "source", "provider_name", "event_id", "ts", "computer", "event_type", "data")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Manifest lines (sha256, family); the family falls back to the folder's name."""
    raw = spark.read.schema("sha256 string, family string, _corrupt_record string").option("mode", "PERMISSIVE").json(path)
    folder = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1)
    x = raw.select("sha256", F.coalesce(F.nullif("family", F.lit("")), folder).alias("family"), "_corrupt_record")
    return x.filter(F.col("_corrupt_record").isNull() & two_valued(F.col("sha256") != "")).select(F.lower("sha256").alias("sha256"), "family")


def labels_from_manifest(runs: DataFrame, manifest: DataFrame, labels: DataFrame) -> DataFrame:
    """Labels of manifest samples that have a run and no label yet (idempotent)."""
    known = labels.filter(F.col("match_kind") == "sha256").select(F.lower("match_value").alias("sha256"))
    m = manifest.groupBy("sha256").agg(F.max("family").alias("family"))
    new = m.join(runs.select(F.lower("sha256").alias("sha256")), "sha256", "left_semi").join(known, "sha256", "left_anti")
    return new.select(F.lit("sha256").alias("match_kind"), F.col("sha256").alias("match_value"), F.lit("malicious").alias("label"), "family")


STIX = (
    "objects array<struct<type:string,id:string,name:string,revoked:boolean,x_mitre_deprecated:boolean,relationship_type:string,"
    "source_ref:string,target_ref:string,external_references:array<struct<source_name:string,external_id:string>>,"
    "kill_chain_phases:array<struct<kill_chain_name:string,phase_name:string>>>>"
)


def read_stix(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(STIX).option("multiLine", True).json(path).select(F.explode("objects").alias("o")).select("o.*")


def _external() -> Column:
    mine = F.filter("external_references", lambda r: r["source_name"] == "mitre-attack")
    return F.get(F.transform(mine, lambda r: r["external_id"]), F.lit(0))


def attack_techniques(objects: DataFrame) -> DataFrame:
    """Technique id, name, tactics of live techniques; ``objects`` as from :func:`read_stix`."""
    dead = two_valued(F.col("revoked")) | two_valued(F.col("x_mitre_deprecated"))
    tactics = F.transform(F.filter("kill_chain_phases", lambda p: p["kill_chain_name"] == "mitre-attack"), lambda p: p["phase_name"])
    return objects.filter((F.col("type") == "attack-pattern") & ~dead).select(
        _external().alias("technique_id"), "name", F.coalesce(tactics, F.array().cast("array<string>")).alias("tactics")
    ).filter(F.col("technique_id").startswith("T"))


def family_techniques(objects: DataFrame, families: DataFrame) -> DataFrame:
    """(family, attack_id, technique) over software -uses-> technique; ``families(family, attack_name)``."""
    tech = objects.filter(F.col("type") == "attack-pattern").select(F.col("id").alias("target_ref"), _external().alias("technique")).filter(F.col("technique").isNotNull())
    soft = objects.filter(F.col("type").isin("malware", "tool")).select(F.col("id").alias("source_ref"), F.lower("name").alias("__n"), _external().alias("attack_id"))
    uses = objects.filter((F.col("type") == "relationship") & (F.col("relationship_type") == "uses")).select("source_ref", "target_ref")
    fam = families.select("family", F.lower("attack_name").alias("__n")).join(soft, "__n")
    return fam.join(uses, "source_ref").join(tech, "target_ref").select("family", "attack_id", "technique").distinct()


def vendor_filter(rules: DataFrame, included: list[str], excluded: list[str], status=tuple(fixed.RULE_STATUS_KEPT)) -> DataFrame:
    """Rules of included folders with a reason: kept, status or correlation.

    ``rules(path, status, is_correlation)``; folders are relative prefixes.
    """
    under = lambda d: (F.col("path") == d) | F.col("path").startswith(d.rstrip("/") + "/")
    inside, outside = F.lit(False), F.lit(False)
    for d in included:
        inside = inside | under(d)
    for d in excluded:
        outside = outside | under(d)
    reason = F.when(two_valued(F.col("is_correlation")), "correlation").when(~F.lower(F.coalesce("status", F.lit("test"))).isin(list(status)), "status").otherwise("kept")
    return rules.filter(inside & ~outside).withColumn("reason", reason)


def vendor_counts(filtered: DataFrame) -> DataFrame:
    """Rules per reason."""
    return filtered.groupBy("reason").agg(F.count("*").alias("n"))


def run_summary(runs: DataFrame, events: DataFrame, alerts: DataFrame, verdicts: DataFrame) -> DataFrame:
    """One row per run, so listings never read events.  Sides are aggregated before joining."""
    e = events.groupBy("run_id").agg(F.count("*").alias("total_events"))
    a = alerts.groupBy("run_id").agg(F.count("*").alias("alert_count"), F.count_if(two_valued(F.col("event_id") == 25)).alias("tampering_count"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return runs.join(e, "run_id", "left").join(a, "run_id", "left").join(verdicts.select("run_id", "score", "level"), "run_id", "left").select(
        "run_id", "ts", "filename", F.substring(F.coalesce("sha256", F.lit("")), 1, 12).alias("sha256_short"), "status",
        zero("total_events"), zero("alert_count"), zero("tampering_count"), F.col("level").alias("verdict_level"), F.col("score").alias("verdict_score"))


def run_identity(runs: DataFrame) -> DataFrame:
    """The four identity columns; column pruning keeps the rest unread."""
    return runs.select("run_id", "sha256", "filename", "ts")


def write_run(df: DataFrame, path: str, buckets: int = 64, spread: int = 8, mode: str = "append") -> None:
    """Store a per-run table.

    Runs are grouped in ``run_bucket`` folders (a folder per run would be millions
    of small files); each bucket is spread over several tasks, so one run that
    holds most rows is written in parallel.  Rows are sorted by run inside a file,
    so Parquet statistics prune a lookup to few row groups.
    """
    x = df.withColumn("run_bucket", F.pmod(F.hash("run_id"), F.lit(buckets)))
    salted = x.withColumn("__s", F.pmod(F.xxhash64(*[c for c in ("run_id", "seq") if c in df.columns]), F.lit(spread)))
    salted.repartition("run_bucket", "__s").drop("__s").sortWithinPartitions("run_bucket", "run_id").write.mode(mode).partitionBy("run_bucket").parquet(path)


def read_run(spark: SparkSession, path: str, run_id: str, buckets: int = 64) -> DataFrame:
    """One run of a stored table: partition pruning by bucket, then row groups by id."""
    bucket = spark.range(1).select(F.pmod(F.hash(F.lit(run_id)), F.lit(buckets)).alias("b"))
    b = bucket.first()["b"]
    return spark.read.parquet(path).filter((F.col("run_bucket") == b) & (F.col("run_id") == run_id)).drop("run_bucket")

