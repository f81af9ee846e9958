"""URL filters: host-suffix and path-prefix expressions, joined with rules on short hash prefixes.

Every distinct (host, path) is expanded into the rule texts that could fit it: all label suffixes of the
host times the prefixes of the path, at the prefix lengths that occur among the rules.  Expressions meet the
rules in an equi-join on the first 8 hexadecimal digits of their SHA-256, the full digest confirms, and the
longest rule wins (equal length: the longer host, then ``block``).

A NULL url, or one without ``://``, has an empty host and path and fits no rule.  Repeated rows are judged
alike.  Of the table only ``page_id`` and ``url`` are read.  An empty table or rule list gives a defined
result: no rows, or the default verdict.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from detectframe.scale import MAX_LITERAL_ROWS

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULE_SCHEMA = "host string, path string, verdict string"
#: Copies of a rule table that is too large to broadcast, so that a frequent expression is split.
SALTS = 16


def url_parts(url):
    """Columns (host, path) of a url column."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(`url`, instr(`url`, '://') + 3)")).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER)
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def expressions(urls: DataFrame, lengths: list[int]) -> DataFrame:
    """``(host, path)`` -> one row per host suffix and path prefix with its digest."""
    suffixes = F.transform(F.sequence(F.lit(1), F.size(F.split("host", "\\."))), lambda k: F.call_function("substring_index", F.col("host"), F.lit("."), -k))
    prefixes = F.transform(
        F.filter(F.array(*[F.lit(x) for x in lengths]), lambda n: n <= F.char_length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n)
    )
    return (
        urls.select("host", "path", F.explode(suffixes).alias("h"), prefixes.alias("p"))
        .select("host", "path", "h", F.explode("p").alias("p"))
        .select("host", "path", F.sha2(F.concat("h", "p").cast("binary"), 256).alias("digest"))
        .withColumn("short", F.substring("digest", 1, 8))
    )


def url_verdicts(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """``page_id, host, path, rule, verdict`` for every page.

    ``rules`` has ``host``, ``path`` (starting with ``/``) and ``verdict``.  Up to ``MAX_LITERAL_ROWS`` rules
    are counted and broadcast; more are joined by a shuffle on a salted key.  Path lengths of the rules are
    collected: there are no more of them than the longest path has characters.
    """
    rules = rules.select(
        F.translate("host", UPPER, LOWER).alias("rule_host"), F.col("path").alias("rule_path"), F.col("verdict").alias("rule_verdict")
    ).where("rule_host IS NOT NULL AND rule_path IS NOT NULL")
    rules = rules.withColumn("rule", F.concat("rule_host", "rule_path")).withColumn("digest", F.sha2(F.col("rule").cast("binary"), 256))
    rules = rules.withColumn("short", F.substring("digest", 1, 8)).dropDuplicates(["rule_host", "rule_path", "rule_verdict"])
    lengths = sorted(r[0] for r in rules.select(F.char_length("rule_path")).distinct().collect())
    host, path = url_parts(F.col("url"))
    urls = pages.select("page_id", F.col("url").cast("string").alias("url")).select("page_id", host.alias("host"), path.alias("path"))
    if not lengths:
        return urls.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    found = expressions(urls.select("host", "path").distinct(), lengths)
    if rules.limit(MAX_LITERAL_ROWS + 1).count() <= MAX_LITERAL_ROWS:
        met = found.join(F.broadcast(rules), "short")
    else:
        salted = rules.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = found.withColumn("salt", F.pmod(F.xxhash64("host", "path"), F.lit(SALTS)).cast("int")).join(salted, ["short", "salt"])
    best = met.where(found["digest"] == rules["digest"]).groupBy("host", "path").agg(
        F.max_by(
            F.struct("rule", F.col("rule_verdict").alias("verdict")),
            F.struct(F.char_length("rule"), F.char_length("rule_host"), F.col("rule_verdict") == "block"),
        ).alias("best")
    )
    return urls.join(best, ["host", "path"], "left").select(
        "page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict")
    )


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Rules given as ``(host, path, verdict)``."""
    return spark.createDataFrame(rules, RULE_SCHEMA)
