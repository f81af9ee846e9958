"""Detection-quality measurement over ``scored`` runs.

``scored(id, label, family, predicted, score)``: true label malicious/benign and
predicted band.  Everything reduces to a handful of counters in one pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from detectframe import fixed
from detectframe.functions.leaf import two_valued
from detectframe.operators.scoring import level_of

LOOSE = ["malicious", "suspicious"]


def _boundary() -> Column:
    return (F.col("label") == "benign") & two_valued(F.col("family") == fixed.BOUNDARY_FAMILY)


def confusion(scored: DataFrame) -> DataFrame:
    """Runs per true label and predicted band."""
    g = scored.groupBy("label").pivot("predicted", fixed.BANDS).count()
    return g.select("label", *[F.coalesce(b, F.lit(0)).alias(b) for b in fixed.BANDS])


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Bounds of the score interval of k/n, clamped to [0, 1]; NULL for n = 0."""
    n_ = F.nullif(n.cast("double"), F.lit(0.0))
    p = k / n_
    denom = 1 + z * z / n_
    center = (p + z * z / (2 * n_)) / denom
    margin = (z / denom) * F.sqrt((p * (1 - p) / n_) + z * z / (4 * n_ * n_))
    low = F.when(n_.isNotNull(), F.greatest(F.lit(0.0), center - margin))
    high = F.when(n_.isNotNull(), F.least(F.lit(1.0), center + margin))
    return low, high


def with_rates(counts: DataFrame) -> DataFrame:
    """Precision, recall, FPR and F1 from tp, fp, fn, tn; undefined values are NULL."""
    d = lambda a, b: F.col(a) / F.nullif((F.col(a) + F.col(b)).cast("double"), F.lit(0.0))
    x = counts.withColumn("precision", d("tp", "fp")).withColumn("recall", d("tp", "fn")).withColumn("fpr", d("fp", "tn"))
    p, r = F.col("precision"), F.col("recall")
    return x.withColumn("f1", F.when((p > 0) & (r > 0), 2 * p * r / (p + r)))


def rates(scored: DataFrame) -> DataFrame:
    """Rates at both thresholds; boundary goodware is left out of the looser one."""
    bad, strict = F.col("label") == "malicious", F.col("predicted") == "malicious"
    loose, edge = F.col("predicted").isin(LOOSE), _boundary()
    row = lambda name, hit, take: F.struct(
        F.lit(name).alias("threshold"), F.count_if(take & bad & hit).alias("tp"), F.count_if(take & ~bad & hit).alias("fp"),
        F.count_if(take & bad & ~hit).alias("fn"), F.count_if(take & ~bad & ~hit).alias("tn"))
    # one aggregation, two rows
    g = scored.filter(F.col("predicted").isNotNull()).agg(
        row("malicious-only", strict, F.lit(True)).alias("a"), row("suspicious-or-worse", loose, ~edge).alias("b")
    ).select(F.explode(F.array("a", "b")).alias("r")).select("r.*")
    return with_rates(g)


def rates_with_intervals(scored: DataFrame) -> DataFrame:
    """N2+N3."""
    x = rates(scored)
    for name, k, n in (("precision", "tp", F.col("tp") + F.col("fp")), ("recall", "tp", F.col("tp") + F.col("fn")), ("fpr", "fp", F.col("fp") + F.col("tn"))):
        low, high = wilson(F.col(k), n)
        x = x.withColumn(f"{name}_low", low).withColumn(f"{name}_high", high)
    return x


def family_detection(scored: DataFrame) -> DataFrame:
    """Malicious runs and detected ones per family."""
    return scored.filter((F.col("label") == "malicious") & F.col("predicted").isNotNull()).groupBy(
        F.coalesce(F.nullif("family", F.lit("")), F.lit("unlabeled")).alias("family")
    ).agg(F.count("*").alias("total"), F.count_if(F.col("predicted").isin(LOOSE)).alias("detected"))


def boundary_violations(scored: DataFrame) -> DataFrame:
    """Boundary goodware that reached the top band."""
    return scored.filter(_boundary() & (F.col("predicted") == "malicious"))


def boundary_counts(scored: DataFrame) -> DataFrame:
    """Boundary goodware per outcome."""
    p = F.col("predicted")
    return scored.filter(_boundary() & p.isNotNull()).agg(
        F.count("*").alias("total"), F.count_if(p == "suspicious").alias("suspicious_ok"), F.count_if(p == "clean").alias("clean"),
        F.count_if(p == "malicious").alias("violations"))


def fp_drivers(scored: DataFrame, reasons: DataFrame) -> DataFrame:
    """Reasons on flagged neutral benign runs, counted; ``reasons(id, reason)``."""
    flagged = scored.filter((F.col("label") == "benign") & ~_boundary() & F.col("predicted").isin(LOOSE)).select("id")
    return reasons.join(flagged, "id", "left_semi").groupBy("reason").agg(F.count("*").alias("n"))


def threshold_sweep(scores: DataFrame) -> DataFrame:
    """Rates at the strict threshold of every grid point.

    Scores are integers of a fixed range, so they are first reduced to a
    histogram (at most 101 x labels rows); the grid is exploded over that, never
    over the runs.
    """
    hist = scores.groupBy("score", "label").agg(F.count("*").alias("n"))
    grid = [(m, s) for m in range(15, 71, 5) for s in range(5, m, 5)]
    points = F.array(*[F.struct(F.lit(m).alias("malicious"), F.lit(s).alias("suspicious")) for m, s in grid])
    x = hist.select("*", F.explode(points).alias("g")).select("score", "label", "n", "g.malicious", "g.suspicious")
    bad, hit = F.col("label") == "malicious", F.col("score") >= F.col("malicious")
    s = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    return with_rates(x.groupBy("malicious", "suspicious").agg(
        s(bad & hit).alias("tp"), s(~bad & hit).alias("fp"), s(bad & ~hit).alias("fn"), s(~bad & ~hit).alias("tn")))


def best_threshold(sweep: DataFrame, fpr_budget: float = 0.10) -> DataFrame:
    """Best F1 within the FPR budget; ties to the lower malicious cutoff, then the lower suspicious one."""
    ok = F.col("f1").isNotNull() & (F.col("fpr").isNull() | (F.col("fpr") <= fpr_budget))
    order = F.struct("f1", -F.col("malicious"), -F.col("suspicious"))
    cols = ["malicious", "suspicious", "f1", "precision", "recall", "fpr"]
    return sweep.filter(ok).agg(F.max_by(F.struct(*cols), order).alias("b")).filter(F.col("b").isNotNull()).select("b.*")


def stratum(label: Column, family: Column) -> Column:
    return F.concat_ws("|", F.coalesce(label, F.lit("?")), F.coalesce(F.nullif(family, F.lit("")), F.lit("unlabeled")))


#: Digits of the order hash that are counted at once when a stratum is split.
_PREFIX = 4


def stratified_split(
    labels: DataFrame, frozen: DataFrame, seed=fixed.SPLIT_SEED, ratio=fixed.SPLIT_TEST_RATIO, min_stratum=fixed.SPLIT_MIN_STRATUM
) -> DataFrame:
    """New keys assigned to train/test per stratum in hash order; assigned keys never move.

    ``labels(key, label, family)``, ``frozen(key, split)``.  A rank inside a huge
    stratum would be one task, so the cut is found in two steps: counts per hash
    prefix locate the prefix that holds the last test key, and only keys of that
    prefix are ranked.
    """
    # repeated keys stay, as in a list of labels; they take their places one by one
    rows = labels.filter(two_valued(F.col("key") != "")).join(frozen, "key", "left_anti")
    rows = rows.select("key", stratum(F.col("label"), F.col("family")).alias("stratum"))
    h = F.sha2(F.concat_ws("|", F.lit(seed), F.col("stratum"), F.col("key")), 256)
    rows = rows.withColumn("h", h).withColumn("p", F.substring("h", 1, _PREFIX))
    counts = rows.groupBy("stratum", "p").agg(F.count("*").alias("c"))
    total = counts.groupBy("stratum").agg(F.sum("c").alias("n")).withColumn(
        "n_test", F.when(F.col("n") < min_stratum, 0).otherwise(F.greatest(F.lit(1), F.bround(F.col("n") * ratio).cast("bigint"))))
    # at most 16^4 prefix rows per stratum
    w = Window.partitionBy("stratum").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.join(total, "stratum").withColumn("before", F.coalesce(F.sum("c").over(w), F.lit(0)))
    x = rows.join(before, ["stratum", "p"])
    edge = (F.col("before") < F.col("n_test")) & (F.col("before") + F.col("c") > F.col("n_test"))
    ranked = x.filter(edge).withColumn("r", F.row_number().over(Window.partitionBy("stratum", "p").orderBy("h", "key")))
    ranked = ranked.select("key", "stratum", F.when(F.col("before") + F.col("r") <= F.col("n_test"), "test").otherwise("train").alias("split"))
    clear = x.filter(~edge).select("key", "stratum", F.when(F.col("before") + F.col("c") <= F.col("n_test"), "test").otherwise("train").alias("split"))
    return clear.unionByName(ranked)


def split_stats(labels: DataFrame, assigned: DataFrame) -> DataFrame:
    """train/test/unassigned per stratum."""
    x = labels.select("key", stratum(F.col("label"), F.col("family")).alias("stratum")).join(assigned.select("key", "split").distinct(), "key", "left")
    g = x.withColumn("split", F.coalesce("split", F.lit("unassigned"))).groupBy("stratum").pivot("split", ["train", "test", "unassigned"]).count()
    return g.select("stratum", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("train", "test", "unassigned")])


def replay_drift(old: DataFrame, new: DataFrame) -> DataFrame:
    """Verdicts before and after, with a NULL-safe changed flag."""
    o = old.select("run_id", F.col("level").alias("old_level"), F.col("score").alias("old_score"))
    n = new.select("run_id", F.col("level").alias("new_level"), F.col("score").alias("new_score"))
    same = F.col("old_level").eqNullSafe(F.col("new_level")) & F.col("old_score").eqNullSafe(F.col("new_score"))
    return o.join(n, "run_id", "left").withColumn("changed", ~same)


def dataset_coverage(datasets: DataFrame, alerts: DataFrame) -> DataFrame:
    """Data sets per technique and those with at least one alert; ``datasets(dataset, technique)``."""
    hit = alerts.select("dataset").distinct().withColumn("__h", F.lit(True))
    return datasets.join(hit, "dataset", "left").groupBy("technique").agg(
        F.count("*").alias("total"), F.count_if(two_valued(F.col("__h"))).alias("covered"))


def zero_match(datasets: DataFrame, alerts: DataFrame) -> DataFrame:
    """Data sets without an alert."""
    return datasets.join(alerts.select("dataset").distinct(), "dataset", "left_anti")


def c2_recall(verdicts: DataFrame) -> DataFrame:
    """E7 verdicts rolled up per family, with a total row (family NULL)."""
    v = F.col("verdict")
    return verdicts.withColumn("family", F.coalesce(F.nullif("family", F.lit("")), F.lit("?"))).rollup("family").agg(
        F.count_if(v == "observed").alias("observed"), F.count_if(v == "missed").alias("missed"), F.count_if(v == "inconclusive").alias("inconclusive"),
        F.sum("matched").alias("iocs_matched"), F.sum("total_iocs").alias("iocs_total"))


def family_verify(rows: DataFrame) -> DataFrame:
    """Per family runs, bands, name matches and technique overlap, with a total row."""
    return rows.rollup("family").agg(
        F.count("*").alias("n"), F.count_if(F.col("level").isin(LOOSE)).alias("suspicious_up"), F.count_if(F.col("level") == "malicious").alias("malicious"),
        F.count_if(two_valued(F.col("name_match"))).alias("name_match"), F.count_if(two_valued(F.col("behavior_ok"))).alias("behavior_ok"))


def below_suspicious(rows: DataFrame) -> DataFrame:
    """Runs of real families that scored below suspicious."""
    return rows.filter(~two_valued(F.col("level").isin(LOOSE)))


def atomic_audit(audit: DataFrame) -> DataFrame:
    """E10 rolled up per technique with a total row."""
    return audit.rollup("technique").agg(
        F.count("*").alias("total"), F.count_if(F.col("band_ok") == "yes").alias("verdict_ok"), F.count_if("technique_hit").alias("technique_hit"),
        F.count_if(F.col("verdict") == "NO-REPORT").alias("no_report"))


def expectations(outputs: DataFrame, events: DataFrame, specs: list[dict]) -> DataFrame:
    """Per (run, technique) PASS / FAIL / MISSING_PID.

    The target id is found in the run's output by regex; the required event (or
    alert) for that id must exist, with one of the text fragments if given.
    ``outputs(run_id, stdout)``, ``events(run_id, event_id, event_type, target_id, text)``.
    """
    rows = F.explode(F.array(*[
        F.struct(F.lit(s["name"]).alias("technique"), F.nullif(F.regexp_extract("stdout", s["pattern"], 1), F.lit("")).try_cast("bigint").alias("target_id"),
                 F.lit(s.get("event_id")).cast("int").alias("want_id"), F.lit(s.get("event_type")).cast("string").alias("want_type"))
        for s in specs])).alias("x")
    want = outputs.select("run_id", rows).select("run_id", "x.*")
    frag = F.lit(True)
    for s in specs:
        if s.get("fragments"):
            low = F.lower(F.coalesce("text", F.lit("")))
            ok = None
            for f in s["fragments"]:
                needle = F.replace(F.lit(f), F.lit("{id}"), F.col("target_id").cast("string"))
                ok = low.contains(needle) if ok is None else ok | low.contains(needle)
            frag = F.when(F.col("technique") == s["name"], ok).otherwise(frag)
    ev = events.select("run_id", "target_id", F.col("event_id").alias("want_id"), F.col("event_type").alias("__t"), "text")
    x = want.filter(F.col("want_id").isNotNull()).join(ev.drop("__t"), ["run_id", "target_id", "want_id"], "left").withColumn("__seen", F.lit(1))
    y = want.filter(F.col("want_id").isNull()).join(
        ev.drop("want_id").withColumnRenamed("__t", "want_type"), ["run_id", "target_id", "want_type"], "left").withColumn("__seen", F.lit(1))
    g = x.unionByName(y).groupBy("run_id", "technique", "target_id").agg(
        F.max(two_valued(F.col("text").isNotNull() & frag)).alias("ok"), F.count("text").alias("matched_events"))
    return g.select("run_id", "technique", "target_id", "matched_events",
                    F.when(F.col("target_id").isNull(), "MISSING_PID").when(F.col("ok"), "PASS").otherwise("FAIL").alias("status"))


def gate(rate_rows: DataFrame, boundary: DataFrame, limits: dict = fixed.GATE) -> DataFrame:
    """Failed checks (no rows = pass); too few runs skip every check.

    Undefined recall counts as 0, undefined FPR as 0, undefined precision as 1.
    """
    r = rate_rows.groupBy().pivot("threshold", ["malicious-only", "suspicious-or-worse"]).agg(
        F.first("precision").alias("p"), F.first("recall").alias("r"), F.first("fpr").alias("f"),
        F.first(F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")).alias("n"))
    both = r.unionByName(boundary.select("violations"), allowMissingColumns=True)  # one row each
    x = both.agg(*[F.max(F.col(f"`{c}`")).alias(c) for c in both.columns])
    recall, fpr = F.coalesce("suspicious-or-worse_r", F.lit(0.0)), F.coalesce("suspicious-or-worse_f", F.lit(0.0))
    prec = F.coalesce("malicious-only_p", F.lit(1.0))
    row = lambda name, value, limit: F.struct(F.lit(name).alias("check"), value.cast("double").alias("value"), F.lit(float(limit)).alias("limit"))
    bad = F.filter(F.array(
        F.when(recall < limits["recall"], row("recall", recall, limits["recall"])),
        F.when(fpr > limits["fpr"], row("fpr", fpr, limits["fpr"])),
        F.when(prec < limits["precision"], row("precision", prec, limits["precision"])),
        F.when(F.col("violations") > limits["boundary"], row("boundary", F.col("violations"), limits["boundary"])),
    ), lambda c: c.isNotNull())
    return x.filter(F.col("malicious-only_n") >= limits["min_runs"]).select(F.explode(bad).alias("b")).select("b.*")


def groundtruth_worklist(samples: DataFrame, known: DataFrame) -> DataFrame:
    """Per family the samples and those with a usable network indicator."""
    good = known.filter(F.lower("ioc_type").isin(fixed.IOC_KINDS) & two_valued(F.col("confidence") >= fixed.IOC_MIN_CONFIDENCE)).select("sha256").distinct()
    x = samples.join(good.withColumn("__g", F.lit(True)), "sha256", "left")
    return x.groupBy(F.coalesce(F.nullif("family", F.lit("")), F.lit("?")).alias("family")).agg(
        F.count("*").alias("total"), F.count_if(two_valued(F.col("__g"))).alias("with_c2"))


def scenario_check(expected: DataFrame, observed: DataFrame) -> DataFrame:
    """Expected facts of a scenario that were not observed; both ``(scenario, kind, value)``.

    Kinds are e.g. rule, type, priority, level; alternatives of a level are one
    value list joined by '|'.
    """
    wanted = expected.withColumn("option", F.explode(F.split("value", r"\|")))
    hit = wanted.join(observed.select("scenario", "kind", F.col("value").alias("option")).distinct(), ["scenario", "kind", "option"], "left_semi")
    return expected.join(hit.select("scenario", "kind", "value").distinct(), ["scenario", "kind", "value"], "left_anti")


def unlabeled_worklist(resolved: DataFrame) -> DataFrame:
    """Runs without a label."""
    return resolved.filter(F.col("label").isNull())


def scored_runs(resolved: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Labeled runs with their verdict, in the shape the metrics read."""
    return resolved.filter(F.col("label").isNotNull()).join(verdicts, "run_id").select(
        F.col("run_id").alias("id"), "label", "family", F.col("level").alias("predicted"), "score")


def rescore(scores: DataFrame, malicious: int, suspicious: int) -> DataFrame:
    """Bands under other cutoffs, without detecting again."""
    return scores.withColumn("predicted", level_of(F.col("score"), ((malicious, "malicious"), (suspicious, "suspicious"), (0, "clean"))))
