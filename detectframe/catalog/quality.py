"""Queries of SURVEY 2.N."""

from pyspark.sql import functions as F

from detectframe import fixed
from detectframe.catalog.base import adapter, query, table
from detectframe.catalog.joins import AUDIT, IOC, VERD, audit_rows, ioc_verdict_rows, iocs, labels_of
from detectframe.catalog.rules import MATCHES, ruleset
from detectframe.operators import joins as J
from detectframe.operators import quality as Q
from detectframe.operators import rules as R

_COUNTS = """
cnt AS (SELECT 'malicious-only' AS threshold, count(*) FILTER (WHERE label = 'malicious' AND predicted = 'malicious') AS tp, count(*) FILTER (WHERE label = 'benign' AND predicted = 'malicious') AS fp,
  count(*) FILTER (WHERE label = 'malicious' AND predicted <> 'malicious') AS fn, count(*) FILTER (WHERE label = 'benign' AND predicted <> 'malicious') AS tn FROM scored
  UNION ALL SELECT 'suspicious-or-worse', count(*) FILTER (WHERE label = 'malicious' AND predicted <> 'clean'), count(*) FILTER (WHERE label = 'benign' AND predicted <> 'clean'), count(*) FILTER (WHERE label = 'malicious' AND predicted = 'clean'),
  count(*) FILTER (WHERE label = 'benign' AND predicted = 'clean') FROM scored WHERE NOT (label = 'benign' AND family = 'goodware_boundary')),
rat AS (SELECT *, tp / nullif(tp + fp, 0) AS precision, tp / nullif(tp + fn, 0) AS recall, fp / nullif(fp + tn, 0) AS fpr FROM cnt)"""


def scored(spark, d):
    return adapter(spark, d, "scored")


@query("n1_confusion", using="scored", oracle="""
SELECT label, count(*) FILTER (WHERE predicted = 'malicious') AS malicious, count(*) FILTER (WHERE predicted = 'suspicious') AS suspicious, count(*) FILTER (WHERE predicted = 'clean') AS clean FROM scored GROUP BY 1""")
def n1(spark, d):
    return Q.confusion(scored(spark, d))


@query("n2_rates", using="scored", oracle=f"""
WITH {_COUNTS.strip()} SELECT threshold, tp, fp, fn, tn, round(precision, 9) AS precision, round(recall, 9) AS recall, round(fpr, 9) AS fpr, round(CASE WHEN precision > 0 AND recall > 0 THEN 2 * precision * recall / (precision + recall) END, 9) AS f1 FROM rat""")
def n2(spark, d):
    r = Q.rates(scored(spark, d))
    return r.select("threshold", "tp", "fp", "fn", "tn", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "fpr", "f1")])


_W = "round({f}(0.0 + {b}, (({k} / {n} + 1.96 * 1.96 / (2 * {n})) / (1 + 1.96 * 1.96 / {n})) {s} (1.96 / (1 + 1.96 * 1.96 / {n})) * sqrt(({k} / {n}) * (1 - {k} / {n}) / {n} + 1.96 * 1.96 / (4.0 * {n} * {n}))), 9)"


@query("n3_wilson", using="scored", oracle=f"""
WITH g AS (SELECT family, count(*) FILTER (WHERE predicted <> 'clean') AS k, CAST(count(*) AS double) AS n FROM scored GROUP BY 1)
SELECT family, {_W.format(f='greatest', b='0', k='k', n='n', s='-')} AS low, {_W.format(f='least', b='1', k='k', n='n', s='+')} AS high FROM g""")
def n3(spark, d):
    g = scored(spark, d).groupBy("family").agg(F.count_if(F.col("predicted") != "clean").alias("k"), F.count("*").alias("n"))
    low, high = Q.wilson(F.col("k"), F.col("n"))
    return g.select("family", F.round(low, 9).alias("low"), F.round(high, 9).alias("high"))


@query("n2_rates_with_intervals", using="scored", oracle=f"""
WITH {_COUNTS.strip()}, x AS (SELECT threshold, CAST(tp AS double) AS k, CAST(tp + fn AS double) AS n FROM rat) SELECT threshold, {_W.format(f='greatest', b='0', k='k', n='n', s='-')} AS recall_low, {_W.format(f='least', b='1', k='k', n='n', s='+')} AS recall_high FROM x""")
def n2_ci(spark, d):
    return Q.rates_with_intervals(scored(spark, d)).select("threshold", F.round("recall_low", 9).alias("recall_low"), F.round("recall_high", 9).alias("recall_high"))


@query("n4_family_detection", using="scored", oracle="SELECT family, count(*) AS total, count(*) FILTER (WHERE predicted <> 'clean') AS detected FROM scored WHERE label = 'malicious' GROUP BY 1")
def n4(spark, d):
    return Q.family_detection(scored(spark, d))


@query("n5_boundary_violations", using="scored", oracle="SELECT id, score FROM scored WHERE label = 'benign' AND family = 'goodware_boundary' AND predicted = 'malicious'")
def n5(spark, d):
    return Q.boundary_violations(scored(spark, d)).select("id", "score")


@query("n5_boundary_counts", using="scored", oracle="""
SELECT count(*) AS total, count(*) FILTER (WHERE predicted = 'suspicious') AS suspicious_ok, count(*) FILTER (WHERE predicted = 'clean') AS clean, count(*) FILTER (WHERE predicted = 'malicious') AS violations FROM scored WHERE label = 'benign' AND family = 'goodware_boundary'""")
def n5_counts(spark, d):
    return Q.boundary_counts(scored(spark, d))


@query("n6_fp_drivers", using="scored", oracle="""
WITH f AS (SELECT id FROM scored WHERE label = 'benign' AND family <> 'goodware_boundary' AND predicted <> 'clean'),
r AS (SELECT doc_id AS id, 'license' AS reason FROM documents WHERE contains(lower(text), 'license') UNION ALL SELECT doc_id, 'http' FROM documents WHERE contains(text, 'http') UNION ALL SELECT doc_id, concat('length ', n_chars % 30 // 10) FROM documents)
SELECT reason, count(*) AS n FROM r WHERE id IN (SELECT id FROM f) GROUP BY 1""")
def n6(spark, d):
    t = F.col("text")
    why = F.filter(F.array(F.when(F.lower(t).contains("license"), "license"), F.when(t.contains("http"), "http"), F.concat(F.lit("length "), F.floor(F.col("n_chars") % 30 / 10))), lambda x: x.isNotNull())
    return Q.fp_drivers(scored(spark, d), table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.explode(why).alias("reason")))


_SWEEP = """
g AS (SELECT m.m, s.s FROM (SELECT unnest(range(15, 71, 5)) AS m) m, (SELECT unnest(range(5, 70, 5)) AS s) s WHERE s.s < m.m),
sw AS (SELECT m, s, count(*) FILTER (WHERE label = 'malicious' AND score >= m) AS tp, count(*) FILTER (WHERE label = 'benign' AND score >= m) AS fp, count(*) FILTER (WHERE label = 'malicious' AND score < m) AS fn, count(*) FILTER (WHERE label = 'benign' AND score < m) AS tn FROM g, scored GROUP BY 1, 2),
sr AS (SELECT *, tp / nullif(tp + fp, 0) AS precision, tp / nullif(tp + fn, 0) AS recall, fp / nullif(fp + tn, 0) AS fpr FROM sw),
sf AS (SELECT *, CASE WHEN precision > 0 AND recall > 0 THEN 2 * precision * recall / (precision + recall) END AS f1 FROM sr)"""


@query("n7_threshold_sweep", using="scored", oracle=f"WITH {_SWEEP.strip()} SELECT m AS malicious, s AS suspicious, tp, fp, fn, tn, round(f1, 9) AS f1, round(fpr, 9) AS fpr FROM sf")
def n7(spark, d):
    s = Q.threshold_sweep(scored(spark, d))
    return s.select(F.col("malicious").cast("bigint").alias("malicious"), F.col("suspicious").cast("bigint").alias("suspicious"), "tp", "fp", "fn", "tn", F.round("f1", 9).alias("f1"), F.round("fpr", 9).alias("fpr"))


@query("n7_best_threshold", using="scored", oracle=f"WITH {_SWEEP.strip()} SELECT m AS malicious, s AS suspicious, round(f1, 9) AS f1 FROM sf WHERE f1 IS NOT NULL AND (fpr IS NULL OR fpr <= 0.2) ORDER BY sf.f1 DESC, m, s LIMIT 1")
def n7_best(spark, d):
    b = Q.best_threshold(Q.threshold_sweep(scored(spark, d)), 0.2)
    return b.select(F.col("malicious").cast("bigint").alias("malicious"), F.col("suspicious").cast("bigint").alias("suspicious"), F.round("f1", 9).alias("f1"))


_SPLIT = f"""
lab AS (SELECT CAST(d.doc_id AS varchar) AS key, CASE l.quality WHEN 0 THEN 'malicious' ELSE 'benign' END AS label, CASE WHEN d.lang <> 'de' THEN d.lang ELSE '' END AS family FROM labels l JOIN documents d ON l.doc_id = d.doc_id),
str AS (SELECT key, concat(label, '|', coalesce(nullif(family, ''), 'unlabeled')) AS stratum FROM lab), fz AS (SELECT CAST(doc_id AS varchar) AS key, CASE WHEN doc_id % 2 = 0 THEN 'test' ELSE 'train' END AS split FROM labels WHERE doc_id % 10 = 0),
rk AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY sha256(concat('{fixed.SPLIT_SEED}', '|', stratum, '|', key)), key) AS r, count(*) OVER (PARTITION BY stratum) AS n FROM str WHERE key NOT IN (SELECT key FROM fz)),
asg AS (SELECT key, stratum, CASE WHEN n >= 4 AND r <= greatest(1, round_even(n * 0.2, 0)) THEN 'test' ELSE 'train' END AS split FROM rk)"""


def _split_rows(spark, d):
    lab, doc = table(spark, d, "labels"), table(spark, d, "documents").select("doc_id", "lang")
    x = lab.join(doc, "doc_id").select(F.col("doc_id").cast("string").alias("key"), F.when(F.col("quality") == 0, "malicious").otherwise("benign").alias("label"), F.when(F.col("lang") != "de", F.col("lang")).otherwise("").alias("family"))
    frozen = lab.filter(F.col("doc_id") % 10 == 0).select(F.col("doc_id").cast("string").alias("key"), F.when(F.col("doc_id") % 2 == 0, "test").otherwise("train").alias("split"))
    return x, frozen


@query("n8_stratified_split", oracle=f"WITH {_SPLIT.strip()} SELECT key, stratum, split FROM asg")
def n8(spark, d):
    return Q.stratified_split(*_split_rows(spark, d))


@query("n9_split_stats", oracle=f"""
WITH {_SPLIT.strip()}, al AS (SELECT key, split FROM asg UNION ALL SELECT key, split FROM fz)
SELECT stratum, count(*) FILTER (WHERE al.split = 'train') AS train, count(*) FILTER (WHERE al.split = 'test') AS test, count(*) FILTER (WHERE al.split IS NULL) AS unassigned FROM str LEFT JOIN al ON str.key = al.key GROUP BY 1""")
def n9(spark, d):
    x, frozen = _split_rows(spark, d)
    some = Q.stratified_split(x, frozen).select("key", "split")
    return Q.split_stats(x, some.unionByName(frozen))


@query("n10_replay_drift", using="runs", oracle="""
WITH n AS (SELECT run_id, CASE WHEN score % 3 = 0 THEN least(score + 5, 100) ELSE score END AS score FROM runs WHERE score % 17 <> 0), m AS (SELECT *, CASE WHEN score >= 40 THEN 'malicious' WHEN score >= 10 THEN 'suspicious' ELSE 'clean' END AS level FROM n)
SELECT r.run_id, r.level AS old_level, r.score AS old_score, m.level AS new_level, m.score AS new_score, m.run_id IS NULL OR r.level <> m.level OR r.score <> m.score AS changed FROM runs r LEFT JOIN m ON r.run_id = m.run_id""")
def n10(spark, d):
    from detectframe.operators.scoring import level_of

    r = adapter(spark, d, "runs").select("run_id", "level", "score")
    s = F.when(F.col("score") % 3 == 0, F.least(F.col("score") + 5, F.lit(100))).otherwise(F.col("score"))
    return Q.replay_drift(r, r.filter(F.col("score") % 17 != 0).select("run_id", s.alias("score")).withColumn("level", level_of(F.col("score"))))


def _datasets(spark, d):
    t = adapter(spark, d, "tel")
    name = F.concat(F.lit("ds"), F.col("ProcessId"))
    data = t.select(name.alias("dataset"), F.concat(F.lit("T"), F.col("ProcessId").cast("bigint") % 11).alias("technique")).distinct()
    hits = R.apply_rules(t, ruleset(), keep=["ProcessId"]).filter(F.col("rule_id") == "r-cmd").select(name.alias("dataset"))
    return data, hits


_DS = f"{MATCHES.strip()}, ds AS (SELECT DISTINCT concat('ds', ProcessId) AS dataset, concat('T', CAST(ProcessId AS bigint) % 11) AS technique FROM tel), hit AS (SELECT DISTINCT concat('ds', ProcessId) AS dataset FROM matches WHERE rule_id = 'r-cmd')"


@query("n11_dataset_coverage", using="tel", oracle=f"WITH {_DS} SELECT technique, count(*) AS total, count(hit.dataset) AS covered FROM ds LEFT JOIN hit ON ds.dataset = hit.dataset GROUP BY 1")
def n11(spark, d):
    return Q.dataset_coverage(*_datasets(spark, d))


@query("n11_zero_match", using="tel", oracle=f"WITH {_DS} SELECT dataset, technique FROM ds WHERE dataset NOT IN (SELECT dataset FROM hit)")
def n11_zero(spark, d):
    return Q.zero_match(*_datasets(spark, d))


@query("n12_c2_recall", oracle=f"""
WITH {VERD.strip()} SELECT family, count(*) FILTER (WHERE verdict = 'observed') AS observed, count(*) FILTER (WHERE verdict = 'missed') AS missed, count(*) FILTER (WHERE verdict = 'inconclusive') AS inconclusive, CAST(sum(hit) AS bigint) AS iocs_matched, CAST(sum(total) AS bigint) AS iocs_total FROM verd GROUP BY ROLLUP (family)""")
def n12(spark, d):
    return Q.c2_recall(ioc_verdict_rows(spark, d))


@query("n13_family_verify", using="runs", oracle="""
WITH x AS (SELECT priority AS family, level, score % 4 = 0 AS nm, score % 3 > 0 AS ok FROM runs)
SELECT family, count(*) AS n, count(*) FILTER (WHERE level <> 'clean') AS suspicious_up, count(*) FILTER (WHERE level = 'malicious') AS malicious, count(*) FILTER (WHERE nm) AS name_match, count(*) FILTER (WHERE ok) AS behavior_ok FROM x GROUP BY ROLLUP (family)""")
def n13(spark, d):
    r = adapter(spark, d, "runs").select(F.col("priority").alias("family"), "level", (F.col("score") % 4 == 0).alias("name_match"), (F.col("score") % 3 > 0).alias("behavior_ok"))
    return Q.family_verify(r)


@query("n13_below_suspicious", using="runs", oracle="SELECT run_id, score FROM runs WHERE level = 'clean'")
def n13_bad(spark, d):
    return Q.below_suspicious(adapter(spark, d, "runs")).select("run_id", "score")


@query("n14_atomic_audit", using="runs", oracle=f"""
WITH {AUDIT.strip()} SELECT technique, count(*) AS total, count(*) FILTER (WHERE band_ok = 'yes') AS verdict_ok, count(*) FILTER (WHERE technique_hit) AS technique_hit, count(*) FILTER (WHERE verdict = 'NO-REPORT') AS no_report FROM aud GROUP BY ROLLUP (technique)""")
def n14(spark, d):
    return Q.atomic_audit(audit_rows(spark, d))


_SPECS = [
    {"name": "replace", "pattern": r"Replace target pid=(\d+)", "event_id": 5, "fragments": ["aa", "pid {id}"]},
    {"name": "hook", "pattern": r"Hook target pid=(\d+)", "event_id": 7},
    {"name": "chain", "pattern": r"Chain target pid=(\d+)", "event_type": "FileCreate", "fragments": ["into {id}"]},
]


@query("n15_expectations", using="tel", oracle="""
WITH o AS (SELECT concat('run', user_id % 10) AS run_id, user_id, max(event_id) AS m FROM events GROUP BY 1, 2), r AS (SELECT run_id, min(user_id) AS p FROM o GROUP BY 1),
w AS (SELECT run_id, t.technique, CASE t.technique WHEN 'replace' THEN CASE WHEN p % 2 = 0 THEN p END WHEN 'hook' THEN p + 20 ELSE p + 100000 * (p % 3) END AS target_id FROM r, (VALUES ('replace'), ('hook'), ('chain')) t(technique)),
e AS (SELECT run_id, CAST(ProcessId AS bigint) AS pid, event_id, event_type, k FROM tel),
x AS (SELECT w.run_id, w.technique, w.target_id, count(e.pid) AS matched_events, coalesce(bool_or(CASE w.technique WHEN 'replace' THEN e.k % 50 = 7 WHEN 'hook' THEN e.pid IS NOT NULL ELSE e.k % 10 = 1 END), false) AS ok FROM w LEFT JOIN e ON e.run_id = w.run_id AND e.pid = w.target_id
  AND CASE w.technique WHEN 'replace' THEN e.event_id = 5 WHEN 'hook' THEN e.event_id = 7 ELSE e.event_type = 'FileCreate' END GROUP BY 1, 2, 3)
SELECT run_id, technique, target_id, matched_events, CASE WHEN target_id IS NULL THEN 'MISSING_PID' WHEN ok THEN 'PASS' ELSE 'FAIL' END AS status FROM x""")
def n15(spark, d):
    e = table(spark, d, "events")
    p = F.col("p")
    runs = e.select(F.concat(F.lit("run"), F.col("user_id") % 10).alias("run_id"), "user_id").groupBy("run_id").agg(F.min("user_id").alias("p"))
    out = runs.select("run_id", F.concat(F.lit("start\n"), F.when(p % 2 == 0, F.concat(F.lit("Replace target pid="), p)).otherwise("no"), F.lit("\nHook target pid="), p + 20, F.lit("\nChain target pid="), p + 100000 * (p % 3)).alias("stdout"))
    k, pid = F.col("k"), F.col("ProcessId")
    text = F.when(F.col("event_id") == 5, F.when(k % 50 == 7, F.concat(F.lit("AA PID "), pid)).otherwise("none")).when(F.col("event_id") == 11, F.when(k % 10 == 1, F.concat(F.lit("Into "), pid)).otherwise("x")).otherwise("")
    ev = adapter(spark, d, "tel").select("run_id", pid.cast("bigint").alias("target_id"), "event_id", "event_type", text.alias("text"))
    return Q.expectations(out, ev, _SPECS)


@query("n16_gate", using="scored", oracle=f"""
WITH {_COUNTS.strip()}, v AS (SELECT count(*) AS n FROM scored WHERE label = 'benign' AND family = 'goodware_boundary' AND predicted = 'malicious'), a AS (SELECT * FROM rat WHERE threshold = 'malicious-only'), b AS (SELECT * FROM rat WHERE threshold = 'suspicious-or-worse'),
c AS (SELECT 'recall' AS "check", coalesce(b.recall, 0) AS value, 0.9 AS lim, coalesce(b.recall, 0) < 0.9 AS bad FROM b UNION ALL SELECT 'fpr', coalesce(b.fpr, 0), 0.2, coalesce(b.fpr, 0) > 0.2 FROM b UNION ALL SELECT 'precision', coalesce(a.precision, 1), 0.9, coalesce(a.precision, 1) < 0.9 FROM a UNION ALL SELECT 'boundary', n, 0, n > 0 FROM v)
SELECT "check", round(value, 9) AS value FROM c WHERE bad""")
def n16(spark, d):
    s = scored(spark, d)
    return Q.gate(Q.rates(s), Q.boundary_counts(s)).select("check", F.round("value", 9).alias("value"))


@query("n17_groundtruth_worklist", oracle=f"""
WITH {IOC.strip()}, s AS (SELECT concat('s', s_suppkey) AS sha256, concat('n', s_nationkey) AS family FROM supplier) SELECT family, count(*) AS total, count(*) FILTER (WHERE sha256 IN (SELECT sha256 FROM known WHERE j < 4 AND confidence >= 65)) AS with_c2 FROM s GROUP BY 1""")
def n17(spark, d):
    known = iocs(spark, d)[0].withColumn("confidence", F.col("confidence") - 15)
    return Q.groundtruth_worklist(table(spark, d, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("sha256"), F.concat(F.lit("n"), "s_nationkey").alias("family")), known)


@query("n18_scenario_check", using="tel", oracle="""
WITH o AS (SELECT DISTINCT run_id, event_type FROM tel WHERE k < 2), x AS (SELECT DISTINCT run_id AS scenario, 'type' AS kind, event_type AS value FROM tel)
SELECT x.* FROM x LEFT JOIN o ON o.run_id = x.scenario AND o.event_type = x.value WHERE o.run_id IS NULL
UNION ALL SELECT scenario, 'level', 'malicious|suspicious' FROM (SELECT run_id AS scenario, count(*) AS n FROM tel GROUP BY 1) y WHERE n % 3 = 0""")
def n18(spark, d):
    t = adapter(spark, d, "tel")
    runs = t.groupBy(F.col("run_id").alias("scenario")).agg(F.count("*").alias("n"))
    want = t.select(F.col("run_id").alias("scenario"), F.lit("type").alias("kind"), F.col("event_type").alias("value")).distinct().unionByName(runs.select("scenario", F.lit("level").alias("kind"), F.lit("malicious|suspicious").alias("value")))
    level = F.when(F.col("n") % 3 == 0, "clean").when(F.col("n") % 3 == 1, "suspicious").otherwise("malicious")
    got = t.filter(F.col("k") < 2).select(F.col("run_id").alias("scenario"), F.lit("type").alias("kind"), F.col("event_type").alias("value")).unionByName(runs.select("scenario", F.lit("level").alias("kind"), level.alias("value")))
    return Q.scenario_check(want, got)


@query("n19_unlabeled_worklist", using="runs", oracle="""
SELECT run_id FROM runs r WHERE run_id NOT IN (SELECT concat('rep', c_custkey * 7) FROM customer) AND sha256 NOT IN (SELECT concat('sha', c_custkey % 400) FROM customer) AND filename NOT IN (SELECT concat('file', c_custkey % 90, '.exe') FROM customer)""")
def n19(spark, d):
    return Q.unlabeled_worklist(J.resolve_labels(adapter(spark, d, "runs"), labels_of(spark, d))).select("run_id")
