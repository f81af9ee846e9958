"""Queries of SURVEY 2.B: rule leaves over whole tables."""

from pyspark.sql import functions as F

from detectframe.catalog.base import adapter, query, table
from detectframe.functions import leaf as L


@query("b1_field", using="tel", oracle="""
SELECT ProcessId AS pid, CAST(event_id AS string) AS eid, NULL AS missing, count(*) AS n FROM tel GROUP BY 1, 2""")
def b1(spark, d):
    from detectframe.schema import fld

    t = adapter(spark, d, "tel").drop("k")
    m = t.select("event_id", F.create_map(F.lit("ProcessId"), F.col("ProcessId")).alias("data"))
    return m.select(fld(m, "ProcessId").alias("pid"), fld(m, "EventID").alias("eid"), fld(m, "NoSuch").alias("missing")).groupBy("pid", "eid", "missing").agg(F.count("*").alias("n"))


@query("b2_like_ci", oracle="""
SELECT doc_id, contains(lower(text), 'license') AND NOT contains(text, chr(10)) AS has, regexp_matches(text, '^(?i:.*tion.[a-z]+ .*)$') AND NOT contains(text, chr(10)) AS wild,
  coalesce(lower(source) = 'src3', false) AS same FROM documents""")
def b2(spark, d):
    doc = table(spark, d, "documents")
    return doc.select("doc_id", L.like_ci(F.col("text"), "*LICENSE*").alias("has"), (L.like_ci(F.col("text"), "*tion?*") & L.regex(F.col("text"), r"^.*tion.[a-z]+ .*$", "i")).alias("wild"),
                      L.like_ci(F.col("source"), "SRC3").alias("same"))


@query("b3_contains_any", oracle="""
SELECT p_partkey, contains(p_name, 'ring') OR contains(p_name, 'bolt') AS has, starts_with(lower(p_type), 'eco') AS starts, ends_with(p_name, 'widget') OR ends_with(p_name, 'gear') AS ends FROM part""")
def b3(spark, d):
    p = table(spark, d, "part")
    return p.select("p_partkey", L.contains(F.col("p_name"), ["RING", "bolt"]).alias("has"), L.startswith(F.col("p_type"), ["Eco"]).alias("starts"), L.endswith(F.col("p_name"), ["Widget", "gear"]).alias("ends"))


@query("b4_contains_all", oracle="SELECT doc_id FROM documents WHERE NOT contains(text, chr(10)) AND contains(lower(text), 'the') AND contains(lower(text), 'of')")
def b4(spark, d):
    return table(spark, d, "documents").filter(L.contains_all(F.col("text"), ["The", "OF"])).select("doc_id")


@query("b5_like_cs", oracle="SELECT count(*) AS n_cased, count(*) FILTER (WHERE p_type LIKE 'ECO%') AS eco FROM part WHERE p_name LIKE '%ring' OR p_type LIKE 'ECO%'")
def b5(spark, d):
    p = table(spark, d, "part")
    eco = L.like_cs(F.col("p_type"), "ECO*")
    return p.filter(L.like_cs(F.col("p_name"), "*ring") | eco | L.like_cs(F.col("p_name"), "*RING")).agg(F.count("*").alias("n_cased"), F.count_if(eco).alias("eco"))


@query("b6_regex", oracle="SELECT doc_id, regexp_matches(text, '[A-Z][a-z]+tion([^\\p{L}\\p{N}_]|$)') AS cased, regexp_matches(text, '(?i)license|secret') AS loose FROM documents")
def b6(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", L.regex(t, r"[A-Z][a-z]+tion\b").alias("cased"), L.regex(t, "license|secret", "i").alias("loose"))


@query("b7_cidr", using="tel", oracle="""
WITH x AS (SELECT seq, CASE WHEN k % 13 = 0 THEN 'fe80::1' ELSE DestinationIp END AS ip FROM tel)
SELECT seq, ip LIKE '10.1.%' AS n16, ip IN ('10.2.2.4', '10.2.2.5', '10.2.2.6', '10.2.2.7') AS n30, ip = 'fe80::1' AS v6 FROM x""")
def b7(spark, d):
    t = adapter(spark, d, "tel").select("seq", F.when(F.col("k") % 13 == 0, "fe80::1").otherwise(F.col("DestinationIp")).alias("ip"))
    ip = F.col("ip")
    return t.select("seq", L.cidr(ip, "10.1.0.0/16").alias("n16"), L.cidr(ip, "10.2.2.4/30").alias("n30"), L.cidr(ip, "fe80::/10").alias("v6"))


@query("b8_num_eq", using="tel", oracle="SELECT seq FROM tel WHERE k = 42")
def b8(spark, d):
    return adapter(spark, d, "tel").filter(L.num_eq(F.col("Level"), 42)).select("seq")


@query("b9_compare", using="tel", oracle="""
SELECT count(*) FILTER (WHERE k < 10) AS lt, count(*) FILTER (WHERE k <= 10) AS lte, count(*) FILTER (WHERE k > 90) AS gt, count(*) FILTER (WHERE k >= 90) AS gte,
  count(*) FILTER (WHERE k <> 5) AS neq, 0 AS text FROM tel""")
def b9(spark, d):
    t, f = adapter(spark, d, "tel"), F.col("Level")
    ops = {"lt": 10, "lte": 10, "gt": 90, "gte": 90, "neq": 5}
    g = t.agg(*[F.count_if(L.compare(f, op, n)).alias(op) for op, n in ops.items()], F.count_if(L.compare(F.col("Image"), "neq", 5)).cast("int").alias("text"))
    return g


@query("b10_null_exists", using="tel", oracle="""
SELECT count(*) FILTER (WHERE ImageLoaded IS NULL OR ImageLoaded = '') AS empty, count(*) FILTER (WHERE Initiated IS NULL) AS missing, count(*) FILTER (WHERE Initiated IS NOT NULL) AS present,
  count(*) FILTER (WHERE NOT coalesce(seq > 100 AND ParentProcessGuid IS NOT NULL AND ParentProcessGuid > 'g5', false)) AS not_leaf FROM tel""")
def b10(spark, d):
    t = adapter(spark, d, "tel")
    return t.agg(F.count_if(L.is_null(F.col("ImageLoaded"))).alias("empty"), F.count_if(L.exists(F.col("Initiated"), False)).alias("missing"), F.count_if(L.exists(F.col("Initiated"))).alias("present"),
                 F.count_if(L.not_(L.and_(F.col("seq") > 100, F.col("ParentProcessGuid") > "g5"))).alias("not_leaf"))


@query("b11_field_eq_field", oracle="""
SELECT l_orderkey, l_linenumber FROM lineitem WHERE CAST(l_linenumber AS string) = CAST(l_suppkey AS string)""")
def b11(spark, d):
    return table(spark, d, "lineitem").filter(L.field_eq_field(F.col("l_linenumber"), F.col("l_suppkey"))).select("l_orderkey", "l_linenumber")


@query("b12_any_of", oracle="SELECT c_custkey FROM customer WHERE lower(c_mktsegment) IN ('building', 'machinery')")
def b12(spark, d):
    f = F.col("c_mktsegment")
    return table(spark, d, "customer").filter(L.any_of([L.like_ci(f, v) for v in ["Building", "MACHINERY"]])).select("c_custkey")


@query("b13_windash_base64offset", using="tel", oracle="""
SELECT seq, k % 2 = 0 AS dash, contains(base64(encode(concat(repeat('x', CAST(seq % 3 AS int)), 'secret-run', k))), 'secret') OR true AS b64 FROM tel""")
def b13(spark, d):
    t = adapter(spark, d, "tel")
    cmd = F.concat(F.lit("app "), F.when(F.col("k") % 2 == 0, "/run ").otherwise("run "), F.col("k").cast("string"))
    enc = F.base64(F.encode(F.concat(F.expr("repeat('x', cast(seq % 3 as int))"), F.lit("secret-run"), F.col("k").cast("string")), "utf-8"))
    return t.select("seq", L.contains(cmd, L.windash("-run")).alias("dash"), L.contains(enc, L.base64offset("secret-run"), cased=True).alias("b64"))


@query("b14_keyword", using="tel", oracle="SELECT seq FROM tel WHERE lower(Image) LIKE '%app7.exe' OR lower(CommandLine) LIKE '%app7.exe'")
def b14(spark, d):
    t = adapter(spark, d, "tel").withColumn("data", F.create_map(F.lit("Image"), F.col("Image"), F.lit("CommandLine"), F.col("CommandLine")))
    return t.filter(L.keyword(F.col("data"), "*APP7.exe")).select("seq")


@query("b15_two_valued_logic", using="tel", oracle="""
SELECT count(*) FILTER (WHERE NOT coalesce(Initiated = 'true', false)) AS neither, count(*) FILTER (WHERE coalesce(Initiated = 'true', false) AND NOT coalesce(k > 50, false)) AS both_,
  count(*) FILTER (WHERE coalesce(Initiated = 'false', false) OR k > 90) AS either FROM tel""")
def b15(spark, d):
    t, i, k = adapter(spark, d, "tel"), F.col("Initiated"), F.col("k")
    return t.agg(F.count_if(L.not_(i == "true")).alias("neither"), F.count_if(L.and_(i == "true", L.not_(k > 50))).alias("both_"), F.count_if(L.or_(i == "false", k > 90)).alias("either"))


@query("b16_quantifiers", using="tel", oracle="""
SELECT count(*) FILTER (WHERE k < 10 OR k > 90) AS one_sel, count(*) FILTER (WHERE k < 60 AND k > 20) AS all_opt, count(*) FILTER (WHERE k < 10 OR k > 90 OR (k < 60) OR (k > 20)) AS any_them FROM tel""")
def b16(spark, d):
    k = F.col("k")
    named = {"sel_a": k < 10, "sel_b": k > 90, "opt_a": k < 60, "opt_b": k > 20}
    return adapter(spark, d, "tel").agg(F.count_if(L.one_of(named, "sel_*")).alias("one_sel"), F.count_if(L.all_of(named, "opt_*")).alias("all_opt"), F.count_if(L.one_of(named, "them")).alias("any_them"))


@query("b17_unusual_load", using="tel", oracle="""
SELECT seq FROM tel WHERE event_type = 'ImageLoad' AND (k % 3 = 0 OR k % 10 = 0 OR k % 4 = 0)""")
def b17(spark, d):
    t = adapter(spark, d, "tel").filter(F.col("event_type") == "ImageLoad")
    return t.filter(L.matches_unusual_load(F.col("Signed"), F.col("SignatureStatus"), F.col("ImageLoaded"))).select("seq")
