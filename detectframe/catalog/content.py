"""Queries of SURVEY 2.K and 2.O: scalars and content scans over whole texts."""

from pyspark.sql import functions as F

from detectframe.catalog.base import adapter, query, table
from detectframe.functions import scalar as K
from detectframe.operators import content as C


@query("k1_parse_kv", using="tel", oracle="""
SELECT seq, concat('b=', k) AS a, CASE WHEN k % 2 = 0 THEN CAST(k AS varchar) ELSE CAST(seq AS varchar) END AS b, CASE WHEN k % 7 = 0 THEN 'plain text' END AS raw FROM tel""")
def k1(spark, d):
    t, k = adapter(spark, d, "tel"), F.col("k")
    arg = F.when(k % 2 == 0, F.concat(F.lit("b="), F.col("seq"), F.lit(" a=b="), k, F.lit(" b="), k)).otherwise(F.concat(F.lit("x  b="), F.col("seq"), F.lit(" a=b="), k, F.lit(" c= "))  )
    x = t.select("seq", K.parse_kv(arg).alias("kv"), K.parse_kv(F.when(k % 7 == 0, "plain text").otherwise("a=1")).alias("p"))
    return x.select("seq", F.col("kv")["a"].alias("a"), F.col("kv")["b"].alias("b"), F.col("p")["_raw"].alias("raw"))


@query("k2_kv_values", using="tel", oracle="SELECT seq, CASE WHEN k % 3 = 0 THEN NULL ELSE CAST(k AS bigint) END AS n, k % 4 IN (1, 2) AS flag FROM tel")
def k2(spark, d):
    t, k = adapter(spark, d, "tel"), F.col("k")
    v = F.when(k % 4 == 0, "0").when(k % 4 == 1, "1").when(k % 4 == 2, "0x20").otherwise("yes")
    kv = F.create_map(F.lit("n"), F.when(k % 3 == 0, "12x").otherwise(k.cast("string")), F.lit("f"), v)
    return t.select("seq", K.kv_int(kv, "n").alias("n"), K.kv_bool(kv, "f").alias("flag"))


_ENTROPY = "WITH ch AS (SELECT {key}, unnest(string_split({text}, '')) AS c FROM {t}), cnt AS (SELECT {key}, c, count(*) AS n FROM ch GROUP BY 1, 2), tot AS (SELECT *, sum(n) OVER (PARTITION BY {key}) AS s FROM cnt) SELECT {key}, round(-sum(n / s * log2(n / s)), 6) AS entropy FROM tot GROUP BY 1"


@query("k3_entropy_text", oracle=_ENTROPY.format(key="doc_id", text="text", t="documents"))
def k3(spark, d):
    return table(spark, d, "documents").select("doc_id", F.round(K.entropy_text(F.col("text")), 6).alias("entropy"))


@query("k3_entropy_bytes", oracle="""
WITH ch AS (SELECT page_id, unnest(regexp_extract_all(hex(encode(url)), '..')) AS c FROM pages), cnt AS (SELECT page_id, c, count(*) AS n FROM ch GROUP BY 1, 2), tot AS (SELECT *, sum(n) OVER (PARTITION BY page_id) AS s FROM cnt)
SELECT page_id, round(-sum(n / s * log2(n / s)), 4) AS entropy FROM tot GROUP BY 1""")
def k3_bytes(spark, d):
    return table(spark, d, "pages").select("page_id", K.entropy_bytes(F.encode("url", "utf-8")).alias("entropy"))


@query("k4_basename", using="tel", oracle="SELECT seq, concat('doc', k, '.txt') AS name FROM tel")
def k4(spark, d):
    return adapter(spark, d, "tel").select("seq", K.basename(F.upper(F.when(F.col("k") % 2 == 0, F.translate("TargetFilename", "\\", "/")).otherwise(F.col("TargetFilename")))).alias("name"))


@query("k5_parse_time", oracle="SELECT event_id AS seq, CASE event_id % 5 WHEN 0 THEN epoch_us(ts) WHEN 1 THEN epoch_us(ts) WHEN 2 THEN epoch_us(ts) - 7200000000 WHEN 3 THEN epoch_us(ts) // 1000000 * 1000000 END AS us FROM events")
def k5(spark, d):
    n, ts = F.col("event_id"), F.col("ts")
    iso = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    raw = F.when(n % 5 == 0, F.concat(iso, F.lit("Z"))).when(n % 5 == 1, F.concat(F.translate(iso, "T", " "), F.lit("7"))).when(n % 5 == 2, F.concat(iso, F.lit("+02:00"))).when(
        n % 5 == 3, F.date_format(ts, "yyyy-MM-dd HH:mm:ss")).otherwise("soon")
    return table(spark, d, "events").select(n.alias("seq"), K.micros(K.parse_time(raw)).alias("us"))


@query("k6_hex8", oracle="SELECT l_orderkey, l_linenumber, CASE l_linenumber % 3 WHEN 0 THEN concat('0x', lpad(lower(hex(l_partkey)), 8, '0')) WHEN 1 THEN concat('0x', lpad(lower(hex(l_suppkey)), 8, '0')) ELSE 'n/a' END AS h FROM lineitem")
def k6(spark, d):
    n = F.col("l_linenumber") % 3
    v = F.when(n == 0, F.col("l_partkey").cast("string")).when(n == 1, F.concat(F.lit("0x"), F.hex("l_suppkey"))).otherwise("n/a")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", K.hex8(v).alias("h"))


@query("k7_hashes", oracle="SELECT doc_id, md5(text) AS md5, sha1(text) AS sha1, sha256(text) AS sha256 FROM documents")
def k7(spark, d):
    return table(spark, d, "documents").select("doc_id", K.hashes(F.col("text")).alias("h")).select("doc_id", "h.md5", "h.sha1", "h.sha256")


@query("k8_extract_strings", oracle=r"""
WITH x AS (SELECT doc_id, regexp_extract_all(text, '[\x20-\x7E]{4,}') AS s FROM documents) SELECT doc_id, CAST(least(len(s), 1000) AS bigint) AS n, coalesce(s[1], '') AS first, CAST(len(s) AS bigint) AS n_all FROM x""")
def k8(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", F.size(K.extract_strings(t, max_n=1000)).cast("bigint").alias("n"), F.coalesce(F.get(K.extract_strings(t), F.lit(0)), F.lit("")).alias("first"), F.size(K.extract_strings(t, max_n=None)).cast("bigint").alias("n_all"))


@query("k9_interesting_strings", oracle=r"""
WITH x AS (SELECT doc_id, unnest(regexp_extract_all(concat(text, chr(10), 'run ', CASE WHEN doc_id % 3 = 0 THEN 'CertUtil' ELSE 'nothing' END), '[\x20-\x7E]{4,}')) AS s FROM documents)
SELECT doc_id, string_agg(DISTINCT s, '|' ORDER BY s) AS kept FROM x WHERE regexp_matches(s, '(?i)https?://[^\s"]+|powershell|cmd\.exe|rundll32|regsvr32|mshta|certutil') OR regexp_matches(s, '[A-Za-z]:\\[^\s"]+|\\([\w\-]+\\)+[\w\-]+\.\w+|\b(\d{1,3}\.){3}\d{1,3}\b') GROUP BY 1""")
def k9(spark, d):
    t = F.concat("text", F.lit("\nrun "), F.when(F.col("doc_id") % 3 == 0, "CertUtil").otherwise("nothing"))
    x = table(spark, d, "documents").select("doc_id", F.array_join(K.interesting_strings(K.extract_strings(t, max_n=None), None), "|").alias("kept"))
    return x.filter(F.col("kept") != "")


@query("k10_norm_ioc", oracle="""
WITH x AS (SELECT page_id, page_id % 4 AS j, lower(regexp_extract(url, '://([^/:?#]+)', 1)) AS h FROM pages)
SELECT page_id, CASE WHEN j IN (0, 2) THEN h END AS domain, CASE WHEN j = 1 THEN concat('10.0.0.', page_id) END AS ip, CASE WHEN j = 1 THEN CAST(page_id % 7 AS varchar) END AS port FROM x""")
def k10(spark, d):
    i = F.col("page_id")
    j = i % 4
    host = F.regexp_extract("url", "://([^/:?#]+)", 1)
    kind = F.when(j == 0, "url").when(j == 1, "ip:port").when(j == 2, "domain").otherwise("sha256")
    v = F.when(j == 0, F.regexp_replace("url", r"[?#].*$", "")).when(j == 1, F.concat(F.lit(" 10.0.0."), i, F.lit(":"), i % 7)).otherwise(F.upper(host))
    return table(spark, d, "pages").select("page_id", K.norm_ioc(kind, v).alias("x")).select("page_id", "x.domain", "x.ip", "x.port")


@query("k11_technique_parent", using="runs", oracle="SELECT split_part(technique, '.', 1) AS parent, count(*) AS n FROM runs GROUP BY 1")
def k11(spark, d):
    return adapter(spark, d, "runs").groupBy(K.technique_parent(F.col("technique")).alias("parent")).agg(F.count("*").alias("n"))


@query("k12_packing", oracle="SELECT p_partkey, p_retailprice / 250 > 7.2 OR (p_size % 2 = 0 AND p_size / 6.0 > 7.2) AS packed FROM part")
def k12(spark, d):
    s = F.col("p_size")
    sec = F.array(F.struct(F.lit(".data").alias("name"), F.lit("0xc0000040").alias("characteristics"), F.lit(7.9).alias("entropy")),
                  F.struct(F.lit(".text").alias("name"), F.when(s % 2 == 0, "0x60000020").otherwise("0x40000040").alias("characteristics"), (s / 6.0).alias("entropy")))
    return table(spark, d, "part").select("p_partkey", K.packing(F.col("p_retailprice") / 250, sec).alias("packed"))


@query("k13_file_magic", oracle="""
SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'exe' WHEN 1 THEN 'pdf' WHEN 2 THEN 'ps1' ELSE '.xyz' END AS extension, CASE doc_id % 4 WHEN 0 THEN 'application/x-msdownload' WHEN 1 THEN 'application/pdf' WHEN 2 THEN 'text/x-powershell' ELSE 'application/octet-stream' END AS mime FROM documents""")
def k13(spark, d):
    m = F.col("doc_id") % 4
    body = F.encode(F.concat(F.when(m == 0, "MZ").when(m == 1, "%PDF").otherwise("~"), F.col("text")), "utf-8")
    name = F.concat(F.lit("C:\\a.b\\f"), F.when(m == 2, ".PS1").when(m == 3, ".xyz").otherwise(""))
    return table(spark, d, "documents").select("doc_id", K.file_magic(body, name).alias("k")).select("doc_id", "k.extension", "k.mime")


@query("k14_json_path", oracle="SELECT event_id AS seq, CAST(regexp_extract(props, '[0-9]+', 0) AS bigint) AS k FROM events")
def k14(spark, d):
    return table(spark, d, "events").select(F.col("event_id").alias("seq"), K.json_path(F.col("props"), "$.k").try_cast("bigint").alias("k"))


@query("k15_row_contains", oracle="SELECT count(*) AS n FROM part WHERE p_name LIKE '%ring%' OR lower(p_brand) = 'brand#17'")
def k15(spark, d):
    p = table(spark, d, "part")
    return p.filter(K.row_contains("RING", "p_name") | K.row_contains('"Brand#17"', "p_brand")).agg(F.count("*").alias("n"))


# ------------------------------------------------------------------ 2.O

RULES = [
    {"rule": "redline_words", "need": 1, "patterns": {"$a": r"(?i)license", "$b": r"https?://[0-9a-z.]+"}},
    {"rule": "heodo_mix", "need": 2, "patterns": {"$a": r"tion\b", "$b": r"(?i)secret|token|password", "$c": r"[0-9]{4,}"}},
    {"rule": "guarded", "need": 1, "need_guarded": 2, "patterns": {"$a": r"the ", "$b": r"and "}},
]
_FIRES = r"""
f AS (SELECT doc_id, r.rule FROM documents, (VALUES ('redline_words'), ('heodo_mix'), ('guarded')) r(rule) WHERE CASE r.rule WHEN 'redline_words' THEN regexp_matches(text, '(?i)license') OR regexp_matches(text, 'https?://[0-9a-z.]+')
  WHEN 'heodo_mix' THEN CAST(regexp_matches(text, 'tion([^\p{L}\p{N}_]|$)') AS int) + CAST(regexp_matches(text, '(?i)secret|token|password') AS int) + CAST(regexp_matches(text, '[0-9]{4,}') AS int) >= 2
  ELSE CAST(contains(text, 'the ') AS int) + CAST(contains(text, 'and ') AS int) >= CASE WHEN starts_with(text, 'Th') THEN 2 ELSE 1 END END)"""


def _guard(text):
    return text.startswith("Th")


@query("o1_pattern_scan", oracle=f"WITH {_FIRES.strip()} SELECT doc_id, rule FROM f")
def o1(spark, d):
    return C.pattern_scan(table(spark, d, "documents"), RULES, guard=_guard)


_SYLLABLES = ["tion", "the", "ing", "ed", "er", "and", "en", "re", "th", "an"]
#: Patterns of the wide scan: four syllables each, drawn from the pattern's number.
WIDE = 600


@query("o1_pattern_scan_wide", oracle=f"""
WITH p AS (SELECT i, concat('(?i)', list_extract(s, CAST(i % 10 + 1 AS int)), list_extract(s, CAST(i // 10 % 10 + 1 AS int)), list_extract(s, CAST(i // 100 % 10 + 1 AS int)), ' ?', list_extract(s, CAST(i * 7 % 10 + 1 AS int))) AS rx FROM range({WIDE}) r(i), (SELECT {_SYLLABLES!r} AS s) x)
SELECT doc_id, concat('r', i // 3) AS rule FROM documents JOIN p ON regexp_matches(text, rx) GROUP BY doc_id, i // 3""")
def o1_wide(spark, d):
    """Two hundred rules of three patterns each; one must occur."""
    s = _SYLLABLES
    rx = [f"(?i){s[i % 10]}{s[i // 10 % 10]}{s[i // 100 % 10]} ?{s[i * 7 % 10]}" for i in range(WIDE)]
    rules = [{"rule": f"r{r}", "need": 1, "patterns": {f"${j}": rx[3 * r + j] for j in range(3)}} for r in range(WIDE // 3)]
    return C.pattern_scan(table(spark, d, "documents"), rules)


@query("o1_script_patterns", oracle=r"""
WITH x AS (SELECT page_id, concat(html, CASE page_id % 6 WHEN 0 THEN ' powershell -nop IWR x' WHEN 1 THEN ' cmd.exe /q /c dir' WHEN 2 THEN ' http://10.1.2.3/' WHEN 3 THEN ' certutil.exe -urlcache' ELSE '' END) AS t FROM pages)
SELECT page_id, 'suspicious_powershell_download' AS rule FROM x WHERE regexp_matches(t, '(?i)powershell.{0,200}(IWR|Invoke-WebRequest|Net\.WebClient|DownloadString|DownloadFile|FromBase64String)') OR contains(t, '-enc ')
UNION ALL SELECT page_id, 'suspicious_cmd_commands' FROM x WHERE regexp_matches(t, '(?i)cmd\.exe.{0,100}(/c|/k)') OR regexp_matches(t, '(?i)certutil\.exe.{0,80}(decode|urlcache|encode)')
UNION ALL SELECT page_id, 'suspicious_urls' FROM x WHERE regexp_matches(t, '(?i)https?://[a-zA-Z0-9.\-]{5,}/[a-zA-Z0-9._\-]{5,}\.(exe|dll|bat|ps1|vbs|js|scr|cmd)') OR regexp_matches(t, 'https?://[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}')""")
def o1_script(spark, d):
    """The fixed script and command patterns over whole pages."""
    m = F.col("page_id") % 6
    add = F.when(m == 0, " powershell -nop IWR x").when(m == 1, " cmd.exe /q /c dir").when(m == 2, " http://10.1.2.3/").when(m == 3, " certutil.exe -urlcache").otherwise("")
    return C.pattern_scan(table(spark, d, "pages").select("page_id", F.concat("html", add).alias("t")), C.CONTENT_RULES, "page_id", "t")


@query("o2_pattern_hits", oracle=r"""
WITH p(rule, pattern, rx) AS (VALUES ('words', '$a', '(?i)license'), ('words', '$b', 'https?://[0-9a-z.]+'), ('nums', '$n', '[0-9]{3,}')),
h AS (SELECT doc_id, rule, pattern, regexp_extract_all(text, rx) AS hits, regexp_split_to_array(text, rx) AS pieces FROM documents, p WHERE regexp_matches(text, rx)),
i AS (SELECT doc_id, rule, pattern, hits, pieces, unnest(range(1, len(hits) + 1)) AS i FROM h)
SELECT doc_id, rule, pattern, CAST(length(array_to_string(pieces[1:i], '')) + length(array_to_string(hits[1:i - 1], '')) AS bigint) AS "offset", hits[i] AS data FROM i""")
def o2(spark, d):
    rules = [{"rule": "words", "patterns": {"$a": "(?i)license", "$b": "https?://[0-9a-z.]+"}}, {"rule": "nums", "patterns": {"$n": "[0-9]{3,}"}}]
    return C.pattern_hits(table(spark, d, "documents"), rules).withColumn("offset", F.col("offset").cast("bigint"))


@query("o3_guarded_rule", oracle="""
SELECT starts_with(text, 'Th') AS guarded, count(*) AS n, count(*) FILTER (WHERE CAST(contains(text, 'the ') AS int) + CAST(contains(text, 'and ') AS int) >= CASE WHEN starts_with(text, 'Th') THEN 2 ELSE 1 END) AS fired FROM documents GROUP BY 1""")
def o3(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").groupBy(_guard(t).alias("guarded")).agg(F.count("*").alias("n"), F.count_if(C.rule_fires(RULES[2], t, _guard(t))).alias("fired"))


@query("o4_describe_patterns", oracle=f"""
WITH {_FIRES.strip()}, c(rule, n_patterns) AS (VALUES ('redline_words', 2), ('heodo_mix', 3), ('guarded', 2)) SELECT c.rule, CAST(c.n_patterns AS bigint) AS n_patterns, count(f.doc_id) AS docs FROM c LEFT JOIN f ON f.rule = c.rule GROUP BY 1, 2""")
def o4(spark, d):
    """Catalog entries with the documents each rule fires on."""
    cat = C.describe_patterns(spark, RULES).groupBy("rule").agg(F.count("*").alias("n_patterns"))
    hits = C.pattern_scan(table(spark, d, "documents"), RULES, guard=_guard).groupBy("rule").agg(F.count("*").alias("docs"))
    return cat.join(hits, "rule", "left").select("rule", "n_patterns", F.coalesce("docs", F.lit(0)).alias("docs"))


@query("o5_family_hits", oracle=f"WITH {_FIRES.strip()} SELECT CASE rule WHEN 'redline_words' THEN 'redline' ELSE 'emotet' END AS family, count(*) AS n FROM f WHERE rule <> 'guarded' GROUP BY 1")
def o5(spark, d):
    hits = C.family_hits(C.pattern_scan(table(spark, d, "documents"), RULES, guard=_guard))
    return hits.groupBy("family").agg(F.count("*").alias("n"))
