"""The registered queries of the training-data operators, and their SQL twins where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from detectframe.catalog.base import table
from detectframe.llm import collocations, exact_topk, language_id, license_scan, merkle_manifest, mixing, near_dedup, packing, paragraph_dedup, quality_classifier, quality_rules, suffix_dedup, url_filters

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle.strip()
        return fn

    return register


@query("op1_paragraph_dedup")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraph_dedup.paragraph_removals(table(spark, sf_dir, "documents"))


@query("op2_source_mixing")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_to_targets(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op3_best_fit_packing")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents")).drop("fill")


@query("op4_near_dedup")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_dedup(table(spark, sf_dir, "documents"), k=4, percent=80)


@query("op5_quality_classifier")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op6_suffix_dedup")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeated_spans(table(spark, sf_dir, "documents")).drop("spans")


URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


@query(
    "op7_url_filters",
    """
WITH rest AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages),
parts AS (
  SELECT page_id, translate(regexp_extract(r, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
rules(h, p, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
fits AS (
  SELECT page_id, concat(h, p) AS rule, v, row_number() OVER (PARTITION BY page_id ORDER BY length(h) + length(p) DESC, length(h) DESC) AS k
  FROM parts JOIN rules ON (host = h OR ends_with(host, concat('.', h))) AND starts_with(path, p))
SELECT parts.page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM parts LEFT JOIN fits ON parts.page_id = fits.page_id AND k = 1
""",
)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.url_verdicts(table(spark, sf_dir, "pages"), url_filters.rule_table(spark, URL_RULES))


@query(
    "op8_exact_topk",
    """
WITH ok AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS double) * 64) AS bigint)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT q.vec_id AS query_id, x.vec_id, CAST(list_sum(list_transform(list_zip(q.v, x.v), lambda z: z[1] * z[2])) AS bigint) AS score
  FROM ok q JOIN ok x ON q.vec_id % 20 = 0 AND q.vec_id <> x.vec_id)
SELECT query_id, CAST(r AS integer) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM pairs) WHERE r <= 20
""",
)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_topk.top_k(exact_topk.quantized(table(spark, sf_dir, "embeddings")), F.col("vec_id") % 20 == 0, 20)


@query("op9_language_id")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(quality_classifier.fold("doc_id", 4) == 2, F.lit(False))
    model = language_id.fit(docs.where(~held))
    return language_id.predict(docs, model).select("doc_id", held.alias("held_out"), "lang_pred", "score")


@query(
    "op10_quality_rules",
    r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM t),
m AS (
  SELECT doc_id, CAST(len(words) AS bigint) AS n_words, CAST(length(list_aggregate(words, 'string_agg', '')) AS bigint) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS bigint) AS n_symbols FROM w),
l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM t),
d AS (
  SELECT doc_id, CAST(count(*) AS bigint) AS n_lines, CAST(count(*) - count(DISTINCT line) AS bigint) AS n_dup_lines
  FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
p AS (
  SELECT doc_id, unnest(words) AS x, generate_subscripts(words, 1) AS i FROM w),
g AS (
  SELECT doc_id, i, concat(x, ' ', lead(x) OVER q, ' ', lead(x, 2) OVER q) AS g, lead(x, 2) OVER q IS NOT NULL AS whole FROM p WINDOW q AS (PARTITION BY doc_id ORDER BY i)),
c AS (
  SELECT doc_id, i, CASE WHEN whole AND count(*) OVER (PARTITION BY doc_id, g, whole) > 1 THEN 1 ELSE 0 END AS hit FROM g),
r AS (
  SELECT doc_id, CAST(sum(h) AS bigint) AS n_repeat_words FROM (
    SELECT doc_id, max(hit) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS h FROM c) GROUP BY doc_id),
a AS (
  SELECT m.doc_id, n_words, coalesce(word_chars, 0) AS word_chars, n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines
  FROM m LEFT JOIN d ON m.doc_id = d.doc_id LEFT JOIN r ON m.doc_id = r.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR n_symbols > n_words OR (n_lines >= 4 AND 100 * n_dup_lines > 50 * n_lines)
    OR word_chars > 25 * n_words OR (n_words > 0 AND 2 * word_chars < 3 * n_words)) AS kept
FROM a
""",
)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality_rules.apply_policy(quality_rules.ledger(table(spark, sf_dir, "documents")), quality_rules.STRICT)
    base = F.col("failed").bitwiseAND(F.lit(quality_rules.BASE.mask)) != 0
    return rows.select("doc_id", *quality_rules.MEASURES[:5], base.alias("base_failed"), "kept")


@query(
    "op11_collocations",
    r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, doc_id,
    unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM p),
t AS (SELECT lang, CAST(sum(len(words)) AS bigint) AS n FROM w GROUP BY lang),
one AS (SELECT lang, x, count(*) AS f FROM (SELECT lang, unnest(words) AS x FROM w) GROUP BY ALL),
two AS (
  SELECT lang, x, y, count(*) AS f FROM (
    SELECT lang, unnest(words[:-2]) AS x, unnest(words[2:]) AS y FROM w WHERE len(words) > 1) GROUP BY ALL),
three AS (
  SELECT lang, x, y, z, count(*) AS f FROM (
    SELECT lang, unnest(words[:-3]) AS x, unnest(words[2:-2]) AS y, unnest(words[3:]) AS z FROM w WHERE len(words) > 2) GROUP BY ALL HAVING count(*) >= 10),
around AS (
  SELECT lang, x, y, max(f) AS f FROM (SELECT lang, x, y, f FROM three UNION ALL SELECT lang, y, z, f FROM three) GROUP BY ALL),
c AS (
  SELECT two.lang, concat(two.x, ' ', two.y) AS phrase, two.f AS a, 1 AS k, l.f AS l, r.f AS r
  FROM two JOIN one l ON l.lang = two.lang AND l.x = two.x JOIN one r ON r.lang = two.lang AND r.x = two.y
  LEFT JOIN around ON around.lang = two.lang AND around.x = two.x AND around.y = two.y
  WHERE two.f >= 10 AND (around.f IS NULL OR 100 * around.f < 50 * two.f)
  UNION ALL
  SELECT three.lang, concat(three.x, ' ', three.y, ' ', three.z), three.f, 1, l.f, r.f
  FROM three JOIN one l ON l.lang = three.lang AND l.x = three.x JOIN two r ON r.lang = three.lang AND r.x = three.y AND r.y = three.z
  UNION ALL
  SELECT three.lang, concat(three.x, ' ', three.y, ' ', three.z), three.f, 2, l.f, r.f
  FROM three JOIN two l ON l.lang = three.lang AND l.x = three.x AND l.y = three.y JOIN one r ON r.lang = three.lang AND r.x = three.z),
s AS (SELECT *, CAST((CAST(1000000 AS hugeint) * a * a) // (CAST(l AS hugeint) * r) AS bigint) AS score FROM c),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT b.lang, rank, phrase, a, l, r, t.n, score FROM (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM b) b JOIN t ON t.lang = b.lang WHERE rank <= 2000
""",
)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"), least=10, share=50, report=2000)


def _merkle_sql() -> str:
    """Leaves, then one level after the other for sources and for the list of their roots, then the way back."""

    def h(*cols: str) -> str:
        return "sha256(concat(" + ", ".join(f"coalesce(concat(strlen(CAST({c} AS varchar)), ':', {c}), '-')" for c in cols) + "))"

    crc = """list_reduce(list_transform(range(8 * length(CAST(doc_id AS varchar))), lambda i: CAST(CASE WHEN i % 8 = 0 THEN ascii(substr(CAST(doc_id AS varchar), CAST(i // 8 AS int) + 1, 1)) ELSE 0 END AS bigint)),
      lambda c, x: CASE WHEN xor(c, x) % 2 = 1 THEN xor(xor(c, x) // 2, 3988292384) ELSE xor(c, x) // 2 END, CAST(4294967295 AS bigint))"""

    def tree(name: str, start: str) -> str:
        return f"""{name}(g, lvl, pos, h, n) AS (
  {start}
  UNION ALL
  SELECT g, lvl + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), (max(n) + 2) // 3 FROM {name} WHERE n > 1 GROUP BY g, lvl, pos // 3),
{name}_sib AS (
  SELECT x.g, x.lvl, x.pos, coalesce(string_agg(y.h, '' ORDER BY y.pos) FILTER (WHERE y.pos < x.pos), '') AS before,
    coalesce(string_agg(y.h, '' ORDER BY y.pos) FILTER (WHERE y.pos > x.pos), '') AS after
  FROM {name} x JOIN {name} y ON x.g = y.g AND x.lvl = y.lvl AND x.pos // 3 = y.pos // 3 WHERE x.n > 1 GROUP BY ALL)"""

    return f"""
WITH RECURSIVE leaf AS (
  SELECT doc_id, source, coalesce(concat('=', source), '') AS g, {h('doc_id', 'source', 'lang', 'n_chars', 'text')} AS leaf,
    CASE WHEN xor({crc}, 4294967295) % 2 = 0 THEN {h('doc_id', 'source', 'lang', 'n_chars', "replace(text, chr(10), '')")} END AS other FROM documents),
places AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY g) AS n FROM leaf),
{tree('low', 'SELECT g, 0, pos, leaf, n FROM places')},
subroots AS (SELECT g, h AS subroot, row_number() OVER (ORDER BY encode(g)) - 1 AS pos, count(*) OVER () AS n FROM low WHERE n = 1),
{tree('top', "SELECT '', 0, pos, subroot, n FROM subroots")},
way AS (
  SELECT p.g, p.pos AS leaf_pos, s.lvl, s.before, s.after FROM places p JOIN low_sib s ON s.g = p.g AND s.pos = p.pos // CAST(pow(3, s.lvl) AS bigint)
  UNION ALL
  SELECT p.g, p.pos, 1000 + s.lvl, s.before, s.after FROM places p JOIN subroots r ON r.g = p.g JOIN top_sib s ON s.pos = r.pos // CAST(pow(3, s.lvl) AS bigint)),
paths AS (
  SELECT g, leaf_pos, string_agg(concat(before, after), '' ORDER BY lvl) AS proof, list(before ORDER BY lvl) AS befores, list(after ORDER BY lvl) AS afters FROM way GROUP BY ALL),
folds AS (
  SELECT p.*, coalesce(proof, '') AS proof, list_reduce(
    list_prepend(coalesce(other, leaf), coalesce(list_transform(list_zip(befores, afters), lambda z: concat(z[1], '|', z[2])), [])),
    lambda x, y: sha256(concat(split_part(y, '|', 1), x, split_part(y, '|', 2)))) AS folded_root
  FROM places p LEFT JOIN paths w ON w.g = p.g AND w.leaf_pos = p.pos)
SELECT doc_id, leaf, subroot, (SELECT h FROM top WHERE n = 1) AS root, sha256(proof) AS proof_sha256, folded_root, folded_root = (SELECT h FROM top WHERE n = 1) AS verified
FROM folds JOIN subroots ON subroots.g = folds.g
"""


@query("op12_merkle_manifest", _merkle_sql())
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return merkle_manifest.audit(docs, F.crc32(F.col("doc_id").cast("string")) % 2 == 0).drop("copied")


@query("op13_license_scan")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))
