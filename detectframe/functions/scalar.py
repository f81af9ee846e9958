"""Scalar functions as Catalyst expressions; only the entropy of whole texts counts in Arrow batches."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

KV_PATTERN = r"([A-Za-z_][A-Za-z0-9_]*)=([^\s]+)"
KV_PATTERN_LOOSE = r"(\w+)=([^\s]*)"
_TRUTHY_INT = (
    r"^\s*[+-]?(0[xX]0*[1-9a-fA-F][0-9a-fA-F]*|0[oO]0*[1-7][0-7]*|0[bB]0*1[01]*|[1-9][0-9]*)\s*$"
)


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once per row and use it many times in ``body(value)``.

    A Column used inside a lambda would otherwise be computed again per element.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def as_int(c: Column) -> Column:
    """Decimal integer text to bigint; anything else is NULL, never an error."""
    return F.trim(c.cast("string")).try_cast("bigint")


def as_num(c: Column) -> Column:
    return F.trim(c.cast("string")).try_cast("double")


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def parse_kv(arg: Column, pattern: str = KV_PATTERN) -> Column:
    """K1: every ``key=value`` token, the last one of a key wins; none -> ``{_raw: arg}``."""
    text = F.coalesce(arg, F.lit(""))
    found = F.struct(
        F.reverse(F.regexp_extract_all(text, F.lit(pattern), F.lit(1))).alias("k"),
        F.reverse(F.regexp_extract_all(text, F.lit(pattern), F.lit(2))).alias("v"),
    )

    def build(x):
        # reversed, so the first position of a key is its last occurrence in the text
        pick = lambda names: F.map_from_arrays(
            names, F.transform(names, lambda k: F.get(x["v"], F.array_position(x["k"], k).cast("int") - 1))
        )
        return F.when(F.size(x["k"]) > 0, let(F.array_distinct(x["k"]), pick)).otherwise(F.create_map(F.lit("_raw"), text))

    return let(found, build)


def kv_int(kv: Column, key: str) -> Column:
    """K2: integer value of a key."""
    return as_int(kv[key])


def kv_bool(kv: Column, key: str) -> Column:
    """K2: ``1`` is true, ``0`` false, else any base-0 integer other than zero."""
    return F.coalesce(kv[key].rlike(_TRUTHY_INT), F.lit(False))


def _bits(counts: np.ndarray) -> float:
    """Shannon entropy of symbol counts; the counts are ordered, so equal ones give equal bits."""
    p = np.sort(counts[counts > 0]) / counts.sum()
    return float(-(p * np.log2(p)).sum()) + 0.0


def _text_bits(texts: pd.Series) -> pd.Series:
    def one(text: str) -> float:
        raw = text.encode()
        counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
        if counts[128:].any():
            # the ASCII letters are counted by now; the others by code point
            wide = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
            counts = np.concatenate([counts[:128], np.unique(wide[wide >= 128], return_counts=True)[1]])
        return _bits(counts)

    return pd.Series([one(t) if t else 0.0 for t in texts], dtype="float64")


def _byte_bits(values: pd.Series) -> pd.Series:
    return pd.Series([_bits(np.bincount(np.frombuffer(v, np.uint8), minlength=256)) if v else 0.0 for v in values], dtype="float64")


def entropy_text(s: Column) -> Column:
    """K3: Shannon entropy of the characters, bits; empty or NULL -> 0.  One counting pass over Arrow batches."""
    return F.pandas_udf(_text_bits, DoubleType())(s.cast("string"))


def entropy_bytes(content: Column) -> Column:
    """K3: Shannon entropy of a binary column, rounded to 4 digits; empty or NULL -> 0."""
    return F.round(F.pandas_udf(_byte_bits, DoubleType())(content.cast("binary")), 4)


def entropy_label(s: Column) -> Column:
    """K3 for short names, as host labels: a fold over the sorted characters, so predicates stay in the JVM."""
    n = F.char_length(s).cast("double")
    add = lambda acc: F.when(acc["k"] > 0, acc["bits"] - acc["k"] / n * F.log2(acc["k"] / n)).otherwise(acc["bits"])
    state = lambda last, k, bits: F.struct(last.alias("last"), k.alias("k"), bits.alias("bits"))
    first = state(F.lit(""), F.lit(0.0), F.lit(0.0))
    step = lambda acc, c: F.when(acc["last"] == c, state(c, acc["k"] + 1.0, acc["bits"])).otherwise(state(c, F.lit(1.0), add(acc)))
    bits = F.aggregate(F.array_sort(F.split(s, "")), first, step, add)
    return F.when(F.coalesce(F.octet_length(s), F.lit(0)) > 0, bits).otherwise(F.lit(0.0))


def basename(path: Column) -> Column:
    """K4: last component of a Windows or POSIX path, lower case; NULL -> empty."""
    flat = F.translate(F.coalesce(path, F.lit("")), "/", "\\")
    return F.lower(F.substring_index(flat, "\\", -1))


def parse_time(raw: Column) -> Column:
    """K5: ISO-8601 or ``Y-m-d H:M:S[.f]`` text to naive UTC; bad text is NULL.

    An explicit offset is applied, then dropped, so all results share one clock
    (the session time zone is expected to be UTC).
    """
    s = F.trim(raw.cast("string"))
    ok = s.rlike(
        r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})?)?$"
    )
    cut = F.regexp_replace(s, r"(\.\d{6})\d+", "$1")
    return F.when(ok, cut.try_cast("timestamp"))


def hex_to_int(h: Column) -> Column:
    """Hex digits (with or without 0x) to bigint; not hex -> NULL."""
    digits = F.regexp_replace(F.lower(F.trim(h)), "^0x", "")
    return F.when(digits.rlike("^[0-9a-f]{1,16}$"), F.conv(digits, 16, 10).try_cast("bigint"))


def hex8(v: Column) -> Column:
    """K6: ``0x%08x`` of an integer text; other text is returned as it is."""
    text = F.trim(v.cast("string"))
    digits = F.when(text.rlike("^0[xX][0-9a-fA-F]{1,16}$"), F.regexp_replace(F.lower(F.substring(text, 3, 16)), "^0+(?=.)", "")).when(
        text.rlike("^([1-9][0-9]*|0+)$"), F.lower(F.hex(text.try_cast("bigint")))
    )
    padded = let(digits, lambda h: F.when(F.length(h) < 8, F.lpad(h, 8, "0")).otherwise(h))
    return F.coalesce(F.concat(F.lit("0x"), padded), v.cast("string"))


def hashes(content: Column) -> Column:
    """K7: md5, sha1 and sha256 of a binary or string column, as one struct."""
    return F.struct(
        F.md5(content).alias("md5"), F.sha1(content).alias("sha1"), F.sha2(content, 256).alias("sha256")
    )


def extract_strings(text: Column, min_len: int = 4, max_n: int | None = None) -> Column:
    """K8: runs of printable ASCII; ``max_n`` is the feature's own cap (None = all)."""
    runs = F.regexp_extract_all(text, F.lit("([\\x20-\\x7E]{%d,})" % min_len), F.lit(1))
    return runs if max_n is None else F.slice(runs, 1, max_n)


# fixed values: what makes a string worth a look (url, drive path, relative path, ipv4, tool)
INTERESTING = [
    r"(?i)https?://[^\s\"]+",
    r"[A-Za-z]:\\[^\s\"]+",
    r"\\(?:[\w\-]+\\)+[\w\-]+\.\w+",
    r"\b(?:\d{1,3}\.){3}\d{1,3}\b",
    r"(?i)powershell|cmd\.exe|rundll32|regsvr32|mshta|certutil",
]


def interesting_strings(strings: Column, max_n: int | None = None) -> Column:
    """K9: sorted distinct strings that look like an indicator."""
    joined = "|".join(f"(?:{p})" for p in INTERESTING)
    kept = F.array_sort(F.array_distinct(F.filter(strings, lambda s: s.rlike(joined))))
    return kept if max_n is None else F.slice(kept, 1, max_n)


def norm_ioc(kind: Column, value: Column) -> Column:
    """Matchable parts (domain, ip, port) of one indicator; NULL for other kinds."""
    v = F.lower(F.trim(value))
    host = F.split_part(
        F.split_part(F.element_at(F.split(v, "://", 2), -1), F.lit("/"), F.lit(1)), F.lit(":"), F.lit(1)
    )
    none = F.lit(None).cast("string")
    parts = lambda d, i, p: F.struct(d.alias("domain"), i.alias("ip"), p.alias("port"))
    return (
        F.when(F.coalesce(v, F.lit("")) == "", None)
        .when(kind == "domain", parts(v, none, none))
        .when(
            kind == "ip:port",
            parts(none, F.substring_index(v, ":", 1), F.when(v.contains(":"), F.regexp_replace(v, "^[^:]*:", ""))),
        )
        .when(kind == "ip", parts(none, v, none))
        .when(kind == "url", parts(host, none, none))
    )


def technique_parent(t: Column) -> Column:
    """``T1055.012`` -> ``T1055``."""
    return F.substring_index(t, ".", 1)


HIGH_ENTROPY = 7.2  # fixed value
MEM_EXECUTE = 0x20000000  # fixed value


def packing(entropy: Column, sections: Column) -> Column:
    """Whole content or any executable section above the entropy limit.

    ``sections`` is ``array<struct<name, characteristics:string(hex), entropy:double>>``.
    """
    hot = F.exists(
        sections,
        lambda s: (hex_to_int(s["characteristics"]).bitwiseAND(F.lit(MEM_EXECUTE)) != 0)
        & (s["entropy"] > HIGH_ENTROPY),
    )
    return F.coalesce(entropy > HIGH_ENTROPY, F.lit(False)) | F.coalesce(hot, F.lit(False))


# fixed values: leading bytes (hex) and extension fallback
MAGIC = [
    ("4D5A", "exe", "application/x-msdownload"),
    ("504B0304", "zip", "application/zip"),
    ("25504446", "pdf", "application/pdf"),
    ("7F454C46", "elf", "application/x-executable"),
    ("89504E470D0A1A0A", "png", "image/png"),
    ("FFD8FF", "jpg", "image/jpeg"),
    ("1F8B08", "gz", "application/gzip"),
    ("52617221", "rar", "application/x-rar-compressed"),
    ("377ABCAF271C", "7z", "application/x-7z-compressed"),
]
EXTENSION_MIME = {
    ".exe": ("exe", "application/x-msdownload"),
    ".dll": ("dll", "application/x-msdownload"),
    ".bat": ("bat", "text/x-msdos-batch"),
    ".ps1": ("ps1", "text/x-powershell"),
    ".cmd": ("cmd", "text/x-msdos-batch"),
}


def file_magic(content: Column, filename: Column) -> Column:
    """(extension, mime) by leading bytes, else by file extension, else octet-stream."""
    head = F.hex(F.substring(content, 1, 8))
    ext = F.lower(F.regexp_extract(F.coalesce(filename, F.lit("")), r"[^\\/.](\.[^.\\/]*)$", 1))
    pair = lambda e, m: F.struct(F.lit(e).alias("extension"), F.lit(m).alias("mime"))
    out = None
    for magic, e, m in MAGIC:
        cond = head.startswith(magic)
        out = F.when(cond, pair(e, m)) if out is None else out.when(cond, pair(e, m))
    for suffix, (e, m) in EXTENSION_MIME.items():
        out = out.when(ext == suffix, pair(e, m))
    return out.otherwise(F.struct(ext.alias("extension"), F.lit("application/octet-stream").alias("mime")))


def json_path(doc: Column, path: str) -> Column:
    """Nested field of a JSON document column, as text."""
    return F.get_json_object(doc, path)


def row_json(*cols: str) -> Column:
    """The row as JSON text (all columns by default)."""
    return F.to_json(F.struct(*(cols or ("*",))))


def row_contains(needle: str, *cols: str) -> Column:
    """Case-insensitive substring test over the row's JSON text."""
    return F.lower(row_json(*cols)).contains(needle.lower())
